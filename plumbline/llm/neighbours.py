"""Approximate nearest neighbours by learned partitions.

On a bounded sample, the graph of each vector's nearest ones is cut into balanced parts: halves by
the second eigenvector of the graph, evened out by swaps, and the halves again.  A small network
learns to tell a vector's part, and the parts of its neighbours, from the vector.  It files every
vector under its most probable part; a query is routed to its several most probable parts and
compared exactly with all vectors there.  How many parts a query visits is read off the sample: the
fewest with which other sampled vectors find the wanted share of their true neighbours.

Parts are read in chunks of bounded size, so a vector that a third of all rows repeat, or a part
that outgrows the others, is spread over many tasks.

Edge cases: vectors that are null, empty, zero or hold a null or non-finite component take no part,
nor do rows without vec_id or of another length than most; equal rows count once; where one vec_id
names several vectors, the best counts, and the query is the first of them; equal scores go to the
smaller vec_id; with fewer candidates than wanted all are returned; an empty table gives an empty
result; columns other than vec_id and embedding are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import stored

SAMPLE = 4096
PER_PART = 1600            # rows of a part, on average, until there are MOST_PARTS
MOST_PARTS = 256
DEGREE = 10                # edges of a vector in the neighbour graph
RECALL = 0.95              # share of true neighbours wanted on the sample
CHUNK = 8192               # vectors compared in one task
QUERIES = 4096             # queries compared in one task


# --- learning the parts ----------------------------------------------------------------------

def _nearest(x: np.ndarray, pool: np.ndarray, k: int, own: bool) -> np.ndarray:
    """Rows of pool with the largest inner products to each row of x; own: x is pool."""
    out = []
    for at in range(0, len(x), 512):
        s = x[at:at + 512] @ pool.T
        if own:
            s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out.append(np.argsort(-s, axis=1, kind="stable")[:, :k])
    return np.concatenate(out) if out else np.zeros((0, k), np.int64)


def _halves(adj: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Two equal halves of a graph with few edges between them."""
    n = len(adj)
    degree = adj.sum(axis=1) + 1e-9
    root = np.sqrt(degree)
    v = rng.normal(size=n)
    for _ in range(60):  # power iteration towards the second eigenvector
        v -= root * (root @ v) / (root @ root)
        v = v + (adj @ (v / root)) / root
        v /= np.linalg.norm(v) + 1e-12
    side = np.zeros(n, bool)
    side[np.argsort(v, kind="stable")[n // 2:]] = True
    for _ in range(20):  # swap the pairs that gain most
        gain = np.where(side, adj @ ~side - adj @ side, adj @ side - adj @ ~side)
        up, down = np.flatnonzero(side), np.flatnonzero(~side)
        up, down = up[np.argsort(-gain[up])], down[np.argsort(-gain[down])]
        m = min(len(up), len(down), max(1, n // 50))
        good = gain[up[:m]] + gain[down[:m]] > 2 * adj[up[:m], down[:m]]
        if not good.any():
            break
        side[up[:m][good]], side[down[:m][good]] = False, True
    return side


def balanced_parts(near: np.ndarray, parts: int) -> np.ndarray:
    """Parts of nearly equal size of the graph joining every row with those in near; parts is a
    power of two."""
    n = len(near)
    adj = np.zeros((n, n), np.float32)
    adj[np.arange(n)[:, None], near] = 1
    adj = np.maximum(adj, adj.T)
    rng = np.random.default_rng(0)
    part = np.zeros(n, np.int64)
    count = 1
    while count < parts:
        new = part * 2
        for p in range(count):
            rows = np.flatnonzero(part == p)
            if len(rows) > 1:
                new[rows] += _halves(adj[np.ix_(rows, rows)], rng)
        part, count = new, count * 2
    return part


class Router(NamedTuple):
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    visits: int     # parts a query is compared with

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2

    def parts(self, x: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(-self.logits(x), axis=1, kind="stable")[:, :n]


def _classifier(x: np.ndarray, wanted: np.ndarray, hidden: int = 128, epochs: int = 40) -> Router:
    """A network of one hidden layer; wanted: each row's distribution over parts."""
    rng = np.random.default_rng(0)
    d, k = x.shape[1], wanted.shape[1]
    p = [rng.normal(0, d ** -0.5, (d, hidden)), np.zeros(hidden),
         rng.normal(0, hidden ** -0.5, (hidden, k)), np.zeros(k)]
    m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 256):
            rows = order[at:at + 256]
            h = np.tanh(x[rows] @ p[0] + p[1])
            z = h @ p[2] + p[3]
            e = np.exp(z - z.max(axis=1)[:, None])
            d2 = (e / e.sum(axis=1)[:, None] - wanted[rows]) / len(rows)
            d1 = (d2 @ p[2].T) * (1 - h * h)
            grads = [x[rows].T @ d1, d1.sum(axis=0), h.T @ d2, d2.sum(axis=0)]
            step += 1
            for i, g in enumerate(grads):
                g = g + 1e-4 * p[i]
                m[i] += 0.1 * (g - m[i])
                v[i] += 0.01 * (g * g - v[i])
                p[i] -= 0.003 * (m[i] / (1 - 0.9 ** step)) / (
                    np.sqrt(v[i] / (1 - 0.99 ** step)) + 1e-8)
    return Router(*p, 1)


def learn(x: np.ndarray, parts: int, k: int, recall: float = RECALL) -> Router:
    """The router fitted to sampled vectors (scaled to length 1 for learning and routing)."""
    d = x.shape[1] if len(x) else 0
    if parts == 1 or len(x) < 4 * parts:
        return Router(np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    aside = max(1, len(x) // 8)   # these only measure recall
    fit, test = x[aside:], x[:aside]
    unit = fit / np.linalg.norm(fit, axis=1)[:, None]
    near = _nearest(fit, fit, DEGREE, own=True)
    part = balanced_parts(near, parts)
    wanted = np.zeros((len(fit), parts))
    wanted[np.arange(len(fit)), part] += DEGREE / 2
    np.add.at(wanted, (np.arange(len(fit))[:, None], part[near]), 1)
    wanted /= wanted.sum(axis=1)[:, None]
    router = _classifier(unit, wanted)
    filed = router.parts(unit, 1)[:, 0]
    true = _nearest(test, fit, k, own=False)
    order = router.parts(test / np.linalg.norm(test, axis=1)[:, None], parts)
    place = np.argsort(order, axis=1)  # of each part in a query's order
    found = place[np.arange(len(test))[:, None], filed[true]]
    share = [(found < n).mean() for n in range(1, parts + 1)]
    return router._replace(visits=1 + next(i for i, s in enumerate(share) if s >= recall))


# --- search ----------------------------------------------------------------------------------

def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, d)


def _packed(batches: Iterator) -> Iterator:
    for b in batches:
        rows = [np.asarray(r, np.float64).tobytes() for r in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())],
                                         names=["vec_id", "vec"])


def vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vec): the rows that take part, each once, components as doubles in one binary."""
    usable = embeddings.select("vec_id", "embedding").where(
        F.col("vec_id").isNotNull() & (F.size("embedding") > 0)
        & F.forall("embedding", lambda x: F.coalesce(
            x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
        & F.exists("embedding", lambda x: x != 0))
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    packed = usable.mapInArrow(_packed, f"vec_id {kind}, vec binary").distinct()
    return stored(packed, "vectors")


def _routed(batches: Iterator, router: Router, d: int, visits: int) -> Iterator:
    for b in batches:
        if b.num_rows:
            x = _matrix(b.column(1), d)
            parts = router.parts(x / np.linalg.norm(x, axis=1)[:, None], visits)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(list(parts.astype(np.int32)),
                                                    pa.list_(pa.int32()))],
                names=["vec_id", "vec", "parts"])


def nearest(query: np.ndarray, x: np.ndarray, ids: np.ndarray, own: int, scores: np.ndarray,
            k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k ids with the largest products, ties to the smaller; scores are the products up to
    rounding, and only rows that may count are multiplied again, each in the same way."""
    if len(ids) > k + 1:
        edge = np.partition(scores, len(ids) - k - 1)[len(ids) - k - 1]
        scale = np.abs(scores).max() + np.linalg.norm(query)
        rows = np.flatnonzero(scores >= edge - 1e-9 * scale)
    else:
        rows = np.arange(len(ids))
    rows = rows[ids[rows] != own]
    exact = (x[rows] * query).sum(axis=1) + 0.0  # no negative zero
    best = np.lexsort((ids[rows], -exact))[:k]
    return ids[rows][best], exact[best]


def _search(left: pa.Table, right: pa.Table, d: int, k: int) -> pa.Table:
    """left: vectors of one chunk, right: the queries routed to its part; a row per query."""
    asked, out_v, out_s = [], [], []
    if len(left) and len(right):
        x, q = (_matrix(t.column("vec"), d) for t in (left, right))
        ids, queries = (t.column("vec_id").to_numpy() for t in (left, right))
        for at in range(0, len(q), 256):
            block = q[at:at + 256] @ x.T
            for i, scores in enumerate(block, at):
                got, exact = nearest(q[i], x, ids, queries[i], scores, k)
                asked.append(queries[i])
                out_v.append(got)
                out_s.append(exact)
    return pa.table({"query_id": pa.array(asked, pa.int64()),
                     "ids": pa.array(out_v, pa.list_(pa.int64())),
                     "scores": pa.array(out_s, pa.list_(pa.float64()))})


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of every query; what a query found in a part stays one row."""
    pairs = F.flatten(F.collect_list(F.transform(
        F.arrays_zip("ids", "scores"),
        lambda p: F.struct(p["ids"].alias("vec_id"), (F.lit(0.0) - p["scores"]).alias("less")))))
    by_id = F.array_sort("pairs")  # a vec_id's best comes first
    once = F.filter("pairs", lambda p, i: (i == 0) | (
        F.col("pairs")[F.greatest(i - 1, F.lit(0))]["vec_id"] != p["vec_id"]))
    ranked = F.slice(F.array_sort(F.transform("pairs", lambda p: F.struct(
        p["less"].alias("less"), p["vec_id"].alias("vec_id")))), 1, k)
    return found.groupBy("query_id").agg(pairs.alias("pairs")).withColumn("pairs", by_id).withColumn(
        "pairs", once).select("query_id", F.posexplode(ranked).alias("at", "p")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("p.vec_id").alias("vec_id"),
        (F.lit(0.0) - F.col("p.less")).alias("score"))


def search(embeddings: DataFrame, is_query: Column, k: int = 20, sample: int = SAMPLE,
           recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row that is_query picks."""
    rows = vectors(embeddings)
    sizes = rows.groupBy(F.octet_length("vec").alias("bytes")).agg(F.count("*").alias("n"))
    most = sizes.orderBy(F.desc("n"), "bytes").first()
    d, n = (most["bytes"] // 8, most["n"]) if most else (1, 0)
    rows = rows.where(F.octet_length("vec") == 8 * d)
    parts = 1
    while parts < MOST_PARTS and n > 1.5 * parts * PER_PART:
        parts *= 2
    got = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "vec").limit(sample).select("vec").collect()
    x = np.frombuffer(b"".join(bytes(r["vec"]) for r in got), np.float64).reshape(-1, d)
    router = learn(x, parts, k, recall)
    route = partial(_routed, router=router, d=d)
    schema = "vec_id long, vec binary, parts array<int>"
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "vec")
    filed = stored(rows.mapInArrow(partial(route, visits=1), schema).select(
        "vec_id", "vec", F.col("parts")[0].alias("part")), "filed")
    asked = rows.where(is_query).groupBy("vec_id").agg(F.min("vec").alias("vec")).mapInArrow(
        partial(route, visits=router.visits), schema)
    asked = stored(asked.select("vec_id", "vec", F.explode("parts").alias("part")), "asked")
    # one row per part
    chunks = filed.groupBy("part").agg(F.ceil(F.count("*") / CHUNK).alias("chunks")).join(
        asked.groupBy("part").agg(F.ceil(F.count("*") / QUERIES).alias("groups")), "part")
    left = filed.join(F.broadcast(chunks), "part").select(
        "vec_id", "vec", "part", F.pmod(F.xxhash64("vec_id"), "chunks").alias("chunk"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("group"))
    right = asked.join(F.broadcast(chunks), "part").select(
        "vec_id", "vec", "part", F.explode(F.sequence(
            F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"),
        F.pmod(F.xxhash64("vec_id"), "groups").alias("group"))
    keys = ["part", "chunk", "group"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        partial(_search, d=d, k=k), "query_id long, ids array<bigint>, scores array<double>")
    return _best(found, k)
