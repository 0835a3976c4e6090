"""Near duplicates by SimHash, candidates pruned by pigeonring filtering.

A fingerprint of W bits is cut into m segments lying on a ring.  If two fingerprints differ in at
most t bits, some segment starts a chain whose every prefix of l segments differs in at most
l*t/m bits (the pigeonring principle).  Where t < m that first segment agrees exactly, and so do
at least m-t segments in all; a row is therefore filed under every choice of m-t segments, its
candidates are the rows under the same key, and a candidate is compared in full only if one of the
key's segments starts a chain within the proportional budgets.  No link is lost.

Rows of one key are compared where they meet and leave only the edges of a spanning forest, so a
group of copies never turns into all its pairs.  Keys with more than `dense` different
fingerprints are not gathered at all: two of them within t bits share a point within t/2 bits of
both, so rows are filed under all such points, one least row per point, and no two rows meet.

Edge cases: null and empty texts have fingerprint zero and link like any other; equal texts share
their fingerprint and thereby their group; a repeated row stays a row; an empty table gives an
empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import sized, small_batches, stored, utf8
from plumbline.llm.graph import components

CHAIN = 4          # segments of a chain that are looked at before the full comparison
DENSE = 4096       # different fingerprints under one key that are still compared in one place


def shingle_hashes(data: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `words` words, A-Z lower-cased, joined by one space."""
    parts = data.lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    line = b" ".join(parts)
    n = max(1, len(parts) - words + 1)
    ends = list(accumulate([len(p) + 1 for p in parts]))
    digest = xxhash.xxh64_intdigest
    starts = [0, *ends[:n - 1]]
    return np.array([digest(line[a:b - 1], 42) for a, b in
                     zip(starts, ends[min(words, len(parts)) - 1:], strict=False)], np.uint64)


def fingerprint(data: bytes, words: int = 4) -> bytes:
    """A bit is 1 if it is set in over half of the shingles' hashes, repeated ones as often as they
    occur; highest bit first."""
    h = shingle_hashes(data, words)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 255 * 64):
        bits = np.unpackbits(h[at:at + 255 * 64, None].astype(">u8").view(np.uint8), axis=1)
        for k in range(0, len(bits), 255):  # sums of up to 255 ones stay in bytes
            counts += bits[k:k + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(h)).tobytes()


def _fingerprint_batches(batches: Iterator, words: int) -> Iterator:
    for b in batches:
        fps = [fingerprint(x, words) for x in b.column(b.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps, pa.binary())],
                                         names=[*b.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame, columns: list[str], words: int = 4) -> DataFrame:
    """(*columns, fp): one row per row of docs, fp the fingerprint's bytes, highest bit first."""
    small_batches(docs.sparkSession)
    rows = docs.select(*columns, utf8().alias("_text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("fp", T.BinaryType())])
    return rows.mapInArrow(partial(_fingerprint_batches, words=words), schema)


# --- segments and keys -----------------------------------------------------------------------

def segment_count(rows: int, bits: int, diff: int) -> int:
    """How many segments: few enough keys per row, and keys wide enough that rows under one key
    stay few.  The key of m-diff segments has about bits*(m-diff)/m bits."""
    m = diff + 2
    while bits * (m - diff) / m < np.log2(max(rows, 2)) and m < 2 * diff + 2:
        m += 1
    return m


def _bounds(bits: int, m: int) -> list[int]:
    return [round(i * bits / m) for i in range(m + 1)]


def _segments(fps: np.ndarray, m: int) -> np.ndarray:
    """(n, bytes) -> (n, m): each segment as a number."""
    bits = np.unpackbits(fps, axis=1)
    edge = _bounds(bits.shape[1], m)
    out = np.empty((len(fps), m), np.uint64)
    for s in range(m):
        part = bits[:, edge[s]:edge[s + 1]]
        out[:, s] = part @ (np.uint64(1) << np.arange(part.shape[1], dtype=np.uint64)[::-1])
    return out


def _choices(m: int, diff: int) -> list[tuple[int, ...]]:
    """The segments a row is filed under: every m-diff of them."""
    return list(combinations(range(m), m - diff))


def _as_matrix(column) -> np.ndarray:
    size = len(column[0].as_py())
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, size)


def _key_batches(batches: Iterator, m: int, diff: int) -> Iterator:
    for b in batches:
        if not b.num_rows:
            continue
        fps = _as_matrix(b.column(0))
        seg, edge = _segments(fps, m), _bounds(8 * fps.shape[1], m)
        for k, chosen in enumerate(_choices(m, diff)):
            key = np.full(len(seg), k, np.uint64)
            for s in chosen:
                key = (key << np.uint64(edge[s + 1] - edge[s])) | seg[:, s]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(np.full(len(seg), k, np.int32)),
                 b.column(0)], names=["key", "choice", "fp"])


def _within(seg: np.ndarray, a: np.ndarray, b: np.ndarray, heads: np.ndarray, diff: int
            ) -> np.ndarray:
    """Which pairs of rows (a, b) have a chain within budget from one of their heads, and differ
    in at most diff bits in all."""
    m = seg.shape[1]
    viable = np.zeros(len(a), bool)
    for h in range(heads.shape[1]):
        alive = np.flatnonzero(~viable)
        total = np.zeros(len(alive), np.int64)
        for step in range(min(CHAIN, m)):
            at = (heads[alive, h] + step) % m
            total += np.bitwise_count(seg[a[alive], at] ^ seg[b[alive], at])
            keep = total * m <= (step + 1) * diff
            alive, total = alive[keep], total[keep]
        viable[alive] = True
    out = np.flatnonzero(viable)
    full = np.zeros(len(out), np.int64)
    for s in range(m):
        full += np.bitwise_count(seg[a[out], s] ^ seg[b[out], s])
    return out[full <= diff]


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least reachable index of each of n nodes."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _pairs(keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows with equal keys (sorted), some thousands of rows' worth at a time."""
    first = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1]
    length = np.diff(np.r_[first, len(keys)])
    short = np.repeat(length <= 64, length)
    for d in range(1, int(min(64, length.max(initial=0)))):
        a = np.flatnonzero((keys[:-d] == keys[d:]) & short[:-d])
        if len(a):
            yield a, a + d
    for at, n in zip(first[length > 64], length[length > 64], strict=True):
        for x in range(0, n, 128):
            i, j = np.meshgrid(np.arange(x, min(n, x + 128)), np.arange(n), indexing="ij")
            up = j > i
            yield at + i[up], at + j[up]


def _binaries(fps: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in fps], pa.binary())


def _linked(keys, choices, fps: np.ndarray, m: int, diff: int) -> pa.RecordBatch:
    """Edges among the rows of each key: a spanning forest."""
    seg = _segments(fps, m)
    heads = np.array(_choices(m, diff))[choices]
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for a, b in _pairs(keys):
        ok = _within(seg, a, b, heads[a], diff)
        left.append(a[ok])
        right.append(b[ok])
    root = _forest(len(keys), np.concatenate(left), np.concatenate(right))
    a = np.flatnonzero(root != np.arange(len(keys)))
    return pa.RecordBatch.from_arrays([_binaries(fps[a]), _binaries(fps[root[a]])],
                                      names=["u", "v"])


def _edge_batches(batches: Iterator, m: int, diff: int) -> Iterator:
    """Rows come sorted by key; a key's rows are compared together, also across batches."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        rows = (b.column(0).to_numpy(), b.column(1).to_numpy(), _as_matrix(b.column(2)))
        held = rows if held is None else tuple(
            np.concatenate(x) for x in zip(held, rows, strict=True))
        last = int(np.searchsorted(held[0], held[0][-1]))  # where the last, perhaps open, key begins
        if last:
            yield _linked(*(x[:last] for x in held), m, diff)
            held = tuple(x[last:] for x in held)
    if held is not None:
        yield _linked(*held, m, diff)


# --- keys with very many fingerprints --------------------------------------------------------

def _ball(bits: list[int], radius: int, size: int) -> np.ndarray:
    """Every pattern with up to `radius` ones among the given bits."""
    patterns = []
    for r in range(radius + 1):
        for chosen in combinations(bits, r):
            p = np.zeros(size, np.uint8)
            p[list(chosen)] = 1
            patterns.append(np.packbits(p))
    return np.stack(patterns)


def _point_batches(batches: Iterator, m: int, diff: int) -> Iterator:
    balls: dict[int, np.ndarray] = {}
    for b in batches:
        if not b.num_rows:
            continue
        fps, choices = _as_matrix(b.column(1)), b.column(0).to_numpy()
        size = 8 * fps.shape[1]
        edge = _bounds(size, m)
        for c in np.unique(choices):
            if c not in balls:
                fixed = _choices(m, diff)[c]
                free = [x for s in range(m) if s not in fixed for x in range(edge[s], edge[s + 1])]
                balls[c] = _ball(free, (diff + 1) // 2, size)
            for i in np.flatnonzero(choices == c):
                points = balls[c] ^ fps[i]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p.tobytes() for p in points], pa.binary()),
                     pa.array([fps[i].tobytes()] * len(points), pa.binary())],
                    names=["point", "fp"])


def _dense_edges(rows: DataFrame, m: int, diff: int) -> DataFrame:
    """Edges among rows of one key that are too many to compare.  Needs an even diff: then a
    point shared by two balls of radius diff/2 means at most diff bits between their centres."""
    points = rows.select("choice", "fp").mapInArrow(
        partial(_point_batches, m=m, diff=diff), "point binary, fp binary")
    least = points.groupBy("point").agg(F.min("fp").alias("v"))
    return points.join(least, "point").where("fp <> v").select(
        F.col("fp").alias("u"), "v").distinct()


def edges(nodes: DataFrame, diff: int, m: int, dense: int = DENSE) -> DataFrame:
    """nodes(fp), each once -> (u, v): a spanning forest of every key's links."""
    keys = nodes.select("fp").mapInArrow(partial(_key_batches, m=m, diff=diff),
                                         "key long, choice int, fp binary")
    hot = stored(keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > dense)
                 .select("key"), "hot_keys")
    some = bool(hot.head(1))
    usual = keys.join(hot, "key", "left_anti") if some else keys
    found = usual.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(
        partial(_edge_batches, m=m, diff=diff), "u binary, v binary")
    if some:
        found = found.unionByName(_dense_edges(keys.join(hot, "key", "left_semi"), m, diff))
    return found


def _first(columns: list[str]):
    """Of rows, the one that comes first by the columns, nulls last."""
    return F.min(F.struct(*[x for c in columns for x in (
        F.col(c).isNull().alias(f"no_{c}"), F.col(c))])).alias("least")


def _labelled(fps: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """fps with the first row of each row's component."""
    comp = components(links)
    rooted = nodes.join(comp, nodes["fp"] == comp["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("least"))
    # nodes are far fewer than rows only where there are copies; a hot node is split by AQE
    labels = rooted.select("fp", "root").join(least, "root").select("fp", "least")
    return fps.join(labels, "fp", "left")


def _grouped(docs: DataFrame, columns: list[str], words: int, diff: int, segments: int | None,
             dense: int) -> DataFrame:
    """(*columns, fp, least): every row and the first row of its group, by the columns."""
    fps = stored(fingerprints(docs, columns, words), "fingerprints")
    nodes = stored(fps.groupBy("fp").agg(_first(columns)), "nodes")
    m = segments or segment_count(nodes.count(), 64, diff)
    return _labelled(fps, nodes, edges(nodes, diff, m, dense))


def near_duplicates(docs: DataFrame, words: int = 4, diff: int = 4,
                    segments: int | None = None, dense: int = DENSE) -> DataFrame:
    """(doc_id, fp, component_id): the least doc_id reachable over links of at most diff bits of
    64.  Exact."""
    return _grouped(docs, ["doc_id"], words, diff, segments, dense).select(
        "doc_id", "fp", F.col("least")["doc_id"].alias("component_id"))


def deduplicate(docs: DataFrame, words: int = 4, diff: int = 4, dense: int = DENSE) -> DataFrame:
    """docs with one row of each group of near_duplicates: the one with the least doc_id, null ids
    last, and of equal ids the one whose text has the least hash."""
    key = {"k1": F.xxhash64("doc_id", "text", F.lit(1)),
           "k2": F.xxhash64(F.lit(2), "text", F.col("text").isNull(), "doc_id")}
    rows = docs.select("doc_id", "text", *[c.alias(k) for k, c in key.items()])
    found = stored(_grouped(rows, ["doc_id", *key], words, diff, None, dense), "near_duplicates")
    dropped = stored(found.where("k1 <> least.k1 or k2 <> least.k2").select(*key).distinct(),
                     "dropped")
    named = {k: f"_near_{k}" for k in key}
    left = docs.withColumns({named[k]: c for k, c in key.items()}).join(
        sized(dropped).withColumnsRenamed(named), list(named.values()), "left_anti")
    if found.groupBy(*key).count().where("count > 1").head(1):  # rows repeated in full
        left = left.dropDuplicates(list(named.values()))
    return left.select(*docs.columns)
