"""Exact k-means by Shallot search, over vectors as whole numbers.

Every vector remembers its nearest and second-nearest centroid, an upper bound of the distance to
the one and a lower bound of the distance to all others.  Moved centroids loosen the bounds; while
the upper one stays below the lower one, or below half the way to the next centroid, nothing is
computed.  Otherwise the two remembered centroids are measured, and the scan starts from the closer
one: its neighbours are tried by rising distance, and the ball that may still hold a nearer
centroid shrinks with every better second-nearest one, until the next neighbour lies outside it.
Bounds are floating numbers with a margin; whatever survives them is compared in whole numbers,
ties going to the smaller number, so the result is that of comparing everything.

Vectors are written once in chunks, as a table bucketed by chunk; what the chunks remember is
written so every round.  The two meet without moving: a round exchanges only sums and counts of
those vectors that changed their centroid, at most one row per centroid and component.

Edge cases: vectors that are null, of another length, or hold a null or non-finite component take
no part; equal rows count each; rows without vec_id take part, last in the choice of first
centroids; fewer vectors than centroids start as many clusters as there are vectors; clusters that
lose all vectors keep their centroid; components of any finite size are exact, and a distance or
sum of distances beyond a long is null; an empty table gives an empty result; columns other than
vec_id and embedding are not read.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import stored
from plumbline.plans.session import scratch_path

CHUNK = 1024               # vectors of one row
CHUNKS = 512               # rows of a bucket at most, unless there are few cores' worth
NARROW = 1 << 27           # components up to this square and add up within 64 bits
LIMB = 32                  # sums travel in parts of so many bits
MARGIN = 1e-9              # of the floating bounds


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite doubles, exactly; scale is a power of two."""
    with np.errstate(over="ignore"):
        y = np.floor(x * float(scale))
    if np.abs(y).max(initial=0) <= NARROW:
        return y.astype(np.int64)
    return np.array([[math.floor(v) * scale if abs(v) >= 2.0 ** 53 else math.floor(v * scale)
                      for v in row] for row in x.tolist()], object).reshape(x.shape)


class Centroids(NamedTuple):
    at: np.ndarray         # k x d, 64-bit where narrow, else Python's whole numbers
    gap: np.ndarray        # distances between centroids
    order: np.ndarray      # of each centroid's neighbours by distance, itself first
    half: np.ndarray       # half the distance to the next one
    moved: np.ndarray      # how far each moved in the last round, rounded up

    @property
    def narrow(self) -> bool:
        return self.at.dtype != object


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return (d * d).sum(axis=-1)


def _roots(x: np.ndarray) -> np.ndarray:
    return np.sqrt(x.astype(np.float64))


def centroids(at: list[list[int]], before: list[list[int]] | None) -> Centroids:
    k, d = len(at), len(at[0])
    if max(abs(v) for rows in (at, before or at) for row in rows for v in row) > NARROW:
        endless = np.full(k, np.inf)
        return Centroids(np.array(at, object).reshape(k, d), np.zeros((k, k)),
                         np.tile(np.arange(k), (k, 1)), np.zeros(k), endless)
    now = np.array(at, np.int64)
    gap = np.stack([_roots(_squares(now, c)) for c in now])
    order = np.argsort(gap + np.where(np.eye(k, dtype=bool), -1.0, 0.0), axis=1, kind="stable")
    half = gap[np.arange(k), order[:, 1]] / 2 if k > 1 else np.full(k, np.inf)
    moved = _roots(_squares(now, np.array(before or at, np.int64))) * (1 + MARGIN)
    return Centroids(now, gap, order, half, moved)


class Memory(NamedTuple):
    """What the vectors of a chunk remember."""
    first: np.ndarray
    second: np.ndarray
    upper: np.ndarray
    lower: np.ndarray

    def packed(self) -> list[bytes]:
        return [x.tobytes() for x in self]

    @staticmethod
    def read(columns: list[bytes]) -> Memory:
        return Memory(*(np.frombuffer(c, t).copy() for c, t in zip(
            columns, ("<i4", "<i4", "<f8", "<f8"), strict=True)))


class Nearest:
    """The two best centroids of some vectors so far, by (distance, number)."""

    def __init__(self, n: int, kind):
        self.first, self.second = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        self.d1, self.d2 = np.zeros(n, kind), np.zeros(n, kind)

    def offer(self, rows: np.ndarray, c: np.ndarray, d: np.ndarray) -> None:
        def better(than: np.ndarray, number: np.ndarray) -> np.ndarray:
            return ((number < 0) | (d < than) | ((d == than) & (c < number))).astype(bool)
        wins = better(self.d1[rows], self.first[rows])
        runs = ~wins & better(self.d2[rows], self.second[rows])
        won, ran = rows[wins], rows[runs]
        self.second[won], self.d2[won] = self.first[won], self.d1[won]
        self.first[won], self.d1[won] = c[wins], d[wins]
        self.second[ran], self.d2[ran] = c[runs], d[runs]


def _everything(x: np.ndarray, c: Centroids) -> Memory:
    """Every centroid measured."""
    n, rows = len(x), np.arange(len(x))
    exact = x.dtype != object and c.narrow
    best = Nearest(n, np.int64 if exact else object)
    for number, at in enumerate(c.at):
        best.offer(rows, np.full(n, number, np.int32), _squares(x, at))
    if not exact:  # bounds would not fit: the next round measures again
        return Memory(best.first, best.second, np.full(n, np.inf), np.full(n, -np.inf))
    lower = np.where(best.second >= 0, _roots(best.d2) * (1 - MARGIN), np.inf)
    return Memory(best.first, best.second, _roots(best.d1) * (1 + MARGIN), lower)


def assign(x: np.ndarray, c: Centroids, m: Memory | None) -> Memory:
    """The memory of vectors x once the centroids are c; m: their memory before."""
    k = len(c.at)
    if m is None or k == 1 or x.dtype == object or not c.narrow:
        return _everything(x, c)
    # bounds after the move: the second largest move counts where the largest is the own one's
    most = np.argsort(-c.moved, kind="stable")[:2]
    m = m._replace(upper=m.upper + c.moved[m.first],
                   lower=m.lower - np.where(m.first == most[0], c.moved[most[1]], c.moved[most[0]]))
    rows = np.flatnonzero(~(m.upper < np.maximum(m.lower, c.half[m.first] * (1 - MARGIN))))
    d1 = _squares(x[rows], c.at[m.first[rows]])
    m.upper[rows] = _roots(d1) * (1 + MARGIN)
    open_ = ~(m.upper[rows] < np.maximum(m.lower[rows], c.half[m.first[rows]] * (1 - MARGIN)))
    rows, d1 = rows[open_], d1[open_]
    # the two remembered ones; the scan starts from the closer
    y, here = x[rows], np.arange(len(rows))
    best = Nearest(len(rows), np.int64)
    best.offer(here, m.first[rows], d1)
    best.offer(here, m.second[rows], _squares(y, c.at[m.second[rows]]))
    start, other = best.first.copy(), best.second.copy()
    radius = _roots(best.d1)
    for step in range(1, k):
        number = c.order[start[here], step].astype(np.int32)
        ball = (radius[here] + _roots(best.d2[here])) * (1 + MARGIN)
        inside = c.gap[start[here], number] * (1 - MARGIN) <= ball
        here, number = here[inside], number[inside]
        if not len(here):
            break
        new = number != other[here]
        best.offer(here[new], number[new], _squares(y[here[new]], c.at[number[new]]))
    m.first[rows], m.second[rows] = best.first, best.second
    m.upper[rows], m.lower[rows] = _roots(best.d1) * (1 + MARGIN), _roots(best.d2) * (1 - MARGIN)
    return m


# --- chunks ----------------------------------------------------------------------------------

def _chunked(batches: Iterator, scale: int, d: int) -> Iterator:
    """Vectors as whole numbers, narrow ones packed, wide ones as text, in rows of CHUNK."""
    part, number = TaskContext.get().partitionId() << 32, 0
    held: dict[bool, list] = {False: [], True: []}

    def row(wide: bool) -> pa.RecordBatch:
        nonlocal number
        ids, vectors = zip(*held[wide], strict=True)
        number += 1
        held[wide] = []
        return pa.RecordBatch.from_arrays([
            pa.array([part + number], pa.int64()), pa.array([ids], pa.list_(kind)),
            pa.array([None if wide else np.array(vectors, "<i4").tobytes()], pa.binary()),
            pa.array([[str(v) for x in vectors for v in x] if wide else None],
                     pa.list_(pa.string()))],
            names=["chunk", "vec_ids", "narrow", "wide"])

    kind = pa.int64()
    for b in batches:
        kind = b.column(0).type
        x = np.array(b.column(1).flatten().to_numpy(zero_copy_only=False), np.float64)
        for vec_id, vector in zip(b.column(0).to_pylist(), x.reshape(-1, d), strict=True):
            v = whole(vector[None], scale)[0]
            wide = v.dtype == object
            held[wide].append((vec_id, v))
            if len(held[wide]) == CHUNK:
                yield row(wide)
    for wide in (False, True):
        if held[wide]:
            yield row(wide)


def _vectors(narrow: bytes | None, wide: list[str] | None, d: int) -> np.ndarray:
    if narrow is not None:
        return np.frombuffer(narrow, "<i4").reshape(-1, d).astype(np.int64)
    return np.array([int(v) for v in wide], object).reshape(-1, d)


def _limbs(total: list[int]) -> list[list[int]]:
    """Whole numbers as signed parts of LIMB bits, the least first."""
    out = []
    while any(total) or not out:
        signs = [1 if v >= 0 else -1 for v in total]
        out.append([s * (abs(v) & (1 << LIMB) - 1) for s, v in zip(signs, total, strict=True)])
        total = [s * (abs(v) >> LIMB) for s, v in zip(signs, total, strict=True)]
    return out


def _changes(x: np.ndarray, was: np.ndarray | None, now: np.ndarray) -> list[dict]:
    """By cluster that gained or lost vectors: their number and sum, in limbs."""
    out = []
    moved = np.arange(len(x)) if was is None else np.flatnonzero(was != now)
    for c in np.unique(np.concatenate([now[moved], [] if was is None else was[moved]])).tolist():
        gained = moved[now[moved] == c]
        lost = moved[:0] if was is None else moved[was[moved] == c]
        total = [int(v) for v in x[gained].sum(axis=0) - x[lost].sum(axis=0)]
        for limb, values in enumerate(_limbs(total)):
            out.append({"cluster": int(c), "limb": limb, "sums": values,
                        "n": len(gained) - len(lost) if limb == 0 else 0})
    return out


_STATE = ("first binary, second binary, upper binary, lower binary",
          "array<struct<cluster int, limb int, sums array<bigint>, n bigint>>")


def _round(batches: Iterator, c: Centroids, d: int, fresh: bool) -> Iterator:
    kind = pa.list_(pa.struct([("cluster", pa.int32()), ("limb", pa.int32()),
                               ("sums", pa.list_(pa.int64())), ("n", pa.int64())]))
    for b in batches:
        for chunk, narrow, wide, *state in zip(*(x.to_pylist() for x in b.columns), strict=True):
            x = _vectors(narrow, wide, d)
            before = None if fresh else Memory.read(state)
            was = None if fresh else before.first.copy()
            after = assign(x, c, before)
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk], pa.int64()), *(pa.array([s], pa.binary())
                                                  for s in after.packed()),
                 pa.array([_changes(x, was, after.first)], kind)],
                names=["chunk", "first", "second", "upper", "lower", "changes"])


def _rows(batches: Iterator, c: Centroids, d: int) -> Iterator:
    """A row per vector: its cluster and the exact distance."""
    for b in batches:
        ids = b.column(4)
        for i, (chunk, narrow, wide, first) in enumerate(zip(
                *(x.to_pylist() for x in b.columns[:4]), strict=True)):
            own = np.frombuffer(first, "<i4")
            far = [int(v) for v in _squares(_vectors(narrow, wide, d), c.at[own])]
            yield pa.RecordBatch.from_arrays(
                [ids.slice(i, 1).flatten(), pa.array(own, pa.int32()),
                 pa.array([v if v < 1 << 63 else None for v in far], pa.int64())],
                names=["vec_id", "cluster", "distance"])


# --- rounds ----------------------------------------------------------------------------------

def _bucketed(df: DataFrame, name: str, buckets: int) -> str:
    """df in the shared folder as a table bucketed by chunk; its name."""
    name = f"{name}_{uuid.uuid4().hex}"
    df.write.format("parquet").option("path", scratch_path(df.sparkSession, name)).bucketBy(
        buckets, "chunk").saveAsTable(name)
    return name


def _first(kept: DataFrame, k: int, seed: int, scale: int) -> list[list[int]]:
    """The vectors with the least hashes of seed and vec_id."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    got = kept.select(key.alias("key"), "embedding").orderBy(
        F.asc_nulls_last("key"), "embedding").limit(k).collect()
    return [[int(v) for v in whole(np.array([r["embedding"]], np.float64), scale)[0]]
            for r in got]


def cluster(embeddings: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, d: int = 64,
            scale: int = 1024) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) per vector."""
    spark = embeddings.sparkSession
    kept = embeddings.select("vec_id", "embedding").where(
        (F.size("embedding") == d) & F.forall("embedding", lambda x: F.coalesce(
            x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))))
    kind = kept.schema["vec_id"].dataType.simpleString()
    at = _first(kept, k, seed, scale)
    if not at:
        at = [[0] * d]
    chunks = stored(kept.mapInArrow(
        partial(_chunked, scale=scale, d=d),
        f"chunk long, vec_ids array<{kind}>, narrow binary, wide array<string>"), "chunks")
    n = chunks.count()
    buckets = max(1, min(n, max(spark.sparkContext.defaultParallelism, n // CHUNKS)))
    tables = [_bucketed(chunks.repartition(buckets, "chunk"), "vectors", buckets)]
    vectors = spark.table(tables[0])
    total, count = [[0] * d for _ in at], [0] * len(at)
    before, state = None, None
    for step in range(rounds + 1):
        c = centroids(at, before)
        both = vectors.select("chunk", "narrow", "wide")
        if state is not None:
            both = both.join(spark.table(state), "chunk").select(
                "chunk", "narrow", "wide", "first", "second", "upper", "lower")
        after = both.mapInArrow(partial(_round, c=c, d=d, fresh=state is None),
                                f"chunk long, {_STATE[0]}, changes {_STATE[1]}")
        state = _bucketed(after, "memory", buckets)
        tables.append(state)
        if step == rounds:
            break
        sums = spark.table(state).select(F.explode("changes").alias("c")).select(
            "c.cluster", "c.limb", F.posexplode("c.sums").alias("i", "v"), "c.n").groupBy(
            "cluster", "limb", "i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"),
                                        F.sum("n").alias("n")).collect()  # k x d rows
        for r in sums:
            total[r["cluster"]][r["i"]] += int(r["v"]) << LIMB * r["limb"]
            if r["i"] == 0:
                count[r["cluster"]] += r["n"]
        before, at = at, [[v // m for v in row] if m else old
                          for row, m, old in zip(total, count, at, strict=True)]
        if at == before:
            break  # nothing moves any more
    own = vectors.join(spark.table(state), "chunk").select(
        "chunk", "narrow", "wide", "first", "vec_ids")
    rows = stored(own.mapInArrow(partial(_rows, c=centroids(at, None), d=d),
                                 f"vec_id {kind}, cluster int, distance long"), "clustered")
    for name in tables:  # external: the files stay in the shared folder
        spark.sql(f"DROP TABLE {name}")
    known = F.count("*") == F.count("distance")
    inertia = F.when(known, F.sum(F.col("distance").cast("decimal(38,0)")))
    sizes = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(
        inertia.alias("s")).collect()}  # k rows
    everything = None if None in sizes.values() else int(sum(sizes.values()))

    def long(v):
        return None if v is None or v >= 1 << 63 else int(v)
    by_cluster = spark.createDataFrame(
        [(i, long(sizes.get(i, 0)), long(everything), hashlib.sha256(
            ",".join(map(str, row)).encode()).hexdigest()) for i, row in enumerate(at)],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(by_cluster), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
