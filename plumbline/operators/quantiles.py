"""Exact quantiles of many columns without holding a column in one task.

Each wanted order statistic is bracketed with a mergeable quantile sketch, the bracket is
verified by exact counts and narrowed until the values inside are few enough to keep.  Each
round is one fused scan, and the kept range shrinks by a factor of about a thousand per
round.  Columns below the size bound need no narrowing at all.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.cells import number_cells, small_frame, together
from plumbline.roles import col

EXACT_LIMIT = 1_000_000
_SKETCH = 4_000        # size parameter of a sketch
_RANK_ERROR = 0.001    # of a sketch of that size, as a share of the values
_BATCH = 80


def _num(name: str):
    return col(name).cast("double")


def exact_quantiles(df: DataFrame, names: list[str], probs=(0.25, 0.5, 0.75),
                    exact_limit: int = EXACT_LIMIT,
                    counts: dict[str, int] | None = None) -> DataFrame:
    """(column, n, q_<prob>...) with linear interpolation, one row per non-empty column.

    counts: non-null rows per column if already known, which saves a scan.
    """
    spark = df.sparkSession
    labels = [label(p) for p in probs]
    ddl = "column string, n bigint, " + ", ".join(f"{x} double" for x in labels)
    if not names:
        return small_frame(spark, [], ddl)
    small_df = df.select([_num(n).alias(n) for n in names])
    if counts is None:
        counts = {r["column"]: r["n"] for r in number_cells(small_df, names)
                  .groupBy("column").agg(F.count("value").alias("n")).collect()}
    ranks, wanted = {}, set()
    for n in names:
        for p in probs if counts.get(n) else ():
            h = (counts[n] - 1) * p
            ranks[n, p] = (math.floor(h), math.ceil(h), h - math.floor(h))
            wanted |= {(n, math.floor(h)), (n, math.ceil(h))}
    stats = order_statistics(small_df, sorted(wanted), counts, exact_limit)
    out = []
    for n in names:
        if counts.get(n):
            row = []
            for p in probs:
                lo, hi, part = ranks[n, p]
                row.append(stats[n, lo] + part * (stats[n, hi] - stats[n, lo]))
            out.append((n, counts[n], *row))
    return small_frame(spark, out, ddl)


def label(p: float) -> str:
    return "q_" + f"{p:g}".replace("0.", "").ljust(2, "0")


def order_statistics(df: DataFrame, wanted: list[tuple[str, int]], counts: dict[str, int],
                     limit: int) -> dict[tuple[str, int], float]:
    """{(column, 0-based rank): value} by repeated sketch-and-count narrowing.

    State per target: an open interval (lo, hi) known to hold the target, the rank inside
    it and the number of values inside it.
    """
    done: dict = {}
    todo = {t: (-math.inf, math.inf, t[1], counts[t[0]]) for t in wanted}
    slack = 2.0
    while todo:
        finish = {t: s for t, s in todo.items() if s[3] <= limit}
        if finish:
            done.update(_pick(df, finish, limit))
            todo = {t: s for t, s in todo.items() if t not in finish}
        if not todo:
            break
        brackets = _sketch(df, todo, slack)
        nxt = {}
        for t, (below, at_lo, mid, at_hi) in _count(df, todo, brackets).items():
            lo, hi, rank, inside = todo[t]
            a, b = brackets[t]
            if rank < below:
                nxt[t] = (lo, a, rank, below)
            elif rank < below + at_lo:
                done[t] = a
            elif rank < below + at_lo + mid:
                nxt[t] = (a, b, rank - below - at_lo, mid)
            elif rank < below + at_lo + mid + at_hi:
                done[t] = b
            else:
                skip = below + at_lo + mid + at_hi
                nxt[t] = (b, hi, rank - skip, inside - skip)
        todo = nxt
    return done


def _batches(items: list):
    return [items[i:i + _BATCH] for i in range(0, len(items), _BATCH)]


def _inside(name: str, lo: float, hi: float):
    c = col(name)
    cond = c.isNotNull()
    if lo != -math.inf:
        cond &= c > lo
    if hi != math.inf:
        cond &= c < hi
    return cond


def _fused(df: DataFrame, exprs: list) -> dict:
    """Evaluate {key: aggregate} pairs in as few scans as the batch size allows."""
    out = {}
    for part in _batches(exprs):
        row = df.agg(*[e.alias(f"x{i}") for i, (_, e) in enumerate(part)]).first()
        out.update({k: row[i] for i, (k, _) in enumerate(part)})
    return out


def _sketch(df, todo, slack):
    """Bracketing values for each target; targets of one interval share one sketch.

    Neighbouring ranks (the two an interpolation needs) get the same bracket.
    """
    shared: dict = {}
    for t, (lo, hi, rank, inside) in todo.items():
        shared.setdefault((t[0], lo, hi, inside), []).append((rank, t))
    asked, wanted = {}, {}
    for key, ranked in shared.items():
        inside = key[3]
        probs, last = [], None
        for rank, t in sorted(ranked):
            if last is None or rank > last + 1:
                p, e = (rank + 0.5) / inside, slack * _RANK_ERROR
                probs += [max(0.0, p - e), min(1.0, p + e)]
            last = rank
            wanted[t] = (key, len(probs) - 2)
        asked[key] = probs
    got = {}
    for part in _batches(list(asked.items())):
        got.update(_merged_sketches(df, part))
    return {t: (float(got[key][i]), float(got[key][i + 1])) for t, (key, i) in wanted.items()}


def _merged_sketches(df, part) -> dict:
    """Quantiles from sketches merged in two levels, so that no task merges those of all
    others: first among about the square root of the partitions, then the results."""
    groups = max(8, math.isqrt(df.rdd.getNumPartitions()))
    level = df.groupBy(F.pmod(F.spark_partition_id(), F.lit(groups)).alias("group")).agg(*[
        F.kll_sketch_agg_double(F.when(_inside(*key[:3]), col(key[0])), F.lit(_SKETCH))
        .alias(f"x{i}") for i, (key, _) in enumerate(part)])
    row = level.agg(*[F.kll_merge_agg_double(f"x{i}", F.lit(_SKETCH)).alias(f"x{i}")
                      for i in range(len(part))]).select(*[
        F.kll_sketch_get_quantile_double(f"x{i}", F.array(*map(F.lit, probs))).alias(f"x{i}")
        for i, (_, probs) in enumerate(part)]).first()
    return {key: row[i] for i, (key, _) in enumerate(part)}


def _count(df, todo, brackets):
    """Exact (below a, equal a, strictly between, equal b) inside each interval."""
    exprs: dict = {}
    for t, (lo, hi, _, _) in todo.items():
        a, b = brackets[t]
        c, key = col(t[0]), (t[0], lo, hi, a, b)
        if (key, 0) not in exprs:
            inside = _inside(t[0], lo, hi)
            exprs[key, 0] = F.count_if(inside & (c < a))
            exprs[key, 1] = F.count_if(c == a)
            exprs[key, 2] = F.count_if((c > a) & (c < b))
            exprs[key, 3] = F.count_if((c == b) & (F.lit(a) < b))
    got = _fused(df, list(exprs.items()))
    return {t: tuple(got[(t[0], s[0], s[1], *brackets[t]), i] for i in range(4))
            for t, s in todo.items()}


def _pick(df, finish, limit):
    """Read the wanted ranks out of intervals that hold at most `limit` values.

    A sketch whose accuracy exceeds twice the number of values keeps them all, so its ranks
    are exact; it is built from sorted arrays and merges map-side.
    """
    shared: dict = {}
    for t, (lo, hi, rank, inside) in finish.items():
        shared.setdefault((t[0], lo, hi), []).append((t, (rank + 0.5) / inside))
    items = [(key, F.percentile_approx(
        F.when(_inside(*key), col(key[0])), [p for _, p in pairs],
        4 * max(limit, 1_000))) for key, pairs in shared.items()]
    parts = [items[i:i + 4] for i in range(0, len(items), 4)]  # bounds a task's memory
    got: dict = {}
    for part in together(*[lambda x=x: _fused(df, x) for x in parts]):
        got.update(part)
    return {t: float(got[key][i]) for key, pairs in shared.items()
            for i, (t, _) in enumerate(pairs)}
