"""Mixing sources to target weights by weighted fair queueing.

Every document of a source stands in a queue in shuffled order, up to `repeats` times over.  A
copy's virtual finish time is the words of its source up to and including it, divided by the
source's target; served in that order, sources progress in proportion to their targets, and the
queue ends where the total budget is used up.

Edge cases: null sources are one source, the last; null and empty texts have size 0 and take
nothing; a source without words has target 0; rows alike in doc_id, source and size are treated
alike (the order is decided by these alone); an empty table gives an empty result; columns other
than doc_id, source and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import WORD, stored

BUCKETS = 4096     # ranges of a source's shuffled order, summed before they are put in line
CELLS = 4096       # ranges of a unit of virtual time
LAST_CELL = 8 * CELLS


def _keys(seed: str) -> dict[str, Column]:
    """The columns that name a row for the mix; `place` orders a source's rows at random."""
    return {
        "no_source": F.col("source").isNull(),
        "src": F.coalesce(F.col("source").cast("string"), F.lit("")),
        "size": F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long"),
        "place": F.md5(F.concat(F.lit(seed), F.coalesce(
            F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))}


def targets(sources: DataFrame, weights: list[int], most: int) -> DataFrame:
    """sources(no_source, src, words) -> the same and target.

    Weights repeat over the sources in code point order.  A target stops at `most` times its
    source's words and the excess goes to the others by weight: with sources in order of the
    level at which they are full, the first level that fills no further source is the answer.
    """
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy("no_source", "src")))
    weighted = ranked.withColumn("weight", F.element_at(
        F.array(*[F.lit(w) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    ).withColumn("full", F.lit(most) * F.col("words")).withColumn(
        "full_at", F.col("full") / F.col("weight"))
    order = Window.orderBy("full_at", "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy("full_at", "rank").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    level = weighted.withColumn("place", F.row_number().over(order)).withColumn(
        "level", (F.sum("words").over(everything) - F.coalesce(F.sum("full").over(before), F.lit(0)))
        / F.sum("weight").over(onward))
    first = F.min(F.when(F.col("full_at") >= F.col("level"), F.struct("place", "level"))
                  ).over(everything)["level"]
    return level.withColumn("chosen", first).select(
        "no_source", "src", "words",
        F.when(F.col("full_at") <= F.col("chosen"), F.col("full").cast("double"))
        .otherwise(F.col("chosen") * F.col("weight")).alias("target"))


_ORDER = ("v", "no_source", "src", "copy", "place", "size")


def _queued(rows: DataFrame, weights: list[int], most: int) -> DataFrame:
    """rows, their source's words and target, and `upto`: words of the source up to this row."""
    bucket = F.conv(F.substring("place", 1, 3), 16, 10).cast("int") % BUCKETS
    rows = rows.withColumn("bucket", bucket)
    sums = rows.groupBy("no_source", "src", "bucket").agg(F.sum("size").alias("n"))
    sources = targets(sums.groupBy("no_source", "src").agg(F.sum("n").alias("words")),
                      weights, most)
    before = Window.partitionBy("no_source", "src").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1)  # BUCKETS rows a source at most
    offsets = sums.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("no_source", "src", "bucket").orderBy("place", "size").rowsBetween(
        Window.unboundedPreceding, 0)
    return rows.withColumn("inside", F.sum("size").over(inside)).join(
        offsets, ["no_source", "src", "bucket"]).join(sources, ["no_source", "src"]).select(
        "doc_id", "no_source", "src", "size", "place", "words", "target",
        (F.col("offset") + F.col("inside")).alias("upto"))


def _finish(copy: Column) -> Column:
    return F.try_divide(copy * F.col("words") + F.col("upto"), F.col("target"))


def mix(docs: DataFrame, weights: list[int], most: int = 3, seed: str = "mix:") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies), a row for each row of docs.

    The budget is the words of all documents.  The order is exact: sums over 4096 ranges of a
    unit of virtual time find the range where the budget ends, and only its rows are put in line.
    """
    queue = stored(_queued(stored(docs.select(
        "doc_id", *[c.alias(k) for k, c in _keys(seed).items()]), "sizes"), weights, most), "queue")
    served = queue.where("size > 0").select(
        "no_source", "src", "place", "size",
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda e: F.struct(
            e.alias("copy"), _finish(e).alias("v")))).alias("c")).select("*", "c.*").drop("c")
    served = served.withColumn(
        "cell", F.least(F.floor(F.col("v") * CELLS), F.lit(LAST_CELL)).cast("int"))
    cells = served.groupBy("cell").agg(F.sum("size").alias("n"))
    line = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    budget = queue.agg(F.sum("size")).first()[0] or 0
    # LAST_CELL + 1 rows at most
    ends = cells.withColumn("upto", F.sum("n").over(line)).where(F.col("upto") > budget).orderBy(
        "cell").select("cell", (F.col("upto") - F.col("n")).alias("before")).first()
    if ends is None:
        copies = F.lit(most if budget else 0)
    else:
        upto = Window.orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, 0)
        last = served.where(F.col("cell") == ends["cell"]).withColumn(
            "upto", F.sum("size").over(upto) + ends["before"]).where(
            F.col("upto") <= budget).agg(F.max(F.struct(*_ORDER)).alias("last")).first()["last"]
        end = F.struct(*[F.lit(last[c]).cast("long" if c == "size" else served.schema[c].dataType)
                         .alias(c) for c in _ORDER]) if last else None

        def taken(e: int) -> Column:
            v = _finish(F.lit(e))
            cell = F.least(F.floor(v * CELLS), F.lit(LAST_CELL)).cast("int")
            here = F.struct(v.alias("v"), "no_source", "src", F.lit(e).alias("copy"), "place",
                            "size") <= end if last else F.lit(False)
            return F.when((cell < ends["cell"]) | ((cell == ends["cell"]) & here), 1).otherwise(0)
        copies = F.when(F.col("size") > 0, sum((taken(e) for e in range(most)), F.lit(0))
                        ).otherwise(0)
    return queue.select(
        "doc_id", F.when(~F.col("no_source"), F.col("src")).alias("source"), "size",
        F.col("words").alias("source_size"), "target", copies.alias("copies"),
        "no_source", "src", "place")


def apply(docs: DataFrame, weights: list[int], most: int = 3, seed: str = "mix:") -> DataFrame:
    """docs with every row as often as the mix takes it."""
    keys = _keys(seed)
    decided = mix(docs, weights, most, seed).where("copies > 0").groupBy(*keys).agg(
        F.max("copies").alias("copies"))
    decided = decided.select(*[F.col(c).alias(f"_mix_{c}") for c in keys],
                             F.col("copies").alias("_mix_copies"))
    tagged = docs.withColumns({f"_mix_{c}": e for c, e in keys.items()})
    return tagged.join(decided, [f"_mix_{c}" for c in keys]).withColumn(
        "_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies")))).select(*docs.columns)
