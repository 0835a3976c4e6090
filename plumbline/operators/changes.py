"""Exact change summary between two versions of a table."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline import roles
from plumbline.operators import drift, state
from plumbline.operators.cells import TABLE, in_columns, small_frame, text_cells
from plumbline.operators.frequent import KEY, MOST, PREFIX, texts
from plumbline.operators.profile import missing, normalised

VALUES_SHOWN = 20


def column_changes(a: DataFrame, b: DataFrame) -> DataFrame:
    """change ('added', 'removed', 'type'), column, before, after; schemas only, no job."""
    ta = {c.name: c.dtype.simpleString() for c in roles.columns(a)}
    tb = {c.name: c.dtype.simpleString() for c in roles.columns(b)}
    rows = [("added", c, None, tb[c]) for c in sorted(tb.keys() - ta.keys())]
    rows += [("removed", c, ta[c], None) for c in sorted(ta.keys() - tb.keys())]
    rows += [("type", c, ta[c], tb[c]) for c in sorted(ta.keys() & tb.keys()) if ta[c] != tb[c]]
    return small_frame(a.sparkSession, rows,
                       "change string, column string, before string, after string")


def row_changes(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows_before, rows_after, change, change_pct."""
    both = (a.select(F.lit(1).alias("x"), F.lit(0).alias("y"))
            .unionAll(b.select(F.lit(0), F.lit(1))))
    return _row_change(both)


def _row_change(counts: DataFrame) -> DataFrame:
    n = counts.agg(F.coalesce(F.sum("x"), F.lit(0)).alias("rows_before"),
                 F.coalesce(F.sum("y"), F.lit(0)).alias("rows_after"))
    d = F.col("rows_after") - F.col("rows_before")
    return n.withColumn("change", d).withColumn("change_pct", F.when(
        F.col("rows_before") > 0, F.round(d * 100.0 / F.col("rows_before"), 2)).otherwise(0.0))


def missing_changes(a: DataFrame, b: DataFrame) -> DataFrame:
    """column, before, after, delta where the number of missing cells differs."""
    x = missing(a).select("column", F.col("missing_count").alias("before"))
    y = missing(b).select("column", F.col("missing_count").alias("after"))
    return (x.join(y, "column").where("before <> after")
            .withColumn("delta", F.col("after") - F.col("before")))


def distribution_shift(a: DataFrame, b: DataFrame) -> DataFrame:
    """column and mean / std / min / max before and after, for numbers on both sides."""
    numeric, _ = drift.common_columns(a, b)
    return _shift(drift.numeric_moments(a, b, numeric))


def _shift(moments: DataFrame) -> DataFrame:
    return moments.where("n_a >= 2 AND n_b >= 2").select(
        "column", *[F.round(f"{k}_{s}", 4).alias(f"{k}_{label}")
                    for k in ("mean", "std", "min", "max")
                    for s, label in (("a", "before"), ("b", "after"))],
        F.round(F.col("mean_b") - F.col("mean_a"), 4).alias("mean_delta"))


def common_categories(a: DataFrame, b: DataFrame) -> list[str]:
    """Columns that both versions have and that hold no numbers in either."""
    ka = {c.name for c in roles.columns(a) if c.kind != "numeric"}
    return [c.name for c in roles.columns(b) if c.kind != "numeric" and c.name in ka]


def category_changes(a: DataFrame, b: DataFrame) -> DataFrame:
    """column, change ('added' or 'removed'), value: every value only one version has.

    Membership on both sides comes from one grouped pass instead of two anti-joins.
    """
    return (drift.paired_histogram(text_cells, a, b, common_categories(a, b))
            .where("(n_a = 0) <> (n_b = 0)")
            .select("column", F.when(F.col("n_a") == 0, "added").otherwise("removed")
                    .alias("change"), "value"))


def _first_changed(pairs: DataFrame, k: int) -> DataFrame:
    """column, change, total and, of each such group, the hashes and prefixes of the values that
    may be among its k first: MOST + 1 at most."""
    changed = pairs.where("(n_a = 0) <> (n_b = 0)").select(*KEY, "prefix", F.when(
        F.col("n_a") == 0, "added").otherwise("removed").alias("change"))
    total = changed.groupBy("column", "change").agg(F.count("*").alias("total"))
    w = Window.partitionBy("column", "change").orderBy("prefix")
    first = changed.withColumn("line", F.row_number().over(w)).where(
        F.col("line") <= MOST + 1).withColumn("place", F.rank().over(w)).where(F.col("place") <= k)
    return first.join(total, ["column", "change"])


def category_changes_shown(a: DataFrame, b: DataFrame, k: int = VALUES_SHOWN,
                           pairs: DataFrame | None = None) -> DataFrame:
    """column, change, values, total: the first k values in order that only one version has, and
    how many there are.

    Histograms are laid beside each other by hashes; texts are read back for the values shown
    alone, and only where those are PREFIX characters or longer.  Where more than MOST changed
    values begin alike, the column's are compared again by longer beginnings.  With pairs given
    (state.paired_hashes), the tables are read for these two purposes only.
    """
    spark, names, width = a.sparkSession, common_categories(a, b), PREFIX
    totals: dict[tuple[str, str], int] = {}
    shown: list[tuple] = []                      # column, change, value
    long: dict[tuple[str, int], list[tuple]] = {}  # change, width: column, h1, h2
    if pairs is None:
        pairs = drift.paired_hashes(a, b, names, width)
    todo: set | None = None                      # groups still to be settled; None: all
    while names:
        rows = _first_changed(pairs, k).collect()
        lines = Counter((r["column"], r["change"]) for r in rows)
        again = {g for g, n in lines.items() if n > MOST and (todo is None or g in todo)}
        for r in rows:
            group = (r["column"], r["change"])
            totals[group] = r["total"]
            if group in again or todo is not None and group not in todo:
                continue
            if r["h1"] is None:
                shown.append((*group, r["prefix"]))
            else:
                long.setdefault((r["change"], width), []).append((r["column"], r["h1"], r["h2"]))
        todo, width = again, width * 8
        names = sorted({c for c, _ in again})
        pairs = drift.paired_hashes(a, b, names, width) if names else None
    values = small_frame(spark, shown, "column string, change string, value string")
    for (change, width), keys in long.items():
        df = normalised(b if change == "added" else a)
        values = values.unionByName(texts(df, keys, width).select(
            "column", F.lit(change).alias("change"), "value"))
    w = Window.partitionBy("column", "change").orderBy("value")
    lists = values.withColumn("i", F.row_number().over(w)).where(F.col("i") <= k).groupBy(
        "column", "change").agg(F.array_sort(F.collect_list("value")).alias("values"))
    return small_frame(spark, [(*g, n) for g, n in totals.items()],
                       "column string, change string, total bigint").join(lists, ["column", "change"])


def summary(a: DataFrame, b: DataFrame) -> DataFrame:
    """All sections in one tall frame: section, column, item, before, after, delta (text)."""
    return summary_of(a, b, state.of(a), state.of(b))


def summary_of(a: DataFrame, b: DataFrame, state_a: state.State, state_b: state.State
               ) -> DataFrame:
    """Like summary, from the states of both versions.  The tables give their schemas; they are
    read only to show changed values of PREFIX characters or more."""
    numeric, _ = drift.common_columns(a, b)
    facts_a, facts_b = state_a.columns, state_b.columns
    both = facts_a.select("column", *[F.col(c).alias(f"{c}_a") for c in facts_a.columns[1:]]).join(
        facts_b.select("column", *[F.col(c).alias(f"{c}_b") for c in facts_b.columns[1:]]), "column")
    counts = facts_a.where(F.col("column") == TABLE).select(
        F.col("rows").alias("x"), F.lit(0).alias("y")).unionAll(
        facts_b.where(F.col("column") == TABLE).select(F.lit(0), "rows"))
    def text(c):
        return F.col(c).cast("string").alias(c)
    none = F.lit(None).cast("string")
    cols = column_changes(a, b).select(
        F.lit("columns").alias("section"), "column", F.col("change").alias("item"), "before",
        "after", none.alias("delta"))
    rows = _row_change(counts).select(
        F.lit("rows").alias("section"), F.lit("__all__").alias("column"),
        F.lit("rows").alias("item"), F.col("rows_before").cast("string").alias("before"),
        F.col("rows_after").cast("string").alias("after"),
        F.col("change").cast("string").alias("delta"))
    lost = both.where("missing_a <> missing_b").select(
        "column", F.col("missing_a").alias("before"), F.col("missing_b").alias("after"),
        (F.col("missing_b") - F.col("missing_a")).alias("delta"))
    gaps = lost.select(
        F.lit("missing").alias("section"), "column", F.lit("missing").alias("item"),
        text("before"), text("after"), text("delta"))
    shift = _shift(both.where(in_columns(numeric))).select("column", F.inline(F.array(*[
        F.struct(F.lit(k).alias("item"), F.col(f"{k}_before").cast("string").alias("before"),
                 F.col(f"{k}_after").cast("string").alias("after"),
                 F.round(F.col(f"{k}_after") - F.col(f"{k}_before"), 4).cast("string")
                 .alias("delta")) for k in ("mean", "std", "min", "max")]))).select(
        F.lit("distribution").alias("section"), "column", "item", "before", "after", "delta")
    pairs = state.paired_hashes(state_a, state_b, common_categories(a, b))
    cats = category_changes_shown(a, b, pairs=pairs).select(
        F.lit("categories").alias("section"), "column", F.col("change").alias("item"),
        none.alias("before"), F.array_join("values", ", ").alias("after"),
        F.col("total").cast("string").alias("delta"))
    return cols.unionByName(rows).unionByName(gaps).unionByName(shift).unionByName(cats)
