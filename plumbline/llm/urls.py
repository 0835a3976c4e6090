"""URL filter: rules first, then a ratio of character language models.

URLs that a rule decides are the examples: two variable-order Markov models over the characters of
host and path, one of the accepted, one of the rejected, smoothed by Witten-Bell.  A context that
was seen n times with t different successors leaves t/(n+t) of its weight to the context shorter
by one, down to a uniform choice; so every prediction uses the longest context that was seen.  The
sum of log ratios is divided by the number of characters, and the threshold on it is the one that
best separates examples kept out of the counting.

Edge cases: null urls and urls without `://` have empty host and path, match no rule and are judged
by the models like any other text; very long urls are judged whole; repeated rows get a row each;
without examples of a kind its model is uniform, and without examples of both kinds to calibrate on
the threshold is 0 (allow); an empty table gives an empty result; columns other than page_id and
url are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import ascii_lower, sized, stored

ORDER = 4                  # characters of the longest context
ALPHABET = 256             # of the uniform choice at the end
START, END = "\x02", "\x03"
SCALE = 1_000_000          # log ratios are summed as whole millionths, in any order alike
BIN = 1_000                # width of a score bin in calibration, in millionths

Rule = tuple[str, str]     # verdict, host and path


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    u = F.coalesce(F.col(url), F.lit(""))
    return (ascii_lower(F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1)),
            F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1))


def _fits(rule: str) -> Column:
    host, slash, path = rule.partition("/")
    return ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col(
        "path").startswith(slash + path)


def matched(rules: list[Rule]) -> Column:
    """The longest rule that fits host and path, else null."""
    by_length = sorted((r for _, r in rules), key=len, reverse=True)
    return F.coalesce(*[F.when(_fits(r), F.lit(r)) for r in by_length], F.lit(None).cast("string"))


def ruled(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """(page_id, host, path, rule, given): given is the rule's verdict or null."""
    host, path = host_and_path()
    verdicts = reduce(lambda c, r: c.when(F.col("rule") == r[1], r[0]), rules, F.when(F.lit(False), ""))
    return pages.select("page_id", host.alias("host"), path.alias("path")).withColumn(
        "rule", matched(rules)).withColumn("given", verdicts).withColumn(
        "chars", F.concat("host", "path"))


def _grams(texts: DataFrame) -> DataFrame:
    """texts(chars, ...) -> each place's character behind its ORDER characters of context."""
    padded = F.concat(F.lit(START * ORDER), "chars", F.lit(END))
    return texts.select("*", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("chars") + 1),
        lambda i: F.substring(padded, i, F.lit(ORDER + 1)))).alias("gram"))


def log_ratios(counts: DataFrame, grams: DataFrame) -> DataFrame:
    """counts(gram, a, b): how often in accepted and rejected; grams(gram), each once.
    -> (gram, ratio): ln P(last | rest) in accepted minus the same in rejected, in millionths."""
    out = grams.withColumns({"pa": F.lit(1.0 / ALPHABET), "pb": F.lit(1.0 / ALPHABET)})
    for k in range(ORDER + 1):
        seen = counts.groupBy(F.expr(f"right(gram, {k + 1})").alias("t")).agg(
            F.sum("a").alias("a"), F.sum("b").alias("b"))
        context = seen.groupBy(F.expr(f"left(t, {k})").alias("context")).agg(
            F.sum("a").alias("na"), F.sum("b").alias("nb"),
            F.count_if(F.col("a") > 0).alias("ta"), F.count_if(F.col("b") > 0).alias("tb"))
        out = out.withColumns({"t": F.expr(f"right(gram, {k + 1})"),
                               "context": F.expr(f"substring(gram, {ORDER + 1 - k}, {k})")}
                              ).join(seen, "t", "left").join(context, "context", "left")
        smooth = {f"p{x}": F.when(F.col(f"n{x}") > 0, (
            F.coalesce(x, F.lit(0)) + F.col(f"t{x}") * F.col(f"p{x}"))
            / (F.col(f"n{x}") + F.col(f"t{x}"))).otherwise(F.col(f"p{x}")) for x in "ab"}
        out = out.withColumns(smooth).select("gram", "pa", "pb")
    return out.select("gram", F.round((F.ln("pa") - F.ln("pb")) * SCALE).cast("long").alias("ratio"))


def scores(texts: DataFrame, ratios: DataFrame) -> DataFrame:
    """texts(chars, ...), each once -> the same and score: the mean ratio in millionths."""
    return _grams(texts).join(sized(ratios), "gram").groupBy(*texts.columns).agg(
        (F.sum("ratio") / F.count("*")).alias("score"))


def threshold(examples: DataFrame) -> float:
    """examples(given, score, n) -> the lowest bin edge that best separates the two kinds."""
    bins = examples.groupBy(F.floor(F.col("score") / BIN).alias("bin")).agg(
        F.sum(F.when(F.col("given") == "allow", F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("given") == "block", F.col("n")).otherwise(0)).alias("b"))
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    total = bins.agg(F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    if not total["a"] or not total["b"]:
        return 0.0
    # a mean of log ratios is bounded by the logarithm of the alphabet, and so are the bins
    gain = (F.lit(total["a"]) - F.coalesce(F.sum("a").over(below), F.lit(0))) / total["a"] - (
        F.lit(total["b"]) - F.coalesce(F.sum("b").over(below), F.lit(0))) / total["b"]
    return float(bins.select("bin", gain.alias("gain")).orderBy(F.desc("gain"), "bin").first()["bin"]
                 * BIN)


def judge(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """(page_id, host, path, rule, verdict, score), a row per page; score is null where a rule
    decides."""
    rows = stored(ruled(pages, rules), "urls")
    # a sixteenth's digit of the text's md5 puts three sixteenths of the examples aside
    aside = F.substring(F.md5(F.col("chars").cast("binary")), 1, 1).isin("0", "1", "2")
    texts = stored(rows.groupBy("chars", "given").agg(F.count("*").alias("n")).withColumn(
        "aside", aside), "texts")
    fit = texts.where("given is not null and not aside")
    counts = stored(_grams(fit).groupBy("gram").agg(
        F.sum(F.when(F.col("given") == "allow", F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("given") == "block", F.col("n")).otherwise(0)).alias("b")), "counts")
    judged = texts.where("given is null or aside")
    ratios = stored(log_ratios(counts, _grams(judged.select("chars")).select("gram").distinct()),
                    "ratios")
    scored = stored(scores(judged, ratios), "scores")
    edge = threshold(scored.where("given is not null"))
    own = scored.where("given is null").select("chars", "score")
    return rows.join(own, "chars", "left").select(
        "page_id", "host", "path", "rule",
        F.when(F.col("given").isNotNull(), F.col("given")).when(
            F.col("score") >= edge, "allow").otherwise("block").alias("verdict"),
        F.when(F.col("given").isNull(), F.col("score")).alias("score"))
