"""Benchmark decontamination over a distributed positional inverted index.

A benchmark item is cut into windows of `window` consecutive words (an item of fewer is one
window).  The corpus frequency of every benchmark word is counted; each window is then looked up
by its two rarest words only.  Their postings - document, position - are stored as the index.
Shifted by the word's offset in the item, the two lists must meet in the same start.  Where they
do, every word of the item is compared with the document at that start, and unbroken runs of at
least a window's length are matches.  For proximity matches the two lists may miss each other by up
to `slack` words.

Frequent words are thereby never posted unless a window has nothing rarer, no list is gathered
anywhere, and a passage that a third of all documents share costs those documents' rows only.

Edge cases: null and empty texts have no words, hit nothing and, as items, have no window; an item
repeated under several ids counts for each id, a repeated id once, a null id as the empty string;
rows alike in doc_id and text get the same result each; empty tables give no hits, or no rows;
columns other than doc_id, item_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import ascii_lower, sized, stored

#: What separates words, once A-Z are lower-cased: letters, digits and all beyond ASCII make words.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KEY = ["k1", "k2"]


def _cut(text: str = "text") -> Column:
    """The words in order; an empty one at either end where the text begins or ends with a gap."""
    return F.split(ascii_lower(F.coalesce(F.col(text), F.lit(""))), GAPS)


def _words(text: str = "text") -> Column:
    return F.array_remove(_cut(text), "")


def _key() -> dict[str, Column]:
    """Two hashes name a row by its doc_id and text: equal rows share results, others do not."""
    return {"k1": F.xxhash64("doc_id", "text", F.lit(1)),
            "k2": F.xxhash64(F.lit(2), "text", F.col("text").isNull(), "doc_id")}


def _anchors(parts: DataFrame, freq: DataFrame, window: int) -> DataFrame:
    """(text, first, a, b): the offsets of the two rarest words of every window that can occur;
    b is null in windows of one word."""
    known = parts.join(freq, "term", "left")
    last = F.greatest(F.col("n") - window, F.lit(0))
    # a word lies in the windows that begin up to window - 1 words before it
    inside = known.withColumn("first", F.explode(F.sequence(
        F.greatest(F.col("offset") - (window - 1), F.lit(0)), F.least(F.col("offset"), last))))
    rarest = F.array_sort(F.collect_list(F.struct("freq", "offset")))
    return inside.groupBy("text", "first").agg(
        F.bool_or(F.col("freq").isNull()).alias("lost"), rarest.alias("r")).where(
        "not lost").select("text", "first", F.get("r", 0)["offset"].alias("a"),
                           F.get("r", 1)["offset"].alias("b"))


class Matcher:
    """The index of a corpus for one benchmark, and what is found through it."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, window: int = 10):
        self.window = window
        self.docs = docs.select("doc_id", "text", *[c.alias(k) for k, c in _key().items()])
        named = stored(benchmark.select(
            F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
            _words().alias("words")).where(F.size("words") > 0), "items")
        texts = stored(named.select("words").distinct().withColumn(
            "text", F.monotonically_increasing_id()), "texts")
        self.items = stored(named.join(texts, "words").select("text", "item").distinct(), "item_ids")
        # with a table's real size known, Spark broadcasts it only if it is small
        self.parts = stored(texts.select("text", F.size("words").alias("n"), F.posexplode(
            "words").alias("offset", "term")), "parts")
        wanted = stored(self.parts.select("term").distinct(), "terms")
        freq = stored(self.docs.select(F.explode(_cut()).alias("term")).join(
            wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("freq")),
            "frequencies")
        self.anchors = stored(_anchors(self.parts, freq, window), "anchors")
        places = self.anchors.select("text", F.explode(F.array("a", "b")).alias("offset")).where(
            "offset is not null").distinct()
        self.looked_up = stored(self.parts.join(places, ["text", "offset"]), "looked_up")
        posted = stored(self.looked_up.select("term").distinct(), "posted")
        self.index = stored(self.docs.select(*KEY, F.posexplode(_cut()).alias("pos", "term")).join(
            posted, "term", "left_semi"), "index")

    def alignments(self, slack: int = 0) -> DataFrame:
        """(k1, k2, text, n, start, here, near): where items would start by the posted words; the
        offsets of the words that say so, and of those that say so up to `slack` words before."""
        found = self.index.join(self.looked_up, "term").select(
            *KEY, "text", "n", (F.col("pos") - F.col("offset")).alias("start"), "offset")
        by_start = Window.partitionBy(*KEY, "text").orderBy("start")
        offsets = F.collect_set("offset")  # of one item's words
        met = found.withColumn("near", offsets.over(by_start.rangeBetween(-slack, 0)))
        if slack:
            met = met.withColumn("here", offsets.over(by_start.rangeBetween(0, 0)))
        else:
            met = met.withColumn("here", F.col("near"))
        return met.where((F.size("near") > 1) | (F.col("n") == 1)).drop("offset")

    def meeting(self, alignments: DataFrame, offsets: str) -> DataFrame:
        """Those where both rare words of some window are among the offsets."""
        return alignments.join(self.anchors, "text").where(
            F.array_contains(offsets, F.col("a"))
            & (F.col("b").isNull() | F.array_contains(offsets, F.col("b"))))

    def exact(self, alignments: DataFrame) -> DataFrame:
        """(k1, k2, text, first, words): every longest run of an item's words in a document that
        holds a window; first is its position in the document."""
        place = [*KEY, "text", "n", "start"]
        met = stored(self.meeting(alignments, "here").select(*place).distinct(), "met")
        left = self.docs.join(sized(stored(met.select(*KEY).distinct(), "met_docs")), KEY,
                              "left_semi").select(*KEY, F.posexplode(_cut()).alias("pos", "term")
                                                  ).distinct()
        expected = met.join(self.parts.drop("n"), "text").withColumn(
            "pos", F.col("start") + F.col("offset"))
        same = expected.join(left, [*KEY, "pos", "term"], "left_semi")
        order = Window.partitionBy(*place).orderBy("offset")  # one item's words
        return same.withColumn("run", F.col("offset") - F.row_number().over(order)).groupBy(
            *place, "run").agg(F.min("pos").alias("first"), F.count("*").alias("words")).where(
            F.col("words") >= F.least(F.col("n"), F.lit(self.window))).select(
            *KEY, "text", "first", "words")


def judge(docs: DataFrame, benchmark: DataFrame, window: int = 10, slack: int = 3) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near), a row per document.

    n_near: different item texts found by proximity, exact ones included.
    """
    m = Matcher(docs, benchmark, window)
    aligned = stored(m.alignments(slack), "alignments")
    exact = stored(m.exact(aligned), "matches")
    hit = exact.select(*KEY, F.explode(F.sequence(
        F.col("first").cast("long"), F.col("first") + F.col("words") - 1)).alias("pos")).distinct(
        ).groupBy(*KEY).agg(F.count("*").alias("n_hit"))
    items = exact.select(*KEY, "text").distinct().join(m.items, "text").select(*KEY, "item"
                                                                               ).distinct().groupBy(
        *KEY).agg(F.count("*").alias("n_items"), F.sort_array(F.collect_list("item")).alias("items"))
    near = m.meeting(aligned, "near").select(*KEY, "text").distinct().groupBy(*KEY).agg(
        F.count("*").alias("n_near"))
    found = stored(hit.join(items, KEY).join(near, KEY, "full_outer"), "found")
    return m.docs.select(*KEY, "doc_id", F.size(_words()).cast("long").alias("n_words")).join(
        found, KEY, "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256
               ).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).alias("n_near"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """docs without those that contain a window of the benchmark."""
    m = Matcher(docs, benchmark, window)
    hit = stored(m.exact(m.alignments()).select(*KEY).distinct(), "contaminated")
    named = {k: f"_hit_{k}" for k in KEY}
    tagged = docs.withColumns({named[k]: c for k, c in _key().items()})
    return tagged.join(sized(hit).withColumnsRenamed(named), list(named.values()),
                       "left_anti").select(*docs.columns)
