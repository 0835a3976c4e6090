"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from plumbline.llm import (
    align, decontaminate, html, language, mixing, neighbours, packing, pieces, quality, sharding,
    shallot, simhash, urls)
from plumbline.llm.common import QUERIES, SQL, fold, query, table  # noqa: F401
from plumbline.llm.sql import DECONTAMINATION, MIXING, url_filter

URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
             ("block", "net/es/"), ("block", "net/fr/")]
QUALITY_FOLDS, QUALITY_HELD_OUT = 4, 2
LM_FOLDS, LM_HELD_OUT = 10, 0
SHARDS = 40
SHINGLE, NEAR_BITS = 4, 4
WINDOW = 10
RANKS = os.environ.get("TOKENIZER_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
BYTES = os.environ.get("TOKENIZER_BYTES", "/opt/tokenizers/byte_bpe_50k.json")
PIECES = os.environ.get("TOKENIZER_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
MIX_WEIGHTS = [1, 2, 3]
MIX_MOST = 3


@query("op1_urls", url_filter(URL_RULES, urls.ORDER, urls.ALPHABET, urls.SCALE, urls.BIN))
def op1_urls(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


@query("op2_quality")
def op2_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels, QUALITY_HELD_OUT, QUALITY_FOLDS)
    return quality.score(docs, model).select(
        "doc_id", F.coalesce(fold("doc_id", QUALITY_FOLDS) == QUALITY_HELD_OUT, F.lit(False)
                             ).alias("held_out"),
        "score", (F.col("score") >= quality.ACCEPT).cast("int").alias("predicted"))


@query("op3_sharding")
def op3_sharding(spark, sf_dir):
    return sharding.assign(table(spark, sf_dir, "documents"), SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query("op4_language")
def op4_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold("doc_id", LM_FOLDS) == LM_HELD_OUT, F.lit(False))
    return language.score(docs, language.train(docs, ~held_out)).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score",
        "score")


@query("op5_simhash")
def op5_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), SHINGLE, NEAR_BITS).select(
        "doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


@query("op6_html")
def op6_html(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return html.main_text(pages, html.train(pages))


@query("op7_packing")
def op7_packing(spark, sf_dir):
    rows = packing.pack(table(spark, sf_dir, "documents"), RANKS)
    return rows.select("task", "block", "row", "doc_ids", "pieces", "ends",
                       F.element_at("ends", -1).alias("n_tokens"),
                       F.crc32("ids").alias("ids_crc32"),
                       F.crc32("positions").alias("positions_crc32"))


@query("op8_decontamination", DECONTAMINATION)
def op8_decontamination(spark, sf_dir):
    return decontaminate.judge(table(spark, sf_dir, "documents"),
                               table(spark, sf_dir, "benchmark"), WINDOW)


@query("op9_mixing", MIXING)
def op9_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_MOST).select(
        "doc_id", "size", F.col("source_size"), "target",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"))


@query("op10_neighbours")
def op10_neighbours(spark, sf_dir):
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op11_kmeans")
def op11_kmeans(spark, sf_dir):
    return shallot.cluster(table(spark, sf_dir, "embeddings"), k=8, rounds=10, seed=3, d=64)


@query("op12_pieces")
def op12_pieces(spark, sf_dir):
    model = pieces.read_model(PIECES)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.round_trip(docs, model).select(
        "doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op13_alignment")
def op13_alignment(spark, sf_dir):
    aligned = align.compare(table(spark, sf_dir, "documents"), BYTES, PIECES)
    return align.score(aligned, align.pair_counts(aligned))
