"""Exact k-means, piece encoding and token alignment against brute force and the libraries."""

import hashlib
import math
import random
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import align, packing, pieces, shallot
from plumbline.llm.queries import BYTES, PIECES, QUERIES, RANKS

CLASHES = ["ids", "decoded", "source", "pairs", "counts", "row", "links", "chunk", "first",
           "cluster", "narrow", "n_a", "pair"]
DOCS = "doc_id long, text string"
VECTORS = "vec_id long, embedding array<double>"


def clashing(df):
    return df.withColumns({c: F.lit("own") for c in CLASHES if c not in df.columns})


def awkward_texts():
    rng = random.Random(5)
    bits = [" ", "  ", "a", "the", "ing", "\n", "\t", "▁", "é", "日本", "😀", "ｆ", "\0", ".", "12",
            "<0x41>", "<s>", "<|endoftext|>", "é", "     ", "²", "'s", "ll", "x" * 40]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 40))) for _ in range(150)]
    texts += [f"{rng.choice(texts)} once more" for _ in range(20)] * 2
    return [*texts, "", None, " ", "\n\n", "▁", "one", "one", " " * 200_000 + "x", "ab" * 100_000]


@pytest.fixture(scope="module")
def rows():
    return [*enumerate(awkward_texts()), (None, "no id"), (None, None), (7, "same id")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return clashing(spark.createDataFrame(rows, DOCS)).cache()


# --- 11 --------------------------------------------------------------------------------------

def reference_kmeans(rows, k=8, rounds=10, d=64):
    kept = [(i, v) for i, v in rows if v is not None and len(v) == d and all(
        c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(v * 1024) if abs(v) < 2 ** 53 else int(v) * 1024 for v in vec]
         for _, vec in kept]
    order = sorted(range(len(kept)), key=lambda j: (kept[j][0] is None, hashlib.sha256(
        f"3:{kept[j][0]}".encode()).hexdigest(), kept[j][1]))
    at = [list(x[j]) for j in order[:k]]

    def nearest():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n)
                    for n, c in enumerate(at)) for v in x]
    for _ in range(rounds):
        own = [n for _, n in nearest()]
        for n in range(len(at)):
            mine = [v for v, o in zip(x, own, strict=True) if o == n]
            if mine:
                at[n] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    final = nearest()
    sums = Counter()
    for far, n in final:
        sums[n] += far
    return [(i, n, far, sums[n], sum(sums.values()),
             hashlib.sha256(",".join(map(str, at[n])).encode()).hexdigest())
            for (i, _), (far, n) in zip(kept, final, strict=True)]


def as_text(rows):
    return sorted(map(str, (tuple(r) for r in rows)))


def long_or_null(v):
    return v if v < 1 << 63 else None


@pytest.mark.parametrize("kind", ["plain", "ties", "few", "wide"])
def test_kmeans_is_exact(spark, kind):
    rng = np.random.default_rng(4)
    n = 5 if kind == "few" else 400
    x = rng.normal(0, 1, (n, 64)) + rng.integers(0, 3, (n, 1))
    if kind == "ties":  # few different whole numbers: many equal distances
        x = rng.integers(0, 2, (n, 64)) * (rng.random((n, 64)) < 0.06) / 1024
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(1000, None), (1001, []), (1002, [1.0] * 63), (1003, [1.0] * 63 + [math.nan]),
             (1004, [math.inf] + [0.0] * 63), (1005, [None] + [0.0] * 63), (1006, [0.0] * 64)]
    rows += [rows[0], rows[0], (None, rows[1][1]), (None, rows[2][1])]
    if kind == "wide":
        rows += [(2000 + i, [float(v) * 10.0 ** e for v in x[i]]) for i, e in enumerate(
            [9, 12, 30, 200, 300] * 3)]
        rows += [(3000, [-1.7e308] * 64), (3001, [1.7e308] * 64)]
    df = clashing(spark.createDataFrame(rows, VECTORS)).repartition(3)
    got = shallot.cluster(df).collect()
    want = [(i, n, long_or_null(far), long_or_null(s), long_or_null(t), h)
            for i, n, far, s, t, h in reference_kmeans(rows)]
    if kind == "wide":  # sums of distances beyond a long are null altogether
        assert as_text((r[0], r[1], r[2], r[5]) for r in got) == as_text(
            (r[0], r[1], r[2], r[5]) for r in want)
        assert {r["inertia"] for r in got} == {None}
    else:
        assert as_text(got) == as_text(want)


def test_kmeans_of_nothing(spark):
    got = shallot.cluster(spark.createDataFrame([], VECTORS))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia",
                           "centroid_sha256"] and got.count() == 0


@pytest.mark.parametrize("k", [1, 2, 3, 17])
def test_shallot_search_equals_full_scan(k):
    rng = np.random.default_rng(k)
    x = rng.integers(-40, 40, (500, 4))
    at, before, memory = x[:k].tolist(), None, None
    for _ in range(12):
        memory = shallot.assign(x, shallot.centroids(at, before), memory)
        far = ((x[:, None] - np.array(at)[None]) ** 2).sum(axis=2)
        assert (memory.first == far.argmin(axis=1)).all()
        own = np.sqrt(far[np.arange(len(x)), memory.first])
        assert (memory.upper >= own).all()
        far[np.arange(len(x)), memory.first] = 1 << 60
        assert k == 1 or (memory.lower <= np.sqrt(far.min(axis=1))).all()
        before, at = at, [(x[memory.first == c].sum(axis=0) // max(1, (memory.first == c).sum())
                           ).tolist() if (memory.first == c).any() else at[c] for c in range(k)]


def test_kmeans_rounds_do_not_move_vectors(spark):
    x = np.random.default_rng(0).normal(0, 1, (100, 64)).tolist()
    df = spark.createDataFrame(list(enumerate(x)), VECTORS)
    chunks = df.select(F.col("vec_id").alias("chunk"), "embedding")
    names = [shallot._bucketed(chunks.repartition(4, "chunk"), "trial", 4) for _ in range(2)]
    other = spark.table(names[1]).withColumnRenamed("embedding", "memory")
    plan = spark.table(names[0]).join(other.hint("merge"), "chunk").mapInArrow(
        lambda b: b, "chunk long, a array<double>, b array<double>"
    )._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Bucketed: true" in plan
    for n in names:
        spark.sql(f"DROP TABLE {n}")


# --- 12 --------------------------------------------------------------------------------------

def test_pieces_equal_the_library(docs, rows):
    model, sp = pieces.read_model(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = pieces.decode(pieces.encode(docs, model), model)
    assert sorted(got.columns) == sorted([*docs.columns])
    for (_, text), r in zip(rows, got.collect(), strict=True):
        ids = sp.encode(text or "", add_bos=True, add_eos=True)
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids
        assert r["decoded"] == sp.decode(ids) and r["source"] == "own"


def test_pieces_there_and_back_at_once(spark, docs):
    """One Python process per task in batches of bounded rows: two with batches of 10,000 texts
    took more memory than an executor has."""
    model = pieces.read_model(PIECES)
    got = pieces.round_trip(docs, model)
    want = pieces.decode(pieces.encode(docs, model), model)
    assert got.columns == want.columns and as_text(got.collect()) == as_text(want.collect())
    query = QUERIES["op12_pieces"](spark, "/root/testdata/sf0.001")
    assert query._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000


def test_pieces_of_nothing(spark):
    model = pieces.read_model(PIECES)
    got = pieces.decode(pieces.encode(spark.createDataFrame([], DOCS), model), model)
    assert got.columns == ["doc_id", "text", "ids", "decoded"] and got.count() == 0


def test_splitting_equals_merging():
    """The backtracking against its definition, with words of the vocabulary run together."""
    model = pieces.read_model(PIECES)
    codec, rng, words = pieces.Codec(model), random.Random(2), list(model.ids)
    for _ in range(3000):
        word = "".join(rng.choices(words, k=rng.randint(1, 4)))
        assert codec.split(word) == pieces.merged(word, model.score)


def test_backtracking_gives_pieces_back():
    """The longest first piece is wrong, and so is every end it leads to."""
    score = {"ab": -3.0, "bc": -1.0, "abc": -9.0, "cd": -2.0}
    model = pieces.Model({p: i for i, p in enumerate([*score, *"abcd"])},
                         score | dict.fromkeys("abcd", -50.0), [b""] * 8, [0] * 256, 0, 0, False)
    codec = pieces.Codec(model)
    for word in ("abcd", "abab", "bcdcd", "abcabcd", "dcba", "aabbccdd" * 50):
        assert codec.split(word) == pieces.merged(word, score)


def test_any_ids_decode_as_the_library_does():
    model, sp = pieces.read_model(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    codec, rng = pieces.Codec(model), random.Random(8)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), 0, 1, 2, 259])
               for _ in range(rng.randint(0, 12))]
        assert codec.decode(ids) == sp.decode(ids)


# --- 13 --------------------------------------------------------------------------------------

def spans(tokens, surface):
    out, at = [], 0
    for t in tokens:
        out.append((at, at + len(surface[t])))
        at = out[-1][1]
    return out


def test_alignment(spark, docs, rows):
    tok, sp = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    tok.encode_special_tokens = True
    with open(BYTES, encoding="utf-8") as f:
        left = align.Bytes(f.read()).surface
    with open(PIECES, "rb") as f:
        right = align.Pieces(f.read()).surface
    rows = [r for r in rows if len(r[1] or "") < 5000]  # all pairs below
    docs = docs.where(F.coalesce(F.length("text"), F.lit(0)) < 5000)
    kept, counts = [], Counter()
    for doc_id, text in rows:
        a = tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        spelt = b"" if not text else (" " + text).encode()
        if b"".join(left[t] for t in a) != spelt or b"".join(right[t] for t in b) != spelt:
            a, b = [], []
        sa, sb = spans(a, left), spans(b, right)
        links = [(t, u) for t, (s, e) in zip(a, sa, strict=True)
                 for u, (s2, e2) in zip(b, sb, strict=True) if s < e2 and s2 < e]
        cuts = sorted({e for _, e in sa} & {e for _, e in sb})
        groups = ";".join(
            ",".join(str(t) for t, (s, e) in zip(a, sa, strict=True) if lo <= s and e <= hi) + "|"
            + ",".join(str(t) for t, (s, e) in zip(b, sb, strict=True) if lo <= s and e <= hi)
            for lo, hi in zip([0, *cuts], cuts, strict=False))
        kept.append((doc_id, a, b, links, groups, len(cuts)))
        counts.update(links)
    most = defaultdict(int)
    for (_, u), n in counts.items():
        most[u] = max(most[u], n)
    want = [(doc_id, len(a), len(b), n, len(links),
             hashlib.sha256(groups.encode()).hexdigest() if groups else "",
             sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links))
            for doc_id, a, b, links, groups, n in kept]
    aligned = align.compare(docs, BYTES, PIECES)
    counted = align.pair_counts(aligned)
    got = align.score(aligned, counted)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256",
                           "n_best", "count_sum"]
    assert as_text(got.collect()) == as_text(want)
    shuffled = align.sized
    align.sized = lambda df: df  # as beyond the bound
    try:
        assert as_text(align.score(aligned, counted).collect()) == as_text(want)
    finally:
        align.sized = shuffled
    assert {(r["pair"] >> 32, r["pair"] % align.PAIR): r["links"]
            for r in counted.collect()} == counts


def test_texts_are_aligned_as_one(monkeypatch):
    """The marks of many texts are written and hashed at once, empty and refused ones between."""
    task = SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 2))
    monkeypatch.setattr(align, "TaskContext", task)
    calls, own = [], align.align
    monkeypatch.setattr(align, "align", lambda a, b: calls.append(len(a)) or own(a, b))
    texts = awkward_texts()
    with open(BYTES, encoding="utf-8") as f, open(PIECES, "rb") as g:
        files = {"bytes_file": f.read(), "pieces_file": g.read()}
    found = []
    for size in (1, 64):
        monkeypatch.setattr(align, "TEXTS", size)
        batch = pa.RecordBatch.from_pydict(
            {"doc_id": list(range(len(texts))), "text": pa.array(texts, pa.string())})
        calls.clear()
        found.append([r for b in align._align_batches(iter([batch]), **files)
                      for r in b.to_pylist()])
        assert len(calls) == -(-len(texts) // size)
    assert found[0] == found[1] and len(found[0]) == len(texts)


def test_alignment_of_nothing(spark):
    aligned = align.compare(spark.createDataFrame([], DOCS), BYTES, PIECES)
    assert align.score(aligned, align.pair_counts(aligned)).count() == 0


def test_alignment_reads_long_texts(spark):
    rows = [(0, " " * 1_000_000), (1, "a" * 1_000_000), (2, "\n" * 300_000 + "é" * 300_000)]
    got = align.compare(spark.createDataFrame(rows, DOCS), BYTES, PIECES).collect()
    assert all(r["n_groups"] > 0 and r["n_links"] == r["n_a"] + r["n_b"] - r["n_groups"]
               for r in got)


def test_bytes_equal_the_library():
    tok = Tokenizer.from_file(BYTES)
    tok.encode_special_tokens = True
    with open(BYTES, encoding="utf-8") as f:
        own = align.Bytes(f.read())
    texts = [" " + (t or "") for t in awkward_texts()]
    assert [own.encode(t) for t in texts] == [
        e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_runs_jump_stretches():
    rng = random.Random(1)
    for _ in range(300):
        end = rng.randint(1, 300)
        a, b = (sorted({*rng.sample(range(1, end + 1), rng.randint(0, end)), end,
                        *range(end // 3, end // 2)}) for _ in range(2))
        a, b = (np.array([e for e in x if e]) for x in (a, b))
        runs, la, lb = align.align(a, b)
        ends = np.union1d(a, b)
        assert sorted(zip(la, lb, strict=True)) == list(zip(
            np.searchsorted(a, ends), np.searchsorted(b, ends), strict=True))
        assert sum(p if not q else 1 for _, p, _, q in runs) == len(np.intersect1d(a, b))


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_000_000 + "x", "a" * 1_000_000])
def test_packing_reads_texts_of_one_character(text):
    with open(RANKS, "rb") as f:
        tok = packing.Tokenizer(f.read(), packing.PATTERN)
    ids = tok.encode(text)
    assert tok.encoding.decode(ids) == text
    blanks = " " * 999 + "x  y" + "\n" * 900
    assert [i for w in tok.cut(blanks) for i in tok.one.encode_ordinary(w)] == tok.encode(blanks)
