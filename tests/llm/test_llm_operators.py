"""Corpus operators against brute force, on small tables with every awkward kind of row."""

import hashlib
import math
import random
import re
import subprocess
import sys
import time
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from functools import partial

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Row
from pyspark.sql import functions as F

from plumbline.llm import (
    decontaminate, html, language, mixing, neighbours, packing, quality, sharding, simhash, urls)
from plumbline.llm.graph import components
from plumbline.llm.queries import MIX_WEIGHTS, RANKS, URL_RULES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use within; a table may bring its own columns so named.
CLASHES = ["fp", "size", "cell", "part", "k1", "term", "win", "v", "copy", "src", "place", "word",
           "row", "score", "label", "t", "gram", "host", "vec", "shard", "slot", "least", "bucket"]
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def clashing(df):
    return df.withColumns({c: F.lit("own") for c in CLASHES if c not in df.columns})


def texts(seed=1, n=60):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma,", "ÉTÉ", "été", "delta", "x1", "eins", "zwei", "drei"]
    words += [f"w{i}" for i in range(200)]
    out = [" ".join(rng.choices(words, k=rng.randint(8, 60))) for _ in range(n)]
    for i in range(0, 12):  # near copies
        parts = out[i].split()
        parts[len(parts) // 2] = "other"
        out.append(" ".join(parts))
    return out


@pytest.fixture(scope="module")
def rows():
    long = " ".join(f"long{i % 997}" for i in range(30_000))
    all_texts = [*texts(), "", None, " \n\t ", "one", "two words", "one", long, "a\nb\n\nc", "ÀÉ",
                 "same text here", "same text here", "nbsp\u00a0joined \x1f\x85 kept", None, ""]
    out = [(i, t, "en", f"src{i % 4}" if i % 9 else None, len(t or ""))
           for i, t in enumerate(all_texts)]
    return out + [out[3], out[3], (None, "no id", None, "src1", 5), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return clashing(spark.createDataFrame(rows, SCHEMA)).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def found(df, key="doc_id"):
    out = defaultdict(list)
    for r in df.collect():
        out[r[key]].append(r)
    return out


# --- 1 ---------------------------------------------------------------------------------------

URLS = ["http://www.A.example.com/en/1?q#f", "https://b.net/es/2#x", "http://net/fr/", "x", None, "",
        "http://", "http://example.com", "ftp://example.com/en/", "http://www.example.com/en/9",
        "http://sub.www.example.com/en/9", "a://b://c.com/d", "http://c.net/en/7", "//no/scheme",
        "http://o.org/de/3.html", "HTTP://ÉX.COM/À?", "http://e.com\n/p\nq?z", "http://e.net?/es/",
        "http://notnet/es/1", "http://c.net/en/7", "http://" + "l" * 5000 + ".org/" + "p" * 5000]


def reference_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host):])[0]
        host = host.translate(ASCII)
    best = None
    for verdict, rule in URL_RULES:
        h, _, p = rule.partition("/")
        fits = (host == h or host.endswith("." + h)) and path.startswith("/" + p)
        if fits and (best is None or len(rule) > len(best[1])):
            best = verdict, rule
    return host, path, best


def test_url_rules(spark):
    pages = clashing(spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string"))
    got = {r["page_id"]: r for r in urls.judge(pages, URL_RULES).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        host, path, best = reference_rule(u)
        r = got[i]
        assert (r["host"], r["path"]) == (host, path), u
        assert r["rule"] == (best[1] if best else None), u
        assert r["verdict"] in ("allow", "block")
        if best:
            assert r["verdict"] == best[0]
    assert got[12]["score"] == got[19]["score"]


def witten_bell(counts, gram):
    p = 1.0 / urls.ALPHABET
    for k in range(urls.ORDER + 1):
        context, last = gram[urls.ORDER - k:urls.ORDER], gram[-1]
        after = Counter()
        for g, n in counts.items():
            if g[urls.ORDER - k:urls.ORDER] == context:
                after[g[-1]] += n
        total, kinds = sum(after.values()), len(after)
        if total:
            p = (after[last] + kinds * p) / (total + kinds)
    return p


def test_url_models(spark):
    rng = random.Random(3)
    pages = [(i, f"http://{rng.choice('abc')}{rng.choice(['x.com', 'y.net', 'z.org'])}/"
              f"{rng.choice(['en', 'es', 'fr', 'de'])}/{rng.randint(1, 40)}") for i in range(400)]
    got = urls.judge(spark.createDataFrame(pages, "page_id long, url string"), URL_RULES).collect()
    kinds = {"allow": Counter(), "block": Counter()}
    aside, judged = [], {}
    for _, u in pages:
        host, path, best = reference_rule(u)
        chars = host + path
        padded = urls.START * urls.ORDER + chars + urls.END
        grams = [padded[i:i + urls.ORDER + 1] for i in range(len(chars) + 1)]
        held = hashlib.md5(chars.encode()).hexdigest()[0] in "012"
        if best and not held:
            kinds[best[0]].update(grams)
        elif best:
            aside.append((best[0], grams))
        judged[chars] = grams
    memo = {}

    def score(grams):
        total = 0
        for g in grams:
            if g not in memo:
                memo[g] = round((math.log(witten_bell(kinds["allow"], g))
                                 - math.log(witten_bell(kinds["block"], g))) * urls.SCALE)
            total += memo[g]
        return total / len(grams)
    held = [(kind, score(g)) for kind, g in aside]
    sizes = Counter(kind for kind, _ in held)

    def gain(edge):
        above = Counter(kind for kind, s in held if math.floor(s / urls.BIN) >= edge)
        return above["allow"] / sizes["allow"] - above["block"] / sizes["block"]
    edges = sorted({math.floor(s / urls.BIN) for _, s in held})
    edge = max(edges, key=lambda e: (gain(e), -e)) * urls.BIN
    for r in got:
        if r["rule"] is None:
            s = score(judged[r["host"] + r["path"]])
            assert abs(s - r["score"]) < 2
            if abs(s - edge) > 2:
                assert r["verdict"] == ("allow" if s >= edge else "block")
        else:
            assert r["score"] is None


def test_urls_of_nothing(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), URL_RULES).count() == 0


# --- 2 ---------------------------------------------------------------------------------------

def test_chain_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    lengths = np.array([3, 1, 5, 2])
    emit, change = rng.normal(size=11), rng.normal(size=(2, 2))
    good, pairs, total = quality.Chains(lengths).marginals(emit, change)
    at, z_all, pair_all = 0, 0.0, np.zeros((2, 2))
    for n in lengths:
        z, mark, two = 0.0, np.zeros(n), np.zeros((2, 2))
        for code in range(2 ** n):
            y = [code >> i & 1 for i in range(n)]
            w = math.exp(sum(emit[at + i] for i in range(n) if y[i])
                         + sum(change[a, b] for a, b in zip(y, y[1:], strict=False)))
            z += w
            mark += w * np.array(y)
            for a, b in zip(y, y[1:], strict=False):
                two[a, b] += w
        np.testing.assert_allclose(good[at:at + n], mark / z)
        pair_all += two / z
        z_all += math.log(z)
        at += n
    np.testing.assert_allclose(pairs, pair_all)
    assert abs(total - z_all) < 1e-9


def test_quality_learns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score(clashing(docs), model).collect()}
    held = [r for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    right = [(got[r["doc_id"]] >= quality.ACCEPT) == (r["quality"] == 1) for r in held]
    assert len(got) == docs.count() and len(right) >= 10 and np.mean(right) >= 0.9
    kept = quality.keep(clashing(docs), model)
    assert kept.columns == clashing(docs).columns
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {
        i for i, s in got.items() if s >= quality.ACCEPT}


def test_quality_of_odd_rows(spark, docs, nothing, rows):
    labels = spark.createDataFrame(
        [(0, 1), (1, 0), (1, 1), (2, None), (None, 1), (4, 0), (5, 1), (99999, 0), (6, 0), (6, 0)],
        "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.train(docs, labels.limit(0)) is None
    assert {r["score"] for r in quality.score(docs, None).collect()} == {0.5}
    assert quality.score(nothing, model).count() == 0 and quality.keep(nothing, model).count() == 0


# --- 3 ---------------------------------------------------------------------------------------

@pytest.mark.parametrize("seed", range(6))
def test_smallest_capacity(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 2, 5, rng.randint(1, 90)]) for _ in range(rng.randint(1, 12))]
    for shards in (1, 2, 3, 5):
        def best(i, left):
            if i == len(sizes):
                return 0
            if not left:
                return math.inf
            return min(max(sum(sizes[i:j]), best(j, left - 1)) for j in range(i + 1, len(sizes) + 1))
        least = sharding.smallest_capacity(sizes, shards)
        assert least == best(0, shards)
        begins = sharding.cuts(sizes, shards)
        assert len(begins) == shards - 1 and begins == sorted(begins)
        ends = [*begins, len(sizes)]
        assert max(sum(sizes[a:b]) for a, b in zip([0, *begins], ends, strict=True)) <= least


def test_sharding(spark, docs, rows, nothing):
    got = sharding.assign(docs, 5).collect()
    assert len(got) == len(rows)
    by_text, slots, size = defaultdict(set), defaultdict(list), Counter()
    for r in got:
        slots[r["shard"]].append(r["slot"])
        size[r["shard"]] += r["size"]
        by_text[r["text_crc32"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in by_text.values())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (i, len((t or "").encode()) + 16, None if t is None else zlib.crc32(t.encode()))
        for i, t, *_ in rows)
    assert sharding.assign(nothing, 5).count() == 0
    hot = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(
        F.col("id").cast("string")).alias("text")).withColumnRenamed("id", "doc_id")
    got = sharding.assign(hot, 40).groupBy("shard").agg(
        F.count("*").alias("n"), F.max("slot").alias("last")).collect()
    assert len(got) == 40 and all(r["n"] == r["last"] + 1 for r in got)


# --- 4 ---------------------------------------------------------------------------------------

def test_gradients_are_slopes():
    counts = np.array([9, 7, 5, 3, 2], np.int64)
    voc = language.Vocabulary(26, 5, {b"%d" % i: i for i in range(5)}, counts, 5,
                              np.array([0, 0, 1, 1, 2]), np.ones((language.SPELLINGS, 2)))
    net = language.Network(voc, hidden=4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(2)
    targets = rng.integers(0, 8, (5, 3))
    inputs = rng.integers(0, 8, (5, 3))
    real = np.ones((5, 3), bool)
    real[3:, 2] = False
    first = np.zeros((5, 3), bool)
    first[0], first[3, 1] = True, True

    def loss():
        h, out = np.zeros((3, 4)), 0.0
        for t in range(5):
            h = net.step(net.p["x"][inputs[t]], np.where(first[t][:, None], 0, h))[0]
            out -= net.log_probs(h, targets[t])[real[t]].sum()
        return out / real.sum()
    grads, _ = net.gradients(inputs, targets, real, first, np.zeros((3, 4)))
    for k, g in grads.items():
        flat = net.p[k].ravel()
        for i in rng.choice(flat.size, min(12, flat.size), replace=False):
            keep = flat[i]
            flat[i] = keep + 1e-5
            up = loss()
            flat[i] = keep - 1e-5
            down = loss()
            flat[i] = keep
            assert abs((up - down) / 2e-5 - g.ravel()[i]) < 1e-4, (k, i)


def test_language_model(docs, rows, nothing):
    training = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0,
                          F.lit(True))
    model = language.train(docs, training, listed=40)
    got = language.score(docs, model).collect()
    counts = Counter()
    for i, t, *_ in rows:
        if i is None or zlib.crc32(str(i).encode()) % 10:
            counts.update([*(t or "").encode().lower().split(), language.END])
    total, kinds = sum(counts.values()), len(counts)
    want = Counter()
    for i, t, *_ in rows:
        words = [*(t or "").encode().lower().split(), language.END]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in words)
        want[i, len(words), sum(counts[w] > 0 for w in words), round(base, 6)] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6))
                   for r in got) == want
    assert {r["train_tokens"] for r in got} == {total}
    voc, net = model.voc, model.net  # each word after the other, without lanes and windows
    scores = found(language.score(docs, model))
    for i, t, *_ in rows[::7]:
        words = language.tokens((t or "").encode())[:20_000]
        if len(words) == 20_000:
            continue
        h, before, ln = np.zeros((1, net.hidden), np.float32), net.ids, 0.0
        for w, k in zip(words, language.encode(words, voc)[1], strict=True):
            h = net.step(net.p["x"][[before]], h)[0]
            ln += net.log_probs(h, np.array([k]))[0]
            if k >= voc.short:
                n, v = voc.spelt[k - voc.short]
                ln += math.log((counts[w] + 0.1) / (n + 0.1 * (v + 1)))
            before = k
        assert any(abs(ln / math.log(10) - r["score"]) < 1e-2 for r in scores[i])
    assert language.score(nothing, model).count() == 0
    empty = language.train(nothing, F.lit(True))
    assert all(math.isfinite(r["score"]) for r in language.score(docs, empty).collect())


def test_every_training_document_is_learnt_from(spark):
    """A sequence that only documents beyond the sample hold, or only long ones, is foreseen."""
    rng = random.Random(4)
    plain = [" ".join(rng.choices("abcdefgh", k=80)) for _ in range(40)]
    rare = [" ".join(["a b c d"] * 20)] * 400
    for more, longest in ((rare, 5000), ([" ".join(["a b c d"] * 8000)], 100)):
        rows = list(enumerate(plain + more))
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).cache()
        # the sample: none of the further documents
        small = language.train(docs.where(f"doc_id < {len(plain)}"), F.lit(True), longest=longest)
        model = language.train(docs, F.lit(True), sample=1, longest=longest)
        assert language.fit_all(docs.select(F.encode("text", "utf-8").alias("t")), model.voc,
                                model.net, longest) == sum(len(t.split()) + 1 for _, t in rows)
        ask = spark.createDataFrame([(0, rare[0])], docs.schema)
        learnt, other = (language.score(ask, m).first()["score"] for m in (model, small))
        assert learnt > other + 5


def test_probabilities_add_up(docs):
    model = language.train(docs, F.lit(True), sample=20, listed=40)
    voc, net = model.voc, model.net
    h = np.random.default_rng(0).normal(size=(1, net.hidden)).astype(np.float32)
    listed = sum(math.exp(net.log_probs(h, np.array([i]))[0]) for i in range(voc.short))
    other = sum(math.exp(net.log_probs(h, np.array([voc.short + k]))[0])
                for k in range(language.SPELLINGS))
    assert abs(listed + other - 1) < 1e-4
    known = {bytes(r["word"]): r["n"] for r in model.counts.collect()}
    short = set(list(voc.rank)[:voc.short])
    for k in range(language.SPELLINGS):
        own = [n for w, n in known.items() if w not in short and language.spelling(w) == k]
        assert (sum(own), len(own)) == tuple(voc.spelt[k])


def test_language_model_beats_counts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    model = language.train(docs, ~held)
    r = language.score(docs, model).where(held).agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


def test_columns_are_encoded_as_words_are(docs, rows, monkeypatch):
    voc = language.train(docs, F.lit(True), sample=1, listed=40).voc
    odd = [" lead", "trail\t\n", "a  b\x0b\x0cC\rÉ\u00a0É", "\x1cx \x85", "Z", "zz z", "\n"]
    texts = [b"cut", *((t or "").encode() for _, t, *_ in rows), *(t.encode() for t in odd)]
    for stretch in (1, 100, 1 << 23):
        monkeypatch.setattr(language, "_STRETCH", stretch)
        coder, got, place = language.Coder(voc), [], 0
        for begin, starts, ranks, ids, of, unlisted in coder.coded(pa.array(texts)[1:]):
            assert begin == place
            place += len(starts)
            for i, (s, e) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                got.append((list(ranks[s:e]), list(ids[s:e]),
                            [w.as_py() for w, r in zip(unlisted, of, strict=True) if r == i]))
        want = [language.encode(language.tokens(t), voc) for t in texts[1:]]
        assert got == [(list(r), list(k), other) for r, k, other in want]
    assert list(coder.coded(pa.array([], pa.binary()))) == []


def test_tasks_need_no_copy_of_the_package(tmp_path):
    voc = language.Vocabulary(3, 2, {language.END: 0, b"ab": 1}, np.array([2, 1]), 1,
                              np.array([0]), np.ones((language.SPELLINGS, 2)))
    ship = tmp_path / "shipped"
    ship.write_bytes(cloudpickle.dumps(
        (partial(language._score_batches, voc=voc, net=language.Network(voc)),
         partial(language._fit_batches, voc=voc, net=language.Network(voc), longest=5),
         language._count_batches, pa.record_batch([[7], [b"ab c"]], ["doc_id", "t"]))))
    code = ("import sys; from pyspark import cloudpickle; "
            "score, fit, count, b = cloudpickle.load(open(sys.argv[1], 'rb')); "
            "print(sum(x.num_rows for x in score(iter([b]))), "
            "sum(x.num_rows for x in count(iter([b.select(['t'])]))))")
    got = subprocess.run([sys.executable, "-c", code, ship], cwd=tmp_path, capture_output=True)
    assert got.stdout.split() == [b"1", b"3"], got.stderr


def test_word_counts_passed_on_in_parts(monkeypatch):
    texts = [" ".join(f"w{i % 7} w{i} W{i}" for i in range(k)).encode() for k in (0, 9, 40, 3, 40)]
    monkeypatch.setattr(language, "_STRETCH", 50)
    for flush in (2, 30, 10_000):
        monkeypatch.setattr(language, "_FLUSH", flush)
        monkeypatch.setattr(language, "_ROWS", 11)
        got = Counter()
        for b in language._count_batches(iter([pa.record_batch([pa.array(texts)], ["t"])] * 2)):
            for w, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                got[w] += n
        assert got == Counter(w for t in texts * 2 for w in language.tokens(t))
    assert list(language._count_batches(iter([]))) == []


def test_learning_and_scoring_cost_little(spark):
    """Processor time of both, in that of cutting the texts and counting their words: 9 and 12 in
    two runs, 22 and 23 with a row per lane and words encoded one by one."""
    rng = np.random.default_rng(5)
    data = [" ".join(f"w{i}" for i in rng.zipf(1.2, 600) % 50_000).encode() for _ in range(1000)]
    docs = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(data)],
                                 "doc_id long, text string")
    model = language.train(docs, F.lit(True), sample=1)
    voc, net = model[:2]

    def measured(_):  # in a task, where products take one thread
        ids = [language.encode(language.tokens(t), voc)[1] for t in data]
        batch = pa.record_batch([pa.array(range(len(data))), pa.array(data)], ["doc_id", "t"])

        def cost(*work):
            begun = time.process_time()
            for w in work:
                w()
            return time.process_time() - begun
        return min(cost(lambda: language.fit_onward(language.Adam(net), ids),
                        lambda: list(language._score_batches(iter([batch]), voc, net)))
                   / cost(lambda: [Counter(language.tokens(t)) for t in data]) for _ in range(3))
    ratio = spark.sparkContext.parallelize([0], 1).map(measured).first()
    assert ratio < 16, ratio


# --- 5 ---------------------------------------------------------------------------------------

def brute_fingerprint(text, k=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + k]), 42)
              for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, diff=4):
    ids = [i for i, _ in fps if i is not None]
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, x in fps:
        for b, y in fps:
            if a is not None and b is not None and a < b and bin(x ^ y).count("1") <= diff:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("dense", [simhash.DENSE, 3])
def test_simhash(docs, rows, nothing, dense):
    got = simhash.near_duplicates(docs, dense=dense).collect()
    assert Counter((r["doc_id"], int.from_bytes(bytes(r["fp"]))) for r in got) == Counter(
        (i, brute_fingerprint(t)) for i, t, *_ in rows)
    want = brute_components([(i, brute_fingerprint(t)) for i, t, *_ in rows])
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    assert simhash.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("dense", [simhash.DENSE, 6])
@pytest.mark.parametrize("segments", [6, 7])
def test_links_of_planted_fingerprints(spark, dense, segments):
    """Clusters of fingerprints a few bits apart, compared in place or by shared points."""
    rng = random.Random(5)
    fps = set()
    for _ in range(30):
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 20])):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 6)):
                x ^= 1 << b
            fps.add(x)
    numbered = list(enumerate(sorted(fps)))
    want = brute_components(numbered)
    df = spark.createDataFrame([Row(fp=x.to_bytes(8)) for _, x in numbered], "fp binary")
    names = {x: i for i, x in numbered}
    found_edges = [(names[int.from_bytes(bytes(r["u"]))], names[int.from_bytes(bytes(r["v"]))])
                   for r in simhash.edges(df, 4, segments, dense).collect()]
    root = {i: i for i, _ in numbered}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in found_edges:
        assert bin(numbered[a][1] ^ numbered[b][1]).count("1") <= 4 or want[a] == want[b]
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    assert {i: find(i) for i, _ in numbered} == want


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 301)]
    got = {r["node"]: r["root"] for r in components(
        spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100),
                   300: 300, 301: 300}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("dense", [simhash.DENSE, 3])
def test_deduplicate(docs, rows, nothing, dense):
    """The whole stage against brute force over all pairs of fingerprints."""
    out = simhash.deduplicate(docs, dense=dense)
    assert out.columns == docs.columns
    prints = {}
    for i, t, *_ in rows:  # a row without id stands behind all that have one
        prints.setdefault((i is None, i, t), brute_fingerprint(t))
    order = sorted(prints, key=lambda r: (r[0], r[1] or 0))
    group = list(range(len(order)))
    for x, a in enumerate(order):
        for y, b in enumerate(order[:x]):
            if bin(prints[a] ^ prints[b]).count("1") <= 4 and group[x] != group[y]:
                low, high = sorted((group[x], group[y]))
                group = [low if g == high else g for g in group]
    want = {g: order[g] for g in group}
    got = out.collect()
    assert len(got) == len(want)
    assert Counter(r["doc_id"] for r in got) == Counter(i for _, i, _ in want.values())
    assert simhash.deduplicate(nothing).count() == 0


def test_deduplicate_keeps_one_of_hot_copies(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choices(words, k=200)) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, base[12]) for i in range(300)]
    rows += [rows[3], rows[3], (None, base[12]), (None, None), (400, None), (401, "")]
    out = simhash.deduplicate(clashing(spark.createDataFrame(rows, "doc_id long, text string")))
    assert sorted(r["doc_id"] for r in out.collect()) == [*range(25), 400]


# --- 6 ---------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style>
<script>var a="<p>no</p>";</script></head><body><header class="top">Site name</header>
<nav><ul><li><a href="/">Home page</a></li><li><a href="/x">Other page</a></li></ul></nav>
<!-- ad --><div class="ad">Buy now, this is cheap and good.</div>{body}
<div class="comments"><p>First! I like this text a lot.</p></div>
<footer>&copy; a host &middot; Words at the end of a page.</footer></body></html>"""
MAIN = """<h1>Head &lt;1&gt;</h1><p>Some <b>bold</b>   text
with words<br>and more.</p><aside>Not this.</aside><p>Second para&shy;graph &#8212; ends here with
many more words so that it counts.<form>Name <input></form></p><p>Third one, unclosed"""
TEXT = ("Head <1> Some bold text with words and more. Second para\u00adgraph \u2014 ends here with many "
        "more words so that it counts. Third one, unclosed")


def test_html(spark):
    marked = PAGE.format(body=f"<article>{MAIN}</article>")
    plain = PAGE.format(body=f'<div id="content">{MAIN}</div>')
    cut = f"<nav><li>menu words here</nav><article>{MAIN}"
    rows = [(1, "u1", marked), (2, "u2", plain), (3, "u3", cut), (4, None, None), (5, "u", ""),
            (6, "u", "<nav>only a menu</nav>"), (1, "u1", marked), (None, "u", marked),
            (7, "u", "<article>" + "<p>many words in a page</p>" * 20_000 + "</article>"),
            (8, "u", "a < b <"), *[(100 + i, "m", marked) for i in range(20)]]
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    weights = html.train(pages)
    got = found(html.main_text(pages, weights), "page_id")
    for i in (1, 2, 3, None):
        assert {r["text"] for r in got[i]} == {TEXT}, i
    assert len(got[1]) == 2 and got[4][0]["text"] == got[5][0]["text"] == got[6][0]["text"] == ""
    assert got[7][0]["n_chars"] == len("many words in a page ") * 20_000 - 1
    assert all(r["n_chars"] == len(r["text"]) for x in got.values() for r in x)
    none = pages.limit(0)
    assert html.train(none) == {} and html.main_text(none, {}).count() == 0


def plain_tag_end(text, i):
    quote = ""
    for j in range(i, len(text)):
        c = text[j]
        if quote:
            quote = "" if c == quote else quote
        elif c == ">":
            return j
        elif c in "\"'":
            quote = c
    return -1


@pytest.mark.parametrize("seed", range(20))
def test_ends_of_tags(seed):
    text = "".join(random.Random(seed).choices("a<>\"' ", k=60))
    at, ends = html._tag_ends(text)
    for i in range(len(text) + 1):
        assert ends[bisect_left(at, i)] == plain_tag_end(text, i), (text, i)


WEIGHTS = {"word ": 10.0, "word comments": -2.0, "word ?message": -1.5}


@pytest.mark.parametrize("page, text", [
    ("<article>A <math><mi>x</mi></math> and <noscript>more</noscript></article>", "A x and more"),
    ("<main>a <svg><text>t</text></svg> <object>o</object> <b>c</b></main>", "a t o c"),
    ("<article>a <select><option>n</select><textarea>n</textarea> b</article>", "a b"),
    ("<article>a <script>no<p></script> b <style>no</style> c</article>", "a b c"),
    ("<article><div id=discussion>kept</div> a <div class=message>not</div></article>", "kept a"),
    ("<article>a b <div class=related><div class=comments>no</div> yes</div></article>", "a b yes"),
    ("<p>a b c <div class=comment-list>no <article>d e f</article>", "a b c d e f"),
    ("<p>one < two <a title='x>y'>link</a> <b", "one < two link <b"),
    ("<p>a <!-- no > no --> b <!no> c </ no> d <!-- rest", "a b c d")])
def test_html_parts(page, text):
    assert html.extract(page, WEIGHTS) == text


@pytest.mark.parametrize("unit", ["<a ", "<a \"", "<div>x", "<div><nav><body>", "<div></section>",
                                  "<script", "</script", "<!-", "<nav><div>x", "<!-- x"])
def test_html_is_linear(unit):
    """Half a megabyte of what once took quadratic time: hours, not seconds."""
    start = time.perf_counter()
    html.extract("<article>text " + unit * (500_000 // len(unit)), WEIGHTS)
    assert time.perf_counter() - start < 20


@pytest.mark.parametrize("seed", range(5))
def test_best_run(seed):
    rng = random.Random(seed)
    s = [rng.choice([-3, -1, 0, 1, 2]) for _ in range(25)]
    a, b = html.best_run(s)
    assert sum(s[a:b]) == max(0, *(sum(s[i:j]) for i in range(25) for j in range(i, 26)))


# --- 7 ---------------------------------------------------------------------------------------

@pytest.mark.parametrize("seed", range(8))
def test_best_fit(seed):
    rng = random.Random(seed)
    length = rng.choice([5, 16, 50])
    sizes = [rng.randint(1, length) for _ in range(rng.randint(0, 80))]
    rows, room = [], []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [r for r in range(len(rows)) if room[r] >= sizes[i]]
        if fits:
            r = min(fits, key=lambda r: room[r])
        else:
            r = len(rows)
            rows.append([])
            room.append(length)
        rows[r].append(i)
        room[r] -= sizes[i]
    got = packing.best_fit(sizes, length)
    assert sorted(i for r in got for i in r) == list(range(len(sizes)))
    assert sorted(sum(sizes[i] for i in r) for r in got) == sorted(length - x for x in room)


def test_packing_round_trip(docs, rows, nothing, monkeypatch):
    got = packing.pack(docs, RANKS, length=64).collect()
    with open(RANKS, "rb") as f:
        tok = packing.Tokenizer(f.read(), packing.PATTERN)
    pieces = defaultdict(list)
    for r in got:
        ids = np.frombuffer(bytes(r["ids"]), "<u2")
        positions = np.frombuffer(bytes(r["positions"]), "<u4")
        assert len(ids) == len(positions) == 64 and r["ends"][0] == 0
        want = np.concatenate([np.arange(b - a) for a, b in
                               zip(r["ends"], [*r["ends"][1:], 64], strict=True)])
        assert (positions == want).all() and (ids[r["ends"][-1]:] == tok.end).all()
        for i, n, a, b in zip(r["doc_ids"], r["pieces"], r["ends"], r["ends"][1:], strict=False):
            pieces[i, n].append(ids[a:b].tolist())
    whole = Counter()
    for i, t, *_ in rows:
        ids = [*tok.encoding.encode_ordinary(t or ""), tok.end]
        for n, a in enumerate(range(0, len(ids), 64)):
            whole[i, n, tuple(ids[a:a + 64])] += 1
    assert Counter((i, n, tuple(x)) for (i, n), xs in pieces.items() for x in xs) == whole
    assert packing.pack(nothing, RANKS).count() == 0


# --- 8 ---------------------------------------------------------------------------------------

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_decontamination(spark, docs, rows, nothing):
    items = [(0, " ".join(rows[5][1].split()[2:30])), (1, rows[5][1]), (1, "ONE"), (2, "two, Words!"),
             (3, None), (4, "..."), (None, rows[6][1]), (5, "never seen anywhere at all"),
             (10, rows[7][1]), (9, rows[7][1]), (11, "long5 long6 " + "long7 " * 12)]
    bench = clashing(spark.createDataFrame(items, "item_id long, text string"))
    wins = defaultdict(set)
    for i, t in items:
        w = WORDS.findall((t or "").translate(ASCII))
        for s in range(max(1, len(w) - 9)):
            if w:
                wins[tuple(w[s:s + 10])].add("" if i is None else str(i))
    want = Counter()
    for i, t, *_ in rows:
        w = WORDS.findall((t or "").translate(ASCII))
        hit, ids = set(), set()
        for n in {len(k) for k in wins}:
            for s in range(len(w) - n + 1):
                if tuple(w[s:s + n]) in wins:
                    hit.update(range(s, s + n))
                    ids |= wins[tuple(w[s:s + n])]
        want[i, len(w), len(hit), len(ids),
             hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)] += 1
    got = decontaminate.judge(docs, bench).collect()
    assert Counter(tuple(r)[:6] for r in got) == want
    assert all(r["n_near"] > 0 for r in got if r["contaminated"])
    left = decontaminate.clean(docs, bench)
    assert left.columns == docs.columns and left.count() == sum(
        n for k, n in want.items() if not k[5])
    assert decontaminate.judge(nothing, bench).count() == 0
    assert not decontaminate.judge(docs, bench.limit(0)).where("contaminated").count()


def test_proximity(spark):
    docs = spark.createDataFrame([(0, "a b c rare1 x rare2 d e"), (1, "a b c rare1 x y rare2 d e"),
                                  (2, "rare2 a b c d rare1")], "doc_id long, text string")
    bench = spark.createDataFrame([(0, "rare1 x rare2")], "item_id long, text string")
    m = {r["doc_id"]: (r["contaminated"], r["n_near"])
         for r in decontaminate.judge(docs, bench, slack=1).collect()}
    assert m == {0: (True, 1), 1: (False, 1), 2: (False, 0)}


# --- 9 ---------------------------------------------------------------------------------------

def test_mixing(docs, rows, nothing):
    got = mixing.mix(docs, MIX_WEIGHTS).collect()
    size = {(i, t): len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows}
    total = Counter()
    for i, t, _, s, _ in rows:
        total[s] += size[i, t]
    order = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: MIX_WEIGHTS[k % 3] for k, s in enumerate(order)}
    budget, open_, target = sum(total.values()), set(order), {}
    while True:  # share by weight, stop what is above, share the rest
        level = (budget - sum(target.values())) / sum(weight[s] for s in open_)
        above = {s for s in open_ if level * weight[s] > 3 * total[s]}
        if not above:
            break
        target |= {s: 3.0 * total[s] for s in above}
        open_ -= above
    target |= {s: level * weight[s] for s in open_}
    taken, most = Counter(), Counter()
    for r in got:
        assert abs(r["target"] - target[r["source"]]) < 1e-6 and 0 <= r["copies"] <= 3
        assert r["source_size"] == total[r["source"]]
        taken[r["source"]] += r["copies"] * r["size"]
        most[r["source"]] = max(most[r["source"]], r["size"])
    assert sum(taken.values()) <= budget
    assert len(got) == len(rows)
    assert all(abs(taken[s] - target[s]) <= 2 * max(most.values()) for s in order)
    once = sorted(map(str, got))
    assert once == sorted(map(str, mixing.mix(docs.repartition(7), MIX_WEIGHTS).collect()))
    out = mixing.apply(docs, MIX_WEIGHTS)
    assert out.columns == docs.columns
    assert out.count() == sum(r["copies"] for r in got)
    assert mixing.mix(nothing, MIX_WEIGHTS).count() == 0
    blank = docs.where("text is null")
    assert {r["copies"] for r in mixing.mix(blank, MIX_WEIGHTS).collect()} == {0}


# --- 10 --------------------------------------------------------------------------------------

def brute_neighbours(x, ids, q, k):
    s = (x * x[q]).sum(axis=1)
    rows = [i for i in range(len(ids)) if ids[i] != ids[q]]
    return sorted(rows, key=lambda i: (-s[i], ids[i]))[:k], s


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, 4000)] + 0.5 * rng.normal(size=(4000, 16))).astype(np.float32)
    x[::3] = x[0]  # a third of all rows alike
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)],
                               "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in neighbours.search(df, F.col("vec_id") % 50 == 0, sample=1500).orderBy(
            "query_id", "rank").collect():
        got[r["query_id"]].append(r)
    x, ids, hits = x.astype(np.float64), np.arange(4000), 0
    assert sorted(got) == list(range(0, 4000, 50))
    for q, found_ in got.items():
        want, s = brute_neighbours(x, ids, q, 20)
        hits += len(set(want) & {r["vec_id"] for r in found_})
        assert [r["rank"] for r in found_] == list(range(1, 21))
        assert all(abs(s[r["vec_id"]] - r["score"]) < 1e-12 for r in found_)
        if q % 3 == 0:  # ties go to the least ids
            assert [r["vec_id"] for r in found_] == want
    assert hits / (20 * len(got)) >= 0.9


def test_parts_are_balanced():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 8))
    near = neighbours._nearest(x, x, 10, own=True)
    part = neighbours.balanced_parts(near, 8)
    cut = (part[near] != part[:, None]).mean()
    at_random = (rng.permutation(part)[near] != part[:, None]).mean()
    assert np.bincount(part, minlength=8).max() <= 101 and cut < 0.8 * at_random


def test_neighbours_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, [2.0, 1.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]),
            (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 2.0, 3.0]), (8, [1.0, 0.0]), (9, [1.0, 0.0]),
            (None, [5.0, 5.0]), (0, [1.0, 2.0]), (40, [0.0, 0.0]), (10, [-1.0, -1.0])]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = neighbours.search(df, F.col("vec_id") % 20 == 0).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == [
        (0, 1, 20, 4.0), (0, 2, 8, 1.0), (0, 3, 9, 1.0), (0, 4, 10, -3.0),
        (20, 1, 0, 4.0), (20, 2, 8, 2.0), (20, 3, 9, 2.0), (20, 4, 10, -3.0)]
    assert neighbours.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
