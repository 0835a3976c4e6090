"""Document likelihood by a gated recurrent language model with a class-factored output.

Words of all training documents are counted.  The most frequent ones form the short list, dealt
into classes of equal square-root frequency; every other word belongs to a class by its spelling.
A gated recurrent unit reads a document word by word, and each word's probability is that of its
class given the state, times that of the word within the class: a softmax over the state for
listed words, the smoothed share of the class's counts for others, unseen words included.

Counts, classes, shares and weights come from every word of all training documents, scores from
every word of every document.  The weights are learnt by back-propagation through windows: they
start from a few epochs over a sample, the `sample` first documents by a hash of their id with at
most `longest` words; from there each task goes on over all training documents it reads, and the
tasks' weights are averaged by their tokens.  Many documents are read side by side, one per lane,
the state passing from window to window until a document ends, in learning also after `longest`
words.  What a task learns depends on the rows it reads: another split of the input gives slightly
other scores.

Words with at least a certain count, at most `listed` of them, are sent to the tasks with their
counts; the others' counts are joined to the documents that hold them.

Edge cases: null and empty texts consist of the end mark; without training documents every count
is 0 and the weights stay as they were made; equal texts score alike up to rounding; a repeated
row stays a row; an empty table gives an empty result; columns other than doc_id and text are not
read.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator
from functools import partial
from itertools import pairwise, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import small_batches, stored, utf8

END = b"\n"            # no word holds white space
SHORT = 1024           # words with a place of their own in the output
CLASSES = 32
SPELLINGS = 16         # classes of the other words
HIDDEN = 24
LISTED = 200_000
SAMPLE, LONGEST = 600, 5000
LANES, STEPS = 512, 64
CHUNK = 3_000_000      # tokens that a task reads side by side
_FIT_LANES, _FIT_STEPS, _EPOCHS, _RATE = 32, 16, 3, 0.01
_ONWARD, _SLOWER = 0.003, 50    # rate of the pass over all documents, windows until it falls
_MERGED = 16           # tasks that add up weights
_FLUSH = 400_000       # different words a task counts before it passes them on
_ROWS = 100_000        # of them in a batch
_STRETCH = 1 << 23     # bytes of text that a task cuts into words at once
PSEUDO = 0.1


def tokens(data: bytes) -> list[bytes]:
    words = data.lower().split()
    words.append(END)
    return words


def spelling(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % SPELLINGS


def by_ending() -> np.ndarray:
    """The spelling of every two last bytes, then of every only one."""
    two = [bytes([a, b]) for a in range(256) for b in range(256)]
    return np.array([spelling(w) for w in [*two, *(bytes([a]) for a in range(256))]], np.int32)


def spellings(words: pa.Array, known: np.ndarray) -> np.ndarray:
    """`spelling` of each by what `by_ending` gave; no word is empty."""
    _, ends, data = words.buffers()
    ends = np.frombuffer(ends, np.int32)[words.offset:words.offset + len(words) + 1]
    data, last = np.frombuffer(data or b"", np.uint8), ends[1:] - 1
    before = np.where(np.diff(ends) > 1, data[last - 1].astype(np.int32), 256)
    return known[np.where(before < 256, before * 256, 65536) + data[last]]


# --- counts ----------------------------------------------------------------------------------

def words_of(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, pa.Array]]:
    """(first row, words of each row, the words) of stretches of some _STRETCH bytes; all rows'."""
    upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    cuts = [0, *np.flatnonzero(np.diff(upto // _STRETCH)) + 1, len(texts)]
    for begin, end in pairwise(cuts):
        if begin == end:
            continue
        cut = pc.ascii_split_whitespace(pc.ascii_lower(texts[begin:end].view(pa.string())))
        n = pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
        words = cut.flatten()
        real = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
        if not real.all():  # white space at an end of a text leaves an empty word
            n = np.bincount(np.repeat(np.arange(len(n)), n)[real], minlength=len(n))
            words = words.filter(pa.array(real))
        yield begin, n, words.view(pa.binary())


def _count_batches(batches: Iterator) -> Iterator:
    held: list[pa.Table] = []
    size = ends = 0

    def added_up() -> pa.Table:
        return pa.concat_tables(held).group_by("word", use_threads=False).aggregate(
            [("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])
    for b in batches:
        for _, n, words in words_of(b.column(0)):
            found = words.value_counts()
            held.append(pa.table({"word": found.field(0), "n": found.field(1)}))
            size, ends = size + len(found), ends + len(n)
            if size > 4 * _FLUSH:
                held = [added_up()]
                size = held[0].num_rows
            if size > _FLUSH and len(held) == 1:
                yield from held[0].to_batches(max_chunksize=_ROWS)
                held, size = [], 0
    if held:
        yield from added_up().to_batches(max_chunksize=_ROWS)
    if ends:
        yield pa.RecordBatch.from_arrays(
            [pa.array([END], pa.binary()), pa.array([ends], pa.int64())], names=["word", "n"])


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all words of all documents, the end mark among them."""
    return docs.select(utf8().alias("t")).mapInArrow(_count_batches, "word binary, n long").groupBy(
        "word").agg(F.sum("n").alias("n"))


class Vocabulary(NamedTuple):
    total: int               # training tokens
    distinct: int
    rank: dict[bytes, int]   # listed words, the short list first
    count: np.ndarray        # by rank
    short: int
    class_of: np.ndarray     # by rank in the short list, ascending
    spelt: np.ndarray        # (SPELLINGS, 2): tokens and distinct words outside the short list


def vocabulary(counts: DataFrame, listed: int = LISTED, short: int = SHORT) -> Vocabulary:
    """What tasks need to know of the counts: totals and the most frequent words."""
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    down = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    # a row per different count: few, as their sum is bounded by the tokens
    least = counts.groupBy("n").agg(F.count("*").alias("words")).withColumn(
        "upto", F.sum("words").over(down)).where(F.col("upto") <= listed).agg(F.min("n")).first()[0]
    rows = counts.where(F.col("n") >= least).collect() if least is not None else []
    known = {bytes(r["word"]): r["n"] for r in rows}
    known.setdefault(END, 0)
    # the end mark always has its own place
    order = [END, *sorted((w for w in known if w != END), key=lambda w: (-known[w], w))]
    count = np.array([known[w] for w in order], np.int64)
    short = min(short, len(order))
    order[:short] = sorted(order[:short], key=lambda w: (-known[w], w))
    count = np.array([known[w] for w in order], np.int64)
    mass = np.cumsum(np.sqrt(count[:short] + PSEUDO))
    class_of = np.minimum((mass / mass[-1] * CLASSES - 1e-9).astype(np.int64), CLASSES - 1)
    spelt = np.zeros((SPELLINGS, 2))
    by_spelling = counts.where(F.col("word") != F.lit(END)).groupBy(
        (F.crc32(F.substring("word", -2, 2)) % SPELLINGS).cast("int").alias("k")).agg(
        F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    for r in by_spelling:
        spelt[r["k"]] = r["n"], r["v"]
    for w, n in zip(order[:short], count[:short], strict=True):
        if w != END and n:
            spelt[spelling(w)] -= n, 1
    return Vocabulary(total, distinct, {w: i for i, w in enumerate(order)}, count, short, class_of,
                      spelt)


def encode(words: list[bytes], voc: Vocabulary) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Ranks (-1: not listed), model ids (place or short + spelling), words not listed."""
    ranks = np.fromiter(map(voc.rank.get, words, repeat(-1)), np.int32, len(words))
    ids = ranks.copy()
    other = np.flatnonzero((ranks < 0) | (ranks >= voc.short))
    ids[other] = [voc.short + zlib.crc32(words[i][-2:]) % SPELLINGS for i in other]
    return ranks, ids, [words[i] for i in np.flatnonzero(ranks < 0)]


class Coder:
    """Encodes whole columns of texts as `encode` does a text's words."""

    def __init__(self, voc: Vocabulary):
        self.listed = pa.array(list(voc.rank), pa.binary())
        self.end, self.short = voc.rank[END], voc.short
        self.known = by_ending()
        self.place = np.r_[np.arange(voc.short), voc.short + spellings(
            self.listed[voc.short:], self.known)].astype(np.int32)

    def coded(self, texts: pa.Array) -> Iterator[tuple]:
        """Per stretch: first row, each row's first token, ranks, model ids, the rows and words of
        tokens not listed."""
        for begin, n, words in words_of(texts):
            found = pc.index_in(words, value_set=self.listed).fill_null(-1).to_numpy()
            places = self.place[found]
            other = np.flatnonzero(found < 0)
            unlisted = words.take(pa.array(other))
            places[other] = self.short + spellings(unlisted, self.known)
            rows, last = np.repeat(np.arange(len(n)), n), np.cumsum(n + 1) - 1
            at = rows + np.arange(len(rows))
            ranks, ids = (np.empty(len(rows) + len(n), np.int32) for _ in range(2))
            ranks[at], ids[at] = found, places
            ranks[last], ids[last] = self.end, self.place[self.end]
            yield begin, last - n, ranks, ids, rows[other], unlisted


# --- the network -----------------------------------------------------------------------------

class Network:
    """A gated recurrent unit over model ids; START, the last id, comes before a document."""

    def __init__(self, voc: Vocabulary, hidden: int = HIDDEN, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.short, self.hidden = voc.short, hidden
        self.ids = voc.short + SPELLINGS
        self.class_of = np.r_[voc.class_of, CLASSES + np.arange(SPELLINGS)]
        self.begin = np.searchsorted(voc.class_of, np.arange(CLASSES + 1))
        weight = np.r_[voc.count[:voc.short] + PSEUDO, voc.spelt[:, 0] + PSEUDO]
        mass = np.bincount(self.class_of, weight, CLASSES + SPELLINGS)
        made = {
            "x": rng.normal(0, 0.1, (self.ids + 1, 3 * hidden)),
            "u": rng.normal(0, hidden ** -0.5, (hidden, 3 * hidden)),
            "c": rng.normal(0, 0.05, (hidden, CLASSES + SPELLINGS)),
            "cb": np.log(mass + 1e-9),
            "o": rng.normal(0, 0.05, (voc.short, hidden)),
            "ob": np.log(weight[:voc.short] / mass[voc.class_of])}
        self.p = {k: v.astype(np.float32) for k, v in made.items()}

    def advance(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """The next state and what its slope needs; a column per lane."""
        n = self.hidden
        a = self.p["u"].T @ h
        gates, inner = a[:2 * n], a[2 * n:]
        gates += x[:2 * n]
        gates *= 0.5
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        new = gates[n:] * inner
        new += x[2 * n:]
        np.tanh(new, out=new)
        out = h - new
        out *= gates[:n]
        out += new
        return out, gates, new, inner

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """The same, a row per lane."""
        return tuple(y.T for y in self.advance(x.T, h.T))

    def by_class(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of ids in the order of their classes, and where each class begins."""
        own = self.class_of[ids].astype(np.int16)  # short integers are sorted by their digits
        return np.argsort(own, kind="stable"), np.r_[0, np.cumsum(
            np.bincount(own, minlength=CLASSES + SPELLINGS))]

    def outputs(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights of the classes and of the listed words, a row each, the biases behind them."""
        p = self.p
        return np.c_[p["c"].T, p["cb"]], np.c_[p["o"], p["ob"]]

    def log_probs(self, h: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """ln P(class | h), and for listed words of the word within it, for each row."""
        return self.log_prob_columns(np.r_[h.T, np.ones((1, len(h)), h.dtype)], ids)

    def log_prob_columns(self, h: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The same for each column, below which there is a one."""
        order, cut = self.by_class(ids)
        c, o = self.outputs()
        h, ids = h.take(order, axis=1, mode="clip"), ids[order]
        logits = _logits(c, h)
        got = np.concatenate([logits[k, s:e] for k, (s, e) in enumerate(pairwise(cut))])
        got -= np.log(np.exp(logits, out=logits).sum(axis=0))
        for k, (s, e) in enumerate(pairwise(cut[:CLASSES + 1])):
            a, b = self.begin[k], self.begin[k + 1]
            if s < e and b - a > 1:
                inner = _logits(o[a:b], h[:, s:e])
                got[s:e] += inner[ids[s:e] - a, np.arange(e - s)]
                got[s:e] -= np.log(np.exp(inner, out=inner).sum(axis=0))
        out = np.empty(len(ids))
        out[order] = got
        return out

    def gradients(self, inputs, targets, real, reset, h) -> tuple[dict, np.ndarray]:
        """One window, (steps, lanes) each; real: not beyond a lane's end.  -> gradients, state."""
        steps, lanes = inputs.shape
        n, p = self.hidden, self.p
        kind = p["u"].dtype
        x = p["x"].T.take(inputs, axis=1, mode="clip")
        before, hs = np.empty((n, steps, lanes), kind), np.ones((n + 1, steps, lanes), kind)
        kept, fresh = [], reset.any(axis=1)
        h = h.T.astype(kind)
        for t in range(steps):
            if fresh[t]:
                h = h * ~reset[t]
            before[:, t] = h
            h, *rest = self.advance(x[:, t], h)
            kept.append(rest)
            hs[:n, t] = h
        g = {k: np.zeros_like(v) for k, v in p.items()}
        dh = self._output_gradients(hs.reshape(n + 1, -1), targets.ravel(), real.ravel(), g).reshape(
            n, steps, lanes)
        back = np.zeros((n, lanes), kind)
        da, d_new = np.empty((3 * n, steps, lanes), kind), np.empty((n, steps, lanes), kind)
        for t in range(steps - 1, -1, -1):
            gates, new, inner = kept[t]
            slope = gates * (1 - gates)
            z, r = gates[:n], gates[n:]
            total = dh[:, t] + back
            own, d = da[:, t], total * (1 - z)
            d *= 1 - new * new
            d_new[:, t] = d
            np.multiply(total, before[:, t] - new, out=own[:n])
            np.multiply(d, inner, out=own[n:2 * n])
            own[:2 * n] *= slope
            np.multiply(d, r, out=own[2 * n:])
            back = p["u"] @ own
            total *= z
            back += total
            if fresh[t]:
                back *= ~reset[t]
        g["u"] = before.reshape(n, -1) @ da.reshape(3 * n, -1).T
        da[2 * n:] = d_new
        flat = inputs.ravel().astype(np.min_scalar_type(self.ids))
        order = np.argsort(flat, kind="stable")
        seen, at = np.unique(flat[order], return_index=True)
        dx = da.reshape(3 * n, -1).take(order, axis=1, mode="clip")
        g["x"][seen] = np.add.reduceat(dx, at, axis=1).T
        return g, h.T

    def _output_gradients(self, h, ids, real, g: dict) -> np.ndarray:
        """The gradients of the output's weights, into g; returns that of h, a column per word."""
        n, p, (order, cut) = self.hidden, self.p, self.by_class(ids)
        c, o = self.outputs()
        h, ids = h.take(order, axis=1, mode="clip"), ids[order]
        scale = real[order].astype(h.dtype) / max(1, real.sum())
        d = np.exp(_logits(c, h))
        d *= scale / d.sum(axis=0)
        for k, (s, e) in enumerate(pairwise(cut)):
            d[k, s:e] -= scale[s:e]
        slopes = d @ h.T
        g["c"], g["cb"] = slopes[:, :n].T, slopes[:, n]
        dh, slopes = p["c"] @ d, np.zeros_like(o)
        for k, (s, e) in enumerate(pairwise(cut[:CLASSES + 1])):
            a, b = self.begin[k], self.begin[k + 1]
            if s < e and b - a > 1:
                own, part = h[:, s:e], scale[s:e]
                d = _logits(o[a:b], own)
                np.exp(d, out=d)
                d *= part / d.sum(axis=0)
                d[ids[s:e] - a, np.arange(e - s)] -= part
                np.matmul(d, own.T, out=slopes[a:b])
                dh[:, s:e] += p["o"][a:b].T @ d
        g["o"], g["ob"] = slopes[:, :n], slopes[:, n]
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return dh.take(back, axis=1, mode="clip")


def _logits(w: np.ndarray, h: np.ndarray) -> np.ndarray:
    """w @ h, less each column's greatest."""
    out = w @ h
    out -= out.max(axis=0)
    return out


def lanes_of(lengths: list[int], lanes: int) -> list[list[int]]:
    """Documents dealt to lanes, the longest first, each to the shortest lane; longest lane first."""
    heap = [(0, k) for k in range(min(lanes, len(lengths)))]
    out: list[list[int]] = [[] for _ in heap]
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        load, k = heapq.heappop(heap)
        out[k].append(i)
        heapq.heappush(heap, (load + lengths[i], k))
    return sorted(out, key=lambda docs: -sum(lengths[i] for i in docs))


def _laid_out(docs: list[np.ndarray], lanes: int, start: int):
    """Matrices (time, lane): input and target ids, document (-1 beyond the end), its first word."""
    dealt = lanes_of([len(d) for d in docs], lanes)
    size = [sum(len(docs[i]) for i in d) for d in dealt]
    shape = (max(size, default=0), len(dealt))
    inputs, targets = np.full(shape, start, np.int32), np.zeros(shape, np.int32)
    doc, first = np.full(shape, -1, np.int32), np.zeros(shape, bool)
    for k, own in enumerate(dealt):
        t = 0
        for i in own:
            n = len(docs[i])
            targets[t:t + n, k] = docs[i]
            inputs[t + 1:t + n, k] = docs[i][:-1]
            doc[t:t + n, k] = i
            first[t, k] = True
            t += n
    return inputs, targets, doc, first, np.array(size)


class Adam:
    """Descent with momentum; gradients longer than 1 are shortened to that."""

    def __init__(self, net: Network):
        self.done, self.flat = 0, np.concatenate([x.ravel() for x in net.p.values()])
        self.net, at = net, 0
        for k, x in net.p.items():  # the weights become views of one vector
            net.p[k], at = self.flat[at:at + x.size].reshape(x.shape), at + x.size
        self.m, self.v = np.zeros((2, len(self.flat)), self.flat.dtype)

    def descend(self, g: dict, rate: float) -> None:
        self.done += 1
        m, v, done = self.m, self.v, self.done
        x = np.concatenate([g[k].ravel() for k in self.net.p])
        x *= min(1.0, 1.0 / (math.sqrt(float(x @ x)) + 1e-9))
        m += 0.1 * (x - m)
        x *= x
        x -= v
        x *= 0.01
        v += x
        np.sqrt(v, out=x)
        x *= 1 / math.sqrt(1 - 0.99 ** done)
        x += 1e-8
        np.divide(m, x, out=x)
        x *= rate / (1 - 0.9 ** done)
        self.flat -= x


def fit(net: Network, docs: list[np.ndarray]) -> None:
    """Truncated back-propagation through time with Adam; the state passes between windows."""
    inputs, targets, doc, first, _ = _laid_out(docs, _FIT_LANES, net.ids)
    adam, planned = Adam(net), max(1, _EPOCHS * -(-len(inputs) // _FIT_STEPS))
    for _ in range(_EPOCHS):
        h = np.zeros((inputs.shape[1], net.hidden), np.float32)
        for t in range(0, len(inputs), _FIT_STEPS):
            at = slice(t, t + _FIT_STEPS)
            g, h = net.gradients(inputs[at], targets[at], doc[at] >= 0, first[at], h)
            adam.descend(g, _RATE * (1 - 0.9 * (adam.done + 1) / planned))


def fit_onward(adam: Adam, docs: list[np.ndarray]) -> None:
    """One pass over docs, many lanes wide; lanes that have ended are left out."""
    net = adam.net
    inputs, targets, doc, first, size = _laid_out(docs, LANES, net.ids)
    h = np.zeros((inputs.shape[1], net.hidden), np.float32)
    for t in range(0, len(inputs), _FIT_STEPS):
        live, at = int((size > t).sum()), slice(t, t + _FIT_STEPS)
        g, h = net.gradients(inputs[at, :live], targets[at, :live], doc[at, :live] >= 0,
                             first[at, :live], h[:live])
        adam.descend(g, _ONWARD / math.sqrt(1 + adam.done / _SLOWER))


def network_scores(net: Network, docs: list[np.ndarray]) -> np.ndarray:
    """ln P of every document's classes and listed words, every window of it read in order."""
    inputs, targets, doc, first, size = _laid_out(docs, LANES, net.ids)
    out = np.zeros(len(docs))
    h = np.zeros((net.hidden, inputs.shape[1]), np.float32)
    rows = net.p["x"].T.copy()
    for t0 in range(0, len(inputs), STEPS):
        live = int((size > t0).sum())
        h, part = h[:, :live], slice(t0, t0 + STEPS)
        x = rows.take(inputs[part, :live], axis=1, mode="clip")
        hs = np.ones((net.hidden + 1, *x.shape[1:]), np.float32)
        starts = first[part, :live]
        fresh = starts.any(axis=1)
        for t in range(len(starts)):
            if fresh[t]:
                h = h * ~starts[t]
            h = net.advance(x[:, t], h)[0]
            hs[:-1, t] = h
        own = doc[part, :live].ravel()
        got = net.log_prob_columns(hs.reshape(net.hidden + 1, -1), targets[part, :live].ravel())
        real = own >= 0
        out += np.bincount(own[real], got[real], len(docs))
    return out


# --- documents -------------------------------------------------------------------------------

def _sample_batches(batches: Iterator, voc: Vocabulary, longest: int) -> Iterator:
    for b in batches:
        coded = [encode(w, voc)[1] for w in map(tokens, b.column(0).to_pylist())
                 if len(w) <= longest]
        yield pa.RecordBatch.from_arrays(
            [pa.array([c.tobytes() for c in coded], pa.binary())], names=["ids"])


def _fit_batches(batches: Iterator, voc: Vocabulary, net: Network, longest: int) -> Iterator:
    """The tokens a task read and its weights times these, after a pass over all its rows."""
    adam, coder, held, size, read = Adam(net), Coder(voc), [], 0, 0
    for b in batches:
        for _, starts, _, ids, *_ in coder.coded(b.column(0)):
            for s, e in pairwise([*starts.tolist(), len(ids)]):
                held += [ids[i:min(i + longest, e)] for i in range(s, e, longest)]
                size += e - s
                if size > CHUNK:
                    fit_onward(adam, held)
                    read, size, held = read + size, 0, []
    if held:
        fit_onward(adam, held)
    read += size
    if read:
        yield _weights(read, {k: x.astype(np.float64) * read for k, x in net.p.items()},
                       TaskContext.get().partitionId())


def _weights(read: int, sums: dict, part: int) -> pa.RecordBatch:
    flat = np.concatenate([x.ravel() for x in sums.values()])
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int64()), pa.array([read], pa.int64()),
         pa.array([flat.tobytes()], pa.binary())], names=["part", "read", "sums"])


def _add_batches(batches: Iterator) -> Iterator:
    read, total = 0, None
    for b in batches:
        for n, data in zip(b.column(1), b.column(2), strict=True):
            own = np.frombuffer(data.as_py())
            read, total = read + n.as_py(), own if total is None else total + own
    if read:
        yield _weights(read, {"all": total}, 0)


def fit_all(rows: DataFrame, voc: Vocabulary, net: Network, longest: int) -> int:
    """net's weights after every row of rows (t) was learnt from; returns the tokens read."""
    schema = "part long, read long, sums binary"
    learnt = stored(rows.mapInArrow(partial(_fit_batches, voc=voc, net=net, longest=longest),
                                    schema), "weights")
    # as many rows as tasks; always added in the same order
    got = learnt.repartition(_MERGED, "part").sortWithinPartitions("part").mapInArrow(
        _add_batches, schema).collect()
    read = sum(r["read"] for r in got)
    if read:
        flat, at = sum(np.frombuffer(r["sums"]) for r in got) / read, 0
        for k, x in net.p.items():
            net.p[k] = flat[at:at + x.size].reshape(x.shape).astype(np.float32)
            at += x.size
    return read


class Model(NamedTuple):
    voc: Vocabulary
    net: Network
    counts: DataFrame


def train(docs: DataFrame, training: Column, sample: int = SAMPLE, longest: int = LONGEST,
          listed: int = LISTED) -> Model:
    """Counts and weights from all rows of `training`; the weights start from a sample's."""
    small_batches(docs.sparkSession)
    rows = docs.where(training)
    counts = stored(word_counts(rows), "word_counts")
    voc = vocabulary(counts, listed)
    net = Network(voc)
    chosen = rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    got = rows.select("doc_id", utf8().alias("t")).join(F.broadcast(chosen), "doc_id").select(
        "t").mapInArrow(partial(_sample_batches, voc=voc, longest=longest), "ids binary").limit(
        2 * sample).collect()
    coded = sorted((bytes(r["ids"]) for r in got))  # whichever task came first
    if coded:
        rng = np.random.default_rng(1)
        rng.shuffle(coded)
        fit(net, [np.frombuffer(c, np.int32) for c in coded])
    fit_all(rows.select(utf8().alias("t")), voc, net, longest)
    return Model(voc, net, counts)


def _score_batches(batches: Iterator, voc: Vocabulary, net: Network) -> Iterator:
    """Per document: tokens, and over its listed words the known ones, sum of log10(c + PSEUDO),
    ln probability; its other words with their counts."""
    coder, ten = Coder(voc), math.log(10)
    logs = np.log10(voc.count + PSEUDO)
    share = np.log10(voc.spelt[:, 0] + PSEUDO * (voc.spelt[:, 1] + 1))
    # by rank, the last for words not listed, which the join adds
    of_count, is_known = np.r_[logs, 0], np.r_[voc.count > 0, False]
    # a word outside the short list: log10(c + PSEUDO), less its class's total
    beyond, less = np.r_[logs, 0], np.r_[np.zeros(voc.short), share]
    beyond[:voc.short] = 0
    held: list = []

    def scored():
        ln = network_scores(net, [d for x in held for d in np.split(x[1], x[2][1:])]) / ten
        for (doc_id, _, starts, more, *cols) in held:
            own, ln = ln[:len(starts)], ln[len(starts):]
            yield pa.RecordBatch.from_arrays([doc_id, *cols[:3], pa.array(own + more), *cols[3:]],
                                             names=names)
    names = ["doc_id", "n_tokens", "known", "logs", "model", "words", "times"]
    size = 0
    for b in batches:
        for begin, starts, ranks, ids, rows, words in coder.coded(b.column(1)):
            if held and size + len(ids) > CHUNK:
                yield from scored()
                held, size = [], 0
            size += len(ids)
            sums = [np.add.reduceat(x, starts) for x in (
                beyond[ranks] - less[ids], is_known[ranks].astype(np.int64), of_count[ranks])]
            held.append((b.column(0)[begin:begin + len(starts)], ids, starts, sums[0],
                         pa.array(np.diff(starts, append=len(ids))), *map(pa.array, sums[1:]),
                         *_by_row(rows, words, len(starts))))
    if held:
        yield from scored()


def _by_row(rows: np.ndarray, words: pa.Array, n: int) -> tuple[pa.Array, pa.Array]:
    """For each of n rows its different words and how often it has them."""
    got = pa.table({"row": rows, "word": words}).group_by(
        ["row", "word"], use_threads=False).aggregate([([], "count_all")])
    own = got["row"].to_numpy()
    order = np.argsort(own, kind="stable")
    cuts = pa.array(np.searchsorted(own[order], np.arange(n + 1)).astype(np.int32))
    got = got.take(pa.array(order)).combine_chunks()
    return tuple(pa.ListArray.from_arrays(cuts, pa.concat_arrays([*got[c].chunks, empty]))
                 for c, empty in (("word", pa.array([], pa.binary())),
                                  ("count_all", pa.array([], pa.int64()))))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score), a row per document."""
    small_batches(docs.sparkSession)
    voc = model.voc
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = stored(docs.select("doc_id", utf8().alias("t")).mapInArrow(
        partial(_score_batches, voc=voc, net=model.net),
        f"doc_id {kind}, n_tokens long, known long, logs double, model double, "
        "words array<binary>, times array<long>").withColumn(
        "row", F.monotonically_increasing_id()), "scored")
    other = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select(
        "row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    sums = other.join(model.counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + PSEUDO)).alias("more"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"))
    more = F.coalesce("more", F.lit(0.0))
    norm = math.log10(voc.total + PSEUDO * (voc.distinct + 1))
    return rows.drop("words", "times").join(sums, "row", "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(voc.total).cast("long").alias("train_tokens"),
        (F.col("logs") + more - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        (F.col("model") + more).alias("score"))
