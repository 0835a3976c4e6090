"""Document quality by a linear-chain conditional random field over lines.

Each line is described by shares of its bytes and words, by those of the lines before and after it,
and by its place at the text's edges.  The field has two states, good and bad, a weight per state
change and a weight per feature; it learns from labelled documents, all lines of a good one being
good.  Forward and backward sums give every line's probability of being good, and their mean,
weighted by the lines' bytes, is the document's score.

Fitting takes a bounded sample: the `sample` labelled documents that come first by a hash of their
id, of at most `lines` lines each.  Scoring reads every line of every text.

Edge cases: null and empty texts are one empty line; labels that are null, for unknown documents or
against each other for one document are left out; without any label left the score is 0.5; ties and
repeated rows are scored alike; an empty table gives an empty result; columns other than doc_id,
text and quality are not read (`keep` passes all of them on).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import fold, small_batches, utf8

SAMPLE = 4000
LINES = 1000
ACCEPT = 0.7
_STEPS = 120
_RATE = 0.15
_PENALTY = 1e-3

# kinds of bytes, each a column of shares
_KINDS = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?'\"()-", b"!", b"|",
          b"#$%&*+/<=>@[\\]^_`{}~", b" \t\r\x0b\x0c")
_MASK = np.zeros((len(_KINDS), 256), np.uint8)
for _k, _chars in enumerate(_KINDS):
    _MASK[_k, list(_chars)] = 1
OWN = len(_KINDS) + 5
WIDTH = 3 * OWN + 3


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line of every text, bytes of every line, lines of every text."""
    lines = [t.split(b"\n") for t in texts]
    flat = [x for t in lines for x in t]
    n_lines = np.array([len(t) for t in lines])
    size = np.array([len(x) for x in flat], np.float64)
    data = np.frombuffer(b"\n".join(flat) + b"\n", np.uint8)
    begin = np.r_[0, np.cumsum(size.astype(np.int64) + 1)[:-1]]
    own = np.empty((len(flat), OWN), np.float32)
    for k in range(len(_KINDS)):
        own[:, k] = np.add.reduceat(_MASK[k][data], begin, dtype=np.int64) / np.maximum(size, 1)
    words = [x.split() for x in flat]
    n = np.array([len(w) for w in words], np.float64)
    seen = np.array([len(set(w)) for w in words], np.float64)
    again = np.array([sum(map(bytes.__eq__, w, w[1:])) for w in words], np.float64)
    k = len(_KINDS)
    own[:, k] = 1 - seen / np.maximum(n, 1)
    own[:, k + 1] = again / np.maximum(n, 1)
    own[:, k + 2] = np.minimum(size / np.maximum(n, 1), 30) / 30
    own[:, k + 3] = np.log1p(size) / 10
    own[:, k + 4] = np.log1p(n) * own[:, k]  # long lines repeat words of themselves
    last = np.cumsum(n_lines) - 1
    first = last - n_lines + 1
    x = np.zeros((len(flat), WIDTH), np.float32)
    x[:, :OWN] = own
    x[1:, OWN:2 * OWN] = own[:-1]
    x[first, OWN:2 * OWN] = own[first]  # a text's first line stands in for the one before it
    x[:-1, 2 * OWN:3 * OWN] = own[1:]
    x[last, 2 * OWN:3 * OWN] = own[last]
    x[first, -3] = x[last, -2] = x[:, -1] = 1
    return x, size, n_lines


class Chains:
    """Sequences of different lengths, worked on step by step side by side."""

    def __init__(self, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        ends = np.cumsum(lengths)
        self.first = (ends - lengths)[self.order]
        self.length = lengths[self.order]
        steps = int(lengths.max(initial=0))
        self.active = len(lengths) - np.searchsorted(self.length[::-1], np.arange(steps), "right")

    def marginals(self, emit: np.ndarray, change: np.ndarray
                  ) -> tuple[np.ndarray, np.ndarray, float]:
        """emit: (lines,) score of good over bad; change: (2, 2) log weights from state to state.
        -> probability of good per line, expected changes summed, log partition."""
        steps, n = len(self.active), len(self.length)
        fwd = np.zeros((len(emit), 2))
        bwd = np.zeros((len(emit), 2))
        cur = np.zeros((n, 2))
        for t in range(steps):
            a = self.active[t]
            at = self.first[:a] + t
            if t:
                m = cur[:a, :, None] + change
                cur = np.logaddexp(m[:, 0], m[:, 1])
            else:
                cur = cur[:a].copy()
            cur[:, 1] += emit[at]
            fwd[at] = cur
        total = np.logaddexp(*fwd[self.first + self.length - 1].T) if n else np.zeros(0)
        pairs = np.zeros((2, 2))
        for t in range(steps - 2, -1, -1):
            a = self.active[t + 1]
            at = self.first[:a] + t
            onward = bwd[at + 1].copy()
            onward[:, 1] += emit[at + 1]
            m = change + onward[:, None, :]
            bwd[at] = np.logaddexp(m[:, :, 0], m[:, :, 1])
            pairs += np.exp(fwd[at][:, :, None] + m - total[:a, None, None]).sum(axis=0)
        both = fwd + bwd
        good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -700, 700)))
        return good, pairs, float(total.sum())


Model = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # mean, scale, weights, change


def fit(x: np.ndarray, n_lines: np.ndarray, labels: np.ndarray) -> Model:
    """Maximum likelihood by Adam; every line carries its document's label."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    mean[-1], scale[-1] = 0, 1
    z = ((x - mean) / scale).astype(np.float32)
    y = np.repeat(labels, n_lines).astype(np.float64)
    chains = Chains(n_lines)
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    seen = np.zeros((2, 2))
    for label in (0, 1):  # a document's lines never change state
        seen[label, label] = (n_lines[labels == label] - 1).sum()
    for step in range(1, _STEPS + 1):
        w, change = theta[:-4], theta[-4:].reshape(2, 2)
        good, pairs, _ = chains.marginals(z @ w, change)
        grad = np.r_[z.T @ (good - y), (pairs - seen).ravel()] / len(n_lines) + _PENALTY * theta
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad ** 2
        theta -= _RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return mean, scale, theta[:-4], theta[-4:].reshape(2, 2)


def score_texts(texts: list[bytes], model: Model | None) -> np.ndarray:
    """Each text's mean probability of good, weighted by its lines' bytes."""
    if not texts or model is None:
        return np.full(len(texts), 0.5)
    mean, scale, w, change = model
    x, size, n_lines = line_features(texts)
    good, _, _ = Chains(n_lines).marginals(((x - mean) / scale) @ w, change)
    first = np.cumsum(n_lines) - n_lines
    weight = size + 1  # the line's end
    return np.add.reduceat(good * weight, first) / np.add.reduceat(weight, first)


def _sampled(batches: Iterator, lines: int) -> Iterator:
    for b in batches:
        texts = [t for t in b.column(1).to_pylist()]
        fits = [i for i, t in enumerate(texts) if t.count(b"\n") < lines]
        if fits:
            x, _, n = line_features([texts[i] for i in fits])
            cut = np.split(x, np.cumsum(n)[:-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array([b.column(0)[i].as_py() for i in fits], pa.int32()),
                 pa.array([c.tobytes() for c in cut], pa.binary())], names=["label", "x"])


def train(docs: DataFrame, labels: DataFrame, held_out: int = 2, folds: int = 4,
          sample: int = SAMPLE, lines: int = LINES) -> Model | None:
    """The field fitted to labelled documents outside the fold held out.

    sample documents of at most `lines` lines bound what reaches the driver: their features only.
    """
    small_batches(docs.sparkSession)
    known = labels.where(F.col("quality").isin(0, 1) & (fold("doc_id", folds) != held_out)).groupBy(
        "doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("other")).where(
        "label = other")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(
        "doc_id", F.col("label").cast("int").alias("label"))
    rows = docs.select("doc_id", utf8().alias("t")).join(F.broadcast(chosen), "doc_id").select(
        "label", "t").mapInArrow(partial(_sampled, lines=lines), "label int, x binary").limit(
        2 * sample).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["label"], bytes(r["x"])))  # whichever task came first
    x = [np.frombuffer(r["x"], np.float32).reshape(-1, WIDTH) for r in rows]
    return fit(np.concatenate(x), np.array([len(m) for m in x]),
               np.array([r["label"] for r in rows]))


def _score_batches(batches: Iterator, model: Model | None) -> Iterator:
    for b in batches:
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(score_texts(b.column(1).to_pylist(), model), pa.float64())],
            names=["doc_id", "score"])


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score), a row per document."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", utf8().alias("t")).mapInArrow(
        partial(_score_batches, model=model), f"doc_id {kind}, score double")


def _keep_batches(batches: Iterator, model: Model | None, accept: float, text: int) -> Iterator:
    for b in batches:
        texts = [(t or "").encode() for t in b.column(text).to_pylist()]
        yield b.filter(pa.array(score_texts(texts, model) >= accept))


def keep(docs: DataFrame, model: Model | None, accept: float = ACCEPT) -> DataFrame:
    """docs without those that score below `accept`."""
    small_batches(docs.sparkSession)
    return docs.mapInArrow(partial(_keep_batches, model=model, accept=accept,
                                   text=docs.columns.index("text")), docs.schema)
