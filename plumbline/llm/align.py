"""Tokens of two tokenizers on one text, put beside each other by diagonal run skipping.

Both token sequences spell the same bytes, so they are two lists of byte ends.  While the ends at
the current shift between the lists' indices agree, tokens stand one to one: the agreeing stretch
is measured by exponential probing, comparing slices twice as long each time, and jumped over; its
first tokens are compared one by one.  Where it stops, the shorter end is followed on either side
until both meet again; these tokens are one irregular group, and its surplus on one side is added to the shift.

A group of p and q tokens has p + q - 1 overlapping pairs, for no end within it is common.  Tasks
count each document's pairs of ids; counts of the whole corpus are a grouped sum of these, and the
best counts of each id an aggregate of that.  They are joined back by id pair: broadcast where a
count proves them few, else shuffled, where adaptive execution splits what frequent pairs weigh.

Vocabularies are read on the driver from the paths given and sent to the tasks.

Edge cases: texts that are null, empty or spelt otherwise by either tokenizer (as where U+2581
becomes a blank) have no tokens: all numbers zero, groups empty; very long texts are aligned whole;
repeated rows and repeated doc_ids count once each; an empty table gives an empty result; columns
other than doc_id and text are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import partial
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import sized, stored

#: The bytes that a byte-level vocabulary writes as themselves (the others follow
#: from 256 on), and the pattern that cuts texts for it.
PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PROBE = 16                 # ends compared in the first slice, then twice as many each time
TEXTS = 256                # texts aligned one after the other, rows of a batch of results
PAIR = 1 << 32             # a pair of ids in one number


class Bytes:
    """A byte-level merge tokenizer, from the text of its JSON file; strings of special tokens are
    plain text.

    Its ids must follow the order of its merges: then merging the pair that spells the least id is
    the same as merging by that order.
    """

    def __init__(self, file: str):
        spec = json.loads(file)
        model, cut = spec["model"], spec["pre_tokenizer"] or {}
        others = (b for b in range(256) if b not in set(PLAIN))
        byte = {chr(b): b for b in PLAIN} | {chr(256 + i): b for i, b in enumerate(others)}
        special = {t["content"] for t in spec["added_tokens"]}
        ids = {bytes(byte[c] for c in entry): i for entry, i in model["vocab"].items()
               if entry not in special}
        merges = (m if isinstance(m, str) else " ".join(m) for m in model["merges"])
        order = [model["vocab"][m.replace(" ", "", 1)] for m in merges]
        if (model["type"] != "BPE" or spec["normalizer"] or cut.get("type") != "ByteLevel"
                or cut.get("add_prefix_space") or not cut.get("use_regex", True)
                or order != sorted(order)):
            raise ValueError("only byte-level merge tokenizers with ids in the order of merges")
        self.surface = [b""] * (max(ids.values()) + 1)
        for entry, i in ids.items():
            self.surface[i] = entry
        self.all, self.one = (tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ids,
                                                special_tokens={})
                              for pattern in (PATTERN, "(?s).+"))
        self.cut = regex.compile(PATTERN).findall
        self.blanks = regex.compile(r"\s{1000}").search

    def encode(self, text: str) -> list[int]:
        if not self.blanks(text):
            return self.all.encode_ordinary(text)
        # the library's pattern recurses over white space; words of any length it takes
        return [i for word in self.cut(text) for i in self.one.encode_ordinary(word)]


def stretch(a: np.ndarray, b: np.ndarray, i: int, j: int) -> int:
    """How many ends from a[i] and b[j] on agree one to one."""
    most, n, step = min(len(a) - i, len(b) - j), 0, PROBE
    while n < most:
        step = min(step, most - n)
        differ = a[i + n:i + n + step] != b[j + n:j + n + step]
        first = int(differ.argmax())
        if differ[first]:
            return n + first
        n += step
        step *= 2
    return n


def align(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ends of two spellings of one text -> runs, and the indices of every overlapping pair.

    A run is (i, p, j, q): p tokens from a[i] and q from b[j], one group; (i, p, j, 0) is a stretch
    of p tokens that stand one to one.
    """
    runs: list[int] = []     # four numbers each
    left, right = [], []     # pairs in irregular groups
    ends_a, ends_b = a.tolist(), b.tolist()
    i, shift, size = 0, 0, len(ends_a)
    while i < size:
        p, q = i, i + shift
        x, y = ends_a[p], ends_b[q]
        if x == y:
            # one by one at first: most stretches are shorter than a slice is worth
            p, near = p + 1, min(i + PROBE, size, len(ends_b) - shift)
            while p < near and ends_a[p] == ends_b[p + shift]:
                p += 1
            if p == i + PROBE:
                p += stretch(a, b, p, p + shift)
            runs += (i, p - i, q, 0)
            i = p
            continue
        while x != y:
            left.append(p)
            right.append(q)
            if x < y:
                p += 1
                x = ends_a[p]
            else:
                q += 1
                y = ends_b[q]
        left.append(p)
        right.append(q)
        runs += (i, p + 1 - i, i + shift, q + 1 - i - shift)
        i, shift = p + 1, q - p
    found = np.array(runs, np.int64).reshape(-1, 4)
    # a stretch's pairs: its tokens in order
    even = found[found[:, 3] == 0]
    n = even[:, 1]
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return (found, np.concatenate([np.repeat(even[:, 0], n) + at, np.array(left, np.int64)]),
            np.concatenate([np.repeat(even[:, 2], n) + at, np.array(right, np.int64)]))


class Pieces:
    """A SentencePiece tokenizer, from the bytes of its model file."""

    def __init__(self, file: bytes):
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=file)
        self.surface = [b""] * self.processor.get_piece_size()
        for i in range(len(self.surface)):
            piece = self.processor.id_to_piece(i)
            self.surface[i] = (bytes([int(piece[3:-1], 16)]) if self.processor.is_byte(i)
                               else piece.replace("\u2581", " ").encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.processor.encode(texts, num_threads=1)


def written(ids: int) -> np.ndarray:
    """(3, ids): every id in decimal before a comma, a bar and a semicolon."""
    return np.array([[f"{i}{mark}".encode() for i in range(ids)] for mark in ",|;"])


def groups_of(a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray,
              table: np.ndarray) -> np.ndarray:
    """The ids of both sides as they are written, a1,a2|b1;a3|b2,b3; with a mark behind each: those
    of a group, which the tokens marked last end, from a and then from b."""
    of_a, of_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    out = np.empty(len(a) + len(b), table.dtype)
    out[np.arange(len(a)) + np.r_[0, np.flatnonzero(last_b) + 1][of_a]] = table[last_a * 1, a]
    out[np.arange(len(b)) + (np.flatnonzero(last_a) + 1)[of_b]] = table[last_b * 2, b]
    return out


def _align_batches(batches: Iterator, bytes_file: str, pieces_file: bytes) -> Iterator:
    left, right = Bytes(bytes_file), Pieces(pieces_file)
    surface_a, surface_b = left.surface, right.surface
    size_a, size_b = (np.array([len(s) for s in x], np.int64) for x in (surface_a, surface_b))
    table = written(max(len(size_a), len(size_b)))
    part, row = TaskContext.get().partitionId() << 40, 0
    for whole in batches:
        for at in range(0, whole.num_rows, TEXTS):
            batch = whole.slice(at, TEXTS)
            texts = [t or "" for t in batch.column(1).to_pylist()]
            all_a, all_b = [], []
            for text, b in zip(texts, right.encode(texts), strict=True):
                spaced = " " + text if text else ""
                a, spelt = left.encode(spaced), spaced.encode()
                if (b"".join(map(surface_a.__getitem__, a)) != spelt
                        or b"".join(map(surface_b.__getitem__, b)) != spelt):
                    a, b = [], []
                all_a.append(np.array(a, np.int64))
                all_b.append(np.array(b, np.int64))
            # texts end alike on both sides, so one after the other they are aligned as apart
            ids_a, ids_b = np.concatenate(all_a), np.concatenate(all_b)
            ends_a, ends_b = np.cumsum(size_a[ids_a]), np.cumsum(size_b[ids_b])
            _, la, lb = align(ends_a, ends_b)
            met = ends_a[la] == ends_b[lb]
            last_a, last_b = np.zeros(len(ids_a), bool), np.zeros(len(ids_b), bool)
            last_a[la[met]], last_b[lb[met]] = True, True
            marked = groups_of(ids_a, ids_b, last_a, last_b, table)
            upto_a, upto_b = (np.r_[0, np.cumsum([len(x) for x in xs])] for xs in (all_a, all_b))
            order = np.argsort(la, kind="stable")
            linked, cut = (ids_a[la] * PAIR + ids_b[lb])[order], np.searchsorted(la[order], upto_a)
            upto, out = upto_a + upto_b, []
            for k in range(len(texts)):
                pairs, counts = np.unique(linked[cut[k]:cut[k + 1]], return_counts=True)
                groups = marked[upto[k]:upto[k + 1]].tobytes().replace(b"\0", b"")[:-1]
                out.append((part + row, len(all_a[k]), len(all_b[k]),
                            int(last_a[upto_a[k]:upto_a[k + 1]].sum()),
                            sha256(groups).hexdigest() if groups else "",
                            int(cut[k + 1] - cut[k]), pairs, counts))
                row += 1
            rows, n_a, n_b, n_groups, digests, n_links, pairs, counts = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in (
                    rows, n_a, n_b, n_groups, n_links)), pa.array(digests, pa.string()),
                 *(pa.array(c, pa.list_(pa.int64())) for c in (pairs, counts))],
                names=["doc_id", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256",
                       "pairs", "counts"])


def compare(docs: DataFrame, bytes_path: str, pieces_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, row, pairs, counts) per document: the
    tokens of a space and the text by the byte-level vocabulary beside those by the pieces.

    pairs: the linked ids, a * 2^32 + b, each once; counts: their links in this document.
    """
    with open(bytes_path, encoding="utf-8") as f, open(pieces_path, "rb") as g:  # on the driver
        files = {"bytes_file": f.read(), "pieces_file": g.read()}
    kind = docs.schema["doc_id"].dataType.simpleString()
    return stored(docs.select("doc_id", "text").mapInArrow(
        partial(_align_batches, **files),
        f"doc_id {kind}, row long, n_a long, n_b long, n_groups long, n_links long, "
        "groups_sha256 string, pairs array<bigint>, counts array<bigint>"), "aligned")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, links, is_best) over all documents; is_best: no other pair of the same b has more."""
    links = aligned.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).groupBy(
        F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("links"))
    of_b = Window.partitionBy(F.col("pair") % PAIR)  # as many rows as A has ids at most
    return stored(links.withColumn("is_best", F.col("links") == F.max("links").over(of_b)), "pairs")


def score(aligned: DataFrame, counted: DataFrame) -> DataFrame:
    """aligned's numbers with n_best and count_sum; counted: pair_counts of the corpus."""
    links = aligned.select("row", F.explode(F.arrays_zip("pairs", "counts")).alias("p")).select(
        "row", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n"))
    sums = links.join(sized(counted), "pair").groupBy("row").agg(
        F.sum(F.when(F.col("is_best"), F.col("n")).otherwise(0)).alias("n_best"),
        F.sum(F.col("n") * F.col("links")).alias("count_sum"))
    return aligned.drop("pairs", "counts").join(sums, "row", "left").fillna(
        0, ["n_best", "count_sum"]).drop("row")
