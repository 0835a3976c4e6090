"""Token ids packed into rows of fixed length by best-fit decreasing.

Documents are tokenised whole, an end mark behind each, and cut into pieces of at most `length`
ids.  Pieces of full length are rows of their own.  The others, longest first, go each into the
row with the least room that still holds them; a segment tree over the possible rooms finds it.
A packed row is its ids, padded, the cumulative lengths of its segments, and each id's position,
which starts again at 0 with every segment and with the padding.

A task packs what it reads, some millions of ids at a time: nothing is shuffled, and memory does
not grow with the input.

The tokenizer's file is read on the driver from the path given, and sent to the tasks.

Edge cases: null and empty texts are an end mark only; equal texts and repeated rows are packed
each; very long texts are split and nothing of them is dropped; an empty table gives an empty
result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import small_batches

#: Fixed value: the pattern that belongs to the public vocabulary's ranks.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_LONG_BLANKS = regex.compile(r"\s{1000}").search
LENGTH = 2048
CHUNK = 4_000_000          # ids that a task packs together


class Tokenizer:
    """Byte pieces merged by rank; `end` is the first id behind the ranks."""

    def __init__(self, ranks_file: bytes, pattern: str):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines())
                 if a}
        self.encoding, self.one = (
            tiktoken.Encoding("own", pat_str=p, mergeable_ranks=ranks, special_tokens={})
            for p in (pattern, "(?s).+"))
        self.cut = regex.compile(pattern).findall
        self.end = max(ranks.values()) + 1

    def encode(self, text: str) -> list[int]:
        if not _LONG_BLANKS(text):
            return self.encoding.encode_ordinary(text)
        # the pattern's engine recurses over white space, whose words it takes one by one
        return [i for word in self.cut(text) for i in self.one.encode_ordinary(word)]


class Rooms:
    """Which rooms (free places of open rows) there are; the least one of at least a size."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]
        self.tree = [0] * (2 * self.leaves)  # rows with a room in the node's range

    def _add(self, room: int, n: int) -> None:
        at = room + self.leaves
        while at:
            self.tree[at] += n
            at >>= 1

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """(room, row) of the fullest row that still holds size."""
        at = size + self.leaves
        if not self.tree[at]:
            while at > 1 and (at & 1 or not self.tree[at + 1]):
                at >>= 1  # no such room to the right within the parent
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.tree[2 * at] else 2 * at + 1
        room = at - self.leaves
        self._add(room, -1)
        return room, self.rows[room].pop()


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of indices into sizes, none above length, longest pieces first."""
    rooms, rows = Rooms(length), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        got = rooms.take(sizes[i])
        if got is None:
            got = length, len(rows)
            rows.append([])
        room, row = got
        rows[row].append(i)
        if room > sizes[i]:
            rooms.put(room - sizes[i], row)
    return rows


def _packed_rows(pieces: list, length: int, pad: int, block: int, kind: str, id_type: pa.DataType
                 ) -> pa.RecordBatch:
    """pieces: (doc_id, number, ids)."""
    rows = best_fit([len(p[2]) for p in pieces], length)
    ids = np.full((len(rows), length), pad, kind)
    positions = np.empty((len(rows), length), "<u4")
    ends = []
    for r, row in enumerate(rows):
        at, cut = 0, [0]
        for i in row:
            n = len(pieces[i][2])
            ids[r, at:at + n] = pieces[i][2]
            positions[r, at:at + n] = np.arange(n)
            at += n
            cut.append(at)
        positions[r, at:] = np.arange(length - at)
        ends.append(cut)
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(len(rows), TaskContext.get().partitionId(), np.int32)),
        pa.array(np.full(len(rows), block, np.int32)),
        pa.array(np.arange(len(rows), dtype=np.int32)),
        pa.array([[pieces[i][0] for i in row] for row in rows], pa.list_(id_type)),
        pa.array([[pieces[i][1] for i in row] for row in rows], pa.list_(pa.int32())),
        pa.array(ends, pa.list_(pa.int32())),
        pa.array([x.tobytes() for x in ids], pa.binary()),
        pa.array([x.tobytes() for x in positions], pa.binary())],
        names=["task", "block", "row", "doc_ids", "pieces", "ends", "ids", "positions"])


def _pack_batches(batches: Iterator, ranks_file: bytes, pattern: str, length: int) -> Iterator:
    tok = Tokenizer(ranks_file, pattern)
    kind = "<u2" if tok.end < 1 << 16 else "<u4"
    held, size, block, id_type = [], 0, 0, pa.int64()
    for b in batches:
        id_type = b.column(0).type
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ids = np.array([*tok.encode(text or ""), tok.end], kind)
            for number, at in enumerate(range(0, len(ids), length)):
                held.append((doc_id, number, ids[at:at + length]))
            size += len(ids)
            if size > CHUNK:
                yield _packed_rows(held, length, tok.end, block, kind, id_type)
                held, size, block = [], 0, block + 1
    if held:
        yield _packed_rows(held, length, tok.end, block, kind, id_type)


def pack(docs: DataFrame, ranks_path: str, pattern: str = PATTERN, length: int = LENGTH
         ) -> DataFrame:
    """(task, block, row, doc_ids, pieces, ends, ids, positions), a row per packed row.

    ids: `length` little-endian numbers of 2 bytes, or 4 for large vocabularies; positions: 4
    bytes each; ends: cumulative segment lengths from 0.  Written as Parquet this is the training
    matrix: ids of consecutive rows follow each other.
    """
    small_batches(docs.sparkSession)
    with open(ranks_path, "rb") as f:  # on the driver
        ranks_file = f.read()
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text")).mapInArrow(
        partial(_pack_batches, ranks_file=ranks_file, pattern=pattern, length=length),
        f"task int, block int, row int, doc_ids array<{kind}>, pieces array<int>, ends array<int>, "
        "ids binary, positions binary")
