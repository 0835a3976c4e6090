"""SentencePiece encoding of merge-type models by backtracking, and decoding.

A sequence of pieces is what merging by score gives exactly if every two neighbours, merged again
from their characters, come out as they are.  So a text is read from the left: an Aho-Corasick
automaton tells the longest piece that starts at each place; the longest that is compatible with the
piece before is taken, then shorter ones; where none is left the place is marked in a bitfield as
failed, the piece before is given back, and no later try ends at that place again.  Every place
fails once at most, so the time is linear in the text.  Characters outside the vocabulary are
pieces of their own, written as bytes.

A text falls apart wherever no piece of the vocabulary joins two characters: before blanks that
follow something else, between a letter and what is none, at characters that no longer piece holds,
each where the vocabulary allows it.  Such words are encoded one by one and a bounded number of
them is remembered.

The model's file is read on the driver from the path given; its pieces are sent to the tasks.
Models that normalise, hold user-defined or unused pieces, or have no bytes to fall back on are
refused.

Edge cases: null and empty texts are the begin and end ids only; very long texts are encoded whole,
with or without blanks; U+2581 in a text is a blank, as the library has it; equal and repeated rows
are encoded each; an empty table gives an empty result; columns other than the text are passed on
by their names, and the result's columns replace those of the same name.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import partial
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from plumbline.llm.common import small_batches

BLANK = "▁"
REMEMBERED = 400_000       # words, and pairs of pieces, that a task remembers
LONGEST = 64               # characters of a word that is remembered


class Model(NamedTuple):
    ids: dict[str, int]        # piece -> id
    score: dict[str, float]    # piece -> score, the higher the sooner merged
    surface: list[bytes]       # id -> what it decodes to, blanks as spaces
    byte_ids: list[int]        # byte -> id
    begin: int
    end: int
    prefix: bool               # a blank is put before every text


def read_model(path: str) -> Model:
    """The model in a file the driver can read."""
    from sentencepiece import sentencepiece_model_pb2 as proto
    with open(path, "rb") as f:
        m = proto.ModelProto.FromString(f.read())
    kinds, trained, rules = proto.ModelProto.SentencePiece, m.trainer_spec, m.normalizer_spec
    used = {p.type for p in m.pieces}
    if (trained.model_type != proto.TrainerSpec.BPE or not trained.byte_fallback
            or trained.treat_whitespace_as_suffix or rules.precompiled_charsmap
            or rules.remove_extra_whitespaces or not rules.escape_whitespaces
            or used & {kinds.USER_DEFINED, kinds.UNUSED}):
        raise ValueError("only merge models with byte fallback and without normalisation")
    ids, score, surface, byte_ids = {}, {}, [], [0] * 256
    for i, p in enumerate(m.pieces):
        if p.type == kinds.NORMAL:
            ids[p.piece], score[p.piece] = i, p.score
            surface.append(p.piece.replace(BLANK, " ").encode())
        elif p.type == kinds.BYTE:
            byte = int(p.piece[3:-1], 16)  # written <0x0A>
            byte_ids[byte] = i
            surface.append(bytes([byte]))
        elif p.type == kinds.UNKNOWN:
            surface.append(trained.unk_surface.encode())
        else:
            surface.append(b"")
    return Model(ids, score, surface, byte_ids, trained.bos_id, trained.eos_id,
                 rules.add_dummy_prefix)


def merged(text: str, score: dict[str, float]) -> list[str]:
    """Merge characters by highest score, leftmost first, until nothing merges: the definition,
    for short texts."""
    parts = list(text)
    while True:
        best, at = None, -1
        for i in range(len(parts) - 1):
            s = score.get(parts[i] + parts[i + 1])
            if s is not None and (best is None or s > best):
                best, at = s, i
        if best is None:
            return parts
        parts[at:at + 2] = [parts[at] + parts[at + 1]]


def words_pattern(pieces: Iterable[str]) -> str:
    """Matches words between which no piece reaches, without a gap.

    Letters that some piece joins to a following non-letter count as none.
    """
    long = [p for p in pieces if len(p) > 1]
    if any(BLANK in p.lstrip(BLANK) for p in long):
        return ".+"
    seen = {c for p in long for c in p}
    letters = set(re.findall(r"[^\W\d_]", "".join(seen)))
    joined = {(a, b) for p in long for a, b in zip(p, p[1:], strict=False)}
    odd: set[str] = set()
    while more := {a for a, b in joined if a in letters and b not in letters}:
        odd |= more
        letters -= more
    none = re.escape("".join(sorted(odd)))
    letter = rf"[^\W\d_{none}]"
    rest = rf"[^\w{BLANK}{'' if chr(10) in seen else chr(92) + 'n'}]|[\d_{none}]"
    return f"{BLANK}*(?:{rest})*{letter}+|{BLANK}*(?:{rest})+|{BLANK}+|\n"


class Decoder:
    def __init__(self, model: Model):
        self.model = model
        self.bytes = set(model.byte_ids)
        self.silent = {i for i, s in enumerate(model.surface) if not s}
        self.blanks = {i for p, i in model.ids.items() if p.startswith(BLANK)}

    def decode(self, ids: list[int]) -> str:
        """The text of any ids: begin and end are nothing, bytes that form no character U+FFFD."""
        surface, byte_ids = self.model.surface, self.bytes
        try:
            if not self.silent.isdisjoint(ids[1:-1]):
                raise ValueError("bytes before and behind do not join")
            text = b"".join([surface[i] for i in ids]).decode()
        except ValueError:
            text = self._decode_bytes(ids, byte_ids)
        first = next((i for i in ids if surface[i]), None)
        blank = self.model.prefix and first in self.blanks
        return text[1:] if blank else text

    def _decode_bytes(self, ids: list[int], byte_ids: set[int]) -> str:
        """Bytes of one run of byte ids stand together; each that fits nowhere is U+FFFD."""
        surface, out, run = self.model.surface, [], b""
        for i in [*ids, None]:
            if i in byte_ids:
                run += surface[i]
                continue
            while run:
                for n in range(4, 0, -1):
                    try:
                        out.append(run[:n].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    n = 1
                    out.append("�")
                run = run[n:]
            if i is not None:
                out.append(surface[i].decode())
        return "".join(out)


class Codec(Decoder):
    def __init__(self, model: Model):
        super().__init__(model)
        self.automaton = ahocorasick.Automaton()
        for piece in model.ids:
            self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.fits: dict[tuple[str | None, str], str] = {}
        known = model.ids
        # the longest piece a piece starts with, itself apart; a lone character is one
        self.shorter = {p: next(p[:n] for n in range(len(p) - 1, 0, -1) if n == 1 or p[:n] in known)
                        for p in known if len(p) > 1}
        self.words: dict[str, bytes] = {}
        self.cut = re.compile(words_pattern(model.ids), re.DOTALL).findall

    def _first_fit(self, before: str | None, piece: str) -> str:
        """The longest of piece and the pieces it starts with that, behind before or at the start,
        stays as it is when merged again; nothing if none does."""
        if len(self.fits) > REMEMBERED:
            self.fits.clear()
        fit, left = piece, [] if before is None else [before]
        while fit and merged("".join([*left, fit]), self.model.score) != [*left, fit]:
            fit = self.shorter.get(fit, "")
        self.fits[before, piece] = fit
        return fit

    def split(self, word: str) -> list[str]:
        """The pieces of a word."""
        n = len(word)
        longest = [*word, ""]  # by start; later matches of a start are longer
        for end, piece in self.automaton.iter(word):
            longest[end + 1 - len(piece)] = piece
        failed, marked = bytearray((n >> 3) + 1), False
        taken: list[str] = []
        fits, shorter = self.fits.get, self.shorter.get
        at, before, piece = 0, None, longest[0]
        while at < n:
            fit = fits((before, piece))
            if fit is None:
                fit = self._first_fit(before, piece)
            if fit:
                end = at + len(fit)
                if marked and failed[end >> 3] >> (end & 7) & 1:
                    piece = shorter(fit, "")
                else:
                    taken.append(fit)
                    at, before, piece = end, fit, longest[end]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                marked = True
                fit = taken.pop()
                at -= len(fit)
                before, piece = taken[-1] if taken else None, shorter(fit, "")
        return taken

    def _word(self, word: str) -> bytes:
        known, byte_ids = self.model.ids, self.model.byte_ids
        pieces = self.split(word)
        ids = [known.get(p) for p in pieces]
        if None in ids:
            ids = [i for p in pieces for i in (
                [known[p]] if p in known else [byte_ids[b] for b in p.encode()])]
        packed = np.array(ids, "<u4").tobytes()
        if len(word) <= LONGEST:
            if len(self.words) > REMEMBERED:
                self.words.clear()
            self.words[word] = packed
        return packed

    def packed(self, text: str) -> bytes:
        """The ids of a text, without begin and end, 4 bytes each, least first."""
        if not text:
            return b""
        text = text.replace(" ", BLANK)
        if self.model.prefix:
            text = BLANK + text
        words = self.words
        return b"".join([words.get(w) or self._word(w) for w in self.cut(text)])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()


# --- tables ----------------------------------------------------------------------------------

def _encode_batches(batches: Iterator, model: Model, ends: bool, decoded: bool) -> Iterator:
    codec = Codec(model)
    before, after = (np.array([i], "<u4").tobytes() if ends else b""
                     for i in (model.begin, model.end))
    for b in batches:
        ids = [before + codec.packed(text.as_py() or "") + after
               for text in b.column(b.num_columns - 1)]
        more = [pa.array(ids, pa.binary())]
        if decoded:
            more.append(pa.array([codec.decode(np.frombuffer(x, "<u4").tolist()) for x in ids],
                                 pa.string()))
        yield pa.RecordBatch.from_arrays(
            [*b.columns[:-1], *more], names=[*b.schema.names[:-1], *("ids", "decoded")[:len(more)]])


def _decode_batches(batches: Iterator, model: Model) -> Iterator:
    codec = Decoder(model)
    for b in batches:
        texts = [codec.decode(np.frombuffer(x.as_py(), "<u4").tolist()) if x.is_valid else None
                 for x in b.column(b.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())],
                                         names=[*b.schema.names[:-1], "decoded"])


def _with(df: DataFrame, source: str, made: dict, fn) -> DataFrame:
    """df's columns but those made (name: type), then these: what fn makes of the column source,
    which comes last."""
    small_batches(df.sparkSession)
    kept = df.drop(*made)
    schema = StructType([*kept.schema.fields, *(StructField(n, t) for n, t in made.items())])
    source = df[source].alias("of " + " ".join(kept.columns))  # no other column's name
    return df.select(*[df[f"`{c}`"] for c in kept.columns], source).mapInArrow(fn, schema)


def encode(docs: DataFrame, model: Model, text: str = "text", ends: bool = True) -> DataFrame:
    """docs with ids: each text's, between begin and end if ends, 4 bytes each, least first."""
    return _with(docs, text, {"ids": BinaryType()},
                 partial(_encode_batches, model=model, ends=ends, decoded=False))


def decode(encoded: DataFrame, model: Model, ids: str = "ids") -> DataFrame:
    """encoded with decoded: the text of each row's ids; null stays null."""
    return _with(encoded, ids, {"decoded": StringType()}, partial(_decode_batches, model=model))


def round_trip(docs: DataFrame, model: Model, text: str = "text", ends: bool = True) -> DataFrame:
    """decode(encode(docs)): docs with ids and decoded, by one Python process per task, not two."""
    return _with(docs, text, {"ids": BinaryType(), "decoded": StringType()},
                 partial(_encode_batches, model=model, ends=ends, decoded=True))
