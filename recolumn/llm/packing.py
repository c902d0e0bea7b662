"""Harmonic packing of documents into token sequences of one capacity.

A document's ids, with END behind them, are cut into pieces of the capacity and a rest; the rest is cut into as few
pieces as possible whose lengths nearly divide the capacity (at most SLACK ids short). A length in (capacity / (k + 1), capacity / k] belongs to
class k, and every sequence of a class holds exactly k pieces of it. So a sequence closes
on a count alone: each task fills the sequences of its own rows in one pass, without a shuffle, and holds at
most one open sequence a length class. What is left in open sequences when a task ends is joined and cut
anew into full sequences and, for the last ids, sequences of powers of two, which need no padding.

Sequences carry their task's number, so a task that runs again gives the same ones; how documents
are dealt over tasks decides which share a sequence.

Units, about a word each, are encoded once and kept, at most KEPT a worker:
no token of the vocabulary's split rule spans the end of a unit. Strings of special tokens are ordinary text.

Defined cases: null and empty texts are the single id END; repeated rows and null ids are documents
of their own; any id type; empty tables give no sequences; texts of any length are cut freely; other columns are ignored.
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as tx
from .cluster import bounded_batches, row_keys

CAPACITY, SLACK, END = 2048, 20, 1
VOCABULARY = "byte_bpe_50k.json"
KEPT, UNIT_BYTES, SLICE, HELD = 1 << 20, 64, 2 << 20, 128  # kept units; longest kept unit; bytes and sequences at once

PIECES = "array<struct<id:{kind},start:bigint,length:bigint,doc_tokens:bigint,offset:bigint>>"

_WHITE = ~tx.SPACED
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[33:127] = True
_MARK &= ~_LETTER


def _white(body: np.ndarray) -> np.ndarray:
    """Bytes of white space, U+0085, U+00A0, U+1680, U+2000-200A, U+2028, U+2029, U+202F, U+205F and U+3000 among it."""
    out = _WHITE[body]
    for lead, rest in ((0xC2, [[0x85, 0xA0]]), (0xE1, [[0x9A], [0x80]]), (0xE2, [[0x80], [*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF]]), (0xE2, [[0x81], [0x9F]]), (0xE3, [[0x80], [0x80]])):
        at = np.flatnonzero(body == lead)
        for k, some in enumerate(rest, 1):
            at = at[at + k < len(body)]
            at = at[np.isin(body[at + k], some)]
        for k in range(len(rest) + 1):
            out[at + k] = True
    return out


def unit_starts(body: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where units begin: at white space behind another character, at an ASCII mark or digit behind a letter (A-Z, a-z, U+00C0-00FF), at each row's begin.

    No token of the vocabulary's split rule spans such a place.
    """
    white = _white(body)
    letter = _LETTER[body]
    latin = np.flatnonzero(body[:-1] == 0xC3) + 1
    letter[latin[(body[latin] != 0x97) & (body[latin] != 0xB7)]] = True
    first = np.zeros(len(body), bool)
    first[1:] = (white[1:] & ~white[:-1]) | (_MARK[body[1:]] & letter[:-1])
    first[at[:-1][at[:-1] < at[1:]]] = True
    return np.flatnonzero(first)


class Encoder:
    """Ids of texts by a public tokenizer; each distinct unit, known by a 64-bit hash, is encoded once."""

    def __init__(self, vocabulary: str = VOCABULARY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if not os.path.isabs(vocabulary):
            import public_tokenizers

            vocabulary = public_tokenizers.path(vocabulary)
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = True
        self.clear()

    def clear(self):
        self.known, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.first, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.used = self.slots = 0

    def _learn(self, units: list[str]) -> None:
        """Appends the ids of some units."""
        own = [e.ids for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]
        size = np.fromiter(map(len, own), np.int64, len(own))
        until = self.used + int(size.sum())
        while until > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.slots + len(own) > len(self.first):
            self.first, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.size))
        self.ids[self.used : until] = np.fromiter(chain.from_iterable(own), np.uint32, until - self.used)
        self.size[self.slots : self.slots + len(own)] = size
        self.first[self.slots : self.slots + len(own)] = self.used + np.cumsum(size) - size
        self.used, self.slots = until, self.slots + len(own)

    def encode(self, body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts joined, and where each text's ids begin and end."""
        if len(self.known) > KEPT:
            self.clear()
        if not len(body):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        starts = unit_starts(body, at)
        ends = np.append(starts[1:], len(body))
        distinct, one, inverse = np.unique(tx.hashes(body, starts, ends, None), return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, distinct)
        old = place < len(self.known)
        old[old] = self.known[place[old]] == distinct[old]
        slot = np.empty(len(distinct), np.int64)
        slot[old] = self.slot[place[old]]
        new = np.flatnonzero(~old)
        # long units come last and are not kept
        short = ends[one[new]] - starts[one[new]] <= UNIT_BYTES
        new, kept = np.concatenate([new[short], new[~short]]), int(short.sum())
        slot[new] = self.slots + np.arange(len(new))
        for part in (new[:kept], new[kept:]):
            before = self.slots, self.used
            if len(part):
                self._learn([body[i:j].tobytes().decode("utf-8", "replace") for i, j in zip(starts[one[part]].tolist(), ends[one[part]].tolist(), strict=True)])
        own = slot[inverse]
        size = self.size[own]
        ids = self.ids[np.repeat(self.first[own], size) + tx.ranges(size)]
        self.slots, self.used = before
        self.known, self.slot = np.insert(self.known, place[new[:kept]], distinct[new[:kept]]), np.insert(self.slot, place[new[:kept]], slot[new[:kept]])
        return ids, np.concatenate([[0], np.cumsum(size)])[np.searchsorted(starts, at)]


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """A worker's encoder, with the units that its earlier tasks have learned."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


@lru_cache
def cuts(capacity: int = CAPACITY, slack: int = SLACK) -> list[list[int]]:
    """For each rest below the capacity the lengths of its pieces: as few as possible, then the smallest one as large as possible.

    A length fits if as many of it as the capacity holds leave at most `slack` ids of it empty.
    """
    sizes = np.arange(1, capacity + 1)
    fits = sizes[capacity % sizes <= slack]
    best, out = [(0, capacity + 1)], [[]]
    for r in range(1, capacity):
        below = fits[fits <= r]
        count, least, size = min((best[r - s][0] + 1, -min(best[r - s][1], s), s) for s in below.tolist())
        best.append((count, -least))
        out.append(sorted([size, *out[r - size]], reverse=True))
    return out


class Packer:
    """Open sequences of one task; `add` takes a document's ids, `closed` are the sequences that are full."""

    def __init__(self, capacity: int = CAPACITY, slack: int = SLACK, parts: list[list[int]] | None = None):
        self.capacity, self.parts = capacity, parts or cuts(capacity, slack)
        self.open: dict[int, list] = {}
        self.closed: list[list] = []

    def add(self, doc, ids: np.ndarray) -> None:
        """A piece is (document, its first id's place, ids, the document's number of ids)."""
        at, whole = 0, len(ids)
        for size in [self.capacity] * (whole // self.capacity) + self.parts[whole % self.capacity]:
            k = self.capacity // size
            bin_ = self.open.setdefault(k, [])
            bin_.append((doc, at, ids[at : at + size], whole))
            if len(bin_) == k:
                self.closed.append(self.open.pop(k))
            at += size

    def finish(self) -> None:
        """Joins the pieces of open sequences and cuts them into full sequences and powers of two."""
        rest = [piece for k in sorted(self.open) for piece in self.open[k]]
        self.open = {}
        left = sum(len(ids) for _, _, ids, _ in rest)
        room, own = self._room(left), []
        for doc, start, ids, whole in rest:
            while len(ids):
                part, ids = ids[:room], ids[room:]
                own.append((doc, start, part, whole))
                start, room, left = start + len(part), room - len(part), left - len(part)
                if not room:
                    self.closed.append(own)
                    room, own = self._room(left), []

    def _room(self, left: int) -> int:
        return self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1) if left else 0


def _pack(vocabulary: str, capacity: int, slack: int, end: int, kind: pa.DataType):
    def table(first: int, found: list[list]) -> pa.RecordBatch:
        flat = [p for own in found for p in own]
        size = np.array([len(p[2]) for p in flat], np.int64)
        upto = np.concatenate([[0], np.cumsum([len(own) for own in found])])
        before = np.concatenate([[0], np.cumsum(size)])
        used = before[upto[1:]] - before[upto[:-1]]
        offset = before[:-1] - np.repeat(before[upto[:-1]], np.diff(upto))
        padded = np.where(used & (used - 1), capacity, used)
        ids = pa.array([np.concatenate([p[2] for p in own]).astype("<u4").tobytes() for own in found], pa.binary())
        columns = [pa.array([p[0] for p in flat], kind), pa.array([p[1] for p in flat], pa.int64()), pa.array(size), pa.array([p[3] for p in flat], pa.int64()), pa.array(offset)]
        pieces = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.StructArray.from_arrays(columns, ["id", "start", "length", "doc_tokens", "offset"]))
        return pa.RecordBatch.from_arrays([pa.array(row_keys(first, len(found))), pa.array(used), pa.array(padded), ids, pieces], names=["sequence_id", "length", "padded", "ids", "pieces"])

    def run(batches):
        packer, number, last = Packer(capacity, slack), 0, np.array([end], np.uint32)
        for batch in batches:
            docs = batch.column(0).to_pylist()
            body, at = tx.buffers(batch.column(1))
            for i, j in tx.slices(at, SLICE):
                ids, ends = encoder(vocabulary).encode(*tx.cut(body, at, i, j))
                for k, doc in enumerate(docs[i:j]):
                    packer.add(doc, np.concatenate([ids[ends[k] : ends[k + 1]], last]))
                while len(packer.closed) >= HELD:
                    yield table(number, packer.closed[:HELD])
                    packer.closed, number = packer.closed[HELD:], number + HELD
        packer.finish()
        for i in range(0, len(packer.closed), HELD):
            yield table(number + i, packer.closed[i : i + HELD])

    return run


def sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, capacity: int = CAPACITY, slack: int = SLACK, end: int = END) -> DataFrame:
    """sequence_id, length, padded (length with padding), ids (little-endian unsigned 32-bit), pieces (id, start, length, doc_tokens, offset in sequence order)."""
    from pyspark.sql.pandas.types import to_arrow_type

    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"sequence_id long, length long, padded long, ids binary, pieces {PIECES.format(kind=kind.simpleString())}"
    return rows.mapInArrow(_pack(vocabulary, capacity, slack, end, to_arrow_type(kind)), schema)


def report(docs: DataFrame) -> DataFrame:
    """One row a piece; its ids are read back from its sequence."""
    own = lambda p: F.crc32(F.substring(F.col("ids"), (4 * p["offset"] + 1).cast("int"), (4 * p["length"]).cast("int")))
    piece = lambda p: F.struct(p["id"].alias("doc_id"), p["start"].alias("start"), p["length"].alias("length"), own(p).alias("ids_crc32"), p["doc_tokens"].alias("doc_tokens"), F.col("sequence_id"), p["offset"].alias("offset"))
    return sequences(docs).select(F.inline(F.transform("pieces", piece)))
