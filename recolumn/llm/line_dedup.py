"""Substring dedup by line hashing.

A unit is a line, cut further after each of `. , ; : ! ?` that blanks follow, so
that passages which begin or end inside a line are seen as well. Units tile the
text: each one keeps the blanks or the line feed behind it. A unit is normalised (A-Z lower-cased, runs of
`[\\x20\\x09-\\x0D]` to one space, none at the ends) and digested with 128 bits. Of all units
with one digest the earliest is the first, ranked by document id and then by offset. Consecutive
repeated units of a document are joined into runs, and a run of at least PASSAGE
words is removed; shorter runs stay, so lines and phrases that any text may
hold are kept. Units without words have no digest and do not break a run.

One pass over the texts writes digests and places. Digests are counted with partial
aggregates, so a unit that a third of all documents hold arrives as one row a task;
only digests that occur twice go back to the places, most of which a bit table of these
digests keeps out of the join. Texts are shuffled only if many of them lose something.

Defined cases: null texts stay null and have no units; empty texts stay empty; rows
are numbered once, so rows that repeat an id are documents of their own, ranked by that number, and
a null id is ranked last; ids may have any type that can be ordered; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as tx
from .cluster import bit_table, bounded_batches, durable, release

PASSAGE = 40
BROADCAST_ROWS, MAX_BITS = 300_000, 26
_MARK, _BLANK = np.zeros(256, bool), np.zeros(256, bool)
_MARK[list(b".,;:!?")] = True
_BLANK[list(b" \t")] = True
_UNITS = "k int, s bigint, e bigint, words int, h1 bigint, h2 bigint"
_SPANS = "array<struct<s:bigint,e:bigint>>"


def bounds(body: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Starts of all units of the rows, and the end of the last."""
    if not len(body):
        return np.zeros(1, np.int64)
    heads = at[:-1][np.diff(at) > 0]
    head = np.zeros(len(body), bool)
    head[heads] = True
    blank = _BLANK[body]
    opens = blank.copy()
    opens[1:] &= ~blank[:-1] | head[1:]
    marked = opens.copy()
    marked[0] = False
    marked[1:] &= _MARK[body[:-1]] & ~head[1:]
    # the run of blanks that a blank belongs to
    run = np.maximum.accumulate(np.where(opens, np.arange(len(body)), 0))
    closes = blank & marked[run]
    closes[:-1] &= ~blank[1:] | head[1:]
    ends = np.flatnonzero(closes | (body == 10)) + 1
    return np.unique(np.concatenate([heads, ends, [len(body)]]))


def units(body: np.ndarray, at: np.ndarray):
    """Row, number, start and end (bytes in the row), words and two digests of each unit that has words."""
    edges = bounds(body, at)
    starts, ends = edges[:-1], edges[1:]
    first, last, _ = tx.spans(body, at, tx.SPACED)
    low, high = np.searchsorted(first, starts), np.searchsorted(first, ends)
    ok = high > low
    starts, ends, low, high = starts[ok], ends[ok], low[ok], high[ok]
    row = np.searchsorted(at, starts, side="right") - 1
    number = np.arange(len(row)) - np.searchsorted(row, row)
    keys, h = [], tx.hashes(body, first, last)
    up, down = tx._powers(len(h))
    for seed in (0, 0xA0761D6478BD642F):
        values = tx.mix(h + np.uint64(seed)) if seed else h
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(h)])])
        keys.append(tx.mix((sums[high] - sums[low]) * down[low] + (high - low).astype(np.uint64)))
    return row, number, starts - at[row], ends - at[row], high - low, *keys


def _places(batches):
    for batch in batches:
        body_all, at_all = tx.buffers(batch.column(2))
        for i, j in tx.slices(at_all):
            row, k, s, e, words, a, b = units(*tx.cut(body_all, at_all, i, j))
            own = pa.array(row + i)
            cols = [pa.array(k.astype(np.int32)), pa.array(s), pa.array(e), pa.array(words.astype(np.int32)), pa.array(tx.signed(a)), pa.array(tx.signed(b))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), *cols], names=["id", "row", *[c.split()[0] for c in _UNITS.split(", ")]])


def passages(k: np.ndarray, s: np.ndarray, e: np.ndarray, words: np.ndarray, least: int):
    """Runs of consecutive units with at least `least` words: start, end and number of units."""
    new = np.flatnonzero(np.append(True, np.diff(k) != 1)) if len(k) else np.zeros(0, np.int64)
    last = np.append(new[1:], len(k)) - 1
    long_ = np.add.reduceat(words, new) >= least if len(k) else np.zeros(0, bool)
    return s[new[long_]], e[last[long_]], (last - new + 1)[long_]


def _may_repeat(table, bits: int):
    """Places whose digest has its bit in the table."""

    def run(batches):
        for batch in batches:
            bit = batch.column(batch.schema.get_field_index("h1")).to_numpy() & ((1 << bits) - 1)
            yield batch.filter(pa.array((table.value[bit >> 5] >> (bit & 31).astype(np.uint32)) & 1 > 0))

    return run


def _runs(least: int):
    """Spans of the removed runs of each row that has any, and their units."""

    def run(batches):
        for batch in batches:
            rows, spans, counts = [], [], []
            for row, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                starts, ends, n = passages(*(np.array([u[c] for u in found], np.int64) for c in ("k", "s", "e", "words")), least)
                if len(n):
                    rows.append(row)
                    spans.append([{"s": s, "e": e} for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])
                    counts.append(int(n.sum()))
            kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(spans, kind), pa.array(counts, pa.int64())], names=["row", "spans", "n_removed"])

    return run


def repeated_passages(rows: DataFrame, passage: int = PASSAGE) -> DataFrame:
    """(row, spans, n_removed): what is removed from each numbered row (id, row, text) that loses something."""
    kind = rows.schema["id"].dataType.simpleString()
    columns = f"id {kind}, row bigint, {_UNITS}"
    places = durable(rows.select("id", "row", "text").mapInArrow(_places, columns))
    rank = F.struct(F.col("id").isNull().alias("last"), "id", "row", "k")
    firsts = places.groupBy("h1", "h2").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = durable(firsts.select("h1", "h2", F.col("first.row").alias("first_row"), F.col("first.k").alias("first_k")))
    # most digests occur once: a bit table keeps their places out of the join
    table, bits = bit_table(firsts, "h1", MAX_BITS)
    found = places.mapInArrow(_may_repeat(rows.sparkSession.sparkContext.broadcast(table), bits), columns).join(firsts, ["h1", "h2"])
    found = found.where("row <> first_row or k <> first_k").select("row", F.struct("k", "s", "e", "words").alias("u"))
    found = found.groupBy("row").agg(F.array_sort(F.collect_list("u")).alias("units"))
    spans = durable(found.mapInArrow(_runs(passage), f"row bigint, spans {_SPANS}, n_removed bigint"))
    release(places, firsts)
    return spans


def _cut(batches):
    for batch in batches:
        texts, out, removed = batch.column(1), [], []
        for k, spans in enumerate(batch.column(2).to_pylist()):
            if not spans:
                out.append(texts[k].as_py())
                removed.append(0)
                continue
            data, kept, at, chars = texts[k].as_buffer().to_pybytes(), [], 0, 0
            for c in spans:
                kept.append(data[at : c["s"]])
                chars += len(data[c["s"] : c["e"]].decode())
                at = c["e"]
            out.append((b"".join(kept) + data[at:]).decode())
            removed.append(chars)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), batch.column(3), pa.array(removed, pa.int64()), batch.column(2)], names=["id", "text", "n_removed", "removed_chars", "spans"])


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage: int = PASSAGE) -> DataFrame:
    """id, text (what stays), n_removed (units), removed_chars, spans (byte ranges of the original text) of every row."""
    bounded_batches(docs.sparkSession)
    rows = durable(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row")))
    kind = rows.schema["id"].dataType.simpleString()
    spans = repeated_passages(rows, passage)
    rows = rows.join(F.broadcast(spans) if spans.count() <= BROADCAST_ROWS else spans, "row", "left")
    rows = rows.select("id", "text", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"), F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"))
    return rows.mapInArrow(_cut, f"id {kind}, text string, n_removed long, removed_chars long, spans {_SPANS}")


def report(docs: DataFrame) -> DataFrame:
    return clean(docs).select(
        F.col("id").alias("doc_id"), "n_removed", "removed_chars",
        F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["s"], s["e"])), ",").alias("removed_bytes"),
        F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"),
    )
