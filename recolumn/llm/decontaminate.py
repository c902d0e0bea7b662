"""Benchmark decontamination by winnowing.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased. Of every six
neighbouring 5-word hashes the smallest is kept (the last one on a tie), for
documents and benchmark items alike. Two texts that share ten words then share a
kept hash inside those ten words, so joining the kept hashes and extending each
hit word by word finds every shared span of at least ten words. Items of one to
nine words are one window each and are looked up whole.

Cost: one pass over the texts. Only hashes that pass a filter of the benchmark's
hashes leave the pass; the filter has at most 2**27 bits however large the
benchmark. The join with the benchmark is a broadcast one only up to
BROADCAST_ROWS fingerprints, else a shuffled one that adaptive execution splits.

Defined cases: null or empty texts have no words and are never hit; a row whose
id and text repeat counts as a row of its own; null benchmark texts and item ids
are left out; a null document id is kept as null; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops as tx
from .cluster import bounded_batches, durable, fresh_name, release, row_keys, without

WINDOW, GRAM = 10, 5
SPREAD = WINDOW - GRAM + 1
BROADCAST_ROWS = 50_000
MAX_FILTER_BITS = 27
_SPAN = T.StructType([T.StructField("s", T.LongType()), T.StructField("e", T.LongType())])


def _winnow(h: np.ndarray, row_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes kept among the 5-word hashes, windows never crossing rows."""
    n = len(row_of)
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = tx.ngrams(h, GRAM)
    m = n - WINDOW + 1
    whole = row_of[:m] == row_of[WINDOW - 1 :]
    least = grams[:m].copy()
    for k in range(1, SPREAD):
        np.minimum(least, grams[k : k + m], out=least)
    keep = np.zeros(len(grams), bool)
    open_ = whole
    for k in range(SPREAD - 1, -1, -1):
        at = open_ & (grams[k : k + m] == least)
        keep[k : k + m] |= at
        open_ = open_ & ~at
    at = np.flatnonzero(keep)
    return at, grams[at]


class _Words:
    """Words of some rows, with their text on demand."""

    def __init__(self, body, at):
        self.body = body
        self.starts, self.ends, self.range = tx.spans(body, at, tx.ALNUM)
        self.hash = tx.hashes(body, self.starts, self.ends)
        self.counts = np.diff(self.range)
        self.row = np.repeat(np.arange(len(self.counts)), self.counts)

    def text(self, i: int, j: int) -> list[str]:
        return [self.body[a:b].tobytes().decode("utf-8", "replace").translate(_FOLD) for a, b in zip(self.starts[i:j], self.ends[i:j], strict=True)]

    def around(self, i: int, n: int) -> tuple[str, list[str], list[str]]:
        """The n words at i, the words before them (nearest first) and after, as far as a window reaches."""
        row = self.row[i]
        low, high = max(self.range[row], i + n - WINDOW), min(self.range[row + 1], i + WINDOW)
        return " ".join(self.text(i, i + n)), self.text(low, i)[::-1], self.text(i + n, high)


_FOLD = {c: c + 32 for c in range(65, 91)}
_HIT = "n int, fp long, pos long, gram string, before array<string>, after array<string>"


def _hit_batch(found: list[tuple], extra: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    text = pa.string()
    columns = [
        pa.array([x[0] for x in found], pa.int32()),
        pa.array([x[1] for x in found], pa.int64()),
        pa.array([x[2] for x in found], pa.int64()),
        pa.array([x[3] for x in found], text),
        pa.array([x[4] for x in found], pa.list_(text)),
        pa.array([x[5] for x in found], pa.list_(text)),
    ]
    return pa.RecordBatch.from_arrays([*extra, *columns], names=[*names, "n", "fp", "pos", "gram", "before", "after"])


def _item_rows(batches):
    for batch in batches:
        body, at = tx.buffers(batch.column(1))
        words = _Words(body, at)
        short = [(int(words.range[r]), int(c)) for r, c in enumerate(words.counts) if 0 < c < WINDOW]
        where, grams = _winnow(words.hash, words.row)
        rows = [(int(i), GRAM, int(f)) for i, f in zip(where, tx.signed(grams), strict=True)]
        rows += [(i, -c, int(tx.signed(tx.ngrams(words.hash[i : i + c], c))[0])) for i, c in short]
        found = [(n, f, i - int(words.range[words.row[i]]), *words.around(i, abs(n))) for i, n, f in rows]
        ids = batch.column(0).take(pa.array(words.row[[i for i, _, _ in rows]] if rows else [], pa.int64()))
        yield _hit_batch(found, [ids], ["item_id"])


def _filter_bits(items: DataFrame, count: int) -> tuple[np.ndarray, int]:
    bits = int(np.clip(np.ceil(np.log2(max(count, 1))) + 4, 16, MAX_FILTER_BITS))
    bit = F.col("fp").bitwiseAND(F.lit((1 << bits) - 1))
    words = items.select(F.shiftright(bit, 5).alias("w"), bit.bitwiseAND(F.lit(31)).alias("b")).groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, int(b))")).alias("v")).toArrow()
    table = np.zeros(1 << (bits - 5), np.uint32)
    table[words.column("w").to_numpy()] = words.column("v").to_numpy().astype(np.uint32)
    return table, bits


def _document_rows(table, bits: int, short: list[int]):
    mask = np.uint64((1 << bits) - 1)

    def passing(h: np.ndarray) -> np.ndarray:
        b = h & mask
        return (table.value[(b >> np.uint64(5)).astype(np.int64)] >> (b & np.uint64(31)).astype(np.uint32)) & np.uint32(1) > 0

    def run(batches):
        number = 0
        for batch in batches:
            ids = batch.column(0)
            body_all, at_all = tx.buffers(batch.column(1))
            keys = row_keys(number, len(ids))
            number += len(ids)
            for i, j in tx.slices(at_all):
                words = _Words(*tx.cut(body_all, at_all, i, j))
                where, grams = _winnow(words.hash, words.row)
                ok = passing(grams)
                rows = [(int(w), GRAM, int(f)) for w, f in zip(where[ok], tx.signed(grams[ok]), strict=True)]
                for n in short:
                    grams = tx.ngrams(words.hash, n)
                    ok = np.flatnonzero(passing(grams) & (words.row[: len(grams)] == words.row[n - 1 :]))
                    rows += [(int(w), -n, int(f)) for w, f in zip(ok, tx.signed(grams[ok]), strict=True)]
                found = [(n, f, w - int(words.range[words.row[w]]), *words.around(w, abs(n))) for w, n, f in rows]
                owner = words.row[[w for w, _, _ in rows]] if rows else np.zeros(0, np.int64)
                # one row for each document, whose n of 0 meets no item, then its hits
                base = [(0, int(k), 0, None, None, None) for k in keys[i:j]]
                take = np.concatenate([np.arange(j - i), owner]) + i
                extra = [ids.take(pa.array(take)), pa.array(keys[take]), pa.array(np.concatenate([words.counts, np.zeros(len(owner), np.int64)]))]
                yield _hit_batch(base + found, extra, ["id", "row", "n_words"])

    return run


def _common(a: str, b: str):
    """How many leading words of two lists agree."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    end = F.array_position(same, False)
    return F.when(end > 0, end - 1).otherwise(F.size(same)).cast("long")


def _join_spans(batches):
    """Sorted spans of each row, those that overlap or touch joined; one pass however many there are."""
    for batch in batches:
        found = batch.column(3)
        counts = pc.list_value_length(found).to_numpy(zero_copy_only=False).astype(np.int64)
        s, e = (x.to_numpy(zero_copy_only=False) for x in found.flatten().flatten())
        owner = np.repeat(np.arange(len(counts)), counts)
        # the farthest end so far in the row: rows are set apart by more than any end
        apart = owner * (int(e.max()) + 1 if len(e) else 1)
        reach = np.maximum.accumulate(e + apart) - apart if len(e) else e
        opens = np.ones(len(s), bool)
        opens[1:] = (owner[1:] != owner[:-1]) | (s[1:] > reach[:-1])
        first = np.flatnonzero(opens)
        last = np.append(first[1:], len(s))[: len(first)] - 1
        at = np.append(0, np.cumsum(np.bincount(owner[first], minlength=len(counts)))).astype(np.int32)
        spans = pa.StructArray.from_arrays([pa.array(s[first], pa.int64()), pa.array(reach[last], pa.int64())], names=["s", "e"])
        spans = pa.ListArray.from_arrays(pa.array(at), spans)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], spans, batch.column(4)], names=["id", "row", "n_words", "spans", "items"])


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document row: id, row, n_words, spans (word ranges that are hit, joined), items (item ids as sorted strings)."""
    spark = bounded_batches(docs.sparkSession)
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text_col).alias("text"))
    items = items.mapInArrow(_item_rows, f"item_id string, {_HIT}").dropDuplicates(["item_id", "n", "fp", "gram", "before", "after"])
    items = durable(items)
    sizes = items.groupBy("n").count().collect()
    count = sum(r["count"] for r in sizes)
    table, bits = _filter_bits(items, count)
    short = sorted(-r["n"] for r in sizes if r["n"] < 0)
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("row", T.LongType()), T.StructField("n_words", T.LongType()), *T._parse_datatype_string(_HIT).fields])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_document_rows(spark.sparkContext.broadcast(table), bits, short), schema)
    other = items.select("item_id", "n", "fp", "gram", F.col("before").alias("b2"), F.col("after").alias("a2"))
    rows = rows.join(F.broadcast(other) if count <= BROADCAST_ROWS else other, ["n", "fp", "gram"], "left")
    left, right = F.when(F.col("n") > 0, _common("before", "b2")).otherwise(F.lit(0)), F.when(F.col("n") > 0, _common("after", "a2")).otherwise(F.lit(0))
    rows = rows.withColumn("s", F.col("pos") - left).withColumn("e", F.col("pos") + F.abs("n") + right)
    hit = F.col("item_id").isNotNull() & ((F.col("n") < 0) | (F.col("e") - F.col("s") >= WINDOW))
    rows = rows.groupBy("id", "row").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.collect_set(F.when(hit, F.struct("s", "e")))).alias("found"),
        F.array_sort(F.collect_set(F.when(hit, F.col("item_id")))).alias("items"),
    )
    out = T.StructType([*rows.schema.fields[:3], T.StructField("spans", T.ArrayType(_SPAN)), rows.schema["items"]])
    return rows.select("id", "row", "n_words", "found", "items").mapInArrow(_join_spans, out)


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **columns) -> DataFrame:
    """The rows without a benchmark window, all columns. Rows whose id is null or repeats are numbered, written and looked at by number; all others go by id."""
    hit = (F.size("items") > 0).alias("hit")
    found = durable(contamination(docs, benchmark, id_col, text_col, **columns).select("id", hit))
    name = fresh_name(docs, "_id")
    ids = found.where("id is not null").groupBy(F.col("id").alias(name)).agg(F.max("hit").alias("hit"), (F.count("*") > 1).alias("again"))
    ids = durable(ids.where("hit or again"))
    few = ids.count() <= BROADCAST_ROWS
    listed = lambda rows: F.broadcast(rows.select(name)) if few else rows.select(name)
    once = docs.where(F.col(id_col).isNotNull()).join(listed(ids), F.col(id_col) == F.col(name), "left_anti")
    again = docs.where(F.col(id_col).isNull()).union(docs.join(listed(ids.where("again")), F.col(id_col) == F.col(name), "left_semi"))
    row = fresh_name(docs, "_row")
    numbered = durable(again.withColumn(row, F.monotonically_increasing_id()))
    release(found)
    if not numbered.take(1):
        return once
    bad = contamination(numbered, benchmark, row, text_col, **columns).where(hit).select("id")
    return once.union(without(numbered, bad, row).select(*[F.col(f"`{c}`") for c in docs.columns]))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest columns of `contamination` for documents and benchmark."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"])
    return contamination(docs, benchmark).select(
        F.col("id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
