"""Quality classifier: a generalised additive model with pairwise interactions.

Features of the text alone (shares of kinds of bytes, word lengths, repetition,
line shapes) are cut into at most BINS bins. Boosting goes round the features;
each step fits a shallow tree (three leaves) to the gradient of one feature
and adds it to that feature's lookup table. Then the pairs of features with the
largest remaining gain get tables of their own, by trees with one cut in each
of the two features. A score is the sigmoid of a sum of table entries.

Fitting uses at most SAMPLE labelled rows (the smallest seeded hashes of the ids, none
held out); features and scores cover every whole text, in one pass.

Defined cases: null and empty texts have all features 0 and get a score like any
other; labels that are null are not learned from; ids that repeat in labels
count as several examples; without both labels the score is the share of label 1, 0.5 if there
is none; rows are scored one by one, so repeats and null ids are kept; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as tx
from .cluster import bounded_batches, durable

SAMPLE, BINS, ROUNDS, PAIRS, PAIR_ROUNDS, PAIR_BINS = 20_000, 32, 60, 8, 30, 8
RATE, MIN_HESSIAN, L2 = 0.3, 0.5, 1.0

FEATURES = (
    "log_bytes", "log_words", "mean_word", "word_spread", "lower", "upper", "digit", "space", "sentence_marks",
    "symbols", "brackets", "non_ascii", "bars", "distinct_words", "repeated_next", "top_word", "symbol_words",
    "upper_words", "log_lines", "short_lines", "digit_words", "long_words",
)

_KIND = np.full(256, 5, np.int64)  # other symbols
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 0, 1, 2, 7
_KIND[[9, 10, 11, 12, 13, 32]] = 3
_KIND[[ord(c) for c in ".,;:?'-\""]] = 4
_KIND[[ord(c) for c in "()[]{}<>/\\=_"]] = 6
_KIND[ord("|")] = 8
_KINDS = 9


def features(body: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text."""
    rows = len(at) - 1
    lengths = np.diff(at)
    kind = _KIND[body]
    counts = np.bincount(kind + np.repeat(np.arange(rows) * _KINDS, lengths), minlength=rows * _KINDS).reshape(rows, _KINDS)
    starts, ends, words = tx.spans(body, at, tx.SPACED)
    n = np.diff(words)
    row = np.repeat(np.arange(rows), n)
    size = ends - starts
    per_row = lambda x: np.bincount(row, x, minlength=rows)
    h = tx.hashes(body, starts, ends)
    last, first = kind[ends - 1] if len(ends) else size, kind[starts] if len(starts) else size
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    order = np.lexsort((h, row))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
    head = np.flatnonzero(new)
    times = np.diff(np.append(head, len(h)))
    top = np.zeros(rows)
    np.maximum.at(top, row[order][head], times)
    line = (body == 10).astype(np.int64)
    lines = np.add.reduceat(np.append(line, 0), at[:-1]) * (lengths > 0) + 1 if rows else np.zeros(0)
    some, total = np.maximum(n, 1), np.maximum(lengths, 1)
    share = counts / total[:, None]
    out = np.column_stack([
        np.log1p(lengths), np.log1p(n), per_row(size) / some, np.sqrt(np.maximum(per_row(size**2) / some - (per_row(size) / some) ** 2, 0)),
        share[:, 0], share[:, 1], share[:, 2], share[:, 3], share[:, 4], share[:, 5], share[:, 6], share[:, 7], share[:, 8],
        per_row(np.ones(len(h))) * 0 + np.bincount(row[order][head], minlength=rows) / some, per_row(again) / some, top / some,
        per_row((last == 5) | (last == 8)) / some, per_row((first == 1) & (last != 0) & (size > 1)) / some, np.log(lines),
        lines / some, per_row(first == 2) / some, per_row(size > 20) / some,
    ])
    out[lengths == 0] = 0
    return out.astype(np.float32)


def _feature_rows(batches):
    for batch in batches:
        body_all, at_all = tx.buffers(batch.column(1))
        parts = [features(*tx.cut(body_all, at_all, i, j)) for i, j in tx.slices(at_all)]
        flat = np.concatenate(parts).ravel() if parts else np.zeros(0, np.float32)
        column = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(FEATURES)), pa.array(flat))
        yield pa.RecordBatch.from_arrays([batch.column(0), column], names=["id", "x"])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _leaf(g, h):
    return g / (h + L2)


def _gain(g, h):
    return g * g / (h + L2)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values over the bins of one feature: two cuts, each the best at its turn."""
    parts, values = [(0, len(g))], np.zeros(len(g))
    for _ in range(2):
        best = (1e-9, None)
        for k, (a, b) in enumerate(parts):
            if b - a < 2:
                continue
            lg, lh = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            tg, th = g[a:b].sum(), h[a:b].sum()
            gain = np.where((lh >= MIN_HESSIAN) & (th - lh >= MIN_HESSIAN), _gain(lg, lh) + _gain(tg - lg, th - lh) - _gain(tg, th), 0)
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (gain[at], (k, a + at + 1))
        if best[1] is None:
            break
        k, at = best[1]
        a, b = parts.pop(k)
        parts += [(a, at), (at, b)]
    if len(parts) > 1:
        for a, b in parts:
            values[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return values


def _quadrants(g: np.ndarray, h: np.ndarray):
    """The best cut of each feature of a pair at once: gain and leaf values over the grid."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    total_g, total_h = cg[-1, -1], ch[-1, -1]
    cells = []
    for c, t in ((cg, total_g), (ch, total_h)):
        a, rows, cols = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1]
        cells.append([a, rows - a, cols - a, t - rows - cols + a])
    ok = np.minimum.reduce(cells[1]) >= 1.0
    gain = np.where(ok, sum(_gain(x, y) for x, y in zip(*cells, strict=True)) - _gain(total_g, total_h), 0)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    values = np.zeros(g.shape)
    if gain[i, j] > 1e-9:
        corner = [_leaf(x[i, j], y[i, j]) for x, y in zip(*cells, strict=True)]
        values[: i + 1, : j + 1], values[: i + 1, j + 1 :], values[i + 1 :, : j + 1], values[i + 1 :, j + 1 :] = corner
    return gain[i, j], values


class Gam:
    """Lookup tables of the features and of pairs of them."""

    def __init__(self):
        self.base, self.edges, self.tables, self.pairs = 0.0, [], [], []

    def _bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)]

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if self.tables:
            bins = self._bins(x)
            for b, table in zip(bins, self.tables, strict=True):
                out += table[b]
            for i, j, ci, cj, table in self.pairs:
                out += table[ci[bins[i]], cj[bins[j]]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.raw(x))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Gam:
        share = y.mean() if len(y) else 0.0
        if not 0 < share < 1:
            self.base = float(np.log((share * len(y) + 0.5) / ((1 - share) * len(y) + 0.5))) if len(y) else 0.0
            return self
        self.base = float(np.log(share / (1 - share)))
        self.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
        bins = self._bins(x)
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        f = np.full(len(x), self.base)
        for _ in range(ROUNDS):
            for k, b in enumerate(bins):
                p = _sigmoid(f)
                m = len(self.tables[k])
                step = RATE * _tree(np.bincount(b, y - p, minlength=m), np.bincount(b, p * (1 - p), minlength=m))
                self.tables[k] += step
                f += step[b]
        coarse = [np.minimum(np.arange(len(t)) * PAIR_BINS // len(t), PAIR_BINS - 1) for t in self.tables]
        small = [c[b] for c, b in zip(coarse, bins, strict=True)]

        def grid(i, j, p):
            cell, m = small[i] * PAIR_BINS + small[j], PAIR_BINS * PAIR_BINS
            return _quadrants(np.bincount(cell, y - p, minlength=m).reshape(PAIR_BINS, -1), np.bincount(cell, p * (1 - p), minlength=m).reshape(PAIR_BINS, -1))

        p = _sigmoid(f)
        gains = sorted(((grid(i, j, p)[0], i, j) for i in range(len(bins)) for j in range(i + 1, len(bins))), reverse=True)
        self.pairs = [(i, j, coarse[i], coarse[j], np.zeros((PAIR_BINS, PAIR_BINS))) for gain, i, j in gains[:PAIRS] if gain > 0]
        for _ in range(PAIR_ROUNDS):
            for i, j, _, _, table in self.pairs:
                step = RATE * grid(i, j, _sigmoid(f))[1]
                table += step
                f += step[small[i], small[j]]
        return self


def held_out(id_col: str = "doc_id", parts: int = 3):
    return F.crc32(F.col(id_col).cast("string")) % parts == 1


def sample_labels(labels: DataFrame, label: str, size: int = SAMPLE, id_col: str = "doc_id") -> DataFrame:
    """At most `size` labelled ids that are not held out, by seeded hash."""
    rows = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    return rows.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).orderBy(F.xxhash64(F.lit(11), "id"), "y").limit(size)


def _score_rows(model):
    def run(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.score(x))], names=["id", "score"])

    return run


def _learned(seen) -> Gam:
    """The model of (id, x, y) rows: SAMPLE at most."""
    x = seen.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES)) if seen.num_rows else np.zeros((0, len(FEATURES)))
    return Gam().fit(x, seen.column("y").to_numpy().astype(float))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of every document row."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = durable(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_feature_rows, f"id {kind}, x array<float>"))
    seen = rows.join(F.broadcast(sample_labels(labels, "quality")), "id").select("id", "x", "y").orderBy("id", "y").limit(SAMPLE).toArrow()
    return rows.mapInArrow(_score_rows(docs.sparkSession.sparkContext.broadcast(_learned(seen))), f"id {kind}, score double")


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose text scores at least the threshold; texts are scored where they are read."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample_labels(labels, "quality")), "id")
    rows = rows.select(F.struct("id", "y").alias("id"), "text").mapInArrow(_feature_rows, f"id struct<id:{kind},y:int>, x array<float>")
    seen = rows.select("id.id", "x", "id.y").orderBy("id", "y").limit(SAMPLE).toArrow()
    model = docs.sparkSession.sparkContext.broadcast(_learned(seen))
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            body, where = tx.buffers(batch.column(at))
            parts = [model.value.score(features(*tx.cut(body, where, i, j))) for i, j in tx.slices(where)]
            if parts:
                yield batch.filter(pa.array(np.concatenate(parts) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scores = quality_scores(docs, labels).withColumnRenamed("id", "doc_id")
    return scores.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
