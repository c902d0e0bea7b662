"""Toxicity: a subsequence string-kernel SVM with Nystrom landmarks.

The kernel counts subsequences of three letters that two segments share, each
weighted DECAY ** span, with spans of at most SPAN characters, so letters that are
inserted, left out or spread apart lower the value only gradually; it is
normalised to 1 for equal segments. A segment is a word, or a run of at least three
single characters with white space between. Digits used as letters are read as letters.

Landmarks are segments and pieces of segments whose letters, by the kernel, are held by far more toxic than other training
documents, in one segment or in at least two, so insults with varying endings count together; a few segments that are somewhat
alike and the commonest ones stand beside them. A training sentence is represented by its worst segment's kernel
values with the landmarks, times the inverse root of the landmark kernel; a linear
SVM learns from these: from toxic documents' worst sentences that hold such a string, from the worst of all other documents, and from
the strings with characters inserted. Which sentences are worst is what the SVM itself finds, anew each round. The solution is a
weighted sum over landmarks, so for scoring it is folded into one table over letter
triples: the SVM value of a segment is a sum of table entries over its own
norm, computed for the distinct segments of a slice at once and exactly. A document's score is
the calibrated best of its three largest segment values, the second and third raised by an offset: several weak insults
count like a strong one. Offsets and calibration are fitted on values by models that did not learn from the document.

Fitting uses at most SAMPLE labelled rows, none held out; every whole text is scored.

Defined cases: null and empty texts have no segments and get the lowest score that
calibration gives; null labels are not learned from; without both labels the score is 0;
repeated rows and null ids are scored as they stand; other columns are ignored.
"""

from __future__ import annotations

from functools import cached_property
from itertools import product
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as tx
from .cluster import bounded_batches
from .quality import _sigmoid, held_out, sample_labels

SAMPLE, LANDMARKS, SPAN, DECAY = 5_000, 128, 6, 0.7
HARDEST, ROUNDS, SURE = 4, 3, 6.0  # sentences of a document that are learned from; rounds; standard errors
SEEDS, PICKED, HELD, ALIKE, LESS = 192, 48, 0.85, 0.95, 0.7  # strings tried, and taken; share of subsequences to hold one; kernel of alike ones; weight of documents that hold a string
PIECE, LEAST_TOXIC = (5, 6, 7), 4  # characters of a piece; toxic documents that hold it at least
LARGEST, FOLDS, POSITIVE = 3, 5, 3.0  # values of a document that its score reads; folds of the calibration; weight of a positive
GRID, PRICE = np.round(np.arange(-1.5, 1.6, 0.1), 1), 3.0  # offsets of lower values; toxic documents that a false alarm is worth
CLASSES = 32
SLICE = 2 << 20  # larger slices hold each distinct segment once
COMMONEST = 20_000  # segments among which those alike to a landmark are looked for
WORDS, PART, SCORED, KEPT = 256, 512, 8192, 1 << 19  # words or segments that are computed at once; values that a task keeps
#: Gaps (to the second and to the third letter) and weights of all triples within SPAN.
TRIPLES = [(i, j, DECAY ** (j + 1)) for j in range(2, SPAN) for i in range(1, j)]

_CODE = np.zeros(256, np.int64)
_CODE[97:123] = _CODE[65:91] = np.arange(1, 27)
for _digit, _letter in zip("013457", "oieast", strict=True):
    _CODE[ord(_digit)] = ord(_letter) - 96
_CODE[128:] = 27 + np.arange(128) % 5
FLOOR = -1e9


def segments(body: np.ndarray, at: np.ndarray):
    """Starts, ends and row of each segment: words, and runs of spaced single characters."""
    starts, ends, words = tx.spans(body, at, tx.SPACED)
    row = np.repeat(np.arange(len(at) - 1), np.diff(words))
    single = ends - starts == 1
    joined = np.zeros(len(starts) + 1, bool)
    joined[1:-1] = single[1:] & single[:-1] & (row[1:] == row[:-1])
    edge = np.flatnonzero(joined[1:] & ~joined[:-1]), np.flatnonzero(joined[:-1] & ~joined[1:])
    first, last = edge[0], edge[1] - 1
    long_ = last - first >= 2
    first, last = first[long_], last[long_]
    return np.append(starts, starts[first]), np.append(ends, ends[last]), np.append(row, row[first])


def _gather(body, starts, ends):
    """Letter codes of the segments joined, with SPAN zeros behind each; and the place of each segment."""
    size = ends - starts
    at = np.cumsum(size + SPAN) - size - SPAN
    out = np.zeros(int((size + SPAN).sum()) + SPAN, np.int64)
    out[np.repeat(at, size) + tx.ranges(size)] = _CODE[body[np.repeat(starts, size) + tx.ranges(size)]]
    return out, at


def _triples(codes: np.ndarray):
    """Each triple's number and weight at every position; number 0 where a place holds no letter."""
    n = len(codes) - SPAN
    for i, j, weight in TRIPLES:
        a, b, c = codes[:n], codes[i : i + n], codes[j : j + n]
        yield np.where((a > 0) & (b > 0) & (c > 0), (a * CLASSES + b) * CLASSES + c, 0), weight


def kernel_maps(body, starts, ends):
    """Segment number, triple number and weight of all triples, summed, and the norm of each segment."""
    codes, at = _gather(body, starts, ends)
    owner = np.searchsorted(at, np.arange(len(codes) - SPAN), side="right") - 1
    keys, weights = [], []
    for number, weight in _triples(codes):
        on = np.flatnonzero(number)
        keys.append(owner[on] * CLASSES**3 + number[on])
        weights.append(np.full(len(on), weight))
    keys, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    value = np.bincount(inverse, np.concatenate(weights), minlength=len(keys))
    segment, triple = keys // CLASSES**3, keys % CLASSES**3
    norm = np.sqrt(np.bincount(segment, value**2, minlength=len(starts)))
    return segment, triple, value, np.where(norm > 0, norm, np.inf)


def _joined(words):
    data = [w.encode() for w in words]
    ends = np.cumsum([len(d) for d in data])
    return np.frombuffer(b"".join(data), np.uint8), ends - np.array([len(d) for d in data], np.int64), ends


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernel values, words by landmarks, some hundred words at once."""
    dense = np.zeros((CLASSES**3, len(landmarks)), np.float32)
    segment, triple, value, norm = kernel_maps(*_joined(landmarks))
    dense[triple, segment] = value / norm[segment]
    out = np.zeros((len(words), len(landmarks)), np.float32)
    for i in range(0, len(words), WORDS):
        segment, triple, value, norm = kernel_maps(*_joined(words[i : i + WORDS]))
        own, first = np.unique(segment, return_index=True)
        if len(own):
            out[i + own] = np.add.reduceat(dense[triple] * value[:, None].astype(np.float32), first, axis=0) / norm[own, None]
    return out


class Sample:
    """Labelled documents as arrays: each segment's number, and where sentences and documents begin."""

    def __init__(self, y, keys, sentences: pa.Array):
        """y, a key that near copies share, and lists of sentences of distinct segments; sentences without any are left out."""
        self.y = np.asarray(y, np.int64)
        segments = sentences.flatten()
        coded = segments.flatten().dictionary_encode()
        self.names, self.seg = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        size = segments.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        owner = np.repeat(np.arange(len(self.y)), sentences.value_lengths().to_numpy(zero_copy_only=False))
        self.doc = owner[size > 0]  # of each sentence
        size = size[size > 0]
        self.first = np.cumsum(size) - size
        self.sentence = np.repeat(np.arange(len(size)), size)
        # near copies of a document mostly agree in their key and count once
        _, group = np.unique(np.column_stack([self.y, np.asarray(keys, np.int64)]), axis=0, return_inverse=True)
        group = group.ravel()
        label = np.zeros(group.max(initial=-1) + 1, np.int64)
        label[group] = self.y
        self.totals_by_group = label
        self.group = group
        self.once = once = np.unique(group[self.doc[self.sentence]] * max(len(self.names), 1) + self.seg)
        group_of, seg = once // max(len(self.names), 1), once % max(len(self.names), 1)
        self.counts = np.bincount(label[group_of] * len(self.names) + seg, minlength=2 * len(self.names)).reshape(2, -1).astype(float)
        self.totals = np.bincount(label, minlength=2).astype(float)

    @cached_property
    def proper(self) -> np.ndarray:
        return np.array([sum(c.isalpha() for c in w) >= 3 for w in self.names], bool)

    @cached_property
    def maps(self):
        """Triples and weights of all names, name by name, where each name's begin, and the norms; computed SCORED names at a time."""
        first, triples, weights, norms = [np.zeros(1, np.int64)], [], [], []
        for i in range(0, len(self.names), SCORED):
            part = self.names[i : i + SCORED]
            segment, triple, value, norm = kernel_maps(*_joined(part))
            first.append(first[-1][-1] + np.cumsum(np.bincount(segment, minlength=len(part))))
            triples.append(triple.astype(np.int32))
            weights.append(value.astype(np.float32))
            norms.append(norm)
        return np.concatenate(first), np.concatenate(triples or [np.zeros(0, np.int32)]), np.concatenate(weights or [np.zeros(0, np.float32)]), np.concatenate(norms or [np.zeros(0)])

    @property
    def norm(self) -> np.ndarray:
        return self.maps[3]

    def products(self, dense: np.ndarray, scale: np.ndarray, names: np.ndarray | None = None) -> np.ndarray:
        """Products of all or some names with the columns of a table over triples, each divided by its `scale`."""
        first, triple, weight, _ = self.maps
        names = np.arange(len(self.names)) if names is None else names
        out = np.zeros((len(names), dense.shape[1]), np.float32)
        dense = (dense / scale.astype(np.float32)).astype(np.float32)
        for i in range(0, len(names), PART):
            k = names[i : i + PART]
            n = first[k + 1] - first[k]
            at, some = np.repeat(first[k], n) + tx.ranges(n), np.flatnonzero(n)
            if len(some):
                out[i + some] = np.add.reduceat(dense[triple[at]] * weight[at, None], (np.cumsum(n) - n)[some], axis=0)
        return out

    def holding(self, dense: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(name, column) where a name holds nearly all of a column's subsequences, whatever else it holds."""
        first, triple, weight, _ = self.maps
        owners, columns = [], []
        dense = (dense / norm**2).astype(np.float32)
        for i in range(0, len(self.names), PART):
            at = first[i : i + PART + 1]
            some = np.flatnonzero(np.diff(at))
            if len(some):
                part = np.add.reduceat(dense[triple[at[0] : at[-1]]] * weight[at[0] : at[-1], None], at[some] - at[0], axis=0)
                k, c = np.nonzero(part >= HELD)
                owners.append(i + some[k])
                columns.append(c)
        return np.concatenate(owners or [np.zeros(0, np.int64)]), np.concatenate(columns or [np.zeros(0, np.int64)])

    @cached_property
    def pieces(self):
        return _pieces_of(self)

    @cached_property
    def piece_presence(self):
        names, pairs = self.pieces
        return _presence(self, pairs[:, 0], pairs[:, 1], max(len(names), 1))

    def worst(self, single: np.ndarray):
        """Highest value of each sentence and the number of the segment that has it, the larger of equal ones."""
        if not len(self.first):
            return np.zeros(0), np.zeros(0, np.int64)
        most = np.maximum.reduceat(single[self.seg], self.first)
        return most, np.maximum.reduceat(np.where(single[self.seg] == most[self.sentence], self.seg, -1), self.first)


def _table_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Triple weights of each word as columns of a dense table, and their norms."""
    dense = np.zeros((CLASSES**3, len(words)), np.float32)
    segment, triple, value, norm = kernel_maps(*_joined(words))
    dense[triple, segment] = value
    return dense, norm


def _pieces_of(docs: Sample):
    """Distinct pieces of 5 to 7 characters of the segments of at least LEAST_TOXIC toxic documents, and (segment, piece) pairs."""
    size = max(len(docs.names), 1)
    toxic = np.unique(docs.once[docs.totals_by_group[docs.once // size] == 1] % size)
    cut = lambda w: {w[i : i + n] for n in PIECE for i in range(len(w) - n + 1)} if w.isalpha() else set()
    seen: dict[str, int] = {}
    for k in toxic.tolist():
        for piece in cut(docs.names[k]):
            seen[piece] = seen.get(piece, 0) + int(docs.counts[1, k])
    kept = {piece: n for n, piece in enumerate(sorted(x for x, n in seen.items() if n >= LEAST_TOXIC))}
    pairs = [(k, kept[x]) for k, w in enumerate(docs.names) for x in cut(w) if x in kept]
    return list(kept), np.array(pairs, np.int64).reshape(-1, 2)


def _presence(docs: Sample, owner: np.ndarray, column: np.ndarray, columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, column, distinct segments) of (segment, column) pairs, where documents hold any."""
    size = max(len(docs.names), 1)
    order = np.argsort(docs.once % size, kind="stable")
    group, seg = docs.once[order] // size, docs.once[order] % size
    first, last = np.searchsorted(seg, owner), np.searchsorted(seg, owner, side="right")
    rows = np.repeat(first, last - first) + tx.ranges(last - first)
    key, n = np.unique(group[rows] * columns + np.repeat(column, last - first), return_counts=True)
    return key // columns, key % columns, n


def _errors(toxic: np.ndarray, clean: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Standard errors, were there no difference, between the shares of toxic and of clean documents."""
    n1, n0 = totals[1] + 1, totals[0] + 1
    both = (toxic + clean + 1) / (n1 + n0)
    return ((toxic + 0.5) / n1 - (clean + 0.5) / n0) / np.sqrt(both * (1 - both) * (1 / n1 + 1 / n0))


def _spread(toxic: np.ndarray, clean: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Standard errors between the shares as they are: larger for strings that many toxic documents hold."""
    r1, r0 = (toxic + 0.5) / (totals[1] + 1), (clean + 0.5) / (totals[0] + 1)
    return (r1 - r0) / np.sqrt(r1 / totals[1] + r0 / totals[0])


def _over_represented(docs: Sample, use: np.ndarray, z: np.ndarray) -> list[str]:
    """Strings, at most PICKED, whose letters in order (by the kernel) are held by far more toxic documents, in one segment or in at least two.

    Candidates are segments, and pieces of segments that vary in their endings. One after another is taken, with less weight on the
    toxic documents that the ones before occur in, so a rare language's insults are found beside those of a common one.
    """
    label, totals = docs.totals_by_group, np.array([((docs.totals_by_group == c) & use).sum() for c in (0, 1)], float)
    words = [docs.names[k] for k in np.argsort(-z, kind="stable")[: SEEDS // 3] if z[k] > SURE]
    pieces, _ = docs.pieces
    if len(pieces):
        group, column, n = docs.piece_presence
        by = {(least, c): np.bincount(column[use[group] & (n >= least) & (label[group] == c)], minlength=len(pieces)) for least in (1, 2) for c in (0, 1)}
        best = np.max([np.where(by[least, 1] >= LEAST_TOXIC, _errors(by[least, 1], by[least, 0], totals), -np.inf) for least in (1, 2)], axis=0)
        some = np.argsort(-best, kind="stable")[: 16 * SEEDS]
        some = some[best[some] > SURE]
        place = np.full(len(pieces), -1)
        place[some] = np.arange(len(some))
        toxic = np.flatnonzero((label == 1) & use)
        on = np.isin(group, toxic) & (place[column] >= 0)
        hits = np.zeros((len(toxic), len(some)), np.int16)
        hits[np.searchsorted(toxic, group[on]), place[column[on]]] = n[on]
        enough = np.concatenate([hits >= 1, hits >= 2], axis=1)
        words += [pieces[some[k]] for k in _cover(enough.astype(float), np.concatenate([by[1, 0][some], by[2, 0][some]]), totals, SEEDS - len(words), 0.8)]
    words = list(dict.fromkeys(words))
    if not words:
        return []
    dense, norm = _table_of(words)
    owner, column = docs.holding(dense, norm)
    group, column, n = _presence(docs, owner, column, len(words))
    hits = np.zeros((len(label), len(words)), np.int16)
    hits[group, column] = n
    enough = np.concatenate([hits >= 1, hits >= 2], axis=1)
    toxic, clean = enough[(label == 1) & use].astype(float), enough[(label == 0) & use].sum(0)
    like = kernel(words, words)
    return [words[k] for k in _cover(toxic, clean, totals, PICKED, LESS, lambda k: like[k] < ALIKE)]


def _cover(toxic: np.ndarray, clean: np.ndarray, totals: np.ndarray, most: int, less: float, apart=None) -> list[int]:
    """Columns taken one after another by standard errors, with toxic documents weighted by `less` for each column that they have; a column counts once or twice held."""
    n = toxic.shape[1] // 2
    weight, found, open_ = np.ones(len(toxic)), [], np.ones(n, bool)
    while len(found) < most and open_.any():
        held = weight @ toxic
        sure = np.where(_errors(held, clean, totals) > SURE, _spread(held, clean, totals), -np.inf)
        sure = np.where(open_, np.maximum(sure[:n], sure[n:]), -np.inf)
        best = int(sure.argmax())
        if np.isneginf(sure[best]):
            break
        found.append(best)
        if apart is not None:
            open_ &= apart(best)
        open_[best] = False
        weight *= np.where(toxic[:, best] > 0, less, 1.0)
    return found


class SubsequenceSvm:
    """Table over letter triples, bias, and the calibration of a document's LARGEST largest values."""

    def __init__(self):
        self.table, self.bias, self.landmarks = None, 0.0, []
        self.knots, self.shares = np.zeros(1), np.zeros(1)
        self.offsets = np.zeros(LARGEST)
        self.known, self.values = np.zeros(0, np.uint64), np.zeros(0)

    def fit(self, docs: Sample) -> SubsequenceSvm:
        """Learns from all documents; the calibration only sees values by models that did not learn from the document."""
        if len(set(docs.y.tolist())) < 2:
            return self
        self.learn(docs, np.ones(len(docs.totals_by_group), bool))
        if self.table is None:
            return self
        values, known = np.zeros((len(docs.y), LARGEST)), np.zeros(len(docs.y), bool)
        fold = np.arange(len(docs.totals_by_group)) % FOLDS  # copies stay in one fold
        for k in range(FOLDS):
            if len(set(docs.totals_by_group[fold != k].tolist())) < 2:
                continue
            other, out = SubsequenceSvm().learn(docs, fold != k), fold[docs.group] == k
            if other.table is not None:
                values[out], known[out] = other.sample_values(docs)[out], True
        if len(set(docs.y[known].tolist())) == 2:
            self.calibrate(values[known], docs.y[known])
        else:
            self.calibrate(self.sample_values(docs), docs.y)
        return self

    def learn(self, docs: Sample, use: np.ndarray) -> SubsequenceSvm:
        """Landmarks and SVM from the groups of copies in `use`."""
        names = docs.names
        size, label = max(len(names), 1), docs.totals_by_group
        own = docs.once[use[docs.once // size]]
        counts = np.bincount(label[own // size] * size + own % size, minlength=2 * size).reshape(2, -1).astype(float)
        z = _errors(counts[1], counts[0], np.array([((label == c) & use).sum() for c in (0, 1)], float))
        z[~docs.proper | (counts[1] < 2)] = -np.inf
        top = _over_represented(docs, use, z)
        if not top:
            return self
        # beside them, the commonest segments that are somewhat alike, and the commonest of all
        every = counts.sum(0)
        plain = docs.proper & (z < 2) & (every > 0)
        often = np.argsort(-np.where(plain, every, -1), kind="stable")[:COMMONEST]
        alike = docs.products(*_table_of(top), often) / docs.norm[often, None]
        near = [int(often[k]) for j in range(len(top)) for k in [np.where((alike[:, j] > 0.3) & (alike[:, j] < 0.8), every[often], -1).argmax()]]
        common = near + np.argsort(-np.where(plain, every, -1), kind="stable")[:LANDMARKS].tolist()
        common = [names[k] for k in dict.fromkeys(common) if plain[k]][: LANDMARKS - len(top)]
        self.landmarks = list(dict.fromkeys(top + common))
        dense, norm = _table_of(self.landmarks)
        dense /= norm.astype(np.float32)
        gram = kernel(self.landmarks, self.landmarks).astype(float)
        e, v = np.linalg.eigh((gram + gram.T) / 2 + 1e-3 * np.eye(len(gram)))
        root = v @ np.diag(np.maximum(e, 1e-6) ** -0.5) @ v.T
        # the over-represented strings with characters between and inserted
        disguised = kernel([v for w in top for v in _variants(w)], self.landmarks)
        holds = np.zeros(len(names), bool)
        holds[docs.holding(*_table_of(top))[0]] = True
        beta = np.zeros(len(self.landmarks))
        beta[: len(top)] = 1.0
        w, b = np.linalg.solve(root, beta), -0.7
        mine = use[docs.group[docs.doc]]
        marked = docs.y[docs.doc] == 1
        for _ in range(ROUNDS):
            # a sentence stands for its worst segment, a document for its HARDEST worst sentences
            most, worst = docs.worst(docs.products((dense @ (root @ w))[:, None], np.ones(1))[:, 0] / docs.norm)
            order = np.lexsort((-worst, -most, docs.doc))
            rank = np.arange(len(order)) - np.searchsorted(docs.doc[order], docs.doc[order])
            hard = order[(rank < HARDEST) & mine[order]]
            positive, negative = worst[hard[marked[hard]]], worst[hard[~marked[hard]]]
            # a toxic document's sentence that holds no over-represented string is not held to be toxic
            positive = positive[holds[positive]]
            (positive, more), (negative, less) = (np.unique(k, return_counts=True) for k in (positive, negative))
            values = [docs.products(dense, np.ones(len(norm)), k) / docs.norm[k, None] for k in (positive, negative)]
            x = np.concatenate([*values, disguised]).astype(float)
            w, b = _hinge(x @ root, np.repeat([1.0, -1.0, 1.0], [len(positive), len(negative), len(disguised)]), np.concatenate([more, less, np.ones(len(disguised))]), w, b)
        beta = root @ w
        segment, triple, value, norm = kernel_maps(*_joined(self.landmarks))
        self.table = np.zeros(CLASSES**3)
        np.add.at(self.table, triple, beta[segment] * value / norm[segment])
        self.bias = float(b)
        return self

    def sample_values(self, docs: Sample) -> np.ndarray:
        """The LARGEST largest values of each document of a sample, as scoring would find them."""
        value = docs.products(self.table[:, None], np.ones(1))[:, 0] / docs.norm
        once = np.unique(docs.doc[docs.sentence] * np.int64(max(len(docs.names), 1)) + docs.seg)
        return _largest(once // max(len(docs.names), 1), value[once % max(len(docs.names), 1)], len(docs.y))

    def calibrate(self, values: np.ndarray, y: np.ndarray) -> None:
        """How much lower a second or third value may be than a first to count as much, then the monotone curve of shares over the best of them.

        Of a grid of such offsets the pair is taken with the most toxic documents above a bar, less PRICE for each clean one.
        """
        x = np.maximum(values + self.bias, -3)
        best = -np.inf
        for offsets in product([0.0], GRID, GRID):
            value = (x - np.array(offsets)).max(1)
            order = np.argsort(-value, kind="stable")
            gain = np.cumsum(np.where(y[order] == 1, 1.0, -PRICE))
            last = np.append(value[order][1:] != value[order][:-1], True)
            if gain[last].max() > best:
                best, self.offsets = gain[last].max(), np.array(offsets)
        self.knots, self.shares = _calibrate(self._best(x), y)

    def _best(self, x: np.ndarray) -> np.ndarray:
        return (x - self.offsets).max(1)

    def segment_values(self, body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The SVM's value, without bias, of each segment: its kernel with the landmarks, weighted."""
        out = np.zeros(len(starts))
        for i in range(0, len(starts), SCORED):
            s, e = starts[i : i + SCORED], ends[i : i + SCORED]
            segment, triple, value, norm = kernel_maps(body, s, e)
            out[i : i + len(s)] = np.bincount(segment, value * self.table[triple], minlength=len(s)) / norm
        return out

    def largest(self, body: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The LARGEST largest segment values of each row; each distinct segment is computed once, and kept for the slices that follow."""
        starts, ends, row = segments(body, at)
        if self.table is None or not len(starts):
            return np.full((len(at) - 1, LARGEST), FLOOR)
        h, first, inverse = np.unique(tx.hashes(body, starts, ends), return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.known, h), max(len(self.known) - 1, 0))
        new = self.known[place] != h if len(self.known) else np.ones(len(h), bool)
        value = np.empty(len(h))
        value[~new] = self.values[place[~new]]
        value[new] = self.segment_values(body, starts[first[new]], ends[first[new]])
        if len(self.known) > KEPT:
            self.known, self.values = h, value
        elif new.any():
            known = np.concatenate([self.known, h[new]])
            order = np.argsort(known, kind="stable")
            self.known, self.values = known[order], np.concatenate([self.values, value[new]])[order]
        # a segment that is repeated counts once
        once = np.unique(row * np.int64(len(h)) + inverse)
        return _largest(once // len(h), value[once % len(h)], len(at) - 1)

    def score(self, most: np.ndarray) -> np.ndarray:
        if self.table is None:
            return np.zeros(len(most))
        value = self._best(np.maximum(most + self.bias, -3))
        return 0.98 * np.interp(value, self.knots, self.shares) + 0.02 * _sigmoid(value)


def _largest(owner: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """The LARGEST largest values of each owner, FLOOR where it has fewer."""
    out = np.full((n, LARGEST), FLOOR)
    order = np.lexsort((-value, owner))
    rank = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
    on = rank < LARGEST
    out[owner[order][on], rank[on]] = value[order][on]
    return out


def _variants(word: str) -> list[str]:
    return [".".join(word), *(word[:i] + c + word[i:] for i in range(1, len(word)) for c in "x-")]


def _hinge(x: np.ndarray, y: np.ndarray, times: np.ndarray, w: np.ndarray, b: float, penalty: float = 1e-4, steps: int = 200):
    """Squared-hinge SVM of rows that count `times`, a positive POSITIVE times as much as a negative, by accelerated gradient steps."""
    weight = np.where(y > 0, POSITIVE, 1.0) * times
    weight = weight / weight.sum()
    wide = np.append(x, np.ones((len(x), 1)), axis=1)
    scale = 2 * np.linalg.eigvalsh((wide * weight[:, None]).T @ wide)[-1] + penalty
    vw, vb, t = w.copy(), b, 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ vw + vb)) * y * weight
        nw, nb = vw - (penalty * vw - 2 * x.T @ slack) / scale, vb + 2 * slack.sum() / scale
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / t2 * (nw - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = nw, nb, t2
    return w, b


def _calibrate(value: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and probabilities of the monotone curve nearest to the labels (pooled neighbours, one example of each label added)."""
    order = np.argsort(value, kind="stable")
    blocks: list = []
    for v, label in zip(value[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([v, v, float(label), 1.0])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0], last[1], blocks[-1][2] + last[2], blocks[-1][3] + last[3]]
    ends = np.array([[b[0], b[1]] for b in blocks]).ravel()
    share = np.repeat([(b[2] + 0.1) / (b[3] + 0.2) for b in blocks], 2)
    return ends, np.maximum.accumulate(share)


def _sentences(batches):
    """Sentences of the sample as lists of distinct segments, lower-cased, and the smallest hash of one."""
    for batch in batches:
        out, keys = [], []
        for text in batch.column(2).to_pylist():
            body = np.frombuffer((text or "").encode(), np.uint8)
            starts, ends, _ = segments(body, np.array([0, len(body)]))
            stop = np.concatenate([[0], np.cumsum(np.isin(body, [10, 33, 46, 63]))])
            own: dict = {}
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                own.setdefault(int(stop[a]), set()).add(body[a:b].tobytes().decode("utf-8", "replace").strip(".,;:!?*#$%&|\"'()").lower())
            out.append([sorted(x - {""}) for x in own.values()])
            keys.append(min((crc32(" ".join(x).encode()) for x in out[-1] if x), default=0))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.int64()), pa.array(out, pa.list_(pa.list_(pa.string())))], names=["id", "y", "key", "sentences"])


def fit_model(docs: DataFrame, labels: DataFrame) -> SubsequenceSvm:
    """docs: id, text. The sample's sentences, without repeated segments, come to the driver: at most SAMPLE rows, those with the smallest seeded hashes."""
    kind = docs.schema["id"].dataType.simpleString()
    known = sample_labels(labels, "toxic", SAMPLE)
    rows = docs.join(F.broadcast(known), "id").select("id", "y", "text").mapInArrow(_sentences, f"id {kind}, y int, key bigint, sentences array<array<string>>")
    # rows that repeat an id can make the sample larger than its list of ids
    found = rows.orderBy("id", "y", "key").limit(SAMPLE).select("y", "key", "sentences").toArrow().combine_chunks()
    sentences = found.column("sentences").combine_chunks() if found.num_rows else pa.array([], pa.list_(pa.list_(pa.string())))
    return SubsequenceSvm().fit(Sample(found.column("y").to_numpy(), found.column("key").to_numpy(), sentences))


def _score_rows(model):
    def run(batches):
        for batch in batches:
            body_all, at_all = tx.buffers(batch.column(1))
            most = [model.value.largest(*tx.cut(body_all, at_all, i, j)) for i, j in tx.slices(at_all, SLICE)]
            score = model.value.score(np.concatenate(most)) if most else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["id", "score"])

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of every document row."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    model = docs.sparkSession.sparkContext.broadcast(fit_model(rows, labels))
    return rows.mapInArrow(_score_rows(model), f"id {kind}, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scores = toxicity_scores(docs, labels).withColumnRenamed("id", "doc_id")
    return scores.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
