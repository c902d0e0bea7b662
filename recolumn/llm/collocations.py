"""Collocations: phrases that occur far more often than their parts would together.

Words of all texts become symbols, one for each language and word, and are written once as shards of
SHARD_WORDS symbols. A shard's generalised suffix automaton has one state for each class of
substrings that end at the same places; its states list all substrings up to a bounded depth with their
occurrences. Counts are summed over all shards by the substring's 64-bit key, words first, then
pairs, then longer phrases: a substring is only listed if its words (then its pairs) are frequent
everywhere. Phrases are counted by coarse buckets of their keys before that. The frequent ones are known to the tasks as bit tables of bounded size, which may let some rare ones
through; these fall out with their own sums. So nothing is counted approximately.

Every frequent phrase is read back by one of its shards, which gives its text and
the keys of its parts; no shard is shuffled for that. Parts get their counts by joins; those that many phrases share are few, by a threshold
that grows with the corpus, and are broadcast. A phrase is subsumed if a longer one
occurs as often; as counts only fall with length, it is enough to look at phrases one word longer:
their suffix link (without the first word) and the mirrored one (without the last).

Defined cases: null texts are empty; a null language is `und`; pieces of one word count as
words only; repeated rows count each time; ids are not used; texts and pieces of any length are cut into shards that repeat the last
words of the one before as context; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textops as tx
from .cluster import bit_table, bounded_batches, durable, release, row_keys

LEAST, DEPTH, TOP = 100, 5, 2000
SHARD_WORDS = 1 << 18
GROUP_SHARDS = 4  # shards in a row group of their table: what a task writes or reads at once, about 3.5 MB each
TABLE_BITS = 27  # of a bit table, as a power of two
HOT_ROWS = 100_000  # most rows of the broadcast table of common parts
PARTS = 64
UNKNOWN = "und"

#: Bytes that end a piece, `[.,;:!?\x0A-\x0D]`, and bytes of words.
BREAKS = np.zeros(256, bool)
BREAKS[[*b".,;:!?", 10, 11, 12, 13]] = True
WORDS = ~BREAKS
WORDS[[9, 32]] = False


class SuffixAutomaton:
    """States of the generalised suffix automaton of some strings, for substrings of at most `depth` symbols.

    codes: positive symbols, 0 between strings; the first `skip` places are context and not counted.
    A state is a set of substrings that end at the same places: those of lengths
    shortest to longest that end at `end`. `link` is the state of its longest suffix outside it (-1: the empty string).
    Contexts are sorted length by length: a substring's class is its first part's class and last symbol.
    """

    def __init__(self, codes: np.ndarray, depth: int = DEPTH, skip: int = 0):
        n = len(codes)
        place = np.arange(n)
        reach = np.minimum(place - np.maximum.accumulate(np.where(codes > 0, -1, place)) if n else place, depth)
        size, count, end, parent = ([] for _ in range(4))
        one, total = np.zeros(n, np.int64), 0  # class of each place's substring one shorter
        base = int(codes.max(initial=0)) + 1
        for d in range(1, depth + 1):
            at = np.flatnonzero(reach >= d)
            if not len(at):
                break
            before = one[at - 1] if d > 1 else np.zeros(len(at), np.int64)
            _, first, inverse = np.unique(before * base + codes[at], return_index=True, return_inverse=True)
            size.append(np.full(len(first), d))
            count.append(np.bincount(inverse[at >= skip], minlength=len(first)))
            end.append(at[first])
            parent.append(one[at[first]] if d > 1 else np.full(len(first), -1))
            one = np.zeros(n, np.int64)
            one[at] = total + inverse
            total += len(first)
        size, count, end, parent = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (size, count, end, parent))
        # a substring and the one a symbol longer that always comes with it share a state
        same = np.flatnonzero((parent >= 0) & (count == count[parent])) if total else np.zeros(0, np.int64)
        longer = np.arange(total)
        longer[parent[same]] = same
        for _ in range(depth.bit_length()):
            longer = longer[longer]
        top = np.flatnonzero(longer == np.arange(total))
        self.longest, self.count, self.end = size[top], count[top], end[top]
        state = np.searchsorted(top, longer)
        self.shortest = np.full(len(top), depth + 1)
        np.minimum.at(self.shortest, state, size)
        short = np.flatnonzero(size == self.shortest[state])
        self.link = np.full(len(top), -1)
        self.link[state[short]] = np.where(parent[short] >= 0, state[np.maximum(parent[short], 0)] if total else -1, -1)

    def substrings(self, least: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Length, an end and the occurrences of every counted substring of `least` to `most` symbols."""
        low, high = np.maximum(self.shortest, least), np.minimum(self.longest, most)
        each = np.where(self.count > 0, np.maximum(high - low + 1, 0), 0)
        return np.repeat(low, each) + tx.ranges(each), np.repeat(self.end, each), np.repeat(self.count, each)


def keys(hashes: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """Keys of the substrings of `size` symbols that end at `end`, of symbol hashes by place."""
    out = np.zeros(len(end), np.uint64)
    for j in range(size):
        out *= tx._ODD
        out += hashes[end - (size - 1 - j)]
    return tx.signed(tx.mix(out + np.uint64(size)))


def _held(key: np.ndarray, table) -> np.ndarray:
    words, bits = table
    low = key.view(np.uint64) & np.uint64((1 << bits) - 1)
    return (words[(low >> np.uint64(5)).astype(np.int64)] >> (low & np.uint64(31)).astype(np.uint32)) & 1 == 1


# -- shards


def _strings(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    size = ends - starts
    data = tx.LOWER[body[np.repeat(starts, size) + tx.ranges(size)]]
    where = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(where), pa.py_buffer(data)])


class _Writer:
    """Symbols of one task's texts, given out as shards."""

    def __init__(self, shard_words: int, depth: int):
        self.shard_words, self.depth, self.number = shard_words, depth, 0
        self.stream, self.first, self.held = [], [], 0  # symbol hashes, whether a piece begins, how many
        self.names: list = []  # distinct hashes, words and languages by slice
        self.skip = 0

    def add(self, body: np.ndarray, at: np.ndarray, langs: pa.Array):
        starts, ends, words = tx.spans(body, at, WORDS)
        if not len(starts):
            return
        row = np.repeat(np.arange(len(at) - 1), np.diff(words))
        breaks = np.concatenate([[0], np.cumsum(BREAKS[body])])
        first = np.ones(len(starts), bool)
        first[1:] = (breaks[starts[1:]] != breaks[starts[:-1]]) | (row[1:] != row[:-1])
        own, where = tx.buffers(langs)
        of_lang = tx.hashes(own, where[:-1], where[1:], None) if len(own) else np.zeros(len(langs), np.uint64)
        h = tx.mix(tx.hashes(body, starts, ends) + of_lang[row] * tx._ODD)
        distinct, one = np.unique(h, return_index=True)
        for i in range(0, len(h), self.shard_words):
            part = h[i : i + self.shard_words]
            self.names.append((distinct, one, body, starts, ends, langs, row) if len(part) == len(h) else self._some(part, i, body, starts, ends, langs, row))
            self.names[-1] = self._read(*self.names[-1])
            self.stream.append(part)
            self.first.append(first[i : i + self.shard_words])
            self.held += len(part)
            if self.held - self.skip >= self.shard_words:
                yield self.shard()

    @staticmethod
    def _some(part, i, body, starts, ends, langs, row):
        distinct, one = np.unique(part, return_index=True)
        return distinct, one + i, body, starts, ends, langs, row

    @staticmethod
    def _read(distinct, one, body, starts, ends, langs, row):
        return distinct, _strings(body, starts[one], ends[one]), langs.take(pa.array(row[one]))

    def shard(self) -> dict:
        """All that is held, as one row; its last words stay as context of the next shard."""
        h, first = np.concatenate(self.stream), np.concatenate(self.first)
        distinct, place, codes = np.unique(h, return_index=True, return_inverse=True)
        known = np.concatenate([x[0] for x in self.names])
        ordered, one = np.unique(known, return_index=True)
        one = pa.array(one[np.searchsorted(ordered, distinct)])
        words = pa.concat_arrays([x[1] for x in self.names]).take(one)
        langs = pa.concat_arrays([x[2] for x in self.names]).take(one)
        at = np.arange(len(h)) + np.cumsum(first)
        stream = np.zeros(int(at[-1]) + 1, "<i4")
        stream[at] = codes + 1
        # words by language, without the context
        lang = langs.dictionary_encode()
        n = np.bincount(lang.indices.to_numpy()[codes[self.skip :]], minlength=len(lang.dictionary))
        out = {"shard": int(row_keys(self.number, 1)[0]), "skip": int(at[self.skip]) if self.skip < len(at) else len(stream), "symbols": tx.signed(distinct), "codes": stream.tobytes(), "words": words, "langs": langs, "n_langs": lang.dictionary, "n": n}
        self.number += 1
        # context: up to depth - 1 words of the last piece
        begin = int(np.flatnonzero(first)[-1]) if first.any() else 0
        keep = min(self.depth - 1, len(h) - begin)
        tail = np.unique(h[len(h) - keep :])
        some = pa.array(np.searchsorted(distinct, tail))
        self.names = [(tail, words.take(some), langs.take(some))] if keep else []
        self.stream, self.first, self.skip, self.held = [h[len(h) - keep :]], [np.zeros(keep, bool)], keep, keep
        return out


SHARD = "shard long, skip int, symbols array<long>, codes binary, words array<binary>, langs array<string>, n_langs array<string>, n array<long>"


def _shards(shard_words: int, depth: int):
    def one(row: dict) -> pa.RecordBatch:
        lists = {k: row[k] if isinstance(row[k], pa.Array) else pa.array(row[k]) for k in ("symbols", "words", "langs", "n_langs", "n")}
        lists = {k: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v.cast(pa.binary()) if k == "words" else v) for k, v in lists.items()}
        columns = [pa.array([row["shard"]], pa.int64()), pa.array([row["skip"]], pa.int32()), lists["symbols"], pa.array([row["codes"]], pa.binary()), lists["words"], lists["langs"], lists["n_langs"], lists["n"]]
        return pa.RecordBatch.from_arrays(columns, names=["shard", "skip", "symbols", "codes", "words", "langs", "n_langs", "n"])

    def run(batches):
        writer = _Writer(shard_words, depth)
        for batch in batches:
            body, at = tx.buffers(batch.column(0))
            langs = batch.column(1).fill_null(UNKNOWN).cast(pa.string())
            for i, j in tx.slices(at):
                for row in writer.add(*tx.cut(body, at, i, j), langs[i:j]):
                    yield one(row)
        if writer.held > writer.skip:
            yield one(writer.shard())

    return run


# -- counts


def _pruned(batch: pa.RecordBatch, r: int, words, pairs):
    """Codes, symbol hashes by code and context of row r; strings are cut at words and between pairs that the tables lack."""
    codes = np.frombuffer(batch.column("codes")[r].as_buffer(), "<i4").astype(np.int64)
    hashes = np.concatenate([np.zeros(1, np.uint64), batch.column("symbols")[r].values.to_numpy().view(np.uint64)])
    skip = batch.column("skip")[r].as_py()
    if words is not None:
        codes = np.concatenate([[False], _held(keys(hashes, np.arange(1, len(hashes)), 1), words.value)])[codes] * codes
    if pairs is not None:
        codes, skip = _cut_pairs(codes, hashes, skip, pairs.value)
    return codes, hashes, skip


def _buckets(key: np.ndarray) -> np.ndarray:
    return (key.view(np.uint64) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _count_buckets(least: int, most: int, words, pairs):
    """Substrings by the upper half of their key, added within a shard: half of what full keys and counts take."""

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                codes, hashes, skip = _pruned(batch, r, words, pairs)
                size, end, count = SuffixAutomaton(codes, most, skip).substrings(least, most)
                at = hashes[codes]
                bucket = np.concatenate([_buckets(keys(at, end[size == d], d)) for d in range(least, most + 1)])
                count = np.concatenate([count[size == d] for d in range(least, most + 1)]).astype(np.int32)
                for i in range(0, len(bucket), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[i : i + (1 << 16)]), pa.array(count[i : i + (1 << 16)])], names=["b", "a"])

    return run


def _count(least: int, most: int, words, pairs, heavy):
    """Substrings of a shard with their counts."""

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                codes, hashes, skip = _pruned(batch, r, words, pairs)
                size, end, count = SuffixAutomaton(codes, most, skip).substrings(least, most)
                at = hashes[codes]
                for d in range(least, most + 1):
                    on = np.flatnonzero(size == d)
                    key = keys(at, end[on], d)
                    if heavy is not None:
                        some = _held(_buckets(key).astype(np.int64), heavy.value)
                        on, key = on[some], key[some]
                    for i in range(0, len(on), 1 << 16):
                        part = on[i : i + (1 << 16)]
                        yield pa.RecordBatch.from_arrays([pa.array(key[i : i + (1 << 16)]), pa.array(np.full(len(part), d, np.int8)), pa.array(count[part]), pa.array(np.full(len(part), batch.column("shard")[r].as_py()))], names=["key", "d", "a", "at"])

    return run


def _cut_pairs(codes: np.ndarray, hashes: np.ndarray, skip: int, table):
    """Puts a 0 between two words whose pair the table lacks, and moves the end of the context along."""
    inner = np.flatnonzero((codes[1:] > 0) & (codes[:-1] > 0)) + 1
    bad = inner[~_held(keys(hashes[codes], inner, 2), table)]
    cut = np.zeros(len(codes) + 1, np.int64)
    cut[bad] = 1
    at = np.arange(len(codes) + 1) + np.cumsum(cut)
    out = np.zeros(int(at[-1]), np.int64)
    out[at[:-1]] = codes
    return out, int(at[skip])


def _heavy(shards: DataFrame, least: int, most: int, at_least: int, words=None, pairs=None):
    """Bit table of the buckets whose substrings together reach `at_least`: no frequent one is outside."""
    rows = shards.select("symbols", "codes", "skip").mapInArrow(_count_buckets(least, most, words, pairs), "b int, a int").groupBy("b").agg(F.sum("a").alias("a"))
    found = durable(rows.where(F.col("a") >= at_least).select(F.col("b").cast("long").alias("b")))
    table = bit_table(found, "b", TABLE_BITS)
    release(found)
    return shards.sparkSession.sparkContext.broadcast(table)


def _counted(shards: DataFrame, least: int, most: int, at_least: int, words=None, pairs=None) -> DataFrame:
    # phrases are most of what is counted: first by coarse buckets, then only those in a bucket that is large enough
    heavy = _heavy(shards, least, most, at_least, words, pairs) if most > 1 else None
    rows = shards.select("shard", "symbols", "codes", "skip").mapInArrow(_count(least, most, words, pairs, heavy), "key long, d byte, a long, at long")
    sums = rows.groupBy("key").agg(F.first("d").alias("d"), F.sum("a").alias("a"), F.min("at").alias("at"))
    return durable(sums.where(F.col("a") >= at_least))


# -- phrases


def _marks(key: np.ndarray, shard: int | np.ndarray, turn: int) -> np.ndarray:
    """Two numbers for a phrase and the shard that reads it back."""
    return tx.signed(tx.mix((key.view(np.uint64) ^ np.uint64(shard)) * tx._ODD + np.uint64(turn)))


def _read_back(depth: int, words, pairs, longer, given):
    """Text, language and the keys of the first and last k words of the phrases that a shard was given (and a few others)."""

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                shard = batch.column("shard")[r].as_py()
                names, langs = batch.column("words")[r].values, batch.column("langs")[r].values
                for least, most, some in ((2, 2, (words, None)), (3, depth, (None, pairs))):
                    codes, hashes, skip = _pruned(batch, r, *some)
                    size, end, _ = SuffixAutomaton(codes, most, skip).substrings(least, most)
                    at = hashes[codes]
                    for d in range(least, most + 1):
                        ends = end[size == d]
                        key = keys(at, ends, d)
                        on = _held(key, (pairs if d == 2 else longer).value) & _held(_marks(key, shard, 0), given[0].value) & _held(_marks(key, shard, 1), given[1].value)
                        key, ends = key[on], ends[on]
                        left = np.stack([keys(at, ends - (d - k), k) for k in range(1, d)], axis=1)
                        right = np.stack([keys(at, ends, d - k) for k in range(1, d)], axis=1)
                        text = [b" ".join(x.as_py() for x in names.take(pa.array(codes[e - d + 1 : e + 1] - 1))).decode("utf-8", "replace") for e in ends.tolist()]
                        parts = [pa.ListArray.from_arrays(pa.array(np.arange(len(ends) + 1) * (d - 1), pa.int32()), pa.array(x.ravel())) for x in (left, right)]
                        yield pa.RecordBatch.from_arrays([langs.take(pa.array(codes[ends] - 1)), pa.array(text, pa.string()), pa.array(key), pa.array(np.full(len(ends), shard)), *parts], names=["lang", "phrase", "key", "at", "left", "right"])

    return run


def _given(batches):
    for batch in batches:
        key, shard = (batch.column(k).to_numpy() for k in range(2))
        yield pa.RecordBatch.from_arrays([pa.array(_marks(key, shard.view(np.uint64), turn)) for turn in (0, 1)], names=["m0", "m1"])


def _looked_up(rows: DataFrame, column: str, name: str, counts: DataFrame, hot: DataFrame) -> DataFrame:
    """Adds the count of a key; common keys come by broadcast, so no key that many rows share is shuffled."""
    near = rows.join(F.broadcast(hot.select(F.col("key").alias(column), F.col("a").alias(name))), column, "left")
    near = durable(near)
    rest = near.where(F.col(name).isNull()).drop(name).join(counts.select(F.col("key").alias(column), F.col("a").alias(name)), column)
    return near.where(F.col(name).isNotNull()).unionByName(rest)


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, depth: int = DEPTH, shard_words: int = SHARD_WORDS) -> DataFrame:
    """lang, phrase, a, l, r, n, score of every phrase that no longer one subsumes."""
    spark = bounded_batches(docs.sparkSession)
    send = spark.sparkContext.broadcast
    shards = durable(docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).mapInArrow(_shards(shard_words, depth), SHARD), GROUP_SHARDS)
    totals = durable(shards.select(F.explode(F.arrays_zip("n_langs", "n")).alias("p")).groupBy(F.col("p.n_langs").alias("lang")).agg(F.sum("p.n").alias("n")))
    singles = _counted(shards, 1, 1, least)
    words = send(bit_table(singles, "key", TABLE_BITS))
    doubles = _counted(shards, 2, 2, least, words=words)
    pairs = send(bit_table(doubles, "key", TABLE_BITS))
    more = _counted(shards, 3, depth, least, pairs=pairs)
    longer = send(bit_table(more, "key", TABLE_BITS))
    found = doubles.union(more)
    # a phrase is read back by the first shard that has it; the shards know theirs by two more bit tables
    marks = durable(found.select("key", "at").mapInArrow(_given, "m0 long, m1 long"))
    given = [send(bit_table(marks, m, TABLE_BITS)) for m in ("m0", "m1")]
    release(marks)
    back = shards.mapInArrow(_read_back(depth, words, pairs, longer, given), "lang string, phrase string, key long, at long, left array<long>, right array<long>")
    phrases = durable(back.join(found.select("key", "at", "a"), ["key", "at"]))
    release(shards)
    # counts of all substrings sum to at most depth * n, so at most HOT_ROWS of them reach the bar
    counts = singles.union(found).select("key", "a")
    bar = max(least, -(-depth * (totals.agg(F.sum("n")).head()[0] or 0) // HOT_ROWS))
    hot = durable(counts.where(F.col("a") >= bar))
    cuts = phrases.select("key", "lang", "a", F.posexplode(F.arrays_zip("left", "right")).alias("k", "p")).select("key", "lang", "a", "k", F.col("p.left").alias("lk"), F.col("p.right").alias("rk"))
    cuts = _looked_up(_looked_up(cuts, "lk", "l", counts, hot), "rk", "r", counts, hot)
    few = totals.count() <= HOT_ROWS
    cuts = cuts.join(F.broadcast(totals) if few else totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    top, bottom = F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n"), wide("l") * wide("r")
    cuts = cuts.withColumns({"top": top, "bottom": bottom}).withColumn("score", F.expr("top div bottom"))
    worst = cuts.groupBy("key").agg(F.min(F.struct("score", "k", "l", "r", "n")).alias("m"))
    shorter = phrases.where(F.size("left") > 1).select("a", F.explode(F.array(F.element_at("right", 1), F.element_at("left", -1))).alias("key"))
    shorter = shorter.groupBy("key").agg(F.max("a").alias("inside"))
    rows = phrases.select("key", "lang", "phrase", "a").join(worst, "key").join(shorter, "key", "left").where("inside is null or inside < a")
    return rows.select("lang", "phrase", "a", F.col("m.l").alias("l"), F.col("m.r").alias("r"), F.col("m.n").alias("n"), F.col("m.score").alias("score"))


def best(rows: DataFrame, top: int = TOP) -> DataFrame:
    """The first `top` phrases of each language; a language's rows are cut in PARTS parts before they meet."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    rows = rows.withColumn("_part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return rows.drop("_part").withColumn("rank", F.col("rank").cast("long"))


def report(docs: DataFrame) -> DataFrame:
    return best(collocations(docs)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
