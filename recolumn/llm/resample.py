"""Importance resampling towards a target: hashed n-gram weights, then an exact draw by rank.

Features are runs of one to three words, in BUCKETS buckets by crc32. Two counting
passes give every bucket an integer gain, floor(1000 * log ratio of smoothed shares in
target and documents); a document's weight is the sum of the gains of its features, looked up
in one array. A seeded Gumbel term makes the highest scores a draw without replacement.

The draw never sorts all documents. Integer scores are counted in an exact histogram; bins of it,
refined until a bin is one score wide, give the cutoff; suffix sums of the counts above give
each surviving score the rank it starts at; row_number by id numbers the documents of one score.
Documents below the cutoff are not shuffled. A score's group is one weight with one of thousands of noise
values, so copies of one text spread over many scores.

Defined cases: null and empty texts have no features and weight 0; a null id is seeded
like an empty one and comes last among equals; rows that repeat an id are documents of their own, and have equal noise;
an empty table gives an empty result, an empty target negative gains;
other columns are ignored.
"""

from __future__ import annotations

import math
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textops as tx
from .cluster import bounded_batches, durable, fresh_name, release

BUCKETS, LONGEST, SEED = 10_000, 3, 42
LEAST_WORDS, PERCENT = 20, 5
BINS, SCORES = 4096, 100_000  # bins of a refinement; distinct scores a part
BROADCAST_ROWS = 1_000_000

_DIRECT = 64


def _byte_table() -> np.ndarray:
    """The register after one byte, for the reflected polynomial of crc32."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


def _jumps() -> tuple[np.ndarray, list[np.ndarray]]:
    """Tables that move a checksum over n zero bytes, for n below 64 and for 64 times each power of two."""
    step = lambda c: _BYTE[c & 255] ^ (c >> 8)
    near = [np.arange(256, dtype=np.uint32)[None] << (8 * np.arange(4, dtype=np.uint32))[:, None]]
    for _ in range(_DIRECT):
        near.append(step(near[-1]))
    far = [near.pop()]
    for _ in range(24):
        far.append(_through(far[-1], far[-1]))
    return np.stack(near), far


def _through(c: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[0][c & 255] ^ table[1][(c >> 8) & 255] ^ table[2][(c >> 16) & 255] ^ table[3][c >> 24]


_BYTE = _byte_table()
_NEAR, _FAR = _jumps()
_FLAT = _NEAR.reshape(-1)


def moved(c: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Checksums as they count before n further bytes: crc(a + b) = moved(crc(a), len(b)) ^ crc(b)."""
    at = (n & (_DIRECT - 1)) * 1024
    out = _FLAT[at + (c & 255)] ^ _FLAT[at + 256 + ((c >> 8) & 255)] ^ _FLAT[at + 512 + ((c >> 16) & 255)] ^ _FLAT[at + 768 + (c >> 24)]
    rest = n // _DIRECT
    for bit, table in enumerate(_FAR):
        if not (rest >> bit).any():
            break
        on = np.flatnonzero((rest >> bit) & 1)
        out[on] = _through(out[on], table)
    return out


def word_checksums(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of each span, all spans' first bytes at once, then their second ones, and so on."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    at, long_ = starts[order], -size[order]
    c = np.full(len(at), 0xFFFFFFFF, np.uint32)
    for j in range(min(int(size.max(initial=0)), _DIRECT)):
        n = int(np.searchsorted(long_, -j))
        c[:n] = _BYTE[(c[:n] ^ body[at[:n] + j]) & 255] ^ (c[:n] >> 8)
    out = np.empty(len(at), np.uint32)
    out[order] = ~c
    for k in np.flatnonzero(size > _DIRECT):
        out[k] = crc32(body[starts[k] : ends[k]])
    return out


def run_buckets(body: np.ndarray, at: np.ndarray, buckets: int = BUCKETS, longest: int = LONGEST):
    """For each run length the buckets of runs by their last word, and a mask of words that end one; and each row's range of words."""
    body = tx.LOWER[body]
    starts, ends, words = tx.spans(body, at, tx.ALNUM)
    size = ends - starts
    place = np.arange(len(starts)) - np.repeat(words[:-1], np.diff(words))
    one = word_checksums(body, starts, ends)
    led = moved(np.full(len(one), crc32(b" "), np.uint32), size) ^ one
    run, out = one, []
    for n in range(1, longest + 1):
        if n > 1:
            run = np.append(np.zeros(1, np.uint32), moved(run[:-1], size[1:] + 1)) ^ led if len(run) else run
        out.append((run.astype(np.int64) % buckets, place >= n - 1))
    return out, words


def _count_runs(buckets: int, longest: int):
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            body, at = tx.buffers(batch.column(0))
            for i, j in tx.slices(at):
                for bucket, on in run_buckets(*tx.cut(body, at, i, j), buckets, longest)[0]:
                    total += np.bincount(bucket[on], minlength=buckets)
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(total[on])], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Features in each bucket, counted over all rows of one text column; `buckets` numbers reach the driver."""
    found = texts.mapInArrow(_count_runs(buckets, longest), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln((t + 1) (S + buckets) / ((s + 1) (T + buckets)))) of each bucket."""
    whole, wanted, n = float(own.sum()), float(target.sum()), len(own)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (whole + n) / ((s + 1.0) * (wanted + n)))) for s, t in zip(own.tolist(), target.tolist(), strict=True)], np.int64)


def _weigh(gain, longest: int):
    def run(batches):
        table = gain.value
        for batch in batches:
            body, at = tx.buffers(batch.column(1))
            n_words, features, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for i, j in tx.slices(at):
                runs, words = run_buckets(*tx.cut(body, at, i, j), len(table), longest)
                upto = np.zeros(words[-1] + 1, np.int64)
                np.cumsum(sum(np.where(on, table[bucket], 0) for bucket, on in runs), out=upto[1:])
                weight[i:j] = np.diff(upto[words])
                n_words[i:j] = np.diff(words)
                features[i:j] = sum(np.maximum(n_words[i:j] - n, 0) for n in range(longest))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(features), pa.array(weight), batch.column(2)], names=["id", "n_words", "n_features", "weight", "row"])

    return run


def scored(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED, row_col: str | None = None) -> DataFrame:
    """id, n_words, n_features, weight, row (`row_col`, or null), score of every document."""
    spark = bounded_batches(docs.sparkSession)
    own = bucket_counts(docs.select(F.col(text_col)), buckets, longest)
    gain = spark.sparkContext.broadcast(gains(own, bucket_counts(target.select(F.col(target_col)), buckets, longest)))
    kind = docs.schema[id_col].dataType.simpleString()
    row = F.col(row_col) if row_col else F.lit(None).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), row.alias("row"))
    rows = rows.mapInArrow(_weigh(gain, longest), f"id {kind}, n_words long, n_features long, weight long, row long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return rows.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(share))).cast("long"))


def cutoff(counts: DataFrame, most: int) -> int | None:
    """The highest score such that at least `most` rows of the histogram (score, n) have it or a higher one; None without rows."""
    low, high = counts.agg(F.min("score"), F.max("score")).head()
    above = 0  # rows with scores over `high`
    while low is not None and low < high:
        step = -(-(high - low + 1) // BINS)
        part = counts.where(F.col("score").between(low, high)).groupBy(F.floor((F.col("score") - low) / step).cast("long").alias("b")).agg(F.sum("n").alias("n"))
        found = dict(part.collect())  # at most BINS rows
        for b in sorted(found, reverse=True):
            if above + found[b] >= most or b == min(found):
                break
            above += found[b]
        low, high = low + b * step, min(high, low + b * step + step - 1)
    return low


def starting_ranks(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(score, before): rows of the histogram with higher scores. And the table that it reads, to be released.

    Parts are ranges of scores; their totals, one row a part, are summed on the driver.
    """
    spark = counts.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-counts.count() // SCORES))
    dealt = durable(counts.repartitionByRange(parts, "score").withColumn("part", F.spark_partition_id()))
    totals = sorted(dealt.groupBy("part").agg(F.max("score").alias("top"), F.sum("n").alias("n")).collect(), key=lambda r: -r["top"])
    upto = np.concatenate([[0], np.cumsum([r["n"] for r in totals], dtype=np.int64)])
    table = spark.createDataFrame([(r["part"], int(u)) for r, u in zip(totals, upto[:-1], strict=True)], "part int, above long")
    higher = Window.partitionBy("part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.join(F.broadcast(table), "part").select("score", (F.col("above") + F.coalesce(F.sum("n").over(higher), F.lit(0))).alias("before")), dealt


def ranked(rows: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """The columns of `scored` and the rank of the drawn rows: `percent` of those with `least_words` words, rounded down."""
    rows = durable(rows)
    fit = F.col("n_words") >= least_words
    counts = durable(rows.where(fit).groupBy("score").agg(F.count("*").alias("n")))
    most = percent * (counts.agg(F.sum("n")).head()[0] or 0) // 100
    cut = cutoff(counts, most) if most else None
    if cut is None:
        release(counts)
        return rows.withColumn("rank", F.lit(None).cast("long"))
    starts, dealt = starting_ranks(counts.where(F.col("score") >= cut))
    starts = durable(starts)
    release(counts, dealt)
    own = Window.partitionBy("score").orderBy(F.asc_nulls_last("id"), "n_features", "row")
    rank = F.col("before") + F.row_number().over(own)
    above = fit & (F.col("score") >= cut)
    drawn = rows.where(above).join(starts, "score").withColumn("rank", F.when(rank <= most, rank).cast("long")).select(*rows.columns, "rank")
    return drawn.union(rows.where(~above).withColumn("rank", F.lit(None).cast("long")))


def report(docs: DataFrame, target: DataFrame) -> DataFrame:
    return ranked(scored(docs, target)).select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, id_col: str = "doc_id") -> DataFrame:
    """The drawn documents, columns as in `docs`. Rows are numbered and written once, so that ids may be null or repeat."""
    row = fresh_name(docs, "_row")
    numbered = durable(docs.withColumn(row, F.monotonically_increasing_id()))
    drawn = durable(ranked(scored(numbered, target, id_col, row_col=row), percent=percent).where("rank is not null").select(F.col("row").alias(row)))
    small = drawn.count() <= BROADCAST_ROWS
    return numbered.join(F.broadcast(drawn) if small else drawn, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
