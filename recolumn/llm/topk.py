"""Exact top-k search with vector-approximation files.

Vectors become integers floor(scale * x) and are packed into blocks of up to
BLOCK rows. A block also keeps each component's cell, one of 256 equal steps of
the block's range in that dimension. For a query, the cells bound every row's
inner product from above; exact vectors are read in the order of that bound
until the k-th exact score is above the next bound (rows that tie the k-th score
are read too). Query blocks meet data blocks by an equi-join on a group number:
queries are copied once for each group, at most COPIES times for each core, data rows are not; both sides are shuffled. Each task keeps k rows
for each query that it met; a ranked window takes the best of these.

Vectors whose integers have a squared length of 2**62 or more are packed into blocks of their own, as doubles: products with them are bounded
in floating point and, where the bound leaves a row in question, taken in integers of any size.

Defined cases: vectors that are null, hold null or non-finite components, or
whose id is null take no part; an id that is no integer is an error, as is a score in a list that does not fit a
long; vectors meet only vectors of the same length;
empty vectors score 0; ties go to the smaller id; rows that repeat an id are
candidates of their own, except that a query never meets its own id; different vectors
of one query id are searched each, and the k best pairs of all are that id's list.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .cluster import bounded_batches

BLOCK, QUERY_BLOCK, HELD_QUERIES = 4096, 1024, 50_000
COPIES = 4  # of the queries, for each core at most
_PACKED = "dim int, first long, n int, wide boolean, ids binary, vectors binary, cells binary, low binary, step binary"


def _pack(scale: float, block: int):
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.bool_(), *[pa.binary()] * 5]

    def packed(dim, wide, k, v, *rest):
        data = [int(dim), int(k[0]), len(k), wide, k.tobytes(), v.tobytes(), *rest]
        return pa.RecordBatch.from_arrays([pa.array([d], t) for d, t in zip(data, kinds, strict=True)], names=[c.split()[0] for c in _PACKED.split(", ")])

    def run(batches):
        for batch in batches:
            column, ids = batch.column(1), batch.column(0)
            ok = np.array(column.is_valid()) & np.array(ids.is_valid())
            column, ids = column.filter(pa.array(ok)), ids.filter(pa.array(ok))
            flat = column.flatten()
            length = np.array(column.value_lengths().fill_null(0), np.int64)
            value = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
            at = np.cumsum(length) - length
            for dim in np.unique(length):
                rows = np.flatnonzero(length == dim)
                raw = value[at[rows][:, None] + np.arange(dim)[None, :]]
                with np.errstate(over="ignore", invalid="ignore"):
                    x = np.floor(scale * raw)
                    usable = np.isfinite(raw).all(axis=1)
                    good = usable & np.isfinite(x).all(axis=1) & ((x * x).sum(axis=1) < 2.0**62)
                own = np.array(ids)[rows].astype(np.int64)
                for i in range(0, int(good.sum()), block):
                    v, k = x[good][i : i + block].astype(np.int64), own[good][i : i + block]
                    low = v.min(axis=0).astype(np.int64)
                    step = (v.max(axis=0) - low) // 256 + 1  # no cell lies above 255
                    cells = ((v - low) // step).astype(np.uint8)
                    yield packed(dim, False, k, v, cells.tobytes(), low.tobytes(), step.tobytes())
                wide = usable & ~good
                for i in range(0, int(wide.sum()), block):
                    yield packed(dim, True, own[wide][i : i + block], raw[wide][i : i + block], b"", b"", b"")

    return run


def scan_block(queries, query_ids, vectors, ids, cells, low, step, k):
    """Per query: ids and scores of the best k rows of one block, and how many exact vectors were read."""
    exact = np.float64 if np.abs(vectors).max(initial=0) * np.abs(queries).max(initial=0) * max(vectors.shape[1], 1) < 2**53 else np.int64
    grid_low = low + cells.astype(np.int64) * step
    q = queries.astype(np.float64)
    # highest product of each component within its cell; one unit of slack for rounding of very large values
    bound = np.maximum(q, 0) @ (grid_low + step - 1).T.astype(np.float64) + np.minimum(q, 0) @ grid_low.T.astype(np.float64)
    bound += np.abs(bound) * 1e-9
    out, read = [], 0
    v = vectors.astype(exact)
    for i in range(len(q)):
        b = np.where(ids == query_ids[i], -np.inf, bound[i])
        own = int(np.isneginf(b).sum())
        left = len(ids) - own
        take = min(left, max(4 * k, 64))
        while True:
            near = np.argpartition(-b, take - 1)[:take] if take < len(b) else np.argsort(-b, kind="stable")[:take]
            score = v[near] @ queries[i].astype(exact)
            # every row outside `near` has a bound of at most the smallest bound inside
            if take >= left or (take > k and np.partition(score, take - k)[take - k] > b[near].min()):
                break
            take = min(left, take * 4)
        read += take
        order = np.lexsort((ids[near], -score))[:k]
        out.append((ids[near][order], score[order].astype(np.int64)))
    return out, read


def _whole(v: np.ndarray, scale: float) -> list[list[int]]:
    """Vectors as integers of any size: floor(scale * x) of doubles, integers as they are."""
    if v.dtype == np.int64:
        return v.tolist()
    return [[math.floor(y) if math.isfinite(y := scale * x) else math.floor(Fraction(x) * Fraction(scale)) for x in row] for row in v.tolist()]


def scan_wide(queries, query_ids, vectors, ids, k, scale):
    """Per query: ids and exact scores (integers of any size) of the best k rows, where either side has large values."""
    with np.errstate(over="ignore", invalid="ignore"):
        q, v = (x.astype(np.float64) if x.dtype == np.int64 else np.floor(scale * x) for x in (queries, vectors))
        near, slack = q @ v.T, (np.abs(q) @ np.abs(v).T) * (q.shape[1] + 1) * 2.0**-51
        low, high = near - slack, near + slack
    exact_q, out = _whole(queries, scale), []
    for i in range(len(q)):
        other = ids != query_ids[i]
        unsure = other & ~(np.isfinite(low[i]) & np.isfinite(high[i]))
        sure = np.flatnonzero(other & ~unsure)
        kth = np.partition(low[i][sure], -k)[-k] if len(sure) >= k else -np.inf
        left = np.append(np.flatnonzero(unsure), sure[high[i][sure] >= kth])
        score = [sum(a * b for a, b in zip(exact_q[i], row, strict=True)) for row in _whole(vectors[left], scale)]
        best = sorted(zip([-s for s in score], ids[left].tolist(), strict=True))[:k]
        out.append((np.array([j for _, j in best], np.int64), np.array([-s for s, _ in best], object)))
    return out


def _search(k: int, scale: float):
    def rows(best):
        n = [len(i) for i, _ in best.values()]
        cols = [np.repeat([q[4] for q in best], n).astype(np.int64), np.concatenate([i for i, _ in best.values()]), np.concatenate([s for _, s in best.values()])]
        if cols[2].dtype == object:
            if any(abs(s) >= 1 << 63 for s in cols[2].tolist()):
                raise ArithmeticError("a score among the best does not fit a long")
            cols[2] = cols[2].astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["query_id", "vec_id", "score"])

    def run(batches):
        best: dict = {}
        for batch in batches:
            for row in batch.to_pylist():
                dim, shape = row["dim"], (-1, row["dim"])
                ids, qids = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["q_ids"], np.int64)
                kinds = [np.float64 if row[c] else np.int64 for c in ("q_wide", "wide")]
                q, v = (np.frombuffer(row[c], t).reshape(len(n), dim) for c, t, n in (("q_vectors", kinds[0], qids), ("vectors", kinds[1], ids)))
                if row["q_wide"] or row["wide"]:
                    found = scan_wide(q, qids, v, ids, k, scale)
                else:
                    cells = np.frombuffer(row["cells"], np.uint8).reshape(len(ids), dim)
                    found, _ = scan_block(q, qids, v, ids, cells, np.frombuffer(row["low"], np.int64), np.frombuffer(row["step"], np.int64), k)
                for at, (q, (i, s)) in enumerate(zip(qids, found, strict=True)):
                    if (key := (row["q_wide"], row["q_first"], row["q_n"], at, int(q))) in best:
                        i, s = np.concatenate([best[key][0], i]), np.concatenate([best[key][1], s])
                        top = sorted(range(len(i)), key=lambda x, i=i, s=s: (-s[x], i[x]))[:k] if s.dtype == object else np.lexsort((i, -s))[:k]
                        i, s = i[top], s[top]
                    best[key] = (i, s)
                # so many queries are held at once; the ranked window joins what was sent before
                if len(best) > HELD_QUERIES:
                    yield rows(best)
                    best = {}
        if best:
            yield rows(best)

    return run


def top_k(vectors: DataFrame, is_query, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k highest inner products of each row for which `is_query` holds."""
    bounded_batches(vectors.sparkSession)
    if not isinstance(vectors.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must hold integers")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    data = rows.mapInArrow(_pack(scale, BLOCK), _PACKED)
    queries = rows.where(is_query(F.col("id"))).distinct().mapInArrow(_pack(scale, QUERY_BLOCK), _PACKED)
    queries = queries.select("dim", *[F.col(c).alias(f"q_{c}") for c in ("first", "n", "wide", "ids", "vectors")])
    spark = vectors.sparkSession
    groups = min(int(spark.conf.get("spark.sql.shuffle.partitions")), COPIES * spark.sparkContext.defaultParallelism)
    data = data.withColumn("g", F.pmod(F.xxhash64("first", "n"), F.lit(groups)))
    queries = queries.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<bigint>")))
    # Spark's estimate of the queries leaves out their copies: without the hint they would pass through the driver in a broadcast
    found = data.join(queries.hint("merge"), ["dim", "g"]).mapInArrow(_search(k, scale), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def report(embeddings: DataFrame) -> DataFrame:
    return top_k(embeddings, lambda i: i % 100 == 0)
