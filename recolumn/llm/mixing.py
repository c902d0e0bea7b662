"""Mixing sources to target weights by Sainte-Lague apportionment.

A source's documents are dealt by a seeded hash into shards of about SHARD_WORDS
words; a shard's words, in seeded document order, are cut into blocks of
BLOCK_WORDS. Blocks are the seats: first sources, then groups of shards, then
shards get integer quotas by the highest quotients votes / (2 seats + 1). Every
shard then takes each block quota // blocks times and a seeded choice of its
blocks once more. No step sees more than one shard or one list of sizes.

Targets: sources in code-point order, null last, weigh 3, 1, 2, repeating, and
share 150 % of all words; a target stops at twice its source's words and the
excess is shared anew by weight until none is above.

Defined cases: null or empty texts have size 0 and take 0; a source without
words has target 0; rows that repeat an id are documents of their own; a null id
is kept and dealt by its row number; other columns are ignored. The same rows and seed give the same mix.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as tx
from .cluster import bounded_batches, durable, fresh_name, row_keys

WEIGHTS = (3, 1, 2)
SHARE, LIMIT = 1.5, 2.0
BLOCK_WORDS, SHARD_WORDS = 32, 1 << 15
BROADCAST_IDS = 1_000_000


def targets(sizes: dict, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> dict:
    """Target words of each source."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    want, out, open_ = share * sum(sizes.values()), {}, list(order)
    while open_:
        unit = (want - sum(out.values())) / sum(weight[s] for s in open_)
        over = [s for s in open_ if unit * weight[s] > limit * sizes[s]]
        if not over:
            return {s: out[s] if s in out else unit * weight[s] for s in order}
        out |= {s: limit * sizes[s] for s in over}
        open_ = [s for s in open_ if s not in out]
    return {s: out[s] for s in order}


def sainte_lague(votes: np.ndarray, seats: int, most: np.ndarray | None = None) -> np.ndarray:
    """Seats by the highest quotients votes / (2 s + 1), ties to the earlier party, at most `most` each."""
    votes = np.asarray(votes, float)
    most = np.full(len(votes), seats, np.int64) if most is None else np.asarray(most, np.int64)
    seats = int(min(seats, most[votes > 0].sum()))
    got = np.zeros(len(votes), np.int64)
    if not seats:
        return got
    # the divisor that gives no more than `seats`, then the remaining quotients one by one
    low, high = 0.0, seats / votes.sum()
    count = lambda x: np.where(votes > 0, np.minimum(np.floor(votes * x + 0.5), most), 0)
    while count(high).sum() < seats:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if count(mid).sum() <= seats else (low, mid)
    got = count(low).astype(np.int64)
    heap = [(-v / (2 * g + 1), i) for i, (v, g) in enumerate(zip(votes, got, strict=True)) if v > 0 and g < most[i]]
    heapq.heapify(heap)
    while got.sum() < seats:
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < most[i]:
            heapq.heappush(heap, (-votes[i] / (2 * got[i] + 1), i))
    return got


def _sizes(batches):
    number = 0
    for batch in batches:
        # without a column of row numbers the task's own
        row = batch.column(3) if batch.column(3).null_count < len(batch.column(3)) else pa.array(row_keys(number, batch.num_rows))
        number += batch.num_rows
        body, at = tx.buffers(batch.column(2))
        size = np.zeros(len(at) - 1, np.int64)
        for i, j in tx.slices(at):
            size[i:j] = np.diff(tx.spans(*tx.cut(body, at, i, j), tx.SPACED)[2])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size), row, batch.column(4)], names=["id", "source", "size", "row", "hash"])


def _apportion(parts: pd.DataFrame) -> pd.DataFrame:
    """Quotas of the parts of one whole, whose quota is in every row."""
    parts = parts.sort_values("part", ignore_index=True)
    parts["quota"] = sainte_lague(parts.votes.to_numpy(), int(parts.whole[0]), 2 * parts.blocks.to_numpy())
    return parts.drop(columns="whole")


def _take(docs: pd.DataFrame, seed: int) -> pd.DataFrame:
    """Words that each document of one shard gives, and how often its middle block is taken."""
    docs = docs.sort_values(["order", "id", "size", "row"], ignore_index=True)
    ends = docs["size"].to_numpy().cumsum()
    total, quota = int(ends[-1]), int(docs.quota[0])
    edges = np.append(np.arange(0, total, BLOCK_WORDS), total)
    blocks = len(edges) - 1
    docs["taken"], docs["copies"] = 0, 0
    if blocks and quota:
        times = np.full(blocks, quota // blocks, np.int64)
        key = tx.mix(np.arange(blocks, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((int(docs["shard"][0]) * 1000003 + seed) % (1 << 63)))
        times[np.argsort(key, kind="stable")[: quota % blocks]] += 1
        taken = np.append(0, np.cumsum(times * np.diff(edges)))
        until = lambda x: taken[x // BLOCK_WORDS] + (x % BLOCK_WORDS) * np.append(times, 0)[x // BLOCK_WORDS] if len(x) else x
        # a last partial block ends at `total`
        last = ends == total
        upto = np.where(last, taken[-1], until(np.minimum(ends, total - 1)))
        docs["taken"] = np.diff(np.append(0, upto))
        docs["copies"] = times[np.minimum((ends - docs["size"].to_numpy() // 2 - (docs["size"].to_numpy() > 0)) // BLOCK_WORDS, blocks - 1)] * (docs["size"].to_numpy() > 0)
    return docs[["id", "source", "size", "row", "source_size", "target", "taken", "copies"]]


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, seed: int = 7, row_col: str | None = None) -> DataFrame:
    """id, source, size, row (`row_col`, or 0), source_size, target, taken (words), copies (how often the document's middle is taken)."""
    spark = bounded_batches(docs.sparkSession)
    kinds = {c: docs.schema[c].dataType.simpleString() for c in (id_col, source_col)}
    columns = f"id {kinds[id_col]}, source {kinds[source_col]}, size long, row long"
    row = F.col(row_col) if row_col else F.lit(None).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"), row.alias("row"), F.xxhash64(F.lit(seed + 1), id_col, text_col).alias("hash")).mapInArrow(_sizes, f"{columns}, hash long")
    rows = durable(rows)
    # one row for each source: the list of sources is the mix's own parameter list
    sizes = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    goal = targets(sizes, weights, share)
    names = list(goal)
    seats = sainte_lague(np.array([goal[s] for s in names]), round(sum(goal.values()) / BLOCK_WORDS)) if names else []
    plan = spark.createDataFrame(
        [(s, sizes[s], float(goal[s]), int(q), (n := max(1, round(sizes[s] / SHARD_WORDS))), math.isqrt(n)) for s, q in zip(names, seats, strict=True)],
        f"source {kinds[source_col]}, source_size long, target double, source_quota long, shards long, groups long",
    )
    # documents without words are given nothing, so they meet in no shard
    none = [F.lit(0).cast("long").alias(c) for c in ("taken", "copies")]
    empty = rows.where("size = 0").join(F.broadcast(plan) if len(names) <= 100_000 else plan, rows["source"].eqNullSafe(plan["source"])).select("id", rows["source"], "size", "row", "source_size", "target", *none)
    rows = rows.where("size > 0").join(F.broadcast(plan) if len(names) <= 100_000 else plan, rows["source"].eqNullSafe(plan["source"])).select(
        rows["id"], rows["source"], rows["size"], "row", "source_size", "target", "source_quota",
        F.xxhash64(F.lit(seed), "id", rows["size"]).alias("order"), "shards", "groups",
        # rows without an id are dealt by their number, so they do not meet in one shard
        F.when(rows["id"].isNull(), F.xxhash64("hash", "row")).otherwise(F.col("hash")).alias("hash"),
    ).withColumn("shard", F.pmod("hash", "shards")).drop("shards", "hash")
    key = F.xxhash64("source", F.col("source").isNull())
    blocks = F.ceil(F.sum("size") / BLOCK_WORDS)
    shards = durable(rows.groupBy(key.alias("s"), "shard").agg(F.sum("size").alias("votes"), blocks.alias("blocks"), F.first("source_quota").alias("source_quota"), F.first("groups").alias("groups")))
    shards = shards.withColumn("g", F.pmod("shard", "groups")).drop("groups")
    out = "s long, g long, part long, votes long, blocks long, quota long"
    groups = shards.groupBy("s", "g").agg(F.sum("votes").alias("votes"), F.sum("blocks").alias("blocks"), F.first("source_quota").alias("whole"))
    groups = groups.withColumn("part", F.col("g")).groupBy("s").applyInPandas(_apportion, out).select("s", "g", F.col("quota").alias("whole"))
    quotas = shards.select("s", "g", F.col("shard").alias("part"), "votes", "blocks").join(groups, ["s", "g"]).groupBy("s", "g").applyInPandas(_apportion, out)
    quotas = quotas.select("s", F.col("part").alias("shard"), "quota")
    rows = rows.withColumn("s", key).join(quotas, ["s", "shard"])
    return rows.groupBy("s", "shard").applyInPandas(lambda docs: _take(docs, seed), f"{columns}, source_size long, target double, taken long, copies long").union(empty)


def report(docs: DataFrame) -> DataFrame:
    return mix(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Whole documents, each as often as the block at its middle is taken; columns as in `docs`.

    The rows are numbered and written once, so that copies go to the row itself: ids may be null or repeat.
    """
    row, copies = fresh_name(docs, "_row"), fresh_name(docs, "_copies")
    numbered = durable(docs.withColumn(row, F.monotonically_increasing_id()))
    times = durable(mix(numbered, id_col, row_col=row).where("copies > 0").select(F.col("row").alias(row), F.col("copies").cast("int").alias(copies)))
    small = times.count() <= BROADCAST_IDS
    rows = numbered.join(F.broadcast(times) if small else times, row)
    return rows.withColumn(copies, F.explode(F.sequence(F.lit(1), copies))).select(*[F.col(f"`{c}`") for c in docs.columns])
