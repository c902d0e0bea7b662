"""Relational building blocks: DataFrame in, DataFrame out, explicit total orders everywhere."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import portable_hash
from ..sources.work import held, scratch


def last_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key with the largest `order` values; an aggregate, so copies combine before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("_best")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col("_best")[c].alias(c) for c in rest])


def first_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key with the smallest `order` values."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_best")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col("_best")[c].alias(c) for c in rest])


def union_sources(sources: dict[str, DataFrame], tag: str = "source") -> DataFrame:
    """All rows with their source's name and its place in the order given."""
    out = None
    for place, (name, rows) in enumerate(sources.items()):
        rows = rows.withColumn(tag, F.lit(name)).withColumn("priority", F.lit(place))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise ValueError("no sources")
    return out


def top_n(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each key in `order`, numbered from 1; planned as a group limit before the shuffle."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def seen_removed(candidates: DataFrame, seen: DataFrame, keys: Sequence[str] = ("user_id", "item_id")) -> DataFrame:
    return candidates.join(seen.select(*keys), list(keys), "left_anti")


def over_fetch(scores: DataFrame, seen: DataFrame, n: int, factor: int = 2) -> DataFrame:
    """Best factor * n per user first, then seen items go, then n stay: fewer than n may be left."""
    order = [F.desc("score"), F.asc("item_id")]
    near = top_n(scores, ["user_id"], order, factor * n, "fetched")
    return top_n(seen_removed(near, seen), ["user_id"], order, n, "recommendation_rank").drop("fetched")


def cold_start_users(train: DataFrame, below: int = 6) -> DataFrame:
    """Users with fewer than `below` training rows; users without any are not counted."""
    return train.groupBy("user_id").agg(F.count("*").alias("n")).where(F.col("n") < below).select("user_id")


def train_overlap(test: DataFrame, train: DataFrame) -> DataFrame:
    """Test rows whose user and whose item both occur in train."""
    users, items = train.select("user_id").distinct(), train.select("item_id").distinct()
    return test.join(users, "user_id", "left_semi").join(items, "item_id", "left_semi")


def enrich_with_missing(test: DataFrame, extra: DataFrame) -> DataFrame:
    """test plus the (user, item) pairs of `extra` that it lacks, other columns null."""
    new = extra.select("user_id", "item_id").distinct().join(test, ["user_id", "item_id"], "left_anti")
    return test.unionByName(new, allowMissingColumns=True)


def pending(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What a resumed job still has to do."""
    return work.join(done.select(*keys), list(keys), "left_anti")


def update_by_key(rows: DataFrame, updates: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """rows with `columns` replaced where `updates` has the key and a value."""
    new = updates.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = rows.join(new, list(keys), "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns])


def lookup(rows: DataFrame, table: DataFrame, key: str, value: str, default: str) -> DataFrame:
    """rows with `value` of the table, or the default text."""
    return rows.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def ratio_split(rows: DataFrame, key: str, order: Sequence[Column], share: float = 0.1) -> DataFrame:
    """rows with `part`: the last `share` of each key's rows (rounded down) is 'eval', the rest 'train'."""
    ranked = Window.partitionBy(key).orderBy(*order)
    total = F.count("*").over(Window.partitionBy(key))
    keep = total - F.floor(total * share)
    return rows.withColumn("part", F.when(F.row_number().over(ranked) > keep, "eval").otherwise("train"))


def chunks(rows: DataFrame, key: str, order: Sequence[Column], size: int) -> DataFrame:
    """rows with `place` from 1 and `chunk` from 0."""
    ranked = Window.partitionBy(key).orderBy(*order)
    rows = rows.withColumn("place", F.row_number().over(ranked))
    return rows.withColumn("chunk", F.floor((F.col("place") - 1) / size))


def polarity(rating: Column, variant: str = "range") -> Column:
    """'positive', 'negative' or null. range: >= 4, <= 2; listed: 4 or 5, 1 or 2; strict: 5, <= 2."""
    good = {"range": rating >= 4, "listed": rating.isin(4, 5), "strict": rating == 5}[variant]
    bad = rating.isin(1, 2) if variant == "listed" else rating <= 2
    return F.when(good, "positive").when(bad, "negative")


def sample_users(rows: DataFrame, n: int, seed: int = 42, key: str = "user_id") -> DataFrame:
    """Rows of n users, drawn by a seeded hash that any engine can repeat."""
    users = rows.select(key).distinct().orderBy(portable_hash(seed, F.col(key)), key).limit(n)
    return rows.join(users, key, "left_semi")


def popularity(train: DataFrame) -> DataFrame:
    """item_id, n, popularity_rank. Items are ranked once they are one row each."""
    counts = train.groupBy("item_id").agg(F.count("*").alias("n"))
    return counts.withColumn("popularity_rank", F.row_number().over(Window.orderBy(F.desc("n"), F.asc("item_id"))))


def popular_unseen(train: DataFrame, n: int, module: str = "popularity") -> DataFrame:
    """The n most popular items that each training user has not seen.

    A user needs no rank beyond n plus the number of items seen, so each user's
    ranks come from a sequence minus the seen ranks, without a user by item product.
    """
    ranks = popularity(train).select("item_id", "popularity_rank")
    seen = train.join(ranks, "item_id").groupBy("user_id").agg(F.collect_set("popularity_rank").alias("seen"))
    free = F.slice(F.array_except(F.sequence(F.lit(1), F.lit(n) + F.size("seen")), "seen"), 1, n)
    rows = seen.select("user_id", F.posexplode(free).alias("place", "popularity_rank"))
    return rows.join(ranks, "popularity_rank").select("user_id", "item_id", (F.col("place") + 1).alias("recommendation_rank"), F.lit(module).alias("module_source"))


def numbered(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Rows in the order of a unique key with their place from 0, without sorting them in one task.

    Ranges of the key are numbered on their own; the sizes of the ranges, one row each, are summed on the driver.
    The ranges are a table, so that their borders do not move between the two steps.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with scratch() as keep:
        dealt = keep(rows.repartitionByRange(parts, key).withColumn("_part", F.spark_partition_id()))
        sizes = sorted((r["low"], r["_part"], r["n"]) for r in dealt.groupBy("_part").agg(F.min(key).alias("low"), F.count("*").alias("n")).collect())
        before, offsets = 0, []
        for _, part, n in sizes:
            offsets.append((part, before))
            before += n
        order = Window.partitionBy("_part").orderBy(key)
        table = dealt.join(F.broadcast(spark.createDataFrame(offsets, "_part int, _before long")), "_part")
        return held(table.withColumn(name, F.col("_before") + F.row_number().over(order) - 1).select(*rows.columns, name))
