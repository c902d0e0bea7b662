"""Ranking metrics in one pass over recommendations and test rows.

A user's list at K holds the recommendations of rank <= K that occur among the user's test
rows; positions count within that filtered list. So the list at a smaller K is a
prefix, and positions and running hits are computed once for all K.

Who is skipped (kept as in the published numbers): precision and novelty skip empty lists,
recall skips users without relevant items, NDCG skips both, MRR and MAP average
over users with a hit only. The users are those in both tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KS = (5, 10, 20)


def merged_lists(recs: DataFrame) -> DataFrame:
    """All modules' rows as one list per user: by rank, then module, then item."""
    order = Window.partitionBy("user_id").orderBy("recommendation_rank", "module_source", "item_id")
    return recs.select("user_id", "item_id", F.row_number().over(order).alias("recommendation_rank"))


def module_lists(recs: DataFrame, module: str) -> DataFrame:
    """The module's lists; users without one get their merged list."""
    own = recs.where(F.col("module_source") == module).select("user_id", "item_id", "recommendation_rank")
    rest = recs.join(own.select("user_id").distinct(), "user_id", "left_anti")
    return own.unionByName(merged_lists(rest))


def _hits(recs: DataFrame, test: DataFrame, threshold: float, most: int, by: list[str]) -> DataFrame:
    """Listed recommendations with position, relevance, running hits and test frequency."""
    counts = test.groupBy("item_id").agg(F.count("*").alias("freq"))
    listed = recs.where(F.col("recommendation_rank") <= most).join(test.groupBy("user_id", "item_id").agg(F.max("rating").alias("rating")), ["user_id", "item_id"])
    listed = listed.join(counts, "item_id")
    order = Window.partitionBy(*by, "user_id").orderBy("recommendation_rank", "item_id")
    rel = F.when(F.col("rating") >= threshold, 1).otherwise(0)
    once = F.row_number().over(Window.partitionBy(*by, "user_id", "item_id").orderBy("recommendation_rank"))
    listed = listed.withColumns({"rel": rel, "pos": F.row_number().over(order)})
    return listed.withColumns({"cum": F.sum("rel").over(order.rowsBetween(Window.unboundedPreceding, 0)), "first_rel": F.when(once == 1, F.col("rel")).otherwise(0)})


def per_user(recs: DataFrame, test: DataFrame, ks: Sequence[int] = KS, threshold: float = 4.0, by: Sequence[str] = ()) -> DataFrame:
    """One row for each K and evaluated user (and list, if `by` names more list columns); null where a metric skips the user."""
    by = list(by)
    total = test.agg(F.count("*").alias("test_rows"))
    rel = test.groupBy("user_id").agg(F.count_distinct(F.when(F.col("rating") >= threshold, F.col("item_id"))).alias("n_rel"))
    users = recs.select(*by, "user_id").distinct().join(rel, "user_id").withColumn("K", F.explode(F.array(*[F.lit(k) for k in ks])))
    listed = _hits(recs, test, threshold, max(ks), by).crossJoin(F.broadcast(total))
    listed = listed.withColumn("K", F.explode(F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: k >= F.col("recommendation_rank"))))
    gain = 1 / F.log2(F.col("pos") + 1.0)
    lists = listed.groupBy(*by, "K", "user_id").agg(
        F.count("*").alias("n"),
        F.sum("first_rel").alias("hits"),
        F.sum(F.col("rel") * gain).alias("dcg"),
        F.min(F.when(F.col("rel") == 1, F.col("pos"))).alias("first_pos"),
        F.sum(F.col("rel") * F.col("cum") / F.col("pos")).alias("ap"),
        F.avg("freq").alias("novelty"),
        F.avg(-F.log2(F.col("freq") / F.col("test_rows"))).alias("self_information"),
    )
    rows = users.join(lists, [*by, "K", "user_id"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_rel", "K").cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    some, hit = F.col("n_rel") > 0, F.col("hits") > 0
    return rows.withColumns({
        "precision": F.col("hits") / F.col("n"),
        "recall": F.when(some, F.col("hits") / F.col("n_rel")),
        "ndcg": F.when(some & F.col("n").isNotNull(), F.col("dcg") / ideal),
        "rr": F.when(hit, 1 / F.col("first_pos")),
        "ap": F.when(hit & some, F.col("ap") / F.col("n_rel")),
    })


def item_shares(recs: DataFrame, test: DataFrame, ks: Sequence[int] = KS, by: Sequence[str] = ()) -> DataFrame:
    """Coverage, Gini coefficient and entropy of the items in all lists, by K.

    The Gini sum runs over a histogram of frequencies, so no item list is ordered.
    """
    by = [*by, "K"]
    pairs = test.select("user_id", "item_id").distinct()
    listed = recs.where(F.col("recommendation_rank") <= max(ks)).join(pairs, ["user_id", "item_id"])
    listed = listed.withColumn("K", F.explode(F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: k >= F.col("recommendation_rank"))))
    bars = listed.groupBy(*by, "item_id").agg(F.count("*").alias("f")).groupBy(*by, "f").agg(F.count("*").alias("m"))
    order, whole = Window.partitionBy(*by).orderBy("f"), Window.partitionBy(*by)
    n, before = F.sum("m").over(whole), F.sum("m").over(order) - F.col("m")
    bars = bars.withColumns({"n": n, "total": F.sum(F.col("f") * F.col("m")).over(whole), "before": before})
    # sum of running totals: an item of place i of n is counted n - i + 1 times
    running = F.col("f") * (F.col("m") * (F.col("n") - F.col("before") + 1) - F.col("m") * (F.col("m") + 1) / 2)
    universe = test.agg(F.count_distinct("item_id").alias("universe"))
    rows = bars.groupBy(*by).agg(
        F.first("n").alias("n"), F.first("total").alias("total"), F.sum(running).alias("running"), F.sum(F.col("m") * F.col("f") * F.log2("f")).alias("flog")
    ).crossJoin(F.broadcast(universe))
    return rows.select(
        *by,
        (F.col("n") / F.col("universe")).alias("item_coverage"),
        ((F.col("n") + 1 - 2 * F.col("running") / F.col("total")) / F.col("n")).alias("gini"),
        (F.log2("total") - F.col("flog") / F.col("total")).alias("entropy"),
    )


def all_metrics(recs: DataFrame, test: DataFrame, ks: Sequence[int] = KS, threshold: float = 4.0, by: Sequence[str] = ()) -> DataFrame:
    """Every metric by K (and `by`)."""
    keys = [*by, "K"]
    rows = per_user(recs, test, ks, threshold, by).groupBy(*keys).agg(
        F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("ndcg").alias("ndcg"), F.avg("rr").alias("mrr"), F.avg("ap").alias("map"),
        (F.sum(F.when((F.col("hits") > 0) & (F.col("n_rel") > 0), 1).otherwise(0)) / F.sum(F.when(F.col("n_rel") > 0, 1))).alias("user_coverage"),
        F.avg("novelty").alias("novelty"), F.avg("self_information").alias("self_information"), F.var_samp("hits").alias("hit_variance"),
    )
    rows = rows.join(item_shares(recs, test, ks, by), keys, "left")
    p, r = F.coalesce("precision", F.lit(0.0)), F.coalesce("recall", F.lit(0.0))
    rows = rows.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))
    return rows.withColumns({"item_coverage": F.coalesce("item_coverage", F.lit(0.0)), "gini": F.coalesce("gini", F.lit(0.0)), "entropy": F.coalesce("entropy", F.lit(0.0))})


def report(recs: DataFrame, test: DataFrame, ks: Sequence[int] = KS, threshold: float = 4.0, by: Sequence[str] = ()) -> DataFrame:
    """The published columns."""
    columns = ["precision", "recall", "f1", "ndcg", "mrr", "map", "item_coverage", "novelty", F.col("gini").alias("item_fairness")]
    return all_metrics(recs, test, ks, threshold, by).select(*by, "K", *columns)


def by_module(recs: DataFrame, test: DataFrame, ks: Sequence[int] = KS, threshold: float = 4.0, modules: Sequence[str] = ()) -> DataFrame:
    """Metrics of each module's lists and of the merged lists ('ALL'), in one pass: the lists are told apart by `module`."""
    lists = merged_lists(recs).withColumn("module", F.lit("ALL"))
    for module in modules:
        lists = lists.unionByName(module_lists(recs, module).withColumn("module", F.lit(module)))
    return report(lists, test, ks, threshold, ["module"])


def long_form(metrics: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, metric, value) rows for plotting tools."""
    return metrics.unpivot(list(keys), list(columns), "metric", "value")
