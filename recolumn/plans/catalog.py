"""Queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..operators import agreement, blocks, cluster, embed, graph, metrics, recommend, rerank, simulate
from ..operators import relational as R
from ..sources import tables
from ..sources.work import held, scratch
from . import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
KS = (5, 10, 20)
N = 20


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


def _with(*parts: str) -> str:
    return "WITH " + ",".join([views.INTERACTIONS, *parts]) + "\n"


def _r(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


def _rs(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def _long(rows: DataFrame, *names: str) -> DataFrame:
    return rows.withColumns({n: F.col(n).cast("long") for n in names})


def _popular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.popular_unseen(views.train(spark, sf_dir), N)


def _rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best rated items, for users with more than 40 training rows."""
    train = views.train(spark, sf_dir)
    liked = train.groupBy("item_id").agg(F.round(F.avg("rating"), 9).alias("s")).orderBy(F.desc("s"), "item_id").limit(N)
    liked = liked.select("item_id", F.row_number().over(Window.orderBy(F.desc("s"), "item_id")).alias("recommendation_rank"))
    users = train.groupBy("user_id").agg(F.count("*").alias("n")).where("n > 40").select("user_id")
    return users.crossJoin(F.broadcast(liked)).select("user_id", "item_id", "recommendation_rank", F.lit("rating").alias("module_source"))


# -- ranking metrics


def _metric_query(name: str, columns: list[str], ks: tuple[int, ...] = KS) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = metrics.all_metrics(_popular(spark, sf_dir), views.test(spark, sf_dir), ks)
        return _long(rows.select("K", *_r(*columns)), "K")

    run.__name__ = name
    query(_with(views.POPULAR, views.metrics_sql("popular", ks)) + f"SELECT CAST(K AS BIGINT) AS K, {_rs(*columns)} FROM metrics")(run)


_metric_query("popularity_metrics", ["precision", "recall", "f1"], (5, 10))
_metric_query("precision_recall_f1", ["precision", "recall", "f1"])
_metric_query("ndcg", ["ndcg"])
_metric_query("mrr_map", ["mrr", "map"])
_metric_query("coverage_user_item", ["user_coverage", "item_coverage"])
_metric_query("novelty_selfinfo", ["novelty", "self_information"])
_metric_query("fairness_gini_entropy", ["gini", "entropy"])
_metric_query("hit_variance", ["hit_variance"])
_metric_query("metrics_all_k", ["precision", "recall", "f1", "ndcg", "mrr", "map", "item_coverage", "novelty", "gini"], (5, 10, 20))

_MODULES = """
recs AS (SELECT * FROM popular UNION ALL SELECT * FROM rated),
merged AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY recommendation_rank, module_source, item_id) AS recommendation_rank FROM recs),
lists AS (
  SELECT 'ALL' AS module, user_id, item_id, recommendation_rank FROM merged
  UNION ALL SELECT 'popularity', user_id, item_id, recommendation_rank FROM popular
  UNION ALL SELECT 'rating', user_id, item_id, recommendation_rank FROM rated
  UNION ALL SELECT 'rating', user_id, item_id, recommendation_rank FROM merged WHERE user_id NOT IN (SELECT user_id FROM rated)
  UNION ALL SELECT 'popularity', user_id, item_id, recommendation_rank FROM merged WHERE user_id NOT IN (SELECT user_id FROM popular))"""
_PUBLISHED = ["precision", "recall", "f1", "ndcg", "mrr", "map", "item_coverage", "novelty"]


@query(_with(views.POPULAR, _MODULES, views.metrics_sql("lists", KS, "module, ")) + f"SELECT module, CAST(K AS BIGINT) AS K, {_rs(*_PUBLISHED)}, round(gini, 6) AS item_fairness FROM metrics")
def metrics_by_module_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs = _popular(spark, sf_dir).unionByName(_rated(spark, sf_dir))
    rows = metrics.by_module(recs, views.test(spark, sf_dir), KS, modules=["popularity", "rating"])
    return _long(rows.select("module", "K", *_r(*_PUBLISHED, "item_fairness")), "K")


@query(_with(views.POPULAR, views.metrics_sql("popular", KS)) + f"""SELECT CAST(K AS BIGINT) AS K, metric, value FROM (SELECT K, {_rs("precision", "recall", "ndcg")} FROM metrics)
UNPIVOT (value FOR metric IN (precision, recall, ndcg))""")  # fmt: skip
def metric_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.all_metrics(_popular(spark, sf_dir), views.test(spark, sf_dir), KS).select("K", *_r("precision", "recall", "ndcg"))
    return _long(metrics.long_form(rows, ["K"], ["precision", "recall", "ndcg"]), "K")


@query(_with(views.POPULAR, """
joint AS (SELECT 'popularity' AS recommender, user_id, item_id, recommendation_rank FROM popular UNION ALL SELECT 'rating', user_id, item_id, recommendation_rank FROM rated)""",
    views.metrics_sql("joint", KS, "recommender, ")) + f"SELECT recommender, CAST(K AS BIGINT) AS K, {_rs('precision', 'recall', 'ndcg', 'map', 'item_coverage', 'novelty')} FROM metrics")
def recommender_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _popular(spark, sf_dir).unionByName(_rated(spark, sf_dir)).withColumnRenamed("module_source", "recommender")
    rows = metrics.all_metrics(both, views.test(spark, sf_dir), KS, by=["recommender"])
    return _long(rows.select("recommender", "K", *_r("precision", "recall", "ndcg", "map", "item_coverage", "novelty")), "K")


# The events table has no user with fewer than 6 training rows at the larger scales, so the cohort uses the sparse purchases as well.
@query("WITH " + views.PURCHASES + " SELECT user_id FROM purchases WHERE l_linenumber % 4 <> 0 GROUP BY user_id HAVING count(*) < 6")
def coldstart_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cold_start_users(views.purchases(spark, sf_dir).where("l_linenumber % 4 <> 0"))


_COLD = 40


@query(_with(views.POPULAR, f"""
cold AS (SELECT user_id FROM train GROUP BY user_id HAVING count(*) < {_COLD}),
coldtest AS (SELECT * FROM test WHERE user_id IN (SELECT user_id FROM cold))""", views.metrics_sql("popular", KS, test="coldtest"))
    + f"SELECT CAST(K AS BIGINT) AS K, {_rs('precision', 'recall', 'f1', 'ndcg', 'map', 'item_coverage')} FROM metrics")
def coldstart_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    cold = R.cold_start_users(views.train(spark, sf_dir), _COLD)
    test = views.test(spark, sf_dir).join(cold, "user_id", "left_semi")
    return _long(metrics.all_metrics(_popular(spark, sf_dir), test, KS).select("K", *_r("precision", "recall", "f1", "ndcg", "map", "item_coverage")), "K")


@query(_with(views.POPULAR) + "SELECT user_id, item_id, recommendation_rank FROM popular")
def popularity_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_popular(spark, sf_dir).select("user_id", "item_id", "recommendation_rank"), "recommendation_rank")


# -- rating agreement, with the rounded mean training rating of the item as the prediction

_PREDICTED = """
means AS (SELECT item_id, CAST(floor(round(avg(rating), 9) + 0.5) AS INTEGER) AS predicted FROM train GROUP BY item_id),
pairs AS (SELECT user_id, t.item_id, CAST(rating AS INTEGER) AS actual, CASE WHEN (user_id + t.item_id) % 3 = 0 THEN greatest(predicted - 1, 1) WHEN (user_id + t.item_id) % 7 = 0 THEN 5 ELSE predicted END AS predicted
  FROM test t JOIN means USING (item_id))"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = F.floor(F.round(F.avg("rating"), 9) + 0.5).cast("int")
    means = views.train(spark, sf_dir).groupBy("item_id").agg(mean.alias("predicted"))
    key = F.col("user_id") + F.col("item_id")
    varied = F.when(key % 3 == 0, F.greatest(F.col("predicted") - 1, F.lit(1))).when(key % 7 == 0, 5).otherwise(F.col("predicted"))
    return views.test(spark, sf_dir).join(means, "item_id").select("user_id", "item_id", F.col("rating").alias("actual"), varied.alias("predicted"))


@query(_with(_PREDICTED) + """
SELECT count(*) AS n, round(sqrt(avg((actual - predicted) ** 2)), 6) AS rmse, round(avg(abs(actual - predicted)), 6) AS mae,
  round(1 - sum((actual - predicted) ** 2) / (sum(actual * actual) - sum(actual) * sum(actual) / count(*)), 6) AS r2 FROM pairs""")  # fmt: skip
def rating_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.summary(_pairs(spark, sf_dir)).select("n", *_r("rmse", "mae", "r2"))


@query(_with(_PREDICTED) + """
SELECT count(*) FILTER (actual = predicted) AS exact, count(*) FILTER (abs(actual - predicted) = 1) AS off_by_one, count(*) FILTER (abs(actual - predicted) > 1) AS off_by_more,
  round(100.0 * count(*) FILTER (abs(actual - predicted) <= 1) / count(*), 6) AS close_percent,
  round(avg(CASE abs(actual - predicted) WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 ELSE 0.0 END), 6) AS weighted_accuracy FROM pairs""")  # fmt: skip
def match_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.summary(_pairs(spark, sf_dir)).select("exact", "off_by_one", "off_by_more", *_r("close_percent", "weighted_accuracy"))


@query(_with(_PREDICTED, """
ranked AS (SELECT rank() OVER (ORDER BY actual) + (count(*) OVER (PARTITION BY actual) - 1) / 2 AS x, rank() OVER (ORDER BY predicted) + (count(*) OVER (PARTITION BY predicted) - 1) / 2 AS y FROM pairs)""")
    + "SELECT count(*) AS n, round(corr(x, y), 6) AS spearman FROM ranked")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.spearman(_pairs(spark, sf_dir)).select("n", *_r("spearman"))


@query(_with(_PREDICTED) + """
SELECT count(*) AS n, round(1 - avg((actual - predicted) ** 2) / (SELECT avg((a.actual - b.predicted) ** 2) FROM pairs a, pairs b), 6) AS kappa FROM pairs""")  # fmt: skip
def quadratic_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.quadratic_kappa(_pairs(spark, sf_dir)).select("n", *_r("kappa"))


@query(_with(_PREDICTED) + """
SELECT user_id, count(*) AS n, round(sqrt(avg((actual - predicted) ** 2)), 6) AS rmse, round(avg(CASE WHEN actual = predicted THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM pairs GROUP BY user_id""")  # fmt: skip
def per_user_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.per_user(_pairs(spark, sf_dir)).select("user_id", "n", *_r("rmse", "accuracy"))


@query("""
WITH calls AS (SELECT conv_id, sum(CASE WHEN role <> 'assistant' THEN greatest(1, length(text) // 4) ELSE 0 END) AS p, sum(CASE WHEN role = 'assistant' THEN greatest(1, length(text) // 4) ELSE 0 END) AS c FROM conversations GROUP BY conv_id)
SELECT count(*) AS calls, CAST(sum(p) AS BIGINT) AS prompt_tokens, CAST(sum(c) AS BIGINT) AS completion_tokens, round(sum(p) * 0.15 / 1e6 + sum(c) * 0.60 / 1e6, 6) AS cost FROM calls""")  # fmt: skip
def token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens, own = X.token_estimate(F.col("text")), F.col("role") == "assistant"
    calls = views.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.sum(F.when(own, 0).otherwise(tokens)).alias("prompt_tokens"), F.sum(F.when(own, tokens).otherwise(0)).alias("completion_tokens")
    )
    return agreement.token_cost(calls).select("calls", "prompt_tokens", "completion_tokens", *_r("cost"))


# -- relational family


@query(_with() + """
SELECT user_id, item_id, rating, recency, title FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id DESC) AS recency FROM train) JOIN catalog USING (item_id) WHERE recency <= 10""")  # fmt: skip
def last_n_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simulate.recent_with_text(views.train(spark, sf_dir), views.catalog(spark, sf_dir), 10)
    return _long(rows.select("user_id", "item_id", "rating", "recency", "title"), "recency")


@query(_with() + """
SELECT user_id, item_id, polarity, recency FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, polarity ORDER BY ts DESC, item_id DESC) AS recency
  FROM (SELECT *, CASE WHEN rating >= 4 THEN 'positive' WHEN rating <= 2 THEN 'negative' END AS polarity FROM train) WHERE polarity IS NOT NULL) WHERE recency <= 5""")  # fmt: skip
def last_n_pos_neg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(simulate.recent_by_polarity(views.train(spark, sf_dir), 5).select("user_id", "item_id", "polarity", "recency"), "recency")


@query(_with() + """
SELECT user_id, item_id, rating, 41 - recency AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id DESC) AS recency FROM train) WHERE recency <= 40""")  # fmt: skip
def recent40(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simulate.recent(views.train(spark, sf_dir), 40).withColumn("place", 41 - F.col("recency"))
    return _long(rows.select("user_id", "item_id", "rating", "place"), "place")


@query(_with() + "SELECT user_id, item_id, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM train) WHERE place <= 3")
def head_n_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(R.top_n(views.train(spark, sf_dir), ["user_id"], [F.asc("event_id")], 3, "place").select("user_id", "item_id", "place"), "place")


@query(_with() + "SELECT user_id, item_id, rating FROM interactions WHERE item_id IN (SELECT item_id FROM catalog)")
def catalog_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.interactions(spark, sf_dir).join(views.catalog(spark, sf_dir), "item_id", "left_semi").select("user_id", "item_id", "rating")


@query("WITH " + views.PURCHASES + """, tr AS (SELECT * FROM purchases WHERE l_linenumber % 4 <> 0)
SELECT user_id, item_id FROM purchases WHERE l_linenumber % 4 = 0 AND user_id IN (SELECT user_id FROM tr) AND item_id IN (SELECT item_id FROM tr)""")  # fmt: skip
def train_overlap_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = held(views.last_lines(spark, sf_dir))  # read three times
    return R.train_overlap(rows.where("l_linenumber % 4 = 0"), rows.where("l_linenumber % 4 <> 0")).select("user_id", "item_id")


@query(_with(views.POPULAR) + """
SELECT user_id, item_id, rating FROM test UNION ALL SELECT user_id, item_id, NULL FROM popular p WHERE NOT EXISTS (SELECT 1 FROM test t WHERE t.user_id = p.user_id AND t.item_id = p.item_id)""")  # fmt: skip
def enrich_test_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.enrich_with_missing(views.test(spark, sf_dir).select("user_id", "item_id", "rating"), _popular(spark, sf_dir))


@query(_with(views.POPULAR) + """
SELECT user_id, item_id, recommendation_rank, source FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY priority, recommendation_rank) AS rn
  FROM (SELECT user_id, item_id, recommendation_rank, 'rating' AS source, 0 AS priority FROM rated UNION ALL SELECT user_id, item_id, recommendation_rank, 'popularity', 1 FROM popular)) WHERE rn = 1""")  # fmt: skip
def union_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = {"rating": _rated(spark, sf_dir).drop("module_source"), "popularity": _popular(spark, sf_dir).drop("module_source")}
    return _long(tables.union_first_wins(both).select("user_id", "item_id", "recommendation_rank", "source"), "recommendation_rank")


@query(_with(views.POPULAR) + "SELECT user_id, item_id FROM rated r WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.user_id = r.user_id AND t.item_id = r.item_id)")
def seen_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.seen_removed(_rated(spark, sf_dir), views.train(spark, sf_dir)).select("user_id", "item_id")


@query(_with("""
s AS (SELECT user_id, l.item_id, s AS score FROM (SELECT item_id, round(avg(rating), 6) AS s FROM train GROUP BY item_id) l, (SELECT DISTINCT user_id FROM train)),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS r FROM s) WHERE r <= 20)""") + """
SELECT user_id, item_id, score, recommendation_rank FROM (
  SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS recommendation_rank
  FROM f WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.user_id = f.user_id AND t.item_id = f.item_id)) WHERE recommendation_rank <= 10""")  # fmt: skip
def overfetch_filter_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = views.train(spark, sf_dir)
    # the same score for all users: only the first 2 n items can be fetched by anyone
    scores = train.groupBy("item_id").agg(F.round(F.avg("rating"), 6).alias("score")).orderBy(F.desc("score"), "item_id").limit(20)
    rows = train.select("user_id").distinct().crossJoin(F.broadcast(scores))
    return _long(R.over_fetch(rows, train, 10).select("user_id", "item_id", "score", "recommendation_rank"), "recommendation_rank")


@query(_with(views.POPULAR) + """
SELECT p.user_id, p.item_id, coalesce(r.recommendation_rank, p.recommendation_rank) AS recommendation_rank FROM popular p LEFT JOIN rated r ON p.user_id = r.user_id AND p.item_id = r.item_id""")  # fmt: skip
def update_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.update_by_key(_popular(spark, sf_dir), _rated(spark, sf_dir), ["user_id", "item_id"], ["recommendation_rank"])
    return _long(rows.select("user_id", "item_id", "recommendation_rank"), "recommendation_rank")


@query("""
WITH named AS (SELECT p_name, p_type FROM (SELECT p_name, p_type, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS rn FROM part) WHERE rn = 1)
SELECT p_partkey, part.p_name, named.p_type AS info FROM part LEFT JOIN named ON part.p_name = named.p_name AND named.p_type LIKE '%E%'""")  # fmt: skip
def left_join_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = views.table(spark, sf_dir, "part")
    info = R.first_wins(part.select("p_name", "p_partkey", "p_type"), ["p_name"], ["p_partkey"]).where("p_type like '%E%'").select("p_name", F.col("p_type").alias("info"))
    return part.select("p_partkey", "p_name").join(info, "p_name", "left").select("p_partkey", "p_name", "info")


@query(_with() + """
SELECT user_id, item_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts, item_id) > count(*) OVER (PARTITION BY user_id) - CAST(floor(count(*) OVER (PARTITION BY user_id) * 0.1) AS BIGINT) THEN 'eval' ELSE 'train' END AS part FROM train""")  # fmt: skip
def ratio_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ratio_split(views.train(spark, sf_dir), "user_id", [F.asc("ts"), F.asc("item_id")]).select("user_id", "item_id", "part")


@query(_with(views.POPULAR) + """
SELECT user_id, item_id, coalesce(title, 'unknown item') AS title FROM popular LEFT JOIN catalog USING (item_id)""")  # fmt: skip
def lookup_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.lookup(_popular(spark, sf_dir), views.catalog(spark, sf_dir), "item_id", "title", "unknown item").select("user_id", "item_id", "title")


@query(_with(views.POPULAR) + """
SELECT DISTINCT user_id, item_id FROM interactions i WHERE NOT EXISTS (SELECT 1 FROM popular p WHERE p.user_id = i.user_id AND p.item_id = i.item_id) AND rating >= 4""")  # fmt: skip
def resumable_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = views.interactions(spark, sf_dir).where("rating >= 4").select("user_id", "item_id")
    return R.pending(work, _popular(spark, sf_dir), ["user_id", "item_id"])


@query("WITH " + views.PURCHASES + " SELECT user_id, count(*) AS n, round(avg(rating), 6) AS mean_rating, max(rating) AS top_rating FROM purchases GROUP BY user_id")
def purchase_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.purchases(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg("rating"), 6).alias("mean_rating"), F.max("rating").alias("top_rating"))


# -- vectors and content recommenders

_UV = f"""
liked5 AS (SELECT user_id, i.vector FROM train JOIN items i USING (item_id) WHERE rating IN (4, 5)),
up AS (SELECT user_id, p, avg(vector[p]) AS x FROM liked5, (SELECT unnest(range(1, {views.WIDTH + 1})) AS p) GROUP BY user_id, p),
uv AS (SELECT u.user_id, coalesce(vector, list_transform(range(0, {views.WIDTH}), lambda i: 0.0::DOUBLE)) AS vector FROM (SELECT DISTINCT user_id FROM train) u
  LEFT JOIN (SELECT user_id, list(x ORDER BY p) AS vector FROM up GROUP BY user_id) USING (user_id))"""
_COSINE = "CASE WHEN list_dot_product(a.vector, a.vector) > 0 AND list_dot_product(b.vector, b.vector) > 0 THEN list_dot_product(a.vector, b.vector) / (sqrt(list_dot_product(a.vector, a.vector)) * sqrt(list_dot_product(b.vector, b.vector))) ELSE 0 END"


def _user_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.user_vectors(views.train(spark, sf_dir), views.items(spark, sf_dir).select("item_id", "vector"), views.WIDTH)


@query(_with(_UV) + "SELECT user_id, p, round(vector[p], 6) AS x FROM uv, (SELECT unnest(range(1, 65)) AS p)")
def user_mean_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _user_vectors(spark, sf_dir).select("user_id", F.posexplode("vector").alias("p", "x"))
    return rows.select("user_id", (F.col("p") + 1).cast("long").alias("p"), F.round("x", 6).alias("x"))


@query(_with(_UV) + f"""
SELECT user_id, item_id, recommendation_rank, floor(s * 1e6 + 0.5) / 1e6 AS score FROM (
  SELECT user_id, item_id, s, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, item_id) AS recommendation_rank
  FROM (SELECT a.user_id, b.item_id, round({_COSINE}, 10) AS s FROM uv a, items b)) WHERE recommendation_rank <= 50""")  # fmt: skip
def user_cosine_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = recommend.profile_top_n(_user_vectors(spark, sf_dir), views.items(spark, sf_dir), 50)
    return _long(rows.select("user_id", "item_id", "recommendation_rank", "score"), "recommendation_rank")


@query(_with() + f"""
SELECT item_id, neighbour, rank, score FROM (
  SELECT a.item_id, b.item_id AS neighbour, floor(round({_COSINE}, 10) * 1e6 + 0.5) / 1e6 AS score, row_number() OVER (PARTITION BY a.item_id ORDER BY floor(round({_COSINE}, 10) * 1e6 + 0.5) / 1e6 DESC, b.item_id) AS rank
  FROM items a JOIN items b ON a.item_id <> b.item_id) WHERE rank <= 10""")  # fmt: skip
def item_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(recommend.item_neighbours(views.items(spark, sf_dir), 10).select("item_id", "neighbour", "rank", "score"), "rank")


_SHARES = """
pos AS (SELECT user_id, item_id, CASE WHEN label = 0 THEN -1 ELSE label END AS cluster, vector FROM train JOIN items USING (item_id) WHERE rating IN (4, 5)),
shares AS (SELECT user_id, cluster, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS share FROM pos GROUP BY user_id, cluster)"""


def _positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positives with the item's label as the cluster; label 0 stands for noise."""
    items = views.items(spark, sf_dir)
    label = F.when(F.col("label") == 0, -1).otherwise(F.col("label")).alias("cluster")
    return views.train(spark, sf_dir).where(F.col("rating").isin(4, 5)).join(items, "item_id").select("user_id", "item_id", label)


@query(_with(_SHARES) + "SELECT user_id, cluster, n, round(share, 6) AS share FROM shares")
def cluster_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.cluster_shares(_positives(spark, sf_dir)).select("user_id", "cluster", "n", *_r("share"))


_KNN = f"""
quotas AS (SELECT user_id, cluster, CAST(greatest(1, round_even(share * 50, 0)) AS INTEGER) AS quota FROM shares WHERE cluster <> -1),
rich AS (SELECT user_id FROM pos GROUP BY user_id HAVING count(DISTINCT item_id) >= 5),
cc AS (SELECT user_id, cluster, list(x ORDER BY p) AS vector FROM (SELECT user_id, cluster, p, avg(vector[p]) AS x FROM pos, (SELECT unnest(range(1, {views.WIDTH + 1})) AS p) WHERE cluster <> -1 AND user_id IN (SELECT user_id FROM rich) GROUP BY user_id, cluster, p) GROUP BY user_id, cluster),
near AS (SELECT user_id, item_id, score FROM (
  SELECT a.user_id, a.cluster, b.item_id, round({_COSINE}, 10) AS score, row_number() OVER (PARTITION BY a.user_id, a.cluster ORDER BY round({_COSINE}, 10) DESC, b.item_id) AS r FROM cc a, items b) JOIN quotas USING (user_id, cluster) WHERE r <= quota),
seen AS (SELECT user_id, item_id FROM train WHERE rating IN (1, 2, 4, 5)),
mv AS (SELECT user_id, list(x ORDER BY p) AS vector FROM (SELECT user_id, p, avg(vector[p]) AS x FROM pos, (SELECT unnest(range(1, {views.WIDTH + 1})) AS p) GROUP BY user_id, p) GROUP BY user_id),
plain AS (SELECT user_id, item_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS r FROM (SELECT a.user_id, b.item_id, round({_COSINE}, 10) AS score FROM mv a, items b) x
  WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.user_id = x.user_id AND s.item_id = x.item_id)) WHERE r <= 50),
joint AS (SELECT user_id, item_id, max(score) AS score, min(late) AS late FROM (
  SELECT user_id, item_id, score, 0 AS late FROM near x WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.user_id = x.user_id AND s.item_id = x.item_id) UNION ALL SELECT user_id, item_id, score, 1 FROM plain) GROUP BY user_id, item_id),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY late, score DESC, item_id) AS place FROM joint) WHERE place <= 50)"""


@query(_with(_SHARES, _KNN) + "SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS recommendation_rank, floor(score * 1e6 + 0.5) / 1e6 AS score FROM kept")
def cluster_quota_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = views.train(spark, sf_dir).where(F.col("rating").isin(1, 2, 4, 5)).select("user_id", "item_id")
    rows = recommend.clustered_knn(_positives(spark, sf_dir), views.items(spark, sf_dir).select("item_id", "vector"), seen, views.WIDTH)
    return _long(rows.select("user_id", "item_id", "recommendation_rank", "score"), "recommendation_rank")


@query()
def hdbscan_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, items = views.train(spark, sf_dir), views.items(spark, sf_dir).select("item_id", "vector")
    found = cluster.user_clusters(train.where(F.col("rating").isin(4, 5)), items)
    seen = train.where(F.col("rating").isin(1, 2, 4, 5)).select("user_id", "item_id")
    return recommend.clustered_knn(found, items, seen, views.WIDTH)


@query(
    _with("ln AS (SELECT item_id, p, (x - avg(x) OVER w) / sqrt(var_pop(x) OVER w + 1e-5) AS y FROM (SELECT item_id, p, vector[p] AS x FROM items, (SELECT unnest(range(1, 65)) AS p)) WINDOW w AS (PARTITION BY item_id))")
    + "SELECT item_id, p, round(y / sqrt(sum(y * y) OVER (PARTITION BY item_id)), 5) AS x FROM ln")
def embedding_finish(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.items(spark, sf_dir).select("item_id", F.posexplode(V.embedding_finish(F.col("vector"))).alias("p", "x"))
    return rows.select("item_id", (F.col("p") + 1).cast("long").alias("p"), "x")


# -- graph

#: 64 seeded values of N(0, 1) for each id of the relation `own`.
NORMALS = """
  SELECT id, list(sqrt(-2 * ln(u1)) * CASE WHEN p % 2 = 0 THEN cos(2 * pi() * u2) ELSE sin(2 * pi() * u2) END ORDER BY p) AS vector FROM (
    SELECT id, p, (('0x' || substr(h, 1, 13))::BIGINT + 0.5) / 4503599627370496 AS u1, (('0x' || substr(h, 14, 13))::BIGINT + 0.5) / 4503599627370496 AS u2
    FROM (SELECT id, p, md5('42:' || id || ':' || (p // 2)) AS h FROM own, (SELECT unnest(range(64)) AS p))) GROUP BY id"""
_EDGES = """
edges AS (SELECT 'u' || user_id AS src, 'i' || item_id AS dst, CAST(rating AS DOUBLE) AS w FROM train UNION ALL SELECT 'i' || item_id, 'u' || user_id, CAST(rating AS DOUBLE) FROM train),
degrees AS (SELECT src, count(*) AS d FROM edges GROUP BY src),
norms AS (SELECT e.src, e.dst, 1 / sqrt(a.d * b.d) AS norm FROM edges e JOIN degrees a ON a.src = e.src JOIN degrees b ON b.src = e.dst),
own AS (SELECT DISTINCT 'u' || user_id AS id FROM train),
nodes AS (SELECT 'i' || item_id AS id, vector FROM items WHERE item_id IN (SELECT item_id FROM train)
  UNION ALL """ + NORMALS + """)"""


def _nodes(spark: SparkSession, sf_dir: str, train: DataFrame | None = None) -> DataFrame:
    """64 features for each node: the item's vector, or seeded normal values for users."""
    train = views.train(spark, sf_dir) if train is None else train
    items = views.items(spark, sf_dir).join(train, "item_id", "left_semi").select(F.concat(F.lit("i"), "item_id").alias("id"), V.doubles(F.col("vector")).alias("vector"))
    users = train.select(F.concat(F.lit("u"), "user_id").alias("id")).distinct()
    return items.unionByName(users.select("id", V.normals(F.col("id"), views.WIDTH).alias("vector")))


@query(_with(_EDGES) + "SELECT src, dst, w FROM edges")
def bipartite_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.bipartite_edges(views.train(spark, sf_dir))


@query(_with(_EDGES) + "SELECT src, dst, round(norm, 6) AS norm FROM norms")
def degree_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degree_norm(graph.bipartite_edges(views.train(spark, sf_dir))).select("src", "dst", *_r("norm"))


_LAYERS = ["l0 AS (SELECT id, p, vector[p] AS x FROM nodes, (SELECT unnest(range(1, 65)) AS p))"] + [
    f"l{k} AS (SELECT l0.id, l0.p, coalesce(s.x, 0) AS x FROM l0 LEFT JOIN (SELECT dst AS id, p, sum(x * norm) AS x FROM norms JOIN l{k - 1} ON id = src GROUP BY dst, p) s ON s.id = l0.id AND s.p = l0.p)" for k in (1, 2, 3)
]


@query(_with(_EDGES, *_LAYERS) + "SELECT id, p, round((l0.x + l1.x + l2.x + l3.x) / 4, 6) AS x FROM l0 JOIN l1 USING (id, p) JOIN l2 USING (id, p) JOIN l3 USING (id, p)")
def lightgcn_propagate(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch() as keep:
        train = keep(views.train(spark, sf_dir).select("user_id", "item_id", "rating"))  # read for edges, degrees and nodes
        edges = graph.degree_norm(graph.bipartite_edges(train))
        rows = blocks.propagate(edges, _nodes(spark, sf_dir, train), views.WIDTH).select("id", F.posexplode("vector").alias("p", "x"))
    return rows.select("id", (F.col("p") + 1).cast("long").alias("p"), *_r("x"))


@query(_with(_EDGES, """
sums AS (SELECT dst AS id, p, sum(norm * b.vector[p]) + sum(norm * a.vector[p] * b.vector[p]) AS m FROM norms JOIN nodes b ON b.id = src JOIN nodes a ON a.id = dst, (SELECT unnest(range(1, 65)) AS p) GROUP BY dst, p),
single AS (SELECT id, p, vector[p] + coalesce(m, 0) AS v FROM (SELECT id, vector, p FROM nodes, (SELECT unnest(range(1, 65)) AS p)) LEFT JOIN sums USING (id, p))""")
    + "SELECT id, p, round(CASE WHEN v > 0 THEN v ELSE 0.01 * v END, 6) AS value FROM single")
def ngcf_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graph.degree_norm(graph.bipartite_edges(views.train(spark, sf_dir)))
    return graph.ngcf_layer(edges, _nodes(spark, sf_dir)).select("id", (F.col("pos") + 1).cast("long").alias("p"), *_r("value"))


@query(_with(_EDGES, """
loops AS (SELECT src, dst, w FROM edges UNION ALL SELECT dst, dst, avg(w) FROM edges GROUP BY dst),
scores AS (SELECT src, dst, list_sum(list_transform(range(1, 65), lambda p: CASE WHEN a.vector[p] + b.vector[p] + w > 0 THEN a.vector[p] + b.vector[p] + w ELSE 0.2 * (a.vector[p] + b.vector[p] + w) END)) AS e
  FROM loops JOIN nodes b ON b.id = src JOIN nodes a ON a.id = dst),
z AS (SELECT src, dst, exp(e - max(e) OVER (PARTITION BY dst)) AS z FROM scores)""") + "SELECT src, dst, round(z / sum(z) OVER (PARTITION BY dst), 6) AS alpha FROM z")  # fmt: skip
def gat_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.gat_attention(graph.bipartite_edges(views.train(spark, sf_dir)), _nodes(spark, sf_dir)).select("src", "dst", *_r("alpha"))


#: Ranks of items, and the rank that a walk reaches at step t from the start s.
WALK = f"""
ranks AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS r FROM (SELECT DISTINCT item_id FROM train)),
steps AS (SELECT unnest(range(0, (SELECT count(*) FROM ranks))) AS t, (SELECT count(*) FROM ranks) AS total)"""
_REACHED = f"(s // 4 + t * ({list(graph.STEPS)}[s % 4 + 1] % total)) % total"


@query(_with(WALK, """
starts AS (SELECT user_id, ('0x' || substr(md5('42:' || user_id), 1, 15))::BIGINT AS s FROM (SELECT DISTINCT user_id FROM train)),
walk AS (SELECT user_id, t, """ + _REACHED + """ AS r FROM starts, steps),
free AS (SELECT user_id, item_id, t FROM walk JOIN ranks USING (r) WHERE NOT EXISTS (SELECT 1 FROM train x WHERE x.user_id = walk.user_id AND x.item_id = ranks.item_id))""")
    + "SELECT user_id, item_id, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) AS place FROM free) WHERE place <= 5")
def negative_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(graph.negatives(views.train(spark, sf_dir), 5), "place")


#: One item for each positive rating, not rated well or badly by the user.
DRAWN = """
starts AS (SELECT user_id, item_id AS good, ('0x' || substr(md5('42:0:' || user_id || ':' || item_id), 1, 15))::BIGINT AS s FROM train WHERE rating >= 4),
walk AS (SELECT user_id, good, t, """ + _REACHED + """ AS r FROM starts, steps),
drawn AS (SELECT user_id, good, arg_min(item_id, t) AS bad FROM walk JOIN ranks USING (r)
  WHERE NOT EXISTS (SELECT 1 FROM train x WHERE x.user_id = walk.user_id AND x.item_id = ranks.item_id AND (x.rating >= 4 OR x.rating <= 2)) GROUP BY user_id, good)"""


def _drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = views.train(spark, sf_dir)
    ranks = graph.item_ranks(train)
    good = train.where("rating >= 4").select("user_id", F.col("item_id").alias("good"))
    return graph.sampled_pairs(good, train.where("rating >= 4 or rating <= 2").select("user_id", "item_id"), ranks, ranks.count())


@query(_with(WALK, DRAWN) + "SELECT user_id, good, bad FROM drawn")
def sampled_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One negative for every positive rating, as a training epoch draws them."""
    return _drawn(spark, sf_dir)


@query(_with(_EDGES, WALK, DRAWN) + """, x AS (SELECT d.user_id, good, bad, list_dot_product(u.vector, a.vector) - list_dot_product(u.vector, b.vector) AS x FROM drawn d
  JOIN nodes u ON u.id = 'u' || d.user_id JOIN nodes a ON a.id = 'i' || good JOIN nodes b ON b.id = 'i' || bad)
SELECT user_id, good, bad, round(CASE WHEN x >= 0 THEN ln(1 + exp(-x)) ELSE -x + ln(1 + exp(x)) END, 6) AS loss FROM x""")  # fmt: skip
def bpr_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir).withColumn("key", F.expr("substring(id, 2)").cast("long"))
    users, items = (nodes.where(F.col("id").startswith(k)).select(F.col("key").alias(name), "vector") for k, name in (("u", "user_id"), ("i", "item_id")))
    return graph.pair_losses(_drawn(spark, sf_dir), users, items).select("user_id", "good", "bad", *_r("loss"))


# -- scalar functions


@query("""
SELECT o_orderkey, CASE WHEN s IS NULL THEN '' WHEN regexp_extract(s, '(19|20)\\d{2}', 0) <> '' THEN regexp_extract(s, '(19|20)\\d{2}', 0)
  WHEN regexp_matches(s[1:4], '^\\d{4}$') AND TRY_CAST(s[1:4] AS INTEGER) BETWEEN 1900 AND 2100 THEN s[1:4] ELSE '' END AS year
FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%d-%m-%Y') WHEN 1 THEN strftime(o_orderdate, '%Y/%m') WHEN 2 THEN 'unknown' END AS s FROM orders)""")  # fmt: skip
def year_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, F.date_format("o_orderdate", "dd-MM-yyyy")).when(k == 1, F.date_format("o_orderdate", "yyyy/MM")).when(k == 2, "unknown")
    return views.table(spark, sf_dir, "orders").select("o_orderkey", X.year(text).alias("year"))


_LINES = """
replies AS (SELECT user_id, string_agg(CASE WHEN recommendation_rank % 4 = 3 THEN '  ' || coalesce(title, 'item ' || item_id) ELSE recommendation_rank || '. ' || coalesce(title, 'Item ' || item_id || '!') || CASE WHEN item_id % 2 = 0 THEN ' (1995)' ELSE '' END END, chr(10) ORDER BY (item_id * 37) % 101, item_id) || chr(10) || '2. ' AS reply
  FROM popular LEFT JOIN catalog USING (item_id) WHERE recommendation_rank <= 10 GROUP BY user_id),
split AS (SELECT user_id, generate_subscripts(ls, 1) AS line, unnest(ls) AS t FROM (SELECT user_id, string_split(reply, chr(10)) AS ls FROM replies)),
lines AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY line) AS llm_rank, title FROM (
  SELECT user_id, line, nullif(CASE WHEN regexp_matches(t, '^\\s*\\d+\\.\\s*(.*?)(?:\\s*\\(\\d{4}\\))?$') THEN regexp_extract(t, '^\\s*\\d+\\.\\s*(.*?)(?:\\s*\\(\\d{4}\\))?$', 1) ELSE regexp_replace(t, '^\\s+|\\s+$', '', 'g') END, '') AS title FROM split) WHERE title IS NOT NULL)"""


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered-line replies made from each user's first ten candidates, in another order and with some lines unnumbered."""
    own = _popular(spark, sf_dir).where("recommendation_rank <= 10").join(views.catalog(spark, sf_dir), "item_id", "left")
    name = F.concat(F.col("recommendation_rank"), F.lit(". "), F.coalesce("title", F.concat(F.lit("Item "), "item_id", F.lit("!"))), F.when(F.col("item_id") % 2 == 0, " (1995)").otherwise(""))
    bare = F.concat(F.lit("  "), F.coalesce("title", F.concat(F.lit("item "), "item_id")))
    rows = own.withColumn("text", F.when(F.col("recommendation_rank") % 4 == 3, bare).otherwise(name)).withColumn("o", F.struct((F.col("item_id") * 37 % 101).alias("h"), "item_id"))
    return rows.groupBy("user_id").agg(F.concat(simulate.joined_lines(F.col("text"), F.col("o")), F.lit("\n2. ")).alias("reply"))


@query(_with(views.POPULAR, _LINES) + "SELECT user_id, llm_rank, title FROM lines")
def ranked_line_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(rerank.ranked_lines(_replies(spark, sf_dir)), "llm_rank")


_KEY = "regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g')"
_MATCH = f"""
cand AS (SELECT user_id, item_id, recommendation_rank, coalesce(title, 'item ' || item_id) AS title FROM popular LEFT JOIN catalog USING (item_id)),
keyed AS (SELECT *, {_KEY.format("title")} AS key FROM cand),
said AS (SELECT user_id, {_KEY.format("title")} AS said, max(llm_rank) AS llm_rank FROM lines GROUP BY ALL),
exact AS (SELECT k.*, s.llm_rank AS er FROM keyed k LEFT JOIN said s ON s.user_id = k.user_id AND s.said = k.key),
near AS (SELECT user_id, item_id, llm_rank AS nr FROM (
  SELECT e.user_id, e.item_id, s.llm_rank, row_number() OVER (PARTITION BY e.user_id, e.item_id ORDER BY
    round(len(list_intersect(list_distinct(string_split(key, '')), list_distinct(string_split(said, '')))) / nullif(len(list_distinct(string_split(key, ''))), 0), 9) DESC, s.llm_rank) AS rn
  FROM exact e JOIN said s USING (user_id) WHERE er IS NULL AND said <> '' AND (contains(key, said) OR contains(said, key))) WHERE rn = 1),
matched AS (SELECT user_id, item_id, recommendation_rank, title, coalesce(er, nr, 999) AS llm_rank FROM exact LEFT JOIN near USING (user_id, item_id))"""


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _popular(spark, sf_dir).join(views.catalog(spark, sf_dir), "item_id", "left")
    own = own.select("user_id", "item_id", "recommendation_rank", F.coalesce("title", F.concat(F.lit("item "), "item_id")).alias("title"))
    return rerank.match_titles(own, rerank.ranked_lines(_replies(spark, sf_dir)))


@query(_with(views.POPULAR, _LINES, _MATCH) + "SELECT user_id, item_id, llm_rank FROM matched")
def title_normalize_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_matched(spark, sf_dir).select("user_id", "item_id", "llm_rank"), "llm_rank")


_HYBRID = """
normed AS (SELECT *, recommendation_rank / max(recommendation_rank) OVER (PARTITION BY user_id) AS a, llm_rank / max(llm_rank) OVER (PARTITION BY user_id) AS b, CASE WHEN llm_rank <= 5 THEN 0.9 WHEN llm_rank <= 10 THEN 0.7 ELSE 0.5 END::DOUBLE AS w FROM matched),
hybrid AS (SELECT *, round(w * b + (1 - w) * a, 9) AS hybrid_score FROM normed),
reranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY hybrid_score, recommendation_rank, item_id) AS new_rank FROM hybrid)"""


@query(_with(views.POPULAR, _LINES, _MATCH, _HYBRID) + "SELECT user_id, item_id, llm_rank, round(hybrid_score, 6) AS hybrid_score, new_rank FROM reranked")
def listwise_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rerank.hybrid_ranks(_matched(spark, sf_dir))
    return _long(rows.select("user_id", "item_id", "llm_rank", *_r("hybrid_score"), "new_rank"), "llm_rank", "new_rank")


@query(_with(views.POPULAR, _LINES, _MATCH, _HYBRID) + """
SELECT user_id, item_id, coalesce(new_rank, p.recommendation_rank) AS recommendation_rank, CASE WHEN new_rank IS NOT NULL THEN 'LLM' ELSE module_source END AS module_source
FROM popular p LEFT JOIN (SELECT user_id, item_id, new_rank FROM reranked WHERE new_rank <= 10) USING (user_id, item_id)""")  # fmt: skip
def rerank_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = rerank.hybrid_ranks(_matched(spark, sf_dir)).where("new_rank <= 10")
    return _long(rerank.merged_back(_popular(spark, sf_dir), new), "recommendation_rank")


@query(_with(_UV) + f"""
, s AS (SELECT user_id, item_id, s, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, item_id) AS r FROM (SELECT a.user_id, b.item_id, round({_COSINE}, 10) AS s FROM uv a, items b))
SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY floor(s * 1e6 + 0.5) DESC, item_id) AS new_rank FROM s WHERE r <= 20""")  # fmt: skip
def pairwise_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = recommend.profile_top_n(_user_vectors(spark, sf_dir), views.items(spark, sf_dir), 20)
    return _long(rerank.pairwise_order(rows, rerank.by_score, 20), "new_rank")


_JSON = """
js AS (SELECT user_id, '{' || string_agg('"movie_' || item_id || '": ' || CASE WHEN item_id % 5 = 0 THEN '"x"' WHEN item_id % 5 = 1 THEN '"' || rating || '"' ELSE CAST(rating AS VARCHAR) END, ', ' ORDER BY item_id) || '}' AS reply FROM test GROUP BY user_id),
parsed AS (SELECT user_id, item_id, CAST(rating AS INTEGER) AS rating FROM test WHERE item_id % 5 <> 0)"""


def _json_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fenced JSON replies of each user's test ratings; every fifth item has an unusable value."""
    value = F.when(F.col("item_id") % 5 == 0, '"x"').when(F.col("item_id") % 5 == 1, F.concat(F.lit('"'), "rating", F.lit('"'))).otherwise(F.col("rating").cast("string"))
    entry = F.concat(F.lit('"movie_'), "item_id", F.lit('": '), value)
    pairs = F.array_sort(F.collect_list(F.struct("item_id", entry.alias("t"))))
    body = F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda p: p["t"]), ", "), F.lit("}"))
    return views.test(spark, sf_dir).groupBy("user_id").agg(F.concat(F.lit("```json\n"), body, F.lit("\n```")).alias("reply"))


@query(_with(_JSON) + "SELECT user_id, item_id, rating FROM parsed")
def llm_json_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.parsed_ratings(_json_replies(spark, sf_dir))


@query(_with(_JSON) + "SELECT user_id, reply FROM js")
def code_fence_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _json_replies(spark, sf_dir).select("user_id", X.unfenced(F.col("reply")).alias("reply"))


@query(_with(_JSON) + "SELECT user_id, CASE WHEN count(*) FILTER (item_id % 5 = 0) > 0 THEN 'bad_entry' ELSE 'ok' END AS status FROM test GROUP BY user_id")
def reply_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _json_replies(spark, sf_dir).select("user_id", X.reply_status(X.unfenced(F.col("reply"))).alias("status"))


@query("""
SELECT a.doc_id, round(len(list_intersect(list_distinct(string_split(ta, '')), list_distinct(string_split(tb, '')))) / nullif(len(list_distinct(string_split(ta, ''))), 0), 6) AS overlap
FROM (SELECT doc_id, text AS ta, lang AS tb FROM documents) a""")  # fmt: skip
def letter_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "documents").select("doc_id", F.round(X.letter_overlap(F.col("text"), F.col("lang")), 6).alias("overlap"))


# -- prompts and feedback


@query(_with() + """, r AS (SELECT user_id, rating, recency, title FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id DESC) AS recency FROM train) JOIN catalog USING (item_id) WHERE recency <= 10)
SELECT user_id, 'Ratings so far:' || chr(10) || string_agg('- ' || title || ': ' || rating, chr(10) ORDER BY recency) AS prompt FROM r GROUP BY user_id""")  # fmt: skip
def prompt_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.prompts(simulate.recent_with_text(views.train(spark, sf_dir), views.catalog(spark, sf_dir), 10))


@query(_with() + """, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, item_id) AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id DESC) AS recency FROM train) WHERE recency <= 40)
SELECT user_id, (place - 1) // 10 AS chunk, count(*) AS n, string_agg(item_id || '=' || rating, chr(10) ORDER BY place) AS prompt FROM r GROUP BY ALL""")  # fmt: skip
def profile_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(simulate.chunk_prompts(simulate.recent(views.train(spark, sf_dir), 40), 10), "chunk")


@query(_with(views.POPULAR, _JSON) + """
SELECT user_id, item_id, rating, TIMESTAMP '2024-01-01 00:00:00' AS ts FROM parsed WHERE item_id IN (SELECT item_id FROM catalog) AND EXISTS (SELECT 1 FROM test t WHERE t.user_id = parsed.user_id AND t.item_id = parsed.item_id AND t.rating >= 3)""")  # fmt: skip
def simulated_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = views.test(spark, sf_dir).where("rating >= 3")
    return simulate.feedback(_json_replies(spark, sf_dir), wanted, views.catalog(spark, sf_dir), F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")))


@query("""
SELECT date_trunc('minute', ts) AS minute, CAST(sum(greatest(1, length(props) // 4)) AS BIGINT) AS tokens, sum(greatest(1, length(props) // 4)) > 3 AS over FROM events GROUP BY 1""")  # fmt: skip
def minute_token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = views.table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), X.token_estimate(F.col("props")).alias("tokens"))
    return simulate.minute_tokens(calls, 3).withColumn("minute", F.col("minute").cast("timestamp_ntz"))


@query(_with(views.POPULAR, _LINES, _MATCH, _HYBRID) + """
SELECT count(DISTINCT user_id) AS users, count(*) AS rows, count(*) FILTER (new_rank IS NOT NULL) AS judged, count(*) FILTER (coalesce(new_rank, p.recommendation_rank) <> p.recommendation_rank) AS moved
FROM popular p LEFT JOIN (SELECT user_id, item_id, new_rank FROM reranked WHERE new_rank <= 10) USING (user_id, item_id)""")  # fmt: skip
def rerank_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = _popular(spark, sf_dir)
    return rerank.rerank_summary(before, rerank.merged_back(before, rerank.hybrid_ranks(_matched(spark, sf_dir)).where("new_rank <= 10")))


# -- further building blocks


@query(_with(views.POPULAR) + "SELECT user_id, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY recommendation_rank, item_id) AS items, count(*) AS n FROM (SELECT * FROM popular UNION ALL SELECT * FROM rated) GROUP BY user_id")
def ordered_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _popular(spark, sf_dir).unionByName(_rated(spark, sf_dir))
    pairs = F.array_sort(F.collect_list(F.struct("recommendation_rank", "item_id")))
    return rows.groupBy("user_id").agg(F.array_join(F.transform(pairs, lambda p: p["item_id"].cast("string")), ",").alias("items"), F.count("*").alias("n"))


@query("SELECT conv_id, turn FROM conversations WHERE text IS NOT NULL AND regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> ''")
def non_blank_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "conversations").where(X.not_blank(F.col("text"))).select("conv_id", "turn")


@query(_with(views.POPULAR) + "SELECT DISTINCT user_id FROM test INTERSECT SELECT user_id FROM rated")
def evaluated_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.test(spark, sf_dir).select("user_id").intersect(_rated(spark, sf_dir).select("user_id"))


@query(_with() + "SELECT user_id, item_id FROM train WHERE rating >= 4 UNION SELECT user_id, item_id FROM train WHERE rating <= 2")
def seen_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = views.train(spark, sf_dir)
    return train.where("rating >= 4").select("user_id", "item_id").union(train.where("rating <= 2").select("user_id", "item_id")).distinct()


@query("WITH " + views.PURCHASES + " SELECT item_id FROM purchases WHERE l_linenumber % 4 <> 0 EXCEPT SELECT item_id FROM purchases WHERE l_linenumber % 4 = 0")
def items_only_in_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the sparse purchases: every item of the ratings table is in both of its parts."""
    rows = views.purchases(spark, sf_dir)
    return rows.where("l_linenumber % 4 <> 0").select("item_id").subtract(rows.where("l_linenumber % 4 = 0").select("item_id"))


@query(_with() + "SELECT DISTINCT t.item_id, c.title FROM train t LEFT JOIN catalog c USING (item_id)")
def reindexed_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = views.train(spark, sf_dir).select("item_id").distinct()
    return ids.join(R.first_wins(views.catalog(spark, sf_dir), ["item_id"], ["title"]).select("item_id", "title"), "item_id", "left")


@query(_with(views.POPULAR, views.metrics_sql("popular", KS)) + """SELECT dataset, CAST(K AS BIGINT) AS K, metric, value FROM (
  SELECT d AS dataset, K, round(precision, 6) AS precision, round(recall, 6) AS recall FROM metrics, (SELECT unnest(['a', 'b']) AS d)) UNPIVOT (value FOR metric IN (precision, recall))""")  # fmt: skip
def dataset_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.all_metrics(_popular(spark, sf_dir), views.test(spark, sf_dir), KS).select("K", *_r("precision", "recall"))
    both = R.union_sources({"a": rows, "b": rows}, "dataset").drop("priority")
    return _long(metrics.long_form(both, ["dataset", "K"], ["precision", "recall"]), "K")


@query(_with() + """
, t AS (SELECT item_id, [vector[1:16], vector[17:32], vector[33:48], vector[49:64]] AS tokens, [1.0, item_id % 2, item_id % 3, (item_id + 1) % 2]::DOUBLE[] AS mask FROM items),
s AS (SELECT item_id, p, list_sum(list_transform(range(1, 5), lambda k: tokens[k][p] * mask[k])) / greatest(list_sum(mask), 1e-9) AS x FROM t, (SELECT unnest(range(1, 17)) AS p))
SELECT item_id, p, round(x, 6) AS x FROM s""".lstrip("\n"))  # fmt: skip
def masked_mean_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four quarters of an item's vector as token vectors."""
    v, k = V.doubles(F.col("vector")), F.col("item_id")
    tokens = F.array(*[F.slice(v, i, 16) for i in (1, 17, 33, 49)])
    mask = F.array(F.lit(1.0), *[x.cast("double") for x in (k % 2, k % 3, (k + 1) % 2)])
    rows = views.items(spark, sf_dir).select("item_id", tokens.alias("tokens"), mask.alias("mask"))
    rows = rows.select("item_id", F.posexplode(V.masked_mean(F.col("tokens"), F.col("mask"), 16)).alias("p", "x"))
    return rows.select("item_id", (F.col("p") + 1).cast("long").alias("p"), *_r("x"))


@query(_with(_UV) + """
, s AS (SELECT t.user_id, t.item_id, list_dot_product(a.vector, i.vector) AS dot FROM test t JOIN uv a USING (user_id) JOIN items i USING (item_id))
SELECT user_id, item_id, round(dot, 6) AS dot FROM s""".lstrip("\n"))  # fmt: skip
def vector_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every test rating: the user's vector times the item's."""
    rows = views.test(spark, sf_dir).select("user_id", "item_id").join(_user_vectors(spark, sf_dir).select("user_id", F.col("vector").alias("u")), "user_id")
    rows = rows.join(views.items(spark, sf_dir).select("item_id", "vector"), "item_id")
    return rows.select("user_id", "item_id", F.round(V.dot(F.col("u"), F.col("vector")), 6).alias("dot"))


@query(_with() + """
, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, item_id) AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id DESC) AS recency FROM train) WHERE recency <= 20)
SELECT user_id, (place - 1) // 5 AS chunk, count(*) AS rated FROM r GROUP BY ALL""".lstrip("\n"))  # fmt: skip
def profile_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = simulate.profile_steps(simulate.chunk_prompts(simulate.recent(views.train(spark, sf_dir), 20), 5))
    rows = steps.select("user_id", F.explode("intermediate").alias("chunk", "prompt"))
    return _long(rows.select("user_id", "chunk", F.size(F.split("prompt", "\n")).alias("rated")), "chunk", "rated")


@query()
def text_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.embed_text(views.catalog(spark, sf_dir), "item_id", "title").select("item_id", "title_vector")


@query(_with() + """
SELECT user_id, item_id, rating FROM train WHERE user_id IN (
  SELECT user_id FROM (SELECT DISTINCT user_id FROM train) ORDER BY ('0x' || substr(md5('42:' || user_id), 1, 15))::BIGINT, user_id LIMIT 5)""")
def sampled_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: five users by seeded hash."""
    return R.sample_users(views.train(spark, sf_dir), 5).select("user_id", "item_id", "rating")


@query(_with() + """
SELECT user_id, item_id, CASE WHEN r >= 4 THEN 'positive' WHEN r <= 2 THEN 'negative' END AS by_range,
  CASE WHEN r IN (4, 5) THEN 'positive' WHEN r IN (1, 2) THEN 'negative' END AS listed, CASE WHEN r = 5 THEN 'positive' WHEN r <= 2 THEN 'negative' END AS strict
FROM (SELECT user_id, item_id, rating + (item_id % 2) * 0.5 AS r FROM train)""")
def polarity_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fractional ratings, for which the three splits differ."""
    rows = views.train(spark, sf_dir).select("user_id", "item_id", (F.col("rating") + (F.col("item_id") % 2) * 0.5).alias("r"))
    return rows.select("user_id", "item_id", *[R.polarity(F.col("r"), v).alias(name) for v, name in (("range", "by_range"), ("listed", "listed"), ("strict", "strict"))])


@query(_with(views.POPULAR) + "SELECT user_id, module_source, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY recommendation_rank, item_id) AS items FROM (SELECT * FROM popular UNION ALL SELECT * FROM rated) GROUP BY ALL")
def module_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered list of each user and recommender."""
    rows = _popular(spark, sf_dir).unionByName(_rated(spark, sf_dir))
    pairs = F.array_sort(F.collect_list(F.struct("recommendation_rank", "item_id")))
    return rows.groupBy("user_id", "module_source").agg(F.array_join(F.transform(pairs, lambda p: p["item_id"].cast("string")), ",").alias("items"))


@query(_with() + "SELECT item_id, p, round(CASE WHEN p > 64 THEN 0 ELSE greatest(vector[p], 1e-5) END, 6) AS x FROM items, (SELECT unnest(range(1, 73)) AS p)")
def clipped_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start of a factor model of 72 components: positive, zeros behind."""
    rows = views.items(spark, sf_dir).select("item_id", F.posexplode(V.padded(V.clipped(F.col("vector")), 72)).alias("p", "x"))
    return rows.select("item_id", (F.col("p") + 1).cast("long").alias("p"), *_r("x"))
