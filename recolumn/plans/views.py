"""The driver's tables as recommender data, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import last_wins

#: Upper bounds of the event values that become ratings 1 to 4; the rest is 5.
BOUNDS = (11, 25.5, 46, 80.5)
WIDTH = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("value")
    rating = F.lit(5)
    for stars, bound in reversed(list(enumerate(BOUNDS, 1))):
        rating = F.when(value < bound, stars).otherwise(rating)
    item = F.get_json_object("props", "$.k").cast("long")
    rows = table(spark, sf_dir, "events").select("user_id", item.alias("item_id"), rating.alias("rating"), "ts", "event_id")
    return last_wins(rows, ["user_id", "item_id"], ["ts", "event_id"])


def train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(spark, sf_dir).where("event_id % 5 <> 0")


def test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(spark, sf_dir).where("event_id % 5 = 0")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"), "label")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").cast("long").alias("item_id"), F.col("p_name").alias("title"), F.col("p_type").alias("overview"))


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The large sparse variant: customers' latest line for each part."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"),
        (1 + F.floor((F.col("l_quantity") - 1) / 10)).cast("int").alias("rating"), F.col("o_orderdate").alias("ts"),
        "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate",
    )
    order = ["ts", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
    return last_wins(rows, ["user_id", "item_id"], order).select("user_id", "item_id", "rating", "ts", "l_orderkey", "l_linenumber")


def last_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, item_id and l_linenumber of `purchases`: the line's other columns only part rows that agree in all three."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), F.col("o_orderdate").alias("ts"), "l_orderkey", "l_linenumber"
    )
    return last_wins(rows, ["user_id", "item_id"], ["ts", "l_orderkey", "l_linenumber"]).select("user_id", "item_id", "l_linenumber")


INTERACTIONS = """
interactions AS (
  SELECT user_id, item_id, rating, ts, event_id FROM (
    SELECT user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS item_id,
      CASE WHEN value < 11 THEN 1 WHEN value < 25.5 THEN 2 WHEN value < 46 THEN 3 WHEN value < 80.5 THEN 4 ELSE 5 END AS rating, ts, event_id,
      row_number() OVER (PARTITION BY user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) ORDER BY ts DESC, event_id DESC) AS rn
    FROM events) WHERE rn = 1),
train AS (SELECT * FROM interactions WHERE event_id % 5 <> 0),
test AS (SELECT * FROM interactions WHERE event_id % 5 = 0),
items AS (SELECT vec_id AS item_id, CAST(embedding AS DOUBLE[]) AS vector, label FROM embeddings),
catalog AS (SELECT CAST(p_partkey AS BIGINT) AS item_id, p_name AS title, p_type AS overview FROM part)"""

PURCHASES = """
purchases AS (
  SELECT user_id, item_id, rating, ts, l_orderkey, l_linenumber FROM (
    SELECT o_custkey AS user_id, l_partkey AS item_id, CAST(1 + floor((l_quantity - 1) / 10) AS INTEGER) AS rating, o_orderdate AS ts, l_orderkey, l_linenumber,
      row_number() OVER (PARTITION BY o_custkey, l_partkey ORDER BY o_orderdate DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_shipdate DESC) AS rn
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE rn = 1)"""

POPULAR = """
pop AS (SELECT item_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, item_id) AS popularity_rank FROM train GROUP BY item_id),
popular AS (
  SELECT user_id, item_id, recommendation_rank, 'popularity' AS module_source FROM (
    SELECT u.user_id, p.item_id, row_number() OVER (PARTITION BY u.user_id ORDER BY popularity_rank) AS recommendation_rank
    FROM (SELECT DISTINCT user_id FROM train) u, pop p
    WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.user_id = u.user_id AND t.item_id = p.item_id)) WHERE recommendation_rank <= 20),
liked AS (SELECT item_id, row_number() OVER (ORDER BY round(avg(rating), 9) DESC, item_id) AS r FROM train GROUP BY item_id),
rated AS (
  SELECT user_id, item_id, r AS recommendation_rank, 'rating' AS module_source FROM liked, (SELECT user_id FROM train GROUP BY user_id HAVING count(*) > 40)
  WHERE r <= 20)"""


def metrics_sql(lists: str, ks: tuple[int, ...], by: str = "", test: str = "test") -> str:
    """CTEs ending in `metrics` for the lists of one CTE; `by` is a column prefix such as 'module, '."""
    on = f"{by}K, user_id"
    return f"""
ks AS (SELECT unnest({list(ks)}) AS K),
freq AS (SELECT item_id, count(*) AS f FROM {test} GROUP BY item_id),
tot AS (SELECT count(*) AS t, count(DISTINCT item_id) AS u FROM {test}),
rel AS (SELECT user_id, count(DISTINCT CASE WHEN rating >= 4 THEN item_id END) AS n_rel FROM {test} GROUP BY user_id),
ev AS (SELECT DISTINCT {by}r.user_id, n_rel FROM {lists} r JOIN rel ON r.user_id = rel.user_id),
l AS (
  SELECT {by}K, r.user_id, r.item_id, CASE WHEN t.rating >= 4 THEN 1 ELSE 0 END AS rel, f,
    row_number() OVER (PARTITION BY {by}K, r.user_id ORDER BY r.recommendation_rank, r.item_id) AS pos
  FROM {lists} r JOIN {test} t ON r.user_id = t.user_id AND r.item_id = t.item_id JOIN freq ON freq.item_id = r.item_id, ks WHERE r.recommendation_rank <= K),
l2 AS (SELECT *, sum(rel) OVER (PARTITION BY {on} ORDER BY pos) AS cum FROM l),
lu AS (
  SELECT {on}, count(*) AS n, count(DISTINCT CASE WHEN rel = 1 THEN item_id END) AS hits, sum(rel / log2(pos + 1)) AS dcg,
    min(CASE WHEN rel = 1 THEN pos END) AS fp, sum(rel * cum / pos) AS ap, avg(f) AS nov, avg(-log2(f / (SELECT t FROM tot))) AS si
  FROM l2 GROUP BY {on}),
pu AS (SELECT {by}K, user_id, n_rel, n, coalesce(hits, 0) AS hits, dcg, fp, ap, nov, si FROM (SELECT * FROM ev, ks) LEFT JOIN lu USING ({on})),
m AS (
  SELECT {by}K, avg(hits / n) AS precision, avg(CASE WHEN n_rel > 0 THEN hits / n_rel END) AS recall,
    avg(CASE WHEN n_rel > 0 AND n IS NOT NULL THEN dcg / list_sum(list_transform(range(1, least(n_rel, K) + 1), lambda i: 1 / log2(i + 1))) END) AS ndcg,
    avg(CASE WHEN hits > 0 THEN 1 / fp END) AS mrr, avg(CASE WHEN hits > 0 AND n_rel > 0 THEN ap / n_rel END) AS map,
    count(*) FILTER (hits > 0 AND n_rel > 0) / nullif(count(*) FILTER (n_rel > 0), 0) AS user_coverage,
    avg(nov) AS novelty, avg(si) AS self_information, var_samp(hits) AS hit_variance
  FROM pu GROUP BY {by}K),
li AS (SELECT {by}K, item_id, count(*) AS f FROM l GROUP BY {by}K, item_id),
lc AS (SELECT *, sum(f) OVER (PARTITION BY {by}K ORDER BY f, item_id) AS run FROM li),
sh AS (
  SELECT {by}K, count(*) / (SELECT u FROM tot) AS item_coverage, (count(*) + 1 - 2 * sum(run) / sum(f)) / count(*) AS gini,
    log2(sum(f)) - sum(f * log2(f)) / sum(f) AS entropy FROM lc GROUP BY {by}K),
metrics AS (
  SELECT m.*, CASE WHEN coalesce(precision, 0) + coalesce(recall, 0) > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1,
    coalesce(item_coverage, 0) AS item_coverage, coalesce(gini, 0) AS gini, coalesce(entropy, 0) AS entropy FROM m LEFT JOIN sh USING ({by}K))"""
