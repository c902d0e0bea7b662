"""Registered queries run the whole published job."""

import os

import pytest
from pyspark.sql import functions as F

from recolumn.functions import vectors as V
from recolumn.operators import factor, recommend, train
from recolumn.plans import models

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


class Seen(Exception):
    pass


#: Least epochs, and whether all of them run at one rate.
PUBLISHED = {
    "light_gcn_topn": (100, True),
    "ngcf_topn": (100, True),
    "bpr_graph_topn": (300, False),
    "vector_graph_topn": (300, False),
}


@pytest.mark.parametrize("name", PUBLISHED)
def test_training_queries_run_the_published_epochs(spark, monkeypatch, name):
    def fit(rows, settings=None, nodes=None):
        raise Seen(settings or train.Settings())

    monkeypatch.setattr(train, "light_gcn", fit)
    monkeypatch.setattr(train, "ngcf", fit)
    with pytest.raises(Seen) as found:
        getattr(models, name)(spark, DATA)
    settings, (epochs, constant) = found.value.args[0], PUBLISHED[name]
    assert settings.epochs >= epochs
    schedule = train.Schedule(settings)
    losses = [schedule.improved(1.0) or schedule.over for _ in range(epochs)]
    assert losses[0] and (not any(losses[1:]) and schedule.rate == settings.rate if constant else settings.patience >= 15)


def test_users_with_equal_histories_are_scored_once(spark, monkeypatch):
    """Equal probes are scored once, and everyone still gets their own list."""
    scored, score = [], recommend.score_blocks

    def counted(users, *args, **more):
        scored.append(users.count())
        return score(users, *args, **more)

    monkeypatch.setattr(recommend, "score_blocks", counted)
    items = spark.range(40).selectExpr("id AS item_id", "transform(sequence(1, 4), i -> sin(id * i + i)) AS vector")
    alike = spark.range(20).selectExpr("id AS user_id", "explode(sequence(0L, 5L)) AS item_id")
    other = spark.range(20, 22).selectExpr("id AS user_id", "explode(sequence(id - 20, id - 14)) AS item_id")
    positives = alike.union(other).selectExpr("user_id", "item_id", "item_id % 2 AS cluster")
    seen = positives.select("user_id", "item_id").union(spark.createDataFrame([(7, 30)], "user_id long, item_id long"))
    find = lambda some: {tuple(r)[:3] for r in recommend.clustered_knn(positives.where(some), items, seen.where(some), 4, 8).select("user_id", "item_id", "recommendation_rank", "score").collect()}
    whole = find("true")
    # two clusters of each of three kinds of user, of which two share one; user 7 has seen one more item
    assert scored == [5, 4]
    for user in (0, 7, 19, 20, 21):
        mine = {r for r in whole if r[0] == user}
        assert len(mine) == 8 and mine == find(f"user_id = {user}")


def test_als_deals_users_to_all_cores(spark, monkeypatch):
    taken, als = {}, factor.ALS
    monkeypatch.setattr(factor, "ALS", lambda **k: taken.update(k) or als(**k))
    rows = spark.range(60 * 6).selectExpr("id div 6 as user_id", "(id * 7 + id div 6) % 12 as item_id", "CAST(id % 5 + 1 AS INT) as rating")
    assert factor.als_top_n(rows, 3, rounds=2).count() > 0
    assert taken["numUserBlocks"] >= max(10, 3 * spark.sparkContext.defaultParallelism) and taken["maxIter"] == 2


def test_sums_by_position_of_a_named_column(spark):
    """An epoch builds sums of hundreds of positions several times: by name they are one call, with the same values."""
    rows = spark.createDataFrame([("a", [1.5, 2.0, None]), ("a", [0.25, None, 4.0]), ("b", [3.0]), ("c", None)], "id string, vector array<double>")
    by = lambda v: {r["id"]: r["x"] for r in rows.groupBy("id").agg(V.sum_by_position(v, 3).alias("x")).collect()}
    assert by("vector") == by(F.col("vector")) == {"a": [1.75, 2.0, 4.0], "b": [3.0, None, None], "c": [None] * 3}
