"""Factor models, p-values and judge loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from recolumn.operators import agreement, factor, loops, rerank


def vectors(spark, x, key="item_id"):
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], f"{key} long, vector array<double>").repartition(3)


def test_principal_axes_and_alignment(spark):
    x = np.random.default_rng(1).normal(size=(60, 5)) @ np.diag([5, 1, 3, 0.5, 2.0]) + 7
    mean, axes = factor.principal_axes(vectors(spark, x), 3)
    _, _, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    np.testing.assert_allclose(mean, x.mean(0))
    np.testing.assert_allclose(np.abs(axes.T), np.abs(vt[:3]), atol=1e-8)
    assert all(a[np.abs(a).argmax()] > 0 for a in axes.T)
    got = {r["item_id"]: r["vector"] for r in factor.aligned(vectors(spark, x), "item_id", 3).collect()}
    np.testing.assert_allclose(np.array([got[k] for k in range(60)]), (x - x.mean(0)) @ axes, atol=1e-9)
    assert factor.aligned(vectors(spark, x), "item_id", 7).where("size(vector) = 7 and vector[5] = 0 and vector[6] = 0").count() == 60
    assert factor.aligned(vectors(spark, x).limit(0), "item_id", 3).count() == 0


def test_nmf_updates(spark):
    draw = np.random.default_rng(2)
    full = draw.integers(0, 6, (8, 9)).astype(float)
    users, items = draw.normal(size=(8, 4)), draw.normal(size=(9, 4))
    rows = spark.createDataFrame([(u, i, float(full[u, i])) for u in range(8) for i in range(9) if full[u, i]], "user_id long, item_id long, rating double")
    w, h = np.maximum(users, 1e-5), np.maximum(items, 1e-5)
    before = np.square(full - w @ h.T).sum()
    for _ in range(3):
        w = w * (full @ h) / (w @ (h.T @ h) + 1e-9)
        h = h * (full.T @ w) / (h @ (w.T @ w) + 1e-9)
    assert np.square(full - w @ h.T).sum() < before
    gw, gh = factor.nmf_vectors(rows, vectors(spark, users, "user_id"), vectors(spark, items), 4, 3)
    np.testing.assert_allclose(np.array([r["vector"] for r in gw.orderBy("user_id").collect()]), w, rtol=1e-9)
    np.testing.assert_allclose(np.array([r["vector"] for r in gh.orderBy("item_id").collect()]), h, rtol=1e-9)


def test_p_values(spark):
    for r in (-0.999, -0.5, 0.0, 0.1, 0.73):
        t = lambda n, r=r: abs(r) * math.sqrt((n - 2) / (1 - r * r))
        # closed forms for 1, 2 and 4 degrees of freedom
        assert abs(agreement.correlation_p(r, 3) - (1 - 2 / math.pi * math.atan(t(3)))) < 1e-12
        assert abs(agreement.correlation_p(r, 4) - (1 - t(4) / math.sqrt(2 + t(4) ** 2))) < 1e-12
        u = t(6) / math.sqrt(4 + t(6) ** 2)
        assert abs(agreement.correlation_p(r, 6) - (1 - u * (3 - u * u) / 2)) < 1e-12
    # many pairs: the normal tail
    assert abs(agreement.correlation_p(0.002, 1_000_000) - math.erfc(0.002 * math.sqrt(1e6 - 2) / math.sqrt(2) / math.sqrt(1 - 4e-6))) < 1e-6
    assert agreement.correlation_p(1.0, 5) == 0.0 and math.isnan(agreement.correlation_p(0.5, 2))
    rows = spark.createDataFrame([(1, 2), (2, 1), (3, 4), (4, 3), (5, 5)], "actual int, predicted int")
    got = agreement.spearman(rows).head()
    assert abs(got["spearman"] - 0.8) < 1e-12 and abs(got["p_value"] - 0.10408803866182788) < 1e-9


def ratings(spark, kind):
    rows = [("a", k, 5.0 if k < 7 else 1.0, k) for k in range(12)] + [("b", 1, 1.0, 1), ("c", 2, 4.0, 1)]
    return spark.createDataFrame(rows, f"user_id {kind}, item_id long, rating double, ts long")


def test_loops_resume_in_the_middle(spark, tmp_path):
    items = spark.createDataFrame([(k, f"t{k}") for k in range(12) if k != 6], "item_id long, title string")
    steps = loops.polarity_steps(ratings(spark, "string"), items, 6, 3)
    found = sorted((r["user_id"], r["step"], r["kind"], r["body"]) for r in steps.collect())
    assert found == [
        ("a", 0, "initial", "- t5: 5\n- t4: 5"), ("a", 1, "positive", "- t3: 5\n- t2: 5\n- t1: 5"),
        ("a", 2, "negative", "- t11: 1\n- t10: 1\n- t9: 1"), ("a", 3, "negative", "- t8: 1\n- t7: 1"), ("c", 0, "initial", "- t2: 4"),
    ]
    asked = str(tmp_path / "asked")

    def judge(prompts):
        from pathlib import Path
        from uuid import uuid4

        Path(asked).mkdir(exist_ok=True)
        for p in prompts:
            (Path(asked) / uuid4().hex).write_text(p)
        if any("t11" in p for p in prompts):
            raise ValueError("the judge is down")
        return [f"[{p.splitlines()[1][9:]}|{p.splitlines()[2]}]" for p in prompts]

    path = str(tmp_path / "state")
    loops.run_steps(steps, judge, path, attempts=1, until=1)
    calls = len(list((tmp_path / "asked").iterdir()))
    state = loops.run_steps(steps, judge, path, attempts=1)
    rows = {(r["user_id"], r["step"]): (r["profile"], r["status"]) for r in state.collect()}
    assert calls == 3 and len(list((tmp_path / "asked").iterdir())) == 5 and state.count() == 5
    assert rows["a", 1] == ("[[|- t5: 5]|- t3: 5]", "ok") and rows["a", 2] == (rows["a", 1][0], "error") and rows["a", 3][0] == "[[[|- t5: 5]|- t3: 5]|- t8: 1]"
    assert {r["user_id"]: r["profile"] for r in loops.profiles(state).collect()} == {"a": rows["a", 3][0], "c": "[|- t2: 4]"}
    assert loops.run_steps(steps.limit(0), judge, path).count() == 5


def test_missing_items(spark):
    rows = spark.createDataFrame([(1, 9), (1, 3), (1, 9), (2, 4)], "user_id long, item_id long")
    items = spark.createDataFrame([(4, "t", "x", None)], "item_id long, title string, release_date string, overview string")
    assert [tuple(r) for r in rerank.missing_items(rows, items).collect()] == [(1, [3, 9])]
    assert rerank.item_details(rows, items).where(F.col("item_id") == 4).head()["details"] == "t: "


@pytest.mark.parametrize("kind", ["string"])
def test_prompts_of_requests(spark, kind):
    items = spark.createDataFrame([(k, f"t{k}") for k in range(12)], "item_id long, title string")
    rows = ratings(spark, kind)
    known = spark.createDataFrame([("a", "likes t")], "user_id string, profile string")
    got = {(r["user_id"], r["chunk"]): r["prompt"] for r in loops.request_prompts(known, rows.where("item_id = 1").withColumn("recency", F.lit(1)), rows, items, 10).collect()}
    assert set(got) == {("a", 0), ("a", 1), ("b", 0), ("c", 0)}
    assert got["a", 1] == "Profile: likes t\nLatest ratings:\n- t1: 5\nRate each item from 1 to 5:\n- 10: t10\n- 11: t11"
    assert got["c", 0] == "Profile: \nLatest ratings:\n\nRate each item from 1 to 5:\n- 2: t2"


def test_nmf_of_a_user_in_several_blocks(spark, monkeypatch):
    """Ratings are dealt in blocks; a user with more than a block may hold gets the same factors, and rows without a rating count nothing."""
    draw = np.random.default_rng(5)
    full, users, items = draw.integers(1, 6, (3, 20)).astype(float), draw.normal(size=(3, 2)), draw.normal(size=(20, 2))
    rows = spark.createDataFrame([(u, i, float(full[u, i])) for u in range(3) for i in range(20)] + [(0, 1, None)], "user_id long, item_id long, rating double")
    monkeypatch.setattr(factor.graph, "HOT", 4)
    gw, gh = factor.nmf_vectors(rows, vectors(spark, users, "user_id"), vectors(spark, items), 2, 1)
    w, h = np.maximum(users, 1e-5), np.maximum(items, 1e-5)
    w = w * (full @ h) / (w @ (h.T @ h) + 1e-9)
    h = h * (full.T @ w) / (h @ (w.T @ w) + 1e-9)
    np.testing.assert_allclose(np.array([r["vector"] for r in gw.orderBy("user_id").collect()]), w, rtol=1e-9)
    np.testing.assert_allclose(np.array([r["vector"] for r in gh.orderBy("item_id").collect()]), h, rtol=1e-9)


def test_few_items_get_few_als_blocks(spark, monkeypatch):
    """Each user's factors go to every block of items in each round; few items beside many users do not make ten."""
    assert [factor.item_blocks(*k) for k in ((540_000, 100), (1000, 500), (10, 1000), (0, 0))] == [3, 5, 10, 3]
    taken, als = {}, factor.ALS
    monkeypatch.setattr(factor, "ALS", lambda **k: taken.update(k) or als(**k))
    rows = spark.range(60 * 6).selectExpr("id div 6 as user_id", "(id * 7 + id div 6) % 12 as item_id", "CAST(id % 5 + 1 AS INT) as rating")
    assert factor.als_top_n(rows, 3, rounds=2).count() > 0 and taken["numItemBlocks"] == 3
