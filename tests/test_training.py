"""Graph training: gradients against finite differences, negatives against plain walks, learning on a small graph."""

import hashlib
import os
import subprocess
import sys
import time
from dataclasses import replace
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from recolumn.functions import vectors as V
from recolumn.operators import blocks, graph, relational, train
from recolumn.sources import work


def ratings(spark, users=12, items=15, seed=3, kind="long"):
    draw = np.random.default_rng(seed)
    rows = [(int(u), int(i), float(5 if (u + i) % 3 == 0 else draw.integers(1, 4))) for u in range(users) for i in range(items) if draw.random() < 0.5]
    return spark.createDataFrame(rows, "user_id long, item_id long, rating double").select(F.col("user_id").cast(kind), F.col("item_id").cast(kind), "rating")


def norms(rows):
    pairs = {(f"u{r[0]}", f"i{r[1]}") for r in rows}
    degree = {}
    for a, b in pairs:
        degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    names = sorted(degree)
    out = np.zeros((len(names), len(names)))
    for a, b in pairs:
        out[names.index(a), names.index(b)] = out[names.index(b), names.index(a)] = 1 / np.sqrt(degree[a] * degree[b])
    return names, out


def numbers(names, table):
    found = {r["id"]: r["vector"] for r in table.collect()}
    width = len(next(iter(found.values())))
    return np.array([found.get(n, [0.0] * width) for n in names])


def numeric(function, x, h=1e-6):
    out = np.zeros_like(x)
    for at in np.ndindex(*x.shape):
        for sign in (1, -1):
            y = x.copy()
            y[at] += sign * h
            out[at] += sign * function(y) / (2 * h)
    return out


@pytest.fixture(scope="module")
def small(spark):
    rows = ratings(spark, 5, 6)
    names, a = norms(rows.collect())
    edges, parts = train.dealt_edges(graph.degree_norm(graph.bipartite_edges(rows)), hot=2)
    pairs = [(u, g, b) for u in names if u[0] == "u" for g, b in [("i0", "i1"), ("i2", "i5")] if g in names and b in names]
    return names, a, edges.persist(), parts.persist(), pairs, spark.createDataFrame(pairs, "u string, g string, b string")


@pytest.mark.parametrize("kind", ["bpr", "cross_entropy"])
def test_propagated_gradient(spark, small, kind):
    names, a, edges, parts, pairs, table = small
    x = np.random.default_rng(1).normal(size=(len(names), 3))
    at = {n: k for k, n in enumerate(names)}

    def loss(x):
        z = sum(np.linalg.matrix_power(a, k) @ x for k in range(4)) / 4
        u, g, b = (z[[at[p[c]] for p in pairs]] for c in range(3))
        good, bad = (u * g).sum(1), (u * b).sum(1)
        near = good / np.linalg.norm(u, axis=1) / np.linalg.norm(g, axis=1)
        own = np.log1p(np.exp(bad - good)) if kind == "bpr" else (np.log1p(np.exp(-good)) + np.log1p(np.exp(bad))) / 2
        return (own + 0.5 * (1 - near)).mean()

    nodes = spark.createDataFrame([(n, v.tolist()) for n, v in zip(names, x, strict=True)], "id string, vector array<double>")
    with work.scratch() as keep:
        z = keep(train.layer_mean(edges, parts, nodes, 3, 3, keep))
        got, grad = train.pair_step(table, z, 3, kind, 0.5, keep)
        found = numbers(names, train.layer_mean(edges, parts, grad, 3, 3, keep))
    assert abs(got - loss(x)) < 1e-9
    np.testing.assert_allclose(found, numeric(loss, x), atol=1e-7)


def test_ngcf_gradient(spark, small):
    names, a, edges, parts, pairs, table = small
    draw = np.random.default_rng(2)
    x, weights = draw.normal(size=(len(names), 3)), [draw.normal(size=(3, 3)) for _ in range(4)]
    at = {n: k for k, n in enumerate(names)}
    drop, epoch, seed = 0.3, 4, 7
    import pyarrow as pa

    masks = [train._kept_components(pa.array(names), 3, seed, epoch, k, drop) for k in range(2)]
    assert len({float(m) for k in masks for m in k.ravel()}) == 2

    def loss(x, w=weights):
        layers = [x]
        for k in range(2):
            h = layers[-1]
            z = (h + a @ h) @ w[2 * k] + (h * (a @ h)) @ w[2 * k + 1]
            layers.append(np.where(z > 0, z, 0.2 * z) * masks[k])
        z = np.concatenate(layers, axis=1)
        u, g, b = (z[[at[p[c]] for p in pairs]] for c in range(3))
        return ((np.log1p(np.exp(-(u * g).sum(1))) + np.log1p(np.exp((u * b).sum(1)))) / 2).mean()

    nodes = spark.createDataFrame([(n, v.tolist()) for n, v in zip(names, x, strict=True)], "id string, vector array<double>")
    with work.scratch() as keep:
        tables = train.ngcf_forward(edges, parts, nodes, weights, 3, keep, epoch, drop, seed)
        z = keep(train.joined_layers(tables))
        got, grad = train.pair_step(table, z, 9, "cross_entropy", 0.0, keep)
        grad, totals = train.ngcf_backward(edges, parts, tables, keep(grad), weights, 3, keep, epoch, drop, seed)
        found = numbers(names, grad)
    assert abs(got - loss(x)) < 1e-9
    np.testing.assert_allclose(found, numeric(loss, x), atol=1e-7)
    for k in range(4):
        np.testing.assert_allclose(totals[k], numeric(lambda w, k=k: loss(x, [*weights[:k], w, *weights[k + 1 :]]), weights[k]), atol=1e-7)


def test_adam_and_schedule():
    x, m, v = (np.zeros(1) + c for c in (1.0, 0.0, 0.0))
    x, m, v = train.adam(x, m, v, np.array([0.5]), 1, 0.1, 0.01)
    assert abs(x[0] - (1 - 0.001 - 0.1)) < 1e-6 and abs(m[0] - 0.05) < 1e-12 and abs(v[0] - 0.00025) < 1e-12
    rule = train.Schedule(train.Settings(rate=1.0, plateau=1, patience=4, factor=0.5))
    assert rule.improved(3.0) and not rule.improved(3.0) and rule.rate == 1.0
    assert not rule.improved(4.0) and rule.rate == 0.5 and not rule.over
    assert rule.improved(2.0) and rule.rate == 0.5
    assert [rule.improved(5.0) for _ in range(4)] == [False] * 4 and rule.over and rule.rate == 0.125


def walk(total, *parts):
    h = int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:15], 16)
    stride = graph.STEPS[h % 4] % total
    return [(h // 4 + t * stride) % total for t in range(total)]


def test_negatives_are_the_first_free_steps_of_a_walk(spark):
    rows = ratings(spark, 9, 14).union(spark.createDataFrame([(50, i, 5.0) for i in range(14)], "user_id long, item_id long, rating double"))
    seen, items = {}, sorted({r[1] for r in rows.collect()})
    for u, i, _ in rows.collect():
        seen.setdefault(u, set()).add(i)
    got = {}
    for r in sorted(graph.negatives(rows, 4, seed=9).collect(), key=lambda r: r["place"]):
        got.setdefault(r["user_id"], []).append(r["item_id"])
    want = {u: [items[r] for r in walk(len(items), 9, u) if items[r] not in own][:4] for u, own in seen.items()}
    assert got == {u: v for u, v in want.items() if v} and 50 not in got


def test_sampled_pairs(spark):
    """Nearly everything banned: the walk goes on until an item is free; rating 3 stays drawable."""
    rows = ratings(spark, 9, 40, 5).union(spark.createDataFrame([(50, i, 5.0 if i < 38 else 3.0) for i in range(39)] + [(51, i, 4.0) for i in range(40)], "user_id long, item_id long, rating double"))
    good = rows.where("rating >= 4").select("user_id", F.col("item_id").alias("good"))
    banned = rows.where("rating >= 4 or rating <= 2")
    ranks = graph.item_ranks(rows)
    items = [r["item_id"] for r in ranks.orderBy("r").collect()]
    assert items == sorted(items) and [r["r"] for r in ranks.orderBy("r").collect()] == list(range(len(items)))
    no = {}
    for r in banned.collect():
        no.setdefault(r["user_id"], set()).add(r["item_id"])
    for epoch in (1, 2):
        got = {(r["user_id"], r["good"]): r["bad"] for r in graph.sampled_pairs(good, banned, ranks, len(items), epoch, 9, tries=2).collect()}
        want = {}
        for r in good.collect():
            free = [items[k] for k in walk(len(items), 9, epoch, r["user_id"], r["good"]) if items[k] not in no[r["user_id"]]]
            if free:
                want[(r["user_id"], r["good"])] = free[0]
        assert got == want and {b for (u, _), b in got.items() if u == 50} <= {38, 39} and not any(u == 51 for u, _ in got)


def test_normals(spark):
    rows = spark.range(400).select(V.normals(F.col("id"), 7, 3).alias("v")).collect()
    x = np.array([r["v"] for r in rows])
    assert x.shape == (400, 7) and abs(x.mean()) < 0.06 and abs(x.std() - 1) < 0.05
    assert abs(np.corrcoef(x.T) - np.eye(7)).max() < 0.2
    assert spark.range(1).select(V.normals(F.lit("k"), 5).alias("v")).head()["v"] == spark.range(1).select(V.normals(F.lit("k"), 8).alias("v")).head()["v"][:5]


SETTINGS = train.Settings(width=8, layers=2, epochs=8, rate=0.05, spread=0.3)


@pytest.mark.parametrize(("model", "kind"), [("light", "string"), ("ngcf", "long")])
def test_training_learns(spark, tmp_path, model, kind):
    rows = ratings(spark, kind=kind)
    fit = train.light_gcn if model == "light" else train.ngcf
    found = fit(rows, replace(SETTINGS, drop=0.1, cosine=0.5 if model == "light" else 0.0, epochs=8 if model == "light" else 4))
    assert min(found.losses) < found.losses[0] - 0.02
    lists = train.lists_of(found.vectors, rows, 5, "GCF")
    assert lists.schema["user_id"].dataType == rows.schema["user_id"].dataType
    assert lists.join(rows, ["user_id", "item_id"]).count() == 0 and lists.count() > 0
    # saved and loaded again, the lists are the same
    where = str(tmp_path / "bundle")
    assert work.save(spark, where, model, {"vectors": found.vectors, "nodes": found.nodes}, {"width": 8, "seed": SETTINGS.seed}) == 1
    back = work.load(spark, where, model)
    assert back.settings == {"width": 8, "seed": SETTINGS.seed} and back.version == 1
    assert {tuple(r) for r in train.lists_of(back.tables["vectors"], rows, 5, "GCF").collect()} == {tuple(r) for r in lists.collect()}


def test_bundles_are_whole_or_absent(spark, tmp_path):
    where, rows = str(tmp_path / "b"), spark.range(3)
    assert work.versions(spark, where) == []
    bad = rows.select(F.raise_error(F.lit("stop")).alias("x"))
    with pytest.raises(Exception, match="stop"):
        work.save(spark, where, "ids", {"a": rows, "b": bad})
    assert work.versions(spark, where) == []
    assert [work.save(spark, where, "ids", {"a": rows.limit(n)}) for n in (1, 2)] == [1, 2]
    assert (work.load(spark, where).tables["a"].count(), work.load(spark, where, version=1).tables["a"].count()) == (2, 1)
    with pytest.raises(ValueError, match="kind"):
        work.load(spark, where, "vectors")
    with pytest.raises(FileNotFoundError):
        work.load(spark, where, version=7)


def test_numbered(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"))
    assert [tuple(r) for r in relational.numbered(rows, "k", "n").orderBy("k").collect()] == [(k, n) for n, k in enumerate(sorted(x * 7919 % 1009 for x in range(1000)))]
    assert relational.numbered(rows.limit(0), "k", "n").count() == 0


def test_work_tables_go_with_the_application(tmp_path):
    job = """
import sys
from pathlib import Path
from pyspark.sql import SparkSession
from recolumn.sources import work
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
here = lambda: len(list(Path(sys.argv[1]).glob("w*-*")))
with work.scratch() as keep:
    counts = [keep(spark.range(3)).count(), here()]
print(*counts, here(), work.held(spark.range(5)).count(), here())
spark.stop()
"""
    done = subprocess.run([sys.executable, "-c", job, str(tmp_path)], capture_output=True, text=True, timeout=120, env=os.environ, cwd=Path(__file__).resolve().parents[1])
    assert done.stdout.split() == ["3", "1", "0", "5", "1"], done.stderr
    until = time.time() + 30
    while any(tmp_path.glob("w*-*")) and time.time() < until:
        time.sleep(0.5)
    assert not list(tmp_path.glob("w*-*"))


def test_vectors_are_sent_once_a_block(spark):
    """Sums leave a block once for each of its nodes, not for each edge; a user with too many edges is dealt in several blocks."""
    rows = spark.range(60 * 30).selectExpr("id div 30 as user_id", "id % 30 as item_id", "1.0D as rating")
    names, a = norms(rows.collect())
    x = np.random.default_rng(4).normal(size=(len(names), 2))
    nodes = spark.createDataFrame([(n, v.tolist()) for n, v in zip(names, x, strict=True)], "id string, vector array<double>")
    edges = graph.degree_norm(graph.bipartite_edges(rows)).persist()
    for hot, least in ((1000, 60), (4, 200)):
        packed, parts = (t.persist() for t in graph.dealt_edges(edges, hot))
        users = parts.where("id like 'u%'").count()
        assert least <= users and (hot == 4 or users == 60)
        found = graph.block_sums(packed, parts, nodes, 2)
        assert found.count() == parts.count() <= users + 30 * packed.count() < edges.count()
        np.testing.assert_allclose(numbers(names, graph.spread(packed, parts, nodes, 2)), a @ x, atol=1e-12)


def test_own_nodes_stay_in_their_block(spark):
    """Layers and gradients by blocks are those of the whole matrix; only items, and users dealt in several blocks, are sent."""
    rows = spark.range(60 * 30).where("id % 7 < 5").selectExpr("id div 30 as user_id", "id % 30 as item_id", "1.0D as rating")
    names, a = norms(rows.collect())
    x = np.random.default_rng(4).normal(size=(len(names), 2))
    nodes = spark.createDataFrame([(n, v.tolist()) for n, v in zip([*names, "i99"], [*x, np.ones(2)], strict=True)], "id string, vector array<double>")
    edges = graph.degree_norm(graph.bipartite_edges(rows)).persist()
    want = sum(np.linalg.matrix_power(a, k) @ x for k in range(4)) / 4
    np.testing.assert_allclose(numbers([*names, "i99"], blocks.propagate(edges, nodes, 2)), [*want, [0.25, 0.25]], atol=1e-12)
    for hot in (1000, 4):
        with work.scratch() as keep:
            net = blocks.net(edges, keep, hot)
            assert net.crossed == (hot == 4)
            assert (net.parts.where("id like 'u%'").count() == 0) == (hot == 1000) and net.homes.count() == (60 if hot == 1000 else 0)
            own = net.placed(nodes, 2)
            shared = net.layers(own, nodes.join(net.homes.select("id"), "id", "left_anti"), 2, 3, keep)
            assert shared.count() == len(names) + 1 - net.homes.count()
            np.testing.assert_allclose(numbers(names, blocks.layer_mean(net, own, shared, 2, 3)), want, atol=1e-12)


def test_block_gradient(spark):
    """One epoch's gradients by blocks, with an edge share left out, are those of the shuffled form."""
    rows = ratings(spark, 12, 9)
    s = replace(SETTINGS, width=3, layers=3, drop=0.2, cosine=0.5)
    with work.scratch() as keep:
        g = train._Graph(rows, s, keep)
        net, start = g.dropped(1, keep), g.start(None)
        ids = [r["id"] for r in start.nodes(g).collect()]
        key = V.portable_hash(s.seed, "drop", 1, F.least("src", "dst"), F.greatest("src", "dst"))
        edges = graph.degree_norm(graph.bipartite_edges(rows)).where(key % 1_000_000 >= 200_000).withColumn("norm", F.col("norm") / 0.8)
        edges, parts = graph.dealt_edges(edges)
        z = keep(train.layer_mean(edges, parts, keep(start.nodes(g)), 3, 3, keep))
        pairs = keep(g.pairs(1, keep)[0].select(F.explode("pairs").alias("p")).select("p.*"))
        loss, grad = train.pair_step(pairs, z, 3, "bpr", s.cosine, keep)
        want = numbers(ids, train.layer_mean(edges, parts, grad, 3, 3, keep))
        mine = start.own.select("block", "vector")
        layers = net.layers(mine, start.shared, 3, 3, keep)
        got, own, shared = train._pair_pass(g, net, 1, train._light_finals(3, 3), layers, 12, 3, mine, "bpr", keep)
        np.testing.assert_allclose(numbers(ids, blocks.layer_mean(net, own, net.layers(own, shared, 3, 3, keep), 3, 3)), want, atol=1e-12)
    assert abs(got - loss) < 1e-12


@pytest.mark.parametrize("hot", [1000, 3])
def test_ngcf_block_gradient(spark, hot):
    """NGCF by blocks gives the loss and gradients of the shuffled form, also where users are dealt in several blocks."""
    rows = ratings(spark, 12, 9)
    s = replace(SETTINGS, width=3, layers=2, drop=0.0)
    draw = np.random.default_rng(2)
    weights = [draw.normal(size=(3, 3)) for _ in range(4)]
    with work.scratch() as keep:
        g = train._Graph(rows, s, keep)
        g.net, start = blocks.net(graph.degree_norm(graph.bipartite_edges(rows)), keep, hot), None
        start = g.start(None)
        nodes = keep(start.nodes(g))
        ids = [r["id"] for r in nodes.collect()]
        edges, parts = graph.dealt_edges(graph.degree_norm(graph.bipartite_edges(rows)))
        tables = train.ngcf_forward(edges, parts, nodes, weights, 3, keep, 4, 0.3, 7)
        pairs = keep(g.pairs(1, keep)[0].select(F.explode("pairs").alias("p")).select("p.*"))
        loss, grad = train.pair_step(pairs, keep(train.joined_layers(tables)), 9, "cross_entropy", 0.0, keep)
        want, totals = train.ngcf_backward(edges, parts, tables, keep(grad), weights, 3, keep, 4, 0.3, 7)
        step = train._Ngcf(weights, 3, 4, 0.3, 7)
        mine = start.own.select("block", "vector")
        shared = step.shared_layers(g.net, mine, start.shared, keep)
        np.testing.assert_allclose(numbers(ids, step.joined(g.net, mine, shared)), numbers(ids, train.joined_layers(tables)), atol=1e-12)
        got, own, theirs = train._pair_pass(g, g.net, 1, step.finals, shared.select("id", "vector"), 9, 9, mine, "cross_entropy", keep)
        via, last, found = step.gradients(g.net, mine, own.withColumnRenamed("vector", "grad"), shared, theirs, keep)
        run = lambda block: train.pa.table({"id": block.own, "vector": train.lists(step.own_gradient(block))})
        both = g.net.over(run, train.NODE, via, 4 * 3, mine, own.withColumnRenamed("vector", "grad")).union(last)
        np.testing.assert_allclose(numbers(ids, both), numbers(ids, want), atol=1e-12)
    assert abs(got - loss) < 1e-12
    for a, b in zip(found, totals, strict=True):
        np.testing.assert_allclose(a, b, atol=1e-12)
