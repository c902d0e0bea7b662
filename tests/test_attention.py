"""The attention stack against a dense version."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from recolumn.operators import attention as A
from recolumn.operators import graph as G


def dense(names, x, edges, layer, targets):
    """edges: {dst: [(src, w)]}."""
    heads, size = layer.score.shape
    at = {n: k for k, n in enumerate(names)}
    left, right = x @ layer.left + layer.left_bias, x @ layer.right + layer.right_bias
    out = []
    for t in targets:
        near = [*edges.get(t, []), (t, np.mean([w for _, w in edges[t]]) if edges.get(t) else 0.0)]
        z = np.array([left[at[s]] + right[at[t]] + w * layer.edge for s, w in near])
        z = np.where(z > 0, z, 0.2 * z).reshape(-1, heads, size)
        e = (z * layer.score).sum(2)
        a = np.exp(e - e.max(0)) / np.exp(e - e.max(0)).sum(0)
        v = sum(a[k][:, None] * left[at[s]].reshape(heads, size) for k, (s, _) in enumerate(near)).ravel() + layer.bias
        v = (v - v.mean()) / np.sqrt(v.var() + 1e-5) * layer.gain + layer.shift
        own = x[at[t]]
        out.append(np.where(v > 0, v, 0.01 * v) + (own if layer.residual is None else own @ layer.residual + layer.residual_bias))
    return np.array(out)


@pytest.fixture(scope="module")
def sample(spark):
    draw = np.random.default_rng(1)
    names = [f"n{k:02d}" for k in range(14)] + ["alone"]
    x = draw.normal(size=(15, 6))
    pairs = sorted({(names[a], names[b]) for a, b in draw.integers(0, 14, (60, 2)) if a != b} | {(n, "n00") for n in names[1:14]})
    rows = [(s, d, float(draw.integers(1, 6))) for s, d in pairs]
    nodes = spark.createDataFrame([(n, v.tolist()) for n, v in zip(names, x, strict=True)], "id string, vector array<double>")
    return names, x, rows, spark.createDataFrame(rows, "src string, dst string, w double").repartition(4), nodes


def layers():
    out = A.seeded_layers(6, (5, 5, 4), (3, 3, 1))
    # scores of hundreds: the softmax must not overflow
    return [A.Layer(**{**out[0].__dict__, "score": out[0].score * 300}), *out[1:]]


def test_stack(spark, sample):
    names, x, rows, edges, nodes = sample
    near = {}
    for s, d, w in rows:
        near.setdefault(d, []).append((s, w))
    want = x
    for layer in layers():
        want = dense(names, want, near, layer, names)
    got = {r["id"]: r["vector"] for r in A.attention_stack(edges, nodes, layers()).collect()}
    assert sorted(got) == sorted(names)
    np.testing.assert_allclose(np.array([got[n] for n in names]), want, atol=1e-9)


def test_sampled_stack(spark, sample):
    names, x, rows, edges, nodes = sample
    seeds, most = ["n00", "n05", "alone"], (2, 3, 4)
    order = lambda layer, s, d: (int(hashlib.md5(f"42:{layer}:{s}:{d}".encode()).hexdigest()[:15], 16), s)
    blocks, targets = [], seeds
    for layer in (2, 1, 0):
        near = {t: sorted((s for s, d, _ in rows if d == t), key=lambda s, t=t: order(layer, s, t))[: most[layer]] for t in targets}
        blocks.append((near, targets))
        targets = sorted({*targets, *(s for own in near.values() for s in own)})
    own, at = x[[names.index(t) for t in targets]], targets
    for layer, (near, targets) in zip(layers(), blocks[::-1], strict=True):
        own = dense(at, own, {d: [(s, 0.0) for s in v] for d, v in near.items()}, layer, targets)
        at = targets
    got = {r["id"]: r["vector"] for r in A.sampled_stack(edges, nodes, spark.createDataFrame([(s,) for s in seeds], "id string"), layers(), most).collect()}
    assert sorted(got) == sorted(seeds)
    np.testing.assert_allclose(np.array([got[s] for s in seeds]), own, atol=1e-9)


def test_empty_graph(spark, sample):
    *_, edges, nodes = sample
    assert A.attention_stack(edges.limit(0), nodes, layers()[:1]).count() == 15
    assert A.attention_stack(edges.limit(0), nodes.limit(0), layers()[:1]).where(F.size("vector") > 0).count() == 0


def shuffled(spark):
    """Bytes that the session has shuffled so far."""
    store, sc = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext
    stages = store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


@pytest.fixture(scope="module")
def dense_graph(spark):
    """Users by items, each rated; one item has no vector and one user is no node."""
    draw, width = np.random.default_rng(6), 96
    pairs = [(f"u{u}", f"i{i}", float((u * i) % 5 + 1)) for u in range(40) for i in range(50)]
    rows = [*pairs, *((d, s, w) for s, d, w in pairs)]
    x = {n: draw.normal(size=width) for n in [f"u{u}" for u in range(39)] + [f"i{i}" for i in range(50)]}
    table = spark.createDataFrame([(n, None if n == "i49" else v.tolist()) for n, v in x.items()], "id string, vector array<double>").repartition(4).persist()
    return rows, x, spark.createDataFrame(rows, "src string, dst string, w double").repartition(4).persist(), table, width


@pytest.mark.parametrize("hot", [1000, 7])
def test_head_sends_no_vector_with_an_edge(spark, dense_graph, hot, request):
    rows, x, edges, table, width = dense_graph
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.autoBroadcastJoinThreshold"))
    before = shuffled(spark) + 0 * edges.count() * table.count()
    weights = G.gat_attention(edges, table, **({} if hot == 1000 else {"hot": hot}))
    got = {(r["src"], r["dst"]): r["alpha"] for r in weights.collect()}
    found = {r["id"]: r["vector"] for r in G.attend(weights, table, width, **({} if hot == 1000 else {"hot": hot})).collect()}
    assert hot == 7 or shuffled(spark) - before < len(rows) * width * 8
    near = {}
    for s, d, w in rows:
        near.setdefault(d, []).append((s, w))
    for d, own in near.items():
        own = [(s, w) for s, w in [*own, (d, np.mean([w for _, w in own]))] if s in x and d in x]
        assert not own or {s for s, t in got if t == d} == {s for s, _ in own}
        if d == "i49":
            assert all(got[(s, d)] is None for s, _ in own) and set(found[d]) == {None}
        elif own:
            assert got.get(("i49", d)) is None
            own = [(s, w) for s, w in own if s != "i49"]
            z = np.array([x[s] + x[d] + w for s, w in own])
            e = np.where(z > 0, z, 0.2 * z).sum(1)
            a = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
            np.testing.assert_allclose([got[(s, d)] for s, _ in own], a, atol=1e-9)
            np.testing.assert_allclose(found[d], sum(k * x[s] for k, (s, _) in zip(a, own, strict=True)), atol=1e-9)
    assert "u39" not in found


@pytest.mark.parametrize("hot", [1000, 7])
def test_stack_sends_no_vector_with_an_edge(spark, dense_graph, hot, request):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.autoBroadcastJoinThreshold"))
    rows, x, edges, table, width = dense_graph
    layers = A.seeded_layers(width, (24, 24), (4, 4))
    names = sorted(set(x) - {"i49"})
    near = {}
    for s, d, w in rows:
        if s in names and d in names:
            near.setdefault(d, []).append((s, w))
    # a loop has the mean weight of all edges, those from nodes without a vector too
    edges = edges.where(F.col("src").isin(names) & F.col("dst").isin(names))
    want = np.array([x[n] for n in names])
    for layer in layers:
        want = dense(names, want, near, layer, names)
    before = shuffled(spark)
    got = {r["id"]: r["vector"] for r in A.attention_stack(edges, table, layers, **({} if hot == 1000 else {"hot": hot})).collect()}
    assert hot == 7 or shuffled(spark) - before < len(layers) * len(rows) * width * 8
    np.testing.assert_allclose(np.array([got[n] for n in names]), want, atol=1e-9)
    assert "i49" not in got
