"""Training of graph recommenders: LightGCN and NGCF by full-batch steps over propagated vectors.

The normalised adjacency is symmetric, so gradients travel backwards through the same joins as
vectors travel forwards. Node vectors and their two Adam moments are one table, written anew in
each epoch; an epoch's other tables are deleted when it ends. What is dense (weights of a layer, a row's
gradient, Adam) is numpy over Arrow batches; sums over neighbours and over pairs are grouped sums, combined before
the shuffle. The driver holds the loss, the learning rate and NGCF's weight matrices.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.work import freed, held, scratch
from . import blocks
from .dense import lists, matrix
from .factor import lists_from_vectors
from .graph import HOT, bipartite_edges, by_block, columns, dealt_edges, degree_norm, drawn_pairs, in_blocks, item_ranks, layer_mean, listed_edges, needed, packed, positions, sent, spread, walkers  # noqa: F401

BETAS, TINY = (0.9, 0.999), 1e-8
NODE = "id string, vector array<double>"


@dataclass(frozen=True)
class Settings:
    """Full-batch AdamW. The rate falls by `factor` after more than `plateau` epochs without a new best loss; training ends after `patience` of them."""

    width: int = 64
    layers: int = 3
    epochs: int = 300
    rate: float = 1e-3
    decay: float = 1e-5
    factor: float = 0.4
    plateau: int = 5
    patience: int = 15
    cosine: float = 0.0  # weight of 1 - mean cosine of user and positive item
    drop: float = 0.0  # share of edges (LightGCN) or of message components (NGCF) left out of an epoch
    spread: float = 0.1  # standard deviation of seeded starting vectors
    seed: int = 42


@dataclass
class Trained:
    """`nodes`: the trained (id, vector) with the lowest loss; `vectors`: the same, propagated; `losses`: by epoch; `weights`: NGCF's matrices."""

    nodes: DataFrame
    vectors: DataFrame
    losses: list[float]
    weights: list[np.ndarray] = field(default_factory=list)


class Schedule:
    """Plateau and early-stop rules over the losses seen so far."""

    def __init__(self, settings: Settings):
        self.settings, self.rate, self.best = settings, settings.rate, np.inf
        self.since, self.calm = 0, 0

    def improved(self, loss: float) -> bool:
        """Takes an epoch's loss; True if it is the best so far."""
        if loss < self.best:
            self.best, self.since, self.calm = loss, 0, 0
            return True
        self.since, self.calm = self.since + 1, self.calm + 1
        if self.calm > self.settings.plateau:
            self.rate, self.calm = self.rate * self.settings.factor, 0
        return False

    @property
    def over(self) -> bool:
        return self.since >= self.settings.patience


# -- dense steps over Arrow batches


def pair_gradients(u: np.ndarray, g: np.ndarray, b: np.ndarray, kind: str, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Loss of each pair and its gradients by user, good and bad vector. kind: bpr, or cross_entropy of both scores."""
    good, bad = (u * g).sum(1), (u * b).sum(1)
    below = lambda x: 1 / (1 + np.exp(np.clip(x, -500, 500)))  # sigmoid(-x)
    if kind == "bpr":
        loss, up = np.logaddexp(0, bad - good), -below(good - bad)
        down = -up
    else:
        loss, up, down = (np.logaddexp(0, -good) + np.logaddexp(0, bad)) / 2, -below(good) / 2, below(-bad) / 2
    du, dg, db = up[:, None] * g + down[:, None] * b, up[:, None] * u, down[:, None] * u
    if cosine:
        a, c = (np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) for x in (u, g))
        near = (good[:, None]) / (a * c)
        loss = loss + cosine * (1 - near[:, 0])
        du, dg = du - cosine * (g / (a * c) - near * u / a**2), dg - cosine * (u / (a * c) - near * g / c**2)
    return loss, du, dg, db


def _pair_rows(kind: str, cosine: float, width: int, some: int = 1 << 14):
    """A block's gradients summed by node, and one row without id that holds its loss."""

    def run(pairs: pa.Table, vectors: pa.Table) -> pa.Table:
        at = [positions(pairs.column(c).combine_chunks(), vectors) for c in "ugb"]
        # a pair takes part if all three of its nodes have vectors
        on = np.flatnonzero(np.all([x < vectors.num_rows for x in at], axis=0))
        x, total, loss = np.ascontiguousarray(columns(vectors, width).T), np.zeros((width, vectors.num_rows + 1)), 0.0
        for i in range(0, len(on), some):
            ids = [k[on[i : i + some]] for k in at]
            own, *grads = pair_gradients(*(x[k] for k in ids), kind, cosine)
            loss += float(own.sum())
            ids = np.concatenate(ids)
            for sums, grad in zip(total, np.concatenate(grads).T, strict=True):
                sums += np.bincount(ids, grad, len(sums))
        names = pa.concat_arrays([vectors.column("id").combine_chunks().cast(pa.string()), pa.array([None], pa.string())])
        total = total.T
        total[-1, 0] = loss
        return pa.table({"id": names, "vector": lists(total)})

    return run


def pair_step(pairs: DataFrame, vectors: DataFrame, width: int, kind: str, cosine: float, keep) -> tuple[float, DataFrame]:
    """Mean loss of (u, g, b) node pairs under `vectors`, and its gradient by node. Pairs are dealt in blocks by user; a vector is sent once to each block that reads it."""
    n = pairs.count()
    pairs = keep.cached(by_block(in_blocks(pairs, "u", "g", n, HOT)))
    run = _pair_rows(kind, cosine, width)
    rows = keep(pairs.groupBy("block").cogroup(sent(vectors, needed(pairs, "u", "g", "b")).groupBy("to")).applyInArrow(lambda a, b: run(a, b), NODE))
    loss = (rows.where("id is null").agg(F.sum(F.get("vector", F.lit(0)))).head()[0] or 0.0) / max(n, 1)
    sums = rows.where("id is not null").groupBy("id").agg(V.sum_by_position("vector", width).alias("vector"))
    return loss, sums.select("id", F.transform("vector", lambda x: x / max(n, 1)).alias("vector"))


def adam(x, m, v, grad, turn: int, rate: float, decay: float):
    """One AdamW step: new values and moments."""
    m, v = BETAS[0] * m + (1 - BETAS[0]) * grad, BETAS[1] * v + (1 - BETAS[1]) * grad * grad
    move = (m / (1 - BETAS[0] ** turn)) / (np.sqrt(v / (1 - BETAS[1] ** turn)) + TINY)
    return x * (1 - rate * decay) - rate * move, m, v


def _adam_rows(width: int, turn: int, rate: float, decay: float):
    def run(batches):
        for batch in batches:
            x, m, v = (matrix(batch.column(k)).reshape(-1, width) for k in (1, 2, 3))
            grad = np.zeros_like(x)
            on = batch.column(4).is_valid().to_numpy(zero_copy_only=False)
            grad[on] = matrix(batch.column(4).drop_null()).reshape(-1, width)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(lists, adam(x, m, v, grad, turn, rate, decay))], names=["id", "vector", "m", "v"])

    return run


def stepped(state: DataFrame, grad: DataFrame, width: int, turn: int, rate: float, decay: float) -> DataFrame:
    """The node table (id, vector, m, v) after one step."""
    rows = state.join(grad.withColumnRenamed("vector", "grad"), "id", "left").select("id", "vector", "m", "v", "grad")
    return rows.mapInArrow(_adam_rows(width, turn, rate, decay), "id string, vector array<double>, m array<double>, v array<double>")


# -- training


class _Graph:
    """What every epoch reads: edges in blocks, positives, items that are no negatives, item ranks."""

    def __init__(self, train: DataFrame, settings: Settings, keep):
        train = keep(train.select("user_id", "item_id", F.col("rating").cast("double").alias("rating")).dropna())
        self.net = blocks.net(keep(degree_norm(bipartite_edges(train))), keep)
        good = train.where("rating >= 4").select("user_id", F.col("item_id").alias("good")).distinct()
        # a rating between the two poles does not keep an item from being drawn
        banned = train.where("rating >= 4 or rating <= 2").select("user_id", "item_id").distinct()
        self.ranks = keep(item_ranks(train))
        self.total = self.ranks.count()
        self.good, self.banned = map(keep.cached, walkers(good, banned, self.ranks))
        self.settings = settings

    def pairs(self, epoch: int, keep) -> tuple[DataFrame, DataFrame, int]:
        """(block, pairs) with the epoch's pairs beside their user's edges, (id, block) of the vectors that they read, and their number."""
        rows = drawn_pairs(self.good, self.banned, self.ranks, self.total, epoch, self.settings.seed)
        rows = self.net.dealt(rows.select(F.concat(F.lit("u"), "user_id").alias("u"), F.concat(F.lit("i"), "good").alias("g"), F.concat(F.lit("i"), "bad").alias("b")), "u", "g")
        rows = keep.cached(by_block(keep(rows)).groupBy("block").agg(F.collect_list(F.struct("u", "g", "b")).alias("pairs")))
        parts = self.net.parts.unionByName(rows.select("block", F.explode(F.array_distinct("pairs.b")).alias("id"))).distinct()
        return rows, parts, rows.agg(F.sum(F.size("pairs"))).head()[0] or 0

    def dropped(self, epoch: int, keep) -> blocks.Net:
        """The epoch's edges: both directions of a rating go together, and the rest grows so that sums keep their mean."""
        return self.net.thinned(f"{self.settings.seed}:drop:{epoch}", self.settings.drop, keep) if self.settings.drop else self.net

    def start(self, nodes: DataFrame | None) -> _State:
        """Given node vectors, others seeded, with zero moments."""
        s = self.settings
        seeded = F.transform(V.normals(F.col("id"), s.width, s.seed), lambda x: x * s.spread)

        def rows(ids: DataFrame) -> DataFrame:
            if nodes is None:
                return ids.select("id", seeded.alias("vector"))
            given = nodes.select("id", V.doubles(F.col("vector")).alias("given"))
            return ids.join(given, "id", "left").select("id", F.coalesce("given", seeded).alias("vector"))

        zero = F.transform("vector", lambda x: F.lit(0.0))
        own, shared = self.net.placed(rows(self.net.homes.select("id")), s.width), rows(self.net.parts.select("id").distinct())
        return _State(*(held(t.withColumns({"m": zero, "v": zero})) for t in (own, shared)))


@dataclass
class _State:
    """Vectors and moments between two epochs: (block, vector, m, v) of the blocks' own nodes and (id, vector, m, v) of shared ones."""

    own: DataFrame
    shared: DataFrame

    def freed(self) -> None:
        freed(self.own, self.shared)

    def nodes(self, graph: _Graph) -> DataFrame:
        width = graph.settings.width
        run = lambda block: pa.table({"id": block.own, "vector": lists(block.state("vector", width))})
        return graph.net.over(run, NODE, self.shared, width, self.own.select("block", "vector")).union(self.shared.select("id", "vector"))


def _pair_sums(finals, kind: str, cosine: float, n: int, some: int = 1 << 14):
    """A block's gradients, divided by n: its own nodes' in one row with its number, shared ones' by id, and its loss in a row with neither. `finals` gives the vectors of both that are compared."""

    def run(block: blocks.Block) -> pa.Table:
        own, rest = finals(block)
        x, names = np.concatenate([own, rest]), pa.concat_arrays([block.own, block.ids])
        pairs = block.flat("pairs")
        at = [pc.index_in(pairs.field(k), value_set=names).fill_null(len(names)).to_numpy(zero_copy_only=False) for k in range(3)]
        on = np.flatnonzero(np.all([k < len(names) for k in at], axis=0))
        total, loss = np.zeros((x.shape[1], len(x))), 0.0
        for i in range(0, len(on), some):
            ids = [k[on[i : i + some]] for k in at]
            losses, *grads = pair_gradients(*(x[k] for k in ids), kind, cosine)
            loss += float(losses.sum())
            ids = np.concatenate(ids)
            for sums, grad in zip(total, np.concatenate(grads).T, strict=True):
                sums += np.bincount(ids, grad, len(sums))
        total = total.T / max(n, 1)
        vectors = pa.concat_arrays([blocks.flat(total[: len(own)]), lists(total[len(own) : -1]), blocks.flat(np.array([[loss]]))])
        return pa.table({"block": pa.array([block.number, *[None] * (len(rest))], pa.int32()), "id": pa.concat_arrays([pa.nulls(1, pa.string()), block.ids, pa.nulls(1, pa.string())]), "vector": vectors})

    return run


def _pair_pass(graph: _Graph, net: blocks.Net, epoch: int, finals, rows: DataFrame, sent: int, width: int, own: DataFrame, kind: str, keep) -> tuple[float, DataFrame, DataFrame]:
    """Mean loss of an epoch's pairs and its gradients by the compared vectors of `width`: (block, vector) of own nodes and (id, vector) of shared ones."""
    pairs, parts, n = graph.pairs(epoch, keep)
    found = net.over(_pair_sums(finals, kind, graph.settings.cosine, n), "block int, id string, vector array<double>", rows, sent, own, pairs, parts=parts)
    found = keep(found)
    loss = (found.where("block is null and id is null").agg(F.sum(F.get("vector", F.lit(0)))).head()[0] or 0.0) / max(n, 1)
    shared = found.where("id is not null").groupBy("id").agg(V.sum_by_position("vector", width).alias("vector"))
    return loss, keep.cached(by_block(found.where("block is not null").select("block", "vector"))), keep(shared)


def _light_finals(width: int, layers: int):
    def finals(block: blocks.Block) -> tuple[np.ndarray, np.ndarray]:
        return blocks.mean_own(block, block.state("vector", width), width, layers), block.all.reshape(-1, layers + 1, width).mean(1)

    return finals


STATE = "block int, vector array<double>, m array<double>, v array<double>"


def _own_step(gradient, width: int, turn: int, rate: float, decay: float):
    """The blocks' own nodes after an Adam step with gradient(block)."""

    def run(block: blocks.Block) -> pa.Table:
        new = adam(*(block.state(c, width) for c in ("vector", "m", "v")), gradient(block), turn, rate, decay)
        return pa.table({"block": pa.array([block.number], pa.int32()), **dict(zip(("vector", "m", "v"), map(blocks.flat, new), strict=True))})

    return run


def light_gcn(train: DataFrame, settings: Settings | None = None, nodes: DataFrame | None = None) -> Trained:
    """Vectors of users and items under mean-of-layers propagation, by BPR with negatives drawn per epoch.

    Positives are ratings of at least 4; negatives neither these nor ratings up to 2. `nodes` (id, vector)
    gives starting vectors, such as text embeddings; other nodes get seeded ones.
    """
    s = settings or Settings()
    width, layers = s.width, s.layers
    with scratch() as keep:
        graph = _Graph(train, s, keep)
        state = best = graph.start(nodes)
        schedule, losses = Schedule(s), []
        for epoch in range(1, s.epochs + 1):
            with scratch() as own:
                net, mine = graph.dropped(epoch, own), own.cached(by_block(state.own))
                vectors = mine.select("block", "vector")
                rows = net.layers(vectors, state.shared, width, layers, own)
                loss, grad, shared = _pair_pass(graph, net, epoch, _light_finals(width, layers), rows, (layers + 1) * width, width, vectors, "bpr", own)
                losses.append(loss)
                better = schedule.improved(loss)
                if better and best is not state:
                    best.freed()
                    best = state
                if schedule.over:
                    break
                # the map is linear and symmetric: applied to gradients it is its own backward pass
                rows = net.layers(grad, shared, width, layers, own)
                step = _own_step(lambda block: blocks.mean_own(block, block.state("grad", width), width, layers), width, epoch, schedule.rate, s.decay)
                new = held(net.over(step, STATE, rows, (layers + 1) * width, mine, grad.withColumnRenamed("vector", "grad")))
                new = _State(new, held(stepped(state.shared, blocks.mean_of(rows, width, layers), width, epoch, schedule.rate, s.decay)))
            if state is not best:
                state.freed()
            state = new
        if state is not best:
            state.freed()
        start = keep.cached(by_block(best.own.select("block", "vector")))
        out = held(blocks.layer_mean(graph.net, start, graph.net.layers(start, best.shared, width, layers, keep), width, layers))
        return Trained(held(best.nodes(graph)), out, losses)


def ngcf_weights(settings: Settings) -> list[np.ndarray]:
    """Seeded matrices W1, W2 of each layer, uniform within the usual bound."""
    draw, bound = np.random.default_rng(settings.seed), np.sqrt(3 / settings.width)
    return [draw.uniform(-bound, bound, (settings.width, settings.width)) for _ in range(2 * settings.layers)]


def _kept_components(ids: pa.Array, width: int, seed: int, epoch: int, layer: int, drop: float) -> np.ndarray:
    """0 or 1 / (1 - drop) for each component of each node: a function of id, epoch and layer, so a task that runs again drops the same."""
    if not drop or not epoch:
        return np.ones((len(ids), width))
    from zlib import crc32

    base = np.array([crc32(i.encode()) for i in ids.to_pylist()], np.uint64)[:, None] << np.uint64(20)
    h = (base + np.uint64(((seed * 1009 + epoch) * 16 + layer) * 1_000_003) + np.arange(width, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(11)) / float(1 << 53) >= drop) / (1 - drop)


def ngcf_value(h: np.ndarray, s: np.ndarray, w1: np.ndarray, w2: np.ndarray) -> np.ndarray:
    """(h + s) W1 + (h * s) W2 for own vectors h and neighbour sums s."""
    return (h + s) @ w1 + (h * s) @ w2


def _ngcf_forward(w1, w2, mask):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                z = ngcf_value(matrix(batch.column(1)), matrix(batch.column(2)), w1, w2)
                yield pa.RecordBatch.from_arrays([batch.column(0), lists(np.where(z > 0, z, 0.2 * z) * mask(batch.column(0)))], names=["id", "vector"])

    return run


def _ngcf_backward(w1, w2, mask):
    """Rows (id, direct, via): gradient by the own vector, and what travels on to the neighbours; and a row without id with the gradients of both matrices."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            h, s, d = (matrix(batch.column(k)) for k in (1, 2, 3))
            z = ngcf_value(h, s, w1, w2)
            d = d * mask(batch.column(0)) * np.where(z > 0, 1.0, 0.2)
            both, cross = d @ w1.T, d @ w2.T
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(both + cross * s), lists(both + cross * h)], names=["id", "direct", "via"])
            total = np.concatenate([((h + s).T @ d).ravel(), ((h * s).T @ d).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), lists(total[None]), lists(np.zeros((1, 0)))], names=["id", "direct", "via"])

    return run


def ngcf_forward(edges: DataFrame, parts: DataFrame, nodes: DataFrame, weights: list[np.ndarray], width: int, keep, epoch: int = 0, drop: float = 0.0, seed: int = 42) -> list[DataFrame]:
    """Tables of each layer, from the start vectors on: (id, vector, s) with the neighbour sums that the next layer reads; the last one has none."""
    zero, out, rows = F.array_repeat(F.lit(0.0), width), [], nodes.select("id", "vector")
    for layer in range(len(weights) // 2):
        near = spread(edges, parts, rows, width).withColumnRenamed("vector", "s")
        rows = keep(rows.join(near, "id", "left").select("id", "vector", F.coalesce("s", zero).alias("s")))
        out.append(rows)
        mask = lambda ids, layer=layer: _kept_components(ids, width, seed, epoch, layer, drop)
        rows = rows.mapInArrow(_ngcf_forward(*weights[2 * layer : 2 * layer + 2], mask), NODE)
    return [*out, keep(rows)]


def joined_layers(tables: list[DataFrame]) -> DataFrame:
    """All layers' vectors of a node, one after another."""
    rows = tables[0].select("id", F.col("vector").alias("v0"))
    for k, table in enumerate(tables[1:], 1):
        rows = rows.join(table.select("id", F.col("vector").alias(f"v{k}")), "id")
    return rows.select("id", F.concat(*[f"v{k}" for k in range(len(tables))]).alias("vector"))


def ngcf_backward(edges: DataFrame, parts: DataFrame, tables: list[DataFrame], grad: DataFrame, weights: list[np.ndarray], width: int, keep, epoch: int = 0, drop: float = 0.0, seed: int = 42) -> tuple[DataFrame, list[np.ndarray]]:
    """Gradient by the start vectors and by each matrix, from `grad` by the joined layers."""
    zero, totals = F.array_repeat(F.lit(0.0), width), [None] * len(weights)
    piece = lambda k: grad.select("id", F.slice("vector", k * width + 1, width).alias("own"))
    later, layers = None, len(weights) // 2
    for layer in reversed(range(layers)):
        given = piece(layer + 1).withColumnRenamed("own", "d")
        if later is not None:
            given = given.join(later.withColumnRenamed("vector", "more"), "id", "full").select("id", F.zip_with(F.coalesce("d", zero), F.coalesce("more", zero), lambda a, b: a + b).alias("d"))
        rows = tables[layer].join(given, "id", "left").select("id", "vector", "s", F.coalesce("d", zero).alias("d"))
        mask = lambda ids, layer=layer: _kept_components(ids, width, seed, epoch, layer, drop)
        back = keep(rows.mapInArrow(_ngcf_backward(*weights[2 * layer : 2 * layer + 2], mask), "id string, direct array<double>, via array<double>"))
        sums = back.where("id is null").select(F.posexplode("direct").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).toPandas()
        total = np.zeros(2 * width * width)
        total[sums.k.to_numpy()] = sums.x.to_numpy()
        totals[2 * layer], totals[2 * layer + 1] = (t.reshape(width, width) for t in np.split(total, 2))
        back = back.where("id is not null")
        sent = spread(edges, parts, back.select("id", F.col("via").alias("vector")), width)
        later = back.select("id", F.col("direct").alias("vector")).union(sent).groupBy("id").agg(V.sum_by_position("vector", width).alias("vector"))
    both = later.union(piece(0).withColumnRenamed("own", "vector")).groupBy("id").agg(V.sum_by_position("vector", width).alias("vector"))
    return both, totals


def _matrix_totals(rows: DataFrame, width: int) -> np.ndarray:
    """Sum of list columns of 2 * width * width values, added up by place."""
    sums = rows.select(F.posexplode("vector").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).toPandas()
    total = np.zeros(2 * width * width)
    total[sums.k.to_numpy()] = sums.x.to_numpy()
    return total


@dataclass
class _Ngcf:
    """NGCF by blocks: own nodes' layers are computed anew from those of the shared ones wherever they are read."""

    weights: list[np.ndarray]
    width: int
    epoch: int = 0
    drop: float = 0.0
    seed: int = 42

    @property
    def layers(self) -> int:
        return len(self.weights) // 2

    def mask(self, ids: pa.Array, layer: int) -> np.ndarray:
        return _kept_components(ids, self.width, self.seed, self.epoch, layer, self.drop)

    def part(self, x: np.ndarray, k: int) -> np.ndarray:
        return x[:, k * self.width : (k + 1) * self.width]

    def own(self, block: blocks.Block, upto: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Vectors of layers 0 to `upto` of a block's own nodes, and their neighbour sums."""
        h, s = [block.state("vector", self.width)], []
        for k in range(upto):
            s.append(block.to_own(self.part(block.x, k)))
            z = ngcf_value(h[k], s[k], *self.weights[2 * k : 2 * k + 2])
            h.append(np.where(z > 0, z, 0.2 * z) * self.mask(block.own, k))
        return h, s

    def finals(self, block: blocks.Block) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(self.own(block, self.layers)[0], axis=1), block.all

    def shared_layers(self, net: blocks.Net, own: DataFrame, shared: DataFrame, keep) -> DataFrame:
        """(id, vector, s) of the shared nodes: all layers one after another, and the neighbour sums of all but the last."""
        width, rows = self.width, shared.select("id", "vector", F.array().cast("array<double>").alias("s"))
        zero = F.array_repeat(F.lit(0.0), width)
        for k in range(self.layers):
            run = lambda block, k=k: block.rows(block.to_shared(self.own(block, k)[0][k]) + block.across(self.part(block.x, k)))
            near = net.over(run, NODE, rows, (k + 1) * width, own).groupBy("id").agg(V.sum_by_position("vector", width).alias("near"))
            rows = keep(rows.join(near, "id", "left").select("id", "vector", F.concat("s", F.coalesce("near", zero)).alias("s")))
            last = rows.select("id", F.slice("vector", k * width + 1, width).alias("h"), F.slice("s", k * width + 1, width).alias("s"))
            new = last.mapInArrow(_ngcf_forward(*self.weights[2 * k : 2 * k + 2], lambda ids, k=k: self.mask(ids, k)), NODE)
            rows = rows.join(new.withColumnRenamed("vector", "new"), "id").select("id", F.concat("vector", "new").alias("vector"), "s")
        return keep(rows)

    def joined(self, net: blocks.Net, own: DataFrame, shared: DataFrame) -> DataFrame:
        """All layers' vectors of every node, one after another."""
        run = lambda block: pa.table({"id": block.own, "vector": lists(self.finals(block)[0])})
        return net.over(run, NODE, shared, (self.layers + 1) * self.width, own).union(shared.select("id", "vector"))

    def back(self, block: blocks.Block, layer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What a layer passes to its own nodes and to their neighbours, and the gradients of its matrices; sent: layers but the last, then what later ones pass, latest first."""
        h, s = self.own(block, self.layers)
        grad, later = block.state("grad", (self.layers + 1) * self.width), 0.0
        for k in range(self.layers - 1, layer - 1, -1):
            w1, w2 = self.weights[2 * k : 2 * k + 2]
            d = (self.part(grad, k + 1) + later) * self.mask(block.own, k) * np.where(ngcf_value(h[k], s[k], w1, w2) > 0, 1.0, 0.2)
            both, cross = d @ w1.T, d @ w2.T
            direct, via = both + cross * s[k], both + cross * h[k]
            if k > layer:
                later = direct + block.to_own(self.part(block.x, 2 * self.layers - 1 - k))
        return direct, via, np.concatenate([((h[layer] + s[layer]).T @ d).ravel(), ((h[layer] * s[layer]).T @ d).ravel()])

    def own_gradient(self, block: blocks.Block) -> np.ndarray:
        """Gradient by the start of a block's own nodes, once all layers' `via` are sent."""
        return self.back(block, 0)[0] + block.to_own(self.part(block.x, 2 * self.layers - 1)) + self.part(block.state("grad", (self.layers + 1) * self.width), 0)

    def gradients(self, net: blocks.Net, own: DataFrame, grad: DataFrame, shared: DataFrame, theirs: DataFrame, keep) -> tuple[DataFrame, DataFrame, list[np.ndarray]]:
        """What the own nodes' gradient reads (id, vector), the shared nodes' gradient by their start, and that by each matrix. `grad`: (block, grad), `theirs`: (id, vector), by all layers."""
        width, layers, totals = self.width, self.layers, [None] * (2 * self.layers)
        zero = F.array_repeat(F.lit(0.0), (layers + 1) * width)
        piece = lambda c, k: F.slice(c, k * width + 1, width)
        rows = shared.join(theirs.withColumnRenamed("vector", "grad"), "id", "left")
        rows = keep(rows.select("id", F.slice("vector", 1, layers * width).alias("vector"), "s", F.coalesce("grad", zero).alias("grad"), piece(zero, 0).alias("later")))
        for layer in reversed(range(layers)):
            d = F.zip_with(piece("grad", layer + 1), "later", lambda a, b: a + b)
            back = keep(rows.select("id", piece("vector", layer), piece("s", layer), d).mapInArrow(_ngcf_backward(*self.weights[2 * layer : 2 * layer + 2], lambda ids, layer=layer: self.mask(ids, layer)), "id string, direct array<double>, via array<double>"))
            rows = keep(rows.join(back, "id").select("id", F.concat("vector", "via").alias("vector"), "s", "grad", "direct"))
            sent = (2 * layers - layer) * width

            def run(block, layer=layer):
                _, via, total = self.back(block, layer)
                sums = block.to_shared(via) + block.across(self.part(block.x, 2 * layers - 1 - layer))
                return pa.table({"id": pa.concat_arrays([block.shared, pa.nulls(1, pa.string())]), "vector": pa.concat_arrays([lists(sums), lists(total[None])])})

            found = keep(net.over(run, NODE, rows, sent, own, grad))
            total = _matrix_totals(found.where("id is null").select("vector").union(back.where("id is null").select("direct")), width)
            totals[2 * layer], totals[2 * layer + 1] = (t.reshape(width, width) for t in np.split(total, 2))
            near = found.where("id is not null").groupBy("id").agg(V.sum_by_position("vector", width).alias("near"))
            later = F.zip_with("direct", F.coalesce("near", piece(zero, 0)), lambda a, b: a + b)
            rows = keep(rows.join(near, "id", "left").select("id", "vector", "s", "grad", later.alias("later")))
        return rows.select("id", "vector"), rows.select("id", F.zip_with("later", piece("grad", 0), lambda a, b: a + b).alias("vector")), totals


def ngcf(train: DataFrame, settings: Settings | None = None, nodes: DataFrame | None = None, kind: str = "cross_entropy") -> Trained:
    """Vectors and layer matrices of NGCF; pairs as for `light_gcn`, cross-entropy of both scores; `drop` leaves out edges and message components."""
    s = settings or Settings()
    weights, wide = ngcf_weights(s), s.width * (s.layers + 1)
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    with scratch() as keep:
        graph = _Graph(train, s, keep)
        state = best = graph.start(nodes)
        best_weights, schedule, losses = weights, Schedule(s), []
        for epoch in range(1, s.epochs + 1):
            with scratch() as own:
                net, mine = graph.dropped(epoch, own), own.cached(by_block(state.own))
                model, vectors = _Ngcf(weights, s.width, epoch, s.drop, s.seed), mine.select("block", "vector")
                rows = model.shared_layers(net, vectors, state.shared, own)
                loss, grad, shared = _pair_pass(graph, net, epoch, model.finals, rows, wide, wide, vectors, kind, own)
                losses.append(loss)
                better = schedule.improved(loss)
                if better:
                    if best is not state:
                        best.freed()
                    best, best_weights = state, weights
                if schedule.over:
                    break
                grad = grad.withColumnRenamed("vector", "grad")
                sent, shared, totals = model.gradients(net, vectors, grad, rows, shared, own)
                new = held(net.over(_own_step(model.own_gradient, s.width, epoch, schedule.rate, s.decay), STATE, sent, 2 * s.layers * s.width, mine, grad))
                new = _State(new, held(stepped(state.shared, shared, s.width, epoch, schedule.rate, s.decay)))
                moved = [adam(w, m, v, g, epoch, schedule.rate, s.decay) for w, (m, v), g in zip(weights, moments, totals, strict=True)]
                weights, moments = [x[0] for x in moved], [x[1:] for x in moved]
            if state is not best:
                state.freed()
            state = new
        if state is not best:
            state.freed()
        model, start = _Ngcf(best_weights, s.width), keep.cached(by_block(best.own.select("block", "vector")))
        out = held(model.joined(graph.net, start, model.shared_layers(graph.net, start, best.shared, keep)))
        return Trained(held(best.nodes(graph)), out, losses, best_weights)


def lists_of(trained: DataFrame, train: DataFrame, n: int, module: str) -> DataFrame:
    """The n best unseen items of each user by dot product of node vectors."""
    def side(mark: str, name: str) -> DataFrame:
        key = F.expr("substring(id, 2)").cast(train.schema[name].dataType)
        return trained.where(F.col("id").startswith(mark)).select(key.alias(name), "vector")

    return lists_from_vectors(side("u", "user_id"), side("i", "item_id"), train, n, module)
