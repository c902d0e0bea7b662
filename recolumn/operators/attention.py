"""Graph attention (GATv2) stack: several heads, softmax over incoming edges, layer norm, residual; on all nodes or on sampled blocks.

Edges are dealt in blocks once, and a node's vector is sent once to each block that reads it: none travels with an edge. A block
projects its vectors with the weight matrices, scores its edges and returns one row for each node with incoming edges there: the largest score of each head, and
the sums of weights and of weighted vectors below it. These rows are put together by node, in buckets of bounded size. The edges of a node
with very many never meet in one task. The matrices travel with the task: their size is the layer's own, whatever the number of nodes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.work import held, scratch
from .dense import lists, matrix
from .graph import HOT, directed_blocks, packed, positions, sent

SLOPE, EPSILON = 0.2, 1e-5
#: Nodes of a bucket in which the blocks' rows are put together, about.
BUCKET = 4096


@dataclass(frozen=True)
class Layer:
    """left, right: (width, heads * size), for the two ends of an edge; edge: (heads * size); score: (heads, size).

    bias, gain, shift: (heads * size). residual and residual_bias: (width, heads * size) and (heads * size), or None where the widths agree.
    """

    left: np.ndarray
    right: np.ndarray
    edge: np.ndarray
    score: np.ndarray
    bias: np.ndarray
    gain: np.ndarray
    shift: np.ndarray
    residual: np.ndarray | None = None
    residual_bias: np.ndarray | None = None
    left_bias: np.ndarray | float = 0.0
    right_bias: np.ndarray | float = 0.0


def seeded_layers(width: int, sizes: tuple[int, ...] = (64, 64, 64), heads: tuple[int, ...] = (4, 4, 1), seed: int = 42) -> list[Layer]:
    """Layers with uniform weights of the usual bounds; heads are joined, so a layer of 4 heads of 64 has width 256."""
    draw, out = np.random.default_rng(seed), []
    for size, head in zip(sizes, heads, strict=True):
        wide = size * head
        uniform = lambda *shape: draw.uniform(-1, 1, shape) * np.sqrt(6 / sum(shape))
        residual = uniform(width, wide) if width != wide else None
        out.append(Layer(uniform(width, wide), uniform(width, wide), uniform(wide), uniform(head, size), np.zeros(wide), np.ones(wide), np.zeros(wide), residual, None if residual is None else np.zeros(wide)))
        width = wide
    return out


PARTIAL = "id string, top array<double>, z array<double>, vector array<double>"


def _attend(layer: Layer, some: int = 1 << 12):
    """Of each node with incoming edges in the block: the largest score of each head, and sums of exp(score - largest) and of vectors times it."""
    heads, size = layer.score.shape

    def run(edges: pa.Table, vectors: pa.Table) -> pa.Table:
        if not edges.num_rows or not vectors.num_rows:
            return pa.table({"id": pa.array([], pa.string()), **{c: pa.array([], pa.list_(pa.float64())) for c in ("top", "z", "vector")}})
        names, a, b, w = (edges.column(k).combine_chunks().flatten() for k in range(1, 5))
        a, b, w = (x.to_numpy(zero_copy_only=False) for x in (a, b, w))
        at, x = positions(names, vectors), matrix(vectors.column("vector").combine_chunks())
        left, right = x @ layer.left + layer.left_bias, x @ layer.right + layer.right_bias
        # an edge takes part if both of its ends have vectors; edges of one node follow each other
        on = np.flatnonzero((at[a] < len(x)) & (at[b] < len(x)))
        on = on[np.argsort(b[on], kind="stable")]
        src, dst, w = at[a[on]], b[on], w[on]
        first = np.flatnonzero(np.append(True, dst[1:] != dst[:-1])) if len(dst) else np.zeros(0, np.int64)
        node = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(dst))))
        to, e = at[dst], np.empty((len(src), heads))
        for i in range(0, len(src), some):
            z = left[src[i : i + some]] + right[to[i : i + some]] + w[i : i + some, None] * layer.edge
            z = np.where(z > 0, z, SLOPE * z).reshape(-1, heads, size)
            e[i : i + some] = np.einsum("nhd,hd->nh", z, layer.score)
        top = np.maximum.reduceat(e, first) if len(first) else np.zeros((0, heads))
        z = np.exp(e - top[node])
        total, sums = np.zeros((len(first), heads)), np.zeros((len(first), heads * size))
        for i in range(0, len(src), some):
            own, share = node[i : i + some], z[i : i + some]
            part = (left[src[i : i + some]].reshape(-1, heads, size) * share[:, :, None]).reshape(len(own), -1)
            edge = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            sums[own[edge]] += np.add.reduceat(part, edge)
            total[own[edge]] += np.add.reduceat(share, edge)
        return pa.table({"id": names.take(pa.array(dst[first])), "top": lists(top), "z": lists(total), "vector": lists(sums)})

    return run


def _finish(layer: Layer):
    """New vectors of a bucket's nodes from their blocks' rows and their own vectors."""
    heads, size = layer.score.shape

    def run(parts: pa.Table, nodes: pa.Table) -> pa.Table:
        if not parts.num_rows or not nodes.num_rows:
            return pa.table({"id": pa.array([], pa.string()), "vector": pa.array([], pa.list_(pa.float64()))})
        top, z, x = (matrix(parts.column(c).combine_chunks()) for c in ("top", "z", "vector"))
        ids = nodes.column("id").combine_chunks()
        at = pc.index_in(parts.column("id").combine_chunks(), value_set=ids).to_numpy(zero_copy_only=False)
        most = np.full((len(ids), heads), -np.inf)
        np.maximum.at(most, at, top)
        share = np.exp(top - most[at])
        total, sums = np.zeros((len(ids), heads)), np.zeros((len(ids), heads, size))
        np.add.at(total, at, z * share)
        np.add.at(sums, at, x.reshape(-1, heads, size) * share[:, :, None])
        on = np.unique(at)
        x, own = (sums[on] / total[on][:, :, None]).reshape(len(on), -1) + layer.bias, matrix(nodes.column("vector").combine_chunks())[on]
        x = x - x.mean(1, keepdims=True)
        x = x / np.sqrt((x * x).mean(1, keepdims=True) + EPSILON) * layer.gain + layer.shift
        x = np.where(x > 0, x, 0.01 * x)
        return pa.table({"id": ids.take(pa.array(on)), "vector": lists(x + (own if layer.residual is None else own @ layer.residual + layer.residual_bias))})

    return run


def looped_blocks(edges: DataFrame, ids: DataFrame, keep: scratch, hot: int = HOT) -> DataFrame:
    """The packed blocks of the edges (src, dst, w) and of a loop with the mean weight at each of `ids`, as a cache.

    Without a column w edges have no weight term. A node without edges attends to itself alone.
    """
    edges = edges if "w" in edges.columns else edges.withColumn("w", F.lit(0.0))
    loops = ids.join(edges.groupBy(F.col("dst").alias("id")).agg(F.avg("w").alias("w")), "id", "left").select(F.col("id").alias("src"), F.col("id").alias("dst"), F.coalesce("w", F.lit(0.0)).alias("w"))
    both = edges.where("src <> dst").select("src", "dst", F.col("w").cast("double").alias("w")).union(loops)
    both = both.select("src", "dst", F.nanvl(F.coalesce("w", F.lit(0.0)), F.lit(0.0)).alias("norm"))
    return keep.cached(packed(directed_blocks(keep(both), hot)))


def attention_layer(blocks: DataFrame, nodes: DataFrame, layer: Layer) -> DataFrame:
    """(id, vector) of the nodes with incoming edges in the blocks, from a table of nodes (id, vector)."""
    attends, finish = _attend(layer), _finish(layer)
    vectors = sent(nodes, blocks.select("block", F.explode("names").alias("id")))
    parts = blocks.groupBy("block").cogroup(vectors.groupBy("to")).applyInArrow(lambda a, b: attends(a, b), PARTIAL)
    count = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-nodes.count() // BUCKET))
    bucket = F.pmod(F.xxhash64("id"), F.lit(count)).alias("bucket")
    return parts.groupBy(bucket).cogroup(nodes.select("id", "vector").groupBy(bucket)).applyInArrow(lambda a, b: finish(a, b), "id string, vector array<double>")


def _with_vectors(nodes: DataFrame, keep: scratch) -> DataFrame:
    """The nodes' table first: a filter on derived vectors would be taken below the step that makes nodes distinct."""
    return keep(nodes.select("id", V.doubles(F.col("vector")).alias("vector"))).where("vector is not null")


def attention_stack(edges: DataFrame, nodes: DataFrame, layers: list[Layer], hot: int = HOT) -> DataFrame:
    """(id, vector) after all layers."""
    with scratch() as keep:
        rows = _with_vectors(nodes, keep)
        blocks = looped_blocks(keep(edges.select("src", "dst", "w")), rows.select("id"), keep, hot)
        for layer in layers[:-1]:
            rows = keep(attention_layer(blocks, rows, layer))
        return held(attention_layer(blocks, rows, layers[-1]))


def sampled_blocks(edges: DataFrame, seeds: DataFrame, most: tuple[int, ...], keep: scratch, seed: int = 42) -> list[tuple[DataFrame, DataFrame]]:
    """(edges, targets) of each layer, first to last: the last layer's targets are the seeds (id), the ones before
    their sampled neighbours too; a target takes part with at most most[layer] incoming edges, the first by a seeded hash."""
    out, targets = [], keep(seeds.select("id").distinct())
    for layer in reversed(range(len(most))):
        order = Window.partitionBy("dst").orderBy(V.portable_hash(seed, layer, F.col("src"), F.col("dst")), "src")
        near = edges.select("src", "dst").join(targets.withColumnRenamed("id", "dst"), "dst", "left_semi")
        block = keep(near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most[layer]).select("src", "dst"))
        out.append((block, targets))
        targets = keep(targets.union(block.select(F.col("src").alias("id"))).distinct())
    return out[::-1]


def sampled_stack(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, layers: list[Layer], most: tuple[int, ...] = (10, 10, 10), seed: int = 42) -> DataFrame:
    """(id, vector) of the seeds after all layers on sampled blocks; edge weights take no part."""
    with scratch() as keep:
        blocks = sampled_blocks(edges, seeds, most, keep, seed)
        # the first block reads its targets and their sampled neighbours
        first = blocks[0][1].union(blocks[0][0].select(F.col("src").alias("id"))).distinct()
        rows = _with_vectors(nodes.join(first, "id", "left_semi"), keep)
        for layer, (block, targets) in zip(layers, blocks, strict=True):
            rows = keep(attention_layer(looped_blocks(block, targets, keep), rows, layer))
        return held(rows)
