"""Graph steps in which users stay with their edges and only the vectors of shared nodes travel.

The edges of a symmetric graph are dealt in blocks by their user. A user whose edges are all in one block is that block's own:
its vectors are kept there, one row a block, and never meet a shuffle within a step. Items, and users whose edges fill several
blocks, are shared: a pass sends their vectors once to each block that reads them and adds up what the blocks return for them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.work import held, scratch
from .dense import lists, matrix
from .graph import HOT, block_count, block_of, by_block, positions, sent

NODE = "id string, vector array<double>"
EDGES = "block int, own array<string>, shared array<string>, a array<int>, b array<int>, norm array<double>, crossed boolean"


def flat(x: np.ndarray) -> pa.Array:
    """All of a matrix in one list."""
    return pa.ListArray.from_arrays(pa.array([0, x.size], pa.int32()), pa.array(np.ascontiguousarray(x).ravel()))


def _strings(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _packed(table: pa.Table) -> pa.Table:
    """One row for a block's edges, whose ends are places among its own and then its shared nodes."""
    src, dst, local = (table.column(c).combine_chunks() for c in ("src", "dst", "local"))
    own = pc.unique(src.filter(local))
    shared = pc.unique(pa.concat_arrays([src.filter(pc.invert(local)), dst]))
    names = pa.concat_arrays([own, shared])
    a, b = (pc.index_in(c, value_set=names).to_numpy(zero_copy_only=False).astype(np.int32) for c in (src, dst))
    norm = table.column("norm").combine_chunks().to_numpy(zero_copy_only=False)
    columns = [table.column("block").slice(0, 1).combine_chunks(), _strings(own), _strings(shared), flat(a), flat(b), flat(norm), pa.array([bool((a >= len(own)).any())])]
    return pa.Table.from_arrays(columns, names=["block", "own", "shared", "a", "b", "norm", "crossed"])


class Block:
    """A block's edges as sums over neighbours; matrices have a row for each own or each shared node."""

    def __init__(self, table: pa.Table, vectors: pa.Table, width: int, drop: float = 0.0):
        self.table, self.width = table, width
        self.number, self.own, self.shared = table.column("block")[0].as_py(), self.flat("own"), self.flat("shared")
        a, b, norm = (self.flat(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "norm"))
        if drop:
            norm = norm * self.flat("kept").to_numpy(zero_copy_only=False) / (1 - drop)
        n = len(self.own)
        on = a < n
        self.ends, self.crossing = (a[on], b[on] - n, norm[on]), (a[~on] - n, b[~on] - n, norm[~on])
        self.ids = vectors.column("id").combine_chunks().cast(pa.string())
        x = matrix(vectors.column("vector").combine_chunks()).reshape(-1, width)
        self.all = np.concatenate([x, np.zeros((1, width))])
        self.x = self.all[positions(self.shared, vectors)]

    def flat(self, name: str) -> pa.Array:
        return self.table.column(name).combine_chunks().flatten()

    def state(self, name: str, width: int) -> np.ndarray:
        """A column of the block's row as a matrix of its own nodes."""
        return self.flat(name).to_numpy(zero_copy_only=False).reshape(len(self.own), width)

    def to_own(self, x: np.ndarray) -> np.ndarray:
        a, b, norm = self.ends
        return _sums(a, b, norm, x, len(self.own))

    def to_shared(self, x: np.ndarray) -> np.ndarray:
        a, b, norm = self.ends
        return _sums(b, a, norm, x, len(self.shared))

    def across(self, x: np.ndarray) -> np.ndarray:
        """Sums over edges between two shared nodes."""
        a, b, norm = self.crossing
        return _sums(a, b, norm, x, len(self.shared)) + _sums(b, a, norm, x, len(self.shared)) if len(a) else np.zeros(x.shape)

    def rows(self, x: np.ndarray) -> pa.Table:
        """(id, vector) of its shared nodes."""
        return pa.table({"id": self.shared, "vector": lists(x)})


def _sums(to: np.ndarray, at: np.ndarray, norm: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(to, column[at] * norm, n) for column in np.ascontiguousarray(x.T)], axis=1)


def _layers(width: int, layers: int, have: int, more: int, first: int):
    """What a block adds to layers `have` to `have + more - 1` of its shared nodes; layers from `first` on were sent."""

    def run(block: Block) -> pa.Table:
        layer, out = lambda k: block.x[:, (k - first) * width :][:, :width], []
        for k in range(have, have + more):
            own = block.state("vector", width) if k == 1 else block.to_own(layer(k - 2))
            out.append(block.to_shared(own) + (block.across(layer(k - 1)) if len(block.crossing[0]) else 0))
        return block.rows(np.concatenate(out, axis=1))

    return run


@dataclass
class Net:
    """A symmetric graph in blocks: packed edges, (id, block) of own and of shared nodes, whether edges join two shared nodes, and how edges are dealt."""

    edges: DataFrame
    homes: DataFrame
    parts: DataFrame
    crossed: bool
    hot: DataFrame
    count: int
    drop: float = 0.0

    def over(self, run: Callable[[Block], pa.Table], kinds: str, rows: DataFrame, width: int, *states: DataFrame, parts: DataFrame | None = None) -> DataFrame:
        """run(block) for every block, with its rows of `states` and the vectors (id, vector) of `width` that were sent to it."""
        left, drop = self.edges, self.drop
        for state in states:
            left = left.join(state, "block", "left")
        to = sent(rows, self.parts if parts is None else parts)
        return left.groupBy("block").cogroup(to.groupBy("to")).applyInArrow(lambda a, b: run(Block(a, b, width, drop)), kinds)

    def layers(self, own: DataFrame, shared: DataFrame, width: int, layers: int, keep: scratch) -> DataFrame:
        """(id, vector): the shared nodes' vectors of layers 0 to `layers`, one after another. `own`: (block, vector) of the start, `shared`: (id, vector)."""
        rows, have = shared.select("id", "vector"), 1
        while have <= layers:
            # where no edge joins two shared nodes, layer k needs those up to k - 2 only
            more = min(layers + 1 - have, 1 if self.crossed else 2)
            first = max(0, have - 2)
            some = rows.select("id", F.slice("vector", first * width + 1, (have - first) * width).alias("vector"))
            sums = self.over(_layers(width, layers, have, more, first), NODE, some, (have - first) * width, own)
            sums = sums.groupBy("id").agg(V.sum_by_position("vector", more * width).alias("more"))
            zero = lambda n: F.array_repeat(F.lit(0.0), n * width)
            rows = keep(rows.join(sums, "id", "full").select("id", F.concat(F.coalesce("vector", zero(have)), F.coalesce("more", zero(more))).alias("vector")))
            have += more
        return rows

    def placed(self, rows: DataFrame, width: int) -> DataFrame:
        """(block, vector): the vectors of (id, vector) as one row a block, in the order of its own nodes, zeros for those without."""

        def run(table: pa.Table, vectors: pa.Table) -> pa.Table:
            block = Block(table, vectors, width)
            return pa.Table.from_arrays([table.column("block"), flat(block.all[positions(block.own, vectors)])], names=["block", "vector"])

        mine = sent(rows, self.homes)
        return by_block(self.edges.groupBy("block").cogroup(mine.groupBy("to")).applyInArrow(lambda a, b: run(a, b), "block int, vector array<double>"))

    def dealt(self, rows: DataFrame, home: str, other: str) -> DataFrame:
        """`rows` with the block that holds the edge of their two ends."""
        parts = F.broadcast(self.hot.withColumnRenamed("src", home))  # at most one row in HOT edges
        return rows.join(parts, home, "left").withColumn("block", block_of(home, other, self.count)).drop("parts")

    def thinned(self, key: str, drop: float, keep: scratch) -> Net:
        """The graph without a share of its edges, drawn by the md5 of key and ends; the rest grows so that sums keep their mean."""

        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    own, shared, a, b = (batch.column(k).slice(i, 1).flatten() for k in (1, 2, 3, 4))
                    names = pa.concat_arrays([own, shared])
                    ends = zip(names.take(b).to_pylist(), names.take(a).to_pylist(), strict=True)
                    draw = np.fromiter((int(hashlib.md5(f"{key}:{least}:{most}".encode()).hexdigest()[:15], 16) for least, most in ends), np.int64, len(a))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), flat((draw % 1_000_000 >= int(drop * 1_000_000)).astype(np.int8))], names=["block", "kept"])

        edges = self.edges.select("block", "own", "shared", "a", "b").mapInArrow(run, "block int, kept array<tinyint>")
        return replace(self, edges=self.edges.join(keep.cached(by_block(keep(edges))), "block"), drop=drop)


def net(edges: DataFrame, keep: scratch, hot: int = HOT) -> Net:
    """The blocks of a symmetric graph's edges (src, dst, norm); edges of a user with more than `hot` of them are dealt in several parts."""
    one = edges.where("src > dst").select("src", "dst", "norm")
    count = block_count(edges.sparkSession, one.count())
    many = keep(one.groupBy("src").agg(F.ceil(F.count("*") / hot).cast("int").alias("parts")).where("parts > 1"))
    rows = one.join(F.broadcast(many), "src", "left").join(one.select(F.col("dst").alias("src"), F.lit(True).alias("both")).distinct(), "src", "left")
    rows = rows.select(block_of("src", "dst", count).alias("block"), "src", "dst", "norm", F.expr("parts is null and both is null").alias("local"))
    packed = keep.cached(by_block(keep(rows.groupBy("block").applyInArrow(_packed, EDGES))))
    crossed = packed.where("crossed").limit(1).count() > 0
    ids = lambda c: keep(packed.select("block", F.explode(c).alias("id")))
    return Net(packed.drop("crossed"), ids("own"), ids("shared"), crossed, many, count)


def mean_of(rows: DataFrame, width: int, layers: int) -> DataFrame:
    """(id, vector): mean over layers 0 to `layers` of vectors that stand one after another."""
    at = lambda k: F.aggregate(F.sequence(F.lit(0), F.lit(layers)), F.lit(0.0), lambda s, j: s + F.get("vector", j * width + k))
    return rows.select("id", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: at(k) / (layers + 1)).alias("vector"))


def below(x: np.ndarray, width: int, layers: int) -> np.ndarray:
    """Sum of layers 0 to `layers` - 1, whose neighbour sums are an own node's layers 1 to `layers`."""
    return x[:, : layers * width].reshape(len(x), layers, width).sum(1)


def mean_own(block: Block, start: np.ndarray, width: int, layers: int) -> np.ndarray:
    """Mean over layers of a block's own nodes from their start and the layers of the shared ones."""
    return (start + block.to_own(below(block.x, width, layers))) / (layers + 1)


def layer_mean(graph: Net, own: DataFrame, rows: DataFrame, width: int, layers: int) -> DataFrame:
    """(id, vector): mean over layers of all nodes; `rows` holds the layers of the shared ones."""

    def run(block: Block) -> pa.Table:
        return pa.table({"id": block.own, "vector": lists(mean_own(block, block.state("vector", width), width, layers))})

    return graph.over(run, NODE, rows, (layers + 1) * width, own).union(mean_of(rows, width, layers))


def propagate(edges: DataFrame, nodes: DataFrame, width: int, layers: int = 3) -> DataFrame:
    """Mean over layers 0 to `layers` of neighbourhood sums weighted by `norm`: (id, vector), as a table of the session."""
    with scratch() as keep:
        graph = net(keep(edges.select("src", "dst", "norm")), keep)
        rows = keep(nodes.select("id", V.doubles(F.col("vector")).alias("vector")))
        own = keep.cached(graph.placed(rows, width))
        shared = keep(rows.join(graph.homes.select("id"), "id", "left_anti"))
        return held(layer_mean(graph, own, graph.layers(own, shared, width, layers, keep), width, layers))
