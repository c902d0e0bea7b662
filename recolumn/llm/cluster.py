"""What the operators need of the session: shared folders, durable cuts, links to classes."""

from __future__ import annotations

import tempfile
import uuid
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 8 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEAN_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own_dirs: dict = {}
_tables: ContextVar[list | None] = ContextVar("tables", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or the context's checkpoint folder.

    Where neither is set a local master gets a folder of its own, as in tests; on a cluster,
    where executors would not see it, that is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where:
        return where
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_dirs.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="recolumn-"))


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Arrow batches of about BATCH_BYTES (or one row), however long the texts or lists in a row are; the same for all operators."""
    spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))
    return spark


def _folder(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def durable(df: DataFrame, group_rows: int = 0) -> DataFrame:
    """The rows, computed once and kept as a table in the shared folder; lineage ends there, and the shuffles that led there are freed.

    The table goes when it is released, at the end of a `scope`, or with the application. Rows of megabytes need `group_rows`: so many are
    written and read at once at most. Parquet's writer looks at its size after a hundred rows only, and a reader takes a group whole.
    """
    spark = df.sparkSession
    path, before = fresh_path(spark, "table"), spark.conf.get(_CLEAN_CONF, None)
    spark.conf.set(_CLEAN_CONF, "true")
    try:
        writer = df.write.option("compression", "zstd")
        (writer.option("parquet.block.row.count.limit", group_rows) if group_rows else writer).parquet(path)
    finally:
        spark.conf.unset(_CLEAN_CONF) if before is None else spark.conf.set(_CLEAN_CONF, before)
    at, files = _folder(spark, path)
    files.deleteOnExit(at)
    table = spark.read.schema(df.schema).parquet(path)
    table._durable_path = path
    if (tables := _tables.get()) is not None:
        tables.append(table)
    return table


def release(*tables: DataFrame | None) -> None:
    """Deletes durable tables that nothing reads any more."""
    for table in tables:
        if table is not None:
            at, files = _folder(table.sparkSession, table._durable_path)
            files.delete(at, True)


class scope:
    """Deletes at its end all durable tables made inside, but not those given to `keep`.

    For callers that have written or collected an operator's result when the block ends: the
    result itself may still read such tables.
    """

    def __enter__(self) -> scope:
        self.tables: list[DataFrame] = []
        self.token = _tables.set(self.tables)
        return self

    def keep(self, table: DataFrame) -> DataFrame:
        """A durable table that outlives the block, for the block around it if there is one."""
        self.tables[:] = [t for t in self.tables if t is not table]
        if (around := self.token.old_value) not in (None, self.token.MISSING):
            around.append(table)
        return table

    def __exit__(self, *_) -> None:
        _tables.reset(self.token)
        release(*self.tables)


def bit_table(rows: DataFrame, column: str, most: int) -> tuple[np.ndarray, int]:
    """A table of at most 1 << most bits, 16 for each row where that fits, in which the low bits of each value of a long column have their bit; and its size as a power."""
    bits = int(np.clip(np.ceil(np.log2(max(rows.count(), 1))) + 4, 16, most))
    bit = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    words = rows.select(F.shiftright(bit, 5).alias("w"), bit.bitwiseAND(F.lit(31)).alias("b")).groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, int(b))")).alias("v")).toArrow()
    table = np.zeros(1 << (bits - 5), np.uint32)
    table[words.column("w").to_numpy()] = words.column("v").to_numpy().astype(np.uint32)
    return table, bits


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def _local_forest(batches):
    """Stars (node, smallest node known here) of the links in one partition."""
    parent: dict = {}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(parent.setdefault(a, a)), find(parent.setdefault(b, b))
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if find(x) != x]
    kind = batch.schema.field(0).type if parent else pa.int64()
    for i in range(0, len(nodes), 50_000):
        part = nodes[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, kind), pa.array([find(x) for x in part], kind)], names=["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every node in `links` (a, b): the smallest id that it reaches.

    Each partition first reduces its links to stars. Then every round gives each
    node its smallest neighbour as parent, moves its other edges to that parent and
    lets nodes skip to their parent's parent. Rounds stop when no edge changes. Edges
    lead from the larger to the smaller end, so a hub's edges start at many nodes;
    where they are looked up by the hub, both sides are exchanged, so that key can be split.
    """
    kind = links.schema["a"].dataType.simpleString()
    edges = durable(
        links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").mapInArrow(_local_forest, f"u {kind}, v {kind}").distinct()
    )
    seen = None
    while True:
        state = tuple(edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.hash("v", "u").cast("long"))).head())
        if state == seen or not state[0]:
            break
        seen, old = state, edges
        parents = durable(edges.groupBy("u").agg(F.min("v").alias("p")))
        moved = edges.join(parents, "u").where("v <> p").select(F.col("v").alias("u"), F.col("p").alias("v"))
        above = parents.select(F.col("u").alias("p"), F.col("p").alias("q"))
        jumped = parents.join(above, "p", "left").select("u", F.coalesce("q", "p").alias("v"))
        edges = durable(moved.union(jumped).distinct())
        release(old, parents)
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    out = durable(edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots))
    release(edges)
    return out


def row_keys(first: int, n: int) -> np.ndarray:
    """Numbers of a task's rows, the same whenever the task runs again."""
    from pyspark import TaskContext

    at = TaskContext.get()
    return np.arange(first, first + n, dtype=np.int64) + ((at.partitionId() if at else 0) << 40)


def without(docs: DataFrame, ids: DataFrame, id_col: str, most: int = 1_000_000) -> DataFrame:
    """Rows of `docs` whose id is not in `ids` (one column); the ids are broadcast only if there are at most `most`. A null id is in no list."""
    name = fresh_name(docs, "_id")
    ids = durable(ids.toDF(name))
    small = ids.count() <= most
    return docs.join(F.broadcast(ids) if small else ids, docs[id_col] == ids[name], "left_anti")
