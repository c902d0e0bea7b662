"""Sharding by size-tiered compaction, DataFrame operations only.

A store is a folder with runs of immutable Parquet shards under `data/` and versions under
`manifest/`. `append` writes arrivals as one run of small shards, straight from the tasks that
hold them, without a shuffle. `compact` sorts the runs whose shards are still below the target into
tiers by the mean size of their shards, each tier FACTOR times the one before, and merges every tier that
has at least MIN_RUN shards into a run of files of about the target size; it reads whole shards
side by side (coalesce), so again nothing is shuffled. It repeats until no tier is full.

The shards of a run (file, rows, bytes) are a table that is written once, beside the
run. A version is a list of runs, one line each, so a commit rewrites no table of shards and no
list of shards is built here: runs are read by their folders, which Spark's file index lists. A version is committed by
renaming its list to `manifest/v<number>`, which fails if that version exists; the
writer then rereads and tries again. Readers see all of a version or none of it, and
old versions stay readable. Runs of a lost job are in no version.

Defined cases: null values, empty texts and repeated rows are stored as they are;
an empty table commits a version without a new run; all columns are kept, and
shard columns are added by `read` only on request, with underscores in front where a
column of that name exists.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import fresh_name, fresh_path

TARGET_BYTES, SMALL_ROWS = 64 << 20, 2048
FACTOR, MIN_RUN = 4, 4
ROW_GROUP_BYTES = 16 << 20  # what a writing task holds
_SHARDS = "file string, rows long, bytes long"
_RUNS = "name string, shards long, rows long, bytes long"


class Run(NamedTuple):
    """Shards that one job wrote into one folder."""

    name: str
    shards: int
    rows: int
    bytes: int

    def tier(self) -> int:
        return math.floor(math.log(max(self.bytes / self.shards, 1), FACTOR))


class Conflict(Exception):
    """Another writer committed this version first."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, small_rows: int = SMALL_ROWS):
        self.spark, self.root, self.target, self.small_rows = spark, root, target_bytes, small_rows

    # -- versions

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest")
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        return jvm, path, path.getFileSystem(conf), conf

    def version(self) -> int:
        """The latest committed version, 0 for an empty store."""
        _, path, fs, _ = self._files()
        if not fs.exists(path):
            return 0
        return max((int(s.getPath().getName()[1:]) for s in fs.listStatus(path) if s.getPath().getName().startswith("v")), default=0)

    def runs(self, version: int | None = None) -> list[Run]:
        """The runs of a version: one for each append or merge that is still in it."""
        version = self.version() if version is None else version
        if not version:
            return []
        rows = self.spark.read.schema(_RUNS).option("sep", "\t").csv(f"{self.root}/manifest/v{version:08d}")
        return [Run(*r) for r in rows.orderBy("name").toLocalIterator()]

    def manifest(self, version: int | None = None) -> DataFrame:
        """The shards of a version."""
        runs = self.runs(version)
        if not runs:
            return self.spark.createDataFrame([], _SHARDS)
        return self.spark.read.schema(_SHARDS).parquet(*[f"{self.root}/manifest/{r.name}" for r in runs])

    def commit(self, runs: list[Run], version: int) -> None:
        jvm, path, fs, conf = self._files()
        made = jvm.org.apache.hadoop.fs.Path(path, f"pending-{uuid.uuid4().hex}")
        out = fs.create(made, False)
        for run in runs:
            out.write(bytearray("\t".join(map(str, run)).encode() + b"\n"))
        out.close()
        names = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), conf)
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            names.rename(made, jvm.org.apache.hadoop.fs.Path(path, f"v{version:08d}"), none)
        except Exception as error:
            fs.delete(made, False)
            if "FileAlreadyExists" in str(error):
                raise Conflict(version) from error
            raise

    # -- shards

    def _folder(self, run: Run) -> str:
        return f"{self.root}/data/{run.name}"

    def _write(self, rows: DataFrame, **options) -> list[Run]:
        """A new run of the rows and the table of its shards, for which only footers are read; no run if there are no rows."""
        name = f"run-{uuid.uuid4().hex}"
        rows.write.options(**options).option("parquet.block.size", ROW_GROUP_BYTES).parquet(f"{self.root}/data/{name}")
        files = self.spark.read.schema(rows.schema).parquet(f"{self.root}/data/{name}").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
        table = f"{self.root}/manifest/{name}"
        files.groupBy("file").agg(F.count("*").alias("rows"), F.max("bytes").alias("bytes")).select("file", "rows", "bytes").write.parquet(table)
        total = self.spark.read.schema(_SHARDS).parquet(table).agg(F.count("*").alias("n"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes")).head()
        return [Run(name, total["n"], total["rows"], total["bytes"])] if total["n"] else []

    def append(self, rows: DataFrame) -> int:
        """Writes the rows as a run of small shards and commits the next version."""
        new = self._write(rows, maxRecordsPerFile=self.small_rows)
        while True:
            version = self.version()
            try:
                self.commit(self.runs(version) + new, version + 1)
                return version + 1
            except Conflict:
                continue

    def compact(self, schema) -> int:
        """Merges full tiers until there is none; the version afterwards."""
        while True:
            version = self.version()
            runs, tiers = self.runs(version), defaultdict(list)
            for run in runs:
                if run.bytes < run.shards * (self.target // 2):
                    tiers[run.tier()].append(run)
            full = [t for t, tier in tiers.items() if sum(r.shards for r in tier) >= MIN_RUN]
            if not full:
                return version
            merged = tiers[min(full)]
            parts = math.ceil(sum(r.bytes for r in merged) / self.target)
            new = self._write(self.spark.read.schema(schema).parquet(*map(self._folder, merged)).coalesce(parts))
            try:
                self.commit([r for r in runs if r not in merged] + new, version + 1)
            except Conflict:
                continue

    def read(self, schema, version: int | None = None, shard_columns: bool = False) -> DataFrame:
        """The rows of a version, on request with shard (its file) and shard_bytes."""
        runs = self.runs(version)
        rows = self.spark.read.schema(schema).parquet(*map(self._folder, runs)) if runs else self.spark.createDataFrame([], schema)
        if shard_columns:
            path, size = (F.col("_metadata.file_path"), F.col("_metadata.file_size")) if runs else (F.lit(""), F.lit(0).cast("long"))
            rows = rows.withColumns({fresh_name(rows, "shard"): path, fresh_name(rows, "shard_bytes"): size})
        return rows


def sharded(docs: DataFrame, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Stores the documents, compacts the store and reads the committed version back, with shard columns."""
    spark = docs.sparkSession
    store = ShardStore(spark, fresh_path(spark, "shards"), target_bytes)
    store.append(docs)
    return store.read(docs.schema, store.compact(docs.schema), shard_columns=True)


def report(docs: DataFrame) -> DataFrame:
    return sharded(docs).select("doc_id", "source", "n_chars", F.sha2("text", 256).alias("text_sha256"), "shard", "shard_bytes")
