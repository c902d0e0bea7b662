"""Tables that a job keeps for itself, and model bundles that outlive it.

A bundle is a folder of versions, `v00001` and up. A version is written under another name and
renamed once it is whole; its manifest (kind, tables, settings) is the last file inside, and a version without one
is not read. Two writers cannot take the same number: the later rename fails and tries the next one.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
MANIFEST = "_bundle.json"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir or of the context; a local master without one gets its own, a cluster is refused."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where:
        return where
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="recolumn-"))


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    at, files = _path(spark, path)
    files.delete(at, True)


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path in a folder of its own, which is deleted when the application ends."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    at, files = _path(spark, folder)
    files.mkdirs(at)  # only a folder that exists can be marked
    files.deleteOnExit(at)
    return f"{folder}/rows"


def held(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept as a table in the shared folder until the application ends: lineage ends there."""
    spark = df.sparkSession
    path = fresh_folder(spark, "work")
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._held_path = path.rsplit("/", 1)[0]
    return table


def freed(*tables: DataFrame | None) -> None:
    """Deletes held tables that nothing reads any more."""
    for table in tables:
        if table is not None:
            delete(table.sparkSession, table._held_path)


class scratch:
    """Tables and caches that go when the block ends: `keep(df)` is `held`, `keep.cached(df)` is computed when first read and kept by the executors."""

    def __init__(self):
        self.tables: list[DataFrame] = []
        self.caches: list[DataFrame] = []

    def __enter__(self) -> scratch:
        return self

    def __exit__(self, *_) -> None:
        freed(*self.tables)
        for df in self.caches:
            df.unpersist()

    def __call__(self, df: DataFrame) -> DataFrame:
        self.tables.append(held(df))
        return self.tables[-1]

    def cached(self, df: DataFrame) -> DataFrame:
        self.caches.append(df.persist())
        return self.caches[-1]


@dataclass(frozen=True)
class Bundle:
    kind: str
    version: int
    settings: dict
    tables: dict[str, DataFrame]


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the whole versions at `path`."""
    at, files = _path(spark, path)
    if not files.exists(at):
        return []
    names = [s.getPath().getName() for s in files.listStatus(at)]
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and files.exists(_path(spark, f"{path}/{n}/{MANIFEST}")[0]))


def save(spark: SparkSession, path: str, kind: str, tables: dict[str, DataFrame], settings: dict | None = None) -> int:
    """Writes a new version of a model (vectors, id maps, weights) and returns its number; a failure leaves no version behind."""
    draft = f"{path}/_draft-{uuid.uuid4().hex}"
    try:
        for name, table in tables.items():
            table.write.parquet(f"{draft}/{name}")
        at, files = _path(spark, f"{draft}/{MANIFEST}")
        out = files.create(at, False)
        out.write(bytearray(json.dumps({"kind": kind, "tables": sorted(tables), "settings": settings or {}}).encode()))
        out.close()
        number = max(versions(spark, path), default=0) + 1
        while True:
            target = _path(spark, f"{path}/v{number:05d}")[0]
            if not files.exists(target) and files.rename(_path(spark, draft)[0], target):
                # a rename into a folder that another writer has just made puts the draft inside it
                if files.exists(_path(spark, f"{path}/v{number:05d}/{draft.rsplit('/', 1)[1]}")[0]):
                    files.rename(_path(spark, f"{path}/v{number:05d}/{draft.rsplit('/', 1)[1]}")[0], _path(spark, draft)[0])
                else:
                    return number
            number += 1
    finally:
        delete(spark, draft)


def load(spark: SparkSession, path: str, kind: str | None = None, version: int | None = None) -> Bundle:
    """The newest whole version, or the one named."""
    found = versions(spark, path)
    if not found or (version is not None and version not in found):
        raise FileNotFoundError(f"no bundle {'' if version is None else version} at {path}")
    number = version if version is not None else found[-1]
    at, files = _path(spark, f"{path}/v{number:05d}/{MANIFEST}")
    stream = files.open(at)
    manifest = json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    stream.close()
    if kind is not None and manifest["kind"] != kind:
        raise ValueError(f"the bundle at {path} is of kind {manifest['kind']}, not {kind}")
    tables = {name: spark.read.parquet(f"{path}/v{number:05d}/{name}") for name in manifest["tables"]}
    return Bundle(manifest["kind"], number, manifest["settings"], tables)
