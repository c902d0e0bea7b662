"""Sources and sinks. Column roles are bound to canonical names here and nowhere else."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import first_wins, pending, union_sources

RATINGS = "user_id long, item_id long, rating double, ts long"


def read_ratings(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """Tab-separated ratings without a header."""
    return spark.read.schema(RATINGS).csv(path, sep="\t", encoding=encoding)


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Comma-separated with a header; quoted fields may hold line feeds. Columns are in lower case."""
    reader = spark.read.options(header=True, multiLine=True, escape='"')
    rows = (reader.schema(schema) if schema else reader).csv(path)
    return rows.toDF(*[c.lower() for c in rows.columns])


def bind(rows: DataFrame, **roles: str) -> DataFrame:
    """Only the columns named, under their canonical names: bind(df, user_id='uid', item_id='movie')."""
    return rows.select(*[F.col(c).alias(role) for role, c in roles.items()])


def load_sources(spark: SparkSession, paths: dict[str, str], schema: str | None = None) -> tuple[DataFrame | None, dict[str, str]]:
    """Union of the readable Parquet sources, tagged by name, and the errors of the others."""
    found, errors = {}, {}
    for name, path in paths.items():
        try:
            found[name] = (spark.read.schema(schema) if schema else spark.read).parquet(path)
        except AnalysisException as error:
            errors[name] = str(error).splitlines()[0]
    return (union_sources(found) if found else None), errors


def union_first_wins(sources: dict[str, DataFrame], keys: Sequence[str] = ("user_id", "item_id")) -> DataFrame:
    """One row per key, from the first source that has it (its best rank if it repeats)."""
    return first_wins(union_sources(sources), list(keys), ["priority", "recommendation_rank"]).drop("priority")


def write_csv(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).options(header=True, escape='"').csv(path)


def append_results(rows: DataFrame, path: str) -> None:
    """A resumable job's output: batches are appended, never rewritten."""
    rows.write.mode("append").parquet(path)


def remaining(work: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """Work that the results at `path` do not hold yet; all of it if there are none."""
    try:
        done = work.sparkSession.read.parquet(path)
    except AnalysisException:
        return work
    return pending(work, done, keys)
