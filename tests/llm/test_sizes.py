"""What an operator sends or holds as its input grows."""

from pathlib import Path

import pyarrow.parquet as pq

from recolumn.llm import cluster, collocations, topk


def test_top_k_sends_no_copies_of_queries_through_the_driver(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        table = spark.range(500).selectExpr("id AS vec_id", "transform(sequence(1, 8), i -> sin(id * i)) AS embedding")
        found = topk.report(table)
        rows = found.collect()
        plan = found._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(rows) == 50 and "SortMergeJoin" in plan and "Broadcast" not in plan


def test_shards_are_written_and_read_a_few_at_a_time(spark, monkeypatch):
    groups, made = [], cluster.durable

    def durable(df, *args):
        table = made(df, *args)
        if "codes" in df.columns:
            files = Path(table._durable_path.removeprefix("file:")).glob("*.parquet")
            groups.extend(m.row_group(i).num_rows for f in files for m in [pq.ParquetFile(f).metadata] for i in range(m.num_row_groups))
        return table

    monkeypatch.setattr(collocations, "durable", durable)
    docs = spark.range(40).selectExpr("concat('a b c d ', id % 3, ' e f g') AS text", "'en' AS lang").coalesce(1)
    assert collocations.collocations(docs, least=5, shard_words=16).count() > 0
    assert sum(groups) > 2 * collocations.GROUP_SHARDS and max(groups) <= collocations.GROUP_SHARDS
