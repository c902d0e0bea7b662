"""Streams over files against the batch answer."""

from pyspark.sql import functions as F

from recolumn.streaming import live

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
SOURCE = "/root/testdata/sf0.001/events.parquet"


def _run(rows, name, mode, tmp_path):
    query = rows.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination()


def _stream(spark, tmp_path):
    spark.read.parquet(SOURCE).repartition(3).write.parquet(str(tmp_path / "in"))
    return live.events(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "100 days")


def test_live_popularity(spark, tmp_path):
    _run(live.live_popularity(_stream(spark, tmp_path), "1 day"), "popular", "complete", tmp_path)
    got = {tuple(r) for r in spark.table("popular").collect()}
    rows = spark.read.parquet(SOURCE).select(F.get_json_object("props", "$.k").cast("long").alias("i"), F.date_trunc("day", F.col("ts").cast("timestamp")).alias("d"))
    assert got == {(r["d"], r["i"], r["count"]) for r in rows.groupBy("d", "i").count().collect()}


def test_recent_items(spark, tmp_path):
    _run(live.recent_items(_stream(spark, tmp_path), 3), "recent", "update", tmp_path)
    last = {r["user_id"]: r["items"] for r in spark.table("recent").collect()}
    want = {}
    for r in sorted(spark.read.parquet(SOURCE).collect(), key=lambda r: (r["ts"], r["event_id"]), reverse=True):
        want.setdefault(r["user_id"], []).append(int(r["props"].split(":")[1].strip(" }")))
    assert last == {u: items[:3] for u, items in want.items()}
