"""Queries of prompts and judge loops. Their judge answers with a digest of its prompt, so SQL can follow every step of a loop."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import loops, rerank, simulate
from ..sources.work import fresh_folder
from . import views
from .catalog import _popular, _with, query


def digest_judge(prompts: list[str]) -> list[str]:
    return [hashlib.md5(p.encode()).hexdigest() for p in prompts]


def _ins(kind: str) -> str:
    return f"'{loops.INSTRUCTIONS[kind]}' || chr(10) || 'Profile: '"


_RECENT = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id DESC) AS recency FROM train"
_STEPS = """
pol AS (SELECT *, CASE WHEN rating >= 4 THEN 'positive' WHEN rating <= 2 THEN 'negative' END AS pol FROM train),
rec AS (SELECT *, row_number() OVER (PARTITION BY user_id, pol ORDER BY ts DESC, item_id DESC) AS recency FROM pol WHERE pol IS NOT NULL),
bodies AS (SELECT user_id, pol, (recency - 1) // 5 AS batch, string_agg('- ' || title || ': ' || rating, chr(10) ORDER BY recency) AS body FROM rec JOIN catalog USING (item_id) WHERE recency <= 10 GROUP BY ALL),
steps AS (SELECT user_id, row_number() OVER w - 1 AS step, first_value(pol) OVER w AS f, pol, body FROM bodies WINDOW w AS (PARTITION BY user_id ORDER BY pol DESC, batch))"""


@query(_with(_STEPS) + "SELECT user_id, step, CASE WHEN step = 0 THEN 'initial' ELSE pol END AS kind, body FROM steps WHERE f = 'positive'")
def polarity_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = loops.polarity_steps(views.train(spark, sf_dir), views.catalog(spark, sf_dir))
    return rows.withColumn("step", F.col("step").cast("long"))


@query(_with(_STEPS, f"""
run AS (SELECT user_id, step, md5({_ins("initial")} || chr(10) || body) AS profile FROM steps WHERE step = 0 AND f = 'positive'
  UNION ALL SELECT s.user_id, s.step, md5(CASE WHEN pol = 'positive' THEN {_ins("positive")} ELSE {_ins("negative")} END || r.profile || chr(10) || s.body) FROM run r JOIN steps s ON s.user_id = r.user_id AND s.step = r.step + 1)""").replace("WITH ", "WITH RECURSIVE ", 1)
    + "SELECT user_id, step, profile FROM run")
def interactive_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Favourites, then dislikes, in fives; the run is stopped after its second step and resumed."""
    steps, path = loops.polarity_steps(views.train(spark, sf_dir), views.catalog(spark, sf_dir)), fresh_folder(spark, "profiles")
    loops.run_steps(steps, digest_judge, path, until=1)
    return loops.run_steps(steps, digest_judge, path).select("user_id", F.col("step").cast("long").alias("step"), "profile")


@query(_with(f"""
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, item_id) AS place FROM ({_RECENT}) WHERE recency <= 40),
bodies AS (SELECT user_id, (place - 1) // 10 AS step, string_agg(item_id || '=' || rating, chr(10) ORDER BY place) AS body FROM r GROUP BY ALL),
run AS (SELECT user_id, step, md5({_ins("initial")} || chr(10) || body) AS profile FROM bodies WHERE step = 0
  UNION ALL SELECT s.user_id, s.step, md5({_ins("update")} || r.profile || chr(10) || s.body) FROM run r JOIN bodies s ON s.user_id = r.user_id AND s.step = r.step + 1)""").replace("WITH ", "WITH RECURSIVE ", 1)
    + "SELECT user_id, step, profile FROM run")
def iterative_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest 40 ratings in tens, oldest first."""
    steps = loops.chunk_steps(views.train(spark, sf_dir))
    found = loops.run_steps(steps, digest_judge, fresh_folder(spark, "profiles"))
    return found.select("user_id", F.col("step").cast("long").alias("step"), "profile")


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.train(spark, sf_dir).select("user_id").distinct().select("user_id", F.concat(F.lit("likes part "), F.col("user_id") % 7).alias("profile"))


@query(_with(f"""
r AS (SELECT user_id, string_agg('- ' || title || ': ' || rating, chr(10) ORDER BY recency) AS body FROM ({_RECENT}) JOIN catalog USING (item_id) WHERE recency <= 5 GROUP BY user_id)""")
    + f"SELECT user_id, {_ins('update')} || 'likes part ' || (user_id % 7) || chr(10) || body AS prompt FROM r")
def update_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loops.update_prompts(_known(spark, sf_dir), views.train(spark, sf_dir), views.catalog(spark, sf_dir))


@query(_with(f"""
latest AS (SELECT user_id, string_agg('- ' || title || ': ' || rating, chr(10) ORDER BY recency) AS latest FROM ({_RECENT}) JOIN catalog USING (item_id) WHERE recency <= 5 GROUP BY user_id),
place AS (SELECT user_id, item_id, title, row_number() OVER (PARTITION BY user_id ORDER BY item_id) AS place FROM test JOIN catalog USING (item_id)),
asked AS (SELECT user_id, (place - 1) // 10 AS chunk, string_agg('- ' || item_id || ': ' || title, chr(10) ORDER BY place) AS asked FROM place GROUP BY ALL)""") + """
SELECT user_id, chunk, 'Profile: ' || CASE WHEN user_id IN (SELECT user_id FROM train) THEN 'likes part ' || (user_id % 7) ELSE '' END || chr(10) || 'Latest ratings:' || chr(10) || coalesce(latest, '') || chr(10)
  || 'Rate each item from 1 to 5:' || chr(10) || asked AS prompt FROM asked LEFT JOIN latest USING (user_id)""")  # fmt: skip
def request_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = simulate.recent(views.train(spark, sf_dir), 5)
    rows = loops.request_prompts(_known(spark, sf_dir), recent, views.test(spark, sf_dir), views.catalog(spark, sf_dir))
    return rows.withColumn("chunk", F.col("chunk").cast("long"))


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = views.table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").cast("long").alias("item_id"), F.col("p_name").alias("title"), F.concat(F.lit("1 May "), (1950 + F.col("p_size")).cast("string")).alias("release_date"), F.col("p_type").alias("overview"))


@query(_with(views.POPULAR) + "SELECT user_id, item_id, title || ' (' || (1950 + p_size) || '): ' || overview AS details FROM popular LEFT JOIN catalog USING (item_id) LEFT JOIN part ON p_partkey = item_id")
def item_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank.item_details(_popular(spark, sf_dir), _dated(spark, sf_dir)).select("user_id", "item_id", "details")


@query(_with() + "SELECT user_id, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS missing FROM (SELECT DISTINCT user_id, item_id FROM train WHERE item_id NOT IN (SELECT item_id FROM catalog WHERE item_id % 7 <> 0)) GROUP BY user_id")
def missing_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rated items that a catalogue without every seventh part lacks."""
    rows = rerank.missing_items(views.train(spark, sf_dir), views.catalog(spark, sf_dir).where("item_id % 7 <> 0"))
    return rows.select("user_id", F.array_join(F.transform("missing", lambda x: x.cast("string")), ",").alias("missing"))


@query("""
SELECT conv_id, turn, concat_ws(',', CASE WHEN role IS NULL THEN 'role' END, CASE WHEN turn % 3 = 0 THEN 'summary' END) AS missing FROM conversations""")  # fmt: skip
def missing_reply_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required fields that a JSON reply lacks: two turns of three have a summary."""
    rows = views.table(spark, sf_dir, "conversations")
    reply = F.to_json(F.struct(F.col("role"), F.col("text"), F.when(F.col("turn") % 3 != 0, "short").alias("summary")))
    return rows.select("conv_id", "turn", F.array_join(X.missing_fields(reply, "role", "summary"), ",").alias("missing"))
