"""Judge loops that can be stopped and resumed: profiles refined step by step, and the prompts of each kind of request.

Users go through their steps side by side: step k of all users is one job, its replies are appended to the state
table before step k + 1 begins, and a run that starts again asks only for what the table lacks. An append is
visible as a whole or not at all, so a job that dies leaves no half step.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.work import freed, held
from . import simulate
from .relational import pending

#: What the judge is told before the profile, by kind of step.
INSTRUCTIONS = {"initial": "Write a profile from these favourites.", "positive": "Refine the profile with these favourites.", "negative": "Refine the profile with these dislikes.", "update": "Update the profile with the latest ratings."}
STATE = "profile string, attempts int, status string"


def _line() -> Column:
    return F.format_string("- %s: %d", F.col("title"), F.col("rating").cast("int"))


def _prompt(instruction: Column, profile: Column, body: Column) -> Column:
    return F.concat(instruction, F.lit("\nProfile: "), F.coalesce(profile, F.lit("")), F.lit("\n"), body)


def polarity_steps(ratings: DataFrame, items: DataFrame, n: int = 10, size: int = 5, variant: str = "range") -> DataFrame:
    """user_id, step from 0, kind, body: each user's n latest positives, then the n latest negatives, `size` to a step.

    Items without a title drop out after the cut. Users without positives have no steps.
    """
    rows = simulate.recent_by_polarity(ratings, n, variant).join(items.select("item_id", "title"), "item_id")
    rows = rows.withColumn("batch", F.floor((F.col("recency") - 1) / size))
    body = simulate.joined_lines(_line(), F.col("recency"))
    bodies = rows.groupBy("user_id", "polarity", "batch").agg(body.alias("body"))
    order = Window.partitionBy("user_id").orderBy(F.desc("polarity"), "batch")
    steps = bodies.withColumn("step", F.row_number().over(order) - 1).withColumn("first", F.first("polarity").over(order)).where("first = 'positive'")
    return steps.select("user_id", "step", F.when(F.col("step") == 0, "initial").otherwise(F.col("polarity")).alias("kind"), "body")


def chunk_steps(ratings: DataFrame, n: int = 40, size: int = 10) -> DataFrame:
    """user_id, step, kind, body: each user's n latest ratings, oldest first, `size` to a step."""
    rows = simulate.chunk_prompts(simulate.recent(ratings, n), size)
    return rows.select("user_id", F.col("chunk").cast("int").alias("step"), F.when(F.col("chunk") == 0, "initial").otherwise("update").alias("kind"), F.col("prompt").alias("body"))


def profiles(state: DataFrame) -> DataFrame:
    """user_id and the profile after the user's last step."""
    return state.groupBy("user_id").agg(F.max_by("profile", "step").alias("profile"))


def run_steps(steps: DataFrame, judge: Callable[[list[str]], list[str | None]], path: str, attempts: int = 3, wait: float = 0.0, until: int | None = None) -> DataFrame:
    """Runs the steps (user_id, step, kind, body) that the state table at `path` lacks and returns the table: user_id, step, profile, attempts, status.

    Each prompt holds the profile so far. A step without a reply, or whose judge raises, keeps the
    profile before it, with its status. `until` stops after that step; a later run goes on from there.
    """
    spark, kind = steps.sparkSession, steps.schema["user_id"].dataType.simpleString()
    schema = f"user_id {kind}, step int, {STATE}"
    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    steps = held(steps.select("user_id", F.col("step").cast("int").alias("step"), "kind", "body"))
    words = F.create_map(*[F.lit(x) for pair in INSTRUCTIONS.items() for x in pair])
    low, high = steps.agg(F.min("step"), F.max("step")).head()
    for step in range(low, (high if until is None else min(high, until)) + 1) if low is not None else ():
        state = spark.read.schema(schema).parquet(path)
        rows = pending(steps.where(F.col("step") == step), state, ["user_id", "step"])
        before = profiles(state.where(F.col("step") < step)).withColumnRenamed("profile", "before")
        rows = rows.join(before, "user_id", "left")
        asked = rows.select("user_id", "before", _prompt(F.element_at(words, F.col("kind")), F.col("before"), F.col("body")).alias("prompt"))
        new = simulate.ask(asked, judge, attempts, wait, keys=("user_id", "before"))
        new = new.select("user_id", F.lit(step).alias("step"), F.coalesce("reply", "before").alias("profile"), "attempts", "status")
        new.write.mode("append").parquet(path)
    freed(steps)
    return spark.read.schema(schema).parquet(path)


def update_prompts(known: DataFrame, ratings: DataFrame, items: DataFrame, n: int = 5) -> DataFrame:
    """user_id, prompt: the present profile (user_id, profile) and the user's n latest ratings."""
    rows = simulate.recent_with_text(ratings, items.select("item_id", "title"), n)
    bodies = rows.groupBy("user_id").agg(simulate.joined_lines(_line(), F.col("recency")).alias("body"))
    return bodies.join(known, "user_id").select("user_id", _prompt(F.lit(INSTRUCTIONS["update"]), F.col("profile"), F.col("body")).alias("prompt"))


def request_prompts(known: DataFrame, recent: DataFrame, requested: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """user_id, chunk, prompt: profile, latest ratings (user_id, item_id, rating, recency) and up to `size` items to be rated.

    requested: user_id, item_id; items: item_id, title. Requested items without a title are not asked about.
    """
    titled = requested.select("user_id", "item_id").distinct().join(items.select("item_id", "title"), "item_id")
    order = Window.partitionBy("user_id").orderBy("item_id")
    rows = titled.withColumn("place", F.row_number().over(order)).withColumn("chunk", F.floor((F.col("place") - 1) / size))
    asked = rows.groupBy("user_id", "chunk").agg(simulate.joined_lines(F.format_string("- %s: %s", F.col("item_id").cast("string"), F.col("title")), F.col("place")).alias("asked"))
    latest = recent.join(items.select("item_id", "title"), "item_id").groupBy("user_id").agg(simulate.joined_lines(_line(), F.col("recency")).alias("latest"))
    both = asked.join(latest, "user_id", "left").join(known, "user_id", "left")
    text = F.concat(F.lit("Profile: "), F.coalesce("profile", F.lit("")), F.lit("\nLatest ratings:\n"), F.coalesce("latest", F.lit("")), F.lit("\nRate each item from 1 to 5:\n"), F.col("asked"))
    return both.select("user_id", "chunk", text.alias("prompt"))
