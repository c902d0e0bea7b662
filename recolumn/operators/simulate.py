"""User simulation around an external judge: histories, prompts, parsed replies, feedback rows.

The judge itself is outside Spark. `Replay` looks replies up in a table; any callable
over prompt batches can take its place in `ask`.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .relational import chunks, polarity, top_n


def recent(ratings: DataFrame, n: int, tie: str = "item_id") -> DataFrame:
    """Each user's n latest ratings with `recency` (1 = latest)."""
    return top_n(ratings, ["user_id"], [F.desc("ts"), F.desc(tie)], n, "recency")


def recent_with_text(ratings: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """The n latest ratings, then joined with item text: items without text drop out after the cut."""
    return recent(ratings, n).join(items, "item_id")


def recent_by_polarity(ratings: DataFrame, n: int, variant: str = "range") -> DataFrame:
    """Each user's n latest positives and n latest negatives."""
    rows = ratings.withColumn("polarity", polarity(F.col("rating"), variant)).where("polarity is not null")
    return top_n(rows, ["user_id", "polarity"], [F.desc("ts"), F.desc("item_id")], n, "recency")


def joined_lines(line: Column, order: Column) -> Column:
    """Aggregate: the group's lines in order."""
    pairs = F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("t"))))
    return F.array_join(F.transform(pairs, lambda p: p["t"]), "\n")


def prompts(rows: DataFrame, head: str = "Ratings so far:\n") -> DataFrame:
    """One prompt per user: a heading, then `- item: rating` lines, latest first."""
    line = F.format_string("- %s: %d", F.col("title"), F.col("rating").cast("int"))
    return rows.groupBy("user_id").agg(F.concat(F.lit(head), joined_lines(line, F.col("recency"))).alias("prompt"))


def chunk_prompts(rows: DataFrame, size: int = 10) -> DataFrame:
    """One prompt per user and chunk of `size` rows, oldest first: the steps of an iterative profile."""
    rows = chunks(rows, "user_id", [F.asc("ts"), F.asc("item_id")], size)
    line = F.format_string("%s=%d", F.col("item_id").cast("string"), F.col("rating").cast("int"))
    return rows.groupBy("user_id", "chunk").agg(F.count("*").alias("n"), joined_lines(line, F.col("place")).alias("prompt"))


def profile_steps(steps: DataFrame) -> DataFrame:
    """user_id and a map of chunk to text."""
    return steps.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("chunk", "prompt")))).alias("intermediate"))


class Replay:
    """A judge that answers from recorded replies."""

    def __init__(self, replies: dict[str, str]):
        self.replies = replies

    def __call__(self, batch: list[str]) -> list[str | None]:
        return [self.replies.get(p) for p in batch]


def ask(rows: DataFrame, judge: Callable[[list[str]], list[str | None]], attempts: int = 3, wait: float = 0.0, keys: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """rows (keys, prompt) with `reply`, `attempts` and `status` (ok, no_reply or error).

    A judge that raises fails its attempt, not the task; before each further attempt it gets `wait` seconds, doubled every time.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            todo, reply = list(part.prompt), [None] * len(part)
            used, missing = [0] * len(part), "no_reply"
            for turn in range(attempts):
                open_ = [k for k, r in enumerate(reply) if r is None]
                if not open_:
                    break
                time.sleep(wait * 2**turn / 2 if turn else 0)
                try:
                    found, missing = list(judge([todo[k] for k in open_])), "no_reply"
                except Exception:  # whatever the judge's client raises
                    found, missing = [None] * len(open_), "error"
                for k, r in zip(open_, found, strict=True):
                    reply[k], used[k] = r, used[k] + 1
            yield part.assign(reply=reply, attempts=used, status=["ok" if r is not None else missing for r in reply])

    own = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.select(*keys, "prompt").mapInPandas(run, f"{own}, prompt string, reply string, attempts int, status string")


def parsed_ratings(replies: DataFrame) -> DataFrame:
    """user_id, item_id, rating rows of JSON replies, code fences removed."""
    pairs = X.ratings_map(X.unfenced(F.col("reply")))
    return replies.select("user_id", F.explode(pairs).alias("p")).select("user_id", "p.item_id", "p.rating")


def feedback(replies: DataFrame, requested: DataFrame, catalog: DataFrame, at: Column) -> DataFrame:
    """New interaction rows: parsed ratings of items that were requested and are in the catalog, stamped with `at`."""
    rows = parsed_ratings(replies).join(requested.select("user_id", "item_id"), ["user_id", "item_id"], "left_semi").join(catalog.select("item_id"), "item_id", "left_semi")
    return rows.select("user_id", "item_id", "rating", at.alias("ts"))


def minute_tokens(calls: DataFrame, limit: int) -> DataFrame:
    """Token sums by minute and whether they pass the limit."""
    return calls.groupBy(F.date_trunc("minute", "ts").alias("minute")).agg(F.sum("tokens").alias("tokens")).withColumn("over", F.col("tokens") > limit)


def iterative_profiles(steps: DataFrame, judge: Callable[[list[str]], list[str | None]], instruction: str = "Update the profile.\n") -> DataFrame:
    """user_id, chunk, profile: each chunk's prompt holds the profile so far, so a user's chunks go one after another (in one task; `loops.run_steps` keeps state and can resume).

    steps: user_id, chunk, prompt. A chunk without a reply, or whose judge raises, keeps the profile before it.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        profile, out = "", []
        for row in group.sort_values("chunk").itertuples():
            try:
                reply = judge([f"{instruction}Profile: {profile}\n{row.prompt}"])[0]
            except Exception:  # whatever the judge's client raises
                reply = None
            profile = profile if reply is None else reply
            out.append((row.user_id, row.chunk, profile))
        return pd.DataFrame(out, columns=["user_id", "chunk", "profile"])

    kind = steps.schema["user_id"].dataType.simpleString()
    return steps.select("user_id", "chunk", "prompt").groupBy("user_id").applyInPandas(run, f"user_id {kind}, chunk long, profile string")


def enrich_missing(items: DataFrame, column: str, judge: Callable[[list[str]], list[str | None]], prompt: Column) -> DataFrame:
    """items with `column` filled by the judge where it is null or empty; other rows are not asked about."""
    open_ = items.where(F.col(column).isNull() | (F.col(column) == "")).select(F.col("item_id").alias("user_id"), prompt.alias("prompt"))
    found = ask(open_, judge).select(F.col("user_id").alias("item_id"), F.col("reply").alias("_reply"))
    return items.join(found, "item_id", "left").withColumn(column, F.coalesce("_reply", column)).drop("_reply")
