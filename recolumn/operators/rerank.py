"""Reranking of lists by judgments: listwise (hybrid of two ranks) and pairwise (search tree)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

UNMATCHED = 999
#: Weight of the judged rank by its value: up to 5, up to 10, beyond.
WEIGHTS = ((5, 0.9), (10, 0.7), (None, 0.5))


def item_details(candidates: DataFrame, items: DataFrame) -> DataFrame:
    """`title (year): overview` of each candidate; missing items keep a null text."""
    year = X.year(F.col("release_date"))
    label = F.concat("title", F.when(year != "", F.concat(F.lit(" ("), year, F.lit(")"))).otherwise(""), F.lit(": "), F.coalesce("overview", F.lit("")))
    return candidates.join(items.select("item_id", label.alias("details")), "item_id", "left")


def missing_items(candidates: DataFrame, items: DataFrame) -> DataFrame:
    """user_id and the ids, in order, of the user's candidates that `items` lacks; users without any are left out."""
    lacking = candidates.select("user_id", "item_id").join(items.select("item_id"), "item_id", "left_anti")
    return lacking.groupBy("user_id").agg(F.sort_array(F.collect_set("item_id")).alias("missing"))


def ranked_lines(replies: DataFrame, key: str = "user_id", column: str = "reply") -> DataFrame:
    """user_id, llm_rank from 1, title of each usable line of a reply."""
    lines = replies.select(key, F.posexplode(F.split(column, "\n")).alias("line", "text"))
    lines = lines.withColumn("title", X.ranked_title(F.col("text"))).where("title is not null")
    return lines.select(key, F.row_number().over(Window.partitionBy(key).orderBy("line")).alias("llm_rank"), "title")


def match_titles(candidates: DataFrame, lines: DataFrame) -> DataFrame:
    """Judged rank of each candidate (user_id, item_id, title): equal keys, else containment with the largest letter overlap, else 999.

    The exact match is an equi-join; only what it leaves meets its own user's lines.
    Of equal keys in a reply the last place counts; of equal overlaps the first.
    """
    own = candidates.withColumn("key", X.title_key(F.col("title")))
    said = lines.select("user_id", "llm_rank", X.title_key(F.col("title")).alias("said"))
    places = said.groupBy("user_id", "said").agg(F.max("llm_rank").alias("llm_rank"))
    exact = own.join(places.withColumnRenamed("said", "key"), ["user_id", "key"], "left")
    rest = exact.where("llm_rank is null").drop("llm_rank")
    near = rest.join(places, "user_id").where((F.col("said") != "") & (F.col("key").contains(F.col("said")) | F.col("said").contains(F.col("key"))))
    near = near.withColumn("overlap", F.round(X.letter_overlap(F.col("key"), F.col("said")), 9))
    near = near.groupBy("user_id", "item_id").agg(F.max(F.struct("overlap", (-F.col("llm_rank")).alias("r"))).alias("best")).select("user_id", "item_id", (-F.col("best.r")).alias("near_rank"))
    rows = exact.join(near, ["user_id", "item_id"], "left")
    return rows.withColumn("llm_rank", F.coalesce("llm_rank", "near_rank", F.lit(UNMATCHED))).drop("key", "near_rank")


def hybrid_ranks(rows: DataFrame) -> DataFrame:
    """Normalised ranks, hybrid score and new rank of (user_id, item_id, recommendation_rank, llm_rank) rows."""
    user = Window.partitionBy("user_id")
    rows = rows.withColumns({
        "norm_orig_rank": F.col("recommendation_rank") / F.max("recommendation_rank").over(user),
        "norm_llm_rank": F.col("llm_rank") / F.max("llm_rank").over(user),
    })
    weight = F.when(F.col("llm_rank") <= WEIGHTS[0][0], WEIGHTS[0][1]).when(F.col("llm_rank") <= WEIGHTS[1][0], WEIGHTS[1][1]).otherwise(WEIGHTS[2][1])
    score = F.round(weight * F.col("norm_llm_rank") + (1 - weight) * F.col("norm_orig_rank"), 9)
    rows = rows.withColumn("hybrid_score", score)
    order = user.orderBy("hybrid_score", "recommendation_rank", "item_id")
    return rows.withColumn("new_rank", F.row_number().over(order))


def merged_back(recs: DataFrame, reranked: DataFrame, module: str = "LLM") -> DataFrame:
    """All recommendations with the new rank and module where there is one."""
    new = reranked.select("user_id", "item_id", "new_rank")
    rows = recs.join(new, ["user_id", "item_id"], "left")
    return rows.select(
        "user_id", "item_id", F.coalesce("new_rank", "recommendation_rank").alias("recommendation_rank"),
        F.when(F.col("new_rank").isNotNull(), module).otherwise(F.col("module_source")).alias("module_source"),
    )


def tree_order(ids: list, prefers: Callable) -> list:
    """In-order walk of a search tree: an item that `prefers` the incoming one over a node goes left, else right.

    `prefers(a, b)` returns the id that wins; anything but the incoming id means right.
    Answers are kept for each unordered pair.
    """
    known: dict = {}

    def wins(new, node):
        key = (min(new, node), max(new, node))
        if key not in known:
            known[key] = prefers(new, node)
        return known[key] == new

    nodes, root = {}, None
    for item in ids:
        nodes[item] = [None, None]
        if root is None:
            root = item
            continue
        at = root
        while True:
            side = 0 if wins(item, at) else 1
            if nodes[at][side] is None:
                nodes[at][side] = item
                break
            at = nodes[at][side]
    out, stack, at = [], [], root
    while stack or at is not None:
        while at is not None:
            stack.append(at)
            at = nodes[at][0]
        at = stack.pop()
        out.append(at)
        at = nodes[at][1]
    return out


def pairwise_order(candidates: DataFrame, judge: Callable[[dict, object, object], object], top: int = 20) -> DataFrame:
    """Each user's first `top` candidates in the order of a judge over pairs; candidates carry `score`, which a judge may use.

    `judge(scores, a, b)` gets the user's scores by item. One user's short list is one group.
    """
    head = candidates.where(F.col("recommendation_rank") <= top)

    def order(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("recommendation_rank")
        scores = dict(zip(group.item_id, group.score, strict=True))
        ids = tree_order(list(group.item_id), lambda a, b: judge(scores, a, b))
        return pd.DataFrame({"user_id": group.user_id.iloc[0], "item_id": ids, "new_rank": range(1, len(ids) + 1)})

    return head.select("user_id", "item_id", "recommendation_rank", "score").groupBy("user_id").applyInPandas(order, "user_id long, item_id long, new_rank int")


def by_score(scores: dict, a, b):
    """A consistent judge: higher score, then the smaller item."""
    return a if (-scores[a], a) < (-scores[b], b) else b


def rerank_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """Users, rows and moved rows of a rerank."""
    rows = before.join(after.select("user_id", "item_id", F.col("recommendation_rank").alias("new_rank"), F.col("module_source").alias("new_module")), ["user_id", "item_id"])
    return rows.agg(
        F.count_distinct("user_id").alias("users"), F.count("*").alias("rows"), F.count_if(F.col("new_module") == "LLM").alias("judged"),
        F.count_if(F.col("new_rank") != F.col("recommendation_rank")).alias("moved"),
    )
