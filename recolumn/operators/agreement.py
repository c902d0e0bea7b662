"""Agreement of predicted with actual ratings."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def valid_pairs(rows: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Rows with both ratings, cast to integers (truncated)."""
    return rows.na.drop(subset=[actual, predicted]).withColumns({actual: F.col(actual).cast("int"), predicted: F.col(predicted).cast("int")})


def _gap() -> Column:
    return F.abs(F.col("actual") - F.col("predicted"))


def summary(rows: DataFrame) -> DataFrame:
    """RMSE, MAE, R2, exact / close / off counts and weighted accuracy, in one aggregate."""
    gap = _gap()
    moments = F.sum(F.col("actual") * F.col("actual")) - F.sum("actual") * F.sum("actual") / F.count("*")
    return valid_pairs(rows).agg(
        F.count("*").alias("n"),
        F.sqrt(F.avg(gap * gap)).alias("rmse"),
        F.avg(gap).alias("mae"),
        (1 - F.sum(gap * gap) / F.nullif(moments, F.lit(0.0))).alias("r2"),
        F.count_if(gap == 0).alias("exact"),
        F.count_if(gap == 1).alias("off_by_one"),
        F.count_if(gap > 1).alias("off_by_more"),
        F.avg(F.when(gap <= 1, 100.0).otherwise(0.0)).alias("close_percent"),
        F.avg(F.when(gap == 0, 1.0).when(gap == 1, 0.8).otherwise(0.0)).alias("weighted_accuracy"),
    )


def _table(rows: DataFrame) -> DataFrame:
    """Counts of (actual, predicted): as many rows as pairs of rating values."""
    return valid_pairs(rows).groupBy("actual", "predicted").agg(F.count("*").alias("n"))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction, evaluated from the front."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d, value, k = 1e-300, 1.0, 1.0 / (1 - (a + b) * x / (a + 1)), 1.0, 0
    value = d
    while k < 100_000:
        k += 1
        for term in (k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)), -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))):
            d, c = 1 + term * d, 1 + term / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            step = c * d
            value *= step
        if abs(step - 1) < 1e-15:
            break
    return front * value


def correlation_p(r: float, n: int) -> float:
    """Two-sided p-value of a correlation of n pairs, by Student's t with n - 2 degrees of freedom."""
    if r is None or n is None or n < 3 or math.isnan(r):
        return math.nan
    return 0.0 if abs(r) >= 1 else incomplete_beta((n - 2) / 2, 0.5, 1 - r * r)


@F.pandas_udf(DoubleType())
def _correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([correlation_p(x, m) for x, m in zip(r, n, strict=True)])


def spearman(rows: DataFrame) -> DataFrame:
    """n, rank correlation with average ranks, and its two-sided p-value, from the table of rating pairs."""
    table = _table(rows)
    for column in ("actual", "predicted"):
        side = table.groupBy(column).agg(F.sum("n").alias("m"))
        below = F.sum("m").over(Window.orderBy(column)) - F.col("m")
        table = table.join(side.select(column, (below + (F.col("m") + 1) / 2).alias(f"rank_{column}")), column)
    x, y, n = F.col("rank_actual"), F.col("rank_predicted"), F.col("n")
    sums = table.agg(F.sum(n).alias("n"), F.sum(n * x).alias("x"), F.sum(n * y).alias("y"), F.sum(n * x * x).alias("xx"), F.sum(n * y * y).alias("yy"), F.sum(n * x * y).alias("xy"))
    top = F.col("xy") - F.col("x") * F.col("y") / F.col("n")
    bottom = F.sqrt((F.col("xx") - F.col("x") * F.col("x") / F.col("n")) * (F.col("yy") - F.col("y") * F.col("y") / F.col("n")))
    found = sums.select(F.col("n"), (top / F.nullif(bottom, F.lit(0.0))).alias("spearman"))
    return found.withColumn("p_value", _correlation_p("spearman", "n"))


def quadratic_kappa(rows: DataFrame) -> DataFrame:
    """Cohen's kappa with quadratic weights, from moments of the two margins."""
    a, p = F.col("actual").cast("double"), F.col("predicted").cast("double")
    sums = valid_pairs(rows).agg(F.count("*").alias("n"), F.avg((a - p) * (a - p)).alias("seen"), F.avg(a).alias("ma"), F.avg(p).alias("mp"), F.avg(a * a).alias("aa"), F.avg(p * p).alias("pp"))
    chance = F.col("aa") + F.col("pp") - 2 * F.col("ma") * F.col("mp")
    return sums.select("n", (1 - F.col("seen") / F.nullif(chance, F.lit(0.0))).alias("kappa"))


def per_user(rows: DataFrame) -> DataFrame:
    """Per-user RMSE and accuracy (micro precision and recall of one label each are the same number)."""
    gap = _gap()
    hit = F.avg(F.when(gap == 0, 1.0).otherwise(0.0))
    return valid_pairs(rows).groupBy("user_id").agg(
        F.count("*").alias("n"), F.sqrt(F.avg(gap * gap)).alias("rmse"), hit.alias("accuracy"), hit.alias("micro_precision"), hit.alias("micro_recall")
    )


def token_cost(calls: DataFrame, prompt_price: float = 0.15, completion_price: float = 0.60, per: float = 1e6) -> DataFrame:
    """Token sums and cost of a call log; prices are per `per` tokens."""
    return calls.agg(
        F.count("*").alias("calls"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        (F.sum("prompt_tokens") * (prompt_price / per) + F.sum("completion_tokens") * (completion_price / per)).alias("cost"),
    )
