"""Text to vectors. `Embedder` is the extension point; the default needs no model files."""

from __future__ import annotations

from typing import Protocol

from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V


class Embedder(Protocol):
    def __call__(self, rows: DataFrame, key: str, text: str) -> DataFrame:
        """(key, vector) of every row whose text is not blank."""


class HashedTerms:
    """Hashed term counts weighted by inverse document frequency."""

    def __init__(self, width: int = 64):
        self.width = width

    def __call__(self, rows: DataFrame, key: str, text: str) -> DataFrame:
        words = RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"\s+").transform(rows.select(key, text))
        counts = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=self.width).transform(words)
        weighted = IDF(inputCol="_counts", outputCol="_weighted").fit(counts).transform(counts)
        return weighted.select(key, vector_to_array("_weighted").alias("vector"))


def embed_text(rows: DataFrame, key: str, text: str, embedder: Embedder | None = None, prefix: str = "clustering: ") -> DataFrame:
    """rows with `<text>_vector`: layer norm, unit length, five decimals; null where the text is blank."""
    named = rows.where(X.not_blank(F.col(text))).select(key, F.concat(F.lit(prefix), text).alias(text))
    vectors = (embedder or HashedTerms())(named, key, text)
    finished = vectors.select(key, V.embedding_finish(F.col("vector")).cast("array<float>").alias(f"{text}_vector"))
    return rows.join(finished, key, "left")
