"""Exact nearest neighbours by cosine distance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import cosine_distance

#: Enabled embedding models and the length of their vectors; the first is the default.
MODELS = {"minilm": 384, "mpnet": 768}


def nearest(vectors: DataFrame, query: list[float], limit: int = 10, offset: int = 0, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The rows nearest to query, nearest first, ties by id: each task keeps its best offset + limit, then these are merged."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit is 1 to 100, offset at least 0")
    scored = vectors.withColumn("distance", cosine_distance(F.col(vector), F.array(*[F.lit(float(x)) for x in query])))
    return scored.orderBy(F.col("distance").asc_nulls_last(), id_column).offset(offset).limit(limit)


def search_text(vectors: DataFrame, texts: DataFrame, text: str, embed: Callable[[str], list[float]], **options) -> DataFrame:
    """Embeds a text, finds the nearest vectors, then joins their texts (text_id to id), so only found texts are read."""
    found = nearest(vectors, embed(text), id_column="text_id", **options)
    return texts.join(F.broadcast(found.select(F.col("text_id").alias("id"), "distance")), "id").orderBy("distance", "id")
