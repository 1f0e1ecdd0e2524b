"""Embedding distance to each key's own history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine_distance, mean_vector


def distance_to_history(history: DataFrame, query: DataFrame, keys: Sequence[str], vector: str = "embedding") -> DataFrame:
    """The query rows with ``distance`` to the mean of the history rows of their key (null if the
    key has no history) and ``n_history``."""
    means = mean_vector(history, keys, vector)
    return query.join(means, list(keys), "left").withColumn("distance", cosine_distance(F.col(vector), F.col("mean_vector"))).withColumn("n_history", F.coalesce("n", F.lit(0))).drop("mean_vector", "n")


def merge_distances(first: DataFrame, second: DataFrame, third: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join of (keys, one score column each)."""
    return first.join(second, list(keys), "outer").join(third, list(keys), "outer")
