"""The best rows of each group; ties go to the smaller id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_k(rows: DataFrame, k: int | None, by: list[str], score: str, tie: str) -> DataFrame:
    """rows with ``rank`` from 1, at most k of each group. Spark keeps k of each task and group before it shuffles."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), tie)))
    return ranked if k is None else ranked.where(F.col("rank") <= k)
