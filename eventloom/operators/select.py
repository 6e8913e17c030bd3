"""Row-picking operators: ordered de-duplication, anti join, top rows, gates. Order is a column, never an accident."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row of each key in ``order``. Partial minima run before the shuffle, so a hot key is a row a task."""
    names = [c for c in df.columns]
    best = df.select(key.alias("__key"), F.struct(F.col(order).alias("__order"), *names).alias("__row")).groupBy("__key").agg(F.min_by("__row", "__row.__order").alias("__row"))
    return best.select(*[F.col(f"__row.{c}").alias(c) for c in names])


def best_per_key(df: DataFrame, key: Column, score: str, order: str) -> DataFrame:
    """The row of the highest score of each key, ties to the earlier; ``place`` is the key's first position."""
    names = [c for c in df.columns]
    best = df.select(key.alias("__key"), F.struct(*names).alias("__row")).groupBy("__key").agg(
        F.max_by("__row", F.struct(F.col(f"__row.{score}"), -F.col(f"__row.{order}"))).alias("__row"), F.min(f"__row.{order}").alias("place")
    )
    return best.select(*[F.col(f"__row.{c}").alias(c) for c in names], "place")


def not_sent(df: DataFrame, sent: DataFrame, key: str = "url") -> DataFrame:
    """Rows whose key the state does not hold; the state grows, so adaptive execution picks how to join it."""
    return df.join(sent.select(key).distinct(), key, "left_anti")


def top_rows(df: DataFrame, score: str, order: str, limit: int) -> DataFrame:
    return df.orderBy(F.desc(score), order).limit(limit)


def first_rows_per_group(df: DataFrame, group: str, order: str, limit: int) -> DataFrame:
    at = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return df.withColumn("rank", at.cast("int")).where(F.col("rank") <= limit)


def gate_counts(df: DataFrame, gate: Column) -> DataFrame:
    """Rows by the first gate that stopped them."""
    return df.groupBy(gate.alias("gate")).agg(F.count("*").alias("n"))
