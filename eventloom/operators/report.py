"""Reports of a run as tables: sizes, rejections, deliveries, and lines for a console."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHOWN = 50


def sizes(raw: DataFrame, unique: DataFrame) -> DataFrame:
    """One row: how many candidates were found and how many are left."""
    counted = raw.select(F.lit(1).cast("long").alias("raw"), F.lit(0).cast("long").alias("unique")).unionByName(unique.select(F.lit(0).cast("long").alias("raw"), F.lit(1).cast("long").alias("unique")))
    return counted.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("raw"), F.coalesce(F.sum("unique"), F.lit(0)).alias("unique"))


def delivery_counts(results: DataFrame) -> DataFrame:
    """One row of results (url, status): attempted, sent, failed, blocked. A missing address counts as failed, an event
    that is not today's is blocked and counts as neither."""
    of = lambda s: F.count_if(F.col("status") == s)
    return results.agg(F.count("*").alias("attempted"), of("sent").alias("sent"), of("failed").alias("failed"), of("blocked").alias("blocked"))


def candidate_lines(candidates: DataFrame, order: str, limit: int = SHOWN) -> DataFrame:
    """Numbered lines of the first ``limit`` candidates: number, line."""
    first = candidates.orderBy(order).limit(limit)
    listed = first.agg(F.sort_array(F.collect_list(F.struct(order, "title", "source", "description", "url"))).alias("rows"))
    rows = listed.select(F.posexplode("rows").alias("i", "r"))
    return rows.select((F.col("i") + 1).alias("number"), F.concat(F.lit("["), (F.col("i") + 1).cast("string"), F.lit("] "), F.col("r.title"), F.lit("\n    Source: "), F.col("r.source"), F.lit("\n    "), F.col("r.description"), F.lit("\n    URL: "), F.col("r.url")).alias("line"))


def event_lines(order: str) -> Column:
    """The line of a discovered event; ``order`` names its number."""
    published = F.when(F.coalesce("published", F.lit("")) != "", F.concat(F.lit("\n   📅 Published: "), F.col("published"))).otherwise("")
    return F.concat(F.col(order).cast("string"), F.lit(". "), F.col("title"), F.lit("\n   📍 Location: "), F.col("location"), F.lit("\n   ⭐ Confidence: "), F.col("confidence").cast("string"), F.lit("/100\n   🌐 Source: "), F.col("source"), published, F.lit("\n   🔗 "), F.col("url"))


def as_json(rows: DataFrame) -> DataFrame:
    """Each row as a JSON object of all its columns, empty ones too."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
