"""Static source tables. Names, addresses, priorities, caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCES = [
    ("owasp", "OWASP", "https://owasp.org/events/", "cybersecurity", True, 10),
    ("null", "Null Community", "https://null.community/", "cybersecurity", True, 10),
    ("bsides", "BSides", "https://www.securitybsides.com/", "cybersecurity", True, 10),
    ("meetup", "Meetup", "https://www.meetup.com/", "community", True, 8),
    ("eventbrite", "Eventbrite", "https://www.eventbrite.com/", "events", True, 8),
    ("luma", "Luma", "https://lu.ma/", "events", True, 8),
]
DIRECT = [
    ("owasp_events", "OWASP Events", "https://owasp.org/events/", "OWASP", True),
    ("owasp_chapters", "OWASP Chapters", "https://owasp.org/chapters/", "OWASP", True),
    ("null", "Null Community", "https://null.community/", "Null Community", True),
    ("bsides", "Security BSides", "https://www.securitybsides.com/", "BSides", True),
]
EVENT_FIELDS = "title date time start_date end_date city state location venue organizer event_type price description registration_url event_url source_url source published".split()


def _frame(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A literal table, without a Python conversion."""
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names, strict=True)]) for r in rows])))


def sources(spark: SparkSession) -> DataFrame:
    return _frame(spark, SOURCES, ["key", "name", "url", "type", "enabled", "priority"])


def direct_sources(spark: SparkSession) -> DataFrame:
    """The pages that are read directly, numbered in their order."""
    return _frame(spark, [(n, *r) for n, r in enumerate(DIRECT)], ["ord", "key", "name", "url", "source", "enabled"])


def source_by_key(df: DataFrame, key: str) -> DataFrame:
    """The row of a source key; no row if there is none."""
    return df.where(F.col("key") == key)


def enabled(df: DataFrame) -> DataFrame:
    return df.where(F.coalesce("enabled", F.lit(True)))


def source_name(key: Column) -> Column:
    """Display name of a source key, or the key."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for r in SOURCES for x in r[:2]]), key), key)


def empty_event(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(*[F.lit("").alias(c) for c in EVENT_FIELDS], F.lit(0).alias("verification_score"))
