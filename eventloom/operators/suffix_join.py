"""Hosts against a table of domains: a host belongs to every domain that is its end at a dot.

Written as an equality, so the join can be hashed, shuffled and split as any other: a host of n labels has n endings, each
is a key, and the ending with the most labels that the table has wins. Only distinct hosts are expanded, at most
``LABELS`` endings each (a name has 127 labels at most), and a domain table is broadcast only if its counted rows are few.

Defined cases: null and empty hosts belong to nothing; hosts and domains compare in lower case, without a final dot, a port
or a user; of rows for the same domain the least value of ``order`` stays; an empty table leaves all rows without a domain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELS = 127
FEW = 200_000


def host_name(authority: Column) -> Column:
    """Lower-case host of an authority: no user, no port, no final dot."""
    bare = F.regexp_replace(F.lower(F.coalesce(authority, F.lit(""))), r"^.*@", "")
    return F.regexp_replace(F.regexp_replace(bare, r":\d*$", ""), r"\.$", "")


def endings(host: Column) -> Column:
    """All endings of a host at its dots, the whole host first; none of an empty one."""
    labels = F.split(host, r"\.")
    n = F.least(F.size(labels), F.lit(LABELS))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(labels, F.size(labels) - n + i + 1, n - i), ".")))


def suffix_join(df: DataFrame, host: Column, domains: DataFrame, domain: str = "domain", order: str | None = None, few: int = FEW) -> DataFrame:
    """``df``, left joined to the row of ``domains`` with the longest domain that is the host or a parent of it."""
    values = [c for c in domains.columns if c != domain]
    clean = domains.withColumn(domain, host_name(F.col(domain))).where(F.col(domain) != "")
    table = clean.groupBy(F.col(domain).alias("__ending")).agg(F.min_by(F.struct(F.col(domain).alias("domain"), *values), F.col(order or domain)).alias("__row"))
    rows = df.withColumn("__host", host_name(host))
    hosts = rows.select("__host").distinct().select("__host", F.posexplode(endings(F.col("__host"))).alias("__cut", "__ending"))
    if domains.limit(few + 1).count() <= few:
        table = F.broadcast(table)
    best = hosts.join(table, "__ending").groupBy("__host").agg(F.min_by("__row", "__cut").alias("__row"))
    return rows.join(best, "__host", "left").select(*df.columns, *[F.col(f"__row.{c}").alias(c) for c in ("domain", *values)])
