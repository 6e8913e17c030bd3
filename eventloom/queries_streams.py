"""Queries of streams and of the state between runs, with DuckDB SQL that replays them step by step."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.operators.durable import scratch
from eventloom.sources.sent import SentTable
from eventloom.streaming.incremental import run_stream
from eventloom.streaming.ledger import Ledger
from eventloom.streaming.seen import first_seen_within, stateful

PARTS, LIMIT = 4, 10


def refuses(text: str) -> dict:
    """A sink that never takes some talks."""
    return {"ok": int(re.search(r"Talk (\d+)", text)[1]) % 50 != 7}


def delivery_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four runs that each find a part of the events, then one that finds nothing new: what was sent, and what waits."""
    folder = scratch(spark, "ledger")
    n = F.col("event_id") % 4001
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("ord"), F.concat(F.lit("https://e.org/"), n).alias("url"), F.concat(F.lit("Talk "), n).alias("title"),
        ((F.col("event_id") * 37) % 101).cast("int").alias("verification_score"), F.lit(True).alias("is_today"),
    )
    for part in range(PARTS + 1):
        if part < PARTS:
            rows.where(F.col("ord") % PARTS == part).write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        run_stream(source, f"{folder}/state", f"{folder}/checkpoint", refuses, LIMIT, pause=0).awaitTermination()
    ledger = Ledger(spark, f"{folder}/state")
    return ledger.sent().select("url", "status", "step").unionByName(ledger.pending().select("url", F.lit("waiting").alias("status"), F.col("since").alias("step")))


def _ledger_sql() -> str:
    steps = [
        "e as (select event_id as ord, 'https://e.org/' || (event_id % 4001) as url, event_id % 4001 as n, (event_id * 37) % 101 as score, event_id % 4 as part from events)",
        "x0 as (select url, n, ord, score, 0 as since from e where part = 0)",
    ]
    for k in range(PARTS + 1):
        if k:
            fresh = f" union all select url, n, ord, score, {k} from e where part = {k}" if k < PARTS else ""
            steps.append(f"x{k} as (select url, n, ord, score, since from w{k - 1}{fresh})")
        gone = "".join(f" and url not in (select url from s{j})" for j in range(k))
        steps.append(f"w{k} as (select url, n, ord, score, since from (select *, row_number() over (partition by url order by since, ord) as r from x{k}) where r = 1{gone})")
        steps.append(f"s{k} as (select url from (select * from w{k} order by score desc, ord limit {LIMIT}) where n % 50 <> 7)")
    sent = " union all ".join(f"select url, 'sent' as status, cast({k} as bigint) as step from s{k}" for k in range(PARTS + 1))
    return f"with {', '.join(steps)} {sent} union all select url, 'waiting', cast(since as bigint) from w{PARTS} where url not in (select url from s{PARTS})"


def first_seen_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user and type that were not seen for six hours, over three runs of one stream."""
    own, folder = stateful(spark), scratch(spark, "seen")
    rows = own.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat_ws("/", "event_type", "user_id").alias("url"))
    third = F.least(F.floor((F.dayofmonth("ts") - 1) / 10), F.lit(2))
    for part in range(3):
        rows.where(third == part).write.mode("append").parquet(f"{folder}/in")
        seen = first_seen_within(own.readStream.schema(rows.schema).parquet(f"{folder}/in"), "ts", "url", "6 hours", "1 minute", "event_id")
        seen.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint").format("parquet").start(f"{folder}/out").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/out").select("event_id", "url")


FIRST_SEEN_SQL = """
select event_id, url from (
  select event_id, url, ts, lag(ts) over (partition by url order by ts, event_id) as before
  from (select event_id, ts, event_type || '/' || user_id as url from events where event_type is not null and user_id is not null and ts is not null)
) where before is null or ts - before >= interval 6 hours
"""


def sent_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that an earlier run has not sent, by the table of sent urls in buckets: of each site, the odd ones went out."""
    table = SentTable(spark, scratch(spark, "sent"), "eventloom_sent_pages", buckets=16)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    table.add(pages.where("page_id % 2 = 1"))
    return table.reject(pages)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"delivery_ledger": delivery_ledger, "first_seen_stream": first_seen_stream, "sent_table": sent_table}
SQL: dict[str, str] = {
    "delivery_ledger": _ledger_sql(),
    "first_seen_stream": FIRST_SEEN_SQL,
    "sent_table": "select page_id, url from pages where url is null or url not in (select url from pages where page_id % 2 = 1 and url is not null)",
}
