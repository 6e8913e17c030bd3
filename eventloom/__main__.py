"""Command line: ``python -m eventloom discover`` reads the feeds, ``probe`` asks each source once, ``verify URL`` prints one
page's result as JSON. Exit code 0 if all went well, 130 if interrupted, 1 after an error."""

from __future__ import annotations

import datetime
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.operators import report
from eventloom.plans.collect import feed_events
from eventloom.plans.search_plan import feed_plan, feed_urls
from eventloom.plans.verify import verify
from eventloom.sources import registry
from eventloom.sources.feeds import feed_items
from eventloom.sources.fetch import fetched

POLITENESS = 1.0  # seconds between feed queries


def discover(spark: SparkSession, get=None) -> list[str]:
    """Lines of the events that the feeds name."""
    plan = feed_plan(spark)
    pages = fetched(plan, *([get] if get else []), pause=0.0 if get else POLITENESS)
    items = feed_items(plan.join(pages.where("reachable").select("url", F.col("html").alias("xml")), "url").drop("url"))
    events = feed_events(items.withColumn("ord", F.col("ord") * 1000 + F.col("pos")))
    return [r.line for r in events.withColumn("n", F.lit("-")).select(report.event_lines("n").alias("line")).collect()]


def probe(spark: SparkSession, get=None) -> DataFrame:
    """url, status, n_chars and reachable of the direct sources and one feed."""
    feed = feed_urls(spark.range(1).select(F.lit("cybersecurity event India").alias("query"))).select("url")
    asked = registry.direct_sources(spark).select("url").unionByName(feed)
    return fetched(asked, *([get] if get else [])).select("url", "status", F.length("html").alias("n_chars"), "reachable")


def verified_json(spark: SparkSession, url: str, get=None) -> str:
    """The verification result of one page, as indented JSON."""
    candidate = spark.range(1).select(F.lit(url).alias("url"), F.lit("").alias("title"))
    row = report.as_json(verify(candidate, fetched(candidate, *([get] if get else [])), F.current_date())).first()
    return json.dumps(json.loads(row.value), indent=2, ensure_ascii=False)


def main(argv: list[str], get=None) -> int:
    try:
        if not argv or argv[0] not in ("discover", "probe", "verify") or (argv[0] == "verify") != (len(argv) == 2):
            print(__doc__, file=sys.stderr)
            return 1
        spark = SparkSession.builder.getOrCreate()
        if argv[0] == "verify":
            print(verified_json(spark, argv[1], get))
        elif argv[0] == "probe":
            for r in probe(spark, get).collect():
                print(r.url, r.status, r.n_chars, "accessible" if r.reachable else "not ok")
        else:
            lines = discover(spark, get)
            print("\n".join([f"{datetime.date.today()}: {len(lines)} events", *lines]))
        return 0
    except KeyboardInterrupt:
        return 130
    except Exception as e:  # noqa: BLE001  the exit code is the contract
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
