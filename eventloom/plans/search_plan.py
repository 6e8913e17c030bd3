"""Search plans: query texts and the URLs that ask them, as relations with an order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions import lexicon as L
from eventloom.functions.text import percent

# Query templates, in order; {} is a topic or place. Search pages.
PER_TOPIC = ["{} India event"]
PER_CITY_A = ["cybersecurity {}", "cyber security {} meetup", "infosec {} event", "security conference {}", "security workshop {}", "CTF {}", "cybersecurity networking {}"]
COMMUNITIES = ["OWASP {}", "Null security {}", "BSides {}"]
NATIONAL = [
    "cybersecurity event India", "cyber security event India", "information security event India", "infosec event India", "cybersecurity meetup India", "cybersecurity conference India",
    "cybersecurity workshop India", "cybersecurity webinar India", "cybersecurity CTF India", "cybersecurity hackathon India", "cybersecurity networking India",
]
PER_CITY_B = ["cybersecurity event {}", "cybersecurity meetup {}", "cyber security event {}", "infosec event {}", "security conference {}", "security workshop {}", "CTF {}", "cybersecurity networking {}", "OWASP {}"]
TOPICS_B = ["application security", "cloud security", "AI security", "SOC", "blue team", "red team", "DFIR", "OSINT", "threat intelligence", "incident response", "bug bounty", "VAPT", "penetration testing", "ethical hacking", "GRC", "IAM", "network security", "malware"]
ONLINE = ["online cybersecurity webinar India", "virtual cybersecurity event India", "online cybersecurity conference India", "online cybersecurity workshop India"]
PAGES = [("Eventbrite", "https://www.eventbrite.com/d/india/{query}/"), ("Meetup", "https://www.meetup.com/find/?keywords={query}&source=EVENTS"), ("Luma", "https://lu.ma/discover?q={query}")]
FEED = "https://news.google.com/rss/search?q={query}&hl=en-IN&gl=IN&ceid=IN:en"
FIRST_QUERIES = 20
# The feed queries, in order.
FEED_QUERIES = [
    "cybersecurity event India", "cyber security event India", "information security event India", "infosec event India",
    "cybersecurity meetup India", "cyber security meetup India", "cybersecurity conference India", "cybersecurity workshop India",
    "cybersecurity CTF India", "security meetup India", "security conference India", "cybersecurity networking India", "OWASP India event",
    "Null India cybersecurity meetup", "BSides India cybersecurity", "security community India", "hacker meetup India", "AppSec event India",
    "Application Security event India", "Cloud Security event India", "AI Security event India", "SOC event India", "Blue Team event India",
    "Red Team event India", "DFIR event India", "digital forensics event India", "OSINT event India", "threat intelligence event India",
    "incident response event India", "bug bounty event India", "VAPT event India", "penetration testing event India", "ethical hacking event India",
    "GRC event India", "IAM event India", "network security event India", "malware event India", "CTF India", "cybersecurity hackathon India",
    "cybersecurity event Hyderabad", "cybersecurity meetup Hyderabad", "infosec meetup Hyderabad", "OWASP Hyderabad event",
    "security meetup Hyderabad", "cybersecurity event Bengaluru", "cybersecurity meetup Bengaluru", "infosec meetup Bengaluru",
    "OWASP Bengaluru event", "security meetup Bengaluru", "cybersecurity event Mumbai", "cybersecurity meetup Mumbai", "infosec meetup Mumbai",
    "OWASP Mumbai event", "security meetup Mumbai", "cybersecurity event Pune", "cybersecurity meetup Pune", "infosec meetup Pune",
    "OWASP Pune event", "security meetup Pune", "cybersecurity event Chennai", "cybersecurity meetup Chennai", "infosec meetup Chennai",
    "OWASP Chennai event", "security meetup Chennai", "cybersecurity event Delhi", "cybersecurity meetup Delhi", "cybersecurity event Gurgaon",
    "cybersecurity event Gurugram", "cybersecurity event Noida", "cybersecurity event Kolkata", "cybersecurity event Kochi",
    "cybersecurity event Ahmedabad", "cybersecurity event Jaipur", "cybersecurity event Chandigarh", "cybersecurity event Bhubaneswar",
    "cybersecurity event Lucknow", "cybersecurity event Indore", "cybersecurity event Coimbatore", "cybersecurity event Visakhapatnam",
    "cybersecurity webinar India", "cybersecurity virtual event India", "online cybersecurity conference India",
    "online cybersecurity workshop India",
]


def _rows(spark: SparkSession, values: list[str], column: str) -> DataFrame:
    return spark.range(1).select(F.posexplode(F.array(*[F.lit(v) for v in values])).alias(f"{column}_at", column))


def _filled(spark: SparkSession, block: int, templates: list[str], values: list[str]) -> DataFrame:
    """Every template with every value; two short lists of constants, so the product is as bounded as they are."""
    pairs = _rows(spark, values, "value").withColumn("template", F.explode(F.arrays_zip(F.array(*[F.lit(t) for t in templates]).alias("t"), F.sequence(F.lit(0), F.lit(len(templates) - 1)).alias("i"))))
    return pairs.select(F.lit(block).alias("block"), F.col("value_at").alias("i"), F.col("template.i").alias("j"), F.replace(F.col("template.t"), F.lit("{}"), F.col("value")).alias("query"))


def _ordered(parts: list[DataFrame]) -> DataFrame:
    """Distinct queries numbered by first place."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    first = whole.groupBy("query").agg(F.min(F.struct("block", "i", "j")).alias("at"))
    below = F.array_sort(F.collect_list(F.struct("at", "query")))
    return first.agg(below.alias("q")).select(F.posexplode("q").alias("ord", "q")).select("ord", "q.query")


def search_plan_a(spark: SparkSession) -> DataFrame:
    return _ordered([_filled(spark, 0, PER_TOPIC, L.COLLECT_TOPICS), _filled(spark, 1, PER_CITY_A, L.COLLECT_CITIES), _filled(spark, 2, COMMUNITIES, L.COLLECT_CITIES)])


def search_plan_b(spark: SparkSession) -> DataFrame:
    return _ordered([_filled(spark, 0, NATIONAL, [""]), _filled(spark, 1, PER_CITY_B, L.PLACES), _filled(spark, 2, PER_TOPIC, TOPICS_B), _filled(spark, 3, ONLINE, [""])])


def feed_plan(spark: SparkSession) -> DataFrame:
    """The feed queries in order, with the address that asks each."""
    return feed_urls(_rows(spark, FEED_QUERIES, "query").select(F.col("query_at").alias("ord"), "query"))


def search_urls(spark: SparkSession, first: int = FIRST_QUERIES) -> DataFrame:
    """The first queries on every search page."""
    pages = F.explode(F.array(*[F.struct(F.lit(k).alias("page"), F.lit(n).alias("name"), F.lit(t).alias("template")) for k, (n, t) in enumerate(PAGES)]))
    return search_plan_a(spark).where(F.col("ord") < first).withColumn("p", pages).select("ord", F.col("p.name").alias("name"), F.replace(F.col("p.template"), F.lit("{query}"), percent(F.col("query"))).alias("url"))


def feed_urls(queries: DataFrame) -> DataFrame:
    return queries.withColumn("url", F.replace(F.lit(FEED), F.lit("{query}"), percent(F.col("query"), True)))
