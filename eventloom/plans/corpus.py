"""A corpus of event pages made from the ``events`` table by arithmetic on its ids, in Spark and in DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-01-15"
#: What the two dialects write differently.
DIALECTS = {
    "spark": {"shift": "date_add(date '2024-01-15', cast(event_id % 41 as int) - 20)", "long": "date_format(d, 'dd MMMM yyyy')", "short": "date_format(d, 'MMMM d, yyyy')", "iso": "date_format(d, 'yyyy-MM-dd')", "slash": "date_format(d, 'dd/MM/yyyy')", "end": "date_format(date_add(d, cast(event_id % 40 as int) - 2), 'yyyy-MM-dd')", "upper": "upper(date_format(d, 'MMMM')) || date_format(d, ' d, yyyy')"},
    "duckdb": {"shift": "date '2024-01-15' + (cast(event_id % 41 as int) - 20)", "long": "strftime(d, '%d %B %Y')", "short": "strftime(d, '%B %-d, %Y')", "iso": "strftime(d, '%Y-%m-%d')", "slash": "strftime(d, '%d/%m/%Y')", "end": "strftime(d + (cast(event_id % 40 as int) - 2), '%Y-%m-%d')", "upper": "upper(strftime(d, '%B')) || strftime(d, ' %-d, %Y')"},
}


def _pool(k: int, values: list[str]) -> str:
    whens = " ".join(f"when {i} then '{v}'" for i, v in enumerate(values[:-1]))
    return f"case event_id % {k} {whens} else '{values[-1]}' end"


TOPICS = ["Cloud Security", "Cooking", "OWASP", "social diamond", "Zero Trust", "Malware", "Garden"]
FORMATS = ["Meetup", "Conference", "Notes", "Workshop", "Webinar"]
CITIES = ["Pune", "New Delhi", "Bangalore", "Indianapolis", "London", "Gurgaon", "Mysore", "Goa", "Kerala", "the United States of America", "our goal India"]
MODES = ["in hall 3", "online and in-person", "join on zoom"]
PRICES = ["INR 1,500", "24 speakers 12 talks", "Free event", "500 USD"]
HOSTS = ["www.owasp.org", "www.meetup.com", "lu.ma", "www.eventbrite.com", "chapter.owasp.org", "notowasp.org", "owasp.org:443", "null.community", "github.com", "example.com", "www.meetup.com", "lu.ma", "www.eventbrite.com"]
PATHS = ["/g/events/12345", "/pro/x", "/e/talk-1", "/events/", "/research", "/discover"]
TIMES = ["10:30 AM", "at 7 pm", "18:45", "soon"]
NOISE = ["Register now for tickets", "freedom scale", "RSVP by mail", "plain words"]


def corpus_sql(dialect: str, events: str = "events") -> str:
    d = DIALECTS[dialect]
    return f"""
select b.*, title || ' | ' || d_text || ' | Venue: Hall ' || cast(event_id % 9 as varchar(9)) || ' ' || city || ' | ' || clock || ' | Hosted by Guild ' || cast(event_id % 17 as varchar(9)) || ' | ' || price || ' | ' || mode || ' | ' || noise as text,
  case when event_id % 19 = 0 then 'n/a' when event_id % 23 = 0 then '' else noise || ' about ' || topic || ' with speakers, venue and date in ' || city || case when event_id % 2 = 0 then ' for everyone who wants to learn and to share what they know about the field' else '' end end as snippet,
  'https://' || host || path || case when event_id % 4 = 0 then '#top' when event_id % 4 = 1 then '/' when event_id % 4 = 2 then '?b=' || cast(event_id % 3 as varchar(9)) else '' end as url,
  '{{"@type":"' || case when event_id % 5 = 0 then 'WebPage' else 'Event' end || '","name":"' || title || '","startDate":"' || iso || 'T09:30","endDate":"' || d_end || '","location":{{"name":"Hall ' || cast(event_id % 9 as varchar(9)) || '","address":{{"addressLocality":"' || city || '","addressCountry":"India"}}}},"offers":{{"price":"' || cast(event_id % 700 as varchar(9)) || '","priceCurrency":"INR"}},"organizer":{{"name":"Guild"}}}}' as jsonld
from (select *, topic || ' ' || format || ' ' || city as title,
    case cast(floor(event_id / 3) as bigint) % 7 when 0 then {d["long"]} when 1 then 'Starts on ' || {d["short"]} when 2 then {d["iso"]} || 'T10:00' when 3 then {d["slash"]} when 4 then {d["upper"]} when 5 then '2026-02-30' else 'date: ' || {d["long"]} || ' and ' || {d["short"]} end as d_text,
    {d["iso"]} as iso, {d["long"]} as d_long, {d["end"]} as d_end,
    case when event_id % 5 = 4 then '/pages/' || cast(cast(floor(event_id / 5) as bigint) as varchar(19)) else path_pool end as path
  from (select event_id, {d["shift"]} as d, cast(event_id % 5 as int) as query_id,
      {_pool(7, TOPICS)} as topic, {_pool(5, FORMATS)} as format, {_pool(11, CITIES)} as city, {_pool(3, MODES)} as mode, {_pool(4, PRICES)} as price,
      {_pool(13, HOSTS)} as host, {_pool(6, PATHS)} as path_pool, {_pool(4, TIMES)} as clock, {_pool(4, NOISE)} as noise
    from {events}) a) b"""


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, title, text, snippet, url, jsonld and their ingredients."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id").repartition(spark.sparkContext.defaultParallelism)  # one small file, costly rows
    name = "eventloom_events"
    events.createOrReplaceTempView(name)
    return spark.sql(corpus_sql("spark", name).replace("varchar(9)", "string").replace("varchar(19)", "string"))
