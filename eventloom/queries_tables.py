"""Queries that join texts and hosts to tables of terms and of domains, with DuckDB SQL that cuts texts up instead."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions import html as H
from eventloom.functions import urls as U
from eventloom.functions.jsonld import typed_objects
from eventloom.functions.sql import register
from eventloom.operators import lexicon_join as J
from eventloom.operators.suffix_join import suffix_join

TERMS = 50_000
#: Words of the lists' kind that the documents do hold, in the order in which they would be preferred.
PLACES = ["der", "la", "the", "of", "and", "under", "tion", "ation", "que", "schaft"]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def _lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the documents, between single spaces, of five characters or more: the first of them by their text."""
    words = _documents(spark, sf_dir).select(F.explode(F.split("text", " ")).alias("term")).where((F.length("term") >= 5) & ~F.col("term").rlike(r"\s")).distinct()
    return words.orderBy("term").limit(TERMS).withColumn("pos", F.length("term"))


def lexicon_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence of 50,000 terms between spaces: how often and where first, by document and term."""
    found = J.occurrences(_documents(spark, sf_dir), "doc_id", "text", _lexicon(spark, sf_dir), stand=J.SPACES)
    return found.groupBy("doc_id", "term").agg(F.count("*").alias("n"), F.min("at").cast("long").alias("first_at"), F.sum("at").alias("sum_at"))


WORDS_SQL = r"""
with cut as (select doc_id, regexp_split_to_array(text, '[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]') as words from documents where text is not null),
spread as (select doc_id, unnest(words) as word, unnest(range(len(words))) as i, words from cut),
placed as (select doc_id, word, cast(sum(length(word) + 1) over (partition by doc_id order by i) - length(word) - 1 as bigint) as place from spread),
lexicon as (select term, length(term) as pos from (select distinct unnest(string_split(text, ' ')) as term from documents) where length(term) >= 5 and not regexp_matches(term, '\s') order by term limit 50000)
"""


def lexicon_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document the term that a list prefers, by its order and by its length, anywhere in the text."""
    terms = spark.createDataFrame([(t, i) for i, t in enumerate(PLACES)], "term string, pos int")
    rows, listed = J.with_occurrences(_documents(spark, sf_dir), "text", terms)
    names = F.array(*[F.lit(t) for t in listed])
    pick = lambda n: F.coalesce(F.get(names, n), F.lit(""))
    return rows.select("doc_id", pick(J.first_by_order("found")).alias("first"), pick(J.longest("found")).alias("longest"), F.size("found").cast("long").alias("n"))


def _longest_sql() -> str:
    first = "case " + " ".join(f"when contains(text, '{t}') then '{t}'" for t in PLACES) + " else '' end"
    by_length = "case " + " ".join(f"when contains(text, '{t}') then '{t}'" for t in sorted(PLACES, key=lambda t: (-len(t), PLACES.index(t)))) + " else '' end"
    count = " + ".join(f"(length(text) - length(replace(text, '{t}', ''))) // {len(t)}" for t in PLACES)
    return f"select doc_id, {first} as first, {by_length} as longest, cast({count} as bigint) as n from (select doc_id, coalesce(text, '') as text from documents)"


def _domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains with scores: of every order line one that no page has, and of the pages' hosts what is left of the first dot
    and, of some, the host itself."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.concat_ws("-", F.lit("shop"), "l_orderkey", "l_linenumber").alias("name"))
    hosts = _hosts(spark, sf_dir).select("host").distinct()
    parents = hosts.select(F.regexp_replace("host", r"^[^.]*\.", "").alias("domain"))
    own = hosts.where(F.length("host") % 3 == 0).select(F.col("host").alias("domain"))
    return lines.select(F.concat("name", F.lit(".example.com")).alias("domain")).unionByName(parents).unionByName(own).distinct().withColumn("score", F.length("domain"))


def _hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", U.domain(F.col("url")).alias("host"))


def domain_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the longest listed domain that their host belongs to, and its score."""
    joined = suffix_join(_hosts(spark, sf_dir), F.col("host"), _domains(spark, sf_dir), order="score")
    return joined.select("page_id", F.coalesce("domain", F.lit("")).alias("domain"), F.coalesce("score", F.lit(5)).alias("score"))


DOMAIN_SQL = r"""
with hosts as (select page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '^www\.', '') as host from pages),
domains as (
  select domain, length(domain) as score from (
    select 'shop-' || l_orderkey || '-' || l_linenumber || '.example.com' as domain from lineitem
    union select regexp_replace(host, '^[^.]*\.', '') from hosts union select host from hosts where length(host) % 3 = 0)
), ends as (
  select page_id, i, array_to_string(list_slice(parts, i, len(parts)), '.') as ending
  from (select page_id, parts, unnest(range(1, len(parts) + 1)) as i from (select page_id, string_split(host, '.') as parts from hosts))
), best as (select page_id, arg_min(domain, i) as domain, arg_min(score, i) as score from ends join domains on ending = domain group by page_id)
select page_id, coalesce(domain, '') as domain, cast(coalesce(score, 5) as int) as score from hosts left join best using (page_id)
"""

# JSON-LD in shapes that nest: objects in lists in objects, a graph beside members, lists of types, broken text.
SHAPES = [
    '{"@type":"Thing","n":"#a","sub":{"@type":"Place","n":"#b","deep":[{"x":1},{"@type":"Event","n":"#c"}]},"list":[[{"@type":"T","n":"#d"}]]}',
    '{"@graph":[{"@type":"WebPage","n":"#a"},{"@type":["X","MusicEvent"],"n":"#b","in":{"@type":"Event","n":"#c"}}],"@type":"Root","n":"#d","m":{"@type":"Y","n":"#e"}}',
    '[{"n":"#no type","in":{"@type":"Z","n":"#a"}},{"@type":"business event","n":"#b"},7,{"@type":"Event","n":"#c"}]',
    '{"@type":"Event","n":"#a"',
    '{"@type":"Eventful","n":"#a","list":[{"@type":[],"n":"#b"},{"@type":null,"n":"#c"}]}',
]


def _shaped() -> str:
    whens = " ".join(f"when {i} then '{x}'" for i, x in enumerate(SHAPES))
    return f"select event_id, replace(case event_id % {len(SHAPES)} {whens} end, '#', cast(event_id as varchar(19))) as j from events"


def jsonld_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed objects of nested JSON-LD in order, and the first event among them, as a page's script holds it."""
    spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id").createOrReplaceTempView("eventloom_shapes")
    rows = spark.sql(_shaped().replace("varchar(19)", "string").replace("from events", "from eventloom_shapes"))
    page = H.parse_html(F.concat(F.lit('<p>x</p><script type="application/ld+json">'), "j", F.lit("</script>")))
    names = F.array_join(F.transform(typed_objects("j"), lambda m: m["n"]), ",")
    return rows.withColumn("page", page).select("event_id", F.coalesce(names, F.lit("broken")).alias("names"), F.coalesce(F.get_json_object(F.get("page.objects", F.lit(0)), "$.n"), F.lit("")).alias("event"))


JSONLD_SQL = f"""
with shaped as ({_shaped()}), tree as (
  select event_id, t.id, t.fullkey, t.value from shaped, json_tree(case when json_valid(j) then j else '[]' end) as t where t.type = 'OBJECT'
), typed as (
  select event_id, row_number() over (partition by event_id order by case when contains(fullkey, '@graph') then 0 else 1 end, id) as place,
    json_extract_string(value, '$.n') as n, lower(cast(json_extract(value, '$."@type"') as varchar)) as kind
  from tree where list_contains(json_keys(value), '@type')
)
select event_id, case when json_valid(any_value(j)) then coalesce(string_agg(n, ',' order by place), '') else 'broken' end as names,
  coalesce(arg_min(n, place) filter (where regexp_matches(kind, 'event"')), '') as event
from shaped left join typed using (event_id) group by event_id
"""


def sql_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of pages by SQL alone: a table function beside each row."""
    register(spark)
    spark.read.parquet(f"{sf_dir}/pages.parquet").createOrReplaceTempView("eventloom_pages")
    return spark.sql("select p.page_id, l.pos, l.href, absolute_url(p.url, l.href) = l.url as same, plain_text(l.label) as label from eventloom_pages p, lateral extract_links(p.html, p.url) l")


LINKS_SQL = r"""
with m as (select page_id, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') as found from pages),
a as (select page_id, unnest(found) as a, unnest(range(len(found))) as pos from m)
select page_id, cast(pos as int) as pos, regexp_extract(a, '"([^"]*)"', 1) as href, true as same, regexp_extract(a, '>([^<]*)<', 1) as label from a
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"lexicon_terms": lexicon_terms, "lexicon_longest": lexicon_longest, "domain_trust": domain_trust, "jsonld_nested": jsonld_nested, "sql_links": sql_links}
SQL: dict[str, str] = {
    "lexicon_terms": WORDS_SQL + "select doc_id, term, count(*) as n, min(place) as first_at, cast(sum(place) as bigint) as sum_at from placed join lexicon on word = term group by doc_id, term",
    "lexicon_longest": _longest_sql(),
    "domain_trust": DOMAIN_SQL,
    "jsonld_nested": JSONLD_SQL,
    "sql_links": LINKS_SQL,
}
