"""Benchmark decontamination, with DataFrame functions only.

A document leaks an item if it holds at least 80 % of the item's distinct five-word shingles. Items are partitioned by
size; each partition signs its items with a number of minima of its own: the least hashes of the item, one more than a
leaking document of the partition may lack. So a document that leaks an item holds one of its minima, however long the
document is, and the search finds every pair. Documents meet the signatures alone: a bitmap of fixed size, which every
document's shingles are probed in, leaves the documents that can hold a minimum, and a join of those hits with the
signatures gives the candidate pairs. Candidates are verified by exact shingle containment, counted over the shingles of
the documents that are left. Shingles are compared by 64-bit hashes.

Signatures and the index of items are broadcast only while they have at most ``BROADCAST_ROWS`` rows, which is counted;
larger ones are joined by a shuffle on the hash, both sides of which adaptive execution can split.

Defined cases: words are runs of letters and digits in lower case; null and empty texts and items have no shingles and
match nothing, nor do items of under five words in op8_leaks, as its SQL has it; the pipeline searches for those too, as
one shingle of their own length; repeated items count once, items that share an id or have none but differ in text count
each; repeated rows give one leak; rows keep null ids.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, row_key, table

BROADCAST_ROWS = 500_000
BITS = 22  # a bitmap of 2**22 bits, of which two places are probed for a shingle


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def short_lengths(items: DataFrame, k: int = 5, text: str = "text") -> dict[int, int]:
    """How many items have so few words that they have no k-word shingle, by their number of words from 1 to k - 1."""
    counts = items.select(F.size(words_of(F.col(text))).alias("n")).where((F.col("n") > 0) & (F.col("n") < k)).groupBy("n").count().collect()
    return {r["n"]: r["count"] for r in counts}


def shingle_hashes(text: Column, k: int) -> Column:
    """Distinct hashes of the k-word shingles of a text."""
    words = words_of(text)
    each = lambda ws: F.when(F.size(ws) < k, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(ws) - (k - 1)), lambda i: F.xxhash64(F.slice(ws, i, k))))
    return F.array_distinct(F.get(F.transform(F.array(words), each), F.lit(0)))


def signed_items(items: DataFrame, k: int, num: int, den: int, key: str, text: str, short: bool) -> DataFrame:
    """One row an item: no, item, n, hs (its shingles, least first), minima (how many of them sign it). With ``short``,
    the words of an item of under k words are one shingle."""
    hs, words = shingle_hashes(F.col(text), k), words_of(F.col(text))
    if short:
        hs = F.when((F.size(words) > 0) & (F.size(words) < k), F.array(F.xxhash64(words))).otherwise(hs)
    sized = items.select(F.col(key).alias("item"), F.sort_array(hs).alias("hs")).distinct().withColumn("n", F.size("hs")).where("n > 0")
    widest = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin("n"))) - 1  # of the partition: sizes up to a power of two
    lacking = widest - F.ceil(widest * num / den)
    return durable(sized.withColumn("minima", F.least(F.col("n"), lacking + 1).cast("int")).withColumn("no", F.monotonically_increasing_id()))


def _places(h: Column) -> list[Column]:
    """The two bits of a hash."""
    return [F.shiftrightunsigned(h, 64 - BITS).cast("int"), (F.shiftrightunsigned(h, 64 - 2 * BITS) % (1 << BITS)).cast("int")]


def bitmap(hashes: DataFrame) -> Column:
    """A literal of 2**BITS bits as longs: those of all ``h``. Its words are or-ed on the cluster; at most 2**(BITS - 6)
    of them reach the driver."""
    bits = hashes.select(F.explode(F.array(*_places(F.col("h")))).alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit") % 64)).alias("bits"))
    words = [0] * (1 << BITS - 6)
    for r in bits.collect():
        words[r.word] = r.bits
    return F.from_json(F.lit(json.dumps(words, separators=(",", ":"))), "array<bigint>")


def _small(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def find_leaks(docs: DataFrame, items: DataFrame, k: int = 5, num: int = 80, den: int = 100, doc_key: str = "doc_id", doc_text: str = "text", item_key: str = "item_id", item_text: str = "text", short: bool = False) -> DataFrame:
    """doc_id, row (the row_key of id and text), item_id, n_shared, n_shingles of every leak; a repeated row gives one.
    With ``short``, items of under k words are found where their words stand together."""
    lengths = [k, *sorted(short_lengths(items, k, item_text))] if short else [k]
    signed = signed_items(items, k, num, den, item_key, item_text, short)
    signatures = signed.select("no", F.explode(F.slice("hs", 1, F.col("minima"))).alias("h"))
    bits = bitmap(signatures)
    hit = lambda h: _bit(bits, _places(h)[0]) & _bit(bits, _places(h)[1])
    # The number keeps the filter above the shingles: below it, they would be hashed twice.
    hashes = F.flatten(F.array(*[shingle_hashes(F.col(doc_text), n) for n in lengths])) if len(lengths) > 1 else shingle_hashes(F.col(doc_text), k)
    read = docs.select(F.col(doc_key).alias("doc_id"), row_key(doc_key, doc_text).alias("row"), F.monotonically_increasing_id().alias("place"), hashes.alias("hs"))
    left = durable(read.where(F.exists("hs", hit)))
    hits = left.select("place", F.explode(F.filter("hs", hit)).alias("h"))
    candidates = durable(hits.join(_small(signatures), "h").select("place", "no").distinct())
    index = _small(signed.select("no", F.explode("hs").alias("h")))
    held = left.join(candidates.select("place").distinct(), "place", "left_semi").select("place", F.explode("hs").alias("h"))
    shared = held.join(index, "h").join(candidates, ["place", "no"], "left_semi").groupBy("place", "no").agg(F.count("*").alias("shared"))
    leaks = shared.join(signed.select("no", "item", "n"), "no").where(F.col("shared") * den >= F.col("n") * num)
    return leaks.join(left.select("place", "doc_id", "row"), "place").select("doc_id", "row", F.col("item").alias("item_id"), F.col("shared").alias("n_shared"), F.col("n").cast("long").alias("n_shingles")).distinct()


def _bit(bits: Column, place: Column) -> Column:
    return F.call_function("bit_get", F.get(bits, F.shiftright(place, 6)), place % 64) == 1


def op8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, n_shared, n_shingles, containment of every leak."""
    found = find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shared", "n_shingles", (F.col("n_shared") / F.col("n_shingles")).alias("containment")).distinct()


OP8_SQL = r"""
with dw as (select row_number() over () as place, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') as ws from documents),
iw as (select item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') as ws from benchmark),
ds as (select place, doc_id, unnest(list_distinct(list_transform(range(1, len(ws) - 3), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] || ' ' || ws[i + 4]))) as x from dw where len(ws) >= 5),
ia as (select distinct item_id, list_sort(list_distinct(list_transform(range(1, len(ws) - 3), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] || ' ' || ws[i + 4]))) as s from iw where len(ws) >= 5),
it as (select no, item_id, len(s) as n, unnest(s) as x from (select row_number() over () as no, * from ia)),
c as (select place, doc_id, no, item_id, n, count(*) as shared from ds join it using (x) group by place, doc_id, no, item_id, n)
select distinct doc_id, item_id, shared as n_shared, cast(n as bigint) as n_shingles, shared / cast(n as double) as containment from c where shared * 100 >= n * 80
"""
