"""Ranked lexical search over an index in shards, documents at a time.

Build: a task cuts its share of the documents into shards of about ``SHARD_BYTES`` of text, a row each. In a shard the
documents with terms are numbered in the order of their ids, and every term has its list of (gap of numbers, occurrences)
as variable-length integers. No row leaves its task, so building does not shuffle.

Search: document frequencies and totals are sums over shards. Then each shard merges the lists of all the terms that a
block of items asks for with one heap, so it meets each document once, with all its asked terms; their contributions times
the items' repeats score that document for the block. Every item keeps a bounded heap keyed by score, then by document
id. The shards' lists of an item are merged as a tree.

Defined cases: null texts have no terms, and rows without terms count nowhere; documents with a null id do count and come
last among equal scores; repeated rows are documents of their own; items are distinct rows of id and text, those without
terms find nothing; an empty table on either side gives no rows; other columns are passed over, whatever their names. A
document over ``SHARD_BYTES`` is a shard by itself.
"""

from __future__ import annotations

import heapq
import math
from array import array
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, durable, table

SHARD_BYTES = 16_000_000
ITEM_BYTES = 4_000_000  # of the items' texts that go to every shard at once; more items take more passes
BLOCK = 256  # items that a shard scores together
FAN = 16
#: Bytes of terms as they stand, A to Z lower-cased; every other byte is a gap. Beyond ASCII, all characters are of terms.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
INDEX = "shard long, n_docs long, n_terms long, n_null long, doc_ids binary, lengths binary, terms binary, dfs binary, ends binary, postings binary"
KINDS = [pa.int64()] * 4 + [pa.binary()] * 6
NAMES = [x.split()[0] for x in INDEX.split(", ")]


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(LETTERS).split()


def pack(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Variable-length integers, seven bits a byte, the last one below 128; and where each ends."""
    size = np.ones(len(values), np.int64)
    for b in range(1, 9):
        size += values >> 7 * b > 0
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for b in range(int(size.max(initial=0))):
        has = np.flatnonzero(size > b)
        out[ends[has] - size[has] + b] = (values[has] >> 7 * b & 127) | ((size[has] > b + 1) << 7)
    return out.tobytes(), ends


def unpack(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.int64)
    b = np.frombuffer(raw, np.uint8).astype(np.int64)
    last = b < 128
    begins = np.concatenate(([0], np.flatnonzero(last)[:-1] + 1))
    place = np.arange(len(b)) - np.repeat(begins, np.diff(np.append(begins, len(b))))
    return np.add.reduceat((b & 127) << 7 * place, begins)


class _Numbers(dict):
    def __missing__(self, term: bytes) -> int:
        out = self[term] = len(self)
        return out


def shard_row(shard: int, docs: list[tuple[int | None, array]], numbers: dict[bytes, int]) -> tuple:
    """The index row of documents, given as ids and the numbers of their terms."""
    docs.sort(key=lambda d: (d[0] is None, d[0] or 0))
    lengths = np.array([len(t) for _, t in docs], np.int64)
    at = np.repeat(np.arange(len(docs)), lengths)
    each = np.frombuffer(b"".join([t.tobytes() for _, t in docs]), np.uint32).astype(np.int64)
    keys, tf = np.unique(each << 32 | at, return_counts=True)
    term, number = keys >> 32, keys & 0xFFFFFFFF
    first = np.r_[True, term[1:] != term[:-1]]
    gaps = np.where(first, number, np.diff(number, prepend=0))
    raw, ends = pack(np.stack([gaps, tf], 1).ravel())
    last = np.flatnonzero(np.r_[first[1:], True])
    dfs = np.diff(last, prepend=-1)
    nulls = sum(k is None for k, _ in docs)
    ids = np.array([k or 0 for k, _ in docs], "<i8")
    return shard, len(docs), int(lengths.sum()), nulls, ids.tobytes(), lengths.astype("<u4").tobytes(), b"\n".join(numbers), dfs.astype("<u4").tobytes(), ends[2 * last + 1].astype("<u4").tobytes(), raw


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row a shard, of all documents with terms and all their terms."""
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))

    def run(batches):
        shard = TaskContext.get().partitionId() << 32
        numbers, held, size = _Numbers(), [], 0

        def sent():
            row = shard_row(shard, held, numbers)
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, KINDS, strict=True)], names=NAMES)

        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                terms = terms_of(t.as_py())
                if terms:
                    held.append((k, array("I", map(numbers.__getitem__, terms))))
                size += sum(map(len, terms))
                if size >= shard_bytes:
                    yield sent()
                    numbers, held, size, shard = _Numbers(), [], 0, shard + 1
        if held:
            yield sent()

    return bounded(rows).mapInArrow(run, INDEX)


class Asked:
    """Items as numbered terms with their repeats; weights come once document frequencies are known."""

    def __init__(self, texts: list[str]):
        self.numbers = _Numbers()
        self.items = [np.unique([self.numbers[t] for t in terms_of(x)], return_counts=True) for x in texts]
        self.weights = np.zeros(len(self.numbers), np.int64)
        self.n = self.total = 0

    def weigh(self, n: int, total: int, dfs: dict[int, int]) -> None:
        self.n, self.total = n, total
        for i, df in dfs.items():
            self.weights[i] = math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def best_of_shard(row: dict, asked: Asked, k: int) -> list[tuple[int, int, int]]:
    """(item, number of the document in the shard, score) of the k best documents of the shard for each item."""
    places = {asked.numbers[t]: i for i, t in enumerate(row["terms"].split(b"\n")) if t in asked.numbers}
    ends = np.frombuffer(row["ends"], "<u4").astype(np.int64)
    lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
    m = 100 - 25 + (25 * lengths * asked.n) // asked.total
    out = []
    for begin in range(0, len(asked.items), BLOCK):
        block = asked.items[begin : begin + BLOCK]
        terms = sorted({t for ts, _ in block for t in ts.tolist() if t in places and asked.weights[t] > 0})
        if not terms:
            continue
        local = {t: j for j, t in enumerate(terms)}
        repeats = np.zeros((len(terms), len(block)), np.int64)
        for i, (ts, times) in enumerate(block):
            for t, c in zip(ts.tolist(), times.tolist(), strict=True):
                if t in local:
                    repeats[local[t], i] = c
        lists, owners, gains, size = [], [], [], 0
        for j, t in enumerate(terms):
            p = places[t]
            values = unpack(row["postings"][ends[p - 1] if p else 0 : ends[p]])
            number, tf = np.cumsum(values[::2]), values[1::2]
            lists.append((number << 32 | np.arange(size, size + len(number))).tolist())
            owners.append(np.full(len(number), j))
            gains.append(asked.weights[t] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[number])))
            size += len(number)
        owner, gain = np.concatenate(owners), np.concatenate(gains)
        heaps: list[list[tuple[int, int]]] = [[] for _ in block]
        least = np.zeros(len(block), np.int64)  # what a document must exceed: among equals the earlier one stays
        for number, met in groupby(heapq.merge(*lists), lambda x: x >> 32):
            at = [x & 0xFFFFFFFF for x in met]
            scores = gain[at] @ repeats[owner[at]]
            for i in np.flatnonzero(scores > least).tolist():
                heap, entry = heaps[i], (int(scores[i]), -number)
                if len(heap) < k:
                    heapq.heappush(heap, entry)
                else:
                    heapq.heappushpop(heap, entry)
                if len(heap) == k:
                    least[i] = heap[0][0]
        out += [(begin + i, -number, score) for i, heap in enumerate(heaps) for score, number in heap]
    return out


def search(index: DataFrame, items: DataFrame, k: int, item: str = "item_id", text: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """item, rank, doc_id, score of the k best documents of each item."""
    spark = index.sparkSession
    rows = items.select(F.col(item).alias("item"), F.coalesce(text, F.lit("")).alias("text")).distinct()
    shards, n, total = index.agg(F.count("*"), F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    passes = max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // item_bytes))
    found = []
    for i in range(passes):
        some = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == i).collect()
        asked = Asked([r.text for r in some])
        asked.weigh(n, total, document_frequencies(index, asked))
        names = spark.createDataFrame([(j, r.item) for j, r in enumerate(some)], rows.select(F.lit(0).alias("asked"), "item").schema)
        found.append(merged(scored(index, asked, k), shards, k).join(F.broadcast(names), "asked").select(F.col("item").alias(item), "rank", "doc_id", "score"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def document_frequencies(index: DataFrame, asked: Asked) -> dict[int, int]:
    """Documents that hold each asked term, of all shards; at most an entry a term of the items."""
    numbers = dict(asked.numbers)

    def run(batches):
        for batch in batches:
            for terms, dfs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held = np.frombuffer(dfs, "<u4")
                found = [(numbers[t], i) for i, t in enumerate(terms.split(b"\n")) if t in numbers]
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([int(held[i]) for _, i in found], pa.int64())], names=["term", "df"])

    return dict(map(tuple, bounded(index.select("terms", "dfs")).mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df")).collect()))


def scored(index: DataFrame, asked: Asked, k: int) -> DataFrame:
    """The k best of each shard for each asked item: asked, shard, doc_id, score."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["doc_ids"], "<i8").tolist()
                known = len(ids) - row["n_null"]
                out = [(i, row["shard"], ids[x] if x < known else None, s) for i, x, s in best_of_shard(row, asked, k)]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], pa.int64()) for j in range(4)], names=["asked", "shard", "doc_id", "score"])

    return bounded(index.drop("dfs")).mapInArrow(run, "asked long, shard long, doc_id long, score long")


def merged(lists: DataFrame, shards: int, k: int) -> DataFrame:
    """asked, rank, doc_id, score: lists of shards merged FAN at a time, in as many levels as that takes."""
    order: list[Column | str] = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    groups = max(1, shards)
    lists = lists.withColumn("node", F.pmod(F.xxhash64("shard"), F.lit(groups))).drop("shard")
    while True:
        groups = -(-groups // FAN)
        best = Window.partitionBy("asked", "node").orderBy(*order)
        lists = lists.withColumn("node", F.floor(F.col("node") / FAN)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        if groups <= 1:
            return lists.select("asked", "rank", "doc_id", "score")
        lists = lists.drop("rank")


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = durable(build_index(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return search(index, table(spark, sf_dir, "benchmark"), 20)


OP13_SQL = r"""
with d as (
  select row_number() over () as row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents where text is not null
), held as (select row, doc_id, len(terms) as n, terms from d where len(terms) > 0),
totals as (select count(*) as docs, cast(sum(n) as bigint) as total from held),
tf as (select row, term, count(*) as tf from (select row, unnest(terms) as term from held) group by row, term),
weights as (
  select term, cast(floor(1000 * ln((2 * any_value(docs) + 2) / cast(2 * count(*) + 1 as double))) as bigint) as w
  from tf, totals group by term
), asked as (
  select item_id, term, count(*) as times from (
    select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from benchmark where text is not null
  ) group by item_id, term
), scores as (
  select item_id, doc_id, row, cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // total)))) as bigint) as score
  from asked join weights using (term) join tf using (term) join held using (row), totals
  group by item_id, doc_id, row
), ranked as (select *, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank from scores where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 20
"""
