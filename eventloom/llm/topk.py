"""Exact top-k search: tiled matrix products of query tiles and candidate shards, partial selection in each tile, and
a tree merge of the per-query lists.

Queries are cut into tiles and candidates into shards of fixed row counts, by a hash of the id. Each (shard, tile) cell
is one matrix product, so a task's memory does not grow with either table. A cell keeps its best k a query, and a tree
merges these lists: at each level up to ``FAN`` neighbouring lists of a query become one of k, until one is left. Exact
search needs every cell, so a vector is copied to each tile or shard of the other side: rows x tiles and queries x shards.

Defined cases: null ids and vectors that are null or hold null or non-finite components take no part; vectors meet only
those of their own length; rows that share an id count as one whose best score holds, and never meet their own query;
sums are exact, and one beyond 64 bits is held at the nearest long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

TILE_ROWS, SHARD_ROWS = 1024, 16_384
FAN = 32  # lists that a node of the merge tree puts together
STEP = 256  # query rows of one product: 256 x 16,384 doubles are 32 MB


def _matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids in ascending order and their vectors, as doubles floored to whole numbers."""
    ids = t.column("vec_id").to_numpy()
    flat = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    order = np.argsort(ids, kind="stable")
    return ids[order], np.floor(flat.reshape(len(ids), -1) * 256.0)[order]


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact whole inner products: in doubles while every sum fits 53 bits, else in Python's integers."""
    largest = (np.abs(a).max(initial=0) * np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if largest < 2**53:
        return (a @ b.T).astype(np.int64)
    big = np.array([[int(x) for x in r] for r in a], dtype=object).reshape(a.shape) @ np.array([[int(x) for x in r] for r in b], dtype=object).reshape(b.shape).T
    return np.array([[max(-(2**63), min(2**63 - 1, x)) for x in r] for r in big], dtype=np.int64)


def _merged(ids: np.ndarray, scores: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
    """Best score over rows or columns that share an id; ids are sorted."""
    first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    return (ids, scores) if len(first) == len(ids) else (ids[first], np.maximum.reduceat(scores, first, axis=axis))


def best_of_cell(queries: pa.Table, shard: pa.Table, k: int) -> list[tuple[int, int, int]]:
    """(query_id, vec_id, score) of the k best of the shard for each query of the tile."""
    out: list[tuple[int, int, int]] = []
    qids, qs = _matrix(queries)
    cids, cs = _matrix(shard)
    at = 0
    while at < len(qids):
        to = min(len(qids), at + STEP)
        while to < len(qids) and qids[to] == qids[to - 1]:
            to += 1
        part, scores = _merged(qids[at:to], _product(qs[at:to], cs), 0)
        ids, scores = _merged(cids, scores, 1)
        own = np.searchsorted(ids, part)
        has = (own < len(ids)) & (ids[np.minimum(own, len(ids) - 1)] == part)
        take = np.ones(scores.shape, dtype=bool)
        take[np.flatnonzero(has), own[has]] = False
        low = np.where(take, scores, np.iinfo(np.int64).min)
        if len(ids) > k + 1:
            take &= low >= np.partition(low, len(ids) - k, axis=1)[:, len(ids) - k, None]
        rows, cols = np.nonzero(take)
        order = np.lexsort((ids[cols], -scores[rows, cols].astype(np.float64), rows)) if np.abs(scores).max(initial=0) < 2**53 else np.array(sorted(range(len(rows)), key=lambda i: (rows[i], -int(scores[rows[i], cols[i]]), int(ids[cols[i]]))), dtype=int)
        rows, cols = rows[order], cols[order]
        begin = np.searchsorted(rows, rows)
        keep = np.arange(len(rows)) - begin < k
        out += zip(part[rows[keep]].tolist(), ids[cols[keep]].tolist(), scores[rows[keep], cols[keep]].tolist(), strict=True)
        at = to
    return out


def exact_top_k(vectors: DataFrame, is_query, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", tile_rows: int = TILE_ROWS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of the k best of all other rows for the rows where ``is_query`` holds."""
    fine = F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(fine).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(embedding, lambda x: x.cast("double")).alias("v"), F.size(embedding).alias("dim"), F.coalesce(is_query, F.lit(False)).alias("q"))
    n, q = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("q").cast("long")), F.lit(0))).first()
    shards, tiles = max(1, -(-n // shard_rows)), max(1, -(-q // tile_rows))
    kept = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards))).withColumn("tile", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(tiles)))
    all_of = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    left = kept.where("q").select("dim", all_of(shards).alias("shard"), "tile", "vec_id", "v").groupBy("dim", "shard", "tile")
    # Fresh names: columns that both sides shared would be pruned from this one.
    right = kept.select(F.col("dim").alias("dim"), F.col("shard").alias("shard"), all_of(tiles).alias("tile"), F.col("vec_id").alias("vec_id"), F.col("v").alias("v")).groupBy("dim", "shard", "tile")

    def cell(queries: pa.Table, shard: pa.Table) -> pa.Table:
        out = best_of_cell(queries, shard, k) if queries.num_rows and shard.num_rows else []
        node = shard.column("shard")[0].as_py() if shard.num_rows else 0
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score", "node"), (*cols, [node] * len(out)), strict=True)})

    lists, nodes = left.cogroup(right).applyInArrow(cell, "query_id long, vec_id long, score long, node long"), shards
    best = Window.partitionBy("query_id", "node").orderBy(F.desc("score"), "vec_id")
    while True:
        nodes = -(-nodes // FAN)
        merged = lists.withColumn("node", F.floor(F.col("node") / FAN)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        if nodes <= 1:
            return merged.select("query_id", "rank", "vec_id", "score")
        lists = merged.drop("rank")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


OP4_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.e, c.e) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id and q.vec_id % 50 = 0
), r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""
