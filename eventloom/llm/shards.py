"""Sharding by a k-d tree, with DataFrame functions only.

Starting from all rows, a node that is to hold s shards is split at the weighted median (more exactly, at the share
floor(s/2)/s of its bytes) along the metadata dimension in which it is widest, until every leaf is one shard and so holds
the target bytes. The medians of all nodes of a level are found together: histograms of each node's own dimension are
summed on the cluster and narrowed, so no row moves for a split and only ``nodes x BUCKETS`` sums reach the driver a round.

Rows of equal value at a cut stay together unless that would miss the target by more than ``slack``; then they are cut by
the other dimensions, then by the ties in their order. Put first among the ties, a checksum of the text keeps equal texts
side by side, so a cut parts at most one such group; a group larger than a shard is spread over several.

Defined cases: a null text is empty and has 8 bytes; ties are ordered by doc_id (nulls first), then by row; repeated rows
are placed each; an empty table gives no rows; more shards than rows leaves some empty; columns of the rows that clash
with working names keep their values, as the working names are lengthened.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, free_name, table

BUCKETS = 4096
SLOT_ROWS = 100_000


def _by_node(node: str, values: dict[int, int]) -> Column:
    """A value for each tree node; the tree has fewer than twice as many nodes as shards."""
    pairs = [x for n, v in values.items() for x in (F.lit(n), F.lit(v).cast("bigint"))]
    return F.try_element_at(F.create_map(*pairs), F.col(node)) if pairs else F.lit(None).cast("bigint")


def _narrow(rows: DataFrame, node: str, size: str, key: Column, span: dict[int, tuple[int, int]], aims: dict[int, float]) -> dict[int, tuple[int, float, float]]:
    """For each node, whose keys lie in its span: the least key value v such that rows with key <= v weigh at least the
    aim, the weight below v, and v's own."""
    span, base = dict(span), dict.fromkeys(span, 0.0)
    done: dict[int, tuple[int, float, float]] = {}
    while span:
        step = {n: max(1, -(-(hi - lo + 1) // BUCKETS)) for n, (lo, hi) in span.items()}
        lo, hi, width = _by_node(node, {n: v[0] for n, v in span.items()}), _by_node(node, {n: v[1] for n, v in span.items()}), _by_node(node, step)
        live = rows.where((key >= lo) & (key <= hi))
        sums: dict[int, list] = {}
        for r in live.groupBy(F.col(node).alias("n"), F.call_function("div", key - lo, width).alias("b")).agg(F.sum(size).alias("w")).collect():
            sums.setdefault(r.n, []).append((r.b, float(r.w)))
        for n in list(span):
            total, at = base[n], sorted(sums[n])
            for b, w in at:
                if total + w >= aims[n] or (b, w) == at[-1]:
                    break
                total += w
            begin = span[n][0] + b * step[n]
            base[n] = total
            if step[n] == 1:
                done[n] = (begin, total, w)
                del span[n]
            else:
                span[n] = (begin, min(span[n][1], begin + step[n] - 1))
    return done


def _measured(rows: DataFrame, node: str, size: str, columns: list[str]) -> dict[int, tuple[float, dict[str, tuple[int, int]]]]:
    """Weight of each node and the least and greatest value of each column in it."""
    ends = [f(c).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("lo", F.min), ("hi", F.max))]
    got = rows.groupBy(F.col(node).alias("n")).agg(F.sum(size).alias("w"), *ends).collect()
    return {r.n: (float(r.w), {c: (r[f"lo{i}"], r[f"hi{i}"]) for i, c in enumerate(columns)}) for r in got}


def kd_shards(rows: DataFrame, shards: int, dims: list[str], ties: list[str], slack: float = 0.004, size: str = "size", out: str = "shard") -> DataFrame:
    """Add ``out`` (0 to shards - 1) to rows that have ``size`` and whole ``dims``; nulls of neither.

    ``ties`` are whole numbers that order rows whose dims agree. ``rows`` must be durable: each round reads it again.
    """
    node = free_name(rows, "__node")
    tree = rows.withColumn(node, F.lit(1))
    open_nodes, shard_of, numbers = ({1: (0, shards)}, {}, 2) if shards > 1 else ({}, {1: 0}, 2)
    scale: dict[str, int] = {}
    while open_nodes:
        opened = tree.where(F.col(node).isin(list(open_nodes)))
        stats = _measured(opened, node, size, dims)
        scale = scale or {d: max(1, hi - lo) for d, (lo, hi) in (stats[1][1] if stats else {}).items()}
        child, aims, unit, order = {}, {}, {}, {}
        for n, (first, s) in open_nodes.items():
            child[n] = (numbers, numbers + 1, (first, s // 2), (first + s // 2, s - s // 2))
            numbers += 2
            if n in stats:
                weight, ends = stats[n]
                by_width = sorted(dims, key=lambda d: (ends[d][0] - ends[d][1]) / scale[d])
                aims[n], unit[n], order[n] = weight * (s // 2) / s, weight / s, [*by_width, *ties]
        cuts = _cuts(opened, node, size, stats, aims, unit, order, slack)
        to = F.col(node)
        for n, (a, b, _, _) in child.items():
            to = F.when(F.col(node) == n, F.when(cuts.get(n, F.lit(True)), F.lit(a)).otherwise(F.lit(b))).otherwise(to)
        tree, nxt = tree.withColumn(node, to), {}
        for a, b, one, two in child.values():
            for m, (first, s) in ((a, one), (b, two)):
                if s > 1:
                    nxt[m] = (first, s)
                else:
                    shard_of[m] = first
        open_nodes = nxt
        tree = durable(tree) if open_nodes else tree
    return tree.withColumn(out, F.create_map(*[F.lit(x) for p in shard_of.items() for x in p])[F.col(node)].cast("int")).drop(node)


def _cuts(rows: DataFrame, node: str, size: str, stats: dict, aims: dict[int, float], unit: dict[int, float], order: dict[int, list[str]], slack: float) -> dict[int, Column]:
    """For each node the condition of its left side. Each round cuts all nodes that are still open, each along the next
    column of its own order, among the rows that the columns before could not part."""
    cuts: dict[int, Column] = {}
    path: dict[int, list[tuple[str, int]]] = {n: [] for n in aims}
    aims, depth = dict(aims), 0
    while aims:
        column = {n: order[n][depth] for n in aims}
        key = F.coalesce(*[F.when(F.col(node).isin([n for n in aims if column[n] == c]), F.col(c)) for c in sorted(set(column.values()))])
        if depth:
            fixed = {i: F.coalesce(*[F.when(F.col(node) == n, F.col(path[n][i][0])) for n in aims]) == _by_node(node, {n: path[n][i][1] for n in aims}) for i in range(depth)}
            for same in fixed.values():
                rows = rows.where(same)
            seen = _measured(rows.withColumn("__key", key), node, size, ["__key"])
            span = {n: seen[n][1]["__key"] for n in aims}
        else:
            span = {n: stats[n][1][column[n]] for n in aims}
        left: dict[int, float] = {}
        for n, (v, below, own) in _narrow(rows.where(F.col(node).isin(list(aims))), node, size, key, span, aims).items():
            short, over = aims[n] - below, below + own - aims[n]
            if depth == len(order[n]) - 1 or min(short, over) <= slack * unit[n]:
                at = F.col(column[n])
                cut = at <= F.lit(v) if over <= short else at < F.lit(v)
                for name, value in reversed(path[n]):
                    cut = (F.col(name) < F.lit(value)) | ((F.col(name) == F.lit(value)) & cut)
                cuts[n] = cut
            else:
                path[n].append((column[n], v))
                left[n] = aims[n] - below
        aims, depth = left, depth + 1
    return cuts


def slots(rows: DataFrame, group: str, order: str, out: str = "slot") -> DataFrame:
    """Add ``out``, gapless from 0 in each group. Rows are numbered in runs of about SLOT_ROWS; the runs' counts are
    summed before, so that no task holds a whole group."""
    run, own, before = (free_name(rows, x) for x in ("__run", "__own", "__before"))
    runs = max(1, -(-rows.count() // SLOT_ROWS))
    dealt = rows.withColumn(run, F.pmod(F.xxhash64(order), F.lit(runs)).cast("int"))
    counts = dealt.groupBy(group, run).agg(F.count("*").alias("n"))
    sums = F.sum("n").over(Window.partitionBy(group).orderBy(run).rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.withColumn(before, F.coalesce(sums, F.lit(0))).drop("n")
    placed = dealt.withColumn(own, F.row_number().over(Window.partitionBy(group, run).orderBy(order)) - 1)
    return placed.join(starts, [group, run]).withColumn(out, (F.col(before) + F.col(own)).cast("long")).drop(run, own, before)


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes; dimensions: bytes and words (runs between blanks) of the text."""
    content = F.coalesce(F.col("text"), F.lit(""))
    text = content.cast("binary")
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        (F.length(content) - F.length(F.translate(content, " ", ""))).cast("long").alias("words"),
    )
    rows = durable(docs.withColumn("tie", F.coalesce("doc_id", F.lit(-(2**62)))).withColumn("row", F.monotonically_increasing_id()))
    placed = kd_shards(rows, 24, ["size", "words"], ["text_crc32", "tie", "row"])
    return slots(placed, "shard", "row").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
