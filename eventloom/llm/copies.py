"""N-gram Jaccard join: a size-aware heavy-light join of shingle sets, exact at a rational threshold.

Light sets (few shingles) enumerate all their subsets of the sizes that a partner must share: two light sets that reach
the threshold have such a subset in common, so a hash of it brings them together. Heavy sets go through inverted lists.
An entry is not one shingle but all shingles of a set that fall in one of H + 1 parts of the hash space, H being the
largest difference that the threshold allows at that size: two sets that differ in at most H shingles agree on a whole
part. Lists of such entries stay short where single frequent shingles would list a third of the corpus. The boundary
between light and heavy is the size up to which the subsets cost less than the lists, a list entry counting
``LIST_COST`` times a subset for the scan that it causes.

Entries only bring sets together. Sets that share entries, directly or not, form a cell; each cell joins its sets
exactly, rarest shingles first, and gives the links of a spanning forest: links inside a component that is already
joined add nothing to a class id. A cell that exceeds ``CELL`` shingles is dealt out as blocks x blocks, so no task holds
an unbounded group. Equal sets are one class before all that, so copies meet nowhere as pairs.

Defined cases: null and empty texts have no shingles, no links and their own id; texts under k words have one shingle,
the whole sequence; repeated rows are copies; rows without a doc_id take part, their class id is the least id that is
not null, or null.
"""

from __future__ import annotations

import hashlib
import zlib
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SLICE_BYTES, SLICE_ROWS, arrow_map, bounded, durable, row_key, table
from .components import components

LIST_COST = 4
SPARE = 2  # parts beyond H + 1, so that a set may leave out that many parts of under two shingles
BUCKETS = 1 << 22  # of the document counts of shingles; fixed, so what is sent to the tasks has a fixed size
CELL = 4_000_000
_MIX1, _MIX2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, without a cache that grows with the vocabulary."""
    column = np.empty(len(words), object)
    column[:] = words
    return pd.util.hash_array(column, categorize=False)


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; ASCII letters are lower-cased, ASCII white space parts words."""
    ws = (text or "").encode().lower().split()
    if not ws:
        return np.empty(0, np.uint64)
    h = word_hashes(ws)
    width = min(k, len(ws))
    out = np.full(len(h) - width + 1, (width * _STEP) & (2**64 - 1), np.uint64)
    for i in range(width):
        out = mix(out + h[i : len(h) - width + 1 + i] * np.uint64(((2 * i + 1) * _STEP) & (2**64 - 1) | 1))
    return np.unique(out)


class Seen(set):
    """Digests met by a task, the last ``LIMIT`` or fewer: it only saves work on copies, so it may forget."""

    LIMIT = 50_000

    def first(self, digest: bytes) -> bool:
        if digest in self:
            return False
        if len(self) >= self.LIMIT:
            self.clear()
        self.add(digest)
        return True


class Scheme:
    """Entries of a set at the threshold num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.light = 0
        n = 1
        while self._subsets(n) <= LIST_COST * (self._largest(n) + 1 + SPARE):
            self.light, n = n, n + 1
        self.bounds = [max(1, -(-num * (self.light + 1) // den))]

    def _spared(self, n: int) -> int:
        """Shingles that a set of n may lack in a partner."""
        return n - -(-self.num * n // self.den)

    def _subsets(self, n: int) -> int:
        return sum(comb(n, d) for d in range(self._spared(n) + 1))

    def _largest(self, n: int) -> int:
        """The largest difference of two sets of at most n at the threshold."""
        return 2 * n * (self.den - self.num) // (self.den + self.num)

    def bound(self, c: int) -> int:
        """Least size of class c; a class is at least as wide as 1 / threshold, so partners are in adjacent ones."""
        while len(self.bounds) <= c:
            last = self.bounds[-1]
            self.bounds.append(max(last + 1, -(-last * self.den // self.num), last * 5 // 4))
        return self.bounds[c]

    def entries(self, s: np.ndarray, common: np.ndarray | None = None) -> np.ndarray:
        """Entries of a set. ``common`` flags buckets of shingles that many sets hold: leaving those out of all sets
        lets no difference grow, so the parts of what remains do for a set that has enough of them. A set that has not
        gives the parts of all its shingles as well, for partners of its kind."""
        n = len(s)
        out = []
        if 0 < n <= self.light:
            total = s.sum(dtype=np.uint64)
            gone = [np.uint64(sum(int(x) for x in c) & (2**64 - 1)) for d in range(self._spared(n) + 1) for c in combinations(s, d)]
            out.append(mix(total - np.array(gone, np.uint64) + np.uint64(_STEP)))
        if n >= self.bound(0):
            c = 0
            while self.bound(c + 1) <= n:
                c += 1
            for k in (c, c + 1)[: 1 + (n * self.den // self.num >= self.bound(c + 1))]:
                enough = False
                if common is not None:
                    found, enough = self._parts(s[~common[_bucket(s)]], k, n, 0)
                    out.append(found)
                if not enough:
                    out.append(self._parts(s, k, n, 1)[0])
        return np.unique(np.concatenate(out)) if out else np.empty(0, np.uint64)

    def _parts(self, s: np.ndarray, c: int, n: int, tag: int) -> tuple[np.ndarray, bool]:
        """Entries of class c, and whether parts that hold something sufficed: those of two shingles or more if they
        outnumber the differences of a set of n, else those of one; else all, and with tag 0 those of one anyway."""
        allowed = self._largest(self.bound(c + 1) - 1)
        if not allowed:
            return np.empty(0, np.uint64), True  # only equal sets reach the threshold
        need = min(allowed, n * (self.den - self.num) // self.num) + 1
        m = allowed + 1 + SPARE + (allowed // 5 if 8 * self._largest(1000) > 1000 else 0)
        full, size = np.zeros(m, np.uint64), np.zeros(m, np.int64)
        if len(s):
            part = ((s >> np.uint64(24)) % np.uint64(m)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            at, begin, counts = np.unique(part[order], return_index=True, return_counts=True)
            full[at], size[at] = np.add.reduceat(s[order], begin), counts
        least = 2 if (size >= 2).sum() >= need else 1
        enough = (size >= least).sum() >= need
        at = np.flatnonzero(size >= least) if enough or not tag else np.arange(m)
        return mix(mix(full[at]) + np.uint64((c + 1) * _STEP & (2**64 - 1)) * (at.astype(np.uint64) * np.uint64(4) + np.uint64(2 * (1 - tag) + 1))), bool(enough)


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def texts_of(batches):
    """The first column of Arrow batches, a slice at a time."""
    for b in batches:
        for at in range(0, b.num_rows, 1024):
            yield from b.column(0).slice(at, 1024).to_pylist()


def _bucket(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(42)).astype(np.int64)


def common_shingles(docs: DataFrame, k: int, text: str = "text", times: float = 4.0, least: int = 32) -> np.ndarray:
    """A flag for each bucket of shingles: whether its sets number over ``times`` the mean of all buckets, and over
    ``least``. Every text is counted, repeated ones once a task; tasks send compressed counts of a fixed size."""
    chunk = BUCKETS // 256

    def rows(batches):
        counts, seen = np.zeros(BUCKETS, np.int32), Seen()
        for t in texts_of(batches):
            s = shingles(t, k)
            if len(s) and seen.first(_digest(s)):
                np.add.at(counts, _bucket(s), 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(256), pa.int32()), pa.array([zlib.compress(counts[i * chunk : (i + 1) * chunk].tobytes(), 1) for i in range(256)], pa.binary())], names=["chunk", "counts"])

    def summed(t: pa.Table) -> pa.Table:
        total = np.zeros(chunk, np.int64)
        for x in t.column("counts").to_pylist():
            total += np.frombuffer(zlib.decompress(x), np.int32)
        return pa.table({"chunk": t.column("chunk").slice(0, 1), "total": pa.array([int(total.sum())], pa.int64()), "counts": pa.array([zlib.compress(np.minimum(total, 2**31 - 1).astype(np.int32).tobytes(), 1)], pa.binary())})

    sums = durable(docs.select(text).mapInArrow(rows, "chunk int, counts binary").groupBy("chunk").applyInArrow(lambda t: summed(t), "chunk int, total long, counts binary"))
    limit = max(least, times * (sums.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0] / BUCKETS))

    def flags(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.packbits(np.frombuffer(zlib.decompress(x), np.int32) > limit).tobytes() for x in b.column(1).to_pylist()], pa.binary())], names=["chunk", "flags"])

    out = np.zeros(BUCKETS, bool)
    for r in sums.select("chunk", "counts").mapInArrow(flags, "chunk int, flags binary").collect():
        out[r.chunk * chunk : (r.chunk + 1) * chunk] = np.unpackbits(np.frombuffer(r.flags, np.uint8))[:chunk].astype(bool)
    return out


def distinct(sets: list[np.ndarray]) -> np.ndarray:
    """The sorted distinct shingles of a cell. Numbers for its sets are searched in them, set by set: to have them all from
    one sort takes eight times the memory of the sets, and a cell of them is what a task holds at most."""
    flat = np.concatenate(sets)
    flat.sort()
    return flat[np.concatenate(([True], flat[1:] != flat[:-1]))] if len(flat) else flat


def join_cell(sets: list[np.ndarray], sides: list[int] | None, num: int, den: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the sets that reach the threshold, from each set to one of its tree, so that few
    rounds join the trees of cells; with sides, only pairs across them count."""
    flat = distinct(sets)
    sizes = [len(s) for s in sets]
    mine = [np.searchsorted(flat, s).astype(np.int32) for s in sets]
    df = np.zeros(len(flat), np.int32)
    for m in mine:
        df[m] += 1  # a set holds a shingle once
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    mark = np.full(len(flat), -1, np.int32)
    lists: dict[int, list[int]] = {}
    for i in sorted(range(len(sets)), key=lambda i: sizes[i]):
        n = sizes[i]
        order = np.lexsort((mine[i], df[mine[i]]))
        prefix = mine[i][order[: n - -(-num * n // den) + 1]]
        prefix = prefix[df[prefix] > 1].tolist()
        near = {j for t in prefix for j in lists.get(t, ()) if sizes[j] * den >= num * n and (sides is None or sides[j] != sides[i])}
        marked = False
        for j in sorted(near, reverse=True):
            if root(j) == root(i):
                continue
            if not marked:
                mark[mine[i]] = i
                marked = True
            both = int(np.count_nonzero(mark[mine[j]] == i))
            if both * den >= num * (n + sizes[j] - both):
                parent[root(j)] = root(i)
        for t in prefix:
            lists.setdefault(t, []).append(i)
    return [(i, root(i)) for i in range(len(sets)) if root(i) != i]


def link_copies(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text", cell: int = CELL, without_common: bool = False) -> DataFrame:
    """One row a document: doc_id, row (the row_key of id and text), n_shingles, component_id, keep (True for one row of each
    component, rows equal in id and text sharing it).

    ``without_common`` leaves shingles that many sets hold out of the entries, at the price of a pass that counts them.
    It pays at thresholds whose parts hold few shingles (under eight), where a shared passage fills whole parts.
    """
    scheme_of = lambda: Scheme(num, den)
    source = bounded(docs).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    common = docs.sparkSession.sparkContext.broadcast(np.packbits(common_shingles(source, k))) if without_common else None

    def signed(batches):
        scheme, seen = scheme_of(), Seen()
        flags = None if common is None else np.unpackbits(common.value).astype(bool)
        out, lists, held = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                for i, row, t in zip(*(c.slice(at, 1024).to_pylist() for c in batch.columns), strict=True):
                    s = shingles(t, k)
                    digest = _digest(s) if len(s) else None
                    new = digest is not None and seen.first(digest)
                    out.append((i, row, len(s), digest, new))
                    if new:
                        lists.append(scheme.entries(s, flags))
                        held += lists[-1].nbytes
                    if len(out) >= SLICE_ROWS or held >= SLICE_BYTES:
                        yield packed(out, lists)
                        out, lists, held = [], [], 0
        if out:
            yield packed(out, lists)

    def packed(out, lists):
        """Entries go out as flat arrays: a list of a row that has none is null."""
        i, row, n, digest, new = zip(*out, strict=True)
        sizes = np.zeros(len(out) + 1, np.int32)
        sizes[1:][list(new)] = [len(x) for x in lists]
        flat = np.concatenate(lists).view(np.int64) if lists else np.empty(0, np.int64)
        entries = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.array(flat), mask=pa.array([not x for x in new]))
        columns = [pa.array(i, pa.int64()), pa.array(row, pa.string()), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), entries]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "n", "digest", "entries"])

    sets = durable(source.select("doc_id", row_key("doc_id", "text").alias("row"), "text").mapInArrow(signed, "doc_id long, row string, n long, digest binary, entries array<long>"))
    short = F.conv(F.substring(F.hex("digest"), 1, 15), 16, 10).cast("long")  # joins cells only; a clash merges two
    posted = sets.where("entries is not null").select(F.explode("entries").alias("entry"), short.alias("sig"))
    first = F.first("sig").over(Window.partitionBy("entry").orderBy("sig"))
    lists = posted.select(F.col("sig").alias("b"), first.alias("a")).where("a <> b")
    cells = components(lists)

    classes = sets.where("digest is not null").groupBy("digest").agg(F.min("row").alias("rep"), F.min("n").alias("n"))
    members = durable(classes.withColumn("node", short).join(cells, "node").select("digest", "rep", "n", "label"))
    big = members.groupBy("label").agg(F.sum("n").alias("total")).withColumn("blocks", F.ceil(F.col("total") / cell).cast("int"))
    total = big.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    groups = max(1, -(-total // (cell // 4)))
    block = F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")
    shared = members.join(big, "label").withColumn("block", block).select("digest", "rep", "label", "blocks", "block")
    texts = source.select("text", row_key("doc_id", "text").alias("rep")).join(shared, "rep").select("text", "digest", "label", "blocks", "block")

    def read(columns):
        for t, digest, label, blocks, own in zip(*columns, strict=True):
            s = shingles(t, k)
            if _digest(s) == digest:
                yield digest, label, blocks, own, s.tobytes()

    whole = arrow_map(texts, read, "digest binary, label long, blocks int, block int, tokens binary", ["digest", "label", "blocks", "block", "tokens"], [pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary()])
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = whole.withColumn("other", other).select(
        "digest", "label", "block", "tokens", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("label"), F.lit(groups))).otherwise(F.lit(-1)).alias("bucket"),
    ).withColumn("big", F.when(F.col("bucket") < 0, F.col("label")))

    def joined(t: pa.Table) -> pa.Table:
        by: dict[int, dict[bytes, tuple[int, np.ndarray]]] = {}
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        for label, digest, own, tokens in zip(t.column("label").to_pylist(), t.column("digest").to_pylist(), t.column("block").to_pylist(), t.column("tokens"), strict=True):
            by.setdefault(label, {})[digest] = (own, np.frombuffer(tokens.as_buffer(), np.uint64))  # where Arrow holds it
        a, b = [], []
        for members_ in by.values():
            if len(members_) > 1:
                names = sorted(members_)
                found = join_cell([members_[x][1] for x in names], [members_[x][0] for x in names] if i != j else None, num, den)
                a += [names[x] for x, _ in found]
                b += [names[y] for _, y in found]
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    links = dealt.groupBy("bucket", "big", "i", "j").applyInArrow(lambda t: joined(t), "a binary, b binary")
    linked = components(links)

    named = sets.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("front"))
    groups_ = named.join(linked.withColumnRenamed("node", "digest"), "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    whole_groups = groups_.groupBy("label").agg(F.min("least").alias("component_id"), F.min("front").alias("front"))
    by_class = groups_.select("digest", "label").join(whole_groups, "label").select("digest", "component_id", F.col("front.row").alias("front_row"))
    return sets.select("doc_id", "row", "n", "digest").join(by_class, "digest", "left").select(
        "doc_id", "row", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(F.col("n") == 0, F.lit(True)).otherwise(F.col("row") == F.col("front_row")).alias("keep"),
    )


def op6_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return link_copies(docs, k=3, num=90, den=100).select("doc_id", "n_shingles", "component_id")


OP6_SQL = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents
), g as (
  select doc_id, list_distinct(case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) end) as s from w
), n as (select doc_id, len(s) as n from g),
t as (select doc_id, unnest(s) as x from g),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from t a join t b on a.x = b.x and a.doc_id <> b.doc_id group by 1, 2),
e as (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * c >= 90 * (x.n + y.n - c)),
r as (select doc_id as node, doc_id as seen from n union select r.node, e.b from r join e on e.a = r.seen)
select n.doc_id, cast(n.n as bigint) as n_shingles, m.component_id from n join (select node, min(seen) as component_id from r group by node) m on m.node = n.doc_id
"""
