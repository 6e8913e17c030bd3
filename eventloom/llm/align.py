"""Alignment of two tokenizers over a corpus: common cuts, groups, links, and how often an id pair is linked anywhere.

1. A task encodes its documents by both tokenizers. For many documents at once, NumPy sums up the ends of the tokens' bytes;
   ends that both share (``intersect1d``) are cuts, a token's group is the first cut at or after its end
   (``searchsorted``), and links are written out by repeats: a token of A meets as many tokens of B as its bytes touch.
2. The task's documents go in blocks of about ``BLOCK_LINKS`` different links of a document. A block is one row: what its
   documents come to, their pairs as places in the block's list of pairs, and that list with the documents of each pair.
   Blocks are written once, to a durable copy.
3. Pairs are counted by a shuffle of two stages, first by pair and salt, then by pair; a block sends each pair once. The
   highest count of an A id is at most a row an id of A, so it is broadcast.
4. Counts go back to the blocks that hold the pair, and meet them by block.

Defined cases: texts that are null or empty, or that either tokenizer does not give back byte by byte, have no tokens and
zeros; repeated rows are documents of their own; null keys stay; an empty table gives no rows; columns besides key and text
are passed over, whatever their names; a document with more links than a block should hold is a block by itself.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import sentence
from .common import bounded, durable, list_array, table
from .search import pack, unpack

BLOCK_LINKS = 4_000_000
KNOWN = 300_000
LONG = 64
SALTS = 16
GAPS = "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))  # Unicode's white space
#: No finer than the byte-level split, so each match can be encoded by itself.
WORDS = re.compile(f" ?[^{GAPS}]+|[{GAPS}]+(?![^{GAPS}])|[{GAPS}]+")
BLOCK = "block long, keys array<long>, n_a array<int>, n_b array<int>, n_groups array<int>, n_links array<long>, digests array<string>, sizes array<int>, places binary, times binary, pairs binary, held binary"


def byte_of() -> dict[str, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevel:
    """Tokenizer of a byte-level BPE file; distinct words of a process are encoded once."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # cores belong to Spark's tasks
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.encode_special_tokens = True
        parts = json.loads(spec)
        before = parts["pre_tokenizer"] or {}
        self.words = WORDS if parts["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") else re.compile("(?s).+")
        letter, added = byte_of(), {t["id"]: t["content"].encode() for t in parts["added_tokens"]}
        self.bytes = [b""] * self.tokenizer.get_vocab_size()
        for piece, i in self.tokenizer.get_vocab().items():
            self.bytes[i] = added[i] if i in added else bytes(letter[c] for c in piece)
        self.known: dict[str, bytes] = {}
        self.changed: set[str] = set()  # known words whose tokens are other bytes than they are

    def encode(self, texts: list[str]) -> list[np.ndarray | None]:
        """ids of each text; none of a text that its tokens do not give back byte by byte."""
        if len(self.known) >= KNOWN:
            self.known.clear()
            self.changed.clear()
        known, changed, cut = self.known, self.changed, [self.words.findall(t) for t in texts]
        new = list({x for xs in cut for x in xs if x not in known})
        for x, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            ids = e.ids
            known[x] = array("i", ids).tobytes()
            if b"".join(map(self.bytes.__getitem__, ids)) != x.encode():
                changed.add(x)
        out = [None if changed and not changed.isdisjoint(xs) else np.frombuffer(b"".join(map(known.__getitem__, xs)), np.int32) for xs in cut]
        for x in new:
            if len(x) > LONG:
                del known[x]
                changed.discard(x)
        return out


class Pair:
    """Both tokenizers, with the bytes of their tokens and the written form of their ids."""

    def __init__(self, spec: str, blob: bytes):
        self.a, self.b = ByteLevel(spec), sentence.model_of(blob)
        self.b_bytes = list(self.b.surfaces)
        for i, kind in enumerate(self.b.kinds):
            if kind in (sentence.UNKNOWN, sentence.CONTROL):
                self.b_bytes[i] = self.b.pieces[i].encode()
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], np.int64) for t in (self.a.bytes, self.b_bytes))
        self.ids = max(len(self.a_sizes), len(self.b_sizes))
        self.written = np.array([b"%d%c" % (i, mark) for mark in b",|;" for i in range(self.ids)], object)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """ids by A of space and text, and by B of the text; none where either does not give these bytes back."""
        none = np.zeros(0, np.int32)
        spaced = [" " + t for t in texts]
        out = []
        for t, s, a, (b, _, _) in zip(texts, spaced, self.a.encode(spaced), self.b.encode(texts), strict=True):
            same = t and a is not None and b"".join(map(self.b_bytes.__getitem__, b.tolist())) == s.encode()
            out.append((a, b) if same else (none, none))
        return out


@functools.lru_cache(2)
def pair_of(spec: str, blob: bytes) -> Pair:
    return Pair(spec, blob)


def align(pair: Pair, coded: list[tuple[np.ndarray, np.ndarray]]) -> dict[str, np.ndarray | list[str]]:
    """For documents that follow each other in one run of bytes: their counts and digests, and their different links as
    ``sizes`` a document, ``pairs`` (A id times ``pair.ids`` plus B id, ascending in a document) and ``times``."""
    none = np.zeros(1, np.int64)
    a, b = (np.concatenate([none[:0], *(c[i] for c in coded)]).astype(np.int64) for i in range(2))
    n_a, n_b = (np.array([len(c[i]) for c in coded], np.int64) for i in range(2))
    to_a, to_b = np.cumsum(n_a), np.cumsum(n_b)
    ends_a, ends_b = np.cumsum(pair.a_sizes[a]), np.cumsum(pair.b_sizes[b])
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
    to_group = np.searchsorted(cuts, np.concatenate(([0], ends_a))[to_a], "right")
    # Links: up to the first token of B that ends where the token of A ends or later, from the one that the token before it
    # ended with, or from the next where both ended together.
    last = np.searchsorted(ends_b, ends_a)
    first = np.concatenate((none, (last + (ends_b[last] == ends_a))[:-1])) if len(a) else last
    many = last - first + 1
    upto = np.cumsum(many)
    links = np.arange(upto[-1] if len(upto) else 0) + np.repeat(first - upto + many, many)
    document = np.repeat(np.arange(len(coded)), n_a)
    keys = np.repeat(document << 40 | a * pair.ids, many) + b[links]
    n_links = np.diff(np.concatenate(([0], upto))[to_a], prepend=0)
    pairs, times = np.unique(keys, return_counts=True)
    sizes = np.bincount(pairs >> 40, minlength=len(coded))
    # Groups as written: the A ids of a group, then its B ids, each with the mark that follows it.
    same_a, same_b = (np.append(g[1:] == g[:-1], False) if len(g) else np.zeros(0, bool) for g in (group_a, group_b))
    upto_a, of_b = np.cumsum(np.bincount(group_a, minlength=len(cuts))), np.bincount(group_b, minlength=len(cuts))
    order = np.empty(len(a) + len(b), np.int64)
    order[np.arange(len(a)) + (np.cumsum(of_b) - of_b)[group_a]] = a + np.where(same_a, 0, pair.ids)
    order[np.arange(len(b)) + upto_a[group_b]] = b + np.where(same_b, 0, 2 * pair.ids)
    written = pair.written[order].tolist()
    bounds = [0, *(to_a + to_b).tolist()]
    digests = [hashlib.sha256(b"".join(written[x:y])[:-1]).hexdigest() if y > x else "" for x, y in zip(bounds, bounds[1:], strict=False)]
    return {"n_a": n_a, "n_b": n_b, "n_groups": np.diff(to_group, prepend=0), "n_links": n_links, "digests": digests, "sizes": sizes, "pairs": pairs & ((1 << 40) - 1), "times": times}


def block_row(block: int, keys: list, parts: list[dict]) -> pa.RecordBatch:
    """One block of documents. Places rise in a document, so their steps are small numbers."""
    whole = {n: np.concatenate([p[n] for p in parts]) for n in ("n_a", "n_b", "n_groups", "n_links", "sizes", "pairs", "times")}
    pairs, places, held = np.unique(whole["pairs"], return_inverse=True, return_counts=True)
    steps = np.diff(places, prepend=0)
    begins = np.cumsum(whole["sizes"]) - whole["sizes"]
    begins = begins[whole["sizes"] > 0]
    steps[begins] = places[begins]
    again = whole["times"] > 1
    n = len(keys)
    lists = [pa.array([x], pa.list_(k)) for x, k in ((keys, pa.int64()),)]
    lists += [list_array(whole[c].astype(np.int32), [n]) for c in ("n_a", "n_b", "n_groups")] + [list_array(whole["n_links"], [n], pa.int64())]
    lists += [pa.array([[d for p in parts for d in p["digests"]]], pa.list_(pa.string())), list_array(whole["sizes"].astype(np.int32), [n])]
    packed = [pack(steps << 1 | again)[0], pack(whole["times"][again])[0], pack(np.diff(pairs, prepend=0))[0], pack(held)[0]]
    names = [x.split()[0] for x in BLOCK.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *lists, *(pa.array([x], pa.binary()) for x in packed)], names=names)


def aligned_blocks(docs: DataFrame, spec: str, blob: bytes, key: str = "doc_id", text: str = "text", block_links: int = BLOCK_LINKS) -> DataFrame:
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(text, F.lit("")).alias("text"))

    def run(batches):
        pair, block = pair_of(spec, blob), TaskContext.get().partitionId() << 32
        keys, parts, size = [], [], 0
        for batch in batches:
            for ks, texts in sentence.slices(batch):
                keys += ks
                parts.append(align(pair, pair.encode(texts)))
                size += len(parts[-1]["pairs"])
                if size >= block_links:
                    yield block_row(block, keys, parts)
                    keys, parts, size, block = [], [], 0, block + 1
        if keys:
            yield block_row(block, keys, parts)

    return bounded(rows).mapInArrow(run, BLOCK)


def block_pairs(blocks: DataFrame, ids: int) -> DataFrame:
    """block, place, a, b, docs: every pair of every block with the documents of the block that hold it linked."""

    def run(batches):
        for batch in batches:
            for block, pairs, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pairs, held = np.cumsum(unpack(pairs)), unpack(held)
                for x in range(0, len(pairs), 100_000):
                    y = min(len(pairs), x + 100_000)
                    columns = [np.full(y - x, block), np.arange(x, y, dtype=np.int32), (pairs[x:y] // ids).astype(np.int32), (pairs[x:y] % ids).astype(np.int32), held[x:y]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["block", "place", "a", "b", "docs"])

    return bounded(blocks.select("block", "pairs", "held")).mapInArrow(run, "block long, place int, a int, b int, docs long")


def pair_counts(pairs: DataFrame, salts: int = SALTS) -> DataFrame:
    """a, b, count of documents over the corpus, best: whether no other B id is linked with a more often."""
    salted = pairs.groupBy("a", "b", F.pmod(F.xxhash64("block"), F.lit(salts)).alias("salt")).agg(F.sum("docs").alias("docs"))
    counts = durable(salted.groupBy("a", "b").agg(F.sum("docs").alias("count")))
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))
    return counts.join(F.broadcast(highest), "a").select("a", "b", "count", (F.col("count") == F.col("highest")).alias("best"))


def align_documents(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text", block_links: int = BLOCK_LINKS) -> tuple[DataFrame, DataFrame]:
    """One row a document (key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), and the pairs' counts."""
    with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:
        spec, blob = f.read(), g.read()
    pair = pair_of(spec, blob)
    blocks = durable(aligned_blocks(docs, spec, blob, key, text, block_links))
    pairs = block_pairs(blocks, pair.ids)
    counts = pair_counts(pairs)
    told = pairs.select("block", "place", "a", "b").join(counts, ["a", "b"]).select(F.col("block").alias("of"), "place", "count", "best")

    def finish(block: pa.Table, told: pa.Table) -> pa.Table:
        order = np.argsort(told.column("place").to_numpy())
        count, best = told.column("count").to_numpy()[order], told.column("best").to_numpy()[order]
        out = []
        for row in block.to_pylist():
            steps = unpack(row["places"])
            again = (steps & 1).astype(bool)
            times = np.ones(len(steps), np.int64)
            times[again] = unpack(row["times"])
            to = np.cumsum(row["sizes"])
            places = np.cumsum(steps >> 1)
            # Steps begin anew in each document.
            before = np.concatenate(([0], places))[to - row["sizes"]]
            places -= np.repeat(before, row["sizes"])
            sums = [np.diff(np.concatenate(([0], np.cumsum(times * x[places])))[to], prepend=0) for x in (best, count)]
            columns = [row["keys"], *(row[c] for c in ("n_a", "n_b", "n_groups", "n_links")), *sums]
            out.append(pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"), columns, strict=True)} | {"groups_sha256": pa.array(row["digests"], pa.string())}))
        return pa.concat_tables(out) if out else pa.table({n: pa.array([], t) for n, t in zip(("key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"), [pa.int64()] * 7 + [pa.string()], strict=True)})

    done = blocks.drop("pairs", "held").groupBy("block").cogroup(told.groupBy("of")).applyInArrow(finish, "key long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return done.withColumnRenamed("key", key), counts


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return align_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))[0]
