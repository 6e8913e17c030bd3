"""Byte-level BPE: distinct words are merged by Spark's higher-order functions over a literal rank map.

One narrow pass, without a shuffle, in three steps that each task streams through:

1. The task splits its documents and sends on every word when it first meets it, as its bytes, and each document as the
   numbers of its words. Words are distinct in a task, which covers about ``task_bytes`` of text (scan splits are put
   together, not dealt anew); to make them distinct in the table would shuffle them with their places and the documents.
2. A fold over the word's bytes merges the adjacent pair of the lowest rank, leftmost first, until no pair has a rank. It
   carries the ids of the pieces and the rank of each adjacent pair, so a merge looks up two pairs. The rank map is a
   literal: a table of pairs of ids, placed without collisions (hash and displace), so a lookup reads one place.
3. Decoding is Spark's: the binary pieces of a word's ids, concatenated. The ids of the words, and what they decode to, are
   strung together for each document.

The fold does work quadratic in a word's length, so words over ``LONG`` bytes are merged where they stand, with a heap.
A task forgets its words after ``KNOWN`` of them, so its memory does not follow the size of its share.

Defined cases: null texts are empty; empty texts have no ids; an empty table gives no rows; null keys and repeated rows
stay; columns besides key and text are passed over, whatever their names; lone surrogates cannot occur.
"""

from __future__ import annotations

import base64
import heapq
import json
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, table, tidy

LONG = 256
TASK_BYTES = 64_000_000
KNOWN = 700_000
WORD, DOCUMENT, FORGET = range(3)  # kinds of row that a task sends itself
SIDE = 1 << 20  # ids are below it; a pair's key is left * SIDE + right, an entry of the table key * SIDE + rank
RANK = 1 << 28  # a rank in a piece's number, above the byte that the piece begins at (8 bits) and its id
NONE = SIDE  # the rank of a pair that has none
EMPTY = SIDE**3 - 1  # a place of the table without an entry
GONE = 2**62  # a piece that was merged away


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def pair_ranks(ranks: dict[bytes, int]) -> dict[int, int]:
    """Rank of every pair of pieces that are a piece together, by the pair's key."""
    out = {}
    for piece, rank in ranks.items():
        for i in range(1, len(piece)):
            a, b = ranks.get(piece[:i]), ranks.get(piece[i:])
            if a is not None and b is not None:
                out[a * SIDE + b] = rank
    return out


class RankMap:
    """The rank map as literals: entries of pairs of ids, placed without collisions by displacements of their buckets, and
    a plain table of the pairs of bytes. A plan should name each but once: the driver keeps its plans as text, too."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = pair_ranks(ranks)
        self.size, self.buckets = _prime(len(pairs) * 4 // 3 + 16), _prime(len(pairs) // 3 + 4)
        self.entries, self.moves = [EMPTY] * self.size, [0] * self.buckets
        held: list[list[int]] = [[] for _ in range(self.buckets)]
        for key in pairs:
            held[key % self.buckets].append(key)
        for b in sorted(range(self.buckets), key=lambda b: -len(held[b])):
            d = 0
            while held[b]:
                at = [(key + d) % self.size for key in held[b]]
                if len(set(at)) == len(at) and all(self.entries[x] == EMPTY for x in at):
                    for x, key in zip(at, held[b], strict=True):
                        self.entries[x] = key * SIDE + pairs[key]
                    break
                d += 1
            self.moves[b] = d
        single = [ranks.get(bytes([i]), SIDE - 1) for i in range(256)]
        self.first = [pairs.get(a * SIDE + b, NONE) * RANK + a for a in single for b in single] + [NONE * RANK + a for a in single]

    def literals(self) -> list[Column]:
        return [F.from_json(F.lit(json.dumps(x, separators=(",", ":"))), "array<bigint>") for x in (self.first, self.entries, self.moves)]

    def rank(self, entries: Column, moves: Column, key: Column) -> Column:
        """Rank of a pair by its key, NONE if it has none: an entry of another pair differs above the rank's bits."""
        entry = F.get(entries, ((key + F.get(moves, (key % self.buckets).cast("int"))) % self.size).cast("int"))
        return F.least(entry.bitwiseXOR(key * SIDE), F.lit(NONE).cast("bigint"))


def _prime(n: int) -> int:
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once. The variable of a fold's last step holds it: what an array's element or
    a transform gives would be copied, and its type worked out anew for every row."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda kept, _: kept, body)


def encode_word(letters: Column, ranks: RankMap) -> Column:
    """ids, as array<bigint>, of a word given as the array of its bytes (0 to 255), at most LONG.

    The state is an array of a number a piece: the rank of the pair that it begins, the byte it begins at and its id, in
    this order, so the least number is the leftmost pair of the lowest rank.
    """
    first, entries, moves = ranks.literals()
    state = F.transform(letters, lambda b, i: F.get(first, F.coalesce(b * 256 + F.get(letters, i + 1), b + 65_536)) + i * F.lit(SIDE))

    def merge(acc: Column, _: Column) -> Column:
        def joined(least: Column) -> Column:
            new = F.shiftright(least, 28)

            def ranked(key: Column, rest: Column) -> Column:
                return let(key, lambda y: ranks.rank(entries, moves, y)) * RANK + rest

            def at(k: Column) -> Column:  # the place of the pair's right piece, from 0
                def moved(x: Column, i: Column) -> Column:
                    left = x % RANK - x % SIDE + new
                    left = F.coalesce(ranked(new * SIDE + F.get(acc, k + 1) % SIDE, left), NONE * RANK + left)
                    near = F.when(i == k, F.lit(GONE)).otherwise(F.when(i == k - 1, left).otherwise(ranked(x % SIDE * SIDE + new, x % RANK)))
                    return F.when(i > k, x).otherwise(F.when(i < k - 2, x).otherwise(near))

                return F.array_remove(F.transform(acc, moved), F.lit(GONE))

            return let(F.array_position(acc, least).cast("int"), at)

        return let(F.array_min(acc), lambda least: F.when(least >= NONE * RANK, acc).otherwise(joined(least)))

    return F.aggregate(letters, state, merge, lambda acc: F.transform(acc, lambda x: x % SIDE))


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """ids of a long word: linked pieces and a heap of ranked pairs, so n log n."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end = list(range(1, n + 1))  # of the piece that begins here; 0 once merged away
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, middle, to = heapq.heappop(heap)
        if end[i] != middle or middle >= n or end[middle] != to:
            continue
        end[i], end[middle] = to, 0
        if to < n:
            before[to] = i
            if (r := ranks.get(word[i : end[to]])) is not None:
                heapq.heappush(heap, (r, i, to, end[to]))
        if (b := before[i]) >= 0 and (r := ranks.get(word[b:to])) is not None:
            heapq.heappush(heap, (r, b, i, to))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class _Numbers(dict):
    """Numbers of words in the order in which they are met; ``new`` collects those not sent yet."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        out = self[word] = len(self)
        self.new.append(word)
        return out


def _lists(flat: np.ndarray, sizes: list[int], absent: list[bool], kind: pa.DataType) -> pa.Array:
    """Lists of ``sizes`` cut from flat values; null where ``absent``."""
    ends = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind), mask=pa.array(absent, pa.bool_()))


def encode_documents(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", task_bytes: int = TASK_BYTES, known: int = KNOWN) -> DataFrame:
    """One row a document: key, n_tokens, ids (little-endian unsigned 32-bit, joined), decoded (the bytes of the ids)."""
    ranks = load_ranks(path)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-total // task_bytes))
    tidy(docs.sparkSession)

    def numbered(batches):
        split, numbers = regex.compile(pattern), _Numbers()
        keys, places, held = [], [], 0

        def sent():
            """The new words, then the documents that hold them: words that are a piece, or too long, with their ids."""
            raws = [w.encode() for w in numbers.new]
            whole = [ranks.get(w) for w in raws]
            done = [[r] if r is not None else merge_long(w, ranks) if len(w) > LONG else None for w, r in zip(raws, whole, strict=True)]
            folded = [w if d is None else b"" for w, d in zip(raws, done, strict=True)]
            n, m = len(raws), len(keys)
            letters = _lists(np.frombuffer(b"".join(folded), np.uint8).astype(np.int32), [*map(len, folded), *[0] * m], [*(d is not None for d in done), *[True] * m], pa.int32())
            ids = pa.array([*done, *[None] * m], pa.list_(pa.int64()))
            kind = np.repeat(np.array([WORD, DOCUMENT], np.int8), [n, m])
            out = [pa.array(kind), pa.array([*[None] * n, *keys], pa.int64()), letters, pa.array([*[None] * n, *places], pa.binary()), ids]
            numbers.new.clear()
            keys.clear()
            places.clear()
            return pa.RecordBatch.from_arrays(out, names=["kind", "key", "letters", "places", "done"])

        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                for k, t in zip(*(c.slice(begin, 256).to_pylist() for c in batch.columns), strict=True):
                    at = array("I", map(numbers.__getitem__, split.findall(t)))
                    keys.append(k)
                    places.append(at.tobytes())
                    held += 4 * len(at)
                    if held > 2_000_000 or len(keys) >= 4096:
                        yield sent()
                        held = 0
                        if len(numbers) > known:
                            numbers = _Numbers()
                            yield pa.RecordBatch.from_arrays([pa.array([FORGET], pa.int8()), pa.array([None], pa.int64()), pa.array([None], pa.list_(pa.int32())), pa.array([None], pa.binary()), pa.array([None], pa.list_(pa.int64()))], names=["kind", "key", "letters", "places", "done"])
        if keys:
            yield sent()

    def strung(batches):
        packed: list[bytes] = []
        spelt: list[bytes] = []
        for batch in batches:
            kinds, keys, places = (batch.column(i).to_pylist() for i in range(3))
            ends = batch.column(3).offsets.to_pylist()
            texts = batch.column(4).to_pylist()
            raw = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes()
            first, out, held = ends[0], [], 0
            for i, kind in enumerate(kinds):
                if kind == WORD:
                    packed.append(raw[4 * (ends[i] - first) : 4 * (ends[i + 1] - first)])
                    spelt.append(texts[i])
                elif kind == DOCUMENT:
                    at = array("I", places[i])
                    out.append((keys[i], b"".join(map(packed.__getitem__, at)), b"".join(map(spelt.__getitem__, at))))
                    held += len(out[-1][1]) + len(out[-1][2])
                    if held > 4_000_000:
                        yield documents(out)
                        out, held = [], 0
                else:
                    packed, spelt = [], []
            if out:
                yield documents(out)

    def documents(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary()))], names=["key", "ids", "decoded"])

    words = bounded(rows).coalesce(tasks).mapInArrow(numbered, "kind byte, key long, letters array<int>, places binary, done array<bigint>")
    merged = F.when(F.col("letters").isNotNull(), encode_word(F.col("letters"), RankMap(ranks))).otherwise(F.col("done"))
    spelled = words.select("kind", "key", "places", merged.alias("ids")).withColumn("decoded", decode(F.col("ids"), ranks))
    coded = spelled.mapInArrow(strung, "key long, ids binary, decoded binary")
    return coded.select(F.col("key").alias(key), F.shiftright(F.octet_length("ids"), 2).cast("long").alias("n_tokens"), "ids", "decoded")


def decode(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes of an array of ids: their pieces, concatenated."""
    pieces: list[str | None] = [None] * (max(ranks.values(), default=0) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = base64.b64encode(piece).decode()
    # Strings are only carriers of bytes here: neither cast changes any.
    literal = F.from_json(F.lit(json.dumps(pieces, separators=(",", ":"))), "array<binary>").cast("array<string>")
    return let(literal, lambda ps: F.array_join(F.transform(ids, lambda i: F.get(ps, i)), "").cast("binary"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
