"""SentencePiece BPE that keeps offsets: normalisation records where every character came from, pieces point back there.

One narrow pass over the documents, without a shuffle:

1. Normalisation walks the model's compiled character map (a double-array trie) and takes the longest source prefix it
   knows at each place; other characters stay. Every character of the result keeps the byte of the source at which its
   rule began, so white space that is added, escaped or removed is accounted for.
2. The text is cut where no piece of the vocabulary can span: before a space mark, and between characters that pieces never
   hold side by side. Each distinct segment of a task is merged once, best score first, leftmost among equals, many
   segments together in NumPy; a character without a piece falls back to bytes. A task forgets its segments after ``KNOWN``
   of them, and keeps none over ``LONG`` characters.
3. The ends of the pieces, summed up, index the alignment: that gives each piece's span of source bytes. Of a character
   that fell back to bytes, the last byte's piece holds the span, the others are empty at its beginning.

Decoding joins the surfaces of the ids and puts runs of byte pieces together as UTF-8.

Defined cases: null texts are empty; empty texts have no ids; an empty table gives no rows; null keys and repeated rows
stay; ties of scores go to the left; columns besides key and text are passed over, whatever their names; a long text
without a space is one segment, merged with a heap in n log n. Models other than BPE, and models with user-defined or
unused pieces, are refused.
"""

from __future__ import annotations

import functools
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, list_array, table

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # kinds of pieces in a model file
BPE = 2
KNOWN = 300_000
LONG = 64
TOGETHER = 4096  # segments merged at a time, of like lengths
TEXTS_CHARS = 1_000_000  # of the texts encoded at a time
SIDE = 1 << 22  # symbols are below it
GAP = SIDE - 1  # no symbol
NONE = 1 << 40  # the rank of a pair that makes no piece
CHARACTERS = 0x110000


def fields(blob: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message in the protobuf wire format: varints as int, everything else as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = blob[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(blob):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, blob[at : at + size]
        at += size


class CharMap:
    """The compiled character map: a double array of 32-bit units over UTF-8 bytes, then the replacements it points to."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.targets = blob[4 + size :]
        self.alone: dict[str, str | None] = {}  # replacement of characters after which no longer source can follow

    def _step(self, node: int, byte: int) -> int | None:
        to = node ^ byte
        if to >= len(self.units) or self.units[to] & 0x800000FF != byte:
            return None
        unit = self.units[to]
        return to ^ ((unit >> 10) << ((unit & 512) >> 6))

    def _target(self, node: int) -> str:
        begin = self.units[node] & 0x7FFFFFFF
        return self.targets[begin : self.targets.index(b"\0", begin)].decode()

    def longest(self, raw: bytes, at: int) -> tuple[str | None, int]:
        """Replacement of the longest known source at ``at`` and its bytes; (None, 0) if there is none."""
        unit = self.units[0]
        node, best = (unit >> 10) << ((unit & 512) >> 6), (None, 0)
        for i in range(at, len(raw)):
            byte = raw[i]
            has = node ^ byte
            if (to := self._step(node, byte)) is None:
                break
            if self.units[has] >> 8 & 1:
                best = (to, i + 1 - at)
            node = to
        return (self._target(best[0]), best[1]) if best[1] else best

    def _final(self, raw: bytes) -> bool:
        """Whether no source longer than the character ``raw`` begins with it."""
        unit = self.units[0]
        node: int | None = (unit >> 10) << ((unit & 512) >> 6)
        for byte in raw:
            if (node := self._step(node, byte)) is None:
                return True
        return all(self._step(node, b) is None for b in range(1, 256))

    def apply(self, text: str) -> Iterator[tuple[str, int]]:
        """(replacement, bytes of source) from left to right."""
        raw, at, i = text.encode(), 0, 0
        while i < len(text):
            c = text[i]
            own = len(c.encode())
            if c not in self.alone and self._final(raw[at : at + own]):
                self.alone[c] = self.longest(raw[at : at + own], 0)[0]
            if c in self.alone:
                to, size = self.alone[c], own
            else:
                to, size = self.longest(raw, at)
            if to is None:
                to, size = c, own
            yield to, size
            i += len(raw[at : at + size].decode())
            at += size


def _cuts(pieces: dict[str, int]) -> re.Pattern:
    """Segments that no piece spans: characters are of one kind if pieces hold them side by side, and a space mark is only
    held with what follows it. Where some piece holds a mark after another character, the text is one segment."""
    if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces):
        return re.compile("(?s).+")
    kind: dict[str, str] = {}

    def of(c: str) -> str:
        while (up := kind.setdefault(c, c)) != c:
            kind[c] = kind[up]
            c = kind[c]
        return c

    for p in pieces:
        held = p.replace(SPACE, "")
        for a, b in zip(held, held[1:], strict=False):
            kind[of(a)] = of(b)
        if len(p) > 1 and held:
            of(held[0])
    groups: dict[str, list[str]] = {}
    for c in sorted(kind):
        groups.setdefault(of(c), []).append(re.escape(c))
    each = [f"{SPACE}*[{''.join(g)}]+" for g in sorted(groups.values(), key=len, reverse=True)]
    return re.compile("|".join([*each, f"{SPACE}+", "(?s:.)"]))


class Model:
    """What a model file says, ready to encode and decode."""

    def __init__(self, blob: bytes):
        self.pieces: list[str] = []
        scores, self.kinds = [], []
        spec: dict[int, int | bytes] = {}
        norm: dict[int, int | bytes] = {}
        for number, value in fields(blob):
            if number == 1:
                x = dict(fields(value))
                self.pieces.append(x.get(1, b"").decode())
                scores.append(struct.unpack("<f", x[2])[0] if 2 in x else 0.0)
                self.kinds.append(x.get(3, NORMAL))
            elif number == 2:
                spec |= dict(fields(value))
            elif number == 3:
                norm |= dict(fields(value))
        if spec.get(3, 1) != BPE or not set(self.kinds) <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only BPE models without user-defined and unused pieces are supported")
        self.suffix, self.fallback = bool(spec.get(24, 0)), bool(spec.get(35, 0))
        self.unknown_surface = spec.get(44, " ⁇ ".encode()).decode()
        self.unknown = self.kinds.index(UNKNOWN)
        self.map = CharMap(norm.get(2, b""))
        self.dummy, self.strip, self.escape = (bool(norm.get(i, 1)) for i in (3, 4, 5))
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        order = {x: r for r, x in enumerate(sorted({scores[i] for i in self.ids.values()}, reverse=True))}
        self.ranks = {p: order[scores[i]] for p, i in self.ids.items()}
        self.bytes_ids = [self.pieces.index(f"<0x{b:02X}>") for b in range(256)] if self.fallback else []
        self.segments = _cuts(self.ids)
        # A symbol is the id of a piece, or that of a character without one: its code point beyond the last id.
        self.symbol = np.arange(CHARACTERS, dtype=np.int64) + len(self.pieces)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        pairs = {}
        for p, i in self.ids.items():
            for at in range(1, len(p)):
                left, right = (self.ids.get(x, int(self.symbol[ord(x)]) if len(x) == 1 else None) for x in (p[:at], p[at:]))
                if left is not None and right is not None:
                    pairs[left * SIDE + right] = i
        self.pairs = np.array(sorted(pairs), np.int64)
        self.joined = np.array([pairs[k] for k in self.pairs.tolist()], np.int64)
        self.joined_rank = np.array([self.ranks[self.pieces[i]] for i in self.joined.tolist()], np.int64)
        self.code = np.array([(i << 32) + len(p) for i, p in enumerate(self.pieces)], np.int64)
        self.known: dict[str, bytes] = {}
        self.silent = np.array([k == CONTROL for k in self.kinds])
        self.surfaces = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for i, kind in enumerate(self.kinds):
            if kind in (UNKNOWN, CONTROL):
                self.surfaces[i] = self.unknown_surface.encode() if kind == UNKNOWN else b""
            elif kind == BYTE:
                self.surfaces[i] = bytes([int(self.pieces[i][3:5], 16)])

    def normalize(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and the source byte at which each of its characters begins; one more for the end."""
        mark = SPACE if self.escape else " "
        if not self.map.units and not self.strip:
            if not text:
                return "", np.zeros(1, np.int32)
            at = np.zeros(len(text) + 1, np.int32)
            if text.isascii():
                at[1:] = np.arange(1, len(text) + 1)
            else:
                points = np.frombuffer(text.encode("utf-32-le"), "<u4")
                np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF), out=at[1:])
            out = text.replace(" ", mark)
            if self.dummy:
                return (out + mark, np.append(at, at[-1])) if self.suffix else (mark + out, np.concatenate(([0], at)).astype(np.int32))
            return out, at
        parts = list(self.map.apply(text)) if self.map.units else [(c, len(c.encode())) for c in text]
        done, first = 0, 0
        while self.strip and first < len(parts) and parts[first][0] == " ":
            done += parts[first][1]
            first += 1
        if first == len(parts):
            return "", np.zeros(1, np.int32)
        chars, source = [], []
        if self.dummy and not self.suffix:
            chars.append(mark)
            source.append(done)
        after_space = self.strip
        for to, size in parts[first:]:
            if after_space:
                to = to.lstrip(" ")
            if to:
                chars += to.replace(" ", mark)
                source += [done] * len(to)
                after_space = self.strip and to.endswith(" ")
            done += size
        while self.strip and chars and chars[-1] == mark:
            chars.pop()
            done = source.pop()
        if self.dummy and self.suffix:
            chars.append(mark)
            source.append(done)
        return "".join(chars), np.array([*source, done], np.int32)

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of the piece that two symbols make, NONE if they make none, and its id."""
        if not len(self.pairs):
            return np.full(left.shape, NONE), np.zeros(left.shape, np.int64)
        keys = left * SIDE + right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[at] == keys, self.joined_rank[at], NONE), self.joined[at]

    def _merged(self, segments: list[str]) -> list[bytes]:
        """Codes of segments of about the same length, all merged together: a round joins one pair of every segment, the
        one that makes the piece of the best score, leftmost among equals."""
        sizes = np.array([len(x) for x in segments])
        width = int(sizes.max()) + 1
        state = np.full((len(segments), width), GAP)
        points = np.frombuffer("".join(segments).encode("utf-32-le"), "<u4")
        state[np.arange(width) < sizes[:, None]] = self.symbol[points]
        ranks = self._ranked(state[:, :-1], state[:, 1:])[0]
        live, places = np.arange(len(segments)), np.arange(width)
        out = state.copy()
        while len(live):
            at = ranks.argmin(axis=1)
            more = ranks[np.arange(len(live)), at] < NONE
            out[live[~more]] = state[~more]
            live, state, ranks, at = live[more], state[more], ranks[more], at[more]
            rows = np.arange(len(live))
            new = self._ranked(state[rows, at], state[rows, at + 1])[1]
            state = np.take_along_axis(state, np.minimum(places + (places > at[:, None]), width - 1), 1)
            state[:, -1] = GAP
            state[rows, at] = new
            ranks = np.take_along_axis(ranks, np.minimum(places[:-1] + (places[:-1] > at[:, None]), width - 2), 1)
            ranks[:, -1] = NONE
            ranks[rows, at] = self._ranked(new, state[rows, at + 1])[0]
            inner = at > 0
            ranks[rows[inner], at[inner] - 1] = self._ranked(state[rows[inner], at[inner] - 1], new[inner])[0]
        held = out != GAP
        symbols = out[held]
        ends = np.cumsum(held.sum(axis=1)).tolist()
        plain = (held & (out >= len(self.pieces))).sum(axis=1).tolist()
        code = self.code[np.minimum(symbols, len(self.pieces) - 1)].tobytes()
        return [self._coded(symbols[a:b].tolist()) if odd else code[8 * a : 8 * b] for a, b, odd in zip([0, *ends], ends, plain, strict=False)]

    def _merge_long(self, segment: str) -> list[int]:
        """Symbols of a long segment: linked parts and a heap of pairs."""
        parts, ranks = list(segment), self.ranks
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            if not parts[i] or j >= n or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i] += parts[j]
            parts[j], after[i] = "", after[j]
            if after[j] < n:
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] < n and (r := ranks.get(parts[left] + parts[after[left]])) is not None:
                    heapq.heappush(heap, (r, left, len(parts[left]) + len(parts[after[left]])))
        return [self.ids[p] if p in self.ids else int(self.symbol[ord(p)]) for p in parts if p]

    def _coded(self, symbols: list[int]) -> bytes:
        """Codes of symbols: an id above 32 bits that hold the characters it stands for."""
        out = []
        for i in symbols:
            if i < len(self.pieces):
                out.append(self.code[i])
            elif self.fallback:
                raw = chr(i - len(self.pieces)).encode()
                out += [(self.bytes_ids[b] << 32) + (at == len(raw) - 1) for at, b in enumerate(raw)]
            else:
                out.append((self.unknown << 32) + 1)
        return np.array(out, np.int64).tobytes()

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text its ids, and where each of them begins and ends in the text's UTF-8 bytes."""
        if len(self.known) >= KNOWN:
            self.known.clear()
        known, normal = self.known, [self.normalize(t) for t in texts]
        cut = [self.segments.findall(t) for t, _ in normal]
        new = sorted({x for xs in cut for x in xs if x not in known}, key=len)
        for at in range(0, len(new), TOGETHER):
            some = [x for x in new[at : at + TOGETHER] if len(x) <= LONG]
            known.update(zip(some, self._merged(some) if some else (), strict=True))
        long = [x for x in new if len(x) > LONG]
        known.update((x, self._coded(self._merge_long(x))) for x in long)
        out = []
        for xs, (_, source) in zip(cut, normal, strict=True):
            codes = np.frombuffer(b"".join(map(known.__getitem__, xs)), np.int64)
            ids, ends = (codes >> 32).astype(np.int32), np.cumsum(codes & 0xFFFFFFFF)
            begins = np.concatenate(([0], ends[:-1])) if len(ends) else ends
            if not self.fallback and len(ids):  # unknown pieces in a row are one
                first = np.r_[True, (ids[1:] != self.unknown) | (ids[:-1] != self.unknown)]
                ids, begins, ends = ids[first], begins[first], ends[np.r_[first[1:], True]]
            out.append((ids, source[begins], source[ends]))
        for x in long:
            del known[x]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, as it stood after normalisation."""
        strips = len(ids) > 0 and (self.dummy or self.strip) and self.kinds[ids[0]] == NORMAL and self.pieces[ids[0]].startswith(SPACE)
        if not (strips and self.strip) and not self.silent[ids].any():
            try:  # byte pieces stand together here, so the joined bytes are text if each run of them is
                return b"".join(map(self.surfaces.__getitem__, ids.tolist()))[strips:].decode()
            except UnicodeDecodeError:
                pass
        out, run, begun, seen = [], bytearray(), True, False
        for i in [*ids.tolist(), None]:
            if i is not None and self.kinds[i] == BYTE:
                run += self.surfaces[i]
                continue
            while run:  # each byte that is no part of a character becomes a replacement mark
                size = next((n for n in range(1, 5) if _is_character(bytes(run[:n]))), 0)
                out.append(run[:size].decode() if size else "�")
                del run[: size or 1]
            if i is None:
                break
            if seen or any(out):
                begun = False
            surface, seen = self.surfaces[i].decode(), False
            if begun and (self.dummy or self.strip) and self.kinds[i] == NORMAL and surface.startswith(" "):
                surface, seen = surface[1:], not self.strip
            out.append(surface)
        return "".join(out)


def _is_character(raw: bytes) -> bool:
    try:
        return len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


@functools.lru_cache(2)
def model_of(blob: bytes) -> Model:
    """A model, read once in a process: Python workers serve many tasks."""
    return Model(blob)


def load(path: str) -> Model:
    with open(path, "rb") as f:
        return model_of(f.read())


def slices(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    """Keys and texts of a batch, about ``TEXTS_CHARS`` characters at a time."""
    keys, texts, held = [], [], 0
    for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        keys.append(k)
        texts.append(t.as_py())
        held += len(texts[-1])
        if held >= TEXTS_CHARS:
            yield keys, texts
            keys, texts, held = [], [], 0
    if keys:
        yield keys, texts


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: key, ids, begins and ends (arrays of integers, a place for each piece)."""
    with open(path, "rb") as f:
        blob = f.read()
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(text, F.lit("")).alias("text"))

    def run(batches):
        model = model_of(blob)
        for batch in batches:
            for keys, texts in slices(batch):
                done = model.encode(texts)
                arrays = [list_array(np.concatenate([d[i] for d in done]), [len(d[0]) for d in done]) for i in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *arrays], names=["key", "ids", "begins", "ends"])

    coded = bounded(rows).mapInArrow(run, "key long, ids array<int>, begins array<int>, ends array<int>")
    return coded.select(F.col("key").alias(key), "ids", "begins", "ends")


def decode_documents(coded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``coded`` with the text of its ids; null ids give null."""
    with open(path, "rb") as f:
        blob = f.read()

    @F.pandas_udf("string")
    def texts(column: pd.Series) -> pd.Series:
        model = model_of(blob)
        return pd.Series([None if x is None else model.decode(np.asarray(x, np.int64)) for x in column], dtype=object)

    return bounded(coded).withColumn(out, texts(ids))


def op12_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    coded = decode_documents(encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), path), path)
    # Every source byte belongs to one piece, so the spans' bytes are the text's.
    covered = F.aggregate(F.zip_with("ends", "begins", lambda e, b: (e - b).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), covered.alias("span_bytes"))
