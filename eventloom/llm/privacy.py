"""Personal data by bootstrapped contextual extraction.

Base identifiers (emails, IP addresses, payment cards, phone numbers) are matched exactly; they and the values that a text
assigns to a name of a secret (``token = "..."``) seed the rest. Every identifier-like occurrence is an instance; the words
and marks around it are its lexical patterns. Spark scores the graph of patterns and instances in turns: a pattern's score
for a kind is the smoothed share of its instances' belief in that kind, and an instance believes a kind by the noisy-or of
its patterns. Instances that no rule matched and that a pattern of ``sure`` confidence surrounds become spans of that kind;
base spans and seeds always stay.

Defined cases: null texts are empty; offsets are code points, ends exclusive; base kinds may overlap each other, and no
other span overlaps a base one; repeated rows share their discoveries; rows without an id are told apart by their text.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, bounded, durable, free_name, row_key, table

BASE = ("email", "ip", "card", "phone")
SECRET = len(BASE)
KINDS = (*BASE, "secret")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LIKE = re.compile(r"[A-Za-z0-9][A-Za-z0-9._/+-]*[A-Za-z0-9]")
_MARK = re.compile(r"\w+|[^\w\s]")  # words and single marks: the lexical material of patterns
_ASSIGNED = re.compile(r"(?:token|secret|passw(?:or)?d|pwd|api[_ -]?key|access[_ -]?key|private[_ -]?key|credential)s?[\"']?\s{0,9}[:=]\s{0,9}[\"']?([A-Za-z0-9][A-Za-z0-9._/+=-]*[A-Za-z0-9=])", re.I)


def _emails(text: str):
    """As the base pattern from the left: an address begins after the one before it, or where its characters do."""
    last = 0
    for m in _DOMAIN.finditer(text):
        at = m.start()
        begin = at
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at:
            yield begin, m.end()
            last = m.end()


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(kind, start, end) of every base identifier, by kind and start."""
    text = text or ""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = "".join(_DIGIT.findall(m[0])) if m.end() - m.start() < 64 else ""
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGIT.findall(m[0])) <= 15:
            out.append((3, *m.span()))
    return out


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def _number(s: str) -> int:
    return xxhash.xxh64_intdigest(s) - 2**63


def secret_seeds(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(SECRET, start, end) of values of eight characters and four digits or more that are assigned to a name of a
    secret and overlap no base span."""
    out = []
    if "=" in text or ":" in text:
        for m in _ASSIGNED.finditer(text):
            a, b = m.span(1)
            if b - a >= 8 and len(_DIGIT.findall(m[1])) >= 4 and all(y <= a or x >= b for _, x, y in base):
                out.append((SECRET, a, b))
    return out


def instances(text: str, base: list[tuple[int, int, int]]):
    """(kind or -1, start, end, instance, patterns) of base spans, seeds and other identifier-like tokens.

    A token is identifier-like with six characters and four digits or more. Patterns: the two and the three words or
    marks before; the one before with the one after.
    """
    found = base + secret_seeds(text, base)
    taken = sorted((a, b) for _, a, b in found)
    at = 0
    if _DIGIT.search(text):
        for m in _LIKE.finditer(text):
            if m.end() - m.start() < 6 or len(_DIGIT.findall(m[0])) < 4:
                continue
            while at < len(taken) and taken[at][1] <= m.start():
                at += 1
            if all(b <= m.start() or a >= m.end() for a, b in taken[max(0, at - 4) :]):
                found.append((-1, *m.span()))
    if not found:
        return
    marks = list(_MARK.finditer(text))
    ends, begins = [m.end() for m in marks], [m.start() for m in marks]
    for k, a, b in found:
        i, j = bisect_right(ends, a), bisect_left(begins, b)
        before = [m[0].lower() for m in marks[max(0, i - 3) : i]]
        after = marks[j][0].lower() if j < len(marks) else None
        patterns = [_number(f"{n}|" + " ".join(before[-n:])) for n in (2, 3) if len(before) >= n]
        if before and after is not None:
            patterns.append(_number(f"1|{before[-1]}|{after}"))
        if patterns:
            yield k, a, b, _number(text[a:b].lower()), patterns


def read_documents(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row a document: doc_id, row, base, seeds (of secrets) and found, the instances."""

    def rows(columns):
        for i, row, t in zip(*columns, strict=True):
            base = base_spans(t)
            seeds = secret_seeds(t or "", base)
            yield i, row, [{"kind": k, "start": a, "end": b} for k, a, b in base], [{"kind": k, "start": a, "end": b} for k, a, b in seeds], [{"kind": k, "start": a, "end": b, "instance": x, "patterns": ps} for k, a, b, x, ps in instances(t or "", base)]

    span = [("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]
    return arrow_map(
        docs.select(F.col(key).cast("long").alias("doc_id"), row_key(key, text).alias("row"), F.col(text).alias("text")), rows,
        "doc_id long, row string, base array<struct<kind:int,start:long,end:long>>, seeds array<struct<kind:int,start:long,end:long>>, found array<struct<kind:int,start:long,end:long,instance:long,patterns:array<long>>>",
        ["doc_id", "row", "base", "seeds", "found"],
        [pa.int64(), pa.string(), pa.list_(pa.struct(span)), pa.list_(pa.struct(span)), pa.list_(pa.struct([*span, ("instance", pa.int64()), ("patterns", pa.list_(pa.int64()))]))],
    )


def sure_patterns(places: DataFrame, rounds: int = 3, kept: float = 0.5, sure: float = 0.8, doubt: float = 3.0) -> DataFrame:
    """(pattern, kind) of score ``sure`` or more, from rows (pattern, instance, kind; -1 if no rule matched).

    An instance that a rule matched anywhere is a seed wherever it stands, so it teaches its other patterns.

    A score is the sum of its instances' beliefs over their number plus ``doubt``, so a pattern needs a dozen instances
    that agree. Patterns below ``kept`` tell their instances nothing in the next turn.
    """
    met = durable(places.groupBy("pattern", "instance").agg(F.max("kind").alias("seed")))
    edges = durable(met.drop("seed").join(met.groupBy("instance").agg(F.max("seed").alias("seed")), "instance"))
    size = edges.groupBy("pattern").agg((F.count("*") + doubt).alias("n"))
    belief = edges.where("seed >= 0").select("pattern", "instance", F.col("seed").alias("kind"), F.lit(1.0).alias("p"))
    unknown = edges.where("seed < 0").select("pattern", "instance")
    seeds = belief
    for turn in range(rounds):
        score = belief.groupBy("pattern", "kind").agg(F.sum("p").alias("s")).join(size, "pattern").select("pattern", "kind", (F.col("s") / F.col("n")).alias("score")).where(F.col("score") >= kept)
        if turn == rounds - 1:
            return score.where(F.col("score") >= sure).select("pattern", "kind")
        told = unknown.join(score, "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("score") * 0.999)))).alias("p"))
        belief = seeds.unionByName(unknown.join(told, "instance").select("pattern", "instance", "kind", "p"))
    return None


def discovered(read: DataFrame) -> DataFrame:
    """row, extra: the spans that sure patterns add, by kind and start; a span takes the first of its kinds."""
    places = durable(read.select("row", F.explode("found").alias("f")).select("row", "f.*").select("row", "kind", "start", "end", "instance", F.explode("patterns").alias("pattern")))
    sure = sure_patterns(places)
    spans = places.where("kind < 0").drop("kind").join(sure, "pattern").groupBy("row", "start", "end").agg(F.min("kind").cast("int").alias("kind"))
    return spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end"))).alias("extra"))


def find_private(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, row, base and spans (arrays of kind, start, end)."""
    read = durable(read_documents(docs, key, text))
    extra = F.coalesce("extra", F.array().cast("array<struct<kind:int,start:long,end:long>>"))
    return read.select("doc_id", "row", "base", "seeds").join(discovered(read), "row", "left").select("doc_id", "row", "base", F.sort_array(F.concat("base", "seeds", extra)).alias("spans"))


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in brackets; overlapping spans become one, named by the first."""
    known = discovered(durable(read_documents(docs, key, text).select("row", "found")))

    def masked(t: str | None, extra) -> str | None:
        base = base_spans(t) if t else []
        spans = [(a, b, k) for k, a, b in base + secret_seeds(t or "", base)]
        spans = sorted(spans + [(x["start"], x["end"], x["kind"]) for x in extra or []])
        out, at, until = [], 0, 0
        for a, b, k in spans:
            if a >= until:
                out += [t[at:a], f"[{KINDS[k].upper()}]"]
            until = max(until, b)
            at = until
        return t if not spans else "".join([*out, t[at:]])

    @F.pandas_udf("string")
    def mask(texts, extras):
        import pandas as pd

        return pd.Series([masked(t, x) for t, x in zip(texts, extras, strict=True)], dtype=object)

    spare, row = free_name(docs, "__extra"), free_name(docs, "__row")
    joined_ = bounded(docs).withColumn(row, row_key(key, text)).join(known.select(F.col("row").alias(row), F.col("extra").alias(spare)), row, "left")
    return joined_.withColumn(text, mask(text, spare)).select(*docs.columns)


def op5_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by base kind, digest of the base spans, all spans; beside them how many spans the method added and all."""
    found = find_private(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array(*[F.lit(k) for k in KINDS])
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(k: int):
        return F.size(F.filter("base", lambda s: s["kind"] == F.lit(k))).cast("long")  # a second parameter would get the place

    return found.select(
        "doc_id", *[count(k).alias(f"n_{n}") for k, n in enumerate(BASE)], F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_added"), F.size("spans").cast("long").alias("n_spans"),
    )
