"""Texts against a table of terms: one reading of each text finds every occurrence of every term.

The terms become an Aho-Corasick automaton in flat arrays: the keys of its goto table (state and character class, sorted)
with the states they lead to, a fail state for each state, and for each state the term that ends there and the next
shorter one. It goes to the executors by broadcast, after the terms' bytes are counted; a lexicon over ``LEXICON_CHARS`` is
cut by hash into several automata, each a pass of its own. Python workers step many stretches of text at once: a stretch
starts early by the longest term, so no occurrence is cut. The work follows the text, not the number of terms.

An occurrence may be asked to stand between word boundaries (as ``\\b`` has them) or between white space. The result is a
column of the row, without a shuffle; picks by list order or by length read that column.

Defined cases: null texts have no occurrences; empty and null terms are passed over; of terms that are written alike the
first in order stays; overlapping occurrences are all found; an empty lexicon finds nothing; positions count characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEXICON_CHARS = 20_000_000  # of the terms of one automaton
MOST_CHARS = 200_000_000  # of all terms: their list goes through the driver
STRETCH = 512
FOUND = "array<struct<term:int,at:int,size:int>>"
ANYWHERE, WORDS, SPACES = "anywhere", "words", "spaces"


class Automaton:
    """Goto, fail and output tables of terms; term numbers are places in the list."""

    def __init__(self, terms: list[str]):
        self.longest = max(map(len, terms), default=0)
        letters = sorted(set("".join(terms)))
        self.letters = np.array([ord(c) for c in letters], np.int64)
        self.classes = len(letters) + 1  # 0 is of characters that no term has
        own = {c: i + 1 for i, c in enumerate(letters)}
        child: dict[int, int] = {}
        ends, depth = {}, [0]
        for n, term in enumerate(terms):
            state = 0
            for c in term:
                key = state * self.classes + own[c]
                if (to := child.get(key)) is None:
                    to = child[key] = len(depth)
                    depth.append(depth[state] + 1)
                state = to
            ends.setdefault(state, n)
        order = np.argsort(np.fromiter(child.keys(), np.int64, len(child)))
        self.keys = np.fromiter(child.keys(), np.int64, len(child))[order]
        self.to = np.fromiter(child.values(), np.int64, len(child))[order]
        self.depth = np.array(depth, np.int64)
        self.term = np.full(len(depth), -1, np.int64)
        self.term[list(ends.keys())] = list(ends.values())
        self.fail = np.zeros(len(depth), np.int64)
        self.shorter = np.zeros(len(depth), np.int64)  # the longest proper suffix at which a term ends; 0 is none
        by_child = np.argsort(self.depth[self.to], kind="stable")
        levels = np.split(by_child, np.flatnonzero(np.diff(self.depth[self.to][by_child])) + 1) if len(child) else []
        for level in levels:  # a level at a time: the fail states of the one above are known
            parents, classes, states = self.keys[level] // self.classes, self.keys[level] % self.classes, self.to[level]
            found = self.step(self.fail[parents], classes)
            found[parents == 0] = 0
            self.fail[states] = found
            self.shorter[states] = np.where(self.term[found] >= 0, found, self.shorter[found])

    def step(self, states: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """The states after one more character each."""
        out = np.zeros(len(states), np.int64)
        at = np.arange(len(states))
        if not len(self.keys):
            return out
        while len(at):
            keys = states * self.classes + classes
            place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[place] == keys
            out[at[hit]] = self.to[place[hit]]
            more = ~hit & (states > 0) & (classes > 0)
            at, states, classes = at[more], self.fail[states[more]], classes[more]
        return out

    def classes_of(self, points: np.ndarray) -> np.ndarray:
        if not len(self.letters):
            return np.zeros(len(points), np.int64)
        place = np.minimum(np.searchsorted(self.letters, points), len(self.letters) - 1)
        return np.where(self.letters[place] == points, place + 1, 0)

    def find(self, texts: list[str], stand: str = ANYWHERE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, begin) of every occurrence, in the order of texts and of their ends."""
        sizes = np.array([len(t) for t in texts], np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        begins = np.cumsum(sizes) - sizes
        many = -(-sizes // STRETCH)
        text = np.repeat(np.arange(len(texts)), many)
        first = begins[text] + STRETCH * (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many))
        last = np.minimum(first + STRETCH, (begins + sizes)[text])
        early = np.maximum(first - max(0, self.longest - 1), begins[text])
        classes = self.classes_of(points)
        states, hits = np.zeros(len(text), np.int64), []
        for i in range(int((last - early).max(initial=0))):
            live = np.flatnonzero(early + i < last)
            at = early[live] + i
            now = states[live] = self.step(states[live], classes[at])
            now = np.where(at >= first[live], now, 0)  # before its own part a stretch only gathers its state
            now = np.where(self.term[now] >= 0, now, self.shorter[now])
            while len(some := np.flatnonzero(now)):
                live, at, now = live[some], at[some], now[some]
                hits.append((text[live], self.term[now], at + 1 - self.depth[now], at + 1))
                now = self.shorter[now]
        owner, term, begin, end = (np.concatenate([h[j] for h in hits]) if hits else np.zeros(0, np.int64) for j in range(4))
        if stand != ANYWHERE and len(points):
            inner = _inner(points, stand)
            left = (begin > begins[owner]) & inner[begin - 1]
            right = (end < (begins + sizes)[owner]) & inner[np.minimum(end, len(inner) - 1)]
            keep = (left != inner[begin]) & (right != inner[end - 1]) if stand == WORDS else ~left & ~right
            owner, term, begin, end = owner[keep], term[keep], begin[keep], end[keep]
        order = np.lexsort((begin, end, owner))
        return owner[order], term[order], (begin - begins[owner])[order]


def _inner(points: np.ndarray, stand: str) -> np.ndarray:
    """Whether each character is of a word, or is no white space."""
    kinds, place = np.unique(points, return_inverse=True)
    of = (lambda c: c == "_" or c.isalnum()) if stand == WORDS else (lambda c: not c.isspace())
    return np.array([of(chr(int(c))) for c in kinds], bool)[place] if len(points) else np.zeros(0, bool)


def with_occurrences(df: DataFrame, text: str, terms: DataFrame, term: str = "term", order: str = "pos", stand: str = ANYWHERE, out: str = "found", lexicon_chars: int = LEXICON_CHARS) -> tuple[DataFrame, list[str]]:
    """``df`` with ``out``, every occurrence in ``text`` of the terms of a table, and the terms by number.

    Terms are numbered by ``order``, then by their text; the table is counted before it is read to the driver, and sent
    to the executors in parts of at most ``lexicon_chars`` characters, however many that takes.
    """
    clean = terms.where(F.length(term) > 0).groupBy(F.col(term).alias("t")).agg(F.min(order).alias("o"))
    total = clean.agg(F.sum(F.length("t"))).first()[0] or 0
    if total > MOST_CHARS:
        raise ValueError(f"a lexicon of {total} characters is no lexicon: join its terms as rows")
    parts = max(1, -(-total // lexicon_chars))
    listed = [r.t for r in clean.orderBy("o", "t").toLocalIterator()]
    spark = df.sparkSession
    column: Column = F.array().cast(FOUND)
    for part in range(parts):
        numbers = [n for n in range(len(listed)) if n % parts == part]
        held = spark.sparkContext.broadcast((Automaton([listed[n] for n in numbers]), np.array(numbers, np.int64)))
        column = F.concat(column, _finder(held, stand)(text))
    return df.withColumn(out, F.array_sort(column, lambda a, b: F.when(a["at"] != b["at"], a["at"] - b["at"]).otherwise(a["size"] - b["size"]))), listed


def _finder(held, stand: str):
    @F.pandas_udf(FOUND)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton, numbers = held.value
        sizes = np.zeros(len(numbers), np.int64)
        ends = automaton.term >= 0
        sizes[automaton.term[ends]] = automaton.depth[ends]
        for texts in batches:
            owner, term, begin = automaton.find(["" if t is None else t for t in texts], stand)
            bounds = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
            rows = list(zip(numbers[term].tolist(), begin.tolist(), sizes[term].tolist(), strict=True))
            yield pd.Series([[{"term": n, "at": a, "size": s} for n, a, s in rows[x:y]] for x, y in zip(bounds, bounds[1:], strict=False)], dtype=object)

    return found


def first_by_order(found: str | Column) -> Column:
    """Number of the found term that stands first in the lexicon; null if none was found."""
    return F.array_min(F.transform(found, lambda x: x["term"]))


def longest(found: str | Column) -> Column:
    """Number of the longest found term, among equals the one that stands first in the lexicon."""
    return -F.array_max(F.transform(found, lambda x: F.struct(x["size"].alias("size"), (-x["term"]).alias("term"))))["term"]


def occurrences(df: DataFrame, key: str, text: str, terms: DataFrame, term: str = "term", order: str = "pos", stand: str = ANYWHERE) -> DataFrame:
    """key, term, at: a row an occurrence."""
    rows, listed = with_occurrences(df.select(key, text), text, terms, term, order, stand)
    names = df.sparkSession.createDataFrame(pd.DataFrame({"n": np.arange(len(listed), dtype=np.int32), "term": listed}), "n int, term string")
    flat = rows.select(key, F.explode("found").alias("x")).select(key, F.col("x.term").alias("n"), F.col("x.at").alias("at"))
    return flat.join(names, "n").select(key, "term", "at")
