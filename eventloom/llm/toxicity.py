"""Toxicity by a weighted finite-state pattern grammar.

Five transducers read the class of each word of a clause in lockstep: insult, threat, target, negation and reported
speech. Their composition is compiled lazily to one deterministic machine; the state it ends a clause in names the
pattern that the clause matched, such as a targeted insult or a denied one. Words alone score nothing; clauses do.
The weights of the patterns start from stated priors and are fitted by a penalised logistic regression on a bounded
sample of labelled rows (``sample`` rows, default 20,000, taken in the order of a hash); the same rows teach insult
words and stems beyond the stated lexicon.

Defined cases: null and empty texts score as texts without any match; repeated rows are scored each; labels without a key
or value are passed over, of several labels of a key the highest counts; without labels or with one class the priors hold;
an empty table gives no rows; an input column with the name of the score's is replaced, other columns stay.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, durable, table

# The word classes of the grammar.
INSULT = """idiot idiots idiotic moron morons moronic stupid scum trash garbage loser losers clown clowns pathetic worthless
disgusting imbecile imbeciles dumb dumbass fool fools foolish scumbag creep creeps freak freaks pig pigs vermin parasite
parasites filth filthy cretin jerk jerks bastard bastards asshole assholes bitch whore slut retard retarded degenerate
idiota idiotas imbécil estúpido estúpida basura asqueroso asquerosa inútil imbécile stupide ordure minable dégoûtant
abruti connard dumm idioten abschaum versager widerlich erbärmlich wertlos trottel dummkopf""".split()
THREAT = """kill kills murder destroy hurt beat burn shoot stab strangle hang die crush smash attack exterminate punish
matar morir tuer mourir détruire töten sterben vernichten""".split()
TARGET = """you your yours yourself u ur he she him her they them their these those people everyone
tú usted ustedes vosotros vous toi tu ils elles du dich ihr euch sie""".split()
NEGATION = """not no never neither nor isn't aren't wasn't weren't don't doesn't didn't won't can't cannot nobody hardly
nunca jamás ne pas jamais nicht kein keine nie""".split()
REPORT = """said says say saying told tells wrote writes called calls quoted quotes reported reports claimed claims alleged
according testified dijo dicho dit disait sagte berichtet""".split()

CLASSES = {w: k for k, words in (("I", INSULT), ("T", THREAT), ("Y", TARGET), ("N", NEGATION), ("R", REPORT)) for w in words}
PATTERNS = ("targeted insult", "insult", "targeted threat", "denied", "reported")
PRIOR = np.array([-2.5, 5.0, 4.0, 5.0, 0.3, 0.6])  # bias, then one weight for each pattern
LOOK_BACK = 3  # words that a negation reaches forward
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_CLAUSE = re.compile(r"[.!?;:\n\r ]+|,\s")
_PART = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[\"“”«»]")


def _insult(state: str, symbol: str) -> str:
    return "seen" if symbol == "I" else state


def _threat(state: str, symbol: str) -> str:
    return "seen" if symbol == "T" else state


def _target(state: str, symbol: str) -> str:
    return "seen" if symbol == "Y" else state


def _negation(state: int, symbol: str) -> int:
    """Counts down from LOOK_BACK after a negation; below zero once a core word fell inside its reach."""
    if state < 0:
        return state
    if symbol == "N":
        return LOOK_BACK
    if symbol in "IT" and state:
        return -1
    return max(0, state - 1)


def _reported(state: str, symbol: str) -> str:
    """Speech of someone else: after a verb of saying, or between quotation marks that opened before the core word."""
    if symbol == "R" and state in ("own", "quote"):
        return "other"
    if symbol == "Q":
        return {"own": "quote", "quote": "own"}.get(state, state)
    if symbol in "IT" and state in ("quote", "other"):
        return "reported"
    return state


START = ("no", "no", "no", 0, "own")
_MACHINES = (_insult, _threat, _target, _negation, _reported)
_arcs: dict[tuple, tuple] = {}


def step(state: tuple, symbol: str) -> tuple:
    """An arc of the composed machine, compiled when it is first taken."""
    to = _arcs.get((state, symbol))
    if to is None:
        to = _arcs[state, symbol] = tuple(m(s, symbol) for m, s in zip(_MACHINES, state, strict=True))
    return to


def final(state: tuple) -> int | None:
    """The pattern that a clause ending in this state has matched."""
    insult, threat, target, negation, reported = state
    if insult == "no" and (threat == "no" or target == "no"):
        return None
    if negation < 0:
        return 3
    if reported == "reported":
        return 4
    if threat == "seen" and target == "seen":
        return 2
    return 0 if target == "seen" else 1


class Lexicon:
    """Word classes and core-word weights: the stated ones, plus insults and insult stems learnt from labelled rows."""

    def __init__(self, words: dict[str, float] | None = None, stems: dict[str, float] | None = None):
        self.weights = {w: 1.0 for w in INSULT + THREAT} | (words or {})
        self.stems = stems or {}
        self.lengths = sorted({len(x) for x in self.stems})
        self.cores = frozenset(self.weights)

    def read(self, word: str) -> tuple[str | None, float]:
        """The arc that a word takes: its class, and its weight if it is a core word."""
        if word in self.weights:
            return ("T" if CLASSES.get(word) == "T" else "I"), self.weights[word]
        if word in CLASSES:
            return CLASSES[word], 0.0
        for n in self.lengths:
            if word[:n] in self.stems:
                return "I", self.stems[word[:n]]
        return None, 0.0

    def has_core(self, text: str) -> bool:
        words = set(_WORD.findall(text))
        return not self.cores.isdisjoint(words) or any(w[:n] in self.stems for n in self.lengths for w in words)

    def clauses(self, text: str | None) -> list[float]:
        """Summed core weights of the matched clauses of the whole text, by pattern."""
        sums = [0.0] * len(PATTERNS)
        low = (text or "").lower().replace("’", "'")
        if not self.has_core(low):
            return sums
        for clause in _CLAUSE.split(low):
            state, weight = START, 0.0
            for w in _PART.findall(clause):
                symbol, gain = ("Q", 0.0) if len(w) == 1 and not w.isalnum() else self.read(w)
                if symbol:
                    state = step(state, symbol)
                    weight += gain
            if weight and (k := final(state)) is not None:
                sums[k] += weight
        return sums

    def features(self, text: str | None) -> list[float]:
        return [math.log1p(x) for x in self.clauses(text)]


def fit(rows: np.ndarray, labels: np.ndarray, counts: np.ndarray, strength: float = 0.3, rounds: int = 60) -> np.ndarray:
    """Of rows that stand for ``counts`` documents each. Newton steps of a logistic regression whose penalty pulls towards PRIOR; without two classes, PRIOR itself."""
    w = PRIOR.copy()
    if len(labels) == 0 or labels.min() == labels.max():
        return w
    x = np.hstack([np.ones((len(rows), 1)), rows])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (counts * (p - labels)) + strength * (w - PRIOR)
        hess = (x * (counts * p * (1 - p))[:, None]).T @ x + strength * np.eye(x.shape[1])
        move = np.linalg.solve(hess, grad)
        w = w - np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-9:
            break
    w[1:] = np.maximum(w[1:], 0)
    return w


def _counted(docs: DataFrame, find, dedupe: bool) -> DataFrame:
    """(term, pos, neg) over labelled rows: rows having the term, or with ``dedupe`` its distinct word neighbourhoods.

    Copies of a text repeat its neighbourhoods, so a group of copies counts about once. Tasks add up before the shuffle.
    """

    def rows(batches):
        got: dict[tuple, list[int]] = {}
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for key in find(_WORD.findall((text or "").lower().replace("’", "'"))):
                    got.setdefault(key, [0, 0])[1 - toxic] += 1
        keys = list(got)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array([v[0] for v in got.values()], pa.int64()), pa.array([v[1] for v in got.values()], pa.int64())],
            names=["term", "place", "pos", "neg"],
        )

    out = bounded(docs).select("text", "toxic").mapInArrow(rows, "term string, place long, pos long, neg long")
    if dedupe:
        out = out.groupBy("term", "place").agg((F.sum("pos") > 0).cast("long").alias("pos"), ((F.sum("neg") > 0) & (F.sum("pos") == 0)).cast("long").alias("neg"))
    return out.groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _places(words: list[str], wanted) -> set[tuple[str, int]]:
    """(term, hash of the two neighbours) of each word for which ``wanted`` names terms."""
    out = set()
    for i, w in enumerate(words):
        for term in wanted(w):
            out.add((term, zlib.crc32(f"{words[i - 1] if i else ''} {words[i + 1] if i + 1 < len(words) else ''}".encode())))
    return out


def learn_lexicon(docs: DataFrame, least: int = 5, purity: float = 0.9, stem_words: int = 4) -> Lexicon:
    """Insult words, and stems that several of them share, of the labelled rows ``docs`` (text, toxic).

    A word is learnt if it stands in ``least`` distinct neighbourhoods of toxic rows and they are ``purity`` of all;
    a stem likewise, with four times as many. All words of the rows are weighed; the caller bounds the rows.
    """
    few = _counted(docs, lambda ws: {(w, 0) for w in ws}, False).where((F.col("pos") >= least) & (F.col("pos") >= 0.6 * (F.col("pos") + F.col("neg"))))
    candidates = frozenset(r.term for r in few.select("term").collect())
    if not candidates:
        return Lexicon()
    weight = lambda r: min(1.0, math.log((r.pos + 0.5) / (r.neg + 0.5)) / 5)
    good = lambda n: (F.col("pos") >= n) & (F.col("pos") >= purity * (F.col("pos") + F.col("neg")))
    own = lambda w: (w,) if w in candidates else ()
    words = {r.term: weight(r) for r in _counted(docs, lambda ws: _places(ws, own), True).where(good(least)).collect()}
    shared = Counter(w[:n] for w in words for n in range(3, len(w)))
    heads = frozenset(x for x, n in shared.items() if n >= stem_words)
    stems: dict[str, float] = {}
    if heads:
        sizes = sorted({len(x) for x in heads})
        begins = lambda w: [w[:n] for n in sizes if w[:n] in heads]
        stems = {r.term: weight(r) for r in _counted(docs, lambda ws: _places(ws, begins), True).where(good(4 * least)).collect()}
        longest = lambda x: not any(y != x and y.startswith(x) and shared[y] >= 0.8 * shared[x] for y in stems)
        stems = {x: w for x, w in stems.items() if longest(x)}
    return Lexicon(words, stems)


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> tuple[Lexicon, np.ndarray]:
    """Lexicon and pattern weights from at most ``sample`` labelled rows.

    The sampled keys, bounded so, are what the join broadcasts. Labels with a null key or value are passed over; of
    several labels of a key the highest counts. The caller chooses which rows may be learnt from.
    """
    few = (
        labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    rows = durable(docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("text", F.col("toxic").cast("long").alias("toxic")))
    lexicon = learn_lexicon(rows)

    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        return texts.map(lexicon.features)

    seen = rows.groupBy(measured("text").alias("x"), "toxic").count().collect()
    x = np.array([r.x for r in seen]).reshape(len(seen), len(PATTERNS))
    return lexicon, fit(x, np.array([r.toxic for r in seen], dtype=float), np.array([r["count"] for r in seen], dtype=float))


def score(docs: DataFrame, model: tuple[Lexicon, np.ndarray], text: str = "text", out: str = "score") -> DataFrame:
    """Add ``out``, 0 to 1, from the text alone. Null and empty texts get the score of a text without any match."""
    lexicon, w = model[0], [float(x) for x in model[1]]

    def one(t):
        z = w[0] + sum(a * b for a, b in zip(w[1:], lexicon.features(t), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return bounded(docs).withColumn(out, scored(F.coalesce(F.col(text), F.lit(""))))


def fold(key: str = "doc_id"):
    """True for the held-out third: crc32 of the key as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; learns only from rows outside the held-out fold. Null doc_id: not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = train(docs, labels.where(~fold()))
    return score(docs.withColumn("held_out", fold()), model).select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
