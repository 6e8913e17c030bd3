"""Tables of terms and of domains against brute force."""

import random
import re
import time

import numpy as np
import pytest

from eventloom.operators import lexicon_join as J
from eventloom.operators import suffix_join as S
from pyspark.sql import functions as F


def brute(texts, terms, stand):
    out = []
    for i, t in enumerate(texts):
        for n, term in enumerate(terms):
            if n != terms.index(term):
                continue
            p = {"anywhere": f"(?={re.escape(term)})", "words": rf"(?<!\w)(?=\w)(?={re.escape(term)})", "spaces": rf"(?<!\S)(?={re.escape(term)}(?!\S))"}[stand]
            if stand == "words":
                hits = [a for a in range(len(t)) if t.startswith(term, a) and boundary(t, a) and boundary(t, a + len(term))]
            else:
                hits = [m.start() for m in re.finditer(p, t)]
            out += [(i, n, a) for a in hits]
    return sorted(out)


def boundary(t, at):
    word = lambda c: c == "_" or c.isalnum()
    return (at > 0 and word(t[at - 1])) != (at < len(t) and word(t[at]))


@pytest.mark.parametrize("stand", ["anywhere", "words", "spaces"])
def test_automaton_equals_brute_force(stand, monkeypatch):
    rng = random.Random(1)
    monkeypatch.setattr(J, "STRETCH", 7)
    for _ in range(60):
        letters = rng.choice(["ab", "ab c.", "aé_-1 \U0001f600\n"])
        word = lambda n: "".join(rng.choice(letters) for _ in range(rng.randint(1, n)))
        terms, texts = [word(9) for _ in range(rng.randint(0, 25))], ["", *[word(60) for _ in range(8)]]
        owner, term, begin = J.Automaton(terms).find(texts, stand)
        assert sorted(zip(owner.tolist(), term.tolist(), begin.tolist())) == brute(texts, terms, stand)


def test_work_follows_the_text_not_the_terms():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(5, 12)))
    texts = [" ".join(word() for _ in range(2_000)) for _ in range(60)]
    took = []
    for n in (500, 50_000):
        automaton = J.Automaton([word() for _ in range(n)])
        began = time.process_time()
        automaton.find(texts)
        took.append(time.process_time() - began)
    assert took[1] < 6 * took[0]


def test_occurrences_and_picks(spark):
    docs = spark.createDataFrame([(1, "New Delhi and Delhi, not Delhis"), (2, None), (3, ""), (4, "goa Goa"), (4, "x")], "id int, text string")
    terms = spark.createDataFrame([("Delhi", 0), ("New Delhi", 1), ("Goa", 2), ("", 3), (None, 4), ("Goa", 9)], "term string, pos int")
    got = J.occurrences(docs, "id", "text", terms, stand=J.WORDS)
    assert sorted(map(tuple, got.collect())) == [(1, "Delhi", 4), (1, "Delhi", 14), (1, "New Delhi", 0), (4, "Goa", 4)]
    for chars in (10**6, 6):
        rows, listed = J.with_occurrences(docs, "text", terms, stand=J.WORDS, lexicon_chars=chars)
        assert listed == ["Delhi", "New Delhi", "Goa"]
        picks = rows.select("id", J.first_by_order("found").alias("first"), J.longest("found").alias("longest")).collect()
        assert sorted(map(tuple, picks), key=str) == sorted([(1, 0, 1), (2, None, None), (3, None, None), (4, 2, 2), (4, None, None)], key=str)
    assert J.occurrences(docs, "id", "text", terms.limit(0)).count() == 0 and J.occurrences(docs.limit(0), "id", "text", terms).count() == 0


def test_suffix_join_equals_brute_force(spark):
    rng = random.Random(3)
    label = lambda: rng.choice(["a", "b", "www", "x-y", "co", "org"])
    hosts = [".".join(label() for _ in range(rng.randint(1, 5))) for _ in range(200)] + ["", None, "A.ORG", "u@a.org:443", "a.org.", "notowasp.org", "owasp.org", ".".join(["z"] * 200) + ".a.org"]
    domains = [(".".join(label() for _ in range(rng.randint(1, 3))), i) for i in range(60)] + [("owasp.org", 100), ("Owasp.org", 99), (None, 5), ("", 6)]
    df = spark.createDataFrame(list(enumerate(hosts)), "id int, host string")
    table = spark.createDataFrame(domains, "domain string, score int")
    known = {}
    for d, s in domains:
        if d:
            known[d.lower()] = min(s, known.get(d.lower(), 10**9))

    def best(h):
        h = re.sub(r":\d*$", "", re.sub(r"^.*@", "", (h or "").lower())).removesuffix(".")
        parts = h.split(".")
        return next((known[e] for i in range(len(parts)) if (e := ".".join(parts[i:])) in known and e), None)

    for few in (10**6, 1):
        got = {r.id: r.score for r in S.suffix_join(df, F.col("host"), table, order="score", few=few).collect()}
        assert got == {i: best(h) for i, h in enumerate(hosts)}
    assert S.suffix_join(df, F.col("host"), table.limit(0)).where("domain is not null").count() == 0


def test_empty_automaton():
    owner, term, begin = J.Automaton([]).find(["a", ""], "words")
    assert len(owner) == len(term) == len(begin) == 0 and np.array_equal(J.Automaton(["a"]).find([], "spaces")[0], np.zeros(0))
