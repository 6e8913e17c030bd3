"""Ranked search against a plain scan of all documents."""

import collections
import math
import random
import re

import numpy as np

from eventloom.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    held = [(i, collections.Counter(w), len(w)) for i, t in docs if (w := words(t))]
    n, total = len(held), sum(x for *_, x in held)
    df = collections.Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for i, c, size in held:
            m = 100 - 25 + (25 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in words(text) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def rows(n, seed):
    rng = random.Random(seed)
    vocabulary = ["The", "the", "a", "É", "é", "x1", "你好", "w", "Straße", "zz", "q\x00q", "n-n"] + [f"t{i}" for i in range(60)]
    return [(i if i % 17 else None, rng.choice([None, "", "..."]) if i % 13 == 0 else rng.choice([" ", "\n", ", "]).join(rng.choice(vocabulary[: rng.randint(3, 72)]) for _ in range(rng.randint(1, 40)))) for i in range(n)]


def test_packed_integers():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**21, 2**28 - 1, 2**28, 2**35, 2**55], np.int64)
    raw, ends = search.pack(values)
    assert search.unpack(raw).tolist() == values.tolist() and ends[-1] == len(raw) and len(search.unpack(b"")) == 0
    assert [search.unpack(raw[a:b]).tolist() for a, b in zip([0, *ends.tolist()], ends.tolist())] == [[v] for v in values.tolist()]


def test_search_equals_scan(spark, monkeypatch):
    monkeypatch.setattr(search, "FAN", 2)
    docs = rows(300, 1) + [(1000, "zz zz only"), (1000, "zz zz only"), (1001, "zz zz only"), (1002, " ".join(["the"] * 5000))]
    items = [(i, t) for i, t in rows(30, 2)] + [(100, "zz zz zz"), (100, "zz zz zz"), (101, "nothing here"), (102, None), (None, "x1 zz")]
    items = [(i, t) for i, t in {(i, t) for i, t in items if i is not None}] + [(None, "x1 zz")]
    d = spark.createDataFrame([(i, t, "x", 1, "s") for i, t in docs], "doc_id long, text string, key string, rank int, shard string").repartition(5)
    q = spark.createDataFrame([(i, t, 0) for i, t in items + items[:2]], "item_id long, text string, asked int")
    for shard_bytes, item_bytes in ((200, 100), (10**9, 10**9)):
        index = search.build_index(d, shard_bytes=shard_bytes)
        got = sorted(map(tuple, search.search(index, q, 7, item_bytes=item_bytes).collect()), key=str)
        assert got == brute(docs, items, 7)
    assert search.search(search.build_index(d.limit(0)), q, 7).count() == 0 and search.search(index, q.limit(0), 7).count() == 0


def test_blocks_of_items(spark, monkeypatch):
    docs, items = rows(80, 3), [(i, t) for i, t in rows(40, 4) if i is not None]
    index = search.build_index(spark.createDataFrame(docs, "doc_id long, text string")).collect()[0].asDict()
    asked = search.Asked([t or "" for _, t in items])
    held = [w for _, t in docs if (w := set(words(t)))]
    df = {n: sum(t.decode() in w for w in held) for t, n in asked.numbers.items()}
    asked.weigh(len(held), index["n_terms"], {n: c for n, c in df.items() if c})
    whole = search.best_of_shard(index, asked, 5)
    monkeypatch.setattr(search, "BLOCK", 3)
    assert sorted(search.best_of_shard(index, asked, 5)) == sorted(whole) and whole
