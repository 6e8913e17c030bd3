"""The stages of the corpus pipeline and its run against brute force, with nulls, an empty table and clashing names."""

import collections
import re

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline as P
from eventloom.llm import bpe

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string, __row string, __extra string, __score string"
WORDS = [f"w{i} is" for i in range(40)]
ITEM = "alpha beta gamma delta epsilon zeta eta theta"
TEXTS = {
    1: " ".join(WORDS), 2: " ".join(WORDS), 3: " ".join(WORDS[:39] + ["x is"]), 4: "Mail me at a.b@example.org please, it is late", 5: f"before {ITEM.upper()} after", 6: "You idiot. You are an idiot and trash.",
    7: None, 8: "", 9: "short words here", 10: "a text of its own that says zork blar aloud",
}


def documents(spark, ids=tuple(TEXTS)):
    rows = [(i, TEXTS[i], "en", "s", len(TEXTS[i] or ""), f"r{i}", f"k{i}", "e", "q") for i in ids]
    return spark.createDataFrame(rows + [(None, "null id", "en", "s", 7, "rn", "kn", "e", "q")] * bool(ids), COLUMNS)


def folder(spark, path):
    documents(spark).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, "zork blar"), (3, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(6, 1, 1), (1, 1, 0), (None, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def shingles(text, k=5):
    ws = (text or "").lower().split()
    return {tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))} if ws else set()


def without_copies(rows):
    up = {r.doc_id: r.doc_id for r in rows if r.doc_id is not None}
    for _ in up:
        for a in rows:
            for b in rows:
                x, y = shingles(a.text), shingles(b.text)
                if x and a.doc_id is not None and b.doc_id is not None and 10 * len(x & y) >= 8 * len(x | y):
                    up[a.doc_id] = up[b.doc_id] = min(up[a.doc_id], up[b.doc_id])
    return [r for r in rows if r.doc_id is None or up[r.doc_id] == r.doc_id]


def words(text):
    return " " + " ".join(re.findall(r"[^\W_]+", (text or "").lower())) + " "


def without_items(rows):
    return [r for r in rows if f" {ITEM} " not in words(r.text) and " zork blar " not in words(r.text)]


def masked(rows):
    return [r.text if r.text is None else re.sub(r"[a-z.]+@[a-z.]+", "[EMAIL]", r.text) for r in rows]


def same(got, want):
    return collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, want))


def test_stages_equal_brute_force(spark, tmp_path):
    path, docs = folder(spark, tmp_path), documents(spark)
    rows = docs.collect()
    assert same(P.reject_toxic(spark, docs, path).collect(), [r for r in rows if r.doc_id != 6])
    assert same(P.one_of_each_copy(spark, docs, path).collect(), without_copies(rows)) and len(without_copies(rows)) == len(rows) - 2
    assert same(P.without_benchmark(spark, docs, path).collect(), without_items(rows)) and len(without_items(rows)) == len(rows) - 2
    safe = P.without_personal_data(spark, docs, path)
    assert safe.columns == docs.columns and same([(r.doc_id, r.text, r.row, r["__row"]) for r in safe.collect()], [(r.doc_id, t, r.row, r["__row"]) for r, t in zip(rows, masked(rows))])
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in safe.collect())
    for _, stage in P.STAGES:
        assert stage(spark, documents(spark, ()), path).count() == 0


def test_run_equals_brute_force(spark, tmp_path):
    path = folder(spark, tmp_path)
    rows = without_items(without_copies([r for r in documents(spark).collect() if r.doc_id != 6]))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = [(r.doc_id, t or "", tuple(enc.encode_ordinary(t or ""))) for r, t in zip(rows, masked(rows))]
    got = P.run(spark, path).collect()
    assert same([(r.doc_id, r.text, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got], want) and all(r.n_tokens == len(r.ids) // 4 for r in got)


def test_copies_stage_moves_texts_once(spark):
    docs = documents(spark)
    plan = P._rows_left(docs, docs.select("row"), "left_semi", once=True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2 and "Aggregate [__row" in plan  # of the keys, and of the rows by the key
