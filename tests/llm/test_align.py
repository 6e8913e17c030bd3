"""Cross-tokenizer alignment against naive loops over the libraries' own encodings."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from eventloom.llm import align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


def brute(rows):
    """Rows of (key, text): the contract's columns, token by token."""
    a_lib, b_lib = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_lib.encode_special_tokens = True
    letter = align.byte_of()
    docs = []
    for key, text in rows:
        text = text or ""
        a = a_lib.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_lib.encode(text)
        a_bytes = [bytes(letter[c] for c in a_lib.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if b_lib.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [b_lib.id_to_piece(i)]]
        raw = (" " + text).encode()
        if not text or b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
            docs.append((key, [], [], [], []))
            continue
        spans = []
        for tokens in (a_bytes, b_bytes):
            at, out = 0, []
            for t in tokens:
                out.append((at, at + len(t)))
                at += len(t)
            spans.append(out)
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, begin = [], 0
        for cut in cuts:
            groups.append(",".join(str(i) for i, (x, y) in zip(a, spans[0]) if begin <= x < cut) + "|" + ",".join(str(i) for i, (x, y) in zip(b, spans[1]) if begin <= x < cut))
            begin = cut
        links = [(i, j) for i, (x, y) in zip(a, spans[0]) for j, (u, v) in zip(b, spans[1]) if x < v and u < y]
        docs.append((key, a, b, groups, links))
    count = collections.Counter(p for *_, links in docs for p in set(links))
    highest = collections.Counter()
    for (i, _), n in count.items():
        highest[i] = max(highest[i], n)
    return collections.Counter((key, len(a), len(b), len(g), len(k), sum(count[p] == highest[p[0]] for p in k), sum(count[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for key, a, b, g, k in docs)


def odd_rows(n, seed):
    rng = random.Random(seed)
    bits = ["a", " ", "  ", "é", "你好", "\U0001f600", "\n", " \n ", "\r\n", "<|endoftext|>", "<s>", "<0x41>", "the", "ing ", "12345", "　", "\xa0", "\x1c", "'s", "!'re", "ﬁ", "\x00"]
    return [(rng.choice([i, None]) if i % 9 == 0 else i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))) for i in range(n)]


def folder(spark, path, rows):
    spark.createDataFrame([(i, t, "k", 1, "b", "x") for i, t in rows], "doc_id long, text string, key string, n_a int, block string, a string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_query_equals_brute_force(spark, tmp_path):
    rows = odd_rows(150, 1) + [(900, None), (901, ""), (902, " "), (903, "has ▁ mark"), (904, "same text"), (904, "same text"), (None, None), (905, "x" * 400)]
    rows += [(r.doc_id, r.text[:700]) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()]
    got = collections.Counter(map(tuple, align.op11_align(spark, folder(spark, tmp_path / "a", rows)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()))
    assert got == brute(rows)
    assert align.op11_align(spark, folder(spark, tmp_path / "b", [])).count() == 0
    assert [tuple(r)[1:] for r in align.op11_align(spark, folder(spark, tmp_path / "c", [(1, "▁"), (2, None)])).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_small_blocks_and_pairs(spark):
    rows = odd_rows(60, 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out, counts = align.align_documents(docs, A, B, block_links=1)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert collections.Counter(map(tuple, out.select(*names).collect())) == brute(rows)
    pairs = {(r.a, r.b): (r["count"], r.best) for r in counts.collect()}
    coder = align.pair_of(open(A, encoding="utf-8").read(), open(B, "rb").read())
    assert {a for a, _ in pairs} == {i for x, _ in coder.encode([t for _, t in rows]) for i in x.tolist()} and max(a for a, _ in pairs) > 43_000
    assert len(pairs) == counts.count() and all(any(x == i and best for (x, _), (_, best) in pairs.items()) for i, _ in pairs)


def test_words_are_encoded_as_in_their_text():
    tokenizer = align.ByteLevel(open(A, encoding="utf-8").read())
    whole = Tokenizer.from_file(A)
    whole.encode_special_tokens = True
    texts = [" " + t for _, t in odd_rows(2000, 3)]
    for t, ids in zip(texts, tokenizer.encode(texts), strict=True):
        assert ids.tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_long_text_is_one_document_of_many_links():
    pair = align.pair_of(open(A, encoding="utf-8").read(), open(B, "rb").read())
    text = "the quick brown fox " * 20_000
    out = align.align(pair, pair.encode(["", text, ""]))
    assert out["n_a"][[0, 2]].tolist() == [0, 0] and out["digests"][0] == "" and out["n_links"].tolist() == (out["n_a"] + out["n_b"] - out["n_groups"]).tolist()
    assert out["sizes"].tolist()[1] == len(np.unique(out["pairs"]))
