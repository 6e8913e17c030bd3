"""SentencePiece: ids, spans, decoding and normalisation against the library, on odd texts and rows."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from eventloom.llm import sentence

PATH = public_tokenizers.path("piece_bpe_32k.model")
BITS = ["a", "b", " ", "  ", "▁", "é", "你", "㐀", "\U0001f600", "\n", "\t", "\r\n", "<s>", "</s>", "<unk>", "<0x41>", "the ", "ing", " 12345", "\x00", "　", "\xa0", "    x", "x" * 70, " " * 30, "﷽", "é", "ａ", "!!", "().\r"]


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 30))) for _ in range(n)] + ["x" * 3000, " " * 3000, "ab" * 2000, ""]


def test_encode_equals_library():
    lib, model = sentencepiece.SentencePieceProcessor(model_file=PATH), sentence.load(PATH)
    texts = odd_texts(1500)
    for t, (ids, begins, ends) in zip(texts, model.encode(texts), strict=True):
        want = lib.encode(t, return_type="proto").pieces
        assert list(zip(ids.tolist(), begins.tolist(), ends.tolist(), strict=True)) == [(p.id, p.begin, p.end) for p in want], t
        assert model.decode(ids) == lib.decode(ids.tolist()), t
    assert [len(x[0]) for x in model.encode(texts)] == [len(x[0]) for t in texts for x in model.encode([t])]


def test_decode_of_any_ids_equals_library():
    lib, model, rng = sentencepiece.SentencePieceProcessor(model_file=PATH), sentence.load(PATH), random.Random(2)
    for _ in range(3000):
        ids = [rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(3, 259), rng.randrange(259, 32000), 259, 28705]) for _ in range(rng.randint(0, 12))]
        assert model.decode(np.array(ids, int)) == lib.decode(ids), ids


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
@pytest.mark.parametrize("flags", [{}, {"remove_extra_whitespaces": False}, {"add_dummy_prefix": True}, {"escape_whitespaces": True, "add_dummy_prefix": True}])
def test_normalisation_equals_library(rule, flags):
    lib = sentencepiece.SentencePieceNormalizer(rule_name=rule, **flags)
    norm = {}
    for number, value in sentence.fields(lib.serialized_model_proto()):
        if number == 3:
            norm |= dict(sentence.fields(value))
    model = sentence.Model.__new__(sentence.Model)
    model.map, model.suffix = sentence.CharMap(norm.get(2, b"")), False
    model.dummy, model.strip, model.escape = (bool(norm.get(i, 1)) for i in (3, 4, 5))
    for t in odd_texts(300, 3) + ["ﬁ Ａ  x", "  lead", "trail  ", "Å Å", "각"]:
        text, source = model.normalize(t)
        want, offsets = lib.normalize(t, with_offsets=True)
        begins = [len(t[:i].encode()) for i in offsets]  # the library's binding counts characters
        assert (text, source.tolist()) == (want, begins), t


def test_query_and_odd_rows(spark, tmp_path):
    long = "one two " * 40_000
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (4, "one"), (None, "x▁y"), (5, long), (6, "z" * 50_000), (None, None)]
    df = spark.createDataFrame([(i, t, "k", "i", "b") for i, t in rows], "doc_id long, text string, key string, ids string, begins string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = collections.Counter()
    for i, t in rows:
        ids = lib.encode(t or "")
        want[i, len(ids), digest(",".join(map(str, ids))), digest(lib.decode(ids)), len((t or "").encode())] += 1
    assert collections.Counter(map(tuple, sentence.op12_sentence(spark, str(tmp_path)).collect())) == want
    assert sentence.encode_documents(df.limit(0), PATH).count() == 0


def test_known_segments_are_forgotten(monkeypatch):
    monkeypatch.setattr(sentence, "KNOWN", 3)
    model, lib = sentence.Model(open(PATH, "rb").read()), sentencepiece.SentencePieceProcessor(model_file=PATH)
    for t in odd_texts(50, 4):
        assert model.encode([t])[0][0].tolist() == lib.encode(t)
    with pytest.raises(ValueError):
        sentence.Model(sentencepiece.SentencePieceNormalizer(rule_name="identity").serialized_model_proto())
