import json
import random

import pytest
from tokenizers import Tokenizer

from tidemark.llm.queries import vocabulary_path
from tidemark.llm.tokenize import ByteBPE, encode_ids

PATH = vocabulary_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def texts():
    rng = random.Random(2)
    letters = "abcdeéß 'st01\n\t🚀你好.,—я"
    odd = ["", " ", "\n\n \t", "<|endoftext|> x", "aaaaaaa" * 700, "it's'll   x​ 12³½", "🏳️‍🌈", "\x00\x7f", "Ａ１", "  lead", "ab" * 3000 + "é" * 999]
    return odd + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 90))) for _ in range(800)]


def test_equals_library(library):
    t = texts()
    assert ByteBPE(PATH).encode(t) == library(t)


def test_forgetting_words_changes_nothing(library, monkeypatch):
    monkeypatch.setattr("tidemark.llm.tokenize.CACHE_WORDS", 50)
    monkeypatch.setattr("tidemark.llm.tokenize.CHUNK_BYTES", 100)
    bpe, t = ByteBPE(PATH), texts()
    assert [i for k in range(0, len(t), 100) for i in bpe.encode(t[k : k + 100])] == library(t)


def test_rows(spark, library):
    t = [None, "", "  ", "tender offer"]
    df = spark.createDataFrame([(i, x, "same") for i, x in enumerate([*t, t[3]])], "doc_id bigint, text string, ids string")
    got = {r.doc_id: list(r.ids) for r in encode_ids(df, PATH).collect()}
    assert got == {0: [], 1: [], 2: library([t[2]])[0], 3: library([t[3]])[0], 4: library([t[3]])[0]}
    assert encode_ids(df.limit(0), PATH).count() == 0


def test_a_normalizer_is_refused(tmp_path):
    spec = json.load(open(PATH, encoding="utf-8")) | {"normalizer": {"type": "NFC"}}
    (tmp_path / "t.json").write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError):
        ByteBPE(str(tmp_path / "t.json"))
