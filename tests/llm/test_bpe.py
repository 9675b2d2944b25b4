import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from digitscope.llm import bpe, queries


@pytest.fixture(scope="module")
def library():
    with open(queries.RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def tool():
    with open(queries.RANKS, "rb") as file:
        return bpe.Tokenizer(file.read(), public_tokenizers.PATTERN)


def test_same_ids_as_the_library(tool, library):
    pick = random.Random(5)
    texts = ["", " ", "a", "  x  y ", "ab" * 3000, "x" * 256, "x" * 257, "\x1c\x1d x", "日本語" * 300, "'s'S've", "0123456789" * 40,
             "<|endoftext|>", "　x᠎​", "🎉🎈" * 200, " lead", "trail ", "a \n b"]
    texts += ["".join(pick.choice("abcdeéß日 \n\t01.,'🎉") for _ in range(pick.randint(1, 300))) for _ in range(300)]
    texts += ["".join(pick.choice("thereading") for _ in range(pick.randint(200, 700))) for _ in range(30)]
    got = tool.encode_many(texts)
    assert got == [library.encode_ordinary(t) for t in texts]
    assert [tool.decode(ids).decode() for ids in got] == texts


def test_long_words_and_matrices_agree(tool):
    pick = random.Random(6)
    for _ in range(200):
        word = "".join(pick.choice("therandinguéß") for _ in range(pick.randint(2, 90))).encode()
        if word not in tool.ranks:
            assert tool._merge_long(word) == tool._merge_all([word])[0]


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    monkeypatch.setattr(bpe, "CELLS", 8)
    with open(queries.RANKS, "rb") as file:
        tool = bpe.Tokenizer(file.read(), public_tokenizers.PATTERN)
    for text in ("one twothree fourfive", "sixseven eightnine", "one twothree elevenish"):
        assert tool.encode_many([text]) == [library.encode_ordinary(text)]


def test_incomplete_vocabulary_is_refused():
    with pytest.raises(ValueError):
        bpe.Tokenizer(b"YQ== 0\n", "a")


def test_operator_on_odd_rows(spark, library):
    rows = [(1, None, "x"), (2, "", None), (None, "two words", "y"), (3, "two words", "y"), (3, "two words", "y"), (4, "z" * 30000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.encode(docs, queries.RANKS, public_tokenizers.PATTERN, decoded="decoded").collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(r[0]) for r in rows)
    for r in out:
        assert r.ids == (library.encode_ordinary(r.text) if r.text else [])
        assert bytes(r.decoded).decode() == (r.text or "")
    again = bpe.decode(bpe.encode(docs, queries.RANKS, public_tokenizers.PATTERN), queries.RANKS, public_tokenizers.PATTERN)
    assert {bytes(r.decoded).decode() for r in again.collect()} == {r[1] or "" for r in rows}
    assert bpe.encode(docs.limit(0), queries.RANKS, public_tokenizers.PATTERN).count() == 0


def test_query(spark, data, library):
    out = {r.doc_id: r for r in queries.op3_byte_bpe(spark, data).collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    assert len(out) == len(docs)
    for d in docs:
        ids = library.encode_ordinary(d.text or "")
        got = out[d.doc_id]
        assert got.n_tokens == len(ids)
        assert got.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()
