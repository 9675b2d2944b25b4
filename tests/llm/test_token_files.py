import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from digitscope.llm import queries, token_files
from digitscope.llm.shared import work_folder

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    tool = Tokenizer.from_file(VOCABULARY)
    tool.encode_special_tokens = True
    return lambda text: tool.encode(text or "", add_special_tokens=False).ids


def own(tool, texts):
    return [np.frombuffer(b, "<u4").tolist() for b in tool.encode(texts)]


def brute_force(library, rows):
    """Rows of the contract, for distinct ids."""
    out, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*library(text), 1], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def result(found):
    return [(r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in found.orderBy("start").collect()]


def test_same_ids_as_the_library(library, monkeypatch):
    pick = random.Random(3)
    with open(VOCABULARY, "rb") as file:
        tool = token_files.Encoder(file.read())
    assert tool.by_word
    texts = [None, "", " ", "  a  b ", "It's rock'sand 'Tis don't", "x.\ny", "H̱ é ̸ ≮ <|endoftext|> <|startoftext|>x", "İSTANBUL ß ÿŸ ªº µ",
             "a b c d\u0085e\x1cf", "日本語 テキスト", "٣٤ ½ ²3", "...!!! (a).\"b\" -- a_b", "🎉é🎈", "ǅ ﬁ Å Å", "\x00 \x01", "word " * 3000, "q" * 5000]
    alphabet = "abcXYZ éÉß'.,-\n\t 0123̸̱́'sİ日🎉 "
    texts += ["".join(pick.choice(alphabet) for _ in range(pick.randint(1, 60))) for _ in range(3000)]
    want = [library(t) for t in texts]
    assert own(tool, texts) == want
    assert own(tool, texts[::-1]) == want[::-1]
    monkeypatch.setattr(token_files, "REMEMBERED", 2)
    assert [own(tool, [t])[0] for t in texts[:60]] == want[:60]


def test_other_vocabularies_are_fed_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, "rb") as file:
        tool = token_files.Encoder(file.read())
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    texts = ["two  words here", "<|endoftext|>", "", "é 日本"]
    assert not tool.by_word and own(tool, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_planes_round_trip(kind):
    pick = np.random.default_rng(4)
    for n in (1, 7, 8, 9, 100, 4097):
        for top in (1, 2, 49408, 1 << 32):
            ids = pick.integers(0, top, n, np.uint32)
            planes = token_files.pack(ids, kind)
            assert len(planes) == token_files.PLANES[kind]
            assert (token_files.unpack(planes, n, kind) == ids).all()
    assert token_files.pack(np.full(64, 5, np.uint32), kind).count(b"") == (30 if kind == "bit" else 3)


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_file_round_trip_and_index(kind):
    pick = np.random.default_rng(5)
    lengths = [0, 1, 300, 0, 17, 1000, 2, 0]
    ids = pick.integers(0, 50_000, sum(lengths), np.uint32)
    doc_ids = [None, -5, 0, 1, 2, 2, 1 << 62, None]
    file = token_files.File(token_files.image(3, 4, doc_ids, lengths, ids, 64, kind) + b"\n")
    found = list(file.documents())
    assert (file.part, file.number, file.kind, len(file.index)) == (3, 4, kind, -(-sum(lengths) // 64))
    assert [f[0] for f in found] == doc_ids and [f[1] for f in found] == np.cumsum([0, *lengths[:-1]]).tolist()
    assert b"".join(f[2] for f in found) == ids.tobytes() and [len(f[2]) // 4 for f in found] == lengths
    assert (file.ids(2) == ids[128:192]).all()  # one block alone, by the index
    for broken in (b"", b"x" * 100, token_files.image(0, 0, [1], [1], ids[:1])[:-3]):
        with pytest.raises(ValueError):
            token_files.File(broken)


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_documents_on_odd_rows(spark, library, monkeypatch, most):
    monkeypatch.setattr(token_files, "BROADCAST", most)
    rows = [(5, None), (None, "no id here"), (3, ""), (-4, "first of all"), (1 << 40, "z " * 30_000), (9, "tie one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as hash", "3 as copy", "4 as value", "5 as start")
    folder = work_folder(spark)
    token_files.write(docs, folder, VOCABULARY, block=64, kind="bit")
    assert result(token_files.documents(spark, folder)) == brute_force(library, rows)
    index = token_files.chunk_index(spark, folder).collect()
    assert sum(r.n_ids for r in index) == sum(r[2] for r in brute_force(library, rows)) and all(len(r.plane_bytes) == 32 for r in index)
    repeated = spark.createDataFrame([(1, "same words")] * 40 + [(1, "other words"), (2, None)], "doc_id long, text string")
    folder = work_folder(spark)
    token_files.write(repeated, folder, VOCABULARY, kind="byte")
    got = token_files.documents(spark, folder).orderBy("start").collect()
    ends = np.cumsum([0] + [r.n_tokens for r in got]).tolist()
    assert [r.doc_id for r in got] == [1] * 41 + [2] and [r.start for r in got] == ends[:-1]
    folder = work_folder(spark)
    token_files.write(docs.limit(0), folder, VOCABULARY)
    assert token_files.documents(spark, folder).count() == 0
    folder = work_folder(spark)
    token_files.write(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), folder, VOCABULARY, end=None)
    assert [(r.doc_id, r.start, r.n_tokens) for r in token_files.documents(spark, folder).orderBy("doc_id").collect()] == [(1, 0, 0), (2, 0, 0)]
    with pytest.raises(ValueError):
        token_files.write(docs, folder, VOCABULARY, kind="nibble")


def test_starts_over_many_parts_and_files(spark, monkeypatch):
    monkeypatch.setattr(token_files, "SUMMED", 3)
    pick = random.Random(6)
    files = [(part, number, pick.randint(0, 9)) for part in range(0, 40, 2) for number in range(pick.randint(1, 8))]
    got = {(r.part, r.file): r.before for r in token_files._starts(spark.createDataFrame(files, "part int, file int, n_ids long")).collect()}
    before, want = 0, {}
    for part, number, n in files:
        want[part, number] = before
        before += n
    assert got == want


def test_query(spark, data, library):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = queries.op11_bit_planes(spark, data)
    assert got.dtypes == [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")]
    assert [tuple(r) for r in got.orderBy("doc_id").collect()] == brute_force(library, docs)
