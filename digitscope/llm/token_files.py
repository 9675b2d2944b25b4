"""Files of token ids as compressed bit planes.

The ids of all documents, in ascending order of document id, are one long stream, which is cut into blocks of a fixed
number of ids. A block is transposed: byte (or bit) i of all its ids stands together in plane i, planes are compressed one by
one with zstandard, and planes without a set bit take no room. High planes of a vocabulary's ids are nearly constant. Byte planes are the
default: on the given documents they take 1.34 bytes an id and bit planes 1.55, and are made and opened seven times as fast.

A file is a header, its blocks, a table of its documents, the chunk index (place, ids and plane sizes of every block) and a
footer that says where these are, so a reader can fetch single blocks. Files end where a document ends. Each is one record of
Spark's text writer, so that writing commits and repeats like any other Spark write; part and file numbers in the header
give the order of the stream.

Texts are encoded with the tokenizers library. Vocabularies that drop white space and mark the ends of words are fed distinct
runs, remembered with their ids: texts of plain letters and ASCII signs are cut at spaces and between letters and the rest, where no token
goes across; of other texts only the plain pieces between spaces are.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from digitscope.llm.shared import parts, slices, stored

# Ids in a block, and in a file before it ends with the next document.
BLOCK, FILE_IDS = 1 << 16, 1 << 21
# Runs of text that a worker remembers, words that are encoded in one call, and bytes of text that are cut together.
REMEMBERED, TOGETHER, TEXTS = 1 << 19, 512, 3_000_000
# Parts whose totals are summed up in one window, and files whose places are broadcast at most (16 bytes each, some 50 MB as a table).
SUMMED, BROADCAST = 1024, 1 << 20

MAGIC = b"BITPLANE"
HEADER = struct.Struct("<8sBBxxIii")  # magic, version, kind of planes, ids in a block, part, number of the file in the part
FOOTER = struct.Struct("<QQQQ8s")  # place of the table of documents and of the index, documents, blocks, magic
PLANES = {"bit": 32, "byte": 4}

# How a vocabulary must cut texts for them to be encoded word by word.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Letters and signs whose runs are cut into words of their own, whatever stands beside them.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(rf"[{_LETTERS}\t\n\r -&(-@\[-`{{-~]*")  # no apostrophe, nothing that is composed or folded across a cut
_RUNS = re.compile(rf"[{_LETTERS}]+|[^{_LETTERS} ]+")
_WORD = re.compile(rf"[{_LETTERS}]+")


class Encoder:
    """Encodes texts with one vocabulary of the tokenizers library, given as its JSON file's bytes."""

    def __init__(self, data: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_buffer(data)
        self.tool.encode_special_tokens = True  # their strings in a text are ordinary text
        spec = json.loads(data)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        kinds = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers") or []]
        self.by_word = (kinds == ["NFC", "Replace", "Lowercase"] and steps[0].get("pattern") == {"Regex": CUT} and steps[0].get("invert") is True
                        and spec["model"].get("end_of_word_suffix") == "</w>" and not spec.get("post_processor"))
        names = self.tool.get_vocab()
        self.last = np.zeros(max(names.values()) + 1, bool)
        self.last[[i for t, i in names.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def _whole(self, texts: Sequence[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tool.encode_batch(list(texts), add_special_tokens=False)]

    def _learn(self, runs: set[str]) -> None:
        """Remember the ids of runs of text."""
        letters = [r for r in runs if _WORD.fullmatch(r)]
        for at in range(0, len(letters), TOGETHER):
            some = letters[at:at + TOGETHER]
            ids = np.array(self.tool.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(some):
                data, cuts = ids.tobytes(), (ends * 4).tolist()
                self.known.update(zip(some, map(data.__getitem__, map(slice, [0, *cuts[:-1]], cuts))))
            else:
                self.known.update(zip(some, self._whole(some)))
        others = list(runs.difference(letters))
        self.known.update(zip(others, self._whole(others)))

    def encode(self, texts: Sequence[str | None] | pa.Array) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; a null text has none."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not self.by_word:
            return self._whole(pc.fill_null(texts, "").to_pylist())
        if len(self.known) > REMEMBERED:
            self.known.clear()
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        plain = pc.match_substring_regex(texts, rf"\A{_PLAIN.pattern}\z")
        out = iter(self._joined(*_plain_runs(texts.filter(plain))))
        odd = iter(self._joined(*_other_runs(texts.filter(pc.invert(plain)).to_pylist())))
        return [next(out if simple else odd) for simple in plain.to_pylist()]

    def _joined(self, runs: pa.Array, edges: np.ndarray) -> list[bytes]:
        """The ids of texts that consist of the runs between neighbouring edges."""
        runs = runs.dictionary_encode()
        distinct = runs.dictionary.to_pylist()
        self._learn(set(distinct).difference(self.known))
        held = list(map(self.known.__getitem__, distinct))
        size = np.fromiter(map(len, held), np.int64, len(held)) // 4
        first, codes = np.cumsum(size) - size, runs.indices.to_numpy()
        each = size[codes]
        ends = np.cumsum(each)
        total = int(ends[-1]) if len(ends) else 0
        data = np.frombuffer(b"".join(held), "<u4")[np.repeat(first[codes] - ends + each, each) + np.arange(total)].tobytes()
        edges = (4 * np.r_[0, ends][edges]).tolist()
        return [data[i:j] for i, j in zip(edges, edges[1:])]


def _plain_runs(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Runs of letters and of other signs between spaces, of plain texts."""
    apart = pc.replace_substring_regex(pc.utf8_lower(texts), rf"([^{_LETTERS} ]+)", r" \1 ")
    cut = pc.split_pattern(apart, " ")
    return cut.flatten(), cut.offsets.to_numpy()


def _other_runs(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The same of the plain pieces of other texts, whose other pieces are left whole."""
    runs, edges = [], [0]
    for text in texts:
        for piece in text.split(" "):
            if _PLAIN.fullmatch(piece):
                runs += _RUNS.findall(piece.lower())
            else:
                runs.append(piece)
        edges.append(len(runs))
    return pa.array(runs, pa.large_string()), np.array(edges)


_LOADED: dict[int, Encoder] = {}


def _encoder(data: bytes) -> Encoder:
    """The worker's encoder; built once and kept while the worker lives."""
    key = hash(data)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Encoder(data)
    return _LOADED[key]


def pack(ids: np.ndarray, kind: str = "byte") -> list[bytes]:
    """The compressed planes of a block of ids; a plane of zeros is empty."""
    rows, out = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4), []
    press = zstandard.ZstdCompressor(level=1).compress
    for column in rows.T:
        column = np.ascontiguousarray(column)
        if not column.any():
            out += [b""] * (PLANES[kind] // 4)
        elif kind == "byte":
            out.append(press(column.tobytes()))
        else:
            planes = np.packbits(np.unpackbits(column[:, None], axis=1, bitorder="little").T, axis=1, bitorder="little")
            out += [press(p.tobytes()) if p.any() else b"" for p in planes]
    return out


def unpack(planes: Sequence[bytes], n: int, kind: str = "byte") -> np.ndarray:
    """The ``n`` ids of a block from its planes."""
    rows, each = np.zeros((n, 4), np.uint8), PLANES[kind] // 4
    open_ = zstandard.ZstdDecompressor().decompress
    for column in range(4):
        own = planes[column * each:(column + 1) * each]
        if not any(own):
            continue
        if kind == "byte":
            rows[:, column] = np.frombuffer(open_(own[0]), np.uint8)
        else:
            bits = np.zeros((8, -(-n // 8) * 8), np.uint8)
            for i, plane in enumerate(own):
                if plane:
                    bits[i] = np.unpackbits(np.frombuffer(open_(plane), np.uint8), bitorder="little")
            rows[:, column] = np.packbits(bits[:, :n].T, axis=1, bitorder="little")[:, 0]
    return rows.view("<u4")[:, 0]


def image(part: int, number: int, doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, block: int = BLOCK, kind: str = "byte") -> bytes:
    """The bytes of one file."""
    out, places, held = [HEADER.pack(MAGIC, 1, PLANES[kind], block, part, number)], [], HEADER.size
    for at in range(0, len(ids), block):
        planes = pack(ids[at:at + block], kind)
        places.append((held, min(block, len(ids) - at), *map(len, planes)))
        out += planes
        held += sum(map(len, planes))
    press = zstandard.ZstdCompressor(level=1).compress
    table = press(np.array([i is not None for i in doc_ids], np.uint8).tobytes() + np.array([i or 0 for i in doc_ids], "<i8").tobytes() + np.array(lengths, "<i8").tobytes())
    index = press(np.array(places, "<i8").reshape(-1, 2 + PLANES[kind]).tobytes())
    return b"".join([*out, table, index, FOOTER.pack(held, held + len(table), len(doc_ids), len(places), MAGIC)])


class File:
    """Reader of one file's bytes; blocks are opened one at a time."""

    def __init__(self, data: bytes, name: str = ""):
        self.data = data = memoryview(data)[:-1]  # the writer ends the record with one byte
        if len(data) < HEADER.size + FOOTER.size or bytes(data[:8]) != MAGIC or bytes(data[-8:]) != MAGIC:
            raise ValueError(f"{name}: no file of bit planes, or a part of one")
        _, self.version, planes, self.block, self.part, self.number = HEADER.unpack(data[:HEADER.size])
        self.kind = next(k for k, n in PLANES.items() if n == planes)
        table, index, self.docs, blocks, _ = FOOTER.unpack(data[-FOOTER.size:])
        open_ = zstandard.ZstdDecompressor().decompress
        self.index = np.frombuffer(open_(bytes(data[index:len(data) - FOOTER.size])), "<i8").reshape(blocks, 2 + planes)
        raw = open_(bytes(data[table:index]))
        known = np.frombuffer(raw[:self.docs], bool).tolist()
        numbers, self.lengths = np.frombuffer(raw[self.docs:], "<i8").reshape(2, self.docs)
        self.doc_ids = [i if k else None for i, k in zip(numbers.tolist(), known)]

    def ids(self, number: int) -> np.ndarray:
        """The ids of one block."""
        at, n, *sizes = self.index[number].tolist()
        ends = np.cumsum([at, *sizes]).tolist()
        return unpack([bytes(self.data[a:b]) for a, b in zip(ends, ends[1:])], n, self.kind)

    def documents(self) -> Iterator[tuple[int | None, int, bytes]]:
        """Every document's id, its first id's place in the file, and its ids as little-endian integers."""
        held, block, start = bytearray(), 0, 0
        for doc_id, length in zip(self.doc_ids, self.lengths.tolist()):
            while len(held) < 4 * length:
                held += self.ids(block).tobytes()
                block += 1
            yield doc_id, start, bytes(held[:4 * length])
            del held[:4 * length]
            start += length


def write(docs: DataFrame, folder: str, vocabulary: str, end: int | None = 1, doc_id: str = "doc_id", text: str = "text",
          block: int = BLOCK, kind: str = "byte") -> None:
    """Encode every whole text, append ``end`` (unless None) to each, and write the ids as files into ``folder``.

    ``vocabulary`` is a JSON file of the tokenizers library on the driver, which is broadcast; special tokens are neither added nor
    looked for in texts. Documents stand in ascending order of the integer ``doc_id``, null ids first; equal ids are ordered by a hash of
    their text, and repeated rows are all written. Null and empty texts have the end id alone. Texts are shuffled once, by ranges
    of ids; of other columns nothing is read. A file holds about ``FILE_IDS`` ids, or one longer document.
    """
    if kind not in PLANES or block < 1:
        raise ValueError("planes are of kind bit or byte, and a block holds one id at least")
    spark = docs.sparkSession
    with open(vocabulary, "rb") as file:
        data = spark.sparkContext.broadcast(file.read())
    tail = b"" if end is None else struct.pack("<I", end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, part, number = _encoder(data.value), TaskContext.get().partitionId(), 0
        doc_ids, held, size = [], [], 0

        def file() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            return pa.RecordBatch.from_arrays([pa.array([image(part, number, doc_ids, [len(h) // 4 for h in held], ids, block, kind)], pa.binary())], ["value"])

        for batch in batches:
            for some in slices(batch, "text", TEXTS):
                for i, ids in zip(some.column("id").to_pylist(), tool.encode(some.column("text"))):
                    doc_ids.append(i)
                    held.append(ids + tail)
                    size += len(ids) + len(tail)
                    if size >= 4 * FILE_IDS:
                        yield file()
                        doc_ids, held, size, number = [], [], 0, number + 1
        if doc_ids:
            yield file()

    # Copies of a row are dealt out by a number that the same scan gives again.
    order = ["id", "hash", "copy"]
    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("hash"),
                       F.pmod(F.monotonically_increasing_id(), F.lit(SUMMED)).alias("copy"))
    rows = rows.repartitionByRange(parts(spark), *order).sortWithinPartitions(*order).select("id", "text")
    rows.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\n").option("maxRecordsPerFile", 1).text(folder)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).where("length > 0").select("path", "content")


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, File]]:
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content")):
            yield path.as_py(), File(content.as_py(), path.as_py())


def chunk_index(spark: SparkSession, folder: str) -> DataFrame:
    """``path, part, file, block, offset, n_ids, plane_bytes array<long>``: the index entries of all files in ``folder``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, file in _opened(batches):
            n = len(file.index)
            yield pa.RecordBatch.from_arrays(
                [pa.array([path] * n, pa.string()), pa.array([file.part] * n, pa.int32()), pa.array([file.number] * n, pa.int32()), pa.array(range(n), pa.int32()),
                 pa.array(file.index[:, 0]), pa.array(file.index[:, 1]), pa.array(file.index[:, 2:].tolist(), pa.list_(pa.int64()))],
                ["path", "part", "file", "block", "offset", "n_ids", "plane_bytes"])

    return _files(spark, folder).mapInArrow(run, "path string, part int, file int, block int, offset bigint, n_ids bigint, plane_bytes array<bigint>")


def _starts(index: DataFrame) -> DataFrame:
    """``part, file, before``: ids that stand before each file.

    Files are summed up in sets of ``SUMMED`` neighbours, then the sets; parts likewise. A window holds the files of a set, or one row for each set.
    """
    def before(rows: DataFrame, by: list[str], at: str, name: str) -> DataFrame:
        window = Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn(name, F.coalesce(F.sum("n").over(window), F.lit(0)))

    def total(rows: DataFrame, *by: str) -> DataFrame:
        return rows.groupBy(*by).agg(F.sum("n").alias("n"))

    files = total(index.withColumnRenamed("n_ids", "n"), "part", "file").withColumn("set", F.floor(F.col("file") / SUMMED))
    sets, whole = total(files, "part", "set"), total(files, "part").withColumn("parts", F.floor(F.col("part") / SUMMED))
    found = (before(files, ["part", "set"], "file", "in_set").drop("n").join(before(sets, ["part"], "set", "in_part").drop("n"), ["part", "set"])
             .join(before(whole, ["parts"], "part", "in_parts").drop("n"), "part").join(before(total(whole, "parts"), [], "parts", "in_all").drop("n"), "parts"))
    return found.select("part", "file", (F.col("in_set") + F.col("in_part") + F.col("in_parts") + F.col("in_all")).alias("before"))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document in the files of ``folder``.

    ``start`` is the number of ids of all documents before it, ``ids`` its ids as little-endian unsigned 32-bit integers. Files
    are read where they lie; only their totals are shuffled. A broken or cut file is an error. An empty folder has no documents.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["part", "file", "doc_id", "inside", "ids"])

        for _, file in _opened(batches):
            rows, size = [], 0
            for doc_id, start, ids in file.documents():
                rows.append((file.part, file.number, doc_id, start, ids))
                size += len(ids)
                if size > 1 << 22:
                    yield batch(rows)
                    rows, size = [], 0
            if rows:
                yield batch(rows)

    found = _files(spark, folder).mapInArrow(run, "part int, file int, doc_id bigint, inside bigint, ids binary")
    starts = stored(_starts(chunk_index(spark, folder)))
    starts = F.broadcast(starts) if starts.count() <= BROADCAST else starts
    # Documents without ids (no end id) may leave a file without blocks.
    return found.join(starts, ["part", "file"], "left").select(
        "doc_id", (F.coalesce("before", F.lit(0)) + F.col("inside")).alias("start"), F.floor(F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids")
