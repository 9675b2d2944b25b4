import hashlib
import random

import xxhash
from pyspark.sql import functions as F

from digitscope.llm import fingerprint as omh, queries

SIGN = 1 << 64


def signed(n):
    return n - SIGN if n >> 63 else n


def chain(values, start=42):
    for v in values:
        data = v.encode() if isinstance(v, str) else (v % SIGN).to_bytes(8, "little") if isinstance(v, Long) else (v % (1 << 32)).to_bytes(4, "little")
        start = xxhash.xxh64_intdigest(data, start)
    return start


class Long(int):
    """A bigint, hashed as eight bytes; plain ints are four."""


def mixed(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % SIGN
    x = (x ^ x >> 27) * 0x94D049BB133111EB % SIGN
    return x ^ x >> 31


def joined(values):
    """Hash of a k-mer: the halves' hashes joined, down to single code points."""
    if len(values) == 1:
        return values[0]
    half = len(values) // 2
    return mixed((joined(values[:half]) * int(omh.JOIN) + joined(values[half:])) % SIGN)


def slow_signature(text):
    """By every run of K code points, one at a time."""
    if not text:
        return []
    points = [ord(c) for c in text] + [omh.PAST] * (omh.K - len(text))
    seen, numbered = {}, []
    for i in range(len(points) - omh.K + 1):
        h = joined(points[i:i + omh.K])
        numbered.append(mixed((h + seen.get(h, 0) * int(omh.JOIN)) % SIGN))
        seen[h] = seen.get(h, 0) + 1
    bound = sorted(numbered)[:omh.KEPT][-1]
    kept = [h for h in numbered if h <= bound]
    out = set()
    for i in range(max(len(kept) - omh.TUPLE, 0) + 1):
        t = 0
        for h in kept[i:i + omh.TUPLE]:
            t = mixed((t * int(omh.JOIN) + h) % SIGN)
        out.add(t >> 32)
    return sorted(out)


def slow_likeness(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


TEXTS = [None, "", "  \n", "one", "one two", "one two three", "a b c d e f g h", "x " * 500, ("lorem ipsum dolor " * 3 + "sit ") * 60,
         "日本語" * 100, "🎉" * 30, "w" * 1000, " ".join(f"word{i}" for i in range(900)), "a  b\t\tc", " ".join(str(i % 7) for i in range(3000))]


def test_signatures(spark):
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    for r in frame.select("i", omh.signature(F.col("text")).alias("s")).collect():
        assert r.s == slow_signature(TEXTS[r.i])


def test_nearer_texts_are_liker(spark):
    pick = random.Random(3)
    words = ["".join(pick.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    one, more = list(words), list(words)
    one[200] = "edited"
    for i in range(0, 400, 20):
        more[i] = "edited"
    moved = words[200:] + words[:200]
    shuffled = pick.sample(words, 400)
    base = slow_signature(" ".join(words))
    like = [slow_likeness(base, slow_signature(" ".join(w))) for w in (words, one, moved, more, shuffled)]
    assert like[0] == 1 and like[1] > 0.85 and like[2] > like[3] > like[4] and like[4] < 0.05


def test_edits_in_runs_without_blanks(spark):
    pick = random.Random(11)
    run = "".join(pick.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(4000))
    spaced = " ".join(run[i:i + 9] for i in range(0, 4000, 9))
    texts = [run, "q" + run, run[:2000] + "q" + run[2000:], run[:1000] + run[1001:], spaced, spaced.replace(" ", "\n\n")]
    got = [r.s for r in spark.createDataFrame(list(enumerate(texts)), "i int, text string").orderBy("i").select(omh.signature(F.col("text")).alias("s")).collect()]
    assert got == [slow_signature(t) for t in texts]
    inserted = [slow_likeness(got[0], slow_signature(run[:i] + "q" + run[i:])) for i in range(0, 4001, 100)]
    assert sum(inserted) / len(inserted) >= 0.9 and min(inserted) > 0.7
    assert slow_likeness(got[4], got[5]) < 0.5


def slow_rows(rows):
    """The whole query by hand; rows of (id, text)."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), signed(chain([r[1] or ""]))))
    out = []
    for i, (doc, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        a, b, c = slow_signature(text), slow_signature(edited), slow_signature(after)
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), "".join(f"{h:08x}" for h in a),
                    "".join(f"{h:08x}" for h in b), slow_likeness(a, b), slow_likeness(a, c)))
    return sorted(out, key=str)


def answer(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_order_with_nulls_and_repeated_ids(spark, tmp_path):
    rows = [(i * 10, t) for i, t in enumerate(TEXTS)] + [(None, f"null {i} here") for i in range(40)] + [(70, f"again {i} and on") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert answer(queries.op10_order_minhash(spark, str(tmp_path))) == slow_rows(rows)


def test_few_rows_and_other_columns(spark):
    docs = spark.createDataFrame([(5, "a b c d e f")], "doc_id long, text string").selectExpr("*", "1 as next", "2 as cut", "'s' as sign")
    (r,) = omh.beside_next(docs).collect()
    assert r.next == r.text and r.edited == "a b c a b c" [:6] + "a b c" and r.sign == r.next_sign
    assert omh.beside_next(docs.limit(0)).count() == 0
    assert omh.beside_next(docs.withColumn("doc_id", F.lit(None).cast("long"))).count() == 1


def test_signatures_are_the_only_python(spark, data):
    plan = queries.op10_order_minhash(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "BatchEvalPython" not in plan and "MapInArrow" not in plan and "MapInPandas" not in plan


def test_query(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    got = answer(queries.op10_order_minhash(spark, data))
    assert got == slow_rows(rows)
    near = sorted(r[5] for r in got)
    assert near[len(near) // 2] > 0.2
