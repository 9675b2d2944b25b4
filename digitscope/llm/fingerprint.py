"""Order MinHash fingerprints of documents.

A text's k-mers are its ``K`` code points from every position on (a shorter text is one k-mer), numbered by
occurrence, so that repeats count. The ``KEPT`` numbered k-mers of the smallest hashes are taken in text order, and
every ``TUPLE`` neighbours among them are hashed together. An edit of one code point changes ``K`` k-mers at most, and the set
of these hashes changes with each edit near a kept k-mer and with each change of order.

Signatures are an Arrow function, one vectorised pass over each text: array functions cost 1.7 times as much as the
operator may (figures in the README). All else is DataFrame functions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, LongType

from digitscope.llm.shared import parts

K, KEPT, TUPLE = 8, 64, 3
# Odd multiplier that joins two hashes, and what stands for code points after the end of a text shorter than a k-mer.
JOIN, PAST = np.uint64(0x9E3779B97F4A7C15), 0xFFFFFFFF


def _mixed(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _kmers(text: str) -> np.ndarray:
    """Hashes of the k-mers, by joining neighbours, pairs and fours."""
    h = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(h) < K:
        h = np.append(h, np.full(K - len(h), PAST, np.uint64))
    width = 1
    while width < K:
        h = _mixed(h[:-width] * JOIN + h[width:])
        width *= 2
    return h


def _signature(text: str) -> np.ndarray:
    if not text:
        return np.zeros(0, np.int64)
    kmers = _kmers(text)
    order = np.argsort(kmers, kind="stable")
    s, at = kmers[order], np.arange(len(kmers))
    start = np.maximum.accumulate(np.where(np.append(True, s[1:] != s[:-1]), at, 0))
    numbered = _mixed(s + (at - start).astype(np.uint64) * JOIN)
    if len(numbered) > KEPT:
        few = np.flatnonzero(numbered <= np.partition(numbered, KEPT - 1)[KEPT - 1])
        order, numbered = order[few], numbered[few]
    kept = numbered[np.argsort(order)]
    many = max(len(kept) - TUPLE, 0) + 1
    joined = np.zeros(many, np.uint64)
    for j in range(min(TUPLE, len(kept))):
        joined = _mixed(joined * JOIN + kept[j:j + many])
    return np.unique(joined >> np.uint64(32)).astype(np.int64)


@F.arrow_udf(ArrayType(LongType()))
def _signatures(texts: pa.Array) -> pa.Array:
    found = [_signature(t.as_py()) for t in texts]
    ends = np.cumsum([0, *(len(f) for f in found)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *found])))


def signature(text: Column) -> Column:
    """Sorted distinct tuple hashes (32 bits each, ``array<bigint>``) of the whole text; none for null and empty texts."""
    return _signatures(F.coalesce(text, F.lit("")))


def likeness(a: Column, b: Column) -> Column:
    """Shared part of two signatures, 0 to 1; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def as_text(signature_: Column) -> Column:
    """A signature as lower-case hex, eight digits for each hash."""
    return F.lower(F.array_join(F.transform(signature_, lambda h: F.lpad(F.hex(h), 8, "0")), ""))


def beside_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text, sign, next, edited, edited_sign, next_sign`` by descending id.

    ``next`` is the text of the next document (of the first one after the last), ``edited`` the text whose last
    half of code points, rounded down, is replaced by as many first ones of ``next``, and the signs are
    signatures. Null texts are empty; null ids come last; rows of equal ids follow each other by hash of
    their text; a lone document is its own next one.

    Ids are numbers. The rows are cut into ranges of ids, each sorted by itself, and ranges exchange only
    their first rows; a repeated or null id is cut further by the hash. Texts are shuffled once, with their signatures: a
    window after an Arrow function would shuffle them again.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    count = 2 * parts(docs.sparkSession)
    cuts = docs.agg(F.percentile_approx(F.col(doc_id), [i / count for i in range(1, count)], 20 * count)).first()[0] or []
    often = sorted({c for c in cuts if cuts.count(c) > 1})
    h = F.xxhash64("text")
    many = F.col("doc_id").isNull() | (F.col("doc_id").isin(often) if often else F.lit(False))
    steps = F.array(*[F.lit(c) for c in sorted(set(cuts))]) if cuts else F.array().cast(f"array<{rows.schema['doc_id'].dataType.simpleString()}>")
    rows = rows.select(
        "doc_id", "text", h.alias("h"),
        F.when(F.col("doc_id").isNull(), F.lit(count + 1)).otherwise(F.size(F.filter(steps, lambda c: c > F.col("doc_id")))).alias("cut"),
        F.when(many, F.shiftright(h, 54).cast("int") + 513).otherwise(F.lit(0)).alias("sub"))

    first = rows.groupBy("cut", "sub").agg(F.max_by("text", F.struct("doc_id", F.bitwise_not("h"))).alias("text"))
    ranges = rows.select("cut", "sub").distinct()
    every = Window.orderBy("cut", "sub")
    start = F.min(F.struct("cut", "sub")).over(Window.partitionBy())
    after = ranges.select("cut", "sub", F.coalesce(F.lead(F.struct("cut", "sub")).over(every), start).alias("to"))
    border = after.join(first.select(F.struct("cut", "sub").alias("to"), "text"), "to").select(
        "cut", "sub", F.col("text").alias("border"), signature(F.col("text")).alias("border_sign"))

    own = Window.partitionBy("cut", "sub").orderBy(F.desc_nulls_last("doc_id"), "h")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    out = rows.withColumn("sign", signature(F.col("text"))) \
        .select("*", F.lead("text").over(own).alias("next"), F.lead("sign").over(own).alias("next_sign")) \
        .join(border, ["cut", "sub"], "left").withColumn("next", F.coalesce("next", "border"))
    out = out.withColumn("edited", F.concat(F.substr("text", F.lit(1), n - half), F.substr("next", F.lit(1), half)))
    return out.select(F.col("doc_id").alias(doc_id), "text", "sign", "next", "edited", signature(F.col("edited")).alias("edited_sign"),
                      F.coalesce("next_sign", "border_sign").alias("next_sign"))
