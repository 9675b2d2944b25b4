"""Toxicity classifier on the words of a text, regularised by counterfactuals.

Logistic regression on the presence of words and of word beginnings. For every labelled text that mentions an identity term, the
term is swapped for the other terms of its group and for none; into a seeded part of all labelled texts the terms of
a group are inserted, so that terms are held neutral which no labelled text names. The squared change of the text's logit is
added to the loss. Mentions of a group then carry no score of their own, and texts that only name a group
are not rejected.

The words are chosen and the weights fitted on a bounded sample of labelled rows (``sample``): words by
chi-square, weights by Newton steps with conjugate gradients. Scoring is map-only over whole texts.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from digitscope.llm.shared import slices, stored

# Labelled rows that are used at most, words of the model at most, and labelled rows a word stands in at least.
SAMPLE, WORDS, LEAST = 20_000, 4096, 8
# Part of the labelled texts that get the terms of a group.
INSERTED = 0.25
# Letters of a word's beginning.
BEGINNING = 5

# Groups of terms that are swapped with each other, in English, German, French and Spanish.
IDENTITY = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"),
    ("gay", "lesbian", "straight", "transgender"),
    ("immigrant", "refugee", "citizen"),
    ("immigrants", "refugees", "citizens"),
    ("disabled", "deaf", "blind"),
    ("young", "old", "elderly"),
    ("frauen", "männer"),
    ("frau", "mann"),
    ("mädchen", "jungen"),
    ("christ", "muslim", "jude", "hindu", "buddhist", "atheist"),
    ("christen", "muslime", "juden", "hindus", "buddhisten", "atheisten"),
    ("schwarze", "weiße", "asiaten", "latinos"),
    ("schwul", "lesbisch", "heterosexuell", "transgender"),
    ("einwanderer", "flüchtling", "bürger"),
    ("behindert", "gehörlos", "blind"),
    ("femmes", "hommes"),
    ("femme", "homme"),
    ("filles", "garçons"),
    ("chrétien", "musulman", "juif", "hindou", "bouddhiste", "athée"),
    ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées"),
    ("noirs", "blancs", "asiatiques", "latinos"),
    ("gay", "lesbienne", "hétérosexuel", "transgenre"),
    ("immigré", "réfugié", "citoyen"),
    ("handicapé", "sourd", "aveugle"),
    ("mujeres", "hombres"),
    ("mujer", "hombre"),
    ("niñas", "niños"),
    ("cristiano", "musulmán", "judío", "hindú", "budista", "ateo"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos"),
    ("negros", "blancos", "asiáticos", "latinos"),
    ("gay", "lesbiana", "heterosexual", "transgénero"),
    ("inmigrante", "refugiado", "ciudadano"),
    ("discapacitado", "sordo", "ciego"),
)

_WORDS = re.compile(r"[^\W\d_]+").findall


def words_of(text: str | None) -> set[str]:
    """Distinct words of the lower-cased text."""
    return set(_WORDS(text.lower())) if text else set()


def features(words: set[str]) -> set[str]:
    """The words, and the beginnings of the longer ones, marked by a hyphen."""
    return words | {w[:BEGINNING] + "-" for w in words if len(w) > BEGINNING}


@dataclass
class Model:
    """Weights of words and of the constant; a text's logit is their sum. ``pairs`` counts the counterfactuals of the fit."""

    bias: float
    weights: dict[str, float] = field(default_factory=dict)
    pairs: int = 0

    def score(self, text: str | None) -> float:
        logit = self.bias + sum(self.weights.get(w, 0.0) for w in sorted(features(words_of(text)) & self.weights.keys()))
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, logit))))


def swaps(words: set[str], groups=IDENTITY) -> list[tuple[set[str], set[str]]]:
    """Counterfactuals of a text's words, for each other term of a group that it names and for none.

    Each is the pair of features that go and features that come.
    """
    out, before = [], features(words)
    for group in groups:
        rest = words - set(group)
        if rest != words:
            for other in (set(), *({term} for term in group)):
                after = features(rest | other)
                if after != before:
                    out.append((before - after, after - before))
    return out


def inserted(text: str, groups=IDENTITY, share: float = INSERTED) -> list[tuple[set[str], set[str]]]:
    """Counterfactuals of a text that gains a term, for each term of one group; for the ``share`` of texts that their hash draws.

    Each is the pair of features that go (none) and features that come, as ``swaps`` gives them.
    """
    draw, groups = zlib.crc32(text.encode()), tuple(groups)
    if not groups or draw % 1000 >= 1000 * share:
        return []
    words = words_of(text)
    before = features(words)
    more = [features(words | {term}) - before for term in groups[draw // 1000 % len(groups)]]
    return [(set(), come) for come in more if come]


def fit(rows: list[list[int]], labels: np.ndarray, pairs: list[tuple[list[int], list[int]]], size: int,
        ridge: float = 0.3, penalty: float = 10.0, steps: int = 25) -> np.ndarray:
    """Weights (``size`` words, then the constant) by Newton's method.

    Minimises the summed logistic loss, plus ``ridge / 2`` times the squared weights without the constant,
    plus ``penalty / 2`` times the squared logit changes of the counterfactual ``pairs`` of word numbers.
    """
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    word = np.fromiter((w for r in rows for w in r), np.int64, len(at))
    sign = np.concatenate([np.r_[-np.ones(len(a)), np.ones(len(b))] for a, b in pairs]) if pairs else np.zeros(0)
    pair_at = np.repeat(np.arange(len(pairs)), [len(a) + len(b) for a, b in pairs])
    pair_word = np.fromiter((w for a, b in pairs for w in (*a, *b)), np.int64, len(pair_at))

    def logits(w):
        return np.bincount(at, w[word], len(rows)) + w[-1]

    def back(r):
        return np.append(np.bincount(word, r[at], size), r.sum())

    def shape(w):
        change = np.bincount(pair_at, sign * w[pair_word], len(pairs)) if len(pairs) else np.zeros(0)
        pull = np.bincount(pair_word, sign * change[pair_at], size) if len(pairs) else np.zeros(size)
        return np.append(ridge * w[:-1] + penalty * pull, 1e-6 * w[-1])

    def loss(w):
        z = logits(w)
        return np.logaddexp(0, z).sum() - (labels * z).sum() + 0.5 * w @ shape(w)

    w = np.zeros(size + 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(logits(w), -500, 500)))
        gradient = back(p - labels) + shape(w)
        norm = np.linalg.norm(gradient)
        if norm < 1e-6 * max(1, len(rows)):
            break
        curve = np.maximum(p * (1 - p), 1e-9)
        step, left = np.zeros_like(w), -gradient
        way, old = left.copy(), left @ left
        for _ in range(60):
            bent = back(curve * (logits(way))) + shape(way)
            length = old / (way @ bent)
            step += length * way
            left = left - length * bent
            new = left @ left
            if math.sqrt(new) < 1e-3 * norm:
                break
            way, old = left + new / old * way, new
        scale, now = 1.0, loss(w)
        while scale > 1e-4 and loss(w + scale * step) > now:
            scale /= 2
        w = w + scale * step
    return w


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
          sample: int = SAMPLE, ridge: float = 0.3, penalty: float = 10.0, groups=IDENTITY, share: float = INSERTED) -> Model:
    """Fit a model on at most ``sample`` labelled rows, those of the smallest hashes of their id.

    Terms of ``groups`` are inserted into the ``share`` of these texts.

    A repeated id is toxic if one of its labels is, and takes its smallest text; null labels and ids are
    left out; without labelled rows the model scores every text 0. Words of the sample are counted
    by Spark; word numbers of the sample's rows come to the driver, at most ``sample`` times ``WORDS``.
    """
    key = F.col(doc_id)
    chosen = labels.where(key.isNotNull() & F.col(label).isNotNull()).groupBy(key.alias("id")).agg(
        F.max(F.col(label).cast("int")).alias("label")).orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = stored(docs.select(key.alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")
                   .groupBy("id").agg(F.min("text").alias("text"), F.max("label").alias("label")))
    total, toxic = texts.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not total:
        return Model(-700.0)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [(w, y) for t, y in zip(part.column("text").to_pylist(), part.column("label").to_pylist(), strict=True) for w in features(words_of(t))]
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int32())],
                                                 ["word", "label"])

    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    counted = texts.mapInArrow(spread, "word string, label int").groupBy("word").agg(
        F.count("*").alias("n"), F.sum("label").alias("k")).where(F.col("n") >= LEAST)
    away = k * total - n * toxic
    best = counted.orderBy((away * away / (n * (total - n + 1))).desc(), "word").limit(WORDS)
    vocabulary = sorted({r.word for r in best.select("word").collect()} | features({w for g in groups for w in g}))
    number = {w: i for i, w in enumerate(vocabulary)}

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows, gone, come = [], [], []
                for t in part.column("text").to_pylist():
                    words = words_of(t)
                    rows.append(sorted(number[w] for w in features(words) if w in number))
                    other = swaps(words, groups) + inserted(t or "", groups, share)
                    gone.append([sorted(number[w] for w in a if w in number) for a, _ in other])
                    come.append([sorted(number[w] for w in b if w in number) for _, b in other])
                deep = pa.list_(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), pa.array(rows, pa.list_(pa.int32())),
                                                  pa.array(gone, deep), pa.array(come, deep)], ["id", "label", "words", "gone", "come"])

    kind = texts.schema["id"].dataType.simpleString()
    rows = texts.mapInArrow(numbered, f"id {kind}, label int, words array<int>, gone array<array<int>>, come array<array<int>>") \
        .orderBy("id").toArrow()
    pairs = [(a, b) for gone, come in zip(rows["gone"].to_pylist(), rows["come"].to_pylist(), strict=True) for a, b in zip(gone, come, strict=True)]
    weights = fit(rows["words"].to_pylist(), rows["label"].to_numpy().astype(float), pairs, len(vocabulary), ridge, penalty)
    return Model(float(weights[-1]), {w: float(weights[i]) for w, i in number.items() if weights[i]}, len(pairs))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """Add ``name`` (double, 0 to 1): how likely the whole text is toxic; null and empty texts get the constant's.

    Map-only; the model's few thousand weights travel with the tasks. Other columns pass through.
    """
    kept = [c for c in docs.columns if c != name]
    schema = docs.select(*kept, F.lit(None).cast("double").alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                got = pa.array([model.score(t) for t in part.column(text).to_pylist()], pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, got], [*kept, name])

    return docs.select(*kept).mapInArrow(run, schema)
