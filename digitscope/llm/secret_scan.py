"""Secret scan over a trigram inverted index, in DataFrame functions only.

From each rule's regular expression a Boolean trigram query is derived: alternatives of sets of trigrams of
which one set must stand in any text that matches. The index holds a posting (trigram, document) for every
trigram that the rules ask for; postings are intersected per alternative, and only the documents found are
verified with the expression. Rules without mandatory trigrams are run over all texts.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from re import _constants as ops, _parser as parser

from pyspark.sql import Column, DataFrame, functions as F

from digitscope.functions.lets import let, running_sum
from digitscope.llm.shared import stored

# Strings that a part of an expression is expanded into at most before its trigrams are taken.
EXPANDED = 64


def either(words: str) -> str:
    """A pattern for ASCII text in either case."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in words)


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches whose ``group`` has fewer than ``least`` characters are dropped.

    The pattern must mean the same in Java and in Python, and must not match the empty string. A rule with ``end`` is one for keys
    between two marks (``pattern`` and ``end``); its spans hold their contents.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    end: str | None = None


# The base kinds. A run of 32 or more hex digits is the only match of the run, so the
# length can stand in the pattern of the last one.
BASE = (
    Rule("assign", "(" + "|".join(map(either, ("password", "passwd", "secret", "token", "api_?key")))
         + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", "AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", "[0-9a-f]{32,}", 0, 32),
)
# A private key: what stands between its marks is headers and long runs of base64, the last of which may be short. Without such contents, or
# without END, the marks are covered with what follows BEGIN up to the first word that is neither. Escaped line ends count as blanks.
PEM_BEGIN, PEM_END = "-----BEGIN [A-Z ]*PRIVATE KEY-----", "-----END [A-Z ]*PRIVATE KEY-----"
_B64 = "[A-Za-z0-9+/]"
_LONG = _B64 + r"{16,}={0,2}(?!\S)"
_KEYLIKE = rf"{_LONG}|{_B64}+={{1,2}}(?!\S)|[A-Z][A-Za-z]+-[A-Z][A-Za-z]+:(?!\S)"
# A word that is no part of a key, nor the value of a header. A short last line after a long one is a part.
_OTHER = rf"(?<!\S)(?<![A-Za-z]:[ \t])(?!{_KEYLIKE}|(?<={_B64}{{16}}(?:\r\n|\n|  )){_B64}+(?:\r?\n|  |\z))\S"
_OTHER_INSIDE = rf"(?<!\S)(?<![A-Za-z]:[ \t])(?!{_KEYLIKE}|{_B64}+={{0,2}}\s*\z)\S"
_HEADER_LINES = r"(?m)^[ \t]*[A-Z][A-Za-z]+-[A-Z][A-Za-z]+:[^\n]*$"
# Forms of well-known credentials.
MORE = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", "AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("stripe", "[sr]k_live_[A-Za-z0-9]+", 0, 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("pem", PEM_BEGIN, end=PEM_END),
)
RULES = BASE + MORE


def _needed(strings: set[str]) -> list[frozenset[str]]:
    """Alternatives of trigram sets for a text that holds one of the strings; an empty set means any text."""
    sets = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings}
    return [s for s in sets if not any(other < s for other in sets)]


def _both(left: list[frozenset[str]], right: list[frozenset[str]]) -> list[frozenset[str]]:
    sets = {a | b for a in left for b in right}
    return [s for s in sets if not any(other < s for other in sets)]


def _strings(op, value) -> set[str] | None:
    """All lower-cased strings that a part of an expression can match, if they are few."""
    if op is ops.LITERAL:
        return {chr(value).lower()}
    if op is ops.AT:
        return {""}
    if op is ops.IN:
        if all(o is ops.LITERAL for o, _ in value):
            return {chr(v).lower() for _, v in value}
        return None
    if op is ops.SUBPATTERN:
        return _sequence_strings(value[-1])
    if op is ops.BRANCH:
        found = [_sequence_strings(branch) for branch in value[1]]
        return None if None in found else set().union(*found)
    if op is ops.MAX_REPEAT and value[1] is not ops.MAXREPEAT and value[1] <= 4:
        inner = _sequence_strings(value[2])
        if inner is None:
            return None
        out, power = set(), {""}
        for n in range(value[1] + 1):
            out |= power if n >= value[0] else set()
            power = {a + b for a in power for b in inner}
            if len(power) > EXPANDED:
                return None
        return out
    return None


def _sequence_strings(items) -> set[str] | None:
    out = {""}
    for op, value in items:
        part = _strings(op, value)
        if part is None or len(out) * len(part) > EXPANDED:
            return None
        out = {a + b for a in out for b in part}
    return out


def _sequence_query(items) -> list[frozenset[str]]:
    query, held = [frozenset()], {""}
    for op, value in items:
        part = _strings(op, value)
        if part is not None and len(held) * len(part) <= EXPANDED:
            held = {a + b for a in held for b in part}
            continue
        query, held = _both(query, _needed(held)), {""}
        if part is not None:
            held = part
        elif op is ops.SUBPATTERN:
            query = _both(query, _sequence_query(value[-1]))
        elif op is ops.BRANCH:
            sets = {s for branch in value[1] for s in _sequence_query(branch)}
            query = _both(query, [s for s in sets if not any(other < s for other in sets)])
        elif op is ops.MAX_REPEAT and value[0] >= 1:
            query = _both(query, _sequence_query(value[2]))
    return _both(query, _needed(held))


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives of lower-cased trigram sets, one of which every matching text holds in full.

    An empty list says that the pattern has no mandatory trigrams.
    """
    found = _sequence_query(parser.parse(pattern))
    return [] if frozenset() in found else sorted(found, key=sorted)


def _clauses(rules: Sequence[Rule]) -> list[tuple[str, int, list[str]]]:
    return [(r.kind, i, sorted(clause)) for r in rules for i, clause in enumerate(trigram_query(r.pattern))]


def postings(docs: DataFrame, trigrams: Sequence[str], key: str, text: str) -> DataFrame:
    """The inverted index ``(trigram, key)`` of the texts for the given lower-cased trigrams. Map-only."""
    low = docs.select(F.col(key), F.lower(text).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.col("low").contains(t), F.lit(t)) for t in trigrams]))
    return low.select(F.explode(held).alias("trigram"), key)


def candidates(index: DataFrame, rules: Sequence[Rule], key: str) -> DataFrame:
    """``(key, kinds)``: the rules of which one alternative's postings all hold the document."""
    rows = [(kind, number, trigram, 1 << bit, (1 << len(clause)) - 1)
            for kind, number, clause in _clauses(rules) for bit, trigram in enumerate(clause)]
    asked = index.sparkSession.createDataFrame(rows, "kind string, clause int, trigram string, bit long, whole long")
    return (index.join(F.broadcast(asked), "trigram")  # as many rows as the rules have trigrams
            .groupBy(key, "kind", "clause").agg(F.bit_or("bit").alias("bits"), F.first("whole").alias("whole"))
            .where("bits = whole").groupBy(key).agg(F.collect_set("kind").alias("kinds")))


def spans(text: Column, rule: Rule, order: int) -> Column:
    """Matches of a rule as ``array<struct<start, rank, kind, end>>``; code points, the end exclusive."""
    if rule.end:
        return _enclosed(text, rule, order)
    pattern = F.lit(rule.pattern)
    cut = F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("found"),
                   (F.regexp_extract_all(text, pattern, F.lit(rule.group))).alias("value"),
                   F.split(text, rule.pattern, -1).alias("gaps"))

    def placed(c: Column) -> Column:
        lengths = F.flatten(F.zip_with(c["gaps"], c["found"], lambda g, f: F.array(
            F.length(g).cast("bigint"), F.coalesce(F.length(f), F.lit(0)).cast("bigint"))))
        return let(running_sum(lengths), lambda ends: F.filter(F.transform(c["value"], lambda v, i: F.when(
            F.length(v) >= rule.least, F.struct(F.get(ends, i * 2).alias("start"), F.lit(order).alias("rank"),
                                                F.lit(rule.kind).alias("kind"), F.get(ends, i * 2 + 1).alias("end")))),
            lambda s: s.isNotNull()))

    return let(cut, lambda c: F.when(F.size(c["found"]) > 0, placed(c)).otherwise(F.array().cast(SPANS)))


def _enclosed(text: Column, rule: Rule, order: int) -> Column:
    """Spans of keys between marks. Each BEGIN is paired with the first END before the next BEGIN; all steps are linear in the text."""
    def size(c: Column) -> Column:
        return F.length(c).cast("bigint")

    def span(start: Column, end: Column) -> Column:
        return F.array(F.struct(start.alias("start"), F.lit(order).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end")))

    def one(mark: Column, start: Column, after: Column) -> Column:
        stop = start + size(mark)
        parts = F.struct(F.get(F.split(after, rule.end, 2), F.lit(0)).alias("body"), F.regexp_extract(after, rule.end, 0).alias("end"))

        def judged(p: Column) -> Column:
            flat = F.regexp_replace(p["body"], r"\\[nrt]", "  ")  # as long as before
            closed = p["end"] != ""
            rest = F.regexp_replace(flat, _HEADER_LINES, "")
            whole = closed & ~rest.rlike(_OTHER_INSIDE) & (rest.rlike(_LONG) | (F.trim(F.regexp_replace(rest, r"\s", "")) == ""))
            like = F.regexp_replace(F.get(F.split(flat, _OTHER, 2), F.lit(0)), r"\s+\z", "")
            kept = F.when(like.rlike(_LONG), size(like)).otherwise(0)
            last = stop + size(p["body"])
            return F.when(whole, span(start, last + size(p["end"]))).when(closed, F.concat(span(start, stop + kept), span(last, last + size(p["end"])))).otherwise(
                span(start, stop + kept))

        return let(parts, judged)

    cut = F.struct(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("found"), F.split(text, rule.pattern, -1).alias("gaps"))

    def placed(c: Column) -> Column:
        lengths = F.flatten(F.zip_with(c["gaps"], c["found"], lambda g, f: F.array(size(g), F.coalesce(size(f), F.lit(0).cast("bigint")))))
        return let(running_sum(lengths), lambda ends: F.flatten(F.transform(c["found"], lambda f, i: one(f, F.get(ends, i * 2), F.get(c["gaps"], i + 1)))))

    return let(cut, lambda c: F.when(F.size(c["found"]) > 0, placed(c)).otherwise(F.array().cast(SPANS)))


SPANS = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Add ``spans``: all secrets of each whole text, by start, then by the order of the rules.

    Matches of one rule are leftmost and do not overlap; those of different rules may. Offsets are code
    points. Null and empty texts have no spans; repeated rows keep their rows; null ids are fine, for
    documents are known to the index by a hash of id and text. Other columns pass through; a column
    ``spans`` is replaced. The documents found by the index are joined back by that hash: Spark broadcasts
    them while they are few.
    """
    if len({r.kind for r in rules}) < len(rules):
        raise ValueError("each kind needs one rule")
    kept = [c for c in docs.columns if c != "spans"]
    keyed = docs.select(F.struct(*kept).alias("doc"), F.col(text).alias("text"), F.xxhash64(doc_id, text).alias("key"))
    trigrams = sorted({t for _, _, clause in _clauses(rules) for t in clause})
    if trigrams:
        found = stored(candidates(postings(keyed, trigrams, "key", "text"), rules, "key"))
        keyed = keyed.join(found, "key", "left")
    else:
        keyed = keyed.withColumn("kinds", F.lit(None).cast("array<string>"))
    each = []
    for order, rule in enumerate(rules):
        own = spans(F.col("text"), rule, order)
        if trigram_query(rule.pattern):
            own = F.when(F.array_contains("kinds", rule.kind), own).otherwise(F.array().cast(SPANS))
        else:
            own = F.when(F.col("text").isNotNull(), own).otherwise(F.array().cast(SPANS))
        each.append(own)
    return keyed.select("doc.*", F.array_sort(F.concat(*each)).alias("spans"))


def redacted(text: Column, found: Column, mark: str = "[secret]") -> Column:
    """The text with every run of overlapping spans (sorted by start) replaced by ``mark``."""
    state = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))

    def take(start: Column, end: Column) -> Column:
        return F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))

    def step(acc: Column, s: Column) -> Column:
        return F.when(s["start"] >= acc["at"], F.struct(
            s["end"].alias("at"), F.concat(acc["out"], F.array(take(acc["at"], s["start"]), F.lit(mark))).alias("out"),
        )).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))

    def finish(acc: Column) -> Column:
        return F.concat(F.array_join(acc["out"], ""), take(acc["at"], F.length(text).cast("bigint")))

    return F.when(F.size(found) > 0, F.aggregate(found, state, step, finish)).otherwise(text)


def masked(docs: DataFrame, rules: Sequence[Rule] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All documents with the secrets of ``text`` replaced by a mark; the columns stay as they are."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.col(doc_id).alias("id"), F.col(text).alias("text"))
    found = scan(whole, rules, "id", "text")
    return found.select(*[redacted(F.col("text"), F.col("spans")).alias(c) if c == text else F.col(f"d.`{c}`") for c in docs.columns])
