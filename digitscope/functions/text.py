"""Finding numbers in text, with positions and surrounding context."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from digitscope.functions.labels import number_category
from digitscope.functions.lets import let, running_sum
from digitscope.rules.number_rules import GENERIC_LABEL

# Number tokens. Whole digit runs are consumed, so runs that begin with 0 or are
# longer than 16 digits become tokens of their own and are dropped by NOT_A_NUMBER afterwards.
TOKEN = r"0[0-9]*|[1-9][0-9]{16,}|[1-9][0-9]{0,15}(?:\.[0-9]+)?"
NOT_A_NUMBER = r"^(0|[1-9][0-9]{16,})"

# Exclusive upper bound of accepted numbers, context size in code points.
UPPER_BOUND = 1e16
WINDOW = 30


def has_number(text: Column) -> Column:
    """Cheap test that text may hold a number; used before the costly steps."""
    return text.rlike("[1-9]")


def _accepted(token: Column) -> Column:
    return ~token.rlike(NOT_A_NUMBER) & (token.cast("double") < F.lit(UPPER_BOUND))


def extract_numbers(text: Column) -> Column:
    """All numbers of a text as ``array<double>``, in order."""
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    return F.transform(F.filter(tokens, _accepted), lambda t: t.cast("double"))


def extract_contexts(text: Column, window: int = WINDOW, positions: bool = False) -> Column:
    """Numbers with ``window`` code points of context on either side.

    Returns ``array<struct<token, number, context[, start_pos, end_pos]>>``; positions are
    0-based code points, end exclusive. The text is cut into alternating gaps and tokens. Every
    piece but an outer gap has at least one character, so ``window`` neighbouring pieces always
    hold a full context, and gaps are trimmed to ``window`` characters before they are joined:
    the cost is linear in the text however many numbers it has.
    """
    w = F.lit(window)

    def head(s: Column) -> Column:
        return F.substring(s, F.lit(1), w)

    def tail(s: Column) -> Column:
        return F.when(F.length(s) > w, F.substring(s, -w, w)).otherwise(s)

    def interleave(gaps: Column, tokens: Column) -> Column:
        return F.flatten(F.zip_with(gaps, tokens, lambda g, t: F.array(g, F.coalesce(t, F.lit("")))))

    def pieces(cut: Column) -> Column:
        gaps, tokens = cut["gaps"], cut["tokens"]
        fields = [
            tokens.alias("tokens"), gaps.alias("gaps"),
            interleave(F.transform(gaps, tail), tokens).alias("before"),
            interleave(F.transform(gaps, head), tokens).alias("after"),
        ]
        if positions:
            spans = F.flatten(F.zip_with(gaps, tokens, lambda g, t: F.array(
                F.length(g).cast("bigint"), F.coalesce(F.length(t), F.lit(0)).cast("bigint"))))
            fields.append(running_sum(spans).alias("ends"))
        return F.struct(*fields)

    def one(p: Column, i: Column) -> Column:
        token = F.get(p["tokens"], i)
        at = i * 2 + 1                                     # index of the token among the pieces
        first = F.greatest(at - w, F.lit(0))
        gap_left, gap_right = F.get(p["before"], at - 1), F.get(p["after"], at + 1)
        left = F.when(F.length(gap_left) >= w, gap_left).otherwise(
            tail(F.array_join(F.slice(p["before"], first + 1, at - first), "")))
        right = F.when(F.length(gap_right) >= w, gap_right).otherwise(
            head(F.array_join(F.slice(p["after"], at + 2, w), "")))
        fields = [
            token.alias("token"), token.cast("double").alias("number"),
            F.concat(left, token, right).alias("context"),
        ]
        if positions:
            fields += [F.get(p["ends"], at - 1).alias("start_pos"), F.get(p["ends"], at).alias("end_pos")]
        return F.struct(*fields)

    cut = F.struct(
        F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)).alias("tokens"),
        F.split(text, TOKEN, -1).alias("gaps"),
    )
    return let(cut, lambda c: let(pieces(c), lambda p: F.transform(
        F.filter(
            F.transform(p["tokens"], lambda t, i: F.when(_accepted(t), i)),
            lambda i: i.isNotNull(),
        ),
        lambda i: one(p, i),
    )))


def extract_categorized(text: Column, window: int = WINDOW, categorize: bool = True,
                        positions: bool = False, category=number_category) -> Column:
    """Contexts with the category of each number; ``category`` maps token and context to a label."""
    def label(c: Column) -> Column:
        kind = category(c["token"], c["context"]) if categorize else F.lit(GENERIC_LABEL)
        fields = [c["number"].alias("number"), kind.alias("number_category"),
                  c["token"].alias("token"), c["context"].alias("context")]
        if positions:
            fields += [c["start_pos"].alias("start_pos"), c["end_pos"].alias("end_pos")]
        return F.struct(*fields)

    return F.transform(extract_contexts(text, window, positions), label)
