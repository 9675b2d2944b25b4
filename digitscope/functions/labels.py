"""Ordered rule labels: subject domains and number categories."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from digitscope.functions.lets import escape, let
from digitscope.rules.declared_rules import DECLARED_RULES
from digitscope.rules.domains import DEFAULT_DOMAIN, DOMAIN_KEYWORDS
from digitscope.rules.number_rules import GENERIC_LABEL, OBSERVED_RULES, TRIGGERS, YEAR_LABEL, YEAR_RANGE

# Word characters: letters, numbers of every kind (so also superscripts) and the underscore.
WORD = r"\p{L}\p{N}_"
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"


def unicode_regex(pattern: str) -> str:
    r"""Spell out ``\b``, ``\d``, ``\s`` and ``.`` in their Unicode sense, ignoring case.

    The short classes differ between regex engines: superscripts are word characters in some,
    a no-break space is a space in some. Explicit classes mean the same everywhere. A boundary
    needs only one side checked where the pattern settles the other: before a digit, a letter or
    a group of words, and after a letter, a repetition, a class or a group that is not optional.
    A decimal number gives nothing back once it is read, or long digit runs would take quadratic
    time; so no pattern may continue a number with a digit, a comma or a point.
    """
    before, after = f"(?<![{WORD}])", f"(?![{WORD}])"
    out = re.sub(r"\\b(?=\\d)", lambda _: rf"(?=\p{{Nd}}){before}", pattern)
    out = re.sub(r"\\b(?=\w|\((?:\?:)?\w)", lambda _: before, out)
    out = re.sub(r"(?<=[\w}\])])\\b", lambda _: after, out)
    out = out.replace(r"[\d,]*\.?\d*", r"[\d,]*+\.?+\d*+")
    out = out.replace(r"\d+\.?\d*", r"\d++\.?+\d*+")
    out = out.replace(r"\b", f"(?:(?<=[{WORD}]){after}|{before}(?=[{WORD}]))")
    return "(?iu)" + out.replace(r"\d", r"\p{Nd}").replace(r"\s", SPACE).replace(".*", r"[^\n]*")


def first_match_label(col: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """Label of the first rule ``(label, regex)`` found in ``col``; ``default`` otherwise and for null."""
    out = None
    for label, pattern in rules:
        hit = col.rlike(pattern)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(F.lit(default))


def keyword_regex(keywords: Sequence[str]) -> str:
    """Whole-word, case-insensitive search for any of the keywords."""
    words = "|".join(escape(k) for k in keywords)
    return rf"(?iu)(?<![{WORD}])(?:{words})(?![{WORD}])"


def domain_of_type(infobox_type: Column) -> Column:
    """Domain of an infobox type, by the first domain with a keyword in it."""
    rules = [(domain, keyword_regex(words)) for domain, words in DOMAIN_KEYWORDS]
    return first_match_label(infobox_type, rules, DEFAULT_DOMAIN)


def year_or_generic(number_text: Column) -> Column:
    """``year`` when the truncated number lies in the year range, else ``generic``."""
    value = F.replace(number_text, F.lit(","), F.lit("")).try_cast("double")
    low, high = YEAR_RANGE
    return F.when((value >= low) & (value < high + 1), F.lit(YEAR_LABEL)).otherwise(F.lit(GENERIC_LABEL))


def _contains_any(text: Column, words: Sequence[str]) -> Column:
    """Whether any word occurs; short words, which are found more often, are tried first.

    A word that contains another one of the list adds nothing and is left out.
    """
    needed = [w for w in words if not any(o != w and o in w for o in words)]
    return F.exists(F.lit(sorted(needed, key=len)), lambda word: F.contains(text, word))


def number_category(number_text: Column, context: Column, rules=OBSERVED_RULES, triggers=TRIGGERS) -> Column:
    """Category of a number from its context.

    The first rule decides whose pattern is found and of whose triggers one occurs, provided the
    number itself is in the context; a rule without triggers needs any trigger at all. Otherwise
    the year heuristic applies, at once where no trigger occurs at all. Plain substring tests come before the
    pattern, which most contexts then never meet. The rules are evaluated inside a lambda, so that the lower-cased context is
    computed once and the long list stays out of the generated code of the surrounding stage.
    """
    def decide(ctx: Column, low: Column):
        for category, pattern, words in rules:
            found = ctx.rlike(unicode_regex(pattern))
            yield category, _contains_any(low, words) & found if words else found

    return _decide(number_text, context, context, decide, lambda low: _contains_any(low, triggers))


def declared_category(number_text: Column, context: Column, rules=DECLARED_RULES) -> Column:
    """Category by the rules for all declared categories, without trigger words."""
    def decide(ctx: Column, _: Column):
        for category, pattern in rules:
            yield category, ctx.rlike(unicode_regex(pattern))

    return _decide(number_text, context, F.replace(context, F.lit(","), F.lit("")), decide)


def _decide(number_text: Column, context: Column, searched: Column, decide, needed=None) -> Column:
    """First category of ``decide`` that applies, if the number is in ``searched``; else the year heuristic.

    Nothing but the heuristic is tried where ``needed`` does not hold for the lower-cased context.
    """
    number_text = number_text.cast("string")

    def body(bound: Column) -> Column:
        known = bound["present"] & needed(bound["low"]) if needed else bound["present"]
        out = F.when(~known, bound["fallback"])
        for category, hit in decide(bound["ctx"], bound["low"]):
            out = out.when(hit, F.lit(category))
        return out.otherwise(bound["fallback"])

    present = F.contains(searched, F.replace(number_text, F.lit(","), F.lit("")))
    return let(
        F.struct(context.alias("ctx"), F.lower(context).alias("low"), present.alias("present"),
                 year_or_generic(number_text).alias("fallback")),
        body,
    )
