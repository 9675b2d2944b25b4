"""Small expression helpers shared by the column functions."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` to a lambda variable so that ``body`` may use it often but it is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def literal_map(entries: Mapping[str, str | int]) -> Column:
    """Constant map, parsed from one SQL text; hundreds of single literals would be slow to assemble."""
    def text(value: str | int) -> str:
        if isinstance(value, int):
            return f"{value}L"
        return "'" + "".join(f"\\u{ord(ch):04x}" for ch in value) + "'"

    return F.expr("map(" + ", ".join(text(v) for pair in entries.items() for v in pair) + ")")


def running_sum(values: Column, block: int = 512) -> Column:
    """Inclusive running sums of an ``array<bigint>``.

    Works block by block: appending to one growing array would copy it once per element,
    while here only a block or the short array of block totals is ever copied.
    """
    zero = F.lit(0).cast("bigint")
    none = F.array().cast("array<bigint>")

    def scan(items: Column, start: Column) -> Column:
        return F.aggregate(
            items,
            F.struct(start.alias("at"), none.alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + x).alias("at"), F.array_append(acc["out"], acc["at"] + x).alias("out")
            ),
            lambda acc: acc["out"],
        )

    def run(arr: Column) -> Column:
        last = F.greatest(F.ceil(F.size(arr) / F.lit(block)).cast("int") - 1, F.lit(0))
        blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(arr, b * block + 1, F.lit(block)))
        return let(blocks, lambda bs: F.flatten(F.zip_with(
            bs,
            F.concat(F.array(zero), scan(F.transform(bs, lambda b: F.aggregate(b, zero, lambda a, x: a + x)), zero)),
            lambda b, start: F.when(b.isNotNull(), scan(b, start)).otherwise(none),
        )))

    return let(values, run)


def escape(word: str) -> str:
    """Quote a literal for a regular expression, in a form all regex dialects share."""
    return "".join("\\" + ch if ch in r"\.^$|?*+()[]{}" else ch for ch in word)

