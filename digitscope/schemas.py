"""Schemas of the tables the engine reads and writes."""

from pyspark.sql import types as T


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


NUMBERS = _schema(
    ("article_id", T.LongType()),
    ("domain", T.StringType()),
    ("number", T.DoubleType()),
    ("number_category", T.StringType()),
    ("first_digit", T.IntegerType()),
    ("second_digit", T.IntegerType()),
)

INDEX = _schema(("offset", T.LongType()), ("article_id", T.LongType()), ("title", T.StringType()))

PAGE = _schema(
    ("title", T.StringType()),
    ("ns", T.StringType()),
    ("id", T.StringType()),
    ("revision", _schema(("text", _schema(("_VALUE", T.StringType()))))),
)

# A page with the raw record where it is no XML.
PAGE_OR_BROKEN = _schema(*[(f.name, f.dataType) for f in PAGE], ("broken", T.StringType()))

# What a rejected page leaves: the unit it belongs to, why, and the digest of its raw record.
REJECTED = _schema(("unit_id", T.StringType()), ("reason", T.StringType()), ("digest", T.StringType()))

CATEGORY = _schema(
    ("number_category", T.StringType()),
    ("category_group", T.StringType()),
    ("expected_mad", T.StringType()),
    ("example", T.StringType()),
    ("mad_from", T.DoubleType()),
    ("mad_to", T.DoubleType()),
    ("expected_conformity", T.StringType()),
    ("description", T.StringType()),
    ("examples", T.ArrayType(T.StringType())),
    ("notes", T.StringType()),
    ("group_description", T.StringType()),
)

UNIT = _schema(("unit", T.StringType()), ("measure", T.StringType()))

LEDGER = _schema(
    ("unit_id", T.StringType()),
    ("status", T.StringType()),
    ("articles", T.LongType()),
    ("numbers", T.LongType()),
    ("retries", T.IntegerType()),
    ("error", T.StringType()),
    ("at", T.TimestampType()),
    ("rejected", T.LongType()),
)
