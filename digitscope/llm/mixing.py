"""Mixing sources to target weights by hierarchical budgeting.

A tree of weights (for instance domain, language, source) shares a token budget out from its root. A node's
children split its budget by weight; a child that cannot use its part gives it to its siblings, by
weight, and only what the whole family cannot use goes back to their parent's siblings. A leaf can use its
tokens once in each epoch. Every epoch of a leaf is a seeded order of its documents; whole epochs are taken
first, then the prefix of the next one that fills the budget.

Prefixes are found without sorting a leaf: tokens are summed in 256 bins of the order's hash, the bin in which the
budget ends is divided again, three times in all, and the last bin is summed up by itself. Documents are then
taken by comparing their hash with the leaf's last one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from digitscope.llm.shared import stored

# Name of the child that stands for all values which its siblings do not name.
OTHERS = "*"
# Nodes of a tree at most; tables with a row for each are broadcast.
NODES = 100_000
# Bits of the order's hash, bits that one level of bins divides, and levels.
BITS, BIN_BITS, LEVELS = 60, 8, 3


def share(budget: int, children: Sequence[tuple[int, int]]) -> list[int]:
    """Split a budget over children ``(weight, capacity)``: in proportion to weight, at most the capacity.

    What a full child leaves goes to the others by weight. Parts are rounded down.
    """
    parts = [0] * len(children)
    left, weight = budget, sum(w for w, _ in children)
    order = sorted((i for i, (w, _) in enumerate(children) if w > 0), key=lambda i: (children[i][1] / children[i][0], i))
    for at, i in enumerate(order):
        w, capacity = children[i]
        if capacity * weight > left * w:
            for j in order[at:]:
                parts[j] = left * children[j][0] // weight
            break
        parts[i] = capacity
        left, weight = left - capacity, weight - w
    return parts


def budgets(weights: Mapping[tuple[str, ...], int], capacity: Mapping[tuple[str, ...], int], budget: int) -> dict[tuple[str, ...], int]:
    """Tokens of every leaf path, from the root's budget down; ``capacity`` holds what each leaf can use."""
    children: dict[tuple[str, ...], list[tuple[str, ...]]] = {}
    able: dict[tuple[str, ...], int] = {}
    for path in weights:
        children.setdefault(path[:-1], []).append(path)
    for path, tokens in capacity.items():
        for depth in range(len(path) + 1):
            able[path[:depth]] = able.get(path[:depth], 0) + tokens
    out, open_ = {}, [((), min(budget, able.get((), 0)))]
    while open_:
        path, own = open_.pop()
        if path not in children:
            out[path] = own
            continue
        family = sorted(children[path])
        parts = share(own, [(weights[c], able.get(c, 0)) for c in family])
        open_ += zip(family, parts, strict=True)
    return out


def _checked(weights: Mapping[tuple[str, ...], int], depth: int) -> None:
    if len(weights) > NODES:
        raise ValueError(f"a tree has {NODES} nodes at most")
    for path, weight in weights.items():
        if weight < 0 or weight != int(weight) or not 1 <= len(path) <= depth:
            raise ValueError(f"node {path}: weights are whole numbers from 0, paths have up to {depth} names")
        if len(path) > 1 and path[:-1] not in weights:
            raise ValueError(f"node {path} has no parent")
        if len(path) < depth and not any(p[:-1] == path for p in weights):
            raise ValueError(f"node {path} has no children")


def leaves(docs: DataFrame, weights: Mapping[tuple[str, ...], int], keys: Sequence[str], leaf: str = "leaf") -> DataFrame:
    """Add ``leaf``, the number of the document's leaf in ``sorted(weights)``; null where the tree has no place for it."""
    order = {path: i for i, path in enumerate(sorted(weights))}
    rows = [(order.get(path[:-1], -1), path[-1], i, len(path)) for path, i in order.items()]
    tree = docs.sparkSession.createDataFrame(rows, "up int, name string, node int, depth int")
    out = docs.withColumn(leaf, F.lit(-1))
    for depth, key in enumerate(keys, 1):
        named = F.broadcast(tree.where((F.col("depth") == depth) & (F.col("name") != OTHERS)).select(
            F.col("up").alias("_up"), F.col("name").alias("_name"), F.col("node").alias("_named")))
        other = F.broadcast(tree.where((F.col("depth") == depth) & (F.col("name") == OTHERS)).select(F.col("up").alias("_any"), F.col("node").alias("_other")))
        out = out.join(named, (F.col(leaf) == F.col("_up")) & (F.col(key).cast("string") == F.col("_name")), "left") \
            .join(other, F.col(leaf) == F.col("_any"), "left") \
            .withColumn(leaf, F.coalesce("_named", "_other")).drop("_up", "_name", "_named", "_any", "_other")
    return out


def place(seed: int, epoch: Column, identity: Column) -> Column:
    """Place of a document in a seeded epoch: the first 60 bits of an MD5."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), identity))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("bigint")


def _starts(rows: DataFrame, at: Column) -> DataFrame:
    """``leaf, at, remain, start``: tokens of a leaf that stand before each value of ``at``, besides those ``before`` all rows."""
    earlier = Window.partitionBy("leaf").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return rows.groupBy("leaf", at.alias("at")).agg(F.sum("tokens").alias("n"), F.first("remain").alias("remain"), F.first("before").alias("before")).select(
        "leaf", "at", "remain", (F.col("before") + F.coalesce(F.sum("n").over(earlier), F.lit(0))).alias("start"))


def mix(docs: DataFrame, weights: Mapping[tuple[str, ...], int], keys: Sequence[str], tokens: Column, budget: int | float,
        epochs: int = 1, seed: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents of the mix, once for each ``epoch`` (from 0) they are taken in, with ``tokens`` and ``leaf``.

    ``weights`` gives every node's whole-number weight by its path of names, one name for each of ``keys``;
    ``"*"`` stands for values that its siblings do not name, nulls included, and what finds no place is
    left out. ``budget`` is a number of tokens, or as a float a share of all tokens that have a place. A leaf
    gives whole epochs and then, in hash order, each document before which fewer tokens than its budget
    stand, so it exceeds its budget by less than one document. Rows of equal ids share a place in the order and
    are taken together; null ids are told apart by text. Null token counts are 0. Columns named
    ``epoch``, ``tokens`` or ``leaf`` are replaced.
    """
    _checked(weights, len(keys))
    kept = [f"doc.`{c}`" for c in docs.columns if c not in ("epoch", "tokens", "leaf")]
    own = F.coalesce(F.col(doc_id).cast("string"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    # The caller's columns travel in one struct, so that none of their names can clash.
    named = [f"key{i}" for i in range(len(keys))]
    placed = leaves(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.coalesce(tokens, F.lit(0)).cast("bigint").alias("tokens"),
                                own.alias("identity"), *[F.col(k).alias(n) for k, n in zip(keys, named)]), weights, named).where(F.col("leaf").isNotNull())
    identity = F.col("identity")
    rows = stored(placed.select("leaf", "tokens", "identity"))
    names = sorted(weights)
    supply = {names[r[0]]: r[1] for r in rows.groupBy("leaf").agg(F.sum("tokens")).collect()}
    if isinstance(budget, float):
        budget = int(budget * sum(supply.values()))
    parts = budgets(weights, {p: n * epochs for p, n in supply.items()}, budget)
    plan = [(i, min(epochs, parts[p] // supply[p]), parts[p] % supply[p] if parts[p] // supply[p] < epochs else 0)
            for i, p in enumerate(names) if supply.get(p, 0) > 0 and parts.get(p, 0) > 0]
    plan = F.broadcast(docs.sparkSession.createDataFrame(plan, "leaf int, whole int, remain bigint"))

    hashed = rows.join(plan.where("remain > 0"), "leaf").withColumn("place", place(seed, F.col("whole"), F.col("identity"))) \
        .select("leaf", "remain", "place", "tokens", F.lit(0).cast("bigint").alias("before"))
    inside = hashed
    for level in range(1, LEVELS + 1):
        at = F.shiftright("place", BITS - level * BIN_BITS)
        starts = _starts(inside, at).where("start < remain")
        ends = stored(starts.groupBy("leaf").agg(F.max(F.struct("at", "start")).alias("e")).select("leaf", F.col("e.at").alias("end"), F.col("e.start").alias("before")))
        inside = hashed.drop("before").join(F.broadcast(ends), "leaf").where(at == F.col("end")).drop("end")
    last = stored(_starts(inside, F.col("place")).where("start < remain").groupBy("leaf").agg(F.max("at").alias("last")))

    own = place(seed, F.col("whole"), identity)
    taken = F.concat(F.when(F.col("whole") > 0, F.sequence(F.lit(0), F.col("whole") - 1)).otherwise(F.array().cast("array<int>")),
                     F.when(own <= F.col("last"), F.array("whole")).otherwise(F.array().cast("array<int>")))
    ends = F.broadcast(plan.join(F.broadcast(last), "leaf", "left"))  # a row per leaf of the tree at most
    return placed.join(ends, "leaf").select(*kept, "tokens", "leaf", F.explode(taken).alias("epoch"))
