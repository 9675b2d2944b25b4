"""Near-duplicate embeddings by product quantisation: inverted lists, residual codes, exact rerank.

A bounded sample gives coarse centroids and, for each subspace of the residuals, a codebook; every vector is
indexed. On the unit sphere a cosine of at least ``least`` is a distance of at most ``r``. A vector probes all lists
that can hold a vector so near: list b is out if for a centroid c the squared distances to b's centroid
and to c differ by more than 2 r |b - c|, because b's vectors are nearer to b. In a list, distances
come from tables (query part, code) and are exact up to the stored error of the code, so candidates
within ``r`` plus that error lose nothing; they are reranked by the cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from digitscope.llm.components import components, join_labels
from digitscope.llm.shared import parts, stored

# Vectors that the quantisers are fitted on, lists, subspaces and codes at most.
SAMPLE, LISTS, SUBSPACES, CODES = 16_384, 1024, 8, 256
# Members of a list and queries to it that one unit of work compares.
MEMBERS, QUERIES = 4096, 8192
# Nearest centroids that rule out lists, and slack for rounding.
RULING, SLACK = 12, 1e-9


def centres(points: np.ndarray, count: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """K-means centroids of the points; fewer points than ``count`` are their own centroids."""
    pick = np.random.default_rng(seed)
    found = points[pick.permutation(len(points))[:count]].copy()
    for _ in range(rounds if len(points) > count else 0):
        to = nearest(points, found)
        sums = np.zeros_like(found)
        np.add.at(sums, to, points)
        held = np.bincount(to, minlength=len(found))
        found[held > 0] = sums[held > 0] / held[held > 0, None]
    return found


def squared(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Squared distances of all points to all of ``to``."""
    return np.maximum((points ** 2).sum(1)[:, None] - 2 * points @ to.T + (to ** 2).sum(1)[None, :], 0)


def nearest(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.concatenate([squared(points[i:i + 4096], to).argmin(1) for i in range(0, len(points), 4096)]) if len(points) else np.zeros(0, int)


class Quantiser:
    """Coarse centroids, and codebooks of the residuals' subspaces."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.coarse = centres(sample, lists)
        residual = sample - self.coarse[nearest(sample, self.coarse)]
        self.cuts = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
        self.books = [centres(residual[:, cut], CODES) for cut in self.cuts]
        self.apart = np.sqrt(squared(self.coarse, self.coarse))

    def encode(self, points: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and the distance that each vector has from what its code stands for."""
        residual = points - self.coarse[to]
        codes = np.stack([nearest(residual[:, cut], book) for cut, book in zip(self.cuts, self.books)], 1).astype(np.uint8)
        left = np.concatenate([residual[:, cut] - book[codes[:, m]] for m, (cut, book) in enumerate(zip(self.cuts, self.books))], 1)
        return codes, np.sqrt((left ** 2).sum(1))

    def probes(self, points: np.ndarray, to: np.ndarray, radius: float) -> list[list[int]]:
        """For each point all lists from its own number on that can hold a point within the radius."""
        far = squared(points, self.coarse)
        near = np.argsort(far, 1)[:, :RULING]
        open_ = np.arange(len(self.coarse))[None, :] >= to[:, None]
        for k in range(near.shape[1]):
            c = near[:, k]
            open_ &= far - far[np.arange(len(points)), c][:, None] <= 2 * radius * self.apart[c] + SLACK
        open_[np.arange(len(points)), to] = True
        return [np.flatnonzero(row).tolist() for row in open_]

    def tables(self, queries: np.ndarray, number: int) -> list[np.ndarray]:
        """Squared distances of the queries' residuals to every code of each subspace."""
        residual = queries - self.coarse[number]
        return [squared(residual[:, cut], book) for cut, book in zip(self.cuts, self.books)]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, width)


def valid(vector: Column) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _classes(vectors: DataFrame) -> tuple[DataFrame, list[int]]:
    """Distinct valid vectors, numbered: ``c, embedding, n, first``; and the lengths that more than one of them has."""
    good = vectors.where(valid(F.col("embedding")))
    classes = stored(good.groupBy("embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))
                     .select(F.monotonically_increasing_id().alias("c"), "embedding", "n", "first"))
    widths = classes.groupBy(F.size("embedding").alias("width")).count().where("count > 1").orderBy("width").collect()
    return classes, [r["width"] for r in widths]


def _found(classes: DataFrame, width: int, least: float) -> DataFrame:
    """Counts and links of the classes: rows ``(a, null, add)`` add links to a; rows ``(a, b, null)`` connect a and b."""
    spark, total = classes.sparkSession, classes.count()
    sample = _matrix(classes.orderBy(F.xxhash64("embedding"), "c").limit(SAMPLE).select("embedding").toArrow()
                     .column(0).combine_chunks(), max(1, width)) if total else np.zeros((0, 1))
    if not total:
        return spark.createDataFrame([], "a bigint, b bigint, add bigint")
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    tool = spark.sparkContext.broadcast(Quantiser(sample, max(1, min(LISTS, round(total ** 0.5), len(sample)))))
    radius = max(0.0, 2 - 2 * least) ** 0.5 + 1e-6

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                x = _matrix(part.column("embedding"), width)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                to = nearest(x, tool.value.coarse)
                codes, errors = tool.value.encode(x, to)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(n) for n in ("c", "n", "embedding")), pa.array(to, pa.int32()), pa.array(tool.value.probes(x, to, radius), pa.list_(pa.int32())),
                     pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(errors)], ["c", "n", "embedding", "list", "probes", "code", "error"])

    kind = classes.schema["embedding"].dataType.simpleString()
    indexed = stored(classes.select("c", "n", "embedding").mapInArrow(
        index, f"c bigint, n bigint, embedding {kind}, list int, probes array<int>, code binary, error double"))
    asking = indexed.select("c", "n", "embedding", F.col("list").alias("home"), F.explode("probes").alias("list"))
    # Tiles of members and of queries for each list; there are at most LISTS of them.
    members = {r[0]: r[1] for r in indexed.groupBy("list").count().collect()}
    queries = {r[0]: r[1] for r in asking.groupBy("list").count().collect()}
    lists = len(tool.value.coarse)
    own = F.array(*[F.lit(-(-members.get(i, 0) // MEMBERS) or 1) for i in range(lists)])
    others = F.array(*[F.lit(-(-queries.get(i, 0) // QUERIES) or 1) for i in range(lists)])

    def dealt(rows: DataFrame, tiles: Column, copies: Column, first: bool) -> DataFrame:
        tile = F.pmod(F.xxhash64("c"), F.get(tiles, F.col("list"))).cast("int")
        rows = rows.withColumn("tile", tile).withColumn("copy", F.explode(F.sequence(F.lit(0), F.get(copies, F.col("list")) - 1)))
        unit = F.struct("list", *(("tile", "copy") if first else ("copy", "tile")))
        return rows.select(F.xxhash64(unit).alias("unit"), F.lit(0).alias("side") if first else F.when(F.col("home") == F.col("list"), 2).otherwise(1).alias("side"), "list", "c", "n", "embedding",
                           *([F.col("code"), F.col("error")] if first else [F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("error")]))

    work = dealt(indexed, own, others, True).union(dealt(asking, others, own, False))
    # Units of equal hashes are told apart by the list; tiles of one list that meet are compared together, which repeats no pair.
    work = work.repartition(parts(spark), "unit").sortWithinPartitions("unit", "list", "side", "c")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = _Unit(tool.value, width, least, radius)
        for batch in batches:
            key = np.stack([batch.column("unit").to_numpy(), batch.column("list").to_numpy(), batch.column("side").to_numpy()], 1)
            edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            for i, j in zip(edges, edges[1:]):
                if i < j:
                    if unit.key != tuple(key[i, :2]):
                        yield from unit.result()
                        unit = _Unit(tool.value, width, least, radius, tuple(key[i, :2]))
                    part = batch.slice(i, j - i)
                    unit.ask(part, key[i, 2] == 2) if key[i, 2] else unit.hold(part)
        yield from unit.result()

    return stored(work.mapInArrow(compare, "a bigint, b bigint, add bigint"))


class _Unit:
    """Members of a list and the queries to them; keeps counts and a spanning forest of what it finds."""

    def __init__(self, tool: Quantiser, width: int, least: float, radius: float, key: tuple | None = None):
        self.tool, self.width, self.least, self.radius, self.key = tool, width, least, radius, key
        self.held: list[tuple] = []
        self.ready = None
        self.number: dict[int, int] = {}
        self.add: list[int] = []
        self.labels = np.zeros(0, np.int64)

    def _rows(self, batch: pa.RecordBatch) -> tuple:
        x = _matrix(batch.column("embedding"), self.width)
        return batch.column("c").to_numpy(), batch.column("n").to_numpy(), x, np.linalg.norm(x, axis=1)

    def hold(self, batch: pa.RecordBatch) -> None:
        codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
        self.held.append((*self._rows(batch), codes, batch.column("error").to_numpy()))

    def ask(self, batch: pa.RecordBatch, own: bool) -> None:
        """Compare queries of another list, or of the list itself, whose pairs are met from the smaller number only."""
        if self.ready is None:
            self.ready = [np.concatenate(x) for x in zip(*self.held)] if self.held else []
        if not self.ready:
            return
        c, n, x, norm, codes, error = self.ready
        ids, times, y, size = self._rows(batch)
        for at in range(0, len(ids), 256):
            part = slice(at, at + 256)
            tables = self.tool.tables(y[part] / size[part, None], self.key[1])
            far = tables[0][:, codes[:, 0]]
            for m in range(1, len(tables)):
                far += tables[m][:, codes[:, m]]
            q, k = np.nonzero(far <= ((self.radius + error + SLACK) ** 2)[None, :] + SLACK)
            q = q + at
            if own:
                keep = ids[q] < c[k]
                q, k = q[keep], k[keep]
            for i in range(0, len(q), 1 << 16):
                a, b = q[i:i + (1 << 16)], k[i:i + (1 << 16)]
                cosine = np.einsum("ij,ij->i", y[a], x[b]) / (size[a] * norm[b])
                near = cosine >= self.least
                self._link(ids[a[near]], times[a[near]], c[b[near]], n[b[near]])

    def _link(self, a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> None:
        if not len(a):
            return
        found = np.concatenate([a, b])
        for node in dict.fromkeys(found.tolist()):
            if node not in self.number:
                self.number[node] = len(self.number)
        if len(self.labels) < len(self.number):
            self.labels = np.concatenate([self.labels, np.arange(len(self.labels), len(self.number))])
            self.add += [0] * (len(self.number) - len(self.add))
        at = np.fromiter((self.number[v] for v in found.tolist()), np.int64, len(found))
        gain = np.bincount(at, np.concatenate([nb, na]), len(self.number)).astype(np.int64)
        self.add = (np.asarray(self.add, np.int64) + gain).tolist()
        join_labels(self.labels, at[:len(a)], at[len(a):])

    def result(self) -> Iterator[pa.RecordBatch]:
        if self.number:
            nodes = np.fromiter(self.number, np.int64, len(self.number))
            some = np.flatnonzero(self.labels != np.arange(len(nodes)))
            none = [None] * len(nodes)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(none, pa.int64()), pa.array(self.add, pa.int64())], ["a", "b", "add"])
            yield pa.RecordBatch.from_arrays([pa.array(nodes[self.labels[some]]), pa.array(nodes[some]), pa.array([None] * len(some), pa.int64())],
                                             ["a", "b", "add"])


def near_duplicates(vectors: DataFrame, least: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per vector: ``vec_id, n_links`` (other vectors of cosine ``least`` or more), ``component`` (smallest id
    reachable by links, itself included) and ``kept`` (it is that vector).

    Equal vectors are one class with a count; links are searched between classes and counted for all their
    members, with a search for each length of vectors. Vectors that are null, empty, zero or not finite throughout
    link with nothing. Null ids take part and get the smallest other id of their component; repeated rows are vectors of
    their own.
    """
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding"))
    classes, widths = _classes(rows)
    found = rows.sparkSession.createDataFrame([], "a bigint, b bigint, add bigint")
    for width in widths:
        found = found.union(_found(classes.where(F.size("embedding") == width), width, least))
    added = found.where("add IS NOT NULL").groupBy(F.col("a").alias("c")).agg(F.sum("add").alias("add"))
    roots = components(found.where("b IS NOT NULL").select("a", "b"))
    member = stored(classes.join(roots, classes["c"] == roots["node"], "left").join(added, "c", "left").select(
        "embedding", "first", F.coalesce("root", "c").alias("root"), (F.col("n") - 1 + F.coalesce("add", F.lit(0))).alias("n_links")))
    smallest = stored(member.groupBy("root").agg(F.min("first").alias("component")))
    answer = stored(member.join(smallest, "root").select("embedding", F.xxhash64("embedding").alias("key"), "n_links", "component"))
    keyed = rows.withColumn("key", F.when(valid(F.col("embedding")), F.xxhash64("embedding")))
    component = F.coalesce("component", "vec_id")
    return keyed.join(answer, ["key", "embedding"], "left").select(
        F.col("vec_id").alias(vec_id), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), component.alias("component"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
