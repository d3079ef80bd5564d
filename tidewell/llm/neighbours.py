"""Nearest neighbours by vantage-point trees, one per shard, with triangle-inequality pruning.

Pruning is relaxed by a factor: a branch is skipped if factor times its lower bound exceeds the distance of the k-th
neighbour found so far. Factor 1 is exact search. Trees are as lopsided as they can be, which prunes most where distances
are alike: a vantage point's inner branch is a bucket of the vectors nearest to it, the outer one all the rest. Shards are
cells of a bounded number of pivots, so whole shards are skipped in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, load, settle, tune

#: Neighbours of each vector; the factor; numbers in a shard's vectors; vectors in a bucket; queries in a task; pivots at most.
K, FACTOR, FLOATS, LEAF, BLOCK, PIVOTS = 10, 4.0, 1 << 22, 32, 8192, 4096
#: The query's own set: ids divisible by this are looked up, against all rows.
EVERY = 50
#: Distances count to so many places; what rounding may add to one.
PLACES, EPS = 6, 2e-6


def between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of a to all rows of b."""
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(d, 0.0))


class Tree:
    """A vantage-point tree over one shard, laid out flat, that is searched for many queries at once.

    Bucket j holds vectors whose distance to its vantage point is within [low, high]; all later buckets are `outer` away at
    least. computed counts the distances that searches took.
    """

    def __init__(self, vantage: np.ndarray, span: np.ndarray, sizes: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
        self.vantage, self.ids, self.v, self.computed = vantage, ids, vectors, 0
        self.low, self.high, self.outer = span.T
        self.end = np.cumsum(sizes)
        self.start = self.end - sizes

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> Tree:
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        x = vectors.astype(np.float32)
        x -= x.mean(0) if len(x) else 0
        half = (x.astype(np.float64) ** 2).sum(1)
        slack = 1e-3 * float(np.sqrt(half.max(initial=0)))  # of 32-bit distances, which only choose and bound from below
        half = half.astype(np.float32)
        at, live, total = np.arange(len(ids)), np.ones(len(ids), bool), np.zeros(len(ids), np.float32)
        vantage, span, buckets = [], [], []
        left, nxt = len(ids), 0
        while left:
            d = np.sqrt(np.maximum(half + half[nxt] - 2 * (x @ x[nxt]), 0))
            total += d
            d[~live] = np.inf
            mine = np.argpartition(d, leaf - 1)[:leaf] if left > leaf else np.flatnonzero(live)
            live[mine] = False
            left -= len(mine)
            exact = between(vectors[at[nxt]][None], vectors[at[mine]])[0]
            d[mine] = np.inf
            vantage.append(at[nxt])
            span.append((exact.min(), exact.max(), float(d.min()) - slack if left else np.inf))
            buckets.append(at[mine])
            if left and left * 2 < len(at):  # close the gaps
                x, half, total, at = x[live], half[live], total[live], at[live]
                live = np.ones(left, bool)
            if left:  # the farthest from all before stands at the edge
                nxt = int(np.where(live, total, -1).argmax())
        flat = np.concatenate(buckets) if buckets else np.zeros(0, np.int64)
        return cls(vectors[np.array(vantage, np.int64)], np.array(span).reshape(-1, 3), np.array([len(b) for b in buckets], np.int64), ids[flat], vectors[flat])

    def search(self, queries: np.ndarray, own: np.ndarray, limit: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's row, id, distance) of the k nearest to each query, the id in own left out; of equals the smaller ids.

        limit is the distance beyond which nothing is wanted.
        """
        parts = [self._search(queries[i : i + 512], own[i : i + 512], limit[i : i + 512], k, factor) for i in range(0, len(queries) if len(self.ids) else 0, 512)]
        row = [r + 512 * i for i, (r, _, _) in enumerate(parts)]
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *row]), np.concatenate([none, *(p[1] for p in parts)]), np.concatenate([np.zeros(0), *(p[2] for p in parts)])

    def _search(self, queries: np.ndarray, own: np.ndarray, limit: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        bound = limit.astype(np.float64).copy()
        d = between(queries, self.vantage)
        self.computed += d.size
        beyond = np.maximum.accumulate(self.outer - d, axis=1)
        low = np.maximum(np.maximum(d - self.high, self.low - d), 0)
        low[:, 1:] = np.maximum(low[:, 1:], beyond[:, :-1])
        row, who, dist = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def look(j: int, q: np.ndarray) -> None:
            s, e = self.start[j], self.end[j]
            d = between(queries[q], self.v[s:e]).round(PLACES)
            self.computed += d.size
            a, b = np.nonzero((d <= bound[q, None] + EPS) & (own[q, None] != self.ids[None, s:e]))
            found.append((q[a], self.ids[s + b], d[a, b]))

        def keep() -> None:
            """The k nearest of what was found; the k-th is the new bound."""
            nonlocal row, who, dist
            row, who, dist = (np.concatenate(x) for x in zip((row, who, dist), *found, strict=True))
            found.clear()
            order = np.lexsort((who, dist, row))
            row, who, dist = row[order], who[order], dist[order]
            first = np.searchsorted(row, np.arange(len(queries)))
            place = np.arange(len(row)) - first[row]
            full = place == k - 1
            bound[row[full]] = np.minimum(bound[row[full]], dist[full])
            row, who, dist = row[place < k], who[place < k], dist[place < k]

        # the likeliest buckets first, for a tight bound
        some = min(len(self.end), -(-4 * k // LEAF) + 1)
        near = np.argpartition(low, some - 1, axis=1)[:, :some]
        seen = np.zeros(low.shape, bool)
        np.put_along_axis(seen, near, True, axis=1)
        seen &= factor * low <= bound[:, None] + EPS
        for j in np.flatnonzero(seen.any(0)):
            look(j, np.flatnonzero(seen[:, j]))
        keep()
        low[seen] = np.inf
        done = 0
        for j in np.argsort(low.min(0), kind="stable"):
            q = np.flatnonzero(factor * low[:, j] <= bound + EPS)
            if len(q):
                look(j, q)
                done += 1
                if done % 32 == 0:
                    keep()
        keep()
        return row, who, dist


def matrix(a: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    a = a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a
    return np.asarray(a.flatten(), dtype=np.float64).reshape(-1, dim)


def clean(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """One usable vector for each id, written once, and their common length (the most frequent; of equals the smaller)."""
    v = vectors.select(col(id_col).cast("long").alias("id"), col(vector_col).cast("array<float>").alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    v = v.where((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    size = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = size.d if size else 1
    return settle(v.where(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v"))), dim


def floats(rows: np.ndarray) -> pa.Array:
    """Rows as an array of lists of numbers, 32 bits each as in the table they came from."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.astype(np.float32).ravel()))


def index(placed: DataFrame, dim: int) -> DataFrame:
    """The trees of all shards of (shard, id, v): a row (shard, j, span, vantage, ids, v) for each bucket j."""

    def grow(t: pa.Table) -> pa.Table:
        tree = Tree.build(np.asarray(t["id"]), matrix(t["v"], dim))
        n, off = len(tree.end), pa.array(np.r_[tree.start, len(tree.ids)], pa.int32())
        span = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * 3, pa.int32()), pa.array(np.stack([tree.low, tree.high, tree.outer], 1).ravel()))
        ids = pa.ListArray.from_arrays(off, pa.array(tree.ids, pa.int64()))
        own = pa.ListArray.from_arrays(pa.array(np.r_[tree.start, len(tree.ids)] * dim, pa.int32()), pa.array(tree.v.astype(np.float32).ravel()))
        return pa.table({"shard": pa.repeat(t["shard"][0], n), "j": pa.array(np.arange(n), pa.int32()), "span": span, "vantage": floats(tree.vantage), "ids": ids, "v": own})

    return placed.select("shard", "id", "v").groupBy("shard").applyInArrow(grow, "shard long, j int, span array<double>, vantage array<float>, ids array<long>, v array<float>")


def answers(trees: DataFrame, asked: DataFrame, dim: int, k: int, factor: float) -> DataFrame:
    """(q, n, d): what each query (shard, id, v, t) finds in its shard within the distance t, k at most.

    A shard that is asked a great deal answers block by block, each a task of its own.
    """
    blocks = asked.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("b")).withColumnRenamed("shard", "s")
    ask = asked.join(blocks, F.col("shard") == F.col("s")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("b"))).select("shard", "block", "id", "v", "t")
    give = trees.join(blocks, F.col("shard") == F.col("s")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("b") - 1))).drop("s", "b")

    def run(q: pa.Table, t: pa.Table) -> pa.Table:
        t = t.sort_by("j")
        ids = t["ids"].combine_chunks()
        tree = Tree(matrix(t["vantage"], dim), matrix(t["span"], 3), np.asarray(ids.value_lengths()).astype(np.int64), np.asarray(ids.flatten()).astype(np.int64), matrix(t["v"], dim))
        own = np.asarray(q["id"]).astype(np.int64)
        row, who, d = tree.search(matrix(q["v"], dim), own, np.asarray(q["t"]).astype(np.float64), k, factor)
        return pa.table({"q": own[row], "n": who, "d": d})

    return ask.groupBy("shard", "block").cogroup(give.groupBy("shard", "block")).applyInArrow(run, "q long, n long, d double")


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, factor: float = FACTOR, shard: int | None = None, every: int = 1) -> DataFrame:
    """(id, rank, neighbour_id, distance): the k nearest other vectors, by Euclidean distance, of each vector whose id is
    divisible by `every`, among all vectors.

    Ties go to the smaller id, ranks start at 1, with fewer than k others there are fewer rows. Rows whose id or vector is
    null, empty, of another length than most, or holds null, NaN or an infinity are left out; of rows that repeat an id
    the smallest vector counts. Ids are whole numbers (or texts of such), anything else is an error. Other columns are
    ignored; an empty table gives none. Distances are rounded to 6 places, and equal then.

    The index holds every vector. Its pivots are a sample of PIVOTS vectors at most, one for each shard; a cell of more
    than `shard` vectors is several shards, by id, so neither a crowded cell nor copies of one vector fill a task.
    """
    tune(vectors.sparkSession)
    spark = vectors.sparkSession
    v, dim = clean(vectors, id_col, vector_col)
    shard = shard or max(1024, FLOATS // dim)
    n = v.count()
    cells = min(PIVOTS, max(1, -(-n // shard)))
    pivots = matrix(v.orderBy(F.md5(F.col("id").cast("string")), "id").limit(cells).select("v").toArrow()["v"], dim) if n else np.zeros((1, dim))
    half = (pivots * pivots).sum(1) / 2

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1), dim)
            c = np.concatenate([np.zeros(0, np.int64), *((half - x[i : i + 8192] @ pivots.T).argmin(1) for i in range(0, len(x), 8192))])
            d = np.sqrt(((x - pivots[c]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), b.column(0), b.column(1), pa.array(d)], names=["cell", "id", "v", "d"])

    placed = settle(v.mapInArrow(assign, "cell long, id long, v array<float>, d double"))
    low, high, parts = np.zeros(len(pivots)), np.full(len(pivots), -1.0), np.zeros(len(pivots), np.int64)
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("low"), F.max("d").alias("high")).collect():  # PIVOTS rows at most
        low[r.cell], high[r.cell], parts[r.cell] = r.low, r.high, -(-r.n // shard)
    first = np.cumsum(parts) - parts
    cell_parts = F.broadcast(spark.createDataFrame([(i, int(a), int(p)) for i, (a, p) in enumerate(zip(first, parts, strict=True))], "cell long, first long, parts long"))
    placed = placed.join(cell_parts, "cell").select((F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).alias("shard"), "cell", "id", "v")
    trees = settle(index(placed, dim))
    queries = placed.where(F.pmod("id", F.lit(every)) == 0)
    home = settle(answers(trees, queries.select("shard", "id", "v", F.lit(float("inf")).alias("t")), dim, k, factor))
    within = home.groupBy("q").agg(F.count(F.lit(1)).alias("c"), F.max("d").alias("m")).select("q", F.when(F.col("c") >= k, F.col("m")).otherwise(float("inf")).alias("t"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query with every other shard that may hold something nearer than its t."""
        for b in batches:
            own, cell, x, t = np.asarray(b.column(0)), np.asarray(b.column(1)), matrix(b.column(3), dim), np.asarray(b.column(4))
            for i in range(0, len(x), 1024):
                part = slice(i, i + 1024)
                d = between(x[part], pivots)
                mine = d[np.arange(len(d)), cell[part]]
                # what a cell holds lies between its least and largest distance, and nearer to its pivot than to any other
                least = np.maximum(np.maximum(d - high, low - d), (d - mine[:, None]) / 2)
                q, c = np.nonzero((factor * least <= t[part, None] + EPS) & (parts > 0))
                many = parts[c]
                q, to = np.repeat(q, many), np.repeat(first[c], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                q, to = q[to != own[part][q]] + i, to[to != own[part][q]]
                for j in range(0, len(q), 8192):
                    r = pa.array(q[j : j + 8192])
                    yield pa.RecordBatch.from_arrays([pa.array(to[j : j + 8192], pa.int64()), b.column(2).take(r), b.column(3).take(r), b.column(4).take(r)], names=["shard", "id", "v", "t"])

    asked = queries.join(within, F.col("id") == F.col("q"), "left").select("shard", "cell", "id", "v", F.coalesce("t", F.lit(float("inf"))).alias("t"))
    away = answers(trees, settle(asked.mapInArrow(route, "shard long, id long, v array<float>, t double")), dim, k, factor)
    both = home.unionByName(away).groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "n"))), 1, k).alias("x"))
    out = both.select("q", F.posexplode("x").alias("i", "x"))
    return out.select(F.col("q").alias(id_col), (F.col("i") + 1).cast("long").alias("rank"), F.col("x.n").alias("neighbour_id"), F.col("x.d").alias("distance"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest neighbours, among all embeddings, of every embedding whose id is divisible by 50."""
    return nearest(load(spark, sf_dir, "embeddings"), every=EVERY)
