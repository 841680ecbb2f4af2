"""Exact top-k inner products by ball trees, one for each shard of the vectors.

A node's upper bound for a query q is q.c + |q| r (centre c, radius r). Nodes are opened in the
order of their bounds, and closed once the bound falls below the current k-th score.

Vectors are dealt to the nearest of a few centres, and those of a centre to as many shards as they
need. A query first searches one shard of its own centre; the k-th score found there goes along to
the shards of the other centres, and only to those whose ball can reach it. Each shard's tree is
built once, and its queries are streamed through it.
"""

from __future__ import annotations

import heapq
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casefile.llm.common import written

LEAF = 256
SHARD_ROWS = 16_384
#: Centres of the vectors of one dimension; dimensions that have centres (the most frequent ones).
CENTRES, DIMENSIONS = 64, 100
#: Bounds are computed in floating point; this is added as a share of the norms' product.
SLACK = 1e-9


class BallTree:
    """Splits at the median of the widest of the directions between far points."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        self.x, self.ids = x.astype(np.float64), ids
        #: Products are exact in float64 if they cannot reach 2^53.
        big = float(np.abs(self.x).max(initial=0)) ** 2 * max(1, x.shape[1])
        self.exact = x if big >= 2**52 else self.x
        self.nodes: list[tuple[np.ndarray | None, int, int]] = []
        centres, radii = [], []
        stack = [(np.arange(len(x)), -1, 0)]
        while stack:
            rows, parent, side = stack.pop()
            at = len(self.nodes)
            if parent >= 0:
                self.nodes[parent][side] = at
            part = self.x[rows]
            centre = part.mean(0)
            away = np.sqrt(((part - centre) ** 2).sum(1))
            centres.append(centre)
            radii.append(away.max())
            if len(rows) <= LEAF or away.max() == 0:
                self.nodes.append([-1, -1, rows])
                continue
            far = part[away.argmax()]
            other = part[((part - far) ** 2).sum(1).argmax()]
            along = part @ (other - far)
            order = np.argsort(along, kind="stable")
            half = len(rows) // 2
            self.nodes.append([-1, -1, None])
            stack += [(rows[order[half:]], at, 1), (rows[order[:half]], at, 0)]
        self.centres, self.radii = np.array(centres), np.array(radii)

    def search(self, q: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Scores and row numbers of the k best (score, then smaller id), of those that reach ``least``."""
        f = q.astype(np.float64)
        bounds = upper(self.centres, self.radii, f)
        heap = [(-bounds[0], 0)]
        scores, found = np.empty(0, np.int64), np.empty(0, np.int64)
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < least:
                break
            left, right, rows = self.nodes[node]
            if rows is None:
                for child in (left, right):
                    if bounds[child] >= least:
                        heapq.heappush(heap, (-bounds[child], child))
                continue
            got = (self.exact[rows] @ (q if self.exact.dtype == np.int64 else f)).astype(np.int64)
            keep = got >= least
            if not keep.any():
                continue
            scores, found = np.concatenate([scores, got[keep]]), np.concatenate([found, rows[keep]])
            best = np.lexsort((self.ids[found], -scores))[:k]
            scores, found = scores[best], found[best]
            if len(scores) == k:
                least = max(least, float(scores[-1]))
        return scores, found


def upper(centres: np.ndarray, radii: np.ndarray, q: np.ndarray) -> np.ndarray:
    """No less than the product of q with any vector of each ball."""
    norm = np.sqrt((q * q).sum())
    return centres @ q + norm * radii + SLACK * (1 + norm * (np.sqrt((centres**2).sum(1)) + radii))


HIT = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("own", pa.bool_())])
HIT_DDL = "query long, query_id long, vec_id long, score long, own boolean"
PLACED_DDL = "id long, vec_id long, v array<long>, dim int, centre int, away double"


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(len(column), dim)


def centres_of(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Of each of the most frequent dimensions up to CENTRES vectors: those with the smallest hash of
    as many bins. At most CENTRES * DIMENSIONS vectors reach the driver."""
    h = F.xxhash64("v")
    common = vectors.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(DIMENSIONS).select("dim")
    picked = vectors.join(F.broadcast(common), "dim").groupBy("dim", F.pmod(h, F.lit(CENTRES)).alias("bin")).agg(F.min_by("v", h).alias("v"))
    found: dict[int, list] = {}
    for r in picked.orderBy("dim", "bin").collect():
        found.setdefault(r["dim"], []).append(r["v"])
    return {dim: np.array(x, np.float64).reshape(len(x), dim) for dim, x in found.items()}


def placed(vectors: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """``vectors`` (vec_id, v, dim) with a number of their own, the nearest centre and its distance."""

    def run(batches):
        for batch in batches:
            for dim in pc.unique(batch.column("dim")).to_pylist():
                part = batch.filter(pc.equal(batch.column("dim"), dim))
                nearest, away = np.zeros(part.num_rows, np.int32), np.full(part.num_rows, np.inf)
                if dim in centres and dim:
                    x = matrix(part.column("v"), dim).astype(np.float64)
                    for c, centre in enumerate(centres[dim]):
                        d = np.sqrt(((x - centre) ** 2).sum(1))
                        nearest[d < away], away[d < away] = c, d[d < away]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(nearest), pa.array(away)], names=[*part.schema.names, "centre", "away"])

    return vectors.select(F.monotonically_increasing_id().alias("id"), "vec_id", "v", "dim").mapInArrow(run, PLACED_DDL)


def searched(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best of each query in each shard that it goes to: vectors and queries (with the least
    score that they look for) come sorted by shard, vectors first."""

    def run(batches):
        key, held, tree = None, [], None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("dim", "centre", "shard", "kind"))))
            edges = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            for a, b in itertools.pairwise(edges):
                if a == b:
                    continue
                part, (*now, kind) = batch.slice(a, b - a), keys[a]
                if now != key:
                    key, held, tree = now, [], None
                if not kind:
                    held.append(part)
                elif held:
                    whole = pa.Table.from_batches(held).combine_chunks()
                    if tree is None:
                        tree = BallTree(matrix(whole.column("v").combine_chunks(), now[0]), whole.column("vec_id").to_numpy())
                    yield hits(tree, part, now[0], k)

    def hits(tree: BallTree, queries: pa.RecordBatch, dim: int, k: int) -> pa.RecordBatch:
        out = []
        ids, own, least = (queries.column(c).to_pylist() for c in ("id", "vec_id", "least"))
        for i, o, q, low in zip(ids, own, matrix(queries.column("v"), dim), least):
            scores, found = tree.search(q, k, -np.inf if low is None else float(low))
            same = (tree.ids[found] == o) & (tree.x[found] == q).all(1)
            out.append((np.full(len(found), i), np.full(len(found), o), tree.ids[found], scores, same))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*out), HIT)], schema=HIT)

    by = ["dim", "centre", "shard"]
    both = vectors.select("id", "vec_id", "v", F.lit(None).cast("long").alias("least"), F.lit(0).alias("kind"), *by).unionByName(queries.select("id", "vec_id", "v", "least", F.lit(1).alias("kind"), *by))
    return both.repartition(*by).sortWithinPartitions(*by, "kind").mapInArrow(run, HIT_DDL)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The ``k`` best inner products of each query among all ``vectors`` but its own row.

    Both have vec_id and v (array<long>). Candidates have the query's number of components. Its own
    row is one row with its vec_id and components; other rows of the same vec_id are candidates, and
    each of the queries' rows is answered. Ties go to the smaller vec_id; fewer candidates give fewer
    rows; empty tables give an empty result. Returns query_id, rank (from 1), vec_id and score.

    Shards have bounded sizes and grow in number; a task holds one shard and a batch of queries.
    """
    dim = F.size("v").alias("dim")
    vectors = vectors.select("vec_id", "v", dim)
    centres = centres_of(vectors)
    vectors = written(placed(vectors, centres), "vectors")
    queries = written(placed(queries.select("vec_id", "v", dim), centres), "queries")
    balls = vectors.groupBy("dim", "centre").agg(F.ceil(F.count(F.lit(1)) / shard_rows).alias("shards"), F.max("away").alias("radius"))
    balls = written(balls, "balls")  # a row for each centre, and one for each dimension without centres
    sharded = vectors.join(balls.select("dim", "centre", "shards"), ["dim", "centre"]).withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")))
    known = [r for r in balls.filter(F.col("dim").isin(list(centres))).collect()]  # CENTRES * DIMENSIONS at most
    radii = {d: np.array([max((r["radius"] for r in known if (r["dim"], r["centre"]) == (d, c)), default=-np.inf) for c in range(len(x))]) for d, x in centres.items()}

    home = queries.join(balls.select("dim", "centre", "shards"), ["dim", "centre"]).withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards"))).withColumn("least", F.lit(None).cast("long"))
    first = written(searched(sharded, home, k + 1), "home")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", F.desc("own"))
    kth = first.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k + 1).select(F.col("query").alias("id"), F.col("score").alias("least"))

    def reached(batches):
        """The centres whose balls a query's least score does not rule out."""
        for batch in batches:
            out = []
            for dim, q, low in zip(*(batch.column(c).to_pylist() for c in ("dim", "v", "least"))):
                if dim not in centres or not dim:
                    out.append([0])
                    continue
                may = np.isfinite(radii[dim])
                if low is not None:
                    may &= upper(centres[dim], np.where(may, radii[dim], 0), np.array(q, np.float64)) >= low
                out.append(np.flatnonzero(may).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], names=[*batch.schema.names, "to"])

    known_least = queries.select("id", "vec_id", "v", "dim", "centre").join(kth, "id", "left")
    away = known_least.mapInArrow(reached, "id long, vec_id long, v array<long>, dim int, centre int, least long, to array<int>")
    away = away.select("id", "vec_id", "v", "dim", "least", F.col("centre").alias("_home"), F.explode("to").alias("centre")).join(balls.select("dim", "centre", "shards"), ["dim", "centre"])
    away = away.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
    away = away.filter((F.col("centre") != F.col("_home")) | (F.col("shard") != F.pmod(F.xxhash64("id"), F.col("shards"))))
    found = first.unionByName(searched(sharded, away, k + 1))
    ranked = found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1)
    ranked = ranked.withColumn("self", F.min(F.when(F.col("own"), F.col("n"))).over(Window.partitionBy("query")))
    rank = (F.col("n") - (F.coalesce(F.col("n") > F.col("self"), F.lit(False))).cast("int")).alias("rank")
    return ranked.filter(F.coalesce(F.col("n") != F.col("self"), F.lit(True))).select("query_id", rank, "vec_id", "score").filter(F.col("rank") <= k)


def integer_vectors(df: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and v: floor(1024 x) of each component. Vectors that are null or hold null, NaN or
    infinite components are left out, as are rows with a null vec_id."""
    x = F.col(column).cast("array<double>")
    whole = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), F.lit(False)))
    usable = df.filter(F.col(column).isNotNull() & F.col("vec_id").isNotNull() & whole)
    return usable.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * 1024).cast("long")).alias("v"))
