"""Approximate nearest neighbours by counting collisions on single projections.

Vectors are spread over chunks; in a chunk each of PROJECTIONS random lines has a sorted
array of the vectors' positions. A query opens a window around its own position on every
line. The windows grow together by GROWTH (virtual rehashing: the arrays stay, only their
new rings are read) and count how often they have met each vector. A vector met on
THRESHOLD of the lines is a candidate and verified by its exact distance. A line's gap to a
vector at distance d is about normal with deviation d / sqrt(dimensions), so a window says
how near the vectors are that it has met on enough lines: windows stop growing
when k verified vectors are nearer than that (SURE), whatever the table's size.

Queries are a stated set against all rows: blocks of queries meet chunks of rows, both of
a fixed size, and no task holds more than one of each. Each gives at most k rows a query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PROJECTIONS, THRESHOLD, GROWTH = 128, 0.7, 1.1
#: Half-width, in deviations of the gap, of a window that meets a vector on 0.75 of the lines: 1.2 deviations of the count
#: above THRESHOLD for the farthest of the k, more for the nearer ones.
SURE = 1.15
CHUNK_ROWS = QUERY_ROWS = 1 << 13
#: Windows whose ends are searched in one call per line.
STEPS = 8


class CollisionIndex:
    """The sorted arrays of one chunk."""

    def __init__(self, vectors: np.ndarray, seed: int = 11):
        self.vectors, self.verified = vectors, 0
        self.scale = max(float(np.abs(vectors).max()), 1e-300)  # components up to the largest double stay finite
        lines = np.random.default_rng(seed).normal(size=(PROJECTIONS, vectors.shape[1]))
        self.lines = lines / np.linalg.norm(lines, axis=1, keepdims=True)
        at = self.lines @ (vectors / self.scale).T
        self.order = np.argsort(at, axis=1)
        self.sorted = np.take_along_axis(at, self.order, 1)
        self.step = max(float(np.median(at.std(axis=1))) * 0.25, 1e-9)

    def distance(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """In double precision; differences whose squares overflow are scaled first."""
        with np.errstate(over="ignore", invalid="ignore"):
            away = np.sqrt(((self.vectors[rows] - query) ** 2).sum(1))
            beyond = ~np.isfinite(away)
            if beyond.any():
                scale = max(self.scale, float(np.abs(query).max()))
                away[beyond] = scale * np.sqrt(((self.vectors[rows[beyond]] / scale - query / scale) ** 2).sum(1))
        return away

    def nearest(self, query: np.ndarray, k: int, skip: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest of those met on enough lines and not in skip, by (distance, id), and their distances."""
        n, scaled = len(self.vectors), query / self.scale
        centre, need = self.lines @ scaled, int(np.ceil(THRESHOLD * PROJECTIONS))
        met, known = np.zeros(n, np.int64), skip.copy()
        low = [int(np.searchsorted(s, c)) for s, c in zip(self.sorted, centre)]
        high, radius, reach = list(low), self.step, []
        found, away = np.zeros(0, np.int64), np.zeros(0)
        while True:
            if not reach:  # the ends of the next windows on every line, searched at once
                reach = [radius]
                while len(reach) < STEPS:
                    reach.append(reach[-1] * GROWTH)
                ends_at = np.array(reach)
                below = np.stack([s.searchsorted(c - ends_at) for s, c in zip(self.sorted, centre)], 1).tolist()
                above = np.stack([s.searchsorted(c + ends_at) for s, c in zip(self.sorted, centre)], 1).tolist()
            radius, starts, ends = reach.pop(0), below.pop(0), above.pop(0)
            rings = [part for order, a, b, c, d in zip(self.order, starts, low, high, ends) for part in (order[a:b], order[c:d])]
            low, high = starts, ends
            met += np.bincount(np.concatenate(rings), minlength=n)
            new = np.flatnonzero((met >= need) & ~known)
            if len(new):
                known[new] = True
                found, away = np.r_[found, new], np.r_[away, self.distance(new, query)]
                self.verified += len(new)
            sure = radius * np.sqrt(len(query)) / SURE * self.scale
            if known.all() or (len(away) >= k and np.partition(away, k - 1)[k - 1] <= sure):
                best = np.lexsort((ids[found], away))[:k]
                return found[best], away[best]
            if met.any():
                radius *= GROWTH
            else:  # windows that no vector has entered yet grow faster
                radius, reach = radius * 2.0, []


def usable(column):
    """Vectors that take part: not null, all components finite, not all zero."""
    fine = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(column.isNotNull() & fine & F.exists(column, lambda x: x != 0), F.lit(False))


def nearest_neighbours(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 10, every: int = 100,
                       chunk_rows: int = CHUNK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score, query_row: up to k nearest found of every row whose id `every` divides.

    Score is the Euclidean distance in double precision; ties go to the smaller id. Rows of
    the query's own id are no candidates. Vectors that are null, zero or hold null or
    non-finite components, and rows without an id, take no part. Vectors are compared with
    those of their own length only. Repeated rows are rows: each row whose id `every` divides
    has its own k nearest, told apart by ``query_row``. A distance beyond the largest double
    is infinite. Other columns are not read.
    """
    rows = table.where(F.col(vec_id).isNotNull() & usable(F.col(vector))).select(
        F.col(vec_id).cast("long").alias("id"), F.size(vector).alias("dim"), F.col(vector).cast("array<double>").alias("v"),
        F.monotonically_increasing_id().alias("row"))
    count = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("id") % every == 0, 1)).alias("q")).first()
    chunks, blocks = max(1, -(-count["n"] // chunk_rows)), max(1, -(-count["q"] // query_rows))
    data = rows.select("dim", F.pmod(F.xxhash64("id"), F.lit(chunks)).alias("chunk"),
                       F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "id", "v")
    queries = rows.where(F.col("id") % every == 0).select(
        "dim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"),
        F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), "id", "row", "v")

    def search(asked, given):
        out = []
        if len(asked) and len(given):
            given = given.sort_values("id", kind="stable")
            ids = given["id"].to_numpy()
            index = CollisionIndex(np.stack(given["v"].to_list()))
            for q, row, v in zip(asked["id"].to_numpy(), asked["row"].to_numpy(), asked["v"]):
                near, away = index.nearest(v, k, ids == q, ids)
                out += [(q, row, i, d) for i, d in zip(ids[near], away)]
        return pd.DataFrame(out, columns=["query_id", "query_row", "vec_id", "score"])

    keys = ["dim", "chunk", "block"]
    found = queries.groupBy(keys).cogroup(data.groupBy(keys)).applyInPandas(search, "query_id bigint, query_row bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id", "query_row").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "query_row")
