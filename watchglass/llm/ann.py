"""Approximate nearest neighbours by largest inner product, over balanced posting lists.

Vectors get one more component so that the largest inner product is the least distance.
Centroids are fitted to a bounded sample (SAMPLE vectors, of the least hash of vec_id) by
k-means with a charge on crowded lists. Every vector is indexed: it goes to its nearest
list, and if it lies near a boundary, also to others whose centroid is at most CLOSURE
times as far, unless that centroid lies much nearer to one chosen before than to the
vector. A query walks a graph of neighbouring centroids, kept in memory, and searches the lists
whose centroids are at most RATIO times as far as the nearest, FEWEST of them at least and
PROBES at most.

A list that holds, or is asked for by, more than BLOCK rows is dealt to blocks, and each
block of queries meets each block of vectors in a group of its own; of a group a query
keeps its best K. Of copies of one vector only the K + 1 of least vec_id are indexed: no
answer can hold another.

Scores are inner products of the original vectors in double precision, summed alike for
all candidates. Ties go to the smaller vec_id. Null vectors, zero ones, and those with null
or non-finite components take no part; nor do those of another length than the most
common one. Rows of equal vec_id are taken for one row, the least. A null vec_id takes no part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import tasks, written

K = 20
SAMPLE = 20_000  # vectors that centroids are fitted to
PER_LIST = 128  # vectors that share a list, as far as MAX_LISTS allows
MAX_LISTS = 1024
ITERATIONS = 8
COPIES = 4  # lists of a vector at most
CLOSURE = 1.15  # of the distance to the nearest centroid
DIVERSITY = 0.6  # least gap to the lists chosen before, against the distance to the vector
NEIGHBOURS = 24  # of a centroid in the graph
BEAM = 192  # centroids that a walk keeps
PROBES = 128  # lists of a query at most
FEWEST = 48  # lists of a query whatever the ratio: a dense crowd may fill several lists
RATIO = 1.8
BLOCK = 4096


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v: vectors that take part, as arrays of double."""
    v = F.col("embedding").cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(sound & some)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if usual is not None:
        rows = rows.where(F.size("v") == usual[0])
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column) -> np.ndarray:
    values = pa.chunked_array([column]) if isinstance(column, pa.Array) else column
    flat = values.combine_chunks()
    flat = flat if isinstance(flat, pa.Array) else flat.chunk(0)
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _lifted(v: np.ndarray, radius: float) -> np.ndarray:
    """Vectors with the component that gives all of them the norm `radius`."""
    rest = np.sqrt(np.maximum(0.0, radius * radius - (v * v).sum(axis=1)))
    return np.hstack([v, rest[:, None]])


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2 * x @ y.T
    return np.sqrt(np.maximum(d, 0.0))


class Lists:
    """Centroids and the graph over them."""

    def __init__(self, sample: np.ndarray, n: int, radius: float) -> None:
        self.radius = radius
        x = _lifted(sample, radius)
        rng = np.random.default_rng(0)
        n = max(1, min(n, len(x)))
        self.centroids = x[np.sort(rng.choice(len(x), n, replace=False))]
        sizes = np.full(n, len(x) / n)
        for _ in range(ITERATIONS):
            d = _distances(x, self.centroids)
            charge = np.median(d.min(axis=1)) * 0.1 * np.maximum(0.0, sizes * n / len(x) - 1)
            own = (d + charge).argmin(axis=1)
            sizes = np.bincount(own, minlength=n).astype(float)
            sums = np.zeros_like(self.centroids)
            np.add.at(sums, own, x)
            held = sizes > 0
            self.centroids[held] = sums[held] / sizes[held, None]
        between = _distances(self.centroids, self.centroids)
        linked = np.zeros((n, n), bool)
        np.put_along_axis(linked, np.argsort(between, axis=1, kind="stable")[:, : NEIGHBOURS + 1], True, axis=1)
        # Both ways, else a centroid that is nobody's neighbour could not be reached.
        self.near = [np.flatnonzero(row) for row in linked | linked.T]
        self.starts = np.arange(0, n, max(1, n // 16))

    def of_vectors(self, v: np.ndarray) -> list[np.ndarray]:
        """The lists of each vector: the nearest, and those across a boundary it is close to."""
        x, found = _lifted(v, self.radius), []
        for at in range(0, len(x), 1024):
            d = _distances(x[at : at + 1024], self.centroids)
            for row, order in zip(d, np.argsort(d, axis=1, kind="stable")[:, : 4 * COPIES]):
                chosen = [order[0]]
                for c in order[1:]:
                    if len(chosen) == COPIES or row[c] > CLOSURE * row[order[0]]:
                        break
                    gaps = np.linalg.norm(self.centroids[chosen] - self.centroids[c], axis=1)
                    if (gaps >= DIVERSITY * row[c]).all():
                        chosen.append(c)
                found.append(np.array(chosen))
        return found

    def of_query(self, q: np.ndarray, sizes: np.ndarray, least: int) -> np.ndarray:
        """Lists to search, by a best-first walk over the graph; they hold `least` entries if all do."""
        q = np.append(q, 0.0)
        def far(ids: np.ndarray) -> np.ndarray:
            return np.linalg.norm(self.centroids[ids] - q, axis=1)

        seen = np.zeros(len(self.centroids), bool)
        seen[self.starts] = True
        frontier = [(d, int(c)) for d, c in zip(far(self.starts), self.starts)]
        heapq.heapify(frontier)
        best = [(-d, c) for d, c in frontier]
        heapq.heapify(best)
        while frontier:
            d, c = heapq.heappop(frontier)
            if len(best) >= BEAM and d > -best[0][0]:
                break
            fresh = self.near[c][~seen[self.near[c]]]
            seen[fresh] = True
            for e, x in zip(far(fresh).tolist(), fresh.tolist()):
                if len(best) < BEAM or e < -best[0][0]:
                    heapq.heappush(frontier, (e, x))
                    heapq.heappush(best, (-e, x))
                    if len(best) > BEAM:
                        heapq.heappop(best)
        ranked = sorted((-d, c) for d, c in best)[:PROBES]
        chosen = [c for i, (d, c) in enumerate(ranked) if i < FEWEST or d <= RATIO * ranked[0][0]]
        if sizes[chosen].sum() < least:
            order = np.argsort(far(np.arange(len(self.centroids))), kind="stable")
            more = order[~np.isin(order, chosen)]
            need = np.searchsorted(sizes[more].cumsum(), least - sizes[chosen].sum()) + 1
            chosen += more[:need].tolist()
        return np.array(chosen)


def fit(rows: DataFrame) -> Lists | None:
    """Lists for the rows `vec_id`, `v`; the driver sees a sample of bounded size."""
    n, norm = rows.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    if not n:
        return None
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()
    return Lists(_matrix(sample.column(0)), min(MAX_LISTS, -(-n // PER_LIST)), float(np.sqrt(norm)))


def _best(qid: np.ndarray, q: np.ndarray, vid: np.ndarray, v: np.ndarray, k: int) -> pd.DataFrame:
    """The k best of the vectors for each query, their scores summed in the same order everywhere."""
    rough = q @ v.T
    rough[qid[:, None] == vid[None]] = -np.inf
    n = min(k, len(vid))
    least = np.partition(rough, len(vid) - n, axis=1)[:, len(vid) - n]
    slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(least), least, 0.0)))
    out: tuple[list, list, list] = ([], [], [])
    for i, own in enumerate(qid):
        at = np.flatnonzero((rough[i] >= least[i] - slack[i]) & (rough[i] > -np.inf))
        score = (v[at] * q[i]).sum(axis=1)
        at, score = (x[np.lexsort((vid[at], -score))[:n]] for x in (at, score))
        out[0].append(np.full(len(at), own))
        out[1].append(vid[at])
        out[2].append(score)
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, out))))


def _dealt(rows: DataFrame, name: str) -> DataFrame:
    """A row per list and block of `rows`: list, the number of its blocks."""
    return rows.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))


def nearest(vectors: DataFrame, asked: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of all vectors, but itself, to each vector `asked` for."""
    rows = written(usable(vectors), "vectors")
    lists = fit(rows)
    if lists is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    copy = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    distinct = rows.withColumn("copy", copy).where(F.col("copy") <= k + 1).drop("copy")

    def place(of_rows):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                found = of_rows(_matrix(batch.column(1)))
                rows = pa.array(np.repeat(np.arange(batch.num_rows), [len(f) for f in found]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(found), pa.int32()), *(c.take(rows) for c in batch.columns)],
                    names=["list", "vec_id", "v"],
                )

        return run

    schema = "list int, vec_id long, v array<double>"
    index = written(distinct.select("vec_id", "v").mapInArrow(place(lists.of_vectors), schema), "lists")
    sizes = np.zeros(len(lists.centroids), np.int64)
    for number, size in index.groupBy("list").count().collect():  # MAX_LISTS rows at most
        sizes[number] = size
    least = COPIES * (k + 1)  # entries of more than k vectors
    queries = rows.where(asked).repartition(tasks(rows.sparkSession))
    probes = written(
        queries.mapInArrow(place(lambda v: [lists.of_query(q, sizes, least) for q in v]), schema), "probes"
    )
    blocks = written(_dealt(index, "nv").join(_dealt(probes, "nq"), "list"), "list-blocks")

    def block(df: DataFrame, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        number = F.pmod(F.xxhash64("vec_id"), F.col(own)).cast("int")
        return df.join(blocks, "list").withColumn(mine, number).withColumn(
            theirs, F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        ).select("list", "bv", "bq", "vec_id", "v")

    left = block(probes, "nq", "nv", "bq", "bv").groupBy("list", "bv", "bq")
    right = block(index, "nv", "nq", "bv", "bq").groupBy("list", "bv", "bq")

    def meet(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(v):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return _best(
            q["vec_id"].to_numpy(), np.stack(q["v"]), v["vec_id"].to_numpy(), np.stack(v["v"]), k
        )

    found = left.cogroup(right).applyInPandas(meet, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
