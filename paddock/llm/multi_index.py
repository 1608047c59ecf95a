"""Approximate nearest neighbours with an inverted multi-index.

Vectors are cut in two halves and each half is quantised to its own codebook, so the pair of
centroids names one of K x K cells. A query visits cells in order of the summed distance of
its halves to the centroids, taken from a heap, until the cells visited hold enough rows
of other ids: a share of them, and k at least; the rows in them are reranked by exact distance in double precision.

Codebooks are fitted on at most `fit_rows` vectors; every row is indexed. Work is dealt by the
first half's centroid, split further into parts of about `part_rows` rows and blocks of about
`block_queries` queries, so that no task holds more than one part and one block.

Defined results: vectors that are null, all zero, or hold null or non-finite components take
no part, and neither do vectors of another length than the most frequent one, nor rows without an id. Of rows that share an
id, the smallest vector is the query; all are candidates of other queries. Equal distances
rank by the smaller id. With fewer candidates than asked for, all are returned. An empty table
gives an empty result. Other columns are never read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paddock.llm.tables import stored


@dataclass(frozen=True)
class Params:
    centroids: int = 32  # of each half
    fit_rows: int = 20_000
    rounds: int = 12
    visit_share: float = 0.7  # a query visits cells until they hold this share of the other ids' rows, and k; nearly isotropic vectors need much
    part_rows: int = 8192
    block_queries: int = 2048


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, embedding as doubles) of the rows that take part."""
    v = F.col(embedding).cast("array<double>")
    infinite = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("embedding")).where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
        & ~F.exists("embedding", infinite) & F.exists("embedding", lambda x: x != 0)
    )
    lengths = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return rows.where(F.size("embedding") == (lengths[0]["n"] if lengths else 0))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Equally long lists of doubles as one matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(1) - 2 * points @ centres.T, axis=1)


def _codebook(points: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Lloyd's algorithm from k distinct points chosen by a fixed seed."""
    distinct = np.unique(points, axis=0)
    centres = distinct[np.random.default_rng(5).permutation(len(distinct))[:k]]
    for _ in range(rounds):
        near = _nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        counts = np.bincount(near, minlength=len(centres))[:, None]
        centres = np.where(counts > 0, sums / np.maximum(counts, 1), centres)
    return centres


def fit(rows: DataFrame, params: Params = Params()) -> tuple[np.ndarray, np.ndarray] | None:
    """The two codebooks, from the `fit_rows` rows of smallest id hash."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(params.fit_rows).select("embedding").toArrow()
    if not sample.num_rows:
        return None
    points = _matrix(sample["embedding"])
    half = points.shape[1] // 2
    return _codebook(points[:, :half], params.centroids, params.rounds), _codebook(points[:, half:], params.centroids, params.rounds)


def assign(rows: DataFrame, books: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Every row with its cell: `first` and `second` centroid."""
    half = books[0].shape[1]

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            points = _matrix(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(_nearest(points[:, :half], books[0]), pa.int32()), pa.array(_nearest(points[:, half:], books[1]), pa.int32())],
                ["vec_id", "embedding", "first", "second"],
            )

    return rows.select("vec_id", "embedding").mapInArrow(cells, "vec_id long, embedding array<double>, first int, second int")


def cells_in_order(a: np.ndarray, b: np.ndarray, counts: np.ndarray, wanted: float) -> list[tuple[int, int]]:
    """Cells by growing a[i] + b[j], until those returned hold `wanted` rows.

    The heap holds one open cell per row of the sorted pair grid at most, so it never has
    more than K entries.
    """
    ia, ib = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    heap = [(a[ia[0]] + b[ib[0]], 0, 0)]
    out: list[tuple[int, int]] = []
    held = 0
    while heap and held < wanted:
        _, x, y = heapq.heappop(heap)
        i, j = int(ia[x]), int(ib[y])
        if counts[i, j]:
            out.append((i, j))
            held += counts[i, j]
        if y + 1 < len(ib):
            heapq.heappush(heap, (a[ia[x]] + b[ib[y + 1]], x, y + 1))
        if y == 0 and x + 1 < len(ia):
            heapq.heappush(heap, (a[ia[x + 1]] + b[ib[0]], x + 1, 0))
    return out


def search(vectors: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", params: Params = Params()) -> DataFrame:
    """The k nearest rows found for each query: query_id, rank, vec_id, score (distance).

    `is_query` is a condition on the column `vec_id`.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = usable(vectors, vec_id, embedding)
    books = fit(rows, params)
    if books is None:
        return spark.createDataFrame([], schema)
    index = stored(assign(rows, books), "multi-index")
    counts = np.zeros((len(books[0]), len(books[1])), dtype=np.int64)
    for r in index.groupBy("first", "second").count().collect():  # K x K rows at most
        counts[r["first"], r["second"]] = r["count"]
    half = books[0].shape[1]
    parts = np.maximum(1, -(-counts.sum(1) // params.part_rows))

    # A query's own rows are no candidates, so they fill no cell: (first, second, n) of them.
    own = index.where(is_query).groupBy("vec_id", "first", "second").agg(F.count("*").alias("n"))
    own = own.groupBy("vec_id").agg(F.collect_list(F.struct("first", "second", "n")).alias("own"))  # K x K at most
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).join(own, "vec_id")
    blocks = max(1, -(-queries.count() // params.block_queries))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each first centroid that a query visits, with its second centroids."""
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("query_id", "query", "first", "seconds")}
            for q, point, mine in zip(*[c.to_pylist() for c in batch.columns]):
                x, others = np.array(point), counts.copy()
                for cell in mine:
                    others[cell["first"], cell["second"]] -= cell["n"]
                wanted = max(params.visit_share * int(others.sum()), k)
                by_first: dict[int, list[int]] = {}
                for i, j in cells_in_order(((books[0] - x[:half]) ** 2).sum(1), ((books[1] - x[half:]) ** 2).sum(1), others, wanted):
                    by_first.setdefault(i, []).append(j)
                for i, seconds in by_first.items():
                    for name, value in zip(out, (q, point, i, seconds)):
                        out[name].append(value)
            types = (pa.int64(), pa.list_(pa.float64()), pa.int32(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], list(out))

    split = F.element_at(F.array(*[F.lit(int(p)) for p in parts]), F.col("first") + 1)
    asked = (
        queries.mapInArrow(visits, "query_id long, query array<double>, first int, seconds array<int>")
        .withColumn("part", F.explode(F.sequence(F.lit(0), split - 1)))
        .withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    )
    held = index.withColumn("part", F.pmod(F.xxhash64("vec_id"), split).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if left.num_rows and right.num_rows:
            ids, second = left["vec_id"].to_numpy(), left["second"].to_numpy()
            points = _matrix(left["embedding"])
            for q, point, seconds in zip(right["query_id"].to_pylist(), right["query"].to_pylist(), right["seconds"].to_pylist()):
                at = np.flatnonzero(np.isin(second, seconds) & (ids != q))
                distance = np.sqrt(((points[at] - np.array(point)) ** 2).sum(1))
                best = np.lexsort((ids[at], distance))[:k]
                out.extend(zip([q] * len(best), ids[at][best].tolist(), distance[best].tolist()))
        return pa.table({"query_id": pa.array([o[0] for o in out], pa.int64()), "vec_id": pa.array([o[1] for o in out], pa.int64()), "score": pa.array([o[2] for o in out], pa.float64())})

    key = ["first", "part", "block"]
    near = held.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(rerank, "query_id long, vec_id long, score double")
    best = near.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id")))
    return best.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
