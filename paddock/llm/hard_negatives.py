"""Hard negatives of anchors, by exact integer products of tiles.

Vectors become whole numbers, floor(scale * x). Anchors and candidates are packed into tiles
of int64 numbers, candidates in order of their label; a pair of tiles is multiplied by
Strassen's recursion (zero padding of odd sides, exact additions; arithmetic is modulo 2^64,
and every result fits). Two passes keep mergeable heaps per anchor: the first, over
tiles that share a label with the anchors, the best rows of the anchor's label; the second,
over tiles with another label, for each of those positives the best rows whose score lies in
the positive's window. Heaps of different tasks meet in one grouped limit.

Every anchor meets every candidate, as the scores are exact: the work is anchors times rows, in blocks.
A task holds one pair of tiles and the heaps of at most `held_blocks` blocks of anchors.
Neither vectors nor heaps pass through the driver.

Defined results: rows with a null id, label or vector, or with null or non-finite components,
take no part, and neither do vectors whose squared length (after scaling) is 2^62 or more,
as scores are longs. Vectors may differ in length: missing components count as 0, and an empty
vector scores 0. Of rows that share an anchor's id, the smallest (label, vector) is the anchor;
all are candidates of other anchors, none of their own. Repeated rows count each. Equal
scores rank by the smaller id. An anchor without positives, or a positive without negatives,
has no rows. An empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.llm.tables import stored
from paddock.operators.prefix import first_rows
from paddock.session import parallelism

NOTHING = -(2**63 - 1)  # the score of an empty place in a heap; its negation is a long too


@dataclass(frozen=True)
class Params:
    scale: int = 256
    positives: int = 5  # of each anchor
    negatives: int = 3  # of each positive
    low_percent: int = 50  # negatives score at least and
    high_percent: int = 95  # at most this share of the positive
    tile_rows: int = 1024
    tile_bytes: int = 1 << 23  # wide vectors make lower tiles
    least_rows: int = 128  # a tile of so many rows ends where the label changes
    leaf: int = 16  # sides up to this are multiplied directly
    held_blocks: int = 64
    anchors_per_task: int = 16_384


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = 16) -> np.ndarray:
    """a @ b with seven half-sized products instead of eight, down to sides of `leaf`."""
    (rows, inner), columns = a.shape, b.shape[1]
    if min(rows, inner, columns) <= leaf:
        return a @ b
    a = np.pad(a, ((0, rows & 1), (0, inner & 1)))
    b = np.pad(b, ((0, inner & 1), (0, columns & 1)))
    r, i, c = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:r, :i], a[:r, i:], a[r:, :i], a[r:, i:]
    b11, b12, b21, b22 = b[:i, :c], b[:i, c:], b[i:, :c], b[i:, c:]
    whole = strassen(a11 + a22, b11 + b22, leaf)
    lower = strassen(a21 + a22, b11, leaf)
    right = strassen(a11, b12 - b22, leaf)
    left = strassen(a22, b21 - b11, leaf)
    upper = strassen(a11 + a12, b22, leaf)
    below = strassen(a21 - a11, b11 + b12, leaf)
    above = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * r, 2 * c), dtype=np.int64)
    out[:r, :c] = whole + left - upper + above
    out[:r, c:] = right + upper
    out[r:, :c] = lower + left
    out[r:, c:] = whole - lower + right + below
    return out[:rows, :columns]


def usable(vectors: DataFrame, label: Column, vec_id: str, embedding: str, scale: int = 256) -> DataFrame:
    """(vec_id, label, vector of whole numbers) of the rows that take part."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    length = F.aggregate("v", F.lit(0.0), lambda total, x: total + F.pow(F.floor(x * scale).cast("double"), F.lit(2)))
    small = F.forall("v", lambda x: F.abs(x * scale) < 2.0**31)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(embedding).cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull())
    # One condition inside the other: the length is only summed where components are fit for it.
    fits = F.when(finite, F.when(small, length < 2.0**62).otherwise(False)).otherwise(False)
    return rows.where(fits).select("vec_id", "label", F.transform("v", lambda x: F.floor(x * scale)).alias("vector"))


_TILE = "tile long, lo long, hi long, width int, ids binary, labels binary, vectors binary, goals binary"


def _cut(rows: list[tuple], number: int) -> dict:
    """One tile: rows by id, so that the first of equal scores has the smallest id."""
    rows.sort(key=lambda r: r[0])
    width = max(len(r[2]) for r in rows)
    vectors = np.zeros((len(rows), width), dtype=np.int64)
    for at, r in enumerate(rows):
        vectors[at, : len(r[2])] = r[2]
    labels = np.array([r[1] for r in rows], dtype=np.int64)
    return {
        "tile": number, "lo": int(labels.min()), "hi": int(labels.max()), "width": width,
        "ids": np.array([r[0] for r in rows], dtype=np.int64).tobytes(), "labels": labels.tobytes(), "vectors": vectors.tobytes(),
        "goals": np.array([r[3] for r in rows], dtype=np.int64).tobytes(),
    }


def tiles(rows: DataFrame, params: Params, goals: int = 0) -> DataFrame:
    """Rows (vec_id, label, vector[, goals]) of each partition, packed in order of the label."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        width, count = 0, 0

        def out(batch: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(batch, pa.schema([("tile", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("width", pa.int32()), *[(c, pa.binary()) for c in ("ids", "labels", "vectors", "goals")]]))

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("vec_id", "label", "vector", *(["goals"] if goals else []))]
            for at in range(batch.num_rows):
                vector = columns[2][at].values.to_numpy(zero_copy_only=False)
                row = (columns[0][at].as_py(), columns[1][at].as_py(), vector, columns[3][at].as_py() if goals else [])
                wide = max(width, len(vector))
                full = len(held) >= params.tile_rows or 8 * wide * (len(held) + 1) > params.tile_bytes
                if held and (full or len(held) >= params.least_rows and held[-1][1] != row[1]):
                    yield out([_cut(held, count)])
                    held, count, wide = [], count + 1, len(vector)
                held.append(row)
                width = wide
        if held:
            yield out([_cut(held, count)])

    return rows.sortWithinPartitions("label").mapInArrow(pack, _TILE)


def _best(scores: np.ndarray, open_: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and columns of the k best open columns of each row, the first of equal ones first."""
    work = np.where(open_, scores, NOTHING)
    rows = np.arange(len(work))
    best, columns = np.full((len(work), k), NOTHING), np.zeros((len(work), k), dtype=np.int64)
    for j in range(k):
        columns[:, j] = work.argmax(1)
        best[:, j] = work[rows, columns[:, j]]
        if (best[:, j] == NOTHING).all():
            break
        work[rows, columns[:, j]] = NOTHING
    return best, columns


def merged(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of two heaps (scores, ids) along the last axis."""
    scores, ids = np.concatenate([one[0], two[0]], -1), np.concatenate([one[1], two[1]], -1)
    order = np.lexsort((ids, -scores), axis=-1)[..., :k]
    return np.take_along_axis(scores, order, -1), np.take_along_axis(ids, order, -1)


def _share_up(p: np.ndarray, percent: int) -> np.ndarray:
    """The least whole number of at least `percent` hundredths of p, without overflow."""
    return p // 100 * percent + -(-(p % 100) * percent // 100)


def _share_down(p: np.ndarray, percent: int) -> np.ndarray:
    return p // 100 * percent + p % 100 * percent // 100


def _scan(pairs: DataFrame, params: Params, k: int, goals: int) -> DataFrame:
    """(anchor_id, slot, vec_id, score): the heaps of each task over its pairs of tiles.

    Without goals, one heap per anchor of rows with its label; with `goals` scores
    per anchor, a heap per goal of rows with other labels in the goal's window.
    """
    slots = max(goals, 1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[tuple, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

        def flush() -> pa.RecordBatch:
            parts: list[list[np.ndarray]] = [[], [], [], []]
            for ids, scores, found in heaps.values():
                row, slot, place = np.nonzero(scores != NOTHING)
                for part, values in zip(parts, (ids[row], slot, found[row, slot, place], scores[row, slot, place])):
                    part.append(values)
            heaps.clear()
            joined = [np.concatenate(p) if p else np.empty(0, dtype=np.int64) for p in parts]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(joined, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["anchor_id", "slot", "vec_id", "score"])

        def numbers(batch: pa.RecordBatch, name: str, at: int) -> np.ndarray:
            return np.frombuffer(batch.column(batch.schema.get_field_index(name))[at].as_buffer(), dtype=np.int64)

        for batch in batches:
            for at in range(batch.num_rows):
                ids, candidates = numbers(batch, "a_ids", at), numbers(batch, "ids", at)
                a = numbers(batch, "a_vectors", at).reshape(len(ids), -1)
                b = numbers(batch, "vectors", at).reshape(len(candidates), -1)
                common = min(a.shape[1], b.shape[1])
                scores = strassen(a[:, :common], b[:, :common].T, params.leaf)
                same = numbers(batch, "a_labels", at)[:, None] == numbers(batch, "labels", at)
                others = ids[:, None] != candidates
                if goals:
                    goal = numbers(batch, "a_goals", at).reshape(len(ids), goals)
                    low, high = _share_up(goal, params.low_percent), _share_down(goal, params.high_percent)
                    found = [_best(scores, others & ~same & (scores >= low[:, [s]]) & (scores <= high[:, [s]]) & (goal[:, [s]] != NOTHING), k) for s in range(goals)]
                else:
                    found = [_best(scores, others & same, k)]
                new = np.stack([f[0] for f in found], 1), candidates[np.stack([f[1] for f in found], 1)]
                key = (batch.column(batch.schema.get_field_index("a_tile"))[at].as_py(), ids.tobytes())
                if key not in heaps:
                    if len(heaps) >= params.held_blocks:
                        yield flush()
                    heaps[key] = (ids, np.full((len(ids), slots, k), NOTHING), np.zeros((len(ids), slots, k), dtype=np.int64))
                heaps[key] = (ids, *merged(heaps[key][1:], new, k))
        yield flush()

    heaps = pairs.mapInArrow(scan, "anchor_id long, slot int, vec_id long, score long")
    return first_rows(heaps, ["anchor_id", "slot"], [F.desc("score"), F.asc("vec_id")], k)


def _pairs(blocks: DataFrame, candidates: DataFrame, condition: Column) -> DataFrame:
    """Blocks of the stated anchors against all candidates, pair by pair of tiles."""
    named = blocks.select(*[F.col(c).alias(f"a_{c}") for c in blocks.columns])
    return named.join(candidates.select("lo", "hi", "ids", "labels", "vectors"), condition)


def mine(
    vectors: DataFrame, is_anchor: Column, label: Column | None = None, vec_id: str = "vec_id", embedding: str = "embedding", params: Params = Params()
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `is_anchor` is a condition on the column `vec_id`; `label` an expression over `vectors`.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, F.col("label") if label is None else label, vec_id, embedding, params.scale)
    spread = rows.repartitionByRange(parallelism(spark), "label", F.xxhash64("vec_id", "vector"), F.monotonically_increasing_id())
    candidates = stored(tiles(spread, params), "candidates")
    anchors = rows.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row")).select("vec_id", "row.*")
    anchors = stored(anchors, "anchors")
    tasks = -(-anchors.count() // params.anchors_per_task)
    if not tasks:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")

    blocks = stored(tiles(anchors.coalesce(tasks), params), "blocks")
    shared = (F.col("a_lo") <= F.col("hi")) & (F.col("a_hi") >= F.col("lo"))
    best = _scan(_pairs(blocks, candidates, shared), params, params.positives, 0)
    goal = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), F.col("vec_id"))))
    positives = stored(best.groupBy("anchor_id").agg(goal.alias("goals")), "positives")  # at most `positives` each

    scores = F.transform("goals", lambda g: -g["minus"])
    filled = F.slice(F.concat(scores, F.array_repeat(F.lit(NOTHING), params.positives)), 1, params.positives)
    aimed = anchors.join(positives, F.col("vec_id") == F.col("anchor_id")).select("vec_id", "label", "vector", filled.alias("goals"))
    blocks = stored(tiles(aimed.coalesce(tasks), params, params.positives), "aimed")
    alone = (F.col("a_lo") == F.col("hi")) & (F.col("a_hi") == F.col("lo"))  # one label, the same: nothing to find
    found = _scan(_pairs(blocks, candidates, ~alone), params, params.negatives, params.positives)
    listed = found.groupBy("anchor_id", "slot").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), F.col("vec_id")))).alias("negatives")
    )
    goals = positives.select("anchor_id", F.posexplode("goals").alias("slot", "goal"))
    return goals.join(listed, ["anchor_id", "slot"]).select("anchor_id", "goal", F.posexplode("negatives").alias("place", "negative")).select(
        "anchor_id", F.col("goal.vec_id").alias("positive_id"), (F.col("place") + 1).alias("rank"), F.col("negative.vec_id").alias("negative_id"),
        (-F.col("goal.minus")).alias("positive_score"), (-F.col("negative.minus")).alias("negative_score"),
    )
