"""The rows of a round packed into blocks of bytes, for histograms that touch no row in the JVM.

A block holds the bins of up to `BLOCK_ROWS` rows, a feature after the other, and of every tree under
way its quantised gradients. A level of growth is one pass over the blocks: numpy walks
the rows from the root to the nodes asked for and adds up bigints, so a task hands on one sum per
(slot, node, feature, bin) and the plan of a level is the same for every tree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paddock.operators.binning import FeatureBins
from paddock.operators.objectives import ObjectiveParams, array_gradients

BLOCK_ROWS = 1 << 16
# Sums that a task holds at most, 24 bytes each; wider levels are summed by Spark's own aggregate.
TASK_SUMS = 1 << 21

# `places`: of rows kept apart, by slot the nodes they are kept at and the rows of each (`apart`).
PACKED = "rows int, bins binary, sums binary, places binary"
STORED = "bins binary, cells binary"
# Column that holds a block's bins on the first row of the block, null on the others.
HELD = "__held"
HISTOGRAM = "slot int, node int, feature int, bin int, g long, h long, n long"


@dataclass(frozen=True)
class Step:
    """A node that rows pass: the side they take, and what lies below."""

    feature: int
    bin: int
    missing_bin: int
    default_left: bool
    cats: tuple[int, ...] | None
    left: Step | int | None  # a step, the place of a node asked for, or nothing asked for
    right: Step | int | None


@dataclass(frozen=True)
class Asked:
    """What a level asks of one slot: the way to its nodes, and their numbers; of rows kept apart, a way from each node they are kept at."""

    slot: int
    way: Step | int | None
    nodes: tuple[int, ...]
    apart: dict[int, Step | int] | None = None

    @property
    def ways(self) -> dict[int, Step | int | None]:
        return {0: self.way} if self.apart is None else self.apart


def pack(rows: DataFrame, slots: list[tuple[str, str]], features: int, wide: bool) -> DataFrame:
    """Blocks of rows with columns b0, b1, ... and the gradient columns of each slot.

    A null gradient leaves a row out of a slot; rows left out of all are not packed. A null hessian adds nothing.
    """
    kind = np.int32 if wide else np.int16

    size = BLOCK_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, size):
            yield from _packed(_bins(part, features, kind), part, slots)

    columns = [*[f"b{i}" for i in range(features)], *[c for slot in slots for c in slot]]
    return rows.select(*columns).mapInArrow(run, PACKED)


def _parts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Tables of up to `size` rows."""

    def cut() -> Iterator[pa.Table]:
        whole = pa.Table.from_batches(held).combine_chunks() if held else None
        for at in range(0, whole.num_rows if held else 0, size):
            yield whole.slice(at, size)

    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= size:
            yield from cut()
            held, count = [], 0
    yield from cut()


def _bins(part: pa.Table, features: int, kind: type) -> np.ndarray:
    return np.stack([part[f"b{i}"].to_numpy().astype(kind, copy=False) for i in range(features)])


def _packed(bins: np.ndarray, part: pa.Table, slots: list[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
    """The block of a table's rows, without those left out of all slots."""
    inside = np.stack([part[g].is_valid().to_numpy() for g, _ in slots])
    some = inside.any(axis=0)
    if not some.any():
        return
    whole = bool(some.all())
    sums = np.stack([_filled(part[c]) if whole else _filled(part[c])[some] for slot in slots for c in slot])
    bins, inside = (bins, inside) if whole else (bins[:, some], inside[:, some])
    yield _block(bins, sums, inside)


def _block(bins: np.ndarray, sums: np.ndarray, inside: np.ndarray, places: bytes | None = None) -> pa.RecordBatch:
    body = sums.tobytes() + inside.astype(np.uint8).tobytes()
    arrays = [pa.array([bins.shape[1]], pa.int32()), pa.array([bins.tobytes()], pa.binary()), pa.array([body], pa.binary()), pa.array([places], pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, ["rows", "bins", "sums", "places"])


def _kept_places(places: pa.BinaryScalar, slots: int) -> list[dict[int, np.ndarray]]:
    """The rows kept at each node, by slot."""
    buffer, at, out = places.as_buffer(), 0, []
    for _ in range(slots):
        count = int(np.frombuffer(buffer, np.int32, 1, at)[0])
        nodes, sizes = np.frombuffer(buffer, np.int32, 2 * count, at + 4).reshape(2, count)
        at += 4 + 8 * count
        ends = np.cumsum(sizes).tolist()
        rows = np.frombuffer(buffer, np.uint16, ends[-1] if ends else 0, at)
        at += 2 * len(rows)
        out.append({n: rows[end - size : end] for n, size, end in zip(nodes.tolist(), sizes.tolist(), ends)})
    return out


def _places(kept: list[dict[int, np.ndarray]]) -> bytes:
    """`_kept_places` as bytes; a block has up to 65,536 rows, so a row's number takes two of them."""
    parts = []
    for of_slot in kept:
        parts.append(np.array([len(of_slot), *of_slot, *map(len, of_slot.values())], np.int32).tobytes())
        parts += [rows.astype(np.uint16).tobytes() for rows in of_slot.values()]
    return b"".join(parts)


def _standing(places: pa.BinaryScalar, inside: np.ndarray) -> list[dict[int, np.ndarray]]:
    """By slot, the rows at each node: all at the root (0) unless they are kept apart."""
    if places.is_valid:
        return _kept_places(places, len(inside))
    return [{0: np.flatnonzero(of_slot)} for of_slot in inside]


def apart(packed: DataFrame, slots: int, features: int, wide: bool, ways: list[dict[int, Step | int]]) -> DataFrame:
    """Blocks of the rows under some nodes alone, kept at those nodes: what the ways lead to by slot.

    A level that asks for nodes below them need neither read the other rows nor walk from the root.
    """
    kind = np.dtype(np.int32 if wide else np.int16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, bins, values, places in zip(batch["rows"].to_pylist(), batch["bins"], batch["sums"], batch["places"]):
                bins, (grads, inside) = np.frombuffer(bins.as_buffer(), kind).reshape(features, n), _sums(values, slots, n)
                moved, some = [], np.zeros(n, bool)
                for of_slot, standing in zip(ways, _standing(places, inside)):
                    moved.append({})
                    for node, rows in standing.items():
                        moved[-1].update(_walk(of_slot.get(node), rows.astype(np.intp), bins))
                    for rows in moved[-1].values():
                        some[rows] = True
                if not some.any():
                    continue
                fresh = np.cumsum(some) - 1
                kept = _places([{node: fresh[rows] for node, rows in of_slot.items()} for of_slot in moved])
                yield _block(bins[:, some], grads.reshape(2 * slots, n)[:, some], inside[:, some], kept)

    return packed.mapInArrow(run, PACKED)


def unpacked(packed: DataFrame, slots: list[tuple[str, str]], features: int, wide: bool, with_bins: bool = True) -> DataFrame:
    """The rows of packed blocks again: bins as b0, b1, ... and the gradient columns of each slot; a null hessian has become 0."""
    kind = np.dtype(np.int32 if wide else np.int16)
    names = [f"b{i}" for i in range(features if with_bins else 0)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, bins, values in zip(batch["rows"].to_pylist(), batch["bins"], batch["sums"]):
                bins, (grads, inside) = np.frombuffer(bins.as_buffer(), kind).reshape(features, n), _sums(values, len(slots), n)
                arrays = [pa.array(b.astype(np.int32)) for b in bins[: len(names)]]
                arrays += [pa.array(grads[k, i], mask=inside[k] == 0) for k in range(len(slots)) for i in range(2)]
                yield pa.RecordBatch.from_arrays(arrays, [*names, *[c for slot in slots for c in slot]])

    shape = [*[f"{b} int" for b in names], *[f"{c} long" for slot in slots for c in slot]]
    return packed.mapInArrow(run, ", ".join(shape))


def _sums(values: pa.BinaryScalar, slots: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and hessians by slot, and the rows inside each slot."""
    buffer = values.as_buffer()
    grads = np.frombuffer(buffer, np.int64, 2 * slots * n).reshape(slots, 2, n)
    return grads, np.frombuffer(buffer, np.uint8, slots * n, 16 * slots * n).reshape(slots, n)


# --- rows kept in blocks from round to round ---


def store(rows: DataFrame, carried: list[str], features: int, wide: bool) -> DataFrame:
    """Blocks of rows with columns b0, b1, ...: their bins, and the carried columns as an Arrow table."""
    kind, size = np.int32 if wide else np.int16, BLOCK_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, size):
            yield _stored(_bins(part, features, kind).tobytes(), part.select(carried))

    return rows.select(*carried, *[f"b{i}" for i in range(features)]).mapInArrow(run, STORED)


def _stored(bins: bytes, cells: pa.Table) -> pa.RecordBatch:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, cells.schema) as out:
        out.write_table(cells.combine_chunks())
    return pa.RecordBatch.from_arrays([pa.array([bins], pa.binary()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["bins", "cells"])


def _cells(held: pa.BinaryScalar) -> pa.Table:
    return pa.ipc.open_stream(held.as_buffer()).read_all().combine_chunks()


def _matrix(cells: pa.Table, name: str) -> np.ndarray:
    """A column of arrays of one length, rows by places."""
    flat = pa.concat_arrays(cells[name].chunks).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(cells.num_rows, -1)


def _arrays(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.reshape(-1), kind))


def _put(cells: pa.Table, name: str, values: np.ndarray) -> pa.Table:
    at = cells.schema.get_field_index(name)
    kind = cells.schema.field(at).type
    return cells.set_column(at, pa.field(name, kind), _arrays(values, kind.value_type).cast(kind))


def _leaf(way: Step | int, bins: np.ndarray) -> np.ndarray:
    """The leaf of every row."""
    out = np.zeros(bins.shape[1], np.int32)
    for place, rows in _walk(way, np.arange(bins.shape[1]), bins):
        out[rows] = place
    return out


# Trees whose values are added up: class, and value per leaf.
Values = list[tuple[int, list[float]]]


def _weighed(cells: pa.Table, values: Values) -> pa.Table:
    """Scores plus the values of the trees whose leaves are kept."""
    leaves, scores = _matrix(cells, "leaves"), _matrix(cells, "scores").copy()
    total = np.zeros_like(scores)
    for t, (k, of_leaf) in enumerate(values):
        total[:, k] += np.array(of_leaf)[leaves[:, t]]
    return _put(cells, "scores", scores + total)


def stored_rows(
    blocks: DataFrame, schema: T.StructType, features: int, wide: bool, ways: list[Step | int] = (), values: Values | None = None, held: bool = False,
) -> DataFrame:
    """The carried columns of stored rows, with their leaf of each way as leaf0, leaf1, ...

    With `values` the scores are those of the trees whose leaves are kept. With `held` the bins of a block come
    along on its first row, so that rows in this order can be put together again (`pack_held`, `store_held`).
    """
    kind = np.dtype(np.int32 if wide else np.int16)
    shape = T.StructType([*schema.fields, *[T.StructField(f"leaf{i}", T.IntegerType()) for i in range(len(ways))]])
    if held:
        shape = shape.add(HELD, T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed, kept in zip(batch["bins"] if held or ways else batch["cells"], batch["cells"]):
                cells = _cells(kept)
                n = cells.num_rows
                if values:
                    cells = _weighed(cells, values)
                arrays = [pa.concat_arrays(c.chunks) for c in cells.columns]
                if ways:
                    bins = np.frombuffer(packed.as_buffer(), kind).reshape(features, n)
                    arrays += [pa.array(_leaf(way, bins)) for way in ways]
                if held:
                    arrays.append(pa.concat_arrays([pa.array([packed.as_py()], pa.binary()), pa.nulls(n - 1, pa.binary())]))
                yield pa.RecordBatch.from_arrays(arrays, shape.names)

    return blocks.select(*(["bins"] if held or ways else []), "cells").mapInArrow(run, shape)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, pa.Table]]:
    """(bins, rows) of each block whose rows come in order."""
    bins, part = None, []
    for batch in batches:
        at = 0
        for start in np.flatnonzero(batch[HELD].is_valid().to_numpy(zero_copy_only=False)).tolist():
            if start > at:
                part.append(batch.slice(at, start - at))
            if part:
                yield bins, pa.Table.from_batches(part)
            bins, part, at = batch[HELD][start].as_py(), [], start
        if batch.num_rows > at:
            part.append(batch.slice(at))
    if part:
        yield bins, pa.Table.from_batches(part)


def pack_held(rows: DataFrame, slots: list[tuple[str, str]], features: int, wide: bool) -> DataFrame:
    """Packed blocks (see `pack`) of rows whose bins are held."""
    kind = np.dtype(np.int32 if wide else np.int16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bins, part in _together(batches):
            yield from _packed(np.frombuffer(bins, kind).reshape(features, part.num_rows), part, slots)

    return rows.select(HELD, *[c for slot in slots for c in slot]).mapInArrow(run, PACKED)


# Of a block's rows: which have a gradient, and gradients and hessians of each slot.
Grader = Callable[[pa.Table], tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]


def array_grader(objective: str, p: ObjectiveParams) -> Grader:
    """The gradients of `array_gradients`; rows without label, weight or score have none."""

    def grade(cells: pa.Table) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        named = [c for c in ("label", "weight") if c in cells.column_names]
        scores = pa.concat_arrays(cells["scores"].chunks).flatten()
        inside = scores.is_valid().to_numpy(zero_copy_only=False).reshape(cells.num_rows, -1).all(axis=1)
        for c in named:
            inside = inside & cells[c].is_valid().to_numpy()
        y, *weight = [cells[c].cast(pa.float64()).fill_null(0.0).to_numpy() for c in named]
        with np.errstate(over="ignore", invalid="ignore"):
            return inside, array_gradients(objective, y, _matrix(cells, "scores"), p, *weight)

    return grade


def _each_cells(batches: Iterator[pa.RecordBatch], values: Values | None) -> Iterator[tuple[pa.BinaryScalar | None, pa.Table]]:
    for batch in batches:
        for packed, kept in zip(batch["bins"] if "bins" in batch.schema.names else [None] * batch.num_rows, batch["cells"]):
            cells = _cells(kept)
            yield packed, _weighed(cells, values) if values else cells


def pack_graded(blocks: DataFrame, grader: Grader, scale: tuple[float, float], features: int, wide: bool, values: Values | None = None) -> DataFrame:
    """Packed blocks (see `pack`) of stored ones, with fixed-point gradients; no row leaves its block on the way."""
    kind = np.dtype(np.int32 if wide else np.int16)

    def fixed(x: np.ndarray, by: float) -> np.ndarray:
        return np.floor(np.nan_to_num(x, nan=0.0) * by + 0.5).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for packed, cells in _each_cells(batches, values):
            inside, pairs = grader(cells)
            if not inside.any():
                continue
            bins = np.frombuffer(packed.as_buffer(), kind).reshape(features, cells.num_rows)
            sums = np.stack([fixed(x, by) for pair in pairs for x, by in zip(pair, scale)])
            if not inside.all():
                bins, sums = bins[:, inside], sums[:, inside]
            yield _block(bins, sums, np.ones((len(pairs), bins.shape[1]), bool))

    return blocks.select("bins", "cells").mapInArrow(run, PACKED)


def graded_tops(blocks: DataFrame, grader: Grader, classes: int, values: Values | None = None) -> DataFrame:
    """One row: how many rows have a gradient (n), and the largest |g| and |h| of each class, as g0, h0, ..."""
    names = [f"{c}{k}" for k in range(classes) for c in "gh"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, cells in _each_cells(batches, values):
            inside, pairs = grader(cells)
            if inside.any():
                tops = [float(np.abs(x[inside]).max()) for pair in pairs for x in pair]
                yield pa.RecordBatch.from_arrays([pa.array([int(inside.sum())], pa.int64()), *[pa.array([x]) for x in tops]], ["n", *names])

    got = blocks.select("cells").mapInArrow(run, ", ".join(["n long", *[f"{c} double" for c in names]]))
    return got.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *[F.max(c).alias(c) for c in names])


def store_held(rows: DataFrame, carried: list[str]) -> DataFrame:
    """Stored blocks of rows whose bins are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bins, part in _together(batches):
            yield _stored(bins, part.select(carried))

    return rows.select(HELD, *carried).mapInArrow(run, STORED)


def advance(blocks: DataFrame, features: int, wide: bool, ways: list[Step | int], values: Values | None) -> DataFrame:
    """Stored blocks with the values of new trees added to the scores or, without values, their leaves to the leaves."""
    kind = np.dtype(np.int32 if wide else np.int16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed, kept in zip(batch["bins"], batch["cells"]):
                cells = _cells(kept)
                bins = np.frombuffer(packed.as_buffer(), kind).reshape(features, cells.num_rows)
                leaves = [_leaf(way, bins) for way in ways]
                if values is None:
                    cells = _put(cells, "leaves", np.column_stack([_matrix(cells, "leaves"), *leaves]).astype(np.int16))
                else:
                    scores = _matrix(cells, "scores").copy()
                    for leaf, (k, of_leaf) in zip(leaves, values):
                        scores[:, k] += np.array(of_leaf)[leaf]
                    cells = _put(cells, "scores", scores)
                yield _stored(packed.as_py(), cells)

    return blocks.mapInArrow(run, STORED)


def _filled(column: pa.ChunkedArray) -> np.ndarray:
    return column.fill_null(0).to_numpy().astype(np.int64, copy=False)


def _side(step: Step, bins: np.ndarray) -> np.ndarray:
    if step.cats is not None:
        return np.isin(bins, step.cats)
    left = bins <= step.bin
    if step.missing_bin >= 0:
        left = np.where(bins == step.missing_bin, step.default_left, left)
    return left


def _walk(way: Step | int | None, rows: np.ndarray, bins: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(place, rows) of each node asked for; rows that lead to none are left behind."""
    if way is None or not len(rows):
        return
    if isinstance(way, int):
        yield way, rows
        return
    left = _side(way, bins[way.feature][rows])
    if way.left is not None:
        yield from _walk(way.left, rows[left], bins)
    if way.right is not None:
        yield from _walk(way.right, rows[~left], bins)


def histograms(packed: DataFrame, slots: int, specs: list[FeatureBins], wide: bool, asked: list[Asked], features: list[int]) -> DataFrame:
    """(slot, node, feature, bin, g, h, n) of the nodes asked for, summed over all blocks."""
    kind = np.dtype(np.int32 if wide else np.int16)
    total = len(specs)
    first = np.concatenate([[0], np.cumsum([specs[f].num_bins for f in features])]).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = int(first[-1])
        sums = [np.zeros((3, len(a.nodes) * width), np.int64) for a in asked]
        for batch in batches:
            for n, bins, values, places in zip(batch["rows"].to_pylist(), batch["bins"], batch["sums"], batch["places"]):
                bins = np.frombuffer(bins.as_buffer(), kind).reshape(total, n)
                grads, inside = _sums(values, slots, n)
                standing = _standing(places, inside)
                for a, s in zip(asked, sums):
                    found = (_walk(way, standing[a.slot][node].astype(np.intp), bins) for node, way in a.ways.items() if node in standing[a.slot])
                    for place, rows in chain.from_iterable(found):
                        g, h = grads[a.slot, 0][rows], grads[a.slot, 1][rows]
                        for k, f in enumerate(features):
                            low, high = place * width + first[k], place * width + first[k + 1]
                            at = bins[f][rows].astype(np.intp)
                            np.add.at(s[0, low:high], at, g)
                            np.add.at(s[1, low:high], at, h)
                            s[2, low:high] += np.bincount(at, minlength=high - low)
        for a, s in zip(asked, sums):
            found = np.flatnonzero(s[2])
            place, cell = np.divmod(found, max(width, 1))
            feature = np.searchsorted(first, cell, side="right") - 1
            columns = [
                np.full(len(found), a.slot, np.int32), np.array(a.nodes, np.int32)[place], np.array(features, np.int32)[feature],
                (cell - first[feature]).astype(np.int32), *[s[i][found] for i in range(3)],
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["slot", "node", "feature", "bin", "g", "h", "n"])

    # Dealt by node and feature, as the search for splits needs them.
    parts = packed.mapInArrow(run, HISTOGRAM).repartition("slot", "node", "feature")
    return parts.groupBy("slot", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in "ghn"])
