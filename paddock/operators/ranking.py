"""Pairwise ranking gradients of rows in group order, in numpy.

Rows lie in slices, in order of group, score and id (`prefix.sorted_slices`). A group in one slice is graded where
it lies. Of groups that go on in the next slice there are fewer than slices: what all their rows must know of each
other (the first rows, the extremes, what the first rows gain) is gathered through the driver, a bounded number of
values a slice. Work is rows x truncation level for groups of any size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.operators.prefix import SLICE

# Rows of which the pairs with one first row are worked out at a time.
CHUNK_ROWS = 1 << 16


@dataclass
class Settings:
    """What a pair's force depends on beside its rows."""

    truncation_level: int
    sigmoid: float
    norm: bool


@dataclass
class _Rows:
    """Rows of whole groups or of one run of a group; `lost` rows lack a score or gain, `blank` ones a label."""

    group: np.ndarray  # number of the row's group
    rank: np.ndarray  # one-based place in it
    y: np.ndarray
    s: np.ndarray
    gain: np.ndarray
    blank: np.ndarray
    lost: np.ndarray
    unscored: np.ndarray

    def part(self, rows: slice) -> _Rows:
        return _Rows(*[getattr(self, f)[rows] for f in self.__dataclass_fields__])


@dataclass
class _Groups:
    """By group, what its rows meet: the first rows (groups x truncation level) and the best DCG; `flat` groups have equal scores."""

    y: np.ndarray
    s: np.ndarray
    gain: np.ndarray
    blank: np.ndarray
    lost: np.ndarray
    best: np.ndarray
    flat: np.ndarray


def _rows(table: pa.Table, starts: np.ndarray, before: int = 0) -> _Rows:
    def column(name: str) -> tuple[np.ndarray, np.ndarray]:
        held = table[name].combine_chunks()
        return held.fill_null(0.0).to_numpy(zero_copy_only=False), held.is_null().to_numpy(zero_copy_only=False)

    (y, blank), (s, unscored), (gain, no_gain) = column("y"), column("s"), column("gain")
    group = np.repeat(np.arange(len(starts)), np.diff([*starts, table.num_rows]))
    return _Rows(group, np.arange(table.num_rows) - starts[group] + 1 + before, y, s, gain, blank, unscored | no_gain, unscored)


def _starts(keys: pa.ChunkedArray) -> np.ndarray:
    """Where each run of equal keys starts."""
    keys = keys.combine_chunks()
    return np.concatenate([[0], np.flatnonzero(pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)) + 1])


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that end where a run of equal keys does."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = int(_starts(pa.chunked_array([batch["key"]]))[-1])
        if held and (last or held[-1]["key"][-1] != batch["key"][0]):
            goes_on = held[-1]["key"][-1] == batch["key"][0]
            yield pa.Table.from_batches([*held, batch.slice(0, last)] if goes_on or last else held)
            held = [batch.slice(last)]
        elif last:
            yield pa.Table.from_batches([batch.slice(0, last)])
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _best(rows: _Rows, groups: int, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, place, gain) of the `t` rows of highest label of each group."""
    key = np.where(rows.blank, -np.inf, np.where(np.isnan(rows.y), np.inf, rows.y))
    order = np.lexsort((-key, rows.group))
    group = rows.group[order]
    place = np.arange(len(group)) - np.searchsorted(group, np.arange(groups))[group]
    order, group, place = order[place < t], group[place < t], place[place < t]
    return group, place, np.where(rows.blank[order] | (rows.lost[order] & ~rows.unscored[order]), np.nan, rows.gain[order])


def _dcg(group: np.ndarray, place: np.ndarray, gain: np.ndarray, groups: int) -> np.ndarray:
    known = ~np.isnan(gain)
    return np.bincount(group[known], weights=gain[known] / np.log2(2.0 + place[known]), minlength=groups)


def _same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b) | (np.isnan(a) & np.isnan(b))


def _groups(rows: _Rows, starts: np.ndarray, t: int) -> _Groups:
    """Of groups that are whole."""
    count = len(starts)
    first = np.flatnonzero(rows.rank <= t)
    at = (rows.group[first], rows.rank[first] - 1)

    def firsts(values: np.ndarray) -> np.ndarray:
        out = np.zeros((count, t), values.dtype)
        out[at] = values[first]
        return out

    scored = np.bincount(rows.group[~rows.unscored], minlength=count)  # rows without a score come last
    flat = (scored == 0) | _same(rows.s[starts], rows.s[starts + np.maximum(scored, 1) - 1])
    return _Groups(*[firsts(x) for x in (rows.y, rows.s, rows.gain, rows.blank, rows.lost)], _dcg(*_best(rows, count, t), count), flat)


@dataclass
class _Forces:
    """Sums of a row's pairs (null where one lacks a value), and by group what the first rows get back and the sum of magnitudes."""

    g: np.ndarray
    h: np.ndarray
    null: np.ndarray
    back_g: np.ndarray
    back_h: np.ndarray
    pairs: np.ndarray


def _forces(rows: _Rows, groups: _Groups, p: Settings) -> _Forces:
    count, t = groups.y.shape
    n = len(rows.rank)
    out = _Forces(np.zeros(n), np.zeros(n), np.zeros(n, bool), np.zeros((count, t)), np.zeros((count, t)), np.zeros(count))
    for start in range(0, n, CHUNK_ROWS):
        part = slice(start, start + CHUNK_ROWS)
        _chunk_forces(rows.part(part), groups, p, out, part)
    return out


def _chunk_forces(rows: _Rows, groups: _Groups, p: Settings, out: _Forces, part: slice) -> None:
    disc = 1.0 / np.log2(1.0 + rows.rank)
    low, high = int(rows.group[0]), int(rows.group[-1]) + 1  # rows come in order of group
    magnitude = np.zeros(len(disc))
    g, h, null = out.g[part], out.h[part], out.null[part]
    counting = (groups.best > 0)[rows.group] & ~rows.blank
    for j in range(groups.y.shape[1]):
        at = np.flatnonzero(counting & (rows.rank > j + 1))
        if not len(at):
            break
        of = rows.group[at]
        differ = ~_same(rows.y[at], groups.y[of, j]) & ~groups.blank[of, j]
        at, of = at[differ], of[differ]
        lost = rows.lost[at] | groups.lost[of, j]
        null[at[lost]] = True
        at, of = at[~lost], of[~lost]
        y, s, other, fs = rows.y[at], rows.s[at], groups.y[of, j], groups.s[of, j]
        wins = (y > other) | (np.isnan(y) & ~np.isnan(other))
        with np.errstate(over="ignore", invalid="ignore"):
            rho = 1.0 / (1.0 + np.exp(p.sigmoid * np.where(wins, s - fs, fs - s)))
            delta = np.abs(rows.gain[at] - groups.gain[of, j]) * np.abs(disc[at] - 1.0 / np.log2(2.0 + j)) / groups.best[of]
            if p.norm:
                delta = np.where(groups.flat[of], delta, delta / (0.01 + np.abs(s - fs)))
            force = p.sigmoid * delta * rho
            curve = p.sigmoid * p.sigmoid * delta * rho * (1.0 - rho)
            signed = np.where(wins, -force, force)
            g[at] += signed
            h[at] += curve
            magnitude[at] += np.abs(signed)
            # The first rows get the opposite force, summed over all later rows of the group.
            out.back_g[low:high, j] -= np.bincount(of - low, weights=signed, minlength=high - low)
            out.back_h[low:high, j] += np.bincount(of - low, weights=curve, minlength=high - low)
    out.pairs[low:high] += np.bincount(rows.group[~null] - low, weights=magnitude[~null], minlength=high - low)


def _finished(rows: _Rows, found: _Forces, back_g: np.ndarray, back_h: np.ndarray, pairs: np.ndarray, p: Settings) -> tuple[pa.Array, pa.Array]:
    first = np.flatnonzero(rows.rank <= back_g.shape[1])
    at = (rows.group[first], rows.rank[first] - 1)
    g, h = found.g.copy(), found.h.copy()
    g[first] += back_g[at]
    h[first] += back_h[at]
    if p.norm:
        both = 2.0 * pairs  # both rows of a pair carry its force
        scale = np.where(both > 0, np.log2(1.0 + both) / np.where(both > 0, both, 1.0), 1.0)[rows.group]
        g, h = g * scale, h * scale
    return pa.array(g, mask=found.null), pa.array(h, mask=found.null)


@dataclass
class _Spread:
    """A group in several slices: rows before each slice, what its rows meet, and what the first rows get back."""

    before: dict[int, int]
    groups: _Groups
    back_g: np.ndarray | None = None
    back_h: np.ndarray | None = None
    pairs: np.ndarray | None = None


def _summary(t: int):
    """Of each run: its rows, its first `t` rows, its extremes and its `t` highest gains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_runs(batches):
            starts = _starts(table["key"])
            for start, end in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows]):
                part = table.slice(start, end - start)
                rows = _rows(part, np.array([0]))
                scored = np.flatnonzero(~rows.unscored)
                ends = [None, None] if not len(scored) else [float(rows.s[scored[0]]), float(rows.s[scored[-1]])]
                best = np.argsort(-np.where(rows.blank, -np.inf, np.where(np.isnan(rows.y), np.inf, rows.y)), kind="stable")[:t]
                lists = [rows.y[:t], rows.s[:t], rows.gain[:t], rows.blank[:t].astype(float), rows.lost[:t].astype(float), rows.y[best], _best(rows, 1, t)[2], rows.blank[best].astype(float)]
                columns = [pa.array([part[SLICE][0].as_py()], pa.int32()), part["key"].slice(0, 1).combine_chunks(), pa.array([end - start], pa.int64())]
                columns += [pa.array([x], pa.float64()) for x in ends] + [pa.array([x.tolist()], pa.list_(pa.float64())) for x in lists]
                yield pa.RecordBatch.from_arrays(columns, _SUMMARY)

    return run


_SUMMARY = [SLICE, "key", "n", "top", "bottom", "y", "s", "gain", "blank", "lost", "best_y", "best_gain", "best_blank"]


def _spread_groups(sliced: DataFrame, p: Settings) -> dict[object, _Spread]:
    """The groups that lie in several slices, by key."""
    ends = sliced.groupBy(SLICE).agg(F.min("key").alias("a"), F.max("key").alias("b")).collect()  # one row a slice
    seen: dict[object, int] = {}
    for r in ends:
        for key in {r["a"], r["b"]}:
            seen[key] = seen.get(key, 0) + 1
    keys = [key for key, slices in seen.items() if slices > 1]
    if not keys:
        return {}
    kind, t = sliced.schema["key"].dataType.simpleString(), p.truncation_level
    own = sliced.where(F.col("key").isin(keys))
    shape = f"{SLICE} int, key {kind}, n long, top double, bottom double, " + ", ".join(f"{c} array<double>" for c in _SUMMARY[5:])
    runs: dict[object, list] = {}
    for r in own.mapInArrow(_summary(t), shape).collect():  # fewer than two rows a slice
        runs.setdefault(r["key"], []).append(r)
    found = {}
    for key, parts in runs.items():
        parts.sort(key=lambda r: r[SLICE])
        sizes = np.cumsum([0, *[r["n"] for r in parts]]).tolist()
        joined = {c: np.concatenate([r[c] for r in parts]) for c in _SUMMARY[5:]}
        firsts = {c: np.pad(joined[c][:t], (0, max(t - len(joined[c]), 0)))[None, :] for c in ("y", "s", "gain", "blank", "lost")}
        best = np.argsort(-np.where(joined["best_blank"] > 0, -np.inf, np.where(np.isnan(joined["best_y"]), np.inf, joined["best_y"])), kind="stable")[:t]
        dcg = _dcg(np.zeros(len(best), int), np.arange(len(best)), joined["best_gain"][best], 1)
        ends = [x for r in parts for x in (r["top"], r["bottom"]) if x is not None]
        flat = not ends or bool(_same(np.array(ends[0]), np.array(ends[-1])))
        groups = _Groups(firsts["y"], firsts["s"], firsts["gain"], firsts["blank"] > 0, firsts["lost"] > 0, dcg, np.array([flat]))
        found[key] = _Spread({r[SLICE]: before for r, before in zip(parts, sizes)}, groups)
    sums = own.mapInArrow(_backs(found, p), f"{SLICE} int, key {kind}, back_g array<double>, back_h array<double>, pairs double")
    for r in sums.collect():  # fewer than two rows a slice
        at = found[r["key"]]
        for name, value in (("back_g", np.array([r["back_g"]])), ("back_h", np.array([r["back_h"]])), ("pairs", np.array([r["pairs"]]))):
            setattr(at, name, value if getattr(at, name) is None else getattr(at, name) + value)
    return found


def _spread_run(part: pa.Table, spread: _Spread, p: Settings) -> tuple[_Rows, _Forces]:
    rows = _rows(part, np.array([0]), spread.before[part[SLICE][0].as_py()])
    return rows, _forces(rows, spread.groups, p)


def _backs(spread: dict[object, _Spread], p: Settings):
    """Of each run of a spread group, what it gives back to the group's first rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_runs(batches):
            starts = _starts(table["key"])
            for start, end in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows]):
                part = table.slice(start, end - start)
                _, got = _spread_run(part, spread[part["key"][0].as_py()], p)
                lists = [pa.array([x[0].tolist()], pa.list_(pa.float64())) for x in (got.back_g, got.back_h)]
                columns = [pa.array([part[SLICE][0].as_py()], pa.int32()), part["key"].slice(0, 1).combine_chunks(), *lists, pa.array([float(got.pairs[0])])]
                yield pa.RecordBatch.from_arrays(columns, [SLICE, "key", "back_g", "back_h", "pairs"])

    return run


def _graded(spread: dict[object, _Spread], p: Settings, row_id: str):
    def spread_part(part: pa.Table, known: _Spread) -> pa.RecordBatch:
        rows, got = _spread_run(part, known, p)
        return batch_of(part, _finished(rows, got, known.back_g, known.back_h, known.pairs, p))

    def whole_part(part: pa.Table) -> pa.RecordBatch:
        starts = _starts(part["key"])
        rows = _rows(part, starts)
        got = _forces(rows, _groups(rows, starts, p.truncation_level), p)
        return batch_of(part, _finished(rows, got, got.back_g, got.back_h, got.pairs, p))

    def batch_of(part: pa.Table, values: tuple[pa.Array, pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part[row_id].combine_chunks(), *values], [row_id, "g", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_runs(batches):
            starts = _starts(table["key"])
            # Only the first and the last group of a slice can go on in another one.
            places = [*starts.tolist(), table.num_rows]
            low, high = 0, len(starts)
            if table["key"][0].as_py() in spread:
                low = 1
                yield spread_part(table.slice(0, places[1]), spread[table["key"][0].as_py()])
            if high > low and table["key"][-1].as_py() in spread:
                high -= 1
            if high > low:
                yield whole_part(table.slice(places[low], places[high] - places[low]))
            if low <= high < len(starts):
                yield spread_part(table.slice(places[high]), spread[table["key"][-1].as_py()])

    return run


def pair_gradients(sliced: DataFrame, row_id: str, p: Settings) -> DataFrame:
    """(row_id, g, h) of rows (key, row_id, y, s, gain) in sorted slices; rows without a key have none."""
    keyed = sliced.where(F.col("key").isNotNull())
    shape = sliced.select(row_id, F.lit(0.0).cast("double").alias("g"), F.lit(0.0).cast("double").alias("h")).schema
    for f in shape:
        f.nullable = True
    return keyed.mapInArrow(_graded(_spread_groups(keyed, p), p, row_id), shape)
