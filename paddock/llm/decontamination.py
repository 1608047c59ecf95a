"""Benchmark decontamination: which documents hold a benchmark item, exactly or nearly.

Documents are slid over by windows as long as an item (in words). Windows and items get a
SimHash over their word shingles, each weighted by how often it occurs. A multi-index of byte
blocks finds every item fingerprint within `radius` bits of a window's: with b blocks, two
fingerprints within the radius differ by at most radius // b bits in some block, and each
item is filed under all block values that near. Found candidates are verified by the exact
weighted Jaccard similarity of the two shingle multisets (sum of minima over sum of maxima).

A window without any shingle of the items has similarity 0 with all of them, so only windows
around such shingles are fingerprinted; this drops nothing that could be reported. With 128
bits, similarity 0.8 puts fingerprints about 19 bits apart (standard deviation 4), so the
default radius of 40 lies five deviations out.

Items travel to the tasks in blocks of `block_items`; each block is one pass over the texts.

Defined results: null and blank texts and items match nothing. An item with fewer words than
a shingle is one shingle; a document shorter than an item is one window. Documents with a null
id are reported with it, and repeated rows row by row; item rows that repeat an id are
separate items of one id, of which the best match is reported. Ties take the first window. An
empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.llm.hashing import contains, mix64, shingle_hashes, stream, word_hashes
from paddock.llm.tables import text_bytes

SCHEMA = "doc_id long, item_id long, similarity double, start_word long, n_words long"
_SECOND = stream(31, 1)[0]
_BLOCKS = 16  # bytes of a fingerprint
_STRETCH = 8192  # windows are fingerprinted in stretches of a text, which bounds memory


@dataclass(frozen=True)
class Params:
    width: int = 5
    similarity: float = 0.8
    radius: int = 40
    block_items: int = 10_000


def _signs(shingles: np.ndarray) -> np.ndarray:
    """128 signs of each shingle, one row each."""
    words = np.stack([shingles, mix64(shingles ^ _SECOND)], axis=1)
    bits = np.unpackbits(words.view(np.uint8).reshape(len(shingles), _BLOCKS), axis=1)
    return bits.astype(np.int8) * np.int8(2) - np.int8(1)


def _pack(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1)


def _window_prints(shingles: np.ndarray, begin: np.ndarray, held: int) -> np.ndarray:
    """Fingerprints of the runs of `held` shingles that begin at the given places."""
    sums = np.zeros((len(shingles) + 1, 8 * _BLOCKS), dtype=np.int32)
    np.cumsum(_signs(shingles), axis=0, dtype=np.int32, out=sums[1:])
    return _pack(sums[begin + held] - sums[begin])


def simhash(shingles: np.ndarray) -> np.ndarray:
    """The fingerprint (16 bytes) of one multiset of shingles."""
    return _pack(_signs(shingles).sum(axis=0, dtype=np.int64)[None, :])[0]


def weighted_similarity(a: Counter, b: Counter) -> float:
    shared = sum(min(n, b[k]) for k, n in a.items() if k in b)
    return shared / (sum(a.values()) + sum(b.values()) - shared)


class _Group:
    """The items of one length in words."""

    def __init__(self, length: int, ids: list[int], shingles: list[np.ndarray], radius: int):
        self.length, self.ids = length, ids
        self.known = np.unique(np.concatenate(shingles))
        self.counts = [Counter(s.tolist()) for s in shingles]
        self.prints = np.stack([simhash(s) for s in shingles])
        near = radius // _BLOCKS
        masks = np.array([sum(1 << b for b in bits) for n in range(near + 1) for bits in itertools.combinations(range(8), n)], dtype=np.uint8)
        # filed[block, value] is the row of items whose block lies within `near` bits of value
        self.filed = np.zeros((_BLOCKS, 256, len(ids)), dtype=bool)
        for block in range(_BLOCKS):
            for k in range(len(ids)):
                self.filed[block, self.prints[k, block] ^ masks, k] = True

    def candidates(self, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs within the radius."""
        near = np.zeros((len(prints), len(self.ids)), dtype=bool)
        for block in range(_BLOCKS):
            near |= self.filed[block, prints[:, block]]
        window, item = np.nonzero(near)
        distance = np.bitwise_count(prints[window] ^ self.prints[item]).sum(axis=1)
        keep = distance <= radius
        return window[keep], item[keep]


class Index:
    """A block of items, by the width of their shingles and their length."""

    def __init__(self, items: list[tuple[int, bytes | None]], params: Params):
        self.params = params
        by: dict[tuple[int, int], tuple[list[int], list[np.ndarray]]] = {}
        for item_id, text in items:
            words = word_hashes(text)
            if len(words):
                ids, shingles = by.setdefault((min(params.width, len(words)), len(words)), ([], []))
                ids.append(item_id)
                shingles.append(shingle_hashes(words, params.width))
        self.groups: dict[int, list[_Group]] = {}  # by width
        for (width, length), (ids, shingles) in by.items():
            self.groups.setdefault(width, []).append(_Group(length, ids, shingles, params.radius))
        self.known = {width: np.unique(np.concatenate([g.known for g in groups])) for width, groups in self.groups.items()}
        self.seen = {}
        for width, known in self.known.items():
            self.seen[width] = np.zeros(1 << 20, dtype=bool)
            self.seen[width][known >> np.uint64(44)] = True

    def matches(self, text: bytes | None) -> list[tuple[int, float, int, int]]:
        """(item id, similarity, first word, words) of the best window of each item found."""
        best: dict[int, tuple[float, int, int]] = {}
        words = word_hashes(text) if self.known else ()
        for width, known in self.known.items():
            if len(words) < width:
                continue
            shingles = shingle_hashes(words, width)
            maybe = np.flatnonzero(self.seen[width][shingles >> np.uint64(44)])
            maybe = maybe[contains(known, shingles[maybe])]
            if not len(maybe):
                continue
            for group in self.groups[width]:
                hits = maybe[contains(group.known, shingles[maybe])]
                if not len(hits):
                    continue
                span = min(group.length, len(words))
                # windows that hold a hit: runs of starts, marked by where they begin and end
                marks = np.zeros(len(words) + 2, dtype=np.int32)
                np.add.at(marks, np.maximum(0, hits - span + width), 1)
                np.add.at(marks, np.minimum(hits, len(words) - span) + 1, -1)
                begin = np.flatnonzero(np.cumsum(marks[: len(words) - span + 1]) > 0)
                held = span - width + 1
                for part in np.split(begin, np.flatnonzero(np.diff(begin // _STRETCH)) + 1):
                    prints = _window_prints(shingles[part[0] : part[-1] + held], part - part[0], held)
                    for window, item in zip(*group.candidates(prints, self.params.radius)):
                        at = int(part[window])
                        alike = weighted_similarity(Counter(shingles[at : at + held].tolist()), group.counts[item])
                        name = group.ids[item]
                        if alike >= self.params.similarity and (name not in best or (-alike, at, span) < (-best[name][0], best[name][1], best[name][2])):
                            best[name] = (alike, at, span)
        return [(name, *found) for name, found in sorted(best.items(), key=lambda x: (x[0] is None, x[0]))]


def _indexes(benchmark: DataFrame, item_text: str, item_id: str, params: Params) -> Iterator[Index]:
    """The items in blocks, each of which is one pass over the texts."""
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("__text"))
    blocks = max(1, -(-items.count() // params.block_items))
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "__text"), F.lit(blocks)) == block).toArrow()
        yield Index(list(zip(rows["item_id"].to_pylist(), rows["__text"].cast(pa.large_binary()).to_pylist())), params)


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", params: Params = Params()) -> DataFrame:
    """A row for each document and benchmark item that it holds: doc_id, item_id, similarity,
    start_word, n_words (the best window)."""
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("__text"))
    out = None
    for index in _indexes(benchmark, item_text, item_id, params):

        def scan(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(i, *m) for i, t in zip(batch.column(0).to_pylist(), text_bytes(batch, "__text")) for m in index.matches(t)]
                types = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate(types)], ["doc_id", "item_id", "similarity", "start_word", "n_words"])

        part = narrow.mapInArrow(scan, SCHEMA)
        out = part if out is None else out.unionAll(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id", params: Params = Params()) -> DataFrame:
    """The rows of `docs` whose text holds no benchmark item, all columns as they were.

    Each row is judged by itself, whatever its id.
    """
    out = docs
    for index in _indexes(benchmark, item_text, item_id, params):

        def clean(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not index.matches(t) for t in text_bytes(batch, text)], pa.bool_()))

        out = out.mapInArrow(clean, docs.schema)
    return out
