"""Language-model scoring with a weighted backoff automaton.

The model is an n-gram model with Dirichlet-prior smoothing: P(w | h) = (c(hw) + k P(w | h'))
/ (c(h) + k), where h' is h without its first word, and at the bottom P(w) = (c(w) + 1) /
(N + V + 1). As an automaton, every n-gram seen in training is a state; reading a word follows
the arc to the longest extension that was seen, and where there is none the failure arc
(weight k / (c(h) + k)) leads to the state of the shorter history. All documents of a block
are traversed together, one word at a time from left to right; each carries its state and its
sum of log10 probabilities.

The automaton of a whole corpus fits no task, so it is never put together. Documents are dealt
to blocks of bounded size; a block lists the n-grams it contains with their counts in its own
training documents, these are summed over all blocks per range of their hash, and every block
gets back the counts of just the n-grams it listed: the part of the automaton that its texts
can reach. What is gathered therefore grows with the corpus, and no count is pruned or capped.

Tokens are words (A-Z lower-cased) and one end per document; the end is also the history in
which a document starts.

Defined results: a null or blank text is the end alone. Rows with a null id are scored and not
learned from. Repeated rows are scored, and learned from, row by row. Without training
documents N and V are 0 and every token has probability 1. An empty table gives an empty
result. Other columns are never read. N-grams are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.llm.hashing import mix64, stream, word_hashes
from paddock.llm.tables import text_bytes

_END = stream(41, 1)[0]
_STEP = stream(42, 1)[0] | np.uint64(1)


@dataclass(frozen=True)
class Params:
    order: int = 2
    prior: float = 2.0  # k
    block_bytes: int = 8 << 20  # of text
    range_bits: int = 8  # at least; there are twice as many ranges as blocks


def _tokens(text: bytes | None) -> np.ndarray:
    return np.append(word_hashes(text), _END)


def _ngrams(tokens: np.ndarray, order: int) -> list[np.ndarray]:
    """For each n up to `order`, the hash of the n-gram that ends at each token; before the
    first token lies an end, and nothing before that."""
    out = [tokens]
    for n in range(2, order + 1):
        longer = np.zeros(len(tokens), dtype=np.uint64)
        before = np.concatenate(([_END], out[-1][:-1])) if n == 2 else np.concatenate(([np.uint64(0)], out[-1][:-1]))
        longer = mix64(before * _STEP + tokens)
        # an n-gram that would start before the end ahead of the text does not exist
        if n > 2:
            longer[: n - 2] = 0
        out.append(longer)
    return out


def _count(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sum of their weights."""
    if not len(keys):
        return keys, np.zeros(0, dtype=np.int64)
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(weights, first)


def _pack_keys(keys: np.ndarray) -> bytes:
    """The low 7 bytes of each key; the range that a key is in tells the eighth."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def _unpack_keys(packed: bytes, top: int) -> np.ndarray:
    out = np.full((len(packed) // 7, 8), top, dtype=np.uint8)
    out[:, :7] = np.frombuffer(packed, np.uint8).reshape(-1, 7)
    return out.reshape(-1).view("<u8")


def _pack_counts(counts: np.ndarray) -> bytes:
    """Counts in the fewest bytes that hold the largest, after a byte that says how many."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(counts) or counts.max() < 1 << (8 * w))
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def _unpack_counts(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"<u{packed[0]}", offset=1).astype(np.int64)


def _block_ngrams(texts: list[bytes | None], train: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a block, of all orders, with their training counts."""
    keys, weights = [], []
    for text, learned in zip(texts, train):
        for grams in _ngrams(_tokens(text), order):
            keys.append(grams)
            weights.append(np.full(len(grams), learned, dtype=np.int64))
    return _count(np.concatenate(keys), np.concatenate(weights)) if keys else _count(np.zeros(0, np.uint64), np.zeros(0, np.int64))


def totals(docs: DataFrame, params: Params) -> tuple[int, int, int]:
    """(training tokens, distinct training tokens, bytes of all texts)."""
    shift = np.uint64(64 - params.range_bits)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, count, seen = 0, 0, []
            for text, learned in zip(text_bytes(batch, "__text"), batch.column(1).to_pylist()):
                size += len(text or b"")
                if learned:
                    tokens = _tokens(text)
                    count += len(tokens)
                    seen.append(tokens)
            keys, _ = _count(np.concatenate(seen), np.ones(count, np.int64)) if seen else (np.zeros(0, np.uint64), None)
            parts = np.split(keys, np.searchsorted(keys >> shift, np.arange(1, 1 << params.range_bits)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary()),
                 pa.array([count] + [0] * (len(parts) - 1), pa.int64()), pa.array([size] + [0] * (len(parts) - 1), pa.int64())],
                ["range", "keys", "tokens", "size"],
            )

    def count(group: pa.Table) -> pa.Table:
        keys, _ = _count(np.frombuffer(b"".join(group["keys"].to_pylist()), np.uint64), np.ones(sum(map(len, group["keys"].to_pylist())) // 8, np.int64))
        return pa.table({"kinds": pa.array([len(keys)], pa.int64()), "tokens": pa.array([sum(group["tokens"].to_pylist())], pa.int64()), "size": pa.array([sum(group["size"].to_pylist())], pa.int64())})

    packed = docs.select("__text", "__train").mapInArrow(pack, "range int, keys binary, tokens long, size long")
    row = packed.groupBy("range").applyInArrow(count, "kinds long, tokens long, size long").agg(F.sum("tokens"), F.sum("kinds"), F.sum("size")).first()
    return tuple(x or 0 for x in row)


def traverse(texts: list[bytes | None], keys: np.ndarray, counts: np.ndarray, train_tokens: int, kinds: int, params: Params) -> tuple[np.ndarray, ...]:
    """Walk the automaton over all texts together: (tokens, known tokens, base, score) of each.

    `keys` and `counts` are the states: sorted n-gram hashes and their training counts.
    """
    order, prior, size = params.order, params.prior, len(texts)
    tokens = [_tokens(t) for t in texts]
    length = np.array([len(t) for t in tokens], dtype=np.int64)
    # Documents by falling length: those still being read are always the first ones.
    by_length = np.argsort(-length, kind="stable")
    # grams[n] holds, token place by token place, the n-gram that ends there in each document.
    sorted_tokens = [tokens[i] for i in by_length]
    alive = np.searchsorted(-length[by_length], -np.arange(1, (length.max() if size else 0) + 1), side="right")
    start = np.concatenate(([0], np.cumsum(alive)))
    row = np.concatenate([np.arange(n) for n in alive]) if size else np.zeros(0, np.int64)
    place = np.repeat(np.arange(len(alive)), alive)
    offset = np.concatenate(([0], np.cumsum(length[by_length])))[:-1]
    at = offset[row] + place if size else row
    seen = []
    for n in range(order):
        flat = np.concatenate([_ngrams(t, order)[n] for t in sorted_tokens])[at] if size else np.zeros(0, np.uint64)
        found = np.searchsorted(keys, flat)
        found = np.minimum(found, max(0, len(keys) - 1))
        seen.append(np.where(keys[found] == flat, counts[found], 0) if len(keys) else np.zeros(len(flat), np.int64))
    unit = np.log10((seen[0] + 1.0) / (train_tokens + kinds + 1.0))
    end_count = counts[np.searchsorted(keys, _END)] if len(keys) and _END in keys[np.searchsorted(keys, _END) :][:1] else 0

    base, score, known = np.zeros(size), np.zeros(size), np.zeros(size, np.int64)
    # state[n] is the count of the history of n words that a document stands in; 0 if unseen
    state = [np.full(size, end_count, dtype=np.float64)] + [np.zeros(size) for _ in range(order - 2)] if order > 1 else []
    for t, n in enumerate(alive):
        here = slice(start[t], start[t + 1])
        chance = (seen[0][here] + 1.0) / (train_tokens + kinds + 1.0)
        for k in range(1, order):
            # the arc of the longer history; without one, the failure arc's weight alone
            history = state[k - 1][:n]
            chance = np.where(history > 0, (seen[k][here] + prior * chance) / (history + prior), chance)
        score[:n] += np.log10(chance)
        base[:n] += unit[here]
        known[:n] += seen[0][here] > 0
        for k in range(order - 1):
            state[k][:n] = seen[k][here]
    back = np.empty(size, dtype=np.int64)
    back[by_length] = np.arange(size)
    return length, known[back], base[back], score[back]


def score(docs: DataFrame, held_out: Column, text: str = "text", doc_id: str = "doc_id", params: Params = Params()) -> DataFrame:
    """Every row of `docs`: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model is learned from rows with an id for which `held_out` does not hold.
    """
    narrow = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("__text"), F.coalesce(held_out, F.lit(False)).alias("held_out"),
        (F.col(doc_id).isNotNull() & ~F.coalesce(held_out, F.lit(True))).alias("__train"),
    )
    train_tokens, kinds, size = totals(narrow, params)
    blocks = max(1, -(-size // params.block_bytes))
    ranges = 1 << max(8, params.range_bits)
    while ranges < 2 * blocks:
        ranges *= 2
    bits = ranges.bit_length() - 1
    shift = np.uint64(64 - bits)
    block = F.pmod(F.xxhash64("doc_id", F.xxhash64("__text")), F.lit(blocks)).cast("int")
    dealt = narrow.select(block.alias("block"), "doc_id", "__text", "held_out", "__train")

    def listing(group: pa.Table) -> pa.Table:
        keys, counts = _block_ngrams(_texts(group), group["__train"].to_numpy(), params.order)
        cuts = np.searchsorted(keys >> shift, np.arange(1, ranges))
        # empty parts are left out, so there are never more rows than n-grams
        full = [(r, p, c) for r, (p, c) in enumerate(zip(np.split(keys, cuts), np.split(counts, cuts))) if len(p)]
        number = group["block"][0].as_py()
        return pa.table({
            "range": pa.array([r for r, _, _ in full], pa.int32()), "block": pa.array([number] * len(full), pa.int32()),
            "keys": pa.array([_pack_keys(p) for _, p, _ in full], pa.binary()), "counts": pa.array([_pack_counts(c) for _, _, c in full], pa.binary()),
        })

    def summing(group: pa.Table) -> pa.Table:
        top = group["range"][0].as_py() >> (bits - 8)
        lists = [_unpack_keys(k, top) for k in group["keys"].to_pylist()]
        own = [_unpack_counts(c) for c in group["counts"].to_pylist()]
        keys, counts = _count(np.concatenate(lists), np.concatenate(own))
        back = [_pack_counts(counts[np.searchsorted(keys, part)]) for part in lists]
        return pa.table({"range": group["range"], "block": group["block"], "counts": pa.array(back, pa.binary())})

    def reading(texts: pa.Table, answers: pa.Table) -> pa.Table:
        values = _texts(texts)
        keys, _ = _block_ngrams(values, np.zeros(len(values), np.int64), params.order)
        parts = answers.sort_by("range")["counts"].to_pylist()
        counts = np.concatenate([_unpack_counts(p) for p in parts])
        n, known, base, total = traverse(values, keys, counts, train_tokens, kinds, params)
        return pa.table({
            "doc_id": texts["doc_id"], "held_out": texts["held_out"], "n_tokens": n, "n_known": known,
            "train_tokens": pa.array([train_tokens] * len(values), pa.int64()), "base_score": base, "score": total,
        })

    listed = dealt.groupBy("block").applyInArrow(listing, "range int, block int, keys binary, counts binary")
    summed = listed.groupBy("range").applyInArrow(summing, "range int, block int, counts binary")
    kind = dict(narrow.dtypes)["doc_id"]
    return dealt.groupBy("block").cogroup(summed.groupBy("block")).applyInArrow(
        reading, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def _texts(group: pa.Table) -> list[bytes | None]:
    return group["__text"].cast(pa.large_binary()).to_pylist()
