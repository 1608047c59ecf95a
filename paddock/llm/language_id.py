"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

1. Document frequencies of hashed character n-grams are counted over every labelled document.
2. A bounded, per-language sample of labelled documents trains the weights with
   follow-the-regularised-leader (FTRL-proximal, L1 and L2). The sample is dealt to a fixed
   number of shards which train in parallel; their weights are averaged.
3. A fifth of the sample is kept from training and sets the softmax temperature.
4. Every whole text is scored where it lies; only the weights travel.

Defined results: a null text, an empty text, or one without any letter is `und` with score 0;
so is every text when there is nothing to learn from. Rows with a null id are scored, and
neither rows with a null id nor with a null language are learned from. Repeated rows are
scored row by row, counted row by row in the document frequencies, and train once. Ties go to the language that is first by code point. Other columns are
never read. Texts of any length are read whole, in windows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.llm.hashing import stream
from paddock.llm.tables import stored

UNDETERMINED = "und"
_WINDOW = 1 << 20
_MULTIPLY = stream(11, 4) | np.uint64(1)


@dataclass(frozen=True)
class Params:
    bucket_bits: int = 15
    max_order: int = 3
    sample_per_language: int = 1500  # expected number of training documents of a language
    max_languages: int = 256  # the most frequent ones are learned
    shards: int = 8
    epochs: int = 3
    alpha: float = 0.5  # FTRL learning rate
    beta: float = 1.0
    l1: float = 1e-4
    l2: float = 1e-5


@dataclass(frozen=True)
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float
    params: Params


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def _codes(text: str) -> np.ndarray:
    """Lower-cased letters; every run of other characters is one space."""
    codes = np.frombuffer(text.lower().encode("utf-32-le"), dtype=np.uint32)
    letter = _letters()[codes]
    codes = np.where(letter, codes, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return codes[keep]


def ngram_counts(text: str | None, params: Params) -> np.ndarray | None:
    """Counts of hashed character n-grams of the whole text; None without any letter."""
    if not text:
        return None
    counts, tail = None, np.full(1, 32, dtype=np.uint32)
    for at in range(0, len(text), _WINDOW):
        codes = _codes(text[at : at + _WINDOW])
        if not (codes != 32).any():
            continue
        fresh = len(tail)
        codes = np.concatenate([tail, codes]).astype(np.uint64)
        found = []
        mixed = np.zeros(len(codes), dtype=np.uint64)
        for order in range(1, params.max_order + 1):
            mixed = mixed[: len(codes) - order + 1] + codes[order - 1 :] * _MULTIPLY[order - 1]
            # n-grams that lie in the tail were counted with the window before
            start = max(0, fresh - order + 1) if at else 0
            found.append(((mixed[start:] * _MULTIPLY[3]) >> np.uint64(64 - params.bucket_bits)).astype(np.int64))
        part = np.bincount(np.concatenate(found), minlength=1 << params.bucket_bits)
        counts = part if counts is None else counts + part
        tail = codes[-(params.max_order - 1) :].astype(np.uint32) if params.max_order > 1 else codes[:0].astype(np.uint32)
    return counts


def _features(text: str | None, idf: np.ndarray, params: Params) -> tuple[np.ndarray, np.ndarray] | None:
    counts = ngram_counts(text, params)
    if counts is None:
        return None
    at = np.flatnonzero(counts)
    values = (1 + np.log(counts[at])) * idf[at]
    return at, values / np.sqrt((values * values).sum())


def _document_frequencies(docs: DataFrame, params: Params) -> np.ndarray:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << params.bucket_bits, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts = ngram_counts(text, params)
                if counts is not None:
                    total += counts > 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["feature", "docs"])

    found = docs.select("__text").mapInArrow(count, "feature long, docs long").groupBy("feature").agg(F.sum("docs").alias("docs")).toArrow()
    out = np.zeros(1 << params.bucket_bits, dtype=np.int64)
    out[found["feature"].to_numpy()] = found["docs"].to_numpy()
    return out


def _ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], classes: int, params: Params) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal over the rows; returns weights (buckets x classes) and bias."""
    size = (1 << params.bucket_bits) + 1  # the last one is the bias, which no penalty holds
    z, n = np.zeros((size, classes)), np.zeros((size, classes))
    bias = np.array([size - 1])

    def weights(at: np.ndarray) -> np.ndarray:
        l1 = np.where(at == size - 1, 0.0, params.l1)[:, None]
        step = (params.beta + np.sqrt(n[at])) / params.alpha + params.l2
        return np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / step)

    order = np.random.default_rng(7)
    for _ in range(params.epochs):
        for i in order.permutation(len(rows)):
            at, x = np.concatenate([rows[i][0], bias]), np.append(rows[i][1], 1.0)
            w = weights(at)
            logits = x @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[i]] -= 1
            g = x[:, None] * p[None, :]
            n_new = n[at] + g * g
            z[at] += g - (np.sqrt(n_new) - np.sqrt(n[at])) / params.alpha * w
            n[at] = n_new
    every = weights(np.arange(size))
    return every[:-1], every[-1]


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        s = logits / np.exp(log_t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(labels)), labels]).mean())

    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(docs: DataFrame, train: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", params: Params = Params()) -> Model | None:
    """Learn from the rows of `docs` for which `train` holds and the language is known."""
    known = docs.where(train & F.col(lang).isNotNull()).select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"), F.col(lang).alias("__lang"))
    sizes = known.groupBy("__lang").count().orderBy(F.desc("count"), "__lang").limit(params.max_languages).collect()
    if not sizes:
        return None
    languages = sorted(r["__lang"] for r in sizes)
    frequency = _document_frequencies(known, params)
    total = sum(r["count"] for r in sizes)
    idf = np.log((1 + total) / (1 + frequency)) + 1

    rate = F.create_map(*[F.lit(x) for r in sizes for x in (r["__lang"], min(1.0, params.sample_per_language / r["count"]))])
    # Rows are drawn by id and text, and of equal rows one is kept, so a repeated id or row takes no more than its share.
    cell = lambda seed, parts: F.pmod(F.xxhash64("__id", "__text", F.lit(seed)), F.lit(parts))
    drawn = known.where(cell(1, 1 << 30) / float(1 << 30) < rate[F.col("__lang")]).distinct()
    sample = stored(
        drawn.select("__id", "__text", "__lang", cell(2, params.shards).alias("__shard"), (cell(3, 5) == 0).alias("__calibrate")),
        "language-sample",
    )
    index = {name: k for k, name in enumerate(languages)}

    def train_shard(group: pa.Table) -> pa.Table:
        group = group.sort_by([("__id", "ascending"), ("__text", "ascending")])
        rows, labels = [], []
        for words, name in zip(group["__text"].to_pylist(), group["__lang"].to_pylist()):
            row = _features(words, idf, params)
            if row is not None:
                rows.append(row)
                labels.append(index[name])
        w, b = _ftrl(rows, labels, len(languages), params)
        return pa.table({"rows": [len(rows)], "weights": [w.tobytes()], "bias": [b.tobytes()]})

    shards = sample.where(~F.col("__calibrate")).groupBy("__shard").applyInArrow(train_shard, "rows long, weights binary, bias binary").toArrow().to_pylist()
    shards = [s for s in shards if s["rows"]]
    if not shards:
        return None
    share = np.array([s["rows"] for s in shards], dtype=float)
    share /= share.sum()
    weights = sum(k * np.frombuffer(s["weights"]).reshape(-1, len(languages)) for k, s in sorted(zip(share, shards), key=lambda x: x[1]["weights"]))
    bias = sum(k * np.frombuffer(s["bias"]) for k, s in sorted(zip(share, shards), key=lambda x: x[1]["bias"]))
    model = Model(languages, idf, weights, bias, 1.0, params)

    def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(_logits(t, model), index[k]) for t, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            found = [(x.tolist(), k) for x, k in found if x is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.list_(pa.float64())), pa.array([k for _, k in found], pa.int32())], ["logits", "label"])

    held = sample.where("__calibrate").select("__text", "__lang").mapInArrow(logits, "logits array<double>, label int").toArrow()
    if held.num_rows:
        model = Model(languages, idf, weights, bias, _temperature(np.array(held["logits"].to_pylist()), held["label"].to_numpy()), params)
    return model


def _logits(text: str | None, model: Model) -> np.ndarray | None:
    row = _features(text, model.idf, model.params)
    return None if row is None else row[1] @ model.weights[row[0]] + model.bias


def identify(docs: DataFrame, model: Model | None, keep: list[str], text: str = "text") -> DataFrame:
    """`keep` columns of every row plus `lang_pred` and `score`."""
    narrow = docs.select(*[F.col(c) for c in keep], F.col(text).alias("__text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [], []
            for value in batch.column(batch.num_columns - 1).to_pylist():
                found = None if model is None else _logits(value, model)
                if found is None:
                    names.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                found = found / model.temperature
                p = np.exp(found - found.max())
                best = int(p.argmax())
                names.append(model.languages[best])
                scores.append(float(p[best] / p.sum()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                [*keep, "lang_pred", "score"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])
    return narrow.mapInArrow(score, f"{schema}, lang_pred string, score double")
