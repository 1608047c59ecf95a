"""Toxicity as graded severity: cumulative-link ordinal regression on sparse text features.

P(grade <= k) = sigmoid(t_k - w.x) with one weight vector for all ordered thresholds
t_1 < t_2 < ... Features are the words of a text (A-Z lower-cased, outer punctuation removed)
that tell: those whose log-odds of standing in toxic rather than other labelled documents,
counted over all of them, exceed `least_z` standard errors. Each counts log(1 + occurrences).
Weights are learned with FTRL-proximal steps (L1 and L2); thresholds follow by adaptive
gradient steps in a form that keeps them in order. The output is the expected severity, sum
over k of P(grade > k), and the chance of any severity.

Labels that only say toxic or not are turned to grades: a toxic document's grade is the third
of the toxic documents that its number of telling words falls in.

Training uses a bounded sample per grade (a parameter), weighed back to the true shares, dealt
to a fixed number of shards whose parameters are averaged. At most `telling_words` words are
kept, the surest first; that is the size of the model. Every whole text is scored where it lies.

Defined results: null and blank texts have no features and get the severity of the thresholds
alone. Rows with a null id are scored and not learned from. Repeated rows are scored row by
row, and rows with the same id, grade and features train once; of repeated labels of an id the largest counts. Without both kinds of labels every
severity is 0. An empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.llm.hashing import distinct, word_hashes
from paddock.llm.tables import join_small, stored, text_bytes

# ASCII punctuation becomes blank; bytes beyond ASCII are parts of words.
_BLANK = bytes(32 if chr(b) in "!\"#$%&()*+,./:;<=>?@[\\]^_`{|}~" else b for b in range(256))
_FLUSH = 1 << 20


@dataclass(frozen=True)
class Params:
    telling_words: int = 1 << 16
    least_z: float = 2.8
    per_grade: int = 4000  # expected sample of each grade
    shards: int = 4
    epochs: int = 25
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 0.01
    grades: int = 4


@dataclass(frozen=True)
class Model:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    thresholds: np.ndarray


def _words(text: bytes | None) -> np.ndarray:
    return word_hashes(text.translate(_BLANK)) if text else np.zeros(0, np.uint64)


def features(text: bytes | None, telling: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions among the telling words, values) of one whole text."""
    words = _words(text)
    if not len(words) or not len(telling):
        return np.zeros(0, np.int64), np.zeros(0)
    at = np.minimum(np.searchsorted(telling, words), len(telling) - 1)
    at, counts = np.unique(at[telling[at] == words], return_counts=True)
    return at, np.log1p(counts)


def telling_words(labelled: DataFrame, params: Params = Params()) -> np.ndarray:
    """Sorted hashes of the words that tell toxic documents in (__text, toxic)."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[np.ndarray] = []
        flags: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            keys, where = np.unique(np.concatenate(pending), return_inverse=True)
            toxic = np.bincount(where, weights=np.concatenate(flags), minlength=len(keys)).astype(np.int64)
            docs = np.bincount(where, minlength=len(keys))
            return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(docs, pa.int64()), pa.array(toxic, pa.int64())], ["word", "docs", "toxic"])

        for batch in batches:
            for text, toxic in zip(text_bytes(batch, "__text"), batch.column(1).to_pylist()):
                found = distinct(_words(text))
                pending.append(found)
                flags.append(np.full(len(found), toxic))
                size += len(found)
                if size >= _FLUSH:
                    yield flush()
                    pending, flags, size = [], [], 0
        if size:
            yield flush()

    n, n_toxic = labelled.agg(F.count("*"), F.sum("toxic")).first()
    if not n_toxic or n_toxic == n:
        return np.zeros(0, np.uint64)
    counted = labelled.select("__text", "toxic").mapInArrow(words, "word long, docs long, toxic long").groupBy("word").agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic"))
    a, b = F.col("toxic") + 0.5, F.col("docs") - F.col("toxic") + 0.5
    z = F.log((a / n_toxic) / (b / (n - n_toxic))) / F.sqrt(1 / a + 1 / b)
    found = counted.where("toxic > 1").withColumn("z", z).where(F.col("z") >= params.least_z)
    kept = found.orderBy(F.desc("z"), "word").limit(params.telling_words).select("word").toArrow()
    return np.sort(kept["word"].to_numpy().astype(np.uint64))


def graded_features(labelled: DataFrame, telling: np.ndarray, params: Params = Params()) -> DataFrame:
    """(doc_id, grade, at, x) from (doc_id, __text, toxic)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t, telling) for t in text_bytes(batch, "__text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([float(np.expm1(x).sum()) for _, x in found], pa.float64()),
                 pa.array([at for at, _ in found], pa.list_(pa.int64())), pa.array([x for _, x in found], pa.list_(pa.float64()))],
                ["doc_id", "toxic", "markers", "at", "x"],
            )

    kind = dict(labelled.dtypes)["doc_id"]
    found = stored(labelled.select("doc_id", "__text", "toxic").mapInArrow(count, f"doc_id {kind}, toxic int, markers double, at array<long>, x array<double>"), "markers")
    steps = [k / (params.grades - 1) for k in range(1, params.grades - 1)]
    cuts = found.where("toxic = 1").agg(F.percentile("markers", F.array(*[F.lit(s) for s in steps]))).first()[0] or []
    grade = F.lit(1)
    for cut in cuts:
        grade = grade + (F.col("markers") > cut).cast("int")
    return found.select("doc_id", F.when(F.col("toxic") == 1, grade).otherwise(F.lit(0)).alias("grade"), "at", "x")


def _sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _train(rows: list[tuple[np.ndarray, np.ndarray]], size: int, grade: np.ndarray, weight: np.ndarray, params: Params) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the cumulative-link model."""
    z, n = np.zeros(size), np.zeros(size)
    k = params.grades
    # thresholds: the first, then logarithms of the gaps
    shares = np.cumsum(np.bincount(grade, weights=weight, minlength=k) + 1e-3)[:-1]
    start = np.maximum.accumulate(np.log(shares / (weight.sum() + 1e-3 * k - shares)) + 1e-3 * np.arange(k - 1))
    theta = np.concatenate((start[:1], np.log(np.maximum(1e-3, np.diff(start)))))
    spread = np.ones(k - 1)

    def weights(at: np.ndarray) -> np.ndarray:
        step = (params.beta + np.sqrt(n[at])) / params.alpha + params.l2
        return np.where(np.abs(z[at]) <= params.l1, 0.0, -(z[at] - np.sign(z[at]) * params.l1) / step)

    draw = np.random.default_rng(9)
    for _ in range(params.epochs):
        for i in draw.permutation(len(rows)):
            at, x = rows[i]
            w = weights(at)
            t = np.concatenate(([theta[0]], theta[0] + np.cumsum(np.exp(theta[1:]))))
            f, y = float(x @ w), grade[i]
            upper = _sigmoid(t[y] - f) if y < k - 1 else 1.0
            lower = _sigmoid(t[y - 1] - f) if y > 0 else 0.0
            g = weight[i] * (1 - upper - lower) * x
            fresh = n[at] + g * g
            z[at] += g - (np.sqrt(fresh) - np.sqrt(n[at])) / params.alpha * w
            n[at] = fresh
            by_t = np.zeros(k - 1)
            chance = max(1e-9, upper - lower)
            if y < k - 1:
                by_t[y] -= upper * (1 - upper) / chance
            if y > 0:
                by_t[y - 1] += lower * (1 - lower) / chance
            by = weight[i] * np.concatenate(([by_t.sum()], np.exp(theta[1:]) * np.cumsum(by_t[::-1])[::-1][1:]))
            spread += by * by
            theta -= 0.3 * by / np.sqrt(spread)
    return weights(np.arange(size)), np.concatenate(([theta[0]], theta[0] + np.cumsum(np.exp(theta[1:]))))


def training_sample(graded: DataFrame, rates: dict[int, float], params: Params) -> DataFrame:
    """(doc_id, grade, at, x, shard, key): rows drawn by id and features at the rate of their grade. Of equal
    rows one is kept, so a repeated id or row takes no more than its share."""
    rate = F.create_map(*[F.lit(v) for g, r in rates.items() for v in (g, r)])
    cell = lambda seed, parts: F.pmod(F.xxhash64("doc_id", "at", "x", F.lit(seed)), F.lit(parts))
    drawn = graded.where(cell(1, 1 << 30) / float(1 << 30) < rate[F.col("grade")]).select("doc_id", "grade", "at", "x").distinct()
    return drawn.select("*", cell(2, params.shards).alias("shard"), F.xxhash64("at", "x").alias("key"))


def fit(graded: DataFrame, telling: np.ndarray, params: Params = Params()) -> Model | None:
    """Learn from (doc_id, grade, at, x)."""
    sizes = {r["grade"]: r["count"] for r in graded.groupBy("grade").count().collect()}
    if len(sizes) < 2:
        return None
    rates = {g: min(1.0, params.per_grade / n) for g, n in sizes.items()}
    sample = training_sample(graded, rates, params)

    def train(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("grade", "ascending"), ("key", "ascending")])
        grade = group["grade"].to_numpy().astype(np.int64)
        weight = np.array([1 / rates[g] for g in grade.tolist()])
        rows = [(np.array(at, dtype=np.int64), np.array(x)) for at, x in zip(group["at"].to_pylist(), group["x"].to_pylist())]
        w, t = _train(rows, len(telling), grade, weight / weight.mean(), params)
        return pa.table({"weights": [w.tobytes()], "thresholds": [t.tobytes()], "rows": pa.array([len(rows)], pa.int64())})

    shards = sorted(sample.groupBy("shard").applyInArrow(train, "weights binary, thresholds binary, rows long").toArrow().to_pylist(), key=lambda s: s["weights"])
    if not shards:
        return None
    share = np.array([s["rows"] for s in shards], dtype=float)
    share /= share.sum()
    mean = lambda name: sum(k * np.frombuffer(s[name]) for k, s in zip(share, shards))
    return Model(telling, mean("weights"), mean("thresholds"))


def learn(docs: DataFrame, labels: DataFrame, learnable: Column, text: str = "text", doc_id: str = "doc_id", toxic: str = "toxic", params: Params = Params()) -> Model | None:
    """Learn from toxic / not toxic labels; `learnable` is a condition on the column `doc_id`."""
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(toxic).cast("int").alias("toxic")).where(learnable & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("__text"))
    labelled = stored(join_small(texts, stored(known, "labels"), "doc_id", "inner"), "labelled")
    telling = telling_words(labelled, params)
    return fit(graded_features(labelled, telling, params), telling, params)


def score(docs: DataFrame, model: Model | None, keep: list[str], text: str = "text", threshold: float = 0.15) -> DataFrame:
    """`keep` columns of every row, with `expected_severity`, `score` (the chance of any
    severity), `severity` (the most likely grade) and `predicted` (1 if toxic)."""
    narrow = docs.select(*[F.col(c) for c in keep], F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            expected, chance, grade = [], [], []
            for value in text_bytes(batch, "__text"):
                if model is None:
                    above = np.zeros(1)
                else:
                    at, x = features(value, model.words)
                    above = 1 - _sigmoid(model.thresholds - float(x @ model.weights[at]))
                expected.append(float(above.sum()))
                chance.append(float(above[0]))
                grade.append(int(np.argmax(-np.diff(np.concatenate(([1.0], above, [0.0]))))))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(expected, pa.float64()), pa.array(chance, pa.float64()), pa.array(grade, pa.int32()), pa.array([int(c >= threshold) for c in chance], pa.int32())],
                [*keep, "expected_severity", "score", "severity", "predicted"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])
    return narrow.mapInArrow(run, f"{schema}, expected_severity double, score double, severity int, predicted int")
