"""Text quality by positive-unlabelled learning.

Trusted positives are documents labelled 1; everything else is unlabelled web text, of which a
share `prior` is positive. A linear scorer minimises the non-negative unbiased risk
    prior * E_p[loss(f, +)] + max(0, E_u[loss(f, -)] - prior * E_p[loss(f, -)])
with the logistic loss. When the second term of a batch turns negative, its gradient is
reversed, which keeps the scorer from fitting the unlabelled part to less than nothing. The
prior is the share of label 1 among the labelled documents that may be learned from, unless
one is given.

Features come from the text alone: shape figures (letters, symbols, repeated words, ...) coded
by the quantiles they exceed, and hashed byte trigrams. The scorer is fitted on bounded samples
of both kinds, dealt to a fixed number of shards whose weights are averaged; the sample sizes
are parameters. Every whole text is scored where it lies.

Defined results: null and empty texts are scored like any text, as all figures being 0. Rows
with a null id are scored and not learned from. Repeated rows are scored row by row, and rows with
the same id and text are learned from once; of repeated labels of an id the largest counts. Without positives or unlabelled text every score
is the prior (0.5 if there are no labels). An empty table gives an empty result. Other columns
are never read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.llm.hashing import distinct, shingle_hashes, stream, word_hashes
from paddock.llm.tables import stored, text_bytes

_TRIGRAM = stream(51, 3) | np.uint64(1)
_PIECE = 1 << 20
SHAPES = 14


@dataclass(frozen=True)
class Params:
    positives: int = 4000  # expected sizes of the samples
    unlabelled: int = 12_000
    shards: int = 8
    trigram_bits: int = 11
    quantiles: int = 16
    steps: int = 400
    batch: int = 256
    rate: float = 0.02
    decay: float = 1e-4
    prior: float | None = None


@dataclass(frozen=True)
class Model:
    cuts: np.ndarray  # SHAPES x quantiles
    weights: np.ndarray
    bias: float
    params: Params


@functools.cache
def _kinds() -> np.ndarray:
    """0 other, 1 lower-case or caseless letter, 2 upper-case letter, 3 digit, 4 blank, 5 usual punctuation, 6 line end."""
    out = np.zeros(0x110000, dtype=np.uint8)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            out[c] = 2 if ch.isupper() else 1
        elif ch.isdigit():
            out[c] = 3
        elif ch == "\n":
            out[c] = 6
        elif ch.isspace():
            out[c] = 4
        elif ch in ".,;:!?'\"()-":
            out[c] = 5
    return out


def features(text: bytes | None, params: Params) -> tuple[np.ndarray, np.ndarray]:
    """(shape figures, hashed trigram shares) of one whole text."""
    shape, trigrams = np.zeros(SHAPES), np.zeros(1 << params.trigram_bits)
    if not text:
        return shape, trigrams
    kinds = np.zeros(7)
    for at in range(0, len(text), _PIECE):
        piece = text[at : at + _PIECE]
        codes = np.frombuffer(piece.decode("utf-8", "ignore").encode("utf-32-le"), dtype=np.uint32)
        kinds += np.bincount(_kinds()[codes], minlength=7)
        raw = np.frombuffer(text[at : at + _PIECE + 2], dtype=np.uint8).astype(np.uint64)
        if len(raw) > 2:
            mixed = (raw[:-2] * _TRIGRAM[0] + raw[1:-1] * _TRIGRAM[1] + raw[2:] * _TRIGRAM[2]) >> np.uint64(64 - params.trigram_bits)
            trigrams += np.bincount(mixed.astype(np.int64), minlength=len(trigrams))
    words = word_hashes(text)
    n, chars = max(1, len(words)), max(1.0, kinds.sum())
    ordered = np.sort(words)
    runs = np.diff(np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1], [True])))) if len(words) else np.zeros(1)
    fives = shingle_hashes(words, 5)
    letters = kinds[1] + kinds[2]
    shape[:] = (
        np.log1p(len(words)), letters / chars, kinds[2] / max(1.0, letters), kinds[3] / chars, kinds[0] / chars, kinds[5] / chars,
        kinds[6] / n, chars / n, len(runs) / n, runs.max() / n, (words[1:] == words[:-1]).sum() / n,
        1 - len(distinct(fives)) / max(1, len(fives)), len(runs) / n ** 0.85, (kinds[0] + kinds[5]) / n,
    )
    trigrams = np.sqrt(trigrams)
    return shape, trigrams / max(1e-9, np.sqrt((trigrams * trigrams).sum()))


def _design(texts: list[bytes | None], cuts: np.ndarray, params: Params) -> np.ndarray:
    out = np.empty((len(texts), cuts.size + (1 << params.trigram_bits)), dtype=np.float32)
    for k, text in enumerate(texts):
        shape, trigrams = features(text, params)
        out[k, : cuts.size] = (shape[:, None] > cuts).ravel()
        out[k, cuts.size :] = trigrams
    return out


def non_negative_fit(x: np.ndarray, positive: np.ndarray, prior: float, params: Params) -> tuple[np.ndarray, float]:
    """Adam on the non-negative risk; rows of x are positives or unlabelled."""
    size = x.shape[1] + 1
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    w[-1] = np.log(prior / (1 - prior))
    p, u = np.flatnonzero(positive), np.flatnonzero(~positive)
    draw = np.random.default_rng(3)
    for step in range(1, params.steps + 1):
        xp = x[draw.choice(p, min(params.batch, len(p)), replace=False)]
        xu = x[draw.choice(u, min(2 * params.batch, len(u)), replace=False)]
        sp, su = 1 / (1 + np.exp(-(xp @ w[:-1] + w[-1]))), 1 / (1 + np.exp(-(xu @ w[:-1] + w[-1])))
        # loss(f, +) = log(1 + e^-f), loss(f, -) = log(1 + e^f)
        as_negative = -np.log1p(-np.minimum(su, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-12)).mean()
        g_pos, g_u, g_p = (sp - 1) / len(sp), su / len(su), sp / len(sp)
        if as_negative >= 0:
            gp, gu = prior * g_pos - prior * g_p, g_u
        else:
            gp, gu = prior * g_p, -g_u
        grad = np.append(gp @ xp + gu @ xu, gp.sum() + gu.sum())
        grad[:-1] += params.decay * w[:-1]
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        w -= params.rate / (1 + step / 200) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, learnable: Column, text: str = "text", doc_id: str = "doc_id", quality: str = "quality", params: Params = Params()) -> tuple[Model | None, float]:
    """The scorer and the class prior. `learnable` is a condition on the column `doc_id` that
    says whose labels may be learned from."""
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(quality).cast("int").alias("label")).where(learnable & F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    known = stored(known.groupBy("doc_id").agg(F.max("label").alias("label")), "labels")
    ones, every = known.agg(F.sum((F.col("label") == 1).cast("long")), F.count("*")).first()
    prior = params.prior if params.prior is not None else ((ones or 0) + 1) / (every + 2)
    prior = min(max(prior, 0.01), 0.99)
    total = docs.where(F.col(doc_id).isNotNull()).count()
    if not ones or not total:
        return None, prior

    draw = lambda seed, *by: F.pmod(F.xxhash64(*by, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.where(F.col("label") == 1).where(draw(1, "doc_id") < min(1.0, params.positives / ones)).select("doc_id")
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("__text")).where(F.col("doc_id").isNotNull())
    # The sample of positive ids is bounded by its parameter, so it may be broadcast. An id may be on any number of
    # rows: these are drawn again, by id and text, and of equal rows one is kept.
    held = narrow.join(F.broadcast(chosen), "doc_id")
    rows = held.select("doc_id").count()
    positives = held.where(draw(4, "doc_id", "__text") < min(1.0, params.positives / max(1, rows))).withColumn("positive", F.lit(True))
    unlabelled = narrow.where(draw(2, "doc_id", "__text") < min(1.0, params.unlabelled / total)).withColumn("positive", F.lit(False))
    shard = F.pmod(F.xxhash64("doc_id", "__text", F.lit(3)), F.lit(params.shards))
    sample = stored(positives.unionByName(unlabelled).distinct().withColumn("shard", shard), "quality-sample")

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t, params)[0].tolist() for t in text_bytes(batch, "__text")]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64()))], ["shape"])

    seen = sample.where("NOT positive").select("__text").mapInArrow(shapes, "shape array<double>").toArrow()
    if not seen.num_rows:
        return None, prior
    cuts = np.quantile(np.array(seen["shape"].to_pylist()), np.linspace(0, 1, params.quantiles + 2)[1:-1], axis=0).T

    def train(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("positive", "ascending"), ("__text", "ascending")])
        positive = group["positive"].to_numpy()
        if positive.all() or not positive.any():
            return pa.table({"weights": pa.array([], pa.binary()), "bias": pa.array([], pa.float64())})
        x = _design(group["__text"].cast(pa.large_binary()).to_pylist(), cuts, params)
        w, b = non_negative_fit(x, positive, prior, params)
        return pa.table({"weights": [w.tobytes()], "bias": [b]})

    fitted = sorted(sample.groupBy("shard").applyInArrow(train, "weights binary, bias double").toArrow().to_pylist(), key=lambda r: (r["bias"], r["weights"]))
    if not fitted:
        return None, prior
    return Model(cuts, np.mean([np.frombuffer(r["weights"]) for r in fitted], axis=0), float(np.mean([r["bias"] for r in fitted])), params), prior


def score(docs: DataFrame, model: Model | None, prior: float, keep: list[str], threshold: float = 0.3, text: str = "text") -> DataFrame:
    """`keep` columns of every row, with `score` (0 to 1) and `predicted`."""
    narrow = docs.select(*[F.col(c) for c in keep], F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for value in text_bytes(batch, "__text"):
                if model is None:
                    scores.append(prior)
                    continue
                shape, trigrams = features(value, model.params)
                n = model.cuts.size
                f = (shape[:, None] > model.cuts).ravel() @ model.weights[:n] + trigrams @ model.weights[n:] + model.bias
                scores.append(float(1 / (1 + np.exp(-np.clip(f, -500, 500)))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], [*keep, "score", "predicted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])
    return narrow.mapInArrow(run, f"{schema}, score double, predicted int")
