"""Language identification, LM scoring, quality, toxicity: brute force or held-out accuracy."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from llm_cases import documents, fold, messy_rows, tokens
from pyspark.sql import functions as F

from paddock.llm import language_id, lm_scoring, quality_pu, toxicity
from paddock.llm.tables import fold as fold_column

MIDDLE = "/root/testdata/sf0.01"


def auc(scores, labels):
    rank = np.argsort(np.argsort(scores, kind="stable"))
    labels = np.asarray(labels)
    ones = int(labels.sum())
    return (rank[labels == 1].sum() - ones * (ones - 1) / 2) / (ones * (len(labels) - ones))


def brute_scores(rows, order, prior=2.0):
    learned, counts = [], Counter()
    for r in rows:
        w = [None] + tokens(r[1]) + [None]
        if r[0] is not None and fold(r[0], 7) != 2:
            for n in range(1, order + 1):
                for at in range(1, len(w)):
                    if at - n + 1 >= 0:
                        counts[tuple(w[at - n + 1 : at + 1])] += 1
    one = {k[0]: c for k, c in counts.items() if len(k) == 1}
    total, kinds = sum(one.values()), len(one)
    for r in rows:
        w, base, score, known = [None] + tokens(r[1]) + [None], 0.0, 0.0, 0
        for at in range(1, len(w)):
            p = (one.get(w[at], 0) + 1) / (total + kinds + 1)
            base += math.log10(p)
            known += one.get(w[at], 0) > 0
            for n in range(2, order + 1):
                if at - n + 1 < 0:
                    break
                history = tuple(w[at - n + 1 : at])
                seen = one.get(history[0], 0) if n == 2 else counts[history]
                if seen:
                    p = (counts[(*history, w[at])] + prior * p) / (seen + prior)
            score += math.log10(p)
        learned.append((r[0], fold(r[0], 7) == 2, len(w) - 1, known, total, base, score))
    return learned


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_are_brute_force(spark, order):
    rows = messy_rows(spark)
    docs = documents(spark, rows)
    params = lm_scoring.Params(order=order, block_bytes=40_000)
    got = sorted((tuple(r) for r in lm_scoring.score(docs, fold_column("doc_id", 7) == 2, params=params).collect()), key=lambda r: (str(r[0]), r[2]))
    want = sorted(brute_scores(rows, order), key=lambda r: (str(r[0]), r[2]))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    np.testing.assert_allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)


def test_scores_of_nothing(spark):
    docs = documents(spark, messy_rows(spark, 8))
    assert lm_scoring.score(docs.limit(0), F.lit(False)).count() == 0
    unlearned = lm_scoring.score(docs, F.lit(True)).collect()
    assert {(r["train_tokens"], r["n_known"], r["score"], r["base_score"]) for r in unlearned} == {(0, 0, 0.0, 0.0)}


def test_probabilities_sum_to_one():
    """Over all known words, the end and one unknown word, after a seen and an unseen history."""
    texts = [b"a b a b c", b"a a b", b"c b a"]
    keys, counts = lm_scoring._block_ngrams(texts, np.ones(3), 2)
    total = sum(len(t.split()) + 1 for t in texts)
    one = lambda *tokens: lm_scoring.traverse([b" ".join(tokens)], keys, counts, total, 4, lm_scoring.Params())[3][0]
    end_after = {w: one(w) for w in (b"a", b"b", b"c", b"new")}  # log P(w | start) + log P(end | w)
    chances = []
    for h in (b"a", b"b", b"c", b"new"):
        after = sum(10 ** (one(h, w) - _tail(one, w)) for w in (b"a", b"b", b"c", b"new"))
        chances.append((after + 10 ** end_after[h]) / _first(keys, counts, total, h))
    assert chances == pytest.approx([1.0] * 4)


def _count(keys, counts, key) -> int:
    at = int(np.searchsorted(keys, key))
    return int(counts[at]) if at < len(keys) and keys[at] == key else 0


def _first(keys, counts, total, word) -> float:
    """P(word | start) by the formula."""
    grams = lm_scoring._ngrams(lm_scoring._tokens(word), 2)
    return (_count(keys, counts, grams[1][0]) + 2 * (_count(keys, counts, grams[0][0]) + 1) / (total + 5)) / (3 + 2)


def _tail(one, word) -> float:
    """log10 P(end | word): of the text `word`, less the word itself."""
    texts = [b"a b a b c", b"a a b", b"c b a"]
    keys, counts = lm_scoring._block_ngrams(texts, np.ones(3), 2)
    return one(word) - math.log10(_first(keys, counts, 15 - 1, word))


def test_language(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    model = language_id.fit(docs, fold_column("doc_id", 3) != 1, params=language_id.Params(sample_per_language=100))
    got = {r["doc_id"]: (r["lang_pred"], r["score"], r["lang"]) for r in language_id.identify(docs, model, ["doc_id", "lang"]).collect()}
    held = [v for k, v in got.items() if fold(k, 3) == 1]
    assert len(got) == 1000 and np.mean([p == t for p, _, t in held]) > 0.98
    assert all(0 <= s <= 1 for _, s, _ in held)
    # calibrated: mean confidence close to accuracy
    assert abs(np.mean([s for _, s, _ in held]) - np.mean([p == t for p, _, t in held])) < 0.03

    messy = documents(spark, messy_rows(spark))
    found = language_id.identify(messy, model, ["doc_id", "text"]).collect()
    assert len(found) == messy.count()
    for r in found:
        letters = r["text"] is not None and any(c.isalpha() for c in r["text"])
        assert (r["lang_pred"] == "und") == (not letters)
    assert language_id.identify(messy.limit(0), model, ["doc_id"]).count() == 0
    assert language_id.fit(messy.limit(0), F.lit(True)) is None
    assert {r["lang_pred"] for r in language_id.identify(messy, None, ["doc_id"]).collect()} == {"und"}
    assert language_id.fit(messy, fold_column("doc_id", 3) != 1) is not None


def test_ngram_counts_by_window(monkeypatch):
    text = "Ein Haus, ein  Baum; und 17 Vögel! " * 40
    whole = language_id.ngram_counts(text, language_id.Params())
    monkeypatch.setattr(language_id, "_WINDOW", 64)
    parts = language_id.ngram_counts(text, language_id.Params())
    assert abs(int(whole.sum()) - int(parts.sum())) <= 3 * len(text) // 64 and np.abs(whole - parts).sum() <= 9 * len(text) // 64


def test_quality(spark):
    docs, labels = spark.read.parquet(f"{MIDDLE}/documents.parquet"), spark.read.parquet(f"{MIDDLE}/labels.parquet")
    model, prior = quality_pu.fit(docs, labels, fold_column("doc_id", 5) != 0)
    marks = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [(r["score"], marks[r["doc_id"]]) for r in quality_pu.score(docs, model, prior, ["doc_id"]).collect() if r["doc_id"] in marks and fold(r["doc_id"], 5) == 0]
    assert auc([s for s, _ in held], [m for _, m in held]) > 0.97
    messy = documents(spark, messy_rows(spark))
    found = quality_pu.score(messy, model, prior, ["doc_id"]).collect()
    assert len(found) == messy.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found)
    assert quality_pu.score(messy.limit(0), model, prior, ["doc_id"]).count() == 0
    assert quality_pu.fit(messy, labels.limit(0), F.lit(True)) == (None, 0.5)
    assert {r["score"] for r in quality_pu.score(messy, None, 0.5, ["doc_id"]).collect()} == {0.5}
    again = labels.selectExpr("doc_id", "CAST(NULL AS int) AS quality").unionByName(labels.limit(9).selectExpr("CAST(NULL AS long) AS doc_id", "quality"))
    assert quality_pu.fit(messy, again, F.lit(True))[0] is None


def test_non_negative_risk_separates():
    draw = np.random.default_rng(5)
    x = np.concatenate([draw.normal(1.5, 1, (600, 4)), draw.normal(-1.5, 1, (300, 4))]).astype(np.float32)
    trusted = np.zeros(900, dtype=bool)
    trusted[:200] = True
    w, b = quality_pu.non_negative_fit(x, trusted, 400 / 700, quality_pu.Params(trigram_bits=2))
    assert auc(x @ w + b, np.arange(900) < 600) > 0.98


def test_toxicity(spark):
    docs, labels = spark.read.parquet(f"{MIDDLE}/documents.parquet"), spark.read.parquet(f"{MIDDLE}/labels.parquet")
    model = toxicity.learn(docs, labels, fold_column("doc_id", 5) != 0)
    assert (np.diff(model.thresholds) > 0).all()
    got = toxicity.score(docs, model, ["doc_id"]).collect()
    marks = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [(r["score"], marks[r["doc_id"]], r["predicted"]) for r in got if r["doc_id"] in marks and fold(r["doc_id"], 5) == 0]
    assert auc([h[0] for h in held], [h[1] for h in held]) > 0.75
    assert not [h for h in held if h[2] and not h[1]]
    for r in got:
        assert 0 <= r["score"] <= 1 and r["score"] - 1e-12 <= r["expected_severity"] <= 3 * r["score"] + 1e-12
    messy = documents(spark, messy_rows(spark))
    assert toxicity.score(messy, model, ["doc_id"]).count() == messy.count()
    assert toxicity.score(messy.limit(0), model, ["doc_id"]).count() == 0
    assert toxicity.learn(messy, labels.limit(0), F.lit(True)) is None
    assert {r["expected_severity"] for r in toxicity.score(messy, None, ["doc_id"]).collect()} == {0.0}


def test_ordinal_grades_are_learned():
    draw = np.random.default_rng(6)
    grade = draw.integers(0, 4, 800)
    rows = [(np.arange(3), np.array([g + draw.normal(0, 0.3), draw.normal(), 1.0])) for g in grade]
    w, t = toxicity._train(rows, 3, grade, np.ones(800), toxicity.Params(epochs=10))
    f = np.array([x @ w for _, x in rows])
    assert abs(np.mean(np.searchsorted(t, f) == grade)) > 0.7 and (np.diff(t) > 0).all()
