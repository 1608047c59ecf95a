"""Pipeline stages judge each row by itself: null ids, and ids that rows share."""

from collections import Counter

import corpus_pipeline
from llm_cases import SMALL, documents, real_texts, rows_of

from paddock.llm import decontamination, mixing, ngram_join


def _words(name, count):
    return " ".join(f"{name}{i}" for i in range(count))


def _rows(texts):
    return [(i, t, "en", "src1", 0) for i, t in texts]


def test_near_duplicates_without_id(spark):
    same, near = _words("a", 60), _words("a", 59) + " other"
    texts = [(None, same), (None, same), (None, near), (7, same), (None, _words("b", 30)), (None, _words("b", 30)), (8, _words("c", 30)), (8, _words("d", 30)), (3, _words("d", 30)), (None, None), (9, None), (9, " ")]
    docs = documents(spark, _rows(texts))
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SMALL)
    assert kept.columns == docs.columns
    want = [(7, same), (None, _words("b", 30)), (8, _words("c", 30)), (3, _words("d", 30)), (None, None), (9, None), (9, " ")]
    assert rows_of(kept.select("doc_id", "text")) == sorted(want, key=repr)
    assert ngram_join.one_row_of_each(docs.limit(0)).count() == 0


def test_leaks_without_id_and_of_shared_id(spark):
    item = _words("q", 20)
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    leak, clean = _words("x", 30) + " " + item, _words("y", 50)
    docs = documents(spark, _rows([(None, leak), (None, clean), (5, leak), (5, clean), (6, leak), (None, None)]))
    kept = decontamination.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns
    assert rows_of(kept.select("doc_id", "text")) == sorted([(None, clean), (5, clean), (None, None)], key=repr)


def test_mix_plays_rows_of_one_id_by_themselves(spark):
    """The mix of a table does not change its length when all rows lose or share their id."""
    texts = [t for _, t, *_ in real_texts(spark, 200)]
    draws = {}
    for name, of in (("own", lambda k: k), ("null", lambda k: None), ("shared", lambda k: 4)):
        docs = documents(spark, [(of(k), f"{t} n{k}", "en", f"src{k % 3}", 0) for k, t in enumerate(texts)])
        times = Counter(r["text"] for r in mixing.mixed_documents(docs).select("text").collect())
        taken = {r["taken"] > 0 for r in mixing.mix(docs).collect()}
        assert taken == {True, False} or taken == {True}
        draws[name] = times
    assert all(max(t.values()) <= 3 for t in draws.values())
    words = {n: sum(c * len(t.split()) for t, c in times.items()) for n, times in draws.items()}
    assert max(words.values()) <= 1.2 * min(words.values()), words
    assert len(set(draws["null"].values())) > 1 and len(set(draws["shared"].values())) > 1
