"""N-gram join, decontamination and components against brute force."""

from __future__ import annotations

import os
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_cases import documents, messy_rows, rows_of, tokens

from paddock.llm import decontamination, hashing, ngram_join
from paddock.llm.components import components
from paddock.llm.tables import noted


def shingle_sets(rows, width):
    out = []
    for r in rows:
        w = tokens(r[1])
        out.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    return out


def brute_components(rows, width, percent):
    sets = shingle_sets(rows, width)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None or not sets[i] or not sets[j]:
                continue
            shared = len(sets[i] & sets[j])
            if 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return sorted(((r[0], len(s), None if r[0] is None else least[find(i)]) for i, (r, s) in enumerate(zip(rows, sets))), key=repr)


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_join_is_brute_force(spark, width, percent):
    rows = messy_rows(spark)
    got = rows_of(ngram_join.join(documents(spark, rows), params=ngram_join.Params(width=width, percent=percent)))
    assert got == brute_components(rows, width, percent)


def test_join_small_sets_and_long_lists(spark):
    """Many tiny sets (subsets are enumerated) and a long list of near copies (few pivots)."""
    draw = np.random.default_rng(1)
    rows = [(k, " ".join(f"t{x}" for x in draw.integers(0, 9, draw.integers(5, 22))), None, None, None) for k in range(250)]
    base = [f"c{i}" for i in range(60)]
    for k in range(150):
        w = list(base)
        for at in draw.integers(0, 60, draw.integers(0, 4)):
            w[at] = f"e{draw.integers(0, 30)}"
        rows.append((500 + k, " ".join(w), None, None, None))
    params = ngram_join.Params(short_list=10, pivots=2, percent=60)
    assert rows_of(ngram_join.join(documents(spark, rows, extra=False), params=params)) == brute_components(rows, 4, 60)


def test_join_empty_and_first_of_each(spark):
    rows = messy_rows(spark)
    docs = documents(spark, rows)
    assert rows_of(ngram_join.join(docs.limit(0))) == []
    kept = ngram_join.first_of_each(docs)
    assert kept.columns == docs.columns
    classes = brute_components(rows, 4, 85)
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted({c for i, _, c in classes if i is not None})
    assert kept.where("doc_id IS NULL").count() == 2


def test_entries_travel_once(spark):
    """Entries of lists are dealt by key in one shuffle, whatever their number; single ones go."""
    rows = [(n, n % 7, k) for n in range(50) for k in {n % 5, 100 + n}]
    entries = spark.createDataFrame(rows, "node long, n long, key long")
    got = ngram_join.shared(entries)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, got.select("node", "n", "key", "members").collect())) == sorted((n, m, k, 10) for n, m, k in rows if k < 100)


def test_sets_travel_once_and_signatures_go(spark):
    """Whole sets are read and dealt once for both sides of the pairs and not written; rows with
    all their shingles are deleted once each set has one."""
    rows = messy_rows(spark)
    folders = []
    with noted(folders):
        got = rows_of(ngram_join.join(documents(spark, rows)))
    assert got == brute_components(rows, 4, 85)
    assert len([f for f in folders if "/nodes-" in f]) == 1 and not [f for f in folders if "/sets-" in f]
    assert [os.path.exists(f.removeprefix("file:")) for f in folders if "/signatures-" in f] == [False]
    columns = ", ".join(f"{c} long" for c in ("a", "b", "n_a", "n_b", "comp_a", "comp_b"))
    pairs = spark.createDataFrame([(1, 2, 4, 4, 1, 2), (1, 3, 4, 4, 1, 3), (2, 3, 4, 4, 2, 3)], columns)
    sets = spark.createDataFrame([(1, [1, 2, 3, 4]), (2, [1, 2, 3, 4]), (3, [1, 2, 3, 9])], "node long, shingles array<long>").dropDuplicates(["node"])
    for broadcast in ("-1", "10m"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
        try:
            linked = ngram_join._linked(pairs, sets, ngram_join.Params())
            assert [tuple(r) for r in linked.collect()] == [(1, 2)]
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_subsets_and_sketches():
    draw = np.random.default_rng(2)
    universe = hashing.stream(7, 40)
    for _ in range(300):
        a = np.sort(draw.choice(universe, draw.integers(1, 19), replace=False))
        b = np.sort(draw.choice(a if draw.random() < 0.7 else universe, min(len(a), draw.integers(1, 19)), replace=False))
        b = np.unique(np.concatenate([b, draw.choice(universe, draw.integers(0, 2))]))
        shared = len(np.intersect1d(a, b))
        if len(b) <= 19 and 100 * shared >= 85 * (len(a) + len(b) - shared):
            assert set(ngram_join.subset_keys(a, 85).tolist()) & set(ngram_join.subset_keys(b, 85).tolist())
        differ = np.bitwise_count(ngram_join.parity_sketch(a).view(np.uint64) ^ ngram_join.parity_sketch(b).view(np.uint64)).sum()
        assert differ <= len(a) + len(b) - 2 * shared


def test_components(spark):
    draw = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in draw.integers(0, 200, (150, 2))] + [(k, k + 1) for k in range(300, 340)]
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    root = {}
    for s in sorted(near):
        todo = [s] if s not in root else []
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = s
                todo += near[x]
    expected = {k: v for k, v in root.items() if near[k] - {k}}
    assert dict((r[0], r[1]) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()) == expected
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_word_hashes():
    text = "The  cat\x0bsat on THE mat\x1c x".encode()
    words = text.lower().split()
    hashes = hashing.word_hashes(text)
    assert len(words) == len(hashes) and (hashes[0] == hashes[words.index(b"the", 1)])
    assert len(hashing.word_hashes(None)) == len(hashing.word_hashes(b" \n")) == 0
    long = b"ab cd " * 300_000 + b"y" * (hashing.WINDOW + 5) + b" z"
    assert len(hashing.word_hashes(long)) == 600_002
    assert len(set(hashing.word_hashes(b"a" * 5000 + b" " + b"a" * 4096 + b"b" + b"a" * 903).tolist())) == 2


def brute_leaks(rows, items, width=5, least=0.8):
    def bag(w):
        return Counter(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1)))

    out = set()
    for r in rows:
        w, best = tokens(r[1]), {}
        for item_id, text in items:
            i = tokens(text)
            if not i or not w:
                continue
            n, b = min(len(i), len(w)), bag(i)
            for at in range(len(w) - n + 1):
                part = w[at : at + n]
                if not any(x in b for x in bag(part)):
                    continue
                c = bag(part)
                shared = sum((c & b).values())
                alike = shared / (sum(c.values()) + sum(b.values()) - shared)
                if alike >= least and alike > best.get(item_id, (0,))[0]:
                    best[item_id] = (alike, at, n)
        out |= {(r[0], k, *v) for k, v in best.items()}
    return sorted(out, key=repr)


def test_decontamination_is_brute_force(spark):
    rows = messy_rows(spark, 30)
    items = [(k, " ".join(rows[k][1].split()[3 : 3 + 9 + 4 * k])) for k in range(8)]
    items += [(90, None), (91, ""), (92, "only three words"), (93, rows[12][1].upper()), (94, " ".join(rows[9][1].split()[5:45] + ["other", "end"]))]
    first = rows[3][1].split()
    rows.append((2000, " ".join(["before"] + items[5][1].split()[:1] + ["changed"] + items[5][1].split()[2:] + first[:5]), "en", "src1", 0))
    rows = [r for r in rows if r[0] != 1009]  # brute force takes too long on it
    benchmark = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id", "2 AS similarity")
    docs = documents(spark, rows)
    got = decontamination.contaminated(docs, benchmark)
    want = brute_leaks(rows, items)
    assert sorted({tuple(r) for r in got.collect()}, key=repr) == want and {w[0] for w in want} >= {2000}
    blocks = decontamination.contaminated(docs, benchmark, params=decontamination.Params(block_items=4))
    assert sorted({tuple(r) for r in blocks.collect()}, key=repr) == want
    clean = decontamination.decontaminate(docs, benchmark)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == {r[0] for r in rows} - {w[0] for w in want if w[0] is not None}
    assert decontamination.contaminated(docs.limit(0), benchmark).count() == decontamination.contaminated(docs, benchmark.limit(0)).count() == 0


def test_multi_index_finds_all_within_radius():
    draw = np.random.default_rng(4)
    group = decontamination._Group(9, list(range(50)), [hashing.stream(k, 5) for k in range(50)], 40)
    prints = group.prints[draw.integers(0, 50, 400)].copy()
    for row in prints:
        for bit in draw.integers(0, 128, draw.integers(0, 60)):
            row[bit // 8] ^= 1 << (bit % 8)
    got = set(zip(*[x.tolist() for x in group.candidates(prints, 40)]))
    distance = np.bitwise_count(prints[:, None, :] ^ group.prints[None]).sum(axis=2)
    assert got == set(zip(*[x.tolist() for x in np.nonzero(distance <= 40)]))
