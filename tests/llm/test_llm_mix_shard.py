"""Mixing and sharding: exact parts against plain forms, laws on the rest."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import pytest
from llm_cases import documents, messy_rows, rows_of, tokens

from paddock.llm import mixing, sharding


def brute_targets(sizes: dict, weights=(5, 2, 1), repeats=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        if not free:
            return fixed
        left, heavy = total - sum(fixed.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / heavy > repeats * sizes[s]]
        if not over:
            return fixed | {s: left * weight[s] / heavy for s in free}
        fixed |= {s: repeats * sizes[s] for s in over}


def test_mix(spark):
    rows = messy_rows(spark)
    docs = documents(spark, rows)
    got = [r.asDict() for r in mixing.mix(docs).collect()]
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], len(tokens(r[1]))) for r in rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(tokens(r[1]))
    goal = brute_targets(sizes)
    by_goal = {(sizes[s], round(t, 6)) for s, t in goal.items()}
    assert {(r["source_size"], round(r["target"], 6)) for r in got} == by_goal
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source_size"], round(r["target"], 6)] += r["taken"]
    for (size, target), words in taken.items():
        assert abs(words - target) <= max(0.02 * target, 4)
    assert rows_of(mixing.mix(docs)) == sorted((tuple(r.values()) for r in got), key=repr)


def test_mix_empty_and_wordless(spark):
    docs = documents(spark, messy_rows(spark, 10))
    assert mixing.mix(docs.limit(0)).count() == 0
    assert {r["taken"] for r in mixing.mix(docs.where("doc_id IN (1000, 1001, 1002)")).collect()} == {0}
    assert mixing.mixed_documents(docs.limit(0)).count() == 0


def test_mixed_documents(spark):
    rows = messy_rows(spark)
    docs = documents(spark, rows)
    kept = mixing.mixed_documents(docs)
    assert kept.columns == docs.columns
    times = Counter(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect())
    assert times and max(times.values()) <= 2 * 3 and not {1000, 1001, 1002} & set(times)  # a repeated row doubles its id


def test_schedule_is_even(spark):
    goals = spark.createDataFrame([(0, 1, 1000, 500.0, 1, 1000), (1, 2, 3000, 2500.0, 1, 3000)], "source int, place int, source_size long, target double, block long, blocks long")
    slots = sorted(tuple(r) for r in mixing.schedule(goals).collect())
    assert [s[0] for s in slots] == list(range(3000))
    for n in (60, 600, 3000):
        assert abs(sum(s[1] == 1 for s in slots[:n]) - n / 6) <= 3
    ranks = [s[3] for s in slots if s[1] == 1]
    assert ranks == list(range(len(ranks)))


def check_shards(rows, got, shards=8):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (r[0], len((r[1] or "").encode()) + 1, None if r[1] is None else zlib.crc32(r[1].encode())) for r in rows
    )
    counts = Counter(r["shard"] for r in got)
    assert max(counts.values()) - min(counts[s] for s in range(shards)) <= 1
    slots = defaultdict(list)
    for r in got:
        assert r["law"] == "rows" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding(spark):
    rows = messy_rows(spark)
    docs = documents(spark, rows)
    got = [r.asDict() for r in sharding.shard_documents(docs).collect()]
    check_shards(rows, got)
    homes = defaultdict(Counter)
    for r in got:
        homes[r["text_crc32"]][r["shard"]] += 1
    of = {zlib.crc32(r[1].encode()) for r in rows if r[1] is not None}
    hot = zlib.crc32(b"the very same short text again and again")
    assert all(len(h) == 1 for k, h in homes.items() if k in of and k != hot)
    # 40 copies in shards of 16: three shards hold them when cut least; hashing would use all eight
    assert len(homes[hot]) <= 5
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_sharding_when_all_are_linked(spark):
    rows = [(k, f"text {k // 2}", None, None, None) for k in range(400)]
    got = [r.asDict() for r in sharding.shard_documents(documents(spark, rows)).collect()]
    check_shards(rows, got)
    homes = defaultdict(set)
    for r in got:
        homes[r["text_crc32"]].add(r["shard"])
    assert sum(len(h) > 1 for h in homes.values()) <= 40  # of 200; hashing cuts 175


def test_with_shards(spark):
    docs = documents(spark, messy_rows(spark))
    got = sharding.with_shards(docs)
    assert got.columns == [c for c in docs.columns if c not in ("shard", "slot")] + ["shard", "slot"]
    assert got.count() == docs.count()


@pytest.mark.parametrize(("wishes", "room"), [({(0, 1): 10, (1, 0): 4}, {0: 0, 1: 3}), ({(0, 1): 5, (2, 1): 5}, {1: 4}), ({(0, 1): 7}, {})])
def test_quotas_keep_room(wishes, room):
    granted = sharding.quotas(wishes, room)
    assert all(0 <= n <= wishes[k] for k, n in granted.items())
    for s in {x for k in wishes for x in k}:
        came = sum(n for (_, j), n in granted.items() if j == s)
        left = sum(n for (i, _), n in granted.items() if i == s)
        assert came - left <= room.get(s, 0)
