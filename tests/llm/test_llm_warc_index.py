"""Archives by round trip, nearest neighbours by recall."""

from __future__ import annotations

import base64
import hashlib
import os
import struct
from urllib.parse import urlparse

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from paddock.llm import multi_index, warc
from paddock.llm.tables import new_folder

SMALL = "/root/testdata/sf0.001"


def brute_records(rows, least=0):
    best = {}
    for p, _, h in rows:
        body = (h or "").encode()
        if p is not None and len(body) >= least:
            best[body] = max(p, best.get(body, p))
    out = []
    for p, _, h in rows:
        body = (h or "").encode()
        top = best.get(body)
        revisit = top is not None and p != top
        out.append((p, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 30])
def test_round_trip(spark, least):
    real = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()]
    rows = real + [
        (900, "http://a/\r\n x", real[0][2]), (901, None, real[0][2]), (902, "http://b", None), (903, "http://b", ""), (904, "u", "é\r\n\r\n\x00 ü"),
        (905, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"), (906, "u", "long " * 300_000), (907, "u", "twice"), (907, "u", "twice"), (908, "u", "small"), (909, "u", "small"),
        (None, "n", "no id"), (None, "n", real[1][2]),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS archive", "'x' AS digest", "2 AS payload")
    params = warc.Params(archive_bytes=200_000, least_revisit=least)
    got = warc.round_trip(pages, params)
    back = got.collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in back), key=repr) == brute_records(rows, least)
    bodies = {(r["page_id"], r["payload_digest"]): bytes(r["payload"]) for r in back if r["record_type"] == "response"}
    for p, _, h in rows:
        body = (h or "").encode()
        key = (p, base64.b32encode(hashlib.sha1(body).digest()).decode())
        assert bodies.get(key, body) == body
    assert "http://a/%0D%0A%20x" in {r["target_uri"] for r in back}


def test_archive_layout(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    folder = new_folder(spark, "warc-test")
    made = warc.write(pages, folder, params=warc.Params(archive_bytes=10_000_000)).collect()
    path = os.path.join(urlparse(folder).path, made[0]["file"])
    with open(path, "rb") as f:
        content = f.read()
    magic, size = struct.unpack_from("<II", content)
    assert magic == 0x184D2A5D and content[8:12] == struct.pack("<I", 0xEC30A437) and len(content) == made[0]["bytes"]
    with_dictionary = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content[8 : 8 + size]))
    frames, at = 0, 8 + size
    while at < len(content):
        reader = with_dictionary.decompressobj()
        text = reader.decompress(content[at:])
        assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n") and text.count(b"WARC-Record-ID") == 1
        at = len(content) - len(reader.unused_data)
        frames += 1
    assert frames == made[0]["records"] + 1 == pages.count() + 1


def test_no_pages(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    assert warc.round_trip(pages.limit(0)).count() == 0
    assert warc.round_trip(pages.limit(1)).count() == 1


def test_neighbours(spark):
    vectors = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = [(r["vec_id"], np.array(r["embedding"], dtype=float)) for r in vectors.collect()]
    got = multi_index.search(vectors, F.col("vec_id") % 20 == 0, params=multi_index.Params(part_rows=64, block_queries=8)).collect()
    hits = total = 0
    ids, points = np.array([i for i, _ in rows]), np.array([x for _, x in rows])
    for q, x in rows:
        if q % 20 == 0:
            d = np.sqrt(((points - x) ** 2).sum(1))
            d[ids == q] = np.inf
            want = np.lexsort((ids, d))[:10]
            mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
            assert [m[0] for m in mine] == list(range(1, 11))
            assert [(m[2], m[1]) for m in mine] == sorted((m[2], m[1]) for m in mine)
            at = {i: d[k] for k, i in enumerate(ids)}
            assert all(m[2] == pytest.approx(at[m[1]], rel=1e-12) for m in mine)
            hits += len({m[1] for m in mine} & set(ids[want].tolist()))
            total += 10
    assert hits / total >= 0.9


def test_unusable_vectors_ties_and_few(spark):
    rows = [
        (0, [1.0, 0.0, 0.0, 0.0], 1), (1, [1.0, 0.0, 0.0, 0.0], 1), (2, [0.0, 0.0, 0.0, 0.0], 1), (3, None, 1), (4, [1.0, None, 0.0, 0.0], 1),
        (5, [float("nan"), 1.0, 0.0, 0.0], 1), (6, [float("inf"), 1.0, 0.0, 0.0], 1), (7, [1.0, 1.0], 1), (8, [0.0, 1.0, 0.0, 0.0], 1), (9, [1.0, 0.0, 0.0, 0.0], 1),
        (None, [1.0, 0.0, 0.0, 1.0], 1), (9, [1.0, 0.0, 0.0, 0.0], 2), (100, [0.0, 0.0, 0.0, 0.0], 1), (200, None, 1),
    ]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, first int").selectExpr("*", "1 AS rank", "2 AS part")
    got = sorted(tuple(r) for r in multi_index.search(vectors, F.col("vec_id") % 100 == 0, params=multi_index.Params(visit_share=1.0)).collect())
    assert got == [(0, 1, 1, 0.0), (0, 2, 9, 0.0), (0, 3, 9, 0.0), (0, 4, 8, pytest.approx(2**0.5))]
    assert multi_index.search(vectors.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert multi_index.search(vectors, F.col("vec_id") == 55).count() == 0


def test_cells_come_in_order():
    draw = np.random.default_rng(8)
    a, b = draw.random(9), draw.random(7)
    counts = draw.integers(0, 3, (9, 7))
    order = multi_index.cells_in_order(a, b, counts, counts.sum())
    sums = [a[i] + b[j] for i, j in order]
    assert sums == sorted(sums) and len(order) == (counts > 0).sum() == len(set(order))
    some = multi_index.cells_in_order(a, b, counts, counts.sum() / 3)
    assert some == order[: len(some)] and sum(counts[c] for c in some) >= counts.sum() / 3
