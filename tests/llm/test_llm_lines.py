"""Line removal and spelling variants, whole results against plain forms."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from llm_cases import documents, messy_rows, rows_of

from paddock.llm import line_dedup, spelling

FAR = 2**70  # a null id is the largest


def key_of(line):
    return re.sub(r"[A-Z]+", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))


def brute_lines(rows):
    owner = {}
    for r in rows:
        for line in (r[1] or "").split("\n"):
            key, doc = key_of(line), FAR if r[0] is None else r[0]
            owner[key] = min(doc, owner.get(key, FAR))
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if len(key_of(x)) < 10 or owner[key_of(x)] == (FAR if r[0] is None else r[0])]
        out.append((r[0], len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def line_rows(spark):
    rows = messy_rows(spark)
    common = "This very common line of the footer"
    rows += [(2000 + k, f"{common}\nline of its own number {k}\n\n  {common.upper()}\t\r\nshort\nshort", None, None, None) for k in range(60)]
    rows += [
        (1, "\n\n\n", None, None, None), (3000, common, None, None, None), (3001, "İstanbul ÉCOLE zzz\nistanbul école zzz", None, None, None),
        (3002, "i̇stanbul École zzz\nİstanbul École ZZZ", None, None, None), (None, f"{common}\nonly without an id", None, None, None),
        (None, "only without an id", None, None, None), (3003, "\x1cnot a space here", None, None, None), (3004, "not a space here", None, None, None),
        (3005, "0123456789\n\x0b0123456789 \x0c\n012345678", None, None, None), (3006, "0123456789\n012345678", None, None, None),
        (3007, "\n".join(f"long text line {i % 5000}" for i in range(20_000)), None, None, None),
        (3008, "\n".join(f"long text line {i}" for i in range(4_000)), None, None, None),
        (3008, "\n".join(f"long text line {i}" for i in range(4_000)), None, None, None), (-5, common + " \n" + "x" * 200_000, None, None, None),
    ]
    return rows


@pytest.mark.parametrize("params", [line_dedup.Params(), line_dedup.Params(batches=9, fanout=2), line_dedup.Params(batches=1)])
def test_lines(spark, params):
    rows = line_rows(spark)
    before = {t.name for t in spark.catalog.listTables()}
    assert rows_of(line_dedup.dedup_digest(documents(spark, rows), params)) == brute_lines(rows)
    assert {t.name for t in spark.catalog.listTables()} == before


def test_lines_of_one_id_and_empty(spark):
    rows = [(7, "the same line again", None, None, None)] * 30 + [(8, "the same line again\nanother line here", None, None, None)] * 5
    assert rows_of(line_dedup.dedup_digest(documents(spark, rows))) == brute_lines(rows)
    assert line_dedup.dedup_digest(documents(spark, rows).limit(0)).count() == 0
    nothing = [(None, None, None, None, None), (1, "", None, None, None)]
    assert rows_of(line_dedup.dedup_digest(documents(spark, nothing))) == brute_lines(nothing)


def test_kept_text(spark):
    docs = documents(spark, [(1, "first line here\nb", None, None, None), (2, "b\nFIRST LINE here \nsecond line here", None, None, None)])
    got = {r["doc_id"]: r["kept_text"] for r in line_dedup.dedup(docs).collect()}
    assert got == {1: "first line here\nb", 2: "b\nsecond line here"}


def test_runs_are_levelled(spark):
    runs = line_dedup.Runs(spark, fanout=2)
    for k in range(5):
        keys = spark.range(k * 10, k * 10 + 20).selectExpr("id AS h1", "-id AS h2", f"{k}L AS owner")
        runs.add(runs.unseen(keys))
        runs.compact()
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    owners = sorted((r["h1"], r["owner"]) for name in runs.tables() for r in spark.table(name).collect())
    assert owners == [(h, max(0, h // 10 - 1)) for h in range(60)]
    runs.close()


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(rows):
    count = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            if r[0] is not None and (h := zlib.crc32(f"{r[0]}:{run}".encode())) % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    patterns = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            patterns[w[:i], w[i + 1 :], 1].add(w)
            patterns[w[:i] + w[i + 1 :]].add(w)
    form, close = {}, {}
    for w in words:
        found = set().union(*[patterns[w[:i], w[i + 1 :], 1] for i in range(len(w))], patterns[w], [w[:i] + w[i + 1 :] for i in range(len(w))])
        found = {x for x in found if x in words and x != w}
        close[w] = len(found)
        best = min(found, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], close[w], None if form[w] is None else words[form[w]]))
    return sorted(out, key=repr)


def word_rows(spark):
    rows = messy_rows(spark)
    texts = {
        "abcdefgh": 300, "abcdefg": 25, "abcdeffgh": 2, "abcdefghh": 3, "abcdxfgh": 30, "abcdxfyh": 3, "bcdefgh": 2, "aaaaaaaa": 40, "aaaaaaa": 4, "aaaaaaaaa": 2,
        "ÉCOLEABC": 5, "école×abc": 2, "÷÷÷÷÷÷÷": 3, "straßenbahn": 40, "strassenbahn": 3, "strasenbahn": 2, "abcdefgi": 300, "zyxwvut": 2, "zyxwvus": 20, "zyxwvur": 20,
    }
    rows += [(4000 + k, " ".join([w] * n) + "!", None, None, None) for k, (w, n) in enumerate(texts.items())]
    rows += [(None, "zyxwvut,zyxwvut;żyxwvutz1zyxwvut2", None, None, None), (4100, "q" * 30_000 + " " + "q" * 29_999, None, None, None)] * 2
    return rows


def test_words(spark):
    rows = word_rows(spark)
    got = rows_of(spelling.group(documents(spark, rows)))
    assert got == brute_words(rows)
    assert any(r[1] and r[2] != r[1] for r in got)  # a chain of forms


def test_words_small_batches(spark, monkeypatch):
    rows = word_rows(spark)[-60:]
    monkeypatch.setattr(spelling, "_ENTRIES_OUT", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert rows_of(spelling.group(documents(spark, [r for r in rows if len(r[1] or "") < 20_000]))) == brute_words([r for r in rows if len(r[1] or "") < 20_000])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_words(spark):
    docs = documents(spark, [(1, None, None, None, None), (2, "", None, None, None), (3, "once only words", None, None, None)])
    assert spelling.group(docs).count() == 0
    assert spelling.group(docs.limit(0)).columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_near_is_what_the_words_say():
    assert near("abcdefg", "abcdefgh") and near("abcdefg", "abxdefg") and not near("abcdefg", "bacdefg")
