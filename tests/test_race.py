"""Race half: CSV rule, lenient numbers, archives, joins and payouts on a synthetic month."""

import hashlib
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from paddock.functions.csv import csv_fields
from paddock.functions.text import digits_int, digits_int_strict, loose_double, numeric_token, text_or_null
from paddock.operators import payouts, race
from paddock.operators.joins import skewed_join
from paddock.operators.prefix import first_rows, positions, running_totals
from paddock.plans.race_month import from_archives
from paddock.sources import archives as arc


def scan(line):
    """Character-by-character statement of the CSV rule."""
    fields, current, quoted, i = [], "", False, 0
    while i < len(line):
        c = line[i]
        if c == '"' and quoted and line[i + 1 : i + 2] == '"':
            current += '"'
            i += 1
        elif c == '"':
            quoted = not quoted
        elif c == "," and not quoted:
            fields.append(current)
            current = ""
        else:
            current += c
        i += 1
    return [*fields, current]


def test_csv_fields_follow_the_rule(spark):
    rng = random.Random(7)
    lines = ["".join(rng.choice('a,"b ') for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    lines += ['"a""b",c,d"x,y"e', "a,,", "", '"""",１２', 'x,"open, to the end']
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    got = {r["i"]: r["f"] for r in df.select("i", csv_fields(F.col("line")).alias("f")).collect()}
    assert all(got[i] == scan(x) for i, x in enumerate(lines))


@pytest.mark.parametrize(
    "parse, cases",
    [
        (digits_int, {"-5": 5, "470(+2)": 4702, "12.5": 125, "１２頭": 12, "": None, "x": None, "99999999999": None, "0012": 12, "٣٤": 34}),
        (loose_double, {" 54.5kg": 54.5, "-1.5": -1.5, "1-2": None, "５５": None, "": None, ".5": 0.5}),
        (digits_int_strict, {"470(+2)": 470, "-5": -5, " 12 ": 12, "x": None}),
        (text_or_null, {"　大井　": "大井", " \t": None, "": None, "a b": "a b"}),
        (numeric_token, {" -1.5e2": -150.0, "1e999": 1e308, "-inf": -1e308, "abc": None, ".": 0.0, "1e-2": 0.01}),
    ],
)
def test_lenient_values(spark, parse, cases):
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    assert {r["x"]: r["y"] for r in df.select("x", parse(F.col("x")).alias("y")).collect()} == cases


def test_missing_tokens_are_nan(spark):
    df = spark.createDataFrame([("NA",), ("nan",), ("Null",), ("",)], "x string")
    assert df.where(F.isnan(numeric_token(F.col("x")))).count() == 4


RACES = (
    "﻿競馬場,競走年月日,レース番号,発走時刻,距離,天候,馬場,頭数,レース名,頭数\r\n"
    "\r\n"
    '大井,19980806,1,1500,1600m,晴,"良, 稍""重""",9,　夢 ,12\r\n'
    "大井,19980806,1,1501,1600,雨,良,9,second,3\n"
    "大井,19980806,2,,,,,,\n"
    "川崎,1998/08/07,3R,1200,1400,晴,良,2,x,2"
)
HORSES = (
    "競馬場,競走年月日,レース番号,馬番,馬名,騎手名,負担重量,馬体重,着順\n"
    + "".join(f"大井,19980806,1,{13 - i},horse{13 - i},rider,5{i % 10}.5,470(+2),{i}\n" for i in range(1, 13))
    + "川崎,19980807,3,１,one,,５５,500,\n川崎,19980807,3,,nobody,,,,\n浦和,19980807,9,1,lost,,,,1\n"
)
PAYBACK = (
    "競馬場,競走年月日,レース番号,単勝払戻金（円）,単勝組番,馬複払戻金（円）,馬複組番1,馬複組番2,複勝払戻金1（円）,複勝組番1,ワイド払戻金1（円）,ワイド組番1馬番1,ワイド組番1馬番2\n"
    '大井,19980806,1,350,6,"1,290",5,6,0,6,200,5,\n'
    "大井,19980806,1,999,1,,,,,,,,\n"
)


def bundle_bytes(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


@pytest.fixture(scope="module")
def month_folder(tmp_path_factory):
    folder = tmp_path_factory.mktemp("archives")
    full = {"m/199808_racelist.csv": RACES, "199808_horselist.csv": HORSES, "199808_payback.csv": PAYBACK, "readme.txt": "x"}
    (folder / "199808_race.zip").write_bytes(bundle_bytes(full))
    (folder / "199809_race.zip").write_bytes(bundle_bytes({"199809_racelist.csv": ""}))
    return folder


def test_archive_to_bundle(spark, month_folder):
    files = arc.archive_files(spark, str(month_folder))
    month = from_archives(files.where(F.col("path").contains("199808")))
    races = {(r["track"], r["race_no"]): r for r in race.first_per_key(month.races).collect()}
    first = races["大井", 1]
    assert (first["post_time"], first["distance_m"], first["declared_count"]) == (1500, 1600, 12)
    assert (first["track_condition"], first["race_name"]) == ('良, 稍"重"', "夢")
    assert races["大井", 2]["weather"] is None and ("川崎", 3) in races
    bundles = {(r["track"], r["race_no"]): r for r in month.bundles().collect()}
    top = bundles["大井", 1]
    assert [e["horse_no"] for e in top["entries"]] == list(range(1, 13))
    assert all(e["body_weight_kg"] == 4702 for e in top["entries"])
    paid = [(p["bet_type"], p["combination"], p["amount_yen"]) for p in top["payouts"]]
    assert paid == [("WIN", [6], 350), ("QUINELLA", [5, 6], 1290)]
    assert bundles["川崎", 3]["payouts"] == [] and len(bundles["川崎", 3]["entries"]) == 1
    assert [r["track"] for r in race.horses_without_race(month.horses, month.races).collect()] == ["浦和"]
    assert [r["race_no"] for r in race.races_without_horses(month.races, month.horses).collect()] == [2]
    assert [r["reason"] for r in race.entry_rejects(month.horses).collect()] == ["Horse number missing"]
    ok = {(r["track"], r["race_no"]): r["pass"] for r in race.check_declared_count(race.first_per_key(month.races), month.horses).collect()}
    assert ok == {("大井", 1): True, ("大井", 2): False, ("川崎", 3): True}
    lines = [r["line"] for r in month.card().where("track = '大井' and race_no = 1").orderBy("section", "pos").collect()]
    assert lines[0] == "競馬場=大井 日付=19980806 レース=1R" and lines[-1] == "馬複=5-6 1290円" and len(lines) == 7 + 12 + 2


def test_archive_counts_errors_and_checksum(spark, month_folder):
    files = arc.archive_files(spark, str(month_folder))
    counts = {r["archive"][-14:]: r for r in arc.archive_row_counts(files).collect()}
    full = counts["199808_race.zip"[-14:]]
    assert (full["racelist"], full["horselist"], full["payback"]) == (5, 15, 2)
    assert counts["199809_race.zip"[-14:]]["payback"] == -1
    errors = {(r["kind"], r["error"]) for r in arc.archive_errors(files).collect()}
    assert errors == {("horselist", "horselist not found"), ("payback", "payback not found")}
    sums = {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in month_folder.glob("*.zip")}
    named = files.withColumn("path", F.substring_index("path", "/", -1))
    expected = spark.createDataFrame([(k, v.upper()) for k, v in sums.items()], "path string, expected_sha256 string")
    assert all(r["match"] for r in arc.archive_checksum(named, expected).collect())
    lines = arc.read_archives(files)
    assert [r["kind"] for r in arc.empty_tables(lines, ["archive", "kind"]).collect()] == ["racelist"]


def test_large_members_leave_in_pieces(spark, monkeypatch):
    text = "".join(f"line {i},x\r\n" for i in range(500)) + "end"
    pieces = list(arc._text_pieces(io.BytesIO(text.encode())))
    monkeypatch.setattr(arc, "PIECE_BYTES", 64)
    small = list(arc._text_pieces(io.BytesIO(text.encode())))
    assert "".join(small) == "".join(pieces) == text and len(small) > 50
    assert all(p.endswith("\n") for p in small[:-1])


def test_running_totals_and_hot_groups(spark):
    rng = random.Random(3)
    rows = [(0 if rng.random() < 0.6 else rng.randint(1, 5), rng.randint(0, 50), i, rng.randint(1, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g int, v int, id int, w int")
    got = running_totals(df, ["g"], [F.col("v"), F.col("id")], {"upto": F.col("w")}, 7)
    want, sums = {}, {}
    for g, v, i, w in sorted(rows):
        sums[g] = sums.get(g, 0) + w
        want[i] = sums[g]
    assert {r["id"]: r["upto"] for r in got.collect()} == want
    ranked = positions(df, ["g"], [F.col("v").desc(), F.col("id")])
    assert ranked.groupBy("g").agg(F.max("position").alias("m"), F.count("*").alias("n")).where("m <> n").count() == 0


def test_skewed_join_equals_plain_join(spark):
    many = spark.range(4000).select((F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40)).alias("k"), "id")
    one = spark.range(30).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x"))
    for how in ("inner", "left"):
        plain = many.join(one, "k", how).select("k", "id", "x")
        salted = skewed_join(many, one, ["k"], how, hot_rows=500, salts=4).select("k", "id", "x")
        assert plain.exceptAll(salted).count() == salted.exceptAll(plain).count() == 0


def test_first_rows_limits_groups_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    plan = first_rows(df, ["k"], [F.col("id")])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_expected_payouts(spark):
    paid = spark.createDataFrame([("a", 1, 1, "WIN", [6], 350)], "track string, race_date int, race_no int, bet_type string, combination array<int>, amount_yen int")
    absent = spark.createDataFrame([("a", 1, 1, "WIN", [6], 350), ("a", 1, 1, "QUINELLA", [6, 5], 1290)], paid.schema)
    assert [r["bet_type"] for r in payouts.check_expected_payouts(absent, paid).collect()] == ["QUINELLA"]


def test_expected_payouts_are_not_broadcast(spark):
    """Exploded payouts are far larger than Spark's estimate of them, so none goes through the driver."""
    paid = spark.createDataFrame([("a", 1, 1, "WIN", [6], 350)], "track string, race_date int, race_no int, bet_type string, combination array<int>, amount_yen int")
    plan = payouts.check_expected_payouts(paid, paid.limit(1))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
