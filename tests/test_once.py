"""Costly steps are done once a row: their plans hold them once, and their results stay as they were."""

import re

from pyspark.sql import functions as F

from paddock.functions.text import digits_int, numeric_token


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _conditions(df):
    return [line for line in _plan(df).splitlines() if re.search(r"(Filter|Join) ", line)]


def test_training_tokens_are_read_once(spark, tmp_path):
    from paddock.sources.tables import read_training_table

    path = tmp_path / "train.csv"
    path.write_text("y,a,b\n1,2.5,3\n0,x,4\n1,,1e2\n")
    rows, rejects, names = read_training_table(spark, str(path), header=True, label="name:y", fmt="csv")
    assert names == ["a", "b"]
    got = rows.select("label", F.when(~F.isnan("a"), F.col("a")).alias("a"), "b").orderBy("b").collect()
    assert [tuple(r) for r in got] == [(1.0, 2.5, 3.0), (1.0, None, 100.0)]
    assert [tuple(r) for r in rejects.collect()] == [("0", "x", "4")]
    assert not any("RLIKE" in c for c in _conditions(rows))


def test_plain_numbers_read_as_before(spark):
    given = {"12": 12.0, "-3.50": -3.5, "+7.": 7.0, " 12 ": 12.0, "1e3": 1000.0, ".5": 0.5, "1d": None, "12\n": 12.0, "inf": 1e308}
    got = spark.createDataFrame([(t,) for t in given], "t string").select("t", numeric_token(F.col("t")).alias("v")).collect()
    assert {r["t"]: r["v"] for r in got} == given


def test_numbers_before_a_unit_read_as_before(spark):
    given = {"970円": 970, "57kg": 57, "12": 12, "1２円": 12, "470(+2)": 4702, "1998/08/02": 19980802, "12ꘐ": 12, "1234567890円": 1234567890, "円": None, "": None, "7円\n": 7}
    got = spark.createDataFrame([(t,) for t in given], "t string").select("t", digits_int(F.col("t")).alias("v")).collect()
    assert {r["t"]: r["v"] for r in got} == given


def _month(spark):
    from paddock.operators.payouts import BETS
    from paddock.operators.race import HORSE_COLUMNS, KEY_COLUMNS, RACE_COLUMNS
    from paddock.plans.race_month import RaceMonth

    bets = [n for _, amount, numbers in BETS for n in (amount, *numbers)]

    def lines(names, *rows):
        text = [",".join([*KEY_COLUMNS, *names]), *rows]
        return spark.createDataFrame([("a", i, t) for i, t in enumerate(text)], "archive string, line_no long, line string")

    return RaceMonth(
        lines(RACE_COLUMNS.values(), 'X,1998/08/02,1R,12:30,1200m,"fine, ""dry""",good,2,one'),
        lines(HORSE_COLUMNS.values(), "X,1998/08/02,1,2,b,,55kg,470(+2),", "X,1998/08/02,1,1,a,rider,57kg,480,1", "X,1998/08/02,1,,c,rider,57kg,480,2"),
        lines(bets, "X,1998/08/02,1," + ",".join(f"{10 + i}円" if n.endswith("（円）") else str(i % 9 + 1) for i, n in enumerate(bets))),
        ["archive"],
    )


def test_no_condition_splits_a_line_again(spark):
    """the keys of a join are known to be filled, which is asked of the typed columns alone."""
    month = _month(spark)
    both = month.entries.join(month.outcomes.select("track", "race_date", "race_no", "horse_no", "finish_position"), ["track", "race_date", "race_no", "horse_no"])
    assert any("isnotnull" in c for c in _conditions(both))
    assert not any("split(" in c for c in _conditions(both))
    assert sorted(tuple(r) for r in both.select("horse_no", "finish_position").collect()) == [(1, 1), (2, None)]


def test_horses_used_twice_are_read_from_lines_once(spark):
    from paddock.operators.race import entries_with_outcomes

    month = _month(spark).kept()
    got = entries_with_outcomes(month.entries, month.outcomes)
    assert "split(" not in _plan(got)
    assert sorted(tuple(r) for r in got.select("horse_no", "horse_name", "label").collect()) == [(1, "a", 1.0), (2, "b", 0.0)]


def test_bundle_reads_its_horses_from_lines_once(spark):
    from paddock.operators.payouts import BETS

    month = _month(spark)
    row = month.bundles().collect()[0]
    assert ([e["horse_no"] for e in row["entries"]], [o["finish_position"] for o in row["outcomes"]], row["rejected"]) == ([1, 2], [1, None], 1)
    assert (len(row["payouts"]), row["payouts"][0]["amount_yen"], list(row["payouts"][0]["combination"])) == (len(BETS), 10, [2])
    assert "馬名" not in _plan(month.bundles().select("entries", "rejected"))


def test_archives_are_handed_on_in_pieces():
    """what a task holds does not grow with the rows of a batch."""
    import io
    import random
    import zipfile

    import pandas as pd
    import pyarrow as pa

    from paddock.plans.race_queries import _zip_rows
    from paddock.sources import archives as arc

    text = random.Random(1).randbytes(1 << 20).hex()
    frame = pd.DataFrame({"doc_id": range(12), "text": [text] * 12, "lang": ["en"] * 12})
    made = list(_zip_rows(iter([frame])))
    assert [p for m in made for p in m["path"]] == [str(i) for i in range(12)]
    assert max(sum(map(len, m["content"])) for m in made) < 2 * arc.PIECE_BYTES
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("199808_payback.csv", "h\nx\ny")
    batch = pa.RecordBatch.from_arrays([pa.array(["a", "b", None]), pa.array([out.getvalue(), b"no zip", None])], ["path", "content"])
    counted = [tuple(r.values()) for b in arc._count_members(iter([batch])) for r in b.to_pylist()]
    assert counted == [("a", "199808_payback.csv", 2, True, 5), ("b", "", 0, False, 0), (None, "", 0, False, 0)]


def test_headers_are_read_once_a_piece(spark):
    """The header is worked out below the generator that makes a piece's lines, and every line still carries it."""
    from paddock.sources.archives import piece_lines

    piece = ("a.zip", "199808", "racelist", 5, "x,y\r\n1,2\r3,4\n", 0, 'n,"m,1",n')
    pieces = spark.createDataFrame([piece], "archive string, yyyymm string, kind string, first_line long, text string, header_line long, header_text string")
    lines = piece_lines(pieces)
    plan = [line for line in _plan(lines).splitlines() if "map_from_entries" in line or "Generate posexplode" in line]
    assert len(plan) == 2 and "Generate posexplode" in plan[0], plan
    got = [(r["line_no"], r["line"], r["header_line"], r["header"]) for r in lines.orderBy("line_no").collect()]
    header = {"m,1": 1, "n": 2}
    assert got == [(5, "x,y", 0, header), (6, "1,2", 0, header), (7, "3,4", 0, header)]


def test_fields_of_a_row_are_looked_up_by_one_expression(spark):
    from paddock.operators.race import KEY_COLUMNS, raw_fields

    names = [*KEY_COLUMNS, "a", "b"]
    positions = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)])
    given = spark.createDataFrame([("f", 1, ["X", "d", "1", "p", "q"]), ("f", 2, ["Y", "d"]), ("f", 3, ["Z", "d", "2", None, "r", "more"])], "archive string, line_no long, fields array<string>")
    rows = raw_fields(given.withColumn("header", positions), {"b": "b", "a": "a", "none": "unknown"})
    assert rows.columns == ["archive", "line_no", "track", "race_date", "race_no", "b", "a", "none"]
    got = [tuple(r)[2:] for r in rows.orderBy("line_no").collect()]
    assert got == [("X", "d", "1", "q", "p", ""), ("Y", "d", "", "", "", ""), ("Z", "d", "2", "r", "", "")]
    assert _plan(rows).count("element_at(fields") == 1


def test_line_ends_are_counted_as_they_are_split():
    import re

    from paddock.sources.archives import LINE_END, _line_ends

    for text in ("", "a", "a\n", "\r\n\r\n", "a\rb\nc\r\nd\n\r", "\r\r\n\n"):
        assert _line_ends(text) == len(re.findall(LINE_END, text))


def test_monthly_archives_hold_their_lines_in_order():
    import io
    import zipfile

    import pyarrow as pa

    from paddock.plans.derived import HEADERS
    from paddock.plans.race_queries import _monthly_zip

    lines = pa.table({"month": ["199808"] * 4, "kind": ["racelist", "horselist", "racelist", "horselist"], "line_no": [7, 3, 2, 3], "line": ["b", "d", "a", "e"]})
    made = _monthly_zip(("199808",), lines).to_pylist()[0]
    assert made["path"] == "199808_race.zip" and made["length"] == len(made["content"])
    with zipfile.ZipFile(io.BytesIO(made["content"])) as z:
        assert z.namelist() == ["199808/199808_horselist.csv", "199808/199808_racelist.csv"]
        assert [z.read(n).decode().split("\n")[1:] for n in z.namelist()] == [["d", "e"], ["a", "b"]]
        assert z.read("199808/199808_racelist.csv").decode().split("\n")[0] == ",".join(HEADERS["racelist"])


def test_payback_rows_are_dealt_as_numbers(spark):
    """F8: what finds the first row of each key moves a payback row's numbers; its slots are made after."""
    payouts = _month(spark).payouts
    lines = _plan(payouts).splitlines()
    window = next(i for i, line in enumerate(lines) if "Window" in line)
    assert any("bet_type" in line for line in lines[:window]) and not any("bet_type" in line for line in lines[window:])
    first = payouts.orderBy("pos").first()
    assert (first["bet_type"], first["pos"], list(first["combination"]), first["amount_yen"]) == ("WIN", 0, [2], 10)
