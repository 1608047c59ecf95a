"""Race-half queries: CSV, typed extraction, joins, payouts, checks."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from paddock.functions.csv import csv_fields, csv_value
from paddock.functions.text import digits_int, digits_int_strict, loose_double, numeric_token, text_or_null
from paddock.operators import bundle, payouts, race
from paddock.operators.prefix import first_rows
from paddock.plans.catalog import query, table
from paddock.plans.derived import HEADERS, derived_month, horse_csv, payback_csv, race_csv
from paddock.session import discard, names_in, shared_folder
from paddock.sources import archives as arc
from paddock.streaming import streams

_DAY = "CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER)"
_KEY = f"o_orderstatus AS track, {_DAY} AS race_date, CAST(o_orderkey AS INTEGER) AS race_no"


@query(
    "csv_fields",
    """SELECT p_partkey AS id, p_name AS f0, p_brand || ', "' || p_type || '"' AS f1,
              p_type || 'x,y' || CAST(p_size AS VARCHAR) AS f2, '' AS f3, CAST(4 AS INTEGER) AS n FROM part
       UNION ALL
       SELECT c_custkey + 1000000000, c_name, c_mktsegment || ', "' || c_name || '"',
              c_name || 'x,y' || CAST(c_nationkey AS VARCHAR), '', CAST(4 AS INTEGER) FROM customer""",
)
def _csv_fields(spark, sf):
    p = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("a"), F.col("p_brand").alias("b"),
        F.col("p_type").alias("c"), F.col("p_type").alias("d"), F.col("p_size").alias("e"),
    )
    c = table(spark, sf, "customer").select(
        (F.col("c_custkey") + 1000000000).alias("id"), F.col("c_name").alias("a"), F.col("c_mktsegment").alias("b"),
        F.col("c_name").alias("c"), F.col("c_name").alias("d"), F.col("c_nationkey").alias("e"),
    )
    line = F.concat(
        F.col("a"), F.lit(',"'), F.col("b"), F.lit(', ""'), F.col("c"), F.lit('""",'),
        F.col("d"), F.lit('"x,y"'), F.col("e").cast("string"), F.lit(","),
    )
    fields = p.unionByName(c).select("id", csv_fields(line).alias("f"))
    return fields.select("id", *[F.col("f")[i].alias(f"f{i}") for i in range(4)], F.size("f").alias("n"))


@query(
    "csv_table",
    f"""SELECT o_orderpriority AS archive, o_orderkey AS line_no, CAST(9 AS INTEGER) AS n_fields,
               CAST(9 AS INTEGER) AS n_columns, strftime(o_orderdate, '%Y/%m/%d') AS day FROM orders""",
)
def _csv_table(spark, sf):
    bare = race_csv(spark, sf).drop("header", "header_line")
    t = arc.csv_table(bare, ["archive"])
    return t.select(
        "archive", "line_no", F.size("fields").alias("n_fields"), F.size("header").alias("n_columns"),
        csv_value(F.col("fields"), F.col("header"), "競走年月日").alias("day"),
    )


@query(
    "csv_value",
    """SELECT o_orderkey AS line_no, '12:' || CAST(o_custkey % 50 + 10 AS VARCHAR) AS post,
              o_orderpriority || ', "dry"' AS weather, '' AS unknown FROM orders""",
)
def _csv_value(spark, sf):
    t = arc.csv_table(race_csv(spark, sf), ["archive"])
    at = lambda n: csv_value(F.col("fields"), F.col("header"), n)
    return t.select("line_no", at("発走時刻").alias("post"), at("天候").alias("weather"), at("無い列").alias("unknown"))


@query(
    "read_numeric_token",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
              CASE l_partkey % 6 WHEN 0 THEN -l_extendedprice WHEN 1 THEN l_quantity * 1000.0::DOUBLE
                   WHEN 2 THEN 1e308 WHEN 3 THEN -1e308 WHEN 4 THEN l_discount ELSE -1.0 END AS value,
              l_partkey % 6 = 5 AS missing
       FROM lineitem""",
)
def _numeric_token(spark, sf):
    li = table(spark, sf, "lineitem")
    k = F.col("l_partkey") % 6
    token = (
        F.when(k == 0, F.concat(F.lit("  -"), F.format_string("%.2f", "l_extendedprice")))
        .when(k == 1, F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("e3 ")))
        .when(k == 2, F.lit("1e999"))
        .when(k == 3, F.lit("-Infinity"))
        .when(k == 4, F.concat(F.lit("+"), F.format_string("%.2f", "l_discount")))
        .otherwise(F.lit("NA"))
    )
    v = numeric_token(token)
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        F.when(F.isnan(v), F.lit(-1.0)).otherwise(v).alias("value"), F.isnan(v).alias("missing"),
    )


@query(
    "text_or_null",
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'race ' || CAST(o_custkey AS VARCHAR) END AS body,
              o_orderstatus AS track_condition FROM orders
       UNION ALL SELECT doc_id, nullif(regexp_replace(text, '^[\\t-\\r\\x1c-\\x1f\\p{Z}]+|[\\t-\\r\\x1c-\\x1f\\p{Z}]+$', '', 'g'), ''), source FROM documents""",
)
def _text_or_null(spark, sf):
    o, d = table(spark, sf, "orders"), table(spark, sf, "documents")
    name = F.when(F.col("o_orderkey") % 4 == 0, F.lit(" 　\t")).otherwise(
        F.concat(F.lit(" race "), F.col("o_custkey").cast("string"), F.lit(" "))
    )
    framed = lambda c: text_or_null(F.concat(F.lit("　"), F.col(c), F.lit(" \r"))).alias("track_condition")
    races = o.select(F.col("o_orderkey").alias("id"), text_or_null(name).alias("body"), framed("o_orderstatus"))
    return races.unionByName(d.select(F.col("doc_id").alias("id"), text_or_null(F.col("text")).alias("body"), framed("source")))


_DECORATED = """CASE l_partkey % 5 WHEN 0 THEN '-' || CAST(l_suppkey AS VARCHAR) || 'kg'
   WHEN 1 THEN CAST(l_suppkey AS VARCHAR) || '(+' || CAST(l_linenumber AS VARCHAR) || ')'
   WHEN 2 THEN CAST(l_suppkey AS VARCHAR) || '.' || CAST(l_linenumber AS VARCHAR)
   WHEN 3 THEN translate(CAST(l_partkey AS VARCHAR), '0123456789', '０１２３４５６７８９') || '頭'
   ELSE 'none' || repeat('9', CAST(l_linenumber AS INTEGER) * 2) END"""
_ROW = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"


def _decorated(spark, sf):
    k = F.col("l_partkey") % 5
    s = lambda c: F.col(c).cast("string")
    raw = (
        F.when(k == 0, F.concat(F.lit("-"), s("l_suppkey"), F.lit("kg")))
        .when(k == 1, F.concat(s("l_suppkey"), F.lit("(+"), s("l_linenumber"), F.lit(")")))
        .when(k == 2, F.concat(s("l_suppkey"), F.lit("."), s("l_linenumber")))
        .when(k == 3, F.concat(F.translate(s("l_partkey"), "0123456789", "０１２３４５６７８９"), F.lit("頭")))
        .otherwise(F.concat(F.lit("none"), F.repeat(F.lit("9"), F.col("l_linenumber") * 2)))
    )
    keep = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return table(spark, sf, "lineitem").select(*keep, raw.alias("raw"))


@query(
    "digits_int",
    f"""SELECT {_ROW}, TRY_CAST(regexp_replace(translate({_DECORATED}, '０１２３４５６７８９', '0123456789'), '[^0-9]', '', 'g') AS INTEGER) AS n
        FROM lineitem""",
)
def _digits_int(spark, sf):
    d = _decorated(spark, sf)
    return d.select(*d.columns[:-1], digits_int(F.col("raw")).alias("n"))


@query(
    "loose_double",
    f"""SELECT {_ROW}, TRY_CAST(regexp_replace({_DECORATED}, '[^.\\-\\p{{Nd}}]', '', 'g') AS DOUBLE) AS x FROM lineitem""",
)
def _loose_double(spark, sf):
    d = _decorated(spark, sf)
    return d.select(*d.columns[:-1], loose_double(F.col("raw")).alias("x"))


@query(
    "digits_int_strict",
    f"""SELECT {_ROW}, TRY_CAST(regexp_extract({_DECORATED}, '^([+-]?[0-9]+)', 1) AS INTEGER) AS n FROM lineitem""",
)
def _digits_int_strict(spark, sf):
    d = _decorated(spark, sf)
    return d.select(*d.columns[:-1], digits_int_strict(F.col("raw")).alias("n"))


_RACE_SQL = f"""SELECT {_KEY}, CAST(1200 + o_custkey % 50 + 10 AS INTEGER) AS post_time,
   CAST(floor(o_totalprice) AS INTEGER) AS distance_m, o_orderpriority || ', "dry"' AS weather,
   o_orderstatus AS track_condition, CAST(o_orderkey % 8 AS INTEGER) AS declared_count,
   CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'race ' || CAST(o_custkey AS VARCHAR) END AS race_name,
   o_orderpriority AS archive, o_orderkey AS line_no FROM orders"""
_HORSE_SQL = f"""SELECT {_KEY}, CAST(l_linenumber AS INTEGER) AS horse_no, 'horse ' || CAST(l_partkey AS VARCHAR) AS horse_name,
   CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE 'rider ' || CAST(l_suppkey AS VARCHAR) END AS jockey,
   l_quantity AS assigned_weight_kg, CAST((l_suppkey + 400) * 10 + 2 AS INTEGER) AS body_weight_kg,
   CASE WHEN l_returnflag = 'R' THEN NULL ELSE CAST(l_partkey % 12 + 1 AS INTEGER) END AS finish_position,
   o_orderpriority AS archive, l_partkey * 100000 + l_suppkey AS line_no
   FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


@query("race_key", f"SELECT {_KEY} FROM orders")
def _race_key(spark, sf):
    return race.raw_fields(arc.csv_table(race_csv(spark, sf), ["archive"]), {}).select(*race.race_key())


@query("map_race", _RACE_SQL)
def _map_race(spark, sf):
    return derived_month(spark, sf).races


@query(
    "map_entries",
    f"""SELECT track, race_date, race_no, horse_no, horse_name, jockey, assigned_weight_kg, body_weight_kg, archive, line_no
        FROM ({_HORSE_SQL})""",
)
def _map_entries(spark, sf):
    return derived_month(spark, sf).entries


@query("map_outcomes", f"SELECT track, race_date, race_no, horse_no, finish_position, archive, line_no FROM ({_HORSE_SQL})")
def _map_outcomes(spark, sf):
    return derived_month(spark, sf).outcomes


@query("filter_race", f"SELECT * FROM ({_HORSE_SQL}) WHERE track = 'O' AND race_date = (SELECT {_DAY} FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders WHERE o_orderstatus = 'O')) AND race_no = (SELECT max(o_orderkey) FROM orders WHERE o_orderstatus = 'O')")
def _filter_race(spark, sf):
    last = table(spark, sf, "orders").where("o_orderstatus = 'O'").agg(
        F.max_by("o_orderdate", "o_orderkey").alias("day"), F.max("o_orderkey").alias("n")
    ).first()
    return race.filter_race(derived_month(spark, sf).horses, "O", int(last["day"].strftime("%Y%m%d")), last["n"])


@query("filter_races", f"SELECT h.* FROM ({_HORSE_SQL}) h WHERE EXISTS (SELECT 1 FROM ({_RACE_SQL}) r WHERE r.declared_count = 3 AND r.track = h.track AND r.race_date = h.race_date AND r.race_no = h.race_no)")
def _filter_races(spark, sf):
    m = derived_month(spark, sf)
    return race.filter_races(m.horses, m.races.where("declared_count = 3").select(*race.KEY))


@query(
    "join_race_horses",
    f"""SELECT h.*, r.post_time, r.distance_m, r.weather, r.track_condition, r.declared_count, r.race_name
        FROM ({_HORSE_SQL}) h JOIN ({_RACE_SQL}) r ON h.track = r.track AND h.race_date = r.race_date AND h.race_no = r.race_no""",
)
def _join_race_horses(spark, sf):
    m = derived_month(spark, sf)
    return race.join_race_horses(m.races, m.horses)


_PAYOUT_SQL = " UNION ALL ".join(
    "SELECT {key}, CAST({pos} AS INTEGER) AS pos, '{bet}' AS bet_type, {combo} AS combination, "
    "CAST((o_orderkey * {a} + o_custkey) % 97 * 10 AS INTEGER) AS amount_yen FROM orders "
    "WHERE (o_orderkey * {a} + o_custkey) % 97 > 0 AND {present}".format(
        key=_KEY,
        bet=bet,
        a=slot + 2,
        pos=slot - 1,
        combo=" || '-' || ".join(f"CAST((o_orderkey * {slot} + o_custkey * {j}) % 19 AS VARCHAR)" for j in range(1, len(nums) + 1)),
        present=" AND ".join(f"(o_orderkey * {slot} + o_custkey * {j}) % 19 <> 0" for j in range(1, len(nums) + 1)),
    )
    for slot, (bet, _, nums) in enumerate(payouts.BETS, start=1)
)
# Positions count the paid bets of a race, so the twin renumbers its branches.
_PAYOUT_SQL = (
    "SELECT track, race_date, race_no, CAST(row_number() OVER (PARTITION BY track, race_date, race_no ORDER BY pos) - 1 AS INTEGER) AS pos, "
    f"bet_type, combination, amount_yen FROM ({_PAYOUT_SQL})"
)


def _joined(df):
    return df.withColumn("combination", F.array_join(F.transform("combination", lambda n: n.cast("string")), "-"))


@query("unpivot_payouts", _PAYOUT_SQL)
def _unpivot_payouts(spark, sf):
    return _joined(derived_month(spark, sf).payouts)


@query(
    "join_payback",
    f"""SELECT r.track, r.race_date, r.race_no, CAST(coalesce(n, 0) AS INTEGER) AS n_payouts, coalesce(yen, 0) AS yen
        FROM (SELECT {_KEY} FROM orders) r LEFT JOIN
        (SELECT track, race_date, race_no, count(*) AS n, CAST(sum(amount_yen) AS BIGINT) AS yen FROM ({_PAYOUT_SQL}) WHERE race_no % 5 <> 0 GROUP BY ALL) p
        ON r.track = p.track AND r.race_date = p.race_date AND r.race_no = p.race_no""",
)
def _join_payback(spark, sf):
    m = derived_month(spark, sf)
    some = m.paybacks.where("race_no % 5 <> 0")  # a fifth of the races have no payback here
    paid = race.first_per_key(some).select(*race.KEY, payouts.paid_bets(F.col("slots")).alias("payouts"))
    return race.join_payback(m.races.select(*race.KEY), paid).select(
        *race.KEY,
        F.size("payouts").alias("n_payouts"),
        F.aggregate("payouts", F.lit(0).cast("bigint"), lambda a, p: a + p["amount_yen"]).alias("yen"),
    )


@query("races_without_horses", f"SELECT {_KEY} FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 30)")
def _races_without_horses(spark, sf):
    m = derived_month(spark, sf)
    return race.races_without_horses(m.races, m.horses.where("assigned_weight_kg > 30")).select(*race.KEY)


@query("horses_without_race", f"SELECT * FROM ({_HORSE_SQL}) h WHERE NOT EXISTS (SELECT 1 FROM ({_RACE_SQL}) r WHERE r.declared_count <> 0 AND r.race_no = h.race_no AND r.track = h.track AND r.race_date = h.race_date)")
def _horses_without_race(spark, sf):
    m = derived_month(spark, sf)
    return race.horses_without_race(m.horses, m.races.where("declared_count <> 0"))


@query(
    "first_per_key",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem
       QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_linenumber) = 1""",
)
def _first_per_key(spark, sf):
    order = ["l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_linenumber"]
    return race.first_per_key(table(spark, sf, "lineitem"), ["l_orderkey"], order).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"
    )


@query(
    "entries_with_outcomes",
    f"""WITH h AS (SELECT * FROM ({_HORSE_SQL}))
        SELECT e.track, e.race_date, e.race_no, e.horse_no, e.horse_name, e.jockey, e.assigned_weight_kg, e.body_weight_kg,
               e.archive, e.line_no, CASE WHEN o.finish_position = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label
        FROM h e JOIN h o ON e.track = o.track AND e.race_date = o.race_date AND e.race_no = o.race_no AND e.horse_no = o.horse_no""",
)
def _entries_with_outcomes(spark, sf):
    m = derived_month(spark, sf).kept()
    return race.entries_with_outcomes(m.entries, m.outcomes)


@query("sort_horses", f"SELECT track, race_date, race_no, horse_no, archive, line_no FROM ({_HORSE_SQL}) ORDER BY ALL")
def _sort_horses(spark, sf):
    return race.sort_horses(derived_month(spark, sf).horses).select(*race.KEY, "horse_no", "archive", "line_no")


@query(
    "stable_sort_pairs",
    """SELECT event_type AS key, event_id AS value, row_number() OVER (ORDER BY event_type DESC, event_id) AS pos
       FROM events""",
)
def _stable_sort_pairs(spark, sf):
    from paddock.operators.columns import stable_sort_pairs

    pairs = table(spark, sf, "events").select(
        F.col("event_type").alias("key"), F.col("event_id").alias("value"), F.col("event_id").alias("at")
    )
    return stable_sort_pairs(pairs, descending=True).select("key", "value", "pos")


@query(
    "race_bundle",
    f"""SELECT r.track, r.race_date, r.race_no, CAST(0 AS BIGINT) AS part, CAST(count(*) AS INTEGER) AS n_entries, CAST(count(h.finish_position) AS INTEGER) AS n_finished,
               string_agg(CAST(h.horse_no AS VARCHAR), ',' ORDER BY h.horse_no) AS numbers, r.distance_m,
               CAST(coalesce(max(p.n), 0) AS INTEGER) AS n_payouts, CAST(0 AS BIGINT) AS rejected
        FROM ({_RACE_SQL}) r JOIN ({_HORSE_SQL}) h ON r.race_no = h.race_no AND r.track = h.track AND r.race_date = h.race_date
        LEFT JOIN (SELECT race_no, count(*) AS n FROM ({_PAYOUT_SQL}) GROUP BY race_no) p ON p.race_no = r.race_no
        GROUP BY r.track, r.race_date, r.race_no, r.distance_m""",
)
def _race_bundle(spark, sf):
    b = derived_month(spark, sf).bundles()
    return b.select(
        *race.KEY, "part", F.size("entries").alias("n_entries"),
        F.size(F.filter("outcomes", lambda o: o["finish_position"].isNotNull())).alias("n_finished"),
        F.array_join(F.transform("entries", lambda e: e["horse_no"].cast("string")), ",").alias("numbers"),
        F.col("race.distance_m").alias("distance_m"), F.size("payouts").alias("n_payouts"), "rejected",
    )


_LABEL = "CASE bet_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in bundle.BET_LABELS.items()) + " END"
_CARD_RACE = [
    "'競馬場=' || track || ' 日付=' || CAST(race_date AS VARCHAR) || ' レース=' || CAST(race_no AS VARCHAR) || 'R'",
    *[f"'{label}' || coalesce(CAST({c} AS VARCHAR), '')" for label, c in bundle.RACE_LINE],
]


@query(
    "race_card",
    " UNION ALL ".join(
        f"SELECT track, race_date, race_no, 1 AS section, CAST({i} AS INTEGER) AS pos, {e} AS line FROM ({_RACE_SQL})"
        for i, e in enumerate(_CARD_RACE)
    )
    + f""" UNION ALL SELECT track, race_date, race_no, 2, horse_no, CAST(horse_no AS VARCHAR) || ' ' || horse_name"""
    + "".join(f" || '{label}' || coalesce(CAST({c} AS VARCHAR), '')" for label, c in bundle.HORSE_LINE)
    + f""" FROM ({_HORSE_SQL}) UNION ALL SELECT track, race_date, race_no, 3, pos,
           {_LABEL} || '=' || combination || ' ' || CAST(amount_yen AS VARCHAR) || '円' FROM ({_PAYOUT_SQL})""",
)
def _race_card(spark, sf):
    return derived_month(spark, sf).card()


@query(
    "check_declared_count",
    f"""SELECT {_KEY}, o_orderkey % 8 AS declared_count, coalesce(n, 0) AS horse_rows, o_orderkey % 8 = coalesce(n, 0) AS pass
        FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey""",
)
def _check_declared_count(spark, sf):
    m = derived_month(spark, sf)
    return race.check_declared_count(m.races, m.horses)


@query(
    "check_expected_payouts",
    f"""SELECT track, race_date, race_no, bet_type, combination, e.amount_yen FROM
        (SELECT track, race_date, race_no, bet_type, combination, amount_yen + CAST(CASE WHEN race_no % 3 = 0 THEN 10 ELSE 0 END AS INTEGER) AS amount_yen
         FROM ({_PAYOUT_SQL})) e
        WHERE race_no % 3 = 0 AND NOT EXISTS (SELECT 1 FROM ({_PAYOUT_SQL}) p WHERE p.race_no = e.race_no AND p.bet_type = e.bet_type
              AND p.combination = e.combination AND p.amount_yen = e.amount_yen)""",
)
def _check_expected_payouts(spark, sf):
    paid = derived_month(spark, sf).payouts
    raised = F.when(F.col("race_no") % 3 == 0, 10).otherwise(0)
    expected = paid.withColumn("amount_yen", F.col("amount_yen") + raised).drop("pos")
    return _joined(payouts.check_expected_payouts(expected, paid))


def _zip_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each row's texts as one small archive, so archive queries grow with the table. Archives are
    handed on as soon as they reach the piece size."""
    for frame in frames:
        paths = frame["doc_id"].astype(str)
        start, blobs, held = 0, [], 0
        for text, lang in zip(frame["text"], frame["lang"]):
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("month/", b"")
                z.writestr("month/199808_racelist.csv", "﻿" + text)
                z.writestr("199808_horselist.csv", lang + "\r\n" + text + "\n")
                z.writestr("notes.txt", lang)
            blobs.append(out.getvalue())
            held += len(blobs[-1])
            if held >= arc.PIECE_BYTES:
                yield pd.DataFrame({"path": paths.iloc[start : start + len(blobs)], "content": blobs})
                start, blobs, held = start + len(blobs), [], 0
        yield pd.DataFrame({"path": paths.iloc[start:], "content": blobs})


def _document_archives(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", "lang")
    return d.mapInPandas(_zip_rows, "path string, content binary")


@query(
    "read_archives",
    r"""WITH m AS (SELECT CAST(doc_id AS VARCHAR) AS archive, 'racelist' AS kind, text AS body FROM documents
                   UNION ALL SELECT CAST(doc_id AS VARCHAR), 'horselist', lang || chr(10) || text || chr(10) FROM documents),
             l AS (SELECT archive, kind, regexp_split_to_array(body, '\r\n|\n|\r') AS lines FROM m)
        SELECT archive, '199808' AS yyyymm, kind, CAST(i - 1 AS BIGINT) AS line_no, lines[i] AS line
        FROM l, range(1, 100000) r(i) WHERE i <= len(lines) AND NOT (i = len(lines) AND lines[i] = '' AND i > 1)""",
)
def _read_archives(spark, sf):
    lines = arc.read_archives(_document_archives(spark, sf)).drop("header", "header_line")
    # A text that ends with a line break has an empty last line, which the blank-line rule drops.
    last = lines.groupBy("archive", "kind").agg(F.max("line_no").alias("last"))
    return lines.join(last, ["archive", "kind"]).where(
        ~((F.col("line_no") == F.col("last")) & (F.col("line") == "") & (F.col("line_no") > 0))
    ).drop("last")


@query("archive_errors", "SELECT CAST(doc_id AS VARCHAR) AS archive, 'payback' AS kind, 'payback not found' AS error FROM documents")
def _archive_errors(spark, sf):
    return arc.archive_errors(_document_archives(spark, sf))


_COUNTS_SQL = r"""SELECT CAST(doc_id AS VARCHAR) AS archive,
     CAST(greatest(length(text) - length(replace(text, chr(10), '')) + CASE WHEN right(text, 1) = chr(10) THEN 0 ELSE 1 END - 1, 0) AS BIGINT) AS racelist,
     CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS horselist, CAST(-1 AS BIGINT) AS payback,
     CAST(2 * strlen(text) + 3 + 2 * strlen(lang) + 3 AS BIGINT) AS uncompressed_bytes FROM documents"""


@query("archive_row_counts", _COUNTS_SQL)
def _archive_row_counts(spark, sf):
    c = arc.archive_row_counts(_document_archives(spark, sf))
    return c.select("archive", *[F.col(k).cast("bigint").alias(k) for k in (*arc.KINDS, "uncompressed_bytes")])


@query(
    "archive_manifest_check",
    f"""SELECT archive, racelist, horselist, payback, racelist = horselist - 1 AS pass FROM ({_COUNTS_SQL})""",
)
def _archive_manifest_check(spark, sf):
    c = arc.archive_row_counts(_document_archives(spark, sf))
    expected = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("archive"),
        F.regexp_count("text", F.lit("\n")).cast("bigint").alias("racelist"),
        (F.regexp_count("text", F.lit("\n")) + 1).cast("bigint").alias("horselist"),
        F.lit(-1).cast("bigint").alias("payback"),
    )
    checked = arc.archive_manifest_check(c, expected)
    return checked.select("archive", *[F.col(k).cast("bigint").alias(k) for k in arc.KINDS], "pass")


@query(
    "archive_checksum",
    """SELECT CAST(page_id AS VARCHAR) AS path, sha256(html) AS sha256, CAST(strlen(html) AS BIGINT) AS bytes, page_id % 3 <> 0 AS match FROM pages""",
)
def _archive_checksum(spark, sf):
    pages = table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").cast("binary").alias("content"))
    wrong = F.col("page_id") % 3 == 0
    expected = table(spark, sf, "pages").select(
        F.col("page_id").cast("string").alias("path"),
        F.when(wrong, F.lit("00")).otherwise(F.upper(F.sha2(F.col("html").cast("binary"), 256))).alias("expected_sha256"),
    )
    return arc.archive_checksum(pages, expected).drop("expected_sha256")


@query(
    "missing_columns",
    "SELECT DISTINCT o_orderpriority AS archive, '馬体重' AS \"column\" FROM orders",
)
def _missing_columns(spark, sf):
    t = arc.csv_table(race_csv(spark, sf), ["archive"])
    return arc.missing_columns(t, ["競馬場", "天候", "馬体重"], ["archive"])


@query("entry_rejects", f"SELECT track, race_date, race_no, CASE WHEN horse_no = 3 THEN 'Horse number missing' ELSE 'Horse name missing' END AS reason, line_no FROM ({_HORSE_SQL}) WHERE horse_no = 3 OR jockey IS NULL")
def _entry_rejects(spark, sf):
    h = derived_month(spark, sf).horses
    holed = h.withColumn("horse_name", F.when(F.col("jockey").isNotNull(), F.col("horse_name"))).withColumn(
        "horse_no", F.when(F.col("horse_no") != 3, F.col("horse_no"))
    )
    return race.entry_rejects(holed).select(*race.KEY, "reason", "line_no")


# --- archives as a stream ---


def _monthly_zip(key: tuple, lines: pa.Table) -> pa.Table:
    """One month's lines as an archive of three members, a header line first."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for kind in sorted(pc.unique(lines["kind"]).to_pylist()):
            mine = lines.filter(pc.equal(lines["kind"], kind))
            mine = mine.take(pc.sort_indices(mine, [("line_no", "ascending")]))
            z.writestr(f"{key[0]}/{key[0]}_{kind}.csv", "\n".join([",".join(HEADERS[kind]), *mine["line"].to_pylist()]))
    body = out.getvalue()
    return pa.table({"path": [f"{key[0]}_race.zip"], "length": [len(body)], "content": pa.array([body], pa.binary())})


def monthly_archives(spark, sf):
    """(path, length, content): the rendered lines dealt to one ZIP a month."""
    parts = []
    for kind, lines in (("racelist", race_csv(spark, sf)), ("horselist", horse_csv(spark, sf)), ("payback", payback_csv(spark, sf))):
        day = F.regexp_extract("line", r"(\d{4})/(\d{2})/\d{2}", 0)
        data = lines.where("line_no >= 0").select(F.replace(F.substring(day, 1, 7), F.lit("/"), F.lit("")).alias("month"), F.lit(kind).alias("kind"), "line_no", "line")
        parts.append(data)
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return whole.groupBy("month").applyInArrow(_monthly_zip, "path string, length long, content binary")


@query(
    "stream_archives",
    f"""SELECT CAST(race_date // 100 AS INTEGER) AS yyyymm, track, race_date, race_no, horse_no, horse_name, jockey, assigned_weight_kg, body_weight_kg, finish_position
        FROM ({_HORSE_SQL})""",
)
def _stream_archives(spark, sf):
    """Half of the months arrive, the other half follows; in between the stream stops before it
    has noted its last batch as done, so that batch comes again."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    early = F.pmod(F.xxhash64("path"), F.lit(2)) == 0
    # The archives are made once; each half is then read from its own folder.
    monthly_archives(spark, sf).withColumn("early", early).write.partitionBy("early").parquet(f"{path}/made")
    archives = spark.read.schema("path string, length long, content binary, early boolean").parquet(f"{path}/made")
    for arrived in (F.col("early"), ~F.col("early")):
        archives.where(arrived).drop("early").write.mode("append").parquet(f"{path}/inbox")
        files = spark.readStream.schema(archives.drop("early").schema).option("maxFilesPerTrigger", 4).parquet(f"{path}/inbox")
        streams.store_archives(files, f"{path}/typed", f"{path}/progress").awaitTermination()
        done = sorted(int(n) for n in names_in(spark, f"{path}/progress/commits") if n.isdigit())
        discard(spark, f"{path}/progress/commits/{done[-1]}")
    files = spark.readStream.schema(archives.drop("early").schema).parquet(f"{path}/inbox")
    streams.store_archives(files, f"{path}/typed", f"{path}/progress").awaitTermination()
    return spark.read.parquet(f"{path}/typed/horses").drop("batch", "archive", "line_no")
