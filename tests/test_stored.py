"""What the queries that write and read back return comes from what was stored."""

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

import __spark_entry__ as entry
from paddock.sources import tables


@pytest.mark.parametrize("damage", ["lost", "changed", "bins"])
def test_load_binned_shows_damage(spark, monkeypatch, damage):
    """A loader that loses or changes stored rows, or the bins, changes what the query gives."""
    load = tables.load_binned

    def damaged(*args):
        rows, specs = load(*args)
        if damage == "lost":
            rows = rows.limit(0)
        elif damage == "changed":
            rows = rows.withColumn("bins", F.transform("bins", lambda b: (b + 1).cast("int")))
        else:
            specs[0].bounds[:] = specs[0].bounds[-1:]
        return rows, specs

    query = entry.queries()["load_binned"]
    whole = query(spark, SMALL)
    seen = []
    monkeypatch.setattr(tables, "load_binned", lambda *args: seen.append(damaged(*args)) or seen[0])
    got = query(spark, SMALL)
    assert not got.exceptAll(whole).isEmpty() or not whole.exceptAll(got).isEmpty()
    if damage == "changed":
        held = {r["bins"] for r in got.collect()}
        assert {",".join(map(str, r["bins"])) for r in seen[0][0].collect()} <= held
