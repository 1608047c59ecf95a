"""CSV line splitting without a UDF.

A quote toggles the quoted state anywhere in a field, a doubled quote inside a quoted
stretch is one quote, and only commas outside quotes separate. Spark's own CSV reader
treats quotes in the middle of a field differently, hence the expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# One field after its separating comma: plain runs and quoted stretches in any order.
_FIELD = r',((?>[^",]++|"(?>[^"]++|"")*+"?+)*+)'


def _unquoted(field: Column) -> Column:
    parts = F.split(field, '"', -1)
    last = F.size(parts) - 1

    def piece(x: Column, i: Column) -> Column:
        escaped = (i % 2 == 0) & (i > 0) & (i < last) & (x == "")
        return F.when(escaped, F.lit('"')).otherwise(x)

    return F.array_join(F.transform(parts, piece), "")


def csv_fields(line: Column) -> Column:
    """The fields of one CSV line as array<string>; nothing is trimmed."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_FIELD), 1)
    careful = F.transform(raw, lambda f: F.when(F.instr(f, '"') == 0, f).otherwise(_unquoted(f)))
    return F.when(F.instr(line, '"') == 0, F.split(line, ",", -1)).otherwise(careful)


def csv_value(fields: Column, header: Column, name: str) -> Column:
    """Field by column name; an unknown column or a short row gives an empty string."""
    position = F.try_element_at(header, F.lit(name))
    return F.coalesce(F.try_element_at(fields, position + 1), F.lit(""))


def csv_values(fields: Column, header: Column, names: list[str]) -> Column:
    """`csv_value` of several columns, as one array."""
    positions = F.array(*[F.try_element_at(header, F.lit(name)) for name in names])
    return F.transform(positions, lambda at: F.coalesce(F.try_element_at(fields, at + 1), F.lit("")))


def header_positions(fields: Column) -> Column:
    """Column name to zero-based position; a repeated name keeps its last position."""
    names = F.transform(fields, lambda x: F.regexp_replace(x, "^﻿", ""))
    indexed = F.transform(names, lambda x, i: F.named_struct(F.lit("key"), x, F.lit("value"), i))
    last = F.filter(
        indexed,
        lambda e: F.size(F.filter(indexed, lambda o: (o["key"] == e["key"]) & (o["value"] > e["value"]))) == 0,
    )
    return F.map_from_entries(last)
