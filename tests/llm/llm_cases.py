"""Small inputs with every awkward case, and plain forms of the shared definitions."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
CLASHES = ["score", "held_out", "block", "row", "hub", "shard", "slot", "node", "key", "place", "size", "target", "rank", "__text", "word", "a", "b", "count", "__row", "__play", "__doc", "__times"]


def tokens(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, split at 0x20 and 0x09-0x0D."""
    return (text or "").encode().lower().split()


def fold(value: int | None, parts: int) -> int | None:
    return None if value is None else zlib.crc32(str(value).encode()) % parts


def real_texts(spark: SparkSession, count: int) -> list[tuple]:
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").limit(count).collect()
    return [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in rows]


def messy_rows(spark: SparkSession, count: int = 60) -> list[tuple]:
    rows = real_texts(spark, count)
    base = rows[5][1]
    more = [
        (1000, None, "en", "src1", 0), (1001, "", "en", "src2", 0), (1002, " \t\n ", None, "src3", 4), (1003, "one", "en", None, 3),
        (1004, "only three words", "de", None, 16), (1005, "only three words", None, "src1", 16), (1006, "ONLY\u000bThree  words", "en", "src2", 17),
        (1007, "123 456 !!! 789", "en", "src1", 15), (1008, "é" * 50 + " " + "x" * 9000, "fr", "src2", 9051),
        (1009, " ".join(f"w{i % 997}x{i}" for i in range(40_000)), "en", "src3", 0), (1010, base, "en", "src9", 0),
        (1011, base + " tail", "en", "src9", 0), (rows[5][0], base, rows[5][2], rows[5][3], 0), (None, base, "en", "src1", 0), (None, None, None, None, None),
    ]
    # near copies with one word changed here and there, and copies of one text
    words = rows[7][1].split()
    for k in range(12):
        changed = list(words)
        for at in range(3 * k, len(changed), 97):
            changed[at] = f"edit{k}"
        more.append((1100 + k, " ".join(changed), "en", "src4", 0))
    more += [(1200 + k, "the very same short text again and again", "en", "src0", 0) for k in range(40)]
    return rows + more


def documents(spark: SparkSession, rows: list[tuple], extra: bool = True) -> DataFrame:
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return df.withColumns({c: F.lit(None).cast("string") if k % 2 else F.lit(k) for k, c in enumerate(CLASHES)}) if extra else df


def rows_of(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
