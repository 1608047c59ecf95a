"""Training tables in and out: delimited text, binned tables, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.functions.text import numeric_token
from paddock.operators.binning import FeatureBins, bin_table, collect_spec
from paddock.session import discard, exists

# The columns a binned table keeps. Starting scores are not stored.
STORED = ("row_id", "label", "weight", "group_id", "position")


def detect_format(lines: list[str]) -> str:
    """csv, tsv or libsvm, from a few lines: the mark found most consistently."""
    pairs = sum(sum(":" in t for t in line.split()[1:]) for line in lines)
    if pairs and all(all(":" in t for t in line.split()[1:]) for line in lines if len(line.split()) > 1):
        return "libsvm"
    return "tsv" if sum(line.count("\t") for line in lines) > sum(line.count(",") for line in lines) else "csv"


def _resolve(role: str | int | None, header: list[str] | None, label_at: int) -> int | None:
    """`name:x` by header, else an index; indices other than the label's skip the label column."""
    if role is None:
        return None
    if isinstance(role, str) and role.startswith("name:"):
        if header is None or role[5:] not in header:
            raise ValueError(f"no column {role}")
        return header.index(role[5:])
    i = int(role)
    return i + (label_at >= 0 and i >= label_at)


def read_training_table(
    spark: SparkSession, path: str, header: bool = False, label: str | int = 0, weight: str | int | None = None,
    group: str | int | None = None, ignore: list[str | int] = (), fmt: str | None = None,
    row_id: bool = False,
) -> tuple[DataFrame, DataFrame, list[str]]:
    """(rows, rejects, feature names) of delimited text.

    Rows have label, optional weight and group_id, and double features; a row with a token
    that is no number goes to the rejects, whole. With `row_id`, which sampling, bagging and
    renewed leaves need, rows get a hash of their tokens: the same on every read, and equal
    for equal lines. Name the format in `fmt` (csv, tsv or
    libsvm) where it is known; else it is told from the first 20 lines.
    """
    head = [r["value"] for r in spark.read.text(path).limit(20).collect()]
    fmt = fmt or detect_format(head[1:] if header else head)
    if fmt == "libsvm":
        from pyspark.ml.functions import vector_to_array

        df = spark.read.format("libsvm").load(path).select("label", vector_to_array("features").alias("f"))
        width = df.select(F.size("f").alias("n")).first()["n"]
        names = [f"Column_{i}" for i in range(width)]
        rows = df.select(*([F.xxhash64("label", "f").alias("row_id")] if row_id else []), "label", *[F.col("f")[i].alias(n) for i, n in enumerate(names)])
        return rows, rows.limit(0), names
    sep = "\t" if fmt == "tsv" else ","
    raw = spark.read.option("sep", sep).option("header", header).option("inferSchema", False).csv(path)
    columns = raw.columns
    titles = columns if header else None
    if isinstance(label, str) and label.startswith("name:"):
        label_at = columns.index(label[5:])
    else:
        label_at = int(label)
    at = {"weight": _resolve(weight, titles, label_at), "group_id": _resolve(group, titles, label_at)}
    out_of = {label_at, *[i for i in at.values() if i is not None], *[_resolve(i, titles, label_at) for i in ignore]}
    features = [c for i, c in enumerate(columns) if i not in out_of]
    names = features if header else [f"Column_{columns.index(c)}" for c in features]
    read = F.struct(
        *[F.col(f"`{c}`").alias(f"__raw_{i}") for i, c in enumerate(columns)],
        numeric_token(F.col(f"`{columns[label_at]}`")).alias("label"),
        *[numeric_token(F.col(f"`{columns[i]}`")).alias(role) for role, i in at.items() if i is not None],
        *[numeric_token(F.col(f"`{c}`")).alias(n) for c, n in zip(features, names)],
    )
    # A generator of one row, below which no condition is pushed: each token is read once.
    typed = raw.select(F.inline(F.array(read)))
    wanted = ["label", *[r for r, i in at.items() if i is not None], *names]
    bad = F.lit(False)
    for c in wanted:
        bad = bad | F.col(f"`{c}`").isNull()
    rejects = typed.where(bad).select(*[F.col(f"__raw_{i}").alias(c) for i, c in enumerate(columns)])
    named = [F.xxhash64(*[F.col(f"__raw_{i}") for i in range(len(columns))]).alias("row_id")] if row_id else []
    return typed.where(~bad).select(*named, *[F.col(f"`{c}`") for c in wanted]), rejects, names


def save_binned(binned: DataFrame, spec: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Binned rows and their bin table as Parquet. Starting scores are left out."""
    keep = [c for c in binned.columns if c in STORED or c == "bins"]
    binned.select(*keep).write.mode(mode).parquet(f"{path}/binned")
    if mode == "overwrite":
        spec.write.mode("overwrite").parquet(f"{path}/bin_spec")


def load_binned(spark: SparkSession, path: str) -> tuple[DataFrame, list[FeatureBins]]:
    return spark.read.parquet(f"{path}/binned"), collect_spec(spark.read.parquet(f"{path}/bin_spec"))


def push_block(block: DataFrame, specs: list[FeatureBins], path: str, number: int) -> None:
    """Bin a block of rows with frozen bins and store it, with its metadata columns, under its number.

    A block counts once its entry in the log is written, which is last. A block that comes
    again takes the place of the one before, so a push may be repeated after any failure.
    """
    spark = block.sparkSession
    if exists(spark, f"{path}/finished"):
        raise ValueError(f"{path} is finished: no block can be added")
    keep = [c for c in block.columns if c in STORED]
    discard(spark, f"{path}/log/{number}")
    bin_table(block, specs, keep, packed=True).write.mode("overwrite").parquet(f"{path}/blocks/{number}")
    rows = spark.read.parquet(f"{path}/blocks/{number}").count()
    spark.createDataFrame([(number, rows)], "block long, rows long").coalesce(1).write.mode("overwrite").parquet(f"{path}/log/{number}")


def block_log(spark: SparkSession, path: str) -> DataFrame:
    """(block, rows) of the blocks that count."""
    return spark.read.schema("block long, rows long").parquet(f"{path}/log/*")


def finish_blocks(spark: SparkSession, path: str, blocks: int) -> None:
    """Close a set of blocks 0 to `blocks` - 1; an error names those that are missing."""
    found = {r["block"] for r in block_log(spark, path).collect()}  # a row a block
    if missing := sorted(set(range(blocks)) - found):
        raise ValueError(f"blocks missing: {missing[:20]}")
    block_log(spark, path).coalesce(1).write.mode("overwrite").parquet(f"{path}/finished")


def load_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the blocks that count, and of no others."""
    found = sorted(r["block"] for r in block_log(spark, path).collect())  # a row a block
    return spark.read.parquet(*[f"{path}/blocks/{b}" for b in found])


def save_scores(scored: DataFrame, path: str, columns: list[str], fmt: str = "parquet") -> None:
    scored.select(*columns).write.mode("overwrite").format(fmt).save(path)
