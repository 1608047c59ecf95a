"""Monthly race archives: ZIP files of three CSV members each."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.functions.csv import csv_fields, csv_value, header_positions
from paddock.functions.text import base_name, is_blank
from paddock.session import cut_lineage, parallelism

# Member kinds and the name pattern `{yyyymm}_{kind}.csv`.
KINDS = ("racelist", "horselist", "payback")
MEMBER_NAME = r"^(\d{6})_(racelist|horselist|payback)\.csv$"

LINE_END = r"\r\n|\n|\r"

# What a damaged, cut or encrypted archive or member raises.
BROKEN = (zipfile.BadZipFile, zlib.error, EOFError, OSError, RuntimeError, NotImplementedError)

# Member text leaves the unzip task in pieces of about this size, cut at line ends.
PIECE_BYTES = 4 << 20


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content), one row per archive."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.zip")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "length", "content")
    )


def _wanted_members(content: bytes) -> Iterator[tuple[str, str, zipfile.ZipFile, zipfile.ZipInfo]]:
    with zipfile.ZipFile(io.BytesIO(content)) as bundle:
        for info in bundle.infolist():
            name = re.fullmatch(MEMBER_NAME, info.filename.rsplit("/", 1)[-1])
            if name and not info.is_dir():
                yield name[1], name[2], bundle, info


def _damage(bundle: zipfile.ZipFile, info: zipfile.ZipInfo) -> str | None:
    """What is wrong with a member, from reading it through once: no half member goes out."""
    try:
        with bundle.open(info) as stream:
            while stream.read(PIECE_BYTES):
                pass
    except BROKEN as problem:
        return f"{info.filename}: {problem}"
    return None


def _text_pieces(stream: io.BufferedIOBase) -> Iterator[str]:
    """Decoded text cut after line feeds (or, in texts without any, after a lone return)."""
    rest = b""
    while block := stream.read(PIECE_BYTES):
        rest += block
        cut = rest.rfind(b"\n") + 1
        if not cut:
            cut = rest.rfind(b"\r", 0, len(rest) - 1) + 1
        if cut:
            yield rest[:cut].decode("utf-8", errors="replace")
            rest = rest[cut:]
    yield rest.decode("utf-8", errors="replace")


def _line_ends(text: str) -> int:
    """How often LINE_END is found."""
    return text.count("\n") + text.count("\r") - text.count("\r\n")


def _first_filled(text: str, first_line: int) -> tuple[int | None, str | None]:
    """Line number and text of the first non-blank line, the header of a member."""
    for i, line in enumerate(re.split(LINE_END, text)):
        if line.strip():
            return first_line + i, line
    return None, None


def _unzip(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of `_member_rows`, handed on together until they reach the piece size."""
    columns = ["archive", "yyyymm", "kind", "first_line", "text", "header_line", "header_text", "error"]
    ready: list[tuple] = []
    held = 0
    for row in _member_rows(frames):
        ready.append(row)
        held += 256 + len(row[4] or "")
        if held >= PIECE_BYTES:
            yield pd.DataFrame(ready, columns=columns).astype({"header_line": "Int64"})
            ready, held = [], 0
    if ready:
        yield pd.DataFrame(ready, columns=columns).astype({"header_line": "Int64"})


def _member_rows(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    for frame in frames:
        for archive, content in zip(frame["path"], frame["content"]):
            seen: set[str] = set()
            try:
                for month, kind, bundle, info in _wanted_members(content):
                    seen.add(kind)
                    problem = _damage(bundle, info)
                    if problem:
                        yield (archive, month, kind, 0, None, None, None, problem)
                        continue
                    first_line, header = 0, (None, None)
                    with bundle.open(info) as stream:
                        for text in _text_pieces(stream):
                            if first_line == 0:
                                text = text.removeprefix("﻿")
                            if header[1] is None:
                                header = _first_filled(text, first_line)
                            yield (archive, month, kind, first_line, text, *header, None)
                            first_line += _line_ends(text)
            except BROKEN as problem:
                yield (archive, None, None, 0, None, None, None, str(problem))
                continue
            for kind in KINDS:
                if kind not in seen:
                    yield (archive, None, kind, 0, None, None, None, f"{kind} not found")


def unzip_members(archives: DataFrame) -> DataFrame:
    """(path, content) rows to text pieces; a missing member becomes an error row.

    ZIP is not splittable, so an archive is unzipped by one task, but it leaves that task
    in pieces of a few MB and no member is ever held as one string.
    """
    schema = (
        "archive string, yyyymm string, kind string, first_line long, text string, "
        "header_line long, header_text string, error string"
    )
    return archives.select("path", "content").mapInPandas(_unzip, schema)


def dealt_pieces(archives: DataFrame, partitions: int | None = None) -> DataFrame:
    """The readable text pieces of the archives, dealt out evenly before they are split, so
    one large archive does not keep its lines on one executor."""
    n = partitions or parallelism(archives.sparkSession)
    return unzip_members(archives).where(F.col("error").isNull()).repartition(n)


def piece_lines(pieces: DataFrame) -> DataFrame:
    """Pieces to lines: (archive, yyyymm, kind, line_no, line, header_line, header).

    Every piece carries its member's header, worked out once per piece, so parsing the lines
    needs no join with their header row.
    """
    # A piece ends with its last line break, which must not open a further line.
    body = F.regexp_replace("text", r"(\r\n|\n|\r)\z", "")
    lines = F.when(F.col("text") == "", F.array(F.lit(""))).otherwise(F.split(body, LINE_END, -1))
    file = ["archive", "yyyymm", "kind"]
    header = header_positions(csv_fields(F.col("header_text"))).alias("header")
    # Beside the generator the header would be worked out anew for every line.
    headed = pieces.select(*file, "first_line", "header_line", "text", header)
    return headed.select(
        *file, "first_line", "header_line", "header", F.posexplode(lines).alias("pos", "line")
    ).select(*file, (F.col("first_line") + F.col("pos")).alias("line_no"), "line", "header_line", "header")


def read_archives(archives: DataFrame, partitions: int | None = None) -> DataFrame:
    """Archives to lines: (archive, yyyymm, kind, line_no, line, header_line, header)."""
    return piece_lines(dealt_pieces(archives, partitions))


def archive_errors(archives: DataFrame) -> DataFrame:
    """(archive, kind, error) for missing members and unreadable archives."""
    return unzip_members(archives).where(F.col("error").isNotNull()).select("archive", "kind", "error")


# Most files whose headers are broadcast; a header is a few KB at most.
MAX_BROADCAST_FILES = 10_000


def with_headers(lines: DataFrame, file_columns: list[str]) -> DataFrame:
    """Add (header_line, header) to bare lines: the first non-blank line of each file.

    The header is found by an aggregate, which combines before its shuffle, not by a
    window over the file: a file may hold a large share of all lines. The headers are
    broadcast when counted to be few, else joined by Spark's own choice.
    """
    filled = lines.where(~is_blank(F.col("line")))
    headers = filled.groupBy(*file_columns).agg(
        F.min("line_no").alias("header_line"), F.min_by("line", "line_no").alias("header_text")
    )
    named = cut_lineage(headers).select(
        *file_columns, "header_line", header_positions(csv_fields(F.col("header_text"))).alias("header")
    )
    few = named.limit(MAX_BROADCAST_FILES + 1).count() <= MAX_BROADCAST_FILES
    return lines.join(F.broadcast(named) if few else named, file_columns)


def csv_table(lines: DataFrame, file_columns: list[str]) -> DataFrame:
    """Lines to (file columns, line_no, header, fields): blank lines go, the first other
    line of a file is its header. A file with no such line gives no rows; see
    `empty_tables` for those. Lines that carry their header are parsed in place.
    """
    headed = lines if "header" in lines.columns else with_headers(lines, file_columns)
    return headed.where(~is_blank(F.col("line")) & (F.col("line_no") > F.col("header_line"))).select(
        *file_columns, "line_no", "header", csv_fields(F.col("line")).alias("fields")
    )


def empty_tables(lines: DataFrame, file_columns: list[str]) -> DataFrame:
    """Files without any non-blank line, which the reader treats as an error."""
    filled = F.count_if(~is_blank(F.col("line")))
    return lines.groupBy(*file_columns).agg(filled.alias("filled")).where("filled = 0").drop("filled")


def named_columns(table: DataFrame, names: dict[str, str], keep: list[str]) -> DataFrame:
    """Project named CSV columns of a `csv_table` to string columns {output: csv name}."""
    return table.select(
        *keep, *[csv_value(F.col("fields"), F.col("header"), src).alias(out) for out, src in names.items()]
    )


def missing_columns(table: DataFrame, names: list[str], file_columns: list[str]) -> DataFrame:
    """(file columns, column) for expected columns a file does not have; a renamed column
    would otherwise read as empty text without notice."""
    headers = table.groupBy(*file_columns).agg(F.any_value("header").alias("header"))
    wanted = F.array(*[F.lit(n) for n in names])
    absent = F.filter(wanted, lambda n: ~F.map_contains_key(F.col("header"), n))
    return headers.select(*file_columns, F.explode(absent).alias("column"))


def _entry_counts(content: bytes) -> Iterator[tuple[str, int, bool, int]]:
    """(entry, newlines, open_end, bytes) of each readable file in an archive."""
    with zipfile.ZipFile(io.BytesIO(content)) as bundle:
        for info in bundle.infolist():
            if info.is_dir() or _damage(bundle, info):
                continue
            newlines, last, size = 0, b"", 0
            with bundle.open(info) as stream:
                while block := stream.read(PIECE_BYTES):
                    newlines += block.count(b"\n")
                    last, size = block[-1:], size + len(block)
            yield info.filename, newlines, last not in (b"", b"\n"), size


# (archive, entry, newlines, open_end, bytes) of `_count_members`.
_COUNTED = pa.schema([("archive", pa.string()), ("entry", pa.string()), ("newlines", pa.int64()), ("open_end", pa.bool_()), ("bytes", pa.int64())])


def _count_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Archives leave their Arrow batch one at a time, so no batch is held twice."""
    for batch in batches:
        out = []
        for archive, content in zip(batch.column(0), batch.column(1)):
            try:
                found = list(_entry_counts(content.as_py()))
            except BROKEN:
                found = []
            out += [(archive.as_py(), *counts) for counts in found or [("", 0, False, 0)]]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _COUNTED.types)], schema=_COUNTED)


def archive_row_counts(archives: DataFrame) -> DataFrame:
    """(archive, racelist, horselist, payback, uncompressed_bytes).

    A member counts its line feeds, one more when its last line is open, less the header,
    at least zero; an absent or damaged member is -1, as are all of an unreadable archive.
    """
    schema = "archive string, entry string, newlines long, open_end boolean, bytes long"
    members = archives.select("path", "content").mapInArrow(_count_members, schema)
    kind = F.regexp_extract(base_name(F.col("entry")), MEMBER_NAME, 2)
    rows = F.greatest(F.col("newlines") + F.col("open_end").cast("long") - 1, F.lit(0))
    return (
        members.withColumn("kind", kind)
        .withColumn("data_rows", rows)
        .groupBy("archive")
        .agg(
            *[
                F.coalesce(F.max(F.when(F.col("kind") == k, F.col("data_rows"))), F.lit(-1)).alias(k)
                for k in KINDS
            ],
            F.sum("bytes").alias("uncompressed_bytes"),
        )
    )


def archive_manifest_check(counts: DataFrame, expected: DataFrame) -> DataFrame:
    """Counts against an expected table (archive, racelist, horselist, payback)."""
    want = expected.select("archive", *[F.col(k).alias(f"expected_{k}") for k in KINDS])
    same = [F.coalesce(F.col(k) == F.col(f"expected_{k}"), F.lit(False)) for k in KINDS]
    return want.join(counts, "archive", "left").withColumn("pass", same[0] & same[1] & same[2])


def archive_checksum(files: DataFrame, expected: DataFrame) -> DataFrame:
    """SHA-256 and size of each file against (path, expected_sha256), ignoring case."""
    sums = files.select("path", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("bytes"))
    match = F.coalesce(F.lower("sha256") == F.lower("expected_sha256"), F.lit(False))
    return sums.join(expected, "path", "left").withColumn("match", match)
