"""WARC archives compressed with a dictionary of their own.

Pages are dealt to archives of about `archive_bytes`. Each archive is one task: it renders its
records, trains a Zstandard dictionary on a bounded sample of them, writes the dictionary in a
leading skippable frame (magic 0x184D2A5D) and then every record as a frame of its own, so
single records can be read by offset. Rows are dealt by their file and their place in it, so a task
that runs again deals the same; files get their name only when complete, and an archive that is
there already stays, so a task that runs twice leaves one file. Reading goes through Spark's binary file source and parses the
records as a stream.

Of pages with equal payloads of at least `least_revisit` bytes, that with the largest id is a
response and the others are revisits that refer to it. Only digests that occur more than once
are joined back, so page bodies move once, to their archive.

Defined results: null html is an empty payload. A page without an id is a revisit if a page
with an id has the payload, else a response; its record has no page id. Rows that repeat an id
and payload are alike: all of them are responses if theirs is the largest id. Control
characters in a URL are percent-encoded; a null URL has no target header. An archive whose
records are too few to train on has no dictionary. An empty table writes nothing and reads as
an empty result. Other columns are never read.
"""

from __future__ import annotations

import base64
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.llm.tables import filed, join_small, new_folder, stored
from paddock.session import names_in

# Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, payload binary"
_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())


@dataclass(frozen=True)
class Params:
    archive_bytes: int = 16 << 20
    record_bytes: int = 512  # what a record counts beyond its payload
    least_revisit: int = 0
    dictionary_bytes: int = 64 << 10
    sample_bytes: int = 4 << 20  # of records, for the dictionary
    level: int = 3
    date: str = "2020-01-01T00:00:00Z"
    broadcast_digests: int = 500_000


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """The record of one page: a response, or a revisit without the payload."""
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{url} {digest.hex()}").urn if page_id is None else f"urn:x-page:{page_id}"
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    headers.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(digest).decode()))
    if revisit:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:x-page:{refers_to}>")]
    headers.append(("Content-Type", "application/http;msgtype=response"))
    answer = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return _record(headers, answer + (b"" if revisit else payload))


def train_dictionary(records: list[bytes], params: Params) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from evenly spaced records; None if there is too little to learn."""
    total = sum(map(len, records))
    step = max(1, -(-total // params.sample_bytes))
    sample = [r[: params.sample_bytes // 8] for r in records[::step]]
    try:
        return zstandard.train_dictionary(min(params.dictionary_bytes, max(256, sum(map(len, sample)) // 8)), sample)
    except zstandard.ZstdError:
        return None


def archive(records: list[bytes], params: Params) -> Iterator[bytes]:
    """The pieces of one archive file."""
    learned = train_dictionary(records, params)
    if learned is not None:
        content = learned.as_bytes()
        yield struct.pack("<II", DICTIONARY_FRAME, len(content)) + content
    pack = zstandard.ZstdCompressor(level=params.level, dict_data=learned)
    info = b"software: paddock\r\nformat: WARC File Format 1.1\r\n"
    yield pack.compress(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{uuid.uuid4().urn}>"), ("WARC-Date", params.date), ("Content-Type", "application/warc-fields")], info))
    for record in records:
        yield pack.compress(record)


def _named(header: bytes) -> dict[str, str]:
    lines = header.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def _page_of(value: str | None) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(-?\d+)>", value or "")
    return int(found[1]) if found else None


def read_records(content: bytes) -> Iterator[tuple]:
    """Rows of RECORD_SCHEMA of one archive file."""
    learned, at = None, 0
    if len(content) >= 8 and struct.unpack_from("<I", content)[0] == DICTIONARY_FRAME:
        at = 8 + struct.unpack_from("<I", content, 4)[0]
        learned = zstandard.ZstdCompressionDict(content[8:at])
    stream = zstandard.ZstdDecompressor(dict_data=learned).stream_reader(memoryview(content)[at:], read_across_frames=True)
    buffer = b""
    while True:
        while b"\r\n\r\n" not in buffer:
            more = stream.read(1 << 16)
            if not more:
                if buffer.strip():
                    raise ValueError("archive ends inside a record")
                return
            buffer += more
        header, _, buffer = buffer.partition(b"\r\n\r\n")
        fields = _named(header)
        length = int(fields["content-length"])
        parts, have = [buffer], len(buffer)
        while have < length + 4:
            more = stream.read(max(1 << 16, length + 4 - have))
            if not more:
                raise ValueError("archive ends inside a record")
            parts.append(more)
            have += len(more)
        whole = b"".join(parts)
        block, buffer = whole[:length], whole[length + 4 :]
        if fields["warc-type"] in ("response", "revisit"):
            answer, _, payload = block.partition(b"\r\n\r\n")
            revisit = fields["warc-type"] == "revisit"
            yield (
                _page_of(fields["warc-record-id"]), int(_named(answer)["content-length"]), fields["warc-payload-digest"].removeprefix("sha1:"),
                fields["warc-type"], _page_of(fields.get("warc-refers-to")), fields.get("warc-target-uri"), None if revisit else payload,
            )


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", params: Params = Params()) -> DataFrame:
    """Write `pages` as archives to `folder`, which may hold none yet; returns (file, records, bytes) per archive."""
    spark = pages.sparkSession
    if any(name.endswith(".warc.zst") for name in names_in(spark, folder)):
        raise ValueError(f"{folder} already holds archives")
    held = filed(pages, list(dict.fromkeys([page_id, url, html])))
    payload = F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "UTF-8")
    rows = held.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"),
        F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("place"),
    ).withColumn("digest", F.unhex(F.sha1("payload")))
    same = (
        rows.where(F.octet_length("payload") >= params.least_revisit).groupBy(F.col("digest").alias("of"))
        .agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1 AND largest IS NOT NULL").drop("n")
    )
    total = held.agg(F.sum(F.coalesce(F.octet_length(F.col(html)), F.lit(0)) + F.lit(params.record_bytes).cast("long"))).first()[0] or 0
    archives = max(1, -(-total // params.archive_bytes))
    dealt = join_small(rows, stored(same, "digests"), F.col("digest") == F.col("of"), "left", params.broadcast_digests).select(
        "page_id", "url", "payload", "digest", "largest",
        F.pmod(F.xxhash64("place"), F.lit(archives)).cast("int").alias("archive"),
    )

    def save(group: pa.Table) -> pa.Table:
        number = group["archive"][0].as_py()
        records = [
            page_record(p, u, body, digest, largest, largest is not None and p != largest, params.date)
            for p, u, body, digest, largest in zip(*(group[c].to_pylist() for c in ("page_id", "url", "payload", "digest", "largest")))
        ]
        files, path = pafs.FileSystem.from_uri(folder)
        name = f"part-{number:06d}.warc.zst"
        files.create_dir(path, recursive=True)
        hidden = f"{path}/.{name}.{uuid.uuid4().hex}"
        size = 0
        with files.open_output_stream(hidden) as out:
            for piece in archive(records, params):
                out.write(piece)
                size += len(piece)
        made = files.get_file_info(f"{path}/{name}")
        if made.type == pafs.FileType.NotFound:
            files.move(hidden, f"{path}/{name}")
        else:  # by an attempt before this one, of the same records
            files.delete_file(hidden)
            size = made.size
        return pa.table({"file": [name], "records": pa.array([len(records)], pa.int64()), "bytes": pa.array([size], pa.int64())})

    return dealt.groupBy("archive").applyInArrow(save, "file string, records long, bytes long")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The page records of all archives in `folder` (RECORD_SCHEMA)."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = list(read_records(batch.column(0)[k].as_py()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[c] for f in found], t) for c, t in enumerate(_TYPES)],
                    ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "payload"],
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    return files.select("content").mapInArrow(parse, RECORD_SCHEMA)


def round_trip(pages: DataFrame, params: Params = Params(), **names) -> DataFrame:
    """Write the pages to a new shared folder and read the archives back."""
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    if stored(write(pages, folder, params=params, **names), "manifest").isEmpty():
        return spark.createDataFrame([], RECORD_SCHEMA)
    return read(spark, folder)
