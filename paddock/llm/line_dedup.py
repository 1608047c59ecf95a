"""Removal of lines that other documents hold too, with levelled sorted runs of line hashes.

Documents are taken in batches of growing id. The distinct line hashes of a batch are
anti-joined with the runs of earlier batches; what is left is new, is written as a sorted run
of its own with the smallest id that holds it, and joins the runs. When a level has `fanout`
runs they are merged into one of the next level, so few runs are open at any time and a hash
is rewritten once per level. Runs are bucketed by hash: a batch is shuffled once, the runs not
at all. An occurrence stays if its hash is new in its batch and its document is the smallest.

Hashes have 128 bits. Hashes are combined before they are shuffled; a hash with more than a
thousandth of a batch's lines, of which there are fewer than a thousand, is settled by a
broadcast instead of a shuffle of its lines. Only places of dropped lines come back to the texts, which
move once. Everything is built of DataFrame functions.

Defined results: a null or empty text is one empty line. Rows that share an id are one document:
none of them loses a line to another of them. A null id counts as one more id, the largest
of all. Keys shorter than `least_chars` never make a line go. A document may lose all lines; its kept text is then
empty. Repeated rows give repeated results. An empty table gives an empty result. Other columns
are never read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.llm.tables import discard, new_folder
from paddock.session import parallelism

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPACES = " \t\n\x0b\x0c\r"
HASH = ["h1", "h2"]
_HOT_SHARE = 1000


@dataclass(frozen=True)
class Params:
    least_chars: int = 10
    batches: int = 6
    fanout: int = 3


def lowered(text: Column) -> Column:
    """A-Z lower-cased; plain ASCII takes the quick way to the same result."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def _two_hashes(value: Column) -> list[Column]:
    return [F.xxhash64(value), F.xxhash64(F.lit(0x5EED), value)]


@dataclass
class Runs:
    """Levelled sorted runs of (h1, h2, owner), each bucketed and sorted by hash."""

    spark: SparkSession
    fanout: int = 3
    buckets: int = 0
    levels: list[list[str]] = field(default_factory=list)
    paths: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.buckets = self.buckets or parallelism(self.spark)

    def tables(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = new_folder(self.spark, name)
        dealt = rows.select(*HASH, "owner").repartition(self.buckets, *HASH)
        dealt.write.format("parquet").bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", self.paths[name]).saveAsTable(name)
        return name

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The keys that no run holds: one merge anti-join per run."""
        for name in self.tables():
            keys = keys.join(self.spark.table(name).select(*HASH).hint("merge"), HASH, "left_anti")
        return keys

    def add(self, rows: DataFrame) -> str:
        """A run of level 0; returns its name. Its hashes must be in no other run."""
        name = self._write(rows)
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(name)
        return name

    def compact(self) -> None:
        """Merge every full level into one run of the next."""
        at = 0
        while at < len(self.levels):
            if len(self.levels[at]) >= self.fanout:
                whole = self.spark.table(self.levels[at][0])
                for name in self.levels[at][1:]:
                    whole = whole.unionAll(self.spark.table(name))
                merged = self._write(whole)
                for name in self.levels[at]:
                    self._drop(name)
                self.levels[at] = []
                if at + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[at + 1].append(merged)
            at += 1

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        discard(self.spark, self.paths.pop(name))

    def close(self) -> None:
        """Drop all runs."""
        for name in self.tables():
            self._drop(name)
        self.levels = []


def occurrences(docs: DataFrame, doc_id: str, text: str, params: Params) -> DataFrame:
    """(doc_id, t1, t2, place, h1, h2) of every line whose key is long enough.

    t1 and t2 tell texts apart: what goes depends on id and text alone.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole.alias("body"))
    t1, t2 = _two_hashes(F.col("body"))
    lines = named.select("doc_id", t1.alias("t1"), t2.alias("t2"), F.posexplode(F.split(lowered(F.col("body")), "\n", -1)).alias("place", "line"))
    keyed = lines.select("doc_id", "t1", "t2", "place", F.btrim("line", F.lit(_SPACES)).alias("key")).where(F.char_length("key") >= params.least_chars)
    h1, h2 = _two_hashes(F.col("key"))
    return keyed.select("doc_id", "t1", "t2", "place", h1.alias("h1"), h2.alias("h2"))


def _batch_of(docs: DataFrame, doc_id: str, batches: int) -> Column:
    """Batch number by id; limits are approximate, which moves work, never results."""
    cuts = docs.select(F.percentile_approx(F.col(doc_id).cast("long"), [k / batches for k in range(1, batches)], 1000)).first()[0] if batches > 1 else None
    above = [F.when(F.col("doc_id") > F.lit(c), 1).otherwise(0) for c in sorted(set(cuts or []))]
    # A null id is the largest and belongs to the last batch.
    return F.when(F.col("doc_id").isNull(), len(above)).otherwise(sum(above, F.lit(0))).cast("int")


def dropped_places(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", params: Params = Params()) -> DataFrame:
    """(doc_id, t1, t2, place) of every line that goes."""
    spark = docs.sparkSession
    lines_at, dropped_at = new_folder(spark, "lines"), new_folder(spark, "dropped")
    lines = occurrences(docs, doc_id, text, params)
    lines.withColumn("batch", _batch_of(docs, doc_id, params.batches)).write.partitionBy("batch").parquet(lines_at)
    stored = spark.read.schema(f"{', '.join(f'{n} {t}' for n, t in lines.dtypes)}, batch int").parquet(lines_at)
    counts = {r["batch"]: r["n"] for r in stored.groupBy("batch").agg(F.count("*").alias("n")).collect()}  # a row a batch
    runs = Runs(spark, params.fanout)
    result = "doc_id long, t1 long, t2 long, place int"
    if not counts:
        discard(spark, lines_at)
        return spark.createDataFrame([], result)
    for number in sorted(counts):
        batch = stored.where(F.col("batch") == number).drop("batch")
        keys = batch.groupBy(*HASH).agg(F.min("doc_id").alias("owner"), F.count("*").alias("n"))
        many = F.col("n") > counts[number] // _HOT_SHARE + 100
        fresh = spark.table(runs.add(runs.unseen(keys)))
        # Fewer than _HOT_SHARE hashes can each have more than that share of the lines.
        hot = keys.where(many).select(*HASH).join(fresh.select(*HASH, "owner", F.lit(True).alias("new")), HASH, "left")
        frozen = [tuple(r) for r in hot.collect()]
        hot = spark.createDataFrame(frozen, "h1 long, h2 long, owner long, new boolean")
        stays = F.coalesce(F.col("new"), F.lit(False)) & F.col("doc_id").eqNullSafe(F.col("owner"))
        often = batch.join(F.broadcast(hot), HASH).where(~stays)
        rest = batch.join(F.broadcast(hot.select(*HASH)), HASH, "left_anti")
        rare = rest.join(fresh.select(*HASH, "owner", F.lit(True).alias("new")).hint("merge"), HASH, "left").where(~stays)
        columns = ["doc_id", "t1", "t2", "place"]
        often.select(*columns).unionAll(rare.select(*columns)).write.mode("append").parquet(dropped_at)
        if number != max(counts):
            runs.compact()
    runs.close()
    discard(spark, lines_at)
    return spark.read.schema(result).parquet(dropped_at)


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", params: Params = Params()) -> DataFrame:
    """(doc_id, kept_text, n_lines, n_dropped), a row per row of `docs`."""
    places = dropped_places(docs, doc_id, text, params)
    gone = places.groupBy("doc_id", "t1", "t2").agg(F.array_sort(F.collect_set("place")).alias("gone"))
    gone = gone.select(F.col("doc_id").alias("g_id"), F.col("t1").alias("g1"), F.col("t2").alias("g2"), "gone")
    t1, t2 = _two_hashes(F.col("body"))
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    found = named.withColumns({"t1": t1, "t2": t2}).join(gone, F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("t1") == F.col("g1")) & (F.col("t2") == F.col("g2")), "left")

    def between(row: Column) -> Column:
        """The lines between dropped places: one slice per gap, so the work is linear."""
        ends = F.concat(row["gone"], F.array(F.size(row["lines"])))
        return F.transform(ends, lambda end, k: _gap(row, end, k))

    def _gap(row: Column, end: Column, k: Column) -> Column:
        start = F.when(k == 0, F.lit(0)).otherwise(F.get(row["gone"], k - 1) + 1)
        return F.slice(row["lines"], start + 1, end - start)

    # The one-row array binds lines and places once; inside a lambda they would be split anew for each gap.
    bound = F.array(F.struct(F.split("body", "\n", -1).alias("lines"), F.col("gone").alias("gone")))
    kept = F.transform(bound, lambda row: F.array_join(F.flatten(between(row)), "\n"))[0]
    newlines = F.octet_length("body") - F.octet_length(F.replace(F.col("body"), F.lit("\n"), F.lit("")))
    return found.select(
        "doc_id", F.when(F.col("gone").isNull(), F.col("body")).otherwise(kept).alias("kept_text"),
        (newlines + 1).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def dedup_digest(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256)."""
    kept = dedup(docs, params=params)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
