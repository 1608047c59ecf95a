"""Mixing sources to target weights with a low-discrepancy schedule.

1. Targets: sources in code point order weigh 5, 2, 1, repeating. They share the words of the
   mix by weight; no source plays more than `most_repeats` times its own size, and what it
   cannot take is shared by the others. With sources sorted by limit over weight, the common
   level is the largest of (words left) / (weight left), so no loop is needed.
2. Blocks: each source's documents, in an order drawn by hash, form one stream of words that
   is cut into blocks of equal length.
3. Schedule: slot i of the mix lies at the fractional part of i times the golden ratio, mapped
   through the cumulative targets to a source. Any stretch of the schedule is close to the
   target shares. Slots are ranked within their source, and rank k plays block k modulo the
   source's number of blocks, in pass k // number of blocks.
4. Joining slots and blocks says how often each block, and so each word, is played.

Everything is DataFrame functions. Ranks are counted per chunk of the schedule, running word
counts per range of the stream, so a source of any share spreads over many tasks.

Defined results: a null or blank text has size 0 and nothing of it is taken. A null source is
a source of its own, the last. Rows with a null id and repeated rows are rows like others. An
empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paddock.llm.tables import identified, stored, times_of_rows
from paddock.operators.prefix import running_totals

_BUCKETS = 4096
_CHUNK = 1 << 16
_GOLDEN = 2654435769  # 2**32 over the golden ratio, odd


@dataclass(frozen=True)
class Params:
    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.0  # of all words
    most_repeats: int = 3
    block_words: int = 64  # at most; short sources are cut into `least_blocks` where they can be
    least_blocks: int = 1024
    seed: int = 17


def word_count(text: Column) -> Column:
    """Number of runs of bytes other than 0x20 and 0x09-0x0D; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, params: Params = Params()) -> DataFrame:
    """(source, place, source_size, target, block, blocks), one row per source.

    The windows here run over one row per source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    cycle = F.array(*[F.lit(float(w)) for w in params.weights])
    placed = by_source.withColumn("place", F.row_number().over(W.orderBy(F.asc_nulls_last("source"))))
    weighed = placed.withColumn("weight", F.element_at(cycle, F.pmod(F.col("place") - 1, F.lit(len(params.weights))) + 1)).withColumn(
        "limit", F.col("source_size") * float(params.most_repeats)
    )
    order = W.orderBy(F.col("limit") / F.col("weight"), "place")
    every = W.partitionBy()
    level = weighed.withColumn("total", F.sum("source_size").over(every) * params.share).withColumn(
        "level",
        (F.col("total") - F.coalesce(F.sum("limit").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        / F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)),
    )
    block = F.greatest(F.lit(1), F.least(F.lit(params.block_words), F.floor(F.col("source_size") / params.least_blocks))).cast("long")
    return (
        level.withColumn("target", F.least("limit", F.max("level").over(every) * F.col("weight")))
        .withColumn("block", block)
        .select("source", "place", "source_size", "target", "block", F.ceil(F.col("source_size") / F.col("block")).cast("long").alias("blocks"))
    )


def schedule(goals: DataFrame, params: Params = Params()) -> DataFrame:
    """(slot, place, pass, block_no): the block that each slot of the mix plays."""
    spark = goals.sparkSession
    every = W.partitionBy()
    slots = F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(F.lit(0.0))
    shares = goals.select("place", "blocks", slots.alias("slots"))
    shares = shares.withColumn("all", F.sum("slots").over(every))
    upto = F.sum("slots").over(W.orderBy("place").rowsBetween(W.unboundedPreceding, 0))
    lines = shares.withColumn("high", F.try_divide(upto, "all")).withColumn("low", F.coalesce(F.lag("high").over(W.orderBy("place")), F.lit(0.0))).where("high > low")
    # The last source's line ends at 1 whatever the rounding of the sums.
    lines = lines.withColumn("high", F.when(F.col("place") == F.max("place").over(every), F.lit(1.0)).otherwise(F.col("high")))
    count = lines.agg(F.max("all")).first()[0]
    count = 0 if count is None else int(round(count))
    # The unit interval in buckets: a slot's bucket leads to the few sources that reach into it.
    lookup = lines.select(
        "place", "blocks", "low", "high",
        F.explode(F.sequence(F.floor(F.col("low") * _BUCKETS), F.least(F.floor(F.col("high") * _BUCKETS), F.lit(_BUCKETS - 1)))).alias("bucket"),
    )
    turn = F.pmod(F.pmod(F.col("slot"), F.lit(1 << 31)) * F.lit(_GOLDEN) + F.lit(1 << 31), F.lit(1 << 32))
    points = spark.range(count).withColumnRenamed("id", "slot").withColumn("point", turn / float(1 << 32))
    dealt = (
        points.withColumn("bucket", F.floor(F.col("point") * _BUCKETS)).join(lookup, "bucket")
        .where("point >= low AND point < high")
        .select("slot", "place", "blocks", F.floor(F.col("slot") / _CHUNK).alias("chunk"))
    )
    counts = dealt.groupBy("place", "chunk").agg(F.count("*").alias("here"))
    before = counts.select(
        "place", "chunk", F.coalesce(F.sum("here").over(W.partitionBy("place").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before")
    )
    rank = F.col("before") + F.row_number().over(W.partitionBy("place", "chunk").orderBy("slot")) - 1
    ranked = dealt.join(before, ["place", "chunk"]).withColumn("rank", rank).where(F.col("rank") < params.most_repeats * F.col("blocks"))
    return ranked.select("slot", "place", F.floor(F.col("rank") / F.col("blocks")).alias("pass"), F.pmod("rank", "blocks").alias("block_no"))


def _streamed(docs: DataFrame, text: str, source: str, doc_id: str, params: Params, row: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents with their place in the stream of their source, and the sources' targets.

    `row` is a number for each row that stays the same, where the caller needs one.
    """
    sizes = stored(
        docs.select(
            F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"),
            (F.monotonically_increasing_id() if row is None else row).alias("row"),
        ),
        "sizes",
    )
    goals = stored(targets(sizes, params), "targets")
    placed = sizes.alias("s").join(goals.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source"))).select(
        "row", "doc_id", "size", "place", "source_size", "target", "block"
    )
    shuffled = [F.xxhash64("doc_id", F.lit(params.seed)), F.col("doc_id"), F.col("size"), F.col("row")]
    # `row` only parts rows that are alike in everything the mix looks at
    run = running_totals(placed, ["place"], shuffled, {"until": F.col("size")})
    return stored(run.withColumn("from", F.col("until") - F.col("size")), "stream"), goals


def _plays(goals: DataFrame, params: Params) -> DataFrame:
    """How often the schedule plays each block of each source."""
    return schedule(goals, params).groupBy("place", "block_no").agg(F.count("*").alias("plays"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", params: Params = Params()) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of `docs`."""
    stream, goals = _streamed(docs, text, source, doc_id, params)
    first, last = F.floor(F.col("from") / F.col("block")), F.floor((F.col("until") - 1) / F.col("block"))
    pieces = stream.where("size > 0").withColumn("block_no", F.explode(F.sequence(first, last)))
    words = F.least("until", (F.col("block_no") + 1) * F.col("block")) - F.greatest("from", F.col("block_no") * F.col("block"))
    taken = pieces.join(_plays(goals, params), ["place", "block_no"]).groupBy("row").agg(F.sum(words * F.col("plays")).alias("taken"))
    return stream.join(taken, "row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def mixed_documents(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", params: Params = Params()) -> DataFrame:
    """The mix as whole documents: a document comes as often as the block with its first word
    is played (0 to `most_repeats` times). Each row counts by itself, whatever its id."""
    rows = identified(docs)
    narrow = rows.select("__row", *[F.col("__doc")[c].alias(c) for c in dict.fromkeys((text, source, doc_id))])
    stream, goals = _streamed(narrow, text, source, doc_id, params, F.col("__row"))
    starts = stream.where("size > 0").withColumn("block_no", F.floor(F.col("from") / F.col("block")))
    plays = starts.join(_plays(goals, params), ["place", "block_no"]).select(F.col("row").alias("__row"), F.col("plays").cast("int").alias("__plays"))
    marks = stored(plays.select("__row", F.col("__plays").alias("times")), "plays")
    kept = times_of_rows(rows, marks, params.most_repeats).where("__times > 0")
    return kept.select("__doc", F.explode(F.sequence(F.lit(1), F.col("__times"))).alias("__play")).select("__doc.*")
