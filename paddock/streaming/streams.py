"""Streams: stateless binning and scoring, archive pick-up, leaf updates per batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from paddock.operators.binning import FeatureBins, bin_table
from paddock.operators.model import Model, load_model, save_model
from paddock.operators.scoring import predict, predict_raw
from paddock.operators.training import TrainParams, refit
from paddock.plans.race_month import RaceMonth, from_archives, from_pieces, write_typed
from paddock.session import names_in
from paddock.sources.archives import dealt_pieces
from paddock.sources.tables import STORED


def stream_bin_append(rows: DataFrame, specs: list[FeatureBins], path: str, checkpoint: str) -> StreamingQuery:
    """Arriving rows binned with frozen bins and appended with their metadata; exactly once."""
    keep = [c for c in rows.columns if c in STORED]
    binned = bin_table(rows, specs, keep, packed=True)
    return (
        binned.writeStream.format("parquet").option("path", f"{path}/binned").option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def stream_score(rows: DataFrame, model: Model, raw: bool = False) -> DataFrame:
    """Arriving rows with their score: generated expressions, no state, no shuffle."""
    return predict_raw(rows, model) if raw else predict(rows, model)


def stream_archives(
    spark: SparkSession, path: str, checkpoint: str, on_month: Callable[[RaceMonth, int], None]
) -> StreamingQuery:
    """New archives in a folder, mapped to typed tables batch by batch."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.zip").load(path)

    def each(batch: DataFrame, batch_id: int) -> None:
        on_month(from_archives(batch.select("path", "length", "content")), batch_id)

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def store_archives(files: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """A stream of archives (path, length, content) to typed tables by batch and month.

    The batch number is a partition that a batch overwrites, so one that comes again after a
    restart takes its own place and no month is stored twice. A batch is unzipped once for its three
    tables: its text pieces are kept, on disk where memory is short, until they are written.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        pieces = dealt_pieces(batch.select("path", "length", "content")).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            write_typed(from_pieces(pieces), out, batch_id)
        finally:
            pieces.unpersist()

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class OnlineRefit:
    """A model whose leaf values follow a stream of labelled rows.

    The model after each batch is saved next to the stream's progress, under the batch's
    number: a restart goes on from the last one, and a batch that comes again starts from the
    model before it, so no batch is lost or counts twice. `model` is the last saved one from the
    start on, also where no new rows arrive.
    """

    def __init__(self, model: Model, params: TrainParams, decay: float = 0.9):
        self.model, self.params, self.decay = model, params, decay

    def start(self, rows: DataFrame, checkpoint: str) -> StreamingQuery:
        spark, first = rows.sparkSession, self.model
        folder = f"{checkpoint}-models"
        saved = [int(n) for n in names_in(spark, folder) if n.isdigit()]
        if saved:
            self.model = load_model(spark, f"{folder}/{max(saved)}")

        def each(batch: DataFrame, batch_id: int) -> None:
            before = load_model(spark, f"{folder}/{batch_id - 1}") if batch_id else first
            self.model = before if batch.isEmpty() else refit(batch, before, self.params, self.decay)
            save_model(spark, self.model, f"{folder}/{batch_id}")

        return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
