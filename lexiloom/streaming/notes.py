"""Corrections of notes as they arrive. An extension: the application this serves has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexiloom.operators import correct


def corrected_stream(arriving: DataFrame, r: correct.Resources, s: correct.Settings, to: str, checkpoint: str, keys: tuple[str, ...] = ("doc_id",)) -> StreamingQuery:
    """Each micro-batch of a stream (keys, text) is corrected as a batch and written to a folder
    of its own; a batch that is run again replaces its folder, so every note is there once."""

    def write(batch: DataFrame, number: int) -> None:
        correct.fix_all(batch.select(*keys, "text"), r, s, keys).write.mode("overwrite").parquet(f"{to}/batch={number}")

    return arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def word_counts(arriving: DataFrame, ts: str = "ts", late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Words of a stream (ts, text) by tumbling window; late ones are taken up to the watermark."""
    from lexiloom.operators.tokenize import words

    return words(arriving.withWatermark(ts, late), (ts,)).groupBy(F.window(ts, window), F.lower("word").alias("word")).agg(F.count(F.lit(1)).alias("n"))
