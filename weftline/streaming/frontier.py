"""The frontier as a stream: requests are deduplicated as they come, with state that ends with the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weftline.operators.crawl import with_fingerprint


def deduplicated(requests: DataFrame, at: str = "enqueued_at", delay: str = "1 hour") -> DataFrame:
    """The first request of each fingerprint within ``delay``; those with ``dont_filter`` all pass.

    State is one fingerprint for each key seen within the watermark, whatever came before.
    """
    keyed = with_fingerprint(requests).withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)
    key = F.when(F.coalesce("dont_filter", F.lit(False)), F.concat_ws("#", "fingerprint", F.col("request_id").cast("string"))).otherwise(F.col("fingerprint"))
    return keyed.withColumn("_key", key).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def windowed_counts(responses: DataFrame, at: str = "fetched_at", window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Responses and bytes by window and status; windows close with the watermark."""
    counted = responses.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay).groupBy(F.window(at, window).alias("w"), "status")
    return counted.agg(F.count("*").alias("responses"), F.sum(F.coalesce(F.octet_length("body"), F.lit(0)).cast("long")).alias("bytes")).select(
        F.col("w.start").alias("window_start"), "status", "responses", "bytes"
    )


def run_to_end(stream: DataFrame, sink, checkpoint: str) -> None:
    """Process all that is there now, a batch at a time, into ``sink(batch, number)``; exactly once for idempotent sinks."""
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
