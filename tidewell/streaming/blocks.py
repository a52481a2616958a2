"""Blocks from streams (an extension; the batch operators are the basis).

Events are watermarked and deduplicated, grouped to tumbling windows of each
series, and a closed window becomes one row of the block table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewell.functions.exprs import varint_size, zigzag


def window_blocks(stream: DataFrame, series: list[str], ts: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """n_rows, bounds and difference size of the timestamps of each series and window; emitted when the watermark passes it."""
    grouped = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(*series, F.window(ts, width).alias("w"))
    micros = F.sort_array(F.collect_list(F.unix_micros(F.col(ts))))
    out = grouped.agg(F.count("*").alias("n_rows"), F.min(value).alias("least"), F.max(value).alias("most"), micros.alias("_t"))
    # A window of a series is bounded by its width; differences are taken inside the row.
    first = F.transform("_t", lambda x, i: F.when(i > 0, x - F.get("_t", i - 1)))
    second = F.zip_with(F.slice(first, 2, F.size(first)), F.slice(first, 3, F.size(first)), lambda a, b: b - a)
    size = F.aggregate(F.filter(second, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + varint_size(zigzag(x)))
    return out.select(*series, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_rows", "least", "most", F.when(F.col("n_rows") > 1, size + 17).otherwise(9).alias("encoded_bytes"))


def write_stream(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends a stream to a Parquet table, exactly once."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


__all__ = ["window_blocks", "write_stream"]
