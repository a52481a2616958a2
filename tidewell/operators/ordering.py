"""Rows of a series have an order only by a key.  These operators number them and cut them to blocks.

``series`` names the columns that tell series apart, ``order`` a list of
columns that orders a series without ties.  Windows are always partitioned;
``number_globally`` is the way for one series too large for a task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tidewell.functions.lineage import cut


def window(series: list[str], order: list[str]) -> WindowSpec:
    if not series:
        raise ValueError("series columns are needed; number_globally orders a single large series")
    return Window.partitionBy(*series).orderBy(*order)


def number(df: DataFrame, series: list[str], order: list[str], name: str = "row_index") -> DataFrame:
    """Adds the place in the series, from 0.  No series columns: all rows are one, numbered by range partitions."""
    if not series:
        return number_globally(df, order, name)
    return df.withColumn(name, F.row_number().over(window(series, order)).cast("bigint") - 1)


def number_globally(df: DataFrame, order: list[str], name: str = "row_index") -> DataFrame:
    """Numbers all rows by range partitions: one count for each partition is all that the driver sees."""
    parts = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    counts = sorted((r["_part"], r["count"]) for r in parts.groupBy("_part").count().collect())
    starts, at = [], 0
    for part, n in counts:
        starts.append((part, at))
        at += n
    # One row for each partition: bounded by the number of partitions.
    first = df.sparkSession.createDataFrame(starts or [(0, 0)], "_part int, _start bigint")
    return parts.join(F.broadcast(first), "_part").withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def rows_per_block(widths: list[int], block_size: int, vector: int = 1) -> int:
    """Rows of a block: whole vectors, and about block_size bytes of the widest column."""
    unit = math.lcm(max(vector, 1))
    return max(block_size // max(widths) // unit, 1) * unit


def block_of(rows: int, index: str | Column = "row_index") -> Column:
    index = F.col(index) if isinstance(index, str) else index
    return F.floor(index / rows).cast("bigint")


def with_blocks(df: DataFrame, series: list[str], order: list[str], rows: int) -> DataFrame:
    """Adds row_index and block_id; blocks never cross series."""
    return number(df, series, order).withColumn("block_id", block_of(rows))


def ties(df: DataFrame, series: list[str], order: list[str]) -> DataFrame:
    """Keys that several rows share; empty if the order is total."""
    return df.groupBy(*series, *order).count().where("count > 1")
