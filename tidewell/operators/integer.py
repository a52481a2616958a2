"""Difference coding of integer series as window expressions.

Nulls aren't values: they are left out before differences are taken.  With
``block`` a column, differences start anew in each of its blocks; without it
they run through the whole series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.exprs import varint_size, wrap_subtract, wrap_sum, zigzag
from tidewell.operators.ordering import window

HEAD = {64: (9, 17), 32: (5, 9)}


def deltas(df: DataFrame, series: list[str], order: list[str], value: str, width: int = 64, block: str | None = None) -> DataFrame:
    """Adds delta and delta2, wrapping, null where there is no predecessor (or no two of them).

    Both windows share one exchange and one sort.
    """
    w = window([*series, *([block] if block else [])], order)
    out = df.where(F.col(value).isNotNull()).withColumn("delta", wrap_subtract(value, F.lag(value).over(w), width))
    return out.withColumn("delta2", wrap_subtract("delta", F.lag("delta").over(w), width))


def residual_sizes(df: DataFrame, width: int = 64, double: bool = True) -> DataFrame:
    """Adds zz, the zigzag residual, and residual_bytes, its encoded size, to the result of deltas."""
    return df.withColumn("zz", zigzag("delta2" if double else "delta", width)).withColumn("residual_bytes", varint_size(F.col("zz").cast("bigint").bitwiseAND(F.lit((1 << 32) - 1)) if width == 32 else F.col("zz")))


def encoded_sizes(df: DataFrame, series: list[str], order: list[str], value: str, width: int = 64, double: bool = True, block: str | None = None) -> DataFrame:
    """n_values, raw_bytes and encoded_bytes of the difference stream of each series (and block)."""
    rows = residual_sizes(deltas(df, series, order, value, width, block), width, double)
    keys = [*series, *([block] if block else [])]
    one, more = HEAD[width]
    out = rows.groupBy(*keys).agg(F.count("*").alias("n_values"), F.coalesce(F.sum("residual_bytes"), F.lit(0)).cast("bigint").alias("_rest"))
    head = F.when(F.col("n_values") > 1, more if double else one).otherwise(one)
    return out.select(*keys, "n_values", (F.col("n_values") * (width // 8)).alias("raw_bytes"), (head + F.col("_rest")).cast("bigint").alias("encoded_bytes"))


def rebuild(df: DataFrame, series: list[str], order: list[str], first: str, width: int = 64, block: str | None = None) -> DataFrame:
    """Adds rebuilt: the values again from delta2 by two running sums.

    first holds the value in a series' first row; the first difference is
    delta's in the second.  Sums are exact decimals, wrapped at the end.
    """
    w = window([*series, *([block] if block else [])], order)
    step = F.coalesce(F.col("delta2"), F.col("delta"), F.lit(0)).cast("decimal(38,0)")
    running = df.withColumn("_step", F.sum(step).over(w))
    # The first row adds nothing; each further one adds the running difference.
    moved = F.sum(F.when(F.col("delta").isNull(), F.lit(0)).otherwise(F.col("_step"))).over(w)
    start = F.first(first).over(w).cast("decimal(38,0)")
    return running.withColumn("rebuilt", wrap_sum((start + moved).cast("decimal(38,0)"), width)).drop("_step")


def constant_series(df: DataFrame, series: list[str], value: str) -> DataFrame:
    """Series of one single symbol, which run-length coding stores whole."""
    return df.groupBy(*series).agg(F.count(value).alias("n_values"), F.min(value).alias("least"), F.max(value).alias("most")).where("least = most").select(*series, "n_values", F.col("least").alias("symbol"))
