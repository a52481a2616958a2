"""Float series: XOR residuals, window features, byte lanes and byte differences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.codec import lanes, xorfloat
from tidewell.functions.exprs import byte_lane, entropy, float_bits, leading_zeros, trailing_zeros
from tidewell.operators.ordering import window


def xor_residuals(df: DataFrame, series: list[str], order: list[str], value: str, block: str | None = None) -> DataFrame:
    """Adds bits, xor (null in the first row), lead and trail (64 for an equal value)."""
    w = window([*series, *([block] if block else [])], order)
    out = df.where(F.col(value).isNotNull()).withColumn("bits", float_bits(value))
    out = out.withColumn("xor", F.col("bits").bitwiseXOR(F.lag("bits").over(w)))
    return out.withColumn("lead", leading_zeros("xor")).withColumn("trail", trailing_zeros("xor"))


def xor_sizes(df: DataFrame, series: list[str], order: list[str], value: str, block: str) -> DataFrame:
    """n_values and the exact encoded_bits of the XOR stream of each block; the window's state needs one task for a block."""
    keys = [*series, block]

    def measured(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = pdf.sort_values(order)[value].to_numpy("float64").view("uint64")
        return pdf[keys].head(1).assign(n_values=len(bits), encoded_bits=xorfloat.encoded_bits(bits))

    rows = df.where(F.col(value).isNotNull()).select(*keys, *order, value)
    kind = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.groupBy(*keys).applyInPandas(measured, f"{kind}, n_values bigint, encoded_bits bigint")


def lane_counts(df: DataFrame, keys: list[str], bits: str, width: int = 8) -> DataFrame:
    """Count of each byte value in each byte lane of an integer column; partial sums are made before the shuffle."""
    each = F.posexplode(F.array(*(byte_lane(bits, k) for k in range(width)))).alias("lane", "byte")
    return df.where(F.col(bits).isNotNull()).select(*keys, each).groupBy(*keys, "lane", "byte").agg(F.count("*").alias("n"))


def lane_entropy(df: DataFrame, keys: list[str], bits: str, width: int = 8) -> DataFrame:
    """Order-0 entropy of each lane, from its byte counts."""
    counts = lane_counts(df, keys, bits, width)
    total = counts.groupBy(*keys, "lane").agg(F.sum("n").alias("total"))
    return counts.join(total, [*keys, "lane"]).groupBy(*keys, "lane").agg(F.max("total").alias("n_bytes"), entropy("n", "total").alias("bits_per_byte"))


def byte_deltas(df: DataFrame, series: list[str], order: list[str], byte: str) -> DataFrame:
    """Adds byte_delta: a byte column's difference to its predecessor, modulo 256; the first stays."""
    b = F.col(byte).cast("int")
    return df.withColumn("byte_delta", F.pmod(b - F.coalesce(F.lag(b).over(window(series, order)), F.lit(0)), F.lit(256)))


def rearranged(df: DataFrame, data: str, width: int, delta: bool = False, inverse: bool = False) -> DataFrame:
    """Adds rearranged: a binary column's byte lanes (and their differences), or back again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column(data).to_pylist():
                if x is not None and inverse:
                    x = lanes.join_lanes(lanes.byte_sum(x) if delta else x, width)
                elif x is not None:
                    x = lanes.split_lanes(x, width)
                    x = lanes.byte_delta(x) if delta else x
                out.append(x)
            yield b.append_column("rearranged", pa.array(out, pa.binary()))

    return df.mapInArrow(run, df.withColumn("rearranged", F.lit(b"")).schema)


def series_bytes(values: np.ndarray, width: int) -> bytes:
    return values.astype(f"<f{width}").tobytes()
