"""Lossy vectors over array columns, and their errors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.codec import quantize
from tidewell.codec.quantize import Lossy

TRIPLE = "struct<codes:binary,mean:float,scale:float>"


def _rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of dim values, which of them are there)."""
    lists = column.to_pylist()
    there = np.array([x is not None for x in lists], bool)
    for x in lists:
        if x is not None and len(x) != dim:
            raise quantize.LossyConfigError(f"a vector of {len(x)} values, {dim} expected")
    return np.array([x if x is not None else [0.0] * dim for x in lists], np.float64).reshape(-1, dim), there


def encode_vectors(df: DataFrame, vector: str, conf: Lossy, name: str = "packed") -> DataFrame:
    """Adds the packed form (codes, mean, scale) of an array column; null vectors stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, there = _rows(b.column(vector), conf.dim)
            code, mean, sigma = quantize.encode(x, conf)
            out = [{"codes": quantize.pack(c, conf.bits), "mean": m, "scale": s} if t else None for c, m, s, t in zip(code, mean, sigma, there, strict=True)]
            kind = pa.struct([("codes", pa.binary()), ("mean", pa.float32()), ("scale", pa.float32())])
            yield b.append_column(name, pa.array(out, kind))

    return df.mapInArrow(run, df.withColumn(name, F.lit(None).cast(TRIPLE)).schema)


def decode_vectors(df: DataFrame, packed: str, conf: Lossy, name: str = "vector") -> DataFrame:
    """Adds the array of doubles that a packed column stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column(packed).to_pylist()
            there = [r for r in rows if r is not None]
            code = np.array([quantize.unpack(r["codes"], conf.dim, conf.bits) for r in there]).reshape(-1, conf.dim)
            x = iter(quantize.decode(code, np.array([r["mean"] for r in there], np.float32), np.array([r["scale"] for r in there], np.float32), conf).tolist())
            yield b.append_column(name, pa.array([None if r is None else next(x) for r in rows], pa.list_(pa.float64())))

    return df.mapInArrow(run, df.withColumn(name, F.lit(None).cast("array<double>")).schema)


def mean_sigma(vector: str | Column) -> tuple[Column, Column]:
    """Mean and population deviation of an array of numbers, summed in order as doubles."""
    x = F.transform(F.col(vector) if isinstance(vector, str) else vector, lambda v: v.cast("double"))
    n = F.size(x)
    mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / n
    return mean, F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / n)


def vector_errors(df: DataFrame, vector: str, decoded: str) -> DataFrame:
    """Adds max_abs_error, rmse and has_non_finite of two array columns."""
    pairs = F.zip_with(vector, decoded, lambda a, b: a.cast("double") - b)
    bad = F.exists(vector, lambda v: F.isnan(v) | v.isin(float("inf"), float("-inf")))
    return df.withColumn("max_abs_error", F.array_max(F.transform(pairs, F.abs))).withColumn("rmse", F.sqrt(F.aggregate(pairs, F.lit(0.0), lambda a, d: a + d * d) / F.size(pairs))).withColumn("has_non_finite", F.coalesce(bad, F.lit(False)))


def series_vectors(df: DataFrame, series: list[str], index: str, value: str, dim: int) -> DataFrame:
    """Vectors of dim successive values; each group is one vector, so lists are bounded by dim."""
    cut_up = df.groupBy(*series, F.floor(F.col(index) / dim).cast("bigint").alias("vector_id")).agg(F.sort_array(F.collect_list(F.struct(index, value))).alias("_v"))
    return cut_up.select(*series, "vector_id", F.transform("_v", lambda x: x[value]).alias("vector"))


__all__ = ["Lossy", "decode_vectors", "encode_vectors", "mean_sigma", "series_vectors", "vector_errors"]
