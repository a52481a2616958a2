"""Ratios and speeds of the standard series, by type."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell import generators
from tidewell.codec.frame import CodecConfig
from tidewell.operators.compress import compress_series
from tidewell.operators.transform import pack_series

#: name: (value, type as it is stored, type by which its bytes are packed)
SUITE = {"timestamps": ("v", "i64", "i64"), "temperatures": ("v", "f64sd", "f64"), "counters": ("v", "i64", "i64"), "vibration": ("v", "f32sd", "f32"), "constant": ("v", "i64", "i64"), "random": ("b", "i32", "i32")}


def ratios(spark: SparkSession, n: int = 10_000, rows: int = 8192, conf: CodecConfig = CodecConfig(parser="greedy")) -> DataFrame:
    """name, kind, raw_bytes, encoded_bytes, ratio for each standard series of n values."""
    made = generators.standard(spark, n)
    # Each is one single series, numbered by range partitions.
    out = [compress_series(made[name], [], ["i"], value, kind, rows, conf).withColumn("name", F.lit(name)) for name, (value, kind, _) in SUITE.items()]
    return reduce(DataFrame.unionByName, out).groupBy("name", "kind").agg(F.sum("size").alias("raw_bytes"), F.sum(F.length("payload")).alias("encoded_bytes")).withColumn("ratio", F.round(F.col("raw_bytes") / F.col("encoded_bytes"), 3))


def speeds(spark: SparkSession, n: int = 10_000, rows: int = 8192, conf: CodecConfig = CodecConfig(parser="greedy")) -> DataFrame:
    """name, kind, raw_bytes and MB of raw bytes a second of one core to encode and to decode each standard series; every block is decoded and compared."""
    import time

    from tidewell.codec import frame
    from tidewell.codec.kinds import BY_NAME

    made = generators.standard(spark, n)
    packed = [pack_series(made[name], [], ["i"], value, plain, rows).select(F.lit(name).alias("name"), F.lit(kind).alias("kind"), "data") for name, (value, kind, plain) in SUITE.items()]

    @F.pandas_udf("struct<encode:double,decode:double,same:boolean>")
    def timed(data: pd.Series, kind: pd.Series) -> pd.DataFrame:
        out = []
        for b, k in zip(data, kind, strict=True):
            own, t = BY_NAME[k], time.perf_counter()
            payload = frame.encode_block(bytes(b), own, conf)
            u = time.perf_counter()
            same = frame.decode_block(payload, own, 0, len(b)) == bytes(b)
            out.append((u - t, time.perf_counter() - u, same))
        return pd.DataFrame(out, columns=["encode", "decode", "same"])

    rows_of = reduce(DataFrame.unionByName, packed).select("name", "kind", F.length("data").alias("size"), timed("data", "kind").alias("t"))
    total = rows_of.groupBy("name", "kind").agg(F.sum("size").alias("raw_bytes"), F.sum("t.encode").alias("e"), F.sum("t.decode").alias("d"), F.every("t.same").alias("same"))
    speed = lambda c: F.round(F.col("raw_bytes") / 1e6 / F.col(c), 3)
    return total.select("name", "kind", "raw_bytes", speed("e").alias("encode_mb_s"), speed("d").alias("decode_mb_s"), "same")
