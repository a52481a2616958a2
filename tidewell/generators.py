"""Deterministic test series.  The constants are fixed values: other programs make the same series from them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LCG_START, LCG_FACTOR, LCG_STEP = 0xDEADBEEFCAFEBABE, 6364136223846793005, 1442695040888963407


def timestamps(spark: SparkSession, n: int) -> DataFrame:
    i = F.col("id")
    return spark.range(n).select(i.alias("i"), (F.lit(1_700_000_000_000) + 1_000_000 * i + (7 * i + 13) % 101 - 50).alias("v"))


def temperatures(spark: SparkSession, n: int) -> DataFrame:
    t = F.col("id").cast("double")
    return spark.range(n).select(F.col("id").alias("i"), (22.5 + 0.5 * F.sin(0.001 * t) + 0.01 * F.sin(7.3 * t + 2.1) * F.cos(13.7 * t + 0.3)).alias("v"))


def counters(spark: SparkSession, n: int) -> DataFrame:
    """A running count in closed form: no window over the series, and as much work for each row.

    Every 500th element jumps; the jumps come again after 303 of them, as 500 k
    goes round modulo 101 and modulo 3 in that time.
    """
    i, period = F.col("id"), 101 * 3
    sums = [0]
    for k in range(1, period + 1):
        last = 500 * k - 1
        sums.append(sums[-1] + 100 + last % 101 - (1 + last % 3))
    # Sum of 1 + k mod 3 over k < i, and of what the jumps are more than that.
    plain = i + 3 * F.floor(i / 3) + F.when(i % 3 == 2, 1).otherwise(0)
    jumps = F.floor(i / 500)
    table = F.from_json(F.lit(str(sums[:period])), "array<bigint>")
    extra = F.floor(jumps / period) * sums[period] + F.get(table, (jumps % period).cast("int"))
    return spark.range(n).select(i.alias("i"), (1000 + plain + extra).cast("bigint").alias("v"))


def constant(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), F.lit(42).cast("bigint").alias("v"))


def vibration(spark: SparkSession, n: int) -> DataFrame:
    """Three axes in 32-bit arithmetic."""

    def run(batches):
        for pdf in batches:
            i = pdf["id"].to_numpy()
            f = np.array([0.1, 0.07, 0.13], np.float32)[i % 3] * i.astype(np.float32)
            v = np.float32(2) * np.sin(f) + np.float32(0.5) * np.sin(np.float32(3) * f + np.float32(0.7)) + np.float32(0.1) * np.sin(np.float32(7) * f + np.float32(1.3))
            yield pdf.assign(i=i, axis=(i % 3).astype("int32"), v=v.astype(np.float32))[["i", "axis", "v"]]

    return spark.range(n).mapInPandas(run, "i bigint, axis int, v float")


def lcg_bytes(start: int, n: int) -> np.ndarray:
    """Bytes start .. start + n - 1 of the generator, after a jump ahead by its affine power."""
    a, c, jump_a, jump_c, k = LCG_FACTOR, LCG_STEP, 1, 0, start
    full = (1 << 64) - 1
    while k:
        if k & 1:
            jump_a, jump_c = jump_a * a & full, (jump_c * a + c) & full
        a, c, k = a * a & full, (a + 1) * c & full, k >> 1
    state, out = (LCG_START * jump_a + jump_c) & full, np.empty(n, np.int16)
    for i in range(n):
        state = (state * LCG_FACTOR + LCG_STEP) & full
        out[i] = state >> 33 & 255
    return out


def random_bytes(spark: SparkSession, n: int) -> DataFrame:
    """Each partition jumps to its own place in the sequence."""

    def run(batches):
        for pdf in batches:
            i = pdf["id"].to_numpy()
            runs = np.split(i, np.flatnonzero(np.diff(i) != 1) + 1) if len(i) else []
            yield pdf.assign(i=i, b=np.concatenate([lcg_bytes(int(r[0]), len(r)) for r in runs]) if len(i) else np.zeros(0, np.int16))[["i", "b"]]

    return spark.range(n).mapInPandas(run, "i bigint, b smallint")


def telemetry(spark: SparkSession, n: int) -> DataFrame:
    """Records of 12 bytes: seq u32, temp f32, humidity f32."""
    i = F.col("id")
    return spark.range(n).select(i.alias("seq"), (20 + 0.01 * i).cast("float").alias("temp"), (50 + 0.005 * i).cast("float").alias("humidity"))


def readings(spark: SparkSession, n: int) -> DataFrame:
    """Records of 12 bytes: id u32, temp f32, hum f32."""
    i = F.col("id")
    t = i.cast("double")
    return spark.range(n).select((1000 + F.floor(i / 100)).alias("id"), (22.5 + 0.001 * F.sin(t)).cast("float").alias("temp"), (55 + 0.001 * F.cos(t)).cast("float").alias("hum"), i.alias("i"))


def points(spark: SparkSession, n: int) -> DataFrame:
    """Records of 24 bytes: a helix."""
    t = F.col("id").cast("double")
    return spark.range(n).select(F.col("id").alias("i"), (10 * F.cos(0.001 * t)).alias("x"), (10 * F.sin(0.001 * t)).alias("y"), (0.0005 * t).alias("z"))


def standard(spark: SparkSession, n: int) -> dict[str, DataFrame]:
    return {"timestamps": timestamps(spark, n), "temperatures": temperatures(spark, n), "counters": counters(spark, n), "vibration": vibration(spark, n), "constant": constant(spark, n), "random": random_bytes(spark, n)}


__all__ = ["constant", "counters", "lcg_bytes", "points", "random_bytes", "readings", "standard", "telemetry", "temperatures", "timestamps", "vibration"]
