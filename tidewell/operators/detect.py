"""Which encoding suits a series: shares of steps as aggregates, and a probe of the float transforms."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.codec import kinds
from tidewell.functions.exprs import wrap_subtract
from tidewell.operators.ordering import number, window


def integer_shape(df: DataFrame, series: list[str], order: list[str], value: str, width: int = 64) -> DataFrame:
    """n_values, the shares of rising and small steps, and steady."""
    step = wrap_subtract(F.col(value), F.lag(value).over(window(series, order)), width) if width == 64 else F.col(value).cast("bigint") - F.lag(F.col(value).cast("bigint")).over(window(series, order))
    small = kinds.SMALL_STEP[width // 8]
    rows = df.where(F.col(value).isNotNull()).withColumn("_step", step)
    out = rows.groupBy(*series).agg(
        F.count("*").alias("n_values"),
        F.avg(F.when(F.col("_step") >= 0, 1.0).when(F.col("_step").isNotNull(), 0.0)).alias("rising"),
        F.avg(F.when((F.col("_step") > -small) & (F.col("_step") < small), 1.0).when(F.col("_step").isNotNull(), 0.0)).alias("small"),
    )
    return out.withColumn("steady", (F.col("n_values") >= 4) & ((F.col("rising") > kinds.RISING_SHARE) | (F.col("small") > kinds.SMALL_SHARE)))


def float_shape(df: DataFrame, series: list[str], order: list[str], value: str) -> DataFrame:
    """n_values, span, the share of steps within a quarter of it, and smooth.  One exchange serves range and steps."""
    w = window(series, order)
    every = Window.partitionBy(*series)
    v = F.col(value)
    bad = F.isnan(v) | v.isin(float("inf"), float("-inf"))
    rows = df.where(v.isNotNull()).withColumn("_step", F.abs(v - F.lag(v).over(w))).withColumn("_span", F.max(v).over(every) - F.min(v).over(every))
    out = rows.groupBy(*series).agg(
        F.count("*").alias("n_values"),
        F.sum(bad.cast("bigint")).alias("n_not_finite"),
        F.max("_span").alias("span"),
        F.avg(F.when(F.col("_step") <= F.col("_span") * kinds.SMOOTH_STEP, 1.0).when(F.col("_step").isNotNull(), 0.0)).alias("near"),
    )
    return out.withColumn("smooth", (F.col("n_values") >= 4) & (F.col("n_not_finite") == 0) & ((F.col("span") == 0) | (F.col("near") > kinds.SMOOTH_SHARE)))


def choose_kind(df: DataFrame, series: list[str], order: list[str], value: str, rows: int = kinds.SAMPLE // 8) -> DataFrame:
    """kind: the transform of least entropy for each series, from its first rows (the sample is part of the rule)."""
    head = number(df.where(F.col(value).isNotNull()), series, order).where(F.col("row_index") < rows).select(*series, "row_index", value)
    width = 4 if df.schema[value].dataType.simpleString() in ("float", "int") else 8
    floating = df.schema[value].dataType.simpleString() in ("float", "double")

    def probe(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values("row_index")[value].to_numpy()
        if floating:
            x = v.astype(f"<f{width}")
            kind = kinds.best_float_kind(x.tobytes(), width).name if kinds.smooth_floats(x) else "raw"
        else:
            kind = f"i{8 * width}" if kinds.steady_integers(np.asarray(v, f"<i{width}")) else "raw"
        return pdf[series].head(1).assign(n_sample=len(v), kind=kind)

    types = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in series)
    return head.groupBy(*series).applyInPandas(probe, f"{types}, n_sample bigint, kind string")


def detect_bytes(df: DataFrame, data: str) -> DataFrame:
    """Adds kind: the detected type of each value of a binary column."""

    @F.pandas_udf("string")
    def kind(x: pd.Series) -> pd.Series:
        return x.map(lambda b: None if b is None else kinds.detect(bytes(b)).name)

    return df.withColumn("kind", kind(F.col(data).cast("binary")))
