"""Typed transforms of binary columns: packing values, the transform of each element type, and back."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.codec import kinds
from tidewell.codec.kinds import BY_NAME
from tidewell.operators.ordering import with_blocks


def aligned(data: str | Column, kind: str) -> Column:
    """Whether a binary value holds whole elements of a type."""
    size = F.octet_length(F.col(data) if isinstance(data, str) else data)
    return (size % BY_NAME[kind].width == 0) & (size > 0)


def pack_series(df: DataFrame, series: list[str], order: list[str], value: str, kind: str, rows: int) -> DataFrame:
    """series, block_id, n_values, data: the little-endian bytes of each block of at most rows values; nulls are left out."""
    dtype = f"<{kind[0]}{BY_NAME[kind].width}"
    blocks = with_blocks(df.where(F.col(value).isNotNull()), series, order, rows)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values("row_index")[value].to_numpy()
        return pdf[[*series, "block_id"]].head(1).assign(n_values=len(v), data=v.astype(dtype).tobytes())

    types = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in series)
    return blocks.select(*series, "block_id", "row_index", value).groupBy(*series, "block_id").applyInPandas(pack, f"{types}block_id bigint, n_values bigint, data binary")


def unpack_values(df: DataFrame, data: str, kind: str, name: str = "values") -> DataFrame:
    """Adds the array of values that a binary column holds."""
    width, letter = BY_NAME[kind].width, kind[0]
    spark_type = {"f": {8: "double", 4: "float"}, "i": {8: "bigint", 4: "int"}, "u": {8: "decimal(20,0)", 4: "bigint"}}[letter][width]

    @F.pandas_udf(f"array<{'string' if kind == 'u64' else spark_type}>")
    def run(x: pd.Series) -> pd.Series:
        def one(b):
            v = np.frombuffer(bytes(b), f"<{letter}{width}")
            return [str(n) for n in v.tolist()] if kind == "u64" else v.astype("int64" if kind == "u32" else v.dtype.newbyteorder("="))

        return x.map(lambda b: None if b is None else one(b))

    return df.withColumn(name, run(data).cast(f"array<{spark_type}>"))


def transformed(df: DataFrame, data: str, kind: str, name: str = "transformed") -> DataFrame:
    """Adds the transform of a binary column, as a frame would store it before matching."""
    own = BY_NAME[kind]

    @F.pandas_udf("binary")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda b: None if b is None else kinds.forward(bytes(b), own))

    return df.withColumn(name, run(data))


def restored(df: DataFrame, transformed_data: str, size: str, kind: str, name: str = "restored") -> DataFrame:
    """Adds the inverse of transformed; size names the column of the original sizes."""
    own = BY_NAME[kind]

    @F.pandas_udf("binary")
    def run(x: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else kinds.backward(bytes(b), own, int(k)) for b, k in zip(x, n, strict=True)])

    return df.withColumn(name, run(transformed_data, size))
