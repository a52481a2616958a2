"""Order-0 entropy of symbols, and what it says about compression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.exprs import entropy, estimated_ratio


def symbol_entropy(df: DataFrame, keys: list[str], symbol: Column) -> DataFrame:
    """n_symbols, bits (each, order 0) of a symbol column, for each key.  Two aggregations; the first combines on the map side."""
    counts = df.select(*keys, symbol.alias("_symbol")).where(F.col("_symbol").isNotNull()).groupBy(*keys, "_symbol").agg(F.count("*").alias("n"))
    return of_counts(counts, keys)


def byte_counts(df: DataFrame, keys: list[str], data: str, sample: int = 0) -> DataFrame:
    """symbol and n for each key: a histogram of 256 for each batch of rows, made where the rows are, then added up."""
    raw = F.col(data).cast("binary")
    raw = F.substring(raw, 1, sample) if sample else raw
    rows = df.select(*keys, raw.alias("_raw")).where(F.col("_raw").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own: dict[tuple, np.ndarray] = {}
            for at, x in enumerate(b.column("_raw")):
                key = tuple(b.column(k)[at].as_py() for k in keys)
                seen = own.setdefault(key, np.zeros(256, np.int64))
                seen += np.bincount(np.frombuffer(x.as_py(), np.uint8), minlength=256)
            if own:
                many = len(own)
                columns = [pa.array([k[i] for k in own for _ in range(256)], b.column(c).type) for i, c in enumerate(keys)]
                n = np.concatenate(list(own.values()))
                out = pa.RecordBatch.from_arrays([*columns, pa.array(np.tile(np.arange(256, dtype=np.int32), many)), pa.array(n)], [*keys, "symbol", "n"])
                yield out.filter(pa.array(n > 0))

    types = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)
    return rows.mapInArrow(run, f"{types}symbol int, n bigint").groupBy(*keys, "symbol").agg(F.sum("n").alias("n"))


def of_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """n_symbols and bits for each key, from the counts n of its symbols: H = log2(N) - sum(n log2 n) / N needs no join with the total."""
    out = counts.groupBy(*keys).agg(F.sum("n").alias("n_symbols"), F.sum(F.col("n") * F.log2("n")).alias("_s"))
    return out.select(*keys, "n_symbols", F.greatest(F.lit(0.0), F.log2("n_symbols") - F.col("_s") / F.col("n_symbols")).alias("bits"))


def byte_entropy(df: DataFrame, keys: list[str], data: str, sample: int = 0) -> DataFrame:
    """n_bytes, bits_per_byte and ratio of a binary column, of the first sample bytes of each value if given."""
    out = of_counts(byte_counts(df, keys, data, sample), keys)
    return out.select(*keys, F.col("n_symbols").alias("n_bytes"), F.col("bits").alias("bits_per_byte"), estimated_ratio("n_symbols", "bits").alias("ratio"))


def character_entropy(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """n_chars and bits per character."""
    out = symbol_entropy(df.select(*keys, F.explode(F.split(F.col(text), "")).alias("_char")).where("_char <> ''"), keys, F.col("_char"))
    return out.select(*keys, F.col("n_symbols").alias("n_chars"), F.col("bits").alias("bits_per_char"))


__all__ = ["byte_counts", "byte_entropy", "character_entropy", "entropy", "of_counts", "symbol_entropy"]
