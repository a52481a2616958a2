"""The native block table: series as rows of blocks in Parquet, with bounds that let readers skip.

Values are kept as plain columns, sorted by series and order, so Parquet's own
encodings do the entropy coding and its statistics the skipping; next to them
a small index table has one row for each block with counts, bounds, a CRC-32
and a SHA-256 of the block's values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators.ordering import with_blocks


def write_blocks(df: DataFrame, path: str, series: list[str], order: list[str], value: str, rows: int = 65536, mode: str = "errorifexists") -> None:
    """Writes PATH/values and PATH/index.  Rows are numbered by one exchange on the series and stay sorted."""
    kept = with_blocks(df, series, order, rows)
    kept.sortWithinPartitions(*series, "row_index").write.mode(mode).parquet(f"{path}/values")
    block_index(kept.sparkSession.read.parquet(f"{path}/values"), series, order, value).write.mode(mode).parquet(f"{path}/index")


def block_index(kept: DataFrame, series: list[str], order: list[str], value: str) -> DataFrame:
    """A row for each block: rows, nulls, bounds of value, order and row_index, and checksums of its values in order."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row_index", F.col(value).cast("string").alias("v")))), lambda x: F.coalesce(x["v"], F.lit(""))), "\n")
    return kept.groupBy(*series, "block_id").agg(
        F.count("*").alias("n_rows"),
        (F.count("*") - F.count(value)).alias("n_nulls"),
        F.min("row_index").alias("first_row"),
        F.max("row_index").alias("last_row"),
        F.min(value).alias("least"),
        F.max(value).alias("most"),
        F.min(order[0]).alias("first_key"),
        F.max(order[0]).alias("last_key"),
        F.crc32(joined.cast("binary")).alias("crc32"),
        F.sha2(joined, 256).alias("sha256"),
    )


def read_values(spark: SparkSession, path: str, columns: list[str] | None = None, blocks: tuple[int, int] | None = None, rows: tuple[int, int] | None = None, where: Column | None = None) -> DataFrame:
    """Blocks and rows are half-open ranges; predicates and columns reach the Parquet scan."""
    df = spark.read.parquet(f"{path}/values")
    for name, span in (("block_id", blocks), ("row_index", rows)):
        if span:
            df = df.where((F.col(name) >= span[0]) & (F.col(name) < span[1]))
    df = df.where(where) if where is not None else df
    return df.select(*columns) if columns else df


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/index")


def damaged(spark: SparkSession, path: str, series: list[str], order: list[str], value: str) -> DataFrame:
    """Blocks whose values no longer give the checksums of the index."""
    now = block_index(spark.read.parquet(f"{path}/values"), series, order, value).select(*series, "block_id", F.col("sha256").alias("_now"))
    then = read_index(spark, path)
    return then.join(now, [*series, "block_id"], "left").where(~F.col("sha256").eqNullSafe(F.col("_now"))).drop("_now")


def with_validity(df: DataFrame, value: str) -> DataFrame:
    """Splits nulls from values: ``valid`` and a dense value (0 where it was null)."""
    return df.withColumn("valid", F.col(value).isNotNull()).withColumn(value, F.coalesce(F.col(value), F.lit(0).cast(df.schema[value].dataType)))
