"""Match tokens of binary values: parsing and replay as Arrow kernels, statistics as aggregations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.codec import codes, lz, lz_many
from tidewell.codec.errors import Corrupted
from tidewell.functions.exprs import length_code, offset_code

TOKENS = "array<struct<length:int,value:int>>"


def _joined(column: pa.Array, most: int) -> Iterator[tuple[int, int, lz_many.Joined]]:
    """Groups of a binary or text column's values, nulls as empty ones."""
    values = pc.fill_null(column.cast(pa.large_binary()), b"")
    bounds = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)
    for i, j in lz_many.groups(np.diff(bounds), most):
        yield i, j, lz_many.Joined(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])


def _tokens_of(column: pa.Array) -> lz_many.Tokens:
    """A column of tokens; nulls have none."""
    flat = column.flatten()
    length, value = flat.field("length"), flat.field("value")
    if flat.null_count or length.null_count or value.null_count:
        raise Corrupted("a token is null")
    return lz_many.Tokens(length.to_numpy(), value.to_numpy(), pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64))


def _lists(t: lz_many.Tokens) -> pa.Array:
    each = pa.StructArray.from_arrays([pa.array(t.length, pa.int32()), pa.array(t.value, pa.int32())], ["length", "value"])
    return pa.ListArray.from_arrays(pa.array(lz_many.bounds_of(t.counts), pa.int32()), each, mask=pa.array(t.counts == 0))


def _most(parsers: tuple[str, ...]) -> int:
    return lz_many.WIDE_GROUP if "optimal" in parsers else lz_many.GROUP


def token_batches(batches: Iterator[pa.RecordBatch], data: str, parser: str = "lazy", effort: lz.Effort = lz.Effort(depth=8), name: str = "tokens") -> Iterator[pa.RecordBatch]:
    """Batches with their tokens; each has lz_many.GROUP bytes of values at most (WIDE_GROUP for the optimal parser), or one value."""
    for b in batches:
        for i, j, joined in _joined(b.column(data), _most((parser,))):
            yield b.slice(i, j - i).append_column(name, _lists(lz_many.parse(joined, parser, effort)))


def parsed(df: DataFrame, data: str, parser: str = "lazy", effort: lz.Effort = lz.Effort(depth=8), name: str = "tokens") -> DataFrame:
    """Adds the tokens of a binary or text column: (0, byte) or (length, offset); null and empty values give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return token_batches(batches, data, parser, effort, name)

    return df.mapInArrow(run, df.withColumn(name, F.lit(None).cast(TOKENS)).schema)


def parsed_by_each(df: DataFrame, data: str, parsers: tuple[str, ...] = lz.PARSERS, effort: lz.Effort = lz.Effort(depth=8), parser: str = "parser", name: str = "tokens") -> DataFrame:
    """A row for each parser, with its name and tokens, and the other columns; the matches are looked for once."""
    others = [c for c in df.columns if c != data]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, joined in _joined(b.column(data), _most(parsers)):
                part = b.slice(i, j - i).select(others)
                for p, t in zip(parsers, lz_many.parse_each(joined, parsers, effort), strict=True):
                    yield part.append_column(parser, pa.array([p] * (j - i), pa.string())).append_column(name, _lists(t))

    return df.mapInArrow(run, df.select(*others, F.lit("").alias(parser), F.lit(None).cast(TOKENS).alias(name)).schema)


def replayed(df: DataFrame, tokens: str = "tokens", name: str = "data") -> DataFrame:
    """Adds the bytes that the tokens stand for; invalid tokens raise."""

    @F.arrow_udf("binary")
    def run(rows: pa.Array) -> pa.Array:
        all_ = _tokens_of(rows)
        size, parts = lz_many.sizes(all_), []
        for i, j in lz_many.groups(size):
            part = all_.part(i, j)
            # A large value is copied match by match.
            made = lz_many.replay(part).tobytes() if size[i:j].sum() <= lz_many.GROUP else lz.replay(part.lists()[0])
            bounds = pa.array(lz_many.bounds_of(size[i:j]), pa.int32())
            kept = rows.slice(i, j - i).is_valid()
            parts.append(pc.if_else(kept, pa.Array.from_buffers(pa.binary(), j - i, [None, bounds.buffers()[1], pa.py_buffer(made)]), None))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.binary())

    return df.withColumn(name, run(tokens))


def token_stats(df: DataFrame, keys: list[str], tokens: str = "tokens") -> DataFrame:
    """n_literals, n_matches, matched_bytes, longest and farthest for each key."""
    each = df.select(*keys, F.explode(tokens).alias("t")).select(*keys, "t.length", "t.value")
    match = F.col("length") > 0
    return each.groupBy(*keys).agg(
        F.sum((~match).cast("bigint")).alias("n_literals"),
        F.sum(match.cast("bigint")).alias("n_matches"),
        F.sum("length").alias("matched_bytes"),
        F.max("length").alias("longest"),
        F.max(F.when(match, F.col("value"))).alias("farthest"),
    )


def code_counts(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """stream (literal, length, offset), code, n: the symbols to be entropy-coded, offsets without repeats."""
    t = df.select(F.explode(tokens).alias("t")).select("t.length", "t.value")
    both = F.array(F.struct(F.lit("length").alias("stream"), length_code("length").alias("code")), F.struct(F.lit("offset").alias("stream"), offset_code("value").alias("code")))
    one = F.array(F.struct(F.lit("literal").alias("stream"), F.col("value").alias("code")))
    return t.select(F.explode(F.when(F.col("length") > 0, both).otherwise(one)).alias("x")).select("x.*").groupBy("stream", "code").agg(F.count("*").alias("n"))


def code_costs(counts: DataFrame) -> DataFrame:
    """Adds bits, -log2 of each symbol's share with one added to all counts."""
    total = counts.groupBy("stream").agg(F.sum("n").alias("_total"))
    size = F.create_map(*(F.lit(x) for p in (("literal", codes.LITERALS), ("length", codes.LENGTHS), ("offset", codes.OFFSETS)) for x in p))
    return counts.join(F.broadcast(total), "stream").withColumn("bits", -F.log2((F.col("n") + 1) / (F.col("_total") + size[F.col("stream")]))).drop("_total")


def packed_size(df: DataFrame, tokens: str = "tokens", name: str = "packed_bytes") -> DataFrame:
    """Adds the exact size of the entropy-coded tokens."""

    @F.arrow_udf("bigint")
    def run(rows: pa.Array) -> pa.Array:
        kept = rows.is_valid()
        all_ = _tokens_of(rows.drop_null())
        found = [lz_many.packed_sizes(all_.part(i, j)) for i, j in lz_many.groups(all_.counts)]
        return pc.replace_with_mask(pa.nulls(len(rows), pa.int64()), kept, pa.array(np.concatenate([np.zeros(0, np.int64), *found])))

    return df.withColumn(name, run(tokens))
