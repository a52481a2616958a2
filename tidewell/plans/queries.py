"""The registered queries of the series operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell import generators
from tidewell.codec import codes
from tidewell.codec.frame import CodecConfig
from tidewell.codec.quantize import Lossy
from tidewell.codec.schema import RecordSchema
from tidewell.functions.exprs import fixed_point, guessed_stride, leading_zeros, length_code, offset_code, trailing_zeros, unix_micros, unzigzag, varint_size, zigzag
from tidewell.operators import compress, detect, entropy, floats, integer, ordering, quantize, tokens, transform
from tidewell.plans import report
from tidewell.sources.block_table import block_index
from tidewell.sources.frames import frame_info

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
SERIES, ORDER = ["user_id"], ["ts", "event_id"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value", unix_micros("ts").alias("us"))


ZZ = "CASE WHEN {0} >= 0 THEN 2 * {0}::HUGEINT ELSE -2 * {0}::HUGEINT - 1 END"
VARINT = f"ceil(length(bin(({ZZ})::UBIGINT)) / 7.0)"
DELTAS = "WITH a AS (SELECT *, epoch_us(ts) AS us FROM events), b AS (SELECT *, us - lag(us) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM a), c AS (SELECT *, d - lag(d) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dd FROM b)"


@query(f"{DELTAS} SELECT user_id, event_id, d AS delta, dd AS delta2, ({ZZ.format('dd')})::BIGINT AS zz, ({VARINT.format('dd')})::INTEGER AS residual_bytes FROM c")
def delta_of_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second differences of each user's event times, and their encoded sizes."""
    rows = integer.residual_sizes(integer.deltas(events(spark, sf_dir), SERIES, ORDER, "us"))
    return rows.select("user_id", "event_id", "delta", "delta2", "zz", "residual_bytes")


@query(f"{DELTAS} SELECT user_id, count(*) AS n_values, count(*) * 8 AS raw_bytes, ((CASE WHEN count(*) > 1 THEN 17 ELSE 9 END) + coalesce(sum({VARINT.format('dd')}), 0))::BIGINT AS encoded_bytes FROM c GROUP BY user_id")
def difference_stream_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each user's event times as second-difference streams, against 8 bytes each."""
    return integer.encoded_sizes(events(spark, sf_dir), SERIES, ORDER, "us")


@query(f"{DELTAS} SELECT user_id, count(*) AS n_values, count(*) * 8 AS raw_bytes, (9 + coalesce(sum({VARINT.format('d')}), 0))::BIGINT AS encoded_bytes FROM c GROUP BY user_id")
def single_difference_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integer.encoded_sizes(events(spark, sf_dir), SERIES, ORDER, "us", double=False)


@query("SELECT user_id, event_id, epoch_us(ts) AS us, epoch_us(ts) AS rebuilt FROM events")
def difference_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times rebuilt from their second differences by running sums."""
    rows = integer.rebuild(integer.deltas(events(spark, sf_dir), SERIES, ORDER, "us"), SERIES, ORDER, "us")
    return rows.select("user_id", "event_id", "us", "rebuilt")


@query("SELECT event_id, v, ({0})::HUGEINT::VARCHAR AS zz, v AS back, ceil(length(bin(({0})::UBIGINT)) / 7.0)::INTEGER AS bytes FROM (SELECT event_id, epoch_us(ts) * (CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END) AS v FROM events)".format(ZZ.format("v")))
def zigzag_varint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_id", (F.col("us") * F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1)).alias("v")).withColumn("z", zigzag("v"))
    return rows.select("event_id", "v", F.col("z").cast("string").alias("zz"), unzigzag("z").alias("back"), varint_size("z").alias("bytes"))


@query("SELECT lang, count(*) AS n_chars, round(entropy(c), 6) AS bits_per_char FROM (SELECT lang, unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY lang")
def character_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = entropy.character_entropy(table(spark, sf_dir, "documents"), ["lang"], "text")
    return out.withColumn("bits_per_char", F.round("bits_per_char", 6))


@query("SELECT event_type, count(*) AS n_bytes, round(entropy(b), 6) AS bits_per_byte, round(8 / entropy(b), 6) AS ratio FROM (SELECT event_type, unnest(regexp_extract_all(hex(encode(event_type || props)), '..')) AS b FROM events) GROUP BY event_type")
def byte_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-0 entropy of the bytes of each event type's properties."""
    rows = table(spark, sf_dir, "events").select("event_type", F.concat("event_type", "props").alias("data"))
    out = entropy.byte_entropy(rows, ["event_type"], "data")
    return out.select("event_type", "n_bytes", F.round("bits_per_byte", 6).alias("bits_per_byte"), F.round("ratio", 6).alias("ratio"))


@query("SELECT event_type, count(*) AS n_bytes, round(entropy(b), 6) AS bits_per_byte FROM (SELECT event_type, unnest(regexp_extract_all(substring(hex(encode(event_type || props)), 1, 16), '..')) AS b FROM events) GROUP BY event_type")
def sampled_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entropy probe over the first 8 bytes of each value: the sample is the operator's own feature."""
    rows = table(spark, sf_dir, "events").select("event_type", F.concat("event_type", "props").alias("data"))
    return entropy.byte_entropy(rows, ["event_type"], "data", sample=8).select("event_type", "n_bytes", F.round("bits_per_byte", 6).alias("bits_per_byte"))


@query("""WITH s AS (SELECT user_id, us - lag(us) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM (SELECT *, epoch_us(ts) AS us FROM events))
SELECT user_id, count(*) AS n_values, round(avg(CASE WHEN d >= 0 THEN 1.0 WHEN d IS NOT NULL THEN 0.0 END), 9) AS rising, round(avg(CASE WHEN abs(d) < 1000000 THEN 1.0 WHEN d IS NOT NULL THEN 0.0 END), 9) AS small,
count(*) >= 4 AND (avg(CASE WHEN d >= 0 THEN 1.0 WHEN d IS NOT NULL THEN 0.0 END) > 0.8 OR avg(CASE WHEN abs(d) < 1000000 THEN 1.0 WHEN d IS NOT NULL THEN 0.0 END) > 0.9) AS steady FROM s GROUP BY user_id""")
def detect_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = detect.integer_shape(events(spark, sf_dir), SERIES, ORDER, "us")
    return out.select("user_id", "n_values", F.round("rising", 9).alias("rising"), F.round("small", 9).alias("small"), "steady")


@query("""WITH r AS (SELECT *, max(value) OVER (PARTITION BY user_id) - min(value) OVER (PARTITION BY user_id) AS span FROM events WHERE value IS NOT NULL),
s AS (SELECT user_id, span, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS step FROM r),
t AS (SELECT user_id, count(*) AS n_values, max(span) AS span, avg(CASE WHEN step <= span * 0.25::DOUBLE THEN 1.0 WHEN step IS NOT NULL THEN 0.0 END) AS near FROM s GROUP BY user_id)
SELECT user_id, n_values, round(span, 6) AS span, round(near, 9) AS near, n_values >= 4 AND (span = 0 OR near > 0.7) AS smooth FROM t""")
def detect_floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = detect.float_shape(events(spark, sf_dir), SERIES, ORDER, "value")
    return out.select("user_id", "n_values", F.round("span", 6).alias("span"), F.round("near", 9).alias("near"), "smooth")


@query()
def choose_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The float transform of least entropy for each user's values."""
    return detect.choose_kind(events(spark, sf_dir), SERIES, ORDER, "value")


@query("SELECT l_orderkey, count(*) AS n_values, min(l_returnflag) AS symbol FROM lineitem GROUP BY l_orderkey HAVING min(l_returnflag) = max(l_returnflag)")
def constant_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose return flags are one single symbol."""
    return integer.constant_series(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_returnflag")


@query("""WITH p AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * 100)::BIGINT AS cents FROM lineitem),
d AS (SELECT *, cents - lag(cents) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, cents) AS step FROM p)
SELECT l_suppkey, count(*) AS n_values, sum(cents)::BIGINT AS total, sum(abs(step))::BIGINT AS moved FROM d GROUP BY l_suppkey""")
def fixed_point_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices as whole cents, and their differences along each supplier's lines."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", fixed_point("l_extendedprice", 100).alias("cents"))
    out = integer.deltas(rows, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "cents"], "cents")
    return out.groupBy("l_suppkey").agg(F.count("*").alias("n_values"), F.sum("cents").alias("total"), F.sum(F.abs("delta")).alias("moved"))


@query("""SELECT vec_id, round(list_sum(v) / len(v), 6) AS mean, round(sqrt(list_sum(list_transform(v, lambda x: (x - list_sum(v) / len(v)) * (x - list_sum(v) / len(v)))) / len(v)), 6) AS sigma
FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)""")
def vector_mean_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean, sigma = quantize.mean_sigma("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(mean, 6).alias("mean"), F.round(sigma, 6).alias("sigma"))


def _quantized(spark: SparkSession, sf_dir: str, conf: Lossy) -> DataFrame:
    packed = quantize.encode_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", conf)
    return quantize.vector_errors(quantize.decode_vectors(packed, "packed", conf), "embedding", "vector")


@query()
def quantized_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings through the lossy codec at 8 and 4 bits: packed size and errors."""
    out = [_quantized(spark, sf_dir, Lossy(64, bits)).select("vec_id", F.lit(bits).alias("bits"), (F.length("packed.codes") + 8).alias("packed_bytes"), F.round("rmse", 6).alias("rmse"), F.round("max_abs_error", 6).alias("max_abs_error"), "has_non_finite") for bits in (8, 4)]
    return out[0].unionByName(out[1])


BLOCKED = "(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS row_index, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 64 AS block_id FROM events)"


@query(f"SELECT user_id, block_id, count(*) AS n_rows, count(*) - count(value) AS n_nulls, min(row_index) AS first_row, max(row_index) AS last_row, min(value) AS least, max(value) AS most, min(ts) AS first_key, max(ts) AS last_key FROM {BLOCKED} GROUP BY user_id, block_id")
def block_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of the block table: blocks of 64 rows of each user's events."""
    return block_index(ordering.with_blocks(table(spark, sf_dir, "events"), SERIES, ORDER, 64), SERIES, ORDER, "value").drop("crc32", "sha256")


@query(f"SELECT user_id, event_id, row_index, block_id FROM {BLOCKED} WHERE block_id >= 1 AND block_id < 3")
def block_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ordering.with_blocks(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), SERIES, ORDER, 64)
    return rows.where((F.col("block_id") >= 1) & (F.col("block_id") < 3)).select("user_id", "event_id", "row_index", "block_id")


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS row_index FROM lineitem")
def global_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One large series numbered by range partitions, without a single-task window."""
    return ordering.number_globally(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "row_index")


def _band_sql(value: str, base: list[int], shift: int = 0) -> str:
    return f"len(list_filter({base}, lambda b: b <= {value})) - 1 + {shift}"


@query(f"SELECT code::INTEGER AS code, count(*) AS n FROM (SELECT {_band_sql('length(text)', codes.LENGTH_BASE)} AS code FROM documents WHERE length(text) BETWEEN 4 AND 65535) GROUP BY code")
def length_code_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where(F.length("text").between(4, 65535))
    return rows.groupBy(length_code(F.length("text")).alias("code")).agg(F.count("*").alias("n"))


@query(f"SELECT code::INTEGER AS code, count(*) AS n FROM (SELECT {_band_sql('l_partkey * 7', codes.OFFSET_BASE, 3)} AS code FROM lineitem) GROUP BY code")
def offset_code_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 7).alias("o"))
    return rows.groupBy(offset_code("o").alias("code")).agg(F.count("*").alias("n"))


@query("SELECT lane::INTEGER AS lane, (l_orderkey >> (8 * lane) & 255)::INTEGER AS byte, count(*) AS n FROM lineitem, range(8) t(lane) GROUP BY ALL")
def byte_lane_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return floats.lane_counts(table(spark, sf_dir, "lineitem"), [], "l_orderkey")


@query("SELECT lane::INTEGER AS lane, count(*) AS n_bytes, round(entropy((l_orderkey >> (8 * lane) & 255)), 6) AS bits_per_byte FROM lineitem, range(8) t(lane) GROUP BY lane")
def byte_lane_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return floats.lane_entropy(table(spark, sf_dir, "lineitem").withColumn("all", F.lit(1)), ["all"], "l_orderkey").select("lane", "n_bytes", F.round("bits_per_byte", 6).alias("bits_per_byte"))


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, (l_partkey & 255)::INTEGER AS byte FROM lineitem)
SELECT l_orderkey, l_linenumber, byte, ((byte - coalesce(lag(byte) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey), 0)) % 256 + 256) % 256 AS byte_delta FROM b""")
def byte_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_partkey").bitwiseAND(F.lit(255)).cast("int").alias("byte"))
    return floats.byte_deltas(rows, ["l_orderkey"], ["l_linenumber", "l_partkey"], "byte").drop("l_partkey")


#: The bits of a double by exact arithmetic: exponent, mantissa, sign.
FLOAT_BITS = """CASE WHEN v = 0 THEN 0 ELSE (e + 1023)::BIGINT * 4503599627370496 + ((abs(v) / pow(2.0::DOUBLE, e) - 1) * 4503599627370496)::BIGINT + CASE WHEN v < 0 THEN -9223372036854775808 ELSE 0 END END"""
EXPONENT = "f + CASE WHEN abs(v) < pow(2.0::DOUBLE, f) THEN -1 WHEN abs(v) >= pow(2.0::DOUBLE, f + 1) THEN 1 ELSE 0 END"
ZEROS = "CASE WHEN x = 0 THEN 64 ELSE 64 - length(bin(x)) END::INTEGER AS lead, CASE WHEN x = 0 THEN 64 ELSE length(bin(x)) - length(rtrim(bin(x), '0')) END::INTEGER AS trail"


@query(f"""WITH a AS (SELECT user_id, event_id, ts, value AS v, CASE WHEN value <> 0 THEN floor(log2(abs(value))) END AS f FROM events WHERE value IS NOT NULL),
b AS (SELECT *, {EXPONENT} AS e FROM a), c AS (SELECT user_id, event_id, ts, ({FLOAT_BITS})::BIGINT AS bits FROM b),
d AS (SELECT *, xor(bits, lag(bits) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS x FROM c)
SELECT user_id, event_id, bits, x AS xor, {ZEROS} FROM d""")
def xor_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XOR residuals of each user's values and the zeros around their set bits."""
    return floats.xor_residuals(events(spark, sf_dir), SERIES, ORDER, "value").select("user_id", "event_id", "bits", "xor", "lead", "trail")


@query()
def xor_stream_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact bits of the XOR streams, in blocks of 1024 values."""
    rows = ordering.with_blocks(events(spark, sf_dir).where("value is not null"), SERIES, ORDER, 1024)
    return floats.xor_sizes(rows, SERIES, ["row_index"], "value", "block_id")


@query()
def shuffled_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte lanes and their differences of each embedding's packed floats, and back again."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.to_csv(F.struct(F.transform("embedding", lambda x: x.cast("string")).alias("v"))).cast("binary").alias("raw"))
    rows = rows.select("vec_id", F.substring("raw", F.lit(1), F.floor(F.length("raw") / 4).cast("int") * 4).alias("raw"))
    there = floats.rearranged(rows, "raw", 4, delta=True).withColumnRenamed("rearranged", "lanes")
    back = floats.rearranged(there, "lanes", 4, delta=True, inverse=True)
    return back.select("vec_id", F.length("raw").alias("n_bytes"), F.sha2("lanes", 256).alias("lanes_sha256"), (F.col("raw") == F.col("rearranged")).alias("same"))


@query()
def token_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match tokens of whole web pages."""
    parsed = tokens.parsed(table(spark, sf_dir, "pages").select("page_id", "html"), "html", "greedy")
    return tokens.token_stats(parsed.select("page_id", "tokens"), ["page_id"])


@query()
def token_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages from their tokens again, and the size of the coded tokens."""
    parsed = tokens.packed_size(tokens.replayed(tokens.parsed(table(spark, sf_dir, "pages").select("page_id", "html"), "html")))
    return parsed.select("page_id", F.octet_length("html").alias("n_bytes"), "packed_bytes", (F.col("html").cast("binary") == F.col("data")).alias("same"))


@query()
def token_code_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = tokens.parsed(table(spark, sf_dir, "pages").select("page_id", "html"), "html", "greedy")
    return tokens.code_costs(tokens.code_counts(parsed.select("tokens"))).withColumn("bits", F.round("bits", 6))


@query("SELECT page_id, octet_length(encode(html)) AS n_bytes, sha256(html) AS content_sha256, true AS same FROM pages")
def frame_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as frames with checksums and digest, and back."""
    framed = compress.decompress_column(compress.compress_column(table(spark, sf_dir, "pages").select("page_id", "html"), "html", CodecConfig(kind="raw", parser="greedy")))
    return framed.select("page_id", F.octet_length("html").alias("n_bytes"), F.sha2("data", 256).alias("content_sha256"), (F.col("html").cast("binary") == F.col("data")).alias("same"))


@query("SELECT page_id, hex(encode(html))[21:220] AS part FROM pages WHERE octet_length(encode(html)) >= 110")
def frame_byte_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes 10 to 109 of each page, by the frame's seek table."""
    framed = compress.compress_column(table(spark, sf_dir, "pages").where(F.octet_length("html") >= 110).select("page_id", "html"), "html", CodecConfig(kind="raw", parser="greedy", block_size=256))
    return compress.byte_range_column(framed.select("page_id", "frame"), 10, 110).select("page_id", F.hex("data").alias("part"))


SCHEMA = RecordSchema.of({"seq": "u32", "price": "f64", "qty": "f32"})


@query("SELECT l_suppkey, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_quantity) - 1) AS row_index, l_orderkey AS seq, l_extendedprice AS price, l_quantity::FLOAT AS qty FROM lineitem")
def record_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's lines as packed 16-byte records in frames of at most 4096, and their columns extracted again."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_orderkey").alias("seq"), "l_linenumber", F.col("l_extendedprice").alias("price"), F.col("l_quantity").cast("float").alias("qty"))
    packed = compress.pack_records(rows, ["l_suppkey"], ["seq", "l_linenumber", "price", "qty"], SCHEMA, 4096, CodecConfig(kind="raw", parser="greedy"))
    out = compress.extract_columns(packed, SCHEMA, keys=("l_suppkey", "block_id"))
    return out.select("l_suppkey", (F.col("block_id") * 4096 + F.col("row_index")).alias("row_index"), "seq", "price", "qty")


@query("SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS row_index, epoch_us(ts) AS value FROM events")
def series_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times as encoded blocks of 512 values, checked and decoded again."""
    blocks = compress.compress_series(events(spark, sf_dir), SERIES, ORDER, "us", "i64", 512, CodecConfig(parser="greedy"))
    return compress.decompress_series(blocks, SERIES, 512)


@query()
def series_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw against encoded bytes of each user's values, by type."""
    conf, rows = CodecConfig(parser="greedy"), events(spark, sf_dir)
    out = [compress.compress_series(rows, SERIES, ORDER, c, k, 1024, conf) for c, k in (("us", "i64"), ("value", "f64"), ("value", "f64sd"))]
    both = out[0].unionByName(out[1]).unionByName(out[2])
    return both.groupBy("user_id", "kind").agg(F.sum("size").alias("raw_bytes"), F.sum(F.length("payload")).alias("encoded_bytes")).withColumn("ratio", F.round(F.col("raw_bytes") / F.col("encoded_bytes"), 6))


@query("SELECT i, 1700000000000 + 1000000 * i + (7 * i + 13) % 101 - 50 AS v FROM range(100000) t(i)")
def generated_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.timestamps(spark, 100_000)


@query("SELECT i, (1000 + coalesce(sum(CASE WHEN i % 500 = 499 THEN 100 + i % 101 ELSE 1 + i % 3 END) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS v FROM range(20000) t(i)")
def generated_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.counters(spark, 20_000)


@query("SELECT i, round(22.5 + 0.5 * sin(0.001::DOUBLE * i) + 0.01 * sin(7.3::DOUBLE * i + 2.1) * cos(13.7::DOUBLE * i + 0.3), 6) AS v FROM range(20000) t(i)")
def generated_temperatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.temperatures(spark, 20_000).withColumn("v", F.round("v", 6))


@query("""WITH RECURSIVE g(i, s) AS (SELECT -1, 16045690984503098046::HUGEINT UNION ALL SELECT i + 1, (s * 6364136223846793005 + 1442695040888963407) % 18446744073709551616 FROM g WHERE i < 4999)
SELECT i::BIGINT AS i, ((s // 8589934592) % 256)::SMALLINT AS b FROM g WHERE i >= 0""")
def generated_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.random_bytes(spark, 5000)


@query()
def generated_vibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.vibration(spark, 5000)


@query()
def transform_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's event times and values through the transform of every lossless type, and back."""
    out = None
    for value, names in (("us", ("raw", "i64", "u64")), ("value", ("f64", "f64s", "f64sd"))):
        packed = transform.pack_series(events(spark, sf_dir), SERIES, ORDER, value, "i64" if value == "us" else "f64", 1024).withColumn("size", F.octet_length("data"))
        for name in names:
            own = transform.restored(transform.transformed(packed, "data", name), "transformed", "size", name)
            rows = own.select("user_id", "block_id", F.lit(value).alias("series"), F.lit(name).alias("kind"), "size", F.octet_length("transformed").alias("transformed_bytes"), (F.col("data") == F.col("restored")).alias("same"))
            out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 1024 AS block_id, epoch_us(ts) AS us FROM events")
def packed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times packed to bytes and unpacked to typed values."""
    packed = transform.pack_series(events(spark, sf_dir), SERIES, ORDER, "us", "i64", 1024)
    return transform.unpack_values(packed.where(transform.aligned("data", "i64")), "data", "i64").select("user_id", "block_id", F.explode("values").alias("us"))


@query()
def detected_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detected type of each user's packed times and values."""
    out = [detect.detect_bytes(transform.pack_series(events(spark, sf_dir), SERIES, ORDER, v, k, 1024), "data").select("user_id", "block_id", F.lit(v).alias("series"), "kind") for v, k in (("us", "i64"), ("value", "f64"))]
    return out[0].unionByName(out[1])


@query()
def frame_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the headers say of each page's frame."""
    framed = compress.compress_column(table(spark, sf_dir, "pages").select("page_id", "html"), "html", CodecConfig(kind="raw", parser="greedy", block_size=1024))
    return frame_info(framed, keys=("page_id",)).withColumn("ratio", F.round("ratio", 6))


@query()
def parser_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coded bytes of each benchmark text by the three parsers."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", "text").where(F.length("text") > 0)
    for parser in ("greedy", "lazy", "optimal"):
        rows = tokens.packed_size(tokens.parsed(rows, "text", parser, name=f"{parser}_tokens"), f"{parser}_tokens", f"{parser}_bytes").drop(f"{parser}_tokens")
    return rows.select("item_id", F.octet_length("text").alias("n_bytes"), "greedy_bytes", "lazy_bytes", "optimal_bytes")


@query()
def lossy_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of 16 successive values of each user through the lossy codec, with their errors."""
    conf = Lossy(16, 8)
    rows = ordering.number(events(spark, sf_dir).where("value is not null"), SERIES, ORDER)
    vectors = quantize.series_vectors(rows, SERIES, "row_index", "value", 16).where(F.size("vector") == 16)
    out = quantize.vector_errors(quantize.decode_vectors(quantize.encode_vectors(vectors, "vector", conf), "packed", conf, "decoded"), "vector", "decoded")
    return out.select("user_id", "vector_id", F.round("rmse", 6).alias("rmse"), F.round("max_abs_error", 6).alias("max_abs_error"))


@query()
def dataset_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw against encoded bytes of the standard generated series."""
    return report.ratios(spark)


@query("SELECT * FROM (VALUES ('constant', 'i64', 80000), ('counters', 'i64', 80000), ('random', 'i32', 40000), ('temperatures', 'f64sd', 80000), ('timestamps', 'i64', 80000), ('vibration', 'f32sd', 40000)) t(name, kind, raw_bytes), (SELECT true AS same, true AS timed)")
def dataset_speeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block of the standard series encoded, decoded, compared and timed; the speeds themselves are in report.speeds."""
    return report.speeds(spark).select("name", "kind", F.col("raw_bytes").cast("int").alias("raw_bytes"), "same", ((F.col("encode_mb_s") > 0) & (F.col("decode_mb_s") > 0)).alias("timed"))


@query(f"WITH a AS (SELECT *, epoch_us(ts) AS us FROM events), b AS (SELECT *, xor(us, lag(us) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS x FROM a) SELECT user_id, event_id, x AS xor, {ZEROS} FROM b")
def xor_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XOR residuals of integers, and the zeros around their set bits."""
    rows = events(spark, sf_dir).withColumn("x", F.col("us").bitwiseXOR(F.lag("us").over(ordering.window(SERIES, ORDER))))
    return rows.select("user_id", "event_id", F.col("x").alias("xor"), leading_zeros("x").alias("lead"), trailing_zeros("x").alias("trail"))


@query("""WITH v AS (SELECT user_id, 'us' AS series, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events UNION ALL SELECT user_id, 'value', row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 FROM events WHERE value IS NOT NULL),
k(series, kind) AS (VALUES ('us', 'raw'), ('us', 'i64'), ('us', 'u64'), ('value', 'f64'), ('value', 'f64s'), ('value', 'f64sd'))
SELECT user_id, i // 1024 AS block_id, series, kind, (8 * count(*))::INTEGER AS size, true AS same FROM v JOIN k USING (series) GROUP BY user_id, block_id, series, kind""")
def transform_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks through the transform of every lossless 8-byte type and back: what comes back, and how much."""
    return transform_roundtrip(spark, sf_dir).select("user_id", "block_id", "series", "kind", "size", "same")


@query("""WITH p AS (SELECT l_suppkey, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1) // 512 AS block_id, l_partkey FROM lineitem), k(kind) AS (VALUES ('i32'), ('u32'), ('f32'), ('f32s'), ('f32sd'))
SELECT l_suppkey, block_id, kind, (4 * count(*))::INTEGER AS size, true AS same FROM p, k GROUP BY ALL""")
def narrow_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part numbers as 4-byte integers and floats through the transform of every lossless 4-byte type and back."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", F.col("l_partkey").cast("int").alias("n"), F.col("l_partkey").cast("float").alias("x"))
    out = None
    for value, plain, names in (("n", "i32", ("i32", "u32")), ("x", "f32", ("f32", "f32s", "f32sd"))):
        packed = transform.pack_series(rows, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], value, plain, 512).withColumn("size", F.octet_length("data"))
        for name in names:
            own = transform.restored(transform.transformed(packed, "data", name), "transformed", "size", name)
            one = own.select("l_suppkey", "block_id", F.lit(name).alias("kind"), "size", (F.col("data") == F.col("restored")).alias("same"))
            out = one if out is None else out.unionByName(one)
    return out


NARROW = f"WITH a AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, l_partkey::INTEGER AS n FROM lineitem), b AS (SELECT *, n - lag(n) OVER w AS d FROM a WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, n, l_extendedprice)), c AS (SELECT *, d - lag(d) OVER w AS dd FROM b WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, n, l_extendedprice)) SELECT l_suppkey, count(*) AS n_values, count(*) * 4 AS raw_bytes, ((CASE WHEN count(*) > 1 THEN 9 ELSE 5 END) + coalesce(sum({VARINT.format('dd')}), 0))::BIGINT AS encoded_bytes FROM c GROUP BY l_suppkey"


@query(NARROW)
def narrow_difference_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each supplier's part numbers as 32-bit second-difference streams."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", F.col("l_partkey").cast("int").alias("n"))
    return integer.encoded_sizes(rows, ["l_suppkey"], ["l_orderkey", "l_linenumber", "n", "l_extendedprice"], "n", width=32)


@query("SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 1024 AS block_id, epoch_us(ts) AS us FROM events")
def lane_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times through byte lanes and their differences, and back to values."""
    packed = transform.pack_series(events(spark, sf_dir), SERIES, ORDER, "us", "i64", 1024)
    there = floats.rearranged(packed, "data", 8, delta=True).withColumnRenamed("rearranged", "lanes")
    back = floats.rearranged(there, "lanes", 8, delta=True, inverse=True)
    return transform.unpack_values(back, "rearranged", "i64").select("user_id", "block_id", F.explode("values").alias("us"))


@query("SELECT page_id, parser, octet_length(encode(html)) AS n_bytes, sha256(html) AS content_sha256 FROM pages, (VALUES ('greedy'), ('lazy'), ('optimal')) p(parser) WHERE octet_length(encode(html)) BETWEEN 1 AND 3000")
def token_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short pages from the tokens of each parser again."""
    rows = table(spark, sf_dir, "pages").where(F.octet_length("html").between(1, 3000)).select("page_id", "html")
    back = tokens.replayed(tokens.parsed_by_each(rows, "html", ("greedy", "lazy", "optimal")))
    return back.select("page_id", "parser", F.octet_length("data").alias("n_bytes"), F.sha2("data", 256).alias("content_sha256"))


@query("SELECT page_id, 'raw' AS kind, 2 AS version, 0 AS stride, k AS block_id, least(1024, n - 1024 * k) AS size FROM (SELECT page_id, octet_length(encode(html)) AS n, unnest(range(((octet_length(encode(html)) + 1023) // 1024)::BIGINT)) AS k FROM pages WHERE octet_length(encode(html)) > 0)")
def frame_block_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the headers say of each page's frame but for what depends on the coder."""
    return frame_blocks(spark, sf_dir).select("page_id", "kind", "version", "stride", "block_id", "size")


@query("SELECT page_id, way, true AS refused FROM pages, (VALUES ('flipped'), ('cut'), ('digest'), ('claims')) w(way) WHERE octet_length(encode(html)) > 0")
def damaged_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with a bit flipped in the middle, cut short, with another digest, or with a header that claims more: none is decoded."""
    framed = compress.compress_column(table(spark, sf_dir, "pages").select("page_id", "html"), "html", CodecConfig(kind="raw", parser="greedy")).where(F.col("frame").isNotNull())
    n, piece = F.length("frame"), lambda a, b: F.substring("frame", a, b)
    turned = lambda at: F.concat(piece(F.lit(1), at - 1), F.unhex(F.lpad(F.hex(F.conv(F.hex(piece(at, F.lit(1))), 16, 10).cast("bigint").bitwiseXOR(F.lit(16))), 2, "0")), piece(at + 1, n))
    # Byte 11 is the second of the size of the content.
    ways = {"flipped": turned(F.floor(n / 2).cast("int")), "cut": piece(F.lit(1), n - 33), "digest": turned(n), "claims": turned(F.lit(13))}
    each = framed.select("page_id", F.explode(F.array(*(F.struct(F.lit(k).alias("way"), v.alias("frame")) for k, v in ways.items()))).alias("x")).select("page_id", "x.*")
    out = compress.decompress_column(each, "frame", permissive=True)
    return out.select("page_id", "way", (F.col("data").isNull() & F.col("error").isNotNull()).alias("refused"))


@query("SELECT block_id, least(256, 4000 - 256 * block_id)::BIGINT * 12 AS n_bytes, true AS no_larger FROM range(16) t(block_id)")
def parser_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured records by the three parsers: the optimal one, which knows repeated offsets, never makes more bytes than the greedy one."""
    schema = RecordSchema.of({"id": "u32", "temp": "f32", "hum": "f32"})
    packed = compress.pack_raw(generators.readings(spark, 4000), [], ["i"], schema, 256)
    for parser in ("greedy", "optimal"):
        packed = tokens.packed_size(tokens.parsed(packed, "data", parser, name=f"{parser}_tokens"), f"{parser}_tokens", f"{parser}_bytes").drop(f"{parser}_tokens")
    return packed.select("block_id", F.length("data").cast("bigint").alias("n_bytes"), (F.col("optimal_bytes") <= F.col("greedy_bytes")).alias("no_larger"))


@query("SELECT doc_id, n_bytes, guess::INTEGER AS stride FROM (SELECT doc_id, octet_length(encode(text)) AS n_bytes, CASE WHEN doc_id % 3 = 0 OR octet_length(encode(text)) < 1024 THEN 0 ELSE coalesce(list_filter([20, 24, 16, 12, 32, 28, 8, 40, 48, 64], lambda s: octet_length(encode(text)) % s = 0 AND octet_length(encode(text)) // s >= 10)[1], 0) END AS guess FROM documents WHERE text IS NOT NULL)")
def guessed_strides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record width that a file of each document's size would be taken to have; every third is named as text."""
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.octet_length("text").alias("n_bytes"), F.concat(F.lit("file"), F.when(F.col("doc_id") % 3 == 0, ".TXT").otherwise(".bin")).alias("name"))
    return rows.select("doc_id", "n_bytes", guessed_stride("n_bytes", "name").alias("stride"))


@query("""WITH b AS (SELECT b, count(*) AS n FROM (SELECT unnest(regexp_extract_all(hex(encode(event_type || props)), '..')) AS b FROM events) GROUP BY b)
SELECT ('0x' || b)::INTEGER AS code, n, round(-log2((n + 1) / ((SELECT sum(n) FROM b) + 256)), 6) AS bits FROM b""")
def literal_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each byte of the events' properties costs as a literal."""
    counts = entropy.byte_counts(table(spark, sf_dir, "events").select(F.concat("event_type", "props").alias("data")), [], "data")
    return tokens.code_costs(counts.select(F.lit("literal").alias("stream"), F.col("symbol").alias("code"), "n")).select("code", "n", F.round("bits", 6).alias("bits"))


TOKEN_SQL = "SELECT 4 + l_orderkey % 700 AS length, 1 + l_partkey * 13 AS value, l_linenumber > 1 AS is_match FROM lineitem"


@query(f"""WITH t AS ({TOKEN_SQL}), c AS (SELECT 'length' AS stream, {_band_sql('length', codes.LENGTH_BASE)} AS code FROM t WHERE is_match UNION ALL SELECT 'offset', {_band_sql('value', codes.OFFSET_BASE, 3)} FROM t WHERE is_match UNION ALL SELECT 'literal', value % 256 FROM t WHERE NOT is_match),
n AS (SELECT stream, code::INTEGER AS code, count(*) AS n FROM c GROUP BY ALL)
SELECT stream, code, n, round(-log2((n + 1) / (sum(n) OVER (PARTITION BY stream) + CASE stream WHEN 'literal' THEN 256 WHEN 'length' THEN 52 ELSE 47 END)), 6) AS bits FROM n""")
def token_symbol_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of tokens made from the lines of orders, and what each costs."""
    made = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") > 1, F.struct((4 + F.col("l_orderkey") % 700).cast("int").alias("length"), (1 + F.col("l_partkey") * 13).cast("int").alias("value"))).otherwise(F.struct(F.lit(0).alias("length"), ((1 + F.col("l_partkey") * 13) % 256).cast("int").alias("value"))).alias("t"))
    return tokens.code_costs(tokens.code_counts(made.select(F.array("t").alias("tokens")))).select("stream", "code", "n", F.round("bits", 6).alias("bits"))


#: Bounds of the mean and the greatest relative error, by series, type and bits.
LOSSY_GATES = (("temperatures", "f64pq", 8, 0.005, 0.01), ("vibration", "f32pq", 8, 0.02, 0.10), ("temperatures", "f64pq", 4, 0.03, 0.12))


@query("SELECT * FROM (VALUES ('temperatures', 'f64pq', 8), ('vibration', 'f32pq', 8), ('temperatures', 'f64pq', 4)) t(name, kind, bits), (SELECT 102400 AS n_values, true AS mean_ok, true AS greatest_ok)")
def lossy_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lossy codec's errors on generated series, against their bounds.  Relative to a value's size, or to 1 if it is smaller."""
    out = None
    for name, kind, bits, mean, most in LOSSY_GATES:
        rows = generators.standard(spark, 102_400)[name].select("i", F.col("v").cast("double").alias("v"))
        conf = Lossy(256, bits)
        vectors = quantize.series_vectors(rows, [], "i", "v", 256)
        both = quantize.decode_vectors(quantize.encode_vectors(vectors, "vector", conf), "packed", conf, "decoded")
        each = both.select(F.explode(F.arrays_zip("vector", "decoded")).alias("x")).select(F.abs("x.vector").alias("size"), F.abs(F.col("x.vector") - F.col("x.decoded")).alias("off"))
        error = F.col("off") / F.greatest("size", F.lit(1.0))
        one = each.agg(F.count("*").cast("int").alias("n_values"), F.avg(error).alias("mean"), F.max(error).alias("most"))
        one = one.select(F.lit(name).alias("name"), F.lit(kind).alias("kind"), F.lit(bits).alias("bits"), "n_values", (F.col("mean") < mean).alias("mean_ok"), (F.col("most") < most).alias("greatest_ok"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT (i % 3)::INTEGER AS axis, count(*) AS n, true AS close FROM range(5000) t(i) GROUP BY ALL")
def generated_vibration_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 32-bit series against the same formula in 64 bits."""
    f = F.element_at(F.array(F.lit(0.1), F.lit(0.07), F.lit(0.13)), F.col("axis") + 1) * F.col("i")
    exact = 2 * F.sin(f) + 0.5 * F.sin(3 * f + 0.7) + 0.1 * F.sin(7 * f + 1.3)
    return generators.vibration(spark, 5000).groupBy("axis").agg(F.count("*").alias("n"), (F.max(F.abs(F.col("v") - exact)) < 2e-3).alias("close"))
