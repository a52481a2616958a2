import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell import generators
from tidewell.codec import errors, frame, lz, lz_many, tans, xorfloat
from tidewell.codec.frame import CodecConfig
from tidewell.codec.quantize import Lossy
from tidewell.codec.schema import RecordSchema
from tidewell.functions import exprs
from tidewell.functions.lineage import cut
from tidewell.operators import compress, detect, entropy, floats, integer, ordering, quantize, tokens
from tidewell.sources import block_table, frames
from tidewell.streaming import blocks

EDGES = [2**63 - 1, -(2**63), 0, -1, 1, 127, 128, -64, -65]


def series(spark, n=200, keys=3):
    r = random.Random(5)
    rows = [(k, i, r.choice(EDGES) if r.random() < 0.3 else r.randrange(-1000, 1000), r.choice([float("nan"), -0.0, 0.0, 1.5, float("inf")]) if r.random() < 0.2 else r.gauss(0, 1)) for k in range(keys) for i in range(n)]
    r.shuffle(rows)
    return spark.createDataFrame(rows, "k int, i int, v bigint, x double")


def test_wrapping_and_zigzag(spark):
    pairs = spark.createDataFrame([(a, b) for a in EDGES for b in EDGES], "a bigint, b bigint")
    wrap = lambda x: (x + 2**63) % 2**64 - 2**63
    for r in pairs.select("a", "b", exprs.wrap_subtract("a", "b").alias("s"), exprs.wrap_add("a", "b").alias("t"), exprs.zigzag("a").alias("z")).collect():
        assert r.s == wrap(r.a - r.b) and r.t == wrap(r.a + r.b) and r.z % 2**64 == (r.a << 1 ^ r.a >> 63) % 2**64
    z = pairs.select("a", exprs.zigzag("a").alias("z")).select("a", exprs.unzigzag("z").alias("back"), exprs.varint_size("z").alias("n"))
    assert all(r.a == r.back and r.n == max(1, -(-((r.a << 1 ^ r.a >> 63) % 2**64).bit_length() // 7)) for r in z.collect())
    narrow = spark.createDataFrame([(2**31 - 1, -5), (-(2**31), 7), (3, 9)], "a int, b int").select(exprs.wrap_subtract("a", "b", 32).alias("s"), exprs.zigzag("b", 32).alias("z"))
    assert [tuple(r) for r in narrow.collect()] == [(-2147483644, 9), (2147483641, 14), (-6, 18)]


def test_bit_counts_and_views(spark):
    df = spark.createDataFrame([(0,), (1,), (-1,), (-(2**63),), (96,)], "b bigint").select("b", exprs.leading_zeros("b").alias("l"), exprs.trailing_zeros("b").alias("t"), exprs.byte_lane("b", 7).alias("top"))
    assert [tuple(r) for r in df.collect()] == [(0, 64, 64, 0), (1, 63, 0, 0), (-1, 0, 0, 255), (-(2**63), 0, 63, 128), (96, 57, 5, 0)]
    floats_ = spark.createDataFrame([(1.5,), (-0.0,), (float("nan"),), (None,)], "x double").select(exprs.float_bits("x").alias("b")).select("b", exprs.bits_float("b").alias("x"))
    assert [r.b for r in floats_.collect()] == [*np.array([1.5, -0.0, np.nan]).view("i8").tolist(), None]
    ts = spark.sql("SELECT timestamp_ntz'1969-12-31 23:59:59.999999' a, timestamp_ntz'2024-02-29 12:34:56.789012' b")
    assert tuple(ts.select(exprs.unix_micros("a"), exprs.unix_micros("b")).first()) == (-1, 1709210096789012)


@pytest.mark.parametrize("parts", [1, 7])
@pytest.mark.parametrize("block", [None, "block_id"])
def test_differences_and_back(spark, parts, block):
    df = ordering.with_blocks(series(spark).repartition(parts), ["k"], ["i"], 64)
    d = integer.deltas(df, ["k"], ["i"], "v", block=block)
    back = integer.rebuild(d, ["k"], ["i"], "v", block=block)
    assert back.where("v <> rebuilt or rebuilt is null").count() == 0 and back.count() == 600
    sizes = {(r["k"], r[block] if block else 0): r for r in integer.encoded_sizes(df, ["k"], ["i"], "v", block=block).collect()}
    from tidewell.codec import integers

    rows = df.toPandas().sort_values(["k", "i"])
    for key, part in rows.groupby(["k", "block_id"] if block else ["k"]):
        key = key if block else (key[0], 0)
        assert sizes[key]["encoded_bytes"] == integers.encoded_size(part["v"].to_numpy("int64")) and sizes[key]["n_values"] == len(part)


def test_one_exchange_for_both_differences(spark):
    plan = integer.deltas(series(spark), ["k"], ["i"], "v")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1


def test_nulls_and_short_series(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, None), ("a", 3, 7), ("b", 1, None), ("c", 1, 9)], "k string, i int, v bigint")
    assert {r["k"]: (r["n_values"], r["encoded_bytes"]) for r in integer.encoded_sizes(df, ["k"], ["i"], "v").collect()} == {"a": (2, 17), "c": (1, 9)}
    assert integer.encoded_sizes(df.limit(0), ["k"], ["i"], "v").count() == 0
    assert ordering.ties(df.union(df), ["k"], ["i"]).count() == 5
    with pytest.raises(ValueError):
        ordering.window([], ["i"])


def test_global_numbers(spark):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5003).alias("key"))
    rows = ordering.number_globally(df, ["key"]).orderBy("key").collect()
    assert [r.row_index for r in rows] == list(range(5000))
    assert ordering.number_globally(df.limit(0), ["key"]).count() == 0


def test_xor_features_and_sizes(spark):
    df = ordering.with_blocks(series(spark), ["k"], ["i"], 50)
    rows = floats.xor_residuals(df, ["k"], ["i"], "x", "block_id").orderBy("k", "i").collect()
    sizes = {(r.k, r.block_id): r.encoded_bits for r in floats.xor_sizes(df, ["k"], ["i"], "x", "block_id").collect()}
    for key in sizes:
        bits = np.array([r.bits for r in rows if (r.k, r.block_id) == key], "i8").view("u8")
        assert sizes[key] == xorfloat.encoded_bits(bits)
        assert [r.xor for r in rows if (r.k, r.block_id) == key][1:] == (bits[1:] ^ bits[:-1]).view("i8").tolist()


def test_entropies(spark):
    df = spark.createDataFrame([("a", b"abab"), ("a", b"cdcd"), ("b", b"zzzz"), ("c", b""), ("c", None)], "k string, d binary")
    assert {r.k: (r.n_bytes, round(r.bits_per_byte, 9), r.ratio) for r in entropy.byte_entropy(df, ["k"], "d").collect()} == {"a": (8, 2.0, 4.0), "b": (4, 0.0, 4.0)}


def test_shapes_and_kinds(spark):
    t = generators.temperatures(spark, 2000).select(F.lit("t").alias("k"), "i", "v")
    n = generators.timestamps(spark, 500).select(F.lit("n").alias("k"), "i", "v")
    assert detect.float_shape(t, ["k"], ["i"], "v").first()["smooth"] and detect.integer_shape(n, ["k"], ["i"], "v").first()["steady"]
    assert detect.choose_kind(t, ["k"], ["i"], "v").first()["kind"] == "f64sd" and detect.choose_kind(n, ["k"], ["i"], "v").first()["kind"] == "i64"
    raw = spark.createDataFrame([(np.random.default_rng(1).bytes(500),), (None,)], "d binary")
    assert [r.kind for r in detect.detect_bytes(raw, "d").collect()] == ["raw", None]


def test_vectors(spark):
    r = np.random.default_rng(6)
    df = spark.createDataFrame([(i, r.normal(size=64).tolist()) for i in range(50)] + [(50, [float("nan")] + [1.0] * 63), (51, None)], "id int, v array<double>")
    conf = Lossy(64, 8)
    out = quantize.vector_errors(quantize.decode_vectors(quantize.encode_vectors(df, "v", conf), "packed", conf), "v", "vector").collect()
    assert all(x.rmse < 0.03 for x in out[:50]) and out[50].has_non_finite and out[51].packed is None and not out[51].has_non_finite
    vec = quantize.series_vectors(generators.temperatures(spark, 256).withColumn("k", F.lit(1)), ["k"], "i", "v", 64)
    assert vec.count() == 4 and vec.where(F.size("vector") == 64).count() == 4


def test_tokens_and_frames(spark):
    df = spark.createDataFrame([(1, "abcabcabcabc" * 9), (2, ""), (3, None), (4, "é" * 40)], "id int, t string")
    back = tokens.replayed(tokens.parsed(df, "t"))
    assert [bytes(r.data).decode() if r.data is not None else None for r in back.orderBy("id").collect()] == ["abcabcabcabc" * 9, None, None, "é" * 40]
    sizes = tokens.packed_size(back).orderBy("id").collect()
    assert [r.packed_bytes for r in sizes] == [len(tans.encode_tokens(lz.parse(r.t.encode(), "lazy", lz.Effort(depth=8)))) if r.t else None for r in sizes]
    each = tokens.replayed(tokens.parsed_by_each(df, "t")).collect()
    assert sorted((r.id, r.parser, r.data and bytes(r.data).decode()) for r in each) == sorted((r.id, p, r.t or None) for r in df.collect() for p in lz.PARSERS)
    framed = compress.compress_column(df, "t", CodecConfig(kind="raw"))
    bad = framed.withColumn("frame", F.when(F.col("id") == 1, F.concat(F.substring("frame", 1, 40), F.lit("junk").cast("binary"))).otherwise(F.col("frame")))
    got = {r.id: (r.data, r.error) for r in compress.decompress_column(bad, permissive=True).collect()}
    assert got[1][0] is None and got[1][1] and bytes(got[4][0]).decode() == "é" * 40 and got[3] == (None, None)


def test_tokens_come_in_small_batches(spark):
    df = spark.range(300).coalesce(1).select("id", F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(900)), lambda k: (F.col("id") * k % 1009).cast("string"))).alias("t"))

    # What the kernel gives at once is for GROUP bytes of text; all of it was one batch.
    sizes = [b.nbytes for b in tokens.token_batches(iter(df.toArrow().to_batches()), "t")]
    assert len(sizes) > 1 and max(sizes) < 12 * lz_many.GROUP
    assert tokens.replayed(tokens.parsed(df, "t")).where("data = cast(t as binary)").count() == 300


def test_block_payloads(spark):
    df = series(spark, 100)
    for value, kind in (("v", "i64"), ("x", "f64")):
        out = compress.compress_series(df, ["k"], ["i"], value, kind, 32, CodecConfig(parser="greedy"))
        back = {(r.k, r.row_index): r.value for r in compress.decompress_series(out, ["k"], 32).collect()}
        for r in df.collect():
            assert back[r.k, r.i] == r[value] or r[value] != r[value]
    broken = out.withColumn("crc32", F.col("crc32") + 1)
    with pytest.raises(Exception, match="CRC-32"):
        compress.decompress_series(broken, ["k"], 32).count()


def test_records_from_frames(spark):
    schema = RecordSchema.of({"seq": "u32", "big": "u64", "x": "f64"})
    n = 300
    cols = {"seq": np.arange(n) + 2**32 - n, "big": np.full(n, 2**64 - 1, "u8"), "x": np.linspace(0, 1, n)}
    f = frame.compress(schema.pack(cols), CodecConfig(kind="raw", stride=schema.stride, block_size=schema.stride * 100))
    df = spark.createDataFrame([(7, f)], "id int, frame binary")
    rows = compress.extract_columns(df, schema, keys=("id",), start_block=1, end_block=2).orderBy("row_index").collect()
    assert len(rows) == 100 and rows[0].row_index == 100 and rows[-1].seq == 2**32 - n + 199 and int(rows[0].big) == 2**64 - 1
    info = frames.frame_info(df, keys=("id",)).orderBy("block_id").collect()
    assert [r.block_id for r in info] == [0, 1, 2] and info[0].kind == "raw" and info[0].ratio > 1


def test_block_table(spark, tmp_path):
    df = series(spark).withColumn("v", F.when(F.col("i") % 10 == 3, None).otherwise(F.col("v")))
    path = str(tmp_path / "blocks")
    block_table.write_blocks(df, path, ["k"], ["i"], "v", rows=50)
    index = block_table.read_index(spark, path)
    assert index.count() == 12 and index.agg(F.sum("n_rows"), F.sum("n_nulls")).first()[:] == (600, 60)
    part = block_table.read_values(spark, path, ["k", "i", "v"], blocks=(1, 3))
    assert part.count() == 300
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(block_id), GreaterThanOrEqual(block_id,1), LessThan(block_id,3)]" in plan
    assert "x" not in [c.split(":")[0] for c in plan.split("ReadSchema: struct<")[1].split(">")[0].split(",")]
    assert block_table.damaged(spark, path, ["k"], ["i"], "v").count() == 0
    values = cut(spark.read.parquet(f"{path}/values"))
    values.withColumn("v", F.when((F.col("k") == 1) & (F.col("i") == 60), 12345).otherwise(F.col("v"))).write.mode("overwrite").parquet(f"{path}/values")
    assert [(r.k, r.block_id) for r in block_table.damaged(spark, path, ["k"], ["i"], "v").collect()] == [(1, 1)]
    assert block_table.with_validity(df, "v").where("not valid and v = 0").count() == 60


def test_frame_files(spark, tmp_path):
    frames.register(spark)
    data = [bytes(range(256)) * 20, b"abc" * 999]
    rows = spark.createDataFrame([(f"f{i}", d) for i, d in enumerate(data)], "name string, data binary")
    folder = str(tmp_path / "frames")
    rows.write.format("tidewell_frame").option("block_size", 1000).option("kind", "raw").mode("append").save(folder)
    df = spark.read.format("tidewell_frame").load(folder)
    for i, d in enumerate(data):
        own = df.where(F.col("path").endswith(f"f{i}.frame")).orderBy("block_id").collect()
        assert b"".join(bytes(r.data) for r in own) == d and [r.byte_offset for r in own] == list(range(0, len(d), 1000))
    part = df.where("block_id >= 2 and block_id < 4")
    assert sorted({r.block_id for r in part.collect()}) == [2, 3] and part.rdd.getNumPartitions() <= 4
    whole = compress.decompress_column(frames.read_frames(spark, folder))
    assert {bytes(r.data) for r in whole.collect()} == set(data)
    reader = frames.FrameBlocks(folder)
    from pyspark.sql.datasource import EqualTo, IsNotNull

    assert list(reader.pushFilters([EqualTo(("block_id",), 1), IsNotNull(("block_id",))])) == [IsNotNull(("block_id",))]
    assert {r[1] for p in reader.partitions() for r in reader.read(p)} == {1}
    cut_up = frames.planned([("a", 10), ("b", 25), ("c", 0), ("d", 3)], 10)
    assert cut_up == [[("a", 0, 10)], [("b", 0, 10)], [("b", 10, 20)], [("b", 20, 25), ("c", 0, 0), ("d", 0, 3)]]


def test_streamed_blocks(spark, sf, tmp_path):
    source = tmp_path / "in"
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(str(source))
    late = events.agg(F.max("ts")).first()[0]
    stream = spark.readStream.schema(events.schema).parquet(str(source))
    q = blocks.write_stream(blocks.window_blocks(stream, ["user_id"], "ts", "value", "1 day"), str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    want = events.where(F.col("ts") < F.lit(late)).groupBy("user_id", F.window(F.col("ts").cast("timestamp"), "1 day").alias("w")).agg(F.count("*").alias("n"))
    got = {(r.user_id, r.start): r.n_rows for r in out.collect()}
    assert got and all(got[k] == v for k, v in {(r.user_id, r.w.start): r.n for r in want.collect()}.items() if k in got)


def test_generators(spark):
    n = 2000
    v, want = 1000, []
    for i in range(n):
        want.append(v)
        v += 100 + i % 101 if i % 500 == 499 else 1 + i % 3
    assert [r.v for r in generators.counters(spark, n).orderBy("i").collect()] == want
    state, out = generators.LCG_START, []
    for _ in range(300):
        state = (state * generators.LCG_FACTOR + generators.LCG_STEP) % 2**64
        out.append(state >> 33 & 255)
    assert [r.b for r in generators.random_bytes(spark, 300).orderBy("i").collect()] == out
    assert {k: d.count() for k, d in generators.standard(spark, 50).items()} == dict.fromkeys(("timestamps", "temperatures", "counters", "vibration", "constant", "random"), 50)
    assert generators.points(spark, 3).count() == generators.telemetry(spark, 3).count() == 3


def test_bad_blocks_raise():
    with pytest.raises(errors.Corrupted):
        frame.decode_block(b"\0" * 5, frame.BY_NAME["i64"], 0, 64)
