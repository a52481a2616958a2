import math
import struct
import time
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewell.codec import codes, errors, frame, integers, kinds, lanes, lz, lz_many, quantize, tans, varint, xorfloat
from tidewell.codec.frame import CodecConfig, FrameReader
from tidewell.codec.quantize import Lossy
from tidewell.codec.schema import RecordSchema, guess_stride

I = np.arange(2000)  # noqa: E741
TIMES = (1_700_000_000_000 + 1_000_000 * I + (7 * I + 13) % 101 - 50).astype("<i8")
TEMPS = 22.5 + 0.5 * np.sin(0.001 * I) + 0.01 * np.sin(7.3 * I + 2.1) * np.cos(13.7 * I + 0.3)
EXTREMES = np.array([2**63 - 1, -(2**63), 0, -1, 1], "<i8")
ODD = np.array([np.nan, np.inf, -np.inf, -0.0, 0.0, 5e-324, 1.5])


def test_zigzag_and_sizes():
    assert varint.zigzag(EXTREMES).tolist() == [2**64 - 2, 2**64 - 1, 0, 1, 2]
    assert (varint.unzigzag(varint.zigzag(EXTREMES)) == EXTREMES).all()
    assert varint.sizes(np.array([0, 127, 128, 16383, 16384, 2**64 - 1], "u8")).tolist() == [1, 1, 2, 2, 3, 10]


@given(st.lists(st.integers(-(2**63), 2**63 - 1), min_size=1, max_size=60), st.booleans())
@settings(max_examples=60, deadline=None)
def test_integer_streams(v, double):
    x = np.array(v, "<i8")
    data = integers.encode(x, double)
    assert (integers.decode(data, len(x), 8) == x).all() and len(data) == integers.encoded_size(x, double)
    y = x.astype("<i4")
    assert (integers.decode(integers.encode(y, double), len(y), 4) == y).all()


def test_integer_stream_layout():
    assert integers.encode(np.array([5], "<i8")) == b"\1" + struct.pack("<q", 5)
    assert integers.encode(np.array([5, 8, 12], "<i4")) == b"\1" + struct.pack("<ii", 5, 3) + b"\2"
    for bad in (b"", b"\2" + bytes(8), integers.encode(TIMES[:9]) + b"\0", integers.encode(TIMES[:9])[:-1], b"\1" + bytes(16) + b"\xff" * 9 + b"\2"):
        with pytest.raises(errors.Corrupted):
            integers.decode(bad, 9 if len(bad) != 27 else 3, 8)


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=60))
@settings(max_examples=60, deadline=None)
def test_float_streams(v):
    x = np.array(v, "<u8")
    data = xorfloat.encode(x)
    assert (xorfloat.decode(data, len(x), 64) == x).all() and len(data) == math.ceil(xorfloat.encoded_bits(x) / 8)
    y = x.astype("<u4")
    assert (xorfloat.decode(xorfloat.encode(y), len(y), 32) == y).all()


def test_float_stream_layout():
    one, two = np.array([1.0, 1.0]).view("u8"), np.array([1.0, 2.0, 1.0]).view("u8")
    assert xorfloat.encode(one) == struct.pack(">d", 1.0) + b"\0" and xorfloat.encoded_bits(one) == 65
    assert xorfloat.encoded_bits(two) == 64 + 14 + 11 + 2 + 11
    with pytest.raises(errors.Corrupted):
        xorfloat.decode(xorfloat.encode(two)[:-2], 3, 64)


def test_lanes():
    assert lanes.split_lanes(b"abcdefgh", 4) == b"aebfcgdh" and lanes.join_lanes(b"aebfcgdh", 4) == b"abcdefgh"
    assert lanes.byte_delta(bytes([5, 3, 255])) == bytes([5, 254, 252]) and lanes.byte_sum(bytes([5, 254, 252])) == bytes([5, 3, 255])
    assert lanes.bits_per_byte(b"") == 0 and lanes.bits_per_byte(bytes(range(256))) == 8 and lanes.bits_per_byte(b"ab" + b"c" * 9, 2) == 1
    assert lanes.ratio_estimate(b"") == 1 and lanes.ratio_estimate(b"aaaa") == 4
    with pytest.raises(errors.TypeMismatch):
        lanes.split_lanes(b"abc", 2)
    with pytest.raises(errors.StrideMismatch):
        lanes.records_to_columns(bytes(100), 12)


def test_codes():
    for n in [*range(4, 600), 4095, 4096, 65535]:
        c, width, x = codes.length_code(n)
        assert codes.length_of(c, x) == n and x < 1 << width or (x == 0 and width == 0)
    for o in [*range(1, 700), 65536, 2**22 - 1, 2**22]:
        c, width, x = codes.offset_code(o)
        assert codes.offset_of(c, x) == o and x < max(1 << width, 1)
    assert len(codes.LENGTH_BASE) == codes.LENGTHS and len(codes.OFFSET_BASE) + 3 == codes.OFFSETS
    last = codes.LastOffsets()
    assert [last.code(o)[0] for o in (4, 4, 1, 8, 100, 1)] == [1, 0, 1, 2, codes.offset_code(100)[0], 2]


@given(st.lists(st.integers(0, 255), min_size=2, max_size=400).filter(lambda s: len(set(s)) > 1))
@settings(max_examples=60, deadline=None)
def test_numeral_coding(symbols):
    log = tans.table_log(symbols, 11)
    freqs = tans.scaled(symbols, 256, log)
    assert sum(freqs) == 1 << log and all(freqs[s] for s in symbols)
    t = tans.Table(freqs, log)
    assert t.decode(t.encode(symbols), len(symbols)) == symbols


@given(st.binary(min_size=1, max_size=300).map(lambda b: b * 3), st.sampled_from(lz.PARSERS))
@settings(max_examples=60, deadline=None)
def test_tokens(data, parser):
    tokens = lz.parse(data, parser)
    assert lz.replay(tokens) == data
    assert tans.decode_tokens(tans.encode_tokens(tokens)) == tokens


def joined(values):
    return lz_many.Joined(np.frombuffer(b"".join(values), np.uint8), lz_many.bounds_of(np.array([len(v) for v in values], np.int64)))


def same_as_alone(values, parser, effort):
    """The tokens of values at once are those of each alone, and so are their sizes and bytes."""
    found, alone = lz_many.parse(joined(values), parser, effort), [lz.parse(v, parser, effort) if v else [] for v in values]
    assert found.lists() == alone
    assert lz_many.sizes(found).tolist() == [len(v) for v in values] and lz_many.replay(found).tobytes() == b"".join(values)
    some = lz_many.Tokens(found.length, found.value, found.counts[found.counts > 0])
    assert lz_many.packed_sizes(some).tolist() == [len(tans.encode_tokens(t)) for t in alone if t]


@given(st.lists(st.binary(max_size=120).map(lambda b: b * 3) | st.text("ab", max_size=200).map(str.encode), max_size=6), st.sampled_from(lz.PARSERS), st.sampled_from([lz.Effort(), lz.Effort(depth=2, window=9, candidates=1)]))
@settings(max_examples=80, deadline=None)
def test_tokens_of_many_values(values, parser, effort):
    same_as_alone(values, parser, effort)


@given(st.lists(st.binary(max_size=60).map(lambda b: b * 3) | st.text("ab", max_size=300).map(str.encode) | st.just(b"<td>one</td><td>two</td>" * 20), min_size=8, max_size=14), st.sampled_from([lz.Effort(depth=8), lz.Effort(depth=9, candidates=2), lz.Effort(depth=3, window=40)]))
@settings(max_examples=60, deadline=None)
def test_cheapest_tokens_of_many_values(values, effort):
    same_as_alone(values, "optimal", effort)
    each = lz_many.parse_each(joined(values), lz.PARSERS, effort)
    assert [t.lists() for t in each] == [lz_many.parse(joined(values), p, effort).lists() for p in lz.PARSERS]


def test_cheapest_tokens_cost_less_together():
    """Many short pages by the optimal parser take a fraction of the time of one after the other."""
    values = [b"".join(b"<li class=%d>item %d of %d</li>" % (i % 3, i * k % 101, k) for k in range(30)) + b"y" * (i % 9) for i in range(400)]
    began = time.process_time()
    alone = [lz.parse(v, "optimal", lz.Effort(depth=8)) for v in values[:40]]
    middle = time.process_time()
    assert lz_many.parse(joined(values), "optimal", lz.Effort(depth=8)).lists()[:40] == alone
    assert time.process_time() - middle < 5 * (middle - began)


def test_tokens_of_long_and_odd_values():
    noise = np.random.default_rng(3).integers(0, 4, 40_000).astype(np.uint8).tobytes()
    long = [b"", b"a" * 140_000, noise, (b"x" * 300 + b"y") * 400, b"abcd" * 3 + noise[:20_000] + b"q" + noise[:20_000], bytes(range(256)) * 5, b"abc"]
    for parser in ("greedy", "lazy"):
        same_as_alone(long, parser, lz.Effort(depth=8))
    rare = [bytes([0] * 3000 + list(range(256)) * k) for k in (1, 2, 9)]
    same_as_alone(rare, "greedy", lz.Effort(depth=1, window=1))
    for bad in ([(4, 1)], [(0, 1), (3, 1)], [(0, 1), (70000, 1)], [(0, 256)], [(0, 1), (-4, 1)]):
        n, x = np.array([(0, 7), *bad], np.int32).T
        with pytest.raises(errors.Corrupted):
            lz_many.sizes(lz_many.Tokens(n, x, np.array([1, len(bad)])))


def test_memory_of_many_values():
    values = [b"page %d " % i + b"".join(b"%d," % (i * k % 1009) for k in range(400)) for i in range(300)]
    tracemalloc.start()
    for i, j in lz_many.groups(np.array([len(v) for v in values])):
        found = lz_many.parse(joined(values[i:j]), "lazy", lz.Effort(depth=8))
        lz_many.packed_sizes(found)
        lz_many.replay(found)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 130 * lz_many.GROUP


def test_parsers_compare():
    data = b"".join(b"sensor %d reading %d;" % (i % 7, i * i % 97) for i in range(300))
    size = {p: len(tans.encode_tokens(lz.parse(data, p))) for p in lz.PARSERS}
    assert size["optimal"] <= size["greedy"]
    for bad in ([(4, 1)], [(0, 1), (3, 1)], [(0, 1), (70000, 1)]):
        with pytest.raises(errors.Corrupted):
            lz.replay(bad)


def test_more_than_a_short_count_of_token_kinds():
    tokens = [(0, (i * 7919 ^ i >> 3) & 255) for i in range(524_400)]
    assert tans.decode_tokens(tans.encode_tokens(tokens)) == tokens


INPUTS = {
    "i64": TIMES, "u64": TIMES.view("<u8"), "i32": (I * 7).astype("<i4"), "u32": (I * 7).astype("<u4"), "f64": TEMPS, "f32": TEMPS.astype("<f4"), "f64s": TEMPS, "f32s": TEMPS.astype("<f4"),
    "f64sd": TEMPS, "f32sd": TEMPS.astype("<f4"), "raw": np.frombuffer(b"hello sensors " * 300, "u1"),
}


@pytest.mark.parametrize("parser", lz.PARSERS)
@pytest.mark.parametrize("kind", INPUTS)
def test_frames(kind, parser):
    data = INPUTS[kind].tobytes()
    for size in (8, 4000, 1 << 20):
        part = data[: 400 if size == 8 else len(data)]
        f = frame.compress(part, CodecConfig(kind=kind, parser=parser, block_size=size))
        assert frame.decompress(f) == part
        r = FrameReader(f)
        assert r.byte_range(9, 333) == part[9:333] and r.original_size == len(part) and r.byte_range(5, 5) == b""


@pytest.mark.parametrize("data", [b"\xaa" * 8, bytes(65536), b"\xff" * 65536, b"\xaa\x55" * 500, bytes(range(256)) * 9, EXTREMES.tobytes() * 9, ODD.tobytes(), np.array([math.pi]).tobytes()])
def test_awkward_inputs(data):
    for kind in (None, "raw", "i64", "f64", "f64sd"):
        assert frame.decompress(frame.compress(data, CodecConfig(kind=kind))) == data
    assert frame.decompress(frame.compress(data, CodecConfig(seek_table=False, digest=False))) == data


def test_ratios():
    assert 80_000 / len(frame.compress(np.full(10_000, 42, "<i8").tobytes(), CodecConfig(kind="i64"))) > 10
    assert TIMES.nbytes / len(frame.compress(TIMES.tobytes(), CodecConfig(kind="i64"))) > 2
    noise = np.random.default_rng(1).bytes(64 << 10)
    assert len(frame.compress(noise)) <= 1.25 * len(noise)


def test_errors():
    good = bytearray(frame.compress(TIMES.tobytes(), CodecConfig(kind="i64", block_size=4000)))
    for at in (0, 4, 6, 30, 400, len(good) - 5):
        bad = bytearray(good)
        bad[at] ^= 0x40 if at != 4 else 0x02
        with pytest.raises(errors.CodecError):
            frame.decompress(bytes(bad))
    for n in (3, 20, 60, len(good) - 40):
        with pytest.raises(errors.CodecError):
            frame.decompress(bytes(good[:n]))
    wrong = bytearray(good)
    wrong[11] ^= 8
    with pytest.raises(errors.CodecError):
        frame.decompress(bytes(wrong))
    for data, conf, e in (
        (b"", CodecConfig(), errors.EmptyInput), (b"1234567", CodecConfig(kind="i64"), errors.TypeMismatch), (bytes(100), CodecConfig(stride=12), errors.StrideMismatch),
        (bytes(2048), CodecConfig(kind="i64", lossy=Lossy()), errors.LossyConfigError), (bytes(2048), CodecConfig(kind="f64pq", lossy=Lossy(), stride=8), errors.LossyConfigError), (bytes(2048), CodecConfig(kind="f64pq"), errors.LossyConfigError),
    ):
        with pytest.raises(e):
            frame.compress(data, conf)
    r = FrameReader(bytes(good))
    with pytest.raises(errors.BlockIndexOutOfRange):
        r.block(99)
    with pytest.raises(errors.ByteRangeOutOfBounds):
        r.byte_range(0, 1 << 30)
    with pytest.raises(errors.MissingSeekTable):
        FrameReader(frame.compress(b"abc", CodecConfig(seek_table=False)))


def test_records():
    schema = RecordSchema.of({"seq": "u32", "temp": "f32", "humidity": "f32"})
    cols = {"seq": I.astype("<u4"), "temp": (20 + 0.01 * I).astype("<f4"), "humidity": (50 + 0.005 * I).astype("<f4")}
    f = frame.compress(schema.pack(cols), CodecConfig(kind="raw", stride=12, block_size=1200))
    r = FrameReader(f)
    assert all((r.columns(schema)[k] == v).all() for k, v in cols.items())
    assert (r.columns(schema, 2, 3)["seq"] == I[200:300]).all()
    assert len(f) < len(frame.compress(schema.pack(cols), CodecConfig(kind="raw", block_size=1200)))
    with pytest.raises(errors.StrideMismatch):
        r.columns(RecordSchema.of([("a", "i8")]))
    with pytest.raises(ValueError):
        RecordSchema.of([("a", "i128")])
    wide = RecordSchema.of([("t", "i64"), ("x", "f64"), ("v", "f32")])
    data = wide.pack({"t": TIMES, "x": TEMPS, "v": np.full(2000, 0.5, "f4")})
    assert wide.stride == 20 and frame.decompress(frame.compress(data, CodecConfig(kind="i64", stride=20, block_size=5000))) == data
    assert (guess_stride(2400), guess_stride(2400, "a.csv"), guess_stride(1023), guess_stride(1040)) == (20, 0, 0, 20)


def test_detection():
    assert kinds.detect(TEMPS.tobytes()).name == "f64sd" and kinds.detect(b"x" * 31).name == "raw"
    assert kinds.detect(np.random.default_rng(2).bytes(4096)).name == "raw"
    assert kinds.steady_integers(TIMES) and not kinds.smooth_floats(ODD) and kinds.smooth_floats(np.full(9, 3.0))
    assert kinds.best_float_kind(np.random.default_rng(2).normal(size=1000).tobytes(), 8).name in ("raw", "f64s")


def test_keystream():
    # The zero-key stream of eight rounds begins so; further blocks must differ.
    stream = quantize.keystream(bytes(32), 128)
    assert stream[:16].hex() == "3e00ef2f895f40d67f5bb8e81f09a5a1"
    assert len(set(stream[64:])) > 30 and stream[:64] != stream[64:]


def test_rotation_and_rounding():
    conf, x = Lossy(64), np.random.default_rng(3).normal(size=(20, 64))
    y = quantize.rotate(x, conf)
    assert np.allclose(quantize.rotate_back(y, conf), x, atol=1e-12) and np.allclose((y**2).sum(1), (x**2).sum(1))
    assert quantize.half_away(np.array([0.5, 1.5, 2.5, -0.5, 2.4999])).tolist() == [1, 2, 3, -1, 2]
    for bits in range(2, 9):
        code = np.random.default_rng(bits).integers(0, 1 << bits, 64).astype(np.uint8)
        assert (quantize.unpack(quantize.pack(code, bits), 64, bits) == code).all()
    for bad in ((3, 8), (8192, 8), (64, 1), (2, 3)):
        with pytest.raises(errors.LossyConfigError):
            Lossy(*bad)


@pytest.mark.parametrize(("kind", "bits", "mean", "most"), [("f64pq", 8, 0.005, 0.01), ("f32pq", 8, 0.02, 0.10), ("f64pq", 4, 0.03, 0.12)])
def test_lossy_bounds(kind, bits, mean, most):
    i = np.arange(12_800)
    x = (22.5 + 0.5 * np.sin(0.001 * i) + 0.02 * np.cos(0.07 * i)).astype("<f8" if kind[:3] == "f64" else "<f4")
    f = frame.compress_lossy(x.tobytes(), kind, Lossy(bits=bits))
    e = np.abs(np.frombuffer(frame.decompress(f), x.dtype) - x) / np.abs(x)
    assert e.mean() < mean and e.max() < most


def test_lossy_error_is_as_large_as_its_step():
    x = np.random.default_rng(4).normal(size=(500, 256))
    for bits in (4, 6, 8):
        conf = Lossy(bits=bits)
        rmse = np.sqrt(((quantize.decode(*quantize.encode(x, conf), conf) - x) ** 2).mean())
        assert abs(rmse / (12 / ((1 << bits) - 1) / math.sqrt(12)) - 1) < 0.1
    code, mean, sigma = quantize.encode(np.array([[1.0] * 64, [np.nan] + [1.0] * 63]), Lossy(64))
    assert (code == 128).all() and sigma[0] == 0 and np.isnan(sigma[1])


def test_command_line(tmp_path, capsys):
    from tidewell.__main__ import main

    src = tmp_path / "a.bin"
    src.write_bytes(TIMES.tobytes())
    assert main(["encode", str(src), "--type", "i64"]) == 0 and main(["info", f"{src}.frame"]) == 0
    assert "type i64" in capsys.readouterr().out
    assert main(["decode", f"{src}.frame", str(tmp_path / "b.bin")]) == 0 and (tmp_path / "b.bin").read_bytes() == src.read_bytes()
    assert main(["decode", str(src)]) == 1
