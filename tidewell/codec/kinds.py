"""Element types of a byte stream, and their transforms."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tidewell.codec import integers, lanes, xorfloat
from tidewell.codec.errors import Corrupted, EmptyInput, LossyConfigError, TypeMismatch


@dataclass(frozen=True)
class Kind:
    """name, number in a frame's flags, width of an element, transform."""

    name: str
    code: int
    width: int
    how: str


#: Fixed values of the format.
KINDS = [
    Kind("raw", 0, 1, "none"),
    Kind("i64", 1, 8, "delta"),
    Kind("u64", 2, 8, "delta"),
    Kind("i32", 3, 4, "delta"),
    Kind("u32", 4, 4, "delta"),
    Kind("f64", 5, 8, "xor"),
    Kind("f32", 6, 4, "xor"),
    Kind("f64s", 7, 8, "lanes"),
    Kind("f32s", 8, 4, "lanes"),
    Kind("f64sd", 9, 8, "lanes_delta"),
    Kind("f32sd", 10, 4, "lanes_delta"),
    Kind("f64pq", 11, 8, "lossy"),
    Kind("f32pq", 12, 4, "lossy"),
]
BY_NAME, BY_CODE = {k.name: k for k in KINDS}, {k.code: k for k in KINDS}


def forward(data: bytes, kind: Kind) -> bytes:
    """The bytes that are then parsed for matches."""
    if not data:
        raise EmptyInput("nothing to encode")
    if len(data) % kind.width:
        raise TypeMismatch(f"{len(data)} bytes, elements of {kind.width}")
    if kind.how == "delta":
        return integers.encode(np.frombuffer(data, f"<i{kind.width}"))
    if kind.how == "xor":
        return xorfloat.encode(np.frombuffer(data, f"<u{kind.width}"))
    if kind.how == "lanes":
        return lanes.split_lanes(data, kind.width)
    if kind.how == "lanes_delta":
        return lanes.byte_delta(lanes.split_lanes(data, kind.width))
    if kind.how == "lossy":
        raise LossyConfigError("a lossy type has no lossless transform")
    return data


def backward(data: bytes, kind: Kind, size: int) -> bytes:
    """Inverse of forward; size is that of its input."""
    if size % kind.width:
        raise Corrupted(f"{size} bytes, elements of {kind.width}")
    if kind.how == "delta":
        return integers.decode(data, size // kind.width, kind.width).tobytes()
    if kind.how == "xor":
        return xorfloat.decode(data, size // kind.width, 8 * kind.width).tobytes()
    if len(data) != size:
        raise Corrupted(f"{len(data)} bytes, {size} expected")
    if kind.how == "lanes":
        return lanes.join_lanes(data, kind.width)
    return lanes.join_lanes(lanes.byte_sum(data), kind.width) if kind.how == "lanes_delta" else data


#: Fixed values of the detection.
LEAST_BYTES, LEAST_WIDE, SAMPLE, GAIN = 32, 64, 8192, 0.95
SMOOTH_STEP, SMOOTH_SHARE, RISING_SHARE, SMALL_SHARE = 0.25, 0.7, 0.8, 0.9
SMALL_STEP = {8: 1_000_000, 4: 100_000}


def smooth_floats(v: np.ndarray) -> bool:
    """Finite, and constant or mostly of steps within a quarter of the range."""
    if len(v) < 4 or not np.isfinite(v).all():
        return False
    with np.errstate(over="ignore"):
        span = v.max() - v.min()
        return bool(span == 0 or (np.abs(np.diff(v)) <= span * v.dtype.type(SMOOTH_STEP)).mean() > SMOOTH_SHARE)


def steady_integers(v: np.ndarray) -> bool:
    """Mostly rising, or mostly of small steps."""
    if len(v) < 4:
        return False
    d = np.diff(v if v.dtype.itemsize == 8 else v.astype(np.int64))
    # The magnitude of the least number has no signed form; it isn't small either.
    small = (d > -SMALL_STEP[v.dtype.itemsize]) & (d < SMALL_STEP[v.dtype.itemsize])
    return bool((d >= 0).mean() > RISING_SHARE or small.mean() > SMALL_SHARE)


def best_float_kind(data: bytes, width: int) -> Kind:
    """The float transform of least entropy over the first bytes; raw unless it saves a twentieth."""
    part = data[: min(len(data), SAMPLE) // width * width]
    names = [f"f{8 * width}", f"f{8 * width}s", f"f{8 * width}sd"]
    if len(part) // width < 4:
        return BY_NAME[names[0]]
    plain = lanes.bits_per_byte(part)
    best, least = BY_NAME["raw"], plain
    for name in names:
        bits = lanes.bits_per_byte(forward(part, BY_NAME[name]))
        if bits < least:
            best, least = BY_NAME[name], bits
    return best if least <= GAIN * plain else BY_NAME["raw"]


def detect(data: bytes) -> Kind:
    """The type of untyped bytes.  Integers that read as smooth tiny floats are taken for floats: the order of the tests is fixed."""
    n = len(data)
    if n >= LEAST_BYTES:
        for width in (8, 4):
            if n % width or (width == 8 and n < LEAST_WIDE):
                continue
            if smooth_floats(np.frombuffer(data, f"<f{width}")):
                return best_float_kind(data, width)
            if steady_integers(np.frombuffer(data, f"<i{width}")):
                return BY_NAME[f"i{8 * width}"]
    return BY_NAME["raw"]
