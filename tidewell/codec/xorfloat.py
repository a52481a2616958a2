"""XOR streams of float series, most significant bit first.

Fixed values of the format: the first value whole; then for each value a 0 if
its bits equal the last ones, 10 and the payload if its set bits lie in the
current window, or 11, the leading zeros, the length less one (6 bits each, 5
for 32-bit floats) and the payload, which opens a new window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from tidewell.codec.errors import Corrupted, EmptyInput


def _fields(bits: np.ndarray) -> Iterator[tuple[int, int]]:
    """(value, width) of the stream's fields."""
    width = 8 * bits.dtype.itemsize
    head = 6 if width == 64 else 5
    yield int(bits[0]), width
    low = high = -1  # the window: its lowest bit, and the bit above its highest
    for x in (bits[1:] ^ bits[:-1]).tolist():
        if not x:
            yield 0, 1
            continue
        top, bottom = x.bit_length(), (x & -x).bit_length() - 1
        if low <= bottom and top <= high and high >= 0:
            yield 0b10, 2
        else:
            low, high = bottom, top
            yield 0b11, 2
            yield width - top, head
            yield top - bottom - 1, head
        yield x >> low, high - low


def encoded_bits(bits: np.ndarray) -> int:
    """Bits of the stream of uint32 or uint64 values."""
    return sum(w for _, w in _fields(bits))


def encode(bits: np.ndarray) -> bytes:
    if not len(bits):
        raise EmptyInput("no values")
    out, held, room = bytearray(), 0, 0
    for v, w in _fields(bits):
        held, room = held << w | v, room + w
        if room >= 1 << 12:
            rest = room % 8
            out += (held >> rest).to_bytes(room // 8, "big")
            held, room = held & ((1 << rest) - 1), rest
    pad = -room % 8
    return bytes(out) + (held << pad).to_bytes((room + pad) // 8, "big")


def decode(data: bytes, count: int, width: int) -> np.ndarray:
    """count values of 32 or 64 bits."""
    head, at, end = (6 if width == 64 else 5), 0, 8 * len(data)

    def take(n: int) -> int:
        nonlocal at
        if at + n > end:
            raise Corrupted("a float stream ends early")
        part = int.from_bytes(data[at >> 3 : (at + n + 7) >> 3], "big")
        at += n
        return part >> (-at % 8) & ((1 << n) - 1)

    if count < 1:
        raise Corrupted("a float stream of no values")
    now = take(width)
    out, low, size = [now], 0, 0
    for _ in range(count - 1):
        if take(1):
            if take(1):
                lead, size = take(head), take(head) + 1
                low = width - lead - size
                if low < 0:
                    raise Corrupted("a float stream's window is wider than the value")
            elif not size:
                raise Corrupted("a float stream uses a window before it has one")
            now ^= take(size) << low
        out.append(now)
    return np.array(out, np.dtype(f"<u{width // 8}"))
