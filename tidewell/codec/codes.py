"""Length and offset codes.  The tables below are fixed values of the format."""

from __future__ import annotations

from bisect import bisect_right

from tidewell.codec.errors import Corrupted

LITERALS, LENGTHS, OFFSETS = 256, 52, 47
LENGTH_BASE = [*range(4, 36), 36, 38, 40, 44, 48, 56, 64, 80, 96, 128, 192, 256, 384, 512, 768, 1024, 1536, 2048, 3072, 4096]
LENGTH_EXTRA = [0] * 32 + [1, 1, 2, 2, 3, 3, 4, 4, 5, 6, 6, 7, 7, 8, 8, 9, 9, 10, 10, 16]
#: Codes 0 to 2 repeat one of the last three offsets.
REPEATS = 3
FIRST_OFFSETS = (1, 4, 8)
OFFSET_BASE = [1, 2, 3] + [b for m in range(2, 22) for b in (1 << m, 3 << (m - 1))] + [1 << 22]
OFFSET_EXTRA = [0, 0, 0] + [m - 1 for m in range(2, 22) for _ in range(2)] + [0]


def length_code(n: int) -> tuple[int, int, int]:
    """(code, extra bits, their value)."""
    c = bisect_right(LENGTH_BASE, n) - 1
    return c, LENGTH_EXTRA[c], n - LENGTH_BASE[c]


def length_of(code: int, extra: int) -> int:
    return LENGTH_BASE[code] + extra


def offset_code(o: int) -> tuple[int, int, int]:
    """(code, extra bits, their value) of an offset that isn't a repeat."""
    c = bisect_right(OFFSET_BASE, o) - 1
    return c + REPEATS, OFFSET_EXTRA[c], o - OFFSET_BASE[c]


def offset_of(code: int, extra: int) -> int:
    return OFFSET_BASE[code - REPEATS] + extra


class LastOffsets:
    """The last three different offsets, newest first."""

    def __init__(self):
        self.held = list(FIRST_OFFSETS)

    def code(self, o: int) -> tuple[int, int, int]:
        """The code of an offset, which becomes the newest."""
        out = (self.held.index(o), 0, 0) if o in self.held else offset_code(o)
        self._renew(o)
        return out

    def offset(self, code: int, extra: int) -> int:
        if not 0 <= code < OFFSETS:
            raise Corrupted(f"offset code {code}")
        o = self.held[code] if code < REPEATS else offset_of(code, extra)
        self._renew(o)
        return o

    def _renew(self, o: int) -> None:
        if o in self.held:
            self.held.remove(o)
        self.held = [o, *self.held][:3]
