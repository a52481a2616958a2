"""Table-driven asymmetric numeral coding, and the stream of tokens made with it."""

from __future__ import annotations

from collections import Counter

import numpy as np

from tidewell.codec import codes
from tidewell.codec.errors import Corrupted, EmptyInput

#: Fixed values of the format: table sizes as powers of 2, flags of the header.
DEFAULT_LOG, MIN_LOG, MAX_LOG = (11, 9, 9), 5, 13
ALPHABETS = (codes.LITERALS, codes.LENGTHS, codes.OFFSETS)
ONE_SYMBOL, WIDE = (1, 2, 4), 8
#: No valid stream has more tokens for each of its bytes.
MOST_PER_BYTE = 256


class BitWriter:
    """Least significant bit first."""

    def __init__(self):
        self.out, self.held, self.room = bytearray(), 0, 0

    def put(self, value: int, width: int) -> None:
        self.held |= value << self.room
        self.room += width
        if self.room >= 1 << 12:
            n = self.room // 8
            self.out += (self.held & ((1 << 8 * n) - 1)).to_bytes(n, "little")
            self.held >>= 8 * n
            self.room -= 8 * n

    def align(self) -> None:
        self.out += self.held.to_bytes((self.room + 7) // 8, "little")
        self.held = self.room = 0

    def raw(self, data: bytes) -> None:
        self.align()
        self.out += data

    def finish(self) -> bytes:
        self.align()
        return bytes(self.out)


class BitReader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, width: int) -> int:
        if self.at + width > 8 * len(self.data):
            raise Corrupted("a bit stream ends early")
        part = int.from_bytes(self.data[self.at >> 3 : (self.at + width + 7) >> 3], "little") >> (self.at & 7)
        self.at += width
        return part & ((1 << width) - 1)

    def align(self) -> None:
        self.at = (self.at + 7) // 8 * 8

    def raw(self, n: int) -> bytes:
        self.align()
        i = self.at >> 3
        if i + n > len(self.data):
            raise Corrupted("a stream ends early")
        self.at += 8 * n
        return self.data[i : i + n]


def table_log(symbols: list[int], start: int) -> int:
    """The power of 2 of the table: smaller for short streams, large enough for all different symbols."""
    log, kinds = start, len(set(symbols))
    while log > MIN_LOG and 1 << log > 2 * len(symbols):
        log -= 1
    while log < MAX_LOG and 1 << log < kinds:
        log += 1
    return log


def scaled(symbols: list[int], alphabet: int, log: int) -> list[int]:
    """Frequencies that add to 2**log, at least 1 for each symbol that occurs."""
    seen = np.bincount(symbols, minlength=alphabet).astype(np.int64)
    share = np.where(seen > 0, np.maximum(seen * (1 << log) // len(symbols), 1), 0)
    spare = (1 << log) - int(share.sum())
    if spare >= 0:
        share[int(seen.argmax())] += spare
    for s in [int(seen.argmax()), *np.argsort(-share, kind="stable").tolist()]:
        if spare >= 0:
            break
        less = min(-spare, max(int(share[s]) - 1, 0))
        share[s] -= less
        spare += less
    return share.tolist()


class Table:
    """The states of one alphabet."""

    def __init__(self, freqs: list[int], log: int):
        size = 1 << log
        if sum(freqs) != size:
            raise Corrupted("the frequencies don't add up")
        self.log, self.symbol = log, [0] * size
        step, at = (size >> 1) + (size >> 3) + 3, 0
        for s, f in enumerate(freqs):
            for _ in range(f):
                self.symbol[at] = s
                at = (at + step) & (size - 1)
        nexts = list(freqs)
        self.bits, self.base, self.slots = [0] * size, [0] * size, {s: {} for s, f in enumerate(freqs) if f}
        for u, s in enumerate(self.symbol):
            x = nexts[s]
            nexts[s] += 1
            self.bits[u] = log - (x.bit_length() - 1)
            self.base[u] = (x << self.bits[u]) - size
            self.slots[s][x] = u
        self.freqs = freqs

    def encode(self, symbols: list[int]) -> bytes:
        size, state, emitted = 1 << self.log, 1 << self.log, []
        for s in reversed(symbols):
            f = self.freqs[s]
            n = state.bit_length() - f.bit_length()
            if state >> n < f:
                n -= 1
            emitted.append((state & ((1 << n) - 1), n))
            state = size + self.slots[s][state >> n]
        w = BitWriter()
        w.put(state - size, self.log)
        for v, n in reversed(emitted):
            w.put(v, n)
        return w.finish()

    def decode(self, data: bytes, count: int) -> list[int]:
        r, out = BitReader(data), []
        state, symbol, bits, base = r.take(self.log), self.symbol, self.bits, self.base
        for _ in range(count):
            out.append(symbol[state])
            state = base[state] + r.take(bits[state])
        return out


def _write_freqs(w: BitWriter, freqs: list[int], log: int) -> None:
    top = max((s + 1 for s, f in enumerate(freqs) if f), default=0)
    w.put(top, 16)
    for f in freqs[:top]:
        w.put(1 | (f - 1) << 1 if f else 0, 1 + log if f else 1)


def _read_freqs(r: BitReader, alphabet: int, log: int) -> list[int]:
    top = r.take(16)
    if top > alphabet:
        raise Corrupted(f"{top} symbols in an alphabet of {alphabet}")
    return [r.take(log) + 1 if r.take(1) else 0 for _ in range(top)] + [0] * (alphabet - top)


def encode_tokens(tokens: list[tuple[int, int]]) -> bytes:
    if not tokens:
        raise EmptyInput("no tokens")
    last = codes.LastOffsets()
    lengths = [codes.length_code(n) for n, _ in tokens if n]
    offsets = [last.code(o) for n, o in tokens if n]
    streams = [[b for n, b in tokens if not n], [c for c, *_ in lengths], [c for c, *_ in offsets]]
    logs = [table_log(s, d) if s else MIN_LOG for s, d in zip(streams, DEFAULT_LOG, strict=True)]
    single = [len(set(s)) == 1 for s in streams]
    kinds = np.packbits(np.fromiter((n > 0 for n, _ in tokens), bool, len(tokens)), bitorder="little").tobytes()
    wide = len(kinds) > 0xFFFF
    w = BitWriter()
    w.put(len(streams[0]), 32)
    w.put(len(lengths), 32)
    for log in logs:
        w.put(log, 8)
    w.put(sum(f for f, one in zip(ONE_SYMBOL, single, strict=True) if one) | WIDE * wide, 8)
    w.put(len(kinds), 32 if wide else 16)
    w.raw(kinds)
    tables = []
    for s, alphabet, log, one in zip(streams, ALPHABETS, logs, single, strict=True):
        if one:
            w.put(s[0], 16)
        elif s:
            freqs = scaled(s, alphabet, log)
            _write_freqs(w, freqs, log)
            tables.append((Table(freqs, log), s))
    w.align()
    for t, s in tables:
        body = t.encode(s)
        w.raw(len(body).to_bytes(4, "little"))
        w.raw(body)
    for _, n, x in (*lengths, *offsets):
        w.put(x, n)
    return w.finish()


def decode_tokens(data: bytes, most: int | None = None) -> list[tuple[int, int]]:
    """The tokens; more than most of them are an error, found before any is made."""
    r = BitReader(data)
    counts = [r.take(32), r.take(32)]
    if sum(counts) > MOST_PER_BYTE * len(data) or most is not None and sum(counts) > most:
        raise Corrupted("more tokens than the stream can hold")
    counts.append(counts[1])
    logs, flags = [r.take(8) for _ in range(3)], r.take(8)
    if any(not MIN_LOG <= x <= MAX_LOG for x in logs):
        raise Corrupted("a table size out of range")
    kinds = r.raw(r.take(32 if flags & WIDE else 16))
    total = counts[0] + counts[1]
    if len(kinds) != (total + 7) // 8:
        raise Corrupted("the token kinds don't fit the counts")
    plans: list = []
    for n, alphabet, log, flag in zip(counts, ALPHABETS, logs, ONE_SYMBOL, strict=True):
        if flags & flag:
            s = r.take(16)
            if s >= alphabet:
                raise Corrupted(f"symbol {s} in an alphabet of {alphabet}")
            plans.append([s] * n)
        else:
            plans.append(Table(_read_freqs(r, alphabet, log), log) if n else [])
    r.align()
    literals, lengths, offsets = (p if isinstance(p, list) else p.decode(r.raw(int.from_bytes(r.raw(4), "little")), n) for p, n in zip(plans, counts, strict=True))
    long = [codes.length_of(c, r.take(codes.LENGTH_EXTRA[c])) for c in lengths]
    extra = [r.take(codes.OFFSET_EXTRA[c - codes.REPEATS]) if c >= codes.REPEATS else 0 for c in offsets]
    last, lit, match = codes.LastOffsets(), iter(literals), iter(zip(long, offsets, extra, strict=True))
    is_match = np.unpackbits(np.frombuffer(kinds, np.uint8), count=total, bitorder="little")
    if int(is_match.sum()) != counts[1]:
        raise Corrupted("the token kinds don't fit the counts")
    out = []
    for m in is_match.tolist():
        if m:
            n, c, x = next(match)
            out.append((n, last.offset(c, x)))
        else:
            out.append((0, next(lit)))
    return out


def symbol_bits(symbols: list[int], alphabet: int, start: int) -> float:
    """Bits of a stream of symbols by its scaled frequencies."""
    if not symbols:
        return 0.0
    log = table_log(symbols, start)
    freqs = scaled(symbols, alphabet, log)
    return sum(n * (log - np.log2(freqs[s])) for s, n in Counter(symbols).items())
