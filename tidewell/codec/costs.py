"""What tokens cost in bits, by the model of the entropy coder."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

from tidewell.codec import codes, tans

Token = tuple[int, int]
ALPHABETS = (codes.LITERALS, codes.LENGTHS, codes.OFFSETS)
#: Bits of a symbol that a table doesn't hold: a fixed value, dearer than any other.
ABSENT = 36.0


def symbol_streams(tokens: list[Token]) -> list[list[int]]:
    """The literals, length codes and offset codes of tokens, offsets that repeat one of the last three by their place."""
    last = codes.LastOffsets()
    return [[b for n, b in tokens if not n], [codes.length_code(n)[0] for n, _ in tokens if n], [last.code(o)[0] for n, o in tokens if n]]


@dataclass(frozen=True)
class CostModel:
    """Bits of each literal, length code and offset code; extra bits come on top."""

    literals: tuple[float, ...]
    lengths: tuple[float, ...]
    offsets: tuple[float, ...]

    @classmethod
    def uniform(cls) -> CostModel:
        """No statistics: every symbol of an alphabet is as likely."""
        return cls(*((math.log2(n),) * n for n in ALPHABETS))

    @classmethod
    def of_counts(cls, tokens: list[Token]) -> CostModel:
        """By the tokens' own counts, one added to each."""

        def bits(symbols: list[int], size: int) -> tuple[float, ...]:
            seen, total = Counter(symbols), len(symbols) + size
            return tuple(-math.log2((seen[s] + 1) / total) for s in range(size))

        return cls(*map(bits, symbol_streams(tokens), ALPHABETS))

    @classmethod
    def of_frequencies(cls, tables: list[tuple[list[int], int]]) -> CostModel:
        """By scaled frequencies and their table logs, for literals, lengths and offsets."""

        def bits(freqs: list[int], log: int, size: int) -> tuple[float, ...]:
            return tuple(log - math.log2(f) if f else ABSENT for f in [*freqs, *[0] * size][:size])

        return cls(*(bits(f, log, size) for (f, log), size in zip(tables, ALPHABETS, strict=True)))

    @classmethod
    def of_tokens(cls, tokens: list[Token]) -> CostModel:
        """By the tables that the encoder would make for these tokens."""
        tables = []
        for symbols, size, start in zip(symbol_streams(tokens), ALPHABETS, tans.DEFAULT_LOG, strict=True):
            log = tans.table_log(symbols, start) if symbols else tans.MIN_LOG
            tables.append((tans.scaled(symbols, size, log) if symbols else [], log))
        return cls.of_frequencies(tables)

    def literal(self, byte: int) -> float:
        return self.literals[byte]

    def length(self, n: int) -> float:
        code, extra, _ = codes.length_code(n)
        return self.lengths[code] + extra

    def offset(self, o: int) -> float:
        """Of an offset that isn't a repeat."""
        code, extra, _ = codes.offset_code(o)
        return self.offsets[code] + extra

    def match(self, n: int, o: int) -> float:
        return self.length(n) + self.offset(o)

    def repeat(self, n: int, place: int) -> float:
        """Of a match at one of the last three offsets, newest first."""
        return self.length(n) + self.offsets[place]

    def total(self, tokens: list[Token]) -> float:
        """Bits of all symbols and extra bits, and one for each token's kind."""
        last, out = codes.LastOffsets(), float(len(tokens))
        for n, x in tokens:
            if n:
                code, extra, _ = last.code(x)
                out += self.length(n) + self.offsets[code] + extra
            else:
                out += self.literal(x)
        return out
