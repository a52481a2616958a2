"""Tokens: a literal is (0, byte), a match is (length, offset), length at least 4."""

from __future__ import annotations

import math
from dataclasses import dataclass

from tidewell.codec import codes, tans
from tidewell.codec.costs import CostModel
from tidewell.codec.errors import Corrupted, EmptyInput

Token = tuple[int, int]
#: Fixed values of the format.
MIN_MATCH, MAX_MATCH, MAX_WINDOW = 4, 65535, 4 << 20
PARSERS = ("greedy", "lazy", "optimal")


@dataclass(frozen=True)
class Effort:
    """How far a matcher looks."""

    depth: int = 64
    window: int = MAX_WINDOW
    candidates: int = 8


class Matcher:
    """Earlier places with the same four bytes, newest first."""

    def __init__(self, data: bytes, effort: Effort):
        self.data, self.effort = data, effort
        self.last: dict[bytes, int] = {}
        self.before = [-1] * len(data)
        self.done = 0

    def upto(self, at: int) -> None:
        """Makes all places before at known."""
        data, last, before = self.data, self.last, self.before
        for i in range(self.done, min(at, len(data) - MIN_MATCH + 1)):
            key = data[i : i + MIN_MATCH]
            before[i] = last.get(key, -1)
            last[key] = i
        self.done = max(self.done, at)

    def matches(self, at: int) -> list[Token]:
        """Matches of growing length and offset: each is longer than all nearer ones."""
        data, found, best = self.data, [], MIN_MATCH - 1
        most = min(MAX_MATCH, len(data) - at)
        if most < MIN_MATCH:
            return found
        i, left = self.last.get(data[at : at + MIN_MATCH], -1), self.effort.depth
        while i >= 0 and left and at - i <= self.effort.window:
            if best < most and data[i + best] == data[at + best]:
                n = self.common(i, at, most)
                if n > best:
                    best = n
                    found.append((n, at - i))
                    if n == most:
                        break
            i, left = self.before[i], left - 1
        return found[-self.effort.candidates :]

    def common(self, i: int, at: int, most: int) -> int:
        """How many bytes from i on, up to most, are those from at on."""
        data, n, step = self.data, 0, 16
        while n < most:
            k = min(step, most - n)
            if data[i + n : i + n + k] == data[at + n : at + n + k]:
                n, step = n + k, step * 2
            elif k == 1:
                break
            else:
                step = k // 2
                most = min(most, n + k)
        return n

    def longest(self, at: int) -> Token | None:
        found = self.matches(at)
        return found[-1] if found else None


def _eager(data: bytes, effort: Effort, wait: bool) -> list[Token]:
    m, out, at = Matcher(data, effort), [], 0
    while at < len(data):
        m.upto(at)
        hit = m.longest(at)
        if hit and wait and at + 1 < len(data):
            m.upto(at + 1)
            after = m.longest(at + 1)
            if after and after[0] > hit[0]:
                hit = None
        out.append(hit or (0, data[at]))
        at += hit[0] if hit else 1
    return out


def _cheapest(data: bytes, effort: Effort, cost: CostModel) -> list[Token]:
    """The cheapest path through literals, matches and matches at one of the last offsets.

    Each place keeps the last offsets of the cheapest way to it.
    """
    best: list[float] = [0.0] + [math.inf] * len(data)
    came: list[Token] = [(0, 0)] * (len(data) + 1)
    held: list[tuple[int, ...]] = [codes.FIRST_OFFSETS] * (len(data) + 1)
    lengths = [cost.length(n) for n in range(MIN_MATCH, 129)]
    m = Matcher(data, effort)

    def reach(at: int, shortest: int, longest: int, o: int, base: float, after: tuple[int, ...]) -> None:
        for n in (*range(shortest, min(longest, 128)), longest):
            c = base + (lengths[n - MIN_MATCH] if n <= 128 else cost.length(n))
            if c < best[at + n]:
                best[at + n], came[at + n], held[at + n] = c, (n, o), after

    for at in range(len(data)):
        m.upto(at)
        own = held[at]
        c = best[at] + 1 + cost.literals[data[at]]
        if c < best[at + 1]:
            best[at + 1], came[at + 1], held[at + 1] = c, (0, data[at]), own
        most = min(MAX_MATCH, len(data) - at)
        if most < MIN_MATCH:
            continue
        for place, o in enumerate(own):
            if o <= at and data[at - o : at - o + MIN_MATCH] == data[at : at + MIN_MATCH]:
                reach(at, MIN_MATCH, m.common(at - o, at, most), o, best[at] + 1 + cost.offsets[place], (o, *(x for x in own if x != o)))
        shortest = MIN_MATCH
        for longest, o in m.matches(at):
            if o not in own:
                reach(at, shortest, longest, o, best[at] + 1 + cost.offset(o), (o, *own[:2]))
            shortest = min(longest + 1, 128)
    out, at = [], len(data)
    while at:
        out.append(came[at])
        at -= came[at][0] or 1
    return out[::-1]


def _optimal(data: bytes, effort: Effort) -> list[Token]:
    """The cheapest paths by the costs of a greedy parse and of the path itself; the smallest coded of all three is taken."""
    found = [_eager(data, effort, False)]
    for _ in range(2):
        found.append(_cheapest(data, effort, CostModel.of_counts(found[-1])))
    return min(found, key=lambda t: len(tans.encode_tokens(t)))


def parse(data: bytes, parser: str = "lazy", effort: Effort = Effort()) -> list[Token]:
    if not data:
        raise EmptyInput("nothing to parse")
    if parser not in PARSERS:
        raise ValueError(f"parser: one of {', '.join(PARSERS)}")
    return _optimal(data, effort) if parser == "optimal" else _eager(data, effort, parser == "lazy")


def check(tokens: list[Token], size: int | None = None) -> int:
    """How many bytes the tokens stand for; one that is malformed, reaches before the start or past size is an error."""
    at = 0
    for n, x in tokens:
        if n and (n < MIN_MATCH or n > MAX_MATCH or not 0 < x <= at) or not n and not 0 <= x < codes.LITERALS:
            raise Corrupted(f"token ({n}, {x}) at {at}")
        at += n or 1
        if size is not None and at > size:
            raise Corrupted("the tokens are longer than the block")
    return at


def replay(tokens: list[Token], size: int | None = None) -> bytes:
    """The bytes; a token that reaches before the start, or past size, is an error, found before anything is made."""
    check(tokens, size)
    out = bytearray()
    for n, x in tokens:
        if not n:
            out.append(x)
            continue
        at = len(out) - x
        if x >= n:
            out += out[at : at + n]
        else:
            piece = bytes(out[at:])
            out += (piece * (n // x + 1))[:n]
    return bytes(out)
