"""Tokens of many values at once, the same as those of ``lz`` and ``tans``, by array operations over their joined bytes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from tidewell.codec import codes, lz, tans
from tidewell.codec.errors import Corrupted, EmptyInput

#: Bytes of values that are joined; a longer value stands alone.
GROUP = 1 << 19
#: The same for the optimal parser, which goes through all values in step; fewer of them go alone.
WIDE_GROUP, COMPANY = 1 << 22, 8
#: Bits for each of a place's last offsets; longer values go alone.
HELD = 21
#: Times that 8 and then 64 bytes are compared by arrays before a pair of places goes on alone; streams under which the coder's states do.
SHORT, LONG, LANES = 3, 256, 64


def groups(sizes: np.ndarray, most: int = GROUP) -> Iterator[tuple[int, int]]:
    """Ranges of values whose sizes add to most at the most, or of one value; they are about as large as each other."""
    ends = np.cumsum(sizes)
    total, at = int(ends[-1]) if len(sizes) else 0, 0
    if total:
        most = min(most, -(-total // -(-total // most)) + int(sizes.max()))
    while at < len(sizes):
        end = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")), at + 1)
        yield at, end
        at = end


def bounds_of(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)])


@dataclass
class Joined:
    """Values end to end; bounds has where each begins, and the end."""

    data: np.ndarray
    bounds: np.ndarray

    def __post_init__(self):
        n = len(self.data)
        padded = np.zeros(n + 96, np.uint8)
        padded[:n] = self.data
        #: The eight bytes from each place on, and the eight words of 64 bytes.
        self.words = np.ndarray((n + 88,), "<u8", padded.data, strides=(1,)).copy()
        self.lines = np.lib.stride_tricks.as_strided(self.words, (n + 24, 8), (8, 64))
        self.ends = np.repeat(self.bounds[1:], np.diff(self.bounds)).astype(np.int32)

    def common(self, at: np.ndarray, offset: np.ndarray, known: np.ndarray) -> np.ndarray:
        """How many bytes from each place on are those offset before it, up to the end of the value; as many as known are."""
        end, far = self.ends[at], at + known
        x = self.words[far] ^ self.words[far - offset]
        live = np.flatnonzero((x == 0) & (far + 8 < end))
        far[live] += 8
        reach, back, stop = far[live], offset[live], end[live]
        for k in range(SHORT + LONG):
            if not len(live):
                break
            if k < SHORT:
                y, step = self.words[reach] ^ self.words[reach - back], 8
            else:
                line = self.lines[reach] ^ self.lines[reach - back]
                first = (line != 0).argmax(1)
                y, step = line[np.arange(len(line)), first], 64
                reach = reach + 8 * first.astype(np.int32)
            more = (y == 0) & (reach + step < stop)
            done = live[~more]
            x[done], far[done] = y[~more], reach[~more]
            if k >= SHORT:
                # Without a difference the line ends where the value does, or further on.
                far[done] += np.where(y[~more] == 0, 56, 0).astype(np.int32)
            live, reach, back, stop = live[more], reach[more] + step, back[more], stop[more]
        n = np.minimum(far + (np.bitwise_count((x & -x) - np.uint64(1)) >> 3).astype(np.int32), end) - at
        if len(live):
            whole = lz.Matcher(self.data.tobytes(), lz.Effort())
            for k in live.tolist():
                p = int(at[k])
                n[k] = whole.common(p - int(offset[k]), p, int(end[k]) - p)
        return n

    def matches(self, effort: lz.Effort) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places, and length and offset of their matches, nearest first: the longest by the newest earlier place with the same four bytes, then those by the one before it that are longer, and so on."""
        place = np.flatnonzero(self.ends - np.arange(len(self.data), dtype=np.int32) >= lz.MIN_MATCH).astype(np.uint64)
        keyed = (self.words[place] << np.uint64(32)) | place
        keyed.sort()
        at, key = keyed.astype(np.uint32).view(np.int32), (keyed >> np.uint64(32)).astype(np.uint32)
        same = (key[1:] == key[:-1]) & (self.ends[at[1:]] == self.ends[at[:-1]])
        before = np.full(len(self.data), -1, np.int32)
        before[at[1:][same]] = at[:-1][same]
        best, first = np.zeros((2, len(self.data)), np.int32)
        here = np.flatnonzero(before >= 0).astype(np.int32)
        was, via, length = before[here], None, None
        for _ in range(effort.depth):
            offset = here - was
            if len(self.data) > effort.window and (near := offset <= effort.window).sum() < len(near):
                here, was, offset = here[near], was[near], offset[near]
                via, length = (None, None) if via is None else (via[near], length[near])
            if not len(here):
                return
            # Neighbours with one offset have one match, each without the first byte of the one before.
            last = np.ones(len(here), bool)
            last[:-1] = (offset[1:] != offset[:-1]) | (here[1:] - here[:-1] != 1)
            stop = np.flatnonzero(last)
            end, o = here[stop], offset[stop]
            if via is None:
                n = self.common(end, o, np.full(len(end), lz.MIN_MATCH, np.int32))
            else:
                # What a place has in common with the newer one, and that one with this one: if they differ, the less.
                n, m = length[stop], first[via[stop]]
                same = np.flatnonzero(n == m)
                n = np.minimum(n, m)
                n[same] = self.common(end[same], o[same], n[same])
            length = np.repeat(end + n, np.diff(stop, prepend=-1)) - here
            if via is None:
                first[here] = length
            capped = np.minimum(length, lz.MAX_MATCH)
            more = np.flatnonzero(capped > best[here])
            some, capped = here[more], capped[more]
            best[some] = capped
            yield some, capped, offset[more]
            via, was = was, before[was]
            left = np.flatnonzero(was >= 0)
            here, was, via, length = here[left], was[left], via[left], length[left]


def longest(joined: Joined, effort: lz.Effort) -> tuple[np.ndarray, np.ndarray]:
    """Length and offset of the longest match of each place, the nearest of those; 0: none."""
    length, offset = np.zeros((2, len(joined.data)), np.int32)
    for at, n, o in joined.matches(effort):
        length[at], offset[at] = n, o
    return length, offset


@dataclass
class Tokens:
    """Lengths and values of the tokens of several values; counts: how many each has."""

    length: np.ndarray
    value: np.ndarray
    counts: np.ndarray

    def part(self, i: int, j: int) -> Tokens:
        """Those of values i to j, without j."""
        a, b = int(self.counts[:i].sum()), int(self.counts[:j].sum())
        return Tokens(self.length[a:b], self.value[a:b], self.counts[i:j])

    def lists(self) -> list[list[lz.Token]]:
        both = list(zip(self.length.tolist(), self.value.tolist(), strict=True))
        b = bounds_of(self.counts).tolist()
        return [both[i:j] for i, j in zip(b, b[1:], strict=False)]


def eager(joined: Joined, length: np.ndarray, offset: np.ndarray, wait: bool) -> Tokens:
    """The greedy or lazy parse by the longest match of each place."""
    n = len(joined.data)
    match = length > 0
    if wait:
        match[:-1] &= length[1:] <= length[:-1]
    at = np.flatnonzero(match)
    before = np.zeros(n + 1, np.int32)
    np.cumsum(match, out=before[1:])
    leap = before[at + length[at]].tolist()
    taken, k = [], 0
    while k < len(leap):
        taken.append(k)
        k = leap[k]
    start = at[np.array(taken, np.int64)]
    # Literals and matches in turn.
    turns = np.empty(2 * len(start) + 1, np.int64)
    turns[1::2], turns[0:-1:2], turns[-1] = length[start], start, n
    turns[2:-1:2] -= start[:-1] + length[start[:-1]]
    turns[-1] -= start[-1] + length[start[-1]] if len(start) else 0
    is_match = np.repeat(np.arange(len(turns)) % 2 == 1, turns)
    own = ~is_match
    own[start] = True
    place = np.flatnonzero(own)
    is_match = is_match[place]
    counts = np.diff(np.searchsorted(place, joined.bounds))
    return Tokens(np.where(is_match, length[place], 0).astype(np.int32), np.where(is_match, offset[place], joined.data[place]).astype(np.int32), counts)


#: Lengths of 4 and more have a cost of their own up to this one; further on a match is tried at its whole length only.
EACH_LENGTH = 128
_LENGTH_CODE = np.searchsorted(codes.LENGTH_BASE, np.arange(lz.MAX_MATCH + 1), "right") - 1
_LENGTH_EXTRA = np.array(codes.LENGTH_EXTRA)[_LENGTH_CODE]


class Steps:
    """The cheapest paths through several values in step, from each place of all of them to the next; the longest values come first."""

    def __init__(self, joined: Joined, effort: lz.Effort):
        self.joined = joined
        size = np.diff(joined.bounds)
        self.lanes = np.argsort(-size, kind="stable")
        self.size, self.start = size[self.lanes], joined.bounds[self.lanes]
        rank = np.empty(len(size), np.int64)
        rank[self.lanes] = np.arange(len(size))
        #: Of each byte: the lane of its value.
        self.lane_of = np.repeat(rank, size)
        found = [[] for _ in range(5)]
        self.longest = np.zeros((2, len(joined.data)), np.int32)
        # Of parts of the values, whose arrays are small.
        for i, j in groups(size):
            a = int(joined.bounds[i])
            part = Joined(joined.data[a : joined.bounds[j]], joined.bounds[i : j + 1] - a)
            shortest = np.full(len(part.data), lz.MIN_MATCH, np.int32)
            for k, (at, n, o) in enumerate(part.matches(effort)):
                for into, x in zip(found, (at + a, n, o, shortest[at], np.full(len(at), k, np.int32)), strict=True):
                    into.append(x)
                self.longest[:, at + a] = n, o
                shortest[at] = np.minimum(n + 1, EACH_LENGTH)
        at, length, offset, shortest, order = (np.concatenate([np.zeros(0, np.int32), *x]).astype(np.int64) for x in found)
        by = np.lexsort((order, self.lane_of[at], at - joined.bounds[self.lanes][self.lane_of[at]]))
        at, length, offset, shortest = at[by], length[by], offset[by], shortest[by]
        if effort.candidates < effort.depth and len(at):
            # Of a place's matches only the last, that is the longest, are tried.
            left = np.diff(np.append(np.flatnonzero(np.diff(at, prepend=-1)), len(at)))
            nth_last = np.repeat(np.cumsum(left), left) - np.arange(len(at))
            kept, first = nth_last <= effort.candidates, nth_last == np.minimum(np.repeat(left, left), effort.candidates)
            shortest = np.where(first, lz.MIN_MATCH, shortest)
            at, length, offset, shortest = at[kept], length[kept], offset[kept], shortest[kept]
        self.lane, self.length, self.offset, self.shortest = self.lane_of[at], length, offset, shortest
        self.key, at = self.start[self.lane] + offset, at - self.start[self.lane]
        # A match of the greatest length may go on; its end isn't known.
        self.end = np.where(length < lz.MAX_MATCH, at + length, 0)
        most = int(self.size[0]) if len(size) else 0
        self.cut = np.searchsorted(at, np.arange(most + 1)).tolist()

    def costs(self, tokens: Tokens) -> list[np.ndarray]:
        """Bits of each lane's literals, length codes and offset codes by its tokens' counts, as CostModel.of_counts has them."""
        many = len(self.size)
        row = np.repeat(self.lane_of_value(), tokens.counts)
        match = tokens.length > 0
        counts = np.diff(np.searchsorted(np.flatnonzero(match), bounds_of(tokens.counts)))
        offset_codes, _ = _offset_codes(tokens.value[match], counts)
        out = []
        for symbols, of, alphabet in zip((tokens.value[~match], _LENGTH_CODE[tokens.length[match]], offset_codes), (row[~match], row[match], row[match]), tans.ALPHABETS, strict=True):
            seen = np.bincount(of * alphabet + symbols, minlength=many * alphabet).reshape(many, alphabet)
            share = (seen + 1) / (seen.sum(1) + alphabet)[:, None]
            out.append(-np.fromiter(map(math.log2, share.ravel().tolist()), np.float64, share.size).reshape(share.shape))
        return out

    def lane_of_value(self) -> np.ndarray:
        out = np.empty(len(self.lanes), np.int64)
        out[self.lanes] = np.arange(len(self.lanes))
        return out

    def cheapest(self, tokens: Tokens) -> Tokens:
        """As lz._cheapest for each value, with the costs of its tokens' counts."""
        j, data = self.joined, self.joined.data
        literals, lengths, offsets = self.costs(tokens)
        each = lengths[:, _LENGTH_CODE[lz.MIN_MATCH : EACH_LENGTH + 1]] + _LENGTH_EXTRA[lz.MIN_MATCH : EACH_LENGTH + 1]
        each, literal = each.ravel(), literals[self.lane_of, data]
        wide = EACH_LENGTH + 1 - lz.MIN_MATCH
        code = np.searchsorted(codes.OFFSET_BASE, self.offset, "right") - 1
        fresh = offsets[self.lane, code + codes.REPEATS] + np.array(codes.OFFSET_EXTRA)[code]
        repeats = offsets[:, : codes.REPEATS]
        # A value's places and its end are nodes.
        total = len(data) + len(self.size)
        node0 = j.bounds[self.lanes] + self.lanes
        best, held = np.full(total, np.inf), np.zeros(total, np.int64)
        step, value = np.zeros((2, total), np.int32)
        p, q, r = codes.FIRST_OFFSETS
        best[node0], held[node0] = 0.0, p | q << HELD | r << 2 * HELD
        falling, four = -self.size, j.words.astype(np.uint32)
        # Where the last match of each offset of each value ends.
        ends = np.zeros(len(data) + 1, np.int64)
        mask, shifts = (1 << HELD) - 1, np.arange(3) * HELD
        for at in range(len(self.cut) - 1):
            active = int(np.searchsorted(falling, -at, "left"))
            node, place = node0[:active] + at, self.start[:active] + at
            base, own = best[node] + 1, held[node]
            c = base + literal[place]
            less = np.flatnonzero(c < best[node + 1])
            to = node[less] + 1
            best[to], step[to], held[to] = c[less], 1, own[less]
            near = int(np.searchsorted(falling, 1 - at - lz.MIN_MATCH, "left"))
            here, held_ = place[:near], own[:near, None] >> shifts & mask
            lane, kind = np.nonzero((four[here][:, None] == four[here[:, None] - held_]) & (held_ <= at))
            o = held_[lane, kind]
            a, b = self.cut[at], self.cut[at + 1]
            ends[self.key[a:b]] = self.end[a:b]
            if len(lane):
                key = self.start[lane] + o
                n = ends[key] - at
                # Past the end that is known of this offset's last match another one has begun.
                new = np.flatnonzero(n < lz.MIN_MATCH)
                if len(new):
                    n[new] = j.common(here[lane[new]].astype(np.int32), o[new], np.full(len(new), lz.MIN_MATCH, np.int32))
                    ends[key[new]] = n[new] + at
                n = np.minimum(n, lz.MAX_MATCH)
            else:
                n = o
            if b > a:
                lane2, o2 = self.lane[a:b], self.offset[a:b]
                was = own[lane2]
                new = np.flatnonzero((was & mask != o2) & (was >> HELD & mask != o2) & (was >> 2 * HELD != o2))
                lane2 = lane2[new]
                least = np.concatenate([np.full(len(lane), lz.MIN_MATCH), self.shortest[a:b][new]])
                start = np.concatenate([base[lane] + repeats[lane, kind], base[lane2] + fresh[a:b][new]])
                lane, kind, o, n = np.concatenate([lane, lane2]), np.concatenate([kind, np.full(len(new), codes.REPEATS)]), np.concatenate([o, o2[new]]), np.concatenate([n, self.length[a:b][new]])
            elif len(lane):
                least, start = np.full(len(lane), lz.MIN_MATCH), base[lane] + repeats[lane, kind]
            if not len(lane):
                continue
            # Every length from the least on, and the whole.
            many = np.maximum(np.minimum(n, EACH_LENGTH) - least, 0)
            way = np.repeat(np.arange(len(n)), many)
            goes = np.arange(len(way)) - np.repeat(np.cumsum(many) - many - least, many)
            c = np.concatenate([start[way] + each[lane[way] * wide + goes - lz.MIN_MATCH], start + (lengths[lane, _LENGTH_CODE[n]] + _LENGTH_EXTRA[n])])
            way, goes = np.concatenate([way, np.arange(len(n))]), np.concatenate([goes, n])
            to = node[lane[way]] + goes
            less = np.flatnonzero(c < best[to])
            c, to, way, goes = c[less], to[less], way[less], goes[less]
            np.minimum.at(best, to, c)
            # Of equally cheap ways the first is taken: it is written last.
            less = np.flatnonzero(c == best[to])
            less = less[np.argsort(-way[less], kind="stable")]
            to, way = to[less], way[less]
            step[to], value[to] = goes[less], o[way]
            was, k = own[lane[way]], kind[way]
            p, q, r = was & mask, was >> HELD & mask, was >> 2 * HELD
            held[to] = o[way] | np.where(k == 0, q, p) << HELD | np.where(k <= 1, r, q) << 2 * HELD
        on = np.zeros(total, bool)
        node, first = node0 + self.size, node0
        while len(node):
            on[node] = True
            node = node - step[node]
            more = node > first
            node, first = node[more], first[more]
        taken = np.flatnonzero(on)
        of = np.searchsorted(taken, j.bounds + np.arange(len(j.bounds)))
        # The node after a literal is that after its byte.
        byte = data[taken - 1 - np.repeat(np.arange(len(self.size)), np.diff(of))]
        match = step[taken] > 1
        return Tokens(np.where(match, step[taken], 0), np.where(match, value[taken], byte).astype(np.int32), np.diff(of))


def _alone(sizes: np.ndarray) -> np.ndarray:
    """Values so much longer than most others that they would go on alone, or nearly."""
    if len(sizes) < COMPANY:
        return np.ones(len(sizes), bool)
    return (sizes > 64 + 2 * np.partition(sizes, -COMPANY)[-COMPANY]) | (sizes >= 1 << HELD)


def optimal(joined: Joined, effort: lz.Effort, steps: Steps | None = None) -> Tokens:
    """As lz._optimal for each value: the smallest coded of the greedy parse and two cheapest paths."""
    size = np.diff(joined.bounds)
    alone = _alone(size) & (size > 0)
    together = np.flatnonzero(~alone & (size > 0))
    parts: list[Tokens] = []
    if len(together):
        own = steps.joined if steps else joined if len(together) == len(size) else Joined(joined.data[np.repeat(~alone, size)], bounds_of(size[together]))
        steps = steps or Steps(own, effort)
        found = [eager(own, *steps.longest, False)]
        for _ in range(2):
            found.append(steps.cheapest(found[-1]))
        coded = np.stack([np.concatenate([packed_sizes(t.part(i, j)) for i, j in groups(t.counts)]) for t in found])
        parts += found
        choice = coded.argmin(0)
    one = [lz.parse(joined.data[joined.bounds[k] : joined.bounds[k + 1]].tobytes(), "optimal", effort) for k in np.flatnonzero(alone).tolist()]
    flat = np.array([t for e in one for t in e], np.int32).reshape(-1, 2)
    parts.append(Tokens(flat[:, 0], flat[:, 1], np.array([len(e) for e in one], np.int64)))
    # Each value's tokens out of the part that has them.
    first = bounds_of(np.array([len(t.length) for t in parts]))[:-1]
    begin, counts = np.zeros((2, len(size)), np.int64)
    begin[alone], counts[alone] = first[-1] + bounds_of(parts[-1].counts)[:-1], parts[-1].counts
    if len(together):
        begin[together] = np.stack([f + bounds_of(t.counts)[:-1] for f, t in zip(first, parts[:-1], strict=False)])[choice, np.arange(len(together))]
        counts[together] = np.stack([t.counts for t in parts[:-1]])[choice, np.arange(len(together))]
    at = np.arange(int(counts.sum())) + np.repeat(begin - bounds_of(counts)[:-1], counts)
    return Tokens(np.concatenate([t.length for t in parts])[at], np.concatenate([t.value for t in parts])[at], counts)


def parse(joined: Joined, parser: str = "lazy", effort: lz.Effort = lz.Effort()) -> Tokens:
    """What lz.parse gives for each value; an empty one has no tokens."""
    if parser not in lz.PARSERS:
        raise ValueError(f"parser: one of {', '.join(lz.PARSERS)}")
    return optimal(joined, effort) if parser == "optimal" else eager(joined, *longest(joined, effort), parser == "lazy")


def parse_each(joined: Joined, parsers: tuple[str, ...], effort: lz.Effort = lz.Effort()) -> list[Tokens]:
    """The tokens by several parsers, whose matches are looked for once."""
    size = np.diff(joined.bounds)
    if "optimal" not in parsers or not size.all() or _alone(size).any():
        return [parse(joined, p, effort) for p in parsers]
    steps = Steps(joined, effort)
    return [optimal(joined, effort, steps) if p == "optimal" else eager(joined, *steps.longest, p == "lazy") for p in parsers]


def sizes(tokens: Tokens) -> np.ndarray:
    """How many bytes each value's tokens stand for; one that is malformed or reaches before the start is an error."""
    n, x = tokens.length.astype(np.int64), tokens.value
    step = np.where(n == 0, 1, n)
    ends, b = bounds_of(step), bounds_of(tokens.counts)
    at = ends[:-1] - np.repeat(ends[b[:-1]], tokens.counts)
    bad = np.where(n != 0, (n < lz.MIN_MATCH) | (n > lz.MAX_MATCH) | (x <= 0) | (x > at), (x < 0) | (x >= codes.LITERALS))
    if bad.any():
        k = int(bad.argmax())
        raise Corrupted(f"token ({n[k]}, {x[k]}) at {at[k]}")
    return np.diff(ends[b])


def replay(tokens: Tokens) -> np.ndarray:
    """The bytes of all values end to end, of tokens that sizes() has let pass."""
    match = tokens.length > 0
    step = np.where(match, tokens.length, 1)
    starts = bounds_of(step)[:-1]
    total = int(step.sum())
    made = np.zeros(total, np.uint8)
    made[starts[~match]] = tokens.value[~match]
    # Each byte of a match is the one offset before it; ways are joined until all end at literals.
    source = np.arange(total, dtype=np.int64)
    open_ = np.flatnonzero(np.repeat(match, step))
    source[open_] -= np.repeat(tokens.value[match], step[match])
    where = open_
    while len(open_):
        on = source[source[open_]]
        moved = on != source[open_]
        source[open_] = on
        open_ = open_[moved]
    made[where] = made[source[where]]
    return made


def _scaled(seen: np.ndarray, log: np.ndarray) -> np.ndarray:
    """tans.scaled of each row of counts."""
    total, room = seen.sum(1), np.left_shift(1, log)
    share = np.where(seen > 0, np.maximum(seen * room[:, None] // total[:, None], 1), 0)
    spare = room - share.sum(1)
    rows, top = np.arange(len(seen)), seen.argmax(1)
    order = None
    share0 = share.copy()
    change = np.where(spare >= 0, spare, -np.minimum(-spare, share[rows, top] - 1))
    share[rows, top] += change
    for r in np.flatnonzero((spare < 0) & (change != spare)).tolist():
        left = int(spare[r] - change[r])
        order = np.argsort(-share0[r], kind="stable").tolist()
        for s in order:
            if left >= 0:
                break
            less = min(-left, max(int(share[r, s]) - 1, 0))
            share[r, s] -= less
            left += less
    return share


def _walked(symbols: np.ndarray, counts: np.ndarray, row: np.ndarray, freqs: np.ndarray, log: np.ndarray) -> list[np.ndarray]:
    """For each stream of one alphabet: bits, moves and table of its symbols' coder.  row: the stream of each symbol."""
    size = np.left_shift(1, log)
    begin = bounds_of(size)
    table = np.empty(int(begin[-1]), np.int32)
    for g in np.unique(log).tolist():
        rows = np.flatnonzero(log == g)
        n = 1 << g
        order = (np.arange(n) * ((n >> 1) + (n >> 3) + 3) & (n - 1)).astype(np.int32)
        dealt = np.repeat(np.tile(np.arange(freqs.shape[1], dtype=np.int32), len(rows)), freqs[rows].ravel()).reshape(len(rows), n)
        both = (dealt << g) + order
        both.sort(axis=1)
        table[(begin[rows][:, None] + np.arange(n)).ravel()] = ((both & (n - 1)) + n).ravel()
    f = freqs[row, symbols]
    first = (np.cumsum(freqs, axis=1) - freqs)[row, symbols]
    length = np.frexp(f.astype(np.float64))[1].astype(np.int64)
    least = log[row] + 1 - length
    return [x.astype(np.int32) for x in (least, f << least, begin[row] + first - f)] + [table]


def _state_bits(streams: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Bits of each stream's states, those of its last state first included; streams: symbols, counts, frequencies, logs by alphabet."""
    parts, at = [], 0
    for symbols, counts, freqs, log in streams:
        least, bound, move, table = _walked(symbols, counts, np.repeat(np.arange(len(counts)), counts), freqs, log)
        parts.append((least, bound, move + at, table))
        at += len(table)
    least, bound, move, table = (np.concatenate(x) for x in zip(*parts, strict=True))
    counts, logs = np.concatenate([s[1] for s in streams]), np.concatenate([s[3] for s in streams])
    ends = np.cumsum(counts) - 1
    by = np.argsort(-counts, kind="stable")
    state, bits, last, left = np.left_shift(1, logs[by]), np.zeros(len(by), np.int64), ends[by], counts[by]
    step, active = 0, len(by)
    falling = -left
    while True:
        active = int(np.searchsorted(falling[:active], -step, "left"))
        if active < LANES:
            break
        k = last[:active] - step
        s = state[:active]
        n = least[k] - (s < bound[k])
        bits[:active] += n
        state[:active] = table[move[k] + (s >> n)]
        step += 1
    for i in range(active):
        a, b = int(last[i] - left[i] + 1), int(last[i] - step + 1)
        s, total = int(state[i]), 0
        for l, u, m in zip(least[a:b][::-1].tolist(), bound[a:b][::-1].tolist(), move[a:b][::-1].tolist(), strict=True):
            n = l - (s < u)
            total += n
            s = int(table[m + (s >> n)])
        bits[i] += total
    out = np.empty(len(by), np.int64)
    out[by] = bits + logs[by]
    return out


def _offset_codes(offsets: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and extra bits of all offsets, repeats by their place among the last three of each value."""
    plain = np.searchsorted(codes.OFFSET_BASE, offsets, "right") - 1
    # Each value's offsets after the three that are held at first, oldest first.
    start, held = bounds_of(counts + 3)[:-1], codes.FIRST_OFFSETS[::-1]
    own = np.ones(len(offsets) + 3 * len(counts), bool)
    for k in range(3):
        own[start + k] = False
    all_ = np.empty(len(own), np.int64)
    all_[own] = offsets
    for k in range(3):
        all_[start + k] = held[k]
    # One that equals the newest changes nothing; without these, the second newest is two before.
    fresh = np.ones(len(own), bool)
    fresh[1:] = all_[1:] != all_[:-1]
    fresh[start] = True
    u, of = all_[fresh], own[fresh]
    second, third = np.zeros(len(u), bool), np.zeros(len(u), bool)
    second[2:] = of[2:] & (u[2:] == u[:-2])
    # The third newest is what was second newest at the last offset that wasn't.
    moved = np.maximum.accumulate(np.where(second, -1, np.arange(len(u))))
    third[3:] = of[3:] & ~second[3:] & (u[3:] == u[np.maximum(moved[2:-1] - 2, 0)])
    code = np.zeros(len(own), np.int64)
    code[fresh] = np.where(second, 1, np.where(third, 2, -1))
    code = code[own]
    return np.where(code < 0, plain + codes.REPEATS, code), np.where(code < 0, np.array(codes.OFFSET_EXTRA)[plain], 0)


def packed_sizes(tokens: Tokens) -> np.ndarray:
    """len(tans.encode_tokens(...)) of each value's tokens, by the same walk through the coder's states."""
    many = len(tokens.counts)
    if not many:
        return np.zeros(0, np.int64)
    if not tokens.counts.all():
        raise EmptyInput("no tokens")
    row = np.repeat(np.arange(many), tokens.counts)
    match = tokens.length > 0
    n_match = np.bincount(row[match], minlength=many)
    length_codes = np.searchsorted(codes.LENGTH_BASE, tokens.length[match], "right") - 1
    offset_codes, offset_extra = _offset_codes(tokens.value[match], n_match)
    extra = np.bincount(row[match], np.array(codes.LENGTH_EXTRA)[length_codes] + offset_extra, many).astype(np.int64)
    kinds = (tokens.counts + 7) // 8
    out = np.where(kinds > 0xFFFF, 16, 14) + kinds + (extra + 7) // 8
    head, streams, owners = np.zeros(many, np.int64), [], []
    for symbols, of, alphabet, start in zip((tokens.value[~match].astype(np.int64), length_codes, offset_codes), (row[~match], row[match], row[match]), tans.ALPHABETS, tans.DEFAULT_LOG, strict=True):
        seen = np.bincount(of * alphabet + symbols, minlength=many * alphabet).reshape(many, alphabet)
        total, different = seen.sum(1), (seen > 0).sum(1)
        head += 16 * (different == 1)
        rows = np.flatnonzero(different > 1)
        if not len(rows):
            continue
        log = np.full(len(rows), start)
        for _ in range(start - tans.MIN_LOG):
            log -= (log > tans.MIN_LOG) & (np.left_shift(1, log) > 2 * total[rows])
        for _ in range(tans.MAX_LOG - tans.MIN_LOG):
            log += (log < tans.MAX_LOG) & (np.left_shift(1, log) < different[rows])
        freqs = _scaled(seen[rows], log)
        used = freqs > 0
        head[rows] += 16 + (alphabet - used[:, ::-1].argmax(1)) + log * used.sum(1)
        streams.append((symbols[(different > 1)[of]], total[rows], freqs, log))
        owners.append(rows)
    out += (head + 7) // 8
    if streams:
        np.add.at(out, np.concatenate(owners), 4 + (_state_bits(streams) + 7) // 8)
    return out
