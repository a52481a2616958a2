"""Maximal repeats over a sparse enhanced suffix array, and removal of repeated bytes.

A string of ``least`` bytes has one anchor: the place of the smallest hash of
a ``gram``-byte piece in it, leftmost of equals.  Equal strings have equal
anchors at equal places, so it is enough to index the anchors, about one
suffix in 85.

1. Anchors: hash of the anchor's gram (h), digest of its context (c: up to
   ``least - gram`` bytes before and ``least`` from the anchor, within the
   document).  They are written once.
2. Grams are counted (combined before they are shuffled); only anchors of grams
   with several occurrences go on.  Their contexts are counted by (h, c), and the
   contexts by h.  No gram's rows are gathered in one place for this.  A context
   that occurs twice or more repeats whole: equal leaves of the tree below.
3. Where a gram has several contexts, one occurrence of each is read, and the
   contexts are sorted by the text from the anchor on (Spark's spilling sort):
   the suffix array.  A stack scan over its LCP array gives the common-prefix
   intervals; in each, the left contexts, sorted backwards, are scanned the
   same way.  A group whose members differ to the right (they lie in several
   children of the interval) and to the left (the left scan's interval ends)
   is a maximal repeat with all of its occurrences.
4. Each context thus has a covered span around its anchor; the spans go back
   to all of its occurrences, and the union of a document's spans is removed.

A gram with more than ``max_group`` different contexts isn't gathered in one
task.  For the spans its windows of ``least`` bytes are compared by two 64-bit
hashes in an ordinary aggregation; for the groups the nodes of its two trees are
made by aggregations over prefixes.  Both give what the scan gives.

``repeat_groups`` extends every group beyond the anchors' contexts, as far as
all of its occurrences go along, so that each is a maximal repeat of the texts.
A maximal repeat is missing only if each context inside it also occurs in
further places; then the groups of those contexts stand for it.

Bytes are those of UTF-8.  Null and empty texts, and texts of fewer than
``least`` bytes, keep all their bytes.  Repeated rows are repeats of each other.
Other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import attach, keyed, written

LEAST, GRAM, MAX_GROUP, STRETCH = 200, 32, 100_000, 2 << 20
#: Odd multipliers of the rolling hash.
MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def gram_hashes(buf: bytes, gram: int) -> np.ndarray:
    """A 64-bit hash of the gram at each byte; gram is a multiple of 8."""
    n = len(buf)
    eight = np.zeros(n, np.uint64)
    for o in range(8):
        part = np.frombuffer(buf, "<u8", (n - o) // 8, o)
        eight[o : o + 8 * len(part) : 8] = part
    m = n - gram + 1
    h = np.zeros(m, np.uint64)
    for k in range(gram // 8):
        h = (h ^ (h >> np.uint64(31)) ^ eight[8 * k : 8 * k + m]) * MIX[k % len(MIX)]
    return h ^ (h >> np.uint64(32))


def window_anchors(h: np.ndarray, ends: np.ndarray, starts: np.ndarray, least: int, gram: int) -> np.ndarray:
    """Sorted places of the anchors of all windows that lie in one document each."""
    w = least - gram + 1
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    room = -len(key) % w
    block = np.append(key, np.full(room, np.iinfo(np.uint64).max)).reshape(-1, w)
    first = np.minimum.accumulate(block, axis=1).ravel()
    last = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(key) - w + 1
    anchor = (np.minimum(last[:count], first[w - 1 : w - 1 + count]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(count + 1, np.int32)
    for a, e in zip(starts, ends, strict=True):
        if e - a >= least:
            inside[a] += 1
            inside[e - least + 1] -= 1
    anchor = anchor[np.cumsum(inside[:-1]) > 0]
    return anchor[np.append(True, anchor[1:] != anchor[:-1])] if len(anchor) else anchor


def _anchor_map(least: int, gram: int):
    """Rows of the anchors of each stretch of documents."""

    def rows(ids, ths, texts):
        import xxhash

        buf = b"".join(texts)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lengths)
        starts = ends - lengths
        if len(buf) < least:
            return None
        h = gram_hashes(buf, gram)
        at = window_anchors(h, ends, starts, least, gram)
        if not len(at):
            return None
        doc = np.searchsorted(ends, at, side="right")
        left = np.minimum(at - starts[doc], least - gram)
        right = np.minimum(ends[doc] - at, least)
        digest = xxhash.xxh3_64_intdigest
        view = memoryview(buf)
        c = np.fromiter((digest(view[a - x : a + y], x) for a, x, y in zip(at.tolist(), left.tolist(), right.tolist(), strict=True)), np.uint64, len(at)).view(np.int64)
        take = pa.array(doc)
        columns = [pa.array(ids).take(take), pa.array(ths, pa.int64()).take(take), pa.array((at - starts[doc]).astype(np.int32)), pa.array(left.astype(np.int16)), pa.array(right.astype(np.int16)), pa.array(h[at].view(np.int64)), pa.array(c)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "pos", "lft", "rgt", "h", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ths, texts, room = [], [], [], STRETCH
        for b in batches:
            kind = b.column("doc_id").type
            for i, t, x in zip(b.column("doc_id"), b.column("th"), b.column("text"), strict=True):
                x = x.as_py()
                ids.append(i.as_py())
                ths.append(t.as_py())
                texts.append(x)
                room -= len(x) + 64
                if room < 0:
                    if (out := rows(pa.array(ids, kind), ths, texts)) is not None:
                        yield out
                    ids, ths, texts, room = [], [], [], STRETCH
        if ids and (out := rows(pa.array(ids, kind), ths, texts)) is not None:
            yield out

    return run


def _texts(docs: DataFrame) -> DataFrame:
    return keyed(docs).select("doc_id", "th", F.col("text").cast("binary").alias("text"))


class Index(NamedTuple):
    """alive: doc_id, th, pos, lft, rgt, h, c of every anchor whose gram occurs elsewhere; each: h, c, n and one occurrence of each context; many: h and others, how many contexts it has, where that is two or more."""

    alive: DataFrame
    each: DataFrame
    many: DataFrame


def index(docs: DataFrame, least: int = LEAST, gram: int = GRAM) -> Index:
    kind = docs.schema["doc_id"].dataType.simpleString()
    anchors = written(_texts(docs).mapInArrow(_anchor_map(least, gram), f"doc_id {kind}, th bigint, pos int, lft smallint, rgt smallint, h bigint, c bigint"))
    # Written, here and below, so that the joins' sides are plain exchanges and a gram that very many documents share is split among tasks.
    shared = written(anchors.groupBy("h").agg(F.count("*").alias("m")).where("m > 1").select("h"))
    alive = written(anchors.join(shared, "h", "left_semi"))
    each = written(alive.groupBy("h", "c").agg(F.count("*").alias("n"), *(F.first(x).alias(x) for x in ("doc_id", "th", "pos", "lft", "rgt"))))
    many = written(each.groupBy("h").agg(F.count("*").alias("others")).where("others > 1"))
    return Index(alive, each, many)


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """LCP intervals (length, first, last) by a stack scan; lcp[i] is shared by i - 1 and i, lcp[0] is ignored."""
    stack = [(-1, 0)]
    for i in range(1, len(lcp) + 1):
        v = lcp[i] if i < len(lcp) else -1
        lo = i - 1
        while stack[-1][0] > v:
            top, lo = stack.pop()
            yield top, lo, i - 1
        if stack[-1][0] < v:
            stack.append((v, lo))


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def _adjacent(rows: list[bytes], width: int) -> list[int]:
    """Common prefixes of neighbours, 0 for the first."""
    if len(rows) < 64:
        return [0, *(_shared(a, b) for a, b in zip(rows, rows[1:], strict=False))]
    out = np.zeros(len(rows), np.int64)
    for at in range(0, len(rows) - 1, 8192):
        part = rows[at : at + 8193]
        size = np.fromiter(map(len, part), np.int64, len(part))
        m = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in part), np.uint8).reshape(len(part), width)
        same = m[1:] == m[:-1]
        run = np.where(same.all(axis=1), width, same.argmin(axis=1))
        out[at + 1 : at + len(part)] = np.minimum(run, np.minimum(size[1:], size[:-1]))
    return out.tolist()


def maximal_repeats(rights: list[bytes], lefts: list[bytes], least: int, gram: int) -> Iterator[tuple[int, int, list[int]]]:
    """(right length, left length, members) of every maximal repeat of at least least bytes around one gram.

    rights: texts from the anchors on, sorted; lefts: the texts before them, reversed.
    """
    if len(rights) == 2:
        r, x = _shared(*rights), _shared(*lefts)
        if r + x >= least:
            yield r, x, [0, 1]
        return
    lcp = _adjacent(rights, least)
    for r, lo, hi in intervals(lcp):
        if r < gram:
            continue
        child, children = 0, {}
        for i in range(lo, hi + 1):
            child += i > lo and lcp[i] == r
            children[i] = child
        order = sorted(range(lo, hi + 1), key=lefts.__getitem__)
        for x, a, b in intervals(_adjacent([lefts[i] for i in order], least - gram)):
            if r + x >= least:
                members = order[a : b + 1]
                if any(children[i] != children[members[0]] for i in members):
                    yield r, x, members


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, tuple[bytes, bytes, int]]]]:
    """(h, c: (right, reversed left, occurrences)) of sorted rows, each h once."""
    now, own = None, {}
    for b in batches:
        for h, c, x, ctx, n in zip(*(b.column(k).to_pylist() for k in ("h", "c", "lft", "ctx", "n")), strict=True):
            if h != now:
                if own:
                    yield now, own
                now, own = h, {}
            own[c] = (ctx[x:], ctx[:x][::-1], n)
    if own:
        yield now, own


def _covered_map(least: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, cs, fr, to = [], [], [], []
        for h, own in _groups(batches):
            if len(own) < 2:
                continue
            names = list(own)
            best: dict[int, tuple[int, int]] = {}
            for r, x, members in maximal_repeats([own[c][0] for c in names], [own[c][1] for c in names], least, gram):
                for i in members:
                    a, b = best.get(i, (0, 0))
                    best[i] = max(a, x), max(b, r)
            for i, (a, b) in best.items():
                hs.append(h)
                cs.append(names[i])
                fr.append(-a)
                to.append(b)
            if len(hs) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(cs, pa.int64()), pa.array(fr, pa.int32()), pa.array(to, pa.int32())], ["h", "c", "fr", "til"])
                hs, cs, fr, to = [], [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(cs, pa.int64()), pa.array(fr, pa.int32()), pa.array(to, pa.int32())], ["h", "c", "fr", "til"])

    return run


def holds_anchor(shared: bytes, at: int, least: int, gram: int) -> bool:
    """Whether the gram at that place is the anchor of some window inside a shared string.

    If so, it is an anchor wherever the string occurs; if not, other anchors find the string, at all of its places.
    """
    size = np.array([len(shared)])
    return at in window_anchors(gram_hashes(shared, gram), size, size - size, least, gram)


def _groups_map(least: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, own in _groups(batches):
            # A context that occurs more than once is two equal leaves.
            names, out = [c for c, (*_, n) in own.items() for _ in range(min(n, 2))], []
            for k, (r, x, members) in enumerate(maximal_repeats([own[c][0] for c in names], [own[c][1] for c in names], least, gram) if len(names) > 1 else ()):
                right, left, _ = own[names[members[0]]]
                if holds_anchor(left[:x][::-1] + right[:r], x, least, gram):
                    out += [(h, k, r + x, c, x) for c in dict.fromkeys(names[i] for i in members)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32()), strict=True)], ["h", "k", "length", "c", "back"])

    return run


def _read(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted with ctx, the bytes of each context."""
    text, row = _texts(docs), wanted.withColumnsRenamed({"doc_id": "_doc_id", "th": "_th"})
    met = text.join(row, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("th") == F.col("_th")))
    # Repeated rows of the table give a context more than once; it repeats whole then, and is no more than that below.
    return met.select("h", "c", "n", F.col("lft").cast("int").alias("lft"), F.substring("text", F.col("pos") - F.col("lft") + 1, F.col("lft") + F.col("rgt")).alias("ctx"))


def _sorted(read: DataFrame) -> DataFrame:
    return read.repartition("h").sortWithinPartitions("h", F.substring("ctx", F.col("lft") + 1, F.lit(1 << 30)), "c").select("h", "c", "lft", "ctx", "n")


def _split(docs: DataFrame, found: Index, max_group: int) -> tuple[DataFrame, DataFrame | None]:
    """The contexts, with their bytes, of grams with up to max_group contexts, and of the others, if there are any."""
    few = _read(docs, found.each.join(found.many.where(F.col("others") <= max_group), "h"))
    crowd = found.many.where(F.col("others") > max_group)
    return few, _read(docs, found.each.join(crowd, "h")) if crowd.limit(1).count() else None


def _whole(found: Index, least: int) -> DataFrame:
    return found.each.where((F.col("n") > 1) & (F.col("lft") + F.col("rgt") >= least))


def covered(docs: DataFrame, found: Index, least: int = LEAST, gram: int = GRAM, max_group: int = MAX_GROUP) -> DataFrame:
    """h, c, fr, til: for each context that repeats, the repeated bytes around its anchor (fr <= 0, til exclusive)."""
    few, crowd = _split(docs, found, max_group)
    parts = _whole(found, least).select("h", "c", (-F.col("lft")).cast("int").alias("fr"), F.col("rgt").cast("int").alias("til"))
    parts = parts.unionByName(_sorted(few).mapInArrow(_covered_map(least, gram), "h bigint, c bigint, fr int, til int"))
    if crowd is not None:
        parts = parts.unionByName(_by_windows(crowd, least))
    return parts.groupBy("h", "c").agg(F.min("fr").alias("fr"), F.max("til").alias("til"))


def _by_windows(read: DataFrame, least: int) -> DataFrame:
    each = read.select("h", "c", "n", "lft", "ctx", F.explode(F.when(F.length("ctx") >= least, F.sequence(F.lit(0), F.length("ctx") - least))).alias("i"))
    cut_out = F.substring(F.col("ctx"), F.col("i") + 1, F.lit(least))
    each = each.select("h", "c", "n", (F.col("i") - F.col("lft")).alias("fr"), F.xxhash64(cut_out).alias("x"), F.xxhash64(F.lit(1), cut_out).alias("y"))
    many = each.groupBy("h", "fr", "x", "y").agg(F.sum("n").alias("m")).where("m > 1")
    return each.join(many, ["h", "fr", "x", "y"], "left_semi").select("h", "c", "fr", (F.col("fr") + least).alias("til"))


def _diverse(side: str) -> list[Column]:
    return [F.min(side).alias(f"{side}_low"), F.max(side).alias(f"{side}_high")]


def _by_prefixes(read: DataFrame, least: int, gram: int) -> DataFrame:
    """h, k, length, c, back of every maximal repeat around a gram, as _groups_map has them: the trees' nodes by aggregation.

    A node is a common prefix that goes on in different ways (or ends); the
    prefixes are compared by two 64-bit hashes.
    """
    # Where the bytes differ or end, the node branches.
    branches = lambda side: (F.col(f"{side}_low") != F.col(f"{side}_high")) | (F.length(f"{side}_low") == 0)
    both = lambda x: (F.xxhash64(x), F.xxhash64(F.lit(1), x))
    each = read.select("h", "c", "lft", "ctx", F.least("n", F.lit(2)).alias("n"), F.explode(F.sequence(F.lit(gram), F.length("ctx") - F.col("lft"))).alias("r"))
    a, b = both(F.substring(F.col("ctx"), F.col("lft") + 1, F.col("r")))
    each = each.select("h", "c", "n", "lft", "ctx", "r", a.alias("a"), b.alias("b"), F.substring(F.col("ctx"), F.col("lft") + F.col("r") + 1, F.lit(1)).alias("next"))
    node = ["h", "r", "a", "b"]
    right = each.groupBy(*node).agg(F.sum("n").alias("m"), *_diverse("next")).where((F.col("m") > 1) & branches("next")).select(*node)
    first = F.greatest(F.lit(0), least - F.col("r"))
    back = each.join(right, node, "left_semi").where(first <= F.col("lft")).select(*node, "c", "n", "lft", "ctx", "next", F.explode(F.sequence(first, F.col("lft"))).alias("x"))
    c, d = both(F.substring(F.col("ctx"), F.col("lft") - F.col("x") + 1, F.col("x")))
    before = F.when(F.col("x") < F.col("lft"), F.substring(F.col("ctx"), F.col("lft") - F.col("x"), F.lit(1))).otherwise(F.lit(b""))
    back = back.select(*node, "x", c.alias("p"), d.alias("q"), "c", "n", "next", before.alias("prev"), F.substring(F.col("ctx"), F.col("lft") - F.col("x") + 1, F.col("x") + F.col("r")).alias("shared"))
    name = [*node, "x", "p", "q"]
    left = back.groupBy(*name).agg(F.sum("n").alias("m"), *_diverse("next"), *_diverse("prev")).where((F.col("m") > 1) & branches("next") & branches("prev")).select(*name)

    @F.pandas_udf("boolean")
    def held(shared: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series([holds_anchor(s, x, least, gram) for s, x in zip(shared, at, strict=True)])

    return back.join(left, name, "left_semi").where(held("shared", "x")).select("h", F.xxhash64(*name[1:]).alias("k"), (F.col("r") + F.col("x")).alias("length"), "c", F.col("x").alias("back"))


def _pieces(docs: DataFrame, least: int, gram: int, max_group: int) -> DataFrame:
    """repeat, length, doc_id, th, start: the maximal repeats around each anchor within the contexts, at all their occurrences."""
    found = index(docs, least, gram)
    few, crowd = _split(docs, found, max_group)
    # A gram's only context, if it occurs more than once, is a tree of equal leaves: k is null.
    parts = _whole(found, least).join(found.many, "h", "left_anti").select("h", F.lit(None).cast("bigint").alias("k"), (F.col("lft") + F.col("rgt")).cast("int").alias("length"), "c", F.col("lft").cast("int").alias("back"))
    parts = parts.unionByName(_sorted(few).mapInArrow(_groups_map(least, gram), "h bigint, k bigint, length int, c bigint, back int"))
    if crowd is not None:
        parts = parts.unionByName(_by_prefixes(crowd, least, gram))
    name = F.concat_ws("-", F.hex("h"), F.coalesce(F.hex("k"), F.concat(F.lit("c"), F.hex("c"))), "length", "back")
    every = written(parts.select("h", "c", name.alias("repeat"), "length", "back")).join(found.alive, ["h", "c"])
    return every.select("repeat", F.col("length").cast("int").alias("length"), "doc_id", "th", (F.col("pos") - F.col("back")).alias("start"))


def _common(low: Column, high: Column) -> Column:
    """Bytes that all strings between these two, in hex, share at their start: the least and the greatest share what all share."""
    most = F.floor(F.least(F.length(low), F.length(high)) / 2).cast("int")
    same = F.transform(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), lambda i: F.substring(low, 2 * i - 1, F.lit(2)) == F.substring(high, 2 * i - 1, F.lit(2)))
    first = F.array_position(same, False).cast("int")
    return F.when(most == 0, 0).when(first == 0, most).otherwise(first - 1)


def repeat_groups(docs: DataFrame, least: int = LEAST, gram: int = GRAM, max_group: int = MAX_GROUP, step: int = 256) -> DataFrame:
    """repeat, length, doc_id, th, start: all occurrences of the maximal repeats of at least least bytes.

    Pieces are extended step bytes at a time on either side while all of their
    occurrences go along; pieces that grow to the same repeat are given once.
    Repeated rows of the table count as one occurrence each.
    """
    open_ones, done = written(_pieces(docs, least, gram, max_group)), []
    text = _texts(docs).dropDuplicates(["doc_id", "th"])
    while not open_ones.isEmpty():
        key = open_ones.withColumnsRenamed({"doc_id": "_doc_id", "th": "_th"})
        met = key.join(text, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("th") == F.col("_th")))
        turned = F.reverse(F.expr("regexp_extract_all(hex(substring(text, greatest(start - %d, 0) + 1, least(start, %d))), '..', 0)" % (step, step)))
        sides = met.select("repeat", "length", F.array_join(turned, "").alias("before"), F.hex(F.substring(F.col("text"), F.col("start") + F.col("length") + 1, F.lit(step))).alias("after"))
        grown = sides.groupBy("repeat").agg(F.max("length").alias("size"), *(f(x).alias(f"{x}_{n}") for x in ("before", "after") for f, n in ((F.min, "low"), (F.max, "high"))))
        grown = grown.select("repeat", "size", _common(F.col("before_low"), F.col("before_high")).alias("back"), _common(F.col("after_low"), F.col("after_high")).alias("on"))
        moved = written(open_ones.join(grown, "repeat").select("repeat", (F.col("length") + F.col("back") + F.col("on")).cast("int").alias("length"), "doc_id", "th", (F.col("start") - F.col("back")).cast("int").alias("start"), ((F.col("back") == step) | (F.col("on") == step)).alias("more")))
        # Pieces that have become the same repeat are one from here on: a repeat is told by its first occurrence, its length and its number.
        first = moved.groupBy("repeat").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "start")).alias("first"), F.max("length").alias("size"), F.count("*").alias("m"))
        stay = first.groupBy("first", "size", "m").agg(F.min("repeat").alias("repeat")).select("repeat")
        moved = written(moved.join(stay, "repeat", "left_semi"))
        done.append(moved.where(~F.col("more")).drop("more"))
        open_ones = moved.where("more").drop("more")
    if not done:
        return open_ones
    every = functools.reduce(DataFrame.unionByName, done)
    # Pieces that ended in different rounds may be the same, too.
    first = every.groupBy("repeat").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "start")).alias("first"), F.max("length").alias("size"), F.count("*").alias("m"))
    return every.join(first.groupBy("first", "size", "m").agg(F.min("repeat").alias("repeat")).select("repeat"), "repeat", "left_semi")


def spans(docs: DataFrame, least: int = LEAST, gram: int = GRAM, max_group: int = MAX_GROUP) -> DataFrame:
    """doc_id, th, spans: the repeated byte spans (s, e) of each document that has any, sorted, not yet merged."""
    index_of = index(docs, least, gram)
    found = written(covered(docs, index_of, least, gram, max_group))
    met = index_of.alive.join(found, ["h", "c"])
    return met.select("doc_id", "th", F.struct((F.col("pos") + F.col("fr")).alias("s"), (F.col("pos") + F.col("til")).alias("e")).alias("span")).groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("span")).alias("spans"))


def _merged(found: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for x in found:
        if out and x["s"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], x["e"])
        else:
            out.append([x["s"], x["e"]])
    return [(a, b) for a, b in out]


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sizes, gone, runs, digests = [], [], [], []
        for text, found in zip(b.column("text"), b.column("spans"), strict=True):
            text, merged, at, kept = text.as_py(), _merged(found.as_py() or []), 0, hashlib.sha256()
            for s, e in merged:
                kept.update(text[at:s])
                at = e
            kept.update(text[at:])
            sizes.append(len(text))
            gone.append(sum(e - s for s, e in merged))
            runs.append(len(merged))
            digests.append(kept.hexdigest())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def report(docs: DataFrame, least: int = LEAST, gram: int = GRAM, max_group: int = MAX_GROUP) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    both = attach(_texts(docs), spans(docs, least, gram, max_group)).select("doc_id", "text", "spans")
    return both.mapInArrow(_remove, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
