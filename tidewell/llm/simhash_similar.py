"""SimHash near-duplicates by similarity: wide fingerprints, the generalised pigeonhole, exact verification.

``simhash`` links 64-bit fingerprints within 2 bits, which is a similarity of
about 0.98.  Here texts are linked whose sets of ``shingle``-word shingles
have a Jaccard similarity of ``similarity`` or more:

1. Each text's distinct shingle hashes give a fingerprint of ``BITS`` bits.
   Texts of equal fingerprints are one node.
2. Bits that go along with the corpus' common direction are correlated; the
   bits are ranked by that correlation, measured over all nodes, and cut to
   parts of ``width`` neighbours in rank.  Several partitions of the same bits
   (dealt anew among neighbours in rank) give as many parts as are needed.  The
   width follows from the number of nodes by the same cost as below.
3. Each part gets a threshold of -1 (not probed), 0 or 2 by dynamic
   programming: least cost of probes and candidates such that a pair of just
   ``similarity`` meets in some part with a chance of ``recall`` (as if all bits
   were alike; the parts that are left out are those where texts differ least,
   which costs some of it).  Candidates of
   a part are the pairs of equal keys, counted over all nodes of one in
   ``ONE_IN`` of the keys.  That may miss the key of a large group, so where a
   sketch of the keys' second moment over all nodes is well above its noise, it
   counts instead: a part that many texts share is dear and mostly left out.
4. Nodes of equal part keys (threshold 2: of forms with at most one flipped bit)
   meet.  In a bucket of two or three every pair is a candidate.  Each larger
   one has a centre, the member that meets most others, and each node is a
   candidate with one of the centres of its buckets.
5. Candidates within ``near`` bits are verified: the similarity of the two
   shingle sets is computed from the whole texts.
6. In larger buckets, members that the links so far leave in different
   components are compared, blocks of members against all of them: first each
   one's nearest is verified, then every pair within ``near`` that is still
   between different components.  So no pair that could join two is left out.
7. Components of the verified links.

Links are exact, never estimated.  ``near`` leaves out one pair in a hundred at
just ``similarity`` and fewer above it; the README gives the measured recall.

Null and empty texts are equal to each other; a text of fewer words than a
shingle is one shingle.  Repeated rows share their node.  Null and repeated ids
are kept apart by their texts; a component without any id has a null
component_id.  An empty table has an empty result.  Other columns are ignored by
``assign`` and passed through by ``dedup``, whatever their names.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.llm.common import cut, indices, keyed, let, let_go, split_words
from tidewell.llm.components import connect, keep_one, named

SHINGLE, SIMILARITY, RECALL, MAX_BROADCAST = 5, 0.8, 0.98, 500_000
WORDS = 12
BITS = 64 * WORDS
#: Members of a bucket that are compared with all of it in one place; a candidate's cost in probes.
BLOCK, PAIR_COST = 2048, 40
#: Members of a bucket whose pairs are all looked at at once.
FEW = 3
#: Widths that are tried; steps in which chances are counted; counters of a part's sketch.
WIDTHS, STEPS, CELLS, GATHERED = range(12, 41), 20_000, 64, 16
#: Of so many keys one is counted exactly; fewer where there are few nodes: there is one for each ENOUGH of them.
ONE_IN, ENOUGH = 16, 2048
#: Hashes that are folded at a time; hashes whose bits one byte can count.
CHUNK, BYTE = 1 << 18, 255
LANE = np.uint64(0x0101010101010101)
NAMES = [f"f{k}" for k in range(WORDS)]


def shingle_set(text: Column, k: int = SHINGLE) -> Column:
    """The distinct shingle hashes of a text."""

    def of(w: Column) -> Column:
        many = F.transform(indices(F.size(w), k - 1), lambda i: F.xxhash64(*(w[i - (k - 1 - j)] for j in range(k))))
        return F.when(F.size(w) >= k, F.array_distinct(many)).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))

    return let(split_words(text, True, False), of)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """A further hash of each hash, independent for each k."""
    y = h + np.uint64((k * 0x9E3779B97F4A7C15) % (1 << 64))
    y = (y ^ (y >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    y = (y ^ (y >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return y ^ (y >> np.uint64(31))


def wide(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The fingerprints (documents x WORDS): bits set in over half of a document's hashes.  values: all hashes, document by document."""
    out = np.zeros((len(sizes), WORDS), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    n = sizes[full]
    pieces = -(-n // BYTE)
    first = np.cumsum(pieces) - pieces
    at = np.repeat(np.cumsum(n) - n - BYTE * first, pieces) + BYTE * np.arange(pieces.sum())
    for k in range(WORDS):
        y, ones = _mixed(values, k), np.empty((len(at), 8, 8), np.uint8)
        for b in range(8):
            # Eight counters of a byte each in one sum.
            ones[:, b] = np.add.reduceat((y >> np.uint64(b)) & LANE, at).view(np.uint8).reshape(-1, 8)
        total = np.add.reduceat(ones, first, axis=0, dtype=np.int64)
        most = (2 * total > n[:, None, None]).transpose(0, 2, 1).reshape(len(full), 64)
        out[full, k] = np.packbits(most, axis=1, bitorder="little").view("<u8").ravel()
    return out


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column("h")
        values, ends = lists.values.to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy().astype(np.int64)
        made, i = [], 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + CHUNK, side="right")) - 1)
            made.append(wide(values[ends[i] : ends[j]], np.diff(ends[i : j + 1])))
            i = j
        f = np.vstack([np.zeros((0, WORDS), np.uint64), *made]).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), *(pa.array(f[:, k]) for k in range(WORDS))], ["doc_id", "th", *NAMES])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, th, the fingerprint's words f0 .. and node, its hash."""
    rows = keyed(docs).select("doc_id", "th", shingle_set(F.col("text"), shingle).alias("h"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_fold, f"doc_id {kind}, th bigint, " + ", ".join(f"{w} bigint" for w in NAMES)).withColumn("node", F.xxhash64(*NAMES))


def apart(similarity: float) -> float:
    """The share of bits in which two sets of that similarity differ on average, at most."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def reach(similarity: float) -> int:
    """Bits within which all but one in a hundred pairs of just that similarity lie."""
    p = apart(similarity)
    return math.ceil(BITS * p + 2.4 * math.sqrt(BITS * p * (1 - p)))


def _bits(b: pa.RecordBatch) -> np.ndarray:
    f = np.ascontiguousarray(np.stack([b.column(w).to_numpy(zero_copy_only=False) for w in NAMES], axis=1))
    return np.unpackbits(f.view(np.uint8), axis=1, bitorder="little")


def _summed(distinct: DataFrame, size: int, add: Callable[[np.ndarray, np.ndarray], None]) -> np.ndarray:
    """size numbers, added up over all nodes by add(total, bits of some nodes).  Each task gives one row, and GATHERED of them reach the driver at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(size, np.int64)
        for b in batches:
            if b.num_rows:
                add(total, _bits(b))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % GATHERED], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["g", "sums"])

    def both(rows: pa.Table) -> pa.Table:
        total = np.zeros(size, np.int64)
        for x in rows.column("sums"):
            total += np.frombuffer(x.as_py(), np.int64)
        return pa.table({"sums": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros(size, np.int64)
    for r in distinct.select(*NAMES).mapInArrow(run, "g int, sums binary").groupBy("g").applyInArrow(both, "sums binary").collect():
        out += np.frombuffer(r["sums"], np.int64)
    return out


def ranked(distinct: DataFrame) -> tuple[int, list[int]]:
    """How many nodes there are, and the bits, those first that go along most with how far a node agrees with the majority of all."""

    def count(total: np.ndarray, x: np.ndarray) -> None:
        total[:BITS] += x.sum(axis=0, dtype=np.int64)
        total[BITS] += len(x)

    sums = _summed(distinct, BITS + 1, count)
    n = int(sums[BITS])
    most = (2 * sums[:BITS] > n).astype(np.uint8)

    def along(total: np.ndarray, x: np.ndarray) -> None:
        same = x == most
        own = same.sum(axis=1, dtype=np.int64)
        total[:BITS] += (own.astype(np.float64) @ same).astype(np.int64)
        total[BITS] += own.sum()

    both = _summed(distinct, BITS + 1, along)
    share = np.where(most, sums[:BITS], n - sums[:BITS]) / max(n, 1)
    tied = (both[:BITS] / max(n, 1) - share * both[BITS] / max(n, 1)) / np.sqrt(np.maximum(share * (1 - share), 1e-9))
    return n, sorted(range(BITS), key=lambda b: (-round(float(tied[b]), 6), b))


def cut_up(rank: list[int], width: int, partitions: int) -> list[list[int]]:
    """Parts of width bits: neighbours in rank, in each further partition dealt anew among four parts."""
    out = []
    for g in range(partitions):
        deal, own = random.Random(g), []
        for at in range(0, BITS, 4 * width):
            few = rank[at : at + 4 * width]
            if g:
                deal.shuffle(few)
            own += few
        out += [sorted(own[i : i + width]) for i in range(0, BITS - width + 1, width)]
    return out


def part_values(x: np.ndarray, part: list[int]) -> np.ndarray:
    return (x[:, part].astype(np.int64) << np.arange(len(part))).sum(axis=1)


def equal_pairs(distinct: DataFrame, parts: list[list[int]], one_in: int) -> np.ndarray:
    """Pairs of nodes with equal keys in each part: those of one in one_in of the keys, times one_in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _bits(b)
            for i, part in enumerate(parts):
                own = part_values(x, part)
                own = own[_mixed(own.view(np.uint64), -1 - i) % np.uint64(one_in) == 0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), i, np.int32)), pa.array(own)], ["part", "key"])

    each = distinct.select(*NAMES).mapInArrow(run, "part int, key bigint").groupBy("part", "key").agg(F.count("*").alias("n")).where("n > 1")
    out = np.zeros(len(parts))
    for r in each.groupBy("part").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs")).collect():
        out[r["part"]] = one_in * r["pairs"]
    return out


def meeting(p: float, width: int, t: int) -> float:
    """The chance that at most t of width bits differ."""
    return sum(math.comb(width, j) * p**j * (1 - p) ** (width - j) for j in range(t + 1))


def allocate(options: list[list[tuple[int, float, int]]], need: int) -> list[int]:
    """A threshold for each part, of least cost in all, with gains of need or more; options: (threshold, cost, gain) besides -1, which costs and gains nothing."""
    best = np.full(need + 1, np.inf)
    best[0] = 0
    chosen = []
    for own in options:
        now, pick = best.copy(), np.full(need + 1, -1, np.int8)
        for k, (_, cost, gain) in enumerate(own):
            gain = min(gain, need)
            step = np.full(need + 1, np.inf)
            step[gain:] = best[: need + 1 - gain] + cost
            step[need] = best[need - gain :].min() + cost
            pick[step < now] = k
            now = np.minimum(now, step)
        chosen.append((best, pick))
        best = now
    out, at = [-1] * len(options), need
    for i in reversed(range(len(options))):
        before, pick = chosen[i]
        if pick[at] >= 0:
            out[i], cost, gain = options[i][pick[at]]
            gain = min(gain, need)
            at = at - gain if at < need else need - gain + int(np.argmin(before[need - gain :]))
    return out


def plan(distinct: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part that is probed."""
    n, rank = ranked(distinct)
    if n < 2:
        return []
    p, goal = apart(similarity), -math.log1p(-recall)
    tables = {w: goal / -math.log1p(-meeting(p, w, 0)) for w in WIDTHS}
    width = min(WIDTHS, key=lambda w: tables[w] * (n + PAIR_COST * n * (n - 1) / 2 / 2.0**w))
    parts = cut_up(rank, width, math.ceil(1.1 * tables[width] / (BITS // width)))

    def sketch(total: np.ndarray, x: np.ndarray) -> None:
        for i, part in enumerate(parts):
            h = _mixed(part_values(x, part).view(np.uint64), i + 1)
            total[i * CELLS : (i + 1) * CELLS] += np.bincount((h >> np.uint64(58)).astype(np.int64), 2.0 * (h & np.uint64(1)) - 1, CELLS).astype(np.int64)

    moment = (_summed(distinct, len(parts) * CELLS, sketch).reshape(-1, CELLS).astype(float) ** 2).sum(axis=1)
    # The sketch's error goes with all nodes, however few of them meet: it only tells of keys that very many share.
    equal = np.where(moment > 2 * n, (moment - n) / 2, equal_pairs(distinct, parts, max(1, min(ONE_IN, n // ENOUGH))))
    equal = np.maximum(equal, n * (n - 1) / 2.0 ** (width + 1))
    # Each form of a node may meet each form of another.
    spread = (1 + width) ** 2
    gain = {t: int(STEPS * -math.log1p(-meeting(p, width, t)) / goal) for t in (0, 2)}
    options = [[(0, n + PAIR_COST * e, gain[0]), (2, n * (1 + width) + PAIR_COST * e * spread, gain[2])] for e in equal.tolist()]
    return [(part, t) for part, t in zip(parts, allocate(options, STEPS), strict=True) if t >= 0]


def probes(distinct: DataFrame, chosen: list[tuple[list[int], int]]) -> DataFrame:
    """node and key, a row for each form of each probed part."""
    width = max((len(part) for part, _ in chosen), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, keys = _bits(b), []
            for i, (part, t) in enumerate(chosen):
                own = part_values(x, part) + (i << width)
                keys += [own, *(own ^ (1 << j) for j in range(len(part) if t else 0))]
            flat = np.stack(keys, axis=1) if keys else np.zeros((len(x), 0), np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("node"), lists], ["node", "keys"])

    return distinct.select("node", *NAMES).mapInArrow(run, "node bigint, keys array<bigint>").select("node", F.explode("keys").alias("key"))


def meetings(made: DataFrame) -> DataFrame:
    """node, key, n: the members of every bucket of two or more, and how many it has.  The rows are moved once."""
    return made.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1")


def _neighbours(near: int):
    """Pairs within near bits of rows that share a key, from rows sorted by key, of which no key has more than FEW."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 2 + WORDS), np.int64)
        for batch in batches:
            new = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "node", *NAMES)], axis=1).reshape(-1, 2 + WORDS)
            x, old = np.vstack([held, new]), len(held)
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for step in range(1, FEW):
                # Each pair once: its second row is of this batch.
                j = np.arange(max(old, step), len(x))
                j = j[x[j, 0] == x[j - step, 0]]
                apart_by = np.bitwise_count((x[j, 2:] ^ x[j - step, 2:]).view(np.uint64)).sum(axis=1, dtype=np.int64)
                j = j[apart_by <= near]
                a.append(x[j - step, 1])
                b.append(x[j, 1])
            held = x[len(x) - min(len(x), FEW - 1) :]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return run


def pairs_of_few(met: DataFrame, distinct: DataFrame, near: int) -> DataFrame:
    """All pairs (a, b) within near bits of buckets of up to FEW, found where the bucket's rows meet."""
    own = met.where(F.col("n") <= FEW).groupBy("node").agg(F.collect_list("key").alias("held"))
    each = own.join(distinct.select("node", *NAMES), "node").select(F.explode("held").alias("key"), "node", *NAMES)
    found = each.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_neighbours(near), "a bigint, b bigint")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def stars(met: DataFrame) -> DataFrame:
    """Pairs (a, b), one for each node of larger buckets: of their centres, which meet most others, that which meets most."""
    weighed = met.where(F.col("n") > FEW).withColumn("met", F.sum("n").over(Window.partitionBy("node")))
    centre = F.max(F.struct("met", "node")).over(Window.partitionBy("key"))
    best = weighed.select("node", centre.alias("centre")).where("node <> centre.node").groupBy("node").agg(F.max("centre")["node"].alias("centre"))
    return best.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()


def divided(met: DataFrame, roots: DataFrame) -> DataFrame:
    """The members of larger buckets that hold different components: node, root, and held, their buckets (key, n, most: members of its largest component, inside: whether this one is)."""
    # A node's buckets, no more than there are probes, go along in one row while it is joined.
    own = met.where(F.col("n") > FEW).groupBy("node").agg(F.collect_list(F.struct("key", "n")).alias("held"))
    known = own.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.explode("held").alias("h")).select("node", "root", "h.key", "h.n")
    alike = known.withColumn("alike", F.count("*").over(Window.partitionBy("key", "root")))
    live = alike.withColumn("x", F.max(F.struct("alike", "root")).over(Window.partitionBy("key"))).where("x.alike < n")
    return live.groupBy("node", "root").agg(F.collect_list(F.struct("key", "n", F.col("x.alike").alias("most"), (F.col("root") == F.col("x.root")).alias("inside"))).alias("held"))


def far(a: str, b: str) -> Column:
    """Bits in which the words with these prefixes differ."""
    return sum((F.bit_count(F.col(f"{a}{w}").bitwiseXOR(F.col(f"{b}{w}"))) for w in NAMES), F.lit(0))


def _compared(near: int, nearest: bool):
    """Pairs of a tile's members in different components within near bits; nearest: each member's nearest only."""

    def run(rows: pa.Table) -> pa.Table:
        block, i, j = rows.column("block").to_numpy(), rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        node, root = rows.column("node").to_numpy(), rows.column("root").to_numpy()
        f = np.stack([rows.column(w).to_numpy().view(np.uint64) for w in NAMES], axis=1)
        mine, other = np.flatnonzero(block == i), np.flatnonzero(block == j)
        a, b, far = [], [], []
        best: dict[int, tuple[int, int]] = {}
        for at in range(0, len(mine), 64):
            m = mine[at : at + 64]
            d = np.zeros((len(m), len(other)), np.int64)
            for k in range(WORDS):
                d += np.bitwise_count(f[m, k][:, None] ^ f[other, k][None, :])
            hit = (d <= near) & (root[m][:, None] != root[other][None, :])
            if i == j:
                hit &= node[m][:, None] < node[other][None, :]
            x, y = np.nonzero(hit)
            if not nearest:
                a.append(node[m[x]])
                b.append(node[other[y]])
                far.append(d[x, y])
                continue
            for u, v, bits in zip(node[m[x]].tolist(), node[other[y]].tolist(), d[x, y].tolist(), strict=True):
                best[u] = min(best.get(u, (BITS, 0)), (bits, v))
                best[v] = min(best.get(v, (BITS, 0)), (bits, u))
        if nearest:
            return pa.table({"a": pa.array(best, pa.int64()), "b": pa.array([v for _, v in best.values()], pa.int64()), "far": pa.array([x for x, _ in best.values()], pa.int64())})
        whole = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b, far)]
        return pa.table({"a": pa.array(whole[0]), "b": pa.array(whole[1]), "far": pa.array(whole[2])})

    return run


def tiled(members: DataFrame, distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """key, i, j (a tile), block, node, root and words: each member in the tiles of its buckets.

    A bucket of up to a block is one tile.  In a larger one the members of its
    largest component are not compared with each other: that component and the
    others are cut to blocks, and there is a tile for each two blocks but for
    two of that component.  So a task holds two blocks at a time, however large
    the bucket, and a large component's rows are as many as its members if few
    others meet it.
    """
    each = members.join(distinct.select("node", *NAMES), "node").select("node", "root", *NAMES, F.explode("held").alias("h"))
    one, inside = F.col("h.n") <= block, F.col("h.inside")
    blocks = lambda x: F.ceil(x / block).cast("int")
    most, others = blocks(F.col("h.most")), blocks(F.col("h.n") - F.col("h.most"))
    own = F.pmod(F.xxhash64("node"), F.when(inside, most).otherwise(others)).cast("int")
    tile = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    each = each.select("node", "root", *NAMES, "h.key", one.alias("one"), inside.alias("inside"), most.alias("most"), others.alias("others"), own.alias("own"))
    # Blocks of the largest component count from -1 downwards.
    across = F.transform(indices(F.col("others")), lambda j: tile(-1 - F.col("own"), j))
    outside = F.concat(F.transform(indices(F.col("most")), lambda i: tile(-1 - i, F.col("own"))), F.transform(indices(F.col("others")), lambda j: tile(F.least("own", j), F.greatest("own", j))))
    held = F.when(F.col("one"), F.array(tile(F.lit(0), F.lit(0)))).when(F.col("inside"), across).otherwise(outside)
    place = F.when(F.col("one"), 0).when(F.col("inside"), -1 - F.col("own")).otherwise(F.col("own"))
    return each.select("key", F.explode(held).alias("t"), place.alias("block"), "node", "root", *NAMES).select("key", "t.i", "t.j", "block", "node", "root", *NAMES)


def between(members: DataFrame, distinct: DataFrame, near: int, nearest: bool, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of members of one bucket in different components within near bits; nearest: only each member's nearest one."""
    found = tiled(members, distinct, block).groupBy("key", "i", "j").applyInArrow(_compared(near, nearest), "a bigint, b bigint, far bigint")
    if nearest:
        found = found.groupBy("a").agg(F.min(F.struct("far", "b"))["b"].alias("b"))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def verified(pairs: DataFrame, docs: DataFrame, distinct: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """The pairs (a, b) whose texts are similar."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = cut(nodes.join(distinct.select("node", "doc_id", "th"), "node").withColumnsRenamed({"doc_id": "_doc_id", "th": "_th"}))
    # Few texts have near ones; they are picked without moving the others if their keys are counted and few enough.
    wanted = F.broadcast(wanted) if wanted.count() <= max_broadcast else wanted
    text = keyed(docs).join(wanted, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("th") == F.col("_th"))).select("node", shingle_set(F.col("text"), shingle).alias("s"))
    sets = cut(text.dropDuplicates(["node"]))
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared >= similarity * (F.size("x") + F.size("y") - shared)).select("a", "b")


def links(docs: DataFrame, distinct: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, recall: float = RECALL, max_broadcast: int = MAX_BROADCAST, block: int = BLOCK, chosen: list[tuple[list[int], int]] | None = None) -> DataFrame:
    """Verified links (a, b) of nodes; their components are those of all pairs that meet.  distinct: node, its words, and one row's doc_id and th."""
    side = lambda c: distinct.select(F.col("node").alias(c), *(F.col(w).alias(f"{c}{w}") for w in NAMES))
    near = reach(similarity)
    made = probes(distinct, plan(distinct, similarity, recall) if chosen is None else chosen)
    met = cut(meetings(made))
    let_go(docs.sparkSession)
    starred = stars(met).join(side("a"), "a").join(side("b"), "b").where(far("a", "b") <= near).select("a", "b")
    tried = cut(pairs_of_few(met, distinct, near).unionByName(starred).distinct())
    let_go(docs.sparkSession)
    found = cut(verified(tried, docs, distinct, shingle, similarity, max_broadcast))
    for nearest in (True, False):
        let_go(docs.sparkSession)
        open_ones = cut(divided(met, connect(found)))
        pairs = cut(between(open_ones, distinct, near, nearest, block).join(tried, ["a", "b"], "left_anti"))
        if pairs.isEmpty():
            # Nearest ones may have failed before; the others are still to be tried.
            continue
        found = cut(found.unionByName(verified(pairs, docs, distinct, shingle, similarity, max_broadcast)))
        tried = tried.unionByName(pairs)
    let_go(docs.sparkSession)
    return found


def assign(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """doc_id, th, component_id and root (the component's name) for every row."""
    rows = cut(fingerprints(docs, shingle))
    each = rows.groupBy("node").agg(*(F.first(w).alias(w) for w in NAMES), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("k")).select("node", *NAMES, "k.doc_id", "k.th")
    # A number of partitions of its own: the rows are narrow, but each becomes a hundred and more when it is probed.
    wide = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = cut(each.repartition(wide, "node"))
    return named(rows.select("doc_id", "th", "node"), distinct.select("node", F.col("doc_id").alias("least")), links(docs, distinct, shingle, similarity, recall))


def dedup(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest doc_id, then of the smallest text hash."""
    return keep_one(docs, cut(assign(docs, shingle, similarity, recall)))
