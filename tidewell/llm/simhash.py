"""SimHash near-duplicates, found by the generalised pigeonhole principle.

1. Each text's word shingles are hashed in the JVM; a numpy kernel counts
   the bits.  The narrow table (doc_id, th, fp) is kept once.
2. Copies collapse: everything below works on distinct fingerprints.
3. Correlated bits are grouped into the same partition (from the 64 x 64 sum
   of products over all fingerprints).
4. Thresholds t_i >= -1 with sum(t_i) = radius - parts + 1 are allocated by
   dynamic programming on estimated candidates: exact counts of equal parts
   over all fingerprints, carried to larger thresholds by the odds with which
   the part's bits differ.  The number of parts is chosen the same way.  Any
   two fingerprints within the radius differ by at most t_i in some part i.
5. Fingerprints that meet in a part are verified by their whole distance.  A
   bucket of more than ``bucket`` fingerprints does not emit its pairs: its
   members are flipped in every bit, and all that share a flipped form are
   within 2 of each other, so that a star of links is exact.  Rows stay within
   65 for each fingerprint whatever the skew.
6. Components of the links, by large-star and small-star.

Null and empty texts have fingerprint 0 and are linked like any other.
Repeated rows give equal rows.  A row with a null doc_id takes part; a
component without any id has a null component_id.  Other columns are ignored
by ``assign`` and passed through by ``dedup``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import NOT_SPACE, ascii_lower, cut, indices, keyed, let, words
from tidewell.llm.components import keep_one, named

SHINGLE, RADIUS, BUCKET, PARTS = 3, 2, 8, (2, 3, 4)
#: Hashes whose bits are counted at a time.
CHUNK = 1 << 17


def shingle_hashes(w: Column, k: int) -> Column:
    many = F.transform(indices(F.size(w), k - 1), lambda i: F.xxhash64(F.concat_ws(" ", *(w[i - (k - 1 - j)] for j in range(k)))))
    return F.when(F.size(w) >= k, many).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))


def _majority(h: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a signed 64-bit number."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), CHUNK):
        ones += np.unpackbits(h[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column("h")
        values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        fp = [_majority(np.ascontiguousarray(values[i:j])) for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(fp, pa.int64())], ["doc_id", "th", "fp"])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, th, fp for every row."""
    rows = keyed(docs).select("doc_id", "th", let(words(ascii_lower(F.col("text")), NOT_SPACE), lambda w: shingle_hashes(w, shingle)).alias("h"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_fold, f"doc_id {kind}, th bigint, fp bigint")


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((64, 64), dtype=np.int64)
    for b in batches:
        x = np.unpackbits(np.ascontiguousarray(b.column(0).to_numpy(zero_copy_only=False)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
        for at in range(0, len(x), CHUNK):
            y = x[at : at + CHUNK]
            total += (y.T @ y).astype(np.int64)
    at = np.arange(4096)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel())], ["cell", "n"])


def bit_groups(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """The 64 bits in groups of nearly equal size, correlated bits together.  both[i, j]: how often bits i and j are both set."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    left, groups = list(range(64)), []
    for k in range(parts):
        size = (64 - sum(map(len, groups))) // (parts - k)
        own = [max(left, key=lambda i: (corr[i][left].sum(), -i))]
        left.remove(own[0])
        while len(own) < size:
            own.append(max(left, key=lambda i: (corr[i][own].sum(), -i)))
            left.remove(own[-1])
        groups.append(sorted(own))
    return groups


def part_key(fp: Column, bits: list[int]) -> Column:
    """The fingerprint with all but these bits cleared."""
    mask = sum(1 << b for b in bits)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def flips(fp: Column, bits: list[int]) -> Column:
    """The fingerprint itself and with each of these bits flipped."""
    signed = [(1 << b) - (1 << 64) if b == 63 else 1 << b for b in bits]
    return F.concat(F.array(fp), F.transform(F.array(*map(F.lit, signed)), lambda m: fp.bitwiseXOR(m)))


def allocate(cost: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Thresholds of least cost with the given sum; cost[i][t] for each part and threshold."""
    best = {0: (0.0, [])}
    for own in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t, x in own.items():
                if s + t not in step or c + x < step[s + t][0]:
                    step[s + t] = (c + x, [*ts, t])
        best = step
    return best[total]


def plan(distinct: DataFrame, radius: int = RADIUS, parts: tuple[int, ...] = PARTS) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part that is probed."""
    cells = distinct.select("fp").mapInArrow(_products, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    both = np.zeros(4096, dtype=np.int64)
    for r in cells:
        both[r["cell"]] = r["n"]
    both, n = both.reshape(64, 64), distinct.count()
    groups = {m: bit_groups(both, n, m) for m in parts}
    named = [(m, i) for m in parts for i in range(m)]
    keys = distinct.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), part_key(F.col("fp"), groups[m][i]).alias("key")) for k, (m, i) in enumerate(named)))).alias("x")).select("x.*")
    pairs = {r["k"]: float(r["pairs"]) for r in keys.groupBy("k", "key").count().groupBy("k").agg(F.sum(F.col("count") * (F.col("count") - 1) / 2).alias("pairs")).collect()}
    p = np.diag(both) / max(n, 1)
    odds = 2 * p * (1 - p) / np.maximum(1 - 2 * p * (1 - p), 1e-9)
    best = None
    for m in parts:
        if radius - m + 1 < -m:
            continue
        cost = []
        for i, bits in enumerate(groups[m]):
            # Chance for these bits to differ in just j places, against none: elementary symmetric sums of the odds.
            e = np.zeros(radius + 1)
            e[0] = 1
            for b in bits:
                e[1:] += odds[b] * e[:-1]
            near = max(pairs.get(named.index((m, i)), 0.0), n * (n - 1) / 2 * float(np.prod(1 / (1 + odds[bits]))))
            cost.append({-1: 0.0} | {t: (n * (1 + (len(bits) if t else 0))) + near * float(e[: t + 1].sum()) for t in range(min(radius, 2) + 1)})
        c, ts = allocate(cost, radius - m + 1)
        if best is None or c < best[0]:
            best = c, [(groups[m][i], t) for i, t in enumerate(ts) if t >= 0]
    return best[1]


def links(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET, parts: tuple[int, ...] = PARTS) -> DataFrame:
    """Links (a, b) between distinct fingerprints whose components are those of all pairs within the radius (at most 2)."""
    if not 0 <= radius <= 2:
        raise ValueError("radius: 0 to 2")
    fp = F.col("fp")
    chosen = plan(distinct, radius, parts)
    probes = F.concat(*(F.transform(flips(part_key(fp, bits), bits) if t else F.array(part_key(fp, bits)), _tagged(k)) for k, (bits, t) in enumerate(chosen)))
    met = distinct.select("fp", F.explode(probes).alias("x")).select("fp", "x.k", "x.key")
    # Cut, so that the join's two sides are plain exchanges and a part that very many fingerprints share is split among tasks.
    size = cut(met.groupBy("k", "key").agg(F.count("*").alias("size")).where("size > 1"))
    met = cut(met.join(size, ["k", "key"]))
    few = met.where(F.col("size") <= bucket).select("k", "key", F.col("fp").alias("a"))
    near = few.join(few.withColumnRenamed("a", "b"), ["k", "key"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).select("a", "b")
    many = met.where(F.col("size") > bucket).groupBy("fp").agg(F.lit(1).alias("one"))
    # Sharing a form flipped in one bit is being within 2; for smaller radii the star is verified.
    stars = many.select("fp", F.explode(flips(fp, list(range(64)))).alias("form"))
    if radius == 2:
        centre = stars.groupBy("form").agg(F.min("fp").alias("m"), F.count("*").alias("n")).where("n > 1")
        linked = stars.join(centre, "form").where("fp <> m").select(F.col("m").alias("a"), F.col("fp").alias("b"))
    else:
        linked = stars.where(F.lit(radius == 1)).join(many.select(F.col("fp").alias("form")), "form").where("fp <> form").select(F.least("fp", "form").alias("a"), F.greatest("fp", "form").alias("b"))
    return near.unionByName(linked).distinct()


def _tagged(k: int):
    return lambda x: F.struct(F.lit(k).alias("k"), x.alias("key"))


def assign(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, bucket: int = BUCKET, parts: tuple[int, ...] = PARTS) -> DataFrame:
    """doc_id, th, fp, component_id and root (the component's name) for every row."""
    rows = cut(fingerprints(docs, shingle))
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    return named(rows.withColumn("node", F.col("fp")), distinct.select(F.col("fp").alias("node"), "least"), links(distinct, radius, bucket, parts))


def report(docs: DataFrame) -> DataFrame:
    return assign(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def dedup(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, bucket: int = BUCKET, parts: tuple[int, ...] = PARTS) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest doc_id, then of the smallest text hash."""
    return keep_one(docs, cut(assign(docs, shingle, radius, bucket, parts)))
