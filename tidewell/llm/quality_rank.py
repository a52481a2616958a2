"""Quality classifier: Bradley-Terry ranking of documents by preference pairs.

Features are plain measures of the text, and one learned measure: the mean,
over the hashed words and word shapes of a text, of how much oftener a
preferred than a rejected training text holds them.  All are computed in the
JVM.  Pairs of a preferred (quality 1) and a rejected (quality 0) training row
give the logistic loss ``log(1 + exp(-(x_i - x_j) w))`` on feature differences,
with a ridge; Newton steps minimise it.  The cut is the quantile of the training
scores at the share of rejected rows, and a document's score is the logistic
function of its distance to the cut, in units of the training scores' spread,
so that 0.5 is the cut.

The fit takes every labelled row whose crc32(doc_id as text) mod 3 is not 1, and
every pair of a preferred and a rejected one.  The rows are halved by a hash of
their id: each half counts its words for the learned measure of the other, so no
row is measured by its own label, and a document's measure is the mean of both
halves' ones.  The rows stay in the cluster, and a bitmap of the labelled ids'
hashes keeps most other texts from being moved to them.  A Newton step sums their moments
by class and by cells of the score ``GRID`` wide, at most ``2 * EDGE / GRID`` of
them, and a pair's weight in the loss' derivatives is that of its cells' mean
scores.  Quantiles are exact, found by counting in ever narrower ranges.  A
caller may bound the rows of each class by ``max_labelled``; then those with the
smallest hashes of their id are taken, and the cut weighs each by its class.

Null and empty texts have all measures 0 and are scored like any other.
Repeated rows are scored alike.  A null doc_id isn't held out and has no label.
With one class or none to learn from, every score is 0.5.  Columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import LOWER, UPPER, cut, let, text_of, written

MAX_PAIRS, RIDGE, STEPS, CELLS = 200_000, 1e-3, 30, 1 << 13
#: Width of a score's cells while the loss is minimised, and where its last cells begin; ranges that a quantile's counts have; a step that ends the minimisation.
GRID, EDGE, RANGES, CLOSE = 1 / 32, 32, 1024, 1e-4
#: Bits for each labelled id in the bitmap that texts are looked up in before they are moved; its bits at most (32 MiB).
BITS_EACH, MOST_BITS = 16, 1 << 28
FEATURES = ("log_words", "symbols", "capitals", "exclaims", "digits", "stops", "distinct_words", "distinct_lines", "word_length", "cells")
DIGITS, BLANKS = "0123456789", "\t\n\x0b\x0c\r"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " ", -1), "")


def cells_of(text: Column, cells: int = CELLS) -> Column:
    """The cells of a text's words, and of their shapes (letters and digits of ASCII each made one)."""
    shape = F.translate(text, UPPER + LOWER + DIGITS, "A" * 26 + "a" * 26 + "0" * 10)
    one = lambda w, tag: F.transform(w, lambda x: F.pmod(F.xxhash64(F.lit(tag), x), F.lit(cells)).cast("int"))
    return F.concat(one(_words(text), 0), one(_words(shape), 1))


def told(cells: Column, weights: list[float]) -> Column:
    """The learned measure of a text with these cells."""
    # A constant of fixed size, folded once when the query is planned.
    table = F.split(F.lit(",".join(f"{x:.6g}" for x in weights)), ",").cast("array<double>")
    return let(cells, lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + F.get(table, x)) / F.greatest(F.size(c), F.lit(1)))


def features(text: Column, weights: list[float] | None = None) -> Column:
    """An array of FEATURES; without weights of the cells their measure is 0."""

    def share(chars: str) -> Column:
        return (F.length(text) - F.length(F.translate(text, chars, ""))) / F.greatest(F.length(text), F.lit(1))

    def of(w: Column) -> Column:
        n = F.greatest(F.size(w), F.lit(1))
        lines = F.split(text, "\n", -1)
        return F.array(
            F.log1p(F.size(w).cast("double")),
            share("#*$%&|<>"),
            share(UPPER),
            share("!"),
            share(DIGITS),
            share(".,;:"),
            F.size(F.array_distinct(w)) / n,
            let(lines, lambda v: F.size(F.array_distinct(v)) / F.greatest(F.size(v), F.lit(1))),
            F.least(F.length(text) / n, F.lit(40)) / 10,
            F.lit(0.0) if weights is None else told(cells_of(text, len(weights)), weights),
        ).cast("array<double>")

    return F.when(F.length(text) > 0, let(_words(text), of)).otherwise(F.array_repeat(F.lit(0.0), len(FEATURES)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


@dataclass(frozen=True)
class Ranker:
    """score = 1 / (1 + exp(-(x . w - cut) / spread)), x standardised by mean and scale; cells: weights of the learned measure."""

    mean: tuple[float, ...]
    scale: tuple[float, ...]
    w: tuple[float, ...]
    cut: float
    spread: float
    cells: tuple[float, ...] | None = None

    def column(self, x: Column) -> Column:
        v = F.lit(-self.cut)
        for i in range(len(self.w)):
            v = v + (x[i] - F.lit(self.mean[i])) * F.lit(self.w[i] / self.scale[i])
        return 1 / (1 + F.exp(-v / F.lit(self.spread)))


def pairs(n_good: int, n_bad: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the preferred and the rejected row of each pair; every row is in some pair, the strides walk through different partners."""
    at = np.arange(min(most, n_good * n_bad))
    turn = n_good * n_bad // np.gcd(n_good, n_bad)
    return at % n_good, (at + at // turn) % n_bad


def weighted_quantile(x: np.ndarray, weight: np.ndarray, share: float) -> float:
    """The middle of the gap between the values up to that share of the weight and the others."""
    order = np.argsort(x, kind="stable")
    x, below = x[order], np.cumsum(weight[order]) / weight.sum()
    k = int(np.clip(np.searchsorted(below, share + 1e-12, side="right"), 1, len(x) - 1))
    return float((x[k - 1] + x[k]) / 2)


def learn(good: np.ndarray, bad: np.ndarray, max_pairs: int = MAX_PAIRS, ridge: float = RIDGE, steps: int = STEPS, sizes: tuple[int, int] | None = None) -> Ranker:
    """The ranker of least loss over at most max_pairs pairs of rows in memory, the plain form of ``minimise``; sizes: how many preferred and rejected rows these stand for."""
    k = good.shape[1] if len(good) else bad.shape[1] if len(bad) else len(FEATURES)
    if not len(good) or not len(bad):
        return Ranker((0.0,) * k, (1.0,) * k, (0.0,) * k, 0.0, 1.0)
    # Standardised by the two classes' means of moments, so that their shares don't matter.
    mean = (good.mean(axis=0) + bad.mean(axis=0)) / 2
    scale = np.maximum(np.sqrt((((good - mean) ** 2).mean(axis=0) + ((bad - mean) ** 2).mean(axis=0)) / 2), 1e-6)
    good, bad = (good - mean) / scale, (bad - mean) / scale
    i, j = pairs(len(good), len(bad), max_pairs)
    d = good[i] - bad[j]
    w = np.zeros(k)
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -50, 50)))
        grad = -(d * p[:, None]).mean(axis=0) + ridge * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(k)
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    n_good, n_bad = sizes or (len(good), len(bad))
    s = np.concatenate([good @ w, bad @ w])
    weight = np.concatenate([np.full(len(good), n_good / len(good)), np.full(len(bad), n_bad / len(bad))])
    low, high = np.quantile(bad @ w, 0.5), np.quantile(good @ w, 0.5)
    return Ranker(tuple(map(float, mean)), tuple(map(float, scale)), tuple(map(float, w)), weighted_quantile(s, weight, n_bad / (n_good + n_bad)), float(max((high - low) / 8, 1e-6)))


def _moments(w: np.ndarray):
    """For each class and cell of the scores z . w: how many rows (quality, z) of a task there are, the sums of z and of the products of its parts."""
    upper, last = np.triu_indices(len(w)), int(EDGE / GRID)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4 * last, 1 + len(w) + len(upper[0])))
        for b in batches:
            z = b.column("z").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(w))
            cell = np.clip(np.floor(z @ w / GRID), -last, last - 1).astype(np.int64) + last
            np.add.at(total, 2 * cell + b.column("quality").to_numpy(zero_copy_only=False), np.hstack([np.ones((len(z), 1)), z, z[:, upper[0]] * z[:, upper[1]]]))
        at = np.flatnonzero(total[:, 0])
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * total.shape[1]), pa.array(total[at].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array((at % 2).astype(np.int32)), pa.array((at // 2).astype(np.int32)), sums], ["quality", "cell", "sums"])

    return run


def derivatives(rows: DataFrame, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian at w of the mean loss over all pairs of rows (quality, z)."""
    k = len(w)
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    each = rows.select("quality", "z").mapInArrow(_moments(w), "quality int, cell int, sums array<double>")
    found = sorted(each.groupBy("quality", "cell").agg(*(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(1 + k + len(upper)))).collect())
    of = lambda q: np.array([r[2:] for r in found if r["quality"] == q])
    good, bad = of(1), of(0)

    def squares(m: np.ndarray) -> np.ndarray:
        out = np.zeros((k, k))
        for (i, j), x in zip(upper, m, strict=True):
            out[i, j] = out[j, i] = x
        return out

    (n, x), (m, y) = ((c[:, 0], c[:, 1 : k + 1]) for c in (good, bad))
    p = 1 / (1 + np.exp(np.clip((x @ w / n)[:, None] - (y @ w / m)[None, :], -50, 50)))
    q = p * (1 - p)
    cross = x.T @ q @ y
    total = n.sum() * m.sum()
    return -(x.T @ (p @ m) - y.T @ (n @ p)) / total, (squares((q @ m) @ good[:, k + 1 :]) + squares((n @ q) @ bad[:, k + 1 :]) - cross - cross.T) / total


def minimise(rows: DataFrame, k: int, ridge: float = RIDGE, steps: int = STEPS) -> np.ndarray:
    """The weights of least loss over all pairs of a preferred and a rejected one of rows (quality, z), z standardised."""
    w = np.zeros(k)
    for _ in range(steps):
        grad, hess = derivatives(rows, w)
        step = np.linalg.solve(hess + ridge * np.eye(k), grad + ridge * w)
        step *= min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        w -= step
        # Finer steps only move rows between cells.
        if np.abs(step).max() < CLOSE:
            break
    return w


def quantile(rows: DataFrame, share: float) -> float:
    """The middle of the gap between the values up to that share of the weight and the others, of rows (s, weight)."""
    low, high, total = rows.agg(F.min("s"), F.max("s"), F.sum("weight")).first()
    first, last, before, most = low, high, 0.0, (share + 1e-12) * total
    while low < high:
        # The value wanted is within low and high; each range's least and greatest values bound the next ranges.
        each = F.least(F.floor((F.col("s") - low) / F.lit(high - low) * RANGES), F.lit(RANGES - 1)).alias("r")
        for r in sorted(rows.where(F.col("s").between(low, high)).groupBy(each).agg(F.sum("weight").alias("weight"), F.min("s").alias("low"), F.max("s").alias("high")).collect()):
            now = r["low"], r["high"]
            if before + r["weight"] > most:
                break
            before += r["weight"]
        if now == (low, high):
            break
        low, high = now
    # All weight may lie up to the share, or none: the gap is then the last or the first one.
    if high == first:
        return float((high + (rows.where(F.col("s") > high).agg(F.min("s")).first()[0] or last)) / 2) if first < last else float(high)
    return float((rows.where(F.col("s") < high).agg(F.max("s")).first()[0] + high) / 2)


def possible(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """The rows of docs whose doc_id may be one of the n in ids: all that are, and of the others about one in BITS_EACH, by a bitmap of hashes.

    So a join after it moves few texts of other rows.  The bitmap has BITS_EACH to 2 * BITS_EACH bits for each
    id, in rows of 4 KiB, and MOST_BITS at most; beyond them more of the other rows stay.
    """
    if docs.schema["doc_id"].dataType != ids.schema["doc_id"].dataType:
        # Equal ids of two types may have different hashes.
        return docs
    bits = min(1 << max(15, (n * BITS_EACH - 1).bit_length()), MOST_BITS)
    # bitmap_bucket_number counts from 1 for numbers over 0.
    place = F.pmod(F.xxhash64("doc_id"), F.lit(bits)) + 1
    maps = ids.groupBy(F.bitmap_bucket_number(place).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_bits"))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = docs.withColumn("_bucket", F.bitmap_bucket_number(place)).join(F.broadcast(maps), "_bucket")
    return met.where(F.call_function("shiftright", byte, (at % 8).cast("int")) % 2 == 1).select(*docs.columns)


def labelled(docs: DataFrame, labels: DataFrame, max_labelled: int | None = None) -> tuple[DataFrame, dict[int, int]]:
    """_id, quality and text of the training rows, repeated ones once; and how many labels of each class there are."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", "quality").distinct()
    sizes = {r["quality"]: r["count"] for r in own.groupBy("quality").count().collect()}
    if max_labelled is not None:
        few = [own.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled) for q in (1, 0)]
        own = few[0].unionByName(few[1])
    ids = own.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("quality"))
    met = possible(docs.select(F.col("doc_id"), text_of().alias("text")), own, sum(sizes.values())).join(ids, F.col("doc_id") == F.col("_id"))
    return met.groupBy("_id", "quality", F.xxhash64("text").alias("th")).agg(F.min("text").alias("text")).select("_id", "quality", "text"), sizes


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int | None = None, cells: int = CELLS) -> Ranker:
    k = len(FEATURES)
    texts, sizes = labelled(docs, labels, max_labelled)
    rows = written(texts.select("quality", F.pmod(F.xxhash64(F.lit(1), "_id"), F.lit(2)).cast("int").alias("half"), features(F.col("text")).alias("x"), cells_of(F.col("text"), cells).alias("cells")))
    n, size = np.zeros((2, 2, cells)), np.zeros((2, 2))
    for r in rows.groupBy("half", "quality").count().collect():
        size[r["half"], r["quality"]] = r["count"]
    if not size.sum(axis=0).all():
        return Ranker((0.0,) * k, (1.0,) * k, (0.0,) * k, 0.0, 1.0)
    weights, x = None, F.col("x")
    if size.all():
        for r in rows.select("half", "quality", F.explode(F.array_distinct("cells")).alias("cell")).groupBy("half", "quality", "cell").count().collect():
            n[r["half"], r["quality"], r["cell"]] = r["count"]
        log = np.log((n + 1) / (size + 2)[:, :, None])
        halves = np.round(log[:, 1] - log[:, 0], 6)
        weights = np.round(halves.mean(axis=0), 6).tolist()
        measure = F.when(F.col("half") == 0, told(F.col("cells"), halves[1].tolist())).otherwise(told(F.col("cells"), halves[0].tolist()))
        x = F.concat(F.slice("x", 1, k - 1), F.array(measure))
    rows = cut(rows.select("quality", x.alias("x")))
    # Standardised by the two classes' means of moments, so that their shares don't matter.
    moment = lambda of: np.array([r[1:] for r in rows.groupBy("quality").agg(*(F.avg(of(F.col("x")[i], i)) for i in range(k))).collect()]).mean(axis=0)
    mean = moment(lambda v, i: v)
    scale = np.maximum(np.sqrt(moment(lambda v, i: (v - float(mean[i])) * (v - float(mean[i])))), 1e-6)
    rows = cut(rows.select("quality", F.array(*((F.col("x")[i] - float(mean[i])) / float(scale[i]) for i in range(k))).alias("z")))
    w = minimise(rows, k)
    taken = size.sum(axis=0)
    scored = cut(rows.select("quality", sum((F.col("z")[i] * float(w[i]) for i in range(k)), F.lit(0.0)).alias("s"), F.when(F.col("quality") == 1, sizes[1] / taken[1]).otherwise(sizes[0] / taken[0]).alias("weight")))
    low, high = (quantile(scored.where(F.col("quality") == q), 0.5) for q in (0, 1))
    at = quantile(scored, sizes[0] / (sizes[0] + sizes[1]))
    return Ranker(tuple(map(float, mean)), tuple(map(float, scale)), tuple(map(float, w)), at, float(max((high - low) / 8, 1e-6)), tuple(weights) if weights else None)


def score(docs: DataFrame, labels: DataFrame, max_labelled: int | None = None) -> DataFrame:
    ranker = fit(docs, labels, max_labelled)
    rows = docs.select(F.col("doc_id"), features(text_of(), ranker.cells).alias("x")).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), ranker.column(F.col("x")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
