"""Mixing to target weights by soft membership.

Domains are those of a labelled table (here: ``clean``, ``toxic`` and ``junk``,
from quality and toxic).  A naive Bayes classifier over hashed words, learned
from at most ``max_labelled`` labelled rows, gives every document domain
posteriors, in whole parts of ``GRID`` that add up to it.  Document i has n_i
tokens (words), so that rates r_i >= 0 give expected domain totals
``sum_i r_i n_i p_i``.  With N tokens in all and ``s_d`` the share of them that
domain d expects at rate 1, projected gradient descent minimises

    sum_d (sum_i r_i n_i p_id / N - target_d)^2 / (2 s_d)   over r >= 0,

starting from 1, in the metric ``sum_i n_i r_i^2 / N``.  There the gradient of
r_i is ``sum_d p_id miss_d / s_d``, the projection is the cut at 0, and the
curvature is at most 1 (its matrix has the eigenvector sqrt(s) with the
eigenvalue 1 and no negative entry), so that steps of length 1 never overshoot
and converge; they are taken with momentum, which starts anew whenever it points
uphill.  The descent ends when every domain is met within ``CLOSE``, when the
rates no longer move, which is the condition for the minimum, or after
``STEPS``; ``gap`` is the largest distance from a target that is left.  Documents of equal posteriors
have equal rates, so the sums run over the table of distinct posteriors, at most
one row for each grid point.

Only sums of the number of domains reach the driver in a step.  The
classifier's tables are ``cells`` x domains.  Null and empty texts have no
tokens, posteriors equal to the prior, and a rate like any other.  Repeated
rows have equal rates.  Without labels all posteriors are uniform.  A target
domain without tokens can't be met, nor, as a rule, can one of 0; ``gap`` then
is over 0 and the totals are the nearest ones.  Columns named like the results are replaced by ``mix``;
others are passed through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import attach, cut, keyed, text_of

DOMAINS = ("clean", "toxic", "junk")
TARGETS = {"clean": 0.90, "toxic": 0.02, "junk": 0.08}
MAX_LABELLED, CELLS, GRID, TEMPERATURE, STEPS, CLOSE = 20_000, 1 << 15, 64, 4.0, 100, 1e-6


def domain(quality: Column, toxic: Column) -> Column:
    """Index in DOMAINS."""
    return F.when(quality == 0, 2).when(F.coalesce(toxic, F.lit(0)) == 1, 1).otherwise(0)


class _Cells(dict):
    """word: its cell and that of its ending, in one number, remembered up to a fixed number of words."""

    def __init__(self, cells: int):
        super().__init__()
        self.cells = cells

    def __missing__(self, word: str) -> int:
        if len(self) > 1 << 17:
            self.clear()
        a, b = (zlib.crc32(x.encode()) % self.cells for x in (word, f"~{word[-2:]}"))
        self[word] = both = a * self.cells + b
        return both

    def of_text(self, text: str) -> tuple[np.ndarray, int]:
        """The different cells of a text's words, and how many words it has."""
        w = text.lower().split()
        both = np.fromiter(map(self.__getitem__, w), np.int64, len(w))
        return np.unique(np.concatenate([both // self.cells, both % self.cells])), len(w)


def _count_map(cells: int, domains: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, of = np.zeros((cells, domains), np.int64), _Cells(cells)
        for b in batches:
            for text, d in zip(b.column("text"), b.column("d"), strict=True):
                # Each cell of a text counts once: a few telling words are enough.
                total[of.of_text(text.as_py())[0], d.as_py()] += 1
        at = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(total[at, k]) for k in range(domains))], ["cell", *(f"n{k}" for k in range(domains))])

    return run


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """(log prior, cells x domains log probabilities)."""
    k = len(DOMAINS)
    own = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min(domain(F.col("quality"), F.col("toxic"))).alias("d"))
    ids = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).select(F.col("doc_id").alias("_id"), "d")
    # max_labelled ids at most: the broadcast has a fixed bound.
    met = docs.select(F.col("doc_id"), text_of().alias("text")).join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).select("text", "d")
    rows = met.mapInArrow(_count_map(cells, k), "cell bigint, " + ", ".join(f"n{i} bigint" for i in range(k))).groupBy("cell").agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in range(k))).collect()
    sizes = {r["d"]: r["n"] for r in met.groupBy("d").agg(F.count("*").alias("n")).collect()}
    n = np.zeros((cells, k))
    for r in rows:
        n[r["cell"]] = [r[f"n{i}"] for i in range(k)]
    size = np.array([sizes.get(i, 0) for i in range(k)], float)
    prior = np.log((size + 1) / (size.sum() + k)) if size.sum() else np.full(k, -np.log(k))
    # Share of a domain's documents that hold the cell, drawn to the share over all documents where the domain has few.
    every = (n.sum(axis=1, keepdims=True) + 0.5) / (size.sum() + 1)
    return prior, np.log((n + 4 * every) / (size + 4))


def whole_parts(p: np.ndarray, grid: int) -> np.ndarray:
    """Rows of shares as whole parts that add up to grid, what rounding down leaves going to the largest rests."""
    exact = grid * p
    out = np.floor(exact + 1e-9).astype(np.int64)
    rest = np.argsort(np.argsort(out - exact, axis=1, kind="stable"), axis=1, kind="stable")
    return (out + (rest < (grid - out.sum(axis=1))[:, None])).astype(np.int16)


def _posterior_map(prior: np.ndarray, table: np.ndarray, grid: int, temperature: float):
    base = np.log(np.exp(table).mean(axis=1, keepdims=True))
    ratio = (table - base).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _Cells(len(ratio))
        for b in batches:
            sizes, logs = [], np.zeros((b.num_rows, len(prior)))
            for i, text in enumerate(b.column("text")):
                found, n = of.of_text(text.as_py())
                sizes.append(n)
                logs[i] = ratio[found].sum(axis=0, dtype=np.float64)
            p = prior + logs / temperature
            p = np.exp(p - p.max(axis=1, keepdims=True))
            p = whole_parts(p / p.sum(axis=1, keepdims=True), grid)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(sizes, pa.int64()), *(pa.array(p[:, j]) for j in range(len(prior)))], ["doc_id", "th", "n_tokens", *(f"p{j}" for j in range(len(prior)))])

    return run


def posteriors(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, cells: int = CELLS, grid: int = GRID, temperature: float = TEMPERATURE) -> DataFrame:
    """doc_id, th, n_tokens and p0 .. pk, posteriors in parts of grid."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    prior, table = learn(docs, labels, max_labelled, cells)
    return keyed(docs).mapInArrow(_posterior_map(prior, table, grid, temperature), f"doc_id {kind}, th bigint, n_tokens bigint, " + ", ".join(f"p{j} smallint" for j in range(len(prior))))


def moves(p: list[Column], history: list[tuple[float, np.ndarray]]) -> Column:
    """The rate of posteriors p after the steps so far (momentum and gradient of each), the rate before, and the place between that the last step started from."""
    start = F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("prev"), F.lit(1.0).alias("y"))
    if not history:
        return start
    steps = F.from_json(F.lit(str([[float(m), *map(float, g)] for m, g in history])), "array<array<double>>")

    def step(a: Column, g: Column) -> Column:
        y = a["r"] + g[0] * (a["r"] - a["prev"])
        now = F.greatest(F.lit(0.0), y - sum((x * g[j + 1] for j, x in enumerate(p)), F.lit(0.0)))
        return F.struct(now.alias("r"), a["r"].alias("prev"), y.alias("y"))

    return F.aggregate(steps, start, step)


def fit(found: DataFrame, targets: dict[str, float], grid: int = GRID, steps: int = STEPS, close: float = CLOSE) -> tuple[list[tuple[float, np.ndarray]], float]:
    """The steps that take every rate from 1 to its fitted value, and the gap that they leave."""
    k = len(DOMAINS)
    names = [f"p{j}" for j in range(k)]
    points = cut(found.groupBy(*names).agg(F.sum("n_tokens").cast("double").alias("n")).where("n > 0"))
    p = [F.col(x) / grid for x in names]
    total = points.agg(F.sum("n")).first()[0]
    if not total:
        return [], 0.0
    weights = np.array([targets.get(d, 0.0) for d in DOMAINS])
    goal, history, share, age = weights / weights.sum(), [], None, 1.0
    while True:
        at = points.select("n", *(x.alias(f"x{j}") for j, x in enumerate(p)), moves(p, history).alias("m")).select("*", "m.*")
        moved = F.col("r") - F.col("prev")
        sums = [F.sum(F.col("n") * F.col(c) * F.col(f"x{j}")) for c in ("r", "prev") for j in range(k)]
        row = at.agg(*sums, F.sum(F.col("n") * moved * moved), F.sum(F.col("n") * (F.col("y") - F.col("r")) * moved)).first()
        now, before = np.array(row[:k]) / total, np.array(row[k : 2 * k]) / total
        share = now if share is None else share
        gap = float(np.abs(now - goal).max())
        if gap < close or len(history) >= steps or history and row[2 * k] / total < close**2:
            return history, gap
        age = 1.0 if row[2 * k + 1] > 0 else age
        older, age = age, (1 + np.sqrt(1 + 4 * age * age)) / 2
        momentum = (older - 1) / age if history else 0.0
        miss = now + momentum * (now - before) - goal
        history = [*history, (momentum, np.where(share > 0, miss / np.maximum(share, 1e-300), 0.0))]


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, max_labelled: int = MAX_LABELLED, cells: int = CELLS, grid: int = GRID) -> DataFrame:
    """doc_id, th, n_tokens, a posterior for each domain, rate and gap, for every row."""
    found = cut(posteriors(docs, labels, max_labelled, cells, grid))
    history, gap = fit(found, targets or TARGETS, grid)
    p = [F.col(f"p{j}") / grid for j in range(len(DOMAINS))]
    return found.select("doc_id", "th", "n_tokens", *(x.alias(f"p_{d}") for x, d in zip(p, DOMAINS, strict=True)), moves(p, history)["r"].alias("rate"), F.lit(gap).alias("gap"))


def copies(value: Column, doc_id: Column, th: Column) -> Column:
    """A whole number of copies with the rate as its mean: the part after the point is drawn by a hash of the row's key."""
    whole = F.floor(value)
    return (whole + (F.pmod(F.xxhash64(doc_id, th), F.lit(1 << 30)) / F.lit(float(1 << 30)) < value - whole).cast("bigint")).cast("bigint")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return rates(docs, labels).select("doc_id", "n_tokens", *(F.round(f"p_{d}", 6).alias(f"p_{d}") for d in DOMAINS), F.round("rate", 6).alias("rate"), copies(F.col("rate"), F.col("doc_id"), F.col("th")).alias("copies"), F.round("gap", 6).alias("gap"))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """Every row with its columns, its rate, and the number of copies that the mixture takes of it."""
    cols = [c for c in docs.columns if c not in ("rate", "copies")]
    row = docs.select(F.struct(*(docs[c] for c in cols)).alias("_row"), docs["doc_id"].alias("doc_id"), F.xxhash64(text_of(docs["text"])).alias("th"))
    found = rates(docs, labels, targets).groupBy("doc_id", "th").agg(F.first("rate").alias("rate"))
    both = attach(row, found)
    return both.select("_row", F.round("rate", 6).alias("rate"), copies(F.col("rate"), F.col("doc_id"), F.col("th")).alias("copies")).select("_row.*", "rate", "copies")
