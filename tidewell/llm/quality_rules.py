"""Quality rules (native): fixed base rules, and a hashed n-gram likelihood ratio.

Word unigrams and bigrams are hashed to ``buckets`` cells.  Two multinomials
with add-one smoothing are estimated over the cells: one over the trusted
texts (labelled quality 1, not toxic), one over every text of the corpus.  A
document's ratio is the mean over its n-grams of
``log(p_trusted / p_corpus)``, so length cancels; a document whose ratio is
under the threshold is rejected.

Corpus counts are taken over all documents with map-side combining; what
reaches the driver is one number pair for each of ``buckets`` cells, a fixed
size.  The trusted texts are at most ``max_trusted`` labelled rows, those
with the smallest hashes of their id, so that their ids can be broadcast.

Null and empty texts have no words: every count is 0, ``llr`` is 0, the base
rule fails them.  Repeated rows are judged alike.  Without labels every ratio
is 0 and only the base rules decide.  Other columns of the table are ignored
by ``score`` and passed through untouched by ``keep``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import NOT_SPACE, indices, let, text_of, words

BUCKETS = 1 << 14
MAX_TRUSTED = 20_000
THRESHOLD = -0.1
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def ngram_cells(w: Column, buckets: int) -> Column:
    """Cells of the unigrams and bigrams of an array of words."""
    one = F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int"))
    two = F.transform(indices(F.size(w), 1), lambda i: F.pmod(F.xxhash64(w[i - 1], w[i]), F.lit(buckets)).cast("int"))
    return F.concat(one, two)


def repeat_words(w: Column) -> Column:
    """Words in 3-word windows that the text holds twice or more.

    Windows are compared by 64-bit hashes.  Only texts with a repeated window
    go on to the sort that finds their places.
    """

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            n = F.size(s)
            hit = F.filter(F.transform(s, lambda x, j: F.when(((j > 0) & (F.get(s, j - 1)["h"] == x["h"])) | ((j < n - 1) & (F.get(s, j + 1)["h"] == x["h"])), x["i"])), lambda x: x.isNotNull())
            return F.sort_array(hit)

        def total(p: Column) -> Column:
            step = F.transform(p, lambda x, j: F.when(j < F.size(p) - 1, F.least(F.lit(3), F.get(p, j + 1) - x)).otherwise(F.lit(3)))
            return F.aggregate(step, F.lit(0), lambda a, x: a + x)

        return let(let(pairs, places), total)

    hashes = F.transform(indices(F.size(w), 2), lambda i: F.xxhash64(w[i - 2], w[i - 1], w[i]))
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0)))


def dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda v: F.size(v) - F.size(F.array_distinct(v)))


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, max_trusted: int = MAX_TRUSTED) -> list[float]:
    """log(p_trusted / p_corpus) of each cell."""
    trusted = labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    trusted = trusted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_trusted).select(F.col("doc_id").alias("_id"), F.lit(1).alias("_t"))
    base = docs.select(F.col("doc_id"), text_of().alias("text"))
    # At most max_trusted ids of 8 bytes: the broadcast has a fixed bound.
    base = base.join(F.broadcast(trusted), F.col("doc_id") == F.col("_id"), "left")
    cells = base.select("_t", F.explode(let(words(F.col("text"), NOT_SPACE), lambda w: ngram_cells(w, buckets))).alias("cell"))
    counts = {r["cell"]: (r["n"], r["t"]) for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.count("_t").alias("t")).collect()}
    n, t = sum(x for x, _ in counts.values()), sum(x for _, x in counts.values())
    if not t:
        return [0.0] * buckets
    shift = math.log(n + buckets) - math.log(t + buckets)
    return [math.log(b + 1) - math.log(a + 1) + shift for a, b in (counts.get(i, (0, 0)) for i in range(buckets))]


def literal(weights: list[float]) -> Column:
    """The weights as one array literal: a foldable expression of fixed size."""
    return F.split(F.lit(",".join(f"{x:.6g}" for x in weights)), ",").cast("array<double>")


def verdicts(text: Column, weights: list[float], threshold: float = THRESHOLD) -> Column:
    """All measures of one text, as a struct."""
    table, size = literal(weights), len(weights)

    def of(w: Column) -> Column:
        cells = ngram_cells(w, size)
        llr = let(cells, lambda c: F.when(F.size(c) > 0, F.aggregate(c, F.lit(0.0), lambda a, x: a + F.get(table, x)) / F.size(c)).otherwise(F.lit(0.0)))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
            dup_lines(text).cast("long").alias("n_dup_lines"),
            repeat_words(w).cast("long").alias("n_repeat_words"),
            llr.alias("llr"),
        )

    def judged(m: Column) -> Column:
        failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
        return F.struct(*(m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), failed.alias("base_failed"), (~failed & (m["llr"] >= threshold)).alias("kept"), m["llr"].alias("llr"))

    return let(let(words(text, NOT_SPACE), of), judged)


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, max_trusted: int = MAX_TRUSTED) -> DataFrame:
    """doc_id and the measures and verdicts of every row."""
    weights = fit(docs, labels, buckets, max_trusted)
    return docs.select(F.col("doc_id"), verdicts(text_of(), weights, threshold).alias("_m")).select("doc_id", "_m.*")


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, max_trusted: int = MAX_TRUSTED) -> DataFrame:
    """The rows that the rules keep, with all their columns."""
    weights = fit(docs, labels, buckets, max_trusted)
    held = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), verdicts(text_of(docs["text"]), weights, threshold)["kept"].alias("_kept"))
    return held.where("_kept").select("_row.*")
