"""Benchmark decontamination (native): winnowed fingerprints, joined and extended to whole windows.

Words are ASCII-lower-cased runs of letters, digits and non-ASCII code
points.  A window is ``window`` consecutive words of a benchmark item, or all
of a shorter item.  Both sides keep, of every ``window - gram + 1``
consecutive gram hashes, the smallest; a window shared by a document and an
item therefore shares at least one kept fingerprint.  Equal fingerprints are
joined, and each hit is extended: the whole window around it is compared
word by word, so hash collisions do no harm.  Shorter items are fingerprinted
whole, and documents by all grams of those lengths.

The distinct windows of the benchmark are broadcast only if they and the items
listed at them are counted and found to be at most ``max_broadcast``; otherwise both sides are shuffled
by fingerprint, each document fingerprint with the few words around it.

Null and empty texts have no words.  Repeated rows give equal rows; repeated
items of one id count once.  An empty benchmark hits nothing.  Other columns
are ignored by ``hits`` and passed through by ``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import WORD, ascii_lower, attach, bounded, cut, indices, keyed, let, sha256, split_words, text_of, words

WINDOW, GRAM, MAX_BROADCAST = 8, 5, 500_000
MIN_ITEMS = 2


def grams(w: Column, k: int) -> Column:
    """Hashes of the k-grams of an array of words, by place."""
    return F.transform(indices(F.size(w), k - 1), lambda i: F.xxhash64(F.lit(k), *(w[i - (k - 1 - j)] for j in range(k))))


def is_winnowed(h: Column, i: Column, span: int) -> Column:
    """Whether h[i] is the smallest, ties included, of some span consecutive hashes of the array: at least span - 1 neighbours in a row are no smaller."""
    x = F.get(h, i)
    before = [F.get(h, i - j) >= x for j in range(1, span)]
    after = [F.get(h, i + j) >= x for j in range(1, span)]
    out = F.lit(False)
    for left in range(span):
        test = F.lit(True)
        for part in (*before[:left], *after[: span - 1 - left]):
            test = test & part
        out = out | test
    return F.coalesce(out, F.lit(False))


def item_windows(benchmark: DataFrame, window: int, gram: int) -> DataFrame:
    """h, off, m, win, items: each distinct window once, with the place of its smallest gram and the ids of its items."""
    w = words(ascii_lower(text_of()), WORD)
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), w.alias("w")).where((F.size("w") > 0) & F.col("item").isNotNull())
    parts = F.when(F.size("w") >= window, F.transform(indices(F.size("w"), window - 1), lambda i: F.slice("w", i - (window - 2), window))).otherwise(F.array("w"))
    wins = rows.select("item", F.explode(F.array_distinct(parts)).alias("win")).groupBy("win").agg(F.collect_set("item").alias("items"))
    full = let(grams(F.col("win"), gram), lambda h: let(F.array_min(h), lambda x: F.struct(x.alias("h"), (F.array_position(h, x) - 1).cast("int").alias("off"))))
    short = F.struct(F.coalesce(*(F.when(F.size("win") == k, F.get(grams(F.col("win"), k), 0)) for k in range(1, window))).alias("h"), F.lit(0).alias("off")) if window > 1 else full
    return wins.select(F.when(F.size("win") == window, full).otherwise(short).alias("f"), F.size("win").alias("m"), "win", "items").select("f.*", "m", "win", "items")


def _met(docs: DataFrame, benchmark: DataFrame, window: int, gram: int, max_broadcast: int, every: bool) -> DataFrame:
    """doc_id, th, n_words, span, items: a row for each window found at a kept fingerprint; every: and one with null span for each row of docs."""
    fp = item_windows(benchmark, window, gram)
    stat = fp.agg((F.count("*") + F.coalesce(F.sum(F.size("items")), F.lit(0))).alias("n"), F.collect_set(F.when(F.col("m") < window, F.col("m"))).alias("short")).first()
    small, short, width = stat["n"] <= max_broadcast, sorted(stat["short"]), window - gram + 1
    rows = keyed(docs).select("doc_id", "th", split_words(F.col("text"), True, True).alias("w"))
    rows = rows.select("doc_id", "th", "w", F.size("w").alias("n_words"), grams(F.col("w"), gram).alias("g"), *(grams(F.col("w"), k).alias(f"g{k}") for k in short))
    # Before each array of hashes stands the row's own entry, which no fingerprint equals.
    ahead = every and small
    own = F.array(F.lit(None).cast("bigint")) if ahead else F.array().cast("array<bigint>")
    # One generator over all hashes, so that the arrays are never copied for each of them.
    each = rows.select("doc_id", "th", "w", "n_words", "g", F.posexplode(F.concat(own, "g", *(f"g{k}" for k in short))).alias("q", "h"))
    whole, at = F.lit(False), F.col("q") - int(ahead)
    p = at
    end = F.greatest(F.col("n_words") - (gram - 1), F.lit(0))
    for k in short:
        p, whole = F.when(at >= end, at - end).otherwise(p), whole | (at >= end)
        end = end + F.greatest(F.col("n_words") - (k - 1), F.lit(0))
    each = each.select("doc_id", "th", "w", "n_words", "g", "h", p.alias("p"), whole.alias("whole"))
    kept = F.col("whole") | is_winnowed(F.col("g"), F.col("p"), width)
    start = F.col("p") - F.col("off")
    if small:
        # The join with the broadcast comes first and the winnowing test of the document's side after it: the test is dearer.
        met = each.join(F.broadcast(fp), "h", "left" if every else "inner")
        hit = kept & (start >= 0) & (F.slice("w", F.greatest(start, F.lit(0)) + 1, F.col("m")) == F.col("win"))
    else:
        room = window - 1
        near = each.where(kept).select("doc_id", "th", "n_words", "p", "h", F.slice("w", F.greatest(F.col("p") - room, F.lit(0)) + 1, 2 * window).alias("near"))
        met = near.join(fp, "h")
        at = F.least(F.col("p"), F.lit(room)) - F.col("off")
        hit = (at >= 0) & (F.slice("near", F.greatest(at, F.lit(0)) + 1, F.col("m")) == F.col("win"))
    met = met.where(F.col("h").isNull() | hit)
    out = met.select("doc_id", "th", "n_words", F.when(F.col("m").isNotNull(), F.struct(start.alias("s"), F.col("m").alias("m"))).alias("span"), "items")
    if every and not small:
        # Beside the join, not through it: rows without a key would all be dealt to one task.
        out = out.unionByName(rows.select("doc_id", "th", "n_words", F.lit(None).cast(out.schema["span"].dataType).alias("span"), F.lit(None).cast(out.schema["items"].dataType).alias("items")))
    return out


def _gathered(met: DataFrame) -> DataFrame:
    return met.groupBy("doc_id", "th").agg(
        F.max("n_words").alias("n_words"),
        F.sum(F.col("span").isNull().cast("int")).alias("copies"),
        F.sort_array(F.collect_set("span")).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """doc_id, th, spans: sorted distinct (s, m) of hit windows in words, items: sorted ids.  Only documents that are hit."""
    return _gathered(_met(docs, benchmark, window, gram, max_broadcast, False)).select("doc_id", "th", "spans", "items")


def covered(spans: Column) -> Column:
    """Words in the union of sorted spans (s, m)."""
    return F.aggregate(
        spans,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, x: F.struct(F.greatest(a["end"], x["s"] + x["m"]).alias("end"), (a["n"] + F.greatest(F.lit(0), x["s"] + x["m"] - F.greatest(a["end"], x["s"]))).alias("n")),
        lambda a: a["n"],
    )


def report(docs: DataFrame, benchmark: DataFrame, min_items: int = MIN_ITEMS, window: int = WINDOW, gram: int = GRAM, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    found = _gathered(_met(docs, benchmark, window, gram, max_broadcast, True))
    n_items = F.size("items").cast("long")
    rows = found.select("doc_id", F.col("n_words").cast("long").alias("n_words"), covered(F.col("spans")).cast("long").alias("n_hit"), n_items.alias("n_items"), sha256(F.array_join("items", ",")).alias("items_sha256"), (n_items >= min_items).alias("contaminated"), "copies")
    return rows.withColumn("copies", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).drop("copies")


def clean(docs: DataFrame, benchmark: DataFrame, min_items: int = MIN_ITEMS, window: int = WINDOW, gram: int = GRAM, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """Rows of the table without the contaminated ones; hit words of the others are cut out of their texts.

    A word goes with the separators after it; n_chars, if there, is counted anew.
    """
    cols = docs.columns
    row = docs.select(F.struct(*(docs[c] for c in cols)).alias("_row"), docs["doc_id"].alias("doc_id"), F.xxhash64(text_of(docs["text"])).alias("th"))
    hit = hits(docs, benchmark, window, gram, max_broadcast)
    # Cut once: its rows are counted, and few enough are sent to the texts instead of the texts to them.
    both = attach(row, bounded(cut(hit.select("doc_id", "th", "spans", F.size("items").alias("n_items"))), "spans")).where(F.coalesce(F.col("n_items") < min_items, F.lit(True)))
    text = text_of(F.col("_row.text"))
    # Separators between words; each word's own letters are taken by the case-blind form of the pattern.
    any_case = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

    def kept(spans: Column) -> Column:
        gone = F.flatten(F.transform(spans, lambda x: F.sequence(x["s"], x["s"] + x["m"] - 1)))

        def rest(gaps: Column) -> Column:
            parts = let(words(text, any_case), lambda v: F.zip_with(v, F.slice(gaps, 2, F.size(v)), lambda a, b: F.concat(a, b)))
            left = let(parts, lambda p: F.transform(F.array_except(indices(F.size(p)), gone), lambda i: F.get(p, i)))
            return F.concat(F.element_at(gaps, 1), F.array_join(left, ""))

        return let(F.split(text, any_case, -1), rest)

    new = both.select("_row", F.col("spans").isNotNull().alias("_hit"), F.when(F.col("spans").isNotNull(), kept(F.col("spans"))).otherwise(F.col("_row.text")).alias("_text"))
    fields = {"text": F.col("_text"), "n_chars": F.when(F.col("_hit"), F.length("_text").cast(dict(docs.dtypes).get("n_chars", "bigint"))).otherwise(F.col("_row.n_chars")) if "n_chars" in cols else None}
    return new.select(*(fields.get(c, F.col("_row").getField(c)).alias(c) for c in cols))
