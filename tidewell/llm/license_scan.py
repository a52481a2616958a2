"""Licences (native): ordered signature rules behind keyword gates, overlaps resolved.

The text is ASCII-lower-cased and cut to words; signatures are regular
expressions over the words joined by single blanks.  The rules, some 450 by
hand (``license_rules``), belong to families: full texts and headers, SPDX
identifiers, notices, addresses, names with and without versions.  A family's
rules run only on texts that hold one of its keywords as a word; at each place
the first of them in order of priority that matches is a detection.
Detections of all families are then swept by place: one that lies inside
another is suppressed, of two that overlap in part the one with the better
(smaller) priority stays.  Base phrases and their labels always stay.

Null and empty texts have no words; first_word and last_word are null without
a base phrase.  Repeated rows give equal rows.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import PIECE, find_spans, indices, let, split_words, text_of
from tidewell.llm.license_rules import Rule, families

#: Fixed values of the base rules.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
ONE = "struct<s:int,e:int,priority:int,label:string,confidence:double>"
SPAN_LIST = f"array<{ONE}>"


def pattern_of(rules: list[Rule]) -> str:
    """One expression for a family, its rules tried in order at each place."""
    return "(?<= )(?:" + "|".join(f"(?:{r[0]})" for r in rules) + ")(?= )"


def words_of(keywords: list[str]) -> Column:
    return F.array(*map(F.lit, keywords))


def told(v: Column, rules: list[Rule]) -> Column:
    """priority, label and confidence of the first rule that matches all of v."""
    out = None
    for pattern, priority, label, confidence in rules:
        one = F.struct(F.lit(priority).alias("priority"), F.lit(label).alias("label"), F.lit(confidence).alias("confidence"))
        out = F.when(v.rlike(f"^(?:{pattern})$"), one) if out is None else out.when(v.rlike(f"^(?:{pattern})$"), one)
    return out


def detections(blanked: Column, held: Column) -> Column:
    """All detections: (s, e, priority, label, confidence) in code points of the blanked text; held: the keywords in it."""

    def own(keywords: list[str], rules: list[Rule]) -> Column:
        found = F.transform(find_spans(blanked, pattern_of(rules)), lambda x: let(told(x["v"], rules), lambda r: F.struct(x["s"].alias("s"), x["e"].alias("e"), r["priority"].alias("priority"), r["label"].alias("label"), r["confidence"].alias("confidence"))))
        return F.when(F.arrays_overlap(held, words_of(keywords)), found).otherwise(F.array().cast(SPAN_LIST))

    return F.concat(*(own(keywords, rules) for _, keywords, rules in families()))


def resolved(found: Column) -> Column:
    """The sweep: contained detections go, of partial overlaps the better priority stays."""
    ordered = F.array_sort(
        found,
        lambda a, b: F.when(a["s"] != b["s"], a["s"] - b["s"]).when(a["e"] != b["e"], b["e"] - a["e"]).when(a["priority"] != b["priority"], a["priority"] - b["priority"]).when(a["label"] < b["label"], -1).when(a["label"] > b["label"], 1).otherwise(0),
    )

    def step(acc: Column, x: Column) -> Column:
        last = acc["last"]
        free = last.isNull() | (x["s"] >= last["e"])
        now = F.when(free, x).when((x["e"] <= last["e"]) | (x["priority"] >= last["priority"]), last).otherwise(x)
        return F.struct(now.alias("last"), F.when(free & last.isNotNull(), F.concat(acc["out"], F.array(last))).otherwise(acc["out"]).alias("out"))

    none, empty = F.lit(None).cast(ONE), F.array().cast(f"array<{ONE}>")

    def swept(v: Column) -> Column:
        # In pieces, as appending copies: the work stays linear.
        pieces = F.transform(indices(F.ceil(F.size(v) / PIECE).cast("int")), lambda c: F.slice(v, c * PIECE + 1, F.lit(PIECE)))

        def whole(acc: Column, piece: Column) -> Column:
            part = F.aggregate(piece, F.struct(acc["last"].alias("last"), empty.alias("out")), step)
            return let(part, lambda r: F.struct(r["last"].alias("last"), F.concat(acc["outs"], F.array(r["out"])).alias("outs")))

        zero = F.struct(none.alias("last"), F.array().cast(f"array<array<{ONE}>>").alias("outs"))
        return F.aggregate(pieces, zero, whole, lambda acc: F.concat(F.flatten(acc["outs"]), F.when(acc["last"].isNotNull(), F.array(acc["last"])).otherwise(empty)))

    return let(ordered, swept)


def base_places(w: Column) -> Column:
    """(at, label) of each place where a base phrase stands."""
    tests = [(p.split(), label) for p, label in BASE.items()]

    def label_at(x: Column, i: Column) -> Column:
        out = None
        for phrase, label in tests:
            cond = x == phrase[0]
            for j, word in enumerate(phrase[1:], 1):
                cond = cond & F.coalesce(F.get(w, i + j) == word, F.lit(False))
            out = F.when(cond, label) if out is None else out.when(cond, label)
        return F.struct(i.alias("at"), out.alias("label"))

    return F.filter(F.transform(w, label_at), lambda x: x["label"].isNotNull())


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base: (at in words, label), found: the resolved detections in code points of the blanked text."""
    every = sorted({k for _, keywords, _ in families() for k in keywords})
    rows = docs.select(F.col("doc_id"), split_words(text_of(), True, True).alias("w"))
    rows = rows.select("doc_id", "w", F.array_intersect("w", words_of(every)).alias("held"))
    # Only texts that hold a keyword are joined again; every base phrase holds one, too.
    rows = rows.select("doc_id", "w", "held", F.when(F.size("held") > 0, F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" "))).alias("t"))
    return rows.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.when(F.col("t").rlike("|".join(f" {p} " for p in BASE)), base_places(F.col("w"))).otherwise(F.array().cast("array<struct<at:int,label:string>>")).alias("base"),
        F.when(F.col("t").isNotNull(), let(F.struct("t", "held"), lambda x: resolved(detections(x["t"], x["held"])))).otherwise(F.array().cast(SPAN_LIST)).alias("found"),
    )


def report(docs: DataFrame) -> DataFrame:
    found = scan(docs)
    base = F.array_distinct(F.transform("base", lambda x: x["label"]))
    every = F.array_distinct(F.concat(base, F.transform("found", lambda x: x["label"])))
    at = F.transform("base", lambda x: x["at"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"),
        F.array_max(at).cast("long").alias("last_word"),
        F.array_join(F.sort_array(base), ",").alias("base_labels"),
        F.array_join(F.sort_array(every), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["confidence"])), F.when(F.size("base") > 0, 0.5).otherwise(0.0)).alias("score"),
    )
