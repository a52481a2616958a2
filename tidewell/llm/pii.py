"""Personal data (native): regular expressions propose, checksums confirm, nearby words adjust the score.

Base kinds ``email``, ``ip``, ``card`` (Luhn) and ``phone`` always stay.  The
operator adds ``iban`` (mod-97) and ``national`` (telephone numbers without a
country code, accepted only where a context word lifts their score).  Every
pattern is linear in the text: starts are pinned by look-behinds and
repetitions are of single character classes, so long runs neither backtrack
nor recurse.

Null and empty texts have no spans.  Repeated rows give equal rows.  Columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import SPANS, find_spans, indices, let, sha256, text_of

#: Forms of the base rules with the same matches: a start that an earlier start of the same run would have taken is left out.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@(?=[A-Za-z0-9-]++\.[A-Za-z0-9-])[A-Za-z0-9-][A-Za-z0-9.-]*?(?<=[A-Za-z0-9-])(?![A-Za-z0-9-])(?!\.[A-Za-z0-9-])"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][ -])(?=[0-9](?:[ -]?[0-9]){12})[0-9][0-9 -]*?(?<=[0-9])(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
NATIONAL = r"(?<![0-9+().-])\(?[0-9]{2,5}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])"
BASE, ADDED = ("email", "ip", "card", "phone"), ("iban", "national")

#: Score of a confirmed proposal, words that raise it, words that lower it.
START = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "national": 0.3}
RAISE = {
    "email": r"\b(e-?mail|contact|write|mailto|courriel|correo)\b",
    "ip": r"\b(ip|address|host|server|login|from)\b",
    "card": r"\b(card|visa|mastercard|amex|credit|debit|payment|karte|carte|tarjeta)\b",
    "phone": r"\b(phone|tel|telephone|call|mobile|fax|telefon|t[eé]l[eé]fono?)\b",
    "iban": r"\b(iban|account|bank|transfer|konto|compte|cuenta)\b",
    "national": r"\b(phone|tel|telephone|call|mobile|fax|telefon|t[eé]l[eé]fono?)\b",
}
LOWER_BY = {
    "email": r"\b(example|noreply|no-reply)\b",
    "ip": r"\b(version|release|section|chapter)\b",
    "card": r"\b(order|tracking|serial|isbn|sample|test)\b",
    "phone": r"\b(order|serial|isbn|sample)\b",
    "iban": r"\b(sample|example|test)\b",
    "national": r"\b(order|serial|isbn|version)\b",
}
STEP, ACCEPT = 0.2, 0.5


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""

    def value(r: Column, i: Column) -> Column:
        x = F.substring(r, i + 1, 1).cast("int")
        return F.when(i % 2 == 0, x).otherwise(F.when(x > 4, 2 * x - 9).otherwise(2 * x))

    return let(F.reverse(d), lambda r: F.aggregate(indices(F.length(r)), F.lit(0), lambda a, i: a + value(r, i)) % 10 == 0)


def mod97(v: Column) -> Column:
    """Whether an account number passes the mod-97 check."""
    plain = F.replace(v, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))

    def step(a: Column, c: Column) -> Column:
        x = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
        return (a * F.when(x > 9, F.lit(100)).otherwise(F.lit(10)) + x) % 97

    return let(turned, lambda t: F.aggregate(F.transform(indices(F.length(t)), lambda i: F.substring(t, i + 1, 1)), F.lit(0), step) == 1)


def valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        # More than nine digits are compared after their leading zeros are gone.
        return F.forall(F.split(v, r"\."), lambda p: let(F.regexp_replace(p, "^0+(?=[0-9])", ""), lambda q: (F.length(q) <= 3) & (F.substring(q, 1, 3).cast("int") <= 255)))
    if kind == "card":
        return let(digits(v), lambda d: F.length(d).between(13, 19) & luhn(F.substring(d, 1, 19)))
    if kind == "phone":
        return F.length(digits(v)).between(9, 15)
    if kind == "iban":
        return mod97(v)
    if kind == "national":
        return F.length(digits(v)).between(9, 12)
    return F.lit(True)


GATE = {"email": (EMAIL, lambda t: t.contains("@")), "ip": (IP, lambda t: t.rlike(r"[0-9]\.[0-9]")), "card": (CARD, lambda t: t.rlike("[0-9]")), "phone": (PHONE, lambda t: t.contains("+")), "iban": (IBAN, lambda t: t.rlike("[A-Z]{2}[0-9]{2}")), "national": (NATIONAL, lambda t: t.rlike("[0-9]{3}"))}


def scored(kind: str, text: Column) -> Column:
    """The confirmed spans of a kind with their scores; those of the added kinds need ACCEPT."""
    pattern, gate = GATE[kind]

    def weighed(x: Column) -> Column:
        near = F.lower(F.concat_ws(" | ", x["l"], x["r"]))
        s = let(near, lambda n: F.lit(START[kind]) + F.when(n.rlike(RAISE[kind]), STEP).otherwise(0.0) - F.when(n.rlike(LOWER_BY[kind]), STEP).otherwise(0.0))
        return F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), F.round(s, 2).alias("score"))

    found = F.transform(F.filter(F.when(gate(text), find_spans(text, pattern)).otherwise(F.array().cast(SPANS)), lambda x: valid(kind, x["v"])), weighed)
    return found if kind in BASE else F.filter(found, lambda x: x["score"] >= ACCEPT)


def outside(found: Column, others: Column) -> Column:
    """Spans that overlap none of the others."""
    return F.filter(found, lambda x: ~F.exists(others, lambda y: (x["s"] < y["e"]) & (y["s"] < x["e"])))


def detect(docs: DataFrame) -> DataFrame:
    """doc_id and found: array of (kind, s, e, score), kinds in order, then by place.  s and e are code points, e exclusive."""
    t = F.col("text")
    by_kind = docs.select(F.col("doc_id"), text_of().alias("text")).select("doc_id", *(scored(k, t).alias(k) for k in (*BASE, *ADDED)))
    base = F.concat(*(F.col(k) for k in BASE))
    iban = outside(F.col("iban"), base)
    return by_kind.select("doc_id", base.alias("base"), F.concat(iban, outside(F.col("national"), F.concat(base, iban))).alias("added"))


def of_kind(found: Column, kind: str) -> Column:
    return F.filter(found, lambda x: x["kind"] == kind)


def listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """The digest of detect(): counts of the base kinds, their hash, all spans, and the highest score."""
    found = detect(docs)
    return found.select(
        "doc_id",
        *(F.size(of_kind(F.col("base"), k)).cast("long").alias(f"n_{k}") for k in BASE),
        sha256(listed(F.col("base"))).alias("base_sha256"),
        listed(F.concat("base", "added")).alias("spans"),
        F.coalesce(F.array_max(F.transform(F.concat("base", "added"), lambda x: x["score"])), F.lit(0.0)).alias("top_score"),
    )
