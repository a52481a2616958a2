"""Secrets (native): candidates, and how many repositories and owners of the corpus hold each.

Patterns propose candidates.  Each candidate's secret part is hashed; the
hashes are aggregated over the whole corpus by distinct repository (here: the
document's text, so that copies count once) and distinct owner (here: the
``source``).  A value held by at least ``example_owners`` owners, or by more
than one owner and at least ``example_repos`` repositories, is a widely copied
``example``; every other value is ``live``: it belongs to its owner.  A single
owner's value is never an example, however often it occurs.  Base spans stay whatever the verdict; the operator
adds the kinds ``bearer``, ``pem`` and ``jwt``.  A ``pem`` is the whole block of
a private key, and its secret part the body.

The texts are scanned once; candidates' places and hashes are written.  Only
hashes, ids and owners are shuffled, and each is combined on the map side
to one row a task; the join back to the documents that hold candidates is an
ordinary equi-join, which adaptive execution splits where one value is hot.

Null and empty texts have no candidates.  A null owner counts as one owner of
its own.  Repeated rows count as one repository.  Other columns are ignored by
``scan`` and passed through by ``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import SPANS, attach, bounded, cut, find_spans, keyed, let, sha256, text_of, written

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_HEAD = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
#: Runs too short for the rule are left out here; a longer run is one match either way.
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
BEARER = r"(?i:bearer)\x20+[A-Za-z0-9._~+/-]{20,}+"
PEM_HEAD, PEM_END = r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----", r"-----END [A-Z0-9 ]{0,40}PRIVATE KEY-----"
#: White space in a key's block, also as it is escaped in strings.
PEM_GAP = r"(?:\s|\\[nrt])"
#: A block through its END line; without one, the header fields and base64 lines that follow, the last of which may be short.
PEM = rf"{PEM_HEAD}(?:[^-]*+(?:-(?!----)[^-]*+)*+{PEM_END}|(?:{PEM_GAP}*+(?:Proc-Type|DEK-Info):[^\r\n\\]*+)*+(?:{PEM_GAP}*+[A-Za-z0-9+/]{{16,}}+={{0,2}}+)*+(?:(?<=[A-Za-z0-9+/]{{16}})(?:[\r\n]|\\[nr])++[A-Za-z0-9+/]++={{0,2}}+(?=\s*+$|[\r\n]|\\[nr]))?)"
JWT = r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"
KINDS = {
    "assign": (ASSIGN, lambda t: t.rlike("(?i)passw|secret|token|api_?key"), 6),
    "access": (ACCESS, lambda t: t.contains("AKIA"), 20),
    "hex": (HEX, lambda t: t.rlike("[0-9a-f]{24}"), 24),
    "bearer": (BEARER, lambda t: t.rlike("(?i)bearer"), 20),
    "pem": (PEM, lambda t: t.contains("PRIVATE KEY"), 1),
    "jwt": (JWT, lambda t: t.contains("eyJ"), 30),
}
BASE = ("assign", "access", "hex")
EXAMPLE_OWNERS, EXAMPLE_REPOS = 3, 20
MASK = "[SECRET]"


def value(kind: str, v: Column) -> Column:
    if kind == "assign":
        return F.regexp_replace(v, ASSIGN_HEAD, "")
    if kind == "pem":
        # A header without a key has no other part.
        return let(F.regexp_replace(v, f"{PEM_HEAD}|{PEM_END}|{PEM_GAP}", ""), lambda body: F.when(body == "", v).otherwise(body))
    return F.regexp_replace(v, r"^(?i:bearer)\x20+", "") if kind == "bearer" else v


def candidates_of(text: Column, rank: int, kind: str) -> Column:
    pattern, gate, least = KINDS[kind]
    found = F.filter(F.when(gate(text), find_spans(text, pattern)).otherwise(F.array().cast(SPANS)), lambda x: F.length(value(kind, x["v"])) >= least)
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(rank).alias("rank"), x["e"].alias("e"), F.lit(kind).alias("kind"), F.xxhash64(value(kind, x["v"]), F.lit(kind)).alias("h")))


def candidates(text: Column) -> Column:
    """array of (s, rank, e, kind, h): every candidate, by start, then kind as listed; h is the hash of its secret part."""
    return F.sort_array(F.concat(*(candidates_of(text, rank, kind) for rank, kind in enumerate(KINDS))))


def proposed(docs: DataFrame, owner: str = "source") -> DataFrame:
    """doc_id, th, owner, found of every row: the texts are read once, and only hashes and places are written."""
    return written(keyed(docs.select("doc_id", "text", F.col(owner).alias("owner")), "owner").select("doc_id", "th", "owner", candidates(F.col("text")).alias("found")))


def ownership(rows: DataFrame) -> DataFrame:
    """h, owners, repos: for each candidate value of the proposed rows, its distinct owners and distinct texts over the whole corpus."""
    each = rows.select("owner", "th", F.explode(F.transform("found", lambda x: x["h"])).alias("h"))
    # A null owner counts, in a struct.
    return each.groupBy("h").agg(F.count_distinct(F.struct("owner")).alias("owners"), F.count_distinct("th").alias("repos"))


def verdicts(docs: DataFrame, owner: str = "source", example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> tuple[DataFrame, DataFrame]:
    """(rows with their candidates, live hashes of each row that has any).  Both hold doc_id and th."""
    rows = proposed(docs, owner)
    held = rows.where(F.size("found") > 0).select("doc_id", "th", F.explode(F.array_distinct(F.transform("found", lambda x: x["h"]))).alias("h"))
    # Cut, so that the join's two sides are plain exchanges and a value that very many documents hold is split among tasks.
    live = cut(ownership(rows).where((F.col("owners") < example_owners) & ((F.col("owners") < 2) | (F.col("repos") < example_repos))).select("h"))
    marked = held.join(live, "h", "left_semi").groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("h")).alias("live"))
    return rows.select("doc_id", "th", "found"), marked


def scan(docs: DataFrame, owner: str = "source", example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """doc_id and found: array of (s, e, kind, live) for every row."""
    rows, marked = verdicts(docs, owner, example_owners, example_repos)
    both = attach(rows, marked).select("doc_id", "found", F.coalesce("live", F.array().cast("array<bigint>")).alias("live"))
    return both.select("doc_id", F.transform("found", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"), F.array_contains(F.col("live"), x["h"]).alias("live"))).alias("found"))


def of_kind(found: Column, kind: str) -> Column:
    return F.filter(found, lambda x: x["kind"] == kind)


def masked(text: Column, kind: str, live: Column) -> Column:
    """The text with every match of a kind whose secret part is live replaced."""
    pattern, gate, least = KINDS[kind]

    def of(t: Column) -> Column:
        gaps = F.split(t, pattern, -1)
        hit = lambda v: (F.length(value(kind, v)) >= least) & F.array_contains(live, F.xxhash64(value(kind, v), F.lit(kind)))
        made = lambda m: let(gaps, lambda g: F.concat(F.element_at(g, 1), F.array_join(F.zip_with(m, F.slice(g, 2, F.size(m)), lambda v, x: F.concat(F.when(hit(v), MASK).otherwise(v), x)), "")))
        return F.when(gate(t), let(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), made)).otherwise(t)

    return let(text, of)


def redact(docs: DataFrame, owner: str = "source", example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """Every row, live-looking secrets masked in its text and n_chars, if there, counted anew; examples stay."""
    cols = docs.columns
    row = docs.select(F.struct(*(docs[c] for c in cols)).alias("_row"), docs["doc_id"].alias("doc_id"), F.xxhash64(text_of(docs["text"])).alias("th"))
    _, marked = verdicts(docs, owner, example_owners, example_repos)
    # Cut once: its rows are counted, and few enough are sent to the texts instead of the texts to them.
    both = attach(row, bounded(cut(marked), "live")).select("_row", F.col("live").alias("_live"))
    clean = text_of(F.col("_row.text"))
    # Whole key blocks first: a match of another kind inside one would change its body.
    for kind in sorted(KINDS, key=lambda k: k != "pem"):
        clean = masked(clean, kind, F.col("_live"))
    new = both.select("_row", F.when(F.col("_live").isNotNull(), clean).otherwise(F.col("_row.text")).alias("_text"), F.col("_live").isNotNull().alias("_hit"))
    fields = {"text": F.col("_text"), "n_chars": F.when(F.col("_hit"), F.length("_text").cast(dict(docs.dtypes).get("n_chars", "bigint"))).otherwise(F.col("_row.n_chars")) if "n_chars" in cols else None}
    return new.select(*(fields.get(c, F.col("_row").getField(c)).alias(c) for c in cols))


def report(docs: DataFrame) -> DataFrame:
    """The digest of scan(): counts of the base kinds, their hash, all spans, and live and example candidates."""
    found = scan(docs)
    base = F.filter("found", lambda x: x["kind"].isin(*BASE))
    name = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")
    return found.select(
        "doc_id",
        *(F.size(of_kind(F.col("found"), k)).cast("long").alias(f"n_{k}") for k in BASE),
        sha256(name(base)).alias("base_sha256"),
        name(F.col("found")).alias("spans"),
        F.size(F.filter("found", lambda x: x["live"])).cast("long").alias("n_live"),
        F.size(F.filter("found", lambda x: ~x["live"])).cast("long").alias("n_example"),
    )
