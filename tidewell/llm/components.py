"""Connected components of an edge table, by alternating large-star and small-star.

Each round is two aggregations and joins on node ids; no neighbour list is
ever gathered in one place.  The rounds grow with the logarithm of the number
of nodes.  Lineage is cut after each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import attach, cut, text_of

MAX_ROUNDS = 100


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def connect(edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges (a, b), of any type that has an order; root is the smallest node of its component."""
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = _mark(edges)
    for _ in range(MAX_ROUNDS):
        if not seen[0]:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(down, F.col("a") == F.col("u")).select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        edges = cut(small)
        now = _mark(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = edges.groupBy("a").agg(F.min("b").alias("b"))
    return roots.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def named(rows: DataFrame, least: DataFrame, links: DataFrame) -> DataFrame:
    """rows (with a node each) with component_id and root; least: each node's smallest doc_id; links: pairs (a, b) of nodes.

    A node is named by its smallest id and then by itself, so a component's
    smallest name holds the smallest id of all, and no table is ever dealt by
    component.
    """
    name = least.select("node", F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("id"), F.col("node").alias("own")).alias("name"))
    side = lambda c: name.select(F.col("node").alias(c), F.col("name").alias(f"{c}_name"))
    edges = links.join(side("a"), "a").join(side("b"), "b").select(F.col("a_name").alias("a"), F.col("b_name").alias("b"))
    roots = connect(edges).select(F.col("node.own").alias("node"), "root")
    # Cut, so that the last join's sides are plain exchanges and a node that very many rows share is split among tasks.
    both = cut(name.join(roots, "node", "left").select("node", F.coalesce("root", "name").alias("root")))
    return rows.join(both, "node").select(*(c for c in rows.columns if c != "node"), F.col("root.id").alias("component_id"), F.col("root.own").alias("root"))


def keep_one(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs that stand for their components; found: doc_id, th, root.  Ids may be null or repeated, roots tell components apart."""
    cols = docs.columns
    least = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("x")).select("x.doc_id", "x.th")
    stay = attach(least, found.groupBy("doc_id", "th").agg(F.count("*").alias("n")))
    row = docs.select(F.struct(*(docs[c] for c in cols)).alias("_row"), docs["doc_id"].alias("doc_id"), F.xxhash64(text_of(docs["text"])).alias("th"))
    kept = attach(row, stay).where(F.col("n").isNotNull())
    repeated = kept.where("n > 1").groupBy("doc_id", "th").agg(F.min("_row").alias("_row")).select("_row")
    return kept.where("n = 1").select("_row").unionByName(repeated).select("_row.*")
