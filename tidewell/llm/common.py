"""Expressions shared by the text operators.

Rows are identified by ``(doc_id, th)``, ``th`` being a 64-bit hash of the
text.  Repeated rows share that key and so share every result, and each input
row still gives one output row.  Null texts count as empty.
"""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rules: space, tab, line feed, vertical tab, form feed, return.
NOT_SPACE = r"[^\x20\x09-\x0D]+"
#: Letters and digits of ASCII after lower-casing, and all other code points.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPANS = "array<struct<s:int,e:int,v:string,l:string,r:string>>"
#: Code points kept from the sides of a match; elements that are appended to at a time.
NEAR, PIECE = 40, 256
#: Rows and array elements of a table that may be broadcast (some 16 MB).
MAX_LISTED = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once and not once for each use in a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_of(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def split_words(text: Column, lower: bool, ascii_only_separators: bool) -> Column:
    """The words of a text, by one character translation and a split at single blanks.

    ascii_only_separators: words are WORD after ASCII lower-casing; else they are NOT_SPACE.
    """
    breaks = "".join(chr(c) for c in ([c for c in range(128) if not chr(c).isalnum()] if ascii_only_separators else range(9, 14)) if c != 32)
    plain = F.translate(text, (UPPER if lower else "") + breaks, (LOWER if lower else "") + " " * len(breaks))
    return F.array_remove(F.split(plain, " ", -1), "")


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (never null), th and the columns named in more; other columns are left out, whatever their names."""
    return docs.select(F.col("doc_id"), text_of().alias("text"), F.xxhash64(text_of()).alias("th"), *(F.col(c) for c in more))


def attach(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with the other columns of found, null where found has no row of the same key; doc_id may be null."""
    right = found.withColumnsRenamed({"doc_id": "_doc_id", "th": "_th"})
    return rows.join(right, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("th") == F.col("_th")), "left").drop("_doc_id", "_th")


def bounded(found: DataFrame, listed: str, most: int = MAX_LISTED) -> DataFrame:
    """found, a table that is already cut, as a broadcast if its rows and the elements of the array named listed are counted and are at most most; else as it is."""
    r = found.agg(F.count("*"), F.sum(F.size(listed))).first()
    return F.broadcast(found) if r[0] + (r[1] or 0) <= most else found


def indices(count: Column, start: int = 0) -> Column:
    """start .. count - 1, empty if there are none."""
    return F.when(count > start, F.sequence(F.lit(start), count - 1)).otherwise(F.array().cast("array<int>"))


def running(parts: Column, item: Callable[[Column, Column], Column], kind: str) -> Column:
    """item(start, part) for each part of an array of structs with a (gap) and b (length), start being the sum of all before plus a.

    Appending to an array copies it, so the parts are taken in pieces of PIECE,
    and the pieces' own starts first: the work stays linear for long arrays.
    """

    def of(v: Column) -> Column:
        pieces = F.transform(indices(F.ceil(F.size(v) / PIECE).cast("int")), lambda c: F.slice(v, c * PIECE + 1, F.lit(PIECE)))

        def placed(chunks: Column) -> Column:
            sums = F.transform(chunks, lambda ch: F.aggregate(ch, F.lit(0), lambda t, x: t + x["a"] + x["b"]))
            starts = F.aggregate(sums, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

            def one(ch: Column, o: Column) -> Column:
                zero = F.struct(o.alias("at"), F.array().cast(kind).alias("out"))
                step = lambda acc, x: F.struct((acc["at"] + x["a"] + x["b"]).alias("at"), F.concat(acc["out"], F.array(item(acc["at"] + x["a"], x))).alias("out"))
                return F.aggregate(ch, zero, step, lambda acc: acc["out"])

            return F.flatten(F.zip_with(chunks, starts, one))

        return let(pieces, placed)

    return let(parts, of)


def find_spans(text: Column, pattern: str | Column) -> Column:
    """Leftmost non-overlapping matches of a pattern that never matches nothing, as code point spans.

    v is the match, l and r are up to NEAR code points of the text between it
    and the neighbouring matches.  The pieces between matches give the places,
    so one pass of the regular expression engine for each of the two arrays is
    all that is needed.
    """
    regex = F.lit(pattern) if isinstance(pattern, str) else pattern

    def placed(m: Column) -> Column:
        gaps = F.split(text, regex, -1)
        near = let(gaps, lambda g: F.zip_with(F.slice(g, 1, F.size(m)), F.slice(g, 2, F.size(m)), lambda x, y: F.struct(F.length(x).alias("a"), F.right(x, F.lit(NEAR)).alias("l"), F.left(y, F.lit(NEAR)).alias("r"))))
        parts = F.zip_with(m, near, lambda v, n: F.struct(n["a"].alias("a"), F.length(v).alias("b"), v.alias("v"), n["l"].alias("l"), n["r"].alias("r")))
        return running(parts, lambda s, x: F.struct(s.alias("s"), (s + x["b"]).alias("e"), x["v"].alias("v"), x["l"].alias("l"), x["r"].alias("r")), SPANS)

    return let(F.regexp_extract_all(text, regex, F.lit(0)), lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(F.array().cast(SPANS)))


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; a cluster must name one, a single machine may do without."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _own_folder()


@functools.cache
def _own_folder() -> str:
    made = tempfile.mkdtemp(prefix="tidewell-")
    atexit.register(shutil.rmtree, made, True)
    return made


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the cluster's shared checkpoint folder, its lineage cut."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def let_go(spark: SparkSession) -> None:
    """Has the driver look for what nothing refers to any more, so that the files of finished shuffles go now and not when its heap is full."""
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the cluster's shared checkpoint folder, read again.  The table goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidewell-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _forget_at_exit(spark, path)
    return spark.read.parquet(path)


def _forget_at_exit(spark: SparkSession, path: str) -> None:
    """Has Spark's file system remove the folder when the driver's JVM ends in good order."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
