"""From raw documents to a weighted training mixture, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on
all rows that its predecessor kept.

1. quality_rules: documents that the rules reject go.
2. near_duplicates: one document of each group of near copies stays (SimHash candidates, five-word shingles, similarity 0.8 or more).
3. decontamination: contaminated documents go, words that the others share with a benchmark item are cut out.
4. secrets: live-looking secrets are masked, widely copied examples stay.
5. mixing: every document gets the rate and the copies that meet the target weights.

Null and empty texts have no words and go in the first stage.  Rows with null or
repeated ids are told apart by their texts; repeated rows are copies, of which
one stays.  Further columns go along, whatever their names, but for ``rate`` and
``copies``, which the last stage sets; ``n_chars``, if there, is counted anew
where a text is changed.  Empty tables give empty tables.  The tables written
between the stages go when the driver ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import decontam, mixing, quality_rules, secret_scan, simhash_similar
from tidewell.llm.common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_similar.dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, table(spark, sf_dir, "labels"))


STAGES = [("quality_rules", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("mixing", mix)]
#: The stages' hashes and fits have no SQL form; the tests hold run() against plain versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
