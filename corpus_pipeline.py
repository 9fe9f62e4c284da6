"""A corpus pipeline: each stage is one operator of tarnsieve.llm, applied to what the one before kept.

Toxic documents go, one document of each near-duplicate group (five-word shingles,
Jaccard similarity 0.8 or more) stays, the one of least id, documents with benchmark passages go,
documents with secrets go, and the rest is packed into sequences.
Every stage's result is written as Parquet to the shared folder and read again.

Each stage judges rows, not ids: a row without an id, or one of several with the same id, stays or goes by its own
text, and of equal rows one stays.  A null text is an empty one (all of those are one near-duplicate group).  An
empty table gives no rows.  Columns of any other name pass through unchanged.  Very long texts are judged whole, as
each operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnsieve.llm import decontaminate, near, packing, secrets, toxicity
from tarnsieve.llm.queries import word_bpe_path
from tarnsieve.llm.shared import new_folder, scratch, table, text_batches, with_row_key, without
from tarnsieve.storage import hadoop_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def _without(docs: DataFrame, found) -> DataFrame:
    """docs without the rows whose keys found(rows, name of the key) gives in its column `row`."""
    key = "_row"
    while any(c.lower().startswith(key) for c in docs.columns):
        key += "_"
    rows = with_row_key(docs, key)
    return without(rows, found(rows, key).select(F.col("row").alias(key)), key).drop(key)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    text_batches(spark)
    return _without(docs, lambda rows, key: near.near_duplicates(rows, row_col=key).where(~F.col("stays")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = table(spark, sf_dir, "benchmark")
    return _without(docs, lambda rows, key: decontaminate.find_contamination(rows, benchmark, id_col=key).where("n_hit > 0").withColumnRenamed("doc_id", "row"))


def drop_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, lambda rows, key: secrets.find_secrets(rows, id_col=key).where(F.size("spans") > 0).withColumnRenamed("doc_id", "row"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    text_batches(spark)
    # the executors' heaps have grown in the stages before: a small word cache leaves room beside them
    return packing.pack(docs, word_bpe_path(), cache_bytes=32 << 20)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", drop_secrets),
    ("packing", pack),
]

#: No SQL: the classifier, XXH64 fingerprints and the tokenizer have none.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        folder = new_folder(spark, f"pipeline-{name}")
        with scratch(spark):  # what the stage writes besides goes when its result is written
            stage(spark, docs, sf_dir).write.parquet(folder)
        if last:
            files, at = hadoop_path(spark, last)
            files.delete(at, True)
        docs, last = spark.read.parquet(folder), folder
    return STAGES[-1][1](spark, docs, sf_dir)
