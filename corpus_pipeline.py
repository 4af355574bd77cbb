"""From raw documents to packed training sequences: the stages of a corpus run, each on all that the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonewise.llm import decontaminate, packing, quality, simhash, suffixes
from zonewise.operators.workset import Scratch, settle

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


# Rows in one batch to a Python worker: texts may be long, and two workers share an executor's memory with the JVM.
BATCH_ROWS = 2000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of at least 0.5)."""
    _small_batches(spark)
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    return quality.score(docs.select(*COLUMNS), model).filter(F.col("_score") >= 0.5).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of every group linked by SimHash; rows without a doc_id stay.

    Of texts of one group that share its smallest doc_id one stays, the one of smallest hash.
    """
    _small_batches(spark)
    with Scratch(spark) as scratch:
        found = scratch.settle(simhash.near_duplicates(docs, scratch, root=True))
        gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
        again = docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("_again"))
        again = scratch.keep(again)
        if again.isEmpty():
            return docs.select(*COLUMNS).join(scratch.keep(gone), F.col("doc_id") == F.col("_gone"), "left_anti")
        # a repeated doc_id does not tell its texts apart: there the decision is by doc_id and text
        gone = scratch.keep(gone.join(again, F.col("_gone") == F.col("_again"), "left_anti"))
        repeated = docs.select(*COLUMNS).join(again, F.col("doc_id") == F.col("_again"), "left_semi")
        repeated = scratch.keep(repeated.dropDuplicates(["doc_id", "text"]).withColumn("_hash", F.coalesce(F.sha2("text", 256), F.lit(""))))
        prints = simhash.fingerprints(repeated.select(F.col("doc_id"), "text", "_hash"), keep="_hash")
        groups = found.join(again, F.col("doc_id") == F.col("_again"), "left_semi").distinct()
        least = prints.join(groups, ["doc_id", "fp"]).filter("doc_id = component_id")
        least = scratch.keep(least.groupBy(F.col("doc_id").alias("_id"), "component").agg(F.min("_hash").alias("_least")))
    stay = repeated.join(least, (F.col("doc_id") == F.col("_id")) & (F.col("_hash") == F.col("_least")), "left_semi").select(*COLUMNS)
    once = docs.select(*COLUMNS).join(again, F.col("doc_id") == F.col("_again"), "left_anti")
    return once.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti").unionByName(stay)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that start earlier; a character cut in part goes whole, an emptied document goes."""
    _small_batches(spark)
    with Scratch(spark) as scratch:
        found = scratch.keep(suffixes.repeats(docs, scratch))
    rest = suffixes.apply(docs.select(*COLUMNS), found)
    text = F.when(F.col("_spans") == 0, F.col("text")).otherwise(F.col("_kept"))
    rest = rest.withColumn("text", text).filter("_spans = 0 or length(text) > 0")
    return rest.withColumn("n_chars", F.when(F.col("_spans") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    _small_batches(spark)
    # whether a document leaks is a matter of its text alone, so rows without a doc_id or with another's are told apart
    rows = docs.select(*COLUMNS).withColumn("_hash", F.sha2("text", 256))
    leaked = decontaminate.leaks(rows.select(F.col("_hash").alias("doc_id"), "text"), _table(spark, sf_dir, "benchmark"))
    leaked = settle(leaked.select(F.col("doc_id").alias("_leaked")).distinct())
    return rows.join(leaked, F.col("_hash") == F.col("_leaked"), "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every document (or piece of a long one) in a training sequence."""
    with Scratch(spark) as scratch:
        return scratch.keep(packing.pack(docs, scratch))


STAGES = [
    ("quality_classifier", reject_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_leaked),
    ("packing", pack),
]

# None: the first stage's fitted scores, fingerprints and packing have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written as Parquet and read again by the next."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
