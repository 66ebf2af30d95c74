"""The corpus pipeline: toxicity, exact dedup, near dedup, benchmark decontamination, mixing.

Each stage works on all rows that the one before kept.  A filtering stage returns the columns of its input
unchanged; the last one returns a row per document with the words that the mix takes.  Rows are told apart
by doc_id and a hash of the text, so null and repeated ids do no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mosaiq.llm.common import Stage, give_back_driver, table
from mosaiq.llm.decontaminate import decontaminate as find_contaminated
from mosaiq.llm.exact_dedup import exact_dedup as find_copies
from mosaiq.llm.mixing import mix_sources, taken_words
from mosaiq.llm.ngram_join import LAST, ngram_components
from mosaiq.llm.toxicity import learn_toxicity, score_toxicity


#: Rows and bytes of an Arrow batch.  The default of 10,000 whole texts is held by Spark's process and by both of an executor's workers at once.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def _small_batches(spark: SparkSession) -> None:
    """Sets BATCH for the session that runs the pipeline: a stage's plan is carried out after the stage has returned it.  Results don't depend on it.
    What the stages before have left in the driver is given back."""
    for k, v in BATCH.items():
        spark.conf.set(k, v)
    give_back_driver(spark)


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    while name in docs.columns:
        name += "_"
    return name


def _without(docs: DataFrame, losers: DataFrame) -> DataFrame:
    """docs without the rows that losers(id, key) names by doc_id and text."""
    same = docs["doc_id"].eqNullSafe(losers["id"]) & (F.xxhash64(docs["text"]) == losers["key"])
    return docs.join(losers, same, "left_anti")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are likelier toxic than not.  The model learns from the labelled texts among all documents."""
    _small_batches(spark)
    model = learn_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    score = _fresh(docs, "score")
    return score_toxicity(docs, model, score).filter(F.col(score) < 0.5).drop(score)


def _keep_one(docs: DataFrame, judged: DataFrame, stage: Stage) -> DataFrame:
    """docs without the rows of judged(id, key, kept) that don't stay; of rows alike in id and text, one at most stays."""
    rows = stage.keep(judged.groupBy("id", "key").agg(F.max("kept").alias("kept"), F.count("*").alias("n")).filter("NOT kept OR n > 1"))
    left = _without(docs, rows.filter("NOT kept"))
    twice = rows.filter("kept")
    if twice.isEmpty():
        return left
    same = left["doc_id"].eqNullSafe(twice["id"]) & (F.xxhash64(left["text"]) == twice["key"])
    return _without(left, twice).unionByName(left.join(twice, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts."""
    _small_batches(spark)
    judged = find_copies(docs.select("doc_id", "text")).select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "kept")
    return _keep_one(docs, judged, Stage(spark, "pipeline-exact"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of texts that share 0.8 or more of their five-word n-grams: the smallest id."""
    _small_batches(spark)
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError("near_dedup needs whole numbers as doc_id")
    stage = Stage(spark, "pipeline-near")
    rows = stage.keep(ngram_components(docs.select(F.col("doc_id").cast("long"), "text"), size=5, percent=80))
    rank = F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("did"), "text_key")
    stays = rows.groupBy("group").agg(F.min(rank).alias("stays"))
    judged = rows.join(stays, "group").select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), (rank == F.col("stays")).alias("kept"))
    return _keep_one(docs, judged, stage)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold 10 consecutive words of a benchmark item, or all of a shorter one."""
    _small_batches(spark)
    stage = Stage(spark, "pipeline-decontaminate")
    found = find_contaminated(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, stage.keep(found.filter("contaminated").select(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).distinct()))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document that is left."""
    _small_batches(spark)
    return taken_words(mix_sources(docs.select("doc_id", "text", "source")))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mixing", mixing)]

#: A trained model and pseudorandom draws are beyond SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents, each one's rows written as Parquet and read again."""
    stage = Stage(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES:
        docs = stage.keep(step(spark, docs, sf_dir))
    return docs
