"""The corpus pipeline: documents through quality, rules, deduplication, mixing and tokenising.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelframe.llm import bpe, ngram_join, quality_crf, quality_rules, source_mix
from voxelframe.llm.columns import spare_prefix
from voxelframe.llm.queries import table
from voxelframe.plans.tables import Tables


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go.  Learns from labelled rows of `docs`, but for a held-out third."""
    allowed = F.crc32(F.col("id").cast("string")) % 3 != 1
    model = quality_crf.fit(quality_crf.training_sample(docs, table(spark, sf_dir, "labels"), allowed=allowed))
    return quality_crf.keep_good(docs, model)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return ngram_join.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for, in training order."""
    prefix = spare_prefix(docs, "mixed_")
    return source_mix.training_order(source_mix.plan(docs, prefix=prefix), docs.columns, prefix=prefix)


def written_rank() -> Column:
    """For rows read from a table that was written in order: they sort by the task and the file that wrote them, and by their place in it; null if Spark did not write the files."""
    number = lambda pattern: F.regexp_extract(F.col("_metadata.file_name"), pattern, 1).try_cast("long")
    return F.shiftleft(number(r"^part-(\d+)"), 42) + F.shiftleft(number(r"-c(\d+)\."), 32) + F.col("_metadata.row_index")


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the whole texts, the digest of the text decoded from them and whether it is the text's own, and each row's place in the training order: `training_rank` sorts them."""
    own = F.sha2(F.coalesce("text", F.lit("")), 256)
    ranked = docs.withColumn("training_rank", written_rank()).withColumn("text_sha256", own)
    done = bpe.round_trip_documents(ranked, keep=["doc_id", "source", "training_rank", "text_sha256"]).withColumn("decoded_sha256", F.sha2("decoded", 256))
    return done.select("doc_id", "source", "training_rank", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_sha256", F.col("decoded_sha256").eqNullSafe(F.col("text_sha256")).alias("round_trips"))


STAGES = [("quality classifier", quality_classifier), ("quality rules", rules), ("n-gram Jaccard join", near_duplicates), ("mixing sources", mix), ("BPE encoding and decoding", tokenise)]

#: SQL can express neither the classifiers nor the encoder: the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    tables = Tables(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = tables.cut(docs)
    return docs
