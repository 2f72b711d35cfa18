"""One query for each operator, over whole tables, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import ship
from . import bpe, chat_format, html_extract, language_id, license_scan, ngram_join, quality_crf, quality_rules, source_mix, vector_search


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; its session gets Arrow batches of 8 MB where they have their default size, for rows here are long texts."""
    ship(spark)
    if spark.conf.get(ARROW_BYTES).rstrip("b") == str(64 << 20):
        spark.conf.set(ARROW_BYTES, "8m")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return bpe.round_trip_documents(docs, keep=["doc_id"]).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    first = F.round(F.get("positions", F.lit(0)), 9)
    rows = source_mix.plan(docs).select("doc_id", "size", "source_size", "target", "taken", F.size("positions").cast("long").alias("n_passes"), first.alias("first_position"))
    return source_mix.in_order(rows, F.col("first_position"), [F.col("doc_id"), F.col("size")])


def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pass of the plan with its document, in training order: op2_source_mix has the columns of its SQL, and so the first pass alone."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return source_mix.passes(source_mix.plan(docs), docs.columns)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = lambda c: F.crc32(F.col(c).cast("string")) % 4
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(*language_id.training_rows(docs.select("doc_id", "text", "lang"), allowed=remainder("id") != 2))
    held = F.coalesce(remainder("doc_id") == 2, F.lit(False))
    return language_id.identify(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "n_bytes_agreeing")


def op5_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    allowed = F.crc32(F.col("id").cast("string")) % 3 != 1
    model = quality_crf.fit(quality_crf.training_sample(docs, table(spark, sf_dir, "labels"), allowed=allowed))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return quality_crf.score_documents(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted", "n_lines", "n_bad_lines")


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages).select("page_id", "url", "text", "n_chars", "n_blocks", "n_kept")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.apply_rules(docs).drop("text")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


#: The conversation that op9 adds.
ODD_TEXT = "\\### Assistant: </turn> ok"


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ODD_TEXT).alias("text"))
    done = chat_format.format_records(chat_format.records_of_rows(rows.unionByName(odd)))
    back = done.select("conv_id", "formatted", chat_format.read_back(F.col("formatted"), F.col("loss_spans")).alias("b"))
    return back.select("conv_id", F.col("b.n_turns").alias("n_turns"), F.sha2("b.turns_text", 256).alias("turns_sha256"), F.length("b.loss_text").cast("long").alias("loss_chars"), F.sha2("b.loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op10_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = F.transform("embedding", lambda x: F.when(F.abs(x.cast("double")) < 2.0**46, F.floor(x.cast("double") * 64).cast("double")).otherwise(x.cast("double") * 64))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", scaled.alias("embedding"))
    return vector_search.top_k(vectors, F.col("id") % 20 == 0, integer=True)


VECTOR_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::double*64)) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x)))=0),
 scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::bigint AS score FROM v q JOIN v c ON q.vec_id%20=0 AND q.vec_id<>c.vec_id)
SELECT query_id, rank::int AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank<=20"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op2_source_mix": source_mix.sql(), "op3_ngram_join": ngram_join.sql(), "op8_license_scan": license_scan.sql(), "op9_chat_format": chat_format.sql(ODD_TEXT), "op10_vector_search": VECTOR_SQL}
