"""The catalogue of scrolls and segments, and the registry of volumes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: The catalogue's records.
SEGMENT_DDL = (
    "id STRING, scroll STRUCT<id:STRING,num:STRING,oldId:STRING,isFragment:BOOLEAN>, width BIGINT, height BIGINT, minZ BIGINT, maxZ BIGINT,"
    " volume STRUCT<volume:STRING,baseUrl:STRING,maxX:BIGINT,maxY:BIGINT,maxZ:BIGINT,voxelSizenM:BIGINT,energykeV:BIGINT>,"
    " urls STRUCT<baseUrl:STRING,maskUrl:STRING,metaUrl:STRING,objUrl:STRING,compositeUrl:STRING,ppmUrl:STRING,authorUrl:STRING>,"
    " areaCm2 DOUBLE, author STRING, layers ARRAY<STRING>, labels ARRAY<STRING>"
)
REGISTRY_DDL = "id STRING, label STRING, format STRING, location_kind STRING, location STRING"


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of segment records; a file ending in .zst is a Zstandard buffer."""
    if path.endswith(".zst"):
        from ..sources.codecs import zstd_decode

        def unpack(col: pa.Array) -> pa.Array:
            return pa.array([zstd_decode(b).decode() for b in col.to_pylist()], pa.string())

        text = spark.read.format("binaryFile").load(path).select(arrow_udf(unpack, "string")(F.col("content")).alias("value"))
        return text.select(F.explode(F.from_json("value", f"array<struct<{SEGMENT_DDL}>>")).alias("s")).select("s.*")
    return spark.read.schema(SEGMENT_DDL).option("multiLine", True).json(path)


def flat(records: DataFrame) -> DataFrame:
    """Catalogue records as (segment_id, scroll_id, num, is_fragment, width, height, area, obj_url, volume_id, base_url); without a volume a segment can't be opened."""
    return records.select(F.col("id").alias("segment_id"), F.col("scroll.id").alias("scroll_id"), F.col("scroll.num").alias("num"), F.col("scroll.isFragment").alias("is_fragment"), "width", "height", F.col("areaCm2").alias("area"), F.col("urls.objUrl").alias("obj_url"), F.col("volume.volume").alias("volume_id"), F.col("volume.baseUrl").alias("base_url"))


def openable(segments: DataFrame) -> DataFrame:
    return segments.where("volume_id is not null")


def by_scroll(segments: DataFrame) -> DataFrame:
    """(scroll_id, is_fragment, num, segments): each scroll's segment ids in order, as one row."""
    return segments.groupBy("scroll_id", "is_fragment", "num").agg(F.sort_array(F.collect_list("segment_id")).alias("segments"))


def scrolls(segments: DataFrame) -> DataFrame:
    """(rank, scroll_id, is_fragment, num): scrolls before fragments, by their number as text."""
    known = segments.select("scroll_id", "is_fragment", "num").distinct()
    return known.withColumn("rank", F.row_number().over(Window.orderBy("is_fragment", "num", "scroll_id")))


def cached(segments: DataFrame, files: DataFrame) -> DataFrame:
    """Segments whose mesh is among `files` (segment_id)."""
    return segments.join(files, "segment_id", "left_semi")


def registry(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, REGISTRY_DDL)


def lookup(ids: DataFrame, volumes: DataFrame, key: str = "volume_id") -> DataFrame:
    """`ids` with their volume's columns, null if it is not registered."""
    return ids.join(volumes.withColumnRenamed("id", key), key, "left")


def listing(volumes: DataFrame) -> DataFrame:
    return volumes.select(F.concat_ws(" -> ", "id", "label").alias("line"))


def sniffed(files: DataFrame, volume: str, name: str, content: str) -> DataFrame:
    """(volume, format) by the files of each volume, in order: OME-Zarr, Zarr, cells, layers; null if none fits."""
    has = lambda c: F.bool_or(F.coalesce(c, F.lit(False)))
    n, text = F.col(name), F.col(content)
    marks = files.groupBy(volume).agg(
        has((n == ".zattrs") & text.contains("multiscales")).alias("ome"),
        has((n == ".zarray") & (text.contains("zarr_format") | text.contains("chunks"))).alias("zarr"),
        has(n.startswith("cell_yxz_") & n.endswith(".tif")).alias("cells"),
        has(n.rlike(r"^\d{5}\.tif$")).alias("layers"),
    )
    pick: Column | None = None
    for mark in ("ome", "zarr", "cells", "layers"):
        pick = F.when(F.col(mark), mark) if pick is None else pick.when(F.col(mark), mark)
    return marks.select(volume, pick.alias("format"))


def oldest_share(accesses: DataFrame, key: str, when: str, parts: int = 5) -> DataFrame:
    """(key, last): the least recently used 1/`parts` of the keys.

    Only each key's last access is ranked; the border is a quantile over these, not a sort in one task.
    """
    last = accesses.groupBy(key).agg(F.max(when).alias("last"))
    border = last.agg(F.expr(f"percentile_disc({1 / parts}) within group (order by last)").alias("border")).first().border
    return last.where(F.col("last") <= F.lit(border)).select(key, "last")
