"""Readers of meshes and surfaces: OBJ files, affine transforms and per-pixel maps."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import codecs


def read_obj(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """`vert` (i,x,y,z), `tex` (i,u,v), `norm` (i,nx,ny,nz) and `face` (f, v1..3, t1..3, n1..3), all counted from 0.

    Lines are numbered in file order without sorting the file in one task: a count for each split of the file, added
    up, and row numbers inside the split.  Only the first object is read; faces must be triangles.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("at"), F.trim("value").alias("value"))
    lines = lines.withColumn("kind", F.regexp_extract("value", r"^(v|vt|vn|f|o)\s", 1)).where("kind <> ''")
    counts = lines.groupBy("kind", "part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("kind", "part", "before")
    inside = F.row_number().over(Window.partitionBy("kind", "part").orderBy("at")) - 1
    rows = lines.withColumn("k", inside).join(F.broadcast(before), ["kind", "part"]).withColumn("i", F.col("k") + F.col("before"))
    rows = rows.withColumn("w", F.split("value", r"\s+"))
    second = rows.where("kind = 'o' and i = 1").select("part", "at").first()
    if second:
        rows = rows.where((F.col("part") < second["part"]) | ((F.col("part") == second["part"]) & (F.col("at") < second["at"])))
    number = lambda k: F.get(F.col("w"), F.lit(k)).cast("double")
    table = lambda kind, names: rows.where(F.col("kind") == kind).select("i", *[number(k + 1).alias(n) for k, n in enumerate(names)])
    triangle = F.when(F.size("w") == 4, True).otherwise(F.raise_error(F.concat(F.lit("not a triangle: "), F.col("value"))).cast("boolean"))
    corner = lambda k, part: (F.nullif(F.get(F.split(F.get(F.col("w"), F.lit(k)), "/"), F.lit(part)), F.lit("")).cast("bigint") - 1).alias(f"{'vtn'[part]}{k}")
    faces = rows.where(F.col("kind") == "f").where(triangle)
    return {"vert": table("v", ("x", "y", "z")), "tex": table("vt", ("u", "v")), "norm": table("vn", ("nx", "ny", "nz")), "face": faces.select(F.col("i").alias("f"), *[corner(k, p) for p in range(3) for k in (1, 2, 3)])}


def wide_obj(obj: dict[str, DataFrame]) -> DataFrame:
    """A row for each triangle with its corners' positions, texture coordinates and normals."""
    out = obj["face"]
    for name, key, cols in (("vert", "v", ("x", "y", "z")), ("tex", "t", ("u", "v")), ("norm", "n", ("nx", "ny", "nz"))):
        for k in (1, 2, 3):
            side = obj[name].select(F.col("i").alias(f"{key}{k}"), *[F.col(c).alias(f"{'t' if key == 't' else ''}{c}{k}") for c in cols])
            out = out.join(side, f"{key}{k}")
    return out.drop(*[f"{key}{k}" for key in "vtn" for k in (1, 2, 3)])


def read_affine(spark: SparkSession, text_or_path: str) -> tuple:
    """A 3 x 4 matrix from a JSON array, or from a file with `transformation_matrix`."""
    text = text_or_path.strip()
    if not text.startswith("["):
        text = spark.read.text(text, wholetext=True).first().value
    m = json.loads(text)
    m = m["transformation_matrix"] if isinstance(m, dict) else m
    if len(m) < 3 or any(len(r) != 4 for r in m[:3]):
        raise ValueError("not a 3 x 4 matrix")
    return tuple(tuple(map(float, r)) for r in m[:3])


class MapRows(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


def _open(path: str):
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return store.open_input_file(inner)


class PixelMapReader(DataSourceReader):
    """Reads rows of a map in parallel: each partition seeks to its own rows, so size is no limit."""

    def __init__(self, path: str, rows: int) -> None:
        self.path, self.rows = path, rows
        with _open(path) as f:
            head, self.start = codecs.map_header(f.read(1 << 16))
        self.width, self.height = int(head["width"]), int(head["height"])

    def partitions(self) -> list[InputPartition]:
        return [MapRows(r, min(self.height, r + self.rows)) for r in range(0, self.height, self.rows)]

    def read(self, partition: MapRows):  # type: ignore[override]
        with _open(self.path) as f:
            f.seek(self.start + partition.first * self.width * 48)
            data = f.read((partition.last - partition.first) * self.width * 48)
        values = np.frombuffer(data, "<f8").reshape(-1, 6)
        n = np.arange(len(values))
        cols = [n % self.width, n // self.width + partition.first, *values.T]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["u", "v", "x", "y", "z", "nx", "ny", "nz"])


class PixelMap(DataSource):
    """`spark.read.format("pixelmap").load(path)`: (u, v, x, y, z, nx, ny, nz); option rows: map rows a partition."""

    @classmethod
    def name(cls) -> str:
        return "pixelmap"

    def schema(self) -> str:
        return "u bigint, v bigint, x double, y double, z double, nx double, ny double, nz double"

    def reader(self, schema) -> DataSourceReader:
        return PixelMapReader(self.options["path"], int(self.options.get("rows", "512")))


def read_pixel_map(spark: SparkSession, path: str, rows: int = 512) -> DataFrame:
    spark.dataSource.register(PixelMap)
    return spark.read.format("pixelmap").option("rows", rows).load(path)
