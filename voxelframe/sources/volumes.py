"""Readers of chunked volumes: blocked tiles, Zarr, multiscale Zarr, TIFF cells and TIFF layers.

All go through Spark's file readers, so they work on any store that Spark reads; chunk keys come from the paths, and
a range of keys becomes a path pattern, so other chunks are not even listed.  Payloads are decoded by Arrow
functions, a batch of files at a time.  The result is the chunk table: level, cx, cy, cz and data, x fastest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from . import codecs

TILE_BYTES = 64**3
Ranges = dict[str, range]


def _files(spark: SparkSession, patterns: list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(patterns)


def _part(pattern: str, k: int) -> Column:
    return F.regexp_extract("path", pattern, k).cast("int")


def _pick(keys: range | None, form: str) -> str:
    """A path pattern for a range of keys."""
    return "*" if keys is None else "{" + ",".join(form.format(k) for k in keys) + "}"


def straightened(content: Column) -> Column:
    """A tile's bytes, stored as 4-cubes, with x fastest; null if it has another size."""

    def f(col: pa.Array) -> pa.Array:
        cubes = (np.frombuffer(b, np.uint8).reshape(16, 16, 16, 4, 4, 4) if b is not None and len(b) == TILE_BYTES else None for b in col.to_pylist())
        return pa.array([None if c is None else c.transpose(0, 3, 1, 4, 2, 5).tobytes() for c in cubes], pa.binary())

    return arrow_udf(f, "binary")(content)


def read_tiles(spark: SparkSession, folder: str, ranges: Ranges | None = None, level: int | None = None) -> DataFrame:
    """Tiles of 64 voxels an edge, stored as 4-cubes and put in x, y, z order here; files of another size count as absent."""
    r = ranges or {}
    d = "d*" if level is None else f"d{1 << level:02d}"
    x, y, z = (_pick(r.get(c), "{:03d}") for c in "xyz")
    pattern = r"xyz-(\d+)-(\d+)-(\d+)-b\d+-d(\d+)\.bin$"
    files = _files(spark, [f"{folder}/64-4/{d}/z{z}/xyz-{x}-{y}-{z}-b*-d*.bin"]).where(F.col("length") == TILE_BYTES)

    down = _part(pattern, 4)
    return files.select((F.length(F.bin(down)) - 1).cast("int").alias("level"), *[_part(pattern, k + 1).alias(f"c{c}") for k, c in enumerate("xyz")], straightened(F.col("content")).alias("data"))


def metadata(spark: SparkSession, path: str, authorization: str | None = None) -> str | None:
    """The text of a small file that listings hide, from any store that Spark reads or an HTTP server; None if there is none."""
    if is_url(path):
        from .remote import get

        status, body = get(path, authorization)
        return body.decode() if status == 200 and body is not None else None
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(place):
        return None
    stream = store.open(place)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def is_url(path: str) -> bool:
    return path.startswith(("http://", "https://"))


#: What is read of an array's and a pyramid's metadata.
ARRAY_DDL = "chunks ARRAY<BIGINT>, compressor STRUCT<blocksize:BIGINT,clevel:INT,cname:STRING,id:STRING,shuffle:INT>, dtype STRING, fill_value INT, filters STRING, `order` STRING, shape ARRAY<BIGINT>, zarr_format INT, dimension_separator STRING"
LEVELS_DDL = "multiscales ARRAY<STRUCT<datasets:ARRAY<STRUCT<path:STRING>>,name:STRING,version:STRING>>"
#: Fixed value: the levels of a pyramid that are read.
MOST_LEVELS = 4


def parsed_array(text: Column) -> Column:
    """An array's definition as a struct of ARRAY_DDL."""
    return F.from_json(text, ARRAY_DDL)


def level_paths(text: Column, most: int = MOST_LEVELS) -> Column:
    """The paths of a pyramid's first levels, from its attributes."""
    sets = F.get(F.from_json(text, LEVELS_DDL).multiscales, F.lit(0)).datasets
    return F.transform(F.slice(sets, 1, most), lambda d: d.path)


def array_definition(spark: SparkSession, path: str, authorization: str | None = None) -> dict:
    """The `.zarray` of an array; raises ValueError for what is not read: other types than bytes, filters, other versions.

    The order and the fill value are not looked at: bytes are taken as x fastest, and absent chunks count as 0.
    """
    text = metadata(spark, f"{path}/.zarray", authorization)
    if text is None:
        raise ValueError(f"no array at {path}")
    d = spark.range(1).select(parsed_array(F.lit(text)).alias("d")).first().d.asDict(True)
    if d["dtype"] not in ("|u1", "<u1", "u1"):
        raise ValueError(f"type {d['dtype']} is not supported")
    if d["filters"] not in (None, "[]") or (d["zarr_format"] or 2) != 2 or len(d["chunks"] or ()) != 3:
        raise ValueError("filters, version or number of axes is not supported")
    if d["compressor"] and d["compressor"]["id"] != "blosc":
        raise ValueError(f"compressor {d['compressor']['id']} is not supported")
    return d


def edges(definition: dict) -> tuple[int, int, int]:
    """Chunk edges along x, y and z; they may differ."""
    z, y, x = definition["chunks"]
    return x, y, z


def pyramid_paths(spark: SparkSession, path: str, most: int = MOST_LEVELS, authorization: str | None = None) -> list[str]:
    """The places of a multiscale Zarr's first levels."""
    attrs = metadata(spark, f"{path}/.zattrs", authorization)
    found = spark.range(1).select(level_paths(F.lit(attrs or "{}"), most).alias("p")).first().p
    if not found:
        raise ValueError(f"no levels at {path}")
    return [f"{path}/{p}" for p in found]


def decode_chunks(content: Column, compressed: bool) -> Column:
    if not compressed:
        return content

    def f(col: pa.Array) -> pa.Array:
        return pa.array([codecs.blosc_decode(b) for b in col.to_pylist()], pa.binary())

    return arrow_udf(f, "binary")(content)


def read_zarr(spark: SparkSession, path: str, ranges: Ranges | None = None, level: int = 0) -> DataFrame:
    """A Zarr 2 array of bytes with the axes z, y, x."""
    d = array_definition(spark, path)
    sep = d["dimension_separator"] or "."
    r = ranges or {}
    keys = sep.join(_pick(r.get(c), "{}") for c in "zyx")
    pattern = rf"(\d+){'/' if sep == '/' else chr(92) + sep}(\d+){'/' if sep == '/' else chr(92) + sep}(\d+)$"
    files = _files(spark, [f"{path}/{keys}"]).where(F.col("path").rlike(pattern))
    return files.select(F.lit(level).alias("level"), _part(pattern, 3).alias("cx"), _part(pattern, 2).alias("cy"), _part(pattern, 1).alias("cz"), decode_chunks(F.col("content"), bool(d["compressor"])).alias("data"))


def read_ome(spark: SparkSession, path: str, most: int = MOST_LEVELS, ranges: Ranges | None = None) -> DataFrame:
    """The first levels of a multiscale Zarr as one chunk table; level s has voxels 2**s times as wide."""
    out = None
    for level, place in enumerate(pyramid_paths(spark, path, most)):
        chunks = read_zarr(spark, place, ranges, level)
        out = chunks if out is None else out.unionByName(chunks)
    return out


def _tiff(content: Column, width: int | None = None) -> Column:
    """struct(pages, height, width, data): the high bytes of 16-bit samples; null if the file is none that is read."""

    def f(col: pa.Array) -> pa.Array:
        out = []
        for b in col.to_pylist():
            try:
                s = codecs.tiff_samples(b, width, width)
                out.append({"pages": s.shape[0], "height": s.shape[1], "width": s.shape[2], "data": (s >> 8).astype(np.uint8).tobytes()})
            except (ValueError, KeyError):
                out.append(None)
        return pa.array(out, pa.struct([("pages", pa.int32()), ("height", pa.int32()), ("width", pa.int32()), ("data", pa.binary())]))

    return arrow_udf(f, "pages int, height int, width int, data binary")(content)


CELL = r"cell_yxz_(\d+)_(\d+)_(\d+)\.tif$"


def cell_number(name: Column, axis: str) -> Column:
    """The number, counted from 1, that a cell's file name gives for an axis; null for other names."""
    return F.regexp_extract(name, CELL, "yxz".index(axis) + 1).try_cast("int")


def cell_grid(names: DataFrame, name: str = "name") -> DataFrame:
    """(max_y, max_x, max_z, n_cells): the extent of a grid of cells by its files' names."""
    most = [F.max(cell_number(F.col(name), a)).alias(f"max_{a}") for a in "yxz"]
    return names.agg(*most, F.countDistinct(F.when(F.col(name).rlike(CELL), F.col(name))).alias("n_cells"))


def read_cells(spark: SparkSession, folder: str, edge: int = 500) -> DataFrame:
    """A grid of TIFF cells, `cell_yxz_Y_X_Z.tif` counted from 1, a page for each z."""
    files = _files(spark, [f"{folder}/cell_yxz_*.tif"]).where(F.col("path").rlike(CELL))
    cells = files.select(*[(cell_number(F.col("path"), a) - 1).alias(f"c{a}") for a in "xyz"], _tiff(F.col("content"), edge).alias("t"))
    return cells.where("t is not null").select(F.lit(0).alias("level"), "cx", "cy", "cz", F.col("t.data").alias("data"))


def read_layers(spark: SparkSession, folder: str) -> DataFrame:
    """(z, width, height, data): a stack of TIFF layers `NNNNN.tif`."""
    pattern = r"/(\d{5})\.tif$"
    files = _files(spark, [f"{folder}/[0-9][0-9][0-9][0-9][0-9].tif"])
    layers = files.select(_part(pattern, 1).alias("z"), _tiff(F.col("content")).alias("t")).where("t is not null")
    return layers.select("z", F.col("t.width").alias("width"), F.col("t.height").alias("height"), F.col("t.data").alias("data"))


LAYER_TILE = 256


def tiled_layers(layers: DataFrame, tile: int = LAYER_TILE) -> DataFrame:
    """A layer stack as a chunk table: tiles of a layer are chunks of `tile` x `tile` x 1 voxels, filled up with zeros.

    A layer is cut as it is read, so no whole layer is shuffled and no pixel becomes a row.
    """

    def f(data: pa.Array, width: pa.Array, height: pa.Array) -> pa.Array:
        out = []
        for d, w, h in zip(data.to_pylist(), width.to_pylist(), height.to_pylist(), strict=True):
            image, nx, ny = np.frombuffer(d, np.uint8).reshape(h, w), -(-w // tile), -(-h // tile)
            whole = np.zeros((ny * tile, nx * tile), np.uint8)
            whole[:h, :w] = image
            parts = whole.reshape(ny, tile, nx, tile).swapaxes(1, 2)
            out.append([{"cx": x, "cy": y, "data": parts[y, x].tobytes()} for y in range(ny) for x in range(nx)])
        return pa.array(out, pa.list_(pa.struct([("cx", pa.int32()), ("cy", pa.int32()), ("data", pa.binary())])))

    cut = arrow_udf(f, "array<struct<cx:int,cy:int,data:binary>>")(F.col("data"), F.col("width"), F.col("height"))
    return layers.select("z", F.explode(cut).alias("t")).select(F.lit(0).alias("level"), "t.cx", "t.cy", F.col("z").alias("cz"), "t.data")


def sample_layers(points: DataFrame, layers: DataFrame) -> DataFrame:
    """`points` (px, py, pz) with v of a layer stack; 0 outside."""
    from ..functions.expr import byte_at
    from ..functions.num import to_index

    at = points.withColumns({f"_{c}": to_index(F.col(f"p{c}")) for c in "xyz"})
    out = at.join(layers.withColumnRenamed("z", "_z"), "_z", "left")
    inside = (F.col("_x") < F.col("width")) & (F.col("_y") < F.col("height"))
    v = F.coalesce(F.when(inside, byte_at(F.col("data"), F.col("_y") * F.col("width") + F.col("_x"))), F.lit(0))
    return out.withColumn("v", v).drop("_x", "_y", "_z", "width", "height", "data")


def read_volume(spark: SparkSession, kind: str, location: str) -> DataFrame:
    """The chunk table of a volume of a known format."""
    readers = {"tiles": read_tiles, "zarr": read_zarr, "ome": read_ome, "cells": read_cells, "layers": read_layers}
    if kind not in readers:
        raise ValueError(f"format {kind} is not known")
    return readers[kind](spark, location)


def sniff(spark: SparkSession, location: str) -> str:
    """The format of the volume at a location, by its files."""
    from ..operators.catalog import sniffed

    known = [(f, text) for f in (".zattrs", ".zarray") if (text := metadata(spark, f"{location}/{f}")) is not None]
    if known:
        rows = spark.createDataFrame(known, "name string, content string")
    else:
        rows = spark.read.format("binaryFile").load(location).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.lit(None).cast("string").alias("content"))
    row = sniffed(rows.withColumn("volume", F.lit(0)), "volume", "name", "content").first()
    if row is None or row.format is None:
        raise ValueError(f"no volume at {location}")
    return row.format
