"""Writers: layer images, chunk tables and mesh files."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import codecs

ENCODERS = {"png": codecs.png_encode, "tif": codecs.tiff_encode}


def layer_images(pixels: DataFrame, width: int, height: int, kind: str = "png") -> DataFrame:
    """(name, image) from (w, px, py, v): a file `WW.kind` for each layer; pixels outside are clipped, missing ones 0.

    A layer is one image, so its pixels meet in one group; layers are encoded in parallel.
    """
    if kind not in ENCODERS:
        raise ValueError(f"{kind} images can't be written; known are {', '.join(ENCODERS)}")

    def draw(layer: pa.Table) -> pa.Table:
        image = np.zeros((height, width), np.uint8)
        image[np.asarray(layer["py"]), np.asarray(layer["px"])] = np.asarray(layer["v"])
        return pa.table({"name": [f"{layer['w'][0].as_py():02d}.{kind}"], "image": pa.array([ENCODERS[kind](image)], pa.binary())})

    inside = pixels.where(f"px >= 0 and px < {width} and py >= 0 and py < {height}")
    return inside.select("w", "px", "py", "v").groupBy("w").applyInArrow(draw, "name string, image binary")


def layer_strips(pixels: DataFrame, width: int, height: int, rows: int = 256) -> DataFrame:
    """(w, strip, data): each layer as strips of `rows` lines of bytes; pixels outside are clipped, missing ones 0.

    A strip is a group of its own, so a task holds `rows` lines of a layer, however large it is.
    """

    def draw(part: pa.Table) -> pa.Table:
        w, strip = part["w"][0].as_py(), part["strip"][0].as_py()
        image = np.zeros((min(rows, height - strip * rows), width), np.uint8)
        image[np.asarray(part["py"]) - strip * rows, np.asarray(part["px"])] = np.asarray(part["v"])
        return pa.table({"w": pa.array([w], pa.int64()), "strip": pa.array([strip], pa.int64()), "data": pa.array([image.tobytes()], pa.binary())})

    inside = pixels.where(f"px >= 0 and px < {width} and py >= 0 and py < {height}")
    named = inside.select(F.col("w").cast("long").alias("w"), F.floor(F.col("py") / rows).alias("strip"), "px", "py", "v")
    return named.groupBy("w", "strip").applyInArrow(draw, "w bigint, strip bigint, data binary")


def write_layers(pixels: DataFrame, width: int, height: int, folder: str, kind: str = "png", rows: int = 256, layers: int = 32) -> None:
    """A file `WW.kind` for each layer of pixels (w, px, py, v), written strip by strip.

    Strips meet in the order of their layer; a writer holds one of them at a time and fills absent ones with zeros.
    """
    if kind not in codecs.STREAMS:
        raise ValueError(f"{kind} images can't be written; known are {', '.join(codecs.STREAMS)}")

    def put(strips) -> None:
        import itertools
        import uuid

        store, top = _store(folder)
        for w, parts in itertools.groupby(strips, key=lambda r: r.w):
            name = f"{w:02d}.{kind}"
            part = f"{top}/.{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(part) as f:
                stream = codecs.STREAMS[kind](f.write, width, height)
                at = 0
                for r in parts:
                    for k in range(at, r.strip):
                        stream.add(np.zeros((min(rows, height - k * rows), width), np.uint8))
                    stream.add(np.frombuffer(r.data, np.uint8).reshape(-1, width))
                    at = r.strip + 1
                for k in range(at, -(-height // rows)):
                    stream.add(np.zeros((min(rows, height - k * rows), width), np.uint8))
                stream.end()
            store.move(part, f"{top}/{name}")

    strips = layer_strips(pixels, width, height, rows)
    strips.repartition(layers, "w").sortWithinPartitions("w", "strip").foreachPartition(put)


def _store(folder: str):
    """The file system of a folder, and the folder in it, made if it is not there."""
    from pyarrow import fs

    store, top = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
    store.create_dir(top, recursive=True)
    return store, top


def write_files(images: DataFrame, folder: str) -> None:
    """Each image under its name, written beside it first and then moved."""

    def put(rows) -> None:
        import uuid

        store, top = _store(folder)
        for r in rows:
            part = f"{top}/.{r.name}.{uuid.uuid4().hex}"
            with store.open_output_stream(part) as f:
                f.write(bytes(r.image))
            store.move(part, f"{top}/{r.name}")

    images.foreachPartition(put)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """A chunk table partitioned by level and by its place in z, so that readers skip what a view doesn't show."""
    chunks.withColumn("slab", F.floor(F.col("cz") / 16)).repartition("level", "slab").write.mode("overwrite").partitionBy("level", "slab").parquet(path)
