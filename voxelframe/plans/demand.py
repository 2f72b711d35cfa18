"""Which tiles a surface render has, which chunks each needs, and which of these are still missing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.num import idiv, to_index
from ..operators.mesh import Surface, _interpolated, _weights, offset
from ..operators.sample import Edges, edges_of


@dataclass(frozen=True)
class Render:
    """A batch render: surface size, layers, tiles and the volume's chunk edge."""

    width: int
    height: int
    first_layer: int = 25
    last_layer: int = 41
    middle: int = 32
    tile: int = 1024
    left: int = 0
    top: int = 0
    chunk: Edges = 64


def uv_tiles(spark: SparkSession, r: Render) -> DataFrame:
    """(u, v, w): the tiles layer by layer, then row by row."""
    span = lambda a, b, step: F.explode(F.sequence(F.lit(a), F.lit(b), F.lit(step)))
    rows = spark.range(1).select(span(r.first_layer, r.last_layer, 1).alias("w"))
    rows = rows.select("w", span(r.top, r.top + r.height - 1, r.tile).alias("v"))
    return rows.select(span(r.left, r.left + r.width - 1, r.tile).alias("u"), "v", "w")


def fragments(triangles: DataFrame, surface: Surface, r: Render) -> DataFrame:
    """(u, v, pu, pv, ...): surface pixels under every face with the tile (u, v) they are in; each face rasterised once."""
    out = surface.pixel_corners(triangles)
    for a, low, size in (("u", r.left, r.width), ("v", r.top, r.height)):
        corner = [F.col(f"p{a}{k}") for k in (1, 2, 3)]
        begin, end = F.greatest(F.least(*corner), F.lit(low)), F.least(F.greatest(*corner), F.lit(low + size - 1))
        out = out.withColumn(f"_{a}", F.explode(F.when(begin <= end, F.sequence(begin, end))))
    w = _weights(F.col("_u"), F.col("_v"))
    out = out.withColumns({f"w{k}": w[k] for k in range(3)}).where("w0 >= 0 and w1 >= 0 and w2 >= 0 and w0 + w1 + w2 > 0")
    tile = lambda c, low: (idiv(F.col(c) - low, r.tile) * r.tile + low)
    return out.select(tile("_u", r.left).alias("u"), tile("_v", r.top).alias("v"), F.col("_u").alias("pu"), F.col("_v").alias("pv"), "f", *_interpolated(("x", "y", "z", "nx", "ny", "nz")))


def chunk_demand(triangles: DataFrame, surface: Surface, r: Render) -> DataFrame:
    """(u, v, w, cx, cy, cz): the chunks that a trilinear render of each tile reads.

    A sample's cell spans at most two chunks an axis; the distinct pairs are pre-aggregated where they are made.
    """
    layers = F.explode(F.sequence(F.lit(r.first_layer), F.lit(r.last_layer)))
    at = offset(fragments(triangles, surface, r).withColumn("w", layers), (F.col("w") - r.middle).cast("double"))
    edge = dict(zip("xyz", edges_of(r.chunk), strict=True))
    both = lambda c: F.explode(F.array_distinct(F.array(idiv(to_index(F.col(f"p{c}")), edge[c]), idiv(to_index(F.col(f"p{c}")) + 1, edge[c]))))
    keys = at.select("u", "v", "w", "px", "py", "pz")
    for c in "xyz":
        keys = keys.withColumn(f"c{c}", both(c)).drop(f"p{c}")
    return keys.distinct()


def missing(demand: DataFrame, have: DataFrame) -> DataFrame:
    """(cx, cy, cz): demanded chunks that are not there yet."""
    return demand.select("cx", "cy", "cz").distinct().join(have, ["cx", "cy", "cz"], "left_anti")


def after_download(demand: DataFrame, have: DataFrame) -> DataFrame:
    """(cx, cy, cz): the chunks that are there once the missing ones have come."""
    return demand.select("cx", "cy", "cz").unionByName(have.select("cx", "cy", "cz")).distinct()
