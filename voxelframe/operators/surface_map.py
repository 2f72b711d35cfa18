"""Per-pixel-map surfaces: rows (u, v, x, y, z, nx, ny, nz), sampled in a base volume at steps along the normal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.num import to_i32
from .sample import nearest

PARTS = ("x", "y", "z", "nx", "ny", "nz")
REACH = 45


def usable(u: Column, v: Column, w: Column, width: int, height: int) -> Column:
    """Inside the map but for its first row and column, and near enough to the surface."""
    return (u > 0) & (u < width) & (v > 0) & (v < height) & (F.abs(w) <= REACH)


def sample_map(points: DataFrame, surface: DataFrame, voxels: DataFrame, key: str, width: int, height: int, bilinear: bool = False) -> DataFrame:
    """(key, v) of `points` (key, mu, mv, mw): 0 outside the map, where the map is empty and where the volume is."""
    u, v, w = (to_i32(F.col(c)).cast("bigint") for c in ("mu", "mv", "mw"))
    asks = points.select(key, "mu", "mv", u.alias("u"), v.alias("v"), w.alias("w")).where(usable(F.col("u"), F.col("v"), F.col("w"), width, height))
    if bilinear:
        part = lambda c, whole: F.col(c) - F.col(whole)
        corner = F.array(*[F.struct(F.lit(k).alias("k"), (F.col("u") + (k & 1)).alias("cu"), (F.col("v") + (k >> 1)).alias("cv")) for k in range(4)])
        met = asks.withColumn("c", F.explode(corner)).select(key, "c.*").join(surface.select(F.col("u").alias("cu"), F.col("v").alias("cv"), *PARTS), ["cu", "cv"])
        pivot = met.groupBy(key).agg(*[F.coalesce(F.max(F.when(F.col("k") == k, F.col(p))), F.lit(0.0)).alias(f"{p}{k}") for k in range(4) for p in PARTS])
        joined = asks.join(pivot, key)
        du, dv = part("mu", "u"), part("mv", "v")
        mix = lambda p: F.col(f"{p}0") * (1.0 - du) * (1.0 - dv) + F.col(f"{p}1") * du * (1.0 - dv) + F.col(f"{p}2") * (1.0 - du) * dv + F.col(f"{p}3") * du * dv
        at = joined.select(key, "w", *[mix(p).alias(p) for p in PARTS])
    else:
        at = asks.join(surface, ["u", "v"]).select(key, "w", *PARTS)
    at = at.where(~((F.col("x") == 0) & (F.col("y") == 0) & (F.col("z") == 0)))
    got = nearest(at.select(key, *[(F.col(c) + F.col("w").cast("double") * F.col(f"n{c}")).alias(f"p{c}") for c in "xyz"]), voxels)
    return points.select(key).join(got.select(key, "v"), key, "left").select(key, F.coalesce("v", F.lit(0)).alias("v"))
