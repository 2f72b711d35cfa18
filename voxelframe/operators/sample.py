"""Point sampling of volumes: nearest and trilinear lookups, pyramid fallback, gathers from chunks.

Points are rows with a key and three coordinate columns (px, py, pz); voxels are rows (x, y, z, v), levels have
`level` besides.  Lookups are equi-joins, so both sides are dealt by voxel or chunk key; nothing is broadcast unless
Spark finds it small.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import byte_at
from ..functions.num import idiv, to_index, to_u8, trilinear
from ..plans.tables import Tables

CORNERS = [(k & 1, k >> 1 & 1, k >> 2) for k in range(8)]


def nearest(points: DataFrame, voxels: DataFrame, default: int | None = 0) -> DataFrame:
    """`points` with v of the voxel that holds each; negative coordinates count as 0, missing voxels as `default`."""
    at = points.withColumns({f"_{c}": to_index(F.col(f"p{c}")) for c in "xyz"})
    vox = voxels.select(*[F.col(c).cast("bigint").alias(f"_{c}") for c in "xyz"], "v")
    out = at.join(vox, ["_x", "_y", "_z"], "left").drop("_x", "_y", "_z")
    return out if default is None else out.withColumn("v", F.coalesce("v", F.lit(default)))


def inside(points: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """`points` with whether each lies inside a volume of `shape` voxels."""
    within = F.lit(True)
    for c, n in zip("xyz", shape, strict=True):
        within = within & (F.col(f"p{c}") >= 0) & (F.col(f"p{c}") < n)
    return points.withColumn("inside", within)


def _corners(points: DataFrame, key: str) -> DataFrame:
    """A row for each distinct corner of a point's cell: key, _k, _x, _y, _z."""
    base = points.select(key, *[to_index(F.col(f"p{c}")).alias(f"_b{c}") for c in "xyz"], F.explode(F.array(*map(F.lit, range(8)))).alias("_k"))
    bit = lambda k: F.shiftright("_k", k).bitwiseAND(1)
    return base.select(key, "_k", *[(F.col(f"_b{c}") + bit(k)).alias(f"_{c}") for k, c in enumerate("xyz")])


def _blend(points: DataFrame, values: DataFrame, key: str, strict: bool) -> DataFrame:
    """`values` (key, c0..c7) joined back and interpolated; with `strict`, null unless all corners are known."""
    out = points.join(values, key, "left")
    part = {c: F.col(f"p{c}") - F.when(F.col(f"p{c}") >= 0, F.floor(f"p{c}")).otherwise(F.ceil(f"p{c}")) for c in "xyz"}
    corner = [F.coalesce(F.col(f"c{k}"), F.lit(0)).cast("double") for k in range(8)]
    v = to_u8(trilinear(corner, part["x"], part["y"], part["z"]))
    if strict:
        known = F.lit(True)
        for k in range(8):
            known = known & F.col(f"c{k}").isNotNull()
        v = F.when(known, v)
    return out.withColumn("v", v).drop(*[f"c{k}" for k in range(8)])


def trilinear_sample(points: DataFrame, voxels: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """`points` with the interpolated v; `key` is unique.  Missing corners count as 0, or with `strict` make v null."""
    vox = voxels.select(*[F.col(c).cast("bigint").alias(f"_{c}") for c in "xyz"], "v")
    found = _corners(points, key).join(vox, ["_x", "_y", "_z"])
    pivot = found.groupBy(key).agg(*[F.max(F.when(F.col("_k") == k, F.col("v"))).alias(f"c{k}") for k in range(8)])
    return _blend(points, pivot, key, strict)


Edges = int | tuple[int, int, int]  # of a chunk, in voxels along x, y and z


def edges_of(edge: Edges) -> tuple[int, int, int]:
    return (edge,) * 3 if isinstance(edge, int) else tuple(edge)  # type: ignore[return-value]


def _in_chunk(edge: tuple[int, int, int], off: tuple[int, int, int] = (0, 0, 0)) -> Column:
    """The byte in chunk (cx, cy, cz, data) of the voxel `off` from (_x, _y, _z); null if it lies in another chunk."""
    here, index, size = F.lit(True), F.lit(0), 1
    for c, d, e in zip("xyz", off, edge, strict=True):
        here = here & (idiv(F.col(f"_{c}") + d, e) == F.col(f"c{c}"))
        index = index + (F.col(f"_{c}") + d) % e * size
        size *= e
    return F.when(here, byte_at(F.col("data"), index))


def _asked(at: DataFrame, edge: tuple[int, int, int], keep: list[str]) -> DataFrame:
    """`at` (keep, _x, _y, _z) with a row for each distinct chunk that the corners of a point's cell lie in, mostly one."""
    keys = F.array_distinct(F.array(*[F.struct(*[idiv(F.col(f"_{c}") + d, e).alias(f"c{c}") for c, d, e in zip("xyz", off, edge, strict=True)]) for off in CORNERS]))
    return at.withColumn("_k", F.explode(keys)).select(*keep, "_x", "_y", "_z", "_k.*")


def trilinear_in_chunks(points: DataFrame, chunks: DataFrame, key: str, edge: Edges, strict: bool = False) -> DataFrame:
    """The same from chunks (cx, cy, cz, data; x fastest).

    A point asks once for each distinct chunk its corners lie in, mostly one, and takes all its corners from that
    chunk's bytes at once.  Only chunks that are asked for reach the join.
    """
    e = edges_of(edge)
    asks = _asked(points.select(key, *[to_index(F.col(f"p{c}")).alias(f"_{c}") for c in "xyz"]), e, [key])
    wanted = chunks.join(asks.select("cx", "cy", "cz").distinct(), ["cx", "cy", "cz"], "left_semi")
    got = asks.join(wanted.select("cx", "cy", "cz", "data"), ["cx", "cy", "cz"])
    pivot = got.groupBy(key).agg(*[F.max(_in_chunk(e, off)).alias(f"c{k}") for k, off in enumerate(CORNERS)])
    return _blend(points, pivot, key, strict)


def nearest_in_chunks(points: DataFrame, chunks: DataFrame, edge: Edges, default: int = 0) -> DataFrame:
    e = edges_of(edge)
    at = points.withColumns({f"_{c}": to_index(F.col(f"p{c}")) for c in "xyz"})
    at = at.withColumns({f"c{c}": idiv(F.col(f"_{c}"), n) for c, n in zip("xyz", e, strict=True)})
    wanted = chunks.join(at.select("cx", "cy", "cz").distinct(), ["cx", "cy", "cz"], "left_semi").select("cx", "cy", "cz", "data")
    out = at.join(wanted, ["cx", "cy", "cz"], "left").withColumn("v", F.coalesce(_in_chunk(e), F.lit(default)))
    return out.drop("_x", "_y", "_z", "cx", "cy", "cz", "data")


def _level_by_level(points: DataFrame, key: str, levels: list[int], sample) -> DataFrame:
    """`points` with v of the first of `levels` that knows them, else 0; `sample(points, level)` gives v, null where unknown.

    Points that a level knows are done; only the others ask the next, so a level is written before the next begins.
    """
    tables = Tables(points.sparkSession)
    left, done = points, None
    for level in levels:
        got = tables.cut(sample(left, level).select(*points.columns, "v"))
        known = got.where("v is not null")
        done = known if done is None else done.unionByName(known)
        left = got.where("v is null").drop("v")
    rest = left.withColumn("v", F.lit(0))
    return rest if done is None else done.unionByName(rest)


def nearest_pyramid(points: DataFrame, levels: DataFrame, key: str, finest: int = 0, coarsest: int = 3) -> DataFrame:
    """`points` with v of the finest level, from `finest` on, that holds their voxel; 0 if none does.

    One join for all levels: a point asks every level, and the finest answer wins.
    """
    at = points.select(key, *[to_index(F.col(f"p{c}")).alias(f"_{c}") for c in "xyz"])
    asks = at.withColumn("level", F.explode(F.array(*map(F.lit, range(finest, coarsest + 1)))))
    shift = lambda c: F.call_function("shiftright", F.col(f"_{c}"), F.col("level")).alias(c)
    asks = asks.select(key, "level", *map(shift, "xyz"))
    vox = levels.select("level", *[F.col(c).cast("bigint").alias(c) for c in "xyz"], "v")
    best = asks.join(vox, ["level", "x", "y", "z"]).groupBy(key).agg(F.min_by("v", "level").alias("v"))
    return points.join(best, key, "left").withColumn("v", F.coalesce("v", F.lit(0)))


def _scaled(points: DataFrame, level: int) -> DataFrame:
    """`points` in voxels of a level, their own coordinates kept."""
    return points.withColumns({f"full_{c}": F.col(f"p{c}") for c in "xyz"} | {f"p{c}": F.col(f"p{c}") / float(1 << level) for c in "xyz"})


def _unscaled(points: DataFrame) -> DataFrame:
    return points.withColumns({f"p{c}": F.col(f"full_{c}") for c in "xyz"}).drop(*[f"full_{c}" for c in "xyz"])


def trilinear_pyramid(points: DataFrame, levels: DataFrame, key: str, finest: int = 0, coarsest: int = 3) -> DataFrame:
    """`points` with the interpolated v of the finest level that has all eight corners; 0 if none has."""
    of = lambda left, level: _unscaled(trilinear_sample(_scaled(left, level), levels.where(F.col("level") == level), key, strict=True))
    return _level_by_level(points, key, list(range(finest, coarsest + 1)), of)


@dataclass(frozen=True)
class Voxels:
    """A volume as rows (x, y, z, v)."""

    rows: DataFrame

    def nearest(self, points: DataFrame, key: str) -> DataFrame:
        return nearest(points, self.rows)

    def trilinear(self, points: DataFrame, key: str) -> DataFrame:
        return trilinear_sample(points, self.rows, key)


@dataclass(frozen=True)
class Chunks:
    """A volume as chunks (cx, cy, cz, data) of `edge` voxels, x fastest."""

    rows: DataFrame
    edge: Edges

    def nearest(self, points: DataFrame, key: str) -> DataFrame:
        return nearest_in_chunks(points, self.rows, self.edge)

    def trilinear(self, points: DataFrame, key: str) -> DataFrame:
        return trilinear_in_chunks(points, self.rows, key, self.edge)


@dataclass(frozen=True)
class Pyramid:
    """A volume as voxels of several levels (level, x, y, z, v), the finest that knows a voxel first."""

    rows: DataFrame
    finest: int = 0
    coarsest: int = 3

    def nearest(self, points: DataFrame, key: str) -> DataFrame:
        return nearest_pyramid(points, self.rows, key, self.finest, self.coarsest)

    def trilinear(self, points: DataFrame, key: str) -> DataFrame:
        return trilinear_pyramid(points, self.rows, key, self.finest, self.coarsest)


@dataclass(frozen=True)
class ChunkPyramid:
    """A volume as chunks of several levels (level, cx, cy, cz, data); `edges` has the levels' chunk edges, finest first.

    A voxel of level s is 2**s voxels wide.  The finest level that has a point's chunk answers; only points that it
    does not know ask the next, and only chunks that are asked for are read.  No chunk becomes voxel rows.  `source`,
    if given, finds the chunks of a table of keys (level, cx, cy, cz) instead of `rows`.
    """

    rows: DataFrame | None
    edges: tuple[Edges, ...]
    finest: int = 0
    source: Callable[[DataFrame], DataFrame] | None = None

    def chunks(self, level: int, keys: DataFrame) -> DataFrame:
        """(cx, cy, cz, data) of the wanted keys (cx, cy, cz) of a level."""
        if self.source is not None:
            found = self.source(keys.select(F.lit(level).alias("level"), "cx", "cy", "cz"))
        else:
            found = self.rows.where(F.col("level") == level).join(keys, ["cx", "cy", "cz"], "left_semi")
        return found.select("cx", "cy", "cz", "data")

    def _levels(self) -> list[int]:
        return list(range(self.finest, len(self.edges)))

    def nearest(self, points: DataFrame, key: str) -> DataFrame:
        def one(left: DataFrame, level: int) -> DataFrame:
            e = edges_of(self.edges[level])
            at = left.withColumns({f"_{c}": F.call_function("shiftright", to_index(F.col(f"p{c}")), F.lit(level)) for c in "xyz"})
            at = at.withColumns({f"c{c}": idiv(F.col(f"_{c}"), n) for c, n in zip("xyz", e, strict=True)})
            wanted = self.chunks(level, at.select("cx", "cy", "cz").distinct())
            return at.join(wanted, ["cx", "cy", "cz"], "left").withColumn("v", _in_chunk(e))

        return _level_by_level(points, key, self._levels(), one)

    def trilinear(self, points: DataFrame, key: str) -> DataFrame:
        def one(left: DataFrame, level: int) -> DataFrame:
            scaled = _scaled(left, level)
            keys = _asked(scaled.select(*[to_index(F.col(f"p{c}")).alias(f"_{c}") for c in "xyz"]), edges_of(self.edges[level]), [])
            return _unscaled(trilinear_in_chunks(scaled, self.chunks(level, keys.select("cx", "cy", "cz").distinct()), key, self.edges[level], strict=True))

        return _level_by_level(points, key, self._levels(), one)


class Volume(Protocol):
    """Whatever samples points (px, py, pz and a key): renders and sessions take any class with these two methods."""

    def nearest(self, points: DataFrame, key: str) -> DataFrame:
        """`points` with v of the voxel that holds each."""

    def trilinear(self, points: DataFrame, key: str) -> DataFrame:
        """`points` with v interpolated between eight voxels."""


def as_volume(volume: Volume | DataFrame) -> Volume:
    """A plain table of voxels counts as `Voxels`."""
    return Voxels(volume) if isinstance(volume, DataFrame) else volume
