"""Plane slices of volumes, the tiles a view shows, and where they stand on the screen."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import paint_zoom
from ..functions.num import idiv, to_i32

#: The axes (u, v, plane) of each pane.
PANES = {"XY": (0, 1, 2), "XZ": (0, 2, 1), "YZ": (2, 1, 0), "UV": (0, 1, 2)}
AXES = "xyz"
TILE = 256


@dataclass(frozen=True)
class View:
    """An axis-aligned window: centre (voxels), canvas (pixels) and voxels for each pixel."""

    centre: tuple[int, int, int]
    width: int
    height: int
    pane: str = "XY"
    zoom: int = 1


def slice_voxels(voxels: DataFrame, view: View, opaque_zero: bool = False) -> DataFrame:
    """(px, py, v) of the voxels that pixels of the view fall on; zeros are transparent unless `opaque_zero`.

    The view becomes range filters on the voxels, which a scan can use; pixels are computed from voxels, so there is
    no join at all.
    """
    u, v, plane = (AXES[k] for k in PANES[view.pane])
    cu, cv, cp = (view.centre[k] for k in PANES[view.pane])
    low_u, low_v = cu - view.width // 2 * view.zoom, cv - view.height // 2 * view.zoom
    inside = (F.col(plane) == max(cp, 0)) & F.col(u).between(max(0, low_u), low_u + view.width * view.zoom - 1) & F.col(v).between(max(0, low_v), low_v + view.height * view.zoom - 1)
    if view.zoom > 1:
        inside = inside & ((F.col(u) - low_u) % view.zoom == 0) & ((F.col(v) - low_v) % view.zoom == 0)
    if not opaque_zero:
        inside = inside & (F.col("v") != 0)
    return voxels.where(inside).select(idiv(F.col(u) - low_u, view.zoom).alias("px"), idiv(F.col(v) - low_v, view.zoom).alias("py"), F.col("v").cast("int").alias("v"))


def pixels(spark: SparkSession, view: View) -> DataFrame:
    """(px, py, x, y, z): each pixel of a view and the voxel it shows."""
    cu, cv, cp = (view.centre[k] for k in PANES[view.pane])
    n = F.col("id")
    px, py = n % view.width, idiv(n, view.width)
    at = {PANES[view.pane][0]: cu + (px - view.width // 2) * view.zoom, PANES[view.pane][1]: cv + (py - view.height // 2) * view.zoom, PANES[view.pane][2]: F.lit(cp).cast("bigint")}
    return spark.range(view.width * view.height).select(px.alias("px"), py.alias("py"), *[at[k].alias(AXES[k]) for k in range(3)])


def slice_levels(levels: DataFrame, view: View, finest: int = 0, coarsest: int = 3) -> DataFrame:
    """(px, py, v): levels painted from coarse to fine, zeros transparent, so the finest voxel that isn't 0 wins."""
    pix = pixels(levels.sparkSession, view).where("x >= 0 and y >= 0 and z >= 0")
    asks = pix.withColumn("level", F.explode(F.array(*map(F.lit, range(finest, coarsest + 1)))))
    asks = asks.select("px", "py", "level", *[F.call_function("shiftright", F.col(c), F.col("level")).alias(c) for c in AXES])
    lit = levels.where("v <> 0").select("level", *[F.col(c).cast("bigint").alias(c) for c in AXES], "v")
    return asks.join(lit, ["level", "x", "y", "z"]).groupBy("px", "py").agg(F.min_by("v", "level").alias("v"))


def visible_tiles(views: DataFrame, width: int, height: int) -> DataFrame:
    """`views` (u, v, zoom) with a row for each tile (tile_x, tile_y) they show, one tile of margin included."""
    step = F.lit(float(TILE)) * paint_zoom(F.col("zoom"))
    span = lambda c, size: ((F.col(c) - size / F.col("zoom") / 2.0) / step, (F.col(c) + size / F.col("zoom") / 2.0) / step)
    (left, right), (top, bottom) = span("u", float(width)), span("v", float(height))
    tiles = lambda a, b: F.sequence(F.floor(a) - 1, F.ceil(b))
    return views.withColumn("tile_y", F.explode(tiles(top, bottom))).withColumn("tile_x", F.explode(tiles(left, right)))


def tile_rects(tiles: DataFrame, width: int, height: int) -> DataFrame:
    """`tiles` (u, v, zoom, tile_x, tile_y) with their screen rectangle: left, top, right, bottom."""
    step = F.lit(float(TILE)) * paint_zoom(F.col("zoom"))
    place = lambda tile, more, c, size: F.lit(size / 2.0) + ((F.col(tile) + more) * step - F.col(c)) * F.col("zoom")
    return tiles.withColumns({"left": place("tile_x", 0, "u", width), "top": place("tile_y", 0, "v", height), "right": place("tile_x", 1, "u", width), "bottom": place("tile_y", 1, "v", height)})


def tile_centre(tile: str, zoom: str) -> Column:
    """The world coordinate of a tile's middle."""
    return to_i32((F.col(tile) + 0.5) * TILE * paint_zoom(F.col(zoom)))


#: The least and largest zoom of a view.
ZOOM_LIMITS = (0.025, 8.0)


def scrolled(coord: tuple[int, int, int], pane: str, direction: float, zoom: float, ranges: tuple[tuple[int, int], ...]) -> tuple[int, int, int]:
    """A view's centre one step along its plane's axis: steps are as wide as the level shown, and snap to it."""
    axis, step = PANES[pane][2], 1 << min(int(1.0 / zoom), 6)
    moved = coord[axis] + (step if direction > 0 else -step)
    snapped = int(moved / step) * step
    out = list(coord)
    out[axis] = min(max(snapped, ranges[axis][0]), ranges[axis][1])
    return tuple(out)


def dragged(coord: tuple[int, int, int], pane: str, dx: float, dy: float, zoom: float, ranges: tuple[tuple[int, int], ...]) -> tuple[int, int, int]:
    """A view's centre after a drag by screen pixels."""
    out = list(coord)
    for axis, delta in zip(PANES[pane][:2], (dx, dy), strict=True):
        out[axis] = min(max(coord[axis] + int(-delta / zoom), ranges[axis][0]), ranges[axis][1])
    return tuple(out)


def zoomed(zoom: float, factor: float) -> float:
    return min(max(zoom * factor, ZOOM_LIMITS[0]), ZOOM_LIMITS[1])
