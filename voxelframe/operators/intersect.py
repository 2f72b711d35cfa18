"""Where a plane cuts a mesh: segments, their pixels, and markers at their ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.num import idiv, side, to_i32
from .mesh import Grid, bounds, grid_range_join
from .slices import AXES, PANES, View

HIGHLIGHT, PLAIN = (255, 170, 0), (255, 0, 255)


def view_window(view: View) -> dict[str, tuple[float, float]]:
    """The least and largest coordinate of a view on each axis."""
    u, v, plane = PANES[view.pane]
    out = {AXES[plane]: (float(view.centre[plane]),) * 2}
    for k, size in ((u, view.width), (v, view.height)):
        half = size // 2 * view.zoom
        out[AXES[k]] = (float(view.centre[k] - half), float(view.centre[k] + half))
    return out


def plane_segments(triangles: DataFrame, view: View, grid: Grid, highlight: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(f, u0, v0, u1, v1, highlighted): the segment of each face that the view's plane cuts in two points.

    `highlight` is a window (u0, v0, u1, v1) of texture coordinates.
    """
    window = view_window(view)
    spark = triangles.sparkSession
    row = spark.range(1).select(F.lit(0).alias("window"), *[F.lit(x).alias(f"{n}_{a}") for a in AXES for n, x in zip(("low", "high"), window[a], strict=True)])
    near = grid_range_join(triangles, row, grid, tuple(AXES), "window")
    u, v, plane = (AXES[k] for k in PANES[view.pane])
    w = F.lit(window[plane][0])
    points = []
    for a, b in ((1, 2), (2, 3), (3, 1)):
        pa, pb = F.col(f"{plane}{a}"), F.col(f"{plane}{b}")
        t = (w - pa) / ((w - pa) - (w - pb))
        at = lambda c, a=a, b=b, t=t: F.col(f"{c}{a}") + t * (F.col(f"{c}{b}") - F.col(f"{c}{a}"))
        points.append(F.when(side(pa - w) != side(pb - w), F.struct(at(u).alias("u"), at(v).alias("v"))))
    cut = F.filter(F.array(*points), lambda p: p.isNotNull())
    marked = F.lit(False)
    if highlight:
        (lu, hu), (lv, hv) = bounds("tu"), bounds("tv")
        marked = (lu <= highlight[2]) & (hu >= highlight[0]) & (lv <= highlight[3]) & (hv >= highlight[1])
    found = near.select("f", cut.alias("p"), marked.alias("highlighted")).where(F.size("p") == 2)
    end = lambda k, c: F.get(F.col("p"), F.lit(k))[c]
    return found.select("f", end(0, "u").alias("u0"), end(0, "v").alias("v0"), end(1, "u").alias("u1"), end(1, "v").alias("v1"), "highlighted")


def to_canvas(segments: DataFrame, view: View) -> DataFrame:
    """`segments` with their ends as pixels x0, y0, x1, y1."""
    u, v, _ = (AXES[k] for k in PANES[view.pane])
    window = view_window(view)
    at = lambda c, axis: to_i32((F.col(c) - window[axis][0]) / float(view.zoom)).cast("bigint")
    return segments.withColumns({"x0": at("u0", u), "y0": at("v0", v), "x1": at("u1", u), "y1": at("v1", v)})


def line_pixels(segments: DataFrame, width: int, height: int) -> DataFrame:
    """`segments` (x0, y0, x1, y1) with a row for each pixel (px, py) of their lines, but for the end, inside the canvas.

    Bresenham's line in closed form: step k is k pixels along the longer side and (2k * shorter + longer) div (2 * longer)
    along the other.  Only steps whose place on the longer side is inside the canvas become rows.
    """
    x0, y0, x1, y1 = (F.col(c).cast("bigint") for c in ("x0", "y0", "x1", "y1"))
    dx, dy = F.abs(x1 - x0), F.abs(y1 - y0)
    sx, sy = F.when(x0 < x1, 1).otherwise(-1), F.when(y0 < y1, 1).otherwise(-1)
    along_x, longer, shorter = dx >= dy, F.greatest(dx, dy), F.least(dx, dy)
    pick = lambda x, y: F.when(along_x, x).otherwise(y)
    start, way, size = pick(x0, y0), pick(sx, sy), pick(F.lit(width), F.lit(height)).cast("bigint")
    first = F.greatest(F.lit(0).cast("bigint"), F.when(way > 0, -start).otherwise(start - size + 1))
    last = F.least(longer - 1, F.when(way > 0, size - 1 - start).otherwise(start))

    def place(k: Column) -> Column:
        aside = idiv(2 * k * shorter + longer, 2 * longer)
        return F.struct((x0 + sx * pick(k, aside)).alias("px"), (y0 + sy * pick(aside, k)).alias("py"))

    # one expression: as columns with filters between them, its parts take the optimiser minutes
    inside = lambda p: (p.px >= 0) & (p.px < width) & (p.py >= 0) & (p.py < height)
    path = F.when(first <= last, F.filter(F.transform(F.sequence(first, last), place), inside))
    out = segments.withColumn("_at", F.explode(path))
    return out.withColumns({"px": F.col("_at.px"), "py": F.col("_at.py")}).drop("_at")


def colored(pixels: DataFrame) -> DataFrame:
    """(px, py, r, g, b): the line of the last face on each pixel, orange if highlighted, else magenta."""
    last = pixels.groupBy("px", "py").agg(F.max_by("highlighted", "f").alias("highlighted"))
    pick = lambda k: F.when(F.col("highlighted"), HIGHLIGHT[k]).otherwise(PLAIN[k])
    return last.select("px", "py", *[pick(k).alias(c) for k, c in enumerate("rgb")])


def markers(segments: DataFrame, width: int, height: int, size: int = 4) -> DataFrame:
    """(px, py): the pixels of squares at both ends of each segment, inside the canvas, each once."""
    half = size // 2
    ends = segments.select(F.explode(F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")))).alias("e")).select("e.*").distinct()
    across = lambda c: F.explode(F.sequence(F.col(c) - half, F.col(c) + half - 1))
    out = ends.select("y", across("x").alias("px")).select("px", across("y").alias("py"))
    return out.where(f"px >= 0 and px < {width} and py >= 0 and py < {height}").distinct()
