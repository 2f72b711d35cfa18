"""Triangle meshes: transforms, texture coordinates, grid-binned range joins, rasterising and surface renders.

Vertices are rows (i, u, v, x, y, z, nx, ny, nz), faces (f, v1, v2, v3); `wide` joins them once into a row for each
triangle.  Range joins go through grid bins, so they are equi-joins on the bin; a face in many bins is found once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import align_down, align_up
from ..functions.num import idiv, to_i32, to_index
from .composite import Composite, composite
from .sample import Volume, as_volume

Affine = tuple[tuple[float, float, float, float], ...]


def affine_apply(vertices: DataFrame, m: Affine) -> DataFrame:
    """Positions times the whole matrix, normals times its linear part and scaled to length 1."""
    row = lambda k, cols, last: F.lit(m[k][0]) * F.col(cols[0]) + F.lit(m[k][1]) * F.col(cols[1]) + F.lit(m[k][2]) * F.col(cols[2]) + (F.lit(m[k][3]) if last else 0)
    n = [F.lit(m[k][0]) * F.col("nx") + F.lit(m[k][1]) * F.col("ny") + F.lit(m[k][2]) * F.col("nz") for k in range(3)]
    length = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    moved = {c: row(k, "xyz", True) for k, c in enumerate("xyz")} | {f"n{c}": n[k] / length for k, c in enumerate("xyz")}
    return vertices.withColumns(moved)


def affine_invert(m: Affine) -> Affine:
    """The inverse of a 3 x 4 matrix by cofactors; raises ValueError if it is singular."""
    (a, b, c, p), (d, e, f, q), (g, h, i, r) = m
    co = ((e * i - f * h, c * h - b * i, b * f - c * e), (f * g - d * i, a * i - c * g, c * d - a * f), (d * h - e * g, b * g - a * h, a * e - b * d))
    det = a * co[0][0] + b * co[1][0] + c * co[2][0]
    if det == 0:
        raise ValueError("the matrix is singular")
    lin = [[x / det for x in line] for line in co]
    return tuple((*line, -(line[0] * p + line[1] * q + line[2] * r)) for line in lin)


def _rescaled(rows: DataFrame, columns: tuple[str, ...]) -> dict[str, Column]:
    """Each column rescaled to 0..1 by its least and largest value: one aggregate row reaches the driver."""
    low = rows.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))]).first()
    return {c: (F.col(c) - F.lit(low[f"min_{c}"])) / (F.lit(low[f"max_{c}"]) - F.lit(low[f"min_{c}"])) for c in columns}


def uv_normalise(vertices: DataFrame) -> DataFrame:
    """Texture coordinates rescaled to 0..1."""
    return vertices.withColumns(_rescaled(vertices, ("u", "v")))


def ortho_xz(vertices: DataFrame) -> DataFrame:
    """Texture coordinates from an orthographic projection along y; all normals become (0, 1, 0)."""
    at = _rescaled(vertices, ("x", "z"))
    return vertices.withColumns({"u": at["x"], "v": at["z"], "nx": F.lit(0.0), "ny": F.lit(1.0), "nz": F.lit(0.0)})


def wide(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(f, and u, v, x, y, z, nx, ny, nz of the three vertices with 1, 2, 3 behind): three equi-joins, made once."""
    out = faces
    cols = [c for c in vertices.columns if c != "i"]
    for k in (1, 2, 3):
        v = vertices.select(F.col("i").alias(f"v{k}"), *[F.col(c).alias(f"{c}{k}_") for c in cols])
        out = out.join(v, f"v{k}")
    return out.select("f", *[F.col(f"{c}{k}_").alias(f"t{c}{k}" if c in "uv" else f"{c}{k}") for k in (1, 2, 3) for c in cols])


def edge_function(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    """Twice the signed area of (a, b, p), in 64-bit integers."""
    big = lambda c: c.cast("bigint")
    return (big(bx) - big(ax)) * (big(py) - big(ay)) - (big(by) - big(ay)) * (big(px) - big(ax))


def is_inverted(triangles: DataFrame) -> DataFrame:
    """(winding): whether the second face's centroid is inside by the edge tests; false without a second face."""
    s = [to_i32(F.col(f"t{c}{k}") * 100000.0).cast("bigint") for k in (1, 2, 3) for c in "uv"]
    u, v = idiv(s[0] + s[2] + s[4], 3), idiv(s[1] + s[3] + s[5], 3)
    w = [edge_function(s[2], s[3], s[4], s[5], u, v), edge_function(s[4], s[5], s[0], s[1], u, v), edge_function(s[0], s[1], s[2], s[3], u, v)]
    test = (w[0] >= 0) & (w[1] >= 0) & (w[2] >= 0)
    return triangles.agg(F.coalesce(F.max(F.when(F.col("f") == 1, test)), F.lit(False)).alias("winding"))


@dataclass(frozen=True)
class Grid:
    """A uniform grid over a mesh: the least and largest coordinate and the number of cells of each axis."""

    low: tuple[float, ...]
    high: tuple[float, ...]
    cells: int | tuple[int, ...]

    @staticmethod
    def over(triangles: DataFrame, axes: tuple[str, ...], faces_per_cell: float = 100.0) -> Grid:
        """About `faces_per_cell` faces a cell, at least one cell; one aggregate row reaches the driver."""
        low = [F.least(*[F.min(f"{a}{k}") for k in (1, 2, 3)]) for a in axes]
        high = [F.greatest(*[F.max(f"{a}{k}") for k in (1, 2, 3)]) for a in axes]
        row = triangles.agg(F.count("*"), *low, *high).first()
        return Grid(tuple(row[1 : 1 + len(axes)]), tuple(row[1 + len(axes) :]), max(1, int((row[0] / faces_per_cell) ** (1 / len(axes)))))

    @staticmethod
    def fitted(triangles: DataFrame, axes: tuple[str, ...], windows: tuple[float, ...], most: int = 4096) -> Grid:
        """For range joins: cells as wide as a face is on the mean, or as the windows are if these are wider, on each axis.

        So a face and a window lie in few cells, and a cell holds few faces, however fine the mesh is.
        """
        low = [F.least(*[F.min(f"{a}{k}") for k in (1, 2, 3)]) for a in axes]
        high = [F.greatest(*[F.max(f"{a}{k}") for k in (1, 2, 3)]) for a in axes]
        mean = [F.avg(F.greatest(*[F.col(f"{a}{k}") for k in (1, 2, 3)]) - F.least(*[F.col(f"{a}{k}") for k in (1, 2, 3)])) for a in axes]
        row, n = triangles.agg(*low, *high, *mean).first(), len(axes)
        wide = [max(m or 0.0, w) for m, w in zip(row[2 * n :], windows, strict=True)]
        cells = [max(1, min(most, int((b - a) / w))) if w and a is not None else 1 for a, b, w in zip(row[:n], row[n : 2 * n], wide, strict=True)]
        return Grid(tuple(row[:n]), tuple(row[n : 2 * n]), tuple(cells))

    def count(self, axis: int) -> int:
        return self.cells if isinstance(self.cells, int) else self.cells[axis]

    def cell(self, x: Column, axis: int) -> Column:
        """The cell of a coordinate, by the width of a cell; coordinates outside go to the border cells."""
        width = F.lit((self.high[axis] - self.low[axis]) / self.count(axis))
        return F.least(to_index((x - F.lit(self.low[axis])) / width), F.lit(self.count(axis) - 1))

    def view_cell(self, x: Column, axis: int) -> Column:
        """The cell of a view's border, by the share of the whole."""
        share = (x - F.lit(self.low[axis])) / F.lit(self.high[axis] - self.low[axis])
        return F.least(to_index(share * float(self.count(axis))), F.lit(self.count(axis) - 1))


def bounds(axis: str) -> tuple[Column, Column]:
    cols = [F.col(f"{axis}{k}") for k in (1, 2, 3)]
    return F.least(*cols), F.greatest(*cols)


def binned(triangles: DataFrame, grid: Grid, axes: tuple[str, ...]) -> DataFrame:
    """`triangles` with a row for each grid cell (bin0, bin1, ...) that their bounding box touches."""
    out = triangles
    for k, a in enumerate(axes):
        low, high = bounds(a)
        out = out.withColumn(f"bin{k}", F.explode(F.sequence(grid.cell(low, k), grid.cell(high, k))))
    return out


def grid_range_join(triangles: DataFrame, windows: DataFrame, grid: Grid, axes: tuple[str, ...], key: str) -> DataFrame:
    """Each pair of a window (`key`, low_a, high_a for each axis) and a face whose bounding boxes overlap.

    Both sides go to their grid cells and meet by equi-join; then the exact test.  A pair that meets in several cells
    is made in the first of them only: no distinct, no shuffle after the join.
    """
    w = windows
    for k, a in enumerate(axes):  # one rule for both sides: a border that rounds apart would lose pairs in narrow cells
        w = w.withColumn(f"first{k}", grid.cell(F.col(f"low_{a}"), k)).withColumn(f"bin{k}", F.explode(F.sequence(F.col(f"first{k}"), grid.cell(F.col(f"high_{a}"), k))))
    met = binned(triangles, grid, axes).join(w, [f"bin{k}" for k in range(len(axes))])
    overlap, once = F.lit(True), F.lit(True)
    for k, a in enumerate(axes):
        low, high = bounds(a)
        overlap = overlap & ~((low > F.col(f"high_{a}")) | (high < F.col(f"low_{a}")))
        once = once & (F.col(f"bin{k}") == F.greatest(F.col(f"first{k}"), grid.cell(low, k)))
    return met.where(overlap & once).drop(*[f"{n}{k}" for n in ("bin", "first") for k in range(len(axes))])


@dataclass(frozen=True)
class Surface:
    """A mesh seen as an image of `width` x `height` pixels; `inverted` as by `is_inverted`."""

    width: int
    height: int
    inverted: bool = True

    def v(self, v: Column) -> Column:
        return v if self.inverted else 1.0 - v

    def pixel_corners(self, triangles: DataFrame) -> DataFrame:
        """`triangles` with the corners' pixels pu1, pv1, ..."""
        return triangles.withColumns({f"pu{k}": to_i32(F.col(f"tu{k}") * float(self.width)).cast("bigint") for k in (1, 2, 3)} | {f"pv{k}": to_i32(self.v(F.col(f"tv{k}")) * float(self.height)).cast("bigint") for k in (1, 2, 3)})


@dataclass(frozen=True)
class Window2D:
    """The part of a surface to paint: centre (u, v, layer), canvas in pixels, surface pixels for each canvas pixel."""

    centre: tuple[int, int, int]
    width: int
    height: int
    zoom: int = 1

    @property
    def low(self) -> tuple[int, int]:
        return self.centre[0] - self.width // 2 * self.zoom, self.centre[1] - self.height // 2 * self.zoom

    @property
    def high(self) -> tuple[int, int]:
        return self.centre[0] + self.width // 2 * self.zoom, self.centre[1] + self.height // 2 * self.zoom


def _weights(u: Column, v: Column) -> tuple[Column, Column, Column]:
    c = {f"{a}{k}": F.col(f"p{a}{k}") for a in "uv" for k in (1, 2, 3)}
    return edge_function(c["u2"], c["v2"], c["u3"], c["v3"], u, v), edge_function(c["u3"], c["v3"], c["u1"], c["v1"], u, v), edge_function(c["u1"], c["v1"], c["u2"], c["v2"], u, v)


def _interpolated(names: tuple[str, ...]) -> list[Column]:
    inv = F.lit(1.0) / (F.col("w0") + F.col("w1") + F.col("w2")).cast("double")
    w = [F.col(f"w{k}").cast("double") for k in range(3)]
    return [((w[0] * F.col(f"{c}1") + w[1] * F.col(f"{c}2") + w[2] * F.col(f"{c}3")) * inv).alias(c) for c in names]


def raster(triangles: DataFrame, surface: Surface, window: Window2D, grid: Grid) -> DataFrame:
    """(px, py, f, order, w0, w1, w2, x, y, z, nx, ny, nz): every pixel of the window under every face.

    Pixels come from each face's bounding box, clipped to the window and aligned to the zoom.  `order` is the place
    at which the face paints: grid cells row by row, each with its faces; a face in several cells paints last in the
    last of those that the window touches.
    """
    z = window.zoom
    (low_u, low_v), (high_u, high_v) = window.low, window.high
    view = {"tu": (low_u / surface.width, high_u / surface.width)}
    sides = sorted((low_v / surface.height, high_v / surface.height) if surface.inverted else (1.0 - low_v / surface.height, 1.0 - high_v / surface.height))
    view["tv"] = (sides[0], sides[1])
    seen, last = F.lit(True), []
    for k, a in ((1, "tv"), (0, "tu")):
        low, high = bounds(a)
        first_cell, last_cell = (grid.view_cell(F.lit(float(x)), k) for x in view[a])
        a_cell, b_cell = grid.cell(low, k), grid.cell(high, k)
        seen = seen & (a_cell <= last_cell) & (b_cell >= first_cell) & ~((low > view[a][1]) | (high < view[a][0]))
        last.append(F.least(b_cell, last_cell))
    out = surface.pixel_corners(triangles.where(seen)).withColumn("order", F.struct(last[0].alias("row"), last[1].alias("col"), F.col("f").alias("face")))
    for a, low, size in (("u", low_u, window.width), ("v", low_v, window.height)):
        corner = [F.col(f"p{a}{k}") - low for k in (1, 2, 3)]
        begin = F.greatest(align_down(F.least(*corner), z), F.lit(0))
        end = F.least(align_up(F.greatest(*corner), z), F.lit(size * z - 1))
        out = out.withColumn(f"_{a}", F.explode(F.when(begin <= end, F.sequence(begin, end, F.lit(z).cast("bigint")))))
    w = _weights(F.col("_u") + low_u, F.col("_v") + low_v)
    out = out.withColumns({f"w{k}": w[k] for k in range(3)}).where("w0 >= 0 and w1 >= 0 and w2 >= 0 and w0 + w1 + w2 > 0")
    return out.select(idiv(F.col("_u"), z).alias("px"), idiv(F.col("_v"), z).alias("py"), "f", "order", "w0", "w1", "w2", *_interpolated(("x", "y", "z", "nx", "ny", "nz")))


def top_pixels(fragments: DataFrame) -> DataFrame:
    """The fragment that paints last on each pixel."""
    rest = [c for c in fragments.columns if c not in ("px", "py", "order")]
    return fragments.groupBy("px", "py").agg(F.max_by(F.struct(*rest), "order").alias("t")).select("px", "py", "t.*")


def offset(rows: DataFrame, w: Column) -> DataFrame:
    """`rows` with sample points at `w` steps along the normal."""
    return rows.withColumns({f"p{c}": F.col(c) + w * F.col(f"n{c}") for c in "xyz"})


def render(triangles: DataFrame, volume: Volume | DataFrame, surface: Surface, window: Window2D, grid: Grid, how: Composite | None = None, trilinear: bool = False) -> DataFrame:
    """(px, py, v): the surface painted with the volume's values, at the window's layer or composited along the normal.

    Only the fragments that stay visible are sampled: each pixel's value depends on its last face alone.
    """
    top = top_pixels(raster(triangles, surface, window, grid)).withColumn("pixel", F.col("py") * window.width + F.col("px"))
    layer = window.centre[2]
    top = top.withColumnsRenamed({"px": "at_x", "py": "at_y"})
    sample = as_volume(volume).trilinear if trilinear else as_volume(volume).nearest
    if how is None:
        points = offset(top, F.lit(float(layer))) if layer else top.withColumns({f"p{c}": F.col(c) for c in "xyz"})
        return sample(points.select("pixel", "at_x", "at_y", "px", "py", "pz"), "pixel").select(F.col("at_x").alias("px"), F.col("at_y").alias("py"), "v")
    steps = how.steps(layer)
    k = F.posexplode(F.array(*map(F.lit, steps))).alias("k", "w")
    rays = top.select("*", k)
    rays = offset(rays, F.col("w").cast("double")).withColumn("sample", F.col("pixel") * len(steps) + F.col("k"))
    points = rays.select("sample", "pixel", "at_x", "at_y", "k", "px", "py", "pz")
    return composite(sample(points, "sample"), ["at_x", "at_y"], "k", "v", how).select(F.col("at_x").alias("px"), F.col("at_y").alias("py"), "v")


def outline(top: DataFrame, target: tuple[int, int, int]) -> DataFrame:
    """(px, py, r, g, b) where the surface is within 2 voxels of the target's x (blue), else y (red), else z (green)."""
    near = [F.abs(F.col(c) - F.lit(float(t))) < 2.0 for c, t in zip("xyz", target, strict=True)]
    pick = lambda rgb: F.when(near[0], rgb[0]).when(near[1], rgb[1]).otherwise(rgb[2])
    return top.where(near[0] | near[1] | near[2]).select("px", "py", pick((0, 255, 0)).alias("r"), pick((0, 0, 255)).alias("g"), pick((255, 0, 0)).alias("b"))


def uv_to_xyz(points: DataFrame, triangles: DataFrame, surface: Surface, grid: Grid, key: str) -> DataFrame:
    """`points` (key, u, v, w in surface pixels) with x, y, z (int) of the first face that holds them, else -1.

    Faces are tried cell by cell of `grid`; a point lies in one cell, so the first is the least face of its cell.
    Points meet faces in bins of pixels as wide as a face is on the mean, so only faces near a point are tried; a face
    that does not touch the point's cell is none of them.
    """
    ut, vt = F.col("u") / float(surface.width), surface.v(F.col("v") / float(surface.height))
    faces = surface.pixel_corners(triangles)
    ends = {a: (F.least(*[F.col(f"p{a}{k}") for k in (1, 2, 3)]), F.greatest(*[F.col(f"p{a}{k}") for k in (1, 2, 3)])) for a in "uv"}
    wide = faces.agg(*[F.avg(high - low).alias(a) for a, (low, high) in ends.items()]).first()
    size = {a: max(1, round(wide[a] or 1)) for a in "uv"}
    bin_of = lambda c, a: F.floor(c / F.lit(size[a]))
    at = points.select(key, "u", "v", "w", grid.view_cell(ut, 0).alias("cell0"), grid.view_cell(vt, 1).alias("cell1"), bin_of(F.col("u"), "u").alias("bin0"), bin_of(F.col("v"), "v").alias("bin1"))
    for k, a in enumerate("uv"):
        low, high = bounds(f"t{a}")
        faces = faces.withColumns({f"low{k}": grid.cell(low, k), f"high{k}": grid.cell(high, k)}).withColumn(f"bin{k}", F.explode(F.sequence(bin_of(ends[a][0], a), bin_of(ends[a][1], a))))
    met = faces.join(at, ["bin0", "bin1"]).where("cell0 between low0 and high0 and cell1 between low1 and high1")
    w = _weights(F.col("u"), F.col("v"))
    met = met.withColumns({f"w{k}": w[k] for k in range(3)}).where("w0 >= 0 and w1 >= 0 and w2 >= 0 and w0 + w1 + w2 > 0")
    n = lambda c: F.when(F.col("w") == 0, 0.0).otherwise(F.col(f"n{c}"))
    found = met.select(key, "w", "f", *_interpolated(("x", "y", "z", "nx", "ny", "nz")))
    found = found.select(key, "f", F.struct(*[to_i32(F.col(c) + F.col("w").cast("double") * n(c)).alias(c) for c in "xyz"]).alias("p"))
    first = found.groupBy(key).agg(F.min_by("p", "f").alias("p"))
    return points.join(first, key, "left").select(*points.columns, *[F.coalesce(F.col(f"p.{c}"), F.lit(-1)).alias(c) for c in "xyz"])


def last_request(rows: DataFrame, by: str, order: str, cols: list[str]) -> DataFrame:
    """Rows that differ in `cols` from the row before."""
    w = Window.partitionBy(by).orderBy(order)
    same = F.lit(True)
    for c in cols:
        same = same & F.lag(c).over(w).eqNullSafe(F.col(c))
    return rows.withColumn("_same", same & (F.row_number().over(w) > 1)).where("not _same").drop("_same")


def writers(requests: DataFrame, pixel: list[str], order: str) -> DataFrame:
    """(pixel, last, first): which request wrote each pixel last, and which first."""
    return requests.groupBy(*pixel).agg(F.max(order).alias("last"), F.min(order).alias("first"))


def render_layers(triangles: DataFrame, volume: Volume | DataFrame, surface: Surface, window: Window2D, grid: Grid, layers: list[int], trilinear: bool = False) -> DataFrame:
    """(w, px, py, v): one painted image for each layer; the mesh is rasterised once for all of them."""
    top = top_pixels(raster(triangles, surface, window, grid)).withColumnsRenamed({"px": "at_x", "py": "at_y"})
    rays = offset(top.withColumn("w", F.explode(F.array(*map(F.lit, layers)))), F.col("w").cast("double"))
    key = F.struct("w", "pixel").alias("sample") if trilinear else F.lit(0).alias("sample")
    points = rays.withColumn("pixel", F.col("at_y") * window.width + F.col("at_x")).select(key, "w", "at_x", "at_y", "px", "py", "pz")
    sample = as_volume(volume).trilinear if trilinear else as_volume(volume).nearest
    return sample(points, "sample").select("w", F.col("at_x").alias("px"), F.col("at_y").alias("py"), "v")
