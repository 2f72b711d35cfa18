"""Every operator of the voxel model as a query over whole driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions.num import idiv
from ..operators import catalog, composite, intersect, lattice, mesh, sample, slices, surface_map
from ..sources import volumes
from ..streaming import arrivals
from . import demand, fixtures
from .tables import Tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


#: The views, surface and render that the queries show.
VIEW = slices.View((20, 20, 10), 32, 32)
WIDE_VIEW = slices.View((20, 20, 10), 40, 40)
SURFACE = mesh.Surface(120, 120)
WINDOW = mesh.Window2D((60, 60, 0), 120, 120)
RENDER = demand.Render(120, 120, 30, 34, 32, 48, chunk=4)
AFFINE: mesh.Affine = ((0.5, 0.25, 0.0, 3.0), (-0.25, 0.5, 0.125, 1.0), (0.0, 0.5, 2.0, -4.0))
UV, XYZ = ("tu", "tv"), ("x", "y", "z")
#: Fixed rows: stand-ins for registered volumes.
VOLUMES = [(f"src{k}", f"Volume {k}", ("tiles", "ome", "zarr", "cells", "layers")[k % 5], ("local", "remote")[k % 2], f"https://data.example.org/volume-{k}/") for k in range(0, 20, 2)]
ZARRAY = '{"chunks":[64,64,32],"compressor":{"blocksize":0,"clevel":5,"cname":"lz4","id":"blosc","shuffle":1},"dtype":"|u1","fill_value":0,"filters":null,"order":"C","shape":[1000,900,800],"zarr_format":2,"dimension_separator":"/"}'
ZATTRS = '{"multiscales":[{"axes":[{"name":"z","type":"space"}],"datasets":[{"path":"0","coordinateTransformations":[{"type":"scale","scale":[1.0,1.0,1.0]}]},{"path":"1"},{"path":"2"},{"path":"3"},{"path":"4"}],"name":"scan","version":"0.4"}]}'


def triangles(spark: SparkSession) -> DataFrame:
    return mesh.wide(fixtures.vertices(spark), fixtures.faces(spark))


def uv_grid(tri: DataFrame) -> mesh.Grid:
    return mesh.Grid.over(tri, UV)


def chunk_pyramid(s: SparkSession, d: str) -> sample.ChunkPyramid:
    return sample.ChunkPyramid(fixtures.chunk_levels(s, d), (4, 2, 1, 1))


def r6(c: str) -> Column:
    return (F.round(c, 6) + 0.0).alias(c)  # no negative zero


@query
def voxel_decode(s: SparkSession, d: str) -> DataFrame:
    return fixtures.voxels(s, d).select("x", "y", "z", "v")


@query
def voxel_decode_chunks(s: SparkSession, d: str) -> DataFrame:
    chunks = fixtures.chunks(s, d)
    cell = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i")
    c = chunks.select("cx", "cy", "cz", "data", cell)
    i = F.col("i")
    return c.select((F.col("cx") * 4 + i % 4).alias("x"), (F.col("cy") * 4 + idiv(i, 4) % 4).alias("y"), (F.col("cz") * 4 + idiv(i, 16)).alias("z"), X.byte_at(F.col("data"), i).alias("v"))


@query
def sample_nearest(s: SparkSession, d: str) -> DataFrame:
    return sample.nearest(fixtures.points(s, d), fixtures.voxels(s, d)).select("event_id", "v")


@query
def sample_nearest_chunks(s: SparkSession, d: str) -> DataFrame:
    return sample.nearest_in_chunks(fixtures.points(s, d), fixtures.chunks(s, d), 4).select("event_id", "v")


@query
def sample_trilinear(s: SparkSession, d: str) -> DataFrame:
    return sample.trilinear_sample(fixtures.points(s, d), fixtures.voxels(s, d), "event_id").select("event_id", "v")


@query
def sample_trilinear_chunks(s: SparkSession, d: str) -> DataFrame:
    return sample.trilinear_in_chunks(fixtures.points(s, d), fixtures.chunks(s, d), "event_id", 4).select("event_id", "v")


@query
def sample_trilinear_strict(s: SparkSession, d: str) -> DataFrame:
    level0 = fixtures.pyramid(s, d).where("level = 0")
    return sample.trilinear_sample(fixtures.points(s, d), level0, "event_id", strict=True).select("event_id", "v")


@query
def sample_pyramid(s: SparkSession, d: str) -> DataFrame:
    return sample.nearest_pyramid(fixtures.points(s, d), fixtures.pyramid(s, d), "event_id").select("event_id", "v")


@query
def sample_pyramid_trilinear(s: SparkSession, d: str) -> DataFrame:
    return sample.trilinear_pyramid(fixtures.points(s, d), fixtures.pyramid(s, d), "event_id").select("event_id", "v")


@query
def sample_chunk_pyramid(s: SparkSession, d: str) -> DataFrame:
    return chunk_pyramid(s, d).nearest(fixtures.points(s, d), "event_id").select("event_id", "v")


@query
def sample_chunk_pyramid_trilinear(s: SparkSession, d: str) -> DataFrame:
    return chunk_pyramid(s, d).trilinear(fixtures.points(s, d), "event_id").select("event_id", "v")


@query
def volume_bounds(s: SparkSession, d: str) -> DataFrame:
    return sample.inside(fixtures.points(s, d), (30, 30, 15)).select("event_id", "inside")


@query
def tile_lookup(s: SparkSession, d: str) -> DataFrame:
    asks = fixtures.points(s, d).select("event_id", *[idiv(F.floor(f"p{c}"), 4).alias(f"c{c}") for c in "xyz"])
    tiles = fixtures.voxels(s, d).where("label < 5").groupBy(*[idiv(F.col(c), 4).alias(f"c{c}") for c in "xyz"]).agg(F.count("*").alias("n"))
    return asks.join(tiles, ["cx", "cy", "cz"], "left").select("event_id", F.when(F.col("n").isNull(), "Missing").otherwise("Loaded").alias("state"), F.coalesce("n", F.lit(0)).alias("n"))


@query
def slice_xy(s: SparkSession, d: str) -> DataFrame:
    return slices.slice_voxels(fixtures.voxels(s, d), VIEW)


@query
def slice_xz(s: SparkSession, d: str) -> DataFrame:
    return slices.slice_voxels(fixtures.voxels(s, d), slices.View(VIEW.centre, 32, 32, "XZ"))


@query
def slice_yz(s: SparkSession, d: str) -> DataFrame:
    return slices.slice_voxels(fixtures.voxels(s, d), slices.View(VIEW.centre, 32, 32, "YZ"))


@query
def slice_zoomed(s: SparkSession, d: str) -> DataFrame:
    return slices.slice_voxels(fixtures.voxels(s, d), slices.View(VIEW.centre, 32, 32, "XY", 2))


@query
def slice_generic(s: SparkSession, d: str) -> DataFrame:
    pix = slices.pixels(s, VIEW).select(F.col("px").alias("at_x"), F.col("py").alias("at_y"), *[F.col(c).cast("double").alias(f"p{c}") for c in "xyz"])
    return sample.nearest(pix, fixtures.voxels(s, d)).select(F.col("at_x").alias("px"), F.col("at_y").alias("py"), "v")


@query
def slice_multires(s: SparkSession, d: str) -> DataFrame:
    return slices.slice_levels(fixtures.pyramid(s, d), VIEW)


def views(s: SparkSession, d: str) -> DataFrame:
    """(event_id, u, v, zoom): a view for each sample point, with zooms from 1/16 to 4."""
    p = fixtures.points(s, d)
    return p.select("event_id", (F.floor("px") * 64).cast("double").alias("u"), (F.floor("py") * 64).cast("double").alias("v"), (F.pow(F.lit(2.0), (F.col("event_id") % 7 - 4).cast("double")) * F.when(F.col("event_id") % 3 == 0, 0.75).otherwise(1.0)).alias("zoom"))


@query
def view_tiles(s: SparkSession, d: str) -> DataFrame:
    return slices.visible_tiles(views(s, d), 800, 600).groupBy("event_id").agg(F.count("*").alias("n"), F.min("tile_x").alias("min_x"), F.max("tile_x").alias("max_x"), F.min("tile_y").alias("min_y"), F.max("tile_y").alias("max_y"))


@query
def zoom_levels(s: SparkSession, d: str) -> DataFrame:
    v = views(s, d)
    return v.select("event_id", X.paint_zoom(F.col("zoom")).alias("paint_zoom"), X.level_of(F.col("zoom")).alias("level"), X.level_of_downsampling((F.col("event_id") % 16 + 1).cast("int")).alias("scale"))


@query
def tile_rects(s: SparkSession, d: str) -> DataFrame:
    t = views(s, d).withColumns({"tile_x": F.col("event_id") % 5, "tile_y": F.col("event_id") % 3})
    out = slices.tile_rects(t, 800, 600)
    return out.select("event_id", *map(r6, ("left", "top", "right", "bottom")), slices.tile_centre("tile_x", "zoom").alias("cu"), slices.tile_centre("tile_y", "zoom").alias("cv"))


@query
def paint_alignment(s: SparkSession, d: str) -> DataFrame:
    n = (F.col("event_id") % 101 - 50).cast("bigint")
    return fixtures.table(s, d, "events").select("event_id", X.align_down(n, 4).alias("down"), X.align_up(n, 4).alias("up"))


@query
def pane_axes(s: SparkSession, d: str) -> DataFrame:
    rows = [(name, *axes) for name, axes in slices.PANES.items()]
    return s.createDataFrame(rows, "pane string, u int, v int, plane int")


@query
def contrast_filter(s: SparkSession, d: str) -> DataFrame:
    return fixtures.voxels(s, d).select("x", "y", "z", X.contrast(F.col("v"), 70, 60).alias("v"))


@query
def bitmask_quant(s: SparkSession, d: str) -> DataFrame:
    vox = fixtures.voxels(s, d)
    mask = X.bit_mask((F.col("x") % 10).cast("int"), (F.col("y") % 4).cast("int"))
    active = X.filters_active(F.col("z") % 2 == 0, F.col("x") % 3, F.lit(0), F.col("x") % 10, F.col("y") % 4)
    return vox.select("x", "y", "z", mask.alias("mask"), X.masked(F.col("v"), mask).alias("v"), active.alias("active"))


@query
def color_four(s: SparkSession, d: str) -> DataFrame:
    return fixtures.voxels(s, d).select("x", "y", "z", *[c.alias(n) for c, n in zip(X.four_colors(F.col("v") % 6), "rgb", strict=True)])


@query
def color_hsb(s: SparkSession, d: str) -> DataFrame:
    return fixtures.voxels(s, d).select("x", "y", "z", *[c.alias(n) for c, n in zip(X.component_color(F.col("v").cast("bigint")), "rgb", strict=True)])


@query
def high_byte(s: SparkSession, d: str) -> DataFrame:
    raw = (F.col("l_extendedprice").cast("int") % 65536).alias("raw")
    return fixtures.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", raw).withColumn("v", X.high_byte(F.col("raw")))


VERTEX = ("x", "y", "z", "nx", "ny", "nz")


@query
def affine_apply(s: SparkSession, d: str) -> DataFrame:
    return mesh.affine_apply(fixtures.vertices(s), AFFINE).select("i", *map(r6, VERTEX))


@query
def affine_inverse_roundtrip(s: SparkSession, d: str) -> DataFrame:
    there = mesh.affine_apply(fixtures.vertices(s), AFFINE)
    return mesh.affine_apply(there, mesh.affine_invert(AFFINE)).select("i", *map(r6, ("x", "y", "z")))


@query
def affine_inverse(s: SparkSession, d: str) -> DataFrame:
    rows = [(k, *map(float, row)) for k, row in enumerate(mesh.affine_invert(AFFINE))]
    return s.createDataFrame(rows, "row int, a double, b double, c double, d double").select("row", *map(r6, "abcd"))


@query
def normals_transform(s: SparkSession, d: str) -> DataFrame:
    return mesh.affine_apply(fixtures.vertices(s), AFFINE).select("i", F.round(F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2), 6).alias("length"), r6("nx"))


@query
def uv_normalise(s: SparkSession, d: str) -> DataFrame:
    v = fixtures.vertices(s).withColumns({"u": F.col("u") * 3.0 - 1.0, "v": F.col("v") * 0.5 + 7.0})
    return mesh.uv_normalise(v).select("i", r6("u"), r6("v"))


@query
def ortho_xz(s: SparkSession, d: str) -> DataFrame:
    return mesh.ortho_xz(fixtures.vertices(s)).select("i", r6("u"), r6("v"), "nx", "ny", "nz")


@query
def winding(s: SparkSession, d: str) -> DataFrame:
    plain = triangles(s)
    flipped = mesh.wide(fixtures.vertices(s).withColumn("v", 1.0 - F.col("v")), fixtures.faces(s))
    return mesh.is_inverted(plain).select(F.lit("plain").alias("mesh"), "winding").unionByName(mesh.is_inverted(flipped).select(F.lit("flipped").alias("mesh"), "winding"))


@query
def mesh_bounds(s: SparkSession, d: str) -> DataFrame:
    return triangles(s).select("f", *[r.alias(f"{n}_{a}") for a in XYZ for n, r in zip(("min", "max"), mesh.bounds(a), strict=True)])


@query
def mesh_wide(s: SparkSession, d: str) -> DataFrame:
    return triangles(s).select("f", *[r6(f"{c}{k}") for k in (1, 2, 3) for c in ("tu", "tv", "x", "y", "z")])


@query
def uv_bin_join(s: SparkSession, d: str) -> DataFrame:
    tri = triangles(s)
    p = fixtures.points(s, d).select("event_id", (F.col("px") / 40.0).alias("low_tu"), (F.col("py") / 40.0).alias("low_tv"))
    w = p.withColumns({"high_tu": F.col("low_tu") + 0.03, "high_tv": F.col("low_tv") + 0.02})
    return mesh.grid_range_join(tri, w, mesh.Grid.fitted(tri, UV, (0.03, 0.02)), UV, "event_id").select("event_id", "f")


@query
def xyz_bin_join(s: SparkSession, d: str) -> DataFrame:
    tri = triangles(s)
    w = fixtures.points(s, d).select("event_id", *[F.col(f"p{c}").alias(f"low_{c}") for c in "xyz"], *[(F.col(f"p{c}") + 1.5).alias(f"high_{c}") for c in "xyz"])
    return mesh.grid_range_join(tri, w, mesh.Grid.fitted(tri, XYZ, (1.5,) * 3), XYZ, "event_id").select("event_id", "f")


@query
def raster_pixels(s: SparkSession, d: str) -> DataFrame:
    tri = triangles(s)
    return mesh.raster(tri, SURFACE, WINDOW, uv_grid(tri)).select("px", "py", "f", "w0", "w1", "w2", *map(r6, VERTEX))


@query
def raster_zoomed(s: SparkSession, d: str) -> DataFrame:
    tri = triangles(s)
    return mesh.top_pixels(mesh.raster(tri, SURFACE, mesh.Window2D((70, 50, 0), 40, 30, 3), uv_grid(tri))).select("px", "py", "f", r6("x"), r6("y"))


@query
def uv_to_xyz(s: SparkSession, d: str) -> DataFrame:
    tri = triangles(s)
    p = fixtures.points(s, d).select("event_id", F.floor(F.col("px") * 3.2).alias("u"), F.floor(F.col("py") * 3.2).alias("v"), (F.col("event_id") % 7 - 3).alias("w"))
    return mesh.uv_to_xyz(p, tri, SURFACE, uv_grid(tri), "event_id").select("event_id", "x", "y", "z")


@query
def sync_target(s: SparkSession, d: str) -> DataFrame:
    at = QUERIES["uv_to_xyz"](s, d)
    return at.select("event_id", X.valid_target(F.col("x"), F.col("y"), F.col("z")).alias("valid"))


@query
def surface_render(s: SparkSession, d: str) -> DataFrame:
    tri = triangles(s)
    return mesh.render(tri, fixtures.voxels(s, d), SURFACE, WINDOW, uv_grid(tri))


@query
def surface_render_trilinear(s: SparkSession, d: str) -> DataFrame:
    tri = triangles(s)
    return mesh.render(tri, fixtures.voxels(s, d), SURFACE, mesh.Window2D((60, 60, 1), 120, 120), uv_grid(tri), trilinear=True)


@query
def surface_outline(s: SparkSession, d: str) -> DataFrame:
    tri = triangles(s)
    return mesh.outline(mesh.top_pixels(mesh.raster(tri, SURFACE, WINDOW, uv_grid(tri))), (20, 20, 10))


def _composited(s: SparkSession, d: str, how: composite.Composite) -> DataFrame:
    tri = triangles(s)
    return mesh.render(tri, fixtures.voxels(s, d), SURFACE, WINDOW, uv_grid(tri), how)


@query
def composite_max(s: SparkSession, d: str) -> DataFrame:
    return _composited(s, d, composite.Composite(composite.MAX))


@query
def composite_alpha(s: SparkSession, d: str) -> DataFrame:
    return _composited(s, d, composite.Composite(composite.ALPHA, opacity=200))


@query
def composite_alpha_reverse(s: SparkSession, d: str) -> DataFrame:
    return _composited(s, d, composite.Composite(composite.ALPHA, opacity=120, threshold=6000, reverse=True))


@query
def composite_height(s: SparkSession, d: str) -> DataFrame:
    return _composited(s, d, composite.Composite(composite.HEIGHT, opacity=100))


def _segments(s: SparkSession, view: slices.View = WIDE_VIEW) -> DataFrame:
    tri = triangles(s)
    return intersect.plane_segments(tri, view, mesh.Grid.over(tri, XYZ), (0.2, 0.2, 0.6, 0.6))


@query
def plane_mesh_segments(s: SparkSession, d: str) -> DataFrame:
    return _segments(s).select("f", *map(r6, ("u0", "v0", "u1", "v1")), "highlighted")


@query
def plane_mesh_segments_xz(s: SparkSession, d: str) -> DataFrame:
    return _segments(s, slices.View((20, 17, 10), 40, 40, "XZ")).select("f", *map(r6, ("u0", "v0", "u1", "v1")))


@query
def plane_mesh_raster(s: SparkSession, d: str) -> DataFrame:
    return intersect.colored(intersect.line_pixels(intersect.to_canvas(_segments(s), WIDE_VIEW), 40, 40))


@query
def vertex_markers(s: SparkSession, d: str) -> DataFrame:
    return intersect.markers(intersect.to_canvas(_segments(s), WIDE_VIEW), 40, 40)


def surface_px(s: SparkSession) -> DataFrame:
    """A 40 x 40 per-pixel map with empty pixels."""
    n = F.col("id")
    u, v = n % 40, idiv(n, 40)
    hole = (u + v) % 17 == 0
    part = lambda c: F.when(hole, 0.0).otherwise(c)
    return s.range(1600).select(u.alias("u"), v.alias("v"), part(u + 0.25).alias("x"), part(v + 0.5).alias("y"), part(((u * 3 + v) % 5) * 0.5 + 9.0).alias("z"), part(F.lit(0.125)).alias("nx"), part(F.lit(0.25)).alias("ny"), part(F.lit(0.875)).alias("nz"))


def map_points(s: SparkSession, d: str) -> DataFrame:
    return fixtures.points(s, d).select("event_id", F.col("px").alias("mu"), F.col("py").alias("mv"), ((F.col("event_id") % 11 - 5) * F.when(F.col("event_id") % 50 == 0, 10).otherwise(1)).cast("double").alias("mw"))


@query
def ppm_sample(s: SparkSession, d: str) -> DataFrame:
    return surface_map.sample_map(map_points(s, d), surface_px(s), fixtures.voxels(s, d), "event_id", 40, 40)


@query
def ppm_bilinear(s: SparkSession, d: str) -> DataFrame:
    return surface_map.sample_map(map_points(s, d), surface_px(s), fixtures.voxels(s, d), "event_id", 40, 40, bilinear=True)


@query
def uv_tiles(s: SparkSession, d: str) -> DataFrame:
    return demand.uv_tiles(s, RENDER)


@query
def tiles_per_layer(s: SparkSession, d: str) -> DataFrame:
    return demand.uv_tiles(s, RENDER).groupBy("w").agg(F.count("*").alias("n"))


def have(s: SparkSession, d: str) -> DataFrame:
    return fixtures.voxels(s, d).where("label < 5").select(*[idiv(F.col(c), 4).alias(f"c{c}") for c in "xyz"]).distinct()


@query
def chunk_demand(s: SparkSession, d: str) -> DataFrame:
    return demand.chunk_demand(triangles(s), SURFACE, RENDER)


@query
def chunk_missing(s: SparkSession, d: str) -> DataFrame:
    return demand.missing(demand.chunk_demand(triangles(s), SURFACE, RENDER), have(s, d))


@query
def chunk_union(s: SparkSession, d: str) -> DataFrame:
    return demand.after_download(demand.chunk_demand(triangles(s), SURFACE, RENDER), have(s, d))


@query
def layer_blit(s: SparkSession, d: str) -> DataFrame:
    tri = triangles(s)
    return mesh.render_layers(tri, fixtures.voxels(s, d), SURFACE, WINDOW, uv_grid(tri), [-1, 0, 1])


@query
def layer_blit_chunks(s: SparkSession, d: str) -> DataFrame:
    tri, whole = triangles(s), sample.ChunkPyramid(fixtures.chunks(s, d), (4,))
    return mesh.render_layers(tri, whole, SURFACE, WINDOW, uv_grid(tri), [-1, 0, 1])


@query
def catalog_group(s: SparkSession, d: str) -> DataFrame:
    g = catalog.by_scroll(fixtures.segments(s, d))
    return g.select("scroll_id", "is_fragment", "num", F.size("segments").cast("long").alias("n"), F.array_join(F.transform("segments", lambda x: x.cast("string")), ",").alias("segments"))


@query
def catalog_sort(s: SparkSession, d: str) -> DataFrame:
    return catalog.scrolls(fixtures.segments(s, d))


@query
def catalog_cached(s: SparkSession, d: str) -> DataFrame:
    files = fixtures.table(s, d, "labels").select(F.col("doc_id").alias("segment_id"))
    return catalog.cached(fixtures.segments(s, d), files)


@query
def catalog_table(s: SparkSession, d: str) -> DataFrame:
    seg = fixtures.segments(s, d)
    area = F.when(F.col("segment_id") % 5 != 0, F.col("width") / 1024.0)
    return seg.select("segment_id", X.scroll_label(F.col("is_fragment"), F.col("num"), F.col("scroll_id")).alias("label"), X.area_label(area).alias("area"))


@query
def volume_lookup(s: SparkSession, d: str) -> DataFrame:
    asks = fixtures.segments(s, d).select("segment_id", F.col("num").alias("volume_id"))
    return catalog.lookup(asks, catalog.registry(s, VOLUMES)).select("segment_id", "volume_id", "label", "format", "location")


@query
def volume_list(s: SparkSession, d: str) -> DataFrame:
    return catalog.listing(catalog.registry(s, VOLUMES))


@query
def volume_urls(s: SparkSession, d: str) -> DataFrame:
    c = fixtures.voxels(s, d).select(*[idiv(F.col(c), 4).cast("int").alias(f"c{c}") for c in "xyz"]).distinct()
    return c.withColumn("path", X.tile_path(F.col("cx"), F.col("cy"), F.col("cz"), F.lit(1)))


@query
def cache_hash(s: SparkSession, d: str) -> DataFrame:
    return fixtures.table(s, d, "pages").select("page_id", X.cache_name(F.col("url")).alias("name"))


@query
def crop_parse(s: SparkSession, d: str) -> DataFrame:
    e = fixtures.table(s, d, "events").select("event_id", F.when(F.col("event_id") % 9 == 0, "x").otherwise(F.format_string("%d+%d-%dx%d", F.col("event_id") % 100, F.col("user_id") % 50, F.lit(640), F.col("event_id") % 480)).alias("crop"))
    parts = X.crop_parts(F.col("crop"))
    return e.select("event_id", *[c.alias(n) for c, n in zip(parts, ("left", "top", "width", "height"), strict=True)], F.coalesce(parts[2], F.lit(1000)).alias("render_width"))


@query
def cell_name_parse(s: SparkSession, d: str) -> DataFrame:
    name = F.format_string("cell_yxz_%03d_%03d_%03d.tif", F.col("l_linenumber"), F.col("l_suppkey") % 30 + 1, F.col("l_partkey") % 20 + 1)
    return volumes.cell_grid(fixtures.table(s, d, "lineitem").select(name.alias("name")))


def listing(s: SparkSession, d: str) -> DataFrame:
    """(volume, name, content): the files of 60 volumes of all formats."""
    doc = F.col("doc_id")
    v, k = doc % 60, doc % 6
    name = F.when(k == 0, ".zattrs").when(k == 1, ".zarray").when(k == 2, F.format_string("cell_yxz_%03d_001_001.tif", doc % 500 + 1)).when(k == 3, F.format_string("%05d.tif", doc % 1000)).when(k == 4, F.lit("12345.png")).otherwise(F.lit("readme.txt"))
    content = F.when((k == 0) & (v % 4 != 0), '{"multiscales":[]}').when((k == 1) & (v % 3 != 0), '{"zarr_format":2}')
    return fixtures.table(s, d, "documents").select(v.alias("volume"), name.alias("name"), content.alias("content"))


@query
def format_sniff(s: SparkSession, d: str) -> DataFrame:
    return catalog.sniffed(listing(s, d), "volume", "name", "content")


@query
def json_meta(s: SparkSession, d: str) -> DataFrame:
    e = fixtures.table(s, d, "events").select("event_id", F.from_json("props", "k BIGINT").k.alias("k"), volumes.parsed_array(F.lit(ZARRAY)).alias("a"), volumes.level_paths(F.lit(ZATTRS)).alias("m"))
    levels = e.select("event_id", "k", "a", F.posexplode("m").alias("pos", "path"))
    chunk = F.get(F.col("a.chunks"), F.lit(2))
    return levels.select("event_id", "k", "pos", "path", F.col("a.compressor.cname").alias("codec"), chunk.alias("chunk"), X.n_blocks(F.get(F.col("a.shape"), F.lit(2)), chunk).alias("n_chunks"))


def classed(s: SparkSession, d: str) -> DataFrame:
    """The whole volume in seven classes of voxels."""
    return fixtures.voxels(s, d).select("x", "y", "z", (F.col("v") % 7).alias("v"))


@query
def components_volume(s: SparkSession, d: str) -> DataFrame:
    return lattice.voxel_components(classed(s, d), (40, 40, 1000)).select("x", "y", "z", "component")


@query
def component_sizes(s: SparkSession, d: str) -> DataFrame:
    return lattice.component_sizes(lattice.voxel_components(classed(s, d), (40, 40, 1000)), 5)


@query
def component_numbers(s: SparkSession, d: str) -> DataFrame:
    found = lattice.numbered(lattice.voxel_components(classed(s, d), (40, 40, 1000)), 5)
    return found.groupBy("component").agg(F.max("id").alias("id"), F.count("*").alias("n"))


@query
def point_cloud(s: SparkSession, d: str) -> DataFrame:
    return lattice.point_cloud(fixtures.voxels(s, d), 127)


@query
def morton_index(s: SparkSession, d: str) -> DataFrame:
    wide = fixtures.voxels(s, d).select((F.col("x") * 203).alias("x"), (F.col("y") * 203).alias("y"), (F.col("z") * 97).alias("z"), "v")
    return lattice.addressed(wide)


@query
def value_sum(s: SparkSession, d: str) -> DataFrame:
    return lattice.totals(fixtures.voxels(s, d))


@query
def cache_lru(s: SparkSession, d: str) -> DataFrame:
    return catalog.oldest_share(fixtures.table(s, d, "events"), "user_id", "event_id")


@query
def repeated_requests(s: SparkSession, d: str) -> DataFrame:
    e = fixtures.table(s, d, "events").select("event_id", "user_id", "event_type")
    return mesh.last_request(e, "user_id", "event_id", ["event_type"])


@query
def last_writer(s: SparkSession, d: str) -> DataFrame:
    p = fixtures.points(s, d).select(F.floor("px").alias("x"), F.floor("py").alias("y"), "event_id")
    return mesh.writers(p, ["x", "y"], "event_id")


@query
def download_states(s: SparkSession, d: str) -> DataFrame:
    now = arrivals.latest(arrivals.arrivals(fixtures.table(s, d, "events")))
    return now.withColumn("reload", arrivals.needs_reload(F.col("state")))


@query
def empty_volume(s: SparkSession, d: str) -> DataFrame:
    return sample.nearest(fixtures.points(s, d), fixtures.voxels(s, d).where(F.lit(False))).select("event_id", "v")


@query
def overlay_slice(s: SparkSession, d: str) -> DataFrame:
    base = slices.slice_voxels(fixtures.voxels(s, d), VIEW)
    over = slices.slice_voxels(fixtures.voxels(s, d).where("label = 3"), VIEW).withColumnRenamed("v", "o")
    return base.join(over, ["px", "py"], "left").select("px", "py", F.coalesce("o", "v").alias("v"), F.col("o").isNotNull().alias("overlaid"))


@query
def chunk_arrivals(s: SparkSession, d: str) -> DataFrame:
    schema = fixtures.table(s, d, "events").schema
    return arrivals.run_available(s, f"{d}/{{events}}.parquet", schema, Tables(s))  # as a pattern: a stream takes no single file
