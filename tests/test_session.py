"""The user's entry on files made here, against the operators on tables."""

import json

import numpy as np
import pytest
import zstandard
from conftest import SF
from pyspark.sql import functions as F
from test_sources import volume as noise
from test_sources import zarr

from voxelframe.operators import catalog, mesh, sample, slices
from voxelframe.operators.composite import Composite
from voxelframe.plans import fixtures
from voxelframe.plans import queries as q
from voxelframe.session import Session
from voxelframe.sources import codecs


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """The fixture volume as a Zarr array, a pyramid of it, and the fixture mesh as an OBJ file."""
    top = tmp_path_factory.mktemp("files")
    v = np.zeros((20, 40, 40), np.uint8)
    for r in fixtures.voxels(spark, SF).collect():
        v[r.z, r.y, r.x] = r.v
    zarr(top / "volume", v, 20, "/", True)
    zarr(top / "ome/0", v, 20, "/", True)
    zarr(top / "ome/1", np.ascontiguousarray(v[::2, ::2, ::2]), 10, "/", True)
    (top / "ome/.zattrs").write_text(json.dumps({"multiscales": [{"datasets": [{"path": "0"}, {"path": "1"}]}]}))
    vert, face = fixtures.vertices(spark).orderBy("i").collect(), fixtures.faces(spark).orderBy("f").collect()
    lines = [f"v {r.x!r} {r.y!r} {r.z!r}" for r in vert] + [f"vt {r.u!r} {r.v!r}" for r in vert] + [f"vn {r.nx!r} {r.ny!r} {r.nz!r}" for r in vert]
    lines += ["f " + " ".join(f"{k + 1}/{k + 1}/{k + 1}" for k in (r.v1, r.v2, r.v3)) for r in face]
    (top / "mesh.obj").write_text("\n".join(lines) + "\n")
    return top


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_render_from_files(spark, files):
    s = Session(spark, catalog.registry(spark, [("scan", "A scan", "zarr", "local", f"{files}/volume")]))
    assert s.list_volumes() == ["scan -> A scan"]
    volume, opened = s.open_volume("scan"), s.open_surface(f"{files}/mesh.obj", 120, 120)
    assert isinstance(volume, sample.Chunks) and opened.centre == (60, 60, 0) and opened.surface.inverted
    got = s.render_surface(volume, opened, range(31, 34))
    want = q.QUERIES["layer_blit"](spark, SF).withColumn("w", F.col("w") + 32)
    assert same(got.select("w", "px", "py", "v"), want.select("w", "px", "py", "v"))
    cut = s.render_surface(volume, opened, range(32, 33), crop=(20, 30, 40, 50))
    part = want.where("w = 32 and px between 20 and 59 and py between 30 and 79").select((F.col("px") - 20).alias("px"), (F.col("py") - 30).alias("py"), "v")
    assert same(cut.select("px", "py", "v"), part)
    how = Composite(opacity=200)
    assert same(s.render_surface(volume, opened, how=how).select("px", "py", "v"), q.QUERIES["composite_alpha"](spark, SF))
    s.save_layers(got, 120, 120, str(files / "out"))
    assert sorted(p.name for p in (files / "out").iterdir()) == ["31.png", "32.png", "33.png"]


def test_trilinear_layers(spark, files):
    s = Session(spark)
    volume, opened = s.open_volume(f"{files}/volume"), s.open_surface(f"{files}/mesh.obj", 120, 120)
    got = s.render_surface(volume, opened, range(33, 34), trilinear=True).select("px", "py", "v")
    assert same(got, q.QUERIES["surface_render_trilinear"](spark, SF))


def test_pyramid_from_files(spark, files):
    volume = Session(spark).open_volume(f"{files}/ome")
    p = fixtures.points(spark, SF)
    want = sample.nearest(p, fixtures.voxels(spark, SF)).select("event_id", "v")
    assert isinstance(volume, sample.ChunkPyramid) and "data" in volume.rows.columns and same(volume.nearest(p, "event_id").select("event_id", "v"), want)


def test_unequal_chunks_levels_and_fill_value(spark, tmp_path):
    """Chunks of 6 x 4 x 8 voxels, a fill value and another order in the metadata, and a second level where the first has holes."""
    v = noise((8, 12, 18))
    zarr(tmp_path / "o/0", v, (8, 4, 6), "/", True, fill_value=7, order="F")
    zarr(tmp_path / "o/1", np.ascontiguousarray(v[::2, ::2, ::2]), (4, 6, 3), ".", False)
    (tmp_path / "o/.zattrs").write_text(json.dumps({"multiscales": [{"datasets": [{"path": "0"}, {"path": "1"}]}]}))
    rng = np.random.default_rng(1)
    at = [tuple(float(x) for x in rng.uniform(0, (17, 11, 7))) for _ in range(60)]
    p = spark.createDataFrame([(k, *a) for k, a in enumerate(at)], "k int, px double, py double, pz double")
    plain = Session(spark).open_volume(f"{tmp_path}/o/0")
    assert plain.edge == (6, 4, 8)
    got = {r.k: r.v for r in plain.nearest(p, "k").collect()}
    assert got == {k: v[int(z), int(y), int(x)] for k, (x, y, z) in enumerate(at)}
    rows = [(x, y, z, int(v[z, y, x])) for z in range(8) for y in range(12) for x in range(18)]
    voxels = spark.createDataFrame(rows, "x int, y int, z int, v int")
    assert same(plain.trilinear(p, "k").select("k", "v"), sample.trilinear_sample(p, voxels, "k").select("k", "v"))
    (tmp_path / "o/0/0/1/2").unlink()  # z, y, x
    levels = Session(spark).open_volume(f"{tmp_path}/o")
    hole = lambda x, y, z: x >= 12 and 4 <= y < 8
    want = {k: v[int(z) // 2 * 2, int(y) // 2 * 2, int(x) // 2 * 2] if hole(x, y, z) else v[int(z), int(y), int(x)] for k, (x, y, z) in enumerate(at)}
    assert {r.k: r.v for r in levels.nearest(p, "k").collect()} == want and any(hole(*a) for a in at)


def test_layer_stack(spark, tmp_path):
    v = (noise((3, 300, 500)).astype(np.uint16) << 8) | 3
    for z in range(3):
        (tmp_path / f"{z:05}.tif").write_bytes(codecs.tiff_encode(v[z]))
    volume = Session(spark).open_volume(str(tmp_path))
    at = [(0, 0, 0), (499, 299, 2), (256, 255, 1), (255.5, 256.5, 0), (500, 0, 0), (0, 0, 3)]
    p = spark.createDataFrame([(k, *map(float, a)) for k, a in enumerate(at)], "k int, px double, py double, pz double")
    want = {k: v[int(z), int(y), int(x)] >> 8 if x < 500 and z < 3 else 0 for k, (x, y, z) in enumerate(at)}
    assert volume.edge == (256, 256, 1) and {r.k: r.v for r in volume.nearest(p, "k").collect()} == want


def test_own_volume(spark, files):
    """A volume of the user's own needs two methods."""

    class Ramp:
        def nearest(self, points, key):
            return points.withColumn("v", F.floor("px").cast("int"))

        trilinear = nearest

    s = Session(spark)
    opened = s.open_surface(f"{files}/mesh.obj", 120, 120)
    got = s.render_surface(Ramp(), opened, range(32, 33))
    tri = q.triangles(spark)
    want = mesh.top_pixels(mesh.raster(tri, q.SURFACE, q.WINDOW, q.uv_grid(tri))).select("px", "py", F.floor("x").cast("int").alias("v"))
    assert same(got.select("px", "py", "v"), want)


def test_transform_and_projection(spark, files):
    s = Session(spark)
    m = [[0, 1, 0, 2], [1, 0, 0, 3], [0, 0, 2, 4]]
    moved = s.open_surface(f"{files}/mesh.obj", 10, 10, json.dumps(m)).triangles
    plain = s.open_surface(f"{files}/mesh.obj", 10, 10).triangles
    both = moved.select("f", F.col("x1").alias("mx"), F.col("z2").alias("mz")).join(plain, "f")
    assert both.where("abs(mx - (y1 + 2)) > 1e-9 or abs(mz - (2 * z2 + 4)) > 1e-9").count() == 0
    flat = s.open_surface(f"{files}/mesh.obj", 10, 10, ortho_xz=True).triangles
    assert flat.where("ny1 <> 1 or nx1 <> 0").count() == 0 and flat.agg(F.min("tu1"), F.max("tu1")).first()[:] == (0.0, 1.0)


def test_segments(spark, files, tmp_path):
    record = {"id": "20230101", "scroll": {"id": "s", "num": "1", "isFragment": False}, "width": 120, "height": 120, "volume": {"volume": f"{files}/volume"}, "urls": {"objUrl": f"{files}/mesh.obj"}, "areaCm2": 1.5, "layers": ["a"], "labels": []}
    data = json.dumps([record, {**record, "id": "none", "volume": None}]).encode()
    (tmp_path / "c.json").write_bytes(data)
    (tmp_path / "c.json.zst").write_bytes(zstandard.compress(data))
    plain, packed = (catalog.flat(catalog.read_catalog(spark, f"{tmp_path}/c.json{end}")) for end in ("", ".zst"))
    assert same(plain, packed) and plain.count() == 2
    s = Session(spark, segments=plain)
    volume, opened = s.open_segment("20230101")
    assert opened.surface.width == 120 and volume.rows.count() == 4
    with pytest.raises(ValueError):
        s.open_segment("none")


def test_cancelled_views_end(spark):
    import threading
    import time

    s, ended = Session(spark), []

    def view():
        with s.cancellable("left pane"):
            try:
                spark.range(0, 1 << 40, 1, 4).selectExpr("sum(hash(id) % 7)").collect()
            except Exception as e:
                ended.append(e)

    thread = threading.Thread(target=view)
    thread.start()
    for _ in range(100):
        time.sleep(0.3)
        s.cancel("left pane")
        if not thread.is_alive():
            break
    thread.join(30)
    assert len(ended) == 1 and spark.range(3).count() == 3


def test_moves():
    r = ((0, 100), (0, 100), (0, 100))
    assert slices.scrolled((5, 5, 50), "XY", 1, 0.25, r) == (5, 5, 64)  # one step of 16, snapped
    assert slices.dragged((5, 5, 5), "XZ", -10, 400, 2.0, r) == (10, 5, 0)
    assert slices.zoomed(4.0, 4.0) == 8.0 and slices.zoomed(0.03, 0.1) == 0.025


def test_unknown_formats(spark, tmp_path):
    (tmp_path / "readme.txt").write_text("x")
    with pytest.raises(ValueError):
        Session(spark).open_volume(str(tmp_path))
    with pytest.raises(ValueError):
        mesh.affine_invert(((0, 0, 0, 0),) * 3)
