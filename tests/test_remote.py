"""Volumes behind a URL, and the batch render as one call and as a command."""

import json
import threading
from http.server import HTTPServer, SimpleHTTPRequestHandler

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_session import files, same  # noqa: F401
from test_sources import volume as noise
from test_sources import zarr

from voxelframe import render
from voxelframe.plans import queries as q
from voxelframe.plans.demand import Render
from voxelframe.session import Session
from voxelframe.sources import remote


@pytest.fixture
def served(tmp_path):
    """A server over a folder that counts what it is asked for."""
    asked = []

    class Handler(SimpleHTTPRequestHandler):
        def __init__(self, *args):
            super().__init__(*args, directory=str(tmp_path / "www"))

        def do_GET(self):
            asked.append(self.path)
            super().do_GET()

        def log_message(self, *_):
            pass

    (tmp_path / "www").mkdir()
    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield tmp_path / "www", f"http://127.0.0.1:{server.server_port}", asked
    server.shutdown()


def points(spark, shape, n=40):
    rng = np.random.default_rng(5)
    rows = [(k, *(float(x) for x in rng.uniform(0, np.array(shape[::-1]) - 1))) for k in range(n)]
    return spark.createDataFrame(rows, "k int, px double, py double, pz double"), rows


def test_pyramid_by_url(spark, served, tmp_path):
    """Chunks are fetched when they are asked for, once; those the server lacks are known as such; coarser levels fill in."""
    www, url, asked = served
    v = noise((8, 8, 16))
    zarr(www / "s/0", v, (8, 4, 4), "/", True)
    zarr(www / "s/1", np.ascontiguousarray(v[::2, ::2, ::2]), 4, ".", False)
    (www / "s/.zattrs").write_text(json.dumps({"multiscales": [{"datasets": [{"path": "0"}, {"path": "1"}]}]}))
    (www / "s/0/0/0/2").unlink()
    got = remote.RemoteVolume.open(spark, f"{url}/s/", str(tmp_path / "cache"), wait=0.01)
    assert got.kind == "ome" and got.edges == ((4, 4, 8), (4, 4, 4))
    p, rows = points(spark, v.shape)
    hole = lambda x, y: 8 <= x < 12 and y < 4
    want = {k: v[int(z) // 2 * 2, int(y) // 2 * 2, int(x) // 2 * 2] if hole(x, y) else v[int(z), int(y), int(x)] for k, x, y, z in rows}
    assert {r.k: r.v for r in got.pyramid().nearest(p, "k").collect()} == want and any(hole(r[1], r[2]) for r in rows)
    assert asked.count("/s/0/0/0/2") == 1 and {r.state for r in got.known().collect()} == {"Done", "Failed"}
    before = len(asked)
    assert {r.k: r.v for r in got.pyramid().nearest(p, "k").collect()} == want and len(asked) == before
    zarr(www / "s/0", v, (8, 4, 4), "/", True)  # the server has it now
    keys = spark.createDataFrame([(0, 2, 0, 0), (0, 0, 0, 0)], "level int, cx bigint, cy bigint, cz bigint")
    report = {r.state: (r.n, r.bytes) for r in got.fetch(keys, again=True).collect()}
    assert report["Done"][0] == 1 and report["Done"][1] > 0 and report["Failed"] == (0, 0)
    assert {r.k: r.v for r in got.pyramid().nearest(p, "k").collect()} == {k: v[int(z), int(y), int(x)] for k, x, y, z in rows}


def test_tiles_by_url(spark, served, tmp_path):
    www, url, _ = served
    v = noise((64, 64, 64))
    folder = www / "t/64-4/d01/z000"
    folder.mkdir(parents=True)
    (folder / "xyz-000-000-000-b255-d01.bin").write_bytes(v.reshape(16, 4, 16, 4, 16, 4).transpose(0, 2, 4, 1, 3, 5).tobytes())
    volume = Session(spark).open_volume(f"{url}/t", cache=str(tmp_path / "cache"), wait=0.01)
    p, rows = points(spark, v.shape)
    far = spark.createDataFrame([(99, 70.0, 0.0, 0.0)], p.schema)
    got = {r.k: r.v for r in volume.nearest(p.unionByName(far), "k").collect()}
    assert got == {k: v[int(z), int(y), int(x)] for k, x, y, z in rows} | {99: 0}


def test_mesh_by_url(spark, served, files, tmp_path):  # noqa: F811
    www, url, asked = served
    (www / "mesh.obj").write_bytes((files / "mesh.obj").read_bytes())
    s = Session(spark)
    for _ in range(2):
        opened = s.open_surface(f"{url}/mesh.obj", 120, 120, cache=str(tmp_path / "cache"))
    assert asked.count("/mesh.obj") == 1 and opened.triangles.count() == 800
    with pytest.raises(ValueError):
        remote.cached_file(spark, f"{url}/none.obj", str(tmp_path / "cache"))


def test_unreachable_servers_are_asked_again(spark, tmp_path):
    volume = remote.RemoteVolume(spark, "http://127.0.0.1:9", "tiles", str(tmp_path / "cache"), retries=0)
    keys = spark.createDataFrame([(0, 0, 0, 0)], "level int, cx bigint, cy bigint, cz bigint")
    assert {r.state: r.n for r in volume.fetch(keys).collect()} == {"Done": 0, "Delayed": 0, "Failed": 1}
    assert volume.known().count() == 0 and volume.fetch(keys.where("false")).where("n > 0").count() == 0


def test_batch_render(spark, served, files, tmp_path):  # noqa: F811
    """Tiles, demand, fetch, render and files from a URL give what the local volume gives, and no chunk is fetched in vain."""
    www, url, asked = served
    (www / "scan").symlink_to(files / "volume")
    s = Session(spark)
    surface = s.open_surface(f"{files}/mesh.obj", 120, 120)
    plan = Render(40, 50, 31, 33, 32, 16, 20, 30)
    volume = remote.RemoteVolume.open(spark, f"{url}/scan", str(tmp_path / "cache"), wait=0.01)
    report = {r.state: r.n for r in s.batch_render(volume, surface, plan, str(tmp_path / "a"), "tif", trilinear=False).collect()}
    need = s.needed(surface, Render(40, 50, 31, 33, 32, 16, 20, 30, chunk=20)).count()
    assert report["Done"] == need and sum("/scan/0" in a or "/scan/1" in a for a in asked) == need
    s.batch_render(s.open_volume(f"{files}/volume"), surface, plan, str(tmp_path / "b"), "tif", trilinear=False)
    args = ["--obj", f"{files}/mesh.obj", "--width", "120", "--height", "120", "--volume", f"{url}/scan", "--target-dir", str(tmp_path / "c"), "--target-format", "tif"]
    render.main([*args, "--min-layer", "31", "--max-layer", "33", "--crop", "20+30-40x50", "--tile-size", "16", "--data-directory", str(tmp_path / "cache"), "--nearest"], spark)
    for name in ("31.tif", "32.tif", "33.tif"):
        a, b, c = ((tmp_path / d / name).read_bytes() for d in "abc")
        assert a == b == c and len(set(a[-2000:])) > 10
    want = q.QUERIES["layer_blit"](spark, SF).where("w = 0 and px between 20 and 59 and py between 30 and 79")
    image = np.frombuffer(b"".join([(tmp_path / "a/32.tif").read_bytes()[-2000:]]), np.uint8).reshape(50, 40)
    assert all(image[r.py - 30, r.px - 20] == r.v for r in want.select("px", "py", F.col("v")).collect())


def test_command_line():
    with pytest.raises(SystemExit):
        render.parser().parse_args(["--obj", "m", "--width", "1", "--height", "1", "--volume", "v", "--target-dir", "t", "--crop", "1x2"])
    a = render.parser().parse_args(["--obj", "m", "--width", "1", "--height", "1", "--volume", "v", "--target-dir", "t", "--crop", "1+2-3x4"])
    assert a.crop == (1, 2, 3, 4) and (a.min_layer, a.max_layer, a.middle_layer, a.target_format, a.tile_size, a.retries) == (25, 41, 32, "png", 1024, 20)
