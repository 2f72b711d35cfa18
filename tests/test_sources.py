"""Readers and writers against files made here."""

import json
import struct
import threading
import zlib
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest

from voxelframe.operators import sample
from voxelframe.sources import codecs, meshes, remote, sinks, volumes


def volume(shape, seed=0):
    return np.random.default_rng(seed).integers(0, 256, shape, dtype=np.uint8)


@pytest.mark.parametrize("codec", ["lz4_raw", "zstd"])
def test_blosc_round_trip(codec):
    data = bytes(volume(70000)) + b"\0" * 100000
    packed = codecs.blosc_encode(data, 1 << 14, codec)
    assert codecs.blosc_decode(packed) == data and codecs.blosc_header(packed)["cbytes"] == len(packed)


def test_blosc_refuses():
    head = codecs.blosc_header(struct.pack("<4B3I", 2, 1, 0x21, 1, 125000000, 131072, 6881972))
    assert (head["flags"] >> 5, head["nbytes"], head["blocksize"], head["cbytes"]) == (1, 125000000, 131072, 6881972)
    with pytest.raises(ValueError):
        codecs.blosc_decode(struct.pack("<4B3I", 2, 1, 0x44, 1, 10, 10, 30))
    with pytest.raises(ValueError):
        codecs.blosc_decode(struct.pack("<4B3I", 2, 1, 0x60, 1, 10, 10, 30))


def test_blosc_memcpy_and_shuffle():
    body = bytes(range(64))
    assert codecs.blosc_decode(struct.pack("<4B3I", 2, 1, 2, 1, 64, 64, 80) + body) == body
    shuffled = np.frombuffer(body, np.uint8).reshape(-1, 4).T.tobytes()
    assert codecs.blosc_decode(struct.pack("<4B3I", 2, 1, 1 | 0x10 | 1 << 5, 4, 64, 64, 88) + struct.pack("<I", 20) + struct.pack("<I", 64) + shuffled) == body


def test_tiles(spark, tmp_path):
    v = volume((64, 64, 64))
    folder = tmp_path / "64-4/d01/z003"
    folder.mkdir(parents=True)
    blocks = v.reshape(16, 4, 16, 4, 16, 4).transpose(0, 2, 4, 1, 3, 5)  # z, y, x cubes
    (folder / "xyz-001-002-003-b255-d01.bin").write_bytes(blocks.tobytes())
    (folder / "xyz-001-002-004-b255-d01.bin").write_bytes(b"short")
    rows = volumes.read_tiles(spark, str(tmp_path), level=0).collect()
    assert [(r.level, r.cx, r.cy, r.cz) for r in rows] == [(0, 1, 2, 3)]
    assert bytes(rows[0].data) == v.tobytes()
    assert volumes.read_tiles(spark, str(tmp_path), {"x": range(0, 2), "y": range(2, 3)}, 0).count() == 1


def zarr(path, v, edge, sep, compress, fill_value=0, order="C"):
    """`edge` of all axes, or of z, y and x."""
    path.mkdir(parents=True, exist_ok=True)
    e = (edge,) * 3 if isinstance(edge, int) else edge
    (path / ".zarray").write_text(json.dumps({"chunks": list(e), "compressor": {"id": "blosc", "cname": "lz4"} if compress else None, "dtype": "|u1", "fill_value": fill_value, "filters": None, "order": order, "shape": list(v.shape), "zarr_format": 2, "dimension_separator": sep}))
    for z in range(0, v.shape[0], e[0]):
        for y in range(0, v.shape[1], e[1]):
            for x in range(0, v.shape[2], e[2]):
                f = path / sep.join(str(k // n) for k, n in zip((z, y, x), e, strict=True))
                f.parent.mkdir(parents=True, exist_ok=True)
                raw = v[z : z + e[0], y : y + e[1], x : x + e[2]].tobytes()
                f.write_bytes(codecs.blosc_encode(raw, 512) if compress else raw)


@pytest.mark.parametrize("sep, compress", [("/", True), (".", False)])
def test_zarr(spark, tmp_path, sep, compress):
    v = volume((8, 16, 24))
    zarr(tmp_path / "a", v, 8, sep, compress)
    chunks = volumes.read_zarr(spark, str(tmp_path / "a"))
    points = [(k, float(x), float(y), float(z)) for k, (x, y, z) in enumerate([(0, 0, 0), (23, 15, 7), (9, 3, 5), (24, 0, 0)])]
    p = spark.createDataFrame(points, "k int, px double, py double, pz double")
    got = {r.k: r.v for r in sample.nearest_in_chunks(p, chunks, 8).collect()}
    assert got == {0: v[0, 0, 0], 1: v[7, 15, 23], 2: v[5, 3, 9], 3: 0}
    assert volumes.read_zarr(spark, str(tmp_path / "a"), {"x": range(1, 3)}).count() == 4
    assert volumes.sniff(spark, str(tmp_path / "a")) == "zarr"


def test_zarr_refuses(spark, tmp_path):
    (tmp_path / ".zarray").write_text('{"dtype":"<u2"}')
    with pytest.raises(ValueError):
        volumes.read_zarr(spark, str(tmp_path))


def test_ome(spark, tmp_path):
    (tmp_path / ".zattrs").write_text(json.dumps({"multiscales": [{"datasets": [{"path": str(k)} for k in range(5)]}]}))
    for k in range(4):
        zarr(tmp_path / str(k), volume((8, 8, 8), k), 8, "/", True)
    assert sorted(r.level for r in volumes.read_ome(spark, str(tmp_path)).collect()) == [0, 1, 2, 3]
    assert volumes.sniff(spark, str(tmp_path)) == "ome"


def test_cells_and_layers(spark, tmp_path):
    v = (volume((3, 6, 6)).astype(np.uint16) << 8) | 7
    (tmp_path / "cells").mkdir()
    (tmp_path / "cells/cell_yxz_002_001_003.tif").write_bytes(codecs.tiff_encode(v))
    (tmp_path / "cells/cell_yxz_001_001_001.tif").write_bytes(codecs.tiff_encode(v.astype(np.uint8)))
    rows = volumes.read_cells(spark, str(tmp_path / "cells"), 6).collect()
    assert [(r.cx, r.cy, r.cz, bytes(r.data)) for r in rows] == [(0, 1, 2, (v >> 8).astype(np.uint8).tobytes())]
    assert volumes.sniff(spark, str(tmp_path / "cells")) == "cells"
    (tmp_path / "layers").mkdir()
    for z in range(3):
        (tmp_path / f"layers/{z:05}.tif").write_bytes(codecs.tiff_encode(v[z]))
    p = spark.createDataFrame([(0, 1.0, 2.0, 2.9), (1, 6.0, 0.0, 0.0), (2, 0.0, 0.0, 3.0)], "k int, px double, py double, pz double")
    got = {r.k: r.v for r in volumes.sample_layers(p, volumes.read_layers(spark, str(tmp_path / "layers"))).collect()}
    assert got == {0: v[2, 2, 1] >> 8, 1: 0, 2: 0}
    assert volumes.sniff(spark, str(tmp_path / "layers")) == "layers"


def test_obj(spark, tmp_path):
    text = "mtllib a.mtl\no first\nv 0 0 0\nv 1 0 0\nv 0 1 0.5\nvt 0 0\nvt 1 0\nvt 0 1\nvn 0 0 1\nusemtl m\nf 1/1/1 2/2/1 3/3/1\nf 3/3/1 2/2/1 1/1/1\no second\nv 9 9 9\nf 1/1/1 1/1/1 1/1/1\n"
    (tmp_path / "m.obj").write_text(text)
    obj = meshes.read_obj(spark, str(tmp_path / "m.obj"))
    assert {k: d.count() for k, d in obj.items()} == {"vert": 3, "tex": 3, "norm": 1, "face": 2}
    wide = {r.f: r for r in meshes.wide_obj(obj).collect()}
    assert (wide[0].x2, wide[0].z3, wide[0].tv3, wide[1].x1, wide[1].nz1) == (1.0, 0.5, 1.0, 0.0, 1.0)


def test_affine(spark, tmp_path):
    m = [[1, 0, 0, 5], [0, 2, 0, 6], [0, 0, 3, 7]]
    (tmp_path / "t.json").write_text(json.dumps({"transformation_matrix": m}))
    assert meshes.read_affine(spark, json.dumps(m)) == meshes.read_affine(spark, str(tmp_path / "t.json"))


def test_pixel_map(spark, tmp_path):
    values = np.random.default_rng(0).normal(size=(7, 5, 6))
    (tmp_path / "s.ppm").write_bytes(codecs.map_encode(values))
    rows = meshes.read_pixel_map(spark, str(tmp_path / "s.ppm"), 2).collect()
    assert len(rows) == 35 and all(tuple(r)[2:] == tuple(values[r.v, r.u]) for r in rows)


def test_layer_images(spark, tmp_path):
    v = volume((4, 3))
    rows = [(2, x, y, int(v[y, x])) for y in range(4) for x in range(3)] + [(2, 9, 9, 1), (11, 0, 0, 5)]
    pixels = spark.createDataFrame(rows, "w int, px int, py int, v int")
    sinks.write_files(sinks.layer_images(pixels, 3, 4, "tif"), str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["02.tif", "11.tif"]
    data = (tmp_path / "out/02.tif").read_bytes()
    tags = codecs.tiff_pages(data)[0]
    assert (np.frombuffer(data, np.uint8, 12, tags[codecs.OFFSETS][0]).reshape(4, 3) == v).all()
    png = {r.name: bytes(r.image) for r in sinks.layer_images(pixels, 3, 4).collect()}["02.png"]
    at = png.index(b"IDAT")
    size = struct.unpack(">I", png[at - 4 : at])[0]
    raw = np.frombuffer(zlib.decompress(png[at + 4 : at + 4 + size]), np.uint8).reshape(4, 4)
    assert (raw[:, 1:] == v).all() and (raw[:, 0] == 0).all()
    with pytest.raises(ValueError):
        sinks.layer_images(pixels, 3, 4, "jpeg")


@pytest.mark.parametrize("kind, most", [("png", 0), ("tif", 0), ("jpg", 12)])
def test_written_layers(spark, tmp_path, kind, most):
    """Strips of 16 lines, some of them absent, read back by another library; JPEG within a few grey levels."""
    y, x = np.mgrid[:70, :37]
    image = (128 + 60 * np.sin(x / 5) + 50 * np.cos(y / 7)).astype(np.uint8)
    image[32:48] = 0  # a strip without pixels
    rows = [(32, i, j, int(image[j, i])) for j in range(70) for i in range(37) if image[j, i]] + [(32, 37, 0, 1), (5, 3, 3, 200)]
    pixels = spark.createDataFrame(rows, "w int, px int, py int, v int").repartition(5)
    sinks.write_layers(pixels, 37, 70, str(tmp_path / "out"), kind, rows=16)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == [f"05.{kind}", f"32.{kind}"]
    jvm = spark.sparkContext._jvm
    read = jvm.javax.imageio.ImageIO.read(jvm.java.io.File(str(tmp_path / f"out/32.{kind}")))
    raster = read.getRaster()
    got = np.array([[raster.getSample(i, j, 0) for i in range(37)] for j in range(70)])
    assert (read.getWidth(), read.getHeight()) == (37, 70) and np.abs(got.astype(int) - image).max() <= (most if kind != "jpg" else 40)
    assert kind != "jpg" or np.abs(got[:30].astype(int) - image[:30]).mean() < 2
    with pytest.raises(ValueError):
        sinks.write_layers(pixels, 37, 70, str(tmp_path), "gif")


def test_fetch(spark, tmp_path):
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            if self.headers.get("Authorization") != remote.basic("u", "p"):
                code = 401
            else:
                code = 200 if self.path == "/a" or (self.path == "/busy" and asked.count("/busy") > 1) else 420 if self.path == "/busy" else 404
            self.send_response(code)
            self.end_headers()
            self.wfile.write(b"x" if code == 200 else b"")

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    requests = spark.createDataFrame([(0, 1, f"{base}/a"), (0, 2, f"{base}/a"), (0, 3, f"{base}/busy"), (0, 4, f"{base}/none"), (0, 5, None)], "level int, k int, url string")
    got = remote.fetch(requests, concurrency=2, authorization=remote.basic("u", "p"), wait=0.01)
    remote.store(got, str(tmp_path / "t"), ["level", "k"])
    rows = {r.k: (r.state, r.data and bytes(r.data)) for r in spark.read.parquet(str(tmp_path / "t")).collect()}
    assert rows[1] == rows[2] == rows[3] == ("Done", b"x") and rows[4] == ("Failed", None) and asked.count("/a") == 1
    assert remote.is_authorized(f"{base}/a", remote.basic("u", "p")) and not remote.is_authorized(f"{base}/a")
    server.shutdown()
    assert remote.get("http://127.0.0.1:9/", retries=0) == (0, None)


def test_write_chunks(spark, tmp_path):
    chunks = spark.createDataFrame([(0, 1, 2, 3, bytearray(b"a")), (1, 0, 0, 40, bytearray(b"b"))], "level int, cx int, cy int, cz int, data binary")
    sinks.write_chunks(chunks, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).where("level = 1 and slab = 2").count() == 1
