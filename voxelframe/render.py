"""The batch render as a command: an OBJ surface through a volume, one image file for each layer.

    python -m voxelframe.render --obj mesh.obj --width 9000 --height 7000 --volume https://host/scan.zarr --target-dir out
"""

from __future__ import annotations

import argparse
import re

from pyspark.sql import SparkSession

from .operators.composite import ALPHA, HEIGHT, MAX, Composite
from .plans.demand import Render
from .plans.tables import folder
from .session import Session
from .sources import volumes
from .sources.remote import RemoteVolume, basic


def crop(text: str) -> tuple[int, int, int, int]:
    """left, top, width and height from <left>+<top>-<width>x<height>."""
    m = re.fullmatch(r"(\d+)\+(\d+)-(\d+)x(\d+)", text)
    if not m:
        raise argparse.ArgumentTypeError("a crop is <left>+<top>-<width>x<height>, as in 1000+1000-500x500")
    return tuple(map(int, m.groups()))  # type: ignore[return-value]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="voxelframe.render", description="Renders the layers of a surface through a volume.")
    p.add_argument("--obj", required=True, help="mesh file")
    p.add_argument("--width", type=int, required=True, help="width of the surface in pixels")
    p.add_argument("--height", type=int, required=True, help="height of the surface in pixels")
    p.add_argument("--volume", "-v", required=True, help="location or URL of the volume, or its id in --registry")
    p.add_argument("--registry", help="Parquet table of registered volumes")
    p.add_argument("--target-dir", required=True, help="folder for the images")
    p.add_argument("--target-format", default="png", choices=("png", "tif", "jpg"))
    p.add_argument("--transform", help="affine transform: a file, or a 3 x 4 matrix as JSON")
    p.add_argument("--invert-transform", action="store_true")
    p.add_argument("--ortho-xz", action="store_true", help="texture coordinates by a projection along y")
    p.add_argument("--min-layer", type=int, default=25)
    p.add_argument("--max-layer", type=int, default=41)
    p.add_argument("--middle-layer", type=int, default=32, help="layer of the surface itself")
    p.add_argument("--crop", type=crop, help="<left>+<top>-<width>x<height>")
    p.add_argument("--tile-size", type=int, default=1024)
    p.add_argument("--data-directory", "-d", help="cache for fetched chunks, shared by all executors")
    p.add_argument("--concurrent-downloads", type=int, default=32)
    p.add_argument("--retries", type=int, default=20)
    p.add_argument("--user")
    p.add_argument("--password", default="")
    p.add_argument("--nearest", action="store_true", help="no interpolation between voxels")
    p.add_argument("--composite", choices=(MAX, ALPHA, HEIGHT), help="one composited image instead of layers")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("voxelframe render").getOrCreate()
    registry = spark.read.parquet(a.registry) if a.registry else None
    session = Session(spark, registry)
    row = registry.where(registry.id == a.volume).first() if registry is not None else None
    place, kind = (row.location, row.format) if row else (a.volume, None)
    if volumes.is_url(place):
        login = basic(a.user, a.password) if a.user else None
        cache = a.data_directory or f"{folder(spark)}/volumes"
        volume = RemoteVolume.open(spark, place, cache, kind, login, concurrency=a.concurrent_downloads, retries=a.retries)
    else:
        volume = session.open_volume(a.volume)
    surface = session.open_surface(a.obj, a.width, a.height, a.transform, a.invert_transform, a.ortho_xz)
    left, top, width, height = a.crop or (0, 0, a.width, a.height)
    plan = Render(width, height, a.min_layer, a.max_layer, a.middle_layer, a.tile_size, left, top)
    report = session.batch_render(volume, surface, plan, a.target_dir, a.target_format, Composite(a.composite) if a.composite else None, not a.nearest)
    for r in report.collect() if report is not None else []:
        print(f"{r.state}: {r.n} chunks, {r.bytes} bytes")


if __name__ == "__main__":
    main()
