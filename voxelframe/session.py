"""The user's entry: open volumes and surfaces by name, path or segment, and render them."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import catalog, mesh
from .operators.composite import Composite
from .operators.sample import ChunkPyramid, Chunks, Volume
from .plans import demand
from .plans.demand import Render
from .plans.tables import folder, ship
from .sources import meshes, sinks, volumes
from .sources.remote import RemoteVolume, cached_file

EDGES = {"tiles": 64, "cells": 500}


@dataclass(frozen=True)
class OpenSurface:
    """A mesh with its image size; its centre and the ranges of u, v and the layer."""

    triangles: DataFrame
    surface: mesh.Surface
    grid: mesh.Grid

    @property
    def centre(self) -> tuple[int, int, int]:
        return self.surface.width // 2, self.surface.height // 2, 0

    @property
    def ranges(self) -> tuple[tuple[int, int], ...]:
        return (0, self.surface.width), (0, self.surface.height), (-40, 40)


class Session:
    """`volumes`: registered volumes (`catalog.REGISTRY_DDL`); `segments`: a flat catalogue (`catalog.flat`)."""

    def __init__(self, spark: SparkSession, volumes: DataFrame | None = None, segments: DataFrame | None = None) -> None:
        ship(spark)
        self.spark, self.volumes, self.segments = spark, volumes, segments

    def list_volumes(self) -> list[str]:
        return [r.line for r in catalog.listing(self.volumes).orderBy("line").collect()] if self.volumes is not None else []

    def open_volume(self, ref: str, ranges: volumes.Ranges | None = None, cache: str | None = None, authorization: str | None = None, **how) -> Volume:
        """A registered id, or the location of a volume whose format its files show; `ranges` of chunk keys to read.

        A location may be a URL: its chunks are fetched as they are asked for and kept in `cache`, a folder that all
        executors share (one below spark.checkpoint.dir by default).  `how`: concurrency, retries and wait of `fetch`.
        """
        known = self.volumes.where(F.col("id") == ref).first() if self.volumes is not None else None
        kind, place = (known.format, known.location) if known else (None, ref)
        if volumes.is_url(place):
            return RemoteVolume.open(self.spark, place, cache or f"{folder(self.spark)}/volumes", kind, authorization, **how).pyramid()
        kind = kind or volumes.sniff(self.spark, place)
        if kind == "ome":
            edges = [volumes.edges(volumes.array_definition(self.spark, p)) for p in volumes.pyramid_paths(self.spark, place)]
            return ChunkPyramid(volumes.read_ome(self.spark, place, ranges=ranges), tuple(edges))
        if kind == "layers":
            return Chunks(volumes.tiled_layers(volumes.read_layers(self.spark, place)), (volumes.LAYER_TILE, volumes.LAYER_TILE, 1))
        if kind == "zarr":
            return Chunks(volumes.read_zarr(self.spark, place, ranges), volumes.edges(volumes.array_definition(self.spark, place)))
        return Chunks(volumes.read_volume(self.spark, kind, place), EDGES[kind])

    def open_surface(self, obj: str, width: int, height: int, transform: str | None = None, invert: bool = False, ortho_xz: bool = False, cache: str | None = None, authorization: str | None = None) -> OpenSurface:
        """An OBJ file, by place or URL, as a surface of `width` x `height` pixels, moved by an affine transform (or its inverse) first."""
        if volumes.is_url(obj):
            obj = cached_file(self.spark, obj, cache or f"{folder(self.spark)}/volumes", authorization)
        parts = meshes.read_obj(self.spark, obj)
        if transform:
            m = meshes.read_affine(self.spark, transform)
            m = mesh.affine_invert(m) if invert else m
            zero = [F.lit(0.0).alias(c) for c in ("nx", "ny", "nz")]
            parts["vert"] = mesh.affine_apply(parts["vert"].select("*", *zero), m).select("i", "x", "y", "z")
            parts["norm"] = mesh.affine_apply(parts["norm"].select("*", *[F.lit(0.0).alias(c) for c in "xyz"]), m).select("i", "nx", "ny", "nz")
        if ortho_xz:
            flat = parts["vert"].select("i", "x", "y", "z", *[F.lit(0.0).alias(c) for c in ("u", "v", "nx", "ny", "nz")])
            if parts["tex"].count() != flat.count():
                raise ValueError("vertices and texture coordinates differ in number")
            parts["tex"] = mesh.ortho_xz(flat).select("i", "u", "v")
            parts["norm"] = parts["norm"].select("i", F.lit(0.0).alias("nx"), F.lit(1.0).alias("ny"), F.lit(0.0).alias("nz"))
        else:
            parts["tex"] = mesh.uv_normalise(parts["tex"])
        tri = meshes.wide_obj(parts)
        return OpenSurface(tri, mesh.Surface(width, height, bool(mesh.is_inverted(tri).first().winding)), mesh.Grid.over(tri, ("tu", "tv")))

    def open_segment(self, segment_id: str) -> tuple[Volume, OpenSurface]:
        """The volume and the surface of a catalogued segment that has both."""
        row = catalog.openable(self.segments).where(F.col("segment_id") == segment_id).first()
        if row is None:
            raise ValueError(f"no segment {segment_id} with a volume")
        return self.open_volume(row.volume_id), self.open_surface(row.obj_url, row.width, row.height)

    def render_surface(self, volume: Volume, opened: OpenSurface, layers: range = range(25, 42), middle: int = 32, crop: tuple[int, int, int, int] | None = None, how: Composite | None = None, trilinear: bool = False) -> DataFrame:
        """(w, px, py, v): images of the surface's layers, `middle` being the surface itself; crop is (left, top, width, height).

        With `how`, one composited image with w = `middle`.
        """
        left, top, width, height = crop or (0, 0, opened.surface.width, opened.surface.height)
        window = mesh.Window2D((left + width // 2, top + height // 2, 0), width, height)
        if how:
            image = mesh.render(opened.triangles, volume, opened.surface, window, opened.grid, how, trilinear)
            return image.select(F.lit(middle).alias("w"), "px", "py", "v")
        out = mesh.render_layers(opened.triangles, volume, opened.surface, window, opened.grid, [w - middle for w in layers], trilinear)
        return out.withColumn("w", F.col("w") + middle)

    def save_layers(self, images: DataFrame, width: int, height: int, folder: str, kind: str = "png") -> None:
        """A file for each layer of (w, px, py, v): png, tif or jpg."""
        sinks.write_layers(images, width, height, folder, kind)

    @contextmanager
    def cancellable(self, name: str) -> Iterator[None]:
        """What this thread runs inside may be cancelled by `cancel(name)` from another thread."""
        context = self.spark.sparkContext
        context.addJobTag(name)
        try:
            yield
        finally:
            context.removeJobTag(name)

    def cancel(self, name: str) -> None:
        """Ends the running jobs of a view that is no longer looked at; their actions raise."""
        self.spark.sparkContext.cancelJobsWithTag(name)

    def needed(self, opened: OpenSurface, plan: Render) -> DataFrame:
        """(level, cx, cy, cz): the finest level's chunks that a render reads, each once."""
        need = demand.chunk_demand(opened.triangles, opened.surface, plan).select("cx", "cy", "cz").distinct()
        return need.select(F.lit(0).alias("level"), "cx", "cy", "cz")

    def batch_render(self, volume: Volume | RemoteVolume, opened: OpenSurface, plan: Render, folder: str, kind: str = "png", how: Composite | None = None, trilinear: bool = True) -> DataFrame | None:
        """Plans the chunks of all tiles, fetches those that are missing, renders the layers and writes their files.

        Returns the report of what was fetched (state, n, bytes) for a volume behind a URL.
        """
        report = None
        if isinstance(volume, RemoteVolume):
            plan = replace(plan, chunk=volume.edges[0])
            report = volume.fetch(self.needed(opened, plan))
            volume = volume.pyramid()
        layers = range(plan.first_layer, plan.last_layer + 1)
        crop = (plan.left, plan.top, plan.width, plan.height)
        images = self.render_surface(volume, opened, layers, plan.middle, crop, how, trilinear)
        self.save_layers(images, plan.width, plan.height, folder, kind)
        return report

    @staticmethod
    def plan(width: int, height: int, **parts) -> Render:
        return Render(width, height, **parts)
