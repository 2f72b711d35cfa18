"""Relations of the voxel model derived from plain tables: a volume, a pyramid, sample points and a mesh.

They stand in for scans: one `embeddings` row is one 4-cube of voxels, an `events` row one sample point.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.num import idiv
from .tables import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(x, y, z, label, v): 0 to 255 from the components of each embedding."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "e"))
    v = F.least(F.greatest((F.col("e").cast("double") + 1.0) * 127.5, F.lit(0.0)), F.lit(255.0)).cast("int")
    i, n = F.col("i"), F.col("vec_id")
    return e.select(((n % 10) * 4 + i.bitwiseAND(3)).alias("x"), ((idiv(n, 10) % 10) * 4 + F.shiftright(i, 2).bitwiseAND(3)).alias("y"), (idiv(n, 100) * 4 + F.shiftright(i, 4)).alias("z"), "label", v.alias("v"))


def pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(level, x, y, z, v) with holes: level 0 lacks labels 0 to 2, level 1 lacks label 0."""
    vox = voxels(spark, sf_dir)
    at = lambda c: F.call_function("shiftright", F.col(c), F.col("level")).alias(c)
    rows = vox.withColumn("level", F.explode(F.array(*map(F.lit, range(4))))).withColumn("step", F.call_function("shiftleft", F.lit(1), F.col("level")))
    whole = (F.col("x") % F.col("step") == 0) & (F.col("y") % F.col("step") == 0) & (F.col("z") % F.col("step") == 0)
    hole = ((F.col("level") == 0) & (F.col("label") <= 2)) | ((F.col("level") == 1) & (F.col("label") == 0))
    return rows.where(whole & ~hole).select("level", at("x"), at("y"), at("z"), "v")


def _cubes(voxels: DataFrame, level: int, edge: int) -> DataFrame:
    """(level, cx, cy, cz, data): voxels as cubes of `edge` with a byte for each voxel, x fastest."""
    byte = F.lpad(F.hex(F.col("v")), 2, "0")
    cell = F.struct(((F.col("z") % edge * edge + F.col("y") % edge) * edge + F.col("x") % edge).alias("i"), byte.alias("b"))
    data = F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list(cell)), lambda c: c.b), ""))
    return voxels.groupBy(*[idiv(F.col(c), edge).alias(f"c{c}") for c in "xyz"]).agg(data.alias("data")).select(F.lit(level).alias("level"), "cx", "cy", "cz", "data")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The volume as 4-cubes."""
    return _cubes(voxels(spark, sf_dir), 0, 4)


def chunk_levels(spark: SparkSession, sf_dir: str, edges: tuple[int, ...] = (4, 2, 1, 1)) -> DataFrame:
    """The pyramid as chunks: one embedding's voxels are one chunk of the first three levels."""
    rows, out = pyramid(spark, sf_dir), None
    for level, edge in enumerate(edges):
        part = _cubes(rows.where(F.col("level") == level), level, edge)
        out = part if out is None else out.unionByName(part)
    return out


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, px, py, pz): sample points inside the volume."""
    e = table(spark, sf_dir, "events")
    part = lambda k: F.pmod(F.col("value") * k, F.lit(1.0))
    return e.select("event_id", ((F.col("event_id") * 7) % 39 + F.pmod(F.col("value"), F.lit(1.0))).alias("px"), ((F.col("user_id") * 5) % 39 + part(3)).alias("py"), ((F.col("event_id") * 3) % 19 + part(7)).alias("pz"))


def vertices(spark: SparkSession, sf_dir: str = "") -> DataFrame:
    """(i, u, v, x, y, z, nx, ny, nz): a height field of 21 x 21 vertices with unit normals."""
    i = F.col("id")
    r, c = idiv(i, 21), i % 21
    a, b = (c % 3).cast("double") - 1.0, (r % 3).cast("double") - 1.0
    n = F.sqrt(a * a + b * b + 16.0)
    bump = ((c * 7 + r * 3) % 11 - 5).cast("double") * 0.5
    return spark.range(441).select(i.alias("i"), (c / F.lit(20.0)).alias("u"), (r / F.lit(20.0)).alias("v"), (1 + c * F.lit(1.85)).alias("x"), (1 + r * F.lit(1.85)).alias("y"), (9.5 + bump).alias("z"), (a / n).alias("nx"), (b / n).alias("ny"), (4.0 / n).alias("nz"))


def faces(spark: SparkSession, sf_dir: str = "") -> DataFrame:
    """(f, v1, v2, v3): 800 triangles; texture and normal indices equal the vertex indices."""
    f = F.col("id")
    h, cell = f % 2, idiv(f, 2)
    r, c = idiv(cell, 20), cell % 20
    return spark.range(800).select(f.alias("f"), (r * 21 + c + h).alias("v1"), F.when(h == 0, r * 21 + c + 1).otherwise((r + 1) * 21 + c + 1).alias("v2"), ((r + 1) * 21 + c).alias("v3"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(segment_id, scroll_id, num, is_fragment, width): a catalogue."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("segment_id"), F.col("lang").alias("scroll_id"), F.col("source").alias("num"), (F.col("doc_id") % 7 == 0).alias("is_fragment"), F.col("n_chars").alias("width"))
