"""Connected components of voxels, and exports of voxels as points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import page_address
from ..plans.tables import Tables
from .components import connected_components


RANGES = 4096


def voxel_components(voxels: DataFrame, shape: tuple[int, int, int], value: str = "v", background: int | None = None) -> DataFrame:
    """(x, y, z, <value>, component): voxels of equal value that touch face to face; a component is named by its least linear index.

    Each voxel looks for a neighbour on the higher side of each axis only: three equi-joins in one.
    """
    kept = voxels if background is None else voxels.where(F.col(value) != background)
    index = (F.col("z") * shape[1] + F.col("y")) * shape[0] + F.col("x")
    vox = kept.select(*[F.col(c).cast("bigint").alias(c) for c in "xyz"], value).withColumn("i", index.cast("bigint"))
    steps = F.array(*[F.struct(*[(F.col(c) + (1 if c == a else 0)).alias(c) for c in "xyz"]) for a in "xyz"])
    asks = vox.select(F.col("i").alias("b"), F.col(value).alias("_value"), F.explode(steps).alias("n")).select("b", "_value", "n.*")
    edges = asks.join(vox.select("x", "y", "z", value, F.col("i").alias("a")), ["x", "y", "z"]).where(F.col("_value") == F.col(value)).select("a", "b")
    found = connected_components(edges, Tables(voxels.sparkSession))
    return vox.join(found.withColumnRenamed("node", "i"), "i", "left").select("x", "y", "z", value, F.coalesce("root", "i").alias("component"))


def component_sizes(components: DataFrame, least: int = 0) -> DataFrame:
    return components.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > least)


def numbered(components: DataFrame, small: int) -> DataFrame:
    """`components` with an id: 1 for those of at most `small` voxels, the others counted on from 3 by name, at most 255 ids in use."""
    from pyspark.sql import Window

    tables = Tables(components.sparkSession)
    large = tables.cut(component_sizes(components).where(F.col("n") > small).select("component"))
    # a place by name is a prefix sum over ranges of names and a row number inside a range
    ends = large.agg(F.min("component").alias("low"), F.max("component").alias("high")).first()
    low, width = ends.low or 0, max(1, -(-((ends.high or 0) - (ends.low or 0) + 1) // RANGES))
    ranged = large.withColumn("range", F.floor((F.col("component") - low) / width))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranged.groupBy("range").agg(F.count("*").alias("n")).select("range", before.alias("before"))  # RANGES rows at most
    inside = F.row_number().over(Window.partitionBy("range").orderBy("component"))
    large = ranged.withColumn("k", inside).join(starts, "range").select("component", ((F.col("k") + F.col("before") + 2) % 256).cast("int").alias("id"))
    return components.join(large.select("component", "id"), "component", "left").withColumn("id", F.coalesce("id", F.lit(1)))


def totals(voxels: DataFrame) -> DataFrame:
    """(total, n_lit): the sum of the values and the number of voxels other than 0."""
    return voxels.agg(F.sum("v").alias("total"), F.sum((F.col("v") != 0).cast("long")).alias("n_lit"))


def point_cloud(voxels: DataFrame, threshold: int) -> DataFrame:
    """(part, x, y, z): voxels at or above the threshold go to part 1, others to part 2."""
    return voxels.select(F.when(F.col("v") >= threshold, 1).otherwise(2).alias("part"), "x", "y", "z")


def addressed(voxels: DataFrame) -> DataFrame:
    """`voxels` with their hierarchical address, the order of dense exports."""
    return voxels.withColumn("address", page_address(F.col("x"), F.col("y"), F.col("z")))


def write_dense(voxels: DataFrame, path: str, partitions: int | None = None) -> None:
    """Voxels range-partitioned and sorted by address, so a reader skips files by their address range."""
    rows = addressed(voxels)
    dealt = rows.repartitionByRange(partitions, "address") if partitions else rows.repartitionByRange("address")
    dealt.sortWithinPartitions("address").write.mode("overwrite").parquet(path)


def write_points(cloud: DataFrame, path: str) -> None:
    cloud.write.mode("overwrite").partitionBy("part").parquet(path)


def write_components(components: DataFrame, path: str, small: int) -> None:
    """The voxels of each component of more than `small` voxels in a folder of its own."""
    large = component_sizes(components, small).select("component")
    components.join(large, "component").select("component", "x", "y", "z").write.mode("overwrite").partitionBy("component").parquet(path)
