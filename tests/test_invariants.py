"""What must hold between operators."""

from conftest import SF
from pyspark.sql import functions as F

from voxelframe.operators import mesh, sample
from voxelframe.plans import demand, fixtures
from voxelframe.plans import queries as q


def test_trilinear_at_whole_coordinates_is_nearest(spark):
    p = fixtures.points(spark, SF).select("event_id", *[F.floor(f"p{c}").cast("double").alias(f"p{c}") for c in "xyz"])
    vox = fixtures.voxels(spark, SF)
    a = sample.trilinear_sample(p, vox, "event_id").select("event_id", "v")
    assert a.exceptAll(sample.nearest(p, vox).select("event_id", "v")).count() == 0


def test_negative_points_count_as_zero(spark):
    p = spark.createDataFrame([(1, -3.5, -1.0, 2.0)], "event_id int, px double, py double, pz double")
    zero = p.select("event_id", F.lit(0.0).alias("px"), F.lit(0.0).alias("py"), "pz")
    vox = fixtures.voxels(spark, SF)
    assert sample.nearest(p, vox).first().v == sample.nearest(zero, vox).first().v


def test_max_is_at_least_every_layer(spark):
    one = q.QUERIES["layer_blit"](spark, SF).where("w = 1").select("px", "py", F.col("v").alias("one"))
    most = q.QUERIES["composite_max"](spark, SF)
    assert most.join(one, ["px", "py"]).where("v < one").count() == 0


def test_demand_covers_reads(spark):
    tri = q.triangles(spark)
    need = demand.chunk_demand(tri, q.SURFACE, q.RENDER).select("cx", "cy", "cz").distinct()
    top = mesh.top_pixels(mesh.raster(tri, q.SURFACE, q.WINDOW, q.uv_grid(tri)))
    read = mesh.offset(top, F.lit(2.0)).select(*[F.floor(F.col(f"p{c}") / 4).cast("bigint").alias(f"c{c}") for c in "xyz"]).distinct()
    assert read.join(need, ["cx", "cy", "cz"], "left_anti").count() == 0


def test_range_joins_are_equi_joins(spark):
    tri = q.triangles(spark)
    df = q.QUERIES["xyz_bin_join"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and tri is not None


def test_empty_tables(spark):
    vox = fixtures.voxels(spark, SF).where("false")
    p = fixtures.points(spark, SF).where("false")
    assert sample.trilinear_sample(p, vox, "event_id").count() == 0
    assert sample.nearest_pyramid(fixtures.points(spark, SF), vox.withColumn("level", F.lit(0)), "event_id").where("v <> 0").count() == 0
