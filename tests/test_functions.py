"""Scalar functions and folds against plain restatements."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelframe.functions import expr as X
from voxelframe.functions import num
from voxelframe.operators import composite, intersect, mesh


def test_conversions(spark):
    rows = [(2.9,), (-2.9,), (3e10,), (-3e10,), (float("nan"),), (None,), (300.0,)]
    got = spark.createDataFrame(rows, "x double").select(num.to_i32(F.col("x")), num.to_u8(F.col("x")), num.to_index(F.col("x"))).collect()
    assert [tuple(r) for r in got] == [(2, 2, 2), (-2, 0, 0), (2147483647, 255, 30000000000), (-2147483648, 0, 0), (0, 0, 0), (None, None, None), (300, 255, 300)]


def test_page_address_is_injective(spark):
    corners = [0, 1, 15, 16, 255, 256, 4095, 8191]
    rows = [(x, y, z) for x in corners for y in corners for z in corners]
    got = spark.createDataFrame(rows, "x int, y int, z int").select(X.page_address(F.col("x"), F.col("y"), F.col("z")).alias("a")).distinct().count()
    assert got == len(rows)


def test_bit_mask(spark):
    rows = [(8, 0), (1, 0), (1, 7), (255, 0), (4, 2)]
    got = spark.createDataFrame(rows, "q int, s int").select(X.bit_mask(F.col("q"), F.col("s")).alias("m")).collect()
    assert [r.m for r in got] == [255, 128, 1, 255, 0xF0 >> 2]


def test_labels(spark):
    row = spark.range(1).select(X.area_label(F.lit(None).cast("double")), X.area_label(F.lit(1.25)), X.tile_path(F.lit(1), F.lit(22), F.lit(333), F.lit(2)), X.cache_name(F.lit("http://a/")), X.cache_name(F.lit("http://a"))).first()
    assert row[0] == "" and row[1] == "1.2" and row[2] == "64-4/d02/z333/xyz-001-022-333-b255-d02.bin" and row[3] == row[4]


def plain_fold(values, how):
    """The fold in 64-bit floats, step by step."""
    low, high = how.alpha_min / 255.0, how.alpha_max / 255.0
    alpha = value = depth = 0.0
    for a in values:
        x = min(max((a / 255.0 - low) / (high - low), 0.0), 1.0)
        if x != 0:
            w = (1.0 - alpha) * min(x * (how.opacity / 100.0), 1.0)
            value += w * (depth if how.mode == composite.HEIGHT else x)
            alpha += w
        depth += 1.0
        if x != 0 and alpha >= how.threshold / 10000.0:
            break
    if how.mode == composite.ALPHA:
        return int(min(max(value * 255.0, 0), 255))
    return 0 if alpha == 0 else int(min(max(255.0 - value / alpha * 255.0 / how.layers, 0), 255))


@pytest.mark.parametrize("mode", [composite.ALPHA, composite.HEIGHT])
@pytest.mark.parametrize("opacity, threshold", [(200, 9500), (30, 9500), (300, 100), (100, 0), (0, 9500)])
def test_fold(spark, mode, opacity, threshold):
    how = composite.Composite(mode, opacity=opacity, threshold=threshold)
    rng = np.random.default_rng(3)
    rays = [rng.integers(0, 256, how.layers).tolist() for _ in range(40)] + [[0] * how.layers, [255] * how.layers, [76] * how.layers]
    rows = [(r, k, int(v)) for r, ray in enumerate(rays) for k, v in enumerate(ray)]
    got = composite.composite(spark.createDataFrame(rows, "r int, k int, v int"), ["r"], "k", "v", how).collect()
    assert {r.r: r.v for r in got} == {r: plain_fold(ray, how) for r, ray in enumerate(rays)}


def test_steps():
    assert composite.Composite(in_front=2, behind=1).steps() == [2, 1, 0, -1]
    assert composite.Composite(in_front=2, behind=1, reverse=True).steps(5) == [3, 4, 5, 6]


def plain_line(x0, y0, x1, y1):
    """All pixels but the last, by the usual integer error."""
    dx, dy, sx, sy, out = abs(x1 - x0), -abs(y1 - y0), 1 if x0 < x1 else -1, 1 if y0 < y1 else -1, []
    e, x, y = dx + dy, x0, y0
    while (x, y) != (x1, y1):
        out.append((x, y))
        e2 = 2 * e
        if e2 >= dy:
            e, x = e + dy, x + sx
        if e2 <= dx:
            e, y = e + dx, y + sy
    return out


def test_lines(spark):
    rng = np.random.default_rng(1)
    ends = [tuple(map(int, rng.integers(0, 30, 4))) for _ in range(60)] + [(5, 5, 5, 5), (0, 0, 1, 0), (3, 9, 3, 2), (7, 7, 6, 6)]
    df = spark.createDataFrame([(k, *e) for k, e in enumerate(ends)], "k int, x0 bigint, y0 bigint, x1 bigint, y1 bigint")
    got = sorted((r.k, r.px, r.py) for r in intersect.line_pixels(df, 30, 30).collect())
    assert got == sorted((k, *p) for k, e in enumerate(ends) for p in plain_line(*e))


def test_affine_inverse():
    m = ((0.5, 0.25, 0.0, 3.0), (-0.25, 0.5, 0.125, 1.0), (0.0, 0.5, 2.0, -4.0))
    full = np.vstack([np.array(m), [0, 0, 0, 1]])
    assert np.allclose(np.array(mesh.affine_invert(m)), np.linalg.inv(full)[:3])
    with pytest.raises(ValueError):
        mesh.affine_invert(((1, 0, 0, 0), (2, 0, 0, 0), (0, 0, 1, 0)))


def test_few_faces_have_one_cell(spark):
    tri = spark.createDataFrame([(0, *[float(k) for k in range(6)])], "f int, tu1 double, tv1 double, tu2 double, tv2 double, tu3 double, tv3 double")
    assert mesh.Grid.over(tri, ("tu", "tv")).cells == 1
