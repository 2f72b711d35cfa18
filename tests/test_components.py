import random

from voxelframe.operators.components import connected_components
from voxelframe.operators.lattice import numbered, voxel_components
from voxelframe.plans.tables import Tables


def plain(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(parent)}


def check(spark, edges):
    got = connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), Tables(spark))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(dict(rows)) and dict(rows) == plain(edges)


def test_chain_star_and_random(spark):
    check(spark, [(i, i + 1) for i in range(60)])
    check(spark, [(7, i) for i in range(40)] + [(100, 101)])
    rng = random.Random(2)
    check(spark, [(rng.randrange(150), rng.randrange(150)) for _ in range(110)])


def test_loops_with_and_without_other_edges(spark):
    check(spark, [(1, 1), (2, 2), (2, 1), (9, 9), (5, 4), (5, 5)])


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint"), Tables(spark)).count() == 0


def test_background_and_numbers(spark):
    rows = [(0, 0, 0, 1), (1, 0, 0, 1), (3, 0, 0, 1), (4, 0, 0, 0), (3, 1, 0, 2)]
    vox = spark.createDataFrame(rows, "x int, y int, z int, v int")
    got = {(r.x, r.y, r.z): r.component for r in voxel_components(vox, (10, 10, 10), background=0).collect()}
    assert got == {(0, 0, 0): 0, (1, 0, 0): 0, (3, 0, 0): 3, (3, 1, 0): 13}
    ids = {(r.x, r.y): r.id for r in numbered(voxel_components(vox, (10, 10, 10)), 1).collect()}
    assert ids == {(0, 0): 3, (1, 0): 3, (3, 0): 1, (4, 0): 1, (3, 1): 1}
