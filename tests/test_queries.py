"""Every query of the voxel model against its SQL."""

import pytest
from conftest import SF

from voxelframe.plans import oracle
from voxelframe.plans import queries as plans


def rows_of(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def test_every_query_has_sql():
    assert set(plans.QUERIES) == set(oracle.SQL)


@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    answer = duck.execute(oracle.SQL[name])
    names = [c[0] for c in answer.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows_of(map(tuple, df.select(*columns).collect())) == rows_of(tuple(r[i] for i in at) for r in answer.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 14400
    assert set(plans.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
