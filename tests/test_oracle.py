"""Every query that has SQL gives the same rows as that SQL."""

import pytest

from codelode.plans import catalog

from . import oracle


@pytest.fixture(scope="module")
def duck(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_as_sql(spark, sf_dir, duck, name):
    got = catalog.QUERIES[name](spark, sf_dir).toPandas()
    want = duck.sql(catalog.ORACLE[name]).df()
    assert oracle.rows(got) == oracle.rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_gives_rows(spark, sf_dir, name):
    """What they hold is tested in test_no_sql.py. In the smallest tables no package imports another."""
    got = catalog.QUERIES[name](spark, sf_dir)
    assert got.columns and (got.count() > 0) == (name not in ("gr12_package_cycles", "agg17_package_edges"))
