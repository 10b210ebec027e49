"""Every query of the choice models against DuckDB, and a run of those that SQL cannot express."""

import pytest
from conftest import same_rows

from prefero.plans import catalog

FITS = {"mnl_fit", "mdcev_fit", "mnp_fit", "mnp_random_fit", "morp_fit", "morp_lines_fit"}


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, sf_dir, name):
    same_rows(catalog.queries()[name](spark, sf_dir).toPandas(), duck.execute(catalog.oracle_sql()[name]).df(), 2e-6)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql()) - FITS))
def test_query_runs(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).count() > 0


@pytest.mark.parametrize("name", sorted(FITS))
def test_fits_converge(spark, sf_dir, name):
    rows = catalog.queries()[name](spark, sf_dir).toPandas()
    assert rows["converged"].all() and rows["iterations"].max() < 200 and rows["estimate"].notna().all()


def test_entry(spark, sf_dir):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
