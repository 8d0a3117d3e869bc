import pytest
from compare import assert_same

from codonflow.plans.queries import QUERIES, SQL

TOP = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    assert_same(QUERIES[name](spark, TOP), duck, SQL[name])


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_category_counts_at_sf001(spark):
    """The golden counts of the fixture design."""
    got = {r["category"]: r["n"] for r in QUERIES["label_stats"](spark, "/root/testdata/sf0.01").collect()}
    assert got == {"ir_only": 5303, "dropped_antisense_only": 1733, "dropped_ref_partial": 306, "dropped_not_contained": 218, "kept_single": 5998, "kept_multi": 1185}
