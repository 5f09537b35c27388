"""Every query against its DuckDB twin."""

import pytest

from tallyvault.operators import search
from tallyvault.plans import queries
from tallyvault.plans.testbed import inventory
from tests.conftest import compared


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_its_sql(spark, sf_dir, duck, name):
    ours, theirs = compared(queries.queries()[name](spark, sf_dir), duck, queries.oracle_sql()[name])
    assert ours == theirs


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_source_queries(spark, sf_dir):
    tree, hashes = (queries.queries()[n](spark, sf_dir) for n in ("discover_tree", "hash_files"))
    assert hashes.count() == tree.filter("kind = 'FILE'").count() > 0


def test_a_clustered_store_finds_the_same(spark, sf_dir):
    plain = search.page(inventory(spark, sf_dir), queries.CLUSTERED).collect()
    assert queries.queries()["search_clustered"](spark, sf_dir).collect() == plain and len(plain) > 1
