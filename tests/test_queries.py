import pytest

import oracle
from recollect import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert oracle.same(df.collect(), df.columns, oracle.database(SF).sql(queries.ORACLE_SQL[name]))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["memory_id", "score", "rank"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
