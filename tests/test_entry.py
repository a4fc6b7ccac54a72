import __spark_entry__ as e


def test_every_sql_has_its_query():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_runs(spark):
    df = e.entry(spark)
    assert df.count() > 0 and df.columns == ["query", "node_id", "score", "ordinal"]
