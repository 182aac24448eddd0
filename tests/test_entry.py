import __spark_entry__ as entry


def test_every_query_with_sql_exists():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


def test_flagship(spark, sf_dir):
    df = entry.entry(spark)
    assert df.columns == ["vec_id", "label", "similarity"]
    assert df.count() == 10
