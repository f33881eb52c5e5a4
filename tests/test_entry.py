import __spark_entry__ as entry


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.queries()["pipeline_pseudo"](spark, "/root/testdata/sf0.001").count() == 200
