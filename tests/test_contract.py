import __spark_entry__ as contract


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() == 1112 and "verdict" in df.columns


def test_every_oracle_has_a_query():
    queries, oracles = contract.queries(), contract.oracle_sql()
    assert set(oracles) <= set(queries)
    ours = {name for name in queries if not name.startswith("op") and name != "pipeline"}
    assert ours <= set(oracles)
