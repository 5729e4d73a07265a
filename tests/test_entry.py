import __spark_entry__ as entry


def test_names_match():
    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names) and "rank_jobs" in names
