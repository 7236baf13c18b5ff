import __spark_entry__ as entry


def test_entry_and_names(spark):
    row = entry.entry(spark).collect()
    assert len(row) == 1 and row[0].n_nodes > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
