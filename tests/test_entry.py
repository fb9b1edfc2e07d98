import __spark_entry__ as entry

from millrace.plans import registry


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["source", "stratum", "n"] and df.count() > 0


def test_registry():
    assert set(registry.ORACLES) <= set(registry.QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())
    assert len(registry.QUERIES) > 50
