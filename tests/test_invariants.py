import pytest

from millrace.plans import registry

from .conftest import SMALL

STEADY = ("corpus_strata", "near_duplicate_links", "deduplicated", "quota_sample", "grouped_split", "scalar_votes", "set_votes", "bootstrap_replicates", "length_percentiles", "p1_found", "capped_minority")


def rows(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


@pytest.mark.parametrize("name", STEADY)
def test_same_result_for_any_number_of_partitions(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        got = []
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append(rows(registry.QUERIES[name](spark, SMALL)))
        assert got[0] == got[1] and got[0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_cleaning_is_idempotent(spark):
    from pyspark.sql import functions as F

    from millrace.functions import text as tx

    once = registry.QUERIES["clean_text"](spark, SMALL)
    assert once.filter(tx.clean_text(F.col("text")) != F.col("text")).count() == 0


def test_groups_stay_whole_and_all_rows_are_split(spark):
    split = registry.QUERIES["grouped_split"](spark, SMALL)
    assert split.count() == split.select("k").distinct().count()


def test_long_pay_text():
    from millrace.operators import units

    read = units.UnitParser(units.PAY).read
    assert read("x" * 50_000 + " USD 50,000 a year", "text") == (50000.0, {"currency": "USD", "period": "yearly"})
