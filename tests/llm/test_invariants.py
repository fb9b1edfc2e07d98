import pytest

from millrace.llm.queries import QUERIES

from ..conftest import SMALL

STEADY = ("p2_found", "p2_splits", "p3_found", "p3_sample", "p4_found", "p5_found", "p6_sample", "p7_found", "p8_found", "p9_copies", "p10_pieces")


def rows(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


@pytest.mark.parametrize("name", STEADY)
def test_same_result_for_any_number_of_partitions(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        got = []
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append(rows(QUERIES[name](spark, SMALL)))
        assert got[0] == got[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_no_posting_in_two_splits(spark):
    from pyspark.sql import functions as F

    s = QUERIES["p2_splits"](spark, SMALL)
    assert s.groupBy("posting_id").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0
    found = QUERIES["p2_found"](spark, SMALL).join(s.select("posting_id", "split").distinct(), "posting_id")
    assert found.groupBy("group_company").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0


def test_pieces_under_the_limit(spark):
    p = QUERIES["p10_pieces"](spark, SMALL)
    assert p.filter("n_tokens > 1024").count() == 0
