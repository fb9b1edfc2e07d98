from pyspark.sql import functions as F

from millrace.llm import sampling


def test_category(spark):
    ways = {"salary": "salary", "SALARY ": "salary", "Salary + Deadline": "salary+deadline", "deadline+salary": "salary+deadline", "salary_deadline": "salary+deadline", " deadline": "deadline", "Plain": "plain", None: None, "": None, "other": None}
    df = spark.createDataFrame([(k,) for k in ways], "c string").select("c", sampling.category(F.col("c"), ("salary", "deadline"), "plain").alias("s"))
    assert {r.c: r.s for r in df.collect()} == ways


def rows(spark, n=20_000):
    return spark.range(n).select(F.col("id").cast("string").alias("pid"), F.lit("g").alias("grp"),
                                 F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 100 == 1, "b").when(F.col("id") == 2, "c").when(F.col("id") % 5 == 1, None).otherwise("d").alias("stratum"))


def test_stratified(spark):
    df = rows(spark)
    have = {r.stratum: r.n for r in df.groupBy("stratum").agg(F.count("*").alias("n")).collect()}
    targets = spark.createDataFrame([("g", "a", 0.5, 0.2, 3), ("g", "b", 0.05, 0.2, 3), ("g", "c", 0.0, 0.2, 3), ("g", "d", 0.45, 0.2, 3), ("h", "a", 1.0, 0.5, 4)], "grp string, stratum string, share double, sample_share double, min_rows int")
    sample, report = sampling.stratified_sample(df, targets, id_col="pid", group="grp", stratum="stratum")
    got = {r.stratum: r.n for r in sample.groupBy("stratum").agg(F.count("*").alias("n")).collect()}
    assert got == {"a": 2000, "b": have["b"] if have["b"] < 200 else 200, "c": 1, "d": 1800}
    assert sample.select("id").distinct().count() == sample.count()
    unmet = {(r.grp, r.stratum): round(r.deficit, 6) for r in report.filter("unmet").collect()}
    assert unmet[("g", "c")] == 2 and unmet[("h", "a")] == 4 and ("g", "a") not in unmet
    again, _ = sampling.stratified_sample(df.repartition(9), targets, id_col="pid", group="grp", stratum="stratum")
    assert {r.id for r in again.collect()} == {r.id for r in sample.collect()}


def test_stratified_empty(spark):
    targets = spark.createDataFrame([("g", "a", 1.0, 0.5, 2)], "grp string, stratum string, share double, sample_share double, min_rows int")
    sample, report = sampling.stratified_sample(rows(spark).limit(0), targets, id_col="pid", group="grp", stratum="stratum")
    assert sample.count() == 0 and report.first().unmet and report.first().deficit == 2


def test_consistent_sample(spark):
    ids = spark.range(20_000).select(F.col("id").cast("string").alias("p"), F.lit("x").alias("id"), F.lit(9).alias("weight"))
    first = sampling.consistent_sample(ids.limit(8000), "p", 0.1)
    chosen = {r.id for r in first.filter("selected").collect()}
    assert 700 < len(chosen) < 900
    later = sampling.consistent_sample(ids.unionByName(ids).repartition(11), "p", 0.1, store=first)
    assert chosen <= {r.id for r in later.filter("selected").collect()} and later.count() == 20_000


def test_weights_never_fall(spark):
    a = spark.createDataFrame([("1", 5.0), ("2", None), ("3", -1.0), (None, 1.0)], "p string, w double")
    first = sampling.consistent_sample(a, "p", 0.2, F.col("w"))
    b = spark.createDataFrame([("1", 0.1), ("2", 0.5)], "p string, w double")
    later = {r.id: r.weight for r in sampling.consistent_sample(b, "p", 0.2, F.col("w"), store=first).collect()}
    assert later == {"1": 5.0, "2": 0.5, "3": 0.0}
    assert sampling.consistent_sample(a.limit(0), "p", 0.5).count() == 0


def test_short_acceptance_is_topped_up(spark):
    """Where independent draws accept fewer than wanted, the next draws make up the count."""
    small = spark.range(400).select(F.col("id").cast("string").alias("pid"), (F.col("id") % 40).cast("string").alias("grp"), F.lit("a").alias("stratum"))
    targets = small.select("grp").distinct().select("grp", F.lit("a").alias("stratum"), F.lit(1.0).alias("share"), F.lit(0.1).alias("sample_share"), F.lit(1).alias("min_rows"))
    sample, report = sampling.stratified_sample(small, targets, id_col="pid", group="grp", stratum="stratum", seed="t")
    assert sample.groupBy("grp").count().filter("count = 1").count() == 40 and report.filter("unmet").count() == 0
    assert sampling._first_by_draw(sample.limit(0).select(F.col("id"), F.col("grp"), "stratum", F.lit(0.5).alias("u"), F.lit(1).alias("cell")), spark.createDataFrame([("1", "a", 2)], "grp string, stratum string, wanted long")).count() == 0
