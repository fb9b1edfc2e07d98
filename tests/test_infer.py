import pytest
from pyspark.sql import functions as F

from millrace.operators import infer


def upper():
    def model(texts):
        if any("bad" in t for t in texts):
            raise ValueError("can't read")
        return [t.upper() for t in texts]
    return model


def test_generate(spark):
    rows = [(i, "x" * (i * 37 % 900) + ("bad" if i % 25 == 0 else "")) for i in range(200)] + [(999, None)]
    got = {r.id: r for r in infer.generate(spark.createDataFrame(rows, "k int, t string"), "k", "t", upper, parts=3).collect()}
    assert len(got) == 201 and got[999].output is None and got[999].error is None
    assert all((got[i].output == t.upper()) if "bad" not in t else ("can't read" in got[i].error) for i, t in rows if t is not None)


def test_batches_respect_the_budget():
    seen = []
    assert infer.robust(lambda ts: seen.append(len(ts)) or ts, ["a", "b"]) == [("a", None), ("b", None)] and seen == [2]
    calls = []

    def flaky(ts):
        calls.append(1)
        if len(calls) < 3:
            raise infer.Transient()
        return ts

    pauses = []
    assert infer.call(flaky, ["a"], sleep=pauses.append) == ["a"] and pauses == [2.0, 4.0]
    with pytest.raises(infer.Exhausted):
        infer.robust(lambda ts: (_ for _ in ()).throw(infer.Exhausted()), ["a", "b"])


def test_verdict(spark):
    cases = [("stop", None, "ok"), ("stop", "schema_error", "permanent"), ("length", None, "permanent"), ("length", "no_json", "permanent"), ("stop", "no_json", "transient"), ("STOP", "json_decode_error", "transient"),
             (None, None, "ok"), (None, "no_json", "transient"), ("", "schema_error", "permanent"), ("content_filter", None, "permanent")]
    df = spark.createDataFrame(cases, "f string, e string, want string")
    assert all(r.v == r.want for r in df.select("want", infer.verdict(F.col("f"), F.col("e")).alias("v")).collect())
    assert all(r.v == "ok" for r in df.select(infer.verdict(F.col("f"), F.col("e"), structured=False).alias("v")).collect())


def test_empty_and_instant(spark):
    df = spark.createDataFrame([(None, 0.0), ("  ", 0.01), ("x", 0.0), ("", 1.0)], "o string, s double")
    assert [r.v for r in df.select(infer.empty_and_instant(F.col("o"), F.col("s")).alias("v")).collect()] == [True, True, False, False]


def test_samples(spark):
    def factory(temperature, index):
        return lambda texts: [f"{t}/{temperature}/{index}" for t in texts]

    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, t string")
    got = sorted((r.id, r.sample_idx, r.output) for r in infer.sampled(df, "k", "t", factory, 3, 0.4).collect())
    assert got == [(1, 0, "a/0.0/0"), (1, 1, "a/0.4/1"), (1, 2, "a/0.4/2"), (2, 0, None), (2, 1, None), (2, 2, None)]
