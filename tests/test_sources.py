import json

import pytest
from pyspark.sql import functions as F

from millrace.sources import files
from millrace.streaming import incremental


def test_logs(spark, tmp_path):
    p = tmp_path / "log.jsonl"
    p.write_text('{"posting_id": "a"}\n\n{"posting_id": "b", "x": 1}\n{"posting_id": "c\n{"y": 2}\n{"posting_id": "a"}\n')
    assert sorted(r.posting_id for r in files.logged_ids(spark, str(p), "posting_id").collect()) == ["a", "b"]
    q = tmp_path / "ex.json"
    q.write_text(json.dumps([{"a": 1}, {"a": 2}]))
    assert files.read_examples(spark, str(q), "a int", 1).count() == 1 and files.read_examples(spark, str(q), "a int", 0).count() == 0
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "none"), "a int").count()


def test_merge_and_append(spark, tmp_path):
    a = spark.createDataFrame([("1", "old", 1), ("2", "bulk", 2)], "id string, v string, at int")
    g = spark.createDataFrame([("1", "gold", 0)], "id string, v string, at int")
    b = spark.createDataFrame([("2", "later", 1), (None, "x", 1)], "id string, v string, at int")
    assert {r.id: (r.v, r.is_gold) for r in files.merge_inputs([a, b], [g], "id", "at").collect()} == {"1": ("gold", True), "2": ("later", False)}
    out = str(tmp_path / "log")
    assert files.append_new(a, out, "id") == 2 and files.append_new(a.unionByName(spark.createDataFrame([("3", "n", 1)] * 2, a.schema)), out, "id") == 1
    assert spark.read.parquet(out).count() == 3


def test_cache_splits_runs(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(5)

    for _ in range(2):
        assert files.build_cached(spark, str(tmp_path / "c"), {"n": 5}, build).count() == 5
    assert len(calls) == 1
    rows = spark.createDataFrame([("a", "train"), ("b", "test"), ("c", "test")], "id string, split string")
    files.write_splits(rows, str(tmp_path / "s"), form="parquet")
    assert files.read_split(spark, str(tmp_path / "s"), "test", 1, "id").first().id == "b"
    files.write_splits(rows, str(tmp_path / "j"))
    files.write_manifest(rows, "id", str(tmp_path / "ids"))
    assert [r.value for r in spark.read.text(str(tmp_path / "ids")).collect()] == ["a", "b", "c"]
    metrics = spark.createDataFrame([("f1", 0.5)], "metric string, value double")
    files.write_run(str(tmp_path / "run"), "ours", {"k": 1}, metrics, rows)
    label, tables = files.load_run(spark, f"a=b={tmp_path}/run")
    assert label == "a=b" and tables["metrics"].first().value == 0.5
    for bad in ("nolabel", "=x", f"x={tmp_path}/absent"):
        with pytest.raises((ValueError, FileNotFoundError)):
            files.load_run(spark, bad)
    assert "| f1 | 0.5 |" in files.markdown(metrics, "Metrics")


def test_settings(tmp_path):
    p = tmp_path / ".env"
    p.write_text("# c\nKEY='v'\nTOKEN=PASTE_HERE\nexport N=12\nBAD=x\n")
    s = files.load_settings(str(p), {"KEY": "env"})
    assert s == {"KEY": "env", "N": "12", "BAD": "x"} and files.whole_number(s, "N", 1) == 12 and files.whole_number(s, "M", 1) == 1
    with pytest.raises(ValueError):
        files.whole_number(s, "BAD", 1)
    assert files.resolve("", None, "d") == "d" and files.resolve("f", "s", "d") == "f"


def test_options(tmp_path):
    from dataclasses import dataclass

    @dataclass
    class O(files.Options):
        rank: int = 8

    p = tmp_path / "o.json"
    p.write_text('{"_note": "x", "rank": 16}')
    assert O.from_json(str(p)).rank == 16
    p.write_text('{"rnk": 16}')
    with pytest.raises(ValueError):
        O.from_json(str(p))


def test_streams(spark, tmp_path):
    src, out, at = (str(tmp_path / x) for x in ("in", "out", "at"))
    spark.range(10).select("id", (F.col("id") % 3).alias("k")).write.parquet(src)
    schema = spark.read.parquet(src).schema

    def go():
        return incremental.resume(incremental.file_stream(spark, src, schema, 1), "id", lambda b: b.withColumn("y", F.col("id") * 2), out, at)

    q = go()
    assert spark.read.parquet(out).count() == 10 and sum(p["rows"] for p in incremental.progress(q)) == 10
    spark.range(5, 15).select("id", (F.col("id") % 3).alias("k")).write.mode("append").parquet(src)
    go()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(15))
    stream = lambda n=None: incremental.file_stream(spark, src, schema, n)
    table = str(tmp_path / "l")
    for _ in range(2):
        incremental.latest(stream(1), "k", F.col("id"), table, str(tmp_path / "lat"), buckets=4)
        assert {r.k: r.id for r in incremental.latest_rows(spark, table).collect()} == {0: 12, 1: 13, 2: 14}
    spark.range(20, 21).select("id", F.lit(1).cast("long").alias("k")).write.mode("append").parquet(src)
    incremental.latest(stream(1), "k", F.col("id"), table, str(tmp_path / "lat"), buckets=4)
    assert {r.k: r.id for r in incremental.latest_rows(spark, table).collect()} == {0: 12, 1: 20, 2: 14}
    versions = [len(list(b.glob("_v=*"))) for b in (tmp_path / "l").glob("_b=*")]
    assert versions and max(versions) <= 2


def test_resume_with_watermark(spark, tmp_path):
    src, out, at = (str(tmp_path / x) for x in ("in", "out", "at"))
    spark.range(10).select((F.col("id") % 5).alias("id"), F.timestamp_seconds(F.col("id")).alias("ts")).write.parquet(src)
    stream = incremental.file_stream(spark, src, spark.read.parquet(src).schema, 1)
    incremental.resume(stream, "id", lambda b: b, out, at, "ts", "1 hour")
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3, 4]


def test_cache(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v string, n int")
    assert files.append_new(rows(("a", "1", 1), ("b", "2", 2), ("a", "1", 1)), log, "k") == 2
    assert files.append_new(rows(("a", "9", 3), ("c", "3", 4)), log, "k") == 1
    assert files.append_new(rows(("a", "9", 3)), log, "k") == 0
    rows(("a", "9", 5)).write.mode("append").parquet(log)
    got = files.answered(rows(("a", None, 0), ("c", "old", 0), ("z", None, 0), (None, None, 0)), spark.read.parquet(log), "k", F.col("n"), "v")
    assert {r.k: r.v for r in got.collect()} == {"a": "9", "c": "3", "z": None, None: None}


def test_rehydrate_and_sidecar(spark, tmp_path):
    pairs = spark.createDataFrame([("1", '{"job_title": "Cook"}', "no"), ("2", '{"job_title": "Cook"}', 'so {"job_title": "Chef"}')], "id string, gold string, raw string")
    got = {r.id: (r.gold.job_title, r.pred and r.pred.job_title) for r in files.rehydrate({"per_example": pairs}, "id", "raw", "gold").collect()}
    assert got == {"1": ("Cook", None), "2": ("Cook", "Chef")}
    side = tmp_path / "meta.json"
    side.write_text('{"base": "m", "rank": 8}')
    assert files.with_sidecar(pairs, str(side), ["rank", "gone"]).first()[-2:] == ("8", None)
    assert files.with_sidecar(pairs, str(tmp_path / "none.json"), ["rank"]).first()[-1] is None


def test_report(spark):
    text = files.report("Run", {"Sizes": spark.createDataFrame([("a|b", 0.5)], "k string, v double")}, {"Sizes": "Of all rows."})
    assert text.startswith("# Run\n") and "## Sizes" in text and "a\\|b | 0.5" in text and "Of all rows." in text


def test_jobs():
    from millrace.plans.jobs import Jobs

    seen, jobs = [], Jobs()
    for name, after in (("bulk", ("gold",)), ("gold", ()), ("report", ("bulk", "gold"))):
        jobs.add(name, lambda name=name: seen.append(name) or name, after)
    assert jobs.run("report") == {"gold": "gold", "bulk": "bulk", "report": "report"} and seen == ["gold", "bulk", "report"]
    jobs.add("loop", lambda: None, ("loop",))
    with pytest.raises(ValueError):
        jobs.run("loop")
    with pytest.raises(KeyError):
        jobs.run("none")
