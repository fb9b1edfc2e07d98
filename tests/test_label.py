import json

import pytest
from pyspark.sql import functions as F

from millrace.functions import jsonx
from millrace.functions import records as rec
from millrace.functions import text as tx
from millrace.operators import label, perturb, stats, vote

TEXT = "Backend Engineer. 5 years. You know python and sql. Apply by 2031-01-02. Pay 90000."


def raw(**leaves):
    return json.dumps({"job_title": "Backend Engineer", **leaves})


def test_funnel(spark):
    samples = [("ok", i, raw(years_experience_min=5, required_skills=["python", "sql"]), None) for i in range(3)]
    samples += [("low", i, raw(years_experience_min=v), None) for i, v in enumerate((3, 5, 7))]
    samples += [("parse", i, t, None) for i, t in enumerate(("nothing", '{"job_', raw(salary={"min_amount": 9.9e12})))]
    samples += [("bad", i, raw(company_name="Nowhere Inc", salary={"min_amount": 123456.0}), None) for i in range(2)]
    samples += [("api", 0, raw(), None), ("api", 1, None, "Exhausted")]
    samples += [("most", 0, "torn {", None), ("most", 1, raw(years_experience_min=5), None), ("most", 2, raw(years_experience_min=5), None), ("null", 0, raw(), None)]
    df = spark.createDataFrame([(*r, "x") for r in samples], "id string, sample_idx int, output string, error string, status string")
    sources = spark.createDataFrame([(k, TEXT, 1) for k in ("ok", "low", "parse", "bad", "api", "most", "none")] + [("null", None, 1)], "id string, text string, record int")
    got = {r.id: r for r in label.label(df, sources, error="error").collect()}
    assert {k: r.status for k, r in got.items()} == {"ok": "ok", "low": "low_agreement", "parse": "parse_failed", "bad": "ungrounded", "api": "api_failed", "most": "ok", "none": "api_failed", "null": "ok"}
    assert got["ok"].record.required_skills == ["python", "sql"] and got["low"].record is None and got["most"].n_parsed == 2
    assert got["bad"].ungrounded == ["company_name", "salary.min_amount"] and got["low"].agreement["years_experience_min"] == 1 / 3
    first = {r.id: (r.status, r.record and r.record.years_experience_min) for r in label.label(df, sources, error="error", voted=False).collect()}
    assert first["low"] == ("ok", 3) and first["most"] == ("ok", 5)
    assert set(r.status for r in got.values()) <= set(label.STATUSES)
    assert label.label(df.limit(0), sources.limit(0)).count() == 0


def test_vote_is_validated_again(spark):
    rows = spark.createDataFrame([(1, i, "Cook" if i else None) for i in range(3)] + [(2, i, None if i else "Cook") for i in range(3)], "id int, s int, t string")
    empty = rec.from_json(F.lit(rec.EMPTY_JSON))
    rows = rows.withColumn("r", empty.withField("job_title", F.col("t")))
    assert {r.id: r.status for r in vote.vote_records(rows, "id", "s", F.col("r")).collect()} == {1: "ok", 2: "vote_failed"}


def test_list_overflow(spark):
    row = spark.range(1).select(rec.from_json(F.lit(rec.EMPTY_JSON)).withField("job_title", F.lit("Cook")).withField("company_name", F.lit("x y")).withField("benefits", F.array(F.lit("a"))).alias("r"))
    long = row.select("r", F.col("r").withField("required_skills", F.array(*[F.lit(f"s{i}") for i in range(16)])).alias("raw"))
    got = long.select(rec.degenerate(F.col("r")).alias("a"), rec.degenerate(F.col("r"), F.col("raw")).alias("b")).first()
    assert (got.a, got.b) == (None, "list_overflow")


def test_json_block():
    block = jsonx.json_block
    assert block('x {"a": "}", "b": {"c": 1}} {"d": 2}') == '{"a": "}", "b": {"c": 1}}'
    assert block("```json\n{\"a\": 1}\n```") == '{"a": 1}'
    assert block("{broken: [}") == "{broken: [}" and block('{"a": "line\nbreak {"}') == '{"a": "line\nbreak {"}'
    assert block('{"a": "\\"}"}') == '{"a": "\\"}"}' and block('{a: "\\\\"} }') == '{a: "\\\\"}'
    for text in (None, "", "no", '{"a": 1', '{"a": "}', '{a: "}', '{a: "x\\'):
        assert block(text) is None, text
    deep = "{" + '"a":{' * 5000 + "}" * 5001
    assert block("see " + deep) == deep


def test_extraction(spark):
    long = "Cook wanted. " * 1000
    rows = [(1, TEXT, "Sure: " + raw(years_experience_min=5)), (2, " ", raw()), (3, TEXT, "nothing"), (4, long, raw(job_title="Cook", company_name="Nowhere Inc")), (5, None, None), (6, TEXT, raw(extra=1))]
    got = {r.id: r for r in label.extraction(spark.createDataFrame(rows, "k int, t string, o string"), "k", "t", "o").collect()}
    assert {k: r.status for k, r in got.items()} == {1: "ok", 2: "empty_input", 3: "no_json", 4: "ok", 5: "empty_input", 6: "schema_error"}
    assert got[1].n_filled == 4 and got[1].ungrounded == [] and got[1].read_chars is None
    assert got[4].ungrounded == ["company_name"] and got[4].read_chars < len(long) and got[3].record_json is None


def test_trained_part(spark):
    turns = spark.range(1).select(tx.build_messages(F.lit("Cook wanted")).alias("m"))
    asked = turns.select(tx.render_turns(F.col("m")).alias("t")).select(tx.trained_part(F.col("t")).alias("p"), "t").first()
    assert asked.p is None and asked.t.startswith("<|im_start|>system\n") and asked.t.endswith("<|im_end|>\n")
    whole = F.concat("m", F.array(F.struct(F.lit("assistant").alias("role"), F.lit("{}").alias("content"))))
    assert turns.select(tx.trained_part(tx.render_turns(whole)).alias("p")).first().p == "{}<|im_end|>\n"


def test_guards(spark):
    assert stats.guard_least(spark.range(3), 3, "few").count() == 3
    with pytest.raises(ValueError):
        stats.guard_least(spark.range(2), 3, "few")


def test_doubled_spaces(spark):
    df = spark.range(300).select(perturb.whitespace_chaos(F.lit("a b c d e f g h"), F.lit(None), F.col("id"))[0].alias("t"))
    doubled = {r.t.split("\n")[0].count("  ") for r in df.collect()}
    assert doubled == {0, 1, 2, 3, 4, 5}
