import pytest
from pyspark.sql import functions as F

from millrace.functions import jsonx
from millrace.functions import records as rec
from millrace.functions import text as tx


def run(spark, f, *values, kind="string"):
    return [r.y for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(f(F.col("x")).alias("y")).collect()]


def test_clean_text(spark):
    got = run(spark, tx.clean_text, "See https://a.example/x?y=1 or mail a.b+c@d.example\r\n\r\n\r\n\r\nnow", "duties:• one • two", "a \t  b", None, "", "  \n x \n ", "donâ€™t")
    assert got == ["See [URL] or mail [EMAIL]\n\nnow", "duties:\n- one \n- two", "a b", "", "", "x", "don't"]


def test_strata(spark):
    got = run(spark, tx.stratum, "Pay $28.50/hr", "USD 90,000", "80k - 90k", "apply by June 3", "deadline: 2025-01-02, £45,000", "apply before it closes", "nothing")
    assert got == ["salary", "salary", "salary", "deadline", "salary+deadline", "plain", "plain"]


def test_shingles(spark):
    got = run(spark, tx.shingles, "A b, c d e f", "a b", "", None, "a a a a a a a")
    assert got == [["a b c d e", "b c d e f"], ["a b"], [""], None, ["a a a a a"]]


def test_truncate(spark):
    long = "word " * 2000
    got = run(spark, tx.truncate_source, " short ", long, "x" * 7000)
    assert got[0] == "short" and got[1] == ("word " * 1200).rstrip() + " ..." and len(got[1]) <= 6004 and got[2] == "x" * 6000 + " ..."


def test_small_scalars(spark):
    assert run(spark, tx.comparable, "Austin,  TX!") == ["austin tx"]
    assert run(spark, tx.unset_to_null, "PASTE_KEY", "<x>", "", None, "ok") == [None, None, None, None, "ok"]
    assert run(spark, tx.sentences, "One. Two!\nThree\nfour") == [["One.", "Two!", "Three\nfour"]]
    assert run(spark, lambda x: tx.document_id(x, F.lit("t")), "7", "0", "", None) == ["7", *["8efd86fb78a56a51"] * 3]


def test_extract_record(spark):
    r = run(spark, tx.extract_record, "Senior Engineer\nRemote, full-time. $120k, 5+ years of Python and SQL. Bachelor. 401k")[0]
    assert (r.job_title, r.remote_policy, r.employment_type, r.seniority_level, r.amount, r.currency, r.period, r.years_experience_min) == ("Senior Engineer", "remote", "full_time", "senior", 120000.0, "USD", "yearly", 5)
    assert r.required_skills == ["python", "sql"] and r.benefits == ["401k"]
    assert run(spark, tx.extract_record, "")[0].job_title == "unknown"


def test_region_terms_currency(spark):
    assert run(spark, rec.region_code, "Texas", "  texas ", "tx", "Ontario", " ", None, "New  York") == ["TX", "TX", "TX", "Ontario", None, None, "NY"]
    assert run(spark, rec.currency_code, "usd", "dollars", None, " Eur ") == ["USD", None, None, "EUR"]
    got = run(spark, lambda x: rec.terms(x, 15), ["Python", "python", "AWS", " SQL "], ["JS", "K8s", "PostgreSQL"], ["x", "r", "c", "", "y" * 60], None, [None, "(react.js)"], kind="array<string>")
    assert got == [["aws", "python", "sql"], ["javascript", "kubernetes", "postgresql"], ["c", "r"], None, ["react"]]
    assert run(spark, rec.amount, 0.0, -1.0, 1e9, 12.345, float("nan"), None, kind="double") == [None, None, None, 12.35, None, None]
    assert run(spark, rec.date_shaped, "2025-13-99", "1/2/2025", None) == [True, False, None]


def test_digits_present(spark):
    df = spark.createDataFrame([(120000.0, "$120k a year"), (120000.0, "120,000"), (120000.0, "120 000"), (61.5, "pays 61.50"), (61.5, "pays 62"), (45500.0, "45.5k"), (7.0, "x")], "v double, t string")
    assert [r.y for r in df.select(rec.digits_present(F.col("v"), F.col("t")).alias("y")).collect()] == [True, True, True, False, True, True, False]


def test_ungrounded(spark):
    df = spark.createDataFrame([("Acme pays $120k in Austin, Texas",), (None,)], "t string").withColumn("r", rec.nest({x.path: F.lit({
        "company_name": "Acme", "location.city": "Dallas", "location.region": "TX", "salary.min_amount": 120000.0, "years_experience_min": 3, "application_deadline": "2024-01-01"}.get(x.path)) if not x.is_set
        else F.array(F.lit("austin"), F.lit("cobol")) for x in rec.LEAVES}))
    got = [r.y for r in df.select(rec.ungrounded(F.col("r"), F.col("t")).alias("y")).collect()]
    assert got[0] == ["location.city", "years_experience_min", "application_deadline", "preferred_skills"]


@pytest.mark.parametrize("raw,kind,strict", [
    ('{"job_title":"Cook"}', None, True), ('```json\n{"job_title":"Cook"}\n```', None, False), ('Sure: {"job_title":"a {brace} \\" b"} ok', None, False), ('{"job_title":"x"', "no_json", False), ("none", "no_json", False),
    (None, "no_json", False), ("{bad: 1}", "json_decode_error", False), ('{"job_title":"x","extra":1}', "schema_error", False), ('{"job_title":""}', "schema_error", False),
    ('{"job_title":"x","application_deadline":"soon"}', "schema_error", False), ('{"job_title":"x","salary":{"min_amount":2e9}}', "schema_error", False), ('{"job_title":"x","years_experience_min":"5"}', None, True),
    ('{"job_title":"x","years_experience_min":5.5}', "schema_error", False), ('{"job_title":"x","employment_type":"FULL_TIME"}', "schema_error", False), ('{"job_title":"x","required_skills":null}', "schema_error", False),
    ('{"job_title":"x","location":null}', "schema_error", False), ('[1]', "no_json", False)])
def test_parse(spark, raw, kind, strict):
    record, got, _ = jsonx.parse(raw)
    assert got == kind and (record is not None) == (kind is None) and (record is not None and jsonx._strict(raw)) == strict


def test_parse_udf_and_schemas(spark):
    df = spark.createDataFrame([('{"job_title":"  A   cook ","location":{"region":"texas"},"salary":{"currency":"usd"},"required_skills":["JS","js"]}',), (None,)], "raw string").select(jsonx.parse_record()("raw").alias("p"))
    a, b = [r.p for r in df.collect()]
    assert '"job_title":"A cook"' in a.record_json and '"region":"TX"' in a.record_json and '"currency":"USD"' in a.record_json and '["javascript"]' in a.record_json and b.error_kind == "no_json"
    open_ = jsonx.open_schema()
    assert open_["required"] == rec.SCHEMA.names and open_["properties"]["required_skills"]["maxItems"] == 15
    strict = jsonx.strict_schema(open_)
    assert strict["additionalProperties"] is False and None in strict["properties"]["employment_type"]["enum"] and strict["properties"]["job_title"]["type"] == "string"
    assert jsonx.json_schema_of(rec.SCHEMA)["properties"]["salary"]["required"] == ["min_amount", "max_amount", "currency", "period"]
    assert jsonx.parse(rec.EMPTY_JSON)[0]["job_title"] == "unknown"


def test_messages(spark):
    ex = F.array(F.struct(F.lit("q").alias("question"), F.lit("a").alias("answer")))
    got = run(spark, lambda x: tx.build_messages(x, examples=ex), "hello")[0]
    assert [m.role for m in got] == ["system", "user", "assistant", "user"] and "hello" in got[-1].content
