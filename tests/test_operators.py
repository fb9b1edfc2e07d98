import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import records as rec
from millrace.operators import dedup, perturb, sampling, score, stats, units, vote


def record(spark, rows):
    """Rows of dicts of leaves, with their id and ordinal."""
    data = []
    for i, o, leaves in rows:
        v = {x.path: leaves.get(x.path, [] if x.is_set else None) for x in rec.LEAVES}
        data.append((i, o, *v.values()))
    schema = "id string, ord int, " + ", ".join(f"`{x.path.replace('.', '__')}` {x.type}" for x in rec.LEAVES)
    df = spark.createDataFrame(data, schema)
    return df.select("id", "ord", rec.nest({x.path: F.col(x.path.replace(".", "__")) for x in rec.LEAVES}).alias("r"))


# ---- units --------------------------------------------------------------------------------------


def test_unit_strings():
    read = units.UnitParser(units.PAY).read
    for text, want in {
        "from US$52,300 p.a.": (52300.0, "USD", "yearly"), "Rs. 54.5 lakh p.a.": (5450000.0, "INR", "yearly"), "₹19.3 LPA": (1930000.0, "INR", "yearly"), "3.690 € brutto im Monat": (3690.0, "EUR", "monthly"),
        "137.000 € brutto/Jahr": (137000.0, "EUR", "yearly"), "$12.50-13.55 per hour": (12.5, "USD", "hourly"), "AU$238,900-280,354 per year": (238900.0, "AUD", "yearly"), "CHF 97.38 day rate": (97.38, "CHF", "daily"),
        "Fr. 205.4k per annum": (205400.0, "CHF", "yearly"), "¥9,560,000 a year": (9560000.0, "JPY", "yearly"), "EUR 8 hourly": (8.0, "EUR", "hourly"), "GBP 76,600/yr": (76600.0, "GBP", "yearly"), "USD 405/wk": (405.0, "USD", "weekly"),
    }.items():
        amount, named = read(text, "text")
        assert (amount, named.get("currency"), named.get("period")) == want, text
    for text in ("DOE", "competitive", "negotiable", ""):
        assert read(text, "text") == (None, {})
    assert read("hr", "period")[1] == {"period": "hourly"} and read("a year", "period")[1] == {"period": "yearly"} and read("Rs", "currency")[1] == {"currency": "INR"}


def test_plain_numbers():
    for text, want in {"1,234": 1234, "1.234": 1234, "1.5": 1.5, "1,234.50": 1234.5, "1.234,50": 1234.5, "12": 12, "0.125": 0.125, "1306.5": 1306.5, "1,460,000": 1460000}.items():
        assert units.plain_number(text) == want, text


def test_conversion(spark):
    table = spark.createDataFrame([("currency", "USD", 1.0), ("currency", "EUR", 1.09), ("period", "yearly", 1.0), ("period", "hourly", 2080.0)], "unit_kind string, unit_code string, factor double")
    rows = [(1, 50.0, "usd", "hr", None), (2, 60.0, "USD", "yearly", None), (3, 6_000_000.0, "$", "p.a.", "DOE"), (4, 1.0, "GBP", "yearly", "EUR 40,000 per year"), (5, 50_000.0, None, "yearly", None), (6, 50_000.0, "USD", None, "a year"),
            (7, None, "USD", "yearly", None), (8, -5.0, "USD", "yearly", ""), (9, float("inf"), "USD", "yearly", None), (10, 20.0, "zz", "yearly", None), (1, 50.0, "usd", "hr", None), (11, 5.0, "USD", "hourly", "USD 9 an hour")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "rid int, amount double, currency string, period string, txt string, id string")
    out = units.to_usd_per_year(df, table, id_col="rid", amount="amount", currency="currency", period="period", text="txt")
    got = {r.id: r.usd_per_year for r in out.collect()}
    assert got == {1: 104000.0, 2: 60000.0, 3: 60000.0, 4: pytest.approx(43600.0), 5: None, 6: 50000.0, 7: None, 8: None, 9: None, 10: None, 11: 18720.0}
    assert out.count() == len(rows) and units.to_usd_per_year(df.limit(0), table, id_col="rid", amount="amount", currency="currency", period="period", text="txt").count() == 0
    bands = spark.createDataFrame([(1, 15000.0, 60000.0), (2, 60000.0, 400000.0)], "band_id int, low_usd double, high_usd double")
    assert {r.id: r.band_id for r in units.in_band(out, bands, "usd_per_year").collect()} == {1: 2, 2: 2, 3: 2, 4: 1, 6: 1, 11: 1}
    assert units.in_band(out, bands.limit(0), "usd_per_year").count() == 0


# ---- duplicates ---------------------------------------------------------------------------------


def test_greedy_is_one_pass_in_order(spark):
    rng = random.Random(4)
    for n, edges in ((3, [(0, 1), (1, 2)]), (60, [(rng.randrange(60), rng.randrange(60)) for _ in range(90)]), (5, [])):
        edges = [(a, b) for a, b in edges if a != b]
        kept: list[int] = []
        for i in range(n):
            if not any((i, k) in edges or (k, i) in edges for k in kept):
                kept.append(i)
        nodes = spark.range(n).select(F.col("id").alias("cls"), F.col("id").alias("ord"))
        links = spark.createDataFrame(edges, "cls_a long, cls_b long")
        got = {r.cls: r.keeper for r in dedup.greedy_keepers(nodes, links).collect()}
        assert sorted(k for k, v in got.items() if k == v) == kept
        assert all(v in kept for v in got.values())


def test_deduplicate(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choices(words, k=80) for _ in range(6)]
    texts = []
    for i, w in enumerate(base):
        texts += [(10 * i, " ".join(w)), (10 * i + 1, " ".join(w).upper() + "!"), (10 * i + 2, " ".join([*w[:40], "new", *w[40:]]))]
    texts += [(900, None), (901, ""), (902, " "), (903, "two words"), (904, "x " * 50_000)]
    df = spark.createDataFrame([(*t, "c") for t in texts], "doc_id long, text string, cls string")
    got = {r.id: (r.class_id, r.status) for r in dedup.deduplicate(df, "doc_id", "text").collect()}
    for i in range(6):
        assert got[10 * i] == (10 * i, "kept") and got[10 * i + 1] == (10 * i, "exact") and got[10 * i + 2] == (10 * i, "near")
    assert 900 not in got and got[902] == (901, "exact") and got[903][1] == "kept"
    report = dedup.dedup_report(dedup.deduplicate(df, "doc_id", "text")).first()
    assert (report.n_in, report.n_exact, report.n_near) == (22, 7, 6)
    assert dedup.deduplicate(df.limit(0), "doc_id", "text").count() == 0


def test_links_equal_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(40):
        w = rng.choices(words, k=60)
        docs.append((2 * i, " ".join(w)))
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(60)] = "zzz"
        docs.append((2 * i + 1, " ".join(w)))
    run = lambda t: {" ".join(t.split()[k : k + 5]) for k in range(56)}
    want = {(a, b) for a, s in docs for b, t in docs if a < b and s != t and len(run(s) & run(t)) / len(run(s) | run(t)) >= 0.8}
    members, links = dedup.similar_classes(spark.createDataFrame(docs, "i long, t string"), "i", "t")
    cls = {}
    for r in members.collect():
        cls.setdefault(r.cls, []).append(r.id)
    got = {(min(a, b), max(a, b)) for r in links.collect() for a in cls[r.cls_a] for b in cls[r.cls_b]}
    assert got == want and len(want) > 5


# ---- sampling -----------------------------------------------------------------------------------


def test_grouped_split_matches_one_pass(spark):
    rng = random.Random(1)
    groups = [(f"g{i}", rng.randint(1, 30), rng.random() < 0.3) for i in range(150)]
    df = spark.createDataFrame(groups, "k string, n int, f boolean")
    order = {r.k: r.b for r in df.select("k", sampling.stable_bucket(F.col("k")).alias("b")).collect()}
    left, want = {"test": 90, "val": 60}, {}
    for k, n, f in sorted(groups, key=lambda g: (not g[2], order[g[0]], g[0])):
        want[k] = next((s for s in ("test", "val") if n <= left[s]), "train")
        if want[k] != "train":
            left[want[k]] -= n
    assert {r.k: r.split for r in sampling.grouped_split(df, "k", "n", "f", 90, 60).collect()} == want


def test_quota_and_fill(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") % 10 == 0, "a").otherwise("b").alias("s"))
    got = sampling.quota_sample(df, "s", {"a": 0.5, "b": 0.5}, 600, "id")
    n = {r.s: r.n for r in got.groupBy("s").agg(F.count("*").alias("n")).collect()}
    assert n == {"a": 200, "b": 400}
    assert {r.id for r in got.collect()} == {r.id for r in sampling.quota_sample(df.repartition(7), "s", {"a": 0.5, "b": 0.5}, 600, "id").collect()}
    assert sampling.quota_sample(df.limit(0), "s", {"a": 1.0}, 5, "id").count() == 0


def test_cost_batches(spark):
    rng = random.Random(3)
    rows = [(i, "x" * rng.choice((300, 400, 2000, 12000, 50000))) for i in range(300)] + [(999, None)]
    got = sampling.cost_batches(spark.createDataFrame(rows, "i int, t string"), "i", "t", parts=4).collect()
    assert sorted(r.id for r in got) == sorted(i for i, _ in rows)
    by = {}
    for r in got:
        by.setdefault(r.batch, []).append(r.n_chars)
    assert all(len(v) == 1 or (len(v) * (max(v) / 4 + 400) <= 8000 and len(v) <= 16) for v in by.values()) and len(by) < 200


def test_exemplars_and_categories(spark):
    df = spark.createDataFrame([("a", "x" * 900, "{}", 4, True), ("b", "x" * 950, "{}", 3, False), ("c", "x" * 1000, "{}", 12, False), ("d", "x" * 1100, "{}", 7, False), ("e", "x" * 10, "{}", 7, True)], "id string, t string, j string, n int, p boolean")
    got = {r.id: (r.slot, r.place) for r in sampling.pick_exemplars(df, "t", "j", "n", "p", 4).collect()}
    assert got == {"a": ("paid", 0), "c": ("rich", 1), "b": ("sparse", 2), "d": ("pool", 3)}
    assert sampling.capped_minority(spark.range(100), F.col("id") < 50, F.col("id"), 0.1).count() == 60


# ---- votes, scores ------------------------------------------------------------------------------


def test_votes(spark):
    rows = [("p", i, {"years_experience_min": y, "required_skills": s, "salary.min_amount": 10.0, "job_title": t}) for i, (y, s, t) in enumerate([(5, ["a", "b"], "x"), (5, ["a", "b", "c"], "y"), (3, ["a"], None)])]
    rows += [("q", 0, {"benefits": ["z"]}), ("q", 1, {}), ("r", 0, {"years_experience_min": 3}), ("r", 1, {"years_experience_min": 5}), ("r", 2, {"years_experience_min": 7})]
    df = record(spark, rows)
    got = {(r.id, r.field): (r.value, round(r.agreement, 4)) for r in vote.scalar_votes(df, "id", "ord", F.col("r")).collect()}
    assert got[("p", "years_experience_min")] == ("5.00", 0.6667) and got[("p", "job_title")][0] == "x" and got[("p", "company_name")] == (None, 1.0)
    sets = {(r.id, r.field): (r["items"], round(r.agreement, 4)) for r in vote.set_votes(df, "id", "ord", F.col("r")).collect()}
    assert sets[("p", "required_skills")] == (["a", "b"], round((1 + 2 / 3 + 1 / 3) / 3, 4)) and sets[("q", "benefits")] == ([], 0.5) and sets[("p", "benefits")] == ([], 1.0)
    status = {r.id: r.status for r in vote.vote_records(df, "id", "ord", F.col("r")).collect()}
    assert status == {"p": "low_agreement", "q": "vote_failed", "r": "vote_failed"}  # q and r have no title, which the schema asks for


def test_counts_and_rates(spark):
    gold = {"job_title": "Cook", "company_name": "Acme, Inc", "salary.min_amount": 120000.0, "required_skills": ["python", "sql", "aws"], "years_experience_min": 3}
    pred = {"job_title": "Baker", "company_name": "acme inc", "salary.min_amount": 121000.0, "salary.currency": "USD", "required_skills": ["python", "sql", "go"]}
    df = record(spark, [("g", 0, gold), ("p", 0, pred)])
    pair = df.filter("id = 'g'").select(F.lit("1").alias("k"), F.col("r").alias("gold")).join(df.filter("id = 'p'").select(F.lit("1").alias("k"), F.col("r").alias("pred")), "k")
    none = pair.select(F.lit("2").alias("k"), "gold", F.when(F.lit(False), F.col("pred")).alias("pred"))
    s = score.score_pairs(pair.unionByName(none), "gold", "pred", None, ("k",))
    c = {r.field: (r.tp, r.fp, r.fn, r.tn) for r in score.field_counts(s.filter("k = '1'")).collect()}
    assert c["job_title"] == (0, 1, 1, 0) and c["company_name"] == (1, 0, 0, 0) and c["salary.min_amount"] == (1, 0, 0, 0) and c["salary.currency"] == (0, 1, 0, 0)
    assert c["required_skills"] == (2, 1, 1, 0) and c["years_experience_min"] == (0, 0, 1, 0) and c["benefits"] == (0, 0, 0, 1)
    r = {x.k: x for x in s.collect()}
    assert (r["1"].n_emitted, r["1"].n_over_emitted, r["2"].n_emitted, r["2"].parsed, r["2"].exact_match) == (5, 1, 0, False, False)
    assert r["2"].n_correct_null == r["2"].n_gold_null == 11
    same = score.score_pairs(pair.select("k", "gold", F.col("gold").alias("pred")), "gold", "pred", None, ("k",))
    assert same.first().exact_match and score.paired_test(same, same, "k", replicates=20).first().p_value == 1.0
    tags = pair.select(score.failure_tags(F.col("gold"), F.col("pred"), F.array(F.lit("job_title"))).alias("t")).first().t
    assert tags == ["missed_extraction", "salary_misparse", "set_partial", "ungrounded"]


def test_gap_closed(spark):
    df = spark.createDataFrame([(0.4, 0.6, 0.8), (0.5, 0.6, 0.5)], "a double, b double, c double")
    assert [r.g for r in df.select(score.gap_closed(F.col("a"), F.col("b"), F.col("c")).alias("g")).collect()] == [pytest.approx(0.5), None]


def test_bootstrap_weights(spark):
    w = score.multinomial_weights(spark, 30, 10)
    assert {r.s for r in w.groupBy("replicate").agg(F.sum("w").alias("s")).collect()} == {30}
    p = score.poisson_weights(spark.range(20_000), "id", 2)
    assert abs(p.groupBy("replicate").agg(F.sum("w").alias("s")).first().s / 20_000 - 1) < 0.03


# ---- perturbations, statistics ------------------------------------------------------------------


def test_perturbations(spark):
    text = "Pay is $50,000 a year. Apply by June 3. It's a \"good\" job - really & truly.\nPython helps. Wonderful colleagues everywhere around here."
    df = record(spark, [("a", 0, {"job_title": "Wonderful", "salary.min_amount": 5.0, "application_deadline": "2024-01-01"})]).select("id", F.lit(text).alias("t"), F.col("r").alias("g"))
    out = {r.arm: r for r in perturb.build_suite(df, "id", "t", "g").collect()}
    assert set(out) == set(perturb.ARMS) and out["identity"].text == text and out["shout_case"].text == text.upper()
    assert "$" not in out["strip_salary"].text and out["strip_salary"].gold.salary.min_amount is None and out["identity"].gold.salary.min_amount == 5.0
    assert "June" not in out["strip_deadline"].text and out["strip_deadline"].gold.application_deadline is None
    assert "â€œ" in out["mojibake"].text and out["boilerplate_flood"].text.startswith(text) and len(out["truncate_tail"].text) <= 400
    assert sorted(out["typos"].text) == sorted(text) and "Wonderful" in out["typos"].text
    assert "&amp;" in out["html_residue"].text and "&#39;" in out["html_residue"].text
    again = {r.arm: r.text for r in perturb.build_suite(df.repartition(3), "id", "t", "g").collect()}
    assert again == {k: v.text for k, v in out.items()}


def test_statistics(spark):
    df = spark.range(10).select(F.col("id").alias("v"))
    assert {r.q: r.value for r in stats.place_percentiles(df, "v", (0.0, 0.5, 0.9, 1.0)).collect()} == {0.0: 0, 0.5: 5, 0.9: 9, 1.0: 9}
    assert stats.guard_share(df, F.col("v") < 3, 0.5, "bad").count() == 10
    with pytest.raises(Exception, match="bad"):
        stats.guard_share(df, F.col("v") < 8, 0.5, "bad").collect()
    with pytest.raises(ValueError):
        stats.guard_same_size({"a": df, "b": df.limit(3)})
