import hashlib

from millrace.plans import record_queries as q

from .conftest import SMALL


def test_company_groups_hold_every_document(spark):
    got = q.company_groups(spark, SMALL).collect()
    assert sum(r.n for r in got) == spark.read.parquet(f"{SMALL}/documents.parquet").count()


def test_every_text_is_perturbed(spark):
    texts = {r.row_id: r.text for r in spark.read.parquet(f"{SMALL}/raw_postings.parquet").filter("text is not null").collect()}
    assert any("ß" in t for t in texts.values())
    shouted = {r.row_id: r.digest for r in q.perturbed_shouting(spark, SMALL).collect()}
    assert shouted == {i: hashlib.md5(t.upper().encode()).hexdigest() for i, t in texts.items()}
    assert q.perturbed(spark, SMALL).count() == 6 * len(texts)


def test_bootstrap_has_a_thousand_replicates(spark):
    assert q.bootstrap_replicates(spark, SMALL).select("replicate").distinct().count() == 1000
