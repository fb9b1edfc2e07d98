"""Registered queries of the operators of this subpackage (pN_...)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from . import canonical, garbled, groups, leaks, mixing, oracles, overlap, pieces, sampling


def _train_groups(spark: SparkSession, d: str) -> DataFrame:
    return groups.related_groups(table(spark, d, "train"), "posting_id", groups.entity_number(F.col("company_id")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return groups.shared_groups(_train_groups(spark, d)).select(F.col("id").alias("posting_id"), F.col("group_entity").alias("group_company"))


def p2_splits(spark: SparkSession, d: str) -> DataFrame:
    shares = [(r.split, r.share) for r in table(spark, d, "split_targets").limit(1000).collect()]
    split = groups.assign_splits(_train_groups(spark, d), shares)
    rows = table(spark, d, "train").select("posting_id", "batch", "company_id")
    return rows.join(split.withColumnRenamed("id", "posting_id"), "posting_id")


def _strata(spark: SparkSession, d: str):
    facts = table(spark, d, "corpus_facts")
    names = (("salary", "salary"), ("deadline", "deadline"), ("salary_deadline", "salary+deadline"), ("plain", "plain"))
    targets = facts.select("source", "sample_share", "min_rows", F.explode(F.array(*[
        F.struct(F.lit(name).alias("stratum"), F.col(f"strata.{field}").alias("share")) for field, name in names])).alias("t"))
    targets = targets.select("source", "t.stratum", "t.share", "sample_share", "min_rows")
    postings = (table(spark, d, "raw_postings").filter(F.col("posting_id").isNotNull() & F.col("source").isNotNull())
                .groupBy("source", "posting_id").agg(F.min(sampling.category(F.col("stratum"), ("salary", "deadline"), "plain")).alias("stratum")))
    return sampling.stratified_sample(postings, targets, id_col="posting_id", group="source", stratum="stratum")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _strata(spark, d)[1].filter("unmet").select("source", "stratum")


def p3_sample(spark: SparkSession, d: str) -> DataFrame:
    return _strata(spark, d)[0].select(F.col("id").alias("posting_id"), "source", "stratum")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return _strata(spark, d)[1].select("source", "stratum", "available", "n_sample", F.round("needed", 6).alias("needed"), "unmet")


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlaps(table(spark, d, "train"), table(spark, d, "heldout"), "posting_id", "source_text")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = p4_pairs(spark, d)
    return pairs.select(F.least("id_a", "id_b").alias("posting_id_a"), F.greatest("id_a", "id_b").alias("posting_id_b")).distinct()


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(p4_pairs(spark, d), table(spark, d, "heldout"), "posting_id", "split", "source")


def p5_restored(spark: SparkSession, d: str) -> DataFrame:
    return garbled.repair(table(spark, d, "raw_postings"), "row_id", "text").withColumnRenamed("id", "row_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_restored(spark, d).select("row_id")


def p6_sample(spark: SparkSession, d: str) -> DataFrame:
    chosen = sampling.consistent_sample(table(spark, d, "train"), "posting_id", 0.1)
    return chosen.filter("selected").select(F.col("id").alias("posting_id"))


def p6_deliveries(spark: SparkSession, d: str) -> DataFrame:
    """Two deliveries, the second with the first one's store; gold rows weigh twice."""
    rows = table(spark, d, "train")
    weight = F.when(F.col("is_gold"), 2.0).otherwise(1.0)
    first = sampling.consistent_sample(rows.filter("batch <= 3"), "posting_id", 0.1, weight)
    later = sampling.consistent_sample(rows.filter("batch > 3 or batch is null"), "posting_id", 0.1, weight, store=first)
    return later.filter("selected").select(F.col("id").alias("posting_id"), "weight")


def p7_mapped(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "job_postings")
    regions, skills = table(spark, d, "region_ref"), table(spark, d, "skill_ref")
    codes = canonical.reference(regions, F.col("region_code"), F.col("region_name"))
    names = canonical.reference(skills, F.col("skill_id"), F.col("skill"), F.col("aliases"))

    def stated(column):
        return column.isNotNull() & (F.regexp_replace(column, "[\\s\u00a0]+", "") != "")

    places = rows.select("record_id", F.lit("region").alias("field_name"), F.lit(0).alias("pos"), F.col("location.region").alias("value"))
    entered = rows.select("record_id", F.lit("required_skills").alias("field_name"), F.posexplode("required_skills").alias("pos", "value"))
    mapped = (canonical.canonicalize(places.filter(stated(F.col("value"))), "value", codes, keys_entered=True)
              .unionByName(canonical.canonicalize(entered.filter(stated(F.col("value"))), "value", names)))
    return mapped.filter(~F.col("as_listed"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_mapped(spark, d).select("record_id", "field_name", "pos", "ref_key")


def p7_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return canonical.unmatched_report(p7_mapped(spark, d), "value", "field_name")


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_spans(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_spans(spark, d).select("doc_id", "item_id").distinct()


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leak_report(p8_spans(spark, d))


def p8_stock(spark: SparkSession, d: str) -> DataFrame:
    return leaks.stock_report(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_cleaned(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    spans = leaks.leaked_spans(documents, table(spark, d, "eval_items"))
    return leaks.without_leaks(documents, spans).select("doc_id", "text")


def _mixture(spark: SparkSession, d: str):
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[1].filter(F.col("unmet") & (F.col("n_docs") > 0)).select("source")


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[1]


def p9_copies(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[0].select("doc_id", "source", "copies")


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.split_oversized(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    cut = pieces.split_oversized(table(spark, d, "documents"), "doc_id", "text", with_text=False)
    return cut.filter((F.col("piece") == 0) & (F.col("n_pieces") > 1)).select(F.col("id").alias("doc_id"))


QUERIES = {f.__name__: f for f in (p2_found, p2_splits, p3_found, p3_sample, p3_report, p4_found, p4_report, p5_found, p5_restored, p6_sample, p6_deliveries, p7_found, p7_unmatched,
                                    p8_found, p8_report, p8_stock, p8_cleaned, p9_found, p9_report, p9_copies, p10_found, p10_pieces)}
ORACLES: dict[str, str] = dict(oracles.ORACLES)
