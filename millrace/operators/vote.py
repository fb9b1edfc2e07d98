"""Majority votes over several records of one item.

Votes are counted, not gathered: each leaf becomes a (item, field, value) row, counts are pre-aggregated
before the shuffle, and the winner is the greatest (count, earliest sample). An item with very many
samples is thus added up by all tasks.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import records as rec

HARD_FIELDS = ("salary.min_amount", "salary.max_amount", "salary.period", "years_experience_min", "application_deadline", "seniority_level")
LEAST_AGREEMENT = 0.67


def _text(value: Column, of: rec.Leaf) -> Column:
    if of.comparator == "numeric":
        return value.cast("double").cast("decimal(18,2)").cast("string")
    return value


def scalar_votes(df: DataFrame, id_col: str, sample: str, record: Column | None = None) -> DataFrame:
    """(id, field, value, agreement): the commonest value of each leaf, null counting as a value; a tie goes to the first seen."""
    leaves = [x for x in rec.LEAVES if not x.is_set]
    pairs = F.array(*[F.struct(F.lit(x.path).alias("field"), _text(rec.leaf(record, x.path), x).alias("value")) for x in leaves])
    rows = df.select(F.col(id_col).alias("id"), F.col(sample).alias("ord"), F.explode(pairs).alias("p"))
    counts = rows.groupBy("id", F.col("p.field").alias("field"), F.col("p.value").alias("value")).agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    return (counts.groupBy("id", "field").agg(F.max_by("value", F.struct("n", (-F.col("first")).alias("early"))).alias("value"), F.max("n").alias("n"), F.sum("n").alias("k"))
            .select("id", "field", "value", (F.col("n") / F.col("k")).alias("agreement")))


def set_votes(df: DataFrame, id_col: str, sample: str, record: Column | None = None) -> DataFrame:
    """(id, field, items, agreement): the items that more than half the samples hold, sorted; agreement is the mean support
    over all items named, 1 if none is. A null list is an empty one; repeats within a sample count once."""
    leaves = [x for x in rec.LEAVES if x.is_set]
    k = df.groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("k"))
    lists = F.array(*[F.struct(F.lit(x.path).alias("field"), F.array_distinct(rec.leaf(record, x.path)).alias("items")) for x in leaves])
    named = df.select(F.col(id_col).alias("id"), F.explode(lists).alias("p")).select("id", "p.field", F.explode("p.items").alias("item")).filter(F.col("item").isNotNull())
    support = named.groupBy("id", "field", "item").agg(F.count("*").alias("n")).join(k, "id")
    won = support.groupBy("id", "field").agg(
        F.array_sort(F.collect_list(F.when(F.col("n") / F.col("k") > 0.5, F.col("item")))).alias("items"), F.avg(F.col("n") / F.col("k")).alias("agreement"))
    every = k.select("id", F.explode(F.array(*[F.lit(x.path) for x in leaves])).alias("field"))
    return (every.join(won, ["id", "field"], "left")
            .select("id", "field", F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("agreement", F.lit(1.0)).alias("agreement")))


def vote_records(df: DataFrame, id_col: str, sample: str, record: Column | None = None) -> DataFrame:
    """(id, record, agreement, least_agreement, status): the voted record; status vote_failed if it breaks the schema, as a vote can
    mix leaves of several samples, and low_agreement if a hard field agrees too little."""
    scalars = scalar_votes(df, id_col, sample, record)
    sets = set_votes(df, id_col, sample, record)
    empty = F.array().cast("array<string>")
    rows = (scalars.select("id", "field", "value", F.lit(None).cast("array<string>").alias("items"), "agreement")
            .unionByName(sets.select("id", "field", F.lit(None).cast("string").alias("value"), "items", "agreement")))
    by = {x.path: (F.max(F.when(F.col("field") == x.path, F.col("items"))) if x.is_set else F.max(F.when(F.col("field") == x.path, F.col("value")))) for x in rec.LEAVES}
    wide = rows.groupBy("id").agg(*[c.alias(p.replace(".", "__")) for p, c in by.items()],
                                  F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "agreement")))).alias("agreement"))
    flat = {x.path: F.col(x.path.replace(".", "__")) for x in rec.LEAVES}
    leaves = {x.path: F.coalesce(flat[x.path], empty) if x.is_set else (flat[x.path].cast("double") if x.comparator == "numeric" else flat[x.path]) for x in rec.LEAVES}
    least = F.array_min(F.transform(F.array(*[F.lit(f) for f in HARD_FIELDS]), lambda f: F.coalesce(F.try_element_at("agreement", f), F.lit(1.0))))
    voted = wide.select("id", rec.nest(leaves).alias("record"), "agreement", least.alias("least_agreement"))
    return voted.withColumn("status", F.when(~rec.valid(F.col("record")), "vote_failed").when(F.col("least_agreement") < LEAST_AGREEMENT, "low_agreement").otherwise("ok"))
