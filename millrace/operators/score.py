"""Predicted records against gold records: counts, rates, resampled intervals, failures.

Scoring a pair is a narrow projection; every headline number is a ratio of sums over pairs, so that one
aggregate gives the metrics and one join with replicate weights gives their intervals.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import records as rec
from ..functions import text as tx
from ..runtime import durable
from .order import running

LOWER_IS_BETTER = ("hallucination_rate", "over_emission_rate", "mean_latency_s")


def _empty() -> Column:
    return F.array().cast("array<string>")


def leaf_pairs(gold: Column, pred: Column) -> Column:
    """array<struct<field, kind, g, p, gs, ps>>: both sides of each leaf as text, sets as arrays.

    One array that lambdas walk keeps the plan small: the rules below exist once and not once per leaf.
    """
    out = []
    for x in rec.LEAVES:
        g, p = rec.leaf(gold, x.path), rec.leaf(pred, x.path)
        kind = "pay" if x.comparator == "numeric" and x.path.startswith("salary.") else x.comparator
        text = [F.lit(None).cast("string")] * 2 if x.is_set else ([g.cast("double").cast("string"), p.cast("double").cast("string")] if x.comparator == "numeric" else [g, p])
        sets = [F.coalesce(F.array_distinct(g), _empty()), F.coalesce(F.array_distinct(p), _empty())] if x.is_set else [_empty()] * 2
        out.append(F.struct(F.lit(x.path).alias("field"), F.lit(kind).alias("kind"), text[0].alias("g"), text[1].alias("p"), sets[0].alias("gs"), sets[1].alias("ps")))
    return F.array(*out)


def judge(l: Column) -> Column:
    """Of one leaf pair: struct<field, ok, g_null, p_null, g_none, p_none, tp, fp, fn, tn>.

    A wrong value is both a false positive and a false negative; sets count items. Null is not stated; an empty list is
    neither null nor stated ("none").
    """
    is_set = l["kind"] == "set"
    both = F.size(F.array_intersect(l["gs"], l["ps"]))
    n_g, n_p = F.size(l["gs"]), F.size(l["ps"])
    g, p = l["g"].try_cast("double"), l["p"].try_cast("double")
    same = (F.when(l["kind"] == "string", F.lit(False)).when(l["kind"] == "pay", F.abs(g - p) <= F.lit(rec.SALARY_TOLERANCE) * F.greatest(F.abs(g), F.lit(1.0)))
            .when(l["kind"] == "numeric", g == p).otherwise(l["g"] == l["p"]))
    same = F.when((l["kind"] == "string") & (l["g"] != l["p"]), tx.comparable(l["g"]) == tx.comparable(l["p"])).when(l["kind"] == "string", True).otherwise(same)
    g_null, p_null = l["g"].isNull(), l["p"].isNull()
    equal = F.coalesce(F.when(g_null | p_null, g_null & p_null).otherwise(same), F.lit(False))
    hit = ~g_null & ~p_null & equal

    def pick(for_set: Column, for_scalar: Column) -> Column:
        return F.when(is_set, for_set).otherwise(for_scalar.cast("int"))

    return F.struct(
        l["field"].alias("field"), F.when(is_set, (both == n_g) & (both == n_p)).otherwise(equal).alias("ok"),
        (~is_set & g_null).alias("g_null"), (~is_set & p_null).alias("p_null"), F.when(is_set, n_g == 0).otherwise(g_null).alias("g_none"), F.when(is_set, n_p == 0).otherwise(p_null).alias("p_none"),
        pick(both, hit).alias("tp"), pick(n_p - both, ~p_null & ~hit).alias("fp"), pick(n_g - both, ~g_null & ~hit).alias("fn"), pick(((n_g == 0) & (n_p == 0)).cast("int"), g_null & p_null).alias("tn"))


def score_pairs(pairs: DataFrame, gold: str, pred: str, source: str | None = None, keep: tuple[str, ...] = (), strict: str | None = None, latency: str | None = None) -> DataFrame:
    """One row per pair: validity, correctness, emissions, nulls, counts of each leaf, unsupported fields, seconds.

    `strict` tells whether the raw output as a whole was the record (unstated: no), `latency` its seconds (unstated: 0).

    A pair with a null prediction isn't skipped: every stated gold leaf is missed, every null one credited.
    """
    g, p = F.col(gold), F.col(pred)
    rows = pairs.withColumn("counts", tx.let(leaf_pairs(g, p), lambda ls: F.transform(ls, judge)))
    parsed = p.isNotNull()
    n = lambda rule: F.size(F.filter("counts", rule))
    return rows.select(
        *keep, parsed.alias("parsed"), (parsed & F.coalesce(F.col(strict), F.lit(False)) if strict else F.lit(False)).alias("strict"),
        (F.coalesce(F.col(latency).cast("double"), F.lit(0.0)) if latency else F.lit(0.0)).alias("latency_s"), (parsed & F.forall("counts", lambda c: c["ok"])).alias("exact_match"),
        F.map_from_entries(F.transform("counts", lambda c: F.struct(c["field"], F.when(parsed, c["ok"]).otherwise(c["g_null"])))).alias("field_correct"),
        F.when(parsed, n(lambda c: ~c["p_none"])).otherwise(0).alias("n_emitted"), F.when(parsed, n(lambda c: ~c["p_none"] & c["g_none"])).otherwise(0).alias("n_over_emitted"),
        n(lambda c: c["g_null"]).alias("n_gold_null"), n(lambda c: c["g_null"] & (~parsed | c["p_null"])).alias("n_correct_null"),
        (F.when(parsed, rec.ungrounded(p, F.col(source))).otherwise(_empty()) if source else _empty()).alias("ungrounded"), "counts")


def field_counts(scored: DataFrame, by: tuple[str, ...] = (), weight: Column | None = None) -> DataFrame:
    """(by..., field, tp, fp, fn, tn) with every pair counted `weight` times."""
    w = weight if weight is not None else F.lit(1)
    flat = scored.select(*by, w.alias("_w"), F.explode("counts").alias("c"))
    return flat.groupBy(*by, F.col("c.field").alias("field")).agg(*[F.sum(F.col(f"c.{x}") * F.col("_w")).alias(x) for x in ("tp", "fp", "fn", "tn")])


def with_f1(counts: DataFrame) -> DataFrame:
    """Adds precision, recall, f1 (0 where a denominator is 0) and support."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = counts.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).withColumn("support", F.col("tp") + F.col("fn"))


def tier_of(field: Column) -> Column:
    return F.try_element_at(F.create_map(*[y for x in rec.LEAVES for y in (F.lit(x.path), F.lit(x.tier))]), field)


def roll_up(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., metric, value): micro_f1 of all counts, macro_f1 as the mean over fields, tier_1 ... tier_4 as means over theirs."""
    scored = with_f1(counts).withColumn("tier", tier_of(F.col("field")))
    micro = with_f1(counts.groupBy(*by).agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn", "tn")])).select(*by, F.lit("micro_f1").alias("metric"), F.col("f1").alias("value"))
    macro = scored.groupBy(*by).agg(F.avg("f1").alias("value")).select(*by, F.lit("macro_f1").alias("metric"), "value")
    tiers = scored.groupBy(*by, "tier").agg(F.avg("f1").alias("value")).select(*by, F.concat(F.lit("tier_"), F.col("tier")).alias("metric"), "value")
    return micro.unionByName(macro).unionByName(tiers)


def restricted_macro(counts: DataFrame, fields: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    return with_f1(counts.filter(F.col("field").isin(fields))).groupBy(*by).agg(F.avg("f1").alias("restricted_macro_f1"))


def rates(scored: DataFrame, by: tuple[str, ...] = (), weight: Column | None = None) -> DataFrame:
    """(by..., n, strict_rate, parse_rate, exact_match, hallucination_rate, over_emission_rate, null_recall, mean_latency_s); empty
    denominators count as 1. strict_rate is of outputs that are the record as a whole, parse_rate (lenient) of those that hold one."""
    w = weight if weight is not None else F.lit(1)
    s = lambda c: F.sum(c * w)
    share = lambda a, b: s(a) / F.greatest(s(b), F.lit(1))
    one = F.lit(1)
    return scored.groupBy(*by).agg(
        s(one).alias("n"), share(F.col("strict").cast("int"), one).alias("strict_rate"), share(F.col("parsed").cast("int"), one).alias("parse_rate"), share(F.col("exact_match").cast("int"), one).alias("exact_match"),
        share(F.size("ungrounded"), F.col("n_emitted")).alias("hallucination_rate"), share(F.col("n_over_emitted"), F.col("n_emitted")).alias("over_emission_rate"),
        share(F.col("n_correct_null"), F.col("n_gold_null")).alias("null_recall"), share(F.col("latency_s"), one).alias("mean_latency_s"))


def exact_leaf_rate(pairs: DataFrame, gold: str, pred: str) -> DataFrame:
    """(n, hits, rate): leaves that are the same as text, over all leaves; a null prediction misses all of them."""
    g, p = F.col(gold), F.col(pred)
    hits = F.when(p.isNotNull(), sum((rec.value_key(rec.leaf(g, x.path), x).eqNullSafe(rec.value_key(rec.leaf(p, x.path), x)).cast("int") for x in rec.LEAVES), F.lit(0))).otherwise(0)
    return pairs.agg((F.count("*") * len(rec.LEAVES)).alias("n"), F.coalesce(F.sum(hits), F.lit(0)).alias("hits")).withColumn("rate", F.try_divide(F.col("hits"), F.col("n")))


# ---- resampling ---------------------------------------------------------------------------------


def ordinals(df: DataFrame, key: str) -> DataFrame:
    """`df` with `_at`, 0 to n - 1 by the (unique) key."""
    return running(df, [key], out="_at")


def multinomial_weights(spark, n: int, replicates: int, seed: int = 17) -> DataFrame:
    """(replicate, _at, w): how often each of n rows is drawn in n draws, for each replicate; the draws are MD5 numbers."""
    draws = spark.range(replicates * n).select((F.col("id") / n).cast("bigint").alias("replicate"), (F.col("id") % n).alias("j"))
    number = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("replicate").cast("string"), F.col("j").cast("string"))), 1, 13), 16, 10).cast("bigint")
    return draws.select("replicate", (number % n).alias("_at")).groupBy("replicate", "_at").agg(F.count("*").alias("w"))


def poisson_weights(df: DataFrame, key: str, replicates: int, seed: int = 17) -> DataFrame:
    """`df` exploded to (replicate, w > 0): Poisson(1) weights by hash, needing neither a count nor an order; for large tables."""
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("replicate").cast("string"), F.col(key).cast("string"))), 1, 13), 16, 10).cast("double") / float(16**13)
    bounds = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(9)]
    w = sum(((u >= b).cast("int") for b in bounds), F.lit(0))
    return df.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("w", w).filter("w > 0")


def percentile_interval(values: DataFrame, value: str, by: tuple[str, ...], replicates: int, alpha: float = 0.05) -> DataFrame:
    """(by..., low, high): the values at places int(alpha/2 B) and int((1 - alpha/2) B) - 1 of the sorted replicates."""
    a, b = int(alpha / 2 * replicates), int((1 - alpha / 2) * replicates) - 1
    s = F.sort_array(F.collect_list(value))
    return values.groupBy(*by).agg(F.element_at(s, a + 1).alias("low"), F.element_at(s, b + 1).alias("high"))


def bootstrap(scored: DataFrame, key: str, replicates: int = 1000, seed: int = 17, poisson: bool = False) -> DataFrame:
    """(replicate, micro_f1, macro_f1, exact_match): the metrics of each resample of the pairs.

    Per-pair counts are made once, as one narrow row of numbers; a replicate only weighs and adds them, without
    a row per leaf. `poisson` needs no order and no count and is the way for large tables.
    """
    kinds = ("tp", "fp", "fn")
    per_pair = durable(scored.select(key, F.col("exact_match").cast("int").alias("_exact"), *[F.col("counts")[i][x].cast("int").alias(f"_{x}{i}") for i in range(len(rec.LEAVES)) for x in kinds]))
    if poisson:
        # the few rows are spread first, as each becomes up to `replicates`
        drawn = poisson_weights(per_pair.repartition(int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions")), key), key, replicates, seed)
    else:
        n = per_pair.count()
        drawn = ordinals(per_pair, key).join(multinomial_weights(scored.sparkSession, max(n, 1), replicates, seed), "_at")
    sums = drawn.groupBy("replicate").agg((F.sum(F.col("_exact") * F.col("w")) / F.sum("w")).alias("exact_match"),
                                          *[F.sum(F.col(f"_{x}{i}") * F.col("w")).alias(f"_{x}{i}") for i in range(len(rec.LEAVES)) for x in kinds])
    sums = durable(sums)
    leaves = F.array(*[F.struct(F.lit(leaf.path).alias("field"), *[F.col(f"_{x}{i}").alias(x) for x in kinds], F.lit(0).alias("tn")) for i, leaf in enumerate(rec.LEAVES)])
    c = sums.select("replicate", F.explode(leaves).alias("l")).select("replicate", "l.*")
    f = roll_up(c, ("replicate",)).filter(F.col("metric").isin("micro_f1", "macro_f1")).groupBy("replicate").pivot("metric", ["micro_f1", "macro_f1"]).agg(F.first("value"))
    return f.join(sums.select("replicate", "exact_match"), "replicate")


def paired_test(a: DataFrame, b: DataFrame, key: str, metric: str = "micro_f1", replicates: int = 1000, seed: int = 17) -> DataFrame:
    """(observed, p_value): share of resamples of the shared pairs whose difference is off the observed one by at least its
    size; no row pair shared gives NaN."""
    shared = a.select(key).join(b.select(key), key).distinct()
    if shared.isEmpty():
        return a.sparkSession.createDataFrame([(None, float("nan"))], "observed double, p_value double")
    xs, ys = a.join(shared, key), b.join(shared, key)

    def point(s):
        return roll_up(field_counts(s)).filter(F.col("metric") == metric).select("value")

    observed = point(xs).first()[0] - point(ys).first()[0]
    d = (bootstrap(xs, key, replicates, seed).select("replicate", F.col(metric).alias("x"))
         .join(bootstrap(ys, key, replicates, seed).select("replicate", F.col(metric).alias("y")), "replicate").select((F.col("x") - F.col("y")).alias("d")))
    return d.agg(F.lit(observed).alias("observed"), F.avg((F.abs(F.col("d") - observed) >= abs(observed)).cast("double")).alias("p_value"))


# ---- failures and comparisons -------------------------------------------------------------------


def failure_tags(gold: Column, pred: Column, ungrounded: Column) -> Column:
    """Sorted tags of what is wrong with a pair: unparseable alone, or any of the others."""
    tags = [F.when(F.size(ungrounded) > 0, "ungrounded")]
    for x in rec.LEAVES:
        g, p = rec.leaf(gold, x.path), rec.leaf(pred, x.path)
        differs = ~F.coalesce(g, _empty()).eqNullSafe(F.coalesce(p, _empty())) if x.is_set else ~g.eqNullSafe(p)
        g_none, p_none = rec.is_null(g, x), rec.is_null(p, x)
        if x.path.startswith("salary."):
            tags.append(F.when(differs, "salary_misparse"))
            continue
        wrong = {"categorical": "enum_confusion", "set": "set_partial"}.get(x.comparator)
        tags.append(F.when(differs & g_none & ~p_none, "over_emission").when(differs & ~g_none & p_none, "missed_extraction").when(differs, F.lit(wrong)))
    some = F.array_sort(F.array_distinct(F.filter(F.array(*tags), lambda t: t.isNotNull())))
    return F.when(pred.isNull() | gold.isNull(), F.array(F.lit("unparseable"))).otherwise(some)


def failure_histogram(df: DataFrame, tags: str) -> DataFrame:
    """(tag, n, share of the rows that have any tag)."""
    failing = df.filter(F.size(tags) > 0)
    total = failing.agg(F.count("*")).scalar()
    return failing.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).select("tag", "n", F.round(F.col("n") / total, 6).alias("share"))


def gap_closed(base: Column, ours: Column, ceiling: Column, lower_better: Column | bool = False) -> Column:
    """(ours - base) / (ceiling - base), turned round where lower is better; null if the gap is nothing."""
    sign = F.when(F.lit(lower_better) if isinstance(lower_better, bool) else lower_better, -1.0).otherwise(1.0)
    gap = (ceiling - base) * sign
    return F.when(gap > 1e-9, (ours - base) * sign / gap)


def metric_deltas(a: DataFrame, b: DataFrame, limit: float = 0.02) -> DataFrame:
    """(metric, a, b, delta, regression) of two (metric, value) tables; latency is never a regression."""
    both = a.select("metric", F.col("value").alias("a")).join(b.select("metric", F.col("value").alias("b")), "metric")
    worse = F.when(F.col("metric").isin(*LOWER_IS_BETTER), F.col("b") - F.col("a")).otherwise(F.col("a") - F.col("b"))
    return both.select("metric", "a", "b", (F.col("b") - F.col("a")).alias("delta"), ((worse > limit) & (F.col("metric") != "mean_latency_s")).alias("regression"))


def comparison(runs: dict[str, DataFrame], key: str = "metric", value: str = "value") -> DataFrame:
    """metric x run matrix of (metric, value) tables; refuses runs of different size where they have `n`."""
    rows = None
    for label, df in runs.items():
        part = df.select(key, value).withColumn("run", F.lit(label))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(key).pivot("run", list(runs)).agg(F.first(value))


def disagreements(a: DataFrame, b: DataFrame, key: str, record: str) -> DataFrame:
    """(field, n_pairs, n_differ) of the records that two runs gave one key; two nulls are the same."""
    both = a.select(key, F.col(record).alias("_a")).join(b.select(key, F.col(record).alias("_b")), key)
    rows = F.explode(F.array(*[F.struct(F.lit(x.path).alias("field"), (~rec.leaf(F.col("_a"), x.path).eqNullSafe(rec.leaf(F.col("_b"), x.path))).cast("int").alias("d")) for x in rec.LEAVES])).alias("r")
    return both.select(rows).groupBy("r.field").agg(F.count("*").alias("n_pairs"), F.sum("r.d").alias("n_differ"))
