"""Sources mixed to target shares of all tokens, by entropy balancing.

Each document gets a rate r = min(max_repeats, exp(lambda_source x tokens / mean tokens)): of all rates
that give a source its tokens, those nearest to one copy each in relative entropy. The convex dual has
one lambda a source; its Newton steps need only sums over (source, tokens) counts, which Spark adds up
anew in each step from a pre-aggregated table. Rates are then rounded to whole copies by a hash draw,
whose threshold is moved for each source until the copies have the wanted tokens.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import durable
from . import tokens
from .hashing import draw

#: Most sources a table of targets may have; they are held by the driver.
MOST_SOURCES = 10_000
#: Cells of the histogram of draws by which the rounding is made to meet the wanted tokens.
CELLS = 4096


def _sums(counts: DataFrame, lambdas: dict[str, float]) -> dict[str, tuple[float, float]]:
    """Source -> (tokens at the rates of these lambdas, their derivative)."""
    spark = counts.sparkSession
    at = F.broadcast(spark.createDataFrame(sorted(lambdas.items()), "source string, lambda double"))
    rate = F.exp(F.least(F.col("lambda") * F.col("n_tokens") / F.col("mean"), F.lit(700.0)))
    rows = (counts.join(at, "source").withColumn("free", rate < F.col("max_repeats"))
            .withColumn("r", F.least(rate, F.col("max_repeats").cast("double")))
            .groupBy("source").agg(F.sum(F.col("n") * F.col("n_tokens") * F.col("r")).alias("got"),
                                   F.sum(F.when(F.col("free"), F.col("n") * F.col("n_tokens") * F.col("n_tokens") / F.col("mean") * F.col("r")).otherwise(0.0)).alias("slope")))
    return {r.source: (r.got, r.slope) for r in rows.collect()}


def solve(counts: DataFrame, wanted: dict[str, float], rounds: int = 200, tolerance: float = 1e-7) -> tuple[dict[str, float], set[str]]:
    """(lambda of each source, sources that fall short with every rate at its cap), by Newton steps kept inside a shrinking bracket.

    A source falls short when its tokens are fewer than wanted where the dual's slope has become nothing: no rate
    can rise any more. Raises if a source is unsolved after `rounds`.
    """
    lambdas = {s: 0.0 for s in wanted}
    bracket = {s: [-math.inf, math.inf] for s in wanted}
    open_, short = set(wanted), set()
    for _ in range(rounds):
        if not open_:
            return lambdas, short
        sums = _sums(counts, {s: lambdas[s] for s in open_})
        for s in sorted(open_):
            got, slope = sums.get(s, (0.0, 0.0))
            miss = wanted[s] - got
            if abs(miss) <= tolerance * max(wanted[s], 1.0):
                open_.discard(s)
                continue
            if miss > 0 and slope == 0:
                open_.discard(s)
                short.add(s)
                continue
            low, high = bracket[s]
            low, high = (lambdas[s], high) if miss > 0 else (low, lambdas[s])
            bracket[s] = [low, high]
            most = max(2.0, abs(lambdas[s]))
            step = lambdas[s] + max(-most, min(most, miss / slope if slope > 0 else math.copysign(most, miss)))
            if not low < step < high:
                step = (low + high) / 2 if math.isfinite(low + high) else lambdas[s] + math.copysign(most, miss)
            if step == lambdas[s] or high - low < 1e-13 * max(1.0, abs(step)):
                open_.discard(s)
            lambdas[s] = step
    if open_:
        raise RuntimeError(f"no rates were found for {sorted(open_)[:5]}")
    return lambdas, short


def mixture(documents: DataFrame, targets: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source",
            weight: str = "target_weight", repeats: str = "max_repeats", ranks: str = tokens.RANKS) -> tuple[DataFrame, DataFrame]:
    """(copies, report) of a mixture of as many tokens as all documents have.

    copies: (doc_id, source, n_tokens, rate, copies), every document of a target source, copies from 0 to max_repeats.
    report: (source, target_weight, max_repeats, n_docs, tokens, wanted, reached, share of the mixture, share_of_total, unmet); `unmet`
    sources are those that the dual leaves short with every rate at its cap, i.e. each document used
    max_repeats times; the share reached is reported. Documents of other or null sources are not used but count in the total;
    null and empty texts have no tokens and get no copies; targets without documents are reported with
    0 tokens; repeated documents each count.
    """
    known = targets.select(F.col(source).alias("source"), F.col(weight).cast("double").alias("target_weight"), F.col(repeats).cast("int").alias("max_repeats"))
    known = known.filter(F.col("source").isNotNull())
    counted = durable(tokens.with_counts(documents.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text")), "text", ["doc_id", "source"], ranks)
                      .na.fill(0, ["n_tokens"]))
    counts = durable(counted.groupBy("source", "n_tokens").agg(F.count("*").alias("n")))
    by_source = counts.groupBy("source").agg(F.sum("n").alias("n_docs"), F.sum(F.col("n") * F.col("n_tokens")).alias("tokens"))
    total = counts.agg(F.sum(F.col("n") * F.col("n_tokens"))).first()[0] or 0
    plan = known.join(by_source, "source", "left").na.fill(0, ["n_docs", "tokens"]).withColumn("wanted", F.col("target_weight") * F.lit(float(total)))
    rows = plan.limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError("too many sources to mix")
    spark = documents.sparkSession
    shape = "source string, max_repeats int, mean double"
    stocked = [r for r in rows if r.tokens]
    limits = F.broadcast(spark.createDataFrame([(r.source, r.max_repeats, r.tokens / r.n_docs) for r in stocked], shape))
    lambdas, short = solve(counts.join(limits, "source"), {r.source: r.wanted for r in stocked}) if stocked else ({}, set())
    short |= {r.source for r in rows if not r.tokens and r.wanted > 0}
    rates = [(r.source, r.max_repeats, (r.tokens / r.n_docs) if r.n_docs and r.tokens else 1.0, None if r.source in short else lambdas.get(r.source), r.source in short) for r in rows]
    at = F.broadcast(spark.createDataFrame(rates, shape + ", lambda double, short boolean"))
    free = F.least(F.exp(F.least(F.col("lambda") * F.col("n_tokens") / F.col("mean"), F.lit(700.0))), F.col("max_repeats").cast("double"))
    rated = (counted.join(at, "source")
             .withColumn("rate", F.when(F.col("n_tokens") == 0, 0.0).otherwise(F.coalesce(free, F.col("max_repeats").cast("double"))))
             .withColumn("whole", F.floor("rate").cast("int"))
             # one copy more where the draw is under the fraction; `cell` orders the documents by how near they are to that
             .withColumn("cell", F.when((F.col("rate") >= F.col("max_repeats")) | (F.col("n_tokens") == 0), 2 * CELLS)
                         .otherwise(F.floor((draw(F.lit("mix"), F.col("doc_id")) - F.col("rate") + F.col("whole") + 1) * CELLS)).cast("int")))
    cells = rated.groupBy("source", "cell").agg(F.sum(F.col("whole") * F.col("n_tokens")).alias("sure"), F.sum("n_tokens").alias("more"))
    by = Window.partitionBy("source")
    edge = (cells.join(plan.select("source", "wanted"), "source")
            .withColumn("sure", F.sum("sure").over(by))
            .withColumn("so_far", F.sum("more").over(by.orderBy("cell")))
            .filter((F.col("cell") < 2 * CELLS) & (F.col("sure") + F.col("so_far") - F.col("more") / 2 <= F.col("wanted")))
            .groupBy("source").agg(F.max("cell").alias("edge")))
    copies = (rated.join(F.broadcast(edge), "source", "left")
              .withColumn("copies", F.col("whole") + F.coalesce(F.col("cell") <= F.col("edge"), F.lit(False)).cast("int"))
              .select("doc_id", "source", "n_tokens", "rate", "copies"))
    reached = copies.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("reached"))
    report = (plan.join(at.select("source", "short"), "source").join(reached, "source", "left").na.fill(0, ["reached"]).withColumn("whole", F.sum("reached").over(Window.partitionBy()))
              .select("source", "target_weight", "max_repeats", "n_docs", "tokens", "wanted", "reached", F.try_divide(F.col("reached"), F.col("whole")).alias("share"),
                      F.try_divide(F.col("reached"), F.lit(float(total))).alias("share_of_total"),
                      (F.col("short") & (F.col("reached") < F.col("wanted"))).alias("unmet")))
    return copies, report
