"""Descriptive tables: counters, shares, percentiles by place, stated rates, leakage of keys, guards."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import records as rec
from .order import running


def counter(df: DataFrame, *keys: str) -> DataFrame:
    """(keys..., n), the commonest first, ties by key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys)


def share(df: DataFrame, condition: Column, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(condition.cast("int")).alias("share"))


def place_percentiles(df: DataFrame, value: str, qs: tuple[float, ...]) -> DataFrame:
    """(q, value): the value at place min(n - 1, int(q n)) of the sorted values, which isn't percentile_disc.

    Values are counted first; running counts go over the different values, range by range.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    spans = running(counts, ["v"], F.col("n"))
    total = counts.agg(F.sum("n").alias("total"))
    wanted = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.least(F.col("total") - 1, F.floor(F.lit(q) * F.col("total"))).alias("place")) for q in qs])).alias("w")
    places = total.select(wanted).select("w.*")
    return spans.join(F.broadcast(places), (F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("n"))).select("q", F.col("v").alias("value"))


def stated_rates(df: DataFrame, by: str, record: Column | None = None) -> DataFrame:
    """(by, field, rate): share of the rows in which a leaf states something; one aggregate, then unpivoted."""
    wide = df.groupBy(by).agg(*[F.avg((~rec.is_null(rec.leaf(record, x.path), x)).cast("int")).alias(x.path) for x in rec.LEAVES])
    return wide.unpivot(by, [f"`{x.path}`" for x in rec.LEAVES], "field", "rate")


def shared_keys(a: DataFrame, b: DataFrame, key: Column) -> DataFrame:
    """(key): the different non-null keys that both tables have."""
    return a.select(key.alias("key")).filter("key is not null").intersect(b.select(key.alias("key")))


def windowed_excess(df: DataFrame, ts: str, width: str, limit: int, *by: str) -> DataFrame:
    """Tumbling windows with more than `limit` rows: (window_start, by..., n, excess)."""
    return (df.groupBy(F.window(ts, width).alias("w"), *by).agg(F.count("*").alias("n")).filter(F.col("n") > limit)
            .select(F.col("w.start").alias("window_start"), *by, "n", (F.col("n") - limit).alias("excess")))


def guard_share(df: DataFrame, bad: Column, most: float, message: str) -> DataFrame:
    """`df` as it is, or an error when run if more than `most` of its rows are bad."""
    found = df.agg(F.coalesce(F.avg(bad.cast("int")), F.lit(0.0))).scalar()
    return df.filter(F.assert_true(found <= most, F.lit(message)).isNull())


def guard_least(df: DataFrame, least: int, message: str) -> DataFrame:
    """`df`; refuses it with fewer than `least` rows: what the splits need and 100 to train on, say."""
    if df.limit(least).count() < least:
        raise ValueError(message)
    return df


def provenance(df: DataFrame, split: str, voted: Column) -> DataFrame:
    """(split, n, n_voted, n_single, voted_share): where the labels of each split come from; a null `voted` counts as single."""
    yes = F.count_if(voted)
    return df.groupBy(split).agg(F.count("*").alias("n"), yes.alias("n_voted"), (F.count("*") - yes).alias("n_single"), F.round(yes / F.count("*"), 9).alias("voted_share"))


def guard_same_size(runs: dict[str, DataFrame]) -> int:
    """The number of rows that all runs have; refuses runs of different size."""
    sizes = {k: df.count() for k, df in runs.items()}
    if len(set(sizes.values())) != 1:
        raise ValueError(f"runs of different size can't be compared: {sizes}")
    return next(iter(sizes.values()))
