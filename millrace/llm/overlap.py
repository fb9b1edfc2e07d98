"""Same or near-same texts across splits, by similarity-hash bit fingerprints.

1. One pass counts how many texts hold each run of k words, by lossy counting per partition, and tells
   stock (runs that very many texts hold) from the other, rare runs.
2. Each distinct text gets two bit fingerprints: FIELDS fields of 32 bits, the min-hashes of its rare and
   of its stock runs. Field by field the lesser of the two is the min-hash of all runs; two bits of
   each of the first HAMMING fields are the fingerprint by which a candidate is judged.
3. Blocks cut from the fingerprints (a few neighbouring fields each) meet across the two sides. A pair
   of similarity t shares either a part RARE_PART of t of its rare runs, and then blocks of the rare
   fingerprint, or much of its stock: how much at the least follows from the numbers of runs of the
   text with fewer rare runs for its stock (the lighter) and of the other, and the more it is the wider
   are the blocks of the stock fingerprint by which they meet. So no text is left to rare runs alone,
   and common sentences bring few candidates unless whole sets of them agree in texts with little else.
4. Candidates within the Hamming radius over all runs are verified on the whole texts: shared runs /
   runs that either has.

A plain sign-of-sum fingerprint is not used: at 60 % shared runs it differs in about 23 % of its
bits, so that blocks selective enough for millions of texts (17 bits) would need some 390 tables for
99 % recall.

Exact copies form one class from the start; links are found between classes and spread to members.
"""
from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.wordcodes import chunks, distinct_by_row, mix, shingles, words
from ..runtime import durable, ship

#: A run is stock when it stands in more than this share of the texts (and in at least STOCK_LEAST).
STOCK_SHARE, STOCK_LEAST = 0.002, 30
#: Rare blocks find the pairs that share at least this part of the threshold of their rare runs; stock blocks find the rest.
RARE_PART = 5 / 9
#: Blocks of the rare fingerprint: so many, each as wide as a pair at that limit still shares with this probability.
RARE_BLOCKS, RARE_CHANCE = 32, 0.1
#: Blocks of the stock fingerprint: so many of each width, as multiples of the narrowest, used where the fields of a block all
#: agree with this chance.
STOCK_BLOCKS, STOCK_CHANCE, STOCK_WIDTHS = 10, 0.3, (1, 2, 3, 4.5, 7)
#: Two-bit symbols of the fingerprint that the radius is measured on, and standard deviations of their number that are allowed.
HAMMING, DEVIATIONS = 128, 4.0
#: Texts of one task whose copies are folded before they travel.
REMEMBERED = 1 << 20


def _lossy_counts(k: int, error: float):
    def run(batches):
        kept, counts, seen = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        for batch in batches:
            for _, part in chunks(batch.column(0)):
                h, rows, *_ = words(part)
                codes, rows, _ = shingles(h, rows, k)
                codes, _ = distinct_by_row(codes, rows)
                seen += len(part)
                new, n = np.unique(codes, return_counts=True)
                both = np.concatenate([kept, new])
                kept, at = np.unique(both, return_inverse=True)
                counts = np.bincount(at, np.concatenate([counts, n])).astype(np.int64)
                live = counts > error * seen
                if seen > 1 / error:
                    kept, counts = kept[live], counts[live]
        if seen:
            live = counts >= 2
            codes = pa.concat_arrays([pa.array(kept[live].view(np.int64)), pa.nulls(1, pa.int64())])
            yield pa.RecordBatch.from_arrays([codes, pa.array(np.r_[counts[live], seen])], ["code", "n"])
    return run


def stock_runs(texts: DataFrame, text: str, k: int = 5, share: float = STOCK_SHARE, least: int = STOCK_LEAST) -> np.ndarray:
    """Sorted hashes of the runs of k words that more than `share` of the texts (and `least`) hold.

    All texts are counted, in one pass that counts the rows as well. A run under a quarter of `share`
    within a partition may be missed there, so that a count is short by at most share / 4 of the texts;
    hence the limit is 3/4 of `share`. At most (runs per text) / (0.75 share) runs can qualify,
    whatever the size of the data; that bounds what comes back.
    """
    ship(texts.sparkSession)
    counted = texts.select(text).mapInArrow(_lossy_counts(k, share / 4), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    counted = durable(counted.filter((F.col("n") >= least) | F.col("code").isNull()))
    total = counted.filter("code is null").agg(F.sum("n")).first()[0] or 0
    rows = counted.filter(F.col("code").isNotNull() & (F.col("n") >= max(least, share * 0.75 * total))).select("code").collect()
    return np.sort(np.array([r.code for r in rows], np.int64).view(np.uint64))


def _width(chance: float, similarity: float) -> int:
    """The widest block whose fields all agree with at least this chance."""
    return max(1, int(math.log(chance) / math.log(similarity) + 1e-9)) if 0 < similarity < 1 else 1


def _plan(threshold: float) -> tuple[int, list[tuple[int, float]], int]:
    """(width of the rare blocks, (width, least similarity of stock) of each level of stock blocks, fields)."""
    rare = _width(RARE_CHANCE, RARE_PART * threshold)
    widths = [int(_width(STOCK_CHANCE, threshold) * times) for times in STOCK_WIDTHS]
    levels = [(w, STOCK_CHANCE ** (1 / w) if i else 0.0) for i, w in enumerate(widths)]
    return rare, levels, max(HAMMING, rare * RARE_BLOCKS, widths[-1] * STOCK_BLOCKS)


def radius(threshold: float) -> int:
    """Symbols in which the fingerprints of a pair at the threshold differ, up to DEVIATIONS."""
    p = (1 - threshold) * 3 / 4
    return int(HAMMING * p + DEVIATIONS * math.sqrt(HAMMING * p * (1 - p)))


def _minima(codes: np.ndarray, groups: np.ndarray, n_groups: int, fields: int) -> np.ndarray:
    """(group, field) min-hashes of the codes of each group, which stand in order; all bits set for a group without codes."""
    out = np.full((n_groups, fields), np.uint32(0xFFFFFFFF), np.uint32)
    if len(codes):
        first = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
        short = (codes >> np.uint64(32)).astype(np.uint32)
        seeds = mix(np.arange(1, 2 * fields + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        a, b = (seeds[:fields] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[fields:] >> np.uint64(32)).astype(np.uint32)
        for j in range(fields):
            x = short * a[j] + b[j]
            x ^= x >> np.uint32(15)
            out[groups[first], j] = np.minimum.reduceat(x, first)
    return out


def _blocks(minima: np.ndarray, width: int, blocks: int, tag: int) -> np.ndarray:
    out = np.empty((len(minima), blocks), np.uint64)
    for t in range(blocks):
        key = np.full(len(minima), tag * 1000 + t + 1, np.uint64)
        for j in range(t * width, (t + 1) * width):
            key = mix(key ^ minima[:, j])
        out[:, t] = key
    return out


def _fingerprints(k: int, stock: np.ndarray, threshold: float, side: int):
    """`side` is 0 or 1: stock blocks of the lighter texts of one side meet those of the partners of the other."""
    rare_width, levels, fields = _plan(threshold)
    shared = RARE_PART * threshold
    rise = (threshold - shared) / (1 + shared)

    def coded(cls: np.ndarray, part: pa.Array):
        h, rows, *_ = words(part)
        codes, rows, _ = shingles(h, rows, k)
        codes, rows = distinct_by_row(codes, rows)
        if not len(codes):
            return None
        common = np.zeros(len(codes), bool)
        if len(stock):
            common = stock[np.minimum(np.searchsorted(stock, codes), len(stock) - 1)] == codes
        n = len(part)
        n_stock = np.bincount(rows[common], minlength=n)
        n_rare = np.bincount(rows, minlength=n) - n_stock
        rare, often = _minima(codes[~common], rows[~common], n, max(HAMMING, rare_width * RARE_BLOCKS)), _minima(codes[common], rows[common], n, fields)
        symbols = ((np.minimum(rare[:, :HAMMING], often[:, :HAMMING]) >> np.uint32(9)) & np.uint32(3)).reshape(n, HAMMING // 32, 32).astype(np.uint64)
        prints = (symbols << np.arange(0, 64, 2, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)
        owners, keys = [], []

        def emit(chosen: np.ndarray, minima: np.ndarray, width: int, blocks: int, tag: int) -> None:
            owners.append(np.repeat(chosen, blocks))
            keys.append(_blocks(minima[chosen], width, blocks, tag).ravel())

        emit(np.flatnonzero(n_rare), rare, rare_width, RARE_BLOCKS, 0)
        # A pair of similarity t that shares under m of its rare runs makes up for it by stock: with s and r the runs that either
        # has, s_shared >= t s + (t - m) r. For each text r >= n_rare and s <= n_stock / similarity; for both, r > (sum of n_rare)
        # / (1 + m) and s = (sum of n_stock) / (1 + similarity), where the sums' ratio is no less than that of the lighter text.
        with np.errstate(divide="ignore", invalid="ignore"):
            heavy = np.where(n_stock > 0, n_rare / n_stock, np.inf)
            as_partner = np.where(heavy * (threshold - shared) < 1, threshold / (1 - heavy * (threshold - shared)), 2.0)
            as_lighter = np.where(heavy * rise < 1, (threshold + heavy * rise) / (1 - heavy * rise), 2.0)
        for tag, least in ((side, as_lighter), (1 - side, as_partner)):
            for level, (width, _) in enumerate(levels):
                # a text also emits the wider blocks, by which it meets those that need more in common
                above = levels[level + 1][1] if level + 1 < len(levels) else 2.0
                emit(np.flatnonzero((least <= 1 + 1e-9) & (least < above)), often, width, STOCK_BLOCKS, 2 * level + tag + 1)
        owner, key = np.concatenate(owners), np.concatenate(keys)
        order = np.argsort(owner, kind="stable")
        held = np.unique(rows)
        offsets = np.searchsorted(owner[order], np.arange(n + 1)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(key[order].view(np.int64)))
        words_of = pa.FixedSizeListArray.from_arrays(pa.array(prints.ravel().view(np.int64)), HAMMING // 32).cast(pa.list_(pa.int64()))
        columns = [pa.array(cls), pa.array((n_rare + n_stock).astype(np.int32)), words_of, lists]
        return pa.RecordBatch.from_arrays(columns, ["cls", "runs", "print", "blocks"]).take(pa.array(held))

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            new = []
            for i, c in enumerate(batch.column(0).to_pylist()):
                if c not in seen:
                    seen.add(c)
                    new.append(i)
            if len(seen) > REMEMBERED:
                seen.clear()
            batch = batch.take(pa.array(new, pa.int64()))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at, part in chunks(batch.column(1)):
                out = coded(ids[at : at + len(part)], part)
                if out is not None:
                    yield out
    return run


def _similarity(k: int):
    def run(batches):
        for batch in batches:
            sims = []
            memo: dict[str, set] = {}
            for pair in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                a, b = (memo[t] if t in memo else memo.setdefault(t, runs_of(t, k)) for t in pair)
                n = len(a & b)
                sims.append(n / (len(a) + len(b) - n) if a or b else 0.0)
                if len(memo) > 2000:
                    memo.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims, pa.float64())], ["cls_a", "cls_b", "similarity"])
    return run


def runs_of(text: str, k: int) -> set:
    """The different runs of k consecutive words (a-z, 0-9, lower-cased)."""
    w = re.findall("[a-z0-9]+", text.lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def _differing(a: Column, b: Column) -> Column:
    """Two-bit symbols in which two numbers of 64 bits differ."""
    x = a.bitwiseXOR(b)
    return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))


def class_links(a: DataFrame, b: DataFrame, text: str, *, k: int = 5, threshold: float = 0.6) -> DataFrame:
    """(cls_a, cls_b, similarity) of the distinct texts of `a` and `b` that share at least `threshold`
    of their runs. A class is the 64-bit hash of a text. Null texts and texts under k words link to
    nothing."""
    spark = a.sparkSession
    ship(spark)
    a, b = (side.select(F.col(text).alias("text")).filter("text is not null") for side in (a, b))
    stock = stock_runs(a.unionByName(b), "text", k)

    def coded(texts: DataFrame, side: int) -> DataFrame:
        rows = texts.select(F.xxhash64("text").alias("cls"), "text")
        return durable(rows.mapInArrow(_fingerprints(k, stock, threshold, side), "cls long, runs int, print array<long>, blocks array<long>"))

    def blocks(side: DataFrame, n: str) -> DataFrame:
        # placed by block, so that the join moves nothing again
        return side.select(F.col("cls").alias(f"cls_{n}"), F.explode("blocks").alias("block")).repartition("block").distinct()

    def prints(side: DataFrame, n: str) -> DataFrame:
        return side.select(F.col("cls").alias(f"cls_{n}"), F.col("runs").alias(f"runs_{n}"), F.col("print").alias(f"print_{n}")).dropDuplicates([f"cls_{n}"])

    x, y = coded(a, 0), coded(b, 1)
    met = blocks(x, "a").join(blocks(y, "b"), "block").select("cls_a", "cls_b").distinct()
    apart = sum(_differing(F.col("print_a")[i], F.col("print_b")[i]) for i in range(HAMMING // 32))
    fits = F.least("runs_a", "runs_b") >= F.greatest("runs_a", "runs_b") * threshold - 1e-6
    near = durable(met.join(prints(x, "a"), "cls_a").join(prints(y, "b"), "cls_b").filter(fits & (apart <= radius(threshold))).select("cls_a", "cls_b"))

    def wanted(side: DataFrame, n: str) -> DataFrame:
        rows = side.select(F.xxhash64("text").alias(f"cls_{n}"), F.col("text").alias(f"text_{n}"))
        return rows.join(near.select(f"cls_{n}").distinct(), f"cls_{n}", "left_semi").dropDuplicates([f"cls_{n}"])

    pairs = near.join(wanted(a, "a"), "cls_a").join(wanted(b, "b"), "cls_b").select("cls_a", "cls_b", "text_a", "text_b")
    return pairs.mapInArrow(_similarity(k), "cls_a long, cls_b long, similarity double").filter(F.col("similarity") >= threshold)


def overlaps(a: DataFrame, b: DataFrame, id_col: str, text: str, **kw) -> DataFrame:
    """(id_a, id_b, similarity): every pair of rows' ids across the two tables whose texts overlap.

    A pair comes out once with its best similarity. Null ids, null or blank texts give no pair;
    repeated rows and ties change nothing; an empty side gives no rows; other columns are ignored.
    """
    links = class_links(a, b, text, **kw)

    def members(side: DataFrame, n: str) -> DataFrame:
        return (side.filter(F.col(text).isNotNull() & F.col(id_col).isNotNull())
                .select(F.xxhash64(text).alias(f"cls_{n}"), F.col(id_col).alias(f"id_{n}")).distinct())

    return (links.join(members(a, "a"), "cls_a").join(members(b, "b"), "cls_b")
            .groupBy("id_a", "id_b").agg(F.max("similarity").alias("similarity")))


def overlap_report(pairs: DataFrame, b: DataFrame, id_col: str, split: str, source: str) -> DataFrame:
    """Per split and source of `b`: its ids, those that overlap the other side, and the pairs."""
    sides = b.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id_b"), F.col(split).alias("split"), F.col(source).alias("source")).distinct()
    found = pairs.groupBy("id_b").agg(F.count("*").alias("n_pairs"), F.max("similarity").alias("best"))
    return (sides.join(found, "id_b", "left").groupBy("split", "source")
            .agg(F.count("*").alias("n_records"), F.count("n_pairs").alias("n_leaked"), F.coalesce(F.sum("n_pairs"), F.lit(0)).alias("n_pairs"),
                 F.coalesce(F.sum((F.col("best") >= 1.0).cast("int")), F.lit(0)).alias("n_same")))
