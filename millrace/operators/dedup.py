"""Exact and near-duplicate removal.

Exact: the first of each content hash. Near: min-hash signatures over runs of five words, banded; equal
bands are joined by key, each candidate is verified by the exact Jaccard similarity, and an ordered
greedy elimination keeps a text unless a kept earlier one is similar.

Texts with the same sequence of words form one class from the start, so that copies, however many,
weigh as one; only classes are compared. No bucket is gathered: bands meet in an equi-join, which
adaptive execution splits where a key is hot.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.wordcodes import chunks, distinct_by_row, mix, shingles, words
from ..runtime import durable, ship

K = 5
#: At the threshold a band agrees with at least this chance; so many bands miss one pair in 1,300 there.
BAND_CHANCE, BANDS = 0.165, 40
#: Undecided links that one task may fold when few are left.
REST = 200_000


def band_rows(threshold: float) -> int:
    """Min-hashes in a band: 8 at 0.8, 6 at 0.75."""
    return max(1, int(math.log(BAND_CHANCE) / math.log(threshold))) if threshold < 1 else 8


def exact_first(df: DataFrame, key: Column, order: Column | str) -> DataFrame:
    """The first row by `order` of each key; rows with a null key are one group."""
    o = F.col(order) if isinstance(order, str) else order
    names = df.columns
    picked = df.groupBy(key.alias("_key")).agg(F.min_by(F.struct(*names), o).alias("_row"))
    return picked.select(*[F.col("_row")[n].alias(n) for n in names])


def _runs_of(part: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class of each text, codes of its runs, the text of each code), by text; a text of under K words is one run of all its words."""
    h, owner, *_ = words(part)
    n = len(part)
    # order-dependent hash of all words: the class of texts with the same words
    cls = np.zeros(n, np.uint64)
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)
    if len(starts):
        place = np.arange(len(h)) - np.repeat(starts, np.diff(np.r_[starts, len(h)]))
        cls[owner[starts]] = np.add.reduceat(mix(h ^ mix(place.astype(np.uint64) + np.uint64(1))), starts)
    short = np.bincount(owner, minlength=n) < K
    codes, rows_of, _ = shingles(h, owner, K)
    codes, rows_of = np.r_[codes, cls[short]], np.r_[rows_of, np.flatnonzero(short)]
    order = np.argsort(rows_of, kind="stable")
    return cls, codes[order], rows_of[order]


def _codes(rows: int, bands: int):
    seeds = mix(np.arange(1, 2 * rows * bands + 1, dtype=np.uint64))
    a, b = seeds[: rows * bands] | np.uint64(1), seeds[rows * bands :]

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for at, part in chunks(batch.column(1)):
                n = len(part)
                cls, codes, rows_of = _runs_of(part)
                first = np.flatnonzero(np.r_[True, rows_of[1:] != rows_of[:-1]])
                keys = np.zeros((n, bands), np.uint64)
                for t in range(bands):
                    key = np.full(n, t + 1, np.uint64)
                    for j in range(t * rows, (t + 1) * rows):
                        x = codes * a[j] + b[j]
                        key = mix(key ^ np.minimum.reduceat(x ^ (x >> np.uint64(29)), first))
                    keys[:, t] = key
                lists = pa.ListArray.from_arrays(np.arange(0, n * bands + 1, bands, dtype=np.int32), pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.slice(at, n), pa.array(cls.view(np.int64)), lists], ["id", "cls", "bands"])
    return run


def _run_lists(batches):
    for batch in batches:
        for at, part in chunks(batch.column(1)):
            _, codes, rows_of = _runs_of(part)
            codes, rows_of = distinct_by_row(codes, rows_of)
            offsets = np.searchsorted(rows_of, np.arange(len(part) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(codes.view(np.int64)))], ["cls", "runs"])


def signatures(df: DataFrame, id_col: str, text: str, rows: int = 8, bands: int = BANDS) -> DataFrame:
    """(id, cls, bands): class of equal word sequences and the band keys of the min-hash signature. Null texts have none."""
    ship(df.sparkSession)
    kind = df.select(id_col).schema[0].dataType.simpleString()
    rows_in = df.select(F.col(id_col).alias("id"), F.col(text)).filter(F.col(text).isNotNull())
    return rows_in.mapInArrow(_codes(rows, bands), f"id {kind}, cls long, bands array<long>")


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays of different runs."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def _verified(near: DataFrame, texts_a: DataFrame, texts_b: DataFrame, threshold: float) -> DataFrame:
    """(cls_a, cls_b, similarity) of the candidates that are similar; `texts` are (cls, text) of the classes that candidates name.

    Runs are compared as sorted lists of 64-bit codes, made once per class.
    """
    def runs(texts: DataFrame, side: str) -> DataFrame:
        return texts.mapInArrow(_run_lists, "cls long, runs array<long>").select(F.col("cls").alias(f"cls_{side}"), F.col("runs").alias(f"runs_{side}"))

    pairs = near.join(runs(texts_a, "a"), "cls_a").join(runs(texts_b, "b"), "cls_b")
    return pairs.select("cls_a", "cls_b", jaccard(F.col("runs_a"), F.col("runs_b")).alias("similarity")).filter(F.col("similarity") >= threshold)


def similar_classes(df: DataFrame, id_col: str, text: str, threshold: float = 0.8, rows: int | None = None, bands: int = BANDS) -> tuple[DataFrame, DataFrame]:
    """(members, links).

    members: (id, cls) of every row with a text. links: (cls_a < cls_b, similarity >= threshold) between
    classes of different texts. At 0.8 a pair is a candidate with probability 1 - (1 - 0.8^8)^40 = 0.9994,
    at 0.85 0.999997; every candidate is verified on the whole texts.
    """
    coded = durable(signatures(df, id_col, text, rows or band_rows(threshold), bands))
    members = coded.select("id", "cls")
    heads = coded.groupBy("cls").agg(F.min("id").alias("id"), F.first("bands").alias("bands"))
    keyed = heads.select("cls", F.explode("bands").alias("band"))
    left, right = keyed.select("band", F.col("cls").alias("cls_a")), keyed.select("band", F.col("cls").alias("cls_b"))
    near = durable(left.join(right, "band").filter("cls_a < cls_b").select("cls_a", "cls_b").distinct())
    needed = near.select(F.col("cls_a").alias("cls")).unionByName(near.select(F.col("cls_b").alias("cls"))).distinct()
    wanted = heads.select("cls", "id").join(needed, "cls", "left_semi")
    texts = df.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(wanted, "id").dropDuplicates(["cls"]).select("cls", "text")
    return members, _verified(near, texts, texts, threshold)


def near_copies_across(a: DataFrame, b: DataFrame, id_col: str, text: str, threshold: float = 0.6, rows: int = 6, bands: int = 96) -> DataFrame:
    """(id, similarity): the ids of `b` whose text is similar to a text of `a`, with their best similarity.

    At 0.6 a pair is a candidate with probability 1 - (1 - 0.6^6)^96 = 0.99, at 0.65 0.9993; candidates are
    verified on the whole texts. Null texts and ids are in no pair; repeated ids come out once.
    """
    sides, blocks, members = {}, {}, {}
    for n, df in (("a", a), ("b", b)):
        coded = durable(signatures(df, id_col, text, rows, bands))
        members[n] = coded.filter(F.col("id").isNotNull()).select("id", F.col("cls").alias(f"cls_{n}")).distinct()
        blocks[n] = coded.groupBy("cls").agg(F.first("bands").alias("bands")).select(F.col("cls").alias(f"cls_{n}"), F.explode("bands").alias("band"))
        sides[n] = df.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(coded.groupBy("cls").agg(F.min("id").alias("id")), "id")
    near = durable(blocks["a"].join(blocks["b"], "band").select("cls_a", "cls_b").distinct())
    texts = [sides[n].join(near.select(F.col(f"cls_{n}").alias("cls")).distinct(), "cls", "left_semi").dropDuplicates(["cls"]).select("cls", "text") for n in ("a", "b")]
    links = _verified(near, *texts, threshold)
    return links.join(members["b"], "cls_b").groupBy("id").agg(F.max("similarity").alias("similarity"))


def _fold(batches):
    """Links in the order of their later class: a class is dropped by an earlier one that isn't."""
    dropped: dict[int, None] = {}
    for pdf in batches:
        for early, late in zip(pdf["early"].tolist(), pdf["late"].tolist()):
            if early not in dropped:
                dropped[late] = None
    yield pd.DataFrame({"cls": np.array(list(dropped), np.int64)})


def greedy_keepers(nodes: DataFrame, links: DataFrame, rest: int = REST) -> DataFrame:
    """(cls, keeper): the earliest kept class that a class is similar to, itself if it is kept.

    `nodes` is (cls, ord), `links` undirected (cls_a, cls_b). A class is kept if no kept earlier class is
    linked to it: the rule of one pass in order, computed in rounds. Each round keeps the classes without
    an earlier undecided neighbour and drops their neighbours; only undecided links travel on. Once no more than
    `rest` links are undecided (long chains are decided by few a round), one task folds them in order.
    """
    places = nodes.select("cls", "ord")
    a = places.select(F.col("cls").alias("cls_a"), F.col("ord").alias("ord_a"))
    b = places.select(F.col("cls").alias("cls_b"), F.col("ord").alias("ord_b"))
    placed = links.select("cls_a", "cls_b").join(a, "cls_a").join(b, "cls_b")
    before = (F.col("ord_a") < F.col("ord_b")) | ((F.col("ord_a") == F.col("ord_b")) & (F.col("cls_a") < F.col("cls_b")))
    live = placed.select(F.when(before, F.col("cls_a")).otherwise(F.col("cls_b")).alias("early"), F.when(before, F.col("cls_b")).otherwise(F.col("cls_a")).alias("late"),
                         F.least("ord_a", "ord_b").alias("early_ord"), F.greatest("ord_a", "ord_b").alias("late_ord"))
    live = durable(live.distinct())
    linked = live
    dropped = None
    while left := live.count():
        if left <= rest:
            folded = durable(live.repartition(1).sortWithinPartitions("late_ord", "late").select("early", "late").mapInPandas(_fold, "cls long"))
            dropped = folded if dropped is None else dropped.unionByName(folded)
            break
        heads = live.select(F.col("early").alias("cls")).join(live.select(F.col("late").alias("cls")), "cls", "left_anti").distinct()
        gone = live.join(heads.withColumnRenamed("cls", "early"), "early", "left_semi").select(F.col("late").alias("cls")).distinct()
        gone = durable(gone)
        dropped = gone if dropped is None else dropped.unionByName(gone)
        live = durable(live.join(gone.withColumnRenamed("cls", "early"), "early", "left_anti").join(gone.withColumnRenamed("cls", "late"), "late", "left_anti")
                       .join(heads.withColumnRenamed("cls", "early"), "early", "left_anti"))
    if dropped is None:
        return nodes.select("cls", F.col("cls").alias("keeper"))
    dropped = dropped.distinct()
    keeper = (linked.join(dropped.withColumnRenamed("cls", "late"), "late", "left_semi").join(dropped.withColumnRenamed("cls", "early"), "early", "left_anti")
              .groupBy(F.col("late").alias("cls")).agg(F.min_by("early", F.struct("early_ord", "early")).alias("keeper")))
    return nodes.select("cls").join(keeper, "cls", "left").select("cls", F.coalesce("keeper", "cls").alias("keeper"))


def deduplicate(df: DataFrame, id_col: str, text: str, order: Column | None = None, threshold: float = 0.8) -> DataFrame:
    """(id, class_id, n_links, status): one row for each row with a text.

    class_id is the id of the kept row that a row is a duplicate of (its own if it is kept); n_links the
    number of different similar texts; status kept, exact (same words as an earlier row) or near. Null texts are
    left out; blank texts are copies of each other; repeated ids are each answered.
    """
    members, links = similar_classes(df, id_col, text, threshold)
    links = durable(links)
    place = (order if order is not None else F.col(id_col))
    orders = df.select(F.col(id_col).alias("id"), place.alias("ord")).distinct()
    heads = members.join(orders, "id").groupBy("cls").agg(F.min_by("id", F.struct("ord", "id")).alias("head"), F.min("ord").alias("ord"))
    heads = durable(heads)
    keepers = greedy_keepers(heads, links)
    degree = (links.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("n_links")))
    kept = keepers.join(heads.select(F.col("cls").alias("keeper"), F.col("head").alias("class_id")), "keeper").join(heads.select("cls", "head"), "cls").join(degree, "cls", "left")
    return (members.join(kept, "cls")
            .select("id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
                    F.when(F.col("id") != F.col("head"), "exact").when(F.col("head") != F.col("class_id"), "near").otherwise("kept").alias("status")))


def dedup_report(result: DataFrame) -> DataFrame:
    """Rows in, kept, and dropped as exact and as near copies."""
    return result.agg(F.count("*").alias("n_in"), *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("kept", "exact", "near")])
