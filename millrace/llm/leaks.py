"""Passages of evaluation items in a training corpus.

The n-grams of the items (words of a-z and 0-9, lower-cased) are a small hash set that every task
holds; documents are scanned chunk-wise for windows that hit it. Where so many windows of one item as a leaked
stretch must hit lie close together, the words there are aligned with the item's, and a stretch counts that has enough
of the item's words in order with no more than single words changed, left out or added in between.

Stock sentences do not count: n-grams of `STOCK_GRAM` words that several different items share (over all
blocks), or that more than a set share of all different documents hold. Copies count once in both.
"""
from __future__ import annotations

import re
from dataclasses import dataclass
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.wordcodes import chunks, distinct_by_row, mix, shingles, words
from ..runtime import ship

SEED_GRAM = 4
STOCK_GRAM = 8
#: An n-gram is stock if so many different items hold it, or more than this share of the different documents (and so many at least).
STOCK_ITEMS, STOCK_SHARE, STOCK_LEAST = 4, 0.02, 50
#: Items are held by the tasks in blocks of at most so many words.
BLOCK_WORDS = 2_000_000
_WORD = re.compile("[A-Za-z0-9]+")


def _grams(n: int, texts: list[str]):
    h, rows, *_ = words(pa.array(texts, pa.string()))
    codes, at, first = shingles(h, rows, n)
    starts = np.searchsorted(rows, np.arange(len(texts)))
    return codes, at, first - starts[at] if len(at) else first


class _Set:
    """Sorted codes behind a bit table, so that misses cost one look-up."""

    def __init__(self, codes: np.ndarray):
        self.codes = np.unique(codes)
        self.table = np.zeros(1 << 20, bool)
        self.table[(self.codes >> np.uint64(44)).astype(np.int64)] = True

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in `codes`, places in the set) of the members."""
        if not len(self.codes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        maybe = np.flatnonzero(self.table[(codes >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.codes, codes[maybe]), len(self.codes) - 1)
        sure = self.codes[at] == codes[maybe]
        return maybe[sure], at[sure]


def _text_classes(hashes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """A hash of the sequence of words of each of n texts, whatever the layout."""
    out = np.zeros(n, np.uint64)
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, np.int64)
    if len(starts):
        place = np.arange(len(hashes)) - np.repeat(starts, np.diff(np.r_[starts, len(hashes)]))
        out[rows[starts]] = np.add.reduceat(mix(hashes ^ mix(place.astype(np.uint64) + np.uint64(1))), starts)
    return out


def _item_grams(batches):
    for batch in batches:
        for _, part in chunks(batch.column(0)):
            h, rows, *_ = words(part)
            codes, owner, _ = shingles(h, rows, STOCK_GRAM)
            cls = _text_classes(h, rows, len(part))
            yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(cls[owner].view(np.int64))], ["code", "cls"])


def _document_grams(codes: np.ndarray):
    """(code, cls) of each document that holds one of `codes`; a document's class is the least of its n-grams'
    hashes, so that copies with small edits are mostly one class. Code null: every class once."""
    def run(batches):
        known = _Set(codes)
        for batch in batches:
            for _, part in chunks(batch.column(0)):
                h, rows, *_ = words(part)
                found, rows, _ = shingles(h, rows, STOCK_GRAM)
                if not len(found):
                    continue
                first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
                cls = np.zeros(len(part), np.uint64)
                cls[rows[first]] = np.minimum.reduceat(mix(found), first)
                places, at = known.hits(found)
                at, owner = distinct_by_row(at.astype(np.uint64), rows[places])
                held = pa.array(known.codes[at.astype(np.int64)].view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([held, pa.nulls(len(first), pa.int64())]), pa.array(np.r_[cls[owner], cls[rows[first]]].view(np.int64))], ["code", "cls"])
    return run


def _shared_grams(items: DataFrame) -> set[int]:
    """The n-grams that STOCK_ITEMS different items hold, over all blocks."""
    grams = items.select("text").mapInArrow(_item_grams, "code long, cls long").distinct()
    return {r.code % (1 << 64) for r in grams.groupBy("code").count().filter(F.col("count") >= STOCK_ITEMS).select("code").collect()}


@dataclass
class Items:
    """Items of one block: their words, with stock words masked."""

    ids: list
    words: list[list[str]]
    stock: list[list[bool]]
    spread: list[list[bool]]  # of the stock words those that are it because very many documents hold them

    def seeds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code, item, place) of each n-gram without stock words."""
        out = [(c, i, p) for i, w in enumerate(self.words) for c, p in zip(*self._codes(w)) if not any(self.stock[i][p : p + SEED_GRAM])]
        c, i, p = zip(*out) if out else ((), (), ())
        return np.array(c, np.uint64), np.array(i, np.int64), np.array(p, np.int64)

    @staticmethod
    def _codes(w: list[str]):
        codes, _, first = _grams(SEED_GRAM, [" ".join(w)])
        return codes, first


def _load(documents: DataFrame, text: str, rows: list, shared: set[int]) -> Items:
    texts = [r.text or "" for r in rows]
    codes, owner, first = _grams(STOCK_GRAM, texts)
    stock, spread = shared, set()
    others = np.unique(np.array([c for c in codes.tolist() if c not in shared], np.uint64))
    if len(others):
        held = documents.select(F.col(text).alias("text")).mapInArrow(_document_grams(others), "code long, cls long").distinct()
        counts = {r.code: r.n for r in held.groupBy("code").agg(F.count("*").alias("n")).filter(F.col("code").isNull() | (F.col("n") > STOCK_LEAST)).collect()}
        floor = max(STOCK_LEAST, STOCK_SHARE * counts.get(None, 0))
        spread = {c % (1 << 64) for c, n in counts.items() if c is not None and n > floor}
        stock = shared | spread
    masks, wide = ([[False] * len(_WORD.findall(t)) for t in texts] for _ in range(2))
    for c, i, p in zip(codes.tolist(), owner.tolist(), first.tolist()):
        for mask, members in ((masks, stock), (wide, spread)):
            if c in members:
                mask[i][p : p + STOCK_GRAM] = [True] * len(mask[i][p : p + STOCK_GRAM])
    return Items([r.id for r in rows], [_WORD.findall(t.lower()) for t in texts], masks, wide)


#: A stretch needs so many matched words for each word changed in between: turns of phrase that items share don't add up.
MATCHED_PER_CHANGE = 5.5


def _stretches(doc: list[str], item: list[str], stock: list[bool], slack: int):
    """(item words matched, first and past-the-last document word) of each stretch of an alignment.

    Runs of an alignment hang together if at most `slack` words lie between them; of such a chain the
    part with most matched words is given that has few enough changes.
    """
    masked = [None if s else w for w, s in zip(item, stock)]
    stock_before = np.r_[0, np.cumsum(stock)]
    chain: list[tuple[int, int, int, int]] = []  # words, changes before, first and past-the-last document word
    item_end = 0

    def best():
        top = None
        for i in range(len(chain)):
            n = edits = 0
            for j in range(i, len(chain)):
                edits += chain[j][1] if j > i else 0
                n += chain[j][0]
                if edits * MATCHED_PER_CHANGE <= n and (top is None or n > top[0]):
                    top = (n, chain[i][2], chain[j][3])
        return top

    for b in SequenceMatcher(None, doc, masked, False).get_matching_blocks():
        if not b.size:
            continue
        gap = 0
        if chain:
            skipped = int(stock_before[b.b] - stock_before[item_end])
            gap = max(b.a - chain[-1][3] - skipped, b.b - item_end - skipped, 0)
            if gap > slack:
                yield best()
                chain = []
        chain.append((b.size, gap, b.a, b.a + b.size))
        item_end = b.b + b.size
    if chain:
        yield best()


def _needed_hits(items: Items, least: int) -> np.ndarray:
    """For each item the seeds that a stretch of `least` words or more hits at the least.

    With n words matched and at most n / MATCHED_PER_CHANGE changes and the item's stock runs in between, the words lie in
    that many runs and one more; a run of r words holds r - SEED_GRAM + 1 seeds.
    """
    out = []
    for mask in items.stock:
        breaks = sum(1 for i, m in enumerate(mask) if m and (i == 0 or not mask[i - 1]))
        # a longer stretch may have more changes and so hit fewer seeds: the least over all lengths, which recurs with a change more
        fewest = min(n - (SEED_GRAM - 1) * (int(n / MATCHED_PER_CHANGE) + 1 + breaks) for n in range(least, least + 2 * int(MATCHED_PER_CHANGE + 1)))
        out.append(max(1, fewest))
    return np.array(out, np.int64)


def _finder(items: Items, least: int, slack: int, near: int):
    seed_codes, seed_items, seed_places = items.seeds()
    order = np.argsort(seed_codes, kind="stable")
    seed_codes, seed_items, seed_places = seed_codes[order], seed_items[order], seed_places[order]
    needed = _needed_hits(items, least)

    def aligned(text: str, hits: list[tuple[int, int, int]]):
        """hits: (item, document word, item word), sorted."""
        at = [(m.start(), m.end()) for m in _WORD.finditer(text)]
        low = None
        best: dict[int, list] = {}
        k = 0
        while k < len(hits):
            end = k + 1
            while end < len(hits) and hits[end][0] == hits[k][0] and hits[end][1] - hits[end - 1][1] <= near:
                end += 1
            item = hits[k][0]
            if len({p for _, _, p in hits[k:end]}) >= needed[item]:
                low = low or [text[a:b].lower() for a, b in at]
                a, b = max(0, hits[k][1] - near), min(len(low), hits[end - 1][1] + near)
                for n, first, last in _stretches(low[a:b], items.words[item], items.stock[item], slack):
                    if n >= least:
                        best.setdefault(item, []).append((n, at[a + first][0], at[a + last - 1][1]))
            k = end
        return best

    def run(batches):
        known = _Set(seed_codes)
        begins, ends = (np.searchsorted(seed_codes, known.codes, side) for side in ("left", "right"))
        for batch in batches:
            out_ids, out_items, out_n, out_from, out_to = [], [], [], [], []
            for row0, part in chunks(batch.column(1)):
                h, rows, *_ = words(part)
                codes, owner, first = shingles(h, rows, SEED_GRAM)
                places, at = known.hits(codes)
                if not len(places):
                    continue
                # one entry for each item that has the seed
                times = ends[at] - begins[at]
                seed = np.repeat(begins[at], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                row, word = np.repeat(owner[places], times), np.repeat(first[places], times)
                pair = row * len(needed) + seed_items[seed]
                pairs, which, n = np.unique(pair, return_inverse=True, return_counts=True)
                keep = (n >= needed[pairs % len(needed)])[which]
                row, word, seed = row[keep], word[keep], seed[keep]
                starts = np.searchsorted(rows, row)
                for r in np.unique(row):
                    mine = row == r
                    hits = sorted(zip(seed_items[seed[mine]].tolist(), (word[mine] - starts[mine]).tolist(), seed_places[seed[mine]].tolist()))
                    for item, found in aligned(part[int(r)].as_py(), hits).items():
                        for n_words, a, b in found:
                            out_ids.append(row0 + int(r))
                            out_items.append(items.ids[item])
                            out_n.append(n_words)
                            out_from.append(a)
                            out_to.append(b)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(out_ids, pa.int64())), pa.array(out_items, pa.int64()), pa.array(out_n, pa.int32()), pa.array(out_from, pa.int32()), pa.array(out_to, pa.int32())],
                ["doc_id", "item_id", "n_words", "start_char", "end_char"])
    return run


def leaked_spans(documents: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
                 least: int = 20, slack: int = 2, near: int = 60) -> DataFrame:
    """(doc_id, item_id, n_words, start_char, end_char) of every stretch of a document with at least `least` words of an item.

    Up to `slack` words in a row may be changed, left out or added within a stretch, one for each
    MATCHED_PER_CHANGE matched; stock sentences in between don't count and don't break it. Null and empty texts hold nothing and null items leak
    nothing; repeated documents each count; texts of any length are scanned whole; empty tables give no
    rows; other columns are ignored. `item_id` is an integer. Items beyond `BLOCK_WORDS` words are
    taken in blocks, each scanned for in turn.
    """
    found = None
    kind = documents.select(doc_id).schema[0].dataType.simpleString()
    for block in _blocks(documents, items, text, item_id, item_text):
        one = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
            _finder(block, least, slack, near), f"doc_id {kind}, item_id long, n_words int, start_char int, end_char int")
        found = one if found is None else found.unionByName(one)
    return found


def stock_report(documents: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, n_words, n_shared, n_spread): the words of each item that leaked_spans leaves out as stock.

    n_spread counts those left out because more than STOCK_SHARE of the different documents hold them: an item
    that leaked so widely is told here and not passed over in silence. Items without stock are listed with zeros.
    """
    out = None
    spark = documents.sparkSession
    for block in _blocks(documents, items, text, item_id, item_text):
        rows = [(int(i), len(w), sum(s) - sum(x), sum(x)) for i, w, s, x in zip(block.ids, block.words, block.stock, block.spread)]
        one = spark.createDataFrame(rows, "item_id long, n_words int, n_shared int, n_spread int")
        out = one if out is None else out.unionByName(one)
    return out


def _blocks(documents: DataFrame, items: DataFrame, text: str, item_id: str, item_text: str):
    """The items, loaded in blocks of about BLOCK_WORDS words."""
    ship(documents.sparkSession)
    chosen = items.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text")).filter(F.col("text").isNotNull())
    size = chosen.agg(F.sum(F.size(F.split("text", " ")))).first()[0] or 0
    blocks = size // BLOCK_WORDS + 1
    shared = _shared_grams(chosen)
    for k in range(blocks):
        rows = chosen.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).orderBy("id").collect()
        yield _load(documents, text, rows, shared)


def leak_report(spans: DataFrame) -> DataFrame:
    """Per item: documents that carry it and the longest stretch."""
    return spans.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_documents"), F.max("n_words").alias("most_words"))


def without_leaks(documents: DataFrame, spans: DataFrame, *, doc_id: str = "doc_id", text: str = "text", whole_documents: bool = False) -> DataFrame:
    """The documents without those that leak, or with the leaking spans cut out of their texts."""
    if whole_documents:
        return documents.join(spans.select(F.col("doc_id").alias(doc_id)).distinct(), doc_id, "left_anti")
    cuts = spans.groupBy(F.col("doc_id").alias(doc_id)).agg(F.array_sort(F.collect_set(F.struct("start_char", "end_char"))).alias("_cuts"))
    # a running place keeps overlapping spans from being cut twice
    kept = F.aggregate(
        "_cuts", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda s, c: F.struct(F.greatest(s["at"], c["end_char"]).alias("at"),
                              F.concat(s["out"], F.when(c["start_char"] > s["at"], F.substring(F.col(text), s["at"] + 1, c["start_char"] - s["at"])).otherwise(F.lit(""))).alias("out")),
        lambda s: F.concat(s["out"], F.substring(F.col(text), s["at"] + 1, F.lit(2**31 - 1))))
    return documents.drop("_cuts").join(cuts, doc_id, "left").withColumn(text, F.when(F.col("_cuts").isNull(), F.col(text)).otherwise(kept)).drop("_cuts")
