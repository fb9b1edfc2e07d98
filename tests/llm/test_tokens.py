import random

import pytest
from pyspark.sql import functions as F

from millrace.llm import mixing, pieces, tokens

TEXTS = ["a" * 9000, "東" * 5000, "\n" * 3000, "word " * 3000, "x y.\n\n" * 3000, "é́" * 4000, "😀" * 2000, "A. " * 4000, " " * 20000, "One sentence here. " * 900 + "\n\n" + "Another topic now! " * 900]


@pytest.mark.parametrize("text", TEXTS, ids=range(len(TEXTS)))
def test_pieces_cover_the_text(text):
    s = pieces.Splitter()
    found = s.split(text)
    assert found[0][0] == 0 and found[-1][1] == len(text) and all(p[2] <= 1024 for p in found)
    for p, q in zip(found, found[1:]):
        assert q[0] < p[1] < q[1]
        assert 60 <= len(tokens.encode(text[q[0] : p[1]])) <= 68


def test_cuts_at_natural_boundaries():
    text = "\n\n".join(" ".join(f"Sentence {i} of paragraph {j} speaks on." for i in range(12)) for j in range(40))
    found = pieces.Splitter().split(text)
    assert all(p[3] == "paragraph" for p in found[:-1]) and all(text[: p[1]].endswith("\n\n") for p in found[:-1])
    words = "alpha beta " * 2000
    assert {p[3] for p in pieces.Splitter().split(words)[:-1]} == {"space"}


def test_a_change_of_topic_beats_a_flat_paragraph_end():
    rng = random.Random(2)
    pools = [[f"{k}{x}" for x in "abcdefghijkl"] for k in ("river", "ledger")]

    def sentences(pool, n):
        return " ".join(" ".join(rng.sample(pool, 9)).capitalize() + "." for _ in range(n))

    tail = " ".join("".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(3000))
    first = sentences(pools[0], 12)
    text = first + " " + sentences(pools[1], 4) + "\n\n" + sentences(pools[1], 5) + "\n\n" + sentences(pools[1], 30) + tail
    start, end, _, kind = pieces.Splitter(size=1024, overlap=64, least=0.2).split(text)[0]
    assert (start, kind) == (0, "sentence") and text[:end] == first


def test_valley_between_topics():
    a = [f"The river boat sailed past water mill {i} slowly." for i in range(6)]
    b = [f"Quarterly ledger audits need payroll figures {i} again." for i in range(6)]
    text = " ".join(a + b)
    cuts = [c for c, _ in pieces.boundaries(text)]
    assert cuts[int(pieces.depths(text, cuts).argmax())] == len(" ".join(a))


def test_short_and_empty():
    s = pieces.Splitter()
    assert s.split("") == [] and s.split("short") == []
    with pytest.raises(ValueError):
        pieces.Splitter(100, 60)


def test_split_dataframe(spark):
    rows = [(1, "word " * 3000), (1, "word " * 3000), (2, None), (3, ""), (4, "short"), (5, "x" * 2000)]
    df = spark.createDataFrame([(*r, 3) for r in rows], "id long, text string, piece int")
    got = pieces.split_oversized(df, "id", "text")
    assert {r.id for r in got.collect()} == {1} and got.filter("piece = 0").count() == 2
    assert got.filter(F.substring(F.lit("word " * 3000), F.col("start_char") + 1, F.col("end_char") - F.col("start_char")) != F.col("text")).count() == 0
    assert pieces.split_oversized(df.limit(0), "id", "text").count() == 0


def test_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, "")], "id long, text string")
    assert {r.id: r.n_tokens for r in tokens.with_counts(df, "text", ["id"]).collect()} == {1: 2, 2: None, 3: 0}


@pytest.mark.parametrize("unit", ["some words go here ", "well-known-state-of-the-art-", "aujourd'hui,c'est-à-dire ", "東京都の求人です。", "a1b2-c3;", "x  \n\n  y ", "Ünïcödé—", "can't won't "])
def test_long_texts_lose_no_merge(unit):
    """Texts over the stretch give the tokens of the whole text."""
    for extra in (1, 17, 60_001):
        n = tokens.STRETCH + extra
        text = (unit * (n // len(unit) + 1))[:n]
        assert tokens.encode(text) == tokens.encoder()[0].encode_ordinary(text)


def mix(spark, docs, targets):
    d = spark.createDataFrame(docs, "doc_id long, source string, text string, tokens string")
    return mixing.mixture(d, spark.createDataFrame(targets, "source string, target_weight double, max_repeats int"))


def test_mixture(spark):
    docs = [(i, "abc"[i % 3] if i < 900 else None, "word " * (20 + i % 50), "x") for i in range(1000)] + [(2000, "d", "one two", "x"), (2001, "a", None, "x"), (2002, "a", "", "x")]
    copies, report = mix(spark, docs, [("a", 0.5, 3), ("b", 0.2, 1), ("c", 0.1, 2), ("d", 0.1, 2), ("none", 0.1, 5)])
    r = {x.source: x for x in report.collect()}
    total = sum(x.n * x.t for x in copies.groupBy(F.col("n_tokens").alias("t")).agg(F.count("*").alias("n")).collect())
    assert total > 0
    for s in "abc":
        assert not r[s].unmet and abs(r[s].reached - r[s].wanted) < 60
    assert r["d"].unmet and r["d"].reached == 2 * r["d"].tokens and r["none"].unmet and r["none"].tokens == 0
    assert abs(sum(x.share for x in r.values()) - 1) < 1e-9
    rows = copies.collect()
    caps = {"a": 3, "b": 1, "c": 2, "d": 2}
    assert all(0 <= x.copies <= caps[x.source] for x in rows) and all(x.copies == 0 for x in rows if x.n_tokens == 0)


def test_mixture_empty(spark):
    copies, report = mix(spark, [], [("a", 1.0, 2)])
    assert copies.count() == 0 and report.count() == 1
