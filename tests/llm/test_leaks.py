import random

from millrace.llm import leaks

RNG = random.Random(5555)
VOCAB = [f"word{i}" for i in range(600)]
STOCK = "We keep every paper for six months and then remove it from all our files."


def item(i):
    r = random.Random(i)
    return " ".join(r.choices(VOCAB, k=30)) + ". " + (STOCK + " " if i % 2 else "") + " ".join(r.choices(VOCAB, k=30)) + "."


ITEMS = [(i, item(i)) for i in range(12)]


def doc(*parts):
    return "\n\n".join([" ".join(RNG.choices(VOCAB, k=60)), *parts, " ".join(RNG.choices(VOCAB, k=60))])


def test_found_and_not_found(spark):
    w = item(3).split()
    edited = [x for k, x in enumerate(w[2:28]) if k != 9]
    edited[15] = "changed"
    edited.insert(20, "added")
    docs = [(1, doc(item(0))), (2, doc(" ".join(w[2:26]).upper().replace(" ", " - "))), (3, doc(" ".join(edited))), (4, doc(STOCK)), (5, doc(" ".join(w[2:14]))), (6, doc(" ".join(w[10:29]))),
            (7, None), (8, ""), (9, item(1)), (9, item(1)), (10, doc(item(2), item(4))), (11, " ".join(RNG.choices(VOCAB, k=100_000)) + " " + item(6))]
    d = spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id long, text string, item_id int")
    e = spark.createDataFrame([(*r, "v") for r in [*ITEMS, (99, None), (98, "")]], "item_id long, text string, doc_id string")
    spans = leaks.leaked_spans(d, e)
    got = {(r.doc_id, r.item_id) for r in spans.collect()}
    assert got == {(1, 0), (2, 3), (3, 3), (9, 1), (10, 2), (10, 4), (11, 6)}
    assert leaks.leak_report(spans).filter("item_id = 3").first().n_documents == 2
    cut = {r.doc_id: r.text for r in leaks.without_leaks(d.filter("doc_id in (1, 4, 7)"), spans).collect()}
    assert cut[4] == docs[3][1] and cut[7] is None and "word" in cut[1] and len(cut[1]) < len(docs[0][1]) - 200
    assert leaks.without_leaks(d, spans, whole_documents=True).count() == 5


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    d = spark.createDataFrame([(1, doc(item(0))), (2, doc(item(5)))], "doc_id long, text string")
    e = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = {(r.doc_id, r.item_id) for r in leaks.leaked_spans(d, e).collect()}
    monkeypatch.setattr(leaks, "BLOCK_WORDS", 200)
    assert {(r.doc_id, r.item_id) for r in leaks.leaked_spans(d, e).collect()} == want == {(1, 0), (2, 5)}


def test_words_that_items_share_are_stock_in_any_block(spark, monkeypatch):
    shared = " ".join(VOCAB[:24])
    e = spark.createDataFrame([(i, item(100 + i) + " " + shared) for i in range(8)], "item_id long, text string")
    d = spark.createDataFrame([(i, doc(shared)) for i in range(40)] + [(99, doc(item(103)))], "doc_id long, text string")
    for words in (2_000_000, 200):
        monkeypatch.setattr(leaks, "BLOCK_WORDS", words)
        assert {(r.doc_id, r.item_id) for r in leaks.leaked_spans(d, e).collect()} == {(99, 3)}
        assert all(r.n_shared >= 24 for r in leaks.stock_report(d, e).collect())


def test_items_that_very_many_documents_hold_are_told(spark):
    d = spark.createDataFrame([(i, doc(item(4))) for i in range(200)], "doc_id long, text string")
    told = {r.item_id: (r.n_words, r.n_shared, r.n_spread) for r in leaks.stock_report(d, spark.createDataFrame([(0, item(0)), (4, item(4))], "item_id long, text string")).collect()}
    assert told == {0: (60, 0, 0), 4: (60, 0, 60)}


def test_recall_on_random_edits(spark):
    """Passages of 22 to 60 words of an item with a tenth of the words changed, left out or doubled by another."""
    rng = random.Random(77)
    items = [(i, " ".join(rng.choices(VOCAB, k=80))) for i in range(300)]
    docs, due = [], set()
    for i, text in items:
        n = rng.randint(22, 60)
        at = rng.randint(0, 80 - n)
        out, kept = [], 0
        for w in text.split()[at : at + n]:
            what = rng.random()
            if what < 0.9:
                out.append(w)
                kept += 1
            elif what < 0.93:
                out.append("changed")
            elif what < 0.96:
                out += [w, "added"]
                kept += 1
        docs.append((i, doc(" ".join(out))))
        if kept >= 20:
            due.add((i, i))
    d, e = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leaks.leaked_spans(d, e).collect()}
    recall = len(got & due) / len(due)
    print("recall", recall, len(due))
    assert len(due) > 200 and recall >= 0.95 and all(i == j for i, j in got)


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    e = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert leaks.leaked_spans(d, e).count() == 0
    assert leaks.leaked_spans(spark.createDataFrame([(1, "x y")], "doc_id long, text string"), e.limit(0)).count() == 0


def test_much_copied_leak_is_reported_for_every_copy(spark):
    """Copies of one leaking document, a few of them in other layout, don't make its passage stock; nor do copies of an item."""
    text = doc(item(0))
    docs = [(i, text if i % 3 else text.upper().replace(" ", "\n")) for i in range(80)] + [(100 + i, doc()) for i in range(100)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    e = spark.createDataFrame([*ITEMS, *((50 + i, item(0)) for i in range(4))], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leaks.leaked_spans(d, e).collect()}
    assert got == {(i, j) for i in range(80) for j in (0, 50, 51, 52, 53)}


def test_four_changes_in_a_passage_of_26_words(spark):
    """22 matched words in runs of 4, 4, 4, 5, 5 hold seven seeds only."""
    w = item(2).split()[:26]
    for at in (4, 9, 14, 20):
        w[at] = "changed"
    d = spark.createDataFrame([(1, " ".join(w))], "doc_id long, text string")
    got = [(r.doc_id, r.item_id, r.n_words) for r in leaks.leaked_spans(d, spark.createDataFrame(ITEMS, "item_id long, text string")).collect()]
    assert got == [(1, 2, 22)]
