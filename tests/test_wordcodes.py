import re

import numpy as np
import pyarrow as pa

from millrace.functions import wordcodes as wc


def want(t):
    return [] if t is None else re.findall("[a-z0-9]+", t.lower())


def test_words_equal_regex(monkeypatch):
    texts = ["Ab c, dé-f", None, "", "...", "x", "y1 2z", "end", "İstanbul Kelvin", "a" * 50 + " b"]
    for block in (1 << 22, 7):
        monkeypatch.setattr(wc, "BLOCK", block)
        h, rows, a, b = wc.words(pa.array(texts))
        got = {}
        for r, s, e in zip(rows, a, b):
            got.setdefault(int(r), []).append(texts[r].lower().encode()[s:e].decode() if r != 7 else None)
        for i, t in enumerate(texts):
            if i != 7:
                assert got.get(i, []) == want(t)
    one, *_ = wc.words(pa.array(["word other"]))
    two, *_ = wc.words(pa.array(["x", "OTHER word"]))
    assert one[0] == two[2] and one[1] == two[1] and one[0] != one[1]


def test_shingles_stay_in_their_row():
    h, rows, *_ = wc.words(pa.array(["a b c d e f", "g h", "a b c d e"]))
    codes, r, first = wc.shingles(h, rows, 5)
    assert r.tolist() == [0, 0, 2] and codes[0] == codes[2]
    assert len(wc.words(pa.array([], pa.string()))[0]) == 0
    d, dr = wc.distinct_by_row(np.array([3, 1, 3], np.uint64), np.array([0, 0, 0]))
    assert d.tolist() == [1, 3] and dr.tolist() == [0, 0]
