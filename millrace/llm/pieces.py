"""Oversized texts cut into pieces at natural boundaries, with an overlap.

Blocks of sentences slide over the text; the cosine of the word counts on either side of a boundary
gives its cohesion, and the depth of a cohesion valley marks a change of topic (lexical-cohesion
segmentation). Within the window of sizes that the next piece may have, the cut goes to the boundary of
the best score: the depth of its valley and a bonus for line and paragraph ends, so that a clear change of
topic beats a flat paragraph end. Without a boundary it goes to the last space, else to the last whole
character. Each piece then starts with the last `overlap` tokens of the one before.
"""
from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from . import tokens

_END = re.compile(r"(?P<paragraph>\r?\n[^\S\n]*\r?\n\s*|\r[^\S\r\n]*\r\s*)|(?P<line>\r?\n|\r)|(?P<sentence>[.!?…。！？]+[\"'”’»)\]]*(?=\s|$)|[。！？])")
_WORDS = re.compile(r"\w+")
#: What the kind of a boundary adds to the depth of its valley (0 to 4, mostly under 1).
BONUS = {"paragraph": 0.4, "line": 0.2, "sentence": 0.0}


def boundaries(text: str) -> list[tuple[int, str]]:
    """(character after which to cut, kind) of the paragraph, line and sentence ends, in order."""
    out: dict[int, str] = {}
    for m in _END.finditer(text):
        if 0 < m.end() < len(text):
            out.setdefault(m.end(), m.lastgroup or "sentence")
    return sorted(out.items())


def depths(text: str, cuts: list[int], block: int = 4) -> np.ndarray:
    """Depth of the cohesion valley at each cut: how far the cohesion rises on both sides of it."""
    if not cuts:
        return np.zeros(0)
    edges = [0, *cuts, len(text)]
    units = [Counter(w for w in _WORDS.findall(text[a:b].lower()) if len(w) > 3) for a, b in zip(edges, edges[1:])]
    left, right = Counter(), Counter()
    for u in units[1 : 1 + block]:
        right.update(u)
    sims = np.zeros(len(cuts))
    left.update(units[0])
    for i in range(len(cuts)):
        dot = sum(n * right.get(w, 0) for w, n in left.items())
        size = (sum(n * n for n in left.values()) * sum(n * n for n in right.values())) ** 0.5
        sims[i] = dot / size if size else 0.0
        left.update(units[i + 1])
        if i + 1 - block >= 0:
            left -= units[i + 1 - block]
        right -= units[i + 1]
        if i + 1 + block < len(units):
            right.update(units[i + 1 + block])
    peaks = []
    for s in (sims, sims[::-1]):
        rise, out = s[0], []
        for k, x in enumerate(s):
            # the hilltop reached by climbing away from the valley
            rise = max(x, rise) if k and s[k - 1] >= x else x
            out.append(rise)
        peaks.append(np.array(out))
    return peaks[0] + peaks[1][::-1] - 2 * sims


class Splitter:
    """Cuts texts of more than `size` tokens."""

    def __init__(self, size: int = 1024, overlap: int = 64, ranks: str = tokens.RANKS, block: int = 4, least: float = 0.5):
        if not 0 <= overlap < size // 2:
            raise ValueError("the overlap must be under half the size")
        self.size, self.overlap, self.ranks, self.block, self.least = size, overlap, ranks, block, least

    def split(self, text: str) -> list[tuple[int, int, int, str]]:
        """(start, end, tokens, kind of the cut at the end) of the pieces of a text; none if it isn't oversized."""
        ids = tokens.encode(text, self.ranks)
        if len(ids) <= self.size:
            return []
        _, lengths = tokens.encoder(self.ranks)
        byte_ends = np.cumsum(lengths[np.array(ids)])
        # byte -> character: number of first bytes up to it
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        chars = np.cumsum((raw & 0xC0) != 0x80)
        whole = np.r_[(raw[np.minimum(byte_ends[:-1], len(raw) - 1)] & 0xC0) != 0x80, True]  # the token ends with a character
        char_ends = chars[byte_ends - 1]
        found = boundaries(text)
        cuts = np.array([c for c, _ in found], np.int64)
        kinds = [k for _, k in found]
        score = np.round(depths(text, cuts.tolist(), self.block) + np.array([BONUS[k] for k in kinds]), 9)
        token_of = np.searchsorted(char_ends, cuts, "left") + 1 if len(cuts) else cuts  # tokens up to the cut

        pieces, start_token, start_char, done = [], 0, 0, 0
        while True:
            if len(ids) - start_token <= self.size:
                rest = len(tokens.encode(text[start_char:], self.ranks))
                if rest <= self.size:
                    pieces.append((start_char, len(text), rest, "end"))
                    return pieces
            last = start_token + self.size
            while True:
                end_token, end_char, kind = self._cut(text, start_token, done, last, cuts, kinds, score, token_of, char_ends, whole)
                n = len(tokens.encode(text[start_char:end_char], self.ranks))
                if n <= self.size:
                    break
                last = min(last, end_token) - max(1, n - self.size)
            pieces.append((start_char, end_char, n, kind))
            done = end_token
            start_token = max(end_token - self.overlap, start_token + 1)
            while start_token > 0 and not whole[start_token - 1]:
                start_token -= 1
            start_char = int(char_ends[start_token - 1])

    def _cut(self, text, start, done, last, cuts, kinds, score, token_of, char_ends, whole):
        """(token, character, kind) of the best cut after `done` tokens and by token `last`."""
        low = max(done + 1, int(start + self.least * self.size))
        a, b = np.searchsorted(token_of, low), np.searchsorted(token_of, last, "right")
        if a >= b:  # no boundary in the window: any boundary beyond what the last piece covered
            a = np.searchsorted(token_of, max(done + 1, start + self.overlap + 1))
        if a < b:
            i = int(b - 1 - np.argmax(score[a:b][::-1]))  # of equal scores the last
            return int(token_of[i]), int(cuts[i]), kinds[i]
        last = min(last, len(char_ends))
        floor = max(done, start)
        for t in range(last, floor, -1):
            c = int(char_ends[t - 1])
            if whole[t - 1] and (c >= len(text) or text[c].isspace()):
                return t, c, "space"
        for t in range(last, floor, -1):
            if whole[t - 1]:
                return t, int(char_ends[t - 1]), "character"
        t = floor + 1  # a limit under the tokens of one character
        while not whole[t - 1]:
            t += 1
        return t, int(char_ends[t - 1]), "character"


def _pieces(splitter: Splitter, with_text: bool):
    def run(batches):
        for batch in batches:
            keys, cols = [], [[] for _ in range(7)]
            for r, text in enumerate(batch.column(1).to_pylist()):
                found = splitter.split(text)
                for k, (a, b, n, kind) in enumerate(found):
                    keys.append(r)
                    for col, x in zip(cols, (k, len(found), a, b, n, kind, text[a:b] if with_text else None)):
                        col.append(x)
            types = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, types))],
                                             ["id", "piece", "n_pieces", "start_char", "end_char", "n_tokens", "cut", "text"])
    return run


def split_oversized(df: DataFrame, id_col: str, text: str, *, size: int = 1024, overlap: int = 64, ranks: str = tokens.RANKS, with_text: bool = True) -> DataFrame:
    """(id, piece, n_pieces, start_char, end_char, n_tokens, cut, text): the pieces of every text of more than `size` tokens.

    Pieces have at most `size` tokens and cover the text; consecutive ones share the last `overlap`
    tokens before the cut (one or two more where a character would be torn). Null, empty and short
    texts have no pieces; a text without boundaries is cut at spaces, then at whole characters.
    Repeated rows are each cut, an empty table gives no rows, other columns are ignored. A token is a
    byte at least, so that texts of at most `size` bytes are left out before Python runs.
    """
    ship(df.sparkSession)
    kind = df.select(id_col).schema[0].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text).alias("text")).filter(F.octet_length("text") > size)
    return rows.mapInArrow(_pieces(Splitter(size, overlap, ranks), with_text),
                           f"id {kind}, piece int, n_pieces int, start_char int, end_char int, n_tokens int, cut string, text string")
