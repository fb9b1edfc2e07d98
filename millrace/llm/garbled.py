"""Text decoded with the wrong character encoding: find it and restore the original.

The garbled forms of UTF-8 characters under each wrong encoding are computed beforehand. One
multi-pattern automaton holds the whole forms of two-byte characters and the first two characters of the
forms of three and four bytes; a hit of the latter is completed by reading the characters back as bytes,
so that every assigned character is covered. Only matched spans are replaced, and again until nothing
changes, so that correct text beside them stays as it is and text misread several times over is restored.

Where control characters were dropped from a form, its remains are judged by the place they stand in:
what is left of a capital stands where only a capital can, what is left of a quotation mark or dash where
one belongs. Forms that look like correct text (letters, then closing marks) count only where the letters
about them contradict it, or beside other garbled spans of the text.
"""
from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship

# Encodings that UTF-8 is commonly mistaken for.
WRONG = ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac_roman")
# Blocks of two-byte characters that are looked for (first, last); the others' forms are common in correct text.
BLOCKS = ((0x00A0, 0x017F), (0x0218, 0x021B), (0x0386, 0x03CE), (0x0401, 0x045F))
# More blocks, for the encodings in which their forms are not common in correct text.
MORE_BLOCKS, MORE_WRONG = ((0x0180, 0x0217), (0x021C, 0x024F), (0x02C6, 0x02C6), (0x02DC, 0x02DC), (0x05D0, 0x05EA), (0x060C, 0x06F9)), ("cp1252", "latin-1")
#: Forms that look like correct text: letters, then closing marks.
_CLOSING = frozenset("\xa0»«…“”’‘–—›‹")


def _looks_plain(form: str) -> bool:
    body = form.rstrip("".join(_CLOSING))
    return body.isalpha()


def _misread(data: bytes, wrong: str) -> str:
    """The reading of bytes under a wrong encoding; bytes it doesn't define stay as control characters."""
    return "".join(_readings(wrong)[b] for b in data)


@lru_cache(None)
def _readings(wrong: str) -> tuple[str, ...]:
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(wrong))
        except UnicodeDecodeError:
            out.append(chr(b))
    return tuple(out)


@lru_cache(None)
def _bytes_of(wrong: str) -> dict[str, int]:
    return {c: b for b, c in enumerate(_readings(wrong))}


def _meant(c: str) -> bool:
    """Is it a character that a text may hold."""
    return unicodedata.category(c) not in ("Cn", "Cs", "Co")


@lru_cache(1)
def sequences() -> tuple[dict[str, str], dict[str, tuple[tuple[str, int], ...]], dict[str, str | None]]:
    """(form of a two-byte character -> original; first two characters of longer forms -> (encoding, length);
    form whose control characters were dropped -> original or None).

    A form that several originals have is found but not restored: its original is '' or None.
    """
    whole: dict[str, set[str]] = {}
    dropped: dict[str, set[str]] = {}
    begin: dict[str, list[tuple[str, int]]] = {}
    for blocks, encodings in ((BLOCKS, WRONG), (MORE_BLOCKS, MORE_WRONG)):
        for c in (chr(code) for first, last in blocks for code in range(first, last + 1)):
            if _meant(c):
                for w in encodings:
                    whole.setdefault(_misread(c.encode(), w), set()).add(c)
    for code in range(0x80, 0xA0):  # control characters, as a first misreading leaves them
        for w in MORE_WRONG:
            whole.setdefault(_misread(chr(code).encode(), w), set()).add(chr(code))
    for w in WRONG:
        for lead in range(0xE0, 0xF5):
            for second in range(0x80, 0xC0):
                if not (lead == 0xE0 and second < 0xA0 or lead == 0xED and second > 0x9F or lead == 0xF0 and second < 0x90 or lead == 0xF4 and second > 0x8F):
                    begin.setdefault(_misread(bytes([lead, second]), w), []).append((w, 3 if lead < 0xF0 else 4))
    # what dropped control characters leave of the punctuation and symbols, of which texts hold most
    for code in (*range(0x00C0, 0x0180), *range(0x2010, 0x2040), *range(0x20A0, 0x20C0), 0x2122):
        for w in WRONG:
            form = _misread(chr(code).encode(), w)
            bare = re.sub("[\x80-\x9f]", "", form)
            if bare != form and len(bare) > 1:
                dropped.setdefault(bare, set()).add(chr(code))
    exact = {g: next(iter(v)) if len(v) == 1 else "" for g, v in whole.items()}
    bare = {g: next(iter(v)) if len(v) == 1 else None for g, v in dropped.items() if g not in exact}
    return exact, {g: tuple(dict.fromkeys(v)) for g, v in begin.items()}, bare


@lru_cache(1)
def _automaton():
    import ahocorasick

    auto = ahocorasick.Automaton()
    exact, begin, _ = sequences()
    for g in exact.keys() | begin.keys():
        auto.add_word(g, g)
    auto.make_automaton()
    return auto


def _completed(text: str, a: int, ways: tuple[tuple[str, int], ...]) -> tuple[int, str] | None:
    """(end, original) of a longer form that begins at `a`, '' if its originals differ."""
    found: dict[int, set[str]] = {}
    for wrong, n in ways:
        codes = [_bytes_of(wrong).get(c, -1) for c in text[a : a + n]]
        if len(codes) == n and all(0x80 <= b < 0xC0 for b in codes[1:]):
            try:
                c = bytes(codes).decode()
            except UnicodeDecodeError:
                continue
            if _meant(c):
                found.setdefault(a + n, set()).add(c)
    if not found:
        return None
    end = max(found)
    return end, next(iter(found[end])) if len(found[end]) == 1 else ""


def _plain_here(text: str, a: int, b: int) -> bool:
    """Is a form that looks like correct text correct where it stands: do the letters about it go with its own."""
    before, after = text[a - 1 : a], text[b : b + 1]
    if "\u0400" <= text[a] <= "\u04ff":
        if text[a : a + 2].islower() and text[a + 1].isalpha():
            return True
        return "\u0400" <= after <= "\u04ff" or "\u0400" <= before <= "\u04ff" or (not after.isalnum() and text[b - 1].isalpha())
    if b - a > 2:
        return False
    if text[b - 1].isalpha():  # no small letter may stand before a capital one, nor behind two
        run = [c for c in (before, text[a], text[b - 1], after) if c.isalpha()]
        return not any(x.islower() and y.isupper() for x, y in zip(run, run[1:])) and not (text[a:b].isupper() and after.islower())
    return (before.isupper() or not before.isalpha()) and not after.islower() if text[a].isupper() else True


_UP = "A-ZÀ-ÖØ-Þ"
_LOW = "a-zß-öø-ÿ"
# Words that an English clitic follows, and the clitics.
_CLITIC = "â(?=(?:ll|re|ve|s|t|d|m)\\b)(?i:(?<=\\biâ)|(?<=\\bheâ|\\bitâ|\\bweâ)|(?<=\\byouâ|\\bsheâ|\\bwhoâ)|(?<=\\btheyâ|\\bthatâ|\\bwhatâ)|(?<=\\bthereâ)|(?<=[a-z]nâ))"
#: Remains of forms whose control characters were dropped; each is tried only where one of _SIGNS stands.
_SIGNS = re.compile("[\ufffd\x80-\x84\x86-\x9fÃÂâÅ]|[ä-ïÐÑÎÏ](?=[¡-¿ÐÑ])|≈")
_REMAINS = re.compile("|".join((
    # characters lost for good, and control characters
    "\ufffd", "[\x80-\x84\x86-\x9f]",
    # of a capital: among small letters, before a capital or digit that doesn't follow Ã in correct words (O, E, S do), repeated
    f"Ã(?![{_UP}]|$)(?<![{_UP}]Ã)|Ã(?=[{_LOW}\\d])|(?<=[{_LOW}])Ã|Ã(?=Ã)|(?<=Ã)Ã|Ã(?=[A-DF-NP-RT-Z])",
    f"Â(?![{_UP}{_LOW}])|(?<=[{_LOW}])Â", f"ÅÄ(?!Ö)|(?<=[{_LOW}])Å(?=[{_LOW}]*Ä)",
    # of a dash, mark or symbol: apart from letters, or with a symbol
    "â(?<!\\wâ)(?!\\w)|â(?=[^\\w\\s’'\\-.,;:!?)\"”])", _CLITIC,
    # of quotation marks: one before a word and one behind a word of the same line
    "â(?<!\\wâ)(?=\\w[^\\nâ]{0,80}\\wâ(?!\\w))|â(?<=\\wâ)(?!\\w)",
    "[ä-ï][¡-¿]+[ä-ï][¡-¿]+", "ÐÐ|Ñ(?=Ñ)|[ÐÑÎÏ](?=[¡-ª¬-º¼-¿])", "≈[ÅÇ]ƒ", "â–",
)))
#: Alphabets in which the letters of remains stand in many words: their own other letters (Vietnamese; Romanian; Turkish).
_OWN = re.compile("[\u01a0\u01a1\u01af\u01b0\u1ea0-\u1ef9]|[\u0102\u0103\u0218-\u021b]|[\u011e\u011f\u0130\u0131\u015e\u015f]")
#: What every text with a garbled span holds: two characters beyond ASCII in a row, or a remain.
SUSPECT = "[^\\x00-\\x7f]{2}|[\\x80-\\x9fÃÂâÅ\ufffd]"


def spans(text: str) -> list[tuple[int, int, str | None]]:
    """(start, end, original or None) of the garbled spans of a text, in order and apart; the longest match wins."""
    if text.isascii():
        return []
    exact, begin, bare = sequences()
    starts: dict[int, tuple[int, str]] = {}
    for stop, g in _automaton().iter(text):
        a = stop - 1
        hit = _completed(text, a, begin[g]) if g in begin else None
        if hit is None and g in exact:
            hit = (stop + 1, exact[g])
        if hit:
            starts[a] = hit
    found, weak, at = [], [], 0
    for a in sorted(starts):
        b, c = starts[a]
        if a >= at:
            if "\x80" <= c < "\xa0" and text[b - 1] > "\xa0" and a != at and not "Â" <= text[a - 1 : a] <= "ô":
                continue  # a control character is no character of its own, only part of another form misread again
            if not (_looks_plain(text[a:b]) and _plain_here(text, a, b)):
                found.append((a, b, c or None))
            elif not "\u0180" <= c <= "\u024f":  # letters so rare that the plain reading is always likelier
                weak.append((a, b, c or None))
            at = b
    taken = bytearray(len(text))
    for a, b, _ in found:
        taken[a:b] = b"\1" * (b - a)
    own = not found and _OWN.search(text) is not None
    done = 0
    for sign in _SIGNS.finditer(text):
        m = _REMAINS.match(text, sign.start()) if sign.start() >= done else None
        if m is None:
            continue
        a, b = m.span()
        done = b
        whole = next((w for w in weak if w[0] <= a < w[1] or w[0] < b <= w[1]), None)
        if whole:  # the remain of what is a whole form
            a, b = whole[:2]
            if not any(taken[a:b]):
                taken[a:b] = b"\1" * (b - a)
                found.append(whole)
            continue
        if any(taken[a:b]) or (own and text[a] not in "\ufffd" and text[a] >= "\xa0" and (text[a - 1 : a].isalpha() or text[b : b + 1].isalpha())):
            continue
        original = None
        for n in (4, 3, 2):
            if text[a : a + n] in bare and not any(taken[a : a + n]) and len(text) >= a + n:
                b, original = max(b, a + n), bare[text[a : a + n]]
                break
        taken[a:b] = b"\1" * (b - a)
        found.append((a, b, original))
    if found:
        found += [w for w in weak if not any(taken[w[0] : w[1]])]
    return sorted(found)


def _replaced(text: str, found: list) -> tuple[str, int]:
    out, at, lost = [], 0, 0
    for a, b, c in found:
        out += text[at:a], text[a:b] if c is None else c
        at, lost = b, lost + (c is None)
    return "".join([*out, text[at:]]), lost


def restore(text: str) -> tuple[str, int, int]:
    """(text with garbled spans replaced, spans found, spans that could not be restored).

    A text that was misread several times over is replaced as often.
    """
    found = spans(text)
    n, lost = len(found), 0
    while found:
        before = text
        text, lost = _replaced(text, found)
        if len(text) >= len(before):  # a replaced span gets shorter; none was
            break
        found = spans(text)
    return text, n, lost if found else 0


def _restored(batches):
    for batch in batches:
        fixed, n, lost = [], [], []
        for t in batch.column(1).to_pylist():
            x = (None, 0, 0) if t is None else restore(t)
            fixed.append(x[0])
            n.append(x[1])
            lost.append(x[2])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(fixed, pa.string()), pa.array(n, pa.int32()), pa.array(lost, pa.int32())],
            ["id", "restored", "n_garbled", "n_lost"])


def repair(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, restored text, n_garbled, n_lost) of the rows of `df` that hold garbled characters.

    Spans counted in n_lost are found but have no single original; they stay unchanged. Null and
    empty texts and those without two characters beyond ASCII in a row hold none and are left out before Python runs.
    Repeated rows are each judged; an empty table gives no rows; other columns are ignored.
    """
    ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text).alias("text")).filter(F.col("text").rlike(SUSPECT))
    return rows.mapInArrow(_restored, f"id {kind}, restored string, n_garbled int, n_lost int").filter(F.col("n_garbled") > 0)
