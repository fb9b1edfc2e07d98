"""Quantities recorded in different units, brought to one unit.

A unit string ("from US$52,300 p.a.", "Rs. 54.5 lakh p.a.", "3.690 € brutto im Monat") is segmented by
dynamic programming over three tries: prefixes (scale words and lead-ins), roots (the units of each
dimension) and exponents (what marks a unit as a divisor: "/", "per", "a", "p."; powers: "²", "^-1"). In a
grammar with `prefixes` these attach to roots and roots to each other ("km/h", "kWh", "m/s^2"). Of all
segmentations the cheapest wins; a root that fits several dimensions or units is decided by priors of the
field.
"""
from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship

# How currencies are written, besides their codes.
CURRENCY_MARKS = {
    "$": "USD", "us$": "USD", "usd": "USD", "dollar": "USD", "dollars": "USD", "£": "GBP", "gbp": "GBP", "pounds": "GBP", "€": "EUR", "eur": "EUR",
    "euro": "EUR", "euros": "EUR", "c$": "CAD", "ca$": "CAD", "can$": "CAD", "cad": "CAD", "a$": "AUD", "au$": "AUD", "aud": "AUD", "fr.": "CHF", "sfr.": "CHF", "sfr": "CHF",
    "fr": "CHF", "chf": "CHF", "₹": "INR", "rs": "INR", "rs.": "INR", "inr": "INR", "rupees": "INR", "¥": "JPY", "jpy": "JPY", "yen": "JPY", "円": "JPY",
}
# How periods are written.
PERIOD_MARKS = {
    "year": "yearly", "years": "yearly", "yr": "yearly", "yearly": "yearly", "annum": "yearly", "annual": "yearly", "annually": "yearly", "p.a.": "yearly", "pa": "yearly", "p.a": "yearly",
    "jahr": "yearly", "jährlich": "yearly", "an": "yearly", "año": "yearly", "y": "yearly", "lpa": "yearly",
    "month": "monthly", "mo": "monthly", "monthly": "monthly", "pcm": "monthly", "p.m.": "monthly", "monat": "monthly", "monatlich": "monthly", "mois": "monthly", "mes": "monthly",
    "week": "weekly", "wk": "weekly", "weekly": "weekly", "p.w.": "weekly", "pw": "weekly", "woche": "weekly", "wöchentlich": "weekly", "semaine": "weekly", "semana": "weekly",
    "day": "daily", "daily": "daily", "day rate": "daily", "p.d.": "daily", "d": "daily", "tag": "daily", "täglich": "daily", "jour": "daily", "día": "daily",
    "hour": "hourly", "hr": "hourly", "h": "hourly", "hourly": "hourly", "p.h.": "hourly", "ph": "hourly", "stunde": "hourly", "stündlich": "hourly", "std": "hourly", "heure": "hourly", "hora": "hourly",
}
# Scale words after a number.
SCALES = {"k": 1e3, "tsd": 1e3, "lakh": 1e5, "lakhs": 1e5, "lac": 1e5, "l": 1e5, "m": 1e6, "mn": 1e6, "mio": 1e6, "crore": 1e7, "cr": 1e7, "lpa": 1e5}
# Decimal prefixes of units, and how powers are written.
PREFIXES = {"p": 1e-12, "n": 1e-9, "µ": 1e-6, "μ": 1e-6, "m": 1e-3, "c": 1e-2, "d": 1e-1, "h": 1e2, "k": 1e3, "M": 1e6, "G": 1e9, "T": 1e12,
            "micro": 1e-6, "milli": 1e-3, "centi": 1e-2, "kilo": 1e3, "mega": 1e6, "giga": 1e9}
POWERS = {"²": 2, "³": 3, "^2": 2, "^3": 3, "2": 2, "3": 3, "-1": -1, "-2": -2, "^-1": -1, "^-2": -2, "⁻¹": -1, "⁻²": -2}
# What marks a divisor, and words that carry no unit.
DIVISORS = ("/", "per", "a", "an", "pro", "im", "par", "por", "al", "the", "each")
FILLERS = ("from", "base", "circa", "ca", "starting", "at", "pay", "salary", "to", "and", "up", "about", "brutto", "gross", "netto", "net", "rate", "of", "is", "we", "offer", "plus",
           ":", "-", "–", "—", ",", ".", ";", "(", ")", "~", "+", "approx", "min", "max", "minimum", "maximum", "between", "bis", "von", "ab")


#: Stands for a number within a text that is segmented.
SLOT = "\ue000"
#: State of the segmentation behind a part that is complete.
_START = (False, False, None, False)


class Trie:
    """Characters to meanings; `walk` gives every entry that begins at a place."""

    __slots__ = ("root",)

    def __init__(self, entries: dict):
        self.root: dict = {}
        for word, meaning in entries.items():
            node = self.root
            for c in word:
                node = node.setdefault(c, {})
            node.setdefault("", []).extend(meaning)

    def walk(self, text: str, at: int):
        node = self.root
        while at < len(text) and (node := node.get(text[at])) is not None:
            at += 1
            for meaning in node.get("", ()):
                yield at, meaning


@dataclass(frozen=True)
class UnitGrammar:
    """Roots by dimension, scale words, divisors and fillers, and the priors of a field.

    `priors[field][dimension]` is added to the cost of a reading in which the field states a unit of
    that dimension, so that a short root of two dimensions ("p", "m", "an") is read as the field likes.
    """

    roots: dict
    scales: dict = field(default_factory=lambda: SCALES)
    scaled: tuple = ("lpa",)  # scale words that state a unit as well
    divided: tuple = ("period",)  # dimensions that are expected behind a divisor
    prefixes: dict = field(default_factory=dict)  # attach to roots; with them letters are told by case and roots may be joined
    powers: dict = field(default_factory=lambda: POWERS)
    divisors: tuple = DIVISORS
    fillers: tuple = FILLERS
    priors: dict = field(default_factory=dict)


PAY = UnitGrammar(
    roots={"currency": CURRENCY_MARKS, "period": PERIOD_MARKS},
    priors={"currency": {"currency": -1.0, "period": 3.0}, "period": {"currency": 3.0, "period": -1.0}, "text": {"currency": 0.0, "period": 0.0}})


class UnitParser:
    def __init__(self, grammar: UnitGrammar):
        self.grammar = grammar
        roots: dict = {}
        for dimension, marks in grammar.roots.items():
            for mark, unit in marks.items():
                roots.setdefault(mark, []).append(("root", dimension, unit))
        self.roots = Trie(roots)
        self.prefixes = Trie({**{s: [("scale", "", v)] for s, v in grammar.scales.items() if s not in roots or s not in grammar.scaled}, SLOT: [("number", "", None)]})
        both = {s: v for s, v in grammar.scales.items() if s in roots and s in grammar.scaled}
        self.scaled = Trie({s: [("scaled root", d, (v, u)) for _, d, u in roots[s]] for s, v in both.items()})
        self.exponents = Trie({d: [("divisor", "", None)] for d in grammar.divisors} | {f: [("filler", "", None)] for f in grammar.fillers})
        self.attached = Trie({p: [v] for p, v in grammar.prefixes.items()})
        self.powers = Trie({p: [v] for p, v in grammar.powers.items()} if grammar.prefixes else {})
        self.segment = lru_cache(1 << 16)(self._segment)

    @staticmethod
    def _bounded(text: str, a: int, b: int) -> bool:
        """Words may not begin or end inside a run of letters."""
        left = a == 0 or not (text[a].isalpha() and text[a - 1].isalpha())
        right = b == len(text) or not (text[b - 1].isalpha() and text[b].isalpha())
        return left and right

    def _segment(self, text: str, name: str) -> tuple:
        """Cheapest list of (kind, dimension, value) of a text whose numbers stand as SLOT.

        State: place, whether a divisor is open (a root of a period may follow it more cheaply), whether a
        number comes directly before (a scale word may follow it only then), the prefix that waits for its root, and
        whether a word goes on that has been read as joined roots so far. Only the cheapest way to a state is kept.
        """
        priors = self.grammar.priors.get(name, {})
        compound = bool(self.grammar.prefixes)
        text = text.strip() if compound else text.casefold().strip()
        waiting: list[dict] = [{} for _ in range(len(text) + 1)]
        waiting[0][False, False, None, False] = (0.0, ())
        for at in range(len(text)):
            for (open_divisor, after_number, prefix, joined), (cost, parts) in waiting[at].items():
                steps = []
                if compound:
                    self._joined(text, at, open_divisor, prefix, joined, priors, steps)
                if prefix is not None or joined:
                    pass
                elif text[at].isspace():
                    steps.append((at + 1, (open_divisor, after_number, None, False), 0.0, None))
                else:
                    steps.append((at + 1, _START, 4.0, None))  # an unread character
                    for trie in (self.prefixes, self.scaled, self.roots, self.exponents):
                        for end, (kind, dimension, value) in trie.walk(text, at):
                            if not self._bounded(text, at, end):
                                continue
                            part = (kind, dimension, value)
                            if kind == "number":
                                steps.append((end, (False, True, None, False), 0.0, part))
                            elif kind == "scale" and after_number:
                                steps.append((end, _START, 0.5, part))
                            elif kind == "scaled root" and after_number:
                                steps.append((end, _START, 0.4 + priors.get(dimension, 0.0), part))
                            elif kind == "root" and not compound:
                                divided = dimension in self.grammar.divided
                                odd = 0.0 if open_divisor == divided else (0.3 if divided else 1.5)
                                short = 0.8 if end - at == 1 and text[at].isalpha() else 0.0
                                steps.append((end, _START, 1.0 + odd + short - 0.05 * (end - at) + priors.get(dimension, 0.0), part))
                            elif kind == "divisor":
                                steps.append((end, (True, False, None, False), 0.6, None))
                            elif kind == "filler":
                                steps.append((end, _START, 0.7, None))
                for end, state, step, part in steps:
                    total = cost + step
                    if state not in waiting[end] or total < waiting[end][state][0]:
                        waiting[end][state] = (total, parts if part is None else (*parts, part))
            waiting[at] = {}
        ends = [v for (_, _, prefix, joined), v in waiting[-1].items() if prefix is None]
        return min(ends, key=lambda x: x[0])[1] if ends else ()

    def _joined(self, text: str, at: int, open_divisor: bool, prefix: float | None, joined: bool, priors: dict, steps: list) -> None:
        """Steps of a prefix or a root with its power, which may begin inside a word only behind others."""
        if prefix is None and not joined and at and text[at].isalpha() and text[at - 1].isalpha():
            return
        if prefix is None:
            for end, factor in self.attached.walk(text, at):
                if end < len(text) and text[end].isalpha():
                    steps.append((end, (open_divisor, False, factor, True), 0.3, None))
        for end, (_, dimension, unit) in self.roots.walk(text, at):
            for stop, power in [(end, 1), *((b, p) for b, p in self.powers.walk(text, end))]:
                goes_on = stop < len(text) and text[stop].isalpha() and text[stop - 1].isalpha()
                part = ("power", dimension, (unit, prefix or 1.0, -power if open_divisor else power))
                steps.append((stop, (open_divisor and goes_on, False, None, goes_on), 1.0 - 0.05 * (stop - at) + priors.get(dimension, 0.0), part))

    def quantity(self, text: str, name: str, factors: dict[str, float]) -> tuple[float | None, dict[str, int]]:
        """(lowest amount of a text in base units or None, power of each dimension), by the factor of each unit to its base."""
        amounts, parts = self._slotted(text, name)
        factor, powers = 1.0, {}
        for kind, dimension, value in parts:
            if kind == "scale":
                factor *= value
            elif kind == "power":
                unit, prefix, power = value
                if unit not in factors:
                    return None, {}
                factor *= (prefix * factors[unit]) ** power
                powers[dimension] = powers.get(dimension, 0) + power
        return (min(amounts) * factor if amounts else None), {d: p for d, p in sorted(powers.items()) if p}

    def _slotted(self, text: str, name: str) -> tuple[list[float], tuple]:
        """(numbers, segments) of a text."""
        numbers: list[float] = []
        pattern = _NUMBER_NO_POWER if self.grammar.prefixes else _NUMBER
        slots = pattern.sub(lambda m: numbers.append(plain_number(m.group())) or SLOT, text.replace(SLOT, " "))
        return numbers, self.segment(slots, name)

    def read(self, text: str, name: str) -> tuple[float | None, dict[str, str]]:
        """(lowest amount as written or None, unit of each dimension that the text names once)."""
        amounts, parts = self._slotted(text, name)
        units: dict[str, str] = {}
        scale = None
        for kind, dimension, value in parts:
            if kind == "number":
                continue
            if kind == "power":
                units.setdefault(dimension, value[0])
            elif kind == "scale":
                scale = value
            elif kind == "scaled root":
                scale, unit = value
                units.setdefault(dimension, unit)
            else:
                units.setdefault(dimension, value)
        return (min(amounts) * (scale or 1.0) if amounts else None), units


_NUMBER = re.compile(r"\d(?:[\d.,'’  ]*\d)?")
#: The same without a power that ends a unit: one digit behind a letter, '^' or their '-'.
_NUMBER_NO_POWER = re.compile(r"(?<![^\W\d_])(?<!\^)(?<!\^-)(?<![^\W\d_]-)\d(?:[\d.,'’  ]*\d)?")


def plain_number(text: str) -> float:
    """A number as written: groups of three after '.', ',' or "'" are thousands, a last group of another length is decimals."""
    parts = re.split(r"[.,'’  ]", text)
    marks = re.findall(r"[.,'’  ]", text)
    if not marks:
        return float(text)
    decimals = len(parts[-1]) != 3 or (len(set(marks)) == 2 and marks.count(marks[-1]) == 1)
    if len(parts[0]) > 3 or parts[0] == "0":
        decimals = True
    return float("".join(parts[:-1]) + "." + parts[-1]) if decimals else float("".join(parts))


def rescale(amount: float, low: float, high: float, magnitudes: tuple[float, ...]) -> tuple[float, float] | None:
    """(amount at its true magnitude, the magnitude) with low <= amount < high, of the first magnitude that fits."""
    for m in magnitudes:
        if low <= amount * m < high:
            return amount * m, m
    return None


#: Magnitudes at which a field's amount may be recorded, the likeliest first: as is, in thousands, in hundredths
#: (cents), in hundred thousands (lakh), in millions, in thousandths.
MAGNITUDES = (1.0, 1e3, 1e-2, 1e5, 1e6, 1e-3)


def _converter(currency: dict, period: dict, low: float, high: float, grammar: UnitGrammar):
    def run(batches):
        parser = UnitParser(grammar)

        def unit(value, dimension):
            if value is None or not value.strip():
                return None
            return parser.read(value, dimension)[1].get(dimension)

        for batch in batches:
            out = []
            for amount, cur, per, text in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
                written, named = parser.read(text, "text") if text else (None, {})
                c = named.get("currency") or unit(cur, "currency")
                p = named.get("period") or unit(per, "period")
                usd = magnitude = None
                if c in currency and p in period:
                    rate = currency[c] * period[p]
                    if written is not None:
                        usd, magnitude = written * rate, 1.0
                    elif amount is not None and math.isfinite(amount) and amount > 0:
                        usd, magnitude = rescale(amount * rate, low, high, MAGNITUDES) or (None, None)
                out.append((c, p, usd, magnitude, None if usd is None else ("text" if written is not None else "field")))
            cols = list(zip(*out)) if out else [[]] * 5
            types = (pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(cols, types))],
                                             ["id", "unit_currency", "unit_period", "usd_per_year", "magnitude", "stated_in"])
    return run


def to_usd_per_year(df: DataFrame, units: DataFrame, *, id_col: str, amount: str, currency: str, period: str, text: str,
                    low: float = 15_000.0, high: float = 400_000.0, grammar: UnitGrammar = PAY) -> DataFrame:
    """(id, unit_currency, unit_period, usd_per_year, magnitude, stated_in): one row for each row of `df`.

    A unit that the text names holds over the fields; an amount in the text is taken as written
    (decimal and thousands marks, k, lakh), the lower one of a range. A field's amount may be recorded
    at another power of ten: of MAGNITUDES the first that brings it into [low, high) is taken, and
    there is no amount if none does. usd_per_year is null where amount, currency or period isn't stated
    or isn't readable: null, blank, zero, negative and infinite amounts, unknown units. Repeated rows
    are each converted, an empty table gives no rows, other columns are ignored. `units` is the table
    of factors (unit_kind, unit_code, factor), at most a few hundred rows; it is read on the driver.
    """
    ship(df.sparkSession)
    known = units.limit(10_001).collect()
    if len(known) > 10_000:
        raise ValueError("the table of units must be small")
    factors = {k: {r.unit_code: r.factor for r in known if r.unit_kind == k} for k in ("currency", "period")}
    kind = df.select(F.col(id_col)).schema[0].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.expr(amount).cast("double").alias("amount"),
                     *(F.expr(x).alias(n) for x, n in ((currency, "currency"), (period, "period"), (text, "text"))))
    return rows.mapInArrow(_converter(factors["currency"], factors["period"], low, high, grammar),
                           f"id {kind}, unit_currency string, unit_period string, usd_per_year double, magnitude double, stated_in string")


def to_base_units(df: DataFrame, *, id_col: str, text: str, name: str, grammar: UnitGrammar, factors: dict[str, float]) -> DataFrame:
    """(id, amount, dimensions): the quantity that a text states, in base units, and its powers of dimensions ('length time^-1').

    `factors` gives each unit's size in its base unit; `name` is the field, whose priors decide between
    readings. The amount is null where the text states none; null and blank texts state nothing.
    Repeated rows are each read, an empty table gives no rows, other columns are ignored.
    """
    ship(df.sparkSession)

    def run(batches):
        parser = UnitParser(grammar)
        for batch in batches:
            out = [parser.quantity(t, name, factors) if t else (None, {}) for t in batch.column(1).to_pylist()]
            shape = [" ".join(d if p == 1 else f"{d}^{p}" for d, p in powers.items()) for _, powers in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in out], pa.float64()), pa.array(shape, pa.string())], ["id", "amount", "dimensions"])

    kind = df.select(F.col(id_col)).schema[0].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.expr(text).alias("text")).mapInArrow(run, f"id {kind}, amount double, dimensions string")


def in_band(df: DataFrame, bands: DataFrame, value: str) -> DataFrame:
    """`df` with band_id of the half-open band [low_usd, high_usd) that holds `value`, rows without one left out.

    `bands` is a small fixed table; its bounds become one sorted array on the plan, searched per row
    instead of joining by inequality.
    """
    known = sorted((r.low_usd, r.high_usd, r.band_id) for r in bands.limit(10_001).collect())
    if not known:
        return df.withColumn("band_id", F.lit(None).cast("int")).filter(F.lit(False))
    hit = F.coalesce(*[F.when((F.col(value) >= a) & (F.col(value) < b), F.lit(i)) for a, b, i in known])
    return df.withColumn("band_id", hit.cast("int")).filter(F.col("band_id").isNotNull())
