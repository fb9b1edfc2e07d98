"""Free-entered values mapped to the entries of a reference list.

Reference entries and their alias paths (other names, abbreviated first words, swapped and joined
words) stand in one trie. A value, cut free of decorations, is searched with a Levenshtein automaton
walked along the trie: one row of edit distances per trie node, branches over the limit are cut.
Distances count swapped neighbours as one edit. The limit grows with the value's length.
"""
from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import ship

# Words around a value that name no entry.
DECORATIONS = (
    r"^(?:the )?(?:state|province|region|county|area|district|city) of ", r"^(?:greater|metro|metropolitan) ", r" (?:region|province|state|county|area|district)$",
    r"^(?:strong|certified|proven|solid|excellent|good|advanced|basic|expert|senior|junior) ", r"^(?:experience|experienced|skills?|knowledge|background|expertise|certified|proficient|proficiency) (?:in|with|of) ",
    r"^\d+ ?\+? ?(?:years?|yrs?)(?: of| in)? ", r" (?:skills?|experience|knowledge|expertise|certification|a plus|preferred|required)$",
    r" (?:basic|basics|advanced|intermediate|beginner|expert|level \d)$",
)
_DECORATIONS = [re.compile(p) for p in DECORATIONS]
#: Edits allowed for values of at least so many letters (spaces not counted).
LIMITS = ((15, 2), (5, 1))


def plain(text: str) -> str:
    """Lower case, without accents; every run of other characters than letters and digits is one space."""
    flat = "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))
    return re.sub(r"[\W_]+", " ", flat).strip()


def limit_for(n: int) -> int:
    return next((k for least, k in LIMITS if n >= least), 0)


class Canonicalizer:
    """Search for reference entries. `entries`: (key, name, other names); a key of letters may itself be entered."""

    def __init__(self, entries: list[tuple[str, str, tuple[str, ...]]], keys_entered: bool = False):
        self.trie: dict = {}
        self.listed = {k for k, _, _ in entries} if keys_entered else {n for _, n, _ in entries}
        # forms by strength: keys, names, other names, swapped words, abbreviations
        keys, names, others_, swapped, short = self.forms = tuple({} for _ in range(5))
        for key, name, others in entries:
            if keys_entered:
                keys.setdefault(plain(key).replace(" ", ""), set()).add(key)
            for n in (name, *others):
                words = plain(n).split()
                path = "".join(words)
                (names if n == name else others_).setdefault(path, set()).add(key)
                if len(words) > 1:
                    swapped.setdefault("".join(words[1:] + words[:1]), set()).add(key)
                    for cut in self._abbreviations(words[0]):
                        short.setdefault("".join([cut, *words[1:]]), set()).add(key)
                self._add(path, key)
        self.longest = max((len(f) for d in self.forms[1:4] for f in d), default=0)
        # an abbreviation of several entries means none of them
        for s in [s for s, k in short.items() if len(k) > 1]:
            del short[s]
        for s, k in short.items():
            if len(s) >= 6:
                self._add(s, next(iter(k)))
        self._cached = lru_cache(1 << 16)(self._find)

    def find(self, value: str) -> tuple[str, int, list[tuple[str, int]]]:
        """(key or '', edits, candidates) of the entry meant by a value; short values are remembered."""
        return self._cached(value) if len(value) <= 200 else self._find(value)

    @staticmethod
    def _abbreviations(word: str) -> set[str]:
        if len(word) < 3:
            return set()
        bare = word[0] + re.sub("[aeiou]", "", word[1:])
        return {word[0], word[:2], word[:3], word[:4], bare, bare[:2], bare[:3], word[0] + word[-1]} - {word}

    def _add(self, path: str, key: str) -> None:
        node = self.trie
        for c in path:
            node = node.setdefault(c, {})
        node.setdefault("", set()).add(key)

    def near(self, text: str, limit: int) -> list[tuple[int, str]]:
        """Every (edits, key) of the entries within `limit` edits, nearest first.

        A state of the automaton is the band of edit distances around the diagonal: of a node at depth d the
        distances to the first d - limit ... d + limit letters of the text; all others are over the limit.
        """
        found: dict[str, int] = {}
        n, over = len(text), limit + 1
        width = 2 * limit + 1
        # band[j] is the distance to the first depth - limit + j letters
        first = [over if j < limit else min(j - limit, over) for j in range(width)]
        stack = [(self.trie, "", 0, first, None)]
        while stack:
            node, last, depth, band, before = stack.pop()
            end = n - depth + limit
            keys = node.get("")
            if keys and 0 <= end < width and band[end] <= limit:
                for key in keys:
                    if band[end] < found.get(key, over):
                        found[key] = band[end]
            start = depth + 1 - limit
            for c, child in node.items():
                if not c:
                    continue
                new, least = [], over
                for j in range(width):
                    i = start + j
                    if i < 0 or i > n:
                        new.append(over)
                        continue
                    d = band[j + 1] + 1 if j + 1 < width else over
                    if i:
                        if j and new[j - 1] + 1 < d:
                            d = new[j - 1] + 1
                        x = band[j] + (text[i - 1] != c)
                        if x < d:
                            d = x
                        if before is not None and i > 1 and text[i - 1] == last and text[i - 2] == c and before[j] + 1 < d:
                            d = before[j] + 1
                    if d > over:
                        d = over
                    new.append(d)
                    if d < least:
                        least = d
                if least <= limit or (before is not None or depth == 0) and min(band) <= limit:
                    stack.append((child, c, depth + 1, new, band))
        return sorted((d, k) for k, d in found.items())

    def _forms(self, value: str):
        """The value, and the value freed of decorations step by step, each also with swapped parts."""
        head = re.split(r"\s+[-–|/]\s+|[,(;]", value)
        swapped = re.match(r"\s*([^,]+),\s*([^,]+?)[\s.;]*$", value)
        yield plain(value)
        if swapped:
            yield plain(f"{swapped[2]} {swapped[1]}")
        queue, seen = [plain(value), *(plain(h) for h in head if h.strip())], set()
        while queue:
            form = queue.pop(0)
            if form in seen or not form:
                continue
            seen.add(form)
            yield form
            queue += [p.sub("", form) for p in _DECORATIONS]

    def _find(self, value: str) -> tuple[str, int, list[tuple[str, int]]]:
        """(key, edits, every entry in reach with its edits): exact forms first, then the single nearest. Without a key edits are
        -1 if nothing is in reach and -2 if several entries are equally near."""
        forms = list(dict.fromkeys(f.replace(" ", "") for f in self._forms(value)))
        for d in self.forms[:1], self.forms[1:]:
            for f in forms:
                keys = next((x[f] for x in d if f in x), None)
                if keys:
                    return (min(keys), 0, [(min(keys), 0)]) if len(keys) == 1 else ("", -2, sorted((k, 0) for k in keys))
        reach: dict[str, int] = {}
        for f in forms:
            limit = limit_for(len(f))
            if limit and len(f) <= self.longest + limit:
                for d, k in self.near(f, limit):
                    reach[k] = min(d, reach.get(k, d))
        if not reach:
            return "", -1, []
        least = min(reach.values())
        nearest = [k for k, d in reach.items() if d == least]
        found = sorted(reach.items(), key=lambda x: (x[1], x[0]))
        return (nearest[0], least, found) if len(nearest) == 1 else ("", -2, found)


def _mapper(entries, keys_entered):
    def run(batches):
        finder = Canonicalizer(entries, keys_entered)
        for batch in batches:
            values = batch.column(0).to_pylist()
            found = [finder.find(v) for v in values]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int32()),
                 pa.array([[{"key": k, "edits": d} for k, d in f[2]] for f in found], pa.list_(pa.struct([("key", pa.string()), ("edits", pa.int32())]))),
                 pa.array([v in finder.listed for v in values], pa.bool_())],
                ["_value", "ref_key", "edits", "candidates", "as_listed"])
    return run


ADDED = ("ref_key", "edits", "candidates", "as_listed")


def canonicalize(values: DataFrame, value: str, entries: list[tuple[str, str, tuple[str, ...]]], keys_entered: bool = False) -> DataFrame:
    """`values` with ref_key (the entry meant, '' if none or if several are equally near), edits (-1 if nothing is in reach, -2 if
    several are equally near), candidates (every entry in reach, nearest first) and as_listed (the value is a name of the list,
    or one of its keys with `keys_entered`, to the letter).

    Each different value is searched once, however many rows have it, and joined back. `entries` is a
    bounded reference list of (key, name, other names). Null and blank values mean no entry; values of
    any length are read whole. An empty table gives no rows. The other columns are kept, except that
    earlier ones of the added names are replaced.
    """
    ship(values.sparkSession)
    rows = values.select(*[c for c in values.columns if c not in (value, *ADDED)], value)
    different = rows.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("_value")).agg(F.lit(1).alias("_one")).select("_value")
    # few bytes but much work each: a number of parts of our own keeps adaptive execution from making them one task
    different = different.repartition(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    mapped = different.mapInArrow(_mapper(entries, keys_entered), "_value string, ref_key string, edits int, candidates array<struct<key: string, edits: int>>, as_listed boolean")
    joined = rows.join(mapped, F.col(value) == F.col("_value"), "left").drop("_value")
    return joined.na.fill({"ref_key": "", "edits": -1, "as_listed": False})


def reference(df: DataFrame, key: Column, name: Column, others: Column | None = None, bound: int = 100_000) -> list[tuple[str, str, tuple[str, ...]]]:
    """A reference table as a list; refuses tables over `bound` rows, which must not be broadcast."""
    rows = df.select(key.cast("string").alias("k"), name.alias("n"), (others if others is not None else F.array().cast("array<string>")).alias("o")).limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"the reference list has more than {bound} entries")
    return sorted((r.k, r.n, tuple(sorted(x for x in r.o or () if x))) for r in rows if r.k and r.n)


def unmatched_report(mapped: DataFrame, value: str, *by: str) -> DataFrame:
    """The values that mean no entry, with their number of occurrences and whether that is because several entries are equally near."""
    return mapped.filter(F.col("ref_key") == "").groupBy(*by, value).agg(F.count("*").alias("n"), F.bool_or(F.col("edits") == -2).alias("ambiguous"))
