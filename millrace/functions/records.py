"""The nested record, its leaves, and expressions over them."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx


@dataclass(frozen=True)
class Leaf:
    path: str
    tier: int
    comparator: str  # string, categorical, numeric, set, date
    type: str

    @property
    def is_set(self) -> bool:
        return self.comparator == "set"


# ---- Fixed values: the record's leaves in their order, their tiers and how they are compared -----
LEAVES = (
    Leaf("job_title", 1, "string", "string"), Leaf("company_name", 1, "string", "string"),
    Leaf("location.city", 2, "string", "string"), Leaf("location.region", 2, "string", "string"),
    Leaf("location.country", 2, "string", "string"), Leaf("location.remote_policy", 2, "categorical", "string"),
    Leaf("employment_type", 3, "categorical", "string"), Leaf("seniority_level", 3, "categorical", "string"),
    Leaf("education_requirement", 3, "categorical", "string"), Leaf("salary.min_amount", 4, "numeric", "double"),
    Leaf("salary.max_amount", 4, "numeric", "double"), Leaf("salary.currency", 4, "categorical", "string"),
    Leaf("salary.period", 4, "categorical", "string"), Leaf("years_experience_min", 4, "numeric", "int"),
    Leaf("application_deadline", 4, "date", "string"), Leaf("required_skills", 3, "set", "array<string>"),
    Leaf("preferred_skills", 3, "set", "array<string>"), Leaf("benefits", 3, "set", "array<string>"),
)
MEMBERS = {
    "location.remote_policy": ("onsite", "hybrid", "remote"),
    "employment_type": ("full_time", "part_time", "contract", "internship", "temporary", "volunteer"),
    "seniority_level": ("intern", "entry", "mid", "senior", "lead", "principal", "executive"),
    "education_requirement": ("none", "high_school", "associate", "bachelor", "master", "doctorate"),
    "salary.period": ("hourly", "daily", "weekly", "monthly", "yearly"),
}
LIST_CAPS = {"required_skills": 15, "preferred_skills": 10, "benefits": 10}
REGION_CODES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO", "connecticut": "CT", "delaware": "DE", "florida": "FL",
    "georgia": "GA", "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA", "kansas": "KS", "kentucky": "KY", "louisiana": "LA", "maine": "ME",
    "maryland": "MD", "massachusetts": "MA", "michigan": "MI", "minnesota": "MN", "mississippi": "MS", "missouri": "MO", "montana": "MT", "nebraska": "NE", "nevada": "NV",
    "new hampshire": "NH", "new jersey": "NJ", "new mexico": "NM", "new york": "NY", "north carolina": "NC", "north dakota": "ND", "ohio": "OH", "oklahoma": "OK", "oregon": "OR",
    "pennsylvania": "PA", "rhode island": "RI", "south carolina": "SC", "south dakota": "SD", "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT", "virginia": "VA",
    "washington": "WA", "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY", "district of columbia": "DC", "washington dc": "DC", "washington d.c.": "DC", "puerto rico": "PR",
}
REGION_NAMES = {code: name for name, code in REGION_CODES.items()}
TERM_ALIASES = {
    "js": "javascript", "ts": "typescript", "py": "python", "k8s": "kubernetes", "gcp": "google cloud", "postgres": "postgresql", "ms excel": "excel", "microsoft excel": "excel",
    "ms office": "microsoft office", "node": "node.js", "nodejs": "node.js", "reactjs": "react", "react.js": "react", "c sharp": "c#", "golang": "go", "ci cd": "ci/cd", "cicd": "ci/cd",
    "restful apis": "rest apis", "rest api": "rest apis", "ml": "machine learning", "nlp": "natural language processing",
}
TERM_EDGES = r"[ .,;:\-•*/()\[\]]+"
TRUNCATED_TEXT = 120
LONGEST_TERM = 40
SALARY_TOLERANCE = 0.02
LIST_TOLERANCE = {"required_skills": 2, "preferred_skills": 0, "benefits": 2}
# -------------------------------------------------------------------------------------------------



def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in kinds.items()])


_S, _D, _L = T.StringType(), T.DoubleType(), T.ArrayType(T.StringType())
SCHEMA = _struct(
    job_title=_S, company_name=_S, location=_struct(city=_S, region=_S, country=_S, remote_policy=_S), employment_type=_S, seniority_level=_S, education_requirement=_S,
    salary=_struct(min_amount=_D, max_amount=_D, currency=_S, period=_S), years_experience_min=T.IntegerType(), application_deadline=_S,
    required_skills=_L, preferred_skills=_L, benefits=_L)
EMPTY_JSON = ('{"job_title":"unknown","company_name":null,"location":{"city":null,"region":null,"country":null,"remote_policy":null},"employment_type":null,'
              '"seniority_level":null,"education_requirement":null,"salary":{"min_amount":null,"max_amount":null,"currency":null,"period":null},'
              '"years_experience_min":null,"application_deadline":null,"required_skills":[],"preferred_skills":[],"benefits":[]}')


def _map(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def leaf(record: Column | None, path: str) -> Column:
    """A leaf of a record column, or of the row itself where the record is its columns."""
    if record is None:
        return F.col(path)
    for name in path.split("."):
        record = record[name]
    return record


def region_code(value: Column) -> Column:
    """A state's name or code as its two-letter code, other values with single spaces, null if blank."""
    text = tx.squeeze(value)
    code = F.coalesce(F.try_element_at(_map(REGION_CODES), F.lower(text)), F.when(F.upper(text).isin(*REGION_NAMES), F.upper(text)))
    return F.when(text != "", F.coalesce(code, text))


def terms(values: Column, limit: int | None = None) -> Column:
    """Lower case, '_' as space, edges stripped, aliases mapped; without empty, over-long and single characters but r and c;
    the different ones sorted, then the first `limit`."""
    def one(t: Column) -> Column:
        flat = F.regexp_replace(tx.squeeze(F.replace(F.lower(t), F.lit("_"), F.lit(" "))), f"^{TERM_EDGES}|{TERM_EDGES}$", "")
        return F.coalesce(F.try_element_at(_map(TERM_ALIASES), flat), flat)

    kept = F.filter(F.transform(F.filter(values, lambda t: t.isNotNull()), one),
                    lambda t: (t != "") & (F.length(t) <= LONGEST_TERM) & ((F.length(t) > 1) | t.isin("r", "c")))
    out = F.array_sort(F.array_distinct(kept))
    return F.slice(out, 1, limit) if limit else out


def currency_code(value: Column) -> Column:
    code = F.upper(F.trim(value))
    return F.when(code.rlike("^[A-Z]{3}$"), code)


def amount_ok(value: Column) -> Column:
    """Null, or over 0 and under a billion (and not NaN)."""
    return value.isNull() | ((value > 0) & (value < 1e9) & ~F.isnan(value))


def amount(value: Column) -> Column:
    """Two decimals, null where amount_ok isn't met."""
    return F.when(amount_ok(value), F.round(value, 2))


def short_text(value: Column) -> Column:
    """Single spaces, the first 120 characters, null if blank."""
    text = F.substring(tx.squeeze(value), 1, TRUNCATED_TEXT)
    return F.when(text != "", text)


def date_shaped(value: Column) -> Column:
    """yyyy-mm-dd by shape; the calendar isn't asked."""
    return F.trim(value).rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")


def canonical(record: Column | None = None) -> Column:
    """The record with every leaf in its canonical form; a null list is an empty one, a missing part has null leaves."""
    def at(path):
        return leaf(record, path)

    return nest({
        **{x.path: at(x.path) for x in LEAVES if x.comparator in ("categorical", "date")},
        "job_title": short_text(at("job_title")), "company_name": short_text(at("company_name")), "location.city": at("location.city"),
        "location.region": region_code(at("location.region")), "location.country": at("location.country"), "salary.currency": currency_code(at("salary.currency")),
        "salary.min_amount": amount(at("salary.min_amount")), "salary.max_amount": amount(at("salary.max_amount")), "years_experience_min": at("years_experience_min"),
        **{x.path: F.coalesce(terms(at(x.path), LIST_CAPS[x.path]), F.array().cast("array<string>")) for x in LEAVES if x.is_set}})


def nest(leaves: dict[str, Column]) -> Column:
    """Leaves by path -> the nested record."""
    done, parts = set(), []
    for x in LEAVES:
        head, _, tail = x.path.partition(".")
        if not tail:
            parts.append(leaves[x.path].cast(x.type).alias(head))
        elif head not in done:
            done.add(head)
            parts.append(F.struct(*[leaves[y.path].cast(y.type).alias(y.path.split(".")[1]) for y in LEAVES if y.path.startswith(head + ".")]).alias(head))
    return F.struct(*parts)


def flat_columns(record: Column | None = None, prefix: str = "") -> list[Column]:
    """The leaves as columns named by their path, '.' as '__'."""
    return [leaf(record, x.path).alias(prefix + x.path.replace(".", "__")) for x in LEAVES]


def long_form(record: Column | None = None) -> Column:
    """array<struct<field, value>>: each leaf as JSON text, null for null, for explode."""
    return F.array(*[F.struct(F.lit(x.path).alias("field"), value_key(leaf(record, x.path), x).alias("value")) for x in LEAVES])


def value_key(value: Column, of: Leaf) -> Column:
    """A text that equal values share: sets sorted, numbers as doubles."""
    if of.is_set:
        return F.to_json(F.array_sort(F.array_distinct(value)))
    if of.comparator == "numeric":
        return value.cast("double").cast("string")
    return value


def to_json(record: Column) -> Column:
    """Compact JSON in declaration order, with nulls and empty lists."""
    return F.to_json(record, {"ignoreNullFields": "false"})


def from_json(text: Column) -> Column:
    return F.from_json(text, SCHEMA)


def is_null(value: Column, of: Leaf) -> Column:
    """Not stated: null, or an empty list."""
    return (value.isNull() | (F.size(value) <= 0)) if of.is_set else value.isNull()


def stated_leaves(record: Column | None = None) -> Column:
    """How many leaves state something; an empty string doesn't."""
    out = F.lit(0)
    for x in LEAVES:
        value = leaf(record, x.path)
        nothing = is_null(value, x) | (value == "") if x.type == "string" else is_null(value, x)
        out = out + (~nothing).cast("int")
    return out


def degenerate(record: Column | None = None, raw_lists: Column | None = None) -> Column:
    """Why a record is useless, or null: at most two stated leaves, a title under three characters, a list over its cap.

    `raw_lists` is the record before its lists were cut; without it the record's own lists are held against the caps.
    """
    over = F.lit(False)
    for name, cap in LIST_CAPS.items():
        # canonical lists are cut to their cap: only the lists as they came can be over it
        over = over | (F.size(leaf(raw_lists if raw_lists is not None else record, name)) > cap)
    return (F.when(stated_leaves(record) <= 2, "degenerate_all_null")
            .when(F.length(F.coalesce(tx.strip(leaf(record, "job_title")), F.lit(""))) < 3, "title_too_short")
            .when(F.coalesce(over, F.lit(False)), "list_overflow"))


def valid(record: Column | None = None) -> Column:
    """Does a record of canonical leaves keep the schema: a title, known members, amounts and years in bounds, a shaped date."""
    ok = (F.coalesce(leaf(record, "job_title"), F.lit("")) != "") & F.coalesce(date_shaped(leaf(record, "application_deadline")), F.lit(True))
    for path, members in MEMBERS.items():
        ok = ok & F.coalesce(leaf(record, path).isin(*members), F.lit(True))
    for path in ("salary.min_amount", "salary.max_amount"):
        ok = ok & amount_ok(leaf(record, path))
    return ok & F.coalesce(leaf(record, "years_experience_min").between(0, 50), F.lit(True))


def same_value(of: Leaf, gold: Column, pred: Column) -> Column:
    """Equality by the leaf's comparator; null equals null only."""
    if of.is_set:
        empty = F.array().cast("array<string>")
        return F.array_sort(F.array_distinct(F.coalesce(gold, empty))) == F.array_sort(F.array_distinct(F.coalesce(pred, empty)))
    if of.comparator == "string":
        same = tx.comparable(gold) == tx.comparable(pred)
    elif of.comparator == "numeric":
        g, p = gold.cast("double"), pred.cast("double")
        same = (F.abs(g - p) <= F.lit(SALARY_TOLERANCE) * F.greatest(F.abs(g), F.lit(1.0))) if of.path.startswith("salary.") else g == p
    else:
        same = gold == pred
    return F.when(gold.isNull() | pred.isNull(), gold.isNull() & pred.isNull()).otherwise(same)


def digits_present(value: Column, text: Column) -> Column:
    """Is an amount written in a (lower-cased) text: plain, with commas or spaces, as thousands with or without k."""
    n = F.bround(value, 0).cast("long")
    grouped = F.format_number(n, 0)
    thousands = F.when(n % 1000 == 0, (n / 1000).cast("long").cast("string"))
    hundreds = F.when(n % 100 == 0, F.regexp_replace(F.format_string("%.1f", n / 1000.0), r"\.0$", ""))
    forms = [n.cast("string"), grouped, F.replace(grouped, F.lit(","), F.lit(" ")), thousands, F.concat(thousands, F.lit("k")), F.concat(thousands, F.lit(" k")), F.concat(hundreds, F.lit("k"))]
    out = F.lit(False)
    for f in forms:
        out = out | F.coalesce(F.contains(text, f), F.lit(False))
    return out


def ungrounded(record: Column | None, source: Column) -> Column:
    """Names of the extracted leaves that the (truncated) source doesn't support, in leaf order."""
    return tx.let(tx.truncate_source(source), lambda whole: tx.let(F.lower(whole), lambda low: _ungrounded(record, whole, low)))


def _ungrounded(record: Column | None, whole: Column, low: Column) -> Column:
    checks: list[tuple[str, Column]] = []
    for path in ("company_name", "location.city", "location.region"):
        value = leaf(record, path)
        found = F.contains(low, F.lower(value))
        if path == "location.region":
            found = found | F.coalesce(F.contains(low, F.try_element_at(_map(REGION_NAMES), F.upper(value))), F.lit(False))
        checks.append((path, (tx.strip(value) != "") & ~found))
    for path in ("salary.min_amount", "salary.max_amount"):
        value = leaf(record, path)
        checks.append((path, value.isNotNull() & ~digits_present(value, low)))
    years = leaf(record, "years_experience_min")
    checks.append(("years_experience_min", (years > 0) & ~F.contains(low, years.cast("string"))))
    date = leaf(record, "application_deadline")
    checks.append(("application_deadline", ~F.contains(whole, F.substring(date, 1, 4))))
    for path, tolerance in LIST_TOLERANCE.items():
        missed = F.size(F.filter(leaf(record, path), lambda s: ~F.contains(low, F.substring_index(s, " ", 1))))
        checks.append((path, missed > tolerance))
    return F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in checks]), lambda x: x.isNotNull())
