"""Deterministic damage to texts, for robustness tests: (text, gold record) -> (text', gold').

Random choices are MD5 draws of row, arm and place, so that a row's result depends on nothing else.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import records as rec
from ..functions import text as tx

# ---- Fixed values -------------------------------------------------------------------------------
MISREADINGS = (("'", "â€™"), ('"', "â€œ"), ("-", "â€“"), ("·", "Â·"), ("é", "Ã©"))
TAGS = ("<p>", "</p>", "<br/>", "<div>", "</div>", "<span>", "</span>", "<li>", "</li>", "<strong>")
DEADLINE_CUE = r"(?i)\b(?:deadline|apply by|closing date|applications? close|submit by)\b"
TAIL_SHARE, TAIL_LEAST = 0.4, 400
TAIL_FIELDS = ("job_title", "company_name", "location.city", "location.region", "location.country")
# -------------------------------------------------------------------------------------------------
NOTICE = "\n\n" + " ".join(
    f"Notice {i}: every applicant is considered on merit, and nothing in this paragraph changes the post, its place, its hours or what it asks for."
    for i in range(1, 10))


def draw(*keys: Column) -> Column:
    """Uniform in [0, 1)."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[k.cast("string") for k in keys])), 1, 8), 16, 10).cast("double") / float(16**8)


def identity(text: Column, gold: Column, seed: Column) -> tuple[Column, Column]:
    return text, gold


def whitespace_chaos(text: Column, gold: Column, seed: Column) -> tuple[Column, Column]:
    """Of the lines 30 % with their first one to five spaces doubled, 25 % followed by an empty line, 10 % by a tab."""
    def line(x: Column, i: Column) -> Column:
        spaced = F.when(draw(seed, i, F.lit("a")) < 0.3, F.array_join(F.split(x, " ", (F.floor(draw(seed, i, F.lit("s")) * 5) + 2).cast("int")), "  ")).otherwise(x)
        return F.concat(spaced, F.when(draw(seed, i, F.lit("b")) < 0.25, "\n").otherwise(""), F.when(draw(seed, i, F.lit("c")) < 0.1, "\n\t").otherwise(""))

    return F.array_join(F.transform(F.split(text, "\n"), line), "\n"), gold


def shout_case(text: Column, gold: Column, seed: Column) -> tuple[Column, Column]:
    return F.upper(text), gold


def html_residue(text: Column, gold: Column, seed: Column) -> tuple[Column, Column]:
    """Tags around half the lines; ampersands, apostrophes and some spaces as entities."""
    tags = F.array(*[F.lit(t) for t in TAGS])

    def tag(i: Column, salt: str) -> Column:
        return F.element_at(tags, (F.floor(draw(seed, i, F.lit(salt)) * len(TAGS)) + 1).cast("int"))

    def line(x: Column, i: Column) -> Column:
        x = F.when(draw(seed, i, F.lit("t")) < 0.5, F.concat(tag(i, "o"), x, tag(i, "c"))).otherwise(x)
        x = F.replace(F.replace(x, F.lit(" & "), F.lit(" &amp; ")), F.lit("'"), F.lit("&#39;"))
        return F.when(draw(seed, i, F.lit("n")) < 0.3, F.regexp_replace(x, "^([^ ]*) ([^ ]*) ", "$1&nbsp;$2&nbsp;")).otherwise(x)

    return F.array_join(F.transform(F.split(text, "\n"), line), "\n"), gold


def mojibake(text: Column, gold: Column, seed: Column) -> tuple[Column, Column]:
    for right, wrong in MISREADINGS:
        text = F.replace(text, F.lit(right), F.lit(wrong))
    return text, gold


def boilerplate_flood(text: Column, gold: Column, seed: Column) -> tuple[Column, Column]:
    return F.concat(text, F.lit(NOTICE)), gold


def typos(text: Column, gold: Column, seed: Column) -> tuple[Column, Column]:
    """Two neighbouring letters swapped in 6 % of the words of five or more characters that no gold value holds."""
    values = []
    for x in rec.LEAVES:
        v = rec.leaf(gold, x.path)
        if x.is_set:
            values.append(F.flatten(F.transform(F.coalesce(v, F.array().cast("array<string>")), lambda s: F.split(F.lower(s), r"\s+"))))
        elif x.comparator == "numeric":
            values.append(F.array(v.cast("string"), v.cast("long").cast("string"), F.format_number(v, 0)))
        else:
            values.append(F.split(F.lower(F.coalesce(v, F.lit(""))), r"\s+"))
    return tx.let(F.concat(*values), lambda protected: _swapped(text, protected, seed)), gold


def _swapped(text: Column, protected: Column, seed: Column) -> Column:
    def word(w: Column, i: Column) -> Column:
        safe = (F.length(w) >= 5) & ~F.coalesce(F.array_contains(protected, F.regexp_replace(F.lower(w), "^[.,;:]+|[.,;:]+$", "")), F.lit(False))
        j = (F.floor(draw(seed, i, F.lit("j")) * (F.length(w) - 2)) + 1).cast("int")
        swapped = F.concat(F.substring(w, F.lit(1), j), F.substring(w, j + 2, F.lit(1)), F.substring(w, j + 1, F.lit(1)), F.substring(w, j + 3, F.length(w)))
        return F.when(safe & (draw(seed, i, F.lit("w")) <= 0.06), swapped).otherwise(w)

    return F.array_join(F.transform(F.split(text, " "), word), " ")


def _without(text: Column, pattern: str) -> Column:
    return F.array_join(F.filter(tx.sentences(text), lambda s: ~s.rlike(pattern)), " ")


def strip_salary(text: Column, gold: Column, seed: Column) -> tuple[Column, Column]:
    """Without the sentences that name an amount; the gold pay is null."""
    nothing = F.lit(None).cast("struct<min_amount:double,max_amount:double,currency:string,period:string>")
    pay = F.struct(*[nothing[f].alias(f) for f in ("min_amount", "max_amount", "currency", "period")])
    return _without(text, tx.SALARY), gold.withField("salary", pay)


def strip_deadline(text: Column, gold: Column, seed: Column) -> tuple[Column, Column]:
    return _without(text, DEADLINE_CUE), gold.withField("application_deadline", F.lit(None).cast("string"))


def truncate_tail(text: Column, gold: Column, seed: Column) -> tuple[Column, Column]:
    """The first 40 %, of 400 characters at least; to be scored on TAIL_FIELDS only."""
    return F.substring(text, F.lit(1), F.greatest(F.lit(TAIL_LEAST), F.floor(F.length(text) * TAIL_SHARE).cast("int"))), gold


ARMS: dict[str, Callable] = {f.__name__: f for f in (identity, whitespace_chaos, shout_case, html_residue, mojibake, boilerplate_flood, typos, strip_salary, strip_deadline, truncate_tail)}


def build_suite(df: DataFrame, id_col: str, text: str, gold: str, arms: dict[str, Callable] | None = None, n_per: int | None = None) -> DataFrame:
    """(id, arm, variant_id, text, gold): every row (or the first n_per by id) under every arm, by one explode."""
    rows = df if n_per is None else df.orderBy(id_col).limit(n_per)
    rows = rows.select(F.col(id_col).alias("id"), F.col(text).alias("_text"), F.col(gold).alias("_gold"))
    variants = []
    for name, f in (arms or ARMS).items():
        t, g = f(F.col("_text"), F.col("_gold"), F.concat_ws("|", F.col("id").cast("string"), F.lit(name)))
        variants.append(F.struct(F.lit(name).alias("arm"), t.alias("text"), g.alias("gold")))
    return (rows.select("id", F.explode(F.array(*variants)).alias("v"))
            .select("id", "v.arm", F.concat(F.col("id").cast("string"), F.lit("::"), F.col("v.arm")).alias("variant_id"), "v.text", "v.gold"))
