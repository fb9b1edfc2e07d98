"""Text expressions. All are built-in Spark expressions: Column in, Column out.

Patterns name their characters (ASCII classes) instead of \\w, \\b and \\s where engines differ, so that
the same text gives the same result in SQL engines; accented letters are therefore outside words.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values -------------------------------------------------------------------------------
STOP_WORDS = ("the", "and", "for", "with", "you", "our", "will", "are", "that", "this", "have", "from", "your", "work", "team", "role", "experience", "skills", "we", "job")
URL = r"https?://\S+"
EMAIL = r"\b[\w.+-]+@[\w-]+\.[\w.]+\b"
BULLET = "[·•‣▪]\\s*"
SALARY = r"(?i)(?:[$£€₹]\s?\d[\d,.]*\s*(?:k\b)?)|(?:\b(?:usd|gbp|eur|cad|inr)\s?\d[\d,.]*)|(?:\b\d{2,3}\s?k\b\s*(?:-|to|–)\s*\d{2,3}\s?k\b)"
DEADLINE = (r"(?i)\b(?:apply|applications?|deadline|closes?|closing date|submit)\b[^.\n]{0,60}?"
            r"(?:\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+\d{1,2}|\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{2}-\d{2})")
MISREAD = (("â€™", "'"), ("â€œ", '"'), ("â€“", "-"), ("Â·", "·"), ("Ã©", "é"))
LENGTH_GATE = (400, 20000)
SOURCE_CHARS = 6000
MONEY = r"(?i)([$£€₹]|\b(?:USD|GBP|EUR|INR)\b)?\s?(\d{1,3}(?:,\d{3})+|\d+(?:\.\d+)?)\s*(k\b)?"
YEARS = r"(?i)(\d{1,2})\s*\+?\s*(?:-|to|–)?\s*(?:\d{1,2})?\s*years?"
VOCABULARY = ("python", "java", "javascript", "typescript", "sql", "excel", "aws", "azure", "react", "node.js", "docker", "kubernetes", "git", "linux", "c#", "c++", "go", "rust", "scala",
              "spark", "hadoop", "tableau", "power", "bi", "salesforce", "sap", "communication", "leadership", "project", "management")
BENEFITS = ("health insurance", "401k", "pto", "remote work")
UNSET_PREFIXES = ("PASTE_", "SET_", "your-", "<")


def let(value: Column, body) -> Column:
    """body(value) with `value` evaluated once for each row, also where lambdas inside the body use it."""
    return F.transform(F.array(value), body)[0]


def once(df, **columns: Column):
    """`df` with columns that later filters and projections use without working them out again.

    The optimizer copies an expression into every filter it pushes down; it doesn't push through a generator.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def undo_misreading(text: Column) -> Column:
    """The five commonest sequences of UTF-8 read as a one-byte encoding, put right."""
    for wrong, right in MISREAD:
        text = F.replace(text, F.lit(wrong), F.lit(right))
    return text


def _where_found(text: Column, mark: str, change) -> Column:
    """change(text) only where the text has the mark without which nothing changes; the pattern isn't run on others."""
    return let(text, lambda t: F.when(F.contains(t, F.lit(mark)), change(t)).otherwise(t))


def mask_contacts(text: Column) -> Column:
    """URLs and mail addresses replaced by [URL] and [EMAIL]."""
    text = _where_found(text, "://", lambda t: F.regexp_replace(t, URL, "[URL]"))
    return _where_found(text, "@", lambda t: F.regexp_replace(t, EMAIL, "[EMAIL]"))


def contact_counts(text: Column) -> tuple[Column, Column]:
    """(URLs, mail addresses) in a text."""
    masked = F.regexp_replace(text, URL, "[URL]")
    return F.regexp_count(text, F.lit(URL)), F.regexp_count(masked, F.lit(EMAIL))


def clean_text(raw: Column) -> Column:
    """Null as '', misreadings put right, contacts masked, bullets as list lines, line ends as LF, space runs as one
    space, three and more line ends as two, stripped."""
    text = mask_contacts(undo_misreading(F.coalesce(raw, F.lit(""))))
    text = F.regexp_replace(text, BULLET, "\n- ")
    text = F.regexp_replace(text, "\r\n?", "\n")
    text = F.regexp_replace(text, "[ \t ]+", " ")
    return strip(F.regexp_replace(text, "\n{3,}", "\n\n"))


def length_ok(text: Column, low: int = LENGTH_GATE[0], high: int = LENGTH_GATE[1]) -> Column:
    return F.length(text).between(low, high)


def stop_word_hits(text: Column) -> Column:
    """Different stop words among the words of the first 4,000 characters."""
    found = F.array_distinct(F.regexp_extract_all(F.substring(F.lower(text), 1, 4000), F.lit("[a-z']+"), F.lit(0)))
    return F.size(F.array_intersect(found, F.array(*[F.lit(w) for w in STOP_WORDS])))


def looks_english(text: Column, min_hits: int = 8) -> Column:
    return stop_word_hits(text) >= min_hits


def mentions_salary(text: Column, pattern: str = SALARY) -> Column:
    return text.rlike(pattern)


def mentions_deadline(text: Column, pattern: str = DEADLINE) -> Column:
    return text.rlike(pattern)


def stratum(text: Column, salary: str = SALARY, deadline: str = DEADLINE) -> Column:
    """salary+deadline, salary, deadline or plain, by what a text mentions; the patterns are parameters."""
    found = F.struct(text.rlike(salary).alias("s"), text.rlike(deadline).alias("d"))
    return let(found, lambda f: F.when(f["s"] & f["d"], "salary+deadline").when(f["s"], "salary").when(f["d"], "deadline").otherwise("plain"))


def content_hash(text: Column) -> Column:
    return F.sha1(text)


def document_id(given: Column, text: Column) -> Column:
    """The given identifier; where it is null, empty or 0, sixteen digits of the content hash."""
    text_id = given.cast("string")
    return F.when(text_id.isNull() | text_id.isin("", "0"), F.substring(F.sha1(text), 1, 16)).otherwise(text_id)


def word_list(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def shingles(text: Column, k: int = 5) -> Column:
    """The different runs of k words; a text of fewer words is one run (maybe empty)."""
    def runs(words: Column) -> Column:
        all_runs = F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: F.array_join(F.slice(words, i, F.lit(k)), " "))
        return F.when(F.size(words) < k, F.array(F.array_join(words, " "))).otherwise(F.array_distinct(all_runs))

    return F.when(text.isNotNull(), let(word_list(text), runs))


def truncate_source(text: Column, limit: int = SOURCE_CHARS) -> Column:
    """Stripped; over the limit the first characters up to the last space, then ' ...'."""
    def cut(whole: Column) -> Column:
        head = F.regexp_replace(F.substring(whole, 1, limit), " [^ ]*$", "")
        return F.when(F.length(whole) > limit, F.concat(head, F.lit(" ..."))).otherwise(whole)

    return let(strip(text), cut)


def excerpt(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def comparable(text: Column) -> Column:
    """Lower case, other characters than letters, digits, _ and spaces as spaces, runs of spaces as one."""
    return squeeze(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", " "))


def sentences(text: Column) -> Column:
    """Cut at white space after '.', '!', '?' or a line end."""
    return F.split(text, r"(?<=[.!?\n])\s+")


def unset_to_null(value: Column) -> Column:
    """Placeholder settings count as not set."""
    return F.when(F.coalesce(value, F.lit("")).rlike("^(?:PASTE_|SET_|your-|<)") | (value == ""), None).otherwise(value)


def build_prompt(text: Column, head: str = "Extract one JSON record from the posting.\n\nPOSTING:\n", tail: str = "\n\nJSON:") -> Column:
    return F.concat(F.lit(head), truncate_source(text), F.lit(tail))


def build_messages(text: Column, system: str = "Answer with one JSON object only.", examples: Column | None = None) -> Column:
    """array<struct<role, content>>: the system line, example turns if any (array<struct<question, answer>>), the prompt."""
    def turn(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    first, last = F.array(turn("system", F.lit(system))), F.array(turn("user", build_prompt(text)))
    if examples is None:
        return F.concat(first, last)
    shown = F.flatten(F.transform(examples, lambda e: F.array(turn("user", e["question"]), turn("assistant", e["answer"]))))
    return F.concat(first, shown, last)


# How turns are marked in rendered training texts.
TURN_START, TURN_END = "<|im_start|>", "<|im_end|>"
ANSWER_MARK = TURN_START + "assistant\n"


def render_turns(messages: Column) -> Column:
    """A conversation (array<struct<role, content>>) as one text with marked turns."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit(TURN_START), m["role"], F.lit("\n"), F.coalesce(m["content"], F.lit("")), F.lit(TURN_END + "\n"))), "")


def trained_part(rendered: Column, mark: str = ANSWER_MARK) -> Column:
    """What is behind the last answer mark: all that completion-only training learns from. Null if there is no mark, so that
    a template without it is noticed and doesn't train on the prompt."""
    return F.when(F.contains(rendered, F.lit(mark)), F.substring_index(rendered, mark, -1))


def extract_record(text: Column) -> Column:
    """A record read off a text by patterns alone: the first amount that has a currency or 'k', years, key words.

    Deterministic and crude; it stands in for an extraction model where a pipeline is tested.
    """
    return let(F.lower(text), lambda low: _extract(text, low))


def _extract(text: Column, low: Column) -> Column:
    """Everything that several leaves use is worked out once: what the patterns match, then pay, years and title."""
    found = F.struct(*[F.regexp_extract(text, MONEY, g).alias(n) for g, n in ((1, "cur"), (2, "amount"), (3, "kilo"))],
                     F.regexp_extract(text, YEARS, 1).try_cast("int").alias("years"), strip(F.substring(F.substring_index(text, "\n", 1), 1, 80)).alias("title"))
    return let(found, lambda f: let(_pay(f), lambda pay: _leaves(low, f, pay)))


def _pay(f: Column) -> Column:
    value = F.replace(f["amount"], F.lit(","), F.lit("")).try_cast("double") * F.when(f["kilo"] != "", 1000.0).otherwise(1.0)
    return F.when(((f["cur"] != "") | (f["kilo"] != "")) & (value > 0) & (value < 1e9), value)


def _leaves(low: Column, f: Column, pay: Column) -> Column:
    def has(word: str) -> Column:
        return F.contains(low, F.lit(word))

    cur, years, title = f["cur"], f["years"], f["title"]
    code = F.when(cur == "£", "GBP").when(cur == "€", "EUR").when(cur == "₹", "INR").when(F.upper(cur).isin("USD", "GBP", "EUR", "INR"), F.upper(cur)).otherwise("USD")
    skills = F.filter(F.array(*[F.when(has(w), F.lit(w)) for w in sorted(VOCABULARY)]), lambda w: w.isNotNull())
    perks = F.filter(F.array(*[F.when(has(w), F.lit(w)) for w in sorted(BENEFITS)]), lambda w: w.isNotNull())
    return F.struct(
        F.when(title == "", "unknown").otherwise(title).alias("job_title"),
        F.when(has("remote"), "remote").when(has("hybrid"), "hybrid").alias("remote_policy"),
        F.when(has("full-time") | has("full time"), "full_time").alias("employment_type"),
        F.when(has("senior"), "senior").when(has("entry"), "entry").alias("seniority_level"),
        F.when(has("bachelor"), "bachelor").alias("education_requirement"),
        pay.alias("amount"),
        F.when(pay.isNotNull(), code).alias("currency"),
        F.when(pay < 200, "hourly").when(pay.isNotNull(), "yearly").alias("period"),
        F.when(years <= 50, years).alias("years_experience_min"),
        F.slice(skills, 1, 15).alias("required_skills"),
        F.slice(perks, 1, 10).alias("benefits"))
