"""SQL twins of the expressions, as text, for the comparison with another engine."""
from __future__ import annotations

from ..functions import records as rec
from ..functions import text as tx


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')"


def clean(x: str) -> str:
    t = f"coalesce({x}, '')"
    for wrong, right in tx.MISREAD:
        t = f"replace({t}, {q(wrong)}, {q(right)})"
    t = f"regexp_replace({t}, {q(tx.URL)}, '[URL]', 'g')"
    t = f"regexp_replace({t}, {q(tx.EMAIL)}, '[EMAIL]', 'g')"
    t = f"regexp_replace({t}, '[·•‣▪][ \\t\\n\\x0B\\f\\r]*', chr(10) || '- ', 'g')"
    t = f"regexp_replace({t}, '\\r\\n?', chr(10), 'g')"
    t = f"regexp_replace({t}, '[ \\t\u00a0]+', ' ', 'g')"
    return strip(f"regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


def hits(x: str) -> str:
    words = ", ".join(q(w) for w in tx.STOP_WORDS)
    return f"len(list_intersect(list_distinct(regexp_extract_all(substr(lower({x}), 1, 4000), '[a-z'']+')), [{words}]))"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def stratum(x: str, salary: str = tx.SALARY, deadline: str = tx.DEADLINE) -> str:
    s, d = has(x, salary), has(x, deadline)
    return f"case when {s} and {d} then 'salary+deadline' when {s} then 'salary' when {d} then 'deadline' else 'plain' end"


def admitted(x: str) -> str:
    return f"length({x}) between {tx.LENGTH_GATE[0]} and {tx.LENGTH_GATE[1]} and {hits(x)} >= 8"


def words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


def shingles(w: str, k: int = 5) -> str:
    """Of a column that holds the words."""
    return (f"case when len({w}) < {k} then [array_to_string({w}, ' ')] else list_distinct(list_transform(range(1, len({w}) - {k - 2}), "
            f"lambda i: array_to_string({w}[i:i + {k - 1}], ' '))) end")


def truncate(x: str, n: int = tx.SOURCE_CHARS) -> str:
    s = strip(x)
    return f"case when length({s}) > {n} then regexp_replace(substr({s}, 1, {n}), ' [^ ]*$', '') || ' ...' else {s} end"


def comparable(x: str) -> str:
    return squeeze(f"regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_ \\t\\n\\x0B\\f\\r]', ' ', 'g')")


def mapped(entries: dict[str, str], key: str) -> str:
    return f"case {key} " + " ".join(f"when {q(k)} then {q(v)}" for k, v in entries.items()) + " end"


def region(x: str) -> str:
    s = squeeze(x)
    codes = ", ".join(q(c) for c in rec.REGION_NAMES)
    return f"case when {s} <> '' then coalesce({mapped(rec.REGION_CODES, f'lower({s})')}, case when upper({s}) in ({codes}) then upper({s}) end, {s}) end"


def terms(x: str, limit: int | None = None) -> str:
    flat = squeeze("replace(lower(t), '_', ' ')")
    edges = f"regexp_replace({flat}, {q('^' + rec.TERM_EDGES + '|' + rec.TERM_EDGES + '$')}, '', 'g')"
    one = f"list_transform(list_filter({x}, lambda t: t is not null), lambda t: {edges})"
    alias = f"list_transform({one}, lambda t: coalesce({mapped(rec.TERM_ALIASES, 't')}, t))"
    out = f"list_sort(list_distinct(list_filter({alias}, lambda t: t <> '' and length(t) <= {rec.LONGEST_TERM} and (length(t) > 1 or t in ('r', 'c')))))"
    return f"({out})[1:{limit}]" if limit else out


def currency(x: str) -> str:
    return f"case when regexp_full_match(upper(trim({x})), '[A-Z]{{3}}') then upper(trim({x})) end"


def amount(x: str) -> str:
    return f"case when {x} > 0 and {x} < 1e9 then round({x}, 2) end"


def short(x: str) -> str:
    s = f"substr({squeeze(x)}, 1, {rec.TRUNCATED_TEXT})"
    return f"case when {s} <> '' then {s} end"


def canonical_leaves(prefix: str = "") -> dict[str, str]:
    """Path -> SQL of the canonical leaf of a job_postings row."""
    at = lambda p: prefix + p
    out = {x.path: at(x.path) for x in rec.LEAVES}
    out |= {"job_title": short(at("job_title")), "company_name": short(at("company_name")), "location.region": region(at("location.region")),
            "salary.currency": currency(at("salary.currency")), "salary.min_amount": amount(at("salary.min_amount")), "salary.max_amount": amount(at("salary.max_amount"))}
    return out | {x.path: f"coalesce({terms(at(x.path), rec.LIST_CAPS[x.path])}, []::varchar[])" for x in rec.LEAVES if x.is_set}


def name(path: str) -> str:
    return path.replace(".", "__")


def canonical(table: str, extra: str = "", where: str = "true") -> str:
    """Subquery with the canonical leaves as columns named by `name`."""
    cols = ", ".join(f"{e} as {name(p)}" for p, e in canonical_leaves().items())
    return f"(select {extra}{cols} from {table} where {where})"


def is_null(x: rec.Leaf, col: str) -> str:
    return f"({col} is null or len({col}) = 0)" if x.is_set else f"{col} is null"


def same(x: rec.Leaf, g: str, p: str) -> str:
    if x.is_set:
        return f"(list_sort(list_distinct(coalesce({g}, []))) = list_sort(list_distinct(coalesce({p}, []))))"
    if x.comparator == "string":
        eq = f"{comparable(g)} = {comparable(p)}"
    elif x.path.startswith("salary.") and x.comparator == "numeric":
        eq = f"abs({g} - {p}) <= {rec.SALARY_TOLERANCE} * greatest(abs({g}), 1.0)"
    else:
        eq = f"{g} = {p}"
    return f"(case when {g} is null or {p} is null then {g} is null and {p} is null else {eq} end)"


def digits(v: str, low: str) -> str:
    n = f"cast(round_even({v}, 0) as bigint)"
    grouped = f"format('{{:,}}', {n})"
    forms = [f"cast({n} as varchar)", grouped, f"replace({grouped}, ',', ' ')"]
    tests = [f"contains({low}, {f})" for f in forms]
    k = f"cast({n} // 1000 as varchar)"
    tests.append(f"({n} % 1000 = 0 and contains({low}, {k}))")
    tests.append(f"({n} % 100 = 0 and contains({low}, regexp_replace(printf('%.1f', {n} / 1000.0), '\\.0$', '') || 'k'))")
    return "(" + " or ".join(tests) + ")"


def ungrounded(cols: dict[str, str], source: str) -> str:
    """Array of unsupported fields; `source` is a column that holds the truncated text."""
    low = f"lower({source})"
    tests = [(p, f"{strip(cols[p])} <> '' and not contains({low}, lower({cols[p]}))") for p in ("company_name", "location.city")]
    r = cols["location.region"]
    tests.append(("location.region", f"{strip(r)} <> '' and not (contains({low}, lower({r})) or coalesce(contains({low}, {mapped(rec.REGION_NAMES, f'upper({r})')}), false))"))
    tests += [(p, f"{cols[p]} is not null and not {digits(cols[p], low)}") for p in ("salary.min_amount", "salary.max_amount")]
    y, d = cols["years_experience_min"], cols["application_deadline"]
    tests.append(("years_experience_min", f"{y} > 0 and not contains({low}, cast({y} as varchar))"))
    tests.append(("application_deadline", f"not contains({source}, substr({d}, 1, 4))"))
    tests += [(p, f"len(list_filter({cols[p]}, lambda s: not contains({low}, split_part(s, ' ', 1)))) > {t}") for p, t in rec.LIST_TOLERANCE.items()]
    return "list_filter([" + ", ".join(f"case when coalesce({t}, false) then {q(p)} end" for p, t in tests) + "], lambda f: f is not null)"


def draw13(*keys: str) -> str:
    text = " || '|' || ".join(f"cast({k} as varchar)" for k in keys)
    return f"cast(('0x' || substr(md5({text}), 1, 13)) as bigint)"


def bucket(key: str) -> str:
    return f"cast(cast(('0x' || substr(md5(cast({key} as varchar)), 1, 8)) as bigint) % 10000 as integer)"
