"""Registered queries over records, votes, audits, scores, files and streams, with their SQL."""
from __future__ import annotations

import hashlib
import math
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonx
from ..functions import records as rec
from ..functions import text as tx
from ..operators import audit, infer, label, perturb, score, stats, vote
from ..runtime import durable, table
from ..sources import files
from ..streaming import incremental
from . import sql as s

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f
    return add


def postings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "job_postings")


def joined(values: Column) -> Column:
    return F.array_join(values, "|")


def wide(record: Column) -> list[Column]:
    return [(joined(rec.leaf(record, x.path)) if x.is_set else rec.leaf(record, x.path)).alias(s.name(x.path)) for x in rec.LEAVES]


WIDE = ", ".join(f"array_to_string({s.name(x.path)}, '|') as {s.name(x.path)}" if x.is_set else s.name(x.path) for x in rec.LEAVES)
CANON = s.canonical("job_postings", "record_id, posting_id, sample_idx, company_id, ")


# ---- scalar and nested functions ----------------------------------------------------------------


@query(f"select record_id, {WIDE} from {CANON}")
def canonical_records(spark, d):
    return postings(spark, d).select("record_id", rec.canonical().alias("r")).select("record_id", *wide(F.col("r")))


@query(f"""select record_id, {s.region('location.region')} as region, {s.currency('salary.currency')} as currency, {s.amount('salary.min_amount')} as amount,
coalesce(regexp_full_match(trim(application_deadline), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}'), false) as date_shaped from job_postings""")
def canonical_scalars(spark, d):
    return postings(spark, d).select("record_id", rec.region_code(F.col("location.region")).alias("region"), rec.currency_code(F.col("salary.currency")).alias("currency"),
                                     rec.amount(F.col("salary.min_amount")).alias("amount"), F.coalesce(rec.date_shaped(F.col("application_deadline")), F.lit(False)).alias("date_shaped"))


def _long_sql(value, source, ids):
    return " union all ".join(f"select {ids}, {s.q(x.path)} as field, {value(x)} as value from {source}" for x in rec.LEAVES)


@query("select * from (" + _long_sql(lambda x: f"to_json(list_sort(list_distinct({s.name(x.path)})))::varchar" if x.is_set else f"cast({s.name(x.path)} as varchar)", "c", "record_id")
       .replace("select record_id, 'job_title'", f"with c as {CANON} select record_id, 'job_title'", 1)
       .replace("cast(salary__min_amount as varchar)", "cast(cast(salary__min_amount as decimal(18,2)) as varchar)").replace("cast(salary__max_amount as varchar)", "cast(cast(salary__max_amount as decimal(18,2)) as varchar)")
       .replace("cast(years_experience_min as varchar)", "cast(cast(years_experience_min as decimal(18,2)) as varchar)") + ")")
def long_leaves(spark, d):
    """One row per record and leaf."""
    rows = postings(spark, d).select("record_id", rec.canonical().alias("r")).select("record_id", F.explode(rec.long_form(F.col("r"))).alias("p")).select("record_id", "p.field", "p.value")
    numeric = [x.path for x in rec.LEAVES if x.comparator == "numeric"]
    return rows.withColumn("value", F.when(F.col("field").isin(*numeric), F.col("value").cast("double").cast("decimal(18,2)").cast("string")).otherwise(F.col("value")))


@query(f"""select record_id, {", ".join(f"array_to_string(j.{x.path}, '|') as {s.name(x.path)}" if x.is_set else f"j.{x.path} as {s.name(x.path)}" for x in rec.LEAVES)}
from (select record_id, struct_pack({", ".join(
    f"{h} := " + (s.name(h) if len(ps) == 1 and ps[0] == h else "struct_pack(" + ", ".join(f"{p.split('.')[1]} := {s.name(p)}" for p in ps) + ")")
    for h, ps in ((h, [x.path for x in rec.LEAVES if x.path.partition('.')[0] == h]) for h in dict.fromkeys(x.path.partition('.')[0] for x in rec.LEAVES)))}) as j from {CANON})""")
def json_round_trip(spark, d):
    """Record to JSON text and back."""
    r = postings(spark, d).select("record_id", rec.to_json(rec.canonical()).alias("json"))
    return r.select("record_id", rec.from_json(F.col("json")).alias("r")).select("record_id", *wide(F.col("r")))


_FORMS = ("target_json", "'Here it is: ' || target_json || ' done.'", "'```json' || chr(10) || target_json || chr(10) || '```'", "substr(target_json, 1, length(target_json) - 1)",
          "replace(target_json, '\"job_title\"', '\"extra\":1,\"job_title\"')", "'nothing here'", "'{broken: [}'")
_KINDS = ("null", "null", "null", "'no_json'", "'schema_error'", "'no_json'", "'json_decode_error'")


@query(" union all ".join(f"select posting_id, batch, {i} as form, {k} as error_kind, {'true' if i == 0 else 'false'} as strict from train where target_json is not null" for i, k in enumerate(_KINDS)))
def parsed_output(spark, d):
    """Targets wrapped as models wrap them: bare, in prose, fenced, cut, with an unknown key, absent, broken."""
    rows = table(spark, d, "train").filter("target_json is not null")
    forms = [F.col("target_json"), F.concat(F.lit("Here it is: "), "target_json", F.lit(" done.")), F.concat(F.lit("```json\n"), "target_json", F.lit("\n```")),
             F.expr("substring(target_json, 1, length(target_json) - 1)"), F.replace(F.col("target_json"), F.lit('"job_title"'), F.lit('"extra":1,"job_title"')), F.lit("nothing here"), F.lit("{broken: [}")]
    raw = rows.select("posting_id", "batch", F.posexplode(F.array(*forms)).alias("form", "raw"))
    return raw.select("posting_id", "batch", "form", jsonx.parse_record()(F.col("raw")).alias("p")).select("posting_id", "batch", "form", "p.error_kind", "p.strict")


@query("select posting_id, batch, target_json as block from train where target_json is not null")
def json_blocks(spark, d):
    raw = F.concat(F.lit("Sure:\n```json\n"), "target_json", F.lit("\n```\nmore } text"))
    return table(spark, d, "train").filter("target_json is not null").select("posting_id", "batch", jsonx.extract_json_block()(raw).alias("block"))


_STATED = " + ".join(f"cast(not ({s.is_null(x, s.name(x.path))}{'' if x.type != 'string' else f' or {s.name(x.path)} = ' + chr(39) * 2}) as integer)" for x in rec.LEAVES)


@query(f"""select record_id, {_STATED} as n_stated, case when {_STATED} <= 2 then 'degenerate_all_null' when length(coalesce(job_title, '')) < 3 then 'title_too_short' end as reason from {CANON}""")
def degenerate_records(spark, d):
    r = postings(spark, d).select("record_id", rec.canonical().alias("r"))
    return r.select("record_id", rec.stated_leaves(F.col("r")).alias("n_stated"), rec.degenerate(F.col("r")).alias("reason"))


_TRUTH = "(select posting_id, min(text) as source_text from raw_postings where text is not null group by 1)"
_COLS = {x.path: s.name(x.path) for x in rec.LEAVES}


def _sourced(spark, d):
    source = table(spark, d, "raw_postings").filter("text is not null").groupBy("posting_id").agg(F.min("text").alias("source_text"))
    return postings(spark, d).select("record_id", "posting_id", rec.canonical().alias("r")).join(source, "posting_id")


@query(f"""with t as (select c.*, {s.truncate('source_text')} as src from {CANON} c join {_TRUTH} using (posting_id))
select record_id, array_to_string({s.ungrounded(_COLS, 'src')}, '|') as ungrounded from t""")
def ungrounded_fields(spark, d):
    return _sourced(spark, d).select("record_id", joined(rec.ungrounded(F.col("r"), F.col("source_text"))).alias("ungrounded"))


@query(f"""with t as (select record_id, salary.min_amount as v, lower(source_text) as low from job_postings join {_TRUTH} using (posting_id) where salary.min_amount > 0)
select record_id, {s.digits('v', 'low')} as present from t""")
def digits_present(spark, d):
    rows = _sourced(spark, d).select("record_id", "source_text").join(postings(spark, d).filter("salary.min_amount > 0").select("record_id", F.col("salary.min_amount").alias("v")), "record_id")
    return rows.select("record_id", rec.digits_present(F.col("v"), F.lower("source_text")).alias("present"))


# ---- filters, joins, counters -------------------------------------------------------------------


@query("""select case when status <> 'ok' then 'teacher_' || status when target_json is null then 'reparse_no_json' else 'kept' end as reason, count(*) as n from train group by 1""")
def rejection_reasons(spark, d):
    t = table(spark, d, "train")
    rows = t.select("status", jsonx.parse_record()(F.col("target_json")).alias("p"), rec.degenerate(rec.from_json(F.col("target_json"))).alias("why"))
    reason = F.when(F.col("status") != "ok", F.concat(F.lit("teacher_"), F.col("status"))).when(F.col("p.error_kind").isNotNull(), F.concat(F.lit("reparse_"), F.col("p.error_kind")))
    return stats.counter(rows.select(F.coalesce(reason, "why", F.lit("kept")).alias("reason")), "reason")


@query("""select posting_id, batch, status from (select *, row_number() over (partition by posting_id order by is_gold desc, batch desc, labeled_at desc, status desc) as n from train) t where n = 1""")
def merged_labels(spark, d):
    """Gold rows over bulk rows, later over earlier, by posting."""
    t = table(spark, d, "train")
    t = t.withColumn("at", F.struct("batch", "labeled_at", "status"))
    out = files.merge_inputs([t.filter("not is_gold").drop("is_gold")], [t.filter("is_gold").drop("is_gold")], "posting_id", "at")
    return out.select("posting_id", "batch", "status")


@query("select count(*) as n_left from (select distinct posting_id from raw_postings where posting_id not in (select posting_id from job_postings where posting_id is not null)) t")
def unlabelled(spark, d):
    """Anti-join of postings with those that have records."""
    done = postings(spark, d).select("posting_id")
    return table(spark, d, "raw_postings").select("posting_id").distinct().join(done, "posting_id", "left_anti").agg(F.count("*").alias("n_left"))


@query("select distinct t.company_id as key from train t where t.company_id is not null and t.company_id not in ('', '-', 'nan', 'None', '0') and t.company_id in (select company_id from heldout)")
def shared_companies(spark, d):
    key = F.when(~F.col("company_id").isin("", "-", "nan", "None", "0"), F.col("company_id"))
    return stats.shared_keys(table(spark, d, "train"), table(spark, d, "heldout"), key)


@query("select status, count(*) as n from train group by 1")
def status_counts(spark, d):
    return stats.counter(table(spark, d, "train"), "status")


@query("select batch, round(avg(cast(status = 'ok' as integer)), 9) as share from train group by 1")
def yield_by_batch(spark, d):
    return stats.share(table(spark, d, "train"), F.col("status") == "ok", "batch").withColumn("share", F.round("share", 9))


@query("select split, round(avg(cast(is_gold as integer)), 9) as share from heldout group by 1")
def gold_share(spark, d):
    return stats.share(table(spark, d, "heldout"), F.col("is_gold"), "split").withColumn("share", F.round("share", 9))


@query("""select coalesce(cast(company_id as varchar), 'solo::' || doc_id) as company, count(*) as n, bool_and(lang = 'en') as all_en from documents group by 1""")
def company_groups(spark, d):
    """all_en goes by the stated languages; null if none is."""
    docs = table(spark, d, "documents")
    key = F.coalesce(F.col("company_id").cast("string"), F.concat(F.lit("solo::"), F.col("doc_id").cast("string")))
    return docs.groupBy(key.alias("company")).agg(F.count("*").alias("n"), F.every(F.col("lang") == "en").alias("all_en"))


_QS = (0.5, 0.75, 0.9, 0.95, 0.99, 1.0)


@query("with v as (select n_chars, row_number() over (order by n_chars) - 1 as i, count(*) over () as n from documents), q as (select unnest([" + ", ".join(f"{x}::double" for x in _QS)
       + "]) as q) select distinct q, n_chars as value from q, v where i = least(n - 1, cast(floor(q * n) as bigint))")
def length_percentiles(spark, d):
    return stats.place_percentiles(table(spark, d, "documents"), "n_chars", _QS)


@query("with c as " + CANON + " select * from (" + " union all ".join(
    f"select sample_idx, {s.q(x.path)} as field, round(avg(cast(not {s.is_null(x, s.name(x.path))} as integer)), 9) as rate from c group by 1" for x in rec.LEAVES) + ") t")
def stated_rates(spark, d):
    rows = postings(spark, d).select("sample_idx", rec.canonical().alias("r"))
    return stats.stated_rates(rows, "sample_idx", F.col("r")).withColumn("rate", F.round("rate", 9))


@query("select count_if(source is null or text is null) as n_bad, count(*) as n from documents")
def guarded_documents(spark, d):
    bad = F.col("source").isNull() | F.col("text").isNull()
    docs = stats.guard_share(table(spark, d, "documents").select("source", "text"), bad, 0.5, "too many empty documents")
    return docs.agg(F.count_if(bad).alias("n_bad"), F.count("*").alias("n"))


# ---- votes and audit ----------------------------------------------------------------------------

_SCALARS = [x for x in rec.LEAVES if not x.is_set]
_SETS = [x for x in rec.LEAVES if x.is_set]


def _vote_text(x: rec.Leaf) -> str:
    return f"cast(cast({s.name(x.path)} as decimal(18,2)) as varchar)" if x.comparator == "numeric" else s.name(x.path)


_VOTES = f"""with c as {CANON}, l as (""" + " union all ".join(f"select posting_id, record_id, {s.q(x.path)} as field, {_vote_text(x)} as value from c" for x in _SCALARS) + """),
n as (select posting_id, field, value, count(*) as n, min(record_id) as f from l group by all), k as (select *, sum(n) over (partition by posting_id, field) as k, row_number() over (partition by posting_id, field order by n desc, f) as r from n)
select posting_id, field, value, round(n / k, 9) as agreement from k where r = 1"""


@query(_VOTES)
def scalar_votes(spark, d):
    rows = postings(spark, d).select("posting_id", "record_id", rec.canonical().alias("r"))
    return vote.scalar_votes(rows, "posting_id", "record_id", F.col("r")).select(F.col("id").alias("posting_id"), "field", "value", F.round("agreement", 9).alias("agreement"))


_SETVOTES = f"""with c as {CANON}, k as (select posting_id, count(*) as k from c group by 1), l as (""" + " union all ".join(
    f"select posting_id, {s.q(x.path)} as field, unnest(list_distinct({s.name(x.path)})) as item from c" for x in _SETS) + f"""),
n as (select posting_id, field, item, count(*) as n from l group by all), w as (select posting_id, field, list_sort(list(item) filter (where n / k > 0.5)) as items, avg(n / k) as a from n join k using (posting_id) group by 1, 2)
select posting_id, field, array_to_string(coalesce(items, []), '|') as items, round(coalesce(a, 1.0), 9) as agreement
from (select posting_id, unnest([{", ".join(s.q(x.path) for x in _SETS)}]) as field from k) e left join w using (posting_id, field)"""


@query(_SETVOTES)
def set_votes(spark, d):
    rows = postings(spark, d).select("posting_id", "record_id", rec.canonical().alias("r"))
    return vote.set_votes(rows, "posting_id", "record_id", F.col("r")).select(F.col("id").alias("posting_id"), "field", joined(F.col("items")).alias("items"), F.round("agreement", 9).alias("agreement"))


def _valid_sql(cols: dict[str, str]) -> str:
    parts = [f"coalesce({cols['job_title']}, '') <> ''", f"coalesce(regexp_full_match(trim({cols['application_deadline']}), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}'), true)", f"coalesce({cols['years_experience_min']} between 0 and 50, true)"]
    parts += [f"coalesce({cols[p]} in ({', '.join(s.q(m) for m in ms)}), true)" for p, ms in rec.MEMBERS.items()]
    return " and ".join(parts)


_VOTED = ", ".join(f"max(case when field = {s.q(x.path)} then {('cast(cast(value as double) as integer)' if x.type == 'int' else 'cast(value as double)') if x.comparator == 'numeric' else 'value'} end) as {s.name(x.path)}" for x in _SCALARS)
_VOTED_SETS = ", ".join(f"max(case when field = {s.q(x.path)} then items end) as {s.name(x.path)}" for x in _SETS)
_HARD = f"min(agreement) filter (field in ({', '.join(s.q(x) for x in vote.HARD_FIELDS)})) as a"


@query(f"""with v as ({_VOTES}), m as (select posting_id, {_HARD}, {_VOTED} from v group by 1)
select case when not ({_valid_sql(_COLS)}) then 'vote_failed' when a < 0.67 then 'low_agreement' else 'ok' end as status, count(*) as n, round(sum(a), 6) as agreement from m group by 1""")
def vote_status(spark, d):
    rows = postings(spark, d).select("posting_id", "record_id", rec.canonical().alias("r"))
    voted = vote.vote_records(rows, "posting_id", "record_id", F.col("r"))
    return voted.groupBy("status").agg(F.count("*").alias("n"), F.round(F.sum(F.round("least_agreement", 9)), 6).alias("agreement"))


_PARSED = f"with c as (select * replace (trim(application_deadline) as application_deadline) from {CANON} where {_valid_sql(_COLS)})"


@query(f"""with sv as ({_VOTES.replace(f"with c as {CANON}", _PARSED)}), tv as ({_SETVOTES.replace(f"with c as {CANON}", _PARSED).replace("array_to_string(coalesce(items, []), '|') as items", "coalesce(items, []) as items")}),
m as (select posting_id, {_HARD}, {_VOTED} from sv group by 1), l as (select posting_id, {_VOTED_SETS} from tv group by 1), n as (select posting_id, count(*) as n from job_postings group by 1),
p as ({_PARSED} select posting_id, count(*) as n_parsed from c group by 1), t as (select posting_id, {s.truncate('source_text')} as src from {_TRUTH}),
g as (select t.posting_id, n.n, p.n_parsed, m.* exclude (posting_id), l.* exclude (posting_id), src from t left join n using (posting_id) left join p using (posting_id) left join m using (posting_id) left join l using (posting_id)),
u as (select *, case when n_parsed > 0 and a >= 0.67 then {s.ungrounded(_COLS, 'src')} else [] end as bad from g)
select posting_id, case when n is null then 'api_failed' when n_parsed is null then 'parse_failed' when a < 0.67 then 'low_agreement' when len(bad) > 0 then 'ungrounded' else 'ok' end as status,
coalesce(n_parsed, 0) as n_parsed, array_to_string(bad, '|') as ungrounded, case when n_parsed > 0 and a >= 0.67 and len(bad) = 0 then job_title end as job_title,
case when n_parsed > 0 and a >= 0.67 and len(bad) = 0 then array_to_string(required_skills, '|') end as required_skills from u""")
def label_funnel(spark, d):
    """Every posting's label from the raw outputs of all its samples, with the status of those that got none."""
    samples = postings(spark, d).filter("posting_id is not null").select(F.col("posting_id").alias("id"), F.col("record_id").alias("sample_idx"), rec.to_json(rec.canonical()).alias("output"))
    sources = table(spark, d, "raw_postings").filter("text is not null").groupBy(F.col("posting_id").alias("id")).agg(F.min("text").alias("text"))
    out = label.label(samples, sources.filter("id is not null"))
    r = F.col("record")
    return out.select(F.col("id").alias("posting_id"), "status", "n_parsed", joined(F.col("ungrounded")).alias("ungrounded"), r["job_title"].alias("job_title"), joined(r["required_skills"]).alias("required_skills"))


_FILLED = "2 + " + " + ".join(f"cast({'len(' + n + ') > 0' if n in rec.LIST_CAPS else n + ' is not null'} as integer)" for n in rec.SCHEMA.names if n not in ("location", "salary"))


@query(f"""with c as (select * replace (trim(application_deadline) as application_deadline), {_valid_sql(_COLS)} as fits from {CANON}), t as (select c.*, source_text, {s.strip('source_text')} = '' as blank, {s.truncate('source_text')} as src from c join {_TRUTH} using (posting_id))
select record_id, case when blank then 'empty_input' when fits then 'ok' else 'schema_error' end as status, case when fits and not blank then {_FILLED} end as n_filled,
case when fits and not blank then array_to_string({s.ungrounded(_COLS, 'src')}, '|') end as ungrounded, case when length(source_text) > length(src) then length(src) end as read_chars from t""")
def extraction_results(spark, d):
    """Every record as a model's output for its posting's text, as an extraction shows it."""
    rows = _sourced(spark, d).select("record_id", "source_text", rec.to_json(F.col("r")).alias("output"))
    out = label.extraction(rows, "record_id", "source_text", "output")
    return out.select(F.col("id").alias("record_id"), "status", "n_filled", joined(F.col("ungrounded")).alias("ungrounded"), "read_chars")


@query("select split, count(*) as n, count_if(is_gold) as n_voted, count(*) - count_if(is_gold) as n_single, round(count_if(is_gold) / count(*), 9) as voted_share from heldout group by 1")
def label_provenance(spark, d):
    return stats.provenance(stats.guard_least(table(spark, d, "heldout"), 1, "too few rows"), "split", F.col("is_gold"))


_META = ("title", "location", "min_salary", "max_salary", "pay_period", "currency", "formatted_work_type", "formatted_experience_level", "remote_allowed")


def _audit_sql() -> str:
    c = {p: "c." + n for p, n in _COLS.items()}
    filled = lambda x: f"({x} is not null and {x} <> '')"
    words = lambda x: f"list_filter(regexp_split_to_array({x}, '[ \\t\\n]+'), lambda w: w <> '')"
    title, theirs, place, region = f"lower({c['job_title']})", "lower(m.title)", "lower(m.location)", c["location.region"]
    levels = "[" + ", ".join(s.q(x) for x in rec.MEMBERS["seniority_level"]) + "]"
    level = s.mapped(audit.LEVELS, "lower(m.formatted_experience_level)")
    name = s.mapped(rec.REGION_NAMES, s.region(region))
    t = {
        "job_title": (f"{filled(title)} and {filled(theirs)}", f"contains({theirs}, {title}) or contains({title}, {theirs}) or len(list_intersect({words(title)}, {words(theirs)})) >= 2"),
        "location.city": (f"{filled(c['location.city'])} and {filled(place)}", f"contains({place}, lower({c['location.city']}))"),
        "location.region": (f"{filled(region)} and {filled(place)}", f"contains({place}, lower({region})) or coalesce(contains({place}, lower({s.region(region)})), false) or coalesce(contains({place}, {name}), false)"),
        "location.remote_policy": (f"{c['location.remote_policy']} is not null and m.remote_allowed is not null", f"(m.remote_allowed <> 0) = ({c['location.remote_policy']} in ('remote', 'hybrid'))"),
        "employment_type": (f"{c['employment_type']} is not null and {filled('m.formatted_work_type')}", f"{s.mapped(audit.WORK_TYPES, 'lower(m.formatted_work_type)')} = {c['employment_type']}"),
        "seniority_level": (f"{c['seniority_level']} is not null and {filled('m.formatted_experience_level')}", f"abs(coalesce(list_position({levels}, {c['seniority_level']}), 0) - case when {level} is null then null else list_position({levels}, {level}) end) <= 1"),
        "salary.currency": (f"{filled(c['salary.currency'])} and {filled('m.currency')}", f"{c['salary.currency']} = upper(m.currency)"),
        "salary.period": (f"{filled(c['salary.period'])} and {filled('m.pay_period')}", f"{s.mapped(audit.PERIODS, 'upper(m.pay_period)')} = {c['salary.period']}"),
    }
    for ours, other in (("salary.min_amount", "min_salary"), ("salary.max_amount", "max_salary")):
        v = f"try_cast(m.{other} as double)"
        t[ours] = (f"{c[ours]} is not null and {v} is not null", f"abs({c[ours]} - {v}) <= 0.05 * greatest({v}, 1.0)")
    parts = " union all ".join(f"select {s.q(f)} as field, count_if(coalesce({t[f][0]}, false)) as n_compared, count_if(coalesce({t[f][0]}, false) and coalesce({t[f][1]}, false)) as n_agree from c join m using (posting_id)" for f in audit.FIELDS)
    meta = ", ".join(f"max_by(struct_pack({', '.join(f'{x} := {x}' for x in _META)}), row_id) as m" for _ in (1,))
    return f"""with c as {CANON}, g as (select posting_id, {meta} from raw_postings group by 1), m as (select posting_id, {", ".join(f"m.{x} as {x}" for x in _META)} from g), a as ({parts})
select field, n_compared, n_agree, round(n_agree / n_compared, 4) as agreement from a where n_compared > 0"""


@query(_audit_sql())
def platform_audit(spark, d):
    """Records against the platform's own fields of the latest scrape."""
    meta = table(spark, d, "raw_postings").groupBy("posting_id").agg(F.max_by(F.struct(*_META), "row_id").alias("m"))
    rows = postings(spark, d).select("posting_id", rec.canonical().alias("r")).join(meta, "posting_id")
    return audit.audit(rows, F.col("r"), {x: F.col("m")[x] for x in _META})


# ---- scores -------------------------------------------------------------------------------------


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Per posting the first record of sample 0 as gold and of sample 1, if any, as prediction."""
    rows = postings(spark, d).filter("sample_idx < 2 and posting_id is not null").select("posting_id", "sample_idx", "record_id", rec.canonical().alias("r"))
    first = rows.groupBy("posting_id").agg(*[F.min_by(F.when(F.col("sample_idx") == i, F.col("r")), F.when(F.col("sample_idx") == i, F.col("record_id"))).alias(n) for i, n in ((0, "gold"), (1, "pred"))])
    source = table(spark, d, "raw_postings").filter("text is not null").groupBy("posting_id").agg(F.min("text").alias("source_text"))
    return first.filter("gold is not null").join(source, "posting_id")


def scored(spark: SparkSession, d: str) -> DataFrame:
    rows = pairs(spark, d).withColumn("strict", F.length("source_text") % 3 == 0).withColumn("seconds", F.length("source_text") / 1000)
    return score.score_pairs(rows, "gold", "pred", "source_text", ("posting_id",), "strict", "seconds")


_PAIRS = f"""c as {CANON}, z as (select *, row_number() over (partition by posting_id, sample_idx order by record_id) as rn from c where sample_idx < 2 and posting_id is not null),
pairs as (select g.posting_id, p.posting_id is not null as parsed, {s.truncate('t.source_text')} as src, {", ".join(f"g.{n} as g_{n}, p.{n} as p_{n}" for n in _COLS.values())}
from (select * from z where rn = 1 and sample_idx = 0) g left join (select * from z where rn = 1 and sample_idx = 1) p using (posting_id) join {_TRUTH} t on t.posting_id = g.posting_id)"""
_G = {p: "g_" + n for p, n in _COLS.items()}
_P = {p: "p_" + n for p, n in _COLS.items()}


def _counts_sql(x: rec.Leaf) -> str:
    g, p = _G[x.path], _P[x.path]
    if x.is_set:
        g, p = f"list_distinct(coalesce({g}, []))", f"list_distinct(coalesce({p}, []))"
        both = f"len(list_intersect({g}, {p}))"
        return f"{both} as tp, len({p}) - {both} as fp, len({g}) - {both} as fn, cast(len({g}) = 0 and len({p}) = 0 as integer) as tn"
    ok = f"({g} is not null and {p} is not null and coalesce({s.same(x, g, p)}, false))"
    return (f"cast({ok} as integer) as tp, cast({p} is not null and not {ok} as integer) as fp, cast({g} is not null and not {ok} as integer) as fn, "
            f"cast({g} is null and {p} is null as integer) as tn")


_FIELD_ROWS = " union all ".join(f"select posting_id, {s.q(x.path)} as field, {x.tier} as tier, {_counts_sql(x)} from pairs" for x in rec.LEAVES)
_F1 = "case when tp = 0 then 0.0 else 2.0 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) end"


@query(f"""with {_PAIRS}, f as ({_FIELD_ROWS}), a as (select field, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn, sum(tn) as tn from f group by 1)
select field, cast(tp as bigint) as tp, cast(fp as bigint) as fp, cast(fn as bigint) as fn, cast(tn as bigint) as tn, round(case when tp + fp = 0 then 0 else tp / (tp + fp) end, 9) as precision,
round(case when tp + fn = 0 then 0 else tp / (tp + fn) end, 9) as recall, round({_F1}, 9) as f1, cast(tp + fn as bigint) as support from a""")
def field_scores(spark, d):
    out = score.with_f1(score.field_counts(scored(spark, d)))
    return out.select("field", "tp", "fp", "fn", "tn", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"), F.round("f1", 9).alias("f1"), "support")


_ROLL = f"""select 'micro_f1' as metric, {_F1} as value from (select sum(tp) as tp, sum(fp) as fp, sum(fn) as fn from a) union all
select 'macro_f1', avg({_F1}) from a union all select 'tier_' || tier, avg({_F1}) from a group by tier"""


@query(f"""with {_PAIRS}, f as ({_FIELD_ROWS}), a as (select field, tier, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn from f group by 1, 2), r as ({_ROLL})
select metric, round(value, 9) as value from r""")
def score_rollup(spark, d):
    return score.roll_up(score.field_counts(scored(spark, d))).select("metric", F.round("value", 9).alias("value"))


_RIGHT = {x.path: f"(case when parsed then coalesce({s.same(x, _G[x.path], _P[x.path])}, false) else {_G[x.path]} is null end)" for x in rec.LEAVES}
_EMIT = {x.path: f"cast(parsed and not {s.is_null(x, _P[x.path])} as integer)" for x in rec.LEAVES}
_EXAMPLE = f"""select posting_id, parsed, parsed and {" and ".join(_RIGHT.values())} as exact_match, {" + ".join(f"cast({c} as integer)" for c in _RIGHT.values())} as n_correct, {" + ".join(_EMIT.values())} as n_emitted,
{" + ".join(f"({_EMIT[x.path]} * cast({s.is_null(x, _G[x.path])} as integer))" for x in rec.LEAVES)} as n_over_emitted, {" + ".join(f"cast({g} is null as integer)" for g in _G.values())} as n_gold_null,
{" + ".join(f"cast({_G[p]} is null and (not parsed or {_P[p]} is null) as integer)" for p in _G)} as n_correct_null, case when parsed then {s.ungrounded(_P, 'src')} else [] end as ungrounded from pairs"""


@query(f"with {_PAIRS}, e as ({_EXAMPLE}) select * exclude (ungrounded), array_to_string(ungrounded, '|') as ungrounded from e")
def example_scores(spark, d):
    e = scored(spark, d)
    right = F.size(F.filter(F.map_values("field_correct"), lambda x: x))
    return e.select("posting_id", "parsed", "exact_match", right.alias("n_correct"), "n_emitted", "n_over_emitted", "n_gold_null", "n_correct_null", joined(F.col("ungrounded")).alias("ungrounded"))


@query(f"""with {_PAIRS}, e as ({_EXAMPLE}) select count(*) as n, round(avg(cast(parsed as integer)), 9) as parse_rate, round(avg(cast(exact_match as integer)), 9) as exact_match,
round(sum(len(ungrounded)) / greatest(sum(n_emitted), 1), 9) as hallucination_rate, round(sum(n_over_emitted) / greatest(sum(n_emitted), 1), 9) as over_emission_rate,
round(sum(n_correct_null) / greatest(sum(n_gold_null), 1), 9) as null_recall,
round(sum(cast(parsed and n_chars % 3 = 0 as integer)) / count(*), 9) as strict_rate, round(sum(n_chars / 1000) / count(*), 9) as mean_latency_s from e join (select posting_id, length(source_text) as n_chars from {_TRUTH}) using (posting_id)""")
def score_rates(spark, d):
    r = score.rates(scored(spark, d))
    return r.select("n", *[F.round(c, 9).alias(c) for c in r.columns if c != "n"])


_B = 1000
_BOOT = f"""with {_PAIRS}, f as ({_FIELD_ROWS}), o as (select posting_id, row_number() over (order by posting_id) - 1 as spot, count(*) over () as n from pairs),
w as (select r as replicate, {s.draw13('17', 'r', 'j')} % (select any_value(n) from o) as spot, count(*) as w from range({_B}) a(r), range((select any_value(n) from o)) b(j) group by all),
a as (select replicate, field, tier, sum(tp * w) as tp, sum(fp * w) as fp, sum(fn * w) as fn from f join o using (posting_id) join w using (spot) group by all),
m as (select replicate, {_F1} as micro_f1 from (select replicate, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn from a group by 1)), x as (select replicate, avg({_F1}) as macro_f1 from a group by 1)"""


@query(_BOOT + " select replicate, round(micro_f1, 9) as micro_f1, round(macro_f1, 9) as macro_f1 from m join x using (replicate)")
def bootstrap_replicates(spark, d):
    b = score.bootstrap(scored(spark, d), "posting_id", _B)
    return b.select("replicate", F.round("micro_f1", 9).alias("micro_f1"), F.round("macro_f1", 9).alias("macro_f1"))


@query(_BOOT + f" select round((list_sort(list(micro_f1)))[{int(0.025 * _B) + 1}], 9) as low, round((list_sort(list(micro_f1)))[{int(0.975 * _B)}], 9) as high from m")
def bootstrap_interval(spark, d):
    b = score.bootstrap(scored(spark, d), "posting_id", _B)
    return score.percentile_interval(b, "micro_f1", (), _B, 0.05).select(F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


_POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(9)]
_POISSON_W = " + ".join(f"cast(u >= {b!r}::double as integer)" for b in _POISSON)


@query(f"""with {_PAIRS}, f as (select posting_id, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn from ({_FIELD_ROWS}) group by 1), d as (select f.*, r as replicate, cast(('0x' || substr(md5('17|' || r || '|' || posting_id), 1, 13)) as bigint) / pow(16, 13) as u from f, range({_B}) a(r)),
m as (select replicate, {_F1} as micro_f1 from (select replicate, sum(tp * w) as tp, sum(fp * w) as fp, sum(fn * w) as fn from (select *, {_POISSON_W} as w from d) group by 1))
select round((list_sort(list(micro_f1)))[{int(0.025 * _B) + 1}], 9) as low, round((list_sort(list(micro_f1)))[{int(0.975 * _B)}], 9) as high from m""")
def poisson_bootstrap(spark, d):
    """The resampling for large tables: no order, no count."""
    out = score.percentile_interval(score.bootstrap(scored(spark, d), "posting_id", _B, poisson=True), "micro_f1", (), _B)
    return out.select(F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@query()
def paired_test(spark, d):
    """Samples 1 and 2 against sample 0."""
    rows = postings(spark, d).filter("posting_id is not null").select("posting_id", "sample_idx", "record_id", rec.canonical().alias("r"))
    one = rows.groupBy("posting_id").agg(*[F.min_by(F.when(F.col("sample_idx") == i, F.col("r")), F.when(F.col("sample_idx") == i, F.col("record_id"))).alias(f"s{i}") for i in (0, 1, 2)])
    one = durable(one.filter("s0 is not null and s1 is not null and s2 is not null"))
    a, b = (durable(score.score_pairs(one, "s0", f"s{i}", None, ("posting_id",))) for i in (1, 2))
    return score.paired_test(a, b, "posting_id", replicates=_B)


_DIFF = {x.path: (f"(coalesce({_G[x.path]}, []) is distinct from coalesce({_P[x.path]}, []))" if x.is_set else f"({_G[x.path]} is distinct from {_P[x.path]})") for x in rec.LEAVES}


def _tags_sql() -> str:
    tags = [f"case when len({s.ungrounded(_P, 'src')}) > 0 then 'ungrounded' end"]
    for x in rec.LEAVES:
        if x.path.startswith("salary."):
            tags.append(f"case when {_DIFF[x.path]} then 'salary_misparse' end")
            continue
        g0, p0 = s.is_null(x, _G[x.path]), s.is_null(x, _P[x.path])
        other = {"categorical": "'enum_confusion'", "set": "'set_partial'"}.get(x.comparator, "null")
        tags.append(f"case when {_DIFF[x.path]} and {g0} and not {p0} then 'over_emission' when {_DIFF[x.path]} and not {g0} and {p0} then 'missed_extraction' when {_DIFF[x.path]} then {other} end")
    return f"case when not parsed then ['unparseable'] else list_sort(list_distinct(list_filter([{', '.join(tags)}], lambda t: t is not null))) end"


@query(f"""with {_PAIRS}, t as (select posting_id, {_tags_sql()} as tags from pairs), n as (select count(*) as n from t where len(tags) > 0)
select tag, count(*) as n, round(count(*) / (select n from n), 6) as share from (select unnest(tags) as tag from t) group by 1""")
def failure_histogram(spark, d):
    p = pairs(spark, d)
    ungrounded = F.when(F.col("pred").isNotNull(), rec.ungrounded(F.col("pred"), F.col("source_text"))).otherwise(F.array().cast("array<string>"))
    return score.failure_histogram(p.select(score.failure_tags(F.col("gold"), F.col("pred"), ungrounded).alias("tags")), "tags")


@query(f"with {_PAIRS}, x as (" + " union all ".join(f"select {s.q(p)} as field, count(*) as n_pairs, cast(count_if({_G[p]} is distinct from {_P[p]}) as bigint) as n_differ from pairs where parsed" for p in _COLS) + ") select * from x")
def disagreements(spark, d):
    p = pairs(spark, d).filter("pred is not null")
    return score.disagreements(p.select("posting_id", F.col("gold").alias("r")), p.select("posting_id", F.col("pred").alias("r")), "posting_id", "r")


@query("""with a as (select lang, count(*)::double as value from documents where source = 'board_north' group by 1), b as (select lang, count(*)::double as value from documents where source = 'board_south' group by 1)
select lang as metric, a.value as a, b.value as b, b.value - a.value as delta, a.value - b.value > 0.02 as regression, round(case when a.value - b.value > 1e-9 then (b.value / 2 - b.value) / (a.value - b.value) end, 9) as gap
from a join b using (lang)""")
def metric_deltas(spark, d):
    """Two (metric, value) tables side by side, with the share of the gap that half of b closes."""
    docs = table(spark, d, "documents")
    a, b = (docs.filter(F.col("source") == x).groupBy(F.col("lang").alias("metric")).agg(F.count("*").cast("double").alias("value")) for x in ("board_north", "board_south"))
    out = score.metric_deltas(a, b)
    return out.withColumn("gap", F.round(score.gap_closed(F.col("b"), F.col("b") / 2, F.col("a")), 9))


@query("""select source as metric, cast(count_if(lang = 'en') as double) as en, cast(count_if(lang = 'de') as double) as de from documents group by 1""")
def comparison_matrix(spark, d):
    docs = table(spark, d, "documents")
    runs = {x: docs.groupBy(F.col("source").alias("metric")).agg(F.count_if(F.col("lang") == x).cast("double").alias("value")) for x in ("en", "de")}
    return score.comparison(runs)


_KEYS = {x.path: (f"(list_sort(list_distinct({{}})))" if x.is_set else "{}") for x in rec.LEAVES}
_HITS = " + ".join(f"cast({_KEYS[p].format(_G[p])} is not distinct from {_KEYS[p].format(_P[p])} as integer)" for p in _COLS)


@query(f"with {_PAIRS}, h as (select case when parsed then {_HITS} else 0 end as h from pairs) select count(*) * 18 as n, cast(sum(h) as bigint) as hits, round(sum(h) / (count(*) * 18), 9) as rate from h")
def exact_leaf_rate(spark, d):
    return score.exact_leaf_rate(pairs(spark, d), "gold", "pred").withColumn("rate", F.round("rate", 9))


@query(f"""with {_PAIRS}, f as ({_FIELD_ROWS}), a as (select field, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn from f where field in ({", ".join(s.q(x) for x in perturb.TAIL_FIELDS)}) group by 1)
select round(avg({_F1}), 9) as restricted_macro_f1 from a""")
def restricted_macro(spark, d):
    out = score.restricted_macro(score.field_counts(scored(spark, d)), list(perturb.TAIL_FIELDS))
    return out.select(F.round("restricted_macro_f1", 9).alias("restricted_macro_f1"))


def _digests():
    def model(texts):
        if any("€" in t for t in texts):
            raise ValueError("cannot read a text")
        return [hashlib.md5(t.encode()).hexdigest() for t in texts]
    return model


@query("select row_id, case when not contains(text, '€') then md5(text) end as output, case when contains(text, '€') then 'ValueError: cannot read a text' end as error from raw_postings")
def model_outputs(spark, d):
    """Batched calls of a stand-in model, packed by cost; the texts it can't read keep their rows with an error."""
    return infer.generate(table(spark, d, "raw_postings"), "row_id", "text", _digests).select(F.col("id").alias("row_id"), "output", "error")


_FINISHES = ("stop", "length", "STOP", None, "content_filter", "")
_FINISH = "case batch " + " ".join(f"when {i + 1} then {s.q(f) if f is not None else 'null'}" for i, f in enumerate(_FINISHES)) + " end"


@query("select form, verdict, count(*) as n from (" + " union all ".join(
    f"""select {i} as form, case when {_FINISH} in ('length', 'content_filter') then 'permanent' when {k} = 'schema_error' then 'permanent' when {k} in ('no_json', 'json_decode_error') then 'transient' else 'ok' end as verdict
from train where target_json is not null""" for i, k in enumerate(_KINDS)) + ") t group by 1, 2")
def completion_verdicts(spark, d):
    """Outputs of parsed_output, ended in every way, by whether another attempt could help."""
    finish = F.element_at(F.array(*[F.lit(f).cast("string") for f in _FINISHES]), F.col("batch"))
    out = parsed_output(spark, d).select("form", infer.verdict(finish, F.col("error_kind")).alias("verdict"))
    return out.groupBy("form", "verdict").agg(F.count("*").alias("n"))


# ---- perturbations ------------------------------------------------------------------------------

_ARM_SQL = {
    "identity": "text", "boilerplate_flood": f"text || {s.q(perturb.NOTICE)}",
    "truncate_tail": "substr(text, 1, greatest(400, cast(floor(length(text) * 0.4) as integer)))",
}
_m = "text"
for _a, _b in perturb.MISREADINGS:
    _m = f"replace({_m}, {s.q(_a)}, {s.q(_b)})"
_ARM_SQL["mojibake"] = _m
_SENT = "string_split(regexp_replace(text, '([.!?\\n])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g'), chr(1))"
for _n, _pat in (("strip_salary", tx.SALARY), ("strip_deadline", perturb.DEADLINE_CUE)):
    _ARM_SQL[_n] = f"array_to_string(list_filter({_SENT}, lambda x: not regexp_matches(x, {s.q(_pat)})), ' ')"


def _suite(spark, d, arms):
    rows = table(spark, d, "raw_postings").filter("text is not null").select("row_id", "text", F.lit(None).cast(rec.SCHEMA).alias("gold"))
    return perturb.build_suite(rows, "row_id", "text", "gold", {a: perturb.ARMS[a] for a in arms})


@query("select row_id, arm, row_id || '::' || arm as variant_id, md5(t) as digest from (" + " union all ".join(
    f"select row_id, '{a}' as arm, {e} as t from raw_postings where text is not null" for a, e in _ARM_SQL.items()) + ") x")
def perturbed(spark, d):
    """The arms without random choices; shout_case is perturbed_shouting."""
    return _suite(spark, d, _ARM_SQL).select(F.col("id").alias("row_id"), "arm", "variant_id", F.md5("text").alias("digest"))


@query()
def perturbed_shouting(spark, d):
    """The arm shout_case, without SQL: engines differ in the capital of the eszett."""
    return _suite(spark, d, ["shout_case"]).select(F.col("id").alias("row_id"), "arm", "variant_id", F.md5("text").alias("digest"))


_GOLD_ARMS = ("identity", "strip_salary", "strip_deadline", "truncate_tail")


@query(f"with c as {CANON}, p as (select record_id, c.* exclude (record_id) from c where posting_id in (select posting_id from raw_postings where text is not null)) select * from (" + " union all ".join(
    f"""select record_id, '{a}' as arm, job_title, {'null' if a == 'strip_salary' else 'salary__min_amount'} as min_amount, {'null' if a == 'strip_salary' else 'salary__period'} as period,
{'null' if a == 'strip_deadline' else 'application_deadline'} as deadline, array_to_string(required_skills, '|') as required_skills from p""" for a in _GOLD_ARMS) + ") t")
def perturbed_gold(spark, d):
    """What the arms do to the record that a changed text should give."""
    suite = perturb.build_suite(_sourced(spark, d).select("record_id", "source_text", "r"), "record_id", "source_text", "r", {a: perturb.ARMS[a] for a in _GOLD_ARMS})
    g = F.col("gold")
    return suite.select(F.col("id").alias("record_id"), "arm", g["job_title"].alias("job_title"), g["salary"]["min_amount"].alias("min_amount"), g["salary"]["period"].alias("period"),
                        g["application_deadline"].alias("deadline"), joined(g["required_skills"]).alias("required_skills"))


@query()
def perturbed_randomly(spark, d):
    rows = _sourced(spark, d).select("record_id", "source_text", "r")
    suite = perturb.build_suite(rows, "record_id", "source_text", "r", {a: perturb.ARMS[a] for a in ("whitespace_chaos", "html_residue", "typos")})
    return suite.select(F.col("id").alias("record_id"), "arm", F.md5("text").alias("digest"))


# ---- files and streams --------------------------------------------------------------------------


def _folder(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder."""
    durable(spark.range(1))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get() + "/" + next(tempfile._get_candidate_names())


@query("select posting_id, status, batch from train where batch = 2")
def split_round_trip(spark, d):
    """Written by split and read back with only one split's folder opened."""
    folder = _folder(spark)
    files.write_splits(table(spark, d, "train").select("posting_id", "status", "batch", F.col("batch").cast("string").alias("split")), folder, form="parquet")
    return files.read_split(spark, folder, "2").select("posting_id", "status", "batch")


@query("select distinct posting_id from train where posting_id is not null")
def logged_ids(spark, d):
    """Identifiers of a JSON-lines log with torn lines."""
    folder = _folder(spark)
    lines = table(spark, d, "train").select(F.explode(F.array(F.to_json(F.struct("posting_id", "status")), F.lit('{"posting_id": "torn'), F.lit('{"other": 1}'))).alias("value"))
    lines.write.text(folder)
    return files.logged_ids(spark, folder, "posting_id")


@query("select user_id, max_by(value, event_id) as value from events group by 1")
def last_wins(spark, d):
    return files.last_wins(table(spark, d, "events").select("user_id", "value", "event_id"), "user_id", F.col("event_id")).select("user_id", "value")


@query("""select time_bucket(interval '1 hour', ts) as window_start, event_type, count(*) as n, count(*) - 3 as excess from events group by 1, 2 having count(*) > 3""")
def rate_excess(spark, d):
    """Hours in which an event type is over its budget."""
    return stats.windowed_excess(table(spark, d, "events"), "ts", "1 hour", 3, "event_type")


def _event_stream(spark, d):
    source = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = _folder(spark)
    source.repartition(4).write.parquet(f"{folder}/in")
    return incremental.file_stream(spark, f"{folder}/in", source.schema, files_per_batch=2), folder


@query("select event_id, user_id, round(value * 2, 6) as doubled from events")
def resumable_stream(spark, d):
    """Each event worked on once, by a stream that ends when nothing is left."""
    stream, folder = _event_stream(spark, d)
    incremental.resume(stream, "event_id", lambda b: b.select("event_id", "user_id", F.round(F.col("value") * 2, 6).alias("doubled")), f"{folder}/out", f"{folder}/at")
    return spark.read.parquet(f"{folder}/out").select("event_id", "user_id", "doubled")


@query("select user_id, max_by(value, event_id) as value from events group by 1")
def stream_latest(spark, d):
    stream, folder = _event_stream(spark, d)
    incremental.latest(stream.select("user_id", "value", "event_id"), "user_id", F.col("event_id"), f"{folder}/out", f"{folder}/at")
    return incremental.latest_rows(spark, f"{folder}/out").select("user_id", "value")


@query("select time_bucket(interval '6 hours', ts) as window_start, event_type, count(*) as n from events group by 1, 2")
def stream_windows(spark, d):
    """Tumbling counts by a stream; the watermark is longer than the data's disorder, so that all rows count."""
    stream, folder = _event_stream(spark, d)
    counts = incremental.window_counts(stream, "ts", "6 hours", "400 days", "event_type")
    whole = counts.writeStream.outputMode("complete").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{folder}/out"))
    whole.option("checkpointLocation", f"{folder}/at").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")
