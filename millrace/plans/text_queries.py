"""Registered queries over texts, with their SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import records as rec
from ..functions import text as tx
from ..operators import dedup, sampling
from ..runtime import table
from . import sql as s

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f
    return add


def raw(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_postings")


def cleaned(spark: SparkSession, d: str) -> DataFrame:
    rows = raw(spark, d).select("row_id", "source", "posting_id", F.col("text").alias("raw"))
    return tx.once(rows, text=tx.clean_text(F.col("raw"))).drop("raw")


CLEANED = f"(select row_id, source, posting_id, {s.clean('text')} as text from raw_postings)"


@query(f"""
with c as {CLEANED}, a as (select * from c where {s.admitted('text')}),
f as (select source, text, row_number() over (partition by sha1(text) order by row_id) as n from a)
select source, {s.stratum('text')} as stratum, count(*) as n from f where n = 1 group by all""")
def corpus_strata(spark, d):
    """Clean, gate by length and language, drop exact copies, count strata per source."""
    docs = cleaned(spark, d).filter(tx.length_ok(F.col("text")) & tx.looks_english(F.col("text")))
    unique = docs.groupBy(F.sha1("text").alias("h")).agg(F.min_by(F.struct("source", "text"), "row_id").alias("r")).select("r.*")
    return unique.groupBy("source", tx.stratum(F.col("text")).alias("stratum")).agg(F.count("*").alias("n"))


@query(f"select row_id, text from {CLEANED}")
def clean_text(spark, d):
    return cleaned(spark, d).select("row_id", "text")


@query(f"""select row_id, len(regexp_extract_all(text, {s.q(tx.URL)})) as n_urls,
len(regexp_extract_all(regexp_replace(text, {s.q(tx.URL)}, '[URL]', 'g'), {s.q(tx.EMAIL)})) as n_mails from raw_postings where text is not null""")
def contact_counts(spark, d):
    urls, mails = tx.contact_counts(F.col("text"))
    return raw(spark, d).filter("text is not null").select("row_id", urls.alias("n_urls"), mails.alias("n_mails"))


@query(f"select row_id, length(text) as n_chars, {s.hits('text')} as n_hits, {s.admitted('text')} as admitted from {CLEANED}")
def admission(spark, d):
    t = F.col("text")
    return cleaned(spark, d).select("row_id", F.length(t).alias("n_chars"), tx.stop_word_hits(t).alias("n_hits"), (tx.length_ok(t) & tx.looks_english(t)).alias("admitted"))


@query(f"""select row_id, {s.has('text', tx.SALARY)} as has_salary, {s.has('text', tx.DEADLINE)} as has_deadline, {s.stratum('text')} as stratum
from raw_postings where text is not null""")
def text_strata(spark, d):
    t = F.col("text")
    return raw(spark, d).filter("text is not null").select("row_id", tx.mentions_salary(t).alias("has_salary"), tx.mentions_deadline(t).alias("has_deadline"), tx.stratum(t).alias("stratum"))


@query("""select row_id, sha1(text) as content_hash, case when posting_id is null or posting_id in ('', '0') then substr(sha1(text), 1, 16) else posting_id end as document_id
from raw_postings where text is not null""")
def document_ids(spark, d):
    t = F.col("text")
    return raw(spark, d).filter("text is not null").select("row_id", tx.content_hash(t).alias("content_hash"), tx.document_id(F.col("posting_id"), t).alias("document_id"))


@query(f"""with w as (select doc_id, {s.words('text')} as w from documents), r as (select doc_id, len(w) as n_words, {s.shingles('w')} as runs from w)
select doc_id, n_words, len(runs) as n_runs, md5(array_to_string(list_sort(runs), '|')) as digest from r""")
def word_runs(spark, d):
    runs = tx.shingles(F.col("text"))
    return (table(spark, d, "documents").select("doc_id", F.size(tx.word_list(F.col("text"))).alias("n_words"), runs.alias("runs"))
            .select("doc_id", "n_words", F.size("runs").alias("n_runs"), F.md5(F.array_join(F.array_sort("runs"), "|")).alias("digest")))


@query(f"""with t as (select doc_id, text, {s.truncate('text')} as cut from documents)
select doc_id, length(cut) as n_chars, md5(cut) as digest, substr(text, 1, 400) as excerpt from t""")
def truncated_sources(spark, d):
    return (table(spark, d, "documents").select("doc_id", tx.truncate_source(F.col("text")).alias("cut"), tx.excerpt(F.col("text"), 400).alias("excerpt"))
            .select("doc_id", F.length("cut").alias("n_chars"), F.md5("cut").alias("digest"), "excerpt"))


@query(f"select row_id, {s.comparable('title')} as title, {s.short('location')} as location from raw_postings")
def comparable_titles(spark, d):
    return raw(spark, d).select("row_id", tx.comparable(F.col("title")).alias("title"), rec.short_text(F.col("location")).alias("location"))


@query("""with s as (select doc_id, string_split(regexp_replace(text, '([.!?\\n])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g'), chr(1)) as s from documents)
select doc_id, len(s) as n_sentences, list_max(list_transform(s, lambda x: length(x))) as longest from s""")
def sentence_counts(spark, d):
    return (table(spark, d, "documents").select("doc_id", tx.sentences(F.col("text")).alias("s"))
            .select("doc_id", F.size("s").alias("n_sentences"), F.array_max(F.transform("s", F.length)).alias("longest")))


@query(f"""select row_id, 'Extract one JSON record from the posting.' || chr(10) || chr(10) || 'POSTING:' || chr(10) || {s.truncate('text')} || chr(10) || chr(10) || 'JSON:' as prompt
from raw_postings where text is not null""")
def prompts(spark, d):
    return raw(spark, d).filter("text is not null").select("row_id", tx.build_prompt(F.col("text")).alias("prompt"))


@query(f"""with p as (select posting_id, batch, unnest([struct_pack(role := 'system', content := 'Answer with one JSON object only.'),
struct_pack(role := 'user', content := 'Extract one JSON record from the posting.' || chr(10) || chr(10) || 'POSTING:' || chr(10) || {s.truncate('source_text')} || chr(10) || chr(10) || 'JSON:'),
struct_pack(role := 'assistant', content := target_json)]) as m from train where status = 'ok' and target_json is not null and source_text is not null)
select posting_id, batch, m.role as role, m.content as content from p""")
def tuning_messages(spark, d):
    """Training turns: system, prompt, answer."""
    rows = table(spark, d, "train").filter("status = 'ok' and target_json is not null and source_text is not null")
    turns = F.concat(tx.build_messages(F.col("source_text")), F.array(F.struct(F.lit("assistant").alias("role"), F.col("target_json").alias("content"))))
    return rows.select("posting_id", "batch", F.explode(turns).alias("m")).select("posting_id", "batch", "m.role", "m.content")


@query("select posting_id, batch, target_json || '<|im_end|>' || chr(10) as trained from train where target_json is not null")
def trained_parts(spark, d):
    """What completion-only training learns from each rendered conversation."""
    rows = table(spark, d, "train").filter("target_json is not null")
    turns = F.concat(tx.build_messages(F.coalesce("source_text", F.lit(""))), F.array(F.struct(F.lit("assistant").alias("role"), F.col("target_json").alias("content"))))
    return rows.select("posting_id", "batch", tx.trained_part(tx.render_turns(turns)).alias("trained"))


def _extract_sql() -> str:
    has = lambda w: f"contains(low, '{w}')"
    names = ["money", "cur", "amt", "k"]
    money = f"regexp_extract(text, {s.q(tx.MONEY)}, ['cur', 'amt', 'k'])"
    vocab = "[" + ", ".join(s.q(w) for w in sorted(tx.VOCABULARY)) + "]"
    perks = "[" + ", ".join(s.q(w) for w in sorted(tx.BENEFITS)) + "]"
    del names
    return f"""with a as (select row_id, text, lower(text) as low, {money} as m, try_cast(regexp_extract(text, {s.q(tx.YEARS)}, 1) as integer) as y from raw_postings where text is not null),
b as (select *, m.cur as cur, try_cast(replace(m.amt, ',', '') as double) * case when m.k <> '' then 1000.0 else 1.0 end as v from a),
c as (select *, case when (cur <> '' or m.k <> '') and v > 0 and v < 1e9 then v end as pay, {s.strip("substr(split_part(text, chr(10), 1), 1, 80)")} as title from b)
select row_id, case when title = '' then 'unknown' else title end as job_title,
case when {has('remote')} then 'remote' when {has('hybrid')} then 'hybrid' end as remote_policy,
case when {has('full-time')} or {has('full time')} then 'full_time' end as employment_type,
case when {has('senior')} then 'senior' when {has('entry')} then 'entry' end as seniority_level,
case when {has('bachelor')} then 'bachelor' end as education_requirement, pay as amount,
case when pay is not null then case when cur = '£' then 'GBP' when cur = '€' then 'EUR' when cur = '₹' then 'INR' when upper(cur) in ('USD','GBP','EUR','INR') then upper(cur) else 'USD' end end as currency,
case when pay < 200 then 'hourly' when pay is not null then 'yearly' end as period,
case when y <= 50 then y end as years_experience_min,
array_to_string(list_filter({vocab}, lambda w: contains(low, w))[1:15], '|') as required_skills,
array_to_string(list_filter({perks}, lambda w: contains(low, w))[1:10], '|') as benefits from c"""


@query(_extract_sql())
def extracted_records(spark, d):
    rows = raw(spark, d).filter("text is not null").select("row_id", tx.extract_record(F.col("text")).alias("r")).select("row_id", "r.*")
    return rows.withColumn("required_skills", F.array_join("required_skills", "|")).withColumn("benefits", F.array_join("benefits", "|"))


@query("""select row_id, case when coalesce(min_salary, '') = '' or regexp_matches(coalesce(min_salary, ''), '^(?:PASTE_|SET_|your-|<)') then null else min_salary end as min_salary from raw_postings""")
def unset_values(spark, d):
    return raw(spark, d).select("row_id", tx.unset_to_null(F.col("min_salary")).alias("min_salary"))


# ---- duplicates ---------------------------------------------------------------------------------


@query("""select doc_id, min(doc_id) over (partition by sha1(text)) as first_id, count(*) over (partition by sha1(text)) as n_copies from documents where text is not null""")
def exact_copies(spark, d):
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", F.sha1("text").alias("h"))
    firsts = docs.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_copies"))
    return docs.join(firsts, "h").select("doc_id", "first_id", "n_copies")


@query("select doc_id, source from (select *, row_number() over (partition by sha1(text) order by added_at, doc_id) as n from documents) t where n = 1")
def exact_first(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "text", "added_at")
    return dedup.exact_first(docs, F.sha1("text"), F.struct("added_at", "doc_id")).select("doc_id", "source")


_NEAR = f"""with recursive w as (select doc_id, {s.words('text')} as w from documents where text is not null),
c as (select doc_id, array_to_string(w, ' ') as body, w from w), h as (select body, min(doc_id) as head, any_value(w) as w from c group by body),
r as (select head, unnest({s.shingles('w')}) as run from h), n as (select head, count(*) as n from r group by head),
p as (select a.head as x, b.head as y, count(*) as k from r a join r b on a.run = b.run and a.head < b.head group by all),
l as (select x, y from p join n a on a.head = x join n b on b.head = y where k / (a.n + b.n - k) >= 0.8)"""


@query(_NEAR + """, deg as (select head, count(*) as n_links from (select x as head from l union all select y from l) group by head)
select doc_id, head, coalesce(n_links, 0) as n_links from c join h using (body) left join deg using (head)""")
def near_duplicate_links(spark, d):
    """Per document its class of equal words (its smallest id) and how many different texts are at 0.8 or more."""
    members, links = dedup.similar_classes(table(spark, d, "documents"), "doc_id", "text")
    degree = links.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("n_links"))
    heads = members.groupBy("cls").agg(F.min("id").alias("head"))
    return members.join(heads, "cls").join(degree, "cls", "left").select(F.col("id").alias("doc_id"), "head", F.coalesce("n_links", F.lit(0)).alias("n_links"))


@query()
def deduplicated(spark, d):
    """Per document the kept one that it repeats, exactly or nearly, in the order of ids."""
    return dedup.deduplicate(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


@query()
def dedup_report(spark, d):
    return dedup.dedup_report(dedup.deduplicate(table(spark, d, "documents"), "doc_id", "text"))


def _runs_sql(table: str, key: str) -> str:
    return f"""select {key}, list_distinct({s.shingles('w')}) as runs from (select {key}, {s.words('source_text')} as w from {table} where source_text is not null) t"""


@query(f"""with a as ({_runs_sql('train', 'posting_id')}), b as ({_runs_sql('heldout', 'posting_id, split')}), x as (select row_number() over () as i, runs from (select distinct runs from a)),
y as (select row_number() over () as j, runs from (select distinct runs from b)), p as (select i, j, count(*) as k from (select i, unnest(runs) as run from x) u join (select j, unnest(runs) as run from y) v using (run) group by 1, 2),
l as (select distinct j from p join x using (i) join y using (j) where k / (len(x.runs) + len(y.runs) - k) >= 0.6)
select split, count(*) as n_records, count(j) as n_near from b left join (select runs, j from l join y using (j)) q using (runs) group by 1""")
def leakage_probe(spark, d):
    """Per evaluation split its rows and those with a near copy (0.6) in the training rows."""
    held = table(spark, d, "heldout").filter("source_text is not null")
    near = dedup.near_copies_across(table(spark, d, "train"), held, "posting_id", "source_text")
    return held.join(near.withColumnRenamed("id", "posting_id"), "posting_id", "left").groupBy("split").agg(F.count("*").alias("n_records"), F.count("similarity").alias("n_near"))


# ---- orders, quotas, splits ---------------------------------------------------------------------


@query(f"select doc_id, {s.bucket('doc_id')} as bucket, md5('7|' || doc_id) as shuffle_key from documents")
def stable_buckets(spark, d):
    return table(spark, d, "documents").select("doc_id", sampling.stable_bucket(F.col("doc_id")).alias("bucket"), sampling.hash_order(F.col("doc_id"), "7").alias("shuffle_key"))


@query("select doc_id, title from documents order by added_at, doc_id limit 100")
def first_rows(spark, d):
    """The first rows before any filter, as a top-n."""
    return sampling.prefix(table(spark, d, "documents").select("doc_id", "title", "added_at"), ["added_at", "doc_id"], 100).select("doc_id", "title")


_SHARES = {"salary": 0.40, "plain": 0.538, "deadline": 0.024, "salary+deadline": 0.038}


@query(f"""with t as (select row_id, {s.stratum('text')} as stratum from raw_postings where text is not null),
o as (select *, md5('0|' || row_id) as o, row_number() over (partition by stratum order by md5('0|' || row_id)) as rn from t),
c as (select *, case stratum {" ".join(f"when '{k}' then {round(500 * v)}" for k, v in _SHARES.items())} else 0 end as quota from o),
u as (select row_id, stratum, case when rn <= quota then 0 else 1 end as p, o from c)
select row_id, stratum from u order by p, o limit 500""")
def quota_sample(spark, d):
    """500 rows by stratum quotas, made up from what is left."""
    rows = raw(spark, d).filter("text is not null").select("row_id", tx.stratum(F.col("text")).alias("stratum"))
    return sampling.quota_sample(rows, "stratum", _SHARES, 500, "row_id")


@query(f"""with recursive g as (select coalesce(source, 'none') || '/' || coalesce(cast(company_id as varchar), 'none') as k, count(*) as n, bool_and(lang = 'en') as f from documents group by 1),
o as (select k, n, row_number() over (order by not coalesce(f, false), {s.bucket('k')}, k) as i from g),
w as (select 0::bigint as i, 120::bigint as t, 80::bigint as v, '' as k, '' as split
union all select o.i, case when o.n <= w.t then w.t - o.n else w.t end, case when o.n > w.t and o.n <= w.v then w.v - o.n else w.v end, o.k,
case when o.n <= w.t then 'test' when o.n <= w.v then 'val' else 'train' end from w join o on o.i = w.i + 1)
select k, split from w where i > 0""")
def grouped_split(spark, d):
    docs = table(spark, d, "documents")
    key = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce(F.col("company_id").cast("string"), F.lit("none")))
    groups = docs.groupBy(key.alias("k")).agg(F.count("*").alias("n"), F.coalesce(F.bool_and(F.col("lang") == "en"), F.lit(False)).alias("f"))
    return sampling.grouped_split(groups, "k", "n", "f", 120, 80)


@query("""with m as (select posting_id, batch, row_number() over (order by posting_id, batch, labeled_at) as i, status <> 'ok' as minor, count(*) over () as n from train),
r as (select *, row_number() over (partition by minor order by i) as k from m) select posting_id, batch from r where not minor or k <= floor(0.1 * n)""")
def capped_minority(spark, d):
    rows = table(spark, d, "train").select("posting_id", "batch", "status", "labeled_at")
    return sampling.capped_minority(rows, F.col("status") != "ok", F.struct("posting_id", "batch", "labeled_at")).select("posting_id", "batch")


@query("""select posting_id, batch, row_number() over (order by posting_id, batch, labeled_at) as place from train qualify place <= 200""")
def train_cap(spark, d):
    from pyspark.sql import Window

    rows = table(spark, d, "train").orderBy("posting_id", "batch", "labeled_at").limit(200)
    return rows.select("posting_id", "batch", F.row_number().over(Window.orderBy("posting_id", "batch", "labeled_at")).alias("place"))


@query()
def exemplars(spark, d):
    rows = table(spark, d, "train").filter("status = 'ok' and target_json is not null").select("posting_id", "source_text", "target_json")
    parsed = rec.from_json(F.col("target_json"))
    rows = rows.withColumn("n_stated", rec.stated_leaves(parsed)).withColumn("paid", parsed["salary"]["min_amount"].isNotNull())
    return sampling.pick_exemplars(rows, "source_text", "target_json", "n_stated", "paid", 5).select("posting_id", "slot", "place")


@query()
def cost_batches(spark, d):
    return sampling.cost_batches(table(spark, d, "documents"), "doc_id", "text")


@query("""with t as (select doc_id, title, text, list_filter([case when contains(lower(text), 'payroll') then 'payroll' end, case when contains(lower(text), 'pastry') then 'pastry' end,
case when contains(lower(text), 'welding') then 'welding' end], lambda x: x is not null) as tags from documents),
a as (select 'payroll' as picked_for, min(doc_id) as doc_id from t where list_contains(tags, 'payroll')),
b as (select 'pastry' as picked_for, min(doc_id) as doc_id from t where list_contains(tags, 'pastry') and doc_id not in (select doc_id from a)),
c as (select 'welding' as picked_for, min(doc_id) as doc_id from t where list_contains(tags, 'welding') and doc_id not in (select doc_id from a union all select doc_id from b)),
f as (select 'fill' as picked_for, doc_id from t where doc_id not in (select doc_id from a union all select doc_id from b union all select doc_id from c) order by doc_id limit 7)
select doc_id, picked_for from a union all select doc_id, picked_for from b union all select doc_id, picked_for from c union all select doc_id, picked_for from f""")
def one_per_category(spark, d):
    tags = F.filter(F.array(*[F.when(F.contains(F.lower("text"), F.lit(w)), F.lit(w)) for w in ("payroll", "pastry", "welding")]), lambda x: x.isNotNull())
    rows = table(spark, d, "documents").select("doc_id", tags.alias("tags"))
    return sampling.one_per_category(rows, "tags", ["payroll", "pastry", "welding"], ["doc_id"], 10).select("doc_id", "picked_for")
