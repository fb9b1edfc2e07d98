"""Records held against metadata that comes from elsewhere: one row per field with its agreement."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import records as rec

# The metadata's terms and the record's.
WORK_TYPES = {"full-time": "full_time", "part-time": "part_time", "contract": "contract", "internship": "internship", "temporary": "temporary", "volunteer": "volunteer"}
LEVELS = {"internship": "intern", "entry level": "entry", "associate": "mid", "mid-senior level": "senior", "director": "lead", "executive": "executive"}
PERIODS = {"HOURLY": "hourly", "WEEKLY": "weekly", "MONTHLY": "monthly", "YEARLY": "yearly"}
TOLERANCE = 0.05
FIELDS = ("job_title", "location.city", "location.region", "location.remote_policy", "employment_type", "seniority_level", "salary.min_amount", "salary.max_amount", "salary.currency", "salary.period")


def _mapped(entries: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in entries.items() for x in kv]), key)


def _filled(value: Column) -> Column:
    return value.isNotNull() & (value != "")


def checks(record: Column | None, meta: dict[str, Column]) -> dict[str, tuple[Column, Column]]:
    """Field -> (can it be compared, does it agree). Compared only where both sides state something; a metadata amount that
    isn't a number can't be compared. Titles agree by containment or two shared words, levels by at most one step."""
    at = lambda path: rec.leaf(record, path)
    title, theirs = F.lower(at("job_title")), F.lower(meta["title"])
    shared = F.size(F.array_intersect(F.filter(F.split(title, r"\s+"), lambda w: w != ""), F.filter(F.split(theirs, r"\s+"), lambda w: w != "")))
    place = F.lower(meta["location"])
    region = at("location.region")
    name = _mapped(rec.REGION_NAMES, rec.region_code(region))
    order = F.array(*[F.lit(x) for x in rec.MEMBERS["seniority_level"]])
    steps = F.abs(F.array_position(order, at("seniority_level")) - F.array_position(order, _mapped(LEVELS, F.lower(meta["formatted_experience_level"]))))
    out = {
        "job_title": (_filled(title) & _filled(theirs), F.contains(theirs, title) | F.contains(title, theirs) | (shared >= 2)),
        "location.city": (_filled(at("location.city")) & _filled(place), F.contains(place, F.lower(at("location.city")))),
        "location.region": (_filled(region) & _filled(place), F.contains(place, F.lower(region)) | F.coalesce(F.contains(place, F.lower(rec.region_code(region))), F.lit(False)) | F.coalesce(F.contains(place, name), F.lit(False))),
        "location.remote_policy": (at("location.remote_policy").isNotNull() & meta["remote_allowed"].isNotNull(), (meta["remote_allowed"] != 0) == at("location.remote_policy").isin("remote", "hybrid")),
        "employment_type": (at("employment_type").isNotNull() & _filled(meta["formatted_work_type"]), _mapped(WORK_TYPES, F.lower(meta["formatted_work_type"])) == at("employment_type")),
        "seniority_level": (at("seniority_level").isNotNull() & _filled(meta["formatted_experience_level"]), steps <= 1),
        "salary.currency": (_filled(at("salary.currency")) & _filled(meta["currency"]), at("salary.currency") == F.upper(meta["currency"])),
        "salary.period": (_filled(at("salary.period")) & _filled(meta["pay_period"]), _mapped(PERIODS, F.upper(meta["pay_period"])) == at("salary.period")),
    }
    for ours, other in (("salary.min_amount", "min_salary"), ("salary.max_amount", "max_salary")):
        value = meta[other].try_cast("double")
        out[ours] = (at(ours).isNotNull() & value.isNotNull(), F.abs(at(ours) - value) <= F.lit(TOLERANCE) * F.greatest(value, F.lit(1.0)))
    return out


def audit(df: DataFrame, record: Column | None, meta: dict[str, Column]) -> DataFrame:
    """(field, n_compared, n_agree, agreement) of the fields compared at least once, from one aggregate over wide rows."""
    found = checks(record, meta)
    sums = []
    for f in FIELDS:
        can, agrees = (F.coalesce(c, F.lit(False)) for c in found[f])
        sums += [F.count_if(can).alias(f"{f}|n"), F.count_if(can & agrees).alias(f"{f}|a")]
    wide = df.agg(*sums)
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}|n`").alias("n_compared"), F.col(f"`{f}|a`").alias("n_agree")) for f in FIELDS])).alias("r")
    return wide.select(rows).select("r.*").filter("n_compared > 0").withColumn("agreement", F.round(F.col("n_agree") / F.col("n_compared"), 4))
