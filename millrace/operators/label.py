"""From the raw outputs of several samples to one label per item, with a status for each item that got none.

parse -> vote -> validate -> agreement of the hard fields -> grounding in the source. Nothing is dropped:
each item comes out once, and the first step that it fails gives its status.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import jsonx
from ..functions import records as rec
from ..functions import text as tx
from . import vote

def extraction(df: DataFrame, id_col: str, text: str, output: str) -> DataFrame:
    """(id, status, record_json, n_filled, ungrounded, read_chars): what an extraction shows for each row.

    status is empty_input for a blank text, else why the output isn't a record (no_json, json_decode_error,
    schema_error), else ok. n_filled counts the top-level fields that state something, parts always; read_chars is
    the length of the truncated text where it was cut, else null.
    """
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("_text"), jsonx.parse_record()(F.col(output)).alias("_p")).withColumn("_r", rec.from_json(F.col("_p.record_json")))
    filled = F.lit(0)
    for name in rec.SCHEMA.names:
        value = F.col("_r")[name]
        filled = filled + (value.isNotNull() & (F.size(value) > 0) if name in rec.LIST_CAPS else value.isNotNull()).cast("int")
    status = F.when(tx.strip(F.col("_text")) == "", "empty_input").otherwise(F.coalesce("_p.error_kind", F.lit("ok")))
    cut = F.length(tx.truncate_source(F.col("_text")))
    shown = rows.withColumn("status", status)
    ok = F.col("status") == "ok"
    return shown.select("id", "status", F.when(ok, F.col("_p.record_json")).alias("record_json"), F.when(ok, filled).alias("n_filled"),
                        F.when(ok, rec.ungrounded(F.col("_r"), F.col("_text"))).alias("ungrounded"), F.when(F.length("_text") > cut, cut).alias("read_chars"))


STATUSES = ("ok", "parse_failed", "vote_failed", "low_agreement", "ungrounded", "api_failed")


def label(samples: DataFrame, sources: DataFrame, *, id_col: str = "id", sample: str = "sample_idx", raw: str = "output", text: str = "text", error: str | None = None, voted: bool = True) -> DataFrame:
    """(id, status, record, agreement, ungrounded, n_parsed): one row for each id of `sources`, which has one row per id.

    `samples` has a row per id and sample with the raw output and, in `error`, why a call failed. An id
    with a failed call or without any sample is api_failed; one without a readable sample parse_failed;
    one whose voted record breaks the schema vote_failed; one whose hard fields agree too little
    low_agreement; one with leaves that the text doesn't support ungrounded. `record` is null unless the
    status is ok. Without `voted` the first readable sample is taken. A null text supports nothing.
    """
    rows = samples.select(F.col(id_col).alias("id"), F.col(sample).alias("sample"), (F.col(error).isNotNull() if error else F.lit(False)).alias("failed"),
                          rec.from_json(jsonx.parse_record()(F.col(raw))["record_json"]).alias("record"))
    calls = rows.groupBy("id").agg(F.bool_or("failed").alias("failed"), F.count("record").alias("n_parsed"))
    read = rows.filter(F.col("record").isNotNull())
    if voted:
        one = vote.vote_records(read, "id", "sample", F.col("record")).select("id", "record", "agreement", F.col("status").alias("voted"))
    else:
        one = read.groupBy("id").agg(F.min_by("record", "sample").alias("record")).select("id", "record", F.lit(None).cast("map<string,double>").alias("agreement"), F.lit("ok").alias("voted"))
    texts = sources.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    joined = texts.join(calls, "id", "left").join(one, "id", "left")
    bad = F.when(F.col("voted") == "ok", rec.ungrounded(F.col("record"), F.col("_text"))).otherwise(F.array().cast("array<string>"))
    joined = joined.withColumn("ungrounded", bad)
    status = (F.when(F.col("failed") | F.col("failed").isNull(), "api_failed").when(F.col("n_parsed") == 0, "parse_failed").when(F.col("voted") != "ok", F.col("voted"))
              .when(F.size("ungrounded") > 0, "ungrounded").otherwise("ok"))
    return joined.select("id", status.alias("status"), "record", "agreement", "ungrounded", F.coalesce("n_parsed", F.lit(0)).alias("n_parsed")).withColumn(
        "record", F.when(F.col("status") == "ok", F.col("record")))
