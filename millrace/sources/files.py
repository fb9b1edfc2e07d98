"""Sources and sinks: splits, logs, runs, caches, manifests, options."""
from __future__ import annotations

import hashlib
import json
import os
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSON-lines table with a given schema; blank lines are skipped, a missing path is an error."""
    return spark.read.schema(schema).json(path)


def read_examples(spark: SparkSession, path: str, schema: T.StructType | str, k: int) -> DataFrame:
    """The first k rows of a JSON array file; none for k <= 0."""
    return spark.read.schema(schema).option("multiLine", True).json(path).limit(max(k, 0))


def logged_ids(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The different keys of a JSON-lines log; torn lines and lines without the key are left out."""
    rows = spark.read.schema(f"`{key}` string, _torn string").option("columnNameOfCorruptRecord", "_torn").json(path)
    return rows.filter(F.col("_torn").isNull() & F.col(key).isNotNull()).select(key).distinct()


def last_wins(df: DataFrame, key: str, order: Column) -> DataFrame:
    """The row of greatest order of each key, pre-aggregated before the shuffle."""
    names = df.columns
    picked = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*names), order).alias("_row"))
    return picked.select(*[F.col("_row")[n].alias(n) for n in names])


def merge_inputs(bulk: list[DataFrame], gold: list[DataFrame], key: str, order: str) -> DataFrame:
    """All inputs with later ones overriding earlier ones by key, gold ones after all others; `is_gold` tells which."""
    rows = None
    for rank, (df, is_gold) in enumerate([*((d, False) for d in bulk), *((d, True) for d in gold)]):
        part = df.withColumn("is_gold", F.lit(is_gold)).withColumn("_rank", F.lit(rank))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    return last_wins(rows, key, F.struct("_rank", order)).drop("_rank")


def cache_key(model: Column, temperature: Column, sample: Column, prompt: Column) -> Column:
    """SHA-1 of model|temperature (2 decimals)|sample|prompt."""
    return F.sha1(F.concat_ws("|", model, F.format_string("%.2f", temperature), sample.cast("string"), prompt))


def answered(prompts: DataFrame, cache: DataFrame, key: str, order: Column, value: str) -> DataFrame:
    """`prompts` with the `value` that the cache holds for their key, the last one written by `order`; null where it has none."""
    last = cache.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(value, order).alias(value))
    return prompts.drop(value).join(last, key, "left")


def append_new(new: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key the Parquet log doesn't have; returns how many were appended, counted while they are written."""
    spark = new.sparkSession
    appended = Observation()
    try:
        old = spark.read.parquet(path).select(key)
        new = new.join(old, key, "left_anti")
    except Exception as e:  # noqa: BLE001 - an absent log is an empty one, anything else is an error
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new.dropDuplicates([key]).observe(appended, F.count("*").alias("n")).write.mode("append").parquet(path)
    return appended.get["n"]


def build_cached(spark: SparkSession, folder: str, arguments: dict, build, version: int = 1) -> DataFrame:
    """The Parquet table of these arguments, built once: named by a hash of all arguments, complete once _SUCCESS is there."""
    text = json.dumps({"version": version, **arguments}, sort_keys=True, default=str)
    path = f"{folder}/{hashlib.sha1(text.encode()).hexdigest()[:16]}"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_splits(df: DataFrame, path: str, split: str = "split", form: str = "json") -> None:
    """One folder per split; nulls are written out in JSON."""
    writer = df.write.mode("overwrite").partitionBy(split)
    (writer.option("ignoreNullFields", False).json if form == "json" else writer.parquet)(path)


def read_split(spark: SparkSession, path: str, split: str, first: int | None = None, order: str | None = None) -> DataFrame:
    """One split of a Parquet table (only its folder is read), or its first rows by `order`."""
    rows = spark.read.parquet(path).filter(F.col("split") == split)
    return rows if first is None else rows.orderBy(order).limit(first)


def write_manifest(df: DataFrame, key: str, path: str) -> None:
    """The keys, sorted, one a line in one file; for manifests of held-out sets, which are small."""
    df.select(F.col(key).cast("string")).orderBy(key).coalesce(1).write.mode("overwrite").text(path)


RUN_TABLES = ("runs", "per_example", "metrics")


def write_run(folder: str, label: str, config: dict, metrics: DataFrame, per_example: DataFrame) -> None:
    """A run as three tables: its settings, its pairs, its metrics (metric, value)."""
    spark = metrics.sparkSession
    spark.createDataFrame([(label, json.dumps(config, sort_keys=True))], "label string, config string").write.mode("overwrite").parquet(f"{folder}/runs")
    per_example.withColumn("label", F.lit(label)).write.mode("overwrite").parquet(f"{folder}/per_example")
    metrics.withColumn("label", F.lit(label)).write.mode("overwrite").parquet(f"{folder}/metrics")


def load_run(spark: SparkSession, spec: str) -> tuple[str, dict[str, DataFrame]]:
    """LABEL=FOLDER, cut at the last '='; an empty label or a missing folder is an error."""
    label, eq, folder = spec.rpartition("=")
    if not eq or not label.strip():
        raise ValueError(f"not LABEL=FOLDER: {spec!r}")
    if "://" not in folder and not os.path.isdir(folder):
        raise FileNotFoundError(folder)
    return label, {t: spark.read.parquet(f"{folder}/{t}") for t in RUN_TABLES}


def rehydrate(tables: dict[str, DataFrame], key: str, raw: str, gold: str) -> DataFrame:
    """The pairs of a stored run with both sides parsed again: key, gold and pred records (null where unparsed)."""
    from ..functions import jsonx
    from ..functions import records as rec

    rows = tables["per_example"].select(key, jsonx.parse_record()(F.col(gold)).alias("_g"), jsonx.parse_record()(F.col(raw)).alias("_p"))
    return rows.select(key, rec.from_json(F.col("_g.record_json")).alias("gold"), rec.from_json(F.col("_p.record_json")).alias("pred"))


def with_sidecar(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """`df` with values of a small JSON file beside a model, as text; null where the file or a key is missing."""
    found = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
    return df.select("*", *[F.lit(None if found.get(k) is None else str(found[k])).alias(k) for k in keys])


def load_settings(path: str, environment: dict[str, str] | None = None) -> dict[str, str]:
    """KEY=VALUE lines without comments and quotes; the environment wins; placeholders count as not set."""
    out: dict[str, str] = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            for line in f:
                key, eq, value = line.strip().partition("=")
                if eq and not key.startswith("#"):
                    out[key.removeprefix("export ").strip()] = value.strip().strip("'\"")
    out |= {k: v for k, v in (os.environ if environment is None else environment).items() if k in out or environment is not None}
    return {k: v for k, v in out.items() if v and not v.startswith(("PASTE_", "SET_", "your-", "<"))}


def whole_number(settings: dict[str, str], key: str, default: int) -> int:
    value = settings.get(key)
    if value is None:
        return default
    try:
        return int(value)
    except ValueError:
        raise ValueError(f"{key} must be a whole number, not {value!r}") from None


def resolve(flag: str | None, setting: str | None, default: str) -> str:
    """Flag before setting before default; an empty one counts as not given."""
    return flag or setting or default


@dataclass
class Options:
    """Base of typed options read from JSON: keys beginning with '_' are comments, unknown keys are errors."""

    @classmethod
    def from_json(cls, path: str):
        with open(path, encoding="utf-8") as f:
            given = {k: v for k, v in json.load(f).items() if not k.startswith("_")}
        unknown = set(given) - {x.name for x in fields(cls)}
        if unknown:
            raise ValueError(f"unknown options: {sorted(unknown)}")
        return cls(**given)


def report(title: str, tables: dict[str, DataFrame], notes: dict[str, str] | None = None) -> str:
    """Several small results, each with its heading and note, as one Markdown text."""
    notes = notes or {}
    parts = [markdown(df, heading) + (f"\n{notes[heading]}\n" if heading in notes else "") for heading, df in tables.items()]
    return "\n".join([f"# {title}\n", *parts])


def markdown(df: DataFrame, title: str, most: int = 1000) -> str:
    """A small result as a Markdown table; refuses over `most` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("a report must be small; aggregate first")
    show = lambda v: "" if v is None else (f"{v:.4f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v))
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(show(v).replace("|", "\\|") for v in r) + " |" for r in rows)]) + "\n"
