"""Incremental processing with Structured Streaming: only new rows are worked on, each once."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream; `files_per_batch` is the rate budget."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def resume(stream: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, ts: str | None = None, lateness: str | None = None):
    """Work off what has come since the last call and append it to Parquet.

    Offsets in the checkpoint make a batch run again after a failure; its rows go to a folder named by the
    batch, which is overwritten, so that nothing is written twice. A key seen before is dropped: with `ts` and
    `lateness` by state that the watermark bounds, for keys that repeat within that time; without them by the
    keys of earlier batches, which are kept as a table and not in memory.
    """
    spark = stream.sparkSession
    keys = f"{checkpoint.rstrip('/')}-keys"
    bounded = ts is not None and lateness is not None
    fresh = stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key]) if bounded else stream

    def write(batch: DataFrame, number: int) -> None:
        rows = batch
        if not bounded:
            rows = batch.dropDuplicates([key])
            seen = [f"{keys}/batch={n}" for n in _numbers(spark, keys, "batch=") if n < number]
            if seen:
                rows = rows.join(spark.read.parquet(*seen).select(key), key, "left_anti")
            rows = rows.persist()
        try:
            work(rows).write.mode("overwrite").parquet(f"{out}/batch={number}")
            if not bounded:
                rows.select(key).write.mode("overwrite").parquet(f"{keys}/batch={number}")
        finally:
            if not bounded:
                rows.unpersist()

    query = fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def _folders(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that a pattern of folder names matches, none if there are none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return [f.getPath().toString() for f in found or []]


def _numbers(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    return sorted(int(p.rsplit(prefix, 1)[1]) for p in _folders(spark, f"{folder}/{prefix}*"))


def window_counts(stream: DataFrame, ts: str, width: str, lateness: str, *by: str) -> DataFrame:
    """Rows per tumbling window; rows later than `lateness` are left out by the watermark."""
    return stream.withWatermark(ts, lateness).groupBy(F.window(ts, width).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *by, "n")


#: Buckets of keys of a table of latest values.
BUCKETS = 64


def latest(stream: DataFrame, key: str, order: Column, out: str, checkpoint: str, buckets: int = BUCKETS):
    """Last value of each key as a table in buckets of keys, read by `latest_rows`.

    A batch rewrites only the buckets that its keys fall into: the newest version of each before this batch,
    merged with the batch, becomes the version of this batch, so that a repeated batch gives the same. Of each
    bucket the version before is kept and older ones are removed.
    """
    spark = stream.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        marked = batch.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).persist()
        touched = sorted(r[0] for r in marked.select("_bucket").distinct().collect())
        versions = {b: [v for v in _numbers(spark, f"{out}/_b={b}", "_v=") if v < number] for b in touched}
        old = [f"{out}/_b={b}/_v={vs[-1]}" for b, vs in versions.items() if vs]
        rows = marked.drop("_bucket")
        if old:
            rows = spark.read.schema(batch.schema).parquet(*old).unionByName(rows)
        names = batch.columns
        picked = rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*names), order).alias("_row")).select(*[F.col("_row")[n].alias(n) for n in names])
        placed = picked.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).withColumn("_v", F.lit(number))
        placed.repartition("_b").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_b", "_v").parquet(out)
        marked.unpersist()
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for b, vs in versions.items():
            for v in vs[:-1]:
                path = jvm.org.apache.hadoop.fs.Path(f"{out}/_b={b}/_v={v}")
                path.getFileSystem(conf).delete(path, True)

    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def latest_rows(spark: SparkSession, out: str) -> DataFrame:
    """The newest version of every bucket of a table that `latest` keeps."""
    newest: dict[str, int] = {}
    for path in _folders(spark, f"{out}/_b=*/_v=*"):
        bucket, _, version = path.rpartition("/_v=")
        newest[bucket] = max(int(version), newest.get(bucket, -1))
    return spark.read.parquet(*[f"{b}/_v={v}" for b, v in sorted(newest.items())])


def progress(query) -> list[dict]:
    """(batch, rows, seconds) of the batches a query has run."""
    return [{"batch": p["batchId"], "rows": p["numInputRows"], "seconds": p["batchDuration"] / 1000} for p in query.recentProgress]
