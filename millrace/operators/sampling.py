"""Orders, quotas, splits and packing that give the same result in every run."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import durable
from .order import running

BUCKETS = 10_000
CELLS = 4096


def hash_order(key: Column, seed: str = "0") -> Column:
    """A shuffled order that depends on the key and the seed only."""
    return F.md5(F.concat_ws("|", F.lit(seed), key.cast("string")))


def stable_bucket(key: Column, buckets: int = BUCKETS) -> Column:
    """First eight hex digits of the MD5 of the key, modulo `buckets`."""
    return (F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint") % buckets).cast("int")


def prefix(df: DataFrame, order: list, n: int) -> DataFrame:
    """The first n rows of a total order, as a top-n (no full sort)."""
    return df.orderBy(*order).limit(n)


def first_of_group(df: DataFrame, group: list[str], order: Column, quota: Column) -> DataFrame:
    """Of each group the first `quota` rows by `order` (a hash order: hex text).

    The rank of a row is counted by cells of the order's first three digits: a histogram gives the rows in
    earlier cells, and a window ranks within one cell only, so that a hot group is ranked by many tasks.
    """
    cell = F.conv(F.substring(order, 1, 3), 16, 10).cast("int")
    keyed = df.withColumn("_order", order).withColumn("_cell", cell)
    counts = keyed.groupBy(*group, "_cell").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    ranked = keyed.join(before, [*group, "_cell"]).withColumn("_rank", F.col("_before") + F.row_number().over(Window.partitionBy(*group, "_cell").orderBy("_order")))
    return ranked.filter(F.col("_rank") <= quota).drop("_order", "_cell", "_before", "_rank")


def quota_sample(df: DataFrame, stratum: str, shares: dict[str, float], n: int, id_col: str, seed: str = "0") -> DataFrame:
    """n rows: of each stratum the first round(n x share) (half to even) in hash order, then the next of all to make up n."""
    quota = F.coalesce(*[F.when(F.col(stratum) == s, F.lit(round(n * share))) for s, share in shares.items()], F.lit(0))
    order = hash_order(F.col(id_col), seed)
    keys = durable(df.select(id_col, stratum))
    chosen = durable(first_of_group(keys, [stratum], order, quota).select(id_col))
    got = chosen.count()
    if got > n:  # the rounded quotas are over n together
        picked = first_of_group(chosen, [], order, F.lit(n))
    else:
        picked = chosen.unionByName(first_of_group(keys.join(chosen, id_col, "left_anti").select(id_col), [], order, F.lit(n - got)))
    return df.join(picked, id_col, "left_semi")


def grouped_split(groups: DataFrame, key: str, size: str, first: str, n_test: int, n_val: int, horizon: int = 100_000) -> DataFrame:
    """(key, split): whole groups in order (`first` true before false, bucket, key); one goes to test if it fits what is
    left there, else to val if it fits there, else to train.

    A group that doesn't fit is skipped, not split, so that a running sum alone can't tell. But as long as the running sum
    stays under the quota by the largest group, every group fits: that bulk is cut off by one place in the order. Only the
    groups about the end of each quota are folded one by one, `horizon` of them at a time.
    """
    most = max(n_test, n_val)
    small = groups.filter(F.col(size) <= most).select(F.struct((~F.col(first)).alias("late"), stable_bucket(F.col(key)).alias("bucket"), F.col(key).cast("string").alias("key")).alias("g"), F.col(size).cast("bigint").alias("n"))
    small = durable(small)
    largest = small.agg(F.max("n")).first()[0] or 0
    left = {"test": n_test, "val": n_val}
    placed: list[tuple[str, str]] = []
    spans: list[tuple[str, tuple | None, tuple]] = []  # split, after this place, up to this place

    def place(g) -> Column:
        return F.struct(F.lit(g[0]).alias("late"), F.lit(g[1]).alias("bucket"), F.lit(g[2]).alias("key"))

    def beyond(at) -> DataFrame:
        return small if at is None else small.filter(F.col("g") > place(at))

    last = None
    for split in ("test", "val"):
        room = left[split] - largest
        if room > 0:
            sums = running(beyond(last), ["g"], F.col("n"))
            end = sums.filter(F.col("before") + F.col("n") <= room).agg(F.max("g").alias("g"), F.max(F.col("before") + F.col("n")).alias("sum")).first()
            if end["g"] is not None:
                spans.append((split, last, tuple(end["g"])))
                left[split] -= end["sum"]
                last = tuple(end["g"])
        while left[split] > 0:
            rows = beyond(last).filter(F.col("n") <= max(left.values())).orderBy("g").limit(horizon).collect()
            for r in rows:
                if left[split] <= 0:
                    break
                last = tuple(r["g"])
                for s in ("test", "val"):
                    if r["n"] <= left[s]:
                        left[s] -= r["n"]
                        placed.append((r["g"]["key"], s))
                        break
            if len(rows) < horizon:
                break
    g = F.struct((~F.col(first)).alias("late"), stable_bucket(F.col(key)).alias("bucket"), F.col(key).cast("string").alias("key"))
    bulk = F.lit(None).cast("string")
    for split, after, upto in spans:
        inside = (g <= place(upto)) & (F.col(size) <= most)
        bulk = F.when(inside if after is None else inside & (g > place(after)), F.lit(split)).otherwise(bulk)
    held = groups.sparkSession.createDataFrame(placed, "_key string, split string")
    return groups.join(held, F.col(key).cast("string") == F.col("_key"), "left").select(key, F.coalesce("split", bulk, F.lit("train")).alias("split"))


def capped_minority(df: DataFrame, minority: Column, order: Column, share: float = 0.10) -> DataFrame:
    """All other rows, and of the minority the first int(share x all rows) in order; a null `minority` is none.

    The place of the cut comes from running counts over ranges of the order, so that no task holds the
    whole minority. Rows equal in the order are told apart by a hash of all their columns.
    """
    marked = df.withColumn("_minor", F.coalesce(minority, F.lit(False)))
    cap = marked.agg(F.floor(F.lit(share) * F.count("*"))).first()[0] or 0
    rows = marked.filter("_minor").withColumn("_order", order).withColumn("_tie", F.xxhash64(*df.columns))
    few = running(rows, ["_order", "_tie"], out="_place").filter(F.col("_place") < int(cap)).select(*df.columns)
    return marked.filter(~F.col("_minor")).select(*df.columns).unionByName(few)


def one_per_category(df: DataFrame, tags: str, categories: list[str], order: list, n: int) -> DataFrame:
    """For each category in turn the first row with that tag not taken yet, then the next rows, n in all, with a `picked_for` column.

    Each of the first places is among the first `len(categories)` rows of its tag, so that only those go to the driver.
    """
    ranked = None
    wanted = len(categories) + n
    for c in categories:
        rows = df.filter(F.array_contains(tags, c)).orderBy(*order).limit(len(categories)).withColumn("_for", F.lit(c))
        ranked = rows if ranked is None else ranked.unionByName(rows)
    rest = df.orderBy(*order).limit(wanted).withColumn("_for", F.lit(None).cast("string"))
    ranked = rest if ranked is None else ranked.unionByName(rest)
    rows = ranked.orderBy(*order).collect()
    taken, out = set(), []
    for c in [*categories, None]:
        for r in rows:
            key = tuple(str(x) for x in r[:-1])
            if r["_for"] != c or key in taken or len(out) >= n:
                continue
            taken.add(key)
            out.append((*r[:-1], c or "fill"))
            if c is not None:
                break
    return df.sparkSession.createDataFrame(out, df.withColumn("picked_for", F.lit("")).schema)


def pick_exemplars(df: DataFrame, text: str, target: str, stated: str, paid: str, k: int, low: int = 800, high: int = 2500) -> DataFrame:
    """Up to k example rows of middling length, shortest first: one with pay, a rich one (10 or more stated leaves), a sparse
    one (5 or fewer), each row filling one slot; then the next of the pool. Adds `slot`."""
    pool = df.filter(F.length(text).between(low, high)).withColumn("_size", F.struct(F.length(text), F.length(target)))
    kinds = {"paid": F.col(paid), "sparse": F.col(stated) <= 5, "rich": F.col(stated) >= 10}
    taken: dict[str, tuple] = {}
    rows = None
    for cond in (*kinds.values(), F.lit(True)):
        part = pool.filter(cond).orderBy("_size", *df.columns[:1]).limit(max(k, 3) + 3)
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.withColumn("_kinds", F.array(*[F.when(c, F.lit(n)) for n, c in kinds.items()]))
    seen = sorted({tuple(map(str, r)): r for r in rows.collect()}.values(), key=lambda r: (tuple(r["_size"]), r[0]))
    used = set()
    for i, r in enumerate(seen):
        for name in kinds:
            if name not in taken and name in r["_kinds"]:
                taken[name] = (i, r)
                used.add(i)
                break
    slots = [(name, taken[name][1]) for name in ("paid", "rich", "sparse") if name in taken]
    slots += [("pool", r) for i, r in enumerate(seen) if i not in used]
    names = df.columns
    schema = df.withColumn("slot", F.lit("")).withColumn("place", F.lit(0)).schema
    return df.sparkSession.createDataFrame([(*[r[n] for n in names], s, i) for i, (s, r) in enumerate(slots[:k])], schema)


def cost_batches(df: DataFrame, id_col: str, text: str, budget: float = 8000.0, overhead: float = 400.0, per_token: float = 4.0, most: int = 16, parts: int = 64) -> DataFrame:
    """(id, batch, place): texts grouped by length so that count x (longest / 4 + 400) stays within the budget; one alone always goes.

    Texts are range-partitioned by length; each partition is packed greedily from the shortest, so that the
    packing runs in parallel and at most one batch a partition is left part-filled.
    """
    from collections.abc import Iterator

    import pandas as pd

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = count = 0
        for pdf in batches:
            ids, lengths, part = [], pdf["n"].tolist(), int(pdf["part"].iloc[0]) if len(pdf) else 0
            for n in lengths:
                if count and (count >= most or (count + 1) * (n / per_token + overhead) > budget):
                    number, count = number + 1, 0
                ids.append((f"{part}-{number}", count))
                count += 1
            yield pd.DataFrame({"id": pdf["id"], "batch": [b for b, _ in ids], "place": [p for _, p in ids], "n_chars": lengths})

    kind = df.select(id_col).schema[0].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.length(text), F.lit(0)).alias("n"))
    sized = rows.repartitionByRange(parts, "n", "id").withColumn("part", F.spark_partition_id()).sortWithinPartitions("n", "id")
    return sized.mapInPandas(pack, f"id {kind}, batch string, place int, n_chars int")
