"""Samples: category proportions, and reproducible samples that stay as data grow."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import durable
from .hashing import draw

CELLS = 4096


def category(column: Column, parts: tuple[str, ...], other: str) -> Column:
    """Spellings of combined categories brought to 'a+b' in the order of `parts`: case, spaces, order and separators don't
    matter. `other` is the category of none of the parts, which has to be named as well; null if nothing known is named."""
    text = F.lower(F.coalesce(column, F.lit("")))
    named = F.array_join(F.filter(F.array(*[F.when(text.contains(p), F.lit(p)) for p in parts]), lambda x: x.isNotNull()), "+")
    return F.when(named != "", named).when(F.trim(text) == other, F.lit(other))


def _first_by_draw(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows (id, grp, stratum, u, cell) with the `wanted` smallest draws of each (grp, stratum), exactly.

    A histogram of the draws finds the cell in which the wanted count is reached; all rows of the cells
    before it are taken, and only that cell's rows are ranked, so that no stratum is gathered in one task.
    """
    cells = rows.groupBy("grp", "stratum", "cell").agg(F.count("*").alias("n")).join(wanted, ["grp", "stratum"])
    ordered = cells.groupBy("grp", "stratum", "wanted").agg(F.sort_array(F.collect_list(F.struct("cell", "n"))).alias("cells"))
    # once the cut cell is found, later cells are left alone
    cut = F.aggregate("cells", F.struct(F.lit(0).cast("long").alias("before"), F.lit(-1).alias("cell")),
                      lambda s, c: F.when((s["cell"] < 0) & (s["before"] + c["n"] <= F.col("wanted")),
                                          F.struct((s["before"] + c["n"]).alias("before"), s["cell"].alias("cell")))
                      .when(s["cell"] < 0, F.struct(s["before"].alias("before"), c["cell"].alias("cell"))).otherwise(s))
    cutoff = ordered.withColumn("cut", cut).select("grp", "stratum", "wanted", F.col("cut.before").alias("before"), F.col("cut.cell").alias("cut_cell"))
    marked = rows.join(cutoff, ["grp", "stratum"]).filter((F.col("cut_cell") < 0) | (F.col("cell") <= F.col("cut_cell")))
    sure = marked.filter((F.col("cut_cell") < 0) | (F.col("cell") < F.col("cut_cell")))
    edge = (marked.filter(F.col("cell") == F.col("cut_cell"))
            .withColumn("rank", F.row_number().over(Window.partitionBy("grp", "stratum").orderBy("u", "id")))
            .filter(F.col("rank") <= F.col("wanted") - F.col("before")).drop("rank"))
    return sure.unionByName(edge).select(*rows.columns)


def stratified_sample(rows: DataFrame, targets: DataFrame, *, id_col: str, group: str, stratum: str, seed: str = "s") -> tuple[DataFrame, DataFrame]:
    """(sample, report) with target proportions of each stratum within a group.

    `rows` has one row for each identifier. `targets` has (group, stratum, share, sample_share, min_rows).
    Wanted of a stratum is the larger of min_rows and share x sample_share x the group's identifiers.
    Each identifier is accepted independently, by a fixed draw, with its stratum's acceptance probability
    (wanted to observed, slightly raised). The count is then made exact: the accepted with the smallest
    draws are kept, and a stratum in which too few were accepted is topped up by the next draws. A
    stratum with too few identifiers is taken whole and reported with its deficit: what the sample lacks
    of the wanted number. Rows with a null group or stratum are in no stratum but count in the group's size. Ties of
    draws go to the smaller identifier. An empty table gives an empty sample and a full report.
    """
    base = rows.select(F.col(id_col).alias("id"), F.col(group).alias("grp"), F.col(stratum).alias("stratum")).filter(F.col("id").isNotNull())
    counts = durable(base.groupBy("grp", "stratum").agg(F.count("*").alias("n")))
    sizes = counts.groupBy("grp").agg(F.sum("n").alias("group_size"))
    found = counts.select("grp", "stratum", F.col("n").alias("available"))
    wanted = targets.select(F.col(group).alias("grp"), F.col(stratum).alias("stratum"), "share", "sample_share", "min_rows")
    plan = (wanted.join(sizes, "grp", "left").join(found, ["grp", "stratum"], "left").na.fill(0, ["group_size", "available"])
            .withColumn("needed", F.greatest(F.col("min_rows").cast("double"), F.col("share") * F.col("sample_share") * F.col("group_size")))
            .withColumn("n_target", F.ceil(F.col("needed") - 1e-9))
            .withColumn("accept", F.when(F.col("available") > 0, F.least(F.lit(1.0), (F.col("n_target") + 2 * F.sqrt("n_target") + 2) / F.col("available"))).otherwise(0.0)))
    drawn = base.join(plan.select("grp", "stratum", "accept"), ["grp", "stratum"]).withColumn("u", draw(F.lit(seed), F.col("id"))).withColumn("cell", F.floor(F.col("u") * CELLS).cast("int"))
    accepted = durable(drawn.filter(F.col("u") < F.col("accept")).drop("accept"))
    first = _first_by_draw(accepted, plan.select("grp", "stratum", F.col("n_target").alias("wanted"))).withColumn("topped_up", F.lit(False))
    taken = accepted.groupBy("grp", "stratum").agg(F.count("*").alias("n_accepted"))
    short = (plan.join(taken, ["grp", "stratum"], "left").na.fill(0, ["n_accepted"]).filter(F.least("n_target", "available") > F.col("n_accepted"))
             .select("grp", "stratum", (F.col("n_target") - F.col("n_accepted")).alias("wanted")))
    short = durable(short)
    others = drawn.filter(F.col("u") >= F.col("accept")).drop("accept").join(short.select("grp", "stratum"), ["grp", "stratum"], "left_semi")
    sample = durable(first.unionByName(_first_by_draw(others, short).withColumn("topped_up", F.lit(True))).select("id", F.col("grp").alias(group), "stratum", "topped_up"))
    in_sample = sample.groupBy(F.col(group).alias("grp"), "stratum").agg(F.count("*").alias("n_sample"))
    report = (plan.join(in_sample, ["grp", "stratum"], "left").na.fill(0, ["n_sample"])
              .select(F.col("grp").alias(group), "stratum", "needed", "available", "n_sample", F.col("accept").alias("acceptance"),
                      (F.col("n_sample") < F.col("needed")).alias("unmet"),
                      F.greatest(F.lit(0.0), F.col("needed") - F.col("n_sample")).alias("deficit")))
    return sample, report


def consistent_sample(rows: DataFrame, id_col: str, rate: float, weight: Column | None = None, store: DataFrame | None = None) -> DataFrame:
    """(id, weight, selected): consistent weighted Poisson sampling of identifiers.

    An identifier is selected when its draw is under rate x weight. `store` is an earlier result: the
    running maximum of the weights is kept, so that the inclusion probability of an identifier never
    falls and one selected stays selected when rows come, whatever the partitioning. All rows of an
    identifier share its fate. Null identifiers are in no sample; null or negative weights count as 0;
    an empty table gives what the store holds.
    """
    w = F.greatest(F.coalesce(weight if weight is not None else F.lit(1.0), F.lit(0.0)).cast("double"), F.lit(0.0))
    now = rows.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), w.alias("weight"))
    if store is not None:
        now = now.unionByName(store.select("id", "weight"))
    return (now.groupBy("id").agg(F.max("weight").alias("weight"))
            .withColumn("selected", draw(F.col("id")) < F.col("weight") * F.lit(float(rate))))
