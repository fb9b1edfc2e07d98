"""Splits that keep related records together.

Records tied by an identifier or an entity form components, found by hash-to-min rounds: every node
sends its neighbours to the smallest node it knows and that node to its neighbours, until nothing
changes. Only minima travel, as two columns of edges; no neighbour list is ever gathered. Records of
one identifier are first folded to their smallest entity, so that the rounds run over the few
entity-entity ties and not over all records. Weighted rendezvous hashing then gives each component its
split.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import durable
from .hashing import draw

# Ways of writing that there is no company.
MISSING = ("", "-", "--", "0", "nan", "none", "null", "nil", "n/a", "na", "#n/a", "unknown", "missing", "?", "tbd")


def entity_number(column: Column) -> Column:
    """The number meant by the ways of writing it: spaces, '#', a prefix ending in ':' or '-', thousands commas,
    leading zeros, a decimal zero, powers of ten. Null for missing values and for anything without a number."""
    text = F.lower(F.regexp_replace(column.cast("string"), "[\\s\\u00a0]+", ""))
    plain = F.regexp_extract(text, "^(?:[a-z_.:/#-]*[:#/_-])?([0-9][0-9,]*)(?:\\.0*)?$", 1)
    power = F.regexp_extract(text, "^([0-9]+(?:\\.[0-9]+)?e[+]?[0-9]{1,2})$", 1)
    number = (F.when(plain != "", F.try_to_number(F.regexp_replace(plain, ",", ""), F.lit("9" * 38)))
              .when(power != "", F.round(power.try_cast("double")).try_cast("decimal(38,0)")))
    number = number.try_cast("bigint")
    return F.when(text.isin(*MISSING) | (number <= 0), None).otherwise(number)


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node of the connected component of each node of an edge table.

    Self-loops and repeated edges change nothing; null ends are ignored; an empty table gives no rows.
    Each round is written to the shared checkpoint folder.
    """
    ends = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    now = durable(ends.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct())

    def state(df):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first())

    known = state(now)
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        # each node tells its smallest to its neighbours and to itself
        sent = both.join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y"))
        kept = least.select("x", F.col("m").alias("y"))
        now = durable(sent.unionByName(kept).select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct())
        after = state(now)
        if after == known:
            break
        known = after
    else:
        raise RuntimeError("the components did not become stable")
    return now.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("component"))


def related_groups(df: DataFrame, id_col: str, entity: Column) -> DataFrame:
    """(id, group_entity, n_rows): for each identifier the smallest entity of its component, null if it has none.

    Rows with one identifier or one entity belong together, and so on through further rows. Rows with
    a null identifier are left out.
    """
    rows = df.select(F.col(id_col).alias("id"), entity.alias("entity")).filter(F.col("id").isNotNull())
    counted = rows.groupBy("id", "entity").agg(F.count("*").alias("n"))
    least = durable(counted.groupBy("id").agg(F.min("entity").alias("least"), F.max("entity").alias("most"), F.sum("n").alias("n_rows")))
    # only identifiers with two or more entities tie entities together
    tied = least.filter(F.col("least") != F.col("most")).select("id", "least")
    labels = components(counted.filter(F.col("entity").isNotNull()).join(tied, "id").select("least", "entity"), "least", "entity")
    return (least.join(labels.withColumnRenamed("node", "least"), "least", "left")
            .select("id", F.coalesce("component", "least").alias("group_entity"), "n_rows"))


def shared_groups(groups: DataFrame) -> DataFrame:
    """(id, group_entity) of the groups with two or more identifiers."""
    many = groups.filter(F.col("group_entity").isNotNull()).groupBy("group_entity").agg(F.count("*").alias("n")).filter("n > 1")
    return groups.join(many, "group_entity").select("id", "group_entity")


def _rendezvous(key: Column, shares: list[tuple[str, float]]) -> Column:
    """The split with the largest -share / ln(draw), i.e. with a chance in proportion to its share."""
    scored = [F.struct((F.lit(-float(w)) / F.log(F.greatest(draw(key, F.lit(s)), F.lit(1e-18)))).alias("score"), F.lit(s).alias("split")) for s, w in shares if w > 0]
    return (F.greatest(*scored) if len(scored) > 1 else scored[0])["split"]


def assign_splits(groups: DataFrame, shares: list[tuple[str, float]], giant: float = 0.005, earlier: DataFrame | None = None) -> DataFrame:
    """(id, split): each group as a whole in one split, in about the given shares of all rows.

    Weighted rendezvous hashing assigns by the group's key. Only groups of over `giant` of all rows, of
    which there are fewer than 1 / giant, are placed beforehand, the largest first, each where most is
    left; what then remains of each share weighs the hashing. As these weights follow the giants, groups
    may move when giants grow: as few as weighted rendezvous allows. `earlier` is a former result
    (id, split); a group with an identifier in it keeps that split (the commonest, if groups have
    merged), and only new groups are assigned. Shares are met to about sqrt(share x giant) at the worst,
    and far better where groups are small. An empty table gives no rows.
    """
    shares = sorted((s, float(w)) for s, w in shares if w and w > 0)
    total_share = sum(w for _, w in shares)
    key = F.coalesce(F.concat(F.lit("e"), F.col("group_entity").cast("string")), F.concat(F.lit("i"), F.col("id").cast("string")))
    keyed = groups.withColumn("group_key", key)
    sizes = keyed.groupBy("group_key").agg(F.sum("n_rows").alias("n"))
    kept = None
    if earlier is not None:
        votes = keyed.join(earlier.select("id", F.col("split").alias("kept")), "id").groupBy("group_key", "kept").agg(F.sum("n_rows").alias("n"))
        kept = votes.groupBy("group_key").agg(F.max_by("kept", F.struct("n", "kept")).alias("kept"))
        sizes = sizes.join(kept, "group_key", "left")
    else:
        sizes = sizes.withColumn("kept", F.lit(None).cast("string"))
    sizes = durable(sizes)
    held = {r.kept: r.n for r in sizes.groupBy("kept").agg(F.sum("n").alias("n")).collect()}
    total = sum(held.values())
    giants = sizes.filter(F.col("kept").isNull() & (F.col("n") > max(1.0, giant * total))).orderBy(F.desc("n"), "group_key").limit(int(1 / giant) + 1).collect()
    left = {s: w / total_share * total - held.get(s, 0) for s, w in shares}
    placed = {}
    for r in giants:
        at = max(left, key=lambda s: (left[s], s))
        placed[r.group_key] = at
        left[at] -= r.n
    rest = [(s, max(x, 0.0)) for s, x in left.items()]
    if not any(x for _, x in rest):
        rest = shares
    split = _rendezvous(F.col("group_key"), rest)
    if placed:
        fixed = F.broadcast(groups.sparkSession.createDataFrame(sorted(placed.items()), "group_key string, fixed string"))
        keyed = keyed.join(fixed, "group_key", "left")
        split = F.coalesce("fixed", split)
    if kept is not None:
        keyed = keyed.join(kept, "group_key", "left")
        split = F.coalesce("kept", split)
    return keyed.select("id", split.alias("split"))
