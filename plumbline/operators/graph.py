"""Pair graphs: deletion pairs, connected components, sphere-exclusion clusters."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.core import settle
from plumbline.operators.prefix_join import similar_pairs
from plumbline.operators.set_tiles import pairs_above
from plumbline.operators.similarity import PREFIX_FROM, counted, representatives, set_table, tiled


# ---------------------------------------------------------------- deletion pairs
def deletion_pairs(df: DataFrame, ident: str, units: str) -> DataFrame:
    """(id_without, id_with, unit): pairs of rows that differ by exactly one unit.

    Every row looks up what is left of it after each single deletion. The smallest id stands for
    all rows with the same units, so a group of copies is never paired with another row by row.
    """
    rows = df.select(F.col(ident).alias("id"), F.array_sort(F.array_distinct(units)).alias("u"))
    key = F.md5(F.array_join("u", "\u0001"))
    known = rows.select("id", key.alias("k")).groupBy("k").agg(F.min("id").alias("id_without"))
    cut = rows.select("id", F.explode("u").alias("unit"), "u").select(
        F.col("id").alias("id_with"), "unit",
        F.md5(F.array_join(F.array_remove("u", F.col("unit")), "\u0001")).alias("k"),
    )
    return (
        cut.join(known, "k")
        .where("id_without <> id_with")
        .groupBy("id_without", "id_with")
        .agg(F.min("unit").alias("unit"))
    )


# ---------------------------------------------------------------- connected components
def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, component): component = smallest id in it. ``edges`` has two id columns.

    Alternates two kinds of star contraction (large-star, small-star), which takes a logarithmic
    number of rounds in practice. Minima are taken by partial aggregation, so a hub node is no hot group.
    """
    a, b = edges.columns[:2]
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = settle(e)
    mark = _fingerprint(e)
    while True:
        e = settle(_small_star(_large_star(e)))
        now = _fingerprint(e)
        if now == mark:
            break
        mark = now
    labels = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    labels = labels.unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
    if nodes is None:
        return labels
    return nodes.select("id").join(labels, "id", "left").select(
        "id", F.coalesce("component", "id").alias("component")
    )


def _fingerprint(e: DataFrame):
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def component_report(pairs: DataFrame, a: str, b: str, components: DataFrame) -> DataFrame:
    """One row: pairs, entities in pairs, components, largest one, components of more than two."""
    ends = pairs.select(F.col(a).alias("id")).unionByName(pairs.select(F.col(b).alias("id"))).distinct()
    sizes = ends.join(components, "id").groupBy("component").agg(F.count("*").alias("n"))
    return sizes.agg(
        F.sum("n").alias("n_entities"),
        F.count("*").alias("n_components"),
        F.max("n").alias("largest_component"),
        F.count_if(F.col("n") > 2).alias("n_larger_than_two"),
    ).select(pairs.agg(F.count("*").alias("n")).scalar().alias("n_pairs"), "*")


# ---------------------------------------------------------------- sphere exclusion
def butina(df: DataFrame, ident: str, els: str, min_sim: float = 0.6) -> DataFrame:
    """(id, cluster, is_centroid): sphere-exclusion clusters, named by their centroid's id.

    Rows are taken by number of neighbours (similarity >= ``min_sim``), most first, ties by id; each
    row not yet assigned becomes a centroid and takes its unassigned neighbours. The centroids are
    the lexicographically first maximal independent set of that order, found in rounds: a set is
    decided as soon as no undecided neighbour comes before it. Equal sets share their neighbours and
    so their cluster, hence everything runs on distinct sets. Rows without elements stay alone.
    """
    rows = set_table(df, ident, els)
    if min_sim >= PREFIX_FROM:
        reps = settle(representatives(rows))
        once = similar_pairs(reps.where("n > 0"), None, min_sim).select("q", "r")
    else:
        once = settle(pairs_above(*tiled(rows), None, min_sim).select("q", "r"))
        reps = counted(rows)
    live = reps.where("n > 0")
    pairs = settle(once.unionByName(once.select(F.col("r").alias("q"), F.col("q").alias("r"))))
    copies = live.select("rid", "copies")
    degree = pairs.join(copies.withColumnRenamed("rid", "r"), "r").groupBy("q").agg(F.sum("copies").alias("d"))
    order = settle(
        copies.join(degree.withColumnRenamed("q", "rid"), "rid", "left").select(
            "rid", F.struct((-(F.coalesce("d", F.lit(0)) + F.col("copies") - 1)).alias("d"), F.col("rid").alias("i")).alias("p")
        )
    )
    linked = (
        pairs.join(order.select(F.col("rid").alias("q"), F.col("p").alias("pq")), "q")
        .join(order.select(F.col("rid").alias("r"), F.col("p").alias("pr")), "r")
    )
    open_edges = linked = settle(linked)
    centroids = order.join(pairs.select(F.col("q").alias("rid")).distinct(), "rid", "left_anti").select("rid")
    while open_edges.limit(1).count():
        chosen = settle(
            open_edges.groupBy("q").agg(F.min("pr").alias("first"), F.first("pq").alias("pq"))
            .where("pq < first").select(F.col("q").alias("rid"))
        )
        centroids = centroids.unionByName(chosen)
        done = chosen.unionByName(
            open_edges.join(chosen, open_edges["q"] == chosen["rid"], "left_semi").select(F.col("r").alias("rid"))
        ).distinct()
        done = settle(done)
        rest = open_edges.join(done, open_edges["q"] == done["rid"], "left_anti")
        # a set whose undecided neighbours have all gone to other centroids is a centroid itself
        still = rest.select("q").distinct()
        kept = settle(rest.join(done, rest["r"] == done["rid"], "left_anti"))
        free = still.join(kept.select("q").distinct(), "q", "left_anti").select(F.col("q").alias("rid"))
        centroids = centroids.unionByName(settle(free))
        open_edges = kept
    centroids = settle(centroids)
    joined = linked.join(centroids, linked["r"] == centroids["rid"], "left_semi").groupBy("q").agg(
        F.min("pr").alias("home")
    )
    home = centroids.select("rid", F.col("rid").alias("cluster")).unionByName(
        joined.join(centroids, joined["q"] == centroids["rid"], "left_anti").select(
            F.col("q").alias("rid"), F.col("home.i").alias("cluster")
        )
    )
    named = reps.join(home, "rid", "left").select("sig", "cluster")
    return rows.select("id", "sig").join(named, "sig").select(
        "id", F.coalesce("cluster", "id").alias("cluster")
    ).withColumn("is_centroid", F.col("id") == F.col("cluster"))


def pair_kind(unit_kind: Sequence[tuple[str, str]], unit):
    """Class of the deleted unit by the first matching pattern, else 'other'."""
    out = None
    for name, pattern in unit_kind:
        cond = unit.rlike(pattern)
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out.otherwise(F.lit("other"))
