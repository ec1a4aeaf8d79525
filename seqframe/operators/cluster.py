"""Complete-linkage clusters of a distance table, merged in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqframe.sources.tables import written

#: Sums of distances are of whole numbers of this fraction, so no order of addition changes them.
GRAIN = 10**9


def merged_pairs(links: DataFrame) -> DataFrame:
    """``old, new``: pairs of clusters that are each other's nearest; the larger name goes.

    links: a, b (a < b), d. Of equal distances the pair of the least hash is nearer, so that ties part evenly among
    the clusters and many pairs merge in a round.
    """
    rank = F.struct("d", F.xxhash64("a", "b").alias("h"), "a", "b").alias("k")
    each = links.select(F.explode(F.array("a", "b")).alias("node"), rank).groupBy("node").agg(F.min("k").alias("k"))
    both = each.groupBy("k.a", "k.b").agg(F.count("*").alias("n")).where("n = 2")
    return written(both.select(F.col("b").alias("old"), F.col("a").alias("new")), "merged")


def renamed(df: DataFrame, column: str, merges: DataFrame) -> DataFrame:
    """``df`` with the clusters in ``column`` under the names that merges give them."""
    to = merges.select(F.col("old").alias("o"), F.col("new").alias("w"))
    return df.join(to, F.col(column) == F.col("o"), "left").withColumn(column, F.coalesce("w", column)).drop("o", "w")


def clusters_of(distances: DataFrame, height: float) -> DataFrame:
    """``node, cluster``: complete-linkage clusters cut at ``height``, named by their least member.

    Clusters that are each other's nearest merge, all such pairs of a round at once. Nothing that
    is merged later can come nearer than what has been merged (the largest distance counts), so this gives the clusters of
    merging the nearest pair of all, one by one. Links of clusters of which some members are farther than
    the height can never merge and go; the links of a round are one row a pair of clusters.
    """
    rows = distances.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), "d")
    now = written(rows.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("cluster")), "clusters")
    links = rows.where((F.col("a") != F.col("b")) & (F.col("d") <= height)).groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = written(links.agg(F.min("d").alias("d"), F.lit(1).cast("long").alias("n")), "links")
    while True:
        merges = merged_pairs(links)
        if merges.isEmpty():
            return now
        now = written(renamed(now, "cluster", merges), "clusters")
        sizes = now.groupBy("cluster").agg(F.count("*").alias("size"))
        x = renamed(renamed(links, "a", merges), "b", merges).where("a <> b")
        x = x.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("d").alias("d"), F.sum("n").alias("n"))
        x = x.join(sizes.select(F.col("cluster").alias("ca"), F.col("size").alias("sa")), F.col("a") == F.col("ca"))
        x = x.join(sizes.select(F.col("cluster").alias("cb"), F.col("size").alias("sb")), F.col("b") == F.col("cb"))
        links = written(x.where(F.col("n") == F.col("sa") * F.col("sb")).select("a", "b", "d", "n"), "links")


def cluster(distances: DataFrame, height: float = 0.02) -> DataFrame:
    """``centroid, members, size`` of complete-linkage clusters cut at ``height``.

    distances: a, b, d; pairs not listed are farther than any height, of a pair listed more than once the least
    distance counts. The centroid has the least sum of distances in its cluster, the smallest id of equals; members are in order.
    An empty table gives an empty result.
    """
    now = clusters_of(distances, height)
    of = lambda n, c: now.select(F.col("node").alias(n), F.col("cluster").alias(c))
    pairs = distances.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), "d").where((F.col("a") != F.col("b")) & (F.col("d") <= height))
    pairs = pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("d").alias("d"))
    pairs = pairs.join(of("na", "ca"), F.col("a") == F.col("na")).join(of("nb", "cb"), F.col("b") == F.col("nb")).where("ca = cb")
    far = pairs.select(F.explode(F.array("a", "b")).alias("x"), F.round(F.col("d") * GRAIN).cast("long").alias("d")).groupBy("x").agg(F.sum("d").alias("far"))
    rows = now.join(far, F.col("node") == F.col("x"), "left")
    best = F.min(F.struct(F.coalesce("far", F.lit(0)).alias("far"), "node")).alias("best")
    out = rows.groupBy("cluster").agg(best, F.array_sort(F.collect_list("node")).alias("members"))
    return out.select(F.col("best.node").alias("centroid"), F.array_join("members", " ").alias("members"), F.size("members").alias("size"))
