"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqframe.llm.scratch import dropped, written


def _named(labels: DataFrame, of: str, to: str) -> DataFrame:
    return labels.select(F.col("node").alias(of), F.col("comp").alias(to))


def components(links: DataFrame) -> DataFrame:
    """``node, comp`` for every node of ``links`` (a, b longs): comp is the smallest node reachable.

    In each round every node takes its smallest neighbour if that is smaller; pointer jumping flattens the trees so made, and the
    links between trees are the links of the next round, at most half as many nodes. All rounds are
    written tables, so neither lineage nor a lost executor makes it start over. Both sides of each join
    are plain tables, which lets the engine split a hot node.
    """
    now, edges = None, links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    loops = links.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("comp"))
    while True:
        edges = written(edges.distinct(), "edges")
        if edges.isEmpty():
            break
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        tree = written(ends.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("comp")), "trees")
        while True:
            up = written(tree.join(_named(tree, "at", "beyond"), F.col("comp") == F.col("at")).select("node", "comp", "beyond"), "jumps")
            if up.where("comp <> beyond").isEmpty():
                dropped(up)
                break
            dropped(tree)
            tree = up.select("node", F.col("beyond").alias("comp"))
        if now is None:
            now = tree
        else:
            now = now.join(_named(tree, "at", "beyond"), F.col("comp") == F.col("at"), "left").select("node", F.coalesce("beyond", "comp").alias("comp"))
            now = written(now, "labels")
        edges = edges.join(_named(tree, "ua", "ca"), F.col("a") == F.col("ua")).join(_named(tree, "ub", "cb"), F.col("b") == F.col("ub"))
        edges = edges.where("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"))
    if now is None:
        return written(loops.distinct(), "components")
    return written(now.unionByName(loops).groupBy("node").agg(F.min("comp").alias("comp")), "components")


def merged(known: DataFrame, more: DataFrame) -> DataFrame:
    """``known`` components joined by ``more`` links; nodes that known lacks are components of their own."""
    own = more.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("comp"))
    known = written(known.unionByName(own).groupBy("node").agg(F.min("comp").alias("comp")), "known")
    between = more.join(_named(known, "ua", "ca"), F.col("a") == F.col("ua")).join(_named(known, "ub", "cb"), F.col("b") == F.col("ub"))
    over = components(between.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    return written(known.join(_named(over, "at", "beyond"), F.col("comp") == F.col("at"), "left").select("node", F.coalesce("beyond", "comp").alias("comp")), "merged")
