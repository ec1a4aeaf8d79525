"""Ungapped alignments from shared l-mers, and the best of them for each query."""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqframe.functions.sequence import kmers, reverse_complement, with_bytes
from seqframe.sources.tables import written


def equal_places(a: Column | str, b: Column | str) -> Column:
    """At how many places two strings of equal length agree."""
    x = with_bytes(a, lambda p: with_bytes(b, lambda q: F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(p))), lambda i: F.substring(p, i, F.lit(1)) == F.substring(q, i, F.lit(1))))))
    return F.when(F.length(a) == 0, 0).otherwise(x)


def align(ref: DataFrame, qry: DataFrame, seed: int = 20, gap: int = 90, least: int = 65) -> DataFrame:
    """Alignment rows of ``ref`` (id, seq) with ``qry`` on both strands.

    Shared l-mers of length ``seed`` on one diagonal, at most ``gap`` bases apart, make one alignment without gaps; shorter
    ones than ``least`` are dropped. Identity is the share of equal places. Seeds meet in an equi-join on
    the l-mer; sequences are joined again only for the alignments found.
    """
    at = lambda df, c: df.select(F.col("id").alias(c), F.posexplode(kmers(F.upper("seq"), seed)).alias("p", "w")).where(~F.col("w").rlike("[^ACGT]"))
    both = qry.select("id", F.lit("f").alias("strand"), F.upper("seq").alias("seq")).unionByName(qry.select("id", F.lit("r").alias("strand"), reverse_complement(F.upper("seq")).alias("seq")))
    q = both.select(F.col("id").alias("qry"), "strand", F.posexplode(kmers("seq", seed)).alias("q", "v"))
    hits = at(ref, "ref").join(q, F.col("w") == F.col("v")).select("ref", "qry", "strand", "p", (F.col("q") - F.col("p")).alias("diag"))
    w = Window.partitionBy("ref", "qry", "strand", "diag").orderBy("p")
    far = F.coalesce((F.col("p") - F.lag("p").over(w) > seed + gap).cast("int"), F.lit(0))
    runs = hits.withColumn("far", far).withColumn("run", F.sum("far").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("ref", "qry", "strand", "diag", "run").agg(F.min("p").alias("lo"), (F.max("p") + seed).alias("hi"))
    runs = written(runs.where(F.col("hi") - F.col("lo") >= least), "runs")
    x = runs.join(ref.select(F.col("id").alias("r_of"), F.upper("seq").alias("rs")), F.col("ref") == F.col("r_of"))
    x = x.join(both.select(F.col("id").alias("q_of"), F.col("strand").alias("s_of"), F.col("seq").alias("qs")), (F.col("qry") == F.col("q_of")) & (F.col("strand") == F.col("s_of")))
    n, nr, nq = F.col("hi") - F.col("lo"), F.length("rs"), F.length("qs")
    same = equal_places(F.substring(F.col("rs"), F.col("lo") + 1, n), F.substring(F.col("qs"), F.col("lo") + F.col("diag") + 1, n))
    a, b = F.col("lo") + F.col("diag") + 1, F.col("hi") + F.col("diag")
    turned = F.col("strand") == "r"
    return x.select(
        (F.col("lo") + 1).alias("s1"), F.col("hi").alias("e1"), F.when(turned, nq - a + 1).otherwise(a).alias("s2"), F.when(turned, nq - b + 1).otherwise(b).alias("e2"),
        n.alias("len1"), n.alias("len2"), (same * 100.0 / n).alias("idy"), nr.alias("len_r"), nq.alias("len_q"), (n * 100.0 / nr).alias("cov_r"), (n * 100.0 / nq).alias("cov_q"), "ref", "qry",
    )


def best_hits(rows: DataFrame, least_identity: float = 0.0) -> DataFrame:
    """Of each query's alignments those that no other one covers whole with a higher length times identity (the first of equals)."""
    x = rows.where(F.col("idy") >= least_identity).withColumns({"lo": F.least("s2", "e2"), "hi": F.greatest("s2", "e2"), "worth": F.col("len2") * F.col("idy")})
    key = F.struct(-F.col("worth"), F.col("ref"), F.col("s1"), F.col("e1"), F.col("s2")).alias("key")
    x = x.withColumn("key", key)
    other = x.select(F.col("qry").alias("q"), F.col("lo").alias("l"), F.col("hi").alias("h"), F.col("key").alias("k"))
    beaten = (F.col("qry") == F.col("q")) & (F.col("l") <= F.col("lo")) & (F.col("h") >= F.col("hi")) & (F.col("k") < F.col("key"))
    return x.join(other, beaten, "left_anti").drop("lo", "hi", "worth", "key")


def heaviest(intervals: list[tuple[int, int, int]]) -> list[int]:
    """Places of intervals (lo, hi, weight) that do not overlap and weigh most together; intervals in the order of hi.

    best[i] is the most that the first i can weigh. Of equals an interval is left out rather than taken, from the last on.
    """
    his = [hi for _, hi, _ in intervals]
    best = [0]
    for lo, _, weight in intervals:
        # an interval goes on from the most that intervals before it weigh
        best.append(max(best[-1], weight + best[bisect.bisect_left(his, lo)]))
    out, i = [], len(intervals)
    while i:
        if best[i] == best[i - 1]:
            i -= 1
        else:
            out.append(i - 1)
            i = bisect.bisect_left(his, intervals[i - 1][0])
    return out[::-1]


def best_chain(rows: DataFrame, least_identity: float = 0.0) -> DataFrame:
    """Of each query's alignments those that cover no place of it twice and together have the largest sum of length times identity.

    Identities count in thousandths. Alignments that overlap, if only by way of others, form an island, which
    is solved in one task; islands of one query are solved apart. Ties: see heaviest(); rows of one end are taken by
    start, ref, s1, e1, s2. All columns come back; a negative or null identity weighs nothing and is left out.
    """
    x = rows.where(F.col("idy") >= least_identity).withColumns({"lo": F.least("s2", "e2"), "hi": F.greatest("s2", "e2"), "worth": F.col("len2").cast("long") * F.round(F.col("idy") * 1000).cast("long")})
    w = Window.partitionBy("qry").orderBy("lo", "hi", "ref", "s1", "e1", "s2")
    new = F.coalesce(F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)) < F.col("lo"), F.lit(True))
    x = x.withColumn("new", new.cast("int")).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new")

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["hi", "lo", "ref", "s1", "e1", "s2"], kind="stable")
        return group.iloc[heaviest(list(zip(group["lo"].tolist(), group["hi"].tolist(), group["worth"].tolist(), strict=True)))]

    return x.groupBy("qry", "island").applyInPandas(solve, x.schema).drop("lo", "hi", "worth", "island")
