"""Clusters, unions and cuts of positions on sequences (1-based, both ends included)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqframe.functions.sequence import reverse_complement
from seqframe.operators.chunks import in_chunks, running


def region_of(rows: DataFrame, slack: int = 100) -> DataFrame:
    """``id, lo, hi, dir``: the stretch of the query that an alignment leads to, extended by what it leaves of the reference."""
    hang = F.col("len_r") - F.col("e1")
    fwd = F.col("s2") < F.col("e2")
    return rows.select(
        F.col("qry").alias("id"), F.when(fwd, F.col("s2")).otherwise(F.greatest(F.lit(1), F.col("e2") - hang - slack)).alias("lo"),
        F.when(fwd, F.least(F.col("len_q"), F.col("e2") + hang + slack)).otherwise(F.col("s2")).alias("hi"), F.when(fwd, "f").otherwise("r").alias("dir"),
    )


def endpoint_of(rows: DataFrame, end: bool = True) -> DataFrame:
    """``id, pos, dir, len, prec``: where the reference's end (or start) falls on the query; prec is what was extrapolated."""
    fwd = F.col("s2") < F.col("e2")
    hang = F.col("len_r") - F.col("e1") if end else F.col("s1") - 1
    at, sign = (F.col("e2"), 1) if end else (F.col("s2"), -1)
    return rows.select(
        F.col("qry").alias("id"), F.when(fwd, at + sign * hang).otherwise(at - sign * hang).alias("pos"), F.when(fwd, "f").otherwise("r").alias("dir"),
        F.col("len_q").alias("len"), hang.alias("prec"),
    )


def cluster_endpoints(points: DataFrame, sep: int = 500) -> DataFrame:
    """Of each chain of points of one id and direction at most ``sep`` apart, the one of least prec, the first of equals.

    Points off their sequence are dropped. Columns: id, pos, dir, len, prec.
    """
    points = points.where((F.col("pos") >= 1) & (F.col("pos") <= F.col("len")))
    ids, order = ["id", "dir"], ["pos", "prec", "len"]
    rows = running(in_chunks(points, ids, order), ids, order, F.col("pos"), "last")
    gap = F.coalesce((F.col("pos") - F.col("last") > sep).cast("int"), F.lit(0))
    islands = running(rows.withColumn("gap", gap), ids, order, F.col("gap"), "turns", add=True)
    islands = islands.withColumn("island", F.coalesce("turns", F.lit(0)) + F.col("gap"))
    best = F.min_by(F.struct("pos", "len", "prec"), F.struct("prec", "pos", "len")).alias("b")
    return islands.groupBy("id", "dir", "island").agg(best).select("id", "b.pos", "dir", "b.len", "b.prec")


def union_regions(regions: DataFrame, tail: int = 500) -> DataFrame:
    """``id, lo, hi, dir``: unions of touching regions of one direction, in the order of id, lo, hi descending.

    Where a later region leaves at least ``tail`` of the union, the union begins there instead.
    """
    order = ["lo", F.desc("hi"), "dir"]
    rows = in_chunks(regions, ["id"], order)
    rows = running(rows, ["id"], order, F.struct("lo", -F.col("hi"), "dir"), "last")
    rows = rows.withColumn("turn", F.coalesce((F.col("last.dir") != F.col("dir")).cast("int"), F.lit(0)))
    rows = running(rows, ["id"], order, F.col("turn"), "turns", add=True).withColumn("run", F.coalesce("turns", F.lit(0)) + F.col("turn"))
    rows = running(rows, ["id", "run"], order, F.col("hi"), "reach")
    rows = rows.withColumn("gap", (F.col("reach").isNull() | (F.col("reach") < F.col("lo"))).cast("int"))
    runs = running(rows, ["id", "run"], order, F.col("gap"), "gaps", add=True).withColumn("group", F.coalesce("gaps", F.lit(0)) + F.col("gap"))
    moved = F.max(F.when((F.col("gap") == 0) & (F.lit(tail) <= 1 + F.col("reach") - F.col("lo")), F.col("lo")))
    out = runs.groupBy("id", "run", "group", "dir").agg(F.coalesce(moved, F.min("lo")).alias("lo"), F.max("hi").alias("hi"))
    return out.select("id", "lo", "hi", "dir")


def group_intervals(rows: DataFrame, distance: int = 100, least: int = 2000) -> DataFrame:
    """``qry, start, end`` of intervals of one query joined over gaps of at most ``distance``, at least ``least`` long."""
    x = rows.select("qry", F.least("s2", "e2").alias("s"), F.greatest("s2", "e2").alias("e"))
    x = running(in_chunks(x, ["qry"], ["s", "e"]), ["qry"], ["s", "e"], F.col("e"), "reach")
    x = x.withColumn("gap", F.coalesce((F.col("s") > F.col("reach") + distance).cast("int"), F.lit(1)))
    x = running(x, ["qry"], ["s", "e"], F.col("gap"), "gaps", add=True).withColumn("g", F.coalesce("gaps", F.lit(0)) + F.col("gap"))
    out = x.groupBy("qry", "g").agg(F.min("s").alias("start"), F.max("e").alias("end"))
    return out.where(F.col("end") - F.col("start") + 1 >= least).select("qry", "start", "end")


def cut_sections(seqs: DataFrame, sections: DataFrame, buffer: int = 0) -> DataFrame:
    """``contig, start, end, seq``; start > end reads the other strand. Both ends move by ``buffer`` and are kept in [1, length].

    A contig that has no sequence is an error.
    """
    n = F.length("seq")
    inside = lambda c: F.greatest(F.lit(1), F.least(n, c))
    x = sections.join(seqs.select(F.col("id").alias("of"), "seq"), F.col("contig") == F.col("of"), "left")
    known = F.when(F.col("of").isNotNull(), F.col("seq")).otherwise(F.raise_error(F.concat(F.lit("no sequence for "), F.col("contig").cast("string"))))
    x = x.withColumn("seq", known).select(
        "contig", "start", "end", "seq", inside(F.least("start", "end") - buffer).alias("lo"), inside(F.greatest("start", "end") + buffer).alias("hi")
    )
    piece = F.expr("substring(seq, lo, hi - lo + 1)")
    rev = F.col("start") > F.col("end")
    return x.select(
        "contig", F.when(rev, F.col("hi")).otherwise(F.col("lo")).alias("start"), F.when(rev, F.col("lo")).otherwise(F.col("hi")).alias("end"),
        F.when(rev, reverse_complement(piece)).otherwise(piece).alias("seq"),
    )


def windows_at(points: DataFrame, before: int, after: int, most_prec: int) -> DataFrame:
    """``contig, start, end``: sections around endpoints of at most this precision value, along their direction, kept in [1, len].

    The last 100 bases and 3 more of an end: before=99, after=3; 1,500 bases from 5 before a start: before=5, after=1494.
    """
    fwd = F.col("dir") == "f"
    inside = lambda c: F.greatest(F.lit(1), F.least("len", c)).cast("int")
    return points.where(F.col("prec") <= most_prec).select(
        F.col("id").alias("contig"), inside(F.when(fwd, F.col("pos") - before).otherwise(F.col("pos") + before)).alias("start"),
        inside(F.when(fwd, F.col("pos") + after).otherwise(F.col("pos") - after)).alias("end"),
    )


def selected(rows: DataFrame, identity: float = 0.0, len_r: int = 0, len_q: int = 0, reach: int | None = None) -> DataFrame:
    """Alignments of at least this identity and these aligned lengths; reach: those that end at this place of the reference."""
    out = rows.where((F.col("idy") >= identity) & (F.col("len1") >= len_r) & (F.col("len2") >= len_q))
    return out if reach is None else out.where(F.col("e1") == reach)
