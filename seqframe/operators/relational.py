"""Selections, joins and removals on sequence and alignment tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqframe.functions.sequence import places, reverse_complement
from seqframe.sources.tables import written


def select_tags(df: DataFrame, tags: DataFrame, keep: bool = True) -> DataFrame:
    """Rows whose id is (or is not) among ``tags``. The engine broadcasts the tags when they are small."""
    return df.join(tags.select(F.col("id").alias("tag")), F.col("id") == F.col("tag"), "left_semi" if keep else "left_anti")


def first_seen(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of the rows with equal key, the first in ``order``; a partial minimum, so a common key does not gather."""
    rest = [c for c in df.columns if c not in key and c not in order]
    best = F.min(F.struct(*order, *rest)).alias("b")
    return df.groupBy(*key).agg(best).select(*[c if c in key else F.col(f"b.{c}").alias(c) for c in df.columns])


def unique_paths(df: DataFrame, group: str, order: str, variant: str) -> DataFrame:
    """Rows of variant 1 that the next row in order does not continue: it is variant 1 too, or there is none."""
    w = Window.partitionBy(group).orderBy(order)
    return df.withColumn("next", F.lead(variant).over(w)).where((F.col(variant) == 1) & (F.col("next").isNull() | (F.col("next") == 1))).drop("next")


def classify_ends(seqs: DataFrame, starts: list[str], ends: list[str]) -> DataFrame:
    """``id, len, has_start, has_end``"""
    any_of = lambda f, xs: F.array_max(F.array(F.lit(False), *[f(x) for x in xs]))
    return seqs.select(
        "id", F.length("seq").alias("len"), any_of(lambda p: F.col("seq").startswith(p), starts).alias("has_start"),
        any_of(lambda p: F.col("seq").endswith(p), ends).alias("has_end"),
    )


def composite(cov: str) -> Column:
    return F.col("idy") * F.col(cov) * 0.01


def contained_matches(rows: DataFrame, least: float = 99.0) -> DataFrame:
    """``ref, relation, qry`` of near-identical alignments that cover both ("equals") or end the query ("contains")."""
    rel = F.when((F.col("cov_r") == 100) & (F.col("cov_q") == 100), "equals").when((F.col("s2") == 1) & (F.col("e2") == F.col("len_q")), "contains")
    return rows.where(F.col("idy") >= least).select("ref", rel.alias("relation"), "qry").where(F.col("relation").isNotNull())


def unify(blobs: DataFrame, results: DataFrame, rows: DataFrame, composite_least: float = 95, coverage: float = 5, identity: float = 99) -> DataFrame:
    """``id, level``: the union of results and blobs (0), and the blobs that no result covers but one matches (1, 2).

    rows: alignments with blobs as ref and results as qry. A blob is dropped when a result covers it,
    kept when none matches it, else a problem of level 1, and of level 2 when a result that matches it is
    not covered by any blob.
    """
    covered_blobs = rows.where(composite("cov_r") >= composite_least).select(F.col("ref").alias("id")).distinct()
    covered_results = rows.where(composite("cov_q") >= composite_least).select(F.col("qry").alias("tag")).distinct()
    matches = rows.where((F.col("idy") >= identity) & (F.col("cov_r") >= coverage)).select("ref", "qry").distinct()
    open_ = select_tags(blobs.select("id"), covered_blobs, keep=False)
    touched = matches.join(covered_results, F.col("qry") == F.col("tag"), "left").groupBy(F.col("ref").alias("of")).agg(F.max(F.col("tag").isNull()).alias("two"))
    level = F.when(F.col("of").isNull(), 0).when(F.col("two"), 2).otherwise(1)
    graded = open_.join(touched, F.col("id") == F.col("of"), "left").select("id", level.alias("level"))
    return results.select("id", F.lit(0).alias("level")).unionByName(graded)


def similarity_pairs(rows: DataFrame, slack: int = 4) -> DataFrame:
    """``ref, qry, sim``: the best identity of an alignment that covers the whole reference, else 0; as a fraction."""
    full = F.when((F.col("s1") == 1) & (F.col("e1") >= F.col("len_r") - slack), F.col("idy")).otherwise(0.0)
    return rows.groupBy("ref", "qry").agg((F.max(full) / 100).alias("sim"))


def distance_matrix(rows: DataFrame) -> DataFrame:
    """``a, b, d`` in long form for all pairs of ids that an alignment links in either direction; d = 1 - mean of both similarities.

    Pairs without any alignment have distance 1 and are left out; the diagonal is 0.
    """
    sim = similarity_pairs(rows).where("ref <> qry")
    both = sim.select(F.col("ref").alias("a"), F.col("qry").alias("b"), "sim").unionByName(sim.select(F.col("qry").alias("a"), F.col("ref").alias("b"), "sim"))
    ids = rows.select(F.explode(F.array("ref", "qry")).alias("a")).distinct().select("a", F.col("a").alias("b"), F.lit(0.0).alias("d"))
    return both.groupBy("a", "b").agg((1 - F.sum("sim") * 0.5).alias("d")).unionByName(ids)


def consensus(block: DataFrame, pad: bool = False) -> DataFrame:
    """``seq``: the most frequent character of each column of aligned sequences (smallest of equals) without gaps.

    pad: shorter sequences count as filled up with gaps; else they are an error.
    """
    size = block.agg(F.min(F.length("seq")).alias("lo"), F.max(F.length("seq")).alias("hi"), F.count("*").alias("n"))
    rows = block.select(F.posexplode(F.split("seq", "")).alias("pos", "base")).where("base <> ''").groupBy("pos", "base").count()
    # gaps that fill up are counted, not made
    short = rows.groupBy("pos").agg(F.sum("count").alias("c")).join(F.broadcast(size), F.lit(True)).select("pos", F.lit("-").alias("base"), (F.col("n") - F.col("c")).alias("count"))
    rows = rows.unionByName(short).groupBy("pos", "base").agg(F.sum("count").alias("count"))
    best = rows.groupBy("pos").agg(F.min_by("base", F.struct(-F.col("count"), F.col("base"))).alias("base")).where("base <> '-'")
    joined = best.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "base"))), lambda x: x["base"]), "").alias("seq"))
    even = F.lit(pad) | (F.col("lo") == F.col("hi")) | F.col("lo").isNull()
    return joined.join(F.broadcast(size)).select(F.when(even, F.col("seq")).otherwise(F.raise_error(F.lit("sequences differ in length"))).alias("seq"))


def numbered(df: DataFrame, order: list[str], pattern: str, column: str = "id") -> DataFrame:
    """``df`` with ids such as p0001 (pattern "p%04d") in this order; rows are numbered by sorted partitions, not in one task."""
    ordered = written(df.orderBy(*order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id()), "numbered")
    sizes = ordered.groupBy(F.col("__p").alias("__q")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__q").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = ordered.join(F.broadcast(sizes.select("__q", before.alias("__b"))), F.col("__p") == F.col("__q"))
    place = F.col("__b") + F.col("__i") - F.shiftleft(F.col("__p").cast("long"), 33) + 1
    return x.select(F.format_string(pattern, place).alias(column), *[F.col(c) for c in df.columns if c != column])


def primer_matches(seqs: DataFrame, primers: list[str], side: str) -> DataFrame:
    """``id, which, pos, strand``: every place of every primer, on the strand given (r: of the reverse complement, as len - p)."""
    seq = F.upper("seq") if side == "f" else reverse_complement(F.upper("seq"))
    x, out = seqs.select("id", F.length("seq").alias("n"), seq.alias("s")), None
    for i, p in enumerate(primers):
        at = places("s", [p.upper()], F.lit(1), F.col("n") - len(p) + 1)
        hits = x.select("id", "n", F.lit(i + 1).alias("which"), F.explode(at).alias("p"))
        out = hits if out is None else out.unionByName(hits)
    return out.select("id", "which", (F.col("p") if side == "f" else F.col("n") - F.col("p") + 1).cast("int").alias("pos"), F.lit(side).alias("strand"))


def primer_pairs(seqs: DataFrame, forward: list[str], backward: list[str]) -> DataFrame:
    """``id, lo, hi, len, lo_primer, hi_primer``: each forward match with each backward match after it."""
    f = primer_matches(seqs, forward, "f").select("id", F.col("pos").alias("lo"), F.col("which").alias("lo_primer"))
    r = primer_matches(seqs, backward, "r").select(F.col("id").alias("i"), F.col("pos").alias("hi"), F.col("which").alias("hi_primer"))
    return f.join(r, (F.col("id") == F.col("i")) & (F.col("lo") < F.col("hi"))).select("id", "lo", "hi", (F.col("hi") - F.col("lo") + 1).alias("len"), "lo_primer", "hi_primer")
