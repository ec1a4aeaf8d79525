"""Whole chains of operators: from known exons, an assembly, k-mer counts and long reads to confirmed exon copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqframe.operators.align import best_chain
from seqframe.operators.gapped import align_gapped, align_translated
from seqframe.operators.graph import remove_inclusions
from seqframe.operators.intervals import cluster_endpoints, cut_sections, endpoint_of, group_intervals, windows_at
from seqframe.operators.kmers import confirmed, count_range
from seqframe.operators.relational import first_seen, numbered, select_tags, unify
from seqframe.operators.repair import repair
from seqframe.operators.scans import best_frame, end_mer, first_exon, second_exon, start_mer
from seqframe.operators.walks import walk
from seqframe.sources.tables import written

#: Fixed parameters of the chains: counts of the walks' table, steps, how far an end may be extrapolated.
LEAST_COUNT, FIRST_STEPS, SECOND_STEPS = 10, 12_000, 1_500
END_PREC, START_PREC = 100, 50


def placed_ends(exons: DataFrame, seqs: DataFrame, end: bool = True, **how) -> DataFrame:
    """Where the exons' ends (or starts) fall on sequences, one of each cluster."""
    rows = written(align_gapped(exons, seqs, **how), "alignments")
    return written(cluster_endpoints(endpoint_of(best_chain(rows), end)), "ends")


def pieces(seqs: DataFrame, sections: DataFrame, name: str) -> DataFrame:
    """``id, seq`` of sections, numbered by contig and place."""
    cut = cut_sections(seqs, sections.distinct()).where(F.length("seq") > 0)
    return written(numbered(cut, ["contig", "start", "end"], name, "id").select("id", "seq"), "pieces")


def starts_of(mers: DataFrame, side: str) -> DataFrame:
    """Starts of walks from ``id, kmer``: each k-mer once, under its first id, in the order of ids."""
    once = first_seen(mers.select("id", "kmer"), ["kmer"], ["id"])
    return written(numbered(once, ["id"], "%d", "ord").select(F.col("ord").cast("long").alias("ord"), F.col("id").alias("tag"), "kmer", F.lit(side).alias("dir")), "starts")


def records(found: DataFrame, *reasons: str) -> DataFrame:
    """``id, seq`` of walks that ended for one of these reasons."""
    return found.where(F.col("reason").isin(*reasons)).select(F.concat("tag", F.lit("-"), F.lpad(F.col("variant").cast("string"), 3, "0")).alias("id"), "seq")


def patterns(starts: DataFrame, n: int | None = None) -> list[str]:
    """The distinct (beginnings of n bases of the) k-mers of starts: a parameter of walks, some for each place of an exon."""
    kmer: Column = F.col("kmer") if n is None else F.left("kmer", F.lit(n))
    return [r.p for r in starts.select(kmer.alias("p")).distinct().orderBy("p").collect()]


def all_confirmed(seqs: DataFrame, table: DataFrame, k: int) -> DataFrame:
    """Sequences all of whose k-mers the table has."""
    whole = confirmed(seqs, table, k).where("missing = 0").select("id")
    return select_tags(seqs, whole)


def first_exon_graph(exons: DataFrame, contigs: DataFrame, counts: DataFrame, k: int = 71, least: int = LEAST_COUNT, **how) -> DataFrame:
    """``kmer, cnt`` of the k-mers between starts and ends of first exons.

    Splice sites near the exons' ends on contigs start walks to the left; likely starts in what these give start walks back to the right,
    which stop at the splice sites; the splice sites that these find join the others for a last walk to the left, which stops at
    the starts and whose k-mers are the result.
    """
    table = written(count_range(counts, least, 1 << 62), "table")
    near = windows_at(placed_ends(exons, contigs, **how), 96, 3, END_PREC)
    left = starts_of(end_mer(pieces(contigs, near, "end%06d"), k), "L")
    back = records(walk(left, table, k, FIRST_STEPS)[0], "Orf-end")
    right = starts_of(start_mer(back, k), "R")
    there = records(walk(right, table, k, FIRST_STEPS, patterns(left))[0], "Orf-end")
    more = starts_of(end_mer(there, k), "L")
    known = left.select("kmer").withColumnRenamed("kmer", "have")
    more = more.join(known, F.col("kmer") == F.col("have"), "left_anti")
    top = left.agg(F.coalesce(F.max("ord"), F.lit(0)).alias("m")).first().m
    both = left.unionByName(more.withColumn("ord", F.col("ord") + top))
    return walk(both, table, k, FIRST_STEPS, patterns(right))[1]


def confirm_first_exons(exons: DataFrame, contigs: DataFrame, reads: DataFrame, counts: DataFrame, k: int = 71, least: int = LEAST_COUNT, **how) -> DataFrame:
    """``id, seq``: first exons read from long reads, mended by the k-mers of first_exon_graph() and confirmed whole by them.

    exons, contigs, reads: id, seq; counts: canonical k-mers and counts; ``how``: options of align_gapped(). A read gives the part up to 3
    bases beyond an exon's end.
    """
    graph = written(first_exon_graph(exons, contigs, counts, k, least, **how), "graph")
    ends = placed_ends(exons, reads, **how).where(F.col("prec") <= END_PREC)
    fwd, inside = F.col("dir") == "f", lambda c: F.greatest(F.lit(1), F.least("len", c)).cast("int")
    upto = ends.select(F.col("id").alias("contig"), F.when(fwd, F.lit(1)).otherwise(F.col("len")).cast("int").alias("start"), inside(F.when(fwd, F.col("pos") + 3).otherwise(F.col("pos") - 3)).alias("end"))
    raw = pieces(reads, upto, "read%06d").where(F.length("seq") > k)
    mended = written(first_exon(repair(raw, graph, k).select("id", "seq")), "mended")
    return all_confirmed(mended, graph, k)


def second_exon_graph(exons: DataFrame, contigs: DataFrame, counts: DataFrame, k: int = 71, least: int = LEAST_COUNT, **how) -> DataFrame:
    """``kmer, cnt`` of the k-mers between starts and ends of second exons: walks to the right, back to the left, and to the right again."""
    table = written(count_range(counts, least, 1 << 62), "table")
    near = windows_at(placed_ends(exons, contigs, end=False, **how), 5, 1494, START_PREC)
    first = lambda seqs: second_exon(seqs).select("id", F.left("seq", F.lit(k)).alias("kmer")).where(F.length("kmer") == k)
    there = starts_of(first(pieces(contigs, near, "start%06d")), "R")
    ends = records(walk(there, table, k, SECOND_STEPS)[0], "Orf-end").where(F.length("seq") >= 600)
    back = starts_of(ends.select("id", F.right("seq", F.lit(k)).alias("kmer")), "L")
    begun = second_exon(records(walk(back, table, k, SECOND_STEPS, patterns(there, 10))[0], "Orf-end", "Hit-stop-pattern")).where(F.length("seq") >= 600)
    again = starts_of(first(begun), "R")
    return walk(again, table, k, SECOND_STEPS)[1]


def confirm_second_exons(exons: DataFrame, contigs: DataFrame, reads: DataFrame, counts: DataFrame, k: int = 71, least: int = LEAST_COUNT, **how) -> DataFrame:
    """``id, seq``: second exons read from long reads, mended by the k-mers of second_exon_graph() and confirmed whole by them. As confirm_first_exons()."""
    contigs, reads = (df.where(F.length("seq") > k) for df in (contigs, reads))
    graph = written(second_exon_graph(exons, contigs, counts, k, least, **how), "graph")
    near = windows_at(placed_ends(exons, reads, end=False, **how), 5, 1494, START_PREC)
    raw = pieces(reads, near, "read%06d").where(F.length("seq") > k)
    mended = written(second_exon(repair(raw, graph, k).select("id", "seq")), "mended")
    return all_confirmed(mended, graph, k)


def finish(found: DataFrame, known: DataFrame, contigs: DataFrame, counts: DataFrame, k: int = 71, least: int = LEAST_COUNT, least_region: int = 2000, **how) -> dict[str, DataFrame]:
    """Regions of contigs that read like known sequences, and their union with what was found.

    found, known, contigs: id, seq. Regions are where translated alignments of ``known`` lie close together; they are cut out, scored
    for frame shifts, and mended by counts of ``least`` and more. Of regions and of found sequences those that others include
    go. ``regions`` (id, seq, strand, score), ``results`` (id, seq), ``union`` (id, level, seq): level 0 the union, 1 and 2 regions that a result
    only partly covers.
    """
    rows = align_translated(known, contigs).where((F.col("idy") >= 50) & (F.col("len1") >= 100))
    spans = group_intervals(rows, 100, least_region).select(F.col("qry").alias("contig"), "start", "end")
    raw = pieces(contigs, spans, "region%06d")
    table = written(count_range(counts, least, 1 << 62), "table")
    mended = written(repair(raw, table, k, 200, 300).select("id", "seq"), "mended")

    def unlike(seqs: DataFrame) -> DataFrame:
        own = align_gapped(seqs, seqs, **how)
        return written(select_tags(seqs, remove_inclusions(own)), "unlike")

    regions, results = unlike(mended), unlike(found)
    between = align_gapped(regions, results, **how)
    levels = unify(regions.select("id"), results.select("id"), between)
    every = regions.unionByName(results).select(F.col("id").alias("of"), "seq")
    union = levels.join(every, F.col("id") == F.col("of")).select("id", "level", "seq")
    scores = best_frame(regions).select(F.col("id").alias("of"), "strand", "score")
    return {"regions": regions.join(scores, F.col("id") == F.col("of")).select("id", "seq", "strand", "score"), "results": results, "union": written(union, "union")}
