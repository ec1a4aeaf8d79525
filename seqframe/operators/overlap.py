"""Overlap layout of aligned sequences, and the sequences that it spells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqframe.operators.graph import chains
from seqframe.sources.tables import written


def contained_ids(rows: DataFrame) -> DataFrame:
    """``id`` of references that lie whole in another sequence; of equal ones the largest id is not contained."""
    whole = (F.col("s1") == 1) & (F.col("e1") == F.col("len_r")) & ((F.col("len_r") < F.col("len_q")) | (F.col("ref") < F.col("qry")))
    return rows.where((F.col("e2") >= F.col("s2")) & whole).select(F.col("ref").alias("id")).distinct()


def dovetails(rows: DataFrame) -> DataFrame:
    """``ref, qry, side, s1, e1, e2, len_q``: forward alignments at whose ends one of the two sequences ends.

    side: L where the overlap begins the reference, else R. Rows that make the reference contained are left out.
    """
    whole = (F.col("s1") == 1) & (F.col("e1") == F.col("len_r")) & ((F.col("len_r") < F.col("len_q")) | (F.col("ref") < F.col("qry")))
    meets = ((F.col("s1") == 1) | (F.col("s2") == 1)) & ((F.col("e1") == F.col("len_r")) | (F.col("e2") == F.col("len_q")))
    x = rows.where((F.col("e2") >= F.col("s2")) & ~whole & (F.col("ref") != F.col("qry")) & meets)
    return x.select("ref", "qry", F.when(F.col("s1") == 1, "L").otherwise("R").alias("side"), "s1", "e1", "e2", "len_q")


def layout(rows: DataFrame) -> DataFrame:
    """``unitig, ord, id, from, to, off``: sequences that are not contained, in chains of mutually unique overlaps.

    unitig is the first sequence's id, ord counts from 0; from is where a sequence adds to the one before,
    off where its overlap begins there. An overlap of i with p goes when i's largest overlap on that side, with
    k, and one of k with p on the same side are there; all are judged on the overlaps as they were.
    """
    gone = written(contained_ids(rows), "contained")
    out_of = lambda df, c: df.join(gone.select(F.col("id").alias(f"g_{c}")), F.col(c) == F.col(f"g_{c}"), "left_anti")
    laps = written(out_of(out_of(dovetails(rows), "ref"), "qry"), "overlaps")
    # the largest overlap of each side: on the right it begins first, on the left it ends last
    size = F.when(F.col("side") == "R", -F.col("s1")).otherwise(F.col("e1"))
    first = laps.groupBy("ref", "side").agg(F.min_by("qry", F.struct(-size, F.col("qry"))).alias("k")).withColumnsRenamed({"ref": "r1", "side": "d1"})
    x = laps.join(first, (F.col("ref") == F.col("r1")) & (F.col("side") == F.col("d1"))).drop("r1", "d1")
    beyond = laps.select(F.col("ref").alias("r2"), F.col("side").alias("d2"), F.col("qry").alias("p2")).distinct()
    passed = (F.col("k") == F.col("r2")) & (F.col("side") == F.col("d2")) & (F.col("qry") == F.col("p2")) & (F.col("qry") != F.col("k"))
    kept = written(x.join(beyond, passed, "left_anti").drop("k"), "kept")
    lone = kept.groupBy("ref", "side").agg(F.count("*").alias("n")).where("n = 1")
    right = kept.where("side = 'R'").join(lone.where("side = 'R'").select(F.col("ref").alias("r3")), F.col("ref") == F.col("r3"), "left_semi")
    right = right.join(lone.where("side = 'L'").select(F.col("ref").alias("r4")), F.col("qry") == F.col("r4"), "left_semi")
    right = written(right, "links")
    placed = chains(right.select(F.col("ref").alias("src"), F.col("qry").alias("dst")))
    ids = rows.select(F.col("ref").alias("id"), F.col("len_r").alias("len")).unionByName(rows.select(F.col("qry").alias("id"), F.col("len_q").alias("len")))
    ids = ids.groupBy("id").agg(F.max("len").alias("len")).join(gone.withColumnRenamed("id", "g"), F.col("id") == F.col("g"), "left_anti")
    x = ids.join(placed, F.col("id") == F.col("node"), "left").join(right.select(F.col("qry").alias("q"), (F.col("e2") + 1).alias("from"), F.col("s1").alias("off")), F.col("id") == F.col("q"), "left")
    head = F.coalesce("place", F.lit(0)) == 0
    one = F.lit(1)
    return x.select(
        F.coalesce("head", "id").alias("unitig"), F.coalesce("place", F.lit(0)).cast("long").alias("ord"), "id", F.when(head, one).otherwise(F.col("from")).alias("from"),
        F.col("len").alias("to"), F.when(head, one).otherwise(F.col("off")).alias("off"),
    )


def layout_sequences(placed: DataFrame, seqs: DataFrame) -> DataFrame:
    """``unitig, n, seq``; a sequence that is missing or has another length is an error."""
    x = placed.join(seqs.select(F.col("id").alias("of"), "seq"), F.col("id") == F.col("of"), "left")
    good = F.coalesce(F.length("seq") == F.col("to"), F.lit(False))
    part = F.when(good, F.expr("substring(seq, from)")).otherwise(F.raise_error(F.concat(F.lit("no sequence of this length: "), F.col("id").cast("string"))))
    parts = F.array_sort(F.collect_list(F.struct("ord", part.alias("p"))))
    return x.groupBy("unitig").agg(F.count("*").alias("n"), F.array_join(F.transform(parts, lambda s: s["p"]), "").alias("seq"))
