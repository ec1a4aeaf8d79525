"""Exact de-duplication of texts by two Bloom passes.

Digests fall into groups of bounded size by ranges of their hash; each group has a filter of its own. The
first pass sets ``HASHES`` cells for each digest and keeps, one bit a cell, those that were set more than
once; equal cells are counted before they are shuffled, and no text is. The second pass tests the digests
against the filter, which is broadcast. A text that occurs twice always has all its cells set twice, so
only rows that pass can have an equal: they alone are shuffled and grouped by digest, which settles false
alarms exactly. All other rows stand alone and go straight to the result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqframe.llm.scratch import dropped, written

HASHES = 2
CELLS_A_ROW = 16
#: Rows of a group, on average: its filter has 2 bytes a row, so at most 128 MB are broadcast at any size of the table.
ROWS_A_GROUP = 1 << 26
#: Cells of one row of the filter (4 KB).
SLICE = 32768


def normalised(text: str = "text"):
    """Null as empty; each run of space, tab, line feed, vertical tab, form feed, return as one space."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_a_group: int = ROWS_A_GROUP) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    * Null or empty text: equal to every other null or empty text.
    * Of equal texts the row with the smallest id stays; null ids come after all others. Rows that also
      share the id: one of them stays.
    * An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    digests = docs.select(F.col(id_col).alias("doc_id"), F.sha2(normalised(text_col), 256).alias("text_sha256"))
    digests = written(digests.withColumn("rid", F.monotonically_increasing_id()), "digests")
    total = max(1, digests.count())
    n_groups = -(-total // rows_a_group)
    cells = SLICE
    while cells * n_groups < CELLS_A_ROW * total:
        cells *= 2
    if n_groups > 1:
        grouped = written(digests.withColumn("part", F.pmod(F.xxhash64("text_sha256", F.lit(-1)), F.lit(n_groups)).cast("int")), "groups", ["part"])
        dropped(digests)
        parts = [grouped.where(F.col("part") == i).drop("part") for i in range(n_groups)]
    else:
        parts = [digests]
    return reduce(DataFrame.unionByName, [_marked(part, cells) for part in parts])


def _marked(digests: DataFrame, cells: int) -> DataFrame:
    at = [F.xxhash64("text_sha256", F.lit(i)).bitwiseAND(F.lit(cells - 1)) for i in range(HASHES)]
    # pass 1: the cells hit more than once, as bitmaps of SLICE cells
    bloom = (
        digests.select(F.explode(F.array(*at)).alias("cell")).groupBy("cell").count().where("count > 1")
        .groupBy(F.expr(f"cast(cell div {SLICE} as int)").alias("slice")).agg(F.bitmap_construct_agg(F.col("cell") % SLICE).alias("bits"))
    )
    bloom = written(bloom, "bloom")
    # pass 2: rows with every cell set are possibly repeated
    probed = digests.withColumns({f"c{i}": a for i, a in enumerate(at)})
    hit = F.lit(True)
    for i in range(HASHES):
        side = bloom.select(F.col("slice").alias(f"s{i}"), F.col("bits").alias(f"b{i}"))
        probed = probed.join(F.broadcast(side), F.expr(f"cast(c{i} div {SLICE} as int)") == F.col(f"s{i}"), "left")
        byte = F.conv(F.hex(F.substring(F.col(f"b{i}"), (F.expr(f"c{i} % {SLICE} div 8") + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        hit = hit & F.coalesce(F.getbit(byte, F.expr(f"cast(c{i} % 8 as int)")) == 1, F.lit(False))
    probed = written(probed.select("doc_id", "rid", "text_sha256", hit.alias("maybe")), "probed")
    dropped(bloom)
    alone = probed.where(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256",
    )
    suspects = probed.where("maybe")
    first = F.min(F.struct(F.isnull("doc_id").alias("last"), "doc_id", "rid")).alias("first")
    groups = written(
        suspects.groupBy("text_sha256").agg(first, F.count("*").alias("group_size")), "groups"
    ).withColumnRenamed("text_sha256", "sha")
    settled = suspects.join(groups, F.col("text_sha256") == F.col("sha")).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size",
        (F.col("rid") == F.col("first.rid")).alias("kept"), "text_sha256",
    )
    return alone.unionByName(settled)
