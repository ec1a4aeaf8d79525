"""Sharding by proportional stratified interleaving.

Rows are shuffled within their source by a seeded hash and get the fractional rank (rank - 1/2) / rows
of the source. In the order of this fraction every source is spread evenly, so cutting the order into
equal runs gives shards that all have the mixture of the whole table and row counts at most one apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqframe.llm.scratch import buckets_for, range_of, row_place, running, uniform, written

LAW = "rows"


def assign_shards(docs: DataFrame, shards: int = 40, seed: str = "shard", id_col: str = "doc_id",
                  source_col: str = "source") -> DataFrame:
    """All columns of ``docs`` plus ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard).

    Columns of ``docs`` named shard or slot are replaced. A null source is a source of its own; rows with
    a null id hash by row. Rows that agree in id and source are interchangeable; equal texts are rows like
    others, and nothing keeps them together. With fewer rows than shards, some shards stay empty; an empty
    table gives an empty result. Only row numbers are ranked; whole rows are shuffled once, to meet their
    places. Rows of a plain Parquet scan are known by their place in the files, others are written once to be known.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    keep = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    place = row_place(docs)
    kept = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n")).alias("src"),
        F.col(id_col).cast("string").alias("id"), (F.monotonically_increasing_id() if place is None else place).alias("rid"),
    )
    if place is None:
        kept = written(kept, "rows")
    rows = kept.select("rid", "src", uniform(seed, F.coalesce("id", F.concat(F.lit("row "), F.col("rid").cast("string")))).alias("h"), "id", F.lit(1).cast("long").alias("one"))
    total = docs.count()
    n = buckets_for(total)
    sizes = rows.groupBy("src").agg(F.count("*").alias("n_src")).withColumnRenamed("src", "src_of")
    rows = rows.withColumn("b", range_of(F.col("h"), n))
    ranked = running(rows, ["src"], "b", [F.col("h"), F.col("id"), F.col("rid")], {"rank": "one"})
    ranked = ranked.join(sizes, F.col("src") == F.col("src_of"))
    ranked = ranked.withColumn("f", (F.col("rank") - F.lit(0.5)) / F.col("n_src"))
    ranked = ranked.withColumn("g", F.least(F.lit(n - 1), F.floor(F.col("f") * n)).cast("int"))
    placed = running(ranked.select("rid", "one", "src", "h", "f", "g"), [], "g", [F.col("f"), F.col("src"), F.col("h"), F.col("rid")], {"pos": "one"})
    pos = F.col("pos") - 1
    shard = F.expr(f"(pos - 1) * {shards}L div {max(1, total)}L")
    first = F.expr(f"(shard * {max(1, total)}L + {shards - 1}L) div {shards}L")
    placed = placed.withColumn("shard", shard).select(F.col("rid").alias("of"), F.col("shard").cast("int").alias("shard"), (pos - first).alias("slot"))
    return kept.select("rid", "row").join(placed, F.col("rid") == F.col("of")).select("row.*", "shard", "slot")


def shard_table(docs: DataFrame, shards: int = 40) -> DataFrame:
    """The rows that the sharding query returns: sizes and checksums instead of texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(
        "doc_id", "source", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    out = assign_shards(slim, shards)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
