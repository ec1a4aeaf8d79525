"""Running values over rows in order, where one id may hold any share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqframe.sources.tables import written

EARLIER = (Window.unboundedPreceding, -1)


def in_chunks(rows: DataFrame, ids: list[str], order: list) -> DataFrame:
    """Rows with ``chunk``: consecutive ranges of all rows by ids and order, of about equal size. Equal rows share a chunk.

    Written, since bounds that are sampled again might differ.
    """
    return written(rows.repartitionByRange(*ids, *order).withColumn("chunk", F.spark_partition_id()), "chunks")


def running(rows: DataFrame, ids: list[str], order: list, value: Column, name: str, add: bool = False) -> DataFrame:
    """Rows with ``name``: the largest ``value`` (add: the sum of values) of the rows before in the order of their ids; null where none.

    Chunks run by themselves; what an id brings from earlier chunks is one row a chunk. Only ids in several chunks have such
    rows, two a chunk at most, which bounds the broadcast. Null ids are one id.
    """
    f = F.sum if add else F.max
    own = f(value).over(Window.partitionBy(*ids, "chunk").orderBy(*order).rowsBetween(*EARLIER))
    sums = rows.groupBy(*ids, "chunk").agg(f(value).alias("v"))
    sums = sums.withColumn("earlier", f("v").over(Window.partitionBy(*ids).orderBy("chunk").rowsBetween(*EARLIER))).where("earlier is not null")
    names = [*ids, "chunk"]
    sums = sums.select(*[F.col(c).alias(f"of_{c}") for c in names], "earlier")
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"of_{c}"))
    both = rows.withColumn("own", own).join(F.broadcast(sums), same, "left")
    whole = F.coalesce(F.col("own") + F.col("earlier"), "own", "earlier") if add else F.greatest("own", "earlier")
    return both.withColumn(name, whole).drop("own", "earlier", *[f"of_{c}" for c in names])
