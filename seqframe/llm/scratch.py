"""Written intermediate tables, and the rank helper that several operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROWS_A_BUCKET = 4096
MOST_BUCKETS = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a plain local session may run without the setting; it then gets a temporary folder.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = conf.get("spark.master") or ""
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    global _LOCAL
    if _LOCAL is None:
        _LOCAL = "file://" + tempfile.mkdtemp(prefix="spark-llm-")
    return _LOCAL


_LOCAL: str | None = None


def written(df: DataFrame, name: str, parts: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and a lost executor costs nothing.

    parts: columns that become folders.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*parts) if parts else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that written() made and that nothing reads any more."""
    for df in tables:
        files = df.inputFiles()
        if files:
            _, app, rest = files[0].partition(f"/llm/{df.sparkSession.sparkContext.applicationId}/")
            folder = files[0][: len(files[0]) - len(rest)] + rest.split("/")[0]
            if app and rest:
                jvm, spark = df.sparkSession._jvm, df.sparkSession
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def row_place(df: DataFrame) -> Column | None:
    """Where a row lies in its file, as a key that every scan gives again; None unless ``df`` is a plain scan of Parquet files."""
    if "_metadata" in (c.lower() for c in df.columns):
        return None
    place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    try:
        df.select(place)
    except AnalysisException:
        return None
    return place


def buckets_for(rows: int) -> int:
    """Ranges of a uniform hash such that each holds some thousand rows, whatever the total is."""
    return int(min(MOST_BUCKETS, max(64, -(-rows // ROWS_A_BUCKET))))


def uniform(*parts: Column | str) -> Column:
    """A seeded, engine-independent hash as 32 hex digits; string order is numeric order."""
    return F.md5(F.concat_ws("#", *[p if isinstance(p, Column) else F.lit(p) for p in parts]))


def range_of(hexdigits: Column, buckets: int) -> Column:
    """The bucket, 0 to buckets-1, of a hash; buckets are consecutive ranges of it."""
    top = F.conv(F.substring(hexdigits, 1, 8), 16, 10).cast("long")
    return F.floor(top * F.lit(buckets) / F.lit(1 << 32)).cast("int")


def running(df: DataFrame, group: list[str], bucket: str, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Running totals (inclusive) of ``sums`` {new column: value column} within ``group`` by (bucket, order).

    No group is ever gathered in one task: rows are summed inside a bucket, and the totals of the
    buckets before it, one small row a bucket, are added by a join.
    """
    totals = df.groupBy(*group, bucket).agg(*[F.sum(v).alias(f"__t_{k}") for k, v in sums.items()])
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    if group:
        before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *[F.col(g).alias(f"__g_{g}") for g in group], F.col(bucket).alias("__g_bucket"),
        *[F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__b_{k}") for k in sums],
    )
    here = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = df.select("*", *[F.sum(v).over(here).alias(f"__i_{k}") for k, v in sums.items()])
    on = inside[bucket] == totals["__g_bucket"]
    for g in group:
        on = on & (inside[g] == totals[f"__g_{g}"])
    return inside.join(totals, on).select(
        *[inside[c] for c in df.columns], *[(F.col(f"__i_{k}") + F.col(f"__b_{k}")).alias(k) for k in sums]
    )
