"""Readers and writers of the text formats, and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqframe.functions.sequence import fasta_lines

ALIGNMENT = "s1 int, e1 int, s2 int, e2 int, len1 int, len2 int, idy double, len_r int, len_q int, cov_r double, cov_q double, ref string, qry string"
TRANSLATED = (
    "s1 int, e1 int, s2 int, e2 int, len1 int, len2 int, idy double, pct_sim double, pct_stp double, len_r int, len_q int, cov_r double, cov_q double, "
    "ref_frame int, qry_frame int, ref string, qry string"
)
_LOCAL: str | None = None


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the folder that spark.checkpoint.dir names (a temporary one in a plain local session)."""
    global _LOCAL
    spark = df.sparkSession
    conf = spark.sparkContext.getConf()
    folder, master = conf.get("spark.checkpoint.dir"), conf.get("spark.master") or ""
    if not folder:
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        _LOCAL = _LOCAL or "file://" + tempfile.mkdtemp(prefix="spark-tables-")
        folder = _LOCAL
    path = f"{folder.rstrip('/')}/tables/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``ord, id, desc, seq``, one row per record; ord follows the place in the files. gz files are read too."""
    raw = spark.read.option("lineSep", "\n>").text(path)
    body = F.regexp_replace(F.regexp_replace("value", "\r", ""), r"^\s*>", "")
    x = raw.select(F.monotonically_increasing_id().alias("ord"), body.alias("v")).where(F.trim("v") != "")
    head = F.trim(F.substring_index("v", "\n", 1))
    return x.select(
        "ord", F.regexp_extract(head, r"^(\S*)", 1).alias("id"), F.trim(F.regexp_replace(head, r"^\S*", "")).alias("desc"),
        F.regexp_replace(F.expr("substring(v, length(substring_index(v, '\n', 1)) + 1)"), r"\s", "").alias("seq"),
    )


def write_fasta(df: DataFrame, path: str, width: int = 60, first: int | None = None, skip: str = "") -> None:
    """Records as text, the sequence in lines of ``width``: its first ``first`` characters only, and none that ``skip`` has.

    A record with a null id has no header line.
    """
    desc = F.when(F.coalesce("desc", F.lit("")) != "", F.concat(F.lit(" "), "desc")).otherwise("") if "desc" in df.columns else F.lit("")
    head = F.coalesce(F.concat(F.lit(">"), F.col("id").cast("string"), desc, F.lit("\n")), F.lit(""))
    seq = F.translate("seq", skip, "") if skip else F.col("seq")
    seq = seq if first is None else F.left(seq, F.lit(first))
    df.select(F.concat(head, fasta_lines(seq, width)).alias("value")).write.text(path)


def read_counts(spark: SparkSession, path: str, limit: int = 16383) -> DataFrame:
    """``kmer, cnt``, upper case, counts saturated."""
    x = spark.read.csv(path, sep=" ", schema="kmer string, cnt long")
    return x.select(F.upper("kmer").alias("kmer"), F.least("cnt", F.lit(limit)).alias("cnt"))


def stored(rows: DataFrame, name: str, key: str = "kmer", buckets: int = 200) -> DataFrame:
    """Rows as a table of the warehouse, in buckets of ``key``, one sorted file each: joins on the key shuffle the other side only.

    Filters on counts reach its Parquet files. An older table of the name is replaced.
    """
    rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).mode("overwrite").format("parquet").saveAsTable(name)
    return rows.sparkSession.table(name)


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=ALIGNMENT)


def read_translated(spark: SparkSession, path: str) -> DataFrame:
    """Translated alignments with the columns of plain ones."""
    return spark.read.csv(path, sep="\t", schema=TRANSLATED).drop("pct_sim", "pct_stp", "ref_frame", "qry_frame")


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """``ord, pattern``: the first word of each line, upper case."""
    x = spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), F.upper(F.regexp_extract("value", r"^\s*(\S+)", 1)).alias("pattern"))
    return x.where("pattern <> ''")


def read_starts(spark: SparkSession, path: str, k: int) -> DataFrame:
    """``ord, tag, kmer, dir``; a line with less than two fields, a short k-mer or an odd direction is an error."""
    x = spark.read.text(path).where(F.trim("value") != "").select(F.monotonically_increasing_id().alias("ord"), F.split(F.trim("value"), r"\s+").alias("f"))
    d = F.upper(F.coalesce(F.try_element_at("f", F.lit(3)), F.lit("R")))
    good = (F.size("f") >= 2) & (F.length(F.try_element_at("f", F.lit(2))) >= k) & d.isin("L", "R", "B")
    checked = F.when(good, F.upper(F.try_element_at("f", F.lit(2)))).otherwise(F.raise_error(F.concat(F.lit("bad start: "), F.array_join("f", " "))))
    return x.select("ord", F.col("f")[0].alias("tag"), checked.alias("kmer"), d.alias("dir"))


def read_lower_triangle(spark: SparkSession, path: str) -> DataFrame:
    """``a, b, d`` in both directions from a lower-triangular distance file: a count, then a name and the distances to the names above.

    The place of a name is the number of distances it has, so no row is numbered.
    """
    x = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f"))
    x = x.where("size(f) > 1 or try_cast(f[0] as int) is null").where("f[0] <> ''").select(F.col("f")[0].alias("a"), F.expr("slice(f, 2, size(f))").alias("ds"))
    names = x.select(F.size("ds").alias("j"), F.col("a").alias("b"))
    rows = x.select("a", F.posexplode("ds").alias("p", "d")).join(names, F.col("p") == F.col("j"))
    half = rows.select("a", "b", F.col("d").cast("double").alias("d"))
    return half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))


def read_quality(spark: SparkSession, path: str) -> DataFrame:
    """``ord, id, qual``: numbers in white space under headers, as array<int>."""
    raw = spark.read.option("lineSep", "\n>").text(path)
    x = raw.select(F.monotonically_increasing_id().alias("ord"), F.regexp_replace(F.regexp_replace("value", "\r", ""), r"^\s*>", "").alias("v")).where(F.trim("v") != "")
    body = F.trim(F.regexp_replace(F.expr("substring(v, length(substring_index(v, '\n', 1)) + 1)"), r"\s+", " "))
    head = F.regexp_extract(F.trim(F.substring_index("v", "\n", 1)), r"^(\S*)", 1)
    return x.select("ord", head.alias("id"), F.when(body == "", F.array().cast("array<int>")).otherwise(F.split(body, " ").cast("array<int>")).alias("qual"))


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """``a, b, d`` in long form from a tab-separated square matrix with names in its first row and column."""
    x = spark.read.csv(path, sep="\t", header=True)
    first, rest = x.columns[0], x.columns[1:]
    return x.unpivot([first], rest, "b", "d").select(F.col(first).alias("a"), "b", F.col("d").cast("double").alias("d"))


def one_start(spark: SparkSession, kmer: str, tag: str = "walk_string") -> DataFrame:
    """A list of starts with one k-mer, upper case."""
    return spark.range(1).select(F.col("id").alias("ord"), F.lit(tag).alias("tag"), F.lit(kmer.upper()).alias("kmer"), F.lit("R").alias("dir"))


def write_table(df: DataFrame, path: str) -> None:
    """Rows with tabs between fields."""
    df.write.csv(path, sep="\t")


def write_counts(counts: DataFrame, path: str) -> None:
    """K-mers in lower case and their counts, as a count table."""
    counts.select(F.lower("kmer").alias("kmer"), "cnt").write.csv(path, sep=" ")


def write_matrix(distances: DataFrame, path: str, names: list[str], missing: float = 1.0) -> None:
    """The dense square matrix of ``names``; names is a parameter, as every row has a column for each."""
    x = distances.where(F.col("a").isin(names)).groupBy("a").pivot("b", names).agg(F.min("d")).na.fill(missing)
    x.write.csv(path, sep="\t", header=True)


def write_parts(df: DataFrame, level: str, path: str) -> None:
    """One folder for each value of ``level``."""
    df.write.partitionBy(level).parquet(path)
