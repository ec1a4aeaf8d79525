"""Descriptive statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqframe.sources.tables import written


RANGES = 256


def counted(df: DataFrame, value: str, kind: str) -> DataFrame:
    """``v, c``: distinct values and their counts; equal values are added up before anything is ordered."""
    return df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast(kind).alias("v")).agg(F.count("*").alias("c"))


def in_ranges(x: DataFrame, by: str = "v") -> DataFrame:
    """``x`` with ``part``: one of RANGES ranges of ``by`` with about as many rows each. The bounds are RANGES numbers."""
    at = [i / RANGES for i in range(1, RANGES)]
    bounds = x.agg(F.percentile_approx(by, at, 10_000).alias("b")).first().b or []
    return x.withColumn("part", F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col(by))) if bounds else F.lit(0))


def running(x: DataFrame, sums: dict[str, Column], of: Callable = F.sum, descending: bool = False) -> DataFrame:
    """``x`` (v, part) with running totals by v: inside each range, plus what the ranges before it come to.

    No task holds more than a range; the totals of the ranges, RANGES rows at most, are ordered in one.
    """
    turn = F.desc if descending else F.asc
    before = Window.orderBy(turn("p_of")).rowsBetween(Window.unboundedPreceding, -1)
    here = Window.partitionBy("part").orderBy(turn("v")).rowsBetween(Window.unboundedPreceding, 0)
    totals = x.groupBy(F.col("part").alias("p_of")).agg(*[of(c).alias(f"all_{k}") for k, c in sums.items()])
    totals = totals.select("p_of", *[of(f"all_{k}").over(before).alias(f"b_{k}") for k in sums])
    y = x.select("*", *[of(c).over(here).alias(f"i_{k}") for k, c in sums.items()]).join(F.broadcast(totals), F.col("part") == F.col("p_of"))
    both = (lambda i, b: i + F.coalesce(b, F.lit(0))) if of is F.sum else F.least
    return y.select(*x.columns, *[both(F.col(f"i_{k}"), F.col(f"b_{k}")).alias(k) for k in sums])


def weighted_values(df: DataFrame, value: str = "value") -> DataFrame:
    """Distinct values with their counts, and the rows and sum at and above each."""
    x = in_ranges(written(counted(df, value, "long"), "values"))
    return running(x, {"rank_to": F.col("c"), "sum_to": F.col("v") * F.col("c")}, descending=True).drop("part")


def n50(df: DataFrame, target: int | None = None, value: str = "value") -> DataFrame:
    """``n50, i, prior, n, total, used, mean, median, max, min``: one row, nulls when empty.

    Values are taken in descending order. n50 is the first (the i-th, prior the one before it) at which their
    sum reaches half of the total, or of ``target``; the other figures are of the values used until it reaches all.
    """
    x = written(weighted_values(df, value), "n50")
    total = x.agg(F.sum(F.col("v") * F.col("c")).alias("total"), F.sum("c").alias("n"), F.max("v").alias("top"))
    goal = F.col("total") if target is None else F.lit(target)
    y = x.join(F.broadcast(total), F.lit(True), "right").withColumn("goal", goal)
    above, rows = F.col("sum_to") - F.col("v") * F.col("c"), F.col("rank_to") - F.col("c")
    # of equal values as many are taken as it needs
    need = lambda g: rows + F.greatest(F.lit(1), F.coalesce(F.ceil(F.try_divide(g - above, F.col("v"))), F.lit(1)))
    half, whole = F.col("sum_to") * 2 >= F.col("goal"), F.col("sum_to") >= F.col("goal")
    top = lambda c, ok: F.max_by(c, F.when(ok, F.col("v")))
    z = y.groupBy("n", "total", "top", "goal").agg(
        F.max(F.when(half, F.col("v"))).alias("n50"), top(need(F.col("goal") / 2), half).alias("i"), top(need(F.col("goal")), whole).alias("stop"),
    ).withColumn("used", F.coalesce("stop", "n"))
    z = F.broadcast(z.select(F.col("n").alias("z_n"), F.col("total").alias("z_total"), "top", "n50", "i", "used"))
    y = x.join(z, F.lit(True), "right").withColumn("first", F.col("rank_to") - F.col("c"))
    taken = F.greatest(F.lit(0), F.least(F.col("c"), F.col("used") - F.col("first")))
    at = lambda p: F.max(F.when((F.col("first") < p) & (p <= F.col("rank_to")), F.col("v")))
    out = y.groupBy("z_n", "z_total", "top", "n50", "i", "used").agg(
        at(F.col("i") - 1).alias("prior"), (F.sum(taken * F.col("v")) / F.col("used")).alias("mean"),
        ((at(F.floor((F.col("used") + 1) / 2)) + at(F.floor((F.col("used") + 2) / 2))) / 2).alias("median"), at(F.col("used")).alias("min"),
    )
    return out.select("n50", F.col("i").cast("long").alias("i"), "prior", F.col("z_n").alias("n"), F.col("z_total").alias("total"), F.col("used").cast("long").alias("used"), "mean", "median", F.col("top").alias("max"), "min")


def quantile(df: DataFrame, f: float, value: str = "value") -> DataFrame:
    """``q``: the value at place f (n - 1) of the ascending order; between two places, their midpoint."""
    counts = written(counted(df, value, "double"), "values")
    upto = running(in_ranges(counts), {"to": F.col("c")})
    n = counts.agg(F.sum("c").alias("n")).select(((F.col("n") - 1) * F.lit(f)).alias("at"))
    x = upto.join(F.broadcast(n), F.lit(True))
    return x.agg(((F.min(F.when(F.col("to") > F.floor("at"), F.col("v"))) + F.min(F.when(F.col("to") > F.ceil("at"), F.col("v")))) / 2).alias("q"))


def quantile_bins(df: DataFrame, n: int, value: str = "value") -> DataFrame:
    """``bin, lo, hi, size``: at most n bins of like size; equal values share a bin, bins count from 0.

    A value begins the next bin b when at least (b + 1) n-ths of the rows lie before it; one bin begins at a
    value, so bins that a frequent value has passed are caught up at the values after it.
    """
    counts = written(counted(df, value, "double"), "values")
    x = running(in_ranges(counts), {"to": F.col("c"), "place": F.lit(1).cast("long")}).join(F.broadcast(counts.agg(F.sum("c").alias("n"))), F.lit(True))
    # f, the bins that could have begun, never falls; the bin is the least of f at a value before plus the values since
    ahead = F.floor((F.col("to") - F.col("c")) * n / F.col("n")) - F.col("place")
    y = running(written(x.withColumn("ahead", ahead), "bins"), {"least": F.col("ahead")}, of=F.min)
    return y.groupBy((F.col("least") + F.col("place")).cast("int").alias("bin")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("c").alias("size"))


def describe(df: DataFrame, value: str = "value", by: list[str] | None = None) -> DataFrame:
    """``n, mean, variance, sd, median`` (population variance; the median of an even count is the mean of the middle two)."""
    return df.groupBy(*(by or [])).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("variance"), F.stddev_pop(value).alias("sd"), F.median(value).alias("median")
    )


def least_squares(df: DataFrame, y: str, x: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def pearson(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.corr(x, y).alias("r"))


def best_key(df: DataFrame, by: list[str], key: str, value: str, largest: bool = True, seed: int | None = None) -> DataFrame:
    """The key of the largest (or least) value of each group, and that value.

    Of equals the smallest key, or with a ``seed`` any of them, by a hash: the same one each time.
    """
    turn = -F.col(value) if largest else F.col(value)
    tie = F.struct(key) if seed is None else F.struct(F.xxhash64(F.lit(seed), key).alias("h"), key)
    return df.groupBy(*by).agg(F.min_by(key, F.struct(turn, tie)).alias(key), (F.max if largest else F.min)(value).alias(value))


def argmax_key(df: DataFrame, by: list[str], key: str, value: str) -> DataFrame:
    """The key of the largest value, the smallest key of equals, and that value."""
    return best_key(df, by, key, value)


def tied_keys(df: DataFrame, by: list[str], key: str, value: str, largest: bool = True) -> DataFrame:
    """All keys of the largest (or least) value, sorted."""
    sums = df.groupBy(*by).agg((F.max if largest else F.min)(value).alias("top")).withColumnsRenamed({b: f"of_{b}" for b in by})
    on = F.lit(True)
    for b in by:
        on = on & (F.col(b) == F.col(f"of_{b}"))
    return df.join(sums, on & (F.col(value) == F.col("top"))).groupBy(*by).agg(F.array_sort(F.collect_set(key)).alias("keys"))


def tied_places(values: Column | str, largest: bool = True) -> Column:
    """The places (from 0) of the largest (or least) elements of an array, in order; null for an empty array."""
    values = F.col(values) if isinstance(values, str) else values
    best = F.array_max(values) if largest else F.array_min(values)
    places = F.filter(F.transform(values, lambda x, i: F.when(x == best, i)), lambda i: i.isNotNull())
    return F.when(F.size(values) > 0, places)


def best_place(values: Column | str, largest: bool = True, seed: int | None = None) -> Column:
    """The place (from 0) of the largest (or least) element of an array: the first of equals, or with a ``seed`` any, by a hash of the array."""
    places = tied_places(values, largest)
    which = F.lit(1) if seed is None else (F.pmod(F.xxhash64(F.lit(seed), values), F.size(places)) + 1).cast("int")
    return F.try_element_at(places, which)


def all_any(df: DataFrame, by: list[str], condition: Column) -> DataFrame:
    return df.groupBy(*by).agg(F.bool_and(condition).alias("all"), F.bool_or(condition).alias("any"))
