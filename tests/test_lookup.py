import random

import pytest
from pyspark.sql import functions as F
from test_minimizers import rows_of

from seqframe.operators import kmers, lookup


@pytest.fixture(scope="module")
def odd(spark):
    draw = random.Random(7)
    texts = ["".join(draw.choices("ACGT", k=120)) for _ in range(6)]
    texts += [t[:60] + draw.choice("ACGTN") + t[61:] for t in texts for _ in range(3)]
    texts += ["", "ACG", "A" * 300, "AC" * 90, texts[0][:31], texts[1] + "N" + texts[2], "N" + texts[3] + "N", None]
    return rows_of(spark, texts).repartition(3)


@pytest.mark.parametrize(("k", "lo"), [(31, 2), (5, 3), (6, 1), (21, 4)])
def test_packed_lookups_equal_plain_ones(spark, odd, k, lo):
    counts = kmers.count_kmers(odd, k, lo)
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect())) and a.dtypes == b.select(*a.columns).dtypes
    assert same(lookup.packed_alternatives(odd, counts, k), kmers.alternatives(odd, counts, k))
    assert same(lookup.packed_confirmed(odd, counts, k), kmers.confirmed(odd, counts, k))
    plain = kmers.trace(odd, counts, k).groupBy("id").agg(
        F.count("*").alias("n"), F.count_if(F.col("cnt") > 0).alias("matched"), F.sum("cnt").alias("total"), F.sum(F.coalesce(F.size("alts"), F.lit(0))).cast("long").alias("n_alts"))
    assert same(lookup.trace_totals(odd, counts, k), plain)


def test_names_as_ids_and_small_lots(spark, odd, monkeypatch):
    named = odd.select(F.concat(F.lit("s"), "id").alias("id"), "seq")
    counts = kmers.count_kmers(odd, 11, 2)
    assert sorted(map(tuple, lookup.packed_confirmed(named, counts, 11).collect())) == sorted(map(tuple, kmers.confirmed(named, counts, 11).collect()))


def test_one_shuffle_of_packed_texts(spark, odd):
    counts = kmers.count_kmers(odd, 31, 2)
    plan = lookup.packed_alternatives(odd, counts, 31)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 2 and "Join" not in plan  # of the counts, and this one
    long = rows_of(spark, ["".join(random.Random(8).choices("ACGT", k=100_000))] * 10)
    size = lookup.context_runs(long, 31, False).agg(F.sum(F.length("letters") + F.length("sizes") + F.length("places") + F.length("flags") + 8 * F.size("ids"))).first()[0]
    assert size < 2.6 * 1_000_000
