import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqframe.operators import kmers, minimizers
from seqframe.sources import tables

OPPOSITE = str.maketrans("ACGT", "TGCA")


def brute(texts, k):
    words = [t[i : i + k] for t in texts for i in range(len(t) - k + 1)]
    return Counter(min(w, w[::-1].translate(OPPOSITE)) for w in words if not set(w) - set("ACGT"))


def rows_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, seq string")


@pytest.mark.parametrize(("k", "spread"), [(3, 1), (12, 1), (31, 1), (31, 3), (71, 1)])
def test_counts_against_a_loop(spark, k, spread):
    draw = random.Random(k)
    texts = ["".join(draw.choices("ACGT", k=draw.choice([0, 5, 40, 400]))) for _ in range(30)]
    texts += texts[:5] * 3 + [t[::-1].translate(OPPOSITE) for t in texts[5:15]] + ["A" * 300, "N" * 50 + "ACGTNacgt" + "é" + texts[3] + "\n" + texts[4], ""]
    got = {r.kmer: r.cnt for r in kmers.count_kmers(rows_of(spark, [*texts, None]), k, spread=spread).collect()}
    assert got == brute(texts, k)


def test_no_rows(spark):
    assert kmers.count_kmers(rows_of(spark, []), 31).count() == 0


def test_texts_longer_than_a_piece(spark):
    draw = random.Random(1)
    text = "".join(draw.choices("ACGT", k=minimizers.PIECE + 1000))
    got = kmers.count_kmers(rows_of(spark, [text]), 31).agg(F.sum("cnt"), F.count("*")).first()
    assert tuple(got) == (len(text) - 30, len(brute([text], 31)))


def test_least_of_windows():
    x = np.array([5, 3, 9, 1, 7, 2, 8], np.uint32)
    for width in range(1, 8):
        assert minimizers.window_least(x, width).tolist() == [min(x[i : i + width]) for i in range(8 - width)]


def test_copies_are_one_row_of_a_batch_and_runs_are_short(spark):
    draw = random.Random(2)
    text = "".join(draw.choices("ACGT", k=20000))
    runs = minimizers.minimizer_runs(rows_of(spark, [text] * 50).coalesce(1), 31).agg(F.sum("n"), F.sum(F.length("run")), F.count("*")).first()
    assert runs[1] < 5 * len(text) * 2  # 50 copies fill one piece, and a bit of the text may be cut at its end
    assert runs[0] == 50 * runs[2]


def test_one_shuffle_of_runs(spark):
    plan = kmers.count_kmers(rows_of(spark, ["ACGT"]), 31)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_COL" in plan


def test_trace_against_a_loop(spark):
    draw = random.Random(3)
    texts = ["".join(draw.choices("ACGT", k=60)) for _ in range(4)]
    texts += [t[:30] + "N" + t[31:] for t in texts[:2]] + [texts[0][:20] + "A" + texts[0][21:]]
    k, table = 7, brute(texts[:4], 7)
    both = table | {w[::-1].translate(OPPOSITE): n for w, n in table.items()}
    expected = set()
    for i, t in enumerate(texts):
        for p in range(len(t) - k + 1):
            w = t[p : p + k]
            if set(w) - set("ACGT"):
                expected.add((i, p + 1, w, 0, ()))
                continue
            alts = [("L", b, both[b + w[1:]]) for b in "ACGT" if b != w[0] and b + w[1:] in both]
            alts += [("R", b, both[w[:-1] + b]) for b in "ACGT" if b != w[-1] and w[:-1] + b in both]
            expected.add((i, p + 1, w, both.get(w, 0), tuple(alts)))
    got = kmers.trace(rows_of(spark, texts), kmers.count_kmers(rows_of(spark, texts[:4]), k), k).collect()
    assert {(r.id, r.pos, r.kmer, r.cnt, tuple(map(tuple, r.alts or []))) for r in got} == expected
    assert len(got) == len(expected)


def test_stored_counts_are_not_shuffled(spark):
    draw = random.Random(4)
    texts = rows_of(spark, ["".join(draw.choices("ACGT", k=500)) for _ in range(5)])
    counts = kmers.count_kmers(texts, 15)
    with_filter = kmers.count_range(tables.stored(counts, "stored_counts", buckets=3), 1, 9)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        near = tables.stored(kmers.neighbourhoods(counts), "stored_near", buckets=3)
        for rows, exchanges in ((kmers.confirmed(texts, with_filter, 15), 2), (kmers.traced(texts, near, 15), 1)):
            assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange") == exchanges  # positions, and their sums by id
        assert "GreaterThanOrEqual(cnt,1)" in kmers.confirmed(texts, with_filter, 15)._jdf.queryExecution().executedPlan().toString()
        assert {r.missing for r in kmers.confirmed(texts, with_filter, 15).collect()} == {0}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop table if exists stored_counts")
        spark.sql("drop table if exists stored_near")
