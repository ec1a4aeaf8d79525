import random

import numpy as np
import pytest
from test_minimizers import rows_of

from seqframe.operators import graph, kmers, unitigs


def rows(df):
    return sorted(map(tuple, df.select("head", "n", "seq").collect()))


@pytest.mark.parametrize(("k", "seed"), [(5, 1), (6, 2), (13, 3), (31, 4)])
def test_packed_unitigs_equal_those_of_links(spark, monkeypatch, k, seed):
    draw = random.Random(seed)
    texts = ["".join(draw.choices("ACGT", k=draw.choice([k, 60, 200]))) for _ in range(6 if k < 10 else 25)]
    ring = "".join(draw.choices("ACGT", k=70))
    # branches, cycles over many parts and in one, palindromes, lone k-mers
    texts += [texts[3][:40] + texts[4][-40:], ring + ring[: k + 3], "A" * (k + 3), "AC" * k, "ACGT" * 3 + "ACGT"[: k % 4], "AT" * 20]
    counts = kmers.count_kmers(rows_of(spark, texts), k)
    expected = rows(graph.unitig_sequences(counts))
    assert rows(unitigs.packed_unitigs(counts, k)) == expected
    if k in (6, 13):
        monkeypatch.setattr(unitigs, "IN_ONE_TASK", 0)
        assert rows(unitigs.packed_unitigs(counts, k)) == expected


def test_paths_and_cycles_of_one_part():
    order, edges, ring = unitigs.paths_of(np.array([3, 2, -1, 5, 6, 0, 4, 7, -1]))
    paths = [(order[a:b].tolist(), bool(r)) for a, b, r in zip(edges[:-1], edges[1:], ring, strict=True)]
    assert sorted(paths) == [([0, 3, 5], True), ([1, 2], False), ([4, 6], True), ([7], True), ([8], False)]


def test_long_paths_take_few_rows(spark):
    text = "".join(random.Random(9).choices("ACGT", k=20_000))
    counts = kmers.count_kmers(rows_of(spark, [text]), 31)
    assert unitigs.stretches(counts, 31).count() < 20_000 / 2
    assert rows(unitigs.packed_unitigs(counts, 31)) == rows(graph.unitig_sequences(counts))


@pytest.mark.parametrize("k", [4, 5, 31])
def test_packed_successors_equal_those_of_a_join(spark, k):
    draw = random.Random(k)
    texts = ["".join(draw.choices("ACGT", k=90)) for _ in range(6)] + ["A" * 40, "ACGT" * 12, "N" * 50]
    counts = kmers.count_kmers(rows_of(spark, texts), k)
    df = unitigs.packed_successors(counts, k)
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, kmers.successors(counts).collect()))
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
