import random

import pytest
from pyspark.sql import functions as F

from seqframe.operators import intervals
from seqframe.operators.chunks import in_chunks, running


@pytest.fixture
def parts(spark):
    """Small chunks: seven, none of them merged."""
    kept = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", 7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    for c, v in kept.items():
        spark.conf.set(c, v)


def hot(seed, n=300):
    """Ids of which one has most rows, and a null one."""
    draw = random.Random(seed)
    return [(draw.choice(["hot"] * 8 + ["a", "b", None]), draw.randint(1, 20000), draw.choice("fr"), draw.randint(0, 5)) for _ in range(n)]


@pytest.mark.parametrize("add", [True, False])
def test_running_values_against_a_loop(parts, add):
    rows = list(dict.fromkeys(hot(1)))
    x = in_chunks(parts.createDataFrame(rows, "id string, pos long, dir string, prec long"), ["id"], ["pos", "dir", "prec"])
    assert x.where("id = 'hot'").select("chunk").distinct().count() >= 4
    got = running(x, ["id"], ["pos", "dir", "prec"], F.col("prec"), "v", add).collect()
    f = sum if add else max
    for r in got:
        before = [p for i, *key, p in rows if i == r.id and (*key, p) < (r.pos, r.dir, r.prec)]
        assert r.v == (f(before) if before else None)
    assert len(got) == len(rows)


def clusters(rows, sep):
    out = []
    for group in {(i, d) for i, _, d, _ in rows}:
        here = sorted((p, q) for i, p, d, q in rows if (i, d) == group)
        chains = [[here[0]]]
        for a, b in zip(here, here[1:], strict=False):
            if b[0] - a[0] > sep:
                chains.append([])
            chains[-1].append(b)
        out += [(group[0], *min(c, key=lambda x: (x[1], x[0])), group[1]) for c in chains]
    return out


def in_order(rows):
    return sorted(rows, key=str)


def test_clusters_of_a_hot_id(parts):
    rows = hot(2)
    x = parts.createDataFrame(rows, "id string, pos long, dir string, prec long").withColumn("len", F.lit(99999))
    got = intervals.cluster_endpoints(x, 60).select("id", "pos", "prec", "dir").collect()
    assert in_order(map(tuple, got)) == in_order(clusters(rows, 60))


def unions(rows, tail):
    """Regions of one direction in a row are joined while they touch; a region that leaves a tail moves the start."""
    out = []
    for i in {r[0] for r in rows}:
        last = None
        for _, lo, d, hi in sorted((r for r in rows if r[0] == i), key=lambda r: (r[1], -r[3], r[2])):
            if last and last["dir"] == d and lo <= last["hi"]:
                if last["hi"] - lo + 1 >= tail:
                    last["lo"] = lo
                last["hi"] = max(last["hi"], hi)
            else:
                last = {"id": i, "lo": lo, "hi": hi, "dir": d}
                out.append(last)
    return out


def test_unions_of_a_hot_id(parts):
    draw = random.Random(3)
    rows = [(i, p, "f" if draw.random() < 0.9 else "r", p + draw.randint(10, 900)) for i, p, _, _ in hot(3)]
    x = parts.createDataFrame([(i, lo, hi, d) for i, lo, d, hi in rows], "id string, lo long, hi long, dir string")
    got = intervals.union_regions(x, 300).select("id", "lo", "hi", "dir").collect()
    assert in_order(map(tuple, got)) == in_order(tuple(r.values()) for r in unions(rows, 300))


def groups(rows, distance, least):
    out = []
    for i in {r[0] for r in rows}:
        last = None
        for _, lo, hi in sorted(r for r in rows if r[0] == i) if i else sorted((r for r in rows if r[0] is None), key=lambda r: r[1:]):
            if last and lo <= last[2] + distance:
                last[2] = max(last[2], hi)
            else:
                last = [i, lo, hi]
                out.append(last)
    return [tuple(g) for g in out if g[2] - g[1] + 1 >= least]


def test_groups_of_a_hot_id(parts):
    draw = random.Random(4)
    rows = [(i, p, p + draw.randint(1, 90)) for i, p, _, _ in hot(4)]
    x = parts.createDataFrame(rows, "qry string, s2 long, e2 long")
    got = intervals.group_intervals(x, 20, 50).select("qry", "start", "end").collect()
    assert in_order(map(tuple, got)) == in_order(groups(rows, 20, 50))


def test_no_rows(parts):
    x = parts.createDataFrame([], "id string, pos long, dir string, prec long").withColumn("len", F.lit(9))
    assert intervals.cluster_endpoints(x).count() == 0
    assert intervals.union_regions(parts.createDataFrame([], "id string, lo long, hi long, dir string")).count() == 0
    assert intervals.group_intervals(parts.createDataFrame([], "qry string, s2 long, e2 long")).count() == 0
