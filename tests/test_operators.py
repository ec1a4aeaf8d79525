import random

import pytest
from pyspark.sql import functions as F

from seqframe.functions import sequence as fn
from seqframe.functions.sequence import canonical, is_stop, reverse_complement, translate_codon
from seqframe.operators import cluster, graph, intervals, kmers, relational, scans, stats
from seqframe.sources import tables


def seqs(spark, *pairs):
    return spark.createDataFrame(list(pairs), "id string, seq string")


def test_reverse_complement_twice_is_the_same(spark):
    x = spark.createDataFrame([("ACGTNacgtnRYKM-.",), ("",)], "s string")
    assert all(r.s == r.t for r in x.select("s", reverse_complement(reverse_complement("s")).alias("t")).collect())
    assert x.select(reverse_complement(F.lit("AXC")).alias("r")).first().r == "GNT"


def test_canonical_and_codons(spark):
    x = spark.createDataFrame([("TTTAA",), ("ACGT",)], "s string").select(canonical("s").alias("c")).collect()
    assert [r.c for r in x] == ["TTAAA", "ACGT"]
    y = spark.createDataFrame([("ATG",), ("taa",), ("NNN",)], "s string").select(translate_codon("s").alias("a"), is_stop("s").alias("b")).collect()
    assert [(r.a, r.b) for r in y] == [("M", False), ("*", True), ("X", False)]


def test_kmers_leave_out_other_letters_and_short_sequences(spark):
    got = {r.kmer: r.cnt for r in kmers.count_kmers(seqs(spark, ("a", "ACGNACG"), ("b", "AC"), ("c", "")), 3).collect()}
    assert got == {"ACG": 2}


def test_end_clusters_join_500_and_part_501(spark):
    x = spark.createDataFrame([("c", 100, "f", 9000, 5), ("c", 600, "f", 9000, 5), ("c", 1101, "f", 9000, 1), ("c", 0, "f", 9000, 0), ("c", 9001, "f", 9000, 0)], "id string, pos long, dir string, len long, prec long")
    assert sorted(r.pos for r in intervals.cluster_endpoints(x).collect()) == [100, 1101]


def brute_union(rows, tail=500):
    out = []
    for i, lo, hi, d in sorted(rows, key=lambda r: (r[0], r[1], -r[2], r[3])):
        if not out or out[-1][0] != i or out[-1][3] != d or out[-1][2] < lo:
            out.append([i, lo, hi, d])
        else:
            if tail <= 1 + out[-1][2] - lo:
                out[-1][1] = lo
            out[-1][2] = max(out[-1][2], hi)
    return sorted(map(tuple, out))


def test_region_union_against_a_loop(spark):
    rng = random.Random(3)
    rows = [(f"c{rng.randrange(4)}", lo := rng.randrange(20000), lo + rng.randrange(1500), rng.choice("fr")) for _ in range(400)]
    rows = sorted({(r[0], r[1]): r for r in rows}.values())
    got = intervals.union_regions(spark.createDataFrame(rows, "id string, lo long, hi long, dir string"))
    assert sorted((r.id, r.lo, r.hi, r.dir) for r in got.collect()) == brute_union(rows)


def test_interval_groups_at_the_limits(spark):
    x = spark.createDataFrame([("q", 1, 1000), ("q", 2000, 1100), ("p", 1, 1999), ("o", 1, 2000)], "qry string, s2 long, e2 long")
    assert sorted((r.qry, r.start, r.end) for r in intervals.group_intervals(x).collect()) == [("o", 1, 2000), ("q", 1, 2000)]


def test_cut_sections_reads_the_other_strand(spark):
    got = intervals.cut_sections(seqs(spark, ("c", "AACCGGTT")), spark.createDataFrame([("c", 1, 3), ("c", 4, 2)], "contig string, start int, end int"), 1)
    assert sorted((r.start, r.end, r.seq) for r in got.collect()) == [(1, 4, "AACC"), (5, 1, "CGGTT")]


@pytest.mark.parametrize("rows,kept", [([("a", "b"), ("b", "c")], {"c"}), ([("a", "b"), ("b", "a")], {"a"}), ([("a", "a")], {"a"}), ([("a", "b"), ("a", "c")], {"b", "c"})])
def test_inclusions(spark, rows, kept):
    x = spark.createDataFrame([(b, a, 100.0, 100.0) for a, b in rows], "ref string, qry string, idy double, cov_q double")
    assert {r.id for r in graph.remove_inclusions(x).collect()} == kept


def test_chains_break_cycles_at_the_smallest(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "z"), ("z", "x"), *[(f"r{i}", f"r{(i + 1) % 4}") for i in range(4)], ("o", "o"), ("c", "d"), ("c", "e")], "src string, dst string")
    got = {r.node: (r.head, r.place) for r in graph.chains(links).collect()}
    assert got["c"] == ("a", 2) and got["d"] == ("d", 0) and got["x"] == ("x", 0) and got["z"] == ("x", 2) and got["r3"] == ("r0", 3) and got["o"] == ("o", 0)


def test_walk_reasons(spark):
    counts = kmers.count_kmers(seqs(spark, ("a", "AACCAGAGCC"),), 5)
    starts = spark.createDataFrame([("s", "AACCA"), ("none", "GGGGG")], "tag string, kmer string")
    got = graph.walk(starts, counts, 20).collect()
    assert [(r.tag, r.reason, r.seq) for r in got] == [("s", "No-extension", "AACCAGAGCC")]
    assert graph.walk(starts, counts, 3).collect()[0].reason == "Max-steps"
    hit = graph.walk(starts, counts, 20, ["AGA"]).collect()[0]
    assert (hit.reason, hit.detail, hit.seq) == ("Hit-stop-pattern", "AGA", "AACCAGA")


def frame_loop(s):
    m = [0, 1, 2]
    for p in range(3, len(s) + 1):
        m.append(min(1 + m[p - 1], 2 + m[p - 2], (3 if s[p - 3 : p] in ("TAA", "TAG", "TGA") else 0) + m[p - 3]))
    return m[len(s)]


def test_frame_score_against_a_loop(spark):
    rng = random.Random(5)
    rows = [(str(i), "".join(rng.choice("ACGT") for _ in range(rng.randrange(0, 60)))) for i in range(60)]
    got = seqs(spark, *rows).select("id", scans.frame_score("seq").alias("v")).collect()
    assert {r.id: r.v for r in got} == {i: frame_loop(s) for i, s in rows}


def test_stats_on_empty_and_small(spark):
    none = spark.createDataFrame([], "value long")
    assert stats.n50(none).first().n50 is None and stats.quantile(none, 0.5).first().q is None
    x = spark.createDataFrame([(1,), (2,), (3,), (10,)], "value long")
    assert stats.n50(x).first().n50 == 10 and stats.quantile(x, 0.5).first().q == 2.5


def test_primers_and_consensus(spark):
    got = relational.primer_pairs(seqs(spark, ("a", "ACGTTTTTGGCC")), ["ACG"], ["GGC"]).collect()
    assert [(r.lo, r.hi) for r in got] == [(1, 12)]
    block = seqs(spark, ("a", "AC-T"), ("b", "AG-T"), ("c", "TC-A"))
    assert relational.consensus(block).first().seq == "ACT"


def test_fasta_round_trip(spark, tmp_path):
    x = spark.createDataFrame([("a", "first >x", "ACGT" * 40), ("b", "", "AC")], "id string, desc string, seq string")
    tables.write_fasta(x.coalesce(1), f"{tmp_path}/f")
    got = tables.read_fasta(spark, f"{tmp_path}/f").orderBy("ord").collect()
    assert [(r.id, r.desc, r.seq) for r in got] == [("a", "first >x", "ACGT" * 40), ("b", "", "AC")]


def loop_linkage(ids, d, height, nearer):
    """Merges the nearest pair of all until the height; a group is named by its least member."""
    groups = {i: [i] for i in ids}
    far = lambda a, b: max(d.get((min(x, y), max(x, y)), 9) for x in groups[a] for y in groups[b])
    while True:
        every = [(far(a, b), nearer[a, b], a, b) for a in groups for b in groups if a < b]
        if not every or min(every)[0] > height:
            return groups
        _, _, a, b = min(every)
        groups[a] += groups.pop(b)


@pytest.mark.parametrize("places", [1, 3])
def test_complete_linkage_against_a_loop(spark, places):
    rng = random.Random(places)
    ids = [f"n{i:02d}" for i in range(40)]
    at = {i: (rng.random(), rng.random()) for i in ids}
    d = {(a, b): round(((at[a][0] - at[b][0]) ** 2 + (at[a][1] - at[b][1]) ** 2) ** 0.5, places) for a in ids for b in ids if a < b}
    d = {k: v for k, v in d.items() if rng.random() < 0.9 and v < 0.5}
    pairs = spark.createDataFrame([(a, b) for a in ids for b in ids if a < b], "a string, b string")
    nearer = {(r.a, r.b): r.h for r in pairs.select("a", "b", F.xxhash64("a", "b").alias("h")).collect()}
    groups = loop_linkage(ids, d, 0.4, nearer)
    rows = [(a, b, v) for (a, b), v in d.items()] + [(b, a, v) for (a, b), v in d.items()] + [(i, i, 0.0) for i in ids]
    got = cluster.cluster(spark.createDataFrame(rows, "a string, b string, d double"), 0.4).collect()
    apart = lambda a, b: 0.0 if a == b else d[min(a, b), max(a, b)]
    want = []
    for g in groups.values():
        centre = min(g, key=lambda a: (sum(round(apart(a, b) * 10**9) for b in g), a))
        want.append((centre, " ".join(sorted(g)), len(g)))
    assert sorted(map(tuple, got)) == sorted(want) and max(w[2] for w in want) > 2


def test_inclusions_against_closures(spark):
    rng = random.Random(8)
    rows = []
    for g in range(60):
        n = rng.randrange(1, 9)
        names = [f"g{g}x{rng.randrange(100)}y{i}" for i in range(n)]
        rows.append((names[0], names[0], 100.0))
        rows += [(rng.choice(names), rng.choice(names), rng.choice([100.0, 100.0, 90.0])) for _ in range(rng.randrange(0, 2 * n))]
    rows += [(f"chain{i:03d}", f"chain{i + 1:03d}", 99.0) for i in range(40)] + [("hub", f"spoke{i}", 99.0) for i in range(50)] + [(f"ring{i}", f"ring{(i + 1) % 17}", 99.0) for i in range(17)]
    ids = {x for r in rows for x in r[:2]}
    to = {i: {b for a, b, v in rows if a == i and v >= 95} for i in ids}

    def reach(i):
        seen, todo = set(), [i]
        while todo:
            new = to[todo.pop()] - seen
            seen |= new
            todo += new
        return seen

    far = {i: reach(i) for i in ids}
    want = {a for a in ids if not any(b != a and (a not in far[b] or b < a) for b in far[a])}
    x = spark.createDataFrame([(b, a, v, 100.0) for a, b, v in rows], "ref string, qry string, idy double, cov_q double")
    got = [r.id for r in graph.remove_inclusions(x).collect()]
    assert sorted(got) == sorted(want)


def test_complete_linkage(spark):
    near = {("a", "b"): 0.01, ("b", "c"): 0.015, ("a", "c"): 0.03, ("d", "e"): 0.02}
    rows = [(a, b, d) for (a, b), d in near.items()] + [(b, a, d) for (a, b), d in near.items()] + [(x, x, 0.0) for x in "abcdef"]
    got = cluster.cluster(spark.createDataFrame(rows, "a string, b string, d double")).collect()
    assert sorted((r.members, r.centroid) for r in got) == [("a b", "a"), ("c", "c"), ("d e", "d"), ("f", "f")]


def test_places_and_keys_of_extremes(spark):
    rows = [(1, [3.0, 1.0, 3.0, 1.0]), (2, [5.0]), (3, []), (4, None)]
    x = spark.createDataFrame(rows, "g int, q array<double>")
    got = {r.g: tuple(r)[1:] for r in x.select("g", stats.best_place("q", False), stats.best_place("q"), stats.tied_places("q", False), stats.best_place("q", seed=4)).collect()}
    assert got[1][:3] == (1, 0, [1, 3]) and got[1][3] in (0, 2) and got[2] == (0, 0, [0], 0) and got[3] == (None,) * 4 == got[4]
    seen = {r[0] for r in spark.range(60).select(stats.best_place(F.array(F.lit(7), F.lit(7), F.col("id") * 0 - F.col("id")), seed=1)).collect()}
    assert seen == {0, 1}
    keys = spark.createDataFrame([(1, k, v) for k, v in enumerate([4, 2, 4, 2, 3])], "g int, k int, v int")
    assert tuple(stats.best_key(keys, ["g"], "k", "v", largest=False).first()) == (1, 1, 2)
    assert stats.best_key(keys, ["g"], "k", "v", seed=3).first().k in (0, 2)
    assert stats.tied_keys(keys, ["g"], "k", "v", largest=False).first()["keys"] == [1, 3]


def test_small_functions(spark):
    x = spark.createDataFrame([(True, None, 3), (False, 2, 5)], "b boolean, x int, y int")
    got = x.select(fn.true_letter("b"), fn.or_none("x"), fn.smaller("x", "y"), fn.larger("x", "y")).collect()
    assert [tuple(r) for r in got] == [("T", "none", 3, 3), ("F", "2", 2, 5)]
    n = spark.range(20_000).select(fn.about_normal(5).alias("z")).agg(F.avg("z").alias("m"), F.var_pop("z").alias("v"), F.max(F.abs("z")).alias("top")).first()
    assert abs(n.m) < 0.05 and abs(n.v - 1) < 0.05 and n.top <= 6


def test_first_characters_and_skipped_ones_are_written(spark, tmp_path):
    x = spark.createDataFrame([("a", "AC-GT--ACGT"), (None, "GGG")], "id string, seq string").coalesce(1)
    tables.write_fasta(x, str(tmp_path / "f"), 3, first=5, skip="-")
    text = "".join(p.read_text() for p in (tmp_path / "f").glob("part-*"))
    assert text == ">a\nACG\nTA\nGGG\n"


def test_stop_fraction_limit(spark):
    x = seqs(spark, ("stops", "TAATTA" * 3), ("free", "GCCGCCGCC"))
    assert {r.id for r in scans.best_frame(x).collect()} == {"stops", "free"} and [r.id for r in scans.best_frame(x, 0.1).collect()] == ["free"]
