"""Repair, layout, alignment, walks, statistics and readers against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from seqframe.functions import sequence as fn
from seqframe.operators import align, graph, intervals, kmers, overlap, relational, repair, stats
from seqframe.sources import tables

TURN = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s[::-1].translate(TURN)


def dna(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def seqs(spark, *pairs):
    return spark.createDataFrame(list(pairs), "id string, seq string")


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def end_free(a, b):
    """(distance, prefix of a, prefix of b) over all pairs of prefixes of which one is whole, by the whole table."""
    d = [[max(i, j) if 0 in (i, j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    every = [(d[i][j], j - i, i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if i == len(a) or j == len(b)]
    dist, _, i, j = min(every)
    return (dist, i, j) if dist <= int(3.5 + 0.15 * min(len(a), len(b))) else None


def loop_end(s, has, k, max_paths, found, side):
    """The correction of one end: extensions away from the k-mer in the order A, C, G, T, then the best of them."""
    if not found:
        return []
    at = found[0] if side == "L" else found[-1]
    own = s[:at] if side == "L" else s[at + k :]
    limit, paths = min(500, int(1.1 * len(own) + 10)), []
    if not own:
        return []

    def search(kmer, path):
        grown = False
        for b in "ACGT" if len(path) < limit and len(paths) <= max_paths else "":
            new = b + kmer[:-1] if side == "L" else kmer[1:] + b
            if has(new):
                grown = True
                search(new, b + path if side == "L" else path + b)
        if not grown and path:
            paths.append(path)

    search(s[at : at + k], "")
    if not paths or len(paths) > max_paths:
        return []
    turn = (lambda x: x[::-1]) if side == "L" else (lambda x: x)
    best = None
    for p in paths:
        hit = end_free(turn(own), turn(p))
        if hit and (best is None or 2 * hit[0] / (hit[1] + hit[2]) < best[0]):
            best = (2 * hit[0] / (hit[1] + hit[2]), *hit, p)
    if best is None:
        return []
    rate, dist, i, j, p = best
    if side == "L":
        return [(at - i, at, p[len(p) - j :])] if j == len(p) and dist / j <= 0.12 else []
    return [(at + k, at + k + i, p[:j])] if rate <= 0.12 else []


def loop_repair(s, table, k, max_gap, max_paths, ends=True):
    """Depth-first search in the order A, C, G, T, gap by gap."""
    has = lambda w: min(w, rc(w)) in table
    found = [i for i in range(len(s) - k + 1) if has(s[i : i + k])]
    fixes = []
    for last, i in zip(found, found[1:]):
        if not 0 < i - last - 1 <= max_gap:
            continue
        end, limit, paths = s[i : i + k], int(10 + 1.1 * (i - last)), []

        def search(path, step):
            if step == limit or len(paths) > max_paths:
                return
            if path[step:] == end:
                paths.append(path)
                return
            for b in "ACGT":
                if has(path[step + 1 :] + b):
                    search(path + b, step + 1)

        search(s[last : last + k], 0)
        if not paths or len(paths) > max_paths:
            continue
        own = s[last : i + k]
        cost = lambda p: min(edit(own, p), int(0.5 + 0.1 * max(len(own), len(p))) + 1)
        best = min(paths, key=lambda p: (cost(p), p))
        lo, hi = last + k, i
        read, path = hi - lo, len(best) - 2 * k
        if read >= 0 and path >= 0:
            fixes.append((lo, hi, best[k : k + path]))
        elif read < path:
            fixes.append((lo, lo, best[k : k + path - read]))
        else:
            fixes.append((lo, lo + read - path, ""))
    if ends:
        fixes = [*loop_end(s, has, k, max_paths, found, "L"), *fixes, *loop_end(s, has, k, max_paths, found, "R")]
    out, at = "", 0
    for lo, hi, new in fixes:
        out, at = out + s[at : max(at, lo)] + new, hi
    return out + s[at:]


def test_repair_against_a_loop(spark):
    rng = random.Random(3)
    k, truth = 7, [dna(rng, 90) for _ in range(5)]
    table = {min(w, rc(w)) for t in truth for w in (t[i : i + k] for i in range(len(t) - k + 1))}
    rows = []
    for i in range(40):
        t = list(rng.choice(truth))
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(len(t))
            t[at : at + rng.randrange(0, 2)] = rng.choice(["", "A", "C", "N", "GT"])
        rows.append((str(i), "".join(t)))
    rows += [("short", "ACG"), ("none", "A" * 30), ("empty", "")]
    counts = spark.createDataFrame([(w, 5) for w in sorted(table)], "kmer string, cnt long")
    got = {r.id: (r.seq, r.corrected) for r in repair.repair(seqs(spark, *rows), counts, k, 20, 6, ends=False).collect()}
    want = {i: loop_repair(s, table, k, 20, 6, ends=False) for i, s in rows if len(s) >= k}
    assert {i: g[0] for i, g in got.items()} == want
    assert sum(c for _, c in got.values()) > 10 and all(c or want[i] == dict(rows)[i] for i, (_, c) in got.items())


def test_ends_of_sequences_against_a_loop(spark):
    rng = random.Random(11)
    k, truth = 15, [dna(rng, 150) for _ in range(4)]
    # forks near ends, so that an end has several extensions
    truth += [truth[0][:140] + dna(rng, 10), dna(rng, 12) + truth[1][12:]]
    table = {min(w, rc(w)) for t in truth for w in (t[i : i + k] for i in range(len(t) - k + 1))}
    rows = []
    for i in range(70):
        t = rng.choice(truth)
        t = list(t[: rng.choice([100, 150, 150])])
        for at in (rng.randrange(5, 15), len(t) - rng.randrange(5, 15), rng.randrange(len(t))):
            for _ in range(rng.choice([0, 1, 1])):
                t[at : at + rng.randrange(0, 2)] = rng.choice(["", "A", "C", "N", "GT"])
        rows.append((str(i), rng.choice(["", "", "", "ACG"]) + "".join(t)))
    rows += [("none", "A" * 30), ("empty", ""), ("long", truth[0] + dna(rng, 3000))]
    counts = spark.createDataFrame([(w, 5) for w in sorted(table)], "kmer string, cnt long")
    got = {r.id: r.seq for r in repair.repair(seqs(spark, *rows), counts, k, 20, 1).collect()}
    want = {n: {i: loop_repair(s, table, k, 20, n) for i, s in rows if len(s) >= k} for n in (1, 40)}
    assert got == want[1] and want[1] != want[40]
    got = {r.id: r.seq for r in repair.repair(seqs(spark, *rows), counts, k, 20, 40).collect()}
    assert got == want[40]
    gaps = {i: loop_repair(s, table, k, 20, 40, ends=False) for i, s in rows if len(s) >= k}
    assert sum(got[i] != gaps[i] for i in got) > 20
    left = [i for i, s in rows if i in got and loop_end(s, lambda w: min(w, rc(w)) in table, k, 40, [j for j in range(len(s) - k + 1) if min(s[j : j + k], rc(s[j : j + k])) in table], "L")]
    assert len(left) > 5


def test_end_free_distances_against_the_whole_table():
    rng = random.Random(12)
    pairs = []
    for _ in range(400):
        a = dna(rng, rng.randrange(0, 40))
        b = list(a[: rng.randrange(0, 45)] + dna(rng, rng.randrange(0, 12)))
        for _ in range(rng.randrange(0, 5)):
            if b:
                at = rng.randrange(len(b))
                b[at : at + rng.randrange(0, 2)] = rng.choice(["", "A", "CG"])
        pairs.append((a, "".join(b)))
    assert repair.end_free(pairs) == [end_free(a, b) for a, b in pairs]
    assert repair.end_free([]) == [] and repair.end_free([("", ""), ("A", "")]) == [(0, 0, 0), (0, 0, 0)]


def loop_layout(rows):
    whole = lambda r: r["s1"] == 1 and r["e1"] == r["len_r"] and (r["len_r"] < r["len_q"] or r["ref"] < r["qry"])
    rows = [r for r in rows if r["e2"] >= r["s2"]]
    gone = {r["ref"] for r in rows if whole(r)}
    left, right = {}, {}
    for r in rows:
        if not whole(r) and r["ref"] != r["qry"] and (r["s1"] == 1 or r["s2"] == 1) and (r["e1"] == r["len_r"] or r["e2"] == r["len_q"]) and not {r["ref"], r["qry"]} & gone:
            (left if r["s1"] == 1 else right).setdefault(r["ref"], []).append(r)
    kept = []
    for side, key in ((left, lambda r: (-r["e1"], r["qry"])), (right, lambda r: (r["s1"], r["qry"]))):
        out = {}
        for i, rs in side.items():
            k = min(rs, key=key)["qry"]
            beyond = {x["qry"] for x in side.get(k, [])}
            out[i] = [r for r in rs if r["qry"] == k or r["qry"] not in beyond]
        kept.append(out)
    left, right = kept
    step = {i: rs[0] for i, rs in right.items() if len(rs) == 1 and len(left.get(rs[0]["qry"], [])) == 1}
    heads = {r[c] for r in rows for c in ("ref", "qry")} - gone - {r["qry"] for r in step.values()}
    out = set()
    for h in heads:
        at, place = h, 0
        out.add((h, 0, h, 1, 1))
        while at in step:
            r = step[at]
            at, place = r["qry"], place + 1
            out.add((h, place, at, r["e2"] + 1, r["s1"]))
    return out


def reads_and_rows(rng):
    """Overlapping pieces of a sequence, and the alignments of all pairs on the forward strand."""
    text = dna(rng, 600)
    pieces = [(f"p{i:02d}", i * 50, i * 50 + 100) for i in range(10)] + [("in", 120, 160), ("z1", 0, 80), ("far", 650, 700)]
    rows = []
    for a, alo, ahi in pieces:
        for b, blo, bhi in pieces:
            lo, hi = max(alo, blo), min(ahi, bhi)
            if hi - lo >= 20:
                rows.append((lo - alo + 1, hi - alo, lo - blo + 1, hi - blo, hi - lo, hi - lo, 100.0, ahi - alo, bhi - blo, 0.0, 0.0, a, b))
    rows.append((1, 100, 100, 1, 100, 100, 100.0, 100, 100, 0.0, 0.0, "p00", "p09"))
    return [(i, (text * 2)[lo:hi]) for i, lo, hi in pieces], rows


def test_layout_against_a_loop(spark):
    pieces, rows = reads_and_rows(random.Random(5))
    table = spark.createDataFrame(rows, tables.ALIGNMENT)
    placed = overlap.layout(table)
    got = {(r.unitig, r.ord, r.id, r["from"], r.off) for r in placed.collect()}
    assert got == loop_layout([r.asDict() for r in table.collect()])
    spelt = {r.unitig: r.seq for r in overlap.layout_sequences(placed, seqs(spark, *pieces)).collect()}
    text = dna(random.Random(5), 600)
    assert spelt["p00"] == text[:550] and "in" not in spelt and "z1" not in spelt
    with pytest.raises(Exception, match="no sequence of this length"):
        overlap.layout_sequences(placed, seqs(spark, *pieces[:3])).collect()


def test_alignments_of_planted_pieces(spark):
    rng = random.Random(9)
    text = dna(rng, 400)
    bad = list(text[100:300])
    bad[90] = "ACGT"[("ACGT".index(bad[90]) + 1) % 4]
    got = align.align(seqs(spark, ("r", text), ("n", "")), seqs(spark, ("f", "".join(bad)), ("b", dna(rng, 30) + rc(text[50:150])), ("x", "ACGT")))
    assert sorted((r.qry, r.s1, r.e1, r.s2, r.e2, round(r.idy, 3)) for r in got.collect()) == [("b", 51, 150, 130, 31, 100.0), ("f", 101, 300, 1, 200, 99.5)]
    best = align.best_hits(got.unionByName(got.withColumn("idy", F.lit(50.0)).withColumn("ref", F.lit("other"))))
    assert {r.ref for r in best.collect()} == {"r"} and best.count() == 2


def loop_walks(start, table, steps, left):
    has = lambda w: min(w, rc(w)) in table
    k, out = len(start), []

    def go(seq, closed, step, seen):
        at = seq[:k] if left else seq[-k:]
        why = "Orf-end" if closed == 7 else "Max-steps" if step == steps else "Cycle-detected" if at in seen else None
        nexts = [] if why else [b for b in "ACGT" if has(b + at[:-1] if left else at[1:] + b)]
        if why or not nexts:
            out.append((why or "No-extension", seq))
        for b in nexts:
            new = b + seq if left else seq + b
            stop = (new[:3] if left else new[-3:]) in ("TAA", "TAG", "TGA")
            go(new, closed | (stop << ((step + 1) % 3)), step + 1, seen | {at})

    if has(start):
        go(start, 0, 0, frozenset())
    return sorted(out)


def test_walks_both_ways_against_a_loop(spark):
    rng = random.Random(21)
    k = 7
    table = {min(w, rc(w)) for _ in range(3) for t in [dna(rng, 60)] for w in (t[i : i + k] for i in range(54))}
    counts = spark.createDataFrame([(w, 5) for w in sorted(table)], "kmer string, cnt long")
    words = rng.sample(sorted(table), 6) + ["AAAAAAA"]
    starts = spark.createDataFrame([(str(i), w) for i, w in enumerate(words)], "tag string, kmer string")
    walks = graph.walk(starts, counts, 25, direction="B")
    got = [tuple(r) for r in walks.select("tag", "dir", "reason", "seq").collect()]
    for i, w in enumerate(words):
        for side in "RL":
            assert sorted((r, s) for t, d, r, s in got if t == str(i) and d == side) == loop_walks(w, table, 25, side == "L")
    used = {r.kmer for r in graph.used_kmers(walks, counts, k).collect()}
    assert used == {min(x, rc(x)) for _, _, _, s in got for x in (s[j : j + k] for j in range(len(s) - k + 1))}


def loop_bins(values, n):
    data, out, b, prev, lo = sorted(values), [], 1, None, None
    for i, v in enumerate([*data, data[-1] + 1]):
        if prev is None:
            lo = v
        elif v != prev and i >= len(data) / n * b:
            out.append((lo, prev))
            lo, b = v, b + 1
        prev = v
    return out


def test_bins_and_n50_against_loops(spark):
    rng = random.Random(2)
    for values, n in (([1] * 10 + [2, 3, 4], 4), ([5], 3), ([rng.randrange(40) for _ in range(300)], 7), ([rng.randrange(10_000) for _ in range(900)], 4)):
        x = spark.createDataFrame([(v,) for v in values], "value long")
        assert sorted((r.lo, r.hi) for r in stats.quantile_bins(x, n).collect()) == loop_bins(values, n)
        big, t, half = sorted((v + 1 for v in values), reverse=True), 0, None
        for i, v in enumerate(big):
            t += v
            if half is None and 2 * t >= sum(big):
                half = (v, i + 1, big[i - 1] if i else None)
        r = stats.n50(x.select((F.col("value") + 1).alias("value"))).first()
        assert (r.n50, r.i, r.prior) == half and (r.n, r.total, r.used, r.max, r.min) == (len(big), sum(big), len(big), big[0], big[-1])
        assert r.mean == pytest.approx(sum(big) / len(big))
    r = stats.n50(spark.createDataFrame([(v,) for v in (9, 7, 5, 3)], "value long"), 20).first()
    assert (r.n50, r.i, r.prior, r.used, r.median, r.min) == (7, 2, 9, 3, 7, 5)


def test_sections_stay_on_the_sequence_and_need_one(spark):
    x = seqs(spark, ("c", "AACCGGTT"))
    cut = lambda *rows: [(r.start, r.end, r.seq) for r in intervals.cut_sections(x, spark.createDataFrame(list(rows), "contig string, start int, end int")).collect()]
    assert cut(("c", 20, 30)) == [(8, 8, "T")] and cut(("c", 9, 2)) == [(8, 2, "AACCGGT")] and cut(("c", -5, 1)) == [(1, 1, "A")]
    with pytest.raises(Exception, match="no sequence for d"):
        cut(("d", 1, 2))
    ends = spark.createDataFrame([("c", 500, "f", 502, 3), ("c", 500, "r", 5000, 100), ("c", 500, "f", 5000, 101)], "id string, pos int, dir string, len int, prec int")
    assert sorted(tuple(r) for r in intervals.windows_at(ends, 99, 3, 100).collect()) == [("c", 401, 502), ("c", 599, 497)]


def test_numbers_and_small_functions(spark):
    x = spark.range(1000).select((999 - F.col("id")).alias("v")).repartition(7)
    got = relational.numbered(x, ["v"], "p%04d").collect()
    assert {r.v: r.id for r in got} == {i: f"p{i + 1:04d}" for i in range(1000)}
    row = spark.range(1).select(
        fn.protein(F.lit("ATGTAAC")).alias("p"), fn.commas(F.lit(1234567)).alias("c"), fn.number_or_max(F.lit(9), 9).alias("m"), fn.stripped(F.lit("ab;"), ";").alias("s"),
        fn.first_visible(F.lit("  x")).alias("f"), fn.first_visible(F.lit(" ")).alias("n"), fn.fastq_of(F.array(F.lit(0), F.lit(10))).alias("q"), fn.true_false(F.lit(True)).alias("t"),
        fn.percent(F.lit(1), F.lit(0)).alias("z"), fn.ratio(F.lit(1), F.lit(4)).alias("r"), fn.saturated(F.lit(20_000)).alias("l"), fn.protein(F.lit("AT")).alias("e"),
    ).first()
    assert tuple(row) == ("M*", "1,234,567", "max", "ab", "x", " ", "0:", "true", 0.0, 0.25, 16383, "")


def test_padded_consensus(spark):
    assert relational.consensus(seqs(spark, ("a", "ACGT"), ("b", "ACG"), ("c", "A")), pad=True).first().seq == "ACG"
    with pytest.raises(Exception, match="differ in length"):
        relational.consensus(seqs(spark, ("a", "ACGT"), ("b", "A"))).collect()


def test_readers_and_writers(spark, tmp_path):
    def file(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    assert sorted(tuple(r) for r in tables.read_counts(spark, file("k", "aac 20000\nACG 3\n")).collect()) == [("AAC", 16383), ("ACG", 3)]
    line = "1\t2\t3\t4\t5\t6\t99.5\t{}7\t8\t1.0\t2.0\t{}a\tb\n"
    assert tuple(tables.read_alignments(spark, file("a", line.format("", ""))).first()) == (1, 2, 3, 4, 5, 6, 99.5, 7, 8, 1.0, 2.0, "a", "b")
    assert tuple(tables.read_translated(spark, file("t", line.format("1\t2\t", "1\t-1\t"))).first()) == (1, 2, 3, 4, 5, 6, 99.5, 7, 8, 1.0, 2.0, "a", "b")
    assert [r.pattern for r in tables.read_patterns(spark, file("p", " acg x\n\nTT\n")).orderBy("ord").collect()] == ["ACG", "TT"]
    assert [tuple(r)[1:] for r in tables.read_starts(spark, file("s", "t1 acgt\nt2 ACGT l\n"), 4).orderBy("ord").collect()] == [("t1", "ACGT", "R"), ("t2", "ACGT", "L")]
    with pytest.raises(Exception, match="bad start"):
        tables.read_starts(spark, file("s2", "t1 AC\n"), 4).collect()
    triangle = {(r.a, r.b): r.d for r in tables.read_lower_triangle(spark, file("l", "3\nx\ny 1\nz 2 3\n")).collect()}
    assert triangle == {("y", "x"): 1, ("x", "y"): 1, ("z", "x"): 2, ("x", "z"): 2, ("z", "y"): 3, ("y", "z"): 3}
    assert [(r.id, r.qual) for r in tables.read_quality(spark, file("q", ">r1 x\n40 40\n12\n>r2\n")).orderBy("ord").collect()] == [("r1", [40, 40, 12]), ("r2", [])]
    assert {(r.a, r.b): r.d for r in tables.read_matrix(spark, file("m", "id\tx\ty\nx\t0\t2\ny\t2\t0\n")).collect()} == {("x", "x"): 0, ("x", "y"): 2, ("y", "x"): 2, ("y", "y"): 0}
    assert tables.one_start(spark, "acg").first().kmer == "ACG"
    tables.write_counts(spark.createDataFrame([("ACG", 3)], "kmer string, cnt long"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first().value == "acg 3"
    tables.write_matrix(spark.createDataFrame([("x", "y", 0.5)], "a string, b string, d double"), str(tmp_path / "mo"), ["x", "y"])
    assert "x\t1.0\t0.5" in [r.value for r in spark.read.text(str(tmp_path / "mo")).collect()]
    tables.write_table(spark.createDataFrame([(1, "a")], "i int, s string"), str(tmp_path / "tsv"))
    assert spark.read.text(str(tmp_path / "tsv")).first().value == "1\ta"
    assert kmers.count_range(tables.read_counts(spark, str(tmp_path / "k")), 1, 5).count() == 1


def test_best_chain_against_all_subsets(spark):
    from itertools import combinations

    rng = random.Random(21)
    rows, want = [], {}
    for q in range(25):
        mine = []
        for i in range(rng.randrange(0, 9)):
            a = rng.randrange(1, 60)
            b = a + rng.randrange(0, 25)
            mine.append((1, 1 + b - a, *((a, b) if rng.random() < 0.5 else (b, a)), 1 + b - a, 1 + b - a, rng.choice([90.0, 95.5, 100.0]), f"r{i}", f"q{q}"))
        rows += mine
        span = lambda r: (min(r[2:4]), max(r[2:4]))
        apart = lambda rs: all(span(a)[1] < span(b)[0] or span(b)[1] < span(a)[0] for a, b in combinations(rs, 2))
        if mine:
            want[f"q{q}"] = max(sum(r[5] * round(r[6] * 1000) for r in rs) for n in range(1, len(mine) + 1) for rs in combinations(mine, n) if apart(rs))
    x = spark.createDataFrame(rows, "s1 int, e1 int, s2 int, e2 int, len1 int, len2 int, idy double, ref string, qry string")
    got = {}
    for r in align.best_chain(x).collect():
        got.setdefault(r.qry, []).append(r)
    assert {q: sum(r.len2 * round(r.idy * 1000) for r in rs) for q, rs in got.items()} == want
    for rs in got.values():
        at = sorted((min(r.s2, r.e2), max(r.s2, r.e2)) for r in rs)
        assert all(a[1] < b[0] for a, b in zip(at, at[1:]))
    assert align.best_chain(x.limit(0)).count() == 0
