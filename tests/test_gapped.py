import random

import numpy as np
from test_graph_operators import dna, rc, seqs

from seqframe.functions.sequence import CODE, CODONS
from seqframe.operators import gapped


def whole_table(a, b):
    """Best local alignment by the whole table: (score, s1, e1, s2, e2), places from 1."""
    score = np.zeros((len(a) + 1, len(b) + 1), int)
    came = {}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            ways = [(score[i - 1, j - 1] + (gapped.MATCH if a[i - 1] == b[j - 1] else gapped.EDIT), (i - 1, j - 1)), (score[i - 1, j] + gapped.EDIT, (i - 1, j)), (score[i, j - 1] + gapped.EDIT, (i, j - 1))]
            best = max(ways)
            if best[0] > 0:
                score[i, j], came[i, j] = best
    at = np.unravel_index(int(score.argmax()), score.shape)
    e1, e2 = at
    while at in came:
        at = came[at]
    return int(score.max()), at[0] + 1, int(e1), at[1] + 1, int(e2)


def planted(rng, t, edits):
    t = list(t)
    for _ in range(edits):
        at = rng.randrange(12, len(t) - 12)
        size = rng.randrange(1, 6)
        if rng.random() < 0.5:
            t[at : at + size] = []
        else:
            t[at:at] = rng.choice([[], list(dna(rng, size))]) or ["A"]
    return "".join(t)


def test_planted_copies_against_the_whole_table(spark):
    rng = random.Random(7)
    ref, qry, want = [], [], {}
    for i in range(16):
        t = dna(rng, 160)
        copy = planted(rng, t, rng.randrange(0, 4))
        q = dna(rng, rng.randrange(0, 60)) + copy + dna(rng, rng.randrange(0, 60))
        ref.append((f"r{i}", dna(rng, 20) + t + dna(rng, 20)))
        qry.append((f"q{i}", q if i % 2 else rc(q)))
        want[f"r{i}", f"q{i}"] = whole_table(ref[-1][1], q), i % 2, len(q)
    got = {}
    for r in gapped.align_gapped(seqs(spark, *ref), seqs(spark, *qry, ("empty", ""), ("null", None), ("odd", "N" * 80)), seed=11).collect():
        got.setdefault((r.ref, r.qry), []).append(r)
    assert set(got) == set(want)
    for key, rows in got.items():
        (score, s1, e1, s2, e2), forward, n = want[key]
        r = max(rows, key=lambda r: r.len1)
        a, b = (r.s2, r.e2) if forward else (n - r.s2 + 1, n - r.e2 + 1)
        # the same score, and ends that differ by what scores nothing at most
        columns = max(r.len1, r.len2)
        assert r.idy >= 100 * (1 - 30 / columns) and abs(r.s1 - s1) <= 3 and abs(r.e1 - e1) <= 3 and abs(a - s2) <= 3 and abs(b - e2) <= 3, (key, r, want[key])
        assert (r.s2 < r.e2) == bool(forward)


def test_between_and_beyond_against_tables():
    rng = random.Random(9)
    for _ in range(200):
        a, b = dna(rng, rng.randrange(0, 14)), dna(rng, rng.randrange(0, 14))
        table = {(i, 0): (i, 0) for i in range(len(a) + 1)} | {(0, j): (j, 0) for j in range(len(b) + 1)}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                same = a[i - 1] == b[j - 1]
                d, u, v = table[i - 1, j - 1], table[i - 1, j], table[i, j - 1]
                table[i, j] = min((d[0] + (not same), d[1] - same), (u[0] + 1, u[1]), (v[0] + 1, v[1]))
        edits, matches = table[len(a), len(b)][0], -table[len(a), len(b)][1]
        as_bytes = lambda s: np.frombuffer(s.encode(), np.uint8)
        assert gapped.between(as_bytes(a), as_bytes(b)) == (matches, matches + edits)
        score = {(i, j): 0 for i in range(len(a) + 1) for j in range(len(b) + 1)}
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                ways = [score[i - 1, j] + gapped.EDIT] if i else []
                ways += [score[i, j - 1] + gapped.EDIT] if j else []
                ways += [score[i - 1, j - 1] + (gapped.MATCH if a[i - 1] == b[j - 1] else gapped.EDIT)] if i and j else []
                score[i, j] = max(ways, default=0)
        i, k, m, c = gapped.beyond(as_bytes(a), as_bytes(b))
        assert m * gapped.MATCH + (c - m) * gapped.EDIT == max(score.values()) == score[i, k]


def test_translated_copies(spark):
    rng = random.Random(3)
    codons = [[c for c, x in zip(CODONS, CODE, strict=True) if x == y] for y in "ACDEFGHIKLMNPQRSTVWY"]
    words = rng.choices(codons, k=60)
    a, b = ("".join(rng.choice(w) for w in words) for _ in range(2))
    ref, qry = [("r", "AC" + a)], [("q", "G" + b + "TT"), ("turned", rc("G" + b + "TT"))]
    got = gapped.align_translated(seqs(spark, *ref), seqs(spark, *qry)).collect()
    rows = {(r.qry, r.ref_frame, r.qry_frame): r for r in got if r.len1 == 180}
    f, t = rows["q", 3, 2], rows["turned", 3, -2]
    assert (f.s1, f.e1, f.s2, f.e2, f.idy) == (3, 182, 2, 181, 100.0) and (t.s1, t.e1, t.s2, t.e2) == (3, 182, 182, 3)


def test_long_and_repeated_sequences(spark):
    rng = random.Random(5)
    t = dna(rng, 3000)
    got = gapped.align_gapped(seqs(spark, ("r", t)), seqs(spark, ("q", t[:1500] + t[1510:]), ("twice", t[:400] + t[:400]))).collect()
    q = [r for r in got if r.qry == "q"]
    assert [(r.s1, r.e1, r.s2, r.e2) for r in q] == [(1, 3000, 1, 2990)] and abs(q[0].idy - 100 * 2990 / 3000) < 1e-9
    twice = sorted((r.s1, r.e1, r.s2, r.e2) for r in got if r.qry == "twice")
    assert twice == [(1, 400, 1, 400), (1, 400, 401, 800)]
    assert gapped.align_gapped(seqs(spark), seqs(spark)).count() == 0
