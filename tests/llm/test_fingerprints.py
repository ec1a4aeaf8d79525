import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqframe.llm import fingerprints as fp

SQL = "doc_id long, text string"
MARKS = r"[\s!-/:-@\[-`{-~]+"


def words(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D!-/:-@\[-`{-~]+", text) if w]


def chains(text, common):
    """Signatures as tuples of words."""
    w = words(text)
    out = {("", *w[: fp.CHAIN])} if w else set()
    rest: tuple = ()
    for x in reversed(w):
        if x in common:
            out |= {(x, *rest)} if len(rest) == fp.CHAIN else set()
        else:
            rest = (x, *rest)[: fp.CHAIN]
    return out


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def plain(rows):
    """(id, n_chars, edited_sha256, near_edited, near_next) by a loop; ties by the order given."""
    every = Counter(w for _, t in rows for w in words(t))
    common = {w for w, n in every.items() if n >= fp.COMMON * sum(every.values())}
    out = []
    for i, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(text) // 3
        e = text[: len(text) - k] + after[:k]
        s = chains(text, common)
        out.append((doc, len(text), hashlib.sha256(e.encode()).hexdigest(), round(jaccard(s, chains(e, common)), 9), round(jaccard(s, chains(after, common)), 9)))
    return out


def shown(got):
    return [(r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got]


def order(r):
    return tuple((x is None, x) for x in r)


@pytest.mark.parametrize("rows_a_range", [2000, 7])
def test_fingerprints_against_a_loop(spark, data, monkeypatch, rows_a_range):
    monkeypatch.setattr(fp, "ROWS_A_RANGE", rows_a_range)
    monkeypatch.setattr(fp, "CHARS_AT_ONCE", 20_000)
    table = spark.read.parquet(f"{data}/documents.parquet")
    rows = sorted(((r.doc_id, r.text) for r in table.collect()), key=lambda r: -r[0])
    got = fp.fingerprint_table(table.repartition(5)).collect()
    assert sorted(shown(got), key=order) == sorted(plain(rows), key=order)
    assert sum(r.near_edited for r in got) / len(got) > 0.3
    by, text = {}, dict(rows)
    for r in got:
        by.setdefault(text[r.doc_id], set()).add(r.fingerprint)
        s = fp.unpacked(r.fingerprint)
        assert fp.packed(s) == r.fingerprint and r.near_edited == fp.likeness(s, fp.unpacked(r.edited_fingerprint))
    assert all(len(v) == 1 for v in by.values())


@pytest.mark.parametrize("rows_a_range", [2000, 2])
def test_odd_rows(spark, monkeypatch, rows_a_range):
    monkeypatch.setattr(fp, "ROWS_A_RANGE", rows_a_range)
    monkeypatch.setattr(fp, "CHARS_AT_ONCE", 300)
    rng = random.Random(6)
    prose = lambda n: " ".join(rng.choice(["the", "of", "Rain", "é-u", "x.", "\U0001f600", "hill", "sea"]) for _ in range(n))
    rows = [(9, "long day " * 20_000), (8, prose(80)), (7, None), (6, ""), (5, "..!"), (4, "ab"), (3, "the"), (2, prose(40)), (-3, prose(9)), (-(2**63), "é")]
    x = spark.createDataFrame(rows, SQL).withColumn("part", F.lit("clash")).withColumn("edited", F.lit(1))
    assert sorted(shown(fp.fingerprint_table(x).collect()), key=order) == sorted(plain(rows), key=order)
    one = fp.fingerprint_table(spark.createDataFrame([(1, "only one.")], SQL)).collect()
    assert shown(one) == plain([(1, "only one.")])
    assert fp.fingerprint_table(x.limit(0)).count() == 0
    # equal rows, equal ids and null ids: every row comes once, with some row after it
    many = [(1, "a b c")] * 5 + [(1, "d e f")] * 2 + [(None, prose(5)) for _ in range(9)] + [(None, None)] * 3
    got = fp.fingerprint_table(spark.createDataFrame(many, SQL).repartition(3)).collect()
    assert sorted(((r.doc_id, r.n_chars) for r in got), key=order) == sorted(((i, len(t or "")) for i, t in many), key=order)
    assert sum(r.doc_id == 1 and r.near_next == 1.0 for r in got) == 5


def test_bounds_of_likeness():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a, b = (np.unique(rng.integers(0, 60, rng.integers(0, 60))).astype(np.uint64) for _ in range(2))
        exact = jaccard(set(a.tolist()), set(b.tolist()))
        assert fp.likeness(a, b) == exact and fp.likeness(a, b, 0.5) == (exact if exact >= 0.5 else 0.0)
        if exact >= 0.5:
            assert abs(fp.band(len(a), 0.5) - fp.band(len(b), 0.5)) <= 1
