import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from conftest import plain
from pyspark.sql import functions as F

from seqframe.llm import queries as llm
from seqframe.llm.exact_dedup import mark_duplicates
from seqframe.llm.licenses import scan
from seqframe.llm.mixing import draw, mix, mix_table
from seqframe.llm.sharding import assign_shards, shard_table

SQL = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, *rows):
    return spark.createDataFrame([(i, t, None, s, None) for i, t, s in rows], SQL)


ODD = [(1, None, "a"), (2, "", None), (3, "x  y", "a"), (3, "x  y", "a"), (4, "x\ty", "b"), (None, "x y", "b"), (5, "z " * 30_000, "a"), (6, "z " * 30_000, None)]


@pytest.mark.parametrize("name", ["op1_chat_format", "op2_source_mixing", "op3_exact_dedup", "op6_license_scan", "op9_substring_dedup", "op4_ngram_join", "op12_phrase_collocations"])
def test_query_equals_sql(spark, duck, data, name):
    got = llm.queries()[name](spark, data)
    rows = duck.execute(llm.oracle_sql()[name])
    columns = [c[0] for c in rows.description]
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(rows.fetchall(), columns)


@pytest.mark.parametrize("rows_a_group", [3, 1000])
def test_exact_dedup_odd_rows(spark, rows_a_group):
    got = mark_duplicates(docs(spark, *ODD).withColumn("keep_id", F.lit("clash")), rows_a_group=rows_a_group).collect()
    assert len(got) == len(ODD)
    assert sorted((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in got if r.text_sha256 == hashlib.sha256(b"x y").hexdigest()) == [
        (0, 3, 4, False), (3, 3, 4, False), (3, 3, 4, True), (4, 3, 4, False)]
    assert sum(r.kept for r in got) == 3
    assert mark_duplicates(docs(spark)).count() == 0


def test_shards_follow_the_law(spark, data):
    table = spark.read.parquet(f"{data}/documents.parquet")
    got = shard_table(table).collect()
    text = {r.doc_id: (r.text or "").encode() for r in table.collect()}
    source = {r.doc_id: r.source for r in table.collect()}
    assert {r.doc_id for r in got} == set(text) and len(got) == len(text)
    assert all(r.size == len(text[r.doc_id]) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id]) for r in got)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(40)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # brute force: the same order by fractional rank
    h = lambda i: hashlib.md5(f"shard#{i}".encode()).hexdigest()
    by = defaultdict(list)
    for i in text:
        by[source[i]].append(i)
    order = sorted((((k + 0.5) / len(v), f"s{s}", h(i)), i) for s, v in by.items() for k, i in enumerate(sorted(v, key=h)))
    want = {i: p * 40 // len(text) for p, (_, i) in enumerate(order)}
    assert {r.doc_id: r.shard for r in got} == want


def test_shards_of_odd_rows(spark):
    got = assign_shards(docs(spark, *ODD).withColumn("shard", F.lit("clash")), 3).collect()
    assert len(got) == len(ODD) and sorted(Counter(r.shard for r in got).values()) == [2, 3, 3]
    assert assign_shards(docs(spark)).count() == 0


def test_shards_of_a_scan_and_of_other_tables_agree(spark, data):
    table = spark.read.parquet(f"{data}/documents.parquet")
    scan, other = (sorted((r.doc_id, r.text, r.shard, r.slot) for r in assign_shards(x, 7).collect()) for x in (table, table.where("doc_id >= 0")))
    assert scan == other and len(scan) == table.count()


def test_mixing_evens_sources_out(spark):
    rows = [(i, "w " * 10, "big") for i in range(300)] + [(1000 + i, "w " * 10, "small") for i in range(60)] + [(2000 + i, "w " * 10, None) for i in range(60)]
    got = mix(docs(spark, *rows), entropy=0.999).groupBy("source").count().collect()
    by = {r.source: r["count"] for r in got}
    assert max(by.values()) - min(by.values()) <= 40 and 410 <= sum(by.values()) <= 420
    seen = mix(docs(spark, *rows), entropy=0.999).where("source = 'small'").groupBy("doc_id").count().collect()
    assert len(seen) == 60 and max(r["count"] for r in seen) - min(r["count"] for r in seen) <= 1
    kept = mix(docs(spark, *rows), entropy=1.0, max_repeats=1.0).groupBy("doc_id").count()
    assert kept.agg(F.max("count")).first()[0] == 1


def plain_mix(rows, entropy, max_repeats, budget=None):
    """(id, block) of every draw: the exponent tried one by one, budgets by largest remainder, blocks in seeded orders."""
    from fractions import Fraction
    from math import floor, log

    from seqframe.llm.mixing import SCALE, STEPS

    by = defaultdict(list)
    for i, t, s in rows:
        by["n" if s is None else f"s{s}"].append((i, len((t or "").split())))
    tot = {s: sum(n for _, n in v) for s, v in by.items() if sum(n for _, n in v)}
    total = sum(tot.values())
    budget = total if budget is None else budget

    def measures(k):
        p = {s: (t / total) ** (k / STEPS) for s, t in tot.items()}
        z = sum(p.values())
        h = -sum(x / z * log(x / z) for x in p.values())
        return (h / log(len(p)) if len(p) > 1 else 1.0), max(x / z * budget / tot[s] for s, x in p.items())

    k = max((k for k in range(STEPS + 1) if measures(k)[0] >= entropy - 1e-9), default=0)
    if measures(k)[1] > max_repeats + 1e-9:
        k = min((j for j in range(k, STEPS + 1) if measures(j)[1] <= max_repeats + 1e-9), default=STEPS)
    w = {s: t if k == STEPS else max(1, floor((t / total) ** (k / STEPS) * SCALE)) for s, t in tot.items()}
    exact = {s: Fraction(budget * x, sum(w.values())) for s, x in w.items()}
    b = {s: floor(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (b[s] - exact[s], s))[: budget - sum(b.values())]:
        b[s] += 1
    out = Counter()
    for s in tot:
        full, rest = divmod(b[s], tot[s])
        for block in range(full + (rest > 0)):
            upto = 0
            for i, n in sorted(by[s], key=lambda x: (hashlib.md5(f"mix#{block}#{x[0]}".encode()).hexdigest(), str(x[0]))):
                upto += n
                if block < full or upto <= rest:
                    out[i, block] += 1
    return out


def uneven(seed):
    import random

    rng = random.Random(seed)
    rows, i = [], 0
    for s, n in (("a", 90), ("b", 31), ("c", 7), (None, 12), ("empty", 2)):
        for _ in range(n):
            rows.append((i, "w " * (0 if s == "empty" else rng.randrange(0, 30)), s))
            i += 1
    return rows


@pytest.mark.parametrize("entropy,repeats,budget", [(1.0, 1.7, None), (0.9, 4.0, 5000), (0.0, 4.0, None)])
def test_mixing_against_a_plain_version(spark, entropy, repeats, budget):
    rows = uneven(3)
    want = plain_mix(rows, entropy, repeats, budget)
    for n in (1, 7) if repeats < 2 else (3,):
        got = mix(docs(spark, *rows).repartition(n), budget, entropy, repeats).collect()
        assert Counter((r.doc_id, r.mix_block) for r in got) == want
    drawn = draw(docs(spark, *rows).repartition(3), budget, entropy, repeats)
    assert Counter(r.doc_id for r in drawn.collect()) == Counter(i for i, _ in want.elements())
    if entropy == 0.0:
        # exponent 1: every row of a source with tokens, once
        assert sum(want.values()) == sum(s != "empty" for _, _, s in rows)
    else:
        assert len({b for _, b in want}) > 1


def test_mixing_does_not_depend_on_partitions(spark, data):
    table = spark.read.parquet(f"{data}/documents.parquet")
    got = {n: sorted((r.doc_id, r.mix_block, r.mix_rank) for r in mix_table(table.repartition(n)).collect()) for n in (1, 7)}
    assert got[1] == got[7] and max(r[1] for r in got[1]) > 0
    # an exponent of 1 draws every row of a source with tokens once
    assert mix(table.repartition(5), entropy=0.0).count() == table.count()


def test_mixing_of_odd_rows(spark):
    assert mix(docs(spark)).count() == 0 and mix(docs(spark, (1, None, None), (2, "", "a"))).count() == 0
    got = mix(docs(spark, *ODD).withColumn("mix_block", F.lit("clash")))
    assert set(got.columns) == {*[c.split()[0] for c in SQL.split(", ")], "mix_block", "mix_rank"} and got.count() > 0
    # equal rows are drawn as often as there are; long texts, ties and null ids come with full blocks
    every = Counter((r.doc_id, r.text) for r in mix(docs(spark, *ODD), entropy=0.0).collect())
    assert every == Counter((i, t) for i, t, _ in ODD) == Counter((r.doc_id, r.text) for r in draw(docs(spark, *ODD).withColumn("cut", F.lit("clash")), entropy=0.0).collect())
    assert draw(docs(spark)).count() == 0


def test_licenses_of_odd_rows(spark):
    text = "a b c " * 400 + "Released\nunder the MIT   License. and Licensed under the Apache License, version 2.0!" + " d" * 300
    got = scan(docs(spark, (1, text, "a"), (2, None, "a"), (3, "", "b"), (4, "released under the", "a"), (None, "released under the mit license", "b"))).collect()
    assert sorted((r.doc_id or 0, r.license, r.containment) for r in got) == [(0, "mit-notice", 1.0), (1, "apache-2.0-notice", 1.0), (1, "mit-notice", 1.0)]
    assert scan(docs(spark)).count() == 0


def test_licences_of_long_and_repeated_rows(spark):
    from seqframe.llm.licenses import TEMPLATES

    mit = TEMPLATES["mit"].split()
    long = " ".join(["word"] * 20_000 + mit + ["word"] * 20_000)
    # two rows of one id hold half of a licence each: neither has it
    rows = [(1, long, "a"), (7, " ".join(mit[:80]), "a"), (7, " ".join(mit[80:]), "a"), (8, "Released under the MIT License", "a"), (8, "Released under the MIT License", "a")]
    got = sorted((r.doc_id, r.license, r.containment) for r in scan(docs(spark, *rows).withColumn("stride", F.lit("clash"))).collect())
    assert got == [(1, "mit", 1.0), (8, "mit-notice", 1.0), (8, "mit-notice", 1.0)]


def test_every_template_is_found_in_its_own_text(spark):
    from seqframe.llm.licenses import TEMPLATES

    text = " ".join(f"{t} filler{i}" for i, t in enumerate(TEMPLATES.values()))
    assert {r.license for r in scan(docs(spark, (1, text, "a"))).collect()} == set(TEMPLATES)
