import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from seqframe.llm import conversations as c

SQL = "conv_id long, turn long, role string, text string"
VISIBLE = r"[^\x20\x09-\x0D]"


def faults(rows):
    """(initial, fault) of rows in order."""
    out, seen = [], set()
    for role, text in rows:
        marks = re.findall(VISIBLE, text)
        out.append((role[:1], "blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else ""))
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit) by trying every edit of every row, with up to three inserts in a place."""
    rows, best = faults(rows), {}

    def tail(i, out):
        # what is left to do depends on the place and on the end of what is there
        key = (i, out[-1:] if out != "s" else "S")
        if key not in best:
            found = [(0, "")] if i == len(rows) and re.fullmatch("(s?(ua)+)?", out) else []
            if i < len(rows):
                initial, fault = rows[i]
                found.append(add(3, "D", tail(i + 1, out)))
                if fault in ("", "truncated"):
                    more = fault == "truncated"
                    for cost, edit, to in ((0, "K", initial or "?"), (2, "R", "u"), (2, "R", "a")):
                        if fits(out + to):
                            found.append(add(cost + more, edit, tail(i + 1, out + to)))
            if inserts[0] < 3:
                inserts[0] += 1
                for to in "ua":
                    if fits(out + to):
                        found.append(add(2, "I", plain(i, out + to)))
                inserts[0] -= 1
            return min(found, default=(10**6, ""))
        return best[key]

    def plain(i, out):
        return tail(i, out)

    fits = lambda s: bool(re.fullmatch("(s?(ua)*u?)?", s))
    add = lambda cost, edit, rest: (cost + rest[0], edit + rest[1])
    inserts = [0]
    return tail(0, "")


def wanted(rows, audit):
    """The repaired rows that an audit means."""
    out, at, roles = [], 0, ""
    for e in audit:
        to = "u" if roles[-1:] in ("", "s", "a") else "a"
        if e == "I":
            out.append(({"u": "user", "a": "assistant"}[to], ""))
        else:
            role, text = rows[at]
            at += 1
            if e == "D":
                continue
            out.append((role if e == "K" else {"u": "user", "a": "assistant"}[to], text))
        roles += out[-1][0][:1]
    assert at == len(rows) and re.fullmatch("(s?(ua)+)?", roles)
    return out


def report(conv, rows):
    """The query's row for the rows (turn, role, text) of one conversation, in order."""
    turns = {t for t, _, _ in rows if t is not None}
    said = [(r, t) for _, r, t in rows]
    kinds = [f for _, f in faults(said)]
    cost, audit = cheapest(said)
    text = "\n".join(f"{r}:{t}" for r, t in wanted(said, audit))
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(said, said[1:])]
    return (conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest())


def damage(rows):
    """{conv_id: rows after damage, in order}"""
    out = {}
    said = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        role, text = said(role), said(text)
        kind = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        kept += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for k, v in out.items()}


def key(row):
    return (row[0] is not None, row[0] or 0)


def test_query_against_every_edit(spark, data):
    table = spark.read.parquet(f"{data}/conversations.parquet")
    want = [report(k, v) for k, v in damage([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]).items()]
    got = [tuple(r) for r in c.repair_table(table).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


def some_rows(seed, convs):
    rng = random.Random(seed)
    texts = ["Yes.", "no", "", " \t", "What?", "so on", "é!", "\x0b"]
    roles = ["user", "assistant", "system", "tool", "", "usher", None]
    return [(conv, rng.choice([None, *range(12)]), rng.choices(roles, [6, 6, 2, 1, 1, 1, 1])[0], rng.choice([*texts, None])) for conv in convs for _ in range(rng.randrange(0, 10))]


@pytest.mark.parametrize("seen,memory", [(1 << 18, 1 << 22), (2, 8)])
def test_repair_against_every_edit(spark, monkeypatch, seen, memory):
    monkeypatch.setattr(c, "SEEN_AT_ONCE", seen)
    monkeypatch.setattr(c, "IN_MEMORY", memory)
    rows = some_rows(5, [None, *range(300)])
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    want = [report(k, sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))) for k, v in by.items()]
    x = spark.createDataFrame(rows, SQL).withColumn("gaps", F.lit("clash")).withColumn("edit", F.lit(0))
    got = [tuple(r) for r in c.reports(c.repaired_turns(x)).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_damaged_rows_against_every_edit(spark):
    lost = next(i for i in range(1000, 2000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [*some_rows(9, [None, *range(200)]), (lost, 0, "user", "Gone.")]
    want = [report(k, v) for k, v in damage(rows).items()]
    got = [tuple(r) for r in c.repair_table(spark.createDataFrame(rows, SQL)).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert any(r[7] == "" and r[8] == hashlib.sha256(b"").hexdigest() for r in got)


def test_giant_conversations_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(c, "SEEN_AT_ONCE", 500)
    monkeypatch.setattr(c, "IN_MEMORY", 1 << 12)
    n = 20_000
    rows = [(7, i, "user" if i % 2 == 0 else "assistant", f"turn {i}.") for i in range(n)] + [(8, 0, "user", "long " * 200_000 + "."), (8, 0, "user", "long " * 200_000 + ".")]
    got = {r.conv_id: r for r in c.reports(c.repaired_turns(spark.createDataFrame(rows, SQL))).collect()}
    assert got[7].audit == "K" * n and got[7].cost == 0 and got[7].gaps == 0
    assert got[7].repaired_sha256 == hashlib.sha256("\n".join(f"{r}:{t}" for _, _, r, t in rows[:n]).encode()).hexdigest()
    assert got[8].duplicate == 1 and got[8].audit == "KDI" and got[8].cost == 5


def test_edits_are_rows_of_their_own(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "assistant", "Again"), (1, 5, "user", "")]
    got = c.repaired_turns(spark.createDataFrame(rows, SQL)).orderBy("place").collect()
    assert [(r.edit, r.fault, r.turn, r.role, r.text) for r in got] == [
        ("K", None, 0, "system", "Be kind."), ("R", None, 1, "user", "Hello."), ("K", "truncated", 2, "assistant", "Again"), ("D", "blank", 5, "user", "")]
    assert {(r.gaps, r.illegal, r.cost) for r in got} == {(2, 2, 6)}
    assert c.repair_table(spark.createDataFrame([], SQL)).count() == 0
