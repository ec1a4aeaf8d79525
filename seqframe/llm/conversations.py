"""Repair of the turn structure of conversations.

Rows of one conversation meet in one task, sorted by turn, and stream through it in Arrow batches. A
dynamic program over four states of the wanted order of roles, ``(s?(ua)+)?``, is carried from row to
row and from batch to batch: for each state the least cost so far and the rank of its edits among those
of the other states. What a conversation has been is kept as four bytes of backpointers a row and as its
texts, both in files that leave memory beyond ``IN_MEMORY`` bytes; so memory does not grow with a
conversation.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = " \t\n\x0b\x0c\r"
IN_MEMORY = 1 << 22
#: Digests of earlier rows of a conversation that are held as a set before they become a sorted array.
SEEN_AT_ONCE = 1 << 18
ROWS_OUT, CHARS_OUT = 4096, 1 << 22
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED_COST = 1
ROLE = {"s": "system", "u": "user", "a": "assistant"}
#: States: nothing yet; after s; after u; after a. The first and the last may end.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
GOES = {START: {"s": AFTER_S, "u": AFTER_U}, AFTER_S: {"u": AFTER_U}, AFTER_U: {"a": AFTER_A}, AFTER_A: {"u": AFTER_U}}
#: The role that Rerole and Insert give in a state (they give no system rows).
GIVES = {START: "u", AFTER_S: "u", AFTER_U: "a", AFTER_A: "u"}
ENDS = (START, AFTER_A)
#: A state whose cost is so much above the least one cannot be on a cheapest way: from any state the others'
#: further ways are open for two inserts and a deletion at most.
BEHIND = 16
MOST_INSERTS = 2


def _transitions(initial: str, must_go: bool, truncated: bool) -> list[tuple[int, str, int, int]]:
    """(from, edits, to, cost) of every way to take a row: inserts, then one edit of the row."""
    out = []
    for first in GOES:
        q = first
        for n in range(MOST_INSERTS + 1):
            cost, more = n * COST[INSERT], TRUNCATED_COST * truncated
            out.append((first, INSERT * n + DELETE, q, cost + COST[DELETE]))
            if not must_go:
                if initial in GOES[q]:
                    out.append((first, INSERT * n + KEEP, GOES[q][initial], cost + COST[KEEP] + more))
                out.append((first, INSERT * n + REROLE, GOES[q][GIVES[q]], cost + COST[REROLE] + more))
            q = GOES[q][GIVES[q]]
    return out


class Order:
    """The dynamic program's step, remembered by (costs, ranks, kind of row)."""

    def __init__(self):
        self.kinds: dict[tuple, list] = {}
        self.steps: dict[tuple, tuple] = {}

    def step(self, costs: tuple, ranks: tuple, kind: tuple) -> tuple[tuple, tuple, int, int]:
        """New costs (the least is 0), new ranks, what the least cost has grown by, and backpointers: six bits a state."""
        key = (costs, ranks, kind)
        if key not in self.steps:
            ways = self.kinds.get(kind) or self.kinds.setdefault(kind, _transitions(*kind))
            best: dict[int, tuple] = {}
            for q, edits, to, cost in ways:
                if costs[q] is not None:
                    best[to] = min(best.get(to, (1 << 30,)), (costs[q] + cost, ranks[q], edits, q))
            least = min(b[0] for b in best.values())
            best = {to: b for to, b in best.items() if b[0] - least <= BEHIND}
            # no way is the beginning of another, so the order of ways is that of (rank before, edits)
            place = {to: i for i, to in enumerate(sorted(best, key=lambda to: best[to][1:3]))}
            new = tuple(best[q][0] - least if q in best else None for q in range(4))
            back = sum((b[3] | (len(b[2]) - 1) << 2 | "DKR".index(b[2][-1]) << 4) << 6 * to for to, b in best.items())
            self.steps[key] = new, tuple(place.get(q, -1) for q in range(4)), least, back
        return self.steps[key]


def finish(costs: tuple, ranks: tuple) -> tuple[int, int, int]:
    """Cost, state before the last inserts and their number, of the cheapest end."""
    best = []
    for first in range(4):
        if costs[first] is not None:
            q, n = first, 0
            while q not in ENDS:
                q, n = GOES[q][GIVES[q]], n + 1
            best.append((costs[first] + n * COST[INSERT], ranks[first], first, n))
    cost, _, first, n = min(best)
    return cost, first, n


class Seen:
    """Digests seen before, exact at any number: a set, then a sorted array in a file of its own."""

    def __init__(self):
        self.new: set[bytes] = set()
        self.old, self.file = np.zeros(0, "V16"), None

    def add(self, x: bytes) -> bool:
        """Whether x is new."""
        if x in self.new:
            return False
        if len(self.old):
            key = np.frombuffer(x, ">u8")
            lo, hi = (int(np.searchsorted(self.old["a"], key[0], s)) for s in ("left", "right"))
            if (self.old["b"][lo:hi] == key[1]).any():
                return False
        self.new.add(x)
        if len(self.new) >= SEEN_AT_ONCE:
            self.settle()
        return True

    def settle(self) -> None:
        more = np.frombuffer(b"".join(self.new), [("a", ">u8"), ("b", ">u8")]).astype([("a", "<u8"), ("b", "<u8")])
        more.sort(order="a")
        old = self.old if len(self.old) else more[:0]
        file = tempfile.TemporaryFile()
        whole = np.memmap(file, more.dtype, "w+", shape=(len(old) + len(more),))
        at = np.searchsorted(old["a"], more["a"]) + np.arange(len(more))
        kept = np.ones(len(whole), bool)
        kept[at] = False
        whole[at], whole[kept] = more, old
        if self.file:
            self.file.close()
        self.old, self.file, self.new = whole, file, set()

    def close(self) -> None:
        if self.file:
            self.old = None
            self.file.close()


class Conversation:
    """One conversation as its rows pass."""

    def __init__(self, conv_id: int | None, order: Order):
        self.id, self.order = conv_id, order
        self.costs, self.ranks, self.cost, self.rows = (0, None, None, None), (0, -1, -1, -1), 0, 0
        self.back, self.texts = tempfile.SpooledTemporaryFile(IN_MEMORY), tempfile.SpooledTemporaryFile(IN_MEMORY)
        self.seen, self.before, self.illegal = Seen(), None, 0
        self.low = self.high = None
        self.turns = 0

    def row(self, turn: int | None, role: str, text: str) -> None:
        digest = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        again = not self.seen.add(digest)
        seen = text.rstrip(SPACE)
        fault = "blank" if not seen else "duplicate" if again else "truncated" if seen[-1] not in ".!?" else ""
        initial = role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn
        kind = (initial if initial in ROLE else "", fault in ("blank", "duplicate"), fault == "truncated")
        self.costs, self.ranks, more, back = self.order.step(self.costs, self.ranks, kind)
        self.cost += more
        self.rows += 1
        self.back.write(back.to_bytes(4, "little"))
        head = f"{'' if turn is None else turn}\0{fault}\0{len(role.encode())}\0".encode()
        body = role.encode() + text.encode()
        self.texts.write(len(head).to_bytes(4, "little") + len(body).to_bytes(8, "little") + head + body)

    def edits(self) -> Iterator[str]:
        """The cheapest edits, one row's at a time (inserts before it, then its own), and the inserts at the end."""
        _, q, last = finish(self.costs, self.ranks)
        size = 1 << 18
        way = tempfile.SpooledTemporaryFile(IN_MEMORY)
        # one byte a row, from the last row to the first: blocks are written so that reading the file backwards gives their order
        for hi in range(self.rows, 0, -size):
            lo = max(0, hi - size)
            self.back.seek(4 * lo)
            block = np.frombuffer(self.back.read(4 * (hi - lo)), "<u4").tolist()
            out = bytearray()
            for word in reversed(block):
                x = word >> 6 * q & 63
                out.append(x >> 2)
                q = x & 3
            way.write(out)
        for hi in range(self.rows, 0, -size):
            lo = max(0, hi - size)
            way.seek(lo)
            for x in reversed(way.read(hi - lo)):
                yield INSERT * (x & 3) + "DKR"[x >> 2]
        way.close()
        yield INSERT * last

    def out(self) -> Iterator[tuple]:
        """(edit, fault, turn, role, text) in order."""
        self.texts.seek(0)
        q = START
        for edits in self.edits():
            for _ in range(edits.count(INSERT)):
                initial = GIVES[q]
                q = GOES[q][initial]
                yield INSERT, None, None, ROLE[initial], ""
            edit = edits[-1:]
            if edit not in (KEEP, REROLE, DELETE):
                continue
            n, m = (int.from_bytes(self.texts.read(k), "little") for k in (4, 8))
            turn, fault, k, _ = self.texts.read(n).decode().split("\0")
            body = self.texts.read(m)
            role, text = body[: int(k)].decode(), body[int(k) :].decode()
            if edit == REROLE:
                role = ROLE[GIVES[q]]
            if edit != DELETE:
                q = GOES[q][role[:1]]
            yield edit, fault or None, int(turn) if turn else None, role, text

    def close(self) -> None:
        for f in (self.back, self.texts, self.seen):
            f.close()


REPAIRED_SQL = """conv_id long, place long, edit string, fault string, turn long, role string, text string,
 gaps long, illegal long, cost long"""
REPAIRED = [c.split()[0] for c in REPAIRED_SQL.split(",")]


def _by_conversation(frames: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple]:
    """(whether a conversation begins, its id, the row's other values) of rows sorted by conversation."""
    first, now = True, None
    for frame in frames:
        ids = [None if x is None or x != x else int(x) for x in frame["conv_id"]]
        for conv, *rest in zip(ids, *[frame[c] for c in columns], strict=True):
            yield first or conv != now, conv, rest
            first, now = False, conv


def repaired_turns(turns: DataFrame, gone: Column | None = None) -> DataFrame:
    """Every edit of every conversation, in order: one row for each kept, reroled, deleted or inserted turn.

    turns: conv_id, turn, role, text. Rows are taken by turn (nulls first; ties by role, then text). A row's
    fault is ``blank`` (no visible character), else ``duplicate`` (role and text seen before in the
    conversation), else ``truncated`` (last visible character not ``.!?``). Blank and duplicate rows are
    deleted. The edits are the cheapest that give roles whose initials are ``(s?(ua)+)?``: Keep 0, Rerole
    to user or assistant 2, Delete 3, Insert of an empty user or assistant row 2, and 1 for each truncated row that stays; of
    equals the edits with the least initials. ``turn``, ``fault``: null for inserted rows; ``text``: of deleted rows too.
    ``gaps``: turns missing between the least and the largest; ``illegal``: neighbours whose initials
    are not su, ua or au; ``cost``: all three of the conversation, in each of its rows.
    ``gone``: rows for which it holds only say that the conversation exists; a conversation of such rows
    gives one row with a null edit. Rows of a null conv_id form one conversation; a null role or text counts as one
    space. Other columns are ignored; an empty table gives an empty result. A conversation is one group, as its order asks; it
    streams through a task and never is in memory.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"),
        (F.coalesce(gone, F.lit(False)) if gone is not None else F.lit(False)).alias("gone"),
    )
    rows = rows.withColumn("turn_text", F.col("turn").cast("string")).repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        order, now = Order(), None
        kept: list[tuple] = []
        chars = 0

        def told(c: Conversation) -> Iterator[pd.DataFrame]:
            nonlocal kept, chars
            gaps = 0 if c.low is None else c.high - c.low + 1 - c.turns
            cost = c.cost + finish(c.costs, c.ranks)[0]
            for place, row in enumerate(c.out()):
                kept.append((c.id, place, *row, gaps, c.illegal, cost))
                chars += len(row[-1])
                if len(kept) >= ROWS_OUT or chars >= CHARS_OUT:
                    yield frame()
            if not c.rows:
                kept.append((c.id, 0, None, None, None, None, None, 0, 0, 0))
            c.close()

        def frame() -> pd.DataFrame:
            nonlocal kept, chars
            out = pd.DataFrame(dict(zip(REPAIRED, map(list, zip(*kept, strict=True)), strict=True)))
            for c in ("conv_id", "turn"):
                out[c] = pd.array([r[REPAIRED.index(c)] for r in kept], dtype="Int64")
            kept, chars = [], 0
            return out

        for begins, conv, (turn, role, said, is_gone) in _by_conversation(frames, ["turn_text", "role", "text", "gone"]):
            if begins:
                if now is not None:
                    yield from told(now)
                now = Conversation(conv, order)
            if not is_gone:
                now.row(None if turn is None else int(turn), role, said)
        if now is not None:
            yield from told(now)
        if kept:
            yield frame()

    return rows.select("conv_id", "turn_text", "role", "text", "gone").mapInPandas(run, REPAIRED_SQL)


REPORT_SQL = """conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string,
 repaired_sha256 string"""


def reports(repaired: DataFrame) -> DataFrame:
    """One row a conversation from what repaired_turns() gives, which is read in its order, as it is dealt and sorted.

    blank, duplicate, truncated: rows by fault; audit: the edits' initials; repaired_sha256: of the
    repaired ``role:text``, joined by line feeds, in UTF-8.
    """
    names = [c.split()[0] for c in REPORT_SQL.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: list[tuple] = []
        now, counts, audit, sha, any_row, figures = None, {}, [], None, False, ()

        def told() -> tuple:
            return (now, figures[0], counts["blank"], counts["duplicate"], counts["truncated"], figures[1], figures[2], "".join(audit), sha.hexdigest())

        def frame() -> pd.DataFrame:
            out = pd.DataFrame(dict(zip(names, map(list, zip(*done, strict=True)), strict=True)))
            out["conv_id"] = pd.array([r[0] for r in done], dtype="Int64")
            done.clear()
            return out

        for begins, conv, (edit, fault, role, text, *rest) in _by_conversation(frames, ["edit", "fault", "role", "text", "gaps", "illegal", "cost"]):
            if begins:
                if sha is not None:
                    done.append(told())
                    if len(done) >= ROWS_OUT:
                        yield frame()
                now, counts, audit, sha, any_row = conv, dict.fromkeys(("blank", "duplicate", "truncated"), 0), [], hashlib.sha256(), False
            figures = rest
            if edit is None:
                continue
            audit.append(edit)
            if fault:
                counts[fault] += 1
            if edit != DELETE:
                sha.update(("\n" * any_row + f"{role}:{text}").encode())
                any_row = True
        if sha is not None:
            done.append(told())
            yield frame()

    return repaired.mapInPandas(run, REPORT_SQL)


def damaged(turns: DataFrame) -> tuple[DataFrame, Column]:
    """Rows of conversations as a noisy channel leaves them, and a column that tells the rows it dropped.

    crc32 of ``conv_id:turn`` modulo 20 decides (nulls count as one space): 0 drops a row, 1 empties its text, 2
    removes its ``.!?``, 3 repeats it next to itself, 4 makes its role user.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    x = turns.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"))
    x = x.withColumn("kind", F.crc32(F.concat_ws(":", said("conv_id"), said("turn")).cast("binary")) % 20)
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    x = x.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "kind", F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))))
    return x, F.col("kind") == 0


def repair_table(turns: DataFrame) -> DataFrame:
    """The rows that the repair query returns: conversations damaged, repaired and reported on."""
    x, gone = damaged(turns)
    return reports(repaired_turns(x, gone))
