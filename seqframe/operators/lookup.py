"""Counts of a table's k-mers at all places of texts, and one-base alternatives there, by part of the letters that such k-mers share.

A context is the k - 1 letters that a k-mer and its alternatives share. Runs of contexts, with a letter before and behind, meet the
k-mers of the table in the part of their minimizers; texts are shuffled packed, two bits a letter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqframe.operators.packed import (
    MOST_K, OTHER, PARTS, ROUND, by_part, bytes_of, cut_binary, joined, kmers_of, lots, packed_letters, part_edges, parts_of, pieces_of, read, runs_of, stretches, texts, turned,
)

#: The longest k-mer whose contexts fit with a letter before and behind.
LONGEST_K = MOST_K - 1
#: Rows of a result that are handed on at once, k-mers of a table that are dealt out at once.
ROWS, TABLE_ROWS = 1 << 16, 1 << 20
#: Kinds of rows in a part: they come in this order.
TABLE, RUNS, TEXTS = 0, 1, 2


def fields(id_type: pa.DataType) -> pa.Schema:
    """sizes and letters: as packed_runs() has them; ids, places: of each run; flags: 1 a letter before, 2 one behind. Of the table letters are its k-mers."""
    kinds = {"part": pa.int32(), "kind": pa.int32(), "ids": pa.list_(id_type), "places": pa.binary(), "flags": pa.binary(), "sizes": pa.binary(), "letters": pa.binary(), "counts": pa.binary()}
    return pa.schema(list(kinds.items()))


def id_arrow(seqs: DataFrame) -> tuple[str, pa.DataType]:
    """The type of the ids in SQL and in Arrow."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = seqs.schema["id"].dataType
    return kind.simpleString(), to_arrow_type(kind)


def row(schema: pa.Schema, n: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def context_runs(seqs: DataFrame, k: int, totals: bool) -> DataFrame:
    """Rows of fields(): the runs of contexts of the texts; ``totals``: without places, and, anywhere, the ids and k-mers (counts) of all texts that have some."""
    sql, id_type = id_arrow(seqs)
    schema = fields(id_type)

    def rows(found: list[tuple]) -> pa.RecordBatch:
        ids, place, flag, size, part, letters = zip(*found, strict=True)
        ids = pa.chunked_array(ids, id_type)
        place, flag, size, part, letters = (np.concatenate(x) for x in (place, flag, size, part, letters))
        order, there, edges = by_part(part)
        n = bytes_of(size, k + 1)
        ends = np.concatenate(([0], np.cumsum(n[order])))
        letters = letters[stretches((np.cumsum(n) - n)[order], n[order])]
        ids = ids.take(pa.array(order)).combine_chunks()
        return row(
            schema, there.size, part=pa.array(there, pa.int32()), kind=pa.array(np.full(there.size, RUNS), pa.int32()), ids=pa.ListArray.from_arrays(pa.array(edges, pa.int32()), ids),
            **({} if totals else {"places": cut_binary(place[order].astype(np.int32), edges * 4)}), flags=cut_binary(flag[order].astype(np.uint8), edges), sizes=cut_binary(size[order].astype(np.uint8), edges), letters=cut_binary(letters, ends[edges]),
        )

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for b in it:
            codes, begins = texts(b.column(1))
            if totals:
                n = np.diff(np.append(begins, codes.size)) - k
                some = np.flatnonzero(n > 0)
                if some.size:
                    of = pa.ListArray.from_arrays(pa.array([0, some.size], pa.int32()), b.column(0).take(pa.array(some)))
                    yield row(schema, 1, part=pa.array([int(n.sum()) % PARTS], pa.int32()), kind=pa.array([TEXTS], pa.int32()), ids=of, counts=cut_binary(n[some].astype(np.int64), np.array([0, 8 * some.size])))
            # a letter before and behind all
            codes = np.concatenate(([np.uint8(OTHER)], codes, [np.uint8(OTHER)]))
            for at, piece in pieces_of(codes[1:-1], k - 1):
                first, size, part = runs_of(piece, k - 1)
                if not first.size:
                    continue
                wide = codes[at : at + piece.size + 2]
                flag = (wide[first] != OTHER) + 2 * (wide[first + size + k - 1] != OTHER)
                text = np.searchsorted(begins, at + first, side="right") - 1
                found.append((b.column(0).take(pa.array(text)), at + first - begins[text], flag, size, part, packed_letters(wide, first, size, k + 1)))
                held += piece.size
                if held >= ROUND:
                    yield rows(found)
                    found, held = [], 0
        if found:
            yield rows(found)

    kinds = f"part int, kind int, ids array<{sql}>, places binary, flags binary, sizes binary, letters binary, counts binary"
    return seqs.select("id", "seq").mapInArrow(batches, kinds)


def table_rows(counts: DataFrame, k: int, like: DataFrame | None = None) -> DataFrame:
    """Rows of fields(), with the columns of ``like`` (part, letters and counts without it): every k-mer of the table in the parts of its two contexts."""
    schema = pa.schema([f for f in fields(pa.int64()) if f.name in ("part", "letters", "counts")]) if like is None else fields(id_arrow(like.select(F.col("ids")[0].alias("id")))[1])
    sql = "part int, letters binary, counts binary" if like is None else ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in like.schema.fields)

    def dealt(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        kmers, cnt = (np.concatenate(x) for x in zip(*found, strict=True))
        one, other = parts_of(kmers >> np.uint64(2), k - 1), parts_of(kmers & np.uint64((1 << 2 * (k - 1)) - 1), k - 1)
        twice = np.flatnonzero(one != other)
        kmers, cnt, part = np.append(kmers, kmers[twice]), np.append(cnt, cnt[twice]), np.append(one, other[twice])
        order, there, edges = by_part(part)
        return row(schema, there.size, part=pa.array(there, pa.int32()), kind=pa.array(np.full(there.size, TABLE), pa.int32()), letters=cut_binary(kmers[order], edges * 8), counts=cut_binary(cnt[order], edges * 8))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for b in it:
            if b.num_rows:
                found.append((read(b.column(0), k), b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)))
                held += b.num_rows
            if held >= TABLE_ROWS:
                yield dealt(found)
                found, held = [], 0
        if found:
            yield dealt(found)

    return counts.select("kmer", F.col("cnt").cast("long").alias("cnt")).mapInArrow(batches, sql)


def joined_parts(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each part with its k-mers and counts, from rows of a table in the order of parts."""
    now, table = None, []
    for b in it:
        part, edges = part_edges(b)
        for at, to in zip(edges[:-1], edges[1:], strict=True):
            if not part.size:
                continue
            if table and part[at] != now:
                yield int(now), *(np.concatenate(x) for x in zip(*table, strict=True))
                table = []
            now = part[at]
            table.append((joined(b, "letters", at, to).view(np.uint64), joined(b, "counts", at, to).view(np.int64)))
    if table:
        yield int(now), *(np.concatenate(x) for x in zip(*table, strict=True))


class Near:
    """What the table has around contexts: counts of each with each letter behind (after) and before."""

    def __init__(self, kmers: np.ndarray, counts: np.ndarray, k: int) -> None:
        both = np.concatenate([kmers, turned(kmers, k)])
        counts = np.concatenate([counts, counts])
        low = np.uint64((1 << 2 * (k - 1)) - 1)
        heads, tails = both >> np.uint64(2), both & low
        self.names = np.unique(np.concatenate([heads, tails]))
        self.after, self.before = (np.zeros((self.names.size + 1, 4), np.int64) for _ in range(2))
        self.after[np.searchsorted(self.names, heads), (both & np.uint64(3)).astype(np.int64)] = counts
        self.before[np.searchsorted(self.names, tails), (both >> np.uint64(2 * (k - 1))).astype(np.int64)] = counts

    def rows_of(self, contexts: np.ndarray) -> np.ndarray:
        """The row of each context; of one that is not there the last, which has no counts."""
        if not self.names.size:
            return np.zeros(contexts.size, np.int64)
        at = np.searchsorted(self.names, contexts)
        at[at == self.names.size] = 0
        return np.where(self.names[at] == contexts, at, self.names.size)


class Places:
    """The contexts of a lot of runs: run, place in the text (from 0), row of Near, the letters before and behind, and whether there are such."""

    def __init__(self, batch: pa.RecordBatch, at: int, to: int, near: Near, k: int) -> None:
        sizes = joined(batch, "sizes", at, to)
        words, self.run, j = kmers_of(sizes, joined(batch, "letters", at, to), k + 1)
        flags, places = joined(batch, "flags", at, to), joined(batch, "places", at, to).view(np.int32)
        self.ids = batch.column("ids")[at:to].flatten()
        self.row = near.rows_of((words >> np.uint64(2)) & np.uint64((1 << 2 * (k - 1)) - 1))
        self.place = places[self.run] + j if places.size else None
        self.p, self.q = (words >> np.uint64(2 * k)).astype(np.int64), (words & np.uint64(3)).astype(np.int64)
        self.has_p = (j > 0) | (flags[self.run] & 1 > 0)
        self.has_q = (j < sizes[self.run].astype(np.int64) - 1) | (flags[self.run] & 2 > 0)
        self.n = sizes.size


def looked_up(seqs: DataFrame, counts: DataFrame, k: int, found: Callable, sql: str, totals: bool = False) -> DataFrame:
    """Rows that found(places, near) makes of each lot of runs, an Arrow table; of ids with their k-mers (``totals``) what found(ids, counts) does.

    One shuffle; a task holds the table of one part, and passes the runs by in lots.
    """
    runs = context_runs(seqs, k, totals)

    def meet(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, table, near = None, [], None
        for b in it:
            part, _ = part_edges(b)
            kind = b.column("kind").to_numpy()
            edges = [0, *(np.flatnonzero((part[1:] != part[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), b.num_rows] if b.num_rows else [0]
            for at, to in zip(edges[:-1], edges[1:], strict=True):
                if part[at] != now:
                    now, table, near = part[at], [], None
                if kind[at] == TABLE:
                    table.append((joined(b, "letters", at, to).view(np.uint64), joined(b, "counts", at, to).view(np.int64)))
                elif kind[at] == TEXTS:
                    yield from found(b.column("ids")[at:to].flatten(), joined(b, "counts", at, to).view(np.int64)).to_batches(ROWS)
                elif table:
                    if near is None:
                        near = Near(*(np.concatenate(x) for x in zip(*table, strict=True)), k)
                    for lot, end in lots(b, at, to):
                        yield from found(Places(b, lot, end, near, k), near).to_batches(ROWS)

    rows = runs.unionByName(table_rows(counts, k, runs)).repartition("part").sortWithinPartitions("part", "kind")
    return rows.mapInArrow(meet, sql)


def packed_alternatives(seqs: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """``id, pos, side, base, cnt``: as kmers.alternatives(), k at most LONGEST_K."""

    def found(x: Places, near: Near) -> pa.Table:
        known = np.flatnonzero(x.row < near.names.size)
        out = []
        for side, has, own, table, shift in (("L", x.has_p, x.p, near.before, 0), ("R", x.has_q, x.q, near.after, 1)):
            at = known[has[known]]
            cnt = table[x.row[at]]
            cnt[np.arange(at.size), own[at]] = 0
            which, base = np.nonzero(cnt)
            at = at[which]
            # the k-mer of side L begins a letter before its context
            out.append((x.run[at], x.place[at] + shift, np.full(at.size, side == "R"), base, cnt[which, base]))
        run, pos, right, base, cnt = (np.concatenate(c) for c in zip(*out, strict=True))
        names = lambda of, at: pa.DictionaryArray.from_arrays(pa.array(at, pa.int32()), pa.array(list(of))).cast(pa.string())
        return pa.table({"id": x.ids.take(pa.array(run)), "pos": pa.array(pos, pa.int32()), "side": names("LR", right.astype(np.int32)), "base": names("ACGT", base), "cnt": pa.array(cnt, pa.int64())})

    return looked_up(seqs, counts, k, found, f"id {id_arrow(seqs)[0]}, pos int, side string, base string, cnt long")


def trace_totals(seqs: DataFrame, counts: DataFrame, k: int, alternatives: bool = True) -> DataFrame:
    """``id, n, matched, total, n_alts`` of texts with k-mers: all, those that the table has, the sum of their counts, and alternatives. k at most LONGEST_K."""
    columns = ["n", "matched", "total", "n_alts"]

    def sums(ids: pa.Array, *values: np.ndarray) -> pa.Table:
        x = pa.table({"id": ids, **{c: pa.array(v, pa.int64()) for c, v in zip(columns, values, strict=True)}})
        return x.group_by("id").aggregate([(c, "sum") for c in columns]).rename_columns(["id", *columns])

    def found(x: Places | pa.Array, near: Near | np.ndarray) -> pa.Table:
        if isinstance(near, np.ndarray):
            return sums(x, near, *np.zeros((3, near.size), np.int64))
        known = np.flatnonzero(x.row < near.names.size)
        run, row, p, q, has_p, has_q = (c[known] for c in (x.run, x.row, x.p, x.q, x.has_p, x.has_q))
        own = np.where(has_q, near.after[row, q], 0)
        alts = np.zeros(known.size, np.int64)
        if alternatives:
            for has, letter, table in ((has_p, p, near.before), (has_q, q, near.after)):
                there = table > 0
                alts += np.where(has, there.sum(axis=1)[row] - there[row, letter], 0)
        by = lambda v: np.bincount(run, v, x.n).astype(np.int64)
        values = [by(own > 0), by(own), by(alts)]
        some = np.flatnonzero((values[0] > 0) | (values[2] > 0))
        return sums(x.ids.take(pa.array(some)), np.zeros(some.size, np.int64), *(v[some] for v in values))

    sql = f"id {id_arrow(seqs)[0]}, {', '.join(f'{c} long' for c in columns)}"
    return looked_up(seqs, counts, k, found, sql, totals=True).groupBy("id").agg(*[F.sum(c).alias(c) for c in columns])


def packed_confirmed(seqs: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """``id, missing, total``: as kmers.confirmed(), k at most LONGEST_K."""
    return trace_totals(seqs, counts, k, alternatives=False).select("id", (F.col("n") - F.col("matched")).alias("missing"), F.col("n").alias("total"))
