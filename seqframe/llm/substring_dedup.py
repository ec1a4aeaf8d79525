"""Removal of repeated passages by compaction of a de Bruijn graph of words.

Nodes are runs of k-1 words, edges runs of k words (windows). Documents are dealt into chunks by their
id, and each chunk asks the owners of hash ranges three questions. What is asked and answered travels
packed, one row for each chunk and range, with every hash once a chunk: no row count, and no task,
grows with the number of copies of a passage.

1. Which edges occur more than once? Asked with fingerprints of as many bytes as the number of windows
   calls for; a false alarm costs a row in the next question only.
2. Of these, which truly repeat, and at which is every occurrence followed, or preceded, by the same
   word? Edges between such ends form the nonbranching paths: each occurrence of a path then is one run
   of windows in a document, and the answers joined to the chunks compact the graph.
3. Which path occurrence comes first by document and position? Paths are matched by first edge, length
   and a second hash of the whole span at its coordinates, so that a collision of window hashes cannot
   remove a word.

Each other occurrence of a path is removed from its document.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqframe.llm.tokens import U, rolling, span, windows, word_hashes

WINDOW = 20
LAST = np.iinfo(np.int64).max
ASK = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("data", pa.binary())])
ANSWER = pa.schema([("chunk", pa.int32()), ("step", pa.int32()), ("part", pa.int32()), ("data", pa.binary())])
ASK_SQL, ANSWER_SQL = "part int, chunk int, data binary", "chunk int, step int, part int, data binary"
KEPT_SQL = "doc_id long, n_words long, n_removed long, text string"
EDGE = np.dtype([("h", "<u8"), ("next", "<u4"), ("prev", "<u4"), ("many", "u1")])
PATH = np.dtype([("h", "<u8"), ("n", "<u4"), ("check", "<u8"), ("doc", "<i8")])


def cut(sorted_hashes: np.ndarray, parts: int) -> np.ndarray:
    """Where the ranges of hashes begin that belong to each part."""
    step = (1 << 64) // parts
    marks = np.array([i * step for i in range(1, parts)], dtype=U)
    return np.concatenate([[0], np.searchsorted(sorted_hashes, marks), [len(sorted_hashes)]])


def packed(chunk: int, rows: np.ndarray, bounds: np.ndarray) -> pa.Table:
    """One row for each part that has something."""
    at = [i for i in range(len(bounds) - 1) if bounds[i] < bounds[i + 1]]
    return pa.table(
        [pa.array(at, pa.int32()), pa.array([chunk] * len(at), pa.int32()), pa.array([rows[bounds[i] : bounds[i + 1]].tobytes() for i in at], pa.binary())],
        schema=ASK,
    )


class Chunk:
    """Documents of one chunk, in the order that decides which occurrence is the first."""

    def __init__(self, table: pa.Table, k: int) -> None:
        self.id = table["chunk"][0].as_py()
        self.table = table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.doc_ids = table["doc_id"].fill_null(LAST).to_numpy()
        self.words, self.off = word_hashes(table["text"])
        self.k, self.at = k, windows(self.off, k)
        self.edges, self.inv, self.counts = np.unique(span(rolling(self.words), self.at, self.at + k), return_inverse=True, return_counts=True)
        self.doc = np.searchsorted(self.off, self.at, side="right") - 1

    def repeated(self, answers: dict[int, bytes], parts: int) -> np.ndarray:
        """By distinct edge, after question 1."""
        bounds = cut(self.edges, parts)
        out = self.counts > 1
        for i, data in answers.items():
            lo, hi = bounds[i], bounds[i + 1]
            out[lo:hi] |= np.unpackbits(np.frombuffer(data, np.uint8), count=hi - lo).astype(bool)
        return out

    def ask_edges(self, maybe: np.ndarray) -> np.ndarray:
        """Question 2: the maybe repeated edges with the word after and before, 0 where they differ or there is none."""
        here = maybe[self.inv]
        at, inv, doc = self.at[here], self.inv[here], self.doc[here]
        low = (self.words & U(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)
        after = np.where(at + self.k < self.off[doc + 1], low[np.minimum(at + self.k, len(low) - 1)], 0)
        before = np.where(at > self.off[doc], low[np.maximum(at - 1, 0)], 0)
        o = np.argsort(inv, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], inv[o][1:] != inv[o][:-1]])) if len(o) else np.zeros(0, np.int64)
        out = np.zeros(len(first), EDGE)
        if len(first):
            out["h"], out["many"] = self.edges[maybe], self.counts[maybe] > 1
            out["next"], out["prev"] = same(after[o], first), same(before[o], first)
        return out

    def paths(self, maybe: np.ndarray, answers: dict[int, bytes], parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences of nonbranching paths: index of the first window, number of windows, first edge, second hash."""
        asked = self.edges[maybe]
        bounds, got = cut(asked, parts), np.zeros(len(asked), np.uint8)
        for i, data in answers.items():
            got[bounds[i] : bounds[i + 1]] = np.frombuffer(data, np.uint8)
        flags = np.zeros(len(self.edges), np.uint8)
        flags[maybe] = got
        f = flags[self.inv]
        on = (f & 1) > 0
        goes_on = on[:-1] & on[1:] & (f[:-1] & 2 > 0) & (f[1:] & 4 > 0) & (self.doc[1:] == self.doc[:-1])
        first = on.copy()
        first[1:] &= ~goes_on
        last = on.copy()
        last[:-1] &= ~goes_on
        lo, hi = np.flatnonzero(first), np.flatnonzero(last)
        check = span(rolling(self.words, "check"), self.at[lo], self.at[hi] + self.k)
        return lo, hi - lo + 1, self.edges[self.inv[lo]], check


def same(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    lo, hi = np.minimum.reduceat(values, first), np.maximum.reduceat(values, first)
    return np.where(lo == hi, lo, 0)


def local_paths(c: Chunk, paths: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct paths of a chunk sorted by first edge, the occurrence that comes first of each, and the path of each occurrence."""
    lo, n, h, check = paths
    o = np.lexsort((np.arange(len(lo)), check, n, h))
    new = np.ones(len(o), bool)
    new[1:] = (h[o][1:] != h[o][:-1]) | (n[o][1:] != n[o][:-1]) | (check[o][1:] != check[o][:-1])
    of = np.zeros(len(o), np.int64)
    of[o] = np.cumsum(new) - 1
    first = o[new]
    rows = np.zeros(len(first), PATH)
    rows["h"], rows["n"], rows["check"], rows["doc"] = h[first], n[first], check[first], c.doc_ids[c.doc[lo[first]]]
    return rows, first, of


def by_step(answers: pa.Table) -> dict[int, dict[int, bytes]]:
    out: dict[int, dict[int, bytes]] = {1: {}, 2: {}, 3: {}}
    for step, part, data in zip(*(answers[x].to_pylist() for x in ("step", "part", "data")), strict=True):
        out[step][part] = data
    return out


def answered(step: int, table: pa.Table, results: list[bytes]) -> pa.Table:
    n = table.num_rows
    return pa.table([table["chunk"].cast(pa.int32()), pa.array([step] * n, pa.int32()), table["part"].cast(pa.int32()), pa.array(results, pa.binary())], schema=ANSWER)


def gathered(table: pa.Table) -> tuple[list[bytes], np.ndarray]:
    data = table["data"].to_pylist()
    return data, np.cumsum([0] + [len(x) for x in data])


def drop_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_removed, text`` (kept words, one space between).

    Words are runs of anything but space, tab, line feed, vertical tab, form feed, return; null text has
    none. Every word in a window of ``window`` words is removed whose words also start earlier: in a
    smaller id, or earlier in the same document. Null ids come last. Rows that share an id count in the
    order of their texts; of fully equal rows the first is kept. Texts shorter than the window stay as
    they are. An empty table gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    size = slim.agg(F.sum(F.octet_length("text")).alias("b")).first().b or 0
    chunk_bytes = min(128 << 20, max(1 << 20, int((size * 8192) ** 0.5)))
    chunks = max(1, size // chunk_bytes)
    parts, width = chunks, min(8, max(4, -(-(int(size).bit_length() + 10) // 8)))
    spark = docs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(chunks, 4096))
    dealt = slim.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int")).repartition(tasks, "chunk")

    def q1(table: pa.Table) -> pa.Table:
        c = Chunk(table, window)
        return packed(c.id, c.edges.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :width], cut(c.edges, parts))

    def a1(table: pa.Table) -> pa.Table:
        data, ends = gathered(table)
        wide = np.zeros((ends[-1] // width, 8), np.uint8)
        wide[:, :width] = np.frombuffer(b"".join(data), np.uint8).reshape(-1, width)
        values = wide.view(">u8").ravel().astype(U)
        o = np.argsort(values, kind="stable")
        equal = values[o][1:] == values[o][:-1]
        again = np.zeros(len(values), bool)
        again[o[1:][equal]] = True
        again[o[:-1][equal]] = True
        ends = ends // width
        return answered(1, table, [np.packbits(again[ends[i] : ends[i + 1]]).tobytes() for i in range(len(data))])

    def q2(docs_of: pa.Table, answers: pa.Table) -> pa.Table:
        c, got = Chunk(docs_of, window), by_step(answers)
        rows = c.ask_edges(c.repeated(got[1], parts))
        return packed(c.id, rows, cut(rows["h"], parts))

    def a2(table: pa.Table) -> pa.Table:
        data, ends = gathered(table)
        rows = np.frombuffer(b"".join(data), EDGE)
        o = np.argsort(rows["h"], kind="stable")
        h = rows["h"][o]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        size_of = np.diff(np.concatenate([first, [len(h)]]))
        flags = ((size_of > 1) | (np.maximum.reduceat(rows["many"][o], first) > 0)).astype(np.uint8)
        flags |= np.where(same(rows["next"][o], first) > 0, 2, 0).astype(np.uint8) | np.where(same(rows["prev"][o], first) > 0, 4, 0).astype(np.uint8)
        out = np.zeros(len(rows), np.uint8)
        out[o] = np.repeat(flags, size_of)
        ends = ends // EDGE.itemsize
        return answered(2, table, [out[ends[i] : ends[i + 1]].tobytes() for i in range(len(data))])

    def q3(docs_of: pa.Table, answers: pa.Table) -> pa.Table:
        c, got = Chunk(docs_of, window), by_step(answers)
        rows, _, _ = local_paths(c, c.paths(c.repeated(got[1], parts), got[2], parts))
        return packed(c.id, rows, cut(rows["h"], parts))

    def a3(table: pa.Table) -> pa.Table:
        data, ends = gathered(table)
        rows = np.frombuffer(b"".join(data), PATH)
        ends = ends // PATH.itemsize
        chunk = np.repeat(table["chunk"].to_numpy(), np.diff(ends))
        o = np.lexsort((chunk, rows["doc"], rows["check"], rows["n"], rows["h"]))
        r = rows[o]
        new = np.ones(len(r), bool)
        new[1:] = (r["h"][1:] != r["h"][:-1]) | (r["n"][1:] != r["n"][:-1]) | (r["check"][1:] != r["check"][:-1])
        own = np.zeros(len(r), bool)
        own[o] = new
        return answered(3, table, [np.packbits(own[ends[i] : ends[i + 1]]).tobytes() for i in range(len(data))])

    def result(docs_of: pa.Table, answers: pa.Table) -> pa.Table:
        c, got = Chunk(docs_of, window), by_step(answers)
        lo, n, h, check = paths = c.paths(c.repeated(got[1], parts), got[2], parts)
        rows, first, of = local_paths(c, paths)
        bounds, own = cut(rows["h"], parts), np.zeros(len(rows), bool)
        for i, data in got[3].items():
            own[bounds[i] : bounds[i + 1]] = np.unpackbits(np.frombuffer(data, np.uint8), count=bounds[i + 1] - bounds[i])
        drop = np.ones(len(lo), bool)
        drop[first[own]] = False
        edge = np.zeros(len(c.words) + 1, np.int64)
        np.add.at(edge, c.at[lo[drop]], 1)
        np.add.at(edge, c.at[lo[drop] + n[drop] - 1] + window, -1)
        keep = np.cumsum(edge[:-1]) == 0
        texts, removed = [], np.zeros(len(c.doc_ids), np.int64)
        for i, t in enumerate(c.table["text"]):
            words, k = t.as_py().encode().split(), keep[c.off[i] : c.off[i + 1]]
            removed[i] = len(k) - np.count_nonzero(k)
            texts.append(b" ".join(compress(words, k.tolist()) if removed[i] else words).decode())
        return pa.table({"doc_id": c.table["doc_id"], "n_words": np.diff(c.off), "n_removed": removed, "text": pa.array(texts, pa.string())})

    by_chunk = dealt.groupBy("chunk")
    first = by_chunk.applyInArrow(q1, ASK_SQL).groupBy("part").applyInArrow(a1, ANSWER_SQL)
    second = by_chunk.cogroup(first.groupBy("chunk")).applyInArrow(q2, ASK_SQL).groupBy("part").applyInArrow(a2, ANSWER_SQL)
    both = first.unionByName(second)
    third = by_chunk.cogroup(both.groupBy("chunk")).applyInArrow(q3, ASK_SQL).groupBy("part").applyInArrow(a3, ANSWER_SQL)
    return by_chunk.cogroup(both.unionByName(third).groupBy("chunk")).applyInArrow(result, KEPT_SQL)


def removal_table(docs: DataFrame) -> DataFrame:
    """The rows that the query on repeated passages returns: digests instead of texts."""
    return drop_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
