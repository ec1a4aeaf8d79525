"""Finding benchmark items in documents.

Words are compared without case (A to Z) and ASCII punctuation. An item is found where a window as long as
the item holds at least SIMILARITY of the item's shingle weight (distinct five-word shingles, rare ones
weigh more). Items whose shingles in the whole text weigh too little are left out, which loses nothing, as
no window holds more than the text; for the others all windows are weighed exactly. The best window's
64-bit SimHash and the item's, both of distinct weighted shingles, give the reported distance. They are no
filter: a sum near zero may turn over by a small change, so no radius below 64 keeps all windows at 0.8.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqframe.llm.ngram_join import sliced
from seqframe.llm.scratch import written
from seqframe.llm.tokens import SPACE_OR_MARK, U, mix, rolling, span, windows, word_hashes

WORDS, SIMILARITY, BITS = 5, 0.8, 64
#: Items are held in memory in blocks of so many; each block reads the documents once.
ITEMS_A_BLOCK = 20_000
FOUND_SQL = "doc_id long, item_id long, similarity double, word_start long, n_words long, distance int"


@dataclass
class Items:
    """Benchmark items by shingle, and their fingerprints. Shingles are places in ``known``."""

    ids: list[int]
    sizes: list[int]
    shingles: list[np.ndarray]
    whole: dict[int, list[int]] = field(default_factory=dict)
    known: np.ndarray = field(default_factory=lambda: np.zeros(0, U))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    holders: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    held_from: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    total: np.ndarray = field(default_factory=lambda: np.zeros(0))
    other: float = 1.0
    prints: list[int] = field(default_factory=list)
    bloom: np.ndarray = field(default_factory=lambda: np.zeros(1 << 20, bool))


def signs(shingles: np.ndarray) -> np.ndarray:
    return np.unpackbits(mix(shingles).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int8) * 2 - 1


def fingerprint(shingles: np.ndarray, weight: np.ndarray) -> int:
    """The signs of 64 weighted sums over distinct shingles, as one number."""
    total = (signs(shingles) * weight[:, None]).sum(axis=0)
    return int(np.packbits(total > 0).view(">u8")[0])


def prepare(rows: list[tuple[int, str]], n: int | None = None, counts: tuple[np.ndarray, np.ndarray] | None = None) -> Items:
    """n, counts: items of the whole benchmark, and how many hold each shingle of these rows; without them, rows are the whole benchmark."""
    n = len(rows) if n is None else n
    wh, off = word_hashes(pa.array([t for _, t in rows], pa.string()), True, SPACE_OR_MARK)
    sums = rolling(wh)
    items = Items([i for i, _ in rows], np.diff(off).tolist(), [])
    for k in range(len(rows)):
        at = np.arange(off[k], max(off[k], off[k + 1] - WORDS + 1))
        items.shingles.append(np.unique(span(sums, at, at + WORDS)))
        if 0 < items.sizes[k] < WORDS:
            items.whole.setdefault(int(span(sums, off[k : k + 1], off[k + 1 : k + 2])[0]), []).append(k)
    if any(len(s) for s in items.shingles):
        items.known, df = np.unique(np.concatenate(items.shingles), return_counts=True)
        if counts is not None:
            order = np.argsort(counts[0])
            df = counts[1][order][np.searchsorted(counts[0], items.known, sorter=order)]
        items.weight = 1 + np.log(n / df)
    items.other = 1 + math.log(max(1, n))
    items.bloom[(items.known & U((1 << 20) - 1)).astype(np.int64)] = True
    if len(items.known):
        items.shingles = [np.searchsorted(items.known, x) for x in items.shingles]
        of = np.repeat(np.arange(len(rows)), [len(x) for x in items.shingles])
        every = np.concatenate(items.shingles)
        items.holders = of[np.argsort(every, kind="stable")]
        items.held_from = np.concatenate([[0], np.cumsum(np.bincount(every, minlength=len(items.known)))])
    items.total = np.array([items.weight[x].sum() if len(x) else 0.0 for x in items.shingles])
    items.prints = [fingerprint(items.known[x], items.weight[x]) if len(x) else 0 for x in items.shingles]
    return items


def best_window(item: np.ndarray, weight: np.ndarray, at: np.ndarray, which: np.ndarray, width: int, last: int) -> tuple[float, int]:
    """(weight, start) of the window that holds most of an item's distinct shingles, the first of equals.

    at, which: ascending places of the item's shingles in a text; a window covers ``width`` places and starts at 0 to ``last``.
    """
    order = np.argsort(which, kind="stable")
    before = np.full(len(at), -1)
    again = np.flatnonzero(which[order][1:] == which[order][:-1]) + 1
    before[order[again]] = at[order[again - 1]]
    # a place counts for the starts that reach it and begin after the same shingle's place before
    lo, hi = np.maximum(before + 1, np.maximum(at - width + 1, 0)), np.minimum(at, last)
    lo, hi, w = lo[lo <= hi], hi[lo <= hi], weight[which[lo <= hi]]
    starts, place = np.unique(np.concatenate([lo, hi + 1]), return_inverse=True)
    held = np.cumsum(np.bincount(place, np.concatenate([w, -w]), len(starts)))
    start = int(starts[np.argmax(held >= held.max() - 1e-9 * weight[item].sum())])
    inside = which[np.searchsorted(at, start) : np.searchsorted(at, start + width)]
    return float(weight[item[np.isin(item, inside)]].sum()), start


def search(items: Items, texts: pa.Array) -> list[tuple[int, int, float, int, int]]:
    """(row, item, similarity, first word, distance) of the best window of each item found in each text."""
    wh, off = word_hashes(texts, True, SPACE_OR_MARK)
    sums, out = rolling(wh), []
    if items.whole:
        short = np.flatnonzero((np.diff(off) > 0) & (np.diff(off) < WORDS))
        for row, h in zip(short.tolist(), span(sums, off[short], off[short + 1]).tolist(), strict=True):
            out += [(row, k, 1.0, 0, 0) for k in items.whole.get(h, [])]
    if not len(items.known):
        return out
    at = windows(off, WORDS)
    sh = span(sums, at, at + WORDS)
    hit = np.flatnonzero(items.bloom[(sh & U((1 << 20) - 1)).astype(np.int64)])
    where = np.minimum(np.searchsorted(items.known, sh[hit]), len(items.known) - 1)
    same = items.known[where] == sh[hit]
    hit, where = hit[same], where[same]
    if not len(hit):
        return out
    doc = np.searchsorted(off, at[hit], side="right") - 1
    begins = np.flatnonzero(np.diff(doc, prepend=-1))
    for row, lo, hi in zip(doc[begins].tolist(), begins.tolist(), [*begins[1:].tolist(), len(doc)], strict=True):
        base, length = int(off[row]), int(off[row + 1] - off[row])
        places, which = at[hit[lo:hi]] - base, where[lo:hi]
        have = np.unique(which)
        n = items.held_from[have + 1] - items.held_from[have]
        owners = items.holders[np.repeat(items.held_from[have] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        some, owner = np.unique(owners, return_inverse=True)
        in_text = np.bincount(owner, np.repeat(items.weight[have], n))
        own = sh[hit[lo] - int(places[0]) :][: length - WORDS + 1]
        for k in some[in_text >= (SIMILARITY - 1e-9) * items.total[some]].tolist():
            x, width = items.shingles[k], items.sizes[k] - WORDS + 1
            mine = np.isin(which, x)
            held, start = best_window(x, items.weight, places[mine], which[mine], width, max(0, length - items.sizes[k]))
            share = held / float(items.weight[x].sum())
            if share >= SIMILARITY - 1e-9:
                window = np.unique(own[start : start + width])
                pos = np.minimum(np.searchsorted(items.known, window), len(items.known) - 1)
                fp = fingerprint(window, np.where(items.known[pos] == window, items.weight[pos], items.other))
                out.append((row, k, share, start, (fp ^ items.prints[k]).bit_count()))
    return out


def item_blocks(benchmark: DataFrame) -> Iterator[Items]:
    """Items with a text, in blocks of bounded count; shingles are weighed over the whole benchmark."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    count = items.count()
    n = max(1, -(-count // ITEMS_A_BLOCK))
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(n)))

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = prepare(list(enumerate(batch["text"].to_pylist())))
            held = [own.known[x].view(np.int64) for x in own.shingles if len(x)]
            blocks = np.repeat(batch["block"].to_numpy(), [len(x) for x in own.shingles])
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(np.concatenate([np.zeros(0, np.int64), *held]), pa.int64())], ["block", "shingle"])

    df = items.select("block", "text").mapInArrow(shingles, "block long, shingle long").groupBy("shingle").agg(F.count("*").alias("df"), F.collect_set("block").alias("blocks"))
    df = written(df.select(F.explode("blocks").alias("block"), "shingle", "df"), "item-shingles")
    for b in range(n):
        rows = [(r.item_id, r.text) for r in items.where(F.col("block") == b).orderBy("item_id", "text").collect()]
        known = df.where(F.col("block") == b).select("shingle", "df").toArrow()
        yield prepare(rows, count, (known["shingle"].to_numpy().view(U), known["df"].to_numpy()))


def find_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item found: ``doc_id, item_id, similarity, word_start, n_words, distance``.

    The best window of each is given, the first of equals. Null and empty texts, on either side, match
    nothing; items shorter than a shingle match only texts that consist of the same words. Rows that
    share a doc_id are searched each; items that share an id likewise. Empty tables give an empty
    result; other columns are ignored.
    """
    spark, out = docs.sparkSession, None
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    for block in item_blocks(benchmark):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in batches:
                ids, found = batch["doc_id"].to_pylist(), search(items, batch["text"])
                yield pa.RecordBatch.from_arrays([
                    pa.array([ids[f[0]] for f in found], pa.int64()), pa.array([items.ids[f[1]] for f in found], pa.int64()), pa.array([round(f[2], 6) for f in found], pa.float64()),
                    pa.array([f[3] for f in found], pa.int64()), pa.array([items.sizes[f[1]] for f in found], pa.int64()), pa.array([f[4] for f in found], pa.int32()),
                ], ["doc_id", "item_id", "similarity", "word_start", "n_words", "distance"])

        part = slim.mapInArrow(run, FOUND_SQL)
        out = part if out is None else out.unionByName(part)
    return out


def cleaned(items: Items, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in which no item is found; few rows are searched at a time, so large batches need no more memory."""
    for batch in sliced(batches):
        keep = np.ones(batch.num_rows, bool)
        keep[[f[0] for f in search(items, batch["text"])]] = False
        yield batch.filter(pa.array(keep))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows in which an item is found; columns and their order stay, whatever their names.

    Null and empty texts stay; ids are not read, so null and repeated ids are rows like others; equal texts
    stay or go together; an empty table on either side leaves ``docs`` as it is.
    """
    for block in item_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            yield from cleaned(shared.value, batches)

        docs = docs.mapInArrow(run, docs.schema)
    return docs
