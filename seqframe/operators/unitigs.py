"""Maximal nonbranching paths of k-mers: stretches found in the parts of contexts, then joined where they meet."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqframe.functions.sequence import acgt_reverse_complement
from seqframe.operators.graph import chains
from seqframe.operators.lookup import Near, joined_parts, table_rows
from seqframe.operators.packed import BASES, parts_of, spelt
from seqframe.sources.tables import written

#: Links up to this number are ordered in one task, more by rounds of joins.
IN_ONE_TASK = 1 << 22
FIELDS = "first long, last long, n long, least long, at long, bases string, kept boolean, linked boolean"
SCHEMA = pa.schema([("first", pa.int64()), ("last", pa.int64()), ("n", pa.int64()), ("least", pa.int64()), ("at", pa.int64()), ("bases", pa.string()), ("kept", pa.bool_()), ("linked", pa.bool_())])


def paths_of(after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes in the order of their paths, path by path, where each begins in that order (and the end), and which begin with a cut cycle.

    after: the next node of each, -1 where none; no node has two before it. A cycle is cut before its least node.
    """
    n = after.size
    before = np.full(n, -1)
    has = np.flatnonzero(after >= 0)
    before[after[has]] = has
    least = np.arange(n)

    def jumped(back: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first node of each node's path, how far it is away, and the least node met on the way; on a cycle any and all."""
        head, place, low = np.where(back < 0, np.arange(n), back), (back >= 0).astype(np.int64), np.minimum(least, np.where(back < 0, n, back))
        for _ in range(max(1, n).bit_length()):
            further = head[head]
            if (further == head).all():
                break
            place, low, head = place + place[head], np.minimum(low, low[head]), further
        return head, place, low

    head, place, low = jumped(before)
    ring = before[head] >= 0
    if ring.any():
        before[np.unique(low[ring])] = -1
        head, place, _ = jumped(before)
    order = np.lexsort((place, head))
    edges = np.append(np.flatnonzero(place[order] == 0), n)
    cut = np.zeros(n, bool)
    cut[np.unique(low[ring])] = True
    return order, edges, cut[order[edges[:-1]]]


def stretches_of(kmers: np.ndarray, part: int, k: int) -> pa.RecordBatch:
    """Rows of FIELDS from the k-mers with a context in the part: paths along kept links there, as ends and the bases beyond the first,
    and k-mers (n = 0) of which the part knows one side or both: whether a link is kept, and whether there is one at all.

    A link is kept where its context has one k-mer before it and one after it.
    """
    near = Near(kmers, np.ones(kmers.size, np.int64), k)
    ours = parts_of(near.names, k - 1) == part
    n_after, n_before = ((t[:-1] > 0).sum(axis=1) for t in (near.after, near.before))
    kept = ours & (n_after == 1) & (n_before == 1)
    x = near.names[kept]
    src = (near.before[:-1][kept].argmax(axis=1).astype(np.uint64) << np.uint64(2 * (k - 1))) | x
    dst = (x << np.uint64(2)) | near.after[:-1][kept].argmax(axis=1).astype(np.uint64)
    nodes = np.unique(np.concatenate([src, dst]))
    after = np.full(nodes.size, -1)
    after[np.searchsorted(nodes, src)] = np.searchsorted(nodes, dst)
    order, edges, ring = paths_of(after)
    at, to = edges[:-1], edges[1:]
    # of a cycle the first node comes again at its end
    again = np.insert(order, to[ring], order[at[ring]]) if ring.any() else order
    size = to - at + ring
    ends = np.cumsum(size)
    begin = ends - size
    letters = BASES[(nodes[again] & np.uint64(3)).astype(np.int64)] if nodes.size else np.zeros(0, np.uint8)
    beyond = np.ones(letters.size, bool)
    beyond[begin] = False
    offsets = np.concatenate(([0], np.cumsum(size - 1)))
    bases = pa.StringArray.from_buffers(size.size, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(letters[beyond])))
    # the least node of each but its last, and where it is
    least, where = np.zeros(size.size, np.int64), np.zeros(size.size, np.int64)
    if size.size:
        inner = again.copy()
        inner[ends - 1] = nodes.size
        low = np.minimum.reduceat(inner, begin)
        where = np.flatnonzero(inner == np.repeat(low, size)) - begin
        least = nodes[low].view(np.int64)
    # sides of k-mers as they are in the table: heads of the contexts behind them, tails of those before them
    low = np.uint64((1 << 2 * (k - 1)) - 1)
    behind, ahead = near.rows_of(kmers & low), near.rows_of(kmers >> np.uint64(2))
    some_kept, some_linked, sides = np.zeros(kmers.size, bool), np.zeros(kmers.size, bool), np.zeros(kmers.size, np.int64)
    for row, n in ((behind, n_after), (ahead, n_before)):
        some_kept |= kept[row]
        some_linked |= ours[row] & (n[row] > 0)
        sides += ours[row]
    # a k-mer that has a kept link is in a path; of one known here by both sides only the lone one is told, else all
    told = (sides == 1) | ((sides == 2) & ~some_kept & some_linked)
    lone = kmers[told].view(np.int64)
    columns = [
        pa.array(np.concatenate([nodes[again[begin]].view(np.int64) if size.size else np.zeros(0, np.int64), lone])),
        pa.array(np.concatenate([nodes[again[ends - 1]].view(np.int64) if size.size else np.zeros(0, np.int64), lone])),
        pa.array(np.concatenate([size - 1, np.zeros(lone.size, np.int64)]).astype(np.int64)),
        pa.array(np.concatenate([least, lone])),
        pa.array(np.concatenate([where, np.zeros(lone.size, np.int64)])),
        pa.concat_arrays([bases, pa.nulls(lone.size, pa.string())]),
        pa.array(np.concatenate([np.ones(size.size, bool), some_kept[told]])),
        pa.array(np.concatenate([np.ones(size.size, bool), some_linked[told]])),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=SCHEMA)


def stretches(counts: DataFrame, k: int) -> DataFrame:
    """Rows of FIELDS of the whole table."""

    def parts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, kmers, _ in joined_parts(it):
            found = stretches_of(kmers, part, k)
            for at in range(0, found.num_rows, 1 << 16):
                yield found.slice(at, 1 << 16)

    rows = table_rows(counts, k).repartition("part").sortWithinPartitions("part")
    return rows.mapInArrow(parts, FIELDS)


def named(rows: DataFrame, k: int, *columns: str) -> DataFrame:
    """Numbers in the columns as strings of k letters."""
    names = rows.columns

    def spell(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            new = [spelt(b.column(c).to_numpy(zero_copy_only=False).view(np.uint64), k) if c in columns else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(new, names)

    return rows.mapInArrow(spell, ", ".join(f"{f.name} {'string' if f.name in columns else f.dataType.simpleString()}" for f in rows.schema.fields))


def heads_of(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``node, head, place`` of the nodes first of links first -> last whose path has a beginning, and ``node`` of those on cycles. By pointer jumping."""
    before = links.select(F.col("last").alias("l"), F.col("first").alias("b"))
    now = links.select("first").join(before, F.col("first") == F.col("l"), "left")
    now = written(now.select(F.col("first").alias("node"), F.coalesce("b", "first").alias("head"), F.col("b").isNotNull().cast("long").alias("place"), F.col("b").isNull().alias("whole")), "heads")
    total, rounds = now.count(), 0
    # those that have not reached a beginning jump on
    while (1 << rounds) <= total and not now.where("not whole").isEmpty():
        ahead = now.select(F.col("node").alias("h"), F.col("head").alias("head2"), F.col("place").alias("place2"), F.col("whole").alias("whole2"))
        jumped = now.where("not whole").join(ahead, F.col("head") == F.col("h")).select("node", F.col("head2").alias("head"), (F.col("place") + F.col("place2")).alias("place"), F.col("whole2").alias("whole"))
        now, rounds = written(now.where("whole").unionByName(jumped), "heads"), rounds + 1
    return now.where("whole").drop("whole"), now.where("not whole").select("node")


def ordered(links: DataFrame) -> DataFrame:
    """``node, head, place, ring, least, turn`` of all links first -> last, in one task: on a cycle (ring) head is any node of it, least its
    least k-mer, and turn the steps from head to that."""
    kinds = [("node", pa.int64()), ("head", pa.int64()), ("place", pa.int64()), ("ring", pa.bool_()), ("least", pa.int64()), ("turn", pa.int64())]

    def order_all(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in it if b.num_rows]
        if not batches:
            return
        found = pa.Table.from_batches(batches)
        first, last, n, least, at = (found.column(c).to_numpy() for c in ("first", "last", "n", "least", "at"))
        by = np.argsort(first)
        first, last, n, least, at = first[by], last[by], n[by], least[by], at[by]
        to = np.minimum(np.searchsorted(first, last), first.size - 1)
        order, edges, ring = paths_of(np.where(first[to] == last, to, -1))
        begin, size = edges[:-1], np.diff(edges)
        nth = np.repeat(np.arange(begin.size), size)
        steps = np.cumsum(n[order]) - n[order]
        steps = steps - steps[begin][nth]
        low = np.minimum.reduceat(least[order], begin)
        where = np.flatnonzero(least[order] == low[nth])
        where = where[np.unique(nth[where], return_index=True)[1]]
        turn = steps[where] + at[order][where]
        columns = [first[order], first[order][begin][nth], np.arange(first.size) - begin[nth], ring[nth], low[nth], turn[nth]]
        for i in range(0, first.size, 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c[i : i + (1 << 16)], t) for c, (_, t) in zip(columns, kinds, strict=True)], [x for x, _ in kinds])

    return links.select("first", "last", "n", "least", "at").coalesce(1).mapInArrow(order_all, "node long, head long, place long, ring boolean, least long, turn long")


def packed_unitigs(counts: DataFrame, k: int) -> DataFrame:
    """``head, n, seq``: as graph.unitig_sequences(), of k-mers of k letters, k at most LONGEST_K."""
    found = written(stretches(counts, k), "stretches")
    links = found.where("n > 0").select("first", "last", "n", "least", "at", "bases")
    # each k-mer of the table stands for two nodes, a palindrome for one
    alone = found.where("n = 0").groupBy("first").agg(F.max("kept").alias("kept"), F.max("linked").alias("linked")).where("linked and not kept").select(F.col("first").alias("head"))
    both = named(alone, k, "head").select(F.explode(F.array_distinct(F.array("head", acgt_reverse_complement("head")))).alias("head")).select("head", F.lit(1).cast("long").alias("n"), F.col("head").alias("seq"))
    joined = lambda x: F.array_join(F.transform(x, lambda y: y["bases"]), "")
    all_bases = F.array_sort(F.collect_list(F.struct("place", "bases"))).alias("all")
    if links.count() <= IN_ONE_TASK:
        rows = links.drop("least").join(written(ordered(links), "order"), F.col("first") == F.col("node"))
        rows = rows.groupBy("head").agg(F.sum("n").alias("n"), all_bases, F.first("ring").alias("ring"), F.first("least").alias("least"), F.first("turn").cast("int").alias("turn"))
        rows = named(rows.select(F.when(F.col("ring"), F.col("least")).otherwise(F.col("head")).alias("head"), "n", "ring", "turn", joined("all").alias("tail")), k, "head")
        # a cycle from its least k-mer on, which its last letter would lead to again
        tail = F.when(F.col("ring"), F.expr("concat(substring(tail, turn + 1), left(tail, turn))")).otherwise(F.col("tail"))
        rows = rows.withColumn("tail", tail).withColumn("tail", F.when(F.col("ring"), F.expr("left(tail, length(tail) - 1)")).otherwise(F.col("tail")))
        return rows.select("head", F.when(F.col("ring"), F.col("n")).otherwise(F.col("n") + 1).alias("n"), F.concat("head", "tail").alias("seq")).unionByName(both)
    heads, ring = heads_of(links)
    rows = links.join(heads, F.col("first") == F.col("node")).groupBy("head").agg((F.sum("n") + 1).alias("n"), all_bases)
    out = named(rows.select("head", "n", joined("all").alias("tail")), k, "head").select("head", "n", F.concat("head", "tail").alias("seq"))
    out = out.unionByName(both)
    if ring.isEmpty():
        return out
    # cycles are few: their links one by one
    rings = named(links.join(ring, F.col("first") == F.col("node"), "left_semi"), k, "first").select(F.concat("first", "bases").alias("s"), "n")
    each = rings.select("s", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i"))
    layout = chains(written(each.select(F.expr(f"substring(s, i, {k})").alias("src"), F.expr(f"substring(s, i + 1, {k})").alias("dst")), "rings"))
    last = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.right("node", F.lit(1)).alias("b")))), lambda x: x["b"]), "")
    grouped = layout.groupBy("head").agg(F.count("*").alias("n"), last.alias("tail"))
    return out.unionByName(grouped.select("head", "n", F.concat(F.col("head"), F.expr("substring(tail, 2)")).alias("seq")))


def packed_successors(counts: DataFrame, k: int) -> DataFrame:
    """``src, dst``: as kmers.successors(), of k-mers of k letters, k at most LONGEST_K: k-mers before and behind a context meet in its part."""

    def parts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, kmers, _ in joined_parts(it):
            near = Near(kmers, np.ones(kmers.size, np.int64), k)
            ours = np.flatnonzero(parts_of(near.names, k - 1) == part)
            row, p, q = np.nonzero((near.before[ours] > 0)[:, :, None] & (near.after[ours] > 0)[:, None, :])
            x = near.names[ours[row]]
            src, dst = (p.astype(np.uint64) << np.uint64(2 * (k - 1))) | x, (x << np.uint64(2)) | q.astype(np.uint64)
            for at in range(0, src.size, 1 << 16):
                yield pa.RecordBatch.from_arrays([spelt(c[at : at + (1 << 16)], k) for c in (src, dst)], ["src", "dst"])

    return table_rows(counts, k).repartition("part").sortWithinPartitions("part").mapInArrow(parts, "src string, dst string")
