"""Similarity join of documents on word n-grams, and the components of its links.

Documents with equal shingle sets form one node. Sets are ordered rare shingles first (shingles that
many documents hold, found by a count, come last), and two sets as similar as asked share a shingle
among the first of each: these prefixes deal the nodes into tiles of one shingle, within which only
nodes of near sizes meet. Of each pair, hashed bitmaps bound the overlap from above: every bit that one
bitmap has and the other lacks stands for a shingle outside the intersection. What the bound leaves is
decided by intersecting the sorted shingle arrays.

In a small tile nodes first meet those that follow them in the order of sizes, and then all others of
other components. Large tiles are not gathered. Their nodes first meet a few others in a random order within a size band,
one of a few orders, so that tiles of the same nodes ask for the same pairs; this connects groups of near
copies with a number of pairs in proportion to the nodes. Then tiles that still hold several components
are cut into blocks, and each pair of blocks tests its pairs between components. Links inside a component
change nothing, so the components are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqframe.llm.components import components, merged
from seqframe.llm.scratch import dropped, written
from seqframe.llm.substring_dedup import ASK_SQL, cut
from seqframe.llm.tokens import U, mix, shingle_sets

LAST = np.iinfo(np.int64).max
MOST_COMMON = 1 << 20
TILE = 128
BLOCK = 512
#: Pairs of small tiles that a task holds at a time.
PAIRS_AT_ONCE = 1 << 20
#: In a larger tile a node meets so many nodes after it, in one of so many orders.
NEIGHBOURS, ORDERS = 2, 3
ENTRY = np.dtype([("h", "<u8"), ("node", "<i8"), ("n", "<u4"), ("pos", "<u4")])
#: Documents hashed at a time: a batch of long documents stays small in memory.
AT_ONCE = 256
#: Bits of a filter that tells which documents a check of candidates, or the end of keep_one, may need: 16 a document, 32 MB at most.
FILTER_BITS = 1 << 28
#: Bits of one row of the filter of keep_one (4 KB).
SLICE = 32768
SETS_SQL = "doc_id long, k1 long, k2 long, n long, s1 long, s2 long, prefix binary, bits binary"


def squeezed(x: np.ndarray) -> bytes:
    """Entries in the order of their shingles, compressed: differences of shingles, nodes from the least one; column by column, byte by byte."""
    least = x["node"].min()
    columns = [np.diff(x["h"], prepend=U(0)), (x["node"] - least).astype(U), x["n"], x["pos"]]
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(x), -1).T.tobytes() for c in columns]
    return least.tobytes() + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unsqueezed(data: bytes) -> np.ndarray:
    """The entries that squeezed() got."""
    raw = zstandard.ZstdDecompressor().decompress(data[8:])
    x = np.zeros(len(raw) // ENTRY.itemsize, ENTRY)
    at = 0
    for name, kind in (("h", "<u8"), ("node", "<u8"), ("n", "<u4"), ("pos", "<u4")):
        size = np.dtype(kind).itemsize * len(x)
        column = np.ascontiguousarray(np.frombuffer(raw, np.uint8, size, at).reshape(-1, len(x)).T).view(kind).ravel()
        x[name] = np.cumsum(column, dtype=U) if name == "h" else column
        at += size
    x["node"] += np.frombuffer(data, "<i8", 1)[0]
    return x


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, AT_ONCE):
            yield batch.slice(i, AT_ONCE)


def required(na: np.ndarray, nb: np.ndarray, num: int, den: int) -> np.ndarray:
    """The least overlap at which den * intersection >= num * union."""
    return -(-num * (na + nb) // (num + den))


def prefix_length(n: int, num: int, den: int) -> int:
    """Two sets as similar as asked share one of the first so many shingles of each."""
    return n - -(-num * n // den) + 1


def bitmap(shingles: np.ndarray) -> bytes:
    """One bit a hashed shingle, about two bits of room for each; the length is a power of two bytes, at least 16."""
    bits = 128
    while bits < 2 * len(shingles):
        bits *= 2
    at = np.zeros(bits, np.uint8)
    at[(mix(shingles) & U(bits - 1)).astype(np.int64)] = 1
    return np.packbits(at).tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """A bitmap as it would be at a smaller power of two: bit positions are taken modulo the new size."""
    return np.bitwise_or.reduce(bits.reshape(-1, size), axis=0)


def may_link(a: bytes, b: bytes, na: int, nb: int, num: int, den: int) -> bool:
    """Whether the bit counts leave an overlap as large as required."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) != len(y):
        size = min(len(x), len(y))
        x, y = folded(x, size), folded(y, size)
    both = int(np.bitwise_count(x & y).sum())
    most = min(na - (int(np.bitwise_count(x).sum()) - both), nb - (int(np.bitwise_count(y).sum()) - both))
    return most * (num + den) >= num * (na + nb)


def similar_groups(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id``.

    Texts are compared after lower-casing A to Z, by their distinct shingles of ``words`` words (fewer
    words: all as one shingle). Two link when den * |intersection| >= num * |union|. Null, empty and
    blank texts have no shingle and no link. component_id is the smallest id that links reach; null ids
    come last and give a null component unless another id is reached. Repeated rows fall in one
    component. An empty table gives an empty result; other columns are ignored.
    """
    real = lambda c: F.when(c != LAST, c)
    return _grouped(docs, words, num, den, id_col, text_col)[0].select(
        real(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), real(F.col("component_id")).alias("component_id")
    )


def row_keys(id_col: str, text_col: str) -> list[Column]:
    """Two hashes that tell apart rows of different id or text."""
    return [F.xxhash64(F.lit(i), F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))).alias(f"k{i}") for i in (1, 2)]


def _grouped(docs: DataFrame, words: int, num: int, den: int, id_col: str, text_col: str) -> tuple[DataFrame, list[DataFrame]]:
    """One row per input row: ``doc_id, k1, k2, n, comp, component_id``; null ids are LAST, comp is a node of the component. With the tables it reads."""
    slim = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *row_keys(id_col, text_col))
    spark = docs.sparkSession

    def local_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # counted over a batch of some MB; shingles that are common overall repeat in many of them
        seen, size, total = [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            values, counts = np.unique(np.concatenate(seen), return_counts=True)
            much = counts > 2
            values, counts = np.append(values[much].astype(np.int64), 0), np.append(counts[much], total)
            kind = np.zeros(len(values), bool)
            kind[-1] = True
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts.astype(np.int64)), pa.array(kind)], ["h", "c", "total"])

        for batch in sliced(batches):
            s, off = shingle_sets(batch["text"], words)
            seen.append(s)
            size, total = size + len(s), total + len(s)
            if size > 4_000_000:
                yield from flush()
                seen, size, total = [], 0, 0
        if seen:
            yield from flush()

    counted = written(slim.select("text").mapInArrow(local_counts, "h long, c long, total boolean").groupBy("h", "total").agg(F.sum("c").alias("c")), "common")
    all_shingles = counted.where("total").agg(F.sum("c").alias("c")).first().c or 0
    least = max(64, all_shingles // MOST_COMMON)
    # at most MOST_COMMON values of 8 bytes, whatever the corpus is
    common = np.sort(np.array([r.h for r in counted.where(~F.col("total") & (F.col("c") >= least)).select("h").toLocalIterator()], dtype=np.int64).astype(U))
    shared = spark.sparkContext.broadcast(common)

    def is_common(h: np.ndarray) -> np.ndarray:
        known = shared.value
        if not len(known):
            return np.zeros(len(h), bool)
        return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            s, off = shingle_sets(batch["text"], words)
            far, m = is_common(s), mix(s)
            with_all = np.concatenate([[U(0)], np.cumsum(m)]), np.concatenate([[U(0)], np.cumsum(mix(m ^ U(0x5851F42D4C957F2D)))])
            n = np.diff(off)
            prefixes, bits = [], []
            for i, k in enumerate(n):
                if not k:
                    prefixes.append(b"")
                    bits.append(b"")
                    continue
                own, late = s[off[i] : off[i + 1]], far[off[i] : off[i + 1]]
                ordered = np.concatenate([own[~late], own[late]]) if late.any() else own
                prefixes.append(ordered[: prefix_length(int(k), num, den)].tobytes())
                bits.append(bitmap(own))
            sums = [(x[off[1:]] - x[off[:-1]]).astype(np.int64) for x in with_all]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["k1"], batch["k2"], pa.array(n), pa.array(sums[0]), pa.array(sums[1]), pa.array(prefixes, pa.binary()), pa.array(bits, pa.binary())],
                ["doc_id", "k1", "k2", "n", "s1", "s2", "prefix", "bits"],
            )

    sets = written(slim.mapInArrow(describe, SETS_SQL).withColumn("rid", F.monotonically_increasing_id()), "sets")
    classes = written(
        sets.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("rid").alias("node"), F.min("doc_id").alias("first_doc")), "classes"
    )
    # the rows that stand for no class are few, and leaving them out spares a shuffle of the prefixes
    of_class = classes.select(F.col("s1").alias("c1"), F.col("s2").alias("c2"), F.col("n").alias("c3"), "node")
    others = sets.where("n > 0").select("rid", "s1", "s2", "n").join(of_class, (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2")) & (F.col("n") == F.col("c3")))
    others = written(others.where("rid <> node").select(F.col("rid").alias("of")), "others")
    nodes = sets.where("n > 0").join(others, F.col("rid") == F.col("of"), "left_anti").select("rid", "n", "prefix")
    parts = max(16, min(1 << 16, (all_shingles * (den - num) // den) // 200_000))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, part = [], 0, 0
        for batch in batches:
            for node, n, prefix in zip(batch["rid"].to_numpy(), batch["n"].to_numpy(), batch["prefix"].to_pylist(), strict=True):
                h = np.frombuffer(prefix, U)
                x = np.zeros(len(h), ENTRY)
                x["h"], x["node"], x["n"], x["pos"] = h, node, n, np.arange(len(h))
                rows.append(x)
                size += len(h)
            if size > 1_000_000:
                yield from flushed(rows, part)
                rows, size, part = [], 0, part + 1
        if rows:
            yield from flushed(rows, part)

    def flushed(rows: list[np.ndarray], part: int) -> Iterator[pa.RecordBatch]:
        x = np.concatenate(rows)
        x = x[np.argsort(x["h"], kind="stable")]
        hot = is_common(x["h"])
        usual = x[~hot]
        bounds = cut(usual["h"], parts)
        at = [(i, usual[bounds[i] : bounds[i + 1]]) for i in range(parts) if bounds[i] < bounds[i + 1]]
        # common shingles go to parts of their own kind, dealt by their count, not by their value
        at += [(-1 - (part * 31 + i // 4096) % 1024, x[hot][i : i + 4096]) for i in range(0, int(hot.sum()), 4096)]
        data = pa.array([squeezed(piece) for _, piece in at], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in at], pa.int32()), pa.array([part] * len(at), pa.int32()), data], ["part", "chunk", "data"])

    def tiles(table: pa.Table) -> pa.Table:
        x = np.concatenate([unsqueezed(d) for d in table["data"].to_pylist()])
        if table["part"][0].as_py() < 0:
            return tile_rows(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), x)
        x = x[np.lexsort((x["node"], x["n"], x["h"]))]
        first = np.flatnonzero(np.concatenate([[True], x["h"][1:] != x["h"][:-1]]))
        size = np.diff(np.append(first, len(x)))
        big = np.repeat(size > TILE, size)
        few = x[~big & np.repeat(size > 1, size)]
        # whole tiles, so many that their pairs stay few in memory; a pair may come out of several
        size = size[(size > 1) & (size <= TILE)]
        group = np.cumsum(size * (size - 1) // 2) // PAIRS_AT_ONCE
        ends = np.cumsum(size)[np.flatnonzero(np.append(group[1:] != group[:-1], True))] if len(size) else np.zeros(0, np.int64)
        found = [pairs_in(few[i:j]) for i, j in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)] if len(ends) else [pairs_in(few)]
        return tile_rows(*(np.concatenate(c) for c in zip(*found, strict=True)), x[big])

    def pairs_in(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs in one tile (rows sorted by shingle, size and node) that sizes and positions allow, and whether they follow each other there."""
        if len(x) < 2:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        n, pos = x["n"].astype(np.int64), x["pos"].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], x["h"][1:] != x["h"][:-1]]))
        end = np.repeat(np.append(first[1:], len(x)), np.diff(np.append(first, len(x))))
        i = np.repeat(np.arange(len(x)), end - np.arange(len(x)) - 1)
        j = i + 1 + np.arange(len(i)) - np.searchsorted(i, i)
        ok = n[j] * num <= n[i] * den
        i, j = i[ok], j[ok]
        ok = 1 + np.minimum(n[i] - pos[i], n[j] - pos[j]) - 1 >= required(n[i], n[j], num, den)
        i, j = i[ok], j[ok]
        a, b = x["node"][i], x["node"][j]
        o = np.lexsort((j - i > NEIGHBOURS, np.maximum(a, b), np.minimum(a, b)))
        a, b, near = np.minimum(a, b)[o], np.maximum(a, b)[o], (j - i <= NEIGHBOURS)[o]
        new = np.ones(len(o), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return a[new], b[new], near[new]

    def tile_rows(a: np.ndarray, b: np.ndarray, near: np.ndarray, big: np.ndarray) -> pa.Table:
        none = np.zeros(len(big), bool)
        return pa.table({
            "a": np.concatenate([a, big["node"]]), "b": pa.array(np.concatenate([b, big["node"]]), mask=np.concatenate([np.zeros(len(b), bool), ~none])),
            "h": np.concatenate([np.zeros(len(a), np.int64), big["h"].astype(np.int64)]), "n": np.concatenate([np.zeros(len(a), np.int64), big["n"].astype(np.int64)]),
            "near": np.concatenate([near, none]),
        })

    tiled = written(nodes.mapInArrow(deal, ASK_SQL).groupBy("part").applyInArrow(tiles, "a long, b long, h long, n long, near boolean"), "tiles")
    band = F.floor(F.log("n") / math.log(den / num)).cast("int")
    entries = tiled.where("b is null").select(F.col("a").alias("node"), "h", "n", band.alias("band"))

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if before is not None:
                t = pa.concat_tables([before, t])
            h, bnd, node = (t[c].to_numpy() for c in ("h", "band", "node"))
            out = []
            for d in range(1, NEIGHBOURS + 1):
                if len(h) > d:
                    ok = (h[d:] == h[:-d]) & (bnd[d:] == bnd[:-d])
                    out.append(np.stack([node[:-d][ok], node[d:][ok]], axis=1))
            if out:
                x = np.concatenate(out)
                x = np.unique(np.sort(x, axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["a", "b"])
            before = t.slice(max(0, len(t) - NEIGHBOURS))

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = (
        entries.withColumn("r", F.xxhash64(F.pmod("h", F.lit(ORDERS)), "node")).repartitionByRange(tasks, "h", "band", "r").sortWithinPartitions("h", "band", "r")
        .select("h", "band", "node").mapInArrow(neighbours, "a long, b long")
    )
    small = tiled.where("b is not null").groupBy("a", "b").agg(F.max("near").alias("near"))
    links = verified(written(small.where("near").select("a", "b").unionByName(met).distinct(), "pairs"), sets, slim, words, num, den)
    known = components(links)
    dropped(links, counted)
    # the other pairs of small tiles, where they lie between components
    comp = lambda c: known.select(F.col("node").alias(f"o{c}"), F.col("comp").alias(f"c{c}"))
    rest = small.where("not near").join(comp("a"), F.col("a") == F.col("oa"), "left").join(comp("b"), F.col("b") == F.col("ob"), "left")
    rest = rest.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    more = verified(written(rest, "between"), sets, slim, words, num, den)
    known = merged(known, more)
    dropped(more)

    # tiles of common shingles that still hold more than one component
    labelled = written(
        entries.join(known.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
        .select("h", "n", "band", "node", F.coalesce("comp", "node").alias("comp")), "labelled",
    )
    dropped(tiled)
    mixed = labelled.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select(F.col("h").alias("of_h"))
    open_ = labelled.join(mixed, F.col("h") == F.col("of_h")).drop("of_h")
    # a pair of nodes is tested in one tile only, the smallest that both lie in
    held_in = open_.groupBy(F.col("node").alias("n_of")).agg(F.array_sort(F.collect_list("h")).alias("tiles"))
    open_ = written(open_, "mixed")
    own_bits = bits_of(sets, open_.select("node"))
    open_ = open_.join(own_bits.select(F.col("rid").alias("of"), "bits"), F.col("node") == F.col("of")).drop("of")
    open_ = written(open_.join(held_in, F.col("node") == F.col("n_of")).drop("n_of"), "open")
    if not open_.isEmpty():
        split = written(open_.groupBy("h", "band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("k")), "blocks")
        here = split.select(F.col("h").alias("h1"), F.col("band").alias("b1"), "k")
        nxt = split.select(F.col("h").alias("h2"), (F.col("band") - 1).alias("b2"), F.col("k").alias("k_next"))
        prv = split.select(F.col("h").alias("h3"), (F.col("band") + 1).alias("b3"), F.col("k").alias("k_prev"))
        x = open_.join(here, (F.col("h") == F.col("h1")) & (F.col("band") == F.col("b1")))
        x = x.join(nxt, (F.col("h") == F.col("h2")) & (F.col("band") == F.col("b2")), "left")
        x = x.join(prv, (F.col("h") == F.col("h3")) & (F.col("band") == F.col("b3")), "left")
        x = x.withColumn("s", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
        # a block (band, s) meets its own band's blocks, each pair once, and all blocks of the next band
        x = x.select("*", F.explode(F.expr("""concat(
            transform(sequence(0, k - 1), t -> struct(band as band_a, least(s, t) as s_a, band as band_b, greatest(s, t) as s_b)),
            if(k_next is null, array(), transform(sequence(0, k_next - 1), t -> struct(band as band_a, s as s_a, band + 1 as band_b, t as s_b))),
            if(k_prev is null, array(), transform(sequence(0, k_prev - 1), t -> struct(band - 1 as band_a, t as s_a, band as band_b, s as s_b))))""")).alias("t"))

        def block(table: pa.Table) -> pa.Table:
            node, comp, n = (table[c].to_numpy() for c in ("node", "comp", "n"))
            bnd, salt, bits = table["band"].to_numpy(), table["s"].to_numpy(), table["bits"].to_pylist()
            here, tiles_of = table["h"][0].as_py(), table["tiles"].to_pylist()
            t = table["t"][0].as_py()
            left = (bnd == t["band_a"]) & (salt == t["s_a"])
            right = (bnd == t["band_b"]) & (salt == t["s_b"])
            alone = t["band_a"] == t["band_b"] and t["s_a"] == t["s_b"]
            size = min(map(len, bits))
            x = np.stack([folded(np.frombuffer(z, np.uint8), size) for z in bits])
            ones, a, b = np.bitwise_count(x).sum(axis=1, dtype=np.int64), [], []
            js = np.flatnonzero(right)
            for i in np.flatnonzero(left):
                j = js[(comp[js] != comp[i]) & (np.minimum(n[js], n[i]) * den >= np.maximum(n[js], n[i]) * num)]
                if alone:
                    j = j[j > i]
                both = np.bitwise_count(x[j] & x[i]).sum(axis=1, dtype=np.int64)
                most = np.minimum(n[i] - (ones[i] - both), n[j] - (ones[j] - both))
                for q in j[most * (num + den) >= num * (n[i] + n[j])]:
                    if min(set(tiles_of[i]).intersection(tiles_of[q])) == here and may_link(bits[i], bits[q], int(n[i]), int(n[q]), num, den):
                        a.append(min(node[i], node[q]))
                        b.append(max(node[i], node[q]))
            return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        rest = x.select("h", "t", "node", "comp", "n", "band", "s", "bits", "tiles").groupBy("h", "t").applyInArrow(block, "a long, b long").distinct()
        more = verified(written(rest, "rest"), sets, slim, words, num, den)
        known = merged(known, more)
        dropped(more, split)
    dropped(open_, labelled)

    own = classes.join(known.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select(
        "s1", "s2", "n", "node", F.coalesce("comp", "node").alias("comp"), "first_doc"
    )
    own = written(own, "own")
    dropped(classes)
    least_doc = written(own.groupBy("comp").agg(F.min("first_doc").alias("component_id")), "least").withColumnRenamed("comp", "of")
    named = own.join(least_doc, F.col("comp") == F.col("of")).select(F.col("s1").alias("o1"), F.col("s2").alias("o2"), F.col("n").alias("o3"), "comp", "component_id")
    named = written(named, "named")
    dropped(own, known)
    out = sets.join(named, (F.col("s1") == F.col("o1")) & (F.col("s2") == F.col("o2")) & (F.col("n") == F.col("o3")), "left")
    return out.select("doc_id", "k1", "k2", "n", "comp", F.coalesce("component_id", "doc_id").alias("component_id")), [sets, named]


def bits_of(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """``rid, n, bits`` of some nodes, written: all bitmaps are read past the list of nodes once, and only theirs are joined."""
    wanted = written(nodes.select(F.col("node").alias("of")).distinct(), "wanted")
    out = written(sets.select("rid", "n", "bits").join(wanted, F.col("rid") == F.col("of"), "left_semi"), "bits")
    dropped(wanted)
    return out


def verified(pairs: DataFrame, sets: DataFrame, slim: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """The pairs that link: bit counts first, then sorted arrays."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch["na"].to_pylist(), batch["nb"].to_pylist()
            ok = [may_link(x, y, p, q, num, den) for x, y, p, q in zip(batch["xa"].to_pylist(), batch["xb"].to_pylist(), na, nb, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    own = bits_of(sets, pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))))
    side = lambda c: own.select(F.col("rid").alias(f"r{c}"), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"x{c}"))
    likely = pairs.join(side("a"), F.col("a") == F.col("ra")).join(side("b"), F.col("b") == F.col("rb"))
    likely = written(likely.select("a", "b", "na", "nb", "xa", "xb").mapInArrow(bound, "a long, b long"), "likely")
    dropped(own)
    needed = likely.select(F.col("a").alias("node")).unionByName(likely.select(F.col("b").alias("node"))).distinct()
    needed = written(sets.join(needed, F.col("rid") == F.col("node")).select("node", "doc_id", "s1", "s2"), "needed")

    bits = 1 << 15
    while bits < min(FILTER_BITS, 16 * needed.count()):
        bits *= 2
    place = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    maybe = np.zeros(bits >> 3, np.uint8)
    for r in needed.select(place.alias("x")).groupBy(F.expr("x div 32768").alias("b")).agg(F.bitmap_construct_agg(F.col("x") % 32768).alias("m")).toLocalIterator():
        maybe[r.b << 12 : (r.b + 1) << 12] = np.packbits(np.unpackbits(np.frombuffer(r.m, np.uint8), bitorder="little"))
    shared = slim.sparkSession.sparkContext.broadcast(maybe)

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed_bits = shared.value

        def known(x: np.ndarray) -> np.ndarray:
            return (packed_bits[x >> 3] >> (7 - (x & 7)).astype(np.uint8)) & 1 > 0

        for batch in sliced(b.filter(pa.array(known(b["x"].to_numpy()))) for b in batches):
            s, off = shingle_sets(batch["text"], words)
            m = mix(s)
            x, y = np.concatenate([[U(0)], np.cumsum(m)]), np.concatenate([[U(0)], np.cumsum(mix(m ^ U(0x5851F42D4C957F2D)))])
            sums = [pa.array((v[off[1:]] - v[off[:-1]]).astype(np.int64)) for v in (x, y)]
            data = pa.array([s[off[i] : off[i + 1]].tobytes() for i in range(len(off) - 1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *sums, data], ["doc_id", "s1", "s2", "data"])

    # the shuffle that drops repeats serves the join as well
    made = slim.select("doc_id", "text", place.alias("x")).mapInArrow(arrays, "doc_id long, s1 long, s2 long, data binary").dropDuplicates(["doc_id", "s1", "s2"])
    of = needed.select("node", F.col("doc_id").alias("k0"), F.col("s1").alias("k1"), F.col("s2").alias("k2"))
    held = made.join(of, (F.col("doc_id") == F.col("k0")) & (F.col("s1") == F.col("k1")) & (F.col("s2") == F.col("k2"))).select("node", "data")
    held = written(held, "arrays")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch["da"].to_pylist(), batch["db"].to_pylist(), strict=True):
                p, q = np.frombuffer(x, U), np.frombuffer(y, U)
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(den * both >= num * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    data = lambda c: held.select(F.col("node").alias(f"o{c}"), F.col("data").alias(f"d{c}"))
    found = likely.join(data("a"), F.col("a") == F.col("oa")).join(data("b"), F.col("b") == F.col("ob"))
    links = written(found.select("a", "b", "da", "db").mapInArrow(exact, "a long, b long"), "links")
    dropped(pairs, likely, needed, held)
    return links


def component_table(docs: DataFrame) -> DataFrame:
    """The rows that the query on similar documents returns."""
    return similar_groups(docs, words=4, num=85, den=100)


def possible(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` and ``maybe``: false only where no row of ``keys`` has the row's k1. Only a filter is broadcast, no row is shuffled."""
    bits = SLICE
    while bits < min(FILTER_BITS, 16 * keys.count()):
        bits *= 2
    cell = F.col("k1").bitwiseAND(F.lit(bits - 1))
    filled = keys.select(cell.alias("cell")).groupBy(F.expr(f"cell div {SLICE}").alias("slice")).agg(F.bitmap_construct_agg(F.col("cell") % SLICE).alias("bits"))
    filled = written(filled, "filter")
    probed = rows.withColumn("cell", cell).join(F.broadcast(filled), F.expr(f"cell div {SLICE}") == F.col("slice"), "left")
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.expr(f"cell % {SLICE} div 8") + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, F.expr("cast(cell % 8 as int)")) == 1, F.lit(False))
    return probed.select(*rows.columns, hit.alias("maybe"))


def keep_one(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one row of each group of similar texts; columns and their order stay, whatever their names.

    The row with the smallest id stays, null ids last; of rows with that id, one text of the group, and of
    rows that agree in id and text, the one with the smallest other columns. Null, empty and blank texts have no shingle and all
    stay. An empty table stays empty. Whole rows are shuffled only where a filter of the rows that go, or are
    there more than once, lets them through.
    """
    grouped, used = _grouped(docs, words, num, den, "doc_id", "text")
    groups = written(grouped.where("n > 0"), "groups")
    dropped(*used)
    best = F.min(F.struct("doc_id", "k1", "k2"))
    first_of = written(groups.groupBy("comp").agg(best.alias("b")), "first")
    first = first_of.select(F.col("comp").alias("of"), F.col("b.k1").alias("w1"), F.col("b.k2").alias("w2"))
    marked = groups.join(first, F.col("comp") == F.col("of")).select("k1", "k2", ((F.col("k1") == F.col("w1")) & (F.col("k2") == F.col("w2"))).alias("wins"))
    # rows that go, and rows that stay but are there more than once; a key stands for one id and text, hence for one group
    fate = written(marked.groupBy("k1", "k2").agg(F.max("wins").alias("wins"), F.count("*").alias("n")).where("not wins or n > 1"), "fate")
    dropped(groups, first_of)
    keyed = possible(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *row_keys("doc_id", "text")), fate)
    suspects = keyed.where("maybe")
    on = lambda f: (F.col("k1") == F.col("f1")) & (F.col("k2") == F.col("f2"))
    ends = fate.select(F.col("k1").alias("f1"), F.col("k2").alias("f2"), "wins")
    out = keyed.where("not maybe").select("row.*").unionByName(suspects.join(ends.drop("wins"), on(ends), "left_anti").select("row.*"))
    if not ends.where("wins").isEmpty():
        repeated = suspects.join(ends.where("wins").drop("wins"), on(ends), "left_semi")
        out = out.unionByName(repeated.groupBy("k1", "k2").agg(F.min("row").alias("row")).select("row.*"))
    return out
