"""Fingerprints of documents from chains of content words that follow common words.

A common word (anchor) and the next ``CHAIN`` words that are not common make a signature; a text's
fingerprint is the set of its signatures. Layout, menus and lists hold few common words, so they add
little. Sets are compared by Jaccard similarity; where a least similarity is asked for, sets are
partitioned by their sizes, since those too far apart in size cannot reach it.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqframe.llm.scratch import written
from seqframe.llm.tokens import SPACE_OR_MARK, U, mix, word_hashes

#: A common word makes up so much of all words at least, so there are at most 1 / COMMON of them.
COMMON = 1 / 400
CHAIN = 2
#: Bits of a signature: eight characters of base64.
BITS = 48
CHARS_AT_ONCE = 1 << 22
DOCS_AT_ONCE = 1 << 14
#: Documents are dealt by ranges of their ids; about so many rows a range, and at most so many ranges.
ROWS_A_RANGE, RANGES = 2000, 2048
LAST = np.iinfo(np.int64).max
START = U(0x5851F42D4C957F2D)


def slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of rows with CHARS_AT_ONCE characters at most, but one at least."""
    lo, total = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and (total + n > CHARS_AT_ONCE or i - lo >= DOCS_AT_ONCE):
            yield lo, i
            lo, total = i, 0
        total += n
    if sizes:
        yield lo, len(sizes)


def anchors(docs: DataFrame, text_col: str = "text", common: float = COMMON) -> np.ndarray:
    """Sorted hashes of the words that make up ``common`` of all words of ``docs`` at least; there are at most 1 / common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices([len(x or "") for x in batch["text"].to_pylist()]):
                h, n = np.unique(word_hashes(batch["text"].slice(lo, hi - lo), True, SPACE_OR_MARK)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], ["h", "n"])

    counts = written(docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "words")
    total = counts.agg(F.sum("n").alias("n")).first().n or 0
    return np.sort(np.array([r.h for r in counts.where(F.col("n") >= common * total).select("h").collect()], np.int64).view(U))


def signature_sets(texts: list[str], common: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct signatures of each text; those of one slice are found together.

    The first words of a text, common or not, are a signature too, so that every text with a word has one.
    """
    out: list[np.ndarray] = []
    for lo, hi in slices([len(x) for x in texts]):
        h, off = word_hashes(pa.array(texts[lo:hi], pa.string()), True, SPACE_OR_MARK)
        doc = np.repeat(np.arange(hi - lo), np.diff(off))
        is_common = np.zeros(len(h), bool)
        if len(common) and len(h):
            is_common = common[np.minimum(np.searchsorted(common, h), len(common) - 1)] == h
        content = np.flatnonzero(~is_common)
        at = np.flatnonzero(is_common)
        first = np.searchsorted(content, at)
        ok = first + CHAIN <= len(content)
        at, first = at[ok], first[ok]
        same = doc[content[first + CHAIN - 1]] == doc[at] if len(at) else np.zeros(0, bool)
        at, first = at[same], first[same]
        s = mix(h[at])
        for i in range(CHAIN):
            s = mix(s + h[content[first + i]])
        begun = np.flatnonzero(np.diff(off))
        t = np.full(len(begun), START, U)
        for i in range(CHAIN):
            here = off[begun] + i
            t = np.where(here < off[begun + 1], mix(t + h[np.minimum(here, max(0, len(h) - 1))]), t) if len(begun) else t
        # the text's place stands above the signature's bits
        every = np.concatenate([s, t]) >> U(64 - BITS) | np.concatenate([doc[at], begun]).astype(U) << U(BITS)
        every = np.unique(every)
        bounds = np.searchsorted(every, np.arange(hi - lo + 1).astype(U) << U(BITS))
        every &= U((1 << BITS) - 1)
        out += [every[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return out


def packed(s: np.ndarray) -> str:
    """A set as text: its signatures in order, eight characters each."""
    return base64.b64encode(s.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def unpacked(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, 6)
    return np.concatenate([np.zeros((len(raw), 2), np.uint8), raw], axis=1).copy().view(">u8").ravel().astype(U)


def band(size: int, least: float) -> int:
    """The partition of sets of a size: sets of the least likeness lie in one or in neighbouring ones."""
    return 0 if size == 0 else 1 + math.floor(math.log(size) / -math.log(least) + 1e-9)


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two sets; two empty ones are alike. 0 where sizes or overlap leave less than ``least``."""
    if len(a) == 0 or len(b) == 0:
        return float(len(a) == len(b))
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    x = both / (len(a) + len(b) - both)
    return x if x >= least else 0.0


def edited(text: str, after: str) -> str:
    """The text with its last third replaced by as much of the beginning of another."""
    k = len(text) // 3
    return text[: len(text) - k] + after[:k]


def in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``part, guest, doc_id, text``: rows dealt by descending id and sorted in their partitions.

    Each range of ids (``part``) ends with the first row of the next one (``guest``), the last range with the first of
    all. Ties are ordered by a hash of the text; rows with a null id come last, in ranges of that hash. Bounds
    of the ranges and their first rows, RANGES at most of each kind, pass through the driver.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    x = rows.select("doc_id", "text", F.coalesce(F.bitwise_not("doc_id"), F.lit(LAST)).alias("turned"), F.xxhash64("text").alias("tie"))
    n = docs.count()
    ranges = int(min(RANGES, max(1, n // ROWS_A_RANGE)))
    bounds = []
    if ranges > 1:
        at = [i / ranges for i in range(1, ranges)]
        bounds = sorted(set(x.where("doc_id is not null").agg(F.percentile_approx("turned", at, 4 * RANGES).alias("b")).first().b or []))
    known = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col("turned"))) if bounds else F.lit(0)
    # the hash's upper half, from 0
    lost = F.lit(len(bounds) + 1) + F.floor((F.shiftright("tie", 32) + F.lit(1 << 31)) * F.lit(ranges) / F.lit(1 << 32))
    x = x.withColumn("part", F.when(F.col("doc_id").isNull(), lost).otherwise(known).cast("int"))
    firsts = sorted(tuple(r.f) for r in x.groupBy("part").agg(F.min(F.struct("part", "turned", "tie")).alias("f")).collect())
    before = [(firsts[i - 1][0], *f) for i, f in enumerate(firsts)]
    heads = docs.sparkSession.createDataFrame(before, "goes int, h_part int, h_turned long, h_tie long")
    # the table has one row a range, RANGES twice over at most
    on = (F.col("part") == F.col("h_part")) & (F.col("turned") == F.col("h_turned")) & (F.col("tie") == F.col("h_tie"))
    x = x.join(F.broadcast(heads), on, "left")
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("guest"))
    copies = F.when(F.col("goes").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("goes").alias("part"), F.lit(True).alias("guest"))))
    x = x.select("doc_id", "text", "turned", "tie", F.explode(copies).alias("c")).select("c.part", "c.guest", "doc_id", "text", "turned", "tie")
    return x.repartition("part").sortWithinPartitions("part", "guest", "turned", "tie").select("part", "guest", "doc_id", "text")


OUT_SQL = """doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double,
 near_next double, edited string"""


def fingerprints(docs: DataFrame, common: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its fingerprint, that of its edited text, and how alike they and the next document's are.

    edited: the last third (rounded down) of the text's characters replaced by the first as many, or
    all, of the next document's, by descending id; after the last comes the first. A null text is empty; rows with a null id come last;
    equal ids are ordered by a hash of the text, and equal rows follow each other. A text without a word has an
    empty fingerprint, and two such are alike (1). An empty table gives an empty result; other columns are ignored.
    ``common``: hashes of common words, by default those of ``docs``.
    """
    common = anchors(docs, text_col) if common is None else common
    shared = docs.sparkSession.sparkContext.broadcast(common)
    names = [c.split()[0] for c in OUT_SQL.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        # the row that waits for the next: (part, id, text, signatures)
        waits = None
        for batch in batches:
            every = list(zip(*[batch[c].to_pylist() for c in ("part", "guest", "doc_id", "text")], strict=True))
            for lo, hi in slices([len(r[3]) for r in every]):
                rows = every[lo:hi]
                sets = signature_sets([r[3] for r in rows], common)
                pairs = []
                for (part, guest, doc, text), s in zip(rows, sets, strict=True):
                    if waits is not None:
                        if waits[0] != part:
                            raise ValueError("a range of ids has no end")
                        pairs.append((*waits[1:], text, s))
                    # of several equal guests the first counts
                    waits = None if guest else (part, doc, text, s)
                changed = [edited(text, after) for _, text, _, after, _ in pairs]
                theirs = signature_sets(changed, common)
                out = [
                    (doc, len(text), hashlib.sha256(e.encode()).hexdigest(), packed(s), packed(t), likeness(s, t), likeness(s, after), e)
                    for (doc, text, s, _, after), e, t in zip(pairs, changed, theirs, strict=True)
                ]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string()]
                columns = list(zip(*out, strict=True)) or [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return in_order(docs, id_col, text_col).mapInArrow(run, OUT_SQL)


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """The rows that the fingerprint query returns: all but the edited texts."""
    return fingerprints(docs).drop("edited")
