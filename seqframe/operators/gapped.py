"""Gapped alignments: exact matches chained along both sequences, with what lies between and beyond aligned in a band."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqframe.functions.sequence import CODE, CODONS, kmers, reverse_complement
from seqframe.operators.minimizers import CODE_OF, OTHER
from seqframe.sources.tables import written

#: Scores of the extension: a match, and an edit. In the packed form the lowest four digits count matches.
MATCH, EDIT, DIGITS = 1, -2, 10_000
#: Bases that an end is extended by at most in one go; it goes on while a whole go was used.
REACH = 200
#: Distinct seeds of the reference that queries are filtered by; with more all their places go into the join. Bits of the filter's first step.
MOST_WORDS, FILTER_BITS = 1 << 18, 22
FIELDS = ["s1", "e1", "s2", "e2", "len1", "len2", "matches", "columns"]


def between(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(matches, columns) of an alignment of two whole strings with the fewest edits, of these one with the most matches."""
    big = len(a) + len(b) + 1
    j = np.arange(len(b) + 1) * big
    row = j.copy()
    for i, x in enumerate(a.tolist(), 1):
        new = np.full(len(b) + 1, i * big)
        new[1:] = np.minimum(row[1:] + big, row[:-1] + np.where(b == x, -1, big))
        row = np.minimum.accumulate(new - j) + j
    edits = -(-int(row[-1]) // big)
    matches = edits * big - int(row[-1])
    return matches, matches + edits


def beyond(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, int]:
    """(bases of a, bases of b, matches, columns) of the best-scoring extension into two strings; the shortest of equals."""
    at, score = (0, 0, 0, 0), 0
    j = np.arange(len(b) + 1) * EDIT * DIGITS
    row = j.copy()
    for i, x in enumerate(a.tolist(), 1):
        new = np.full(len(b) + 1, i * EDIT * DIGITS)
        new[1:] = np.maximum(row[1:] + EDIT * DIGITS, row[:-1] + np.where(b == x, MATCH * DIGITS + 1, EDIT * DIGITS))
        row = np.maximum.accumulate(new - j) + j
        best = int(row.max()) // DIGITS
        if best > score:
            k = int(np.flatnonzero(row // DIGITS == best)[0])
            matches, score = int(row[k]) % DIGITS, best
            at = (i, k, matches, matches + (matches * MATCH - best) // -EDIT)
        elif best + (len(a) - i) * MATCH <= score:
            break
    return at


def extended(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, int]:
    """beyond() go by go, while it uses most of what it is given."""
    total = np.zeros(4, np.int64)
    while True:
        i, k = int(total[0]), int(total[1])
        more = beyond(a[i : i + REACH], b[k : k + REACH])
        total += more
        if max(more[0], more[1]) < REACH // 2:
            return tuple(total.tolist())


def chained(segments: np.ndarray, gap: int, shift: int) -> list[list[int]]:
    """Chains of exact matches (p, q, n), heaviest first; each match is in one.

    A chain goes up in both sequences; neighbours are at most ``gap`` apart and ``shift`` diagonals. Where two overlap, the
    overlap counts once; a change of diagonal costs its size.
    """
    order = np.lexsort((segments[:, 1], segments[:, 0]))
    p, q, n = segments[order].T
    free, out = np.ones(len(p), bool), []
    while free.any():
        at = np.flatnonzero(free)
        weight, before = n[at].astype(np.int64), np.full(len(at), -1)
        # only matches that begin within reach of one count before it
        first = np.searchsorted(p[at] + 0, p[at] - gap - n.max() - shift)
        for i in range(len(at)):
            js = np.arange(first[i], i)
            if not len(js):
                continue
            a, b = p[at[i]] - (p[at[js]] + n[at[js]]), q[at[i]] - (q[at[js]] + n[at[js]])
            lap, far, turn = np.maximum(0, -np.minimum(a, b)), np.maximum(a, b), np.abs(a - b)
            ok = (lap < n[at[i]]) & (far <= gap) & (turn <= shift) & (p[at[js]] < p[at[i]]) & (q[at[js]] < q[at[i]])
            if ok.any():
                gain = np.where(ok, weight[js] - lap - turn, np.iinfo(np.int64).min)
                best = int(gain.argmax())
                if gain[best] > 0:
                    weight[i], before[i] = n[at[i]] + gain[best], js[best]
        i, chain = int(weight.argmax()), []
        while i >= 0:
            chain.append(int(order[at[i]]))
            free[at[i]] = False
            i = int(before[i])
        out.append(chain[::-1])
    return out


def aligned(a: np.ndarray, b: np.ndarray, segments: np.ndarray, gap: int, shift: int, least: int) -> list[tuple[int, ...]]:
    """(s1, e1, s2, e2, matches, columns), from 0 and without the end, of the chains' alignments that span ``least`` bases of a.

    A chain within an alignment that a heavier one has led to gives none.
    """
    out: list[tuple[int, ...]] = []
    for chain in chained(segments, gap, shift):
        p, q, n = segments[chain[0]].tolist()
        if any(s1 <= p and p + n <= e1 and s2 <= q and q + n <= e2 for s1, e1, s2, e2, _, _ in out):
            continue
        i, k, m, c = extended(a[:p][::-1], b[:q][::-1])
        s1, s2, matches, columns = p - i, q - k, m + n, c + n
        x, y = p + n, q + n
        for one in chain[1:]:
            p, q, n = segments[one].tolist()
            lap = max(0, x - p, y - q)
            m, c = between(a[x : p + lap], b[y : q + lap])
            matches, columns, x, y = matches + m + n - lap, columns + c + n - lap, p + n, q + n
        i, k, m, c = extended(a[x:], b[y:])
        x, y, matches, columns = x + i, y + k, matches + m, columns + c
        if x - s1 >= least:
            out.append((s1, x, s2, y, matches, columns))
    return out


def hashed(text: np.ndarray, seed: int) -> np.ndarray:
    """A number for the ``seed`` letters from every place on."""
    out = np.zeros(max(0, text.size - seed + 1), np.uint64)
    for i in range(seed):
        out = out * np.uint64(0x9E3779B97F4A7C15) + text[i : i + out.size]
    return (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def with_words(qry: DataFrame, seed: int, words: list[str]) -> DataFrame:
    """``id, seq, at, words``: sequences that have some of the words, with all places (from 0) of such, and maybe of a few others."""
    numbers = np.unique(hashed(np.frombuffer("".join(words).encode("latin-1", "replace"), np.uint8), seed)[::seed])
    top = np.uint64(64 - FILTER_BITS)
    there = np.zeros(1 << FILTER_BITS, bool)
    there[(numbers >> top).astype(np.int64)] = True
    both = qry.sparkSession.sparkContext.broadcast((numbers, np.packbits(there)))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, there = both.value[0], np.unpackbits(both.value[1]).view(bool)
        for b in it:
            kept, places, found = [], [], []
            for i, seq in enumerate(b.column(1).to_pylist()):
                h = hashed(np.frombuffer(seq.encode("latin-1", "replace"), np.uint8), seed)
                at = np.flatnonzero(there[(h >> top).astype(np.int64)])
                at = at[numbers[np.minimum(np.searchsorted(numbers, h[at]), numbers.size - 1)] == h[at]]
                if at.size:
                    kept.append(i)
                    places.append(at.tolist())
                    found.append([seq[x : x + seed] for x in places[-1]])
            lists = [pa.array(places, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(kept, pa.int64())), b.column(1).take(pa.array(kept, pa.int64())), *lists], ["id", "seq", "at", "words"])

    return qry.select("id", "seq").mapInArrow(batches, f"id {qry.schema['id'].dataType.simpleString()}, seq string, at array<int>, words array<string>")


def exact_matches(ref: DataFrame, qry: DataFrame, seed: int, letters: str) -> DataFrame:
    """``ref, qry, segments``: all stretches of ``seed`` letters and more that sequences share, as (p, q, n) from 0. qry: see with_words(), or id and seq."""
    at = lambda df, c, p: df.select(F.col("id").alias(c), F.posexplode(kmers("seq", seed)).alias(p, f"w{p}")).where(~F.col(f"w{p}").rlike(f"[^{letters}]"))
    some = lambda df: df.select(F.col("id").alias("qry"), F.explode(F.arrays_zip("at", "words")).alias("h")).select("qry", F.col("h.at").alias("q"), F.col("h.words").alias("wq"))
    hits = at(ref, "ref", "p").join(some(qry) if "words" in qry.columns else at(qry, "qry", "q"), F.col("wp") == F.col("wq")).select("ref", "qry", "p", (F.col("q") - F.col("p")).alias("diag"))
    # places of one diagonal that follow each other
    w = Window.partitionBy("ref", "qry", "diag").orderBy("p")
    runs = hits.withColumn("run", F.col("p") - F.row_number().over(w)).groupBy("ref", "qry", "diag", "run").agg(F.min("p").alias("p"), F.count("*").alias("n"))
    runs = runs.select("ref", "qry", F.struct(F.col("p").cast("int").alias("p"), (F.col("p") + F.col("diag")).cast("int").alias("q"), (F.col("n") + seed - 1).cast("int").alias("n")).alias("s"))
    return runs.groupBy("ref", "qry").agg(F.collect_list("s").alias("segments"))


def _rows(ref: DataFrame, qry: DataFrame, seed: int, gap: int, shift: int, least: int, letters: str) -> DataFrame:
    """``ref, qry, s1 .. columns``: alignments of sequences (id, seq) with sequences, as they read; places from 1."""
    words = ref.select(F.explode(kmers("seq", seed)).alias("w")).where(~F.col("w").rlike(f"[^{letters}]")).distinct().limit(MOST_WORDS + 1).collect()
    if 0 < len(words) <= MOST_WORDS:
        # few words: only sequences that have some go further, with their places
        qry = written(with_words(qry, seed, [r.w for r in words]), "with-words")
    pairs = written(exact_matches(ref, qry, seed, letters), "matches")
    pairs = pairs.join(ref.select(F.col("id").alias("r_of"), F.col("seq").alias("a")), F.col("ref") == F.col("r_of"))
    pairs = pairs.join(qry.select(F.col("id").alias("q_of"), F.col("seq").alias("b")), F.col("qry") == F.col("q_of")).select("ref", "qry", "segments", "a", "b")
    kinds = {c: pairs.schema[c].dataType.simpleString() for c in ("ref", "qry")}
    fields = [pa.field(c, pa.int32()) for c in FIELDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, out = [], []
            for i in range(batch.num_rows):
                a, b = (np.frombuffer(batch[c][i].as_py().encode("latin-1", "replace"), np.uint8) for c in "ab")
                segments = np.array([(s["p"], s["q"], s["n"]) for s in batch["segments"][i].as_py()], np.int64).reshape(-1, 3)
                for s1, e1, s2, e2, m, c in aligned(a, b, segments, gap, shift, least):
                    which.append(i)
                    out.append((s1 + 1, e1, s2 + 1, e2, e1 - s1, e2 - s2, m, c))
            ids = [batch[c].take(pa.array(which, pa.int64())) for c in ("ref", "qry")]
            yield pa.RecordBatch.from_arrays([*ids, *[pa.array([o[i] for o in out], f.type) for i, f in enumerate(fields)]], ["ref", "qry", *FIELDS])

    return pairs.mapInArrow(run, ", ".join([f"ref {kinds['ref']}", f"qry {kinds['qry']}", *[f"{c} int" for c in FIELDS]]))


def _lengths(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.col("id").alias(f"{name}_id"), F.length("seq").alias(f"len_{name[0]}"))


def align_gapped(ref: DataFrame, qry: DataFrame, seed: int = 20, gap: int = 90, shift: int = 30, least: int = 65) -> DataFrame:
    """Alignment rows of ``ref`` (id, seq) with ``qry`` on both strands, with insertions and deletions.

    Exact matches of ``seed`` bases and more are chained (see chained()); what lies between two is aligned with the fewest
    edits, and the ends are extended while that scores. Rows of fewer than ``least`` reference bases are dropped. idy:
    matches in 100 columns. Matches meet in an equi-join on the l-mer; a task works on one pair of sequences at a time. Null or empty
    sequences, and such without a match, give no row.
    """
    ref, qry = (df.where(F.length("seq") > 0).select("id", F.upper("seq").alias("seq")) for df in (ref, qry))
    sides = F.explode(F.array(F.struct(F.lit("f").alias("strand"), F.col("seq").alias("seq")), F.struct(F.lit("r").alias("strand"), reverse_complement("seq").alias("seq"))))
    both = qry.select("id", sides.alias("s")).select(F.struct("id", "s.strand").alias("id"), "s.seq")
    x = _rows(ref, both, seed, gap, shift, least, "ACGT")
    x = x.join(_lengths(ref, "ref"), F.col("ref") == F.col("ref_id")).join(_lengths(qry, "qry"), F.col("qry.id") == F.col("qry_id"))
    back = F.col("qry.strand") == "r"
    s2, e2 = (F.when(back, F.col("len_q") - F.col(c) + 1).otherwise(F.col(c)) for c in ("s2", "e2"))
    return x.select(
        "s1", "e1", s2.alias("s2"), e2.alias("e2"), "len1", "len2", (F.col("matches") * 100.0 / F.col("columns")).alias("idy"), "len_r", "len_q",
        (F.col("len1") * 100.0 / F.col("len_r")).alias("cov_r"), (F.col("len2") * 100.0 / F.col("len_q")).alias("cov_q"), "ref", F.col("qry_id").alias("qry"),
    )


def frames(df: DataFrame) -> DataFrame:
    """``id (id, frame), seq``: the amino acids of the six reading frames, 1 to 3 and, of the other strand, -1 to -3."""
    kind = df.schema["id"].dataType.simpleString()
    amino = np.full(125, ord("X"), np.uint8)
    for codon, letter in zip(CODONS, CODE, strict=True):
        a, b, c = (int(CODE_OF[ord(x)]) for x in codon)
        amino[25 * a + 5 * b + c] = ord(letter)
    other = np.array([3, 2, 1, 0, OTHER], np.uint8)

    def translated(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(0, batch.num_rows, 500):
                part, out = batch.slice(at, 500), []
                for seq in part.column(1).to_pylist():
                    codes = CODE_OF[np.frombuffer((seq or "").upper().encode("ascii", "replace"), np.uint8)]
                    for side in (codes, other[codes[::-1]]):
                        side = side.astype(np.int64)
                        every = amino[25 * side[:-2] + 5 * side[1:-1] + side[2:]] if side.size > 2 else np.zeros(0, np.uint8)
                        out += [None if seq is None else every[f::3].tobytes().decode() for f in range(3)]
                ids = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), 6)))
                frame = pa.array(np.tile(np.array([1, 2, 3, -1, -2, -3], np.int32), part.num_rows))
                yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([ids, frame], ["id", "frame"]), pa.array(out, pa.string())], ["id", "seq"])

    return df.select("id", "seq").mapInArrow(translated, f"id struct<id: {kind}, frame: int>, seq string")


def align_translated(ref: DataFrame, qry: DataFrame, seed: int = 6, gap: int = 30, shift: int = 10, least: int = 20) -> DataFrame:
    """Alignment rows like align_gapped()'s of the amino acids of all reading frames, with ``ref_frame`` and ``qry_frame``.

    seed, gap, shift and least count amino acids; places and lengths are of bases, descending on the other strand.
    Matches hold no stop codon.
    """
    ref, qry = (df.where(F.length("seq") > 2).select("id", F.upper("seq").alias("seq")) for df in (ref, qry))
    x = _rows(frames(ref), frames(qry), seed, gap, shift, least, "A-WY")
    x = x.join(_lengths(ref, "ref"), F.col("ref.id") == F.col("ref_id")).join(_lengths(qry, "qry"), F.col("qry.id") == F.col("qry_id"))

    def base(place: Column, frame: str, size: str, last: bool) -> Column:
        at = F.abs(F.col(frame)) + 3 * (place - 1) + (2 if last else 0)
        return F.when(F.col(frame) > 0, at).otherwise(F.col(size) - at + 1)

    places = [base(F.col(c), f"{side}.frame", f"len_{side[0]}", c[0] == "e").alias(c) for c, side in (("s1", "ref"), ("e1", "ref"), ("s2", "qry"), ("e2", "qry"))]
    return x.select(
        *places, (3 * F.col("len1")).alias("len1"), (3 * F.col("len2")).alias("len2"), (F.col("matches") * 100.0 / F.col("columns")).alias("idy"), "len_r", "len_q",
        (F.col("len1") * 300.0 / F.col("len_r")).alias("cov_r"), (F.col("len2") * 300.0 / F.col("len_q")).alias("cov_q"),
        F.col("ref.frame").alias("ref_frame"), F.col("qry.frame").alias("qry_frame"), F.col("ref_id").alias("ref"), F.col("qry_id").alias("qry"),
    )
