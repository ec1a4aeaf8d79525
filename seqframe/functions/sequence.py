"""Column expressions on DNA sequences. All but ``dna_rows`` run inside the JVM."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: IUPAC codes and their complements, case kept.
IUPAC = "ACGTUMRWSYKVHDBNacgtumrwsykvhdbn-."
COMPLEMENT = "TGCAAKYWSRMBDHVNtgcaakywsrmbdhvn-."
#: The standard genetic code, bases in the order T, C, A, G.
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
STOPS = ("TAA", "TAG", "TGA")
CODONS = [a + b + c for a in "TCAG" for b in "TCAG" for c in "TCAG"]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def complement(c: Column | str) -> Column:
    """IUPAC complement; letters outside the alphabet become N."""
    return F.translate(F.regexp_replace(_col(c), f"[^{IUPAC[:-2]}.-]", "N"), IUPAC, COMPLEMENT)


def reverse_complement(c: Column | str) -> Column:
    return F.reverse(complement(c))


def acgt_reverse_complement(c: Column | str) -> Column:
    """For strings known to hold only A, C, G, T."""
    return F.reverse(F.translate(_col(c), "ACGT", "TGCA"))


def canonical(c: Column | str) -> Column:
    """The smaller of a k-mer of A, C, G, T and its reverse complement."""
    return F.least(_col(c), acgt_reverse_complement(c))


def is_stop(c: Column | str) -> Column:
    return F.upper(_col(c)).isin(*STOPS)


def translate_codon(c: Column | str) -> Column:
    """One-letter amino acid, * for a stop, X for anything else."""
    table = F.create_map(*[F.lit(x) for pair in zip(CODONS, CODE, strict=True) for x in pair])
    return F.coalesce(F.try_element_at(table, F.upper(_col(c))), F.lit("X"))


def with_bytes(c: Column | str, f) -> Column:
    """f of the ASCII string as bytes, bound once: cutting pieces of a string walks it from its start, of bytes it does not."""
    return F.get(F.transform(F.array(_col(c).cast("binary")), f), F.lit(0))


def piece(b: Column, at: Column, n: int) -> Column:
    """n letters of the bytes from place ``at`` (from 1)."""
    return F.substring(b, at, F.lit(n)).cast("string")


def kmers(c: Column | str, k: int) -> Column:
    """Array of all k-mers in order; empty where the sequence is shorter than k."""
    c = _col(c)
    n = F.length(c) - k + 1
    every = with_bytes(c, lambda b: F.transform(F.sequence(F.lit(1), n), lambda i: piece(b, i, k)))
    return F.when(n < 1, F.array().cast("array<string>")).otherwise(every)


def places(c: Column | str, words: tuple[str, ...] | list[str], first: Column, last: Column, step: int = 1) -> Column:
    """Array of the places from first to last, by step, where one of the words (of equal length) begins."""
    c = _col(c)
    every = with_bytes(c, lambda b: F.filter(F.sequence(first, last, F.lit(step)), lambda i: piece(b, i, len(words[0])).isin(*words)))
    return F.when(first > last, F.array().cast("array<int>")).otherwise(every)


def neighbours(c: Column | str, side: str) -> Column:
    """The k-mers with another last (side R) or first (side L) base: array of (side, base, kmer)."""
    c = _col(c)
    n = F.length(c)
    own = F.substring(c, n, F.lit(1)) if side == "R" else F.substring(c, 1, 1)
    rest = F.substring(c, F.lit(1), n - 1) if side == "R" else F.substring(c, F.lit(2), n - 1)
    each = lambda b: F.struct(F.lit(side).alias("side"), b.alias("base"), (F.concat(rest, b) if side == "R" else F.concat(b, rest)).alias("kmer"))
    return F.filter(F.transform(F.array(*map(F.lit, "ACGT")), each), lambda x: x["base"] != own)


def dna_of(c: Column | str) -> Column:
    """A DNA view of any text: its ASCII letters, folded onto A, C, G, T by their place in the alphabet."""
    low = "abcdefghijklmnopqrstuvwxyz"
    to = ("acgt" * 7)[:26]
    return F.upper(F.translate(F.regexp_replace(F.coalesce(_col(c), F.lit("")), "[^A-Za-z]", ""), low + low.upper(), to + to))


def dna_rows(texts: DataFrame) -> DataFrame:
    """``id, seq`` of ``id, text``: dna_of() for whole tables, in Arrow batches, which takes a small part of its time."""
    low = bytes(range(97, 123))
    table = bytes.maketrans(low + low.upper(), (b"ACGT" * 7)[:26] * 2)
    gone = bytes(set(range(256)) - set(low + low.upper()))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            seq = [(x or "").encode().translate(table, gone) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(seq, pa.binary()).cast(pa.string())], ["id", "seq"])

    return texts.select("id", "text").mapInArrow(batches, f"id {texts.schema['id'].dataType.simpleString()}, seq string")


def percent(a: Column, b: Column) -> Column:
    """100 a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a * 100.0, b), F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def saturated(c: Column | str, limit: int = 16383) -> Column:
    return F.least(_col(c), F.lit(limit))


def fasta_lines(seq: Column | str, width: int = 60) -> Column:
    """The sequence in lines of ``width``."""
    return F.regexp_replace(_col(seq), f"(.{{{width}}})(?!$)", "$1\n")


def protein(c: Column | str) -> Column:
    """The amino acids of the codons from the first base on."""
    c = _col(c)
    n = F.length(c)
    each = with_bytes(c, lambda b: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 2), F.lit(3)), lambda i: translate_codon(piece(b, i, 3))))
    return F.when(n < 3, "").otherwise(F.array_join(each, ""))


def commas(c: Column | str) -> Column:
    """A whole number with commas between thousands."""
    return F.format_number(_col(c), 0)


def number_or_max(c: Column | str, most: int) -> Column:
    return F.when(_col(c) >= most, "max").otherwise(_col(c).cast("string"))


def true_false(c: Column | str) -> Column:
    return F.when(_col(c), "true").otherwise("false")


def true_letter(c: Column | str) -> Column:
    return F.when(_col(c), "T").otherwise("F")


def or_none(c: Column | str) -> Column:
    """The value as text, ``none`` for a null."""
    return F.coalesce(_col(c).cast("string"), F.lit("none"))


def smaller(a: Column | str, b: Column | str) -> Column:
    """The smaller of two values; of a null and a value the value."""
    return F.least(_col(a), _col(b))


def larger(a: Column | str, b: Column | str) -> Column:
    """The larger of two values; of a null and a value the value."""
    return F.greatest(_col(a), _col(b))


def about_normal(seed: int) -> Column:
    """Random numbers of mean 0 and variance 1 between -6 and 6: twelve even ones between 0 and 1, less 6."""
    return sum((F.rand(seed + i) for i in range(12)), F.lit(-6.0))


def stripped(c: Column | str, end: str) -> Column:
    """Without one character at the end, where it is ``end``."""
    c = _col(c)
    return F.when(c.endswith(end), F.left(c, F.length(c) - 1)).otherwise(c)


def first_visible(c: Column | str) -> Column:
    """The first character that is no white space, else a space."""
    found = F.regexp_extract(_col(c), r"(\S)", 1)
    return F.when(found == "", " ").otherwise(found)


def fastq_of(quality: Column | str) -> Column:
    """Qualities (array of int) as text, one character each, 0 as the digit 0."""
    return F.array_join(F.transform(_col(quality), lambda q: F.chr(q + 48)), "")
