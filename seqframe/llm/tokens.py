"""Word hashes of whole batches of texts, by numpy over the Arrow buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE = 1 << 20
_BASE = {"byte": 0x9E3779B97F4A7C15, "word": 0xC2B2AE3D27D4EB4F, "check": 0x165667B19E3779F9}
_POWERS: dict[str, tuple[np.ndarray, np.ndarray]] = {}
#: White space is space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: The same with ASCII punctuation.
SPACE_OR_MARK = SPACE.copy()
SPACE_OR_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2**64, and of its inverse."""
    have = _POWERS.get(kind)
    if have is None or len(have[0]) < n:
        size = max(1 << 20, int(n * 1.25))
        out = []
        for base in (_BASE[kind], pow(_BASE[kind], -1, 1 << 64)):
            x = np.full(size, base, dtype=U)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        _POWERS[kind] = have = (out[0], out[1])
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values, one to one."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets; nulls have no bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, off, data = texts.buffers()
    if off is None or len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    off = np.frombuffer(off, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return (np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)), off


def word_hashes(texts: pa.Array | pa.ChunkedArray, lower: bool = False, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, in order, and where each text's words begin (one more entry at the end).

    ``lower`` folds A to Z; ``space`` tells which bytes part words."""
    data, off = text_buffers(texts)
    n, lo = len(off) - 1, 0
    hashes, counts = [], np.zeros(n, np.int64)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + SLICE, side="right")) - 1)
        h, c = _slice(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], lower, space)
        hashes.append(h)
        counts[lo:hi] = c
        lo = hi
    return (np.concatenate(hashes) if hashes else np.zeros(0, U)), np.concatenate([[0], np.cumsum(counts)])


def _slice(b: np.ndarray, off: np.ndarray, lower: bool, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(b) == 0:
        return np.zeros(0, U), np.zeros(len(off) - 1, np.int64)
    word = ~space[b]
    full = off[1:] > off[:-1]
    first, last = off[:-1][full], off[1:][full] - 1
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    start[first] = word[first]
    end[:-1] &= ~word[1:]
    end[last] = word[last]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    p, q = powers("byte", len(b) + 1)
    total = np.zeros(len(b) + 1, U)
    np.cumsum(((LOWER[b] if lower else b).astype(U) + U(1)) * p[: len(b)], out=total[1:])
    return mix((total[e] - total[s]) * q[s] + (e - s).astype(U) * U(0xD6E8FEB86659FD93)), np.diff(np.searchsorted(s, off))


def rolling(hashes: np.ndarray, kind: str = "word") -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums and inverse powers, from which span() makes the hash of any run of words."""
    p, q = powers(kind, len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, U)
    np.cumsum(hashes * p[: len(hashes)], out=total[1:])
    return total, q


def span(sums: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[0][end] - sums[0][start]) * sums[1][start])


def windows(off: np.ndarray, k: int) -> np.ndarray:
    """Where windows of k words begin that lie in one text."""
    at = np.arange(off[-1])
    return at[at + k <= np.repeat(off[1:], np.diff(off))]


def shingle_sets(texts: pa.Array | pa.ChunkedArray, k: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """For each text its sorted distinct k-word shingles (with fewer words: all of them as one; no word: none), and offsets."""
    wh, off = word_hashes(texts, lower)
    nw = np.diff(off)
    sums = rolling(wh)
    at = windows(off, k)
    short = np.flatnonzero((nw > 0) & (nw < k))
    values = np.concatenate([span(sums, at, at + k), span(sums, off[short], off[short + 1])])
    doc = np.concatenate([np.searchsorted(off, at, side="right") - 1, short])
    if len(short):
        o = np.argsort(doc, kind="stable")
        values, doc = values[o], doc[o]
    bounds = np.searchsorted(doc, np.arange(len(nw) + 1))
    out, sizes = [], np.zeros(len(nw), np.int64)
    for i in range(len(nw)):
        u = np.unique(values[bounds[i] : bounds[i + 1]])
        sizes[i] = len(u)
        out.append(u)
    return (np.concatenate(out) if out else np.zeros(0, U)), np.concatenate([[0], np.cumsum(sizes)])
