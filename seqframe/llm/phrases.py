"""Phrases whose words keep together, by language.

Frequent words are counted first, then phrases of two words and more, each level from the one before: a
place can begin a frequent phrase of m words only if the m - 1 words from it and the m - 1 words from the
next place do (Apriori). Beyond pairs only the runs of frequent pairs are read. What these levels find goes into double-array tries of bounded size, which
are broadcast: numpy moves the states of all places of a batch of texts on together, word by word,
and counts the accepting states; the sums over all tasks are the counts of the phrases.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqframe.llm.scratch import written
from seqframe.llm.tokens import LOWER, SLICE, U, mix, powers, rolling, span, text_buffers

LEAST, MOST_WORDS, TOP = 100, 5, 2000
#: White space is space and tab; pieces end at . , ; : ! ? and at line breaks.
BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True
NO_WORD = BREAK.copy()
NO_WORD[[32, 9]] = True
#: Bytes of text whose words are counted together; one longer text goes alone.
BYTES_AT_ONCE = 1 << 21
#: Phrases in one trie (8 MB of states or so), and hashes in the filter of one level (16 MB, with keys 32). More phrases
#: make more tries, each with a pass of its own; more hashes leave the filter out, and more rows are summed.
TRIE, FILTER = 1 << 18, 1 << 21
#: Shards of the texts, whose counts are summed, for each core.
SHARDS_A_CORE = 1
#: Places that the children of one state are tried at before they go to the end of the trie.
TRIES = 128
SPELT_SQL = "h long, lang string, phrase string"


def _words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Starts, ends, hashes and breaks before them of the words of lower-cased texts."""
    word = ~NO_WORD[data]
    start, end = word.copy(), word.copy()
    if len(data):
        full = off[1:] > off[:-1]
        start[1:] &= ~word[:-1]
        end[:-1] &= ~word[1:]
        first, last = off[:-1][full], off[1:][full] - 1
        start[first], end[last] = word[first], word[last]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    p, q = powers("byte", len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * p[: len(data)], out=total[1:])
    h = mix((total[end] - total[start]) * q[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))
    return start, end, h, np.cumsum(BREAK[data])[start] if len(start) else start


class Words:
    """The words of some texts, in order: hashes (seeded by language), pieces, places."""

    def __init__(self, texts: pa.Array, langs: list[str], keys: np.ndarray | None = None):
        self.keys = np.zeros(len(langs), np.int64) if keys is None else keys
        data, off = text_buffers(texts)
        data, off = data[off[0] : off[-1]], off - off[0]
        self.data, self.langs = LOWER[data], langs
        seeds = {x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in set(langs)}
        seed = np.array([seeds[x] for x in langs], U)
        found, lo, breaks = [], 0, 0
        while lo < len(langs):
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + SLICE, side="right")) - 1)
            a, b = off[lo], off[hi]
            start, end, h, piece = _words(self.data[a:b], off[lo : hi + 1] - a)
            doc = np.searchsorted(off[lo : hi + 1] - a, start, side="right") - 1 + lo
            # breaks and texts before a word; equal for two words only if they share a piece
            found.append((start + a, end + a, doc, mix(h ^ seed[doc]) if len(h) else h, piece + breaks + doc))
            breaks += int(BREAK[data[a:b]].sum())
            lo = hi
        empty = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, U), np.zeros(0, np.int64)]
        self.start, self.end, self.doc, self.hash, self.piece = (np.concatenate(x) for x in zip(*found, strict=True)) if found else empty

    def places(self, m: int) -> np.ndarray:
        """Where m words of one piece begin."""
        n = len(self.hash) - m + 1
        return np.flatnonzero(self.piece[:n] == self.piece[m - 1 :]) if n > 0 else np.zeros(0, np.int64)

    def counted(self, hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """The distinct hashes of what begins at the places ``at``, their number, and the least key of a text that has them."""
        keys = self.keys[self.doc[at]]
        order = np.lexsort((keys, hashes))
        h = hashes[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
        return h[first], np.diff(np.append(first, len(h))), keys[order][first], at[order][first]

    def spelt(self, hashes: np.ndarray, at: np.ndarray, m: int) -> pa.RecordBatch:
        """The distinct hashes of the m words from the places ``at``, their language and words."""
        h, first = np.unique(hashes, return_index=True)
        text, start, end = self.data.tobytes(), self.start, self.end
        at = at[first]
        phrases = [b" ".join(text[start[i] : end[i]] for i in range(p, p + m)).decode() for p in at.tolist()]
        langs = [self.langs[d] for d in self.doc[at].tolist()]
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(langs, pa.string()), pa.array(phrases, pa.string())], ["h", "lang", "phrase"])


def batched(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    """Words of (text, lang, key) rows, some megabytes of text at a time."""
    for batch in batches:
        texts, langs, keys = batch["text"], batch["lang"].to_pylist(), batch["key"].to_numpy()
        off = text_buffers(texts)[1]
        lo = 0
        while lo < len(langs):
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + BYTES_AT_ONCE, side="right")) - 1)
            yield Words(texts.slice(lo, hi - lo), langs[lo:hi], keys[lo:hi])
            lo = hi


def word_counts(texts: DataFrame) -> DataFrame:
    """``h, lang, f, key`` of all words; key: the least of a text that has the word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in batched(batches):
            h, n, keys, at = w.counted(w.hash, np.arange(len(w.hash)))
            langs = [w.langs[d] for d in w.doc[at].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(langs, pa.string()), pa.array(n, pa.int64()), pa.array(keys, pa.int64())], ["h", "lang", "f", "key"])

    return written(texts.mapInArrow(run, "h long, lang string, f long, key long").groupBy("h", "lang").agg(F.sum("f").alias("f"), F.min("key").alias("key")), "words")


def shared_keys(known: DataFrame):
    """The sorted hashes of ``known``, broadcast; None where there are more than FILTER."""
    if known.count() > FILTER:
        return None
    keys = np.sort(np.array(known.select("h").toPandas()["h"], np.int64).view(U))
    return known.sparkSession.sparkContext.broadcast(keys)


def frequent_runs(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """``text, lang, key``: of each text the runs of words in which each two neighbours are one of ``pairs``, one piece each.

    Every place of a phrase that can be frequent lies in such a run. Texts without one are left out.
    """
    keys = shared_keys(pairs)
    if keys is None:
        return texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in batched(batches):
            at = w.places(2)
            at = at[member(keys.value, span(rolling(w.hash), at, at + 2))]
            # whether a word and the next one are a pair
            on = np.zeros(len(w.hash) + 1, bool)
            on[at] = True
            kept = np.flatnonzero(on[:-1] | np.concatenate([[False], on[:-2]])) if len(at) else at
            size = w.end[kept] - w.start[kept] + 1
            ends = np.cumsum(size)
            out = w.data[np.minimum(np.arange(size.sum()) - np.repeat(ends - size - w.start[kept], size), max(0, len(w.data) - 1))]
            out[ends - 1] = np.where(on[kept], 32, 10)
            docs = np.unique(w.doc[kept])
            bounds = np.concatenate([[0], ends])[np.searchsorted(w.doc[kept], np.concatenate([docs, [len(w.langs)]]))]
            text = pa.Array.from_buffers(pa.large_string(), len(docs), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out.tobytes())])
            langs = pa.array([w.langs[d] for d in docs.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([text.cast(pa.string()), langs, pa.array(w.keys[docs], pa.int64())], ["text", "lang", "key"])

    return written(texts.mapInArrow(run, "text string, lang string, key long"), "runs")


def longer(texts: DataFrame, known: DataFrame, m: int, least: int) -> DataFrame:
    """``h, f, key`` of phrases of m words with f >= least; known: those of m - 1 words. key: the least of a text that has the phrase.

    Only places where both parts of m - 1 words are known are summed, equal ones of a batch as one row.
    """
    keys = shared_keys(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in batched(batches):
            at = w.places(m)
            sums = rolling(w.hash)
            if keys is not None:
                parts = w.hash if m == 2 else span(sums, np.arange(max(0, len(w.hash) - m + 2)), np.arange(m - 1, max(m - 1, len(w.hash) + 1)))
                ok = member(keys.value, parts)
                at = at[ok[at] & ok[at + 1]]
            h, n, least_keys, _ = w.counted(span(sums, at, at + m), at)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int64()), pa.array(least_keys, pa.int64())], ["h", "f", "key"])

    rows = texts.mapInArrow(run, "h long, f long, key long").groupBy("h").agg(F.sum("f").alias("f"), F.min("key").alias("key"))
    return written(rows.where(F.col("f") >= least), f"phrases-{m}")


def spelt(texts: DataFrame, found: DataFrame, words: range) -> DataFrame:
    """``h, lang, phrase`` of the phrases of ``found`` (h, key), which have so many words; each is spelt by texts of its key only."""
    shared = None
    if found.count() <= FILTER:
        table = found.select("h", "key").toArrow()
        h, key = (table[c].to_numpy() for c in ("h", "key"))
        order = np.argsort(h.view(U))
        shared = found.sparkSession.sparkContext.broadcast((h.view(U)[order], key[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in batched(batches):
            sums = rolling(w.hash)
            for m in words:
                at = w.places(m)
                h = w.hash if m == 1 else span(sums, at, at + m)
                if shared is not None and len(shared.value[0]) and len(h):
                    every, keys = shared.value
                    i = np.minimum(np.searchsorted(every, h), len(every) - 1)
                    ok = (every[i] == h) & (keys[i] == w.keys[w.doc[at]])
                    h, at = h[ok], at[ok]
                yield w.spelt(h, at, m)

    rows = texts.mapInArrow(run, SPELT_SQL).groupBy("h").agg(F.any_value("lang").alias("lang"), F.any_value("phrase").alias("phrase"))
    return written(rows.join(found.select(F.col("h").alias("k")), F.col("h") == F.col("k"), "left_semi"), "spelt")


def member(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(x), bool)
    return keys[np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x


class Trie:
    """A double-array trie of phrases: from state s, word c leads to t = base[s] + c if check[t] is s.

    words: sorted hashes of the words, whose symbols count from 1; accepts: the phrase (its place in the
    list given) that ends in a state, or -1. State 0 is the root.
    """

    def __init__(self, words: np.ndarray, bounds: np.ndarray):
        """words: the hashes of all phrases' words, one phrase after the other; bounds: where each begins, and the end."""
        self.words, symbols = np.unique(words, return_inverse=True)
        size, n = np.diff(bounds), len(bounds) - 1
        many = len(self.words) + 1
        self.check, self.base, self.accepts = (np.full(2 * many, x, np.int32) for x in (-1, 0, -1))
        self.check[0], self.states, self.free = 0, many, many
        # the state that each phrase has come to
        state, depth = np.zeros(n, np.int64), 0
        while (at := np.flatnonzero(size > depth)).size:
            ways, which = np.unique(state[at] * many + symbols[bounds[:-1][at] + depth] + 1, return_inverse=True)
            parents, c = ways // many, ways % many
            first = np.flatnonzero(np.diff(parents, prepend=-1))
            last = np.append(first[1:], len(ways))
            to = np.zeros(len(ways), np.int64)
            # parents with many children find room first
            for i in np.argsort(first - last, kind="stable").tolist():
                cs, s = c[first[i] : last[i]], int(parents[first[i]])
                base = self._room(cs) if s else 0
                self.base[s] = base
                to[first[i] : last[i]] = base + cs
                self.check[base + cs] = s
                self.states = max(self.states, base + int(cs[-1]) + 1)
            state[at], depth = to[which], depth + 1
        self.accepts[state] = np.arange(n)
        self.check, self.base, self.accepts = (x[: self.states].copy() for x in (self.check, self.base, self.accepts))

    def _room(self, cs: np.ndarray) -> int:
        """A base with which all children of a state find free places."""
        while self.free < self.states and self.check[self.free] != -1:
            self.free += 1
        span = int(cs[-1] - cs[0])
        if self.states + span + 2 > len(self.check):
            self.check, self.base, self.accepts = (np.concatenate([x, np.full(len(x) + span, v, np.int32)]) for x, v in ((self.check, -1), (self.base, 0), (self.accepts, -1)))
        # one child takes the first free place; more of them try places all over, as the first ones are taken
        spread = np.arange(TRIES, dtype=np.int64) * 2_654_435_761 % (self.states - self.free + 1) if span else np.zeros(1, np.int64)
        at = self.free + np.sort(spread)
        fits = (self.check[at[:, None] + (cs - cs[0])[None, :]] == -1).all(axis=1)
        return int((at[fits.argmax()] if fits.any() else self.states) - cs[0])

    def count(self, w: Words, out: np.ndarray) -> None:
        """Adds to ``out`` how many places of the texts' pieces lead to each state."""
        i = np.minimum(np.searchsorted(self.words, w.hash), len(self.words) - 1)
        symbol = np.where(self.words[i] == w.hash, i + 1, 0)
        at = np.flatnonzero(symbol)
        at = at[self.check[symbol[at]] == 0]
        state, depth = symbol[at].astype(np.int64), 1
        while len(at):
            out += np.bincount(state, minlength=len(out))
            on = at + depth
            on = np.where(on < len(symbol), on, at)
            ok = (on != at) & (w.piece[on] == w.piece[at]) & (symbol[on] > 0)
            at, state, on = at[ok], state[ok], on[ok]
            to = self.base[state] + symbol[on]
            ok = (to >= 0) & (to < len(self.check))
            ok[ok] = self.check[to[ok]] == state[ok]
            at, state, depth = at[ok], to[ok], depth + 1


def trie_counts(texts: DataFrame, found: DataFrame) -> DataFrame:
    """``h, f``: occurrences of the phrases of ``found`` (h, lang, phrase), counted by tries of about TRIE phrases each."""
    tries = -(-found.count() // TRIE)
    # every shard gives a row a phrase it has, so there are no more shards than keep all cores busy
    texts = texts.coalesce(SHARDS_A_CORE * max(1, texts.sparkSession.sparkContext.defaultParallelism))
    out = found.select("h", F.lit(0).cast("long").alias("f")).limit(0)
    for part in range(tries):
        mine = found.where(F.pmod(F.xxhash64("h"), F.lit(tries)) == part).toArrow()
        w = Words(mine["phrase"].combine_chunks(), mine["lang"].to_pylist())
        trie = Trie(w.hash, np.searchsorted(w.doc, np.arange(len(mine) + 1)))
        shared = texts.sparkSession.sparkContext.broadcast((trie, mine["h"].to_numpy()))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            trie, hashes = shared.value
            total = np.zeros(len(trie.check), np.int64)
            for w in batched(batches):
                trie.count(w, total)
            at = np.flatnonzero((total > 0) & (trie.accepts >= 0))
            yield pa.RecordBatch.from_arrays([pa.array(hashes[trie.accepts[at]]), pa.array(total[at])], ["h", "f"])

        out = out.unionByName(texts.mapInArrow(run, "h long, f long"))
    return out.groupBy("h").agg(F.sum("f").alias("f"))


def collocations(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, top: int = TOP, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the phrases of each language whose words keep together best.

    Texts are lower-cased (A to Z), split into pieces at ``.,;:!?`` and line breaks, and pieces into words
    at spaces and tabs. n: words of the language; a: occurrences of the phrase in pieces, overlaps included, at
    least ``least``; l, r: those of the two parts at the cut that scores lowest (ties: after fewer words);
    score: floor(1000 a n / (l r)). A phrase inside a longer one of as many occurrences is left out. The
    first ``top`` of each language by score, a, then phrase. A null text is empty, a null language ``und``; other
    columns are ignored; repeated rows count as often as they come; an empty table gives an empty
    result. Words and phrases are told apart by 64-bit hashes.
    """
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    # equal texts have one key; it only chooses which texts spell a phrase
    whole_texts = texts = texts.withColumn("key", F.xxhash64("text", "lang"))
    words = word_counts(texts)
    common = known = words.where(F.col("f") >= least).select("h", "f", "key")
    found = None
    for m in range(2, most_words + 1):
        known = longer(texts, known, m, least)
        if known.isEmpty():
            break
        found = known if found is None else found.unionByName(known)
        if m == 2:
            texts = frequent_runs(texts, known)
    if found is None:
        found = known
    longer_names = spelt(texts, found, range(2, most_words + 1))
    names = longer_names.unionByName(spelt(whole_texts, common, range(1, 2)))
    counts = trie_counts(texts, longer_names).unionByName(common.select("h", "f")).select(F.col("h").alias("k"), "f")
    every = written(names.join(counts, F.col("h") == F.col("k")).select("lang", "phrase", "f"), "counted")
    phrases = every.where(F.contains("phrase", F.lit(" ")) & (F.col("f") >= least))
    whole = lambda c: c.cast("decimal(19,0)")
    part = lambda n: every.select(F.col("lang").alias(f"{n}_lang"), F.col("phrase").alias(f"{n}_phrase"), F.col("f").alias(n))
    w = F.split("phrase", " ")
    cuts = phrases.select("lang", "phrase", F.col("f").alias("a"), w.alias("w"), F.explode(F.sequence(F.lit(1), F.size(w) - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("rest"))
    cuts = cuts.join(part("l"), (F.col("lang") == F.col("l_lang")) & (F.col("first") == F.col("l_phrase"))).join(part("r"), (F.col("lang") == F.col("r_lang")) & (F.col("rest") == F.col("r_phrase")))
    total = words.groupBy(F.col("lang").alias("n_lang")).agg(F.sum("f").alias("n"))
    cuts = cuts.join(total, F.col("lang") == F.col("n_lang"))
    # a decimal holds 38 digits; 1000 a n has at most 3 + 16 + 16 for as many as 10^16 words
    cuts = cuts.withColumns({"top": (whole(F.col("a")) * whole(F.col("n")) * F.lit(1000)).cast("decimal(38,0)"), "below": (whole(F.col("l")) * whole(F.col("r"))).cast("decimal(38,0)")})
    scored = cuts.select("lang", "phrase", "a", F.struct(F.expr("top div below").alias("score"), "k", "l", "r", "n").alias("cut"))
    scored = scored.groupBy("lang", "phrase").agg(F.any_value("a").alias("a"), F.min("cut").alias("cut"))
    # every shorter phrase inside a phrase, with the most occurrences that one around it has
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))))
    inner = phrases.select("lang", w.alias("w"), "f").where(F.size("w") > 2).select(F.col("lang").alias("i_lang"), F.explode(spans).alias("inner"), "f")
    inner = inner.groupBy("i_lang", "inner").agg(F.max("f").alias("around"))
    kept = scored.join(inner, (F.col("lang") == F.col("i_lang")) & (F.col("phrase") == F.col("inner")) & (100 * F.col("around") >= 100 * F.col("a")), "left_anti")
    out = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.n", "cut.score")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
