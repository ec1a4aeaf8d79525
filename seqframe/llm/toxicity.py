"""Toxicity by compression with two dictionaries.

Both dictionaries are trained by zstandard on a bounded sample of labelled documents: one on windows of
ordinary text, one on toxic text. A toxic document is ordinary text but for a few words, so the toxic
training text is cut to the words whose beginnings are far more frequent in toxic documents than in
ordinary ones; README has figures for whole windows. Each window of a text is compressed with the ordinary
dictionary and with both; windows that save at least ``window_gain`` bytes are compared again word by word
(windows of one word), and words that save at least ``word_gain`` bytes are hits. Both thresholds, and the
logistic curve that turns the number of hits and words into a score, are fitted on savings: of toxic
documents those that dictionaries of the other folds of the sample give, so none is measured by its own
text, and of ordinary ones those that the final dictionaries give.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The sample: so many documents of each kind at most, none longer than this (characters).
TOXIC_SAMPLE, ORDINARY_SAMPLE, LONGEST = 1500, 3000, 20_000
#: Bytes of the trained dictionaries; zstandard's trainer picks what fits.
ORDINARY_BYTES, TOXIC_BYTES = 6000, 6000
FOLDS = 3
WINDOW = 24
#: Bytes of a word's beginning, with the space before it.
BEGINNINGS = (5, 6, 7)
#: A beginning tells where it is in so large a part of the toxic documents, and so many times as frequent there.
SUPPORT, RATIO = 0.005, 40
THRESHOLD = 0.3
#: Thresholds that are tried, in bytes.
WINDOW_GAINS, WORD_GAINS = range(1, 16), range(2, 16)
NOT_WORD = re.compile(rb"[^a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return [w for w in NOT_WORD.split((text or "").lower().encode()) if w]


def _compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
    # chains and trees must reach back over the whole dictionary
    strategy, shortest, log = (zstandard.STRATEGY_LAZY2, 4, 13) if level == 1 else (zstandard.STRATEGY_BTOPT, 3, 14)
    params = zstandard.ZstdCompressionParameters(
        window_log=15, strategy=strategy, min_match=shortest, search_log=5, chain_log=log, hash_log=log, target_length=32,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)


@dataclass
class Model:
    """Plain values, so that it travels to the tasks; compressors are made where they are used."""

    ordinary: bytes
    toxic: bytes
    window_gain: int = 2
    word_gain: int = 4
    weights: tuple[float, ...] = (-4.0, 0.0, 0.0, 0.0)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_tools"}

    def tools(self) -> tuple:
        if "_tools" not in self.__dict__:
            both = self.toxic + self.ordinary
            self.__dict__["_tools"] = (
                _compressor(self.ordinary, 1), _compressor(both, 1), _compressor(self.ordinary, 2), _compressor(both, 2), {},
            )
        return self.__dict__["_tools"]

    def word_saving(self, word: bytes) -> int:
        """Bytes that the toxic dictionary saves on one word, between text that either dictionary has."""
        _, _, plain, both, known = self.tools()
        if word not in known:
            if len(known) > 200_000:
                known.clear()
            x = self.ordinary[:32] + b" " + word + b" " + self.ordinary[64:96]
            known[word] = len(plain.compress(x)) - len(both.compress(x))
        return known[word]

    def windows(self, words: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
        """Bytes that the toxic dictionary saves on each window, and the window's words."""
        plain, both = self.tools()[:2]
        for i in range(0, len(words), WINDOW):
            # the last bytes of a block are never matched: known text follows the window
            x = b" " + b" ".join(words[i : i + WINDOW]) + b" " + self.ordinary[64:96]
            yield len(plain.compress(x)) - len(both.compress(x)), words[i : i + WINDOW]

    def savings(self, words: list[bytes]) -> list[tuple[int, list[int]]]:
        """(bytes saved on a window, bytes saved on each of its words) of the windows that save anything."""
        if not self.toxic:
            return []
        return [(saved, [self.word_saving(w) for w in part]) for saved, part in self.windows(words) if saved >= WINDOW_GAINS.start]

    def hits(self, words: list[bytes]) -> int:
        if not self.toxic:
            return 0
        return sum(sum(self.word_saving(w) >= self.word_gain for w in part) for saved, part in self.windows(words) if saved >= self.window_gain)

    def score(self, text: str | None) -> float:
        words = words_of(text)
        x = features(self.hits(words), len(words))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(self.weights, x, strict=True))))))


def features(hits: int, n: int) -> tuple[float, float, float, float]:
    return 1.0, float(hits > 0), math.log1p(hits), math.log1p(100 * hits / (n + 20))


def beginnings(word: bytes) -> set[bytes]:
    w = b" " + word + b" "
    return {w[:n] for n in BEGINNINGS if n <= len(w)}


def counted(docs: list[list[bytes]]) -> Counter:
    """In how many documents each beginning is."""
    return Counter(x for d in docs for x in {b for w in set(d) for b in beginnings(w)})


def trained(samples: list[bytes], size: int, segment: int, piece: int) -> bytes:
    """A dictionary of zstandard's trainer; of too little text, the text itself."""
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=piece).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sorted(set(samples)))[-size:]


def dictionaries(toxic: list[list[bytes]], ordinary: list[list[bytes]], a: Counter, b: Counter) -> Model:
    """Both dictionaries; a, b: counted() of the documents."""
    windows = [b" " + b" ".join(w[i : i + WINDOW]) + b" " for w in ordinary for i in range(0, len(w), WINDOW)]
    plain = trained(windows, ORDINARY_BYTES, 64, 8) if windows else b""
    least = max(3, SUPPORT * len(toxic))
    telling = {x for x, n in a.items() if n >= least and n / len(toxic) >= RATIO * (b[x] + 0.5) / (len(ordinary) + 1)}
    cut = [b" " + w + b" " for d in toxic for w in d if not telling.isdisjoint(beginnings(w))]
    return Model(plain.ljust(96), trained(cut, TOXIC_BYTES, 12, 6) if cut else b"")


def f1(hit: np.ndarray, y: np.ndarray) -> float:
    return 2 * float((hit * y).sum()) / max(1.0, float(hit.sum() + y.sum()))


def thresholds(savings: list[list[tuple[int, list[int]]]], y: np.ndarray) -> tuple[int, int]:
    """The window and word thresholds that tell documents apart best (F1 of "has a hit"; the lowest of equals)."""
    best = np.zeros((len(savings), WINDOW_GAINS.stop), int)  # the largest word saving in windows that save so much
    for i, windows in enumerate(savings):
        for saved, words in windows:
            best[i, : saved + 1] = np.maximum(best[i, : saved + 1], max(words))
    return max(((a, b) for a in WINDOW_GAINS for b in WORD_GAINS), key=lambda g: (f1(best[:, g[0]] >= g[1], y), -g[0], -g[1]))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(b)), x.T @ (y - p) - 0.1 * b)
        b += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(b.tolist())


def fit(rows: list[tuple[str, int]]) -> Model:
    """A model from (text, label) rows, the same whatever their order. Equal rows count once."""
    rows = sorted(set((r[0] or "", r[1]) for r in rows), key=lambda r: (zlib.crc32(r[0].encode()), r))
    docs, y = [words_of(t) for t, _ in rows], np.array([float(label) for _, label in rows])
    fold = np.array([zlib.crc32(t.encode()) // 7 % FOLDS for t, _ in rows], int)
    pick = lambda label, ok: [docs[i] for i in np.flatnonzero((y == label) & ok)]
    each = [{label: counted(pick(label, fold == f)) for label in (0, 1)} for f in range(FOLDS)]
    every = {label: sum((e[label] for e in each), Counter()) for label in (0, 1)}
    model = dictionaries(pick(1, fold >= 0), pick(0, fold >= 0), every[1], every[0]) if y.sum() else Model(b"".ljust(96), b"")
    rate = (y.sum() + 0.1) / (len(y) + 1)
    model.weights = (math.log(rate / (1 - rate)), 0.0, 0.0, 0.0)
    if not model.toxic:
        return model
    savings: list[list[tuple[int, list[int]]]] = [[] for _ in docs]
    for f in range(FOLDS):
        others = fold != f
        if pick(1, others):
            part = dictionaries(pick(1, others), pick(0, others), every[1] - each[f][1], every[0] - each[f][0])
            for i in np.flatnonzero(fold == f):
                savings[i] = part.savings(docs[i])
    # ordinary documents are measured by the dictionaries that will be used: what these take for toxic must not pass
    for i in np.flatnonzero(y == 0):
        savings[i] = model.savings(docs[i])
    model.window_gain, model.word_gain = thresholds(savings, y)
    hits = [sum(sum(s >= model.word_gain for s in words) for saved, words in w if saved >= model.window_gain) for w in savings]
    model.weights = logistic(np.array([features(h, len(d)) for h, d in zip(hits, docs, strict=True)]), y)
    return model


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 4 == 2


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on labelled rows whose crc32(doc_id as text) mod 4 is not 2; null labels and ids are left out.

    The sample takes at most TOXIC_SAMPLE and ORDINARY_SAMPLE labels in the order of a hash of the id, and
    of their documents those of at most LONGEST characters. One task fits on it; only the model, some
    kilobytes, comes to the driver.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).select(
        F.col("doc_id").alias("of"), (F.col("toxic") > 0).cast("int").alias("y")
    ).distinct()
    pick = lambda y, n: known.where(F.col("y") == y).orderBy(F.md5(F.col("of").cast("string")), "of").limit(n)
    sample = pick(1, TOXIC_SAMPLE).unionByName(pick(0, ORDINARY_SAMPLE))
    rows = docs.select("doc_id", "text").where(F.length("text") <= LONGEST).join(F.broadcast(sample), F.col("doc_id") == F.col("of")).select("text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(t, y) for batch in batches for t, y in zip(batch["text"].to_pylist(), batch["y"].to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(found))], pa.binary())], ["model"])

    got = rows.repartition(1).mapInArrow(run, "model binary").first()
    return fit([]) if got is None else pickle.loads(got.model)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted``, one row per input row.

    Null text counts as empty and gets the score of a text without hits. A null id is not held out.
    Repeated rows get equal scores; an empty table gives an empty result; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            s = [m.score(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(s, pa.float64())], ["doc_id", "held_out", "score"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    out = slim.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows predicted toxic; columns and their order stay, whatever their names.

    Null and empty texts have no hit and stay; ids are not read, so null and repeated ids are rows like
    others; equal texts stay or go together; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            yield batch.filter(pa.array([m.score(t) < THRESHOLD for t in batch["text"].to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def toxicity_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that the toxicity query returns."""
    return score(docs, learn(docs, labels))
