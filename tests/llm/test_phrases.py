import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqframe.llm import phrases as p

SQL = "doc_id long, text string, lang string"


def plain(rows, least, most_words, top):
    """The query by dictionaries."""
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + m])) for m in range(1, most_words + 1) for i in range(len(w) - m + 1))
    cands = {(lang, w): c for (lang, w), c in f.items() if len(w) > 1 and c >= least}
    out = []
    for (lang, w), a in cands.items():
        inside = any(y == lang and len(v) > len(w) and c >= a and any(v[i : i + len(w)] == w for i in range(len(v))) for (y, v), c in cands.items())
        if not inside:
            score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            out.append((lang, " ".join(w), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score))
    done = []
    for lang in {x[0] for x in out}:
        mine = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        done += [(x[0], i + 1, *x[1:]) for i, x in enumerate(mine[:top])]
    return sorted(done)


def texts(seed, n):
    rng = random.Random(seed)
    words = ["a", "B", "c", "d\t", "é", "x,", "y.\n", "z", "of the", "of  THE\r", "new york city", " q"]
    rows = [(i, " ".join(rng.choices(words, range(len(words), 0, -1), k=rng.randrange(0, 40))), rng.choice(["en", "de", None, "und", ""])) for i in range(n)]
    return [*rows, (None, None, "en"), (1, "", None), (2, "a " * 5000, "en"), (2, "a " * 5000, "en"), (3, "solo words here", "fr")]


@pytest.mark.parametrize("least,most,top,trie,filter_", [(5, 5, 2000, 1 << 18, 1 << 22), (3, 4, 7, 10, 20)])
def test_collocations_against_dictionaries(spark, monkeypatch, least, most, top, trie, filter_):
    monkeypatch.setattr(p, "TRIE", trie)
    monkeypatch.setattr(p, "FILTER", filter_)
    monkeypatch.setattr(p, "BYTES_AT_ONCE", 500)
    rows = texts(4, 250)
    x = spark.createDataFrame(rows, SQL).repartition(3).withColumn("phrase", F.lit("clash")).withColumn("h", F.lit(1))
    got = sorted(tuple(r) for r in p.collocations(x, least, most, top).collect())
    assert got == plain(rows, least, most, top) and any(len(r[2].split(" ")) > 2 for r in got)


def test_no_phrases(spark):
    x = spark.createDataFrame(texts(1, 3)[:3], SQL)
    assert p.collocations(x, 10_000).count() == 0 and p.collocations(x.limit(0)).count() == 0


def test_trie_holds_what_it_was_given():
    rng = random.Random(2)
    some = list({tuple(rng.randrange(1, 40) for _ in range(rng.randrange(2, 6))) for _ in range(600)})
    trie = p.Trie(np.array([w for x in some for w in x], np.uint64), np.concatenate([[0], np.cumsum([len(x) for x in some])]))
    for x in {*some, *(tuple(rng.randrange(1, 45) for _ in range(3)) for _ in range(600))}:
        s = 0
        for c in x:
            i = int(np.searchsorted(trie.words, np.uint64(c)))
            t = int(trie.base[s]) + i + 1
            s = t if i < len(trie.words) and trie.words[i] == c and t < len(trie.check) and trie.check[t] == s else None
            if s is None:
                break
        assert (s is not None and trie.accepts[s] >= 0) == (x in some)


def test_words_and_pieces():
    w = p.Words(pa.array(["A b,c\n d", None, "", "É\te..f"]).slice(0), ["en"] * 4)
    assert [w.data[a:b].tobytes().decode() for a, b in zip(w.start, w.end, strict=True)] == ["a", "b", "c", "d", "É", "e", "f"]
    assert len(set(w.piece.tolist())) == 5 and w.places(2).tolist() == [0, 4]
