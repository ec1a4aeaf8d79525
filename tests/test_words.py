import random

from conftest import plain
from pyspark.sql import functions as F

from seqframe.functions.sequence import protein, reverse_complement
from seqframe.operators import gapped


def test_frames_equal_columns(spark):
    draw = random.Random(12)
    texts = [(i, "".join(draw.choices("ACGTNacg-", k=n))) for i, n in enumerate([0, 1, 2, 3, 4, 5, 50, 51, 52, 200])]
    df = spark.createDataFrame(texts, "id long, seq string")
    both = [(F.upper("seq"), 1), (reverse_complement(F.upper("seq")), -1)]
    each = F.array(*[F.struct(F.lit(sign * f).alias("frame"), protein(F.substring(s, f, 1 << 30)).alias("seq")) for s, sign in both for f in (1, 2, 3)])
    expected = df.select("id", F.explode(each).alias("s")).select("id", "s.frame", "s.seq")
    got = gapped.frames(df).select("id.id", "id.frame", "seq")
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain([tuple(r) for r in expected.collect()], got.columns)


def test_filtered_alignments_equal_those_of_all_places(spark, monkeypatch):
    draw = random.Random(13)
    ref = ["".join(draw.choices("ACGT", k=300)) for _ in range(4)]
    qry = ["".join(draw.choices("ACGT", k=100)) + t[30:250] + "".join(draw.choices("ACGT", k=draw.randrange(60))) for t in ref] + ["".join(draw.choices("ACGT", k=900)), "ACG", ""]
    r, q = (spark.createDataFrame(list(enumerate(x)), "id long, seq string") for x in (ref, qry))
    run = lambda f: sorted(map(str, f(r, q).collect()))
    few = [run(f) for f in (gapped.align_gapped, gapped.align_translated)]
    # only sequences with a word go into the join
    kept = gapped.with_words(q, 20, [t[i : i + 20] for t in ref for i in range(281)])
    assert sorted(x.id for x in kept.collect()) == [0, 1, 2, 3] and all(x.seq[p : p + 20] == w for x in kept.collect() for p, w in zip(x["at"], x.words, strict=True))
    monkeypatch.setattr(gapped, "MOST_WORDS", 0)
    assert few == [run(f) for f in (gapped.align_gapped, gapped.align_translated)] and all(few)
