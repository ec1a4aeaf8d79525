def test_stages(spark, data):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{data}/documents.parquet")
    n = [docs.count()]
    for i, (_, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, data)
        if i < len(p.STAGES) - 1:
            assert out.columns == docs.columns
            docs = p.written(out, "test")
            n.append(docs.count())
    rows = out.collect()
    assert n[1] <= n[0] and n[2] < n[1] and n[3] <= n[2] and len(rows) == n[4]
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_stages_of_odd_rows(spark, data):
    import random

    from pyspark.sql import functions as F

    import corpus_pipeline as p

    rng = random.Random(23)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = spark.read.parquet(f"{data}/benchmark.parquet").where("text is not null").orderBy("item_id").first().text
    a, b, long = prose(60), prose(60), prose(20_000)
    rows = [(1, a), (1, a), (2, a + " end"), (None, b), (None, b), (3, None), (None, None), (4, ""), (5, long), (6, f"{prose(40)} {item} {prose(40)}"), (6, item), (7, "x")]
    sql = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, None, "s" if i and i % 2 else None, None) for i, t in rows], sql)
    docs = docs.withColumn("row", F.lit("clash")).withColumn("rid", F.lit(0)).withColumn("src", F.lit("clash"))
    stages, texts = dict(p.STAGES), lambda df: sorted((r.doc_id or 0, r.text or "") for r in df.collect())
    kept = stages["near_copies"](spark, docs, data)
    want = sorted([(1, a), (0, b), (3, ""), (0, ""), (4, ""), (5, long), (6, rows[9][1]), (6, item), (7, "x")])
    assert kept.columns == docs.columns and texts(kept) == want
    clean = stages["decontamination"](spark, docs, data)
    assert clean.columns == docs.columns and texts(clean) == sorted((i or 0, t or "") for i, t in rows if i != 6)
    mixed = stages["mixing"](spark, docs, data)
    assert mixed.columns == docs.columns and set(texts(mixed)) <= set(texts(docs)) and mixed.count() > 0
    dealt = stages["sharding"](spark, docs, data)
    assert dealt.columns == [*docs.columns, "shard", "slot"] and texts(dealt) == texts(docs)
    assert len({(r.shard, r.slot) for r in dealt.collect()}) == len(rows)
    assert all(stages[n](spark, docs.limit(0), data).count() == 0 for n in ("near_copies", "decontamination", "mixing", "sharding"))
