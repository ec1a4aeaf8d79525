import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqframe.llm import chat, decontaminate, html_extract, ngram_join, substring_dedup, tokens, toxicity
from seqframe.llm.components import components

SQL = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "ash bay cob dew elm fog gum hay ivy jet kin log mud nut oak pea rye sun tar urn vat wax yew zen".split()


def docs(spark, *rows):
    return spark.createDataFrame([(i, t, None, "s", None) for i, t in rows], SQL)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def test_word_hashes_follow_words():
    texts = ["a b  c", "", None, "\ta\x0bb\n", "é c"]
    h, off = tokens.word_hashes(pa.array(texts, pa.string()))
    assert np.diff(off).tolist() == [3, 0, 0, 2, 2]
    assert h[0] == h[3] and h[1] == h[4] and h[2] == h[6] and h[5] not in (h[0], h[1], h[2])


# chat


def test_escape_is_undone_and_leaves_no_control_string():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice([*chat.CONTROL, "\\", ".", "\\.", "a", "\n", "<", "[INST", "é"]) for _ in range(8))
        assert chat.unescape(chat.escape(text)) == text
        assert not any(c in chat.escape(text) for c in chat.CONTROL)


def test_chats_come_back(spark):
    rows = [(1, 1, "assistant", " hi  </s> \U0001f600é"), (1, 0, "user", None), (1, 2, "assistant", ""), (1, 2, "assistant", ""), (2, 0, None, "\\.x"), (None, 0, "assistant", "a\n" * 3000), (3, 0, "sys\ntem", "<|im_end|>")]
    x = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    got = {r.conv_id: r for r in chat.chat_table(x).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].n_turns == 4 and got[1].turns_sha256 == sha("user\n\nassistant\n" + rows[0][3] + "\n" + "assistant\n\n" * 2)
    assert got[1].loss_chars == len(rows[0][3]) and got[1].loss_sha256 == sha(rows[0][3])
    assert got[None].loss_chars == 6000 and got[2].loss_chars == 0 and got[2].turns_sha256 == sha("\n\\.x\n") and got[3].turns_sha256 == sha("sys\ntem\n<|im_end|>\n")
    assert got[-1].loss_sha256 == sha("</s>[INST] ok [/INST]")
    assert chat.format_chats(x.limit(0)).count() == 0


# n-gram join


def brute_components(rows, words, num, den):
    sets = {}
    for i, t in rows:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").split()
        sets[i] = {tuple(w[j : j + words]) for j in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    comp = {i: i for i in sets}
    link = lambda a, b: sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a != b and link(a, b) and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    return {i: (len(s), comp[i]) for i, s in sets.items()}


@pytest.mark.parametrize("tile,least", [(128, 64), (4, 3)])
def test_similar_groups_against_all_pairs(spark, monkeypatch, tile, least):
    monkeypatch.setattr(ngram_join, "TILE", tile)
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "PAIRS_AT_ONCE", 16)
    rng = random.Random(7)
    base, rows = [prose(rng, n) for n in (3, 8, 40, 90)], [(0, None), (1, ""), (2, " \n"), (3, "Ab c"), (4, "aB  C")]
    for i in range(10, 130):
        w = rng.choice(base).split()
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        rows.append((i, " ".join(w)))
    got = ngram_join.similar_groups(docs(spark, *rows), 4, 85, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, 4, 85, 100)


@pytest.mark.parametrize("rows", [1, 7, 4096])
def test_entries_come_back(rows):
    rng = np.random.default_rng(rows)
    x = np.zeros(rows, ngram_join.ENTRY)
    x["h"] = np.sort(rng.integers(0, 1 << 64, rows, dtype=np.uint64))
    x["h"][-1] = (1 << 64) - 1
    x["node"] = rng.integers(0, 1 << 60, rows)
    x["n"], x["pos"] = rng.integers(0, 1 << 32, rows), rng.integers(0, 1 << 32, rows)
    assert (ngram_join.unsqueezed(ngram_join.squeezed(x)) == x).all()


def test_similar_groups_of_odd_rows(spark):
    rng = random.Random(9)
    long = prose(rng, 20_000)
    x = docs(spark, (None, long), (7, long + " end"), (7, long), (9, "short"), (9, None))
    got = sorted((r.doc_id or 0, r.n_shingles > 0, r.component_id) for r in ngram_join.similar_groups(x.withColumn("n", F.lit("clash"))).collect())
    assert got == [(0, True, 7), (7, True, 7), (7, True, 7), (9, False, 9), (9, True, 9)]
    assert ngram_join.similar_groups(docs(spark)).count() == 0
    assert ngram_join.keep_one(docs(spark, (1, long), (2, long), (3, None), (4, ""))).count() == 3


def test_one_row_of_each_group_stays(spark):
    rng = random.Random(19)
    a, b, c = prose(rng, 40), prose(rng, 40), prose(rng, 40)
    x = docs(spark, (7, a), (7, a), (9, a + " end"), (None, b), (None, b), (None, c), (5, c + " end"), (5, b), (None, None), (None, None), (3, " "))
    x = x.withColumn("row", F.lit("clash")).withColumn("k1", F.lit("clash"))
    got = ngram_join.keep_one(x)
    assert got.columns == x.columns and ngram_join.keep_one(docs(spark)).count() == 0
    assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == sorted([(7, a), (5, c + " end"), (5, b), (0, ""), (0, ""), (3, " ")])
    only_null = ngram_join.keep_one(docs(spark, (None, a), (None, b), (None, b + " end")))
    assert only_null.count() == 2


def test_rows_that_no_filter_holds_are_not_shuffled(spark, monkeypatch):
    rng = random.Random(29)
    texts = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=9)) for _ in range(900)) for _ in range(300)]
    # 3 rows go, one row is there twice
    rows = [*enumerate(texts), (300, texts[5]), (301, texts[6] + " end"), (302, texts[5]), (7, texts[7]), (None, None)]
    want = sorted((i if i is not None else -1, t or "") for i, t in [*enumerate(texts), (None, None)])
    x = docs(spark, *rows)
    plan, sc = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.sparkContext._jsc.sc()

    def shuffled():
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorList(False).apply(0).totalShuffleWrite()

    # as with many rows: what goes is too much to be broadcast
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = ngram_join.keep_one(x)
        before = shuffled()
        got = sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in kept.collect())
        assert got == want and shuffled() - before < sum(map(len, texts)) // 10
        # a filter that lets all through changes nothing
        monkeypatch.setattr(ngram_join, "possible", lambda rows, keys: rows.withColumn("maybe", F.lit(True)))
        got = sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in ngram_join.keep_one(x).collect())
        assert got == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", plan)


def test_large_batches_are_searched_in_small_ones(monkeypatch):
    rng = random.Random(31)
    item = prose(rng, 30)
    texts = [f"{prose(rng, 9)} {item}" if i % 7 == 3 else prose(rng, 9) if i % 5 else None for i in range(2000)]
    items, seen, search = decontaminate.prepare([(1, item)]), [], decontaminate.search
    monkeypatch.setattr(decontaminate, "search", lambda i, t: seen.append(len(t)) or search(i, t))
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(texts, pa.string())], ["doc_id", "text"])
    got = [i for b in decontaminate.cleaned(items, iter([batch])) for i in b["doc_id"].to_pylist()]
    assert got == [i for i in range(2000) if i % 7 != 3]
    assert max(seen) <= ngram_join.AT_ONCE and sum(seen) == 2000


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(50, 51)], "a long, b long")
    assert {r.node: r.comp for r in components(links).collect()} == {**{i: 1 for i in range(1, 41)}, 50: 50, 51: 50}


# substring de-duplication


def brute_repeats(rows, k):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = (t or "").encode().split()
        gone = set()
        for p in range(len(w) - k + 1):
            x = tuple(w[p : p + k])
            if x in seen:
                gone.update(range(p, p + k))
            seen.add(x)
        out[i] = (len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone).decode())
    return out


def test_repeats_against_a_loop(spark):
    rng = random.Random(11)
    passages = [prose(rng, n) for n in (5, 6, 9, 30)]
    rows = [(i, " ".join(rng.choice([*passages, prose(rng, 4), "la " * 7]) for _ in range(rng.randrange(0, 9)))) for i in range(120)] + [(500, None), (501, "x")]
    got = substring_dedup.drop_repeats(docs(spark, *rows), window=5).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.text) for r in got} == brute_repeats(rows, 5)


def test_repeats_of_odd_rows(spark):
    text = prose(random.Random(2), 20_000)
    got = substring_dedup.drop_repeats(docs(spark, (None, text), (3, text), (3, text), (1, "a b")).withColumn("chunk", F.lit("clash"))).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in got) == [(0, 20_000, 20_000), (1, 2, 0), (3, 20_000, 0), (3, 20_000, 20_000)]
    assert substring_dedup.drop_repeats(docs(spark)).count() == 0


# toxicity


def test_toxicity_held_out(spark, data):
    rng, rows = random.Random(4), []
    for i in range(900):
        w = prose(rng, rng.randrange(20, 200)).split()
        y = i % 6 == 0
        for _ in range(4 if y else 0):
            w[rng.randrange(len(w))] = rng.choice(["bletchword", "vilestem" + rng.choice(WORDS), "Nastyterm!"])
        rows.append((i, " ".join(w), int(y)))
    x = docs(spark, *[r[:2] for r in rows], (5000, None), (5001, ""), (None, "a"))
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(5000, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_table(x.withColumn("score", F.lit("clash")), labels).collect()}
    held = [r for r in rows if got[r[0]].held_out]
    assert 150 < len(held) < 300
    assert sum(got[i].predicted == y for i, _, y in held) >= 0.97 * len(held)
    assert got[5000].score == got[5001].score and 0 <= got[5000].score < 0.3 and len(got) == 903
    assert toxicity.toxicity_table(docs(spark), labels).count() == 0


def test_dictionaries_and_thresholds_come_from_the_sample():
    rng, rows = random.Random(8), []
    tails = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(500)]
    for i in range(1500):
        w = prose(rng, 40).split()
        if i % 3 == 0:
            w[rng.randrange(len(w))] = "vilestem" + tails[i % 500]
        rows.append((" ".join(w), int(i % 3 == 0)))
    model = toxicity.fit(rows)
    assert b"vilestem" in model.toxic and b"vilestem" not in model.ordinary and toxicity.fit(rows[::-1]) == model
    assert sum((model.score(t) >= 0.3) == bool(y) for t, y in rows) >= 0.97 * len(rows)
    # savings against a plain loop over windows and words
    words = toxicity.words_of(rows[0][0] + " " + rows[1][0])
    plain, both, plain2, both2, _ = model.tools()
    gap = lambda a, b, x: len(a.compress(x)) - len(b.compress(x))
    hits = 0
    for i in range(0, len(words), toxicity.WINDOW):
        part = words[i : i + toxicity.WINDOW]
        if gap(plain, both, b" " + b" ".join(part) + b" " + model.ordinary[64:96]) >= model.window_gain:
            hits += sum(gap(plain2, both2, model.ordinary[:32] + b" " + w + b" " + model.ordinary[64:96]) >= model.word_gain for w in part)
    assert hits == model.hits(words) > 0
    # thresholds: no others have a larger F1
    y = np.array([1.0, 0, 1, 0])
    savings = [[(5, [0, 6])], [(5, [4])], [(9, [7]), (1, [9])], []]
    assert toxicity.thresholds(savings, y) == (1, 5)
    assert toxicity.fit([]).score("any text") < 0.5 and toxicity.fit([("a b", 1), (None, 0)]).score(None) <= 1


def test_toxicity_of_long_and_repeated_rows(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, 30) + (" vilestemxyz" * 2 if i % 4 == 0 else "")) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    x = docs(spark, *rows, (900, prose(rng, 20_000)), (901, prose(rng, 50) + " vilestemxyz"), (901, "ash"), (None, None))
    x = x.unionByName(x.where("doc_id = 900"))
    model = toxicity.learn(x, labels)
    kept = toxicity.drop_toxic(x, model)
    got = sorted((r.doc_id or 0) for r in kept.where("doc_id >= 900 or doc_id is null").collect())
    assert kept.columns == x.columns and got == [0, 900, 900, 901]
    assert toxicity.drop_toxic(docs(spark), model).count() == 0


# decontamination


def test_items_found_against_all_windows(spark):
    rng = random.Random(6)
    items = [(i, prose(rng, rng.randrange(12, 40))) for i in range(12)] + [(90, "two words"), (91, None)]
    rows = []
    for i in range(60):
        w = prose(rng, rng.randrange(0, 120)).split()
        if i % 3 == 0:
            leak = items[i // 5][1].upper().split()
            for _ in range(i % 4):
                leak[rng.randrange(len(leak))] = "other"
            at = rng.randrange(len(w) + 1)
            w[at:at] = leak
        rows.append((i, " ".join(w)))
    rows += [(100, None), (101, "Two, words!")]
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_items(docs(spark, *rows).withColumn("item_id", F.lit("clash")), spark.createDataFrame(items, "item_id long, text string")).collect()}
    shingles = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in items if t and len(t.split()) >= 5}
    df = {}
    for s in shingles.values():
        for x in s:
            df[x] = df.get(x, 0) + 1
    want = {(101, 90)}
    for d, t in rows:
        w = (t or "").lower().split()
        for i, s in shingles.items():
            n, weight = len(dict(items)[i].split()), {x: 1 + np.log(13 / df[x]) for x in s}
            for p in range(max(1, len(w) - n + 1)):
                own = {tuple(w[q : q + 5]) for q in range(p, min(len(w), p + n) - 4)}
                if sum(weight[x] for x in s & own) >= 0.8 * sum(weight.values()) - 1e-9:
                    want.add((d, i))
    assert got == want
    left = decontaminate.drop_contaminated(docs(spark, *rows), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in left.collect()} == {d for d, _ in rows} - {d for d, _ in want}


def test_no_items_or_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_items(docs(spark, (1, "a b c d e f")), none).count() == 0
    assert decontaminate.find_items(docs(spark), none).count() == 0
    some = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    assert decontaminate.find_items(docs(spark, (1, "a b c d e f g h"), (2, None)), some).count() == 0


def test_verbatim_items_with_repeats_against_all_windows():
    rng = random.Random(12)
    items = [(i, " ".join(rng.sample(prose(rng, n).split(), n) + [w] * m)) for i, (n, m, w) in enumerate([(30, 30, "0"), (60, 60, "0"), (30, 10, "x"), (40, 80, "1"), (8, 50, "0")] * 4)]
    texts = [f"{prose(rng, 50)} {t} {prose(rng, 50)}" for _, t in items] + [t for _, t in items] + ["0 " * 200, prose(rng, 90)]
    shingles = lambda w: {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
    own = [shingles(t.split()) for _, t in items]
    weight = {x: 1 + np.log(len(items) / sum(x in s for s in own)) for s in own for x in s}
    want = {}
    for d, t in enumerate(texts):
        w = t.split()
        for i, s in enumerate(own):
            n, total = len(items[i][1].split()), sum(weight[x] for x in s)
            share, at = max((round(sum(weight[x] for x in s & shingles(w[p : p + n])) / total, 6), -p) for p in range(max(1, len(w) - n + 1)))
            if share >= 0.8:
                want[d, i] = (share, -at)
    got = {(row, k): (round(share, 6), at) for row, k, share, at, _ in decontaminate.search(decontaminate.prepare(items), pa.array(texts))}
    assert got == want and {(i, i) for i in range(20)} | {(i + 20, i) for i in range(20)} <= set(got)


def test_weights_do_not_depend_on_blocks(spark, monkeypatch):
    rng = random.Random(13)
    common = prose(rng, 25)
    items = [(i, f"{common} {prose(rng, 8)}") for i in range(12)] + [(50, "two words")]
    rows = [(i, f"{prose(rng, 30)} {' '.join(t.split()[:-2])} {prose(rng, 30)}") for i, t in items] + [(100, common), (101, "two words")]
    found = lambda: sorted(tuple(r) for r in decontaminate.find_items(docs(spark, *rows), spark.createDataFrame(items, "item_id long, text string")).collect())
    whole = found()
    monkeypatch.setattr(decontaminate, "ITEMS_A_BLOCK", 3)
    assert len(whole) == 13 and found() == whole


# HTML

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var x="</p><article>no</article>";</script></head>
<body><nav><ul><li><a href="/">menu</a></li></ul></nav><!-- <p>no --><div class="ad">buy &amp; buy</div><article><h1>Head {i}</h1>
<p><b>one &lt;tag&gt;<br>two<p>three  <a href=x>li</a>nk</p><aside>side</aside><ul><li>four<li>five</ul></article><div id="comments">said</div><footer>&copy;</footer>"""


def test_pages(spark):
    div = '<html><body><div class="menu"><a>a</a></div><div class="content"><p>Main &eacute; text</p><form>f</form></div><p>x'
    rows = [(i, "http://a.example/x", PAGE.format(i=i)) for i in range(5)] + [(10, "http://b.example", div), (11, None, None), (12, "odd", ""), (13, "http://c.example", "plain")]
    got = {r.page_id: r for r in html_extract.page_table(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()}
    assert got[3].text == "Head 3\none <tag> two\nthree link\nfour\nfive"
    assert got[10].text == "Main é text" and got[11].text == "" and got[12].text == "" and got[13].text == "plain" and got[13].n_chars == 5
    assert html_extract.page_table(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def page_texts(spark, rows):
    return {r.page_id: r.text for r in html_extract.page_table(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_odd_pages_leave_the_host_its_slot(spark):
    page = "<html><body><div>notice</div><article><p>Text {i}</p></article><div>more</div></body></html>"
    rows = [(i, "http://a.example/x", page.format(i=i)) for i in range(20)]
    rows += [(50, "http://a.example/l", page.format(i=50).replace("<div>more", "<article><p>Second</p></article><div>more")), (51, "http://a.example/u", page.format(i=51).replace("</article>", ""))]
    got = page_texts(spark, rows)
    assert all(got[i] == f"Text {i}" for i in range(20)) and got[50] == "Text 50\nSecond" and "Text 51" in got[51]


def test_every_page_has_its_own_id_or_layout(spark):
    page = '<html><body><div>notice</div><article id="post-{i}" class="post-{i} kind"><p>Text {i}</p></article><div>more</div></body></html>'
    wrap = '<html><body><div class="l{i}"><div>notice</div><article><p>Text {i}</p></article></div></body></html>'
    # div.content and the div inside have one level; the links count against the outer one on all pages together
    links = '<html><body><div class="content"><a>many many links</a><div class="post" id="n{i}"><p>Text {i}</p></div></div></body></html>'
    rows = [(i, "http://a.example/x", page.format(i=i)) for i in range(40)] + [(100 + i, "http://b.example/x", wrap.format(i=100 + i)) for i in range(40)]
    rows += [(200 + i, "http://c.example/x", links.format(i=200 + i)) for i in range(40)]
    got = page_texts(spark, rows)
    assert got == {r[0]: f"Text {r[0]}" for r in rows}


def test_names_inside_an_article_take_no_text(spark):
    inner = [
        '<div class="post-header"><h1>Title</h1></div>', '<section class="social-history"><p>Social</p></section>', '<p class="related">Related</p>', '<h2 id="comments-on-kant">Comments on Kant</h2>',
        '<div class="menu-of-the-day">Menu</div>', '<p id="notice">Notice</p>', '<table class="share prices"><tr><td>x</td></tr></table>', '<div class="comments">gone</div>', '<div id="ad-box">gone</div>',
        '<ul class="share-buttons"><li>gone</ul>', "<nav>gone</nav>",
    ]
    rows = [(i, "http://a.example/x", f"<body><div>top</div><article><p>One {i}</p>{''.join(inner)}<p>Two.</p></article></body>") for i in range(7)]
    got = page_texts(spark, rows)
    assert got[3] == "One 3\nTitle\nSocial\nRelated\nComments on Kant\nMenu\nNotice\nx\nTwo."


def test_very_long_and_repeated_pages(spark):
    text = "word " * 300_000
    rows = [(1, "http://a.example/", f"<body><nav>n</nav><article><p>{text}</p></article></body>")] * 2 + [(2, "http://a.example/", "<body><nav>n</nav><article><p>b</p></article></body>")] * 3
    got = html_extract.page_table(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.n_chars) for r in got) == [(1, len(text) - 1)] * 2 + [(2, 1)] * 3
