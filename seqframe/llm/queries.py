"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seqframe.llm.chat import chat_table
from seqframe.llm.conversations import repair_table
from seqframe.llm.decontaminate import find_items
from seqframe.llm.exact_dedup import mark_duplicates
from seqframe.llm.fingerprints import fingerprint_table
from seqframe.llm.html_extract import page_table
from seqframe.llm.licenses import TEMPLATES, scan, template_rows
from seqframe.llm.mixing import ENTROPY, MAX_REPEATS, SCALE, STEPS, mix_table
from seqframe.llm.ngram_join import component_table
from seqframe.llm.phrases import LEAST, MOST_WORDS, TOP, collocations
from seqframe.llm.sharding import shard_table
from seqframe.llm.substring_dedup import removal_table
from seqframe.llm.toxicity import toxicity_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _over(name: str, f: Callable[..., DataFrame], *more: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(*[table(spark, sf_dir, t) for t in (name, *more)])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_format": _over("conversations", chat_table),
        "op2_source_mixing": _over("documents", mix_table),
        "op3_exact_dedup": _over("documents", mark_duplicates),
        "op4_ngram_join": _over("documents", component_table),
        "op5_toxicity": _over("documents", toxicity_table, "labels"),
        "op6_license_scan": _over("documents", scan),
        "op7_sharding": _over("documents", shard_table),
        "op8_decontamination": _over("documents", find_items, "benchmark"),
        "op9_substring_dedup": _over("documents", removal_table),
        "op10_html_extraction": _over("pages", page_table),
        "op11_conversation_repair": _over("conversations", repair_table),
        "op12_phrase_collocations": _over("documents", collocations),
        "op13_fingerprints": _over("documents", fingerprint_table),
    }


_SPACE = r"[\x20\x09-\x0D]+"
_WORDS = r"[^\x20\x09-\x0D]+"

_EXACT = rf"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

_MIX = rf"""
WITH d AS (SELECT doc_id, source, coalesce('s' || source, 'n') AS src, len(regexp_extract_all(coalesce(text, ''), '{_WORDS}')) AS tok FROM documents),
t AS (SELECT src, sum(tok)::BIGINT AS t_src FROM d GROUP BY src HAVING sum(tok) > 0),
s AS (SELECT src, t_src, t_src / (SELECT sum(t_src)::DOUBLE FROM t) AS share FROM t),
g AS (SELECT k, k / {float(STEPS)} AS e FROM range({STEPS + 1}) r(k)),
y0 AS (SELECT k, e, sum(floor(pow(share, e) * {float(SCALE)})::BIGINT)::DOUBLE AS z, sum(floor(pow(share, e) * ln(share) * {float(SCALE)})::BIGINT)::DOUBLE AS a,
             max(pow(share, e - 1)) AS top, ln(count(*)) AS most FROM s, g GROUP BY k, e),
m AS (SELECT k, ln(z / {float(SCALE)}) - e * a / z AS ent, most, top / (z / {float(SCALE)}) AS rep FROM y0),
k AS (SELECT coalesce(max(k) FILTER (most = 0 OR ent / most >= {ENTROPY} - 1e-9), 0) AS k_even, min(k) FILTER (rep <= {MAX_REPEATS} + 1e-9) AS k_spare FROM m),
e AS (SELECT greatest(k_even, k_spare) AS k FROM k),
w AS (SELECT src, t_src, CASE WHEN k = {STEPS} THEN t_src ELSE greatest(1, floor(pow(share, k / {float(STEPS)}) * {float(SCALE)})::BIGINT) END::HUGEINT AS w FROM s, e),
q AS (SELECT src, t_src, (SELECT sum(t_src) FROM t)::HUGEINT * w AS n, (SELECT sum(w) FROM w)::HUGEINT AS z FROM w),
b AS (SELECT src, t_src, (n // z + (row_number() OVER (ORDER BY n % z DESC, src) <= (SELECT sum(t_src) FROM t) - sum(n // z) OVER ())::INT)::BIGINT AS b FROM q),
p AS (SELECT src, t_src, b // t_src AS f, b % t_src AS rest FROM b),
x AS (SELECT doc_id, source, tok, d.src, f, rest, unnest(range(f + 1)) AS block FROM d JOIN p ON d.src = p.src),
y AS (SELECT *, md5('mix#' || block || '#' || coalesce(doc_id::VARCHAR, '')) AS h FROM x WHERE block < f OR rest > 0),
z AS (SELECT *, sum(tok) OVER w AS upto, row_number() OVER w AS mix_rank FROM y WINDOW w AS (PARTITION BY src, block ORDER BY h, doc_id::VARCHAR ROWS UNBOUNDED PRECEDING))
SELECT doc_id, source, tok AS n_tokens, block::INT AS mix_block, mix_rank FROM z WHERE block < f OR upto <= rest
"""

_TEMPLATES = ", ".join(f"('{n}', {s}, '{x}')" for n, s, x in template_rows(TEMPLATES))
_LICENSES = f"""
WITH k(license, stride, shingle) AS (VALUES {_TEMPLATES}),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM documents),
u AS (SELECT doc_id, w, unnest(range(len(w) - 4)) AS p FROM d WHERE len(w) >= 5),
h AS (SELECT doc_id, p, array_to_string(w[p + 1:p + 5], ' ') AS shingle FROM u),
s AS (SELECT doc_id, license, stride, h.shingle, unnest([p // stride - 1, p // stride]) AS win, p FROM h JOIN k ON h.shingle = k.shingle),
c AS (SELECT doc_id, license, stride, win, count(DISTINCT shingle) AS both_have FROM s WHERE win >= 0 AND p + 5 <= (win + 2) * stride GROUP BY ALL),
n AS (SELECT license, count(DISTINCT shingle) AS n FROM k GROUP BY license),
v AS (SELECT doc_id, c.license, win * stride AS word_start, round(both_have / n, 6) AS share FROM c JOIN n ON c.license = n.license WHERE both_have >= 0.8 * n)
SELECT doc_id, license, max(share) AS containment, min(word_start) FILTER (share = top)::BIGINT AS word_start, count(*) AS n_windows
FROM (SELECT *, max(share) OVER (PARTITION BY doc_id, license) AS top FROM v) GROUP BY doc_id, license
"""

_CHAT = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(replace(text, '\', '\\'),
  '(<)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|\|startoftext\|>|s>|/s>|unk>|<SYS>>|</SYS>>)|(\[)(INST\]|/INST\])', '\1\3\\.\2\4', 'g') AS body FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(body) + length(role) + 12 + 1 + 10 + 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

_REPEATS = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
u AS (SELECT doc_id, w, unnest(range(len(w) - 19)) AS p FROM d WHERE len(w) >= 20),
h AS (SELECT doc_id, p, array_to_string(w[p + 1:p + 20], ' ') AS x FROM u),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY x ORDER BY doc_id, p) AS k FROM h),
g AS (SELECT DISTINCT doc_id, p + i AS p FROM r, range(20) s(i) WHERE k > 1),
o AS (SELECT doc_id, list(p) AS gone FROM g GROUP BY doc_id),
q AS (SELECT d.doc_id, len(w) AS n, coalesce(len(gone), 0) AS m, w, gone FROM d LEFT JOIN o ON d.doc_id = o.doc_id),
y AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept FROM (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM d) z
      WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = z.doc_id AND g.p = z.i) GROUP BY doc_id)
SELECT q.doc_id, n::BIGINT AS n_words, m::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM q LEFT JOIN y ON q.doc_id = y.doc_id
"""

_SIMILAR = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [hash(array_to_string(w, ' '))]
        ELSE list_distinct(list_transform(range(len(w) - 3), lambda i: hash(array_to_string(w[i + 1:i + 4], ' ')))) END AS s FROM d),
n AS (SELECT doc_id, len(s) AS n FROM s),
x AS (SELECT doc_id, unnest(s) AS h FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM x a JOIN x b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * both_have >= 85 * (p.n + q.n - both_have)),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.other = l.a)
SELECT n.doc_id, any_value(n.n)::BIGINT AS n_shingles, min(other) AS component_id FROM n JOIN r ON n.doc_id = r.doc_id GROUP BY n.doc_id
"""


_PHRASES = rf"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
p AS (SELECT lang, unnest(ps) AS p FROM t),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM i, range(1, {MOST_WORDS + 1}) r(m) WHERE i + m - 1 <= len(w)),
f AS (SELECT lang, m, g, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, g, f AS a, string_split(g, ' ') AS w FROM f WHERE m > 1 AND f >= {LEAST}),
k AS (SELECT c.*, unnest(range(1, m)) AS k FROM c),
s AS (SELECT k.lang, k.g, k.a, k.k, x.f AS l, y.f AS r, n.n, ((1000::HUGEINT * k.a * n.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
      FROM k JOIN f x ON x.lang = k.lang AND x.g = array_to_string(k.w[1:k.k], ' ') JOIN f y ON y.lang = k.lang AND y.g = array_to_string(k.w[k.k + 1:], ' ') JOIN n ON n.lang = k.lang),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS o FROM s) WHERE o = 1),
q AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND c.g <> b.g AND 100 * c.a >= 100 * b.a AND contains(' ' || c.g || ' ', ' ' || b.g || ' ')))
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank, g AS phrase, a, l, r, n, score FROM q) WHERE rank <= {TOP}
"""


def oracle_sql() -> dict[str, str]:
    """Left to tests: toxicity, decontamination and HTML extraction, which SQL cannot express, and sharding, whose CRC-32 is too slow in SQL."""
    return {
        "op1_chat_format": _CHAT, "op2_source_mixing": _MIX, "op3_exact_dedup": _EXACT, "op4_ngram_join": _SIMILAR,
        "op6_license_scan": _LICENSES, "op9_substring_dedup": _REPEATS, "op12_phrase_collocations": _PHRASES,
    }
