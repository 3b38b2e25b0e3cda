"""Registered queries over the documents, embeddings and labels tables, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbweave.llm import (bytebpe, chosenpath, exact, langid, linetemplates, lm, neighbours, packing, phrases, repeats, tokenfiles,
                          toxicity, whitening)
from orbweave.llm.common import fold

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn
    return add


def _table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@_query("op1_lm_scoring")
def _(spark, sf_dir):
    held_out = fold(F.col("doc_id")) == 1
    return lm.lm_scores(_table(spark, sf_dir, "documents"), ~F.coalesce(held_out, F.lit(False)), "doc_id", "text").select(
        "doc_id", (~F.col("learned_from")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@_query("op2_byte_bpe")
def _(spark, sf_dir):
    import public_tokenizers
    return bytebpe.encode_digests(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_multi_50k.tiktoken"),
                                  public_tokenizers.PATTERN, "doc_id", "text")


@_query("op3_line_dedup", r"""
WITH l AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS pos, unnest(x) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)),
x AS (SELECT doc_id, pos, trim(regexp_replace(line, '\s+', ' ', 'g')) AS plain,
    trim(regexp_replace(regexp_replace(line, '\S*[0-9]\S*', '<*>', 'g'), '\s+', ' ', 'g')) AS masked
  FROM l WHERE regexp_matches(line, '\S')),
t AS (SELECT doc_id, pos, string_split(CASE WHEN regexp_full_match(masked, '<\*>( <\*>){0,3}') THEN plain ELSE masked END, ' ') AS k FROM x),
n AS (SELECT *, len(k) AS n, CAST(floor((len(k) - 2) / 4) AS BIGINT) AS s FROM t),
p AS (SELECT *, concat_ws(chr(1), n, k[1], k[2]) AS lead, array_to_string(k[3:n], chr(1)) AS rest,
    [array_to_string(k[3 : 2 + s], chr(1)), array_to_string(k[3 + s : 2 + 2 * s], chr(1)),
     array_to_string(k[3 + 2 * s : 2 + 3 * s], chr(1)), array_to_string(k[3 + 3 * s : n], chr(1))] AS q FROM n),
v AS (SELECT doc_id, pos, concat_ws(chr(2), '-1', lead, rest) AS template FROM p
  UNION ALL SELECT doc_id, pos, concat_ws(chr(2), i, lead, array_to_string(
    list_concat(q[1 : i - 1], [''], q[i + 1 : 4]), chr(3))) FROM p, (SELECT unnest([1, 2, 3, 4]) AS i) WHERE n >= 12),
f AS (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY template) AS first FROM v),
d AS (SELECT DISTINCT doc_id, pos FROM f WHERE first < doc_id),
o AS (SELECT l.doc_id, count(*) AS n_lines, count(d.pos) AS n_dropped,
    coalesce(string_agg(line, chr(10) ORDER BY l.pos) FILTER (WHERE d.pos IS NULL), '') AS kept
  FROM l LEFT JOIN d ON d.doc_id = l.doc_id AND d.pos = l.pos GROUP BY l.doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, sha256(coalesce(kept, '')) AS text_sha256
FROM documents LEFT JOIN o USING (doc_id)
""")
def _(spark, sf_dir):
    kept = linetemplates.drop_recurring_lines(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@_query("op4_language_id")
def _(spark, sf_dir):
    held_out = fold(F.col("doc_id")) == 0
    found = langid.languages(_table(spark, sf_dir, "documents"), ~F.coalesce(held_out, F.lit(False)), "lang", "doc_id", "text")
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


@_query("op5_nearest_neighbours", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS m FROM v
  WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS query_id, b.vec_id,
    list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])) / (a.m * b.m) AS score
  FROM u a JOIN u b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM p QUALIFY rank <= 5
""")
def _(spark, sf_dir):
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, "vec_id", "embedding", 5)


@_query("op6_best_fit_packing")
def _(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), "doc_id", "text", 4096)


@_query("op7_token_files")
def _(spark, sf_dir):
    return tokenfiles.token_files(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), "doc_id", "text")


@_query("op8_exact_dedup", """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
  sha256(t) AS text_sha256 FROM t WINDOW w AS (PARTITION BY t)
""")
def _(spark, sf_dir):
    seen_before = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0       # one half is the history
    return exact.exact_duplicates(_table(spark, sf_dir, "documents"), seen_before, "doc_id", "text").select(
        "doc_id", F.col("keep_key").alias("keep_id"), "group_size", "kept", "text_sha256")


@_query("op9_ngram_jaccard", r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
    lambda x: x <> '') AS t FROM documents),
c AS MATERIALIZED (SELECT array_to_string(t, ' ') AS k, min(doc_id) AS rep, count(*) AS copies, any_value(t) AS t
  FROM w GROUP BY 1),
s AS MATERIALIZED (SELECT DISTINCT rep, array_to_string(t[i : least(i + 4, len(t))], ' ') AS g
  FROM c, unnest(range(1, 1 + greatest(len(t) - 4, least(len(t), 1)))) AS u(i)),
z AS (SELECT rep, count(*) AS n FROM s GROUP BY rep),
p AS MATERIALIZED (SELECT a.rep AS x, b.rep AS y FROM s a JOIN s b ON a.g = b.g AND a.rep <> b.rep
  JOIN z za ON za.rep = a.rep JOIN z zb ON zb.rep = b.rep GROUP BY a.rep, b.rep, za.n, zb.n
  HAVING count(*) * 5 >= 4 * (za.n + zb.n - count(*))),
r(a, b) AS (SELECT rep, rep FROM c UNION SELECT r.a, p.y FROM r JOIN p ON p.x = r.b),
m AS (SELECT a AS rep, min(b) AS class_id FROM r GROUP BY a),
l AS (SELECT x AS rep, count(*) AS n_links FROM p GROUP BY x)
SELECT w.doc_id, m.class_id, coalesce(l.n_links, 0) AS n_links, c.copies
FROM w JOIN c ON c.k = array_to_string(w.t, ' ') JOIN m ON m.rep = c.rep LEFT JOIN l ON l.rep = c.rep
""")
def _(spark, sf_dir):
    return chosenpath.similarity_classes(_table(spark, sf_dir, "documents"), "doc_id", "text")


@_query("op10_toxicity")
def _(spark, sf_dir):
    scored = toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"),
                               lambda key: F.coalesce(fold(key) != 0, F.lit(False)), "toxic", "doc_id", "text")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


@_query("op11_repeats", """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, c, substr(h, 2000 * c + 1, 2098) AS h FROM d, unnest(range(0, greatest(0, len(h) // 2 - 50) // 1000 + 1)) AS u(c)),
g AS (SELECT doc_id, 1000 * c + i AS z, substr(h, 2 * i + 1, 100) AS w FROM c, unnest(range(0, least(1000, len(h) // 2 - 49))) AS u(i)),
m AS (SELECT doc_id, z FROM g QUALIFY min(doc_id) OVER (PARTITION BY w) < doc_id),
s AS (SELECT doc_id, z, CASE WHEN z > lag(z) OVER w + 50 OR lag(z) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM m
  WINDOW w AS (PARTITION BY doc_id ORDER BY z)),
n AS (SELECT doc_id, z, sum(fresh) OVER (PARTITION BY doc_id ORDER BY z) AS k FROM s),
r AS (SELECT doc_id, k, min(z) AS a, max(z) + 50 AS b FROM n GROUP BY ALL),
p AS (SELECT doc_id, k, a, b, coalesce(lag(b) OVER w, 0) AS before, lead(a) OVER w IS NULL AS last FROM r
  WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
o AS (SELECT doc_id, count(*) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_removed,
    string_agg(substr(h, 2 * before + 1, 2 * (a - before)) || CASE WHEN last THEN substr(h, 2 * b + 1) ELSE '' END, '' ORDER BY k) AS kept
  FROM p JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN o USING (doc_id)
""")
def _(spark, sf_dir):
    kept = repeats.drop_repeats(_table(spark, sf_dir, "documents"), "doc_id", "text", 50)
    return kept.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@_query("op12_phrases", r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
  FROM documents),
w AS MATERIALIZED (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM t),
z AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS MATERIALIZED (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f
  FROM w, (SELECT unnest([1, 2, 3, 4]) AS k), unnest(range(1, len(w) - k + 2)) AS u(i) GROUP BY ALL),
c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS q FROM g WHERE k > 1 AND f >= 30),
x AS (SELECT c.lang, c.phrase, c.f AS a, i, gl.f AS l, gr.f AS r,
    CAST(CAST(c.f AS HUGEINT) * 2000000 // (gl.f + gr.f) AS BIGINT) AS score
  FROM c, unnest(range(1, k)) AS u(i)
  JOIN g gl ON gl.lang = c.lang AND gl.phrase = array_to_string(q[1 : i], ' ')
  JOIN g gr ON gr.lang = c.lang AND gr.phrase = array_to_string(q[i + 1 : ], ' ')),
m AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
s AS (SELECT lang, array_to_string(q[i : i + n - 1], ' ') AS phrase, max(f) AS longer
  FROM c, (SELECT unnest([2, 3]) AS n), unnest(range(1, k - n + 2)) AS u(i) WHERE n < k GROUP BY ALL)
SELECT m.lang, row_number() OVER (PARTITION BY m.lang ORDER BY score DESC, a DESC, encode(m.phrase)) AS rank, m.phrase, a, l, r, z.n, score
FROM m JOIN z ON z.lang = m.lang LEFT JOIN s ON s.lang = m.lang AND s.phrase = m.phrase
WHERE longer IS NULL OR 100 * longer < 80 * a QUALIFY rank <= 2000
""")
def _(spark, sf_dir):
    return phrases.collocations(_table(spark, sf_dir, "documents"), "lang", "text", 30, 2000)


@_query("op13_whitening")
def _(spark, sf_dir):
    return whitening.whiten(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 32)
