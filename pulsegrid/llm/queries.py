"""The registered queries of this subpackage, each its operator with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, context_mixing, embed_dedup, filter_audit, fingerprint, langid, mixing, ngram_join, source_audit, substring, url_filter, warc
from .workspace import Workspace


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Workspace(spark, "warc").path
    warc.write(_table(spark, sf_dir, "pages"), out)
    return warc.read(spark, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digests(chat.read_back(chat.render(chat.reconstruct(chat.as_log(rows)))))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.learn(docs.where(~langid.held_out())))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.9)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove(_table(spark, sf_dir, "documents").select("doc_id", "text"), window=13, keep_text=False)


def op7_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = url_filter.train(url_filter.training_urls(spark))
    return url_filter.judge(_table(spark, sf_dir, "pages"), weights).select("page_id", "host", "path", "rule", "verdict")


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.copies(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(_table(spark, sf_dir, "documents"))


def op12_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    return context_mixing.score(_table(spark, sf_dir, "documents"), ~F.coalesce(held_out, F.lit(False)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


_OP1 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
k AS (SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM k)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND top <> page_id THEN top END AS refers_to
FROM m
"""

_OP2 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss,
         4 + length(regexp_replace(role, '[\\<#:]', 'xx', 'g')) + 2 + length(regexp_replace(text, '[\\<#:]', 'xx', 'g')) + 8 AS chars
  FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(length(loss)) AS BIGINT) AS loss_chars,
       sha256(string_agg(loss, '' ORDER BY turn, role, text)) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

_OP3 = r"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.doc_id),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT t.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id FROM t JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
"""

_OP5 = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r(vec_id, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.vec_id),
m AS (SELECT vec_id, min(c) AS c FROM r GROUP BY vec_id),
k AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT m.vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, m.c AS component_id, m.vec_id = m.c AS kept FROM m LEFT JOIN k ON k.x = m.vec_id
"""

_OP6 = r"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM t WHERE len(w) >= 13),
k AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS h FROM p),
f AS (SELECT h, min(doc_id) AS d FROM k GROUP BY h),
x AS (SELECT DISTINCT k.doc_id, unnest(range(k.i, k.i + 13)) AS i FROM k JOIN f ON k.h = f.h AND f.d < k.doc_id),
a AS (SELECT doc_id, list(i) AS gone FROM x GROUP BY doc_id),
b AS (SELECT t.doc_id, t.w, coalesce(a.gone, []) AS gone FROM t LEFT JOIN a USING (doc_id))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_filter(w, lambda v, i: NOT list_contains(gone, i)), ' ')) AS kept_sha256
FROM b
"""

_OP10 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS BIGINT) AS size
  FROM documents),
k AS (
  SELECT *, length(CAST(size AS VARCHAR)) * 10 + CAST(substr(CAST(size AS VARCHAR), 1, 1) AS INT) AS cls,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % (SELECT greatest(16, CAST(ceil(sqrt(count(*)) / 4) AS BIGINT)) FROM documents) AS part
  FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY cls, part, size, doc_id) AS rk FROM k),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS wt,
         source_size * 2.0::DOUBLE AS top
  FROM s),
l AS (
  SELECT *, row_number() OVER (ORDER BY top / wt, source NULLS LAST) AS o,
         ((SELECT sum(source_size) FROM w) * 1.5::DOUBLE - coalesce(sum(top) OVER (ORDER BY top / wt, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(wt) OVER (ORDER BY top / wt, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv
  FROM w),
f AS (SELECT min(o) AS o FROM l WHERE lv * wt < top),
g AS (SELECT l.source, l.source_size, CASE WHEN l.o >= f.o THEN least(l.top, (SELECT lv FROM l AS m WHERE m.o = f.o) * l.wt) ELSE l.top END AS target FROM l, f),
x AS (
  SELECT r.doc_id, r.size, g.source_size, g.target, r.rk,
         CASE WHEN g.source_size = 0 THEN 0.0::DOUBLE ELSE g.target / CAST(g.source_size AS DOUBLE) END AS rate,
         CAST('0x' || substr(md5('mix|' || coalesce(r.source, '') || '|' || CASE WHEN r.source IS NULL THEN 'true' ELSE 'false' END), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS off
  FROM r JOIN g ON r.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(floor(off + rate * rk) - floor(off + rate * (rk - 1)) AS BIGINT) * size AS taken FROM x
"""

_OP11 = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
x AS (SELECT id, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM x GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
l AS (SELECT lang, sum(total) AS total, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM x GROUP BY ALL),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.total FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS size FROM f),
p AS (
  SELECT s.lang, s.source, term, n, 1 + (CAST(1000000000 AS HUGEINT) * (n + 5)) // CAST(size + 5 * v AS HUGEINT) AS p,
         1 + (CAST(1000000000 AS HUGEINT) * (s.total + 5)) // CAST(l.total + 5 * v AS HUGEINT) AS q
  FROM s JOIN l USING (lang)),
m AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(m.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN m ON m.lang = a.lang AND m.source = a.source AND m.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 50
"""

_OP12 = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
f AS (
  SELECT w.doc_id, part, len(ws) < 50 AS a, 100 * len(list_distinct(ws)) < 65 * len(ws) AS b,
         100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
         coalesce(w.doc_id > least, false) AS e, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic
  FROM w LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id) l ON l.doc_id = w.doc_id),
x AS (SELECT doc_id, part, good, toxic, unnest(['A', 'B', 'C', 'D', 'E']) AS name, unnest([a, b, c, d, e]) AS fails FROM f),
y AS (SELECT part, good, toxic, list_sort(coalesce(list(name) FILTER (WHERE fails), [])) AS names FROM x GROUP BY doc_id, part, good, toxic),
n AS (SELECT part, names, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM y GROUP BY part, names),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM l a, l b, l c, l d, l e
  WHERE a.c NOT IN (b.c, c.c, d.c, e.c) AND b.c NOT IN (c.c, d.c, e.c) AND c.c NOT IN (d.c, e.c) AND d.c <> e.c),
s AS (SELECT filter_order, step, filter_order[step] AS own, string_split(filter_order[1:step - 1], '') AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (
  SELECT part, filter_order, step, own,
         sum(n) FILTER (WHERE NOT list_has_any(names, before) AND NOT list_contains(names, own)) AS kept,
         sum(n) FILTER (WHERE NOT list_has_any(names, before) AND list_contains(names, own)) AS removed,
         sum(n) FILTER (WHERE list_has_any(names, before) AND list_contains(names, own)) AS redundant,
         sum(n) FILTER (WHERE names = [own]) AS unique_fails,
         sum(good) FILTER (WHERE NOT list_has_any(names, before) AND list_contains(names, own)) AS good_lost,
         sum(toxic) FILTER (WHERE NOT list_has_any(names, before) AND list_contains(names, own)) AS toxic_lost
  FROM n, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
       CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
       CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": _OP1, "op2_chat_formatting": _OP2, "op3_ngram_jaccard_join": _OP3, "op5_embedding_near_dedup": _OP5, "op6_substring_dedup": _OP6, "op10_mixing": _OP10, "op11_source_divergence": _OP11, "op12_filter_interaction": _OP12}
