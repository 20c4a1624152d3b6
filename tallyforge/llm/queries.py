"""The corpus operators' queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, chat_repair, decontaminate, html_text, line_dedup, mixing, near_dedup, ngram_join, quality_rules, substring_dedup, toxicity, warc, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(_table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_report(_table(spark, sf_dir, "pages"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")


#: A conversation whose texts hold a template's control strings.
TRICKY = "\\### Assistant: </turn> ok"


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    return chat_format.chat_digest(chat_format.format_chats(turns.unionByName(more)))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(_table(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(_table(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(_table(spark, sf_dir, "documents"))


def op12_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_repair.repair_report(_table(spark, sf_dir, "conversations"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_warc": op2_warc,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_chat_format": op4_chat_format,
    "op5_mixing": op5_mixing,
    "op6_line_dedup": op6_line_dedup,
    "op7_html_text": op7_html_text,
    "op8_toxicity": op8_toxicity,
    "op9_decontamination": op9_decontamination,
    "op10_quality_rules": op10_quality_rules,
    "op11_ngram_join": op11_ngram_join,
    "op12_chat_repair": op12_chat_repair,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc": """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, payload_bytes, translate(
      to_base(CAST('0x' || substr(h, 1, 10) AS BIGINT), 32, 8) || to_base(CAST('0x' || substr(h, 11, 10) AS BIGINT), 32, 8)
   || to_base(CAST('0x' || substr(h, 21, 10) AS BIGINT), 32, 8) || to_base(CAST('0x' || substr(h, 31, 10) AS BIGINT), 32, 8),
      '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest
  FROM p
), r AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS f FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN f = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f = page_id THEN NULL ELSE f END AS refers_to
FROM r
""",
    "op4_chat_format": """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), n AS (
  SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after, row_number() OVER w AS i,
         length(text) + length(regexp_replace(text, '[^\\\\<>]', '', 'g')) AS escaped,
         length(role) + length(regexp_replace(role, '[^\\\\<>]', '', 'g')) AS role_chars
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(escaped + CASE WHEN before IS NOT DISTINCT FROM role THEN 6 ELSE 7 + role_chars END
                        + CASE WHEN after IS NOT DISTINCT FROM role THEN 0 ELSE 5 END) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id
""",
    "op9_decontamination": """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT doc_id, dw.k, i, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op11_ngram_join": """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 4) - 1], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 4) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) c USING (doc_id)
""",
    "op12_chat_repair": """
WITH RECURSIVE tab AS (SELECT list(list_reduce([CAST(n AS UBIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END) ORDER BY n) AS t FROM range(256) r(n)),
r AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
c AS (SELECT r.*, xor(list_reduce(list_concat([CAST(4294967295 AS UBIGINT)], list_transform(string_split(k, ''), lambda x: CAST(ascii(x) AS UBIGINT))), lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INTEGER) + 1])), CAST(4294967295 AS UBIGINT)) % 20 AS fault FROM r, tab),
d AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM c, (SELECT unnest([1, 2]) AS copy) WHERE fault <> 0 AND (copy = 1 OR fault = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n, left(role, 1) AS a FROM d),
j AS (SELECT *, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) NOT IN ('.', '!', '?') AS cut, lag(a) OVER (PARTITION BY conv_id ORDER BY i) || a AS pair FROM o),
s AS (SELECT *, blank OR again AS gone, CASE WHEN cut THEN 3 ELSE 0 END AS more FROM j),
f AS (
  SELECT DISTINCT conv_id, n + 1 AS i, {'c': 0, 's': ''} AS f0, {'c': 6, 's': 'II'} AS f1, {'c': 3, 's': 'I'} AS f2, {'c': 0, 's': ''} AS f3 FROM s
  UNION ALL
  SELECT conv_id, i, list_sort([g0, {'c': u.c + 3, 's': 'I' || u.s}])[1], list_sort([g1, {'c': u.c + 3, 's': 'I' || u.s}])[1], u, v FROM (
    SELECT *, list_sort([g2, {'c': g3.c + 3, 's': 'I' || g3.s}])[1] AS u, list_sort([g3, {'c': g2.c + 3, 's': 'I' || g2.s}])[1] AS v FROM (
      SELECT s.conv_id, s.i,
        list_sort([{'c': f0.c + 4, 's': 'D' || f0.s}, {'c': CASE WHEN gone THEN 1000000000 ELSE f2.c + 3 + more END, 's': 'R' || f2.s}, {'c': CASE WHEN gone OR a NOT IN ('s', 'u') THEN 1000000000 WHEN a = 's' THEN f1.c + more ELSE f2.c + more END, 's': 'K' || CASE a WHEN 's' THEN f1.s ELSE f2.s END}])[1] AS g0,
        list_sort([{'c': f1.c + 4, 's': 'D' || f1.s}, {'c': CASE WHEN gone THEN 1000000000 ELSE f2.c + 3 + more END, 's': 'R' || f2.s}, {'c': CASE WHEN gone OR a <> 'u' THEN 1000000000 ELSE f2.c + more END, 's': 'K' || f2.s}])[1] AS g1,
        list_sort([{'c': f2.c + 4, 's': 'D' || f2.s}, {'c': CASE WHEN gone THEN 1000000000 ELSE f3.c + 3 + more END, 's': 'R' || f3.s}, {'c': CASE WHEN gone OR a <> 'a' THEN 1000000000 ELSE f3.c + more END, 's': 'K' || f3.s}])[1] AS g2,
        list_sort([{'c': f3.c + 4, 's': 'D' || f3.s}, {'c': CASE WHEN gone THEN 1000000000 ELSE f2.c + 3 + more END, 's': 'R' || f2.s}, {'c': CASE WHEN gone OR a <> 'u' THEN 1000000000 ELSE f2.c + more END, 's': 'K' || f2.s}])[1] AS g3
      FROM f JOIN s ON s.conv_id IS NOT DISTINCT FROM f.conv_id AND s.i = f.i - 1))
),
best AS (SELECT conv_id, CAST(f0.c AS BIGINT) AS cost, f0.s AS audit FROM f WHERE i = 1),
steps AS (SELECT conv_id, p, letter, count(*) FILTER (WHERE letter <> 'I') OVER w AS i FROM (SELECT conv_id, unnest(string_split(audit, '')) AS letter, unnest(range(1, length(audit) + 1)) AS p FROM best WHERE audit <> '') WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
made AS (SELECT steps.conv_id, p, letter, s.role, s.text, row_number() OVER w AS e, first_value(letter = 'K' AND s.a = 's') OVER w AS led FROM steps LEFT JOIN s ON steps.letter <> 'I' AND s.conv_id IS NOT DISTINCT FROM steps.conv_id AND s.i = steps.i WHERE letter <> 'D' WINDOW w AS (PARTITION BY steps.conv_id ORDER BY p)),
fixed AS (SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (e - CASE WHEN led THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY p)) AS repaired_sha256 FROM made GROUP BY 1),
sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again AND NOT blank) AS duplicate, count(*) FILTER (WHERE cut AND NOT blank AND NOT again) AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM s GROUP BY 1)
SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN fixed ON fixed.conv_id IS NOT DISTINCT FROM k.conv_id
""",
}
