"""The registered queries of the operators, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spellaudit.llm import bpe, brown, chat, decontaminate, lines, media, near_dups, negatives, passages, periodic, quality, repeats, sharding
from spellaudit.llm.common import table

#: Places for rows of op8.
SHARDS = [f"shard-{i:03d}" for i in range(64)]
RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(table(spark, sf_dir, "documents"))


SQL_op1_line_dedup = f"""
WITH e AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS place, unnest(string_split(text, chr(10))) AS raw
  FROM documents WHERE text IS NOT NULL),
l AS (SELECT *, CASE WHEN length(trim(raw, ' ' || chr(9) || chr(13))) >= {lines.MIN_CHARS} THEN trim(raw, ' ' || chr(9) || chr(13)) END AS line FROM e),
d AS (SELECT line, length(line) AS n, min({{'d': doc_id, 'p': place}}) AS f FROM l WHERE line IS NOT NULL GROUP BY line),
near AS (
  SELECT DISTINCT b.line FROM d a JOIN d b ON a.n BETWEEN b.n - 1 AND b.n + 1 AND a.f < b.f
  AND (left(a.line, a.n // 2 - 1) = left(b.line, a.n // 2 - 1) OR right(a.line, a.n // 2 - 1) = right(b.line, a.n // 2 - 1))
  AND levenshtein(a.line, b.line) <= 1),
m AS (SELECT l.*, l.line IS NOT NULL AND (near.line IS NOT NULL OR {{'d': doc_id, 'p': place}} > d.f) AS gone
  FROM l LEFT JOIN d ON l.line = d.line LEFT JOIN near ON l.line = near.line)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(raw, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, sha256('') FROM documents WHERE text IS NULL
"""


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.scores(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL_op6_decontamination = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item, array_to_string(w[k : k + 12], ' ') AS text, least(len(w), 13) AS n FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS text FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM d JOIN sizes ON n <= len(w))),
found AS (SELECT doc_id, k, n, item FROM places JOIN windows USING (text, n)),
hits AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS at FROM found) GROUP BY doc_id),
listed AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN listed USING (doc_id)
"""


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = chat.calls_of_turns(table(spark, sf_dir, "conversations"))
    return chat.link_calls(calls, results, chat.SCHEMAS)


#: Every call of the conversations has all fields, so that its name decides whether it is valid.
SQL_op7_chat_formatting = """
WITH RECURSIVE one AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY role NULLS FIRST, text NULLS FIRST) = 1),
asked AS (SELECT * FROM one WHERE role <> 'assistant'),
linked AS (SELECT a.*, CASE WHEN b.turn IS NOT NULL THEN b.turn ELSE c.turn END AS after FROM asked a LEFT JOIN asked b ON a.conv_id = b.conv_id AND b.turn = a.turn - 2 LEFT JOIN asked c ON a.conv_id = c.conv_id AND c.turn = a.turn - 1),
ranks AS (SELECT conv_id, turn, 0 AS rank FROM linked WHERE after IS NULL UNION ALL SELECT l.conv_id, l.turn, rank + 1 FROM ranks JOIN linked l ON l.conv_id = ranks.conv_id AND l.after = ranks.turn)
SELECT l.conv_id, 'call-' || l.turn AS call_id, CAST(rank AS BIGINT) AS rank, r.turn IS NOT NULL AS linked, l.role IN ('user', 'system') AS valid,
  '{"after":' || coalesce('"call-' || after || '"', 'null') || ',"arguments":{"query":' || to_json(l.text) || ',"turn":' || l.turn || ',"words":' || len(regexp_split_to_array(trim(l.text, ' '), '[ \\t\\n\\v\\f\\r]+'))
  || '},"id":"call-' || l.turn || '","name":' || to_json(l.role) || ',"rank":' || rank || ',"result":' || coalesce(CAST(to_json(r.text) AS VARCHAR), 'null') || ',"valid":' || (l.role IN ('user', 'system')) || '}' AS record
FROM linked l JOIN ranks USING (conv_id, turn) LEFT JOIN one r ON r.conv_id = l.conv_id AND r.turn = l.turn + 1 AND r.role = 'assistant'
"""


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sharding.assign(docs.select("doc_id", "source"), ["source", "doc_id"], SHARDS)


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


#: Bytes as two hexadecimal digits each; windows of 400 bytes told by MD5.
SQL_op9_suffix_array_dedup = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, p, substr(h, 800 * p + 1, 1598) AS h FROM (SELECT *, unnest(range(0, length(h) // 800)) AS p FROM d)),
w AS (SELECT doc_id, 400 * p + j AS k, md5(substr(h, 2 * j + 1, 800)) AS m FROM (SELECT *, unnest(range(0, length(h) // 2 - 399)) AS j FROM p)),
r AS (SELECT doc_id, k FROM w JOIN (SELECT m FROM w GROUP BY m HAVING count(*) > 1) USING (m)),
g AS (SELECT *, CASE WHEN k - 400 <= coalesce(lag(k) OVER (PARTITION BY doc_id ORDER BY k), -500) THEN 0 ELSE 1 END AS new FROM r),
s AS (SELECT doc_id, min(k) AS a, max(k) + 400 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY k) AS span FROM g) GROUP BY doc_id, span),
c AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM s),
t AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM c JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""

SQL_op10_minhash_near_dedup = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[k : k + 4], ' ')) AS x FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
sets AS (SELECT doc_id, md5(string_agg(x, '' ORDER BY x)) AS whole FROM s GROUP BY doc_id),
leads AS (SELECT whole, min(doc_id) AS lead FROM sets GROUP BY whole),
o AS (SELECT s.* FROM s JOIN leads ON lead = doc_id),
links AS (SELECT a, b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS common FROM o p JOIN o q ON p.x = q.x AND p.doc_id <> q.doc_id GROUP BY ALL) JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 85 * (na.n + nb.n - common)),
reach AS (SELECT lead AS a, lead AS b FROM leads UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
c AS (SELECT doc_id, (SELECT min(b) FROM reach WHERE a = lead) AS component FROM sets JOIN leads USING (whole))
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id, d.doc_id = coalesce(component, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.doc_id = d.doc_id
"""


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_report(table(spark, sf_dir, "documents"), order=periodic.looped_tail)


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.remove_passages(table(spark, sf_dir, "documents"))


#: Windows of 50 words told by MD5.
SQL_op12_substring_dedup = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, k, md5(array_to_string(w[k : k + 49], ' ')) AS m FROM (SELECT *, unnest(range(1, len(w) - 48)) AS k FROM d)),
hits AS (SELECT doc_id, k FROM p JOIN (SELECT m, min(doc_id) AS lo FROM p GROUP BY m) USING (m) WHERE lo < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS i FROM hits),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the ids that 100 divides; ids that 7 divides have the next label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", label))


SQL_op13_hard_negatives = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {k[4:]: v for k, v in globals().items() if k.startswith("SQL_op")}
