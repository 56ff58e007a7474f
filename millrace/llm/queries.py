"""The queries of this subpackage and, where SQL can express one, the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.bitsliced_topk import exact_top
from millrace.llm.conversation_trie import numbered_turns, prefix_trie, with_shared_heads
from millrace.llm.cotraining import score_documents
from millrace.llm.graph_search import nearest
from millrace.llm.length_histogram import length_table
from millrace.llm.line_windows import drop_repeated_lines
from millrace.llm.mixing import mix_sources
from millrace.llm.packing import pack
from millrace.llm.phrase_mining import mine_phrases
from millrace.llm.secret_crf import find_secrets
from millrace.llm.simhash_groups import near_groups
from millrace.llm.url_filter import judge_urls
from millrace.llm.url_labels import RULES, labelled_urls
from millrace.llm.window_dedup import remove_repeats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            CHECKS[name] = sql
        return fn
    return register


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@_query("op1_length_histogram")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return length_table(_table(spark, folder, "documents"))


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), md5(text), '')) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][1 + CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS INTEGER)] AS weight FROM s),
f AS (
  SELECT *, coalesce(sum(2 * source_size) OVER o, 0) AS filled, coalesce(sum(weight) OVER o, 0) AS weight_before
  FROM w WINDOW o AS (ORDER BY 2 * source_size / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (
  SELECT max(((SELECT sum(source_size) FROM s) * CAST(1.5 AS DOUBLE) - filled)
             / ((SELECT sum(weight) FROM w) - weight_before)) AS level FROM f),
t AS (SELECT source, source_size, least(CAST(2 * source_size AS DOUBLE), (SELECT level FROM l) * weight) AS target FROM f),
p AS (
  SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id NULLS LAST, size
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d),
e AS (
  SELECT p.doc_id, p.source, p.size, t.source_size, t.target, p.k, p.before,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs
  FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, floor(target - epochs * source_size) - before)) AS BIGINT) AS taken,
       k AS "key"
FROM e
"""


@_query("op2_mix_sources", MIX_SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(_table(spark, folder, "documents"))


@_query("op3_exact_topk", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank" FROM s)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 20
""")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return exact_top(_table(spark, folder, "embeddings"))


@_query("op4_graph_search")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(_table(spark, folder, "embeddings"))


@_query("op5_simhash_groups")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return near_groups(_table(spark, folder, "documents"))


@_query("op6_pack_sequences")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return pack(_table(spark, folder, "documents"))


@_query("op7_quality_cotraining")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return score_documents(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


@_query("op8_secret_crf")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return find_secrets(_table(spark, folder, "documents"))


WINDOW_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (
  SELECT doc_id, i AS start, array_to_string(list_slice(words, i, i + 19), ' ') AS body
  FROM d, unnest(range(1, CAST(len(words) AS BIGINT) - 18)) AS u(i)),
r AS (SELECT doc_id, start, row_number() OVER (PARTITION BY body ORDER BY doc_id, start) AS nth FROM w),
g AS (SELECT DISTINCT doc_id, unnest(range(start, start + 20)) AS pos FROM r WHERE nth > 1),
c AS (SELECT doc_id, list(pos) AS gone FROM g GROUP BY doc_id),
k AS (
  SELECT d.doc_id, len(words) AS n_words, coalesce(len(gone), 0) AS n_removed,
         CASE WHEN gone IS NULL THEN words
              ELSE list_transform(list_filter(list_zip(words, range(1, CAST(len(words) AS BIGINT) + 1)),
                                              lambda p: NOT list_contains(gone, p[2])), lambda p: p[1]) END AS kept
  FROM d LEFT JOIN c USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
       sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""


@_query("op9_window_dedup", WINDOW_SQL)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(_table(spark, folder, "documents"))


LINES_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (
  SELECT doc_id, i AS pos, trim(lines[i], ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line
  FROM d, unnest(range(1, CAST(len(lines) AS BIGINT) + 1)) AS u(i)),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS o FROM l WHERE line <> ''),
w AS (
  SELECT doc_id, o, line AS a, lead(line) OVER n AS b, lead(line, 2) OVER n AS c, lead(o, 2) OVER n AS last
  FROM f WINDOW n AS (PARTITION BY doc_id ORDER BY o)),
r AS (SELECT doc_id, o, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, o) AS nth FROM w WHERE last IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest(range(o, o + 3)) AS o FROM r WHERE nth > 1),
e AS (
  SELECT f.doc_id, f.o, CASE WHEN f.o = 1 THEN 1 ELSE f.pos END AS low,
         coalesce(lead(f.pos) OVER (PARTITION BY f.doc_id ORDER BY f.o) - 1, CAST(len(d.lines) AS BIGINT)) AS high,
         g.o IS NOT NULL AS gone
  FROM f JOIN d USING (doc_id) LEFT JOIN g ON g.doc_id = f.doc_id AND g.o = f.o),
k AS (
  SELECT e.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
         string_agg(array_to_string(list_slice(d.lines, e.low, e.high), chr(10)), chr(10) ORDER BY e.o) FILTER (WHERE NOT gone) AS kept
  FROM e JOIN d USING (doc_id) GROUP BY e.doc_id)
SELECT t.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN coalesce(n_removed, 0) > 0 THEN coalesce(kept, '') ELSE coalesce(t.text, '') END) AS kept_sha256
FROM documents t LEFT JOIN k USING (doc_id)
"""


@_query("op10_line_windows", LINES_SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return drop_repeated_lines(_table(spark, folder, "documents").select("doc_id", "text")).select(
        "doc_id", F.col("n_lines").cast("bigint").alias("n_lines"), F.col("n_removed").cast("bigint").alias("n_removed"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


PHRASE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, doc, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
q AS (SELECT lang, row_number() OVER () AS piece, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, piece, unnest(range(1, CAST(len(w) AS BIGINT) + 1)) AS pos, unnest(w) AS a FROM q),
s AS (SELECT lang, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c, lead(a, 3) OVER o AS d, lead(a, 4) OVER o AS e
      FROM t WINDOW o AS (PARTITION BY piece ORDER BY pos)),
g AS (
  SELECT lang, 1 AS size, a AS phrase, count(*) AS f FROM s GROUP BY ALL
  UNION ALL SELECT lang, 2, a || ' ' || b AS phrase, count(*) FROM s WHERE b IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, a || ' ' || b || ' ' || c AS phrase, count(*) FROM s WHERE c IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 4, a || ' ' || b || ' ' || c || ' ' || d AS phrase, count(*) FROM s WHERE d IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 5, a || ' ' || b || ' ' || c || ' ' || d || ' ' || e AS phrase, count(*) FROM s WHERE e IS NOT NULL GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM g WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE size > 1 AND f >= 100),
x AS (
  SELECT lang, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase, max(a) AS a
  FROM c, (SELECT unnest([1, 2, 3, 4]) AS i), (SELECT unnest([2, 3, 4]) AS k) WHERE i + k - 1 <= size AND k < size GROUP BY ALL),
v AS (SELECT c.* FROM c LEFT JOIN x ON x.lang = c.lang AND x.phrase = c.phrase WHERE x.a IS NULL OR 100 * x.a < 100 * c.a),
h AS (SELECT lang, phrase, a, k, array_to_string(list_slice(w, 1, k), ' ') AS head, array_to_string(list_slice(w, k + 1, size), ' ') AS tail
      FROM v, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE k < size),
k AS (
  SELECT h.lang, h.phrase, h.a, k, l.f AS l, r.f AS r, n.n,
         CAST(1000 * CAST(h.a AS HUGEINT) * n.n // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM h JOIN g l ON l.lang = h.lang AND l.phrase = head JOIN g r ON r.lang = h.lang AND r.phrase = tail JOIN n ON n.lang = h.lang),
m AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM k)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS "rank", phrase, CAST(a AS BIGINT) AS a,
       CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, score
FROM m WHERE nth = 1 QUALIFY "rank" <= 2000
"""


@_query("op11_phrase_mining", PHRASE_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return mine_phrases(_table(spark, folder, "documents"))


@_query("op12_url_filter")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(_table(spark, folder, "pages"), labelled_urls(spark), RULES)


TRIE_SQL = r"""
WITH t AS (
  SELECT conv_id, ('0x' || substr(d, 1, 15))::BIGINT AS k1, ('0x' || substr(d, 16, 15))::BIGINT AS k2, turn, role, text
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
               md5(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS d
        FROM conversations WHERE conv_id IS NOT NULL)),
p AS (
  SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k1, k2) AS BIGINT) AS pos, role, text,
         CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS words
  FROM t),
c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
         xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT)),
           lambda crc, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END,
                                      xor(crc, b)), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM p)),
r AS (
  SELECT c.conv_id, 0 AS part, pos, role, text, words FROM c JOIN p ON p.conv_id = c.base AND p.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, pos, role, text, words FROM c JOIN p ON p.conv_id = c.conv_id AND p.pos > c.h),
b AS (SELECT conv_id, CAST(row_number() OVER o AS BIGINT) AS pos, words,
             list(struct_pack(role := role, text := text)) OVER (o ROWS UNBOUNDED PRECEDING) AS path
      FROM r WINDOW o AS (PARTITION BY conv_id ORDER BY part, pos)),
m AS (SELECT conv_id, pos AS depth, words, md5(CAST(path AS VARCHAR)) AS node FROM b
      UNION ALL SELECT conv_id, 0, 0, 'root' FROM c),
l AS (SELECT conv_id, max(depth) AS len FROM m GROUP BY conv_id),
n AS (
  SELECT node, m.depth, min(m.conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words,
         coalesce(string_agg(CAST(m.conv_id AS VARCHAR), ',' ORDER BY m.conv_id) FILTER (WHERE len = m.depth), '') AS ends
  FROM m JOIN l USING (conv_id) GROUP BY node, m.depth),
u AS (SELECT n.*, q.conv_id AS parent_conv_id, q.node AS up
      FROM n LEFT JOIN m ON m.conv_id = n.conv_id AND m.depth = n.depth - 1 LEFT JOIN n q ON q.node = m.node),
k AS (SELECT up AS node, count(*) AS n_children FROM u WHERE up IS NOT NULL GROUP BY up),
v AS (SELECT u.*, coalesce(n_children, 0) AS n_children FROM u LEFT JOIN k USING (node)),
s AS (
  SELECT a.node, sum((v.n_children = 0)::BIGINT) AS n_leaves, sum((v.n_convs - 1) * v.words) AS saved_tokens
  FROM v JOIN m a ON a.conv_id = v.conv_id AND a.depth <= v.depth GROUP BY a.node)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, CAST(n_convs AS BIGINT) AS n_convs, CAST(n_children AS BIGINT) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256
FROM v JOIN s USING (node)
"""


@_query("op13_conversation_trie", TRIE_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie(*with_shared_heads(numbered_turns(_table(spark, folder, "conversations"))))
