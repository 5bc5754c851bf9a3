"""Queries of the training-data operators and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dialogs, divergence, fingerprints, language, near, packing, passages, pieces, pii, suffixes, tiff, token_counts, token_files
from .common import documents


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_digest(documents(spark, sf_dir))


def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(documents(spark, sf_dir))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_digest(documents(spark, sf_dir))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_groups(documents(spark, sf_dir), shingle=2)


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(documents(spark, sf_dir))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", language.held_out())
    model = language.train(docs.where(~F.col("held_out")))
    return language.predict(docs, model, keep=["doc_id", "held_out"])


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(documents(spark, sf_dir)))


def op10_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.describe(tiff.pages(tiff.store_as_tiff(documents(spark, sf_dir))))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def op12_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(suffixes.repeats(documents(spark, sf_dir)))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogs.digest(dialogs.repair(dialogs.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_packing, op2_token_files, op3_passages, op4_sentencepiece, op5_token_counts, op6_minhash, op7_winnowing, op8_language, op9_pii, op10_tiff_pages, op11_source_divergence, op12_suffix_arrays, op13_conversation_repair)}
#: The other operators take tokenizers, models or spans that SQL cannot express; tests/llm holds them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op6_minhash": r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.c) AS component_id, d.doc_id = min(r.c) AS kept FROM documents d JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id""",
    "op11_source_divergence": r"""WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT k, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY ALL HAVING count(DISTINCT k) >= 10),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d), t AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM c GROUP BY ALL), v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM kept GROUP BY lang),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 2) // (coalesce(t.n, 0) + 2 * v.v) AS p, 1 + 1000000000 * (k.n + 2) // (v.n + 2 * v.v) AS q
  FROM g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN t ON t.lang = g.lang AND t.source = g.source),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM r QUALIFY part = 'pair' OR rank <= 10""",
    "op12_suffix_arrays": r"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), s AS (SELECT k, doc_id, len(h) // 2 AS n, h FROM d),
b AS (SELECT k, doc_id, n, j, substr(h, 400 * j + 1, 498) AS h FROM (SELECT *, unnest(range(n // 200 + 1)) AS j FROM s WHERE n >= 50 AND doc_id IS NOT NULL)),
g AS (SELECT k, doc_id, 200 * j + p AS p, substr(h, 2 * p + 1, 100) AS x FROM (SELECT *, unnest(range(least(200, n - 49 - 200 * j))) AS p FROM b)),
f AS (SELECT x, min(doc_id) AS least FROM g GROUP BY x), r AS (SELECT k, p FROM g JOIN f USING (x) WHERE least < doc_id),
e AS (SELECT k, p, CASE WHEN p <= lag(p) OVER (PARTITION BY k ORDER BY p) + 50 THEN 0 ELSE 1 END AS new FROM r), i AS (SELECT k, p, sum(new) OVER (PARTITION BY k ORDER BY p) AS i FROM e),
j AS (SELECT k, min(p) AS a, max(p) + 50 AS b FROM i GROUP BY k, i), l AS (SELECT k, count(*) AS spans, sum(b - a) AS removed, list(b ORDER BY a) AS b, list(a ORDER BY a) AS a FROM j GROUP BY k)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
sha256(unhex(CASE WHEN a IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(a) + 1), lambda i: substr(h, 2 * CASE WHEN i = 0 THEN 0 ELSE b[i] END + 1, 2 * (CASE WHEN i = len(a) THEN n ELSE a[i + 1] END - CASE WHEN i = 0 THEN 0 ELSE b[i] END))), '') END)) AS kept_sha256 FROM s LEFT JOIN l USING (k)""",
    "op13_conversation_repair": r"""WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
h AS (SELECT *, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(key, ''), lambda c: [unicode(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) % 20 AS kind FROM o),
m AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE kind <> 0),
q AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS before FROM m),
c AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN again > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '' END AS fault FROM q),
n AS (SELECT conv_id, count(*) AS n, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (before IS NOT NULL AND before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM c GROUP BY conv_id),
ins(s, k, s2, more) AS (VALUES (0, 0, 0, ''), (1, 0, 1, ''), (2, 0, 2, ''), (3, 0, 3, ''), (0, 1, 2, 'user:'), (1, 1, 2, 'user:'), (3, 1, 2, 'user:'), (2, 1, 3, 'assistant:'), (0, 2, 3, 'user:' || chr(10) || 'assistant:'), (1, 2, 3, 'user:' || chr(10) || 'assistant:'), (3, 2, 3, 'user:' || chr(10) || 'assistant:'), (2, 2, 2, 'assistant:' || chr(10) || 'user:')),
ed(s, x, edit, s2, price, new) AS (VALUES (0, 's', 'K', 1, 0, ''), (0, 'u', 'K', 2, 0, ''), (1, 'u', 'K', 2, 0, ''), (3, 'u', 'K', 2, 0, ''), (2, 'a', 'K', 3, 0, ''), (0, '*', 'R', 2, 2, 'user'), (1, '*', 'R', 2, 2, 'user'), (3, '*', 'R', 2, 2, 'user'), (2, '*', 'R', 3, 2, 'assistant'), (0, '*', 'D', 0, 3, ''), (1, '*', 'D', 1, 3, ''), (2, '*', 'D', 2, 3, ''), (3, '*', 'D', 3, 3, '')),
z AS (SELECT conv_id, 0 AS i, 0 AS s, 0 AS cost, '' AS audit, '' AS done FROM n
UNION ALL SELECT conv_id, i, s, best[1:8]::INT, best[9:], done FROM (SELECT conv_id, i, s, min(key) AS best, arg_min(done, key) AS done FROM (
  SELECT z.conv_id, z.i + 1 AS i, ed.s2 AS s, lpad((z.cost + 2 * ins.k + ed.price + CASE WHEN c.fault = 't' AND edit <> 'D' THEN 1 ELSE 0 END)::VARCHAR, 8, '0') || z.audit || repeat('I', ins.k) || edit AS key,
  z.done || CASE WHEN more = '' THEN '' ELSE chr(10) || more END || CASE edit WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || c.role || ':' || c.text ELSE chr(10) || new || ':' || c.text END AS done
  FROM z JOIN ins ON ins.s = z.s JOIN c ON c.conv_id IS NOT DISTINCT FROM z.conv_id AND c.i = z.i + 1 JOIN ed ON ed.s = ins.s2 AND (ed.x = '*' OR ed.x = left(c.role, 1)) AND (edit = 'D' OR fault NOT IN ('b', 'd'))) GROUP BY conv_id, i, s)),
a AS (SELECT z.conv_id, min(lpad((z.cost + 2 * k)::VARCHAR, 8, '0') || z.audit || repeat('I', k)) AS best, arg_min(z.done || CASE WHEN more = '' THEN '' ELSE chr(10) || more END, lpad((z.cost + 2 * k)::VARCHAR, 8, '0') || z.audit || repeat('I', k)) AS done
  FROM z JOIN n ON n.conv_id IS NOT DISTINCT FROM z.conv_id AND n.n = z.i JOIN ins ON ins.s = z.s WHERE s2 IN (0, 3) GROUP BY z.conv_id)
SELECT u.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best[1:8]::BIGINT, 0) AS cost, coalesce(best[9:], '') AS audit, sha256(coalesce(done[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM o) u LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM u.conv_id LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM u.conv_id""",
}
