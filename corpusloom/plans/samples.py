"""Queries of allocation, sampling, chunks and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedup, sample
from .tables import CORPUS_SQL, corpus, table

CELLS = ["register", "text_type"]



def stratified_allocation(spark, sf_dir):
    return sample.allocate(table(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"], 777)


def stratified_sample_hash(spark, sf_dir):
    return sample.stratified_sample(corpus(spark, sf_dir).select("id", *CELLS), CELLS, 100)


def label_subset(spark, sf_dir):
    return sample.stratified_sample(corpus(spark, sf_dir).select("id", *CELLS, "source_name"), [*CELLS, "source_name"], 150, 7).select("id")


def minority_swap_sample(spark, sf_dir):
    rows = corpus(spark, sf_dir).select("id", "source_name", F.when(F.col("id") % 9 == 0, "other").otherwise("target").alias("verdict"))
    return sample.with_minority(rows, sample.stratified_sample(rows, ["source_name"], 100), F.col("verdict") == "other", 30)


def calibration_strata(spark, sf_dir):
    rows = corpus(spark, sf_dir).select("id", "register", "text_type", F.length("cleaned_text").alias("n"))
    strata = [("verse", F.col("text_type") == "verse"), ("news", F.col("register") == "news"), ("other", F.col("register").isin("literary", "opinion"))]
    return sample.calibration_sets(rows, strata, 20, F.col("n").between(400, 2000)).select("id", "stratum")


def _chunks(spark, sf_dir):
    return sample.chunks(corpus(spark, sf_dir).select("id", *CELLS), CELLS, 9)


def chunk_assignment(spark, sf_dir):
    return _chunks(spark, sf_dir).select("id", "chunk")


def chunk_partition_proof(spark, sf_dir):
    return dedup.partition_proof(_chunks(spark, sf_dir), corpus(spark, sf_dir))


def chunk_tolerance(spark, sf_dir):
    return sample.chunk_tolerance(_chunks(spark, sf_dir), CELLS)


def category_quota(spark, sf_dir):
    return sample.quota(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", 7, ["doc_id"])


def _entropy(spark, sf_dir):
    return corpus(spark, sf_dir).select("id", *CELLS, ((F.col("id") * 7919 % 1009) / 1009.0).alias("entropy"))


def _routing(name):
    def query(spark, sf_dir):
        return sample.routing_sets(_entropy(spark, sf_dir), CELLS, 60, 30, 20, 15)[name].select("id")

    query.__name__ = f"routing_{name}"
    return query


routing_routed, routing_control, routing_random, routing_reliability = map(_routing, ("routed", "control", "random", "reliability"))


def routing_disjoint(spark, sf_dir):
    """Counts of overlaps, all zero but the part of reliability outside routed, zero as well."""
    s = sample.routing_sets(_entropy(spark, sf_dir), CELLS, 60, 30, 20, 15)
    tagged = None
    for name, rows in s.items():
        own = rows.select("id", F.lit(name).alias("name"))
        tagged = own if tagged is None else tagged.union(own)
    per = tagged.groupBy("id").agg(F.count_if(F.col("name") != "reliability").alias("sets"), F.max((F.col("name") == "routed").cast("int")).alias("routed"), F.max((F.col("name") == "reliability").cast("int")).alias("reliability"))
    return per.agg(F.count_if(F.col("sets") > 1).alias("overlapping"), F.count_if((F.col("reliability") == 1) & (F.col("routed") == 0)).alias("outside"))


def routing_frontier(spark, sf_dir):
    """Items routed and entropy covered at each of twenty thresholds: one aggregation, then sums over few rows."""
    e = _entropy(spark, sf_dir).select(F.floor(F.col("entropy") * 20).cast("long").alias("tau20"), "entropy")
    bins = e.groupBy("tau20").agg(F.count("*").alias("n"), F.sum("entropy").alias("s"))
    from pyspark.sql import Window

    above = Window.orderBy(F.desc("tau20")).rowsBetween(Window.unboundedPreceding, 0)
    return bins.select("tau20", F.sum("n").over(above).alias("n_routed"), F.round(F.sum("s").over(above), 6).alias("covered"))


def blinded_sheet(spark, sf_dir):
    c = corpus(spark, sf_dir).withColumn("script", F.lit("latin")).withColumn("judge_confidence", F.lit(1.0))
    out = sample.blinded_sheet(sample.uniform(c, 50))
    return out.select("id", F.md5("raw_text").alias("raw_md5"), F.md5("cleaned_text").alias("clean_md5"), "source_name", "register", "text_type", "script", "human_label")


def _alloc_sql(cells: str, target: int, rows: str, tie: str) -> str:
    return f"""SELECT {cells}, n, base + CASE WHEN row_number() OVER (ORDER BY round(exact - base, 9) DESC, {tie}) <= rest THEN 1 ELSE 0 END AS alloc FROM (
SELECT *, least(total, {target}) - sum(base) OVER () AS rest FROM (SELECT *, floor(exact)::BIGINT AS base FROM (SELECT {cells}, count(*)::BIGINT AS n, sum(count(*)) OVER ()::BIGINT AS total, count(*)::DOUBLE * least(sum(count(*)) OVER (), {target}) / sum(count(*)) OVER () AS exact FROM {rows} GROUP BY {cells})))"""


def _sample_sql(cells: str, target: int, rows: str, seed: int = 42, key: str = "id") -> str:
    on = " AND ".join(f"r.{c.strip()} = a.{c.strip()}" for c in cells.split(","))
    return f"SELECT r.* FROM (SELECT *, row_number() OVER (PARTITION BY {cells} ORDER BY md5({key} || ':{seed}'), {key}) AS rn FROM {rows}) r JOIN ({_alloc_sql(cells, target, rows, cells)}) a ON {on} WHERE rn <= alloc"


_ROUTE = f"""WITH {CORPUS_SQL}, e AS (SELECT id, register, text_type, (id * 7919 % 1009) / 1009.0::DOUBLE AS entropy FROM corpus),
ra AS ({_alloc_sql("register, text_type", 60, "e", "md5(register || '|' || text_type || ':42'), register, text_type")}),
ca AS ({_alloc_sql("register, text_type", 30, "e", "md5(register || '|' || text_type || ':42'), register, text_type")}),
routed AS (SELECT id FROM (SELECT e.*, row_number() OVER (PARTITION BY register, text_type ORDER BY entropy DESC, id) AS rn FROM e) x JOIN ra USING (register, text_type) WHERE rn <= alloc),
rest AS (SELECT * FROM e WHERE id NOT IN (SELECT id FROM routed)),
control AS (SELECT id FROM (SELECT rest.*, row_number() OVER (PARTITION BY register, text_type ORDER BY entropy, id) AS rn FROM rest) x JOIN ca USING (register, text_type) WHERE rn <= alloc),
random AS (SELECT id FROM rest WHERE id NOT IN (SELECT id FROM control) ORDER BY md5(id || ':42'), id LIMIT 20),
reliability AS (SELECT id FROM routed ORDER BY md5(id || ':42'), id LIMIT 15)"""
_CHUNKS = f"""WITH {CORPUS_SQL}, ch AS (SELECT id, register, text_type, (((row_number() OVER (PARTITION BY register, text_type ORDER BY md5(id || ':42'), id) - 1)
 + ('0x' || substr(md5(register || '|' || text_type || ':42'), 1, 6))::BIGINT) % 9 + 1)::BIGINT AS chunk FROM corpus)"""
_LONG = "SELECT chunk, 'register' AS field, register AS value FROM ch UNION ALL SELECT chunk, 'text_type', text_type FROM ch"

ORACLE = {
    "stratified_allocation": _alloc_sql("o_orderpriority, o_orderstatus", 777, "orders", "o_orderpriority, o_orderstatus"),
    "stratified_sample_hash": f"WITH {CORPUS_SQL} SELECT id, register, text_type FROM ({_sample_sql('register, text_type', 100, 'corpus')})",
    "label_subset": f"WITH {CORPUS_SQL} SELECT id FROM ({_sample_sql('register, text_type, source_name', 150, 'corpus', 7)})",
    "minority_swap_sample": f"""WITH {CORPUS_SQL}, v AS (SELECT id, source_name, CASE WHEN id % 9 = 0 THEN 'other' ELSE 'target' END AS verdict FROM corpus), s AS (SELECT id, source_name, verdict FROM ({_sample_sql('source_name', 100, 'v')})),
d AS (SELECT greatest(0, 30 - count(*) FILTER (verdict = 'other')) AS n FROM s), i AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY md5(id || ':42'), id) AS rn FROM v WHERE verdict = 'other' AND id NOT IN (SELECT id FROM s)) WHERE rn <= (SELECT n FROM d)),
o AS (SELECT id FROM (SELECT id, row_number() OVER (ORDER BY md5(id || ':42') DESC, id) AS rn FROM s WHERE verdict <> 'other') WHERE rn <= (SELECT count(*) FROM i))
SELECT * FROM s WHERE id NOT IN (SELECT id FROM o) UNION ALL SELECT id, source_name, verdict FROM i""",
    "calibration_strata": f"""WITH {CORPUS_SQL}, c AS (SELECT *, NOT (length(cleaned_text) BETWEEN 400 AND 2000) AS off, md5(id || ':42') AS h FROM corpus),
a AS (SELECT id FROM c WHERE text_type = 'verse' ORDER BY off, h, id LIMIT 20), b AS (SELECT id FROM c WHERE register = 'news' AND id NOT IN (SELECT id FROM a) ORDER BY off, h, id LIMIT 20),
o AS (SELECT id FROM c WHERE register IN ('literary', 'opinion') AND id NOT IN (SELECT id FROM a) AND id NOT IN (SELECT id FROM b) ORDER BY off, h, id LIMIT 20)
SELECT id, 'verse' AS stratum FROM a UNION ALL SELECT id, 'news' FROM b UNION ALL SELECT id, 'other' FROM o""",
    "chunk_assignment": f"{_CHUNKS} SELECT id, chunk FROM ch",
    "chunk_partition_proof": f"{_CHUNKS} SELECT (SELECT count(*) FROM (SELECT id FROM ch GROUP BY id HAVING count(*) > 1))::BIGINT AS repeated, (SELECT count(*) FROM (SELECT id FROM ch GROUP BY id HAVING count(DISTINCT chunk) > 1))::BIGINT AS overlapping, (SELECT count(*) FROM corpus WHERE id NOT IN (SELECT id FROM ch))::BIGINT AS missing, (SELECT count(*) FROM ch WHERE id NOT IN (SELECT id FROM corpus))::BIGINT AS extra",
    "chunk_tolerance": f"""{_CHUNKS}, l AS ({_LONG}), sz AS (SELECT chunk, count(*) AS size FROM ch GROUP BY chunk), v AS (SELECT field, value, count(*) AS all_n FROM l GROUP BY ALL), n AS (SELECT field, value, chunk, count(*) AS n FROM l GROUP BY ALL),
g AS (SELECT v.field, v.value, sz.chunk, 100.0::DOUBLE * coalesce(n.n, 0) / size AS pct, 100.0::DOUBLE * all_n / (SELECT sum(size) FROM sz) AS all_pct FROM v CROSS JOIN sz LEFT JOIN n ON n.field = v.field AND n.value = v.value AND n.chunk = sz.chunk)
SELECT field, value, chunk, round(pct, 6) AS pct, round(all_pct, 6) AS all_pct, abs(pct - all_pct) <= 1.0 AS ok FROM g""",
    "category_quota": "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 7",
    **{f"routing_{n}": f"{_ROUTE} SELECT id FROM {n}" for n in ("routed", "control", "random", "reliability")},
    "routing_disjoint": f"{_ROUTE} SELECT (SELECT count(*) FROM (SELECT id FROM (SELECT id FROM routed UNION ALL SELECT id FROM control UNION ALL SELECT id FROM random) GROUP BY id HAVING count(*) > 1))::BIGINT AS overlapping, (SELECT count(*) FROM reliability WHERE id NOT IN (SELECT id FROM routed))::BIGINT AS outside",
    "routing_frontier": f"{_ROUTE} SELECT tau20, sum(n) OVER w::BIGINT AS n_routed, round(sum(s) OVER w, 6) AS covered FROM (SELECT floor(entropy * 20)::BIGINT AS tau20, count(*)::BIGINT AS n, sum(entropy) AS s FROM e GROUP BY 1) WINDOW w AS (ORDER BY tau20 DESC ROWS UNBOUNDED PRECEDING)",
    "blinded_sheet": f"WITH {CORPUS_SQL} SELECT id, md5(raw_text) AS raw_md5, md5(cleaned_text) AS clean_md5, source_name, register, text_type, 'latin' AS script, '' AS human_label FROM corpus ORDER BY md5(id || ':42'), id LIMIT 50",
}
QUERIES = {f.__name__: f for f in (stratified_allocation, stratified_sample_hash, label_subset, minority_swap_sample, calibration_strata, chunk_assignment, chunk_partition_proof, chunk_tolerance, category_quota, routing_routed, routing_control, routing_random, routing_reliability, routing_disjoint, routing_frontier, blinded_sheet)}
