"""Queries of judge shards, the master table, drift and manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedup, manifest, merge, votes as V
from .tables import CORPUS_SQL, VOTES_SQL, corpus, items, table, votes

#: The faults planted in the shards: a doubled row, one in a second chunk, a foreign id, a missing shard, a changed setting.


def _shards(spark, sf_dir):
    v = votes(spark, sf_dir)
    chunk = (F.col("id") % 9 + 1).cast("long")
    base = v.select("id", F.concat(F.lit("j"), F.col("judge")).alias("judge"), chunk.alias("chunk"), F.when(F.col("vote") == 0, "objective").otherwise("subjective").alias("subjectivity"), F.when(F.col("vote") == 1, "positive").when(F.col("vote") == 2, "negative").when(F.col("vote") == 3, "neutral").when(F.col("vote") == 4, "mixed").alias("polarity"), "confidence", F.lit("general").alias("domain"), F.lit("mixed").alias("narrative_voice"), F.lit(None).cast("string").alias("sentiment_target"), F.lit("r").alias("rationale"), F.when((F.col("judge") == 2) & (F.col("id") % 50 == 0), "v2").otherwise("v1").alias("prompt"))
    base = base.where(~((F.col("judge") == "j4") & (F.col("chunk") == 3)))
    twice = base.where("judge = 'j1' and id % 100 = 7")
    moved = base.where("judge = 'j3' and id % 100 = 9").withColumn("chunk", F.lit(9).cast("long"))
    foreign = base.where("judge = 'j0' and id % 200 = 11").withColumn("id", F.col("id") + 10_000_000_000)
    return base.union(twice).union(moved).union(foreign)


def _members(spark, sf_dir):
    return corpus(spark, sf_dir).select("id", (F.col("id") % 9 + 1).cast("long").alias("chunk"))


def shard_doubled_ids(spark, sf_dir):
    return merge.doubled_ids(_shards(spark, sf_dir))


def shard_coverage(spark, sf_dir):
    return merge.chunk_coverage(_shards(spark, sf_dir), _members(spark, sf_dir))


def shard_configs(spark, sf_dir):
    return merge.inconsistent_configs(_shards(spark, sf_dir), [F.col("prompt")])


def completed_chunks_division(spark, sf_dir):
    return merge.complete_chunks(_shards(spark, sf_dir))


def expected_sidecars(spark, sf_dir):
    s = _shards(spark, sf_dir)
    return merge.expected_grid(s, s, s)


def foreign_ids(spark, sf_dir):
    return merge.foreign_ids(_shards(spark, sf_dir), corpus(spark, sf_dir))


def master_join_n_judges(spark, sf_dir):
    m = merge.master(items(spark, sf_dir), _shards(spark, sf_dir), [f"j{i}" for i in range(5)])
    return m.select("id", "register", "n_judges", "judge_j0_polarity", "judge_j4_subjectivity", F.round("judge_j2_confidence", 6).alias("judge_j2_confidence"))


def master_chunks(spark, sf_dir):
    """Rows and shards by chunk of a master whose every id has a chunk."""
    m = merge.master(merge.with_chunk(items(spark, sf_dir), _members(spark, sf_dir)), _shards(spark, sf_dir), [f"j{i}" for i in range(5)])
    return m.groupBy("chunk").agg(F.count("*").alias("n"), F.sum("n_judges").alias("verdicts"))


def shard_union(spark, sf_dir):
    """The chunks of one judge as one table; one of them lacks the confidence."""
    s = _shards(spark, sf_dir).where("judge = 'j2'").select("id", "chunk", "subjectivity", "confidence")
    parts = [s.where(F.col("chunk") == c) for c in range(2, 10)]
    return merge.union_shards([*parts, s.where("chunk = 1").drop("confidence")]).select("id", "chunk", "subjectivity", F.round("confidence", 6).alias("confidence"))


def master_votes(spark, sf_dir):
    """The master read back as votes: counts per judge and label."""
    judges = [f"j{i}" for i in range(5)]
    m = merge.master(items(spark, sf_dir), _shards(spark, sf_dir), judges)
    return V.long_votes(m, judges).groupBy("judge", "vote").agg(F.count("*").alias("n"))


def nested_votes(spark, sf_dir):
    """The master with one struct a judge: null where the judge gave no verdict."""
    judges = [f"j{i}" for i in range(5)]
    m = merge.nested(merge.master(items(spark, sf_dir), _shards(spark, sf_dir), judges), judges)
    return m.select("id", "n_judges", F.col("judges.j0.polarity").alias("j0_polarity"), F.round("judges.j2.confidence", 6).alias("j2_confidence"), *[F.col(f"judges.{j}").isNull().alias(f"{j}_silent") for j in judges])


def doubled_shards(spark, sf_dir):
    """Pairs of judge and chunk that several files claim; files are named after the prompt that a row was made with."""
    return merge.doubled_shards(_shards(spark, sf_dir).withColumn("file", F.concat_ws("__", "judge", "prompt")))


def judge_signature(spark, sf_dir):
    s = merge.signature(_shards(spark, sf_dir))
    return s.select("judge", "chunk", "n", *[F.round(c, 6).alias(c) for c in ("subjectivity_pct", "positive_pct", "negative_pct", "neutral_pct", "mixed_pct", "mean_confidence")])


def judge_signature_drift(spark, sf_dir):
    d = merge.drift(merge.signature(_shards(spark, sf_dir)), 1, 2)
    return d.select("judge", *[F.round(c, 6).alias(c) for c in ("pct_a", "pct_b", "delta")], "drifted")


def event_drift(spark, sf_dir):
    """The same flag for events: share of large values by type in the two halves of the month."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("judge"), F.when(F.dayofmonth("ts") <= 15, 1).otherwise(2).alias("chunk"), F.when(F.col("value") > 50, "subjective").otherwise("objective").alias("subjectivity"), F.lit("mixed").alias("polarity"), F.lit(1.0).alias("confidence"))
    d = merge.drift(merge.signature(e), 1, 2)
    return d.select("judge", *[F.round(c, 6).alias(c) for c in ("pct_a", "pct_b", "delta")], "drifted")


def unexpected_values(spark, sf_dir):
    return dedup.unexpected_values(_shards(spark, sf_dir), "polarity", ["positive", "negative", "neutral"])


def run_manifest_counts(spark, sf_dir):
    return manifest.counts_by(_shards(spark, sf_dir), ["judge", "subjectivity", "prompt"])


def several_valued_settings(spark, sf_dir):
    return manifest.several_valued(_shards(spark, sf_dir), "judge", ["prompt", "domain"])


def run_dates(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 3 == 0, manifest.UNRECORDED).otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("date"))
    return manifest.run_dates(e, "date")


_S = f"""WITH {CORPUS_SQL}, {VOTES_SQL}, base AS (SELECT id, 'j' || judge AS judge, id % 9 + 1 AS chunk, CASE vote WHEN 0 THEN 'objective' ELSE 'subjective' END AS subjectivity,
 CASE vote WHEN 1 THEN 'positive' WHEN 2 THEN 'negative' WHEN 3 THEN 'neutral' WHEN 4 THEN 'mixed' END AS polarity, confidence, vote, CASE WHEN judge = 2 AND id % 50 = 0 THEN 'v2' ELSE 'v1' END AS prompt FROM votes WHERE NOT (judge = 4 AND id % 9 + 1 = 3)),
s AS (SELECT * FROM base UNION ALL SELECT * FROM base WHERE judge = 'j1' AND id % 100 = 7 UNION ALL SELECT id, judge, 9, subjectivity, polarity, confidence, vote, prompt FROM base WHERE judge = 'j3' AND id % 100 = 9
 UNION ALL SELECT id + 10000000000, judge, chunk, subjectivity, polarity, confidence, vote, prompt FROM base WHERE judge = 'j0' AND id % 200 = 11)"""
_SIG = "sg AS (SELECT judge, chunk, count(*)::BIGINT AS n, 100.0::DOUBLE * count(*) FILTER (subjectivity = 'subjective') / count(*) AS subjectivity_pct, " + ", ".join(f"100.0::DOUBLE * count(*) FILTER (subjectivity = 'subjective' AND polarity = '{p}') / nullif(count(*) FILTER (subjectivity = 'subjective'), 0) AS {p}_pct" for p in ("positive", "negative", "neutral", "mixed")) + ", avg(confidence) AS mean_confidence FROM s GROUP BY ALL)"
_DRIFT = "SELECT judge, round(a, 6) AS pct_a, round(b, 6) AS pct_b, round(b - a, 6) AS delta, abs(b - a) > 5 AS drifted FROM (SELECT judge, max(subjectivity_pct) FILTER (chunk = 1) AS a, max(subjectivity_pct) FILTER (chunk = 2) AS b FROM sg GROUP BY judge) WHERE a IS NOT NULL AND b IS NOT NULL"

ORACLE = {
    "nested_votes": f"{_S} SELECT c.id, count(DISTINCT judge)::BIGINT AS n_judges, max(polarity) FILTER (judge = 'j0') AS j0_polarity, round(max(confidence) FILTER (judge = 'j2'), 6) AS j2_confidence, " + ", ".join(f"count(*) FILTER (judge = 'j{i}') = 0 AS j{i}_silent" for i in range(5)) + " FROM corpus c LEFT JOIN s USING (id) GROUP BY c.id",
    "doubled_shards": f"{_S} SELECT judge, chunk, count(DISTINCT judge || '__' || prompt)::BIGINT AS n FROM s GROUP BY judge, chunk HAVING count(DISTINCT prompt) > 1",
    "master_chunks": f"WITH {CORPUS_SQL}, {VOTES_SQL} SELECT (c.id % 9 + 1)::BIGINT AS chunk, count(DISTINCT c.id)::BIGINT AS n, count(v.judge) FILTER (NOT (v.judge = 4 AND c.id % 9 + 1 = 3))::BIGINT AS verdicts FROM corpus c LEFT JOIN votes v USING (id) GROUP BY ALL",
    "shard_union": f"WITH {CORPUS_SQL}, {VOTES_SQL} SELECT id, (id % 9 + 1)::BIGINT AS chunk, CASE vote WHEN 0 THEN 'objective' ELSE 'subjective' END AS subjectivity, CASE WHEN id % 9 <> 0 THEN round(confidence, 6) END AS confidence FROM votes WHERE judge = 2",

    "shard_doubled_ids": f"{_S} SELECT judge, id, count(*)::BIGINT AS n, CASE WHEN count(DISTINCT chunk) > 1 THEN 'chunks' ELSE 'shard' END AS place FROM s GROUP BY judge, id HAVING count(*) > 1",
    "shard_coverage": f"{_S}, p AS (SELECT DISTINCT judge, chunk FROM s), w AS (SELECT judge, chunk, id FROM p JOIN (SELECT id, id % 9 + 1 AS chunk FROM corpus) USING (chunk)), h AS (SELECT DISTINCT judge, chunk, id FROM s) SELECT coalesce(w.judge, h.judge) AS judge, coalesce(w.chunk, h.chunk) AS chunk, count(*) FILTER (h.id IS NULL)::BIGINT AS missing, count(*) FILTER (w.id IS NULL)::BIGINT AS extra FROM w FULL JOIN h ON w.judge = h.judge AND w.chunk = h.chunk AND w.id = h.id GROUP BY ALL",
    "shard_configs": f"{_S} SELECT judge, count(DISTINCT prompt)::BIGINT AS configs FROM s GROUP BY judge HAVING count(DISTINCT prompt) > 1",
    "completed_chunks_division": f"{_S} SELECT chunk, count(DISTINCT judge)::BIGINT AS n FROM s GROUP BY chunk HAVING count(DISTINCT judge) = (SELECT count(DISTINCT judge) FROM s)",
    "expected_sidecars": f"{_S} SELECT judge, chunk FROM (SELECT DISTINCT judge FROM s), (SELECT DISTINCT chunk FROM s) EXCEPT SELECT judge, chunk FROM s",
    "foreign_ids": f"{_S} SELECT judge, id FROM s WHERE id NOT IN (SELECT id FROM corpus)",
    "master_join_n_judges": f"{_S} SELECT c.id, c.register, count(DISTINCT judge)::BIGINT AS n_judges, max(polarity) FILTER (judge = 'j0') AS judge_j0_polarity, max(subjectivity) FILTER (judge = 'j4') AS judge_j4_subjectivity, round(max(confidence) FILTER (judge = 'j2'), 6) AS judge_j2_confidence FROM corpus c LEFT JOIN s USING (id) GROUP BY c.id, c.register",
    "master_votes": f"{_S} SELECT substr(judge, 2)::INT AS judge, vote::INT AS vote, count(DISTINCT id)::BIGINT AS n FROM s JOIN corpus USING (id) GROUP BY ALL",
    "judge_signature": f"{_S}, {_SIG} SELECT judge, chunk, n, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("subjectivity_pct", "positive_pct", "negative_pct", "neutral_pct", "mixed_pct", "mean_confidence")) + " FROM sg",
    "judge_signature_drift": f"{_S}, {_SIG} {_DRIFT}",
    "event_drift": f"WITH sg AS (SELECT event_type AS judge, CASE WHEN day(ts) <= 15 THEN 1 ELSE 2 END AS chunk, 100.0::DOUBLE * count(*) FILTER (value > 50) / count(*) AS subjectivity_pct FROM events GROUP BY ALL) {_DRIFT}",
    "unexpected_values": f"{_S} SELECT polarity AS value, count(*)::BIGINT AS n FROM s WHERE polarity IS NULL OR polarity NOT IN ('positive', 'negative', 'neutral') GROUP BY polarity",
    "run_manifest_counts": f"{_S} SELECT 'judge' AS dimension, judge AS value, count(*)::BIGINT AS n FROM s GROUP BY judge UNION ALL SELECT 'subjectivity', subjectivity, count(*) FROM s GROUP BY subjectivity UNION ALL SELECT 'prompt', prompt, count(*) FROM s GROUP BY prompt UNION ALL SELECT 'total', 'all', count(*) FROM s",
    "several_valued_settings": f"{_S} SELECT judge, 'prompt' AS column, count(DISTINCT prompt)::BIGINT AS n FROM s GROUP BY judge HAVING count(DISTINCT prompt) > 1",
    "run_dates": "SELECT min(d) AS first, max(d) AS last FROM (SELECT strftime(ts, '%Y-%m-%d') AS d FROM events WHERE event_id % 3 <> 0)",
}
QUERIES = {f.__name__: f for f in (master_chunks, shard_union, nested_votes, doubled_shards, shard_doubled_ids, shard_coverage, shard_configs, completed_chunks_division, expected_sidecars, foreign_ids, master_join_n_judges, master_votes, judge_signature, judge_signature_drift, event_drift, unexpected_values, run_manifest_counts, several_valued_settings, run_dates)}
