"""Queries of votes, agreement, calibration and consensus models."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import em, votes as V
from .tables import CORPUS_SQL, VOTES_SQL, corpus, items, table, votes

#: A line of Devanagari, which the test documents lack.
DEVANAGARI_LINE = "भोजपुरी में लिखल एगो वाक्य"

STRATA = ["register", "text_type"]


def _rounded(df, places: int = 6):
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def vote_long_to_wide(spark, sf_dir):
    return V.wide_votes(votes(spark, sf_dir))


def raw_vote_frequency(spark, sf_dir):
    return _rounded(V.raw_frequency(votes(spark, sf_dir)))


def reduced_vote_frequency(spark, sf_dir):
    return _rounded(V.raw_frequency(V.reduced(votes(spark, sf_dir), 4), 4))


def majority_vote(spark, sf_dir):
    return _rounded(V.majority(items(spark, sf_dir), votes(spark, sf_dir)))


def majority_tie_rate(spark, sf_dir):
    m = V.majority(items(spark, sf_dir), votes(spark, sf_dir))
    return m.agg(F.count("*").alias("n"), F.count_if("tie").alias("ties"), F.round(F.count_if("tie") / F.count("*"), 6).alias("tie_rate"))


def unanimity_check(spark, sf_dir):
    v = votes(spark, sf_dir)
    return _rounded(V.unanimity_check(V.majority(items(spark, sf_dir), v), v))


def class_ratio_check(spark, sf_dir):
    v = votes(spark, sf_dir)
    return _rounded(V.class_ratio(V.majority(items(spark, sf_dir), v), v))


def pairwise_judge_agreement(spark, sf_dir):
    return _rounded(V.pairwise_agreement(votes(spark, sf_dir)))


def subjectivity_agreement(spark, sf_dir):
    """Pairwise agreement of the binary label: objective or not."""
    v = votes(spark, sf_dir).withColumn("vote", F.when(F.col("vote") == 0, 0).otherwise(1))
    return _rounded(V.pairwise_agreement(v))


def fleiss_kappa(spark, sf_dir):
    return _rounded(V.fleiss_kappa(votes(spark, sf_dir)))


def krippendorff_alpha(spark, sf_dir):
    return _rounded(V.krippendorff_alpha(votes(spark, sf_dir)))


def calibration_ece_brier(spark, sf_dir):
    v = votes(spark, sf_dir)
    return _rounded(V.calibration(v, V.majority(items(spark, sf_dir), v)))


def calibration_stratified(spark, sf_dir):
    """Calibration against the stratified model of two rounds."""
    return _rounded(V.calibration(votes(spark, sf_dir), stratified_dawid_skene_fixed2(spark, sf_dir)), 5)


def judge_reliability(spark, sf_dir):
    """Strength of judges on news prose against verse, by the stratified model of two rounds."""
    s = em.judge_strength(items(spark, sf_dir), votes(spark, sf_dir), STRATA, s=em.Settings(rounds=2, tolerance=0.0))
    return _rounded(em.reliability(s), 5)


def posterior_repair(spark, sf_dir):
    """Shares of votes with labels left out and items left out, repaired."""
    long = votes(spark, sf_dir).where("vote <> 2 and id % 11 <> 3").groupBy("id", F.col("vote").alias("label")).agg((F.count("*") / 5).alias("p"))
    return _rounded(V.repaired_posteriors(items(spark, sf_dir), long))


def entropy_by_script(spark, sf_dir):
    """Entropy by script and overall, the highest mean first."""
    m = V.majority(items(spark, sf_dir), votes(spark, sf_dir))
    e = m.select("id", V.entropy([F.col(f"p_{k}") for k in range(5)]).alias("entropy"))
    own = corpus(spark, sf_dir).select("id", F.when(F.col("id") % 50 == 0, F.lit(DEVANAGARI_LINE)).when(F.col("id") % 50 == 1, F.concat(F.lit(DEVANAGARI_LINE), F.lit(" latin letters"))).otherwise(F.col("raw_text")).alias("t"))
    return _rounded(V.breakdown(own.select("id", T.script_of(F.col("t")).alias("script")).join(e, "id"), ["script"]), 5).orderBy(F.desc("mean"), "value")


def entropy_grouping_sets(spark, sf_dir):
    m = V.majority(items(spark, sf_dir), votes(spark, sf_dir))
    e = m.select("id", V.entropy([F.col(f"p_{k}") for k in range(5)]).alias("entropy"))
    return _rounded(V.breakdown(items(spark, sf_dir).join(e, "id"), ["register", "text_type", "source_name"]), 5)


def _fixed(rounds: int, strata: list[str], spark, sf_dir):
    s = em.Settings(rounds=rounds, tolerance=0.0)
    out = em.consensus(items(spark, sf_dir), votes(spark, sf_dir), strata=strata, s=s)
    return out.select("id", "label", F.round("entropy", 5).alias("entropy"), *[F.round(f"p_{k}", 5).alias(f"p_{k}") for k in range(5)])


dawid_skene_fixed3 = partial(_fixed, 3, [])
stratified_dawid_skene_fixed2 = partial(_fixed, 2, STRATA)


def dawid_skene_converged(spark, sf_dir):
    return _rounded(em.consensus(items(spark, sf_dir), votes(spark, sf_dir)), 4)


def mace(spark, sf_dir):
    return _rounded(em.consensus(items(spark, sf_dir), votes(spark, sf_dir), model="mace"), 4)


def glad(spark, sf_dir):
    return _rounded(em.consensus(items(spark, sf_dir), votes(spark, sf_dir), model="glad"), 4)


def leave_one_judge_out(spark, sf_dir):
    return _rounded(em.leave_one_out(items(spark, sf_dir), votes(spark, sf_dir)))


def aggregator_comparison(spark, sf_dir):
    i, v = items(spark, sf_dir), votes(spark, sf_dir)
    mv = V.majority(i, v).select("id", F.col("label").alias("majority"))
    ds = em.consensus(i, v, s=em.Settings(rounds=3, tolerance=0.0)).select("id", F.col("label").alias("dawid_skene"))
    return _rounded(V.label_agreement(mv.join(ds, "id"), ["majority", "dawid_skene"]))


def primary_decision(spark, sf_dir):
    found = em.decide_primary(items(spark, sf_dir), votes(spark, sf_dir), STRATA)
    rows = [(k, v["unanimity"], v["class_ratio"], k.split("_")[0] == found.method and k.endswith("_4") == (found.dropped is not None)) for k, v in found.checks.items()]
    return spark.createDataFrame(rows, "model string, unanimity boolean, class_ratio boolean, chosen boolean")


def label_gold_scores(spark, sf_dir):
    """A rule's prediction of quality against the gold labels."""
    from ..operators.merge import scores

    d = table(spark, sf_dir, "documents").select("doc_id", (F.regexp_count("text", F.lit("[%$#*!]")) * 50 < F.length("text")).cast("int").alias("pred"))
    return scores(table(spark, sf_dir, "labels").join(d, "doc_id"), "quality", "pred")


def confusion_matrix(spark, sf_dir):
    from ..operators.merge import confusion

    d = table(spark, sf_dir, "documents").select("doc_id", (F.regexp_count("text", F.lit("[%$#*!]")) * 50 < F.length("text")).cast("int").alias("pred"))
    return confusion(table(spark, sf_dir, "labels").join(d, "doc_id"), "quality", "pred")


_W = f"WITH {CORPUS_SQL}, {VOTES_SQL}"
_C = ", ".join(f"count(*) FILTER (vote = {k})::BIGINT AS c{k}" for k in range(5))
_MV = f"""{_W}, cnt AS (SELECT id, {_C} FROM votes GROUP BY id), m AS (SELECT c.id, register, text_type, source_name, {", ".join(f"coalesce(c{k}, 0) AS c{k}" for k in range(5))} FROM corpus c LEFT JOIN cnt USING (id)),
mv AS (SELECT *, c0 + c1 + c2 + c3 + c4 AS nv, greatest(c0, c1, c2, c3, c4) AS top FROM m), mj AS (SELECT *, CASE top WHEN c0 THEN 0 WHEN c1 THEN 1 WHEN c2 THEN 2 WHEN c3 THEN 3 ELSE 4 END::INT AS label,
((c0 = top)::INT + (c1 = top)::INT + (c2 = top)::INT + (c3 = top)::INT + (c4 = top)::INT) > 1 AS tie, {", ".join(f"c{k}::DOUBLE / greatest(nv, 1) AS p_{k}" for k in range(5))} FROM mv)"""
_AGREE = "SELECT a.judge::INT AS judge_a, b.judge::INT AS judge_b, count(*)::BIGINT AS n, round(avg((a.vote = b.vote)::INT), 6) AS agreement FROM {v} a JOIN {v} b ON a.id = b.id AND a.judge < b.judge GROUP BY ALL"
_D = "avg(entropy) AS mean, median(entropy) AS median, stddev_pop(entropy) AS std, quantile_cont(entropy, 0.25) AS p25, quantile_cont(entropy, 0.75) AS p75, avg((entropy < 0.3)::INT) AS below_03, avg((entropy > 0.7)::INT) AS above_07"


def _em_sql(rounds: int, strata: bool) -> str:
    """EM with a fixed number of rounds as common table expressions, unrolled."""
    ks = range(5)
    anchor = ", ".join(f"(SELECT count(*) FILTER (vote = {k})::DOUBLE / count(*) FROM votes) AS a{k}" for k in ks)
    s = "register || '|' || text_type" if strata else "'all'"
    sql = [f"{_MV}, it AS (SELECT id, {s} AS s, {', '.join(f'(c{k} + 1.0::DOUBLE) / (nv + 5) AS t{k}' for k in ks)} FROM mv), an AS (SELECT {anchor}), z0 AS (SELECT * FROM it)"]
    for r in range(1, rounds + 1):
        p = f"z{r - 1}"
        sql.append(f"pr{r} AS (SELECT {', '.join(f'ln(greatest((sum(t{k}) + 500 * any_value(a{k})) / (count(*) + 500), 1e-12)) AS l{k}' for k in ks)} FROM {p}, an)")
        sql.append(f"lt{r} AS (SELECT v.judge, v.vote, x.s, k.k, CASE k.k {' '.join(f'WHEN {k} THEN t{k}' for k in ks)} END AS m FROM votes v JOIN {p} x USING (id), range(5) k(k))")
        grid = "(SELECT j.j AS judge, t.k AS k, w.w AS vote FROM range(5) j(j), range(5) t(k), range(5) w(w)) g"
        cell = "({num} + CASE WHEN g.k = g.vote THEN 5.0 ELSE 0.5 END) / ({den} + 7.0)"
        sql.append(f"gj{r} AS (SELECT judge, k, vote, sum(m) AS m FROM lt{r} GROUP BY ALL), gr{r} AS (SELECT judge, k, sum(m) AS m FROM lt{r} GROUP BY ALL)")
        sql.append(f"cg{r} AS (SELECT g.judge, g.k, g.vote, {cell.format(num='coalesce(a.m, 0)', den='coalesce(b.m, 0)')} AS c FROM {grid} LEFT JOIN gj{r} a ON a.judge = g.judge AND a.k = g.k AND a.vote = g.vote LEFT JOIN gr{r} b ON b.judge = g.judge AND b.k = g.k)")
        if strata:
            sql.append(f"ss{r} AS (SELECT s, count(*)::DOUBLE AS n FROM {p} GROUP BY s), sj{r} AS (SELECT s, judge, k, vote, sum(m) AS m FROM lt{r} GROUP BY ALL), sr{r} AS (SELECT s, judge, k, sum(m) AS m FROM lt{r} GROUP BY ALL)")
            sql.append(f"cf{r} AS (SELECT q.s, g.judge, g.k, g.vote, q.n / (q.n + 50) * {cell.format(num='coalesce(a.m, 0)', den='coalesce(b.m, 0)')} + 50 / (q.n + 50) * g.c AS c FROM cg{r} g CROSS JOIN ss{r} q LEFT JOIN sj{r} a ON a.s = q.s AND a.judge = g.judge AND a.k = g.k AND a.vote = g.vote LEFT JOIN sr{r} b ON b.s = q.s AND b.judge = g.judge AND b.k = g.k)")
        else:
            sql.append(f"cf{r} AS (SELECT 'all' AS s, judge, k, vote, c FROM cg{r})")
        sql.append(f"lp{r} AS (SELECT x.id, x.s, {', '.join(f'any_value(l{k}) + coalesce(sum(ln(c.c)) FILTER (c.k = {k}), 0) AS q{k}' for k in ks)} FROM {p} x CROSS JOIN pr{r} LEFT JOIN votes v USING (id) LEFT JOIN cf{r} c ON c.s = x.s AND c.judge = v.judge AND c.vote = v.vote GROUP BY x.id, x.s)")
        top = f"greatest({', '.join(f'q{k}' for k in ks)})"
        sql.append(f"ex{r} AS (SELECT id, s, {', '.join(f'exp(q{k} - {top}) AS e{k}' for k in ks)} FROM lp{r}), z{r} AS (SELECT id, s, {', '.join(f'e{k} / (e0 + e1 + e2 + e3 + e4) AS t{k}' for k in ks)} FROM ex{r})")
    last = f"z{rounds}"
    ent = " + ".join(f"CASE WHEN t{k} > 0 THEN t{k} * ln(t{k}) ELSE 0 END" for k in ks)
    return ", ".join(sql), f"SELECT id, CASE greatest(t0, t1, t2, t3, t4) WHEN t0 THEN 0 WHEN t1 THEN 1 WHEN t2 THEN 2 WHEN t3 THEN 3 ELSE 4 END::INT AS label, round(-({ent}), 5) AS entropy, {', '.join(f'round(t{k}, 5) AS p_{k}' for k in ks)} FROM {last}"


_DS3, _DS3_SELECT = _em_sql(3, False)
_SD2, _SD2_SELECT = _em_sql(2, True)
_PRED = "SELECT l.quality AS t, (len(regexp_extract_all(text, '[%$#*!]')) * 50 < length(text))::INT AS p FROM labels l JOIN documents d USING (doc_id)"

ORACLE = {
    "vote_long_to_wide": f"{_W} SELECT id, {', '.join(f'max(vote) FILTER (judge = {j})::INT AS vote_{j}' for j in range(5))} FROM votes GROUP BY id",
    "raw_vote_frequency": f"{_W} SELECT k::INT AS label, count(*) FILTER (vote = k)::BIGINT AS n, round(count(*) FILTER (vote = k)::DOUBLE / count(*), 6) AS share FROM votes, range(5) r(k) GROUP BY k",
    "reduced_vote_frequency": f"{_W} SELECT k::INT AS label, count(*) FILTER (vote = k)::BIGINT AS n, round(count(*) FILTER (vote = k)::DOUBLE / count(*), 6) AS share FROM votes, range(4) r(k) WHERE vote <> 4 GROUP BY k",
    "majority_vote": f"{_MV} SELECT id, label, tie, {', '.join(f'round(p_{k}, 6) AS p_{k}' for k in range(5))} FROM mj",
    "majority_tie_rate": f"{_MV} SELECT count(*)::BIGINT AS n, count(*) FILTER (tie)::BIGINT AS ties, round(count(*) FILTER (tie)::DOUBLE / count(*), 6) AS tie_rate FROM mj",
    "unanimity_check": f"{_MV} SELECT count(*)::BIGINT AS n_unanimous, count(*) FILTER (label <> u)::BIGINT AS violations, round(count(*) FILTER (label <> u)::DOUBLE / greatest(count(*), 1), 6) AS rate FROM (SELECT id, min(vote) AS u FROM votes GROUP BY id HAVING count(*) >= 2 AND min(vote) = max(vote)) x JOIN mj USING (id)",
    "class_ratio_check": f"{_MV}, raw AS (SELECT k::INT AS label, count(*) FILTER (vote = k)::DOUBLE / count(*) AS raw FROM votes, range(5) r(k) GROUP BY k), sh AS (SELECT raw.label, (SELECT count(*) FROM mj WHERE mj.label = raw.label)::DOUBLE / (SELECT count(*) FROM mj) AS share, raw FROM raw) SELECT label, round(share, 6) AS share, round(raw, 6) AS raw, round(share / raw, 6) AS ratio, share / raw <= 3 AS ok FROM sh",
    "pairwise_judge_agreement": f"{_W} {_AGREE.format(v='votes')}",
    "subjectivity_agreement": f"{_W}, b AS (SELECT id, judge, (vote <> 0)::INT AS vote FROM votes) {_AGREE.format(v='b')}",
    "fleiss_kappa": f"{_W}, c AS (SELECT id, count(*)::DOUBLE AS n, {_C} FROM votes GROUP BY id HAVING count(*) >= 2), s AS (SELECT count(*)::BIGINT AS n_items, avg((c0*c0 + c1*c1 + c2*c2 + c3*c3 + c4*c4 - n) / (n * (n - 1))) AS p_bar, (sum(c0)^2 + sum(c1)^2 + sum(c2)^2 + sum(c3)^2 + sum(c4)^2)::DOUBLE / sum(n)^2 AS p_e FROM c) SELECT n_items, round(p_bar, 6) AS p_bar, round(p_e, 6) AS p_e, round((p_bar - p_e) / (1 - p_e), 6) AS kappa FROM s",
    "krippendorff_alpha": f"{_W}, c AS (SELECT id, count(*)::DOUBLE AS m, {_C} FROM votes GROUP BY id HAVING count(*) >= 2), s AS (SELECT sum(m)::DOUBLE AS n, sum((m*m - c0*c0 - c1*c1 - c2*c2 - c3*c3 - c4*c4) / (m - 1)) AS o, sum(m)^2 - sum(c0)^2 - sum(c1)^2 - sum(c2)^2 - sum(c3)^2 - sum(c4)^2 AS e FROM c) SELECT n::BIGINT AS n, round(1 - (n - 1) * o / e, 6) AS alpha FROM s",
    "calibration_ece_brier": f"{_MV}, b AS (SELECT judge::INT AS judge, confidence, (vote = label)::INT AS hit, len(list_filter([0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9]::DOUBLE[], lambda e: confidence > e)) AS bin FROM votes JOIN mj USING (id)), g AS (SELECT judge, bin, count(*) AS n, sum(confidence) AS c, sum(hit) AS h, sum((confidence - hit)^2) AS q, count(*) FILTER (confidence >= 0.9) AS n90, count(*) FILTER (confidence >= 0.95) AS n95 FROM b GROUP BY ALL) SELECT judge, sum(n)::BIGINT AS n, round(sum(c) / sum(n), 6) AS mean_confidence, round(sum(n90)::DOUBLE / sum(n), 6) AS share_90, round(sum(n95)::DOUBLE / sum(n), 6) AS share_95, round(sum(h)::DOUBLE / sum(n), 6) AS agreement, round(sum(abs(h - c)) / sum(n), 6) AS ece, round(sum(q) / sum(n), 6) AS brier FROM g GROUP BY judge",
    "calibration_stratified": f"{_SD2}, sl AS ({_SD2_SELECT}), b AS (SELECT judge::INT AS judge, confidence, (vote = label)::INT AS hit, len(list_filter([0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9]::DOUBLE[], lambda e: confidence > e)) AS bin FROM votes JOIN sl USING (id)), g AS (SELECT judge, bin, count(*) AS n, sum(confidence) AS c, sum(hit) AS h, sum((confidence - hit)^2) AS q, count(*) FILTER (confidence >= 0.9) AS n90, count(*) FILTER (confidence >= 0.95) AS n95 FROM b GROUP BY ALL) SELECT judge, sum(n)::BIGINT AS n, round(sum(c) / sum(n), 5) AS mean_confidence, round(sum(n90)::DOUBLE / sum(n), 5) AS share_90, round(sum(n95)::DOUBLE / sum(n), 5) AS share_95, round(sum(h)::DOUBLE / sum(n), 5) AS agreement, round(sum(abs(h - c)) / sum(n), 5) AS ece, round(sum(q) / sum(n), 5) AS brier FROM g GROUP BY judge",
    "judge_reliability": f"""{_SD2}, st AS (SELECT s, judge, avg(c) AS strength FROM cf2 WHERE k = vote GROUP BY ALL), r AS (SELECT judge::INT AS judge, avg(strength) FILTER (s = 'news|prose') AS b, avg(strength) FILTER (s LIKE 'verse|%' OR s LIKE '%|verse') AS v FROM st GROUP BY judge)
SELECT judge, round(b, 5) AS base, round(v, 5) AS verse, round(v - b, 5) AS delta, v < b AS degrades FROM r""",
    "posterior_repair": f"""{_W}, l AS (SELECT id, vote, count(*) / 5.0::DOUBLE AS p FROM votes WHERE vote <> 2 AND id % 11 <> 3 GROUP BY ALL), w AS (SELECT c.id, {", ".join(f"coalesce(sum(p) FILTER (vote = {k}), 0)::DOUBLE AS q{k}" for k in range(5))} FROM corpus c LEFT JOIN l USING (id) GROUP BY c.id)
SELECT id, {", ".join(f"round(CASE WHEN q0 + q1 + q2 + q3 + q4 > 0 THEN q{k} / (q0 + q1 + q2 + q3 + q4) ELSE 0.2 END, 6)::DOUBLE AS p_{k}" for k in range(5))} FROM w""",
    "entropy_by_script": f"""{_MV}, x AS (SELECT id, CASE id % 50 WHEN 0 THEN '{DEVANAGARI_LINE}' WHEN 1 THEN '{DEVANAGARI_LINE} latin letters' ELSE raw_text END AS t FROM corpus),
n AS (SELECT id, len(regexp_extract_all(t, '[\\x{{0900}}-\\x{{097F}}]')) AS d, len(regexp_extract_all(t, '[A-Za-z]')) AS l FROM x), e AS (SELECT -({" + ".join(f"CASE WHEN p_{k} > 0 THEN p_{k} * ln(p_{k}) ELSE 0 END" for k in range(5))}) AS entropy,
CASE WHEN d + l = 0 THEN 'other' WHEN d >= 0.9 * (d + l) THEN 'devanagari' WHEN l >= 0.9 * (d + l) THEN 'latin' ELSE 'mixed' END AS script FROM mj JOIN n USING (id)),
u AS (SELECT 'script' AS dimension, script AS value, count(*)::BIGINT AS n, {_D} FROM e GROUP BY script UNION ALL SELECT 'overall', 'all', count(*)::BIGINT, {_D} FROM e)
SELECT dimension, value, n, {", ".join(f"round({c}, 5) AS {c}" for c in ("mean", "median", "std", "p25", "p75", "below_03", "above_07"))} FROM u""",
    "entropy_grouping_sets": f"{_MV}, e AS (SELECT *, -({' + '.join(f'CASE WHEN p_{k} > 0 THEN p_{k} * ln(p_{k}) ELSE 0 END' for k in range(5))}) AS entropy FROM mj), u AS ("
    + " UNION ALL ".join(f"SELECT '{d}' AS dimension, {v} AS value, count(*)::BIGINT AS n, {_D} FROM e GROUP BY {v}" for d, v in (("register", "register"), ("text_type", "text_type"), ("source_name", "source_name"), ("overall", "'all'")))
    + ") SELECT dimension, value, n, round(mean, 5) AS mean, round(median, 5) AS median, round(std, 5) AS std, round(p25, 5) AS p25, round(p75, 5) AS p75, round(below_03, 5) AS below_03, round(above_07, 5) AS above_07 FROM u",
    "dawid_skene_fixed3": f"{_DS3} {_DS3_SELECT}",
    "stratified_dawid_skene_fixed2": f"{_SD2} {_SD2_SELECT}",
    "aggregator_comparison": f"{_DS3}, ds AS ({_DS3_SELECT}) SELECT 'majority' AS method_a, 'dawid_skene' AS method_b, round(avg((mj.label = ds.label)::INT), 6) AS agreement FROM mj JOIN ds USING (id)",
    "confusion_matrix": f"WITH r AS ({_PRED}) SELECT a.t AS true, b.p AS predicted, (SELECT count(*) FROM r WHERE r.t = a.t AND r.p = b.p)::BIGINT AS n FROM (SELECT DISTINCT t FROM r) a, (SELECT DISTINCT p FROM r) b",
    "label_gold_scores": f"WITH r AS ({_PRED}), c AS (SELECT t AS class, count(*)::BIGINT AS support, count(*) FILTER (t = p)::DOUBLE AS hit, (SELECT count(*) FROM r q WHERE q.p = r.t)::DOUBLE AS given FROM r GROUP BY t), s AS (SELECT class, support, CASE WHEN given > 0 THEN hit / given ELSE 0 END AS pr, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS re FROM c) SELECT class, support, round(pr, 4) AS precision, round(re, 4) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 4) AS f1, (SELECT round(avg((t = p)::INT), 4) FROM r) AS accuracy FROM s",
}
QUERIES = {f.__name__: f for f in (calibration_stratified, judge_reliability, posterior_repair, entropy_by_script, vote_long_to_wide, raw_vote_frequency, reduced_vote_frequency, majority_vote, majority_tie_rate, unanimity_check, class_ratio_check, pairwise_judge_agreement, subjectivity_agreement, fleiss_kappa, krippendorff_alpha, calibration_ece_brier, entropy_grouping_sets, dawid_skene_converged, mace, glad, leave_one_judge_out, aggregator_comparison, primary_decision, label_gold_scores, confusion_matrix)} | {"dawid_skene_fixed3": dawid_skene_fixed3, "stratified_dawid_skene_fixed2": stratified_dawid_skene_fixed2}
