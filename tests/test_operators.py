"""Deduplication, allocation and consensus against plain Python."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import dedup, em, enrich, manifest, merge, sample, votes as V


def greedy(rows):
    ids, keys, out = set(), set(), {}
    for n, i, key in rows:
        out[n] = "exact_dupe" if i in ids else "near_dupe" if key in keys else "kept"
        if out[n] == "kept":
            ids.add(i)
            keys.add(key)
    return out


def frame(spark, rows):
    """rows: n, id, key; the text is the key in words."""
    return spark.createDataFrame([(n, i, f"sentence with the key {k} of it", None) for n, i, k in rows], "n int, id string, cleaned_text string, raw_text string")


def test_dedup_where_ids_name_texts(spark):
    rng = random.Random(1)
    rows = [(n, f"i{k}{v}", f"k{k}{'.' * v}") for n in range(300) for k, v in [(rng.randrange(60), rng.randrange(3))]]
    got = {r["n"]: r["reject_reason"] or "kept" for r in dedup.corpus_dedup(frame(spark, rows), ["n"], script="[a-z]").collect()}
    assert got == greedy([(n, i, k.strip(".")) for n, i, k in rows])


def test_strict_dedup_with_foreign_ids(spark):
    rng = random.Random(2)
    rows = [(n, rng.choice([None, *map(str, range(25))]), f"k{rng.randrange(40)}") for n in range(200)]
    got = {r["n"]: r["reject_reason"] or "kept" for r in dedup.strict_order_dedup(frame(spark, rows), ["n"], script="[a-z]").collect()}
    assert got == greedy(rows)


def test_dedup_of_nothing(spark):
    assert dedup.corpus_dedup(frame(spark, []), ["n"]).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(0, 10**6), st.integers(0, 7), min_size=1, max_size=40), st.integers(1, 3))
def test_pattern_em_equals_item_em(cells, judges):
    rng = np.random.default_rng(len(cells))
    votes = rng.integers(-1, 3, (len(cells), judges))
    unique, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    s = em.Settings(rounds=15, tolerance=0.0)
    own = em.dawid_skene(votes, np.ones(len(votes)), 3, np.full(3, 1 / 3), s=s).posteriors
    by_pattern = em.dawid_skene(unique, counts, 3, np.full(3, 1 / 3), s=s).posteriors[inverse.ravel()]
    assert np.allclose(own, by_pattern, atol=1e-9)


def items_and_votes(spark, table):
    items = spark.createDataFrame([(i,) for i in range(len(table))], "id int")
    rows = [(i, j, v, 0.5) for i, t in enumerate(table) for j, v in enumerate(t) if v is not None]
    return items, spark.createDataFrame(rows, "id int, judge int, vote int, confidence double")


TABLE = [(1, 1, 1, 1, 1), (1, 1, 1, 1, None), (1, None, None, None, None), (1, 1, 2, 2, 0), (0, 1, 2, 3, 4), (4, 4, 4, 4, 4), (None,) * 5]


def test_majority_cases(spark):
    items, votes = items_and_votes(spark, TABLE)
    got = {r["id"]: (r["label"], r["tie"]) for r in V.majority(items, votes).collect()}
    assert got == {0: (1, False), 1: (1, False), 2: (1, False), 3: (1, True), 4: (0, True), 5: (4, False), 6: (0, True)}
    assert {r["id"] for r in V.unanimous(votes).collect()} == {0, 1, 5}


def test_class_ratio_extremes(spark):
    items, votes = items_and_votes(spark, [(1, 1)])
    labels = spark.createDataFrame([(0, 2)], "id int, label int")
    got = {r["label"]: r["ratio"] for r in V.class_ratio(labels, votes, 3).collect()}
    assert got == {0: 1.0, 1: 0.0, 2: float("inf")}


def test_kappa_and_alpha_by_hand(spark):
    _, votes = items_and_votes(spark, [(0, 0), (0, 1), (1, 1), (1, 1)])
    k = V.fleiss_kappa(votes, 2).first()
    assert k["p_bar"] == pytest.approx(0.75) and k["kappa"] == pytest.approx((0.75 - (9 + 25) / 64) / (1 - (9 + 25) / 64))
    assert V.krippendorff_alpha(votes, 2).first()["alpha"] == pytest.approx(1 - 7 * 2 / 30)


def test_bins(spark):
    c = [0.0, 0.1, 0.3, 0.30000000000000004, 0.6, 0.7, 1.0]
    rows = spark.createDataFrame([(x,) for x in c], "c double").select(V.confidence_bin(F.col("c")).alias("b")).collect()
    assert [r["b"] for r in rows] == [0, 0, 2, 2, 5, 6, 9]


@pytest.mark.parametrize("model", ["dawid_skene", "mace", "glad"])
def test_models_find_the_truth(spark, model):
    rng = random.Random(5)
    truth = [rng.randrange(3) for _ in range(300)]
    table = [tuple(t if rng.random() < p else rng.randrange(3) for p in (0.95, 0.9, 0.8, 0.3)) for t in truth]
    items, votes = items_and_votes(spark, table)
    got = {r["id"]: r["label"] for r in em.consensus(items, votes, 3, 4, model).collect()}
    assert sum(got[i] == t for i, t in enumerate(truth)) > 270


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=6), st.integers(1, 120))
def test_allocation_and_chunks(spark, sizes, target):
    rows = spark.createDataFrame([(f"{c}-{i}", str(c)) for c, n in enumerate(sizes) for i in range(n)], "id string, cell string")
    got = {r["cell"]: (r["n"], r["alloc"]) for r in sample.allocate(rows, ["cell"], target).collect()}
    total = min(target, sum(sizes))
    assert sum(a for _, a in got.values()) == total
    assert all(abs(a - n * total / sum(sizes)) < 1 for n, a in got.values())
    chunks = sample.chunks(rows, ["cell"], 4).groupBy("cell", "chunk").count().collect()
    for c, n in enumerate(sizes):
        own = [r["count"] for r in chunks if r["cell"] == str(c)]
        assert sum(own) == n and max(own) - (min(own) if len(own) == 4 else 0) <= 1


def test_blinding(spark):
    df = spark.createDataFrame([("1",) * 8], ", ".join(f"{c} string" for c in sample.BLIND_COLUMNS))
    assert sample.assert_blind(df) is df
    with pytest.raises(ValueError):
        sample.assert_blind(df.withColumn("x_entropy", F.lit(1)))


def test_leaves_and_genres(spark):
    labels = spark.createDataFrame([("a",), ("a/b",), ("ab",), ("uncategorized",), ("c/x",)], "label string")
    assert {r["label"] for r in enrich.leaves_only(labels, excluded=["x"]).collect()} == {"a/b", "ab"}
    urls = spark.createDataFrame([("http://h/laghu-katha-1/",), ("http://h/katha",), ("http://h/z",)], "u string")
    assert [r[0] for r in urls.select(enrich.genre_of(F.col("u"))).collect()] == ["लघुकथा", "कथा", None]


def test_manifest(spark):
    log = manifest.run_log(spark, "x\n| a | b |\n|---|:--:|\n| 1 | q |\n")
    assert [tuple(r) for r in log.collect()] == [("1", "q")]
    df = spark.createDataFrame([("a", 1, None), ("a", 2, None)], "g string, x int, y string")
    assert [tuple(r) for r in manifest.several_valued(df, "g", ["x", "y"]).collect()] == [("a", "x", 2)]
    assert dict(tuple(r) for r in manifest.inferred_types(df, ["x", "y"]).collect())["y"] == "null"
    assert manifest.log_text('[{"data": "a"}, {"data": "b"}]') == "ab" and manifest.log_text("plain") == "plain"
    assert manifest.markdown_table(df.select("x")).count("\n") == 3


def test_version_and_sitemap(spark):
    df = spark.createDataFrame([("## 1.2\n 1.10.1 and 1.9", "<url><loc> a </loc><image:image><image:loc>i</image:loc></image:image></url><loc>b</loc>")], "m string, s string")
    r = df.select(T.protocol_version(F.col("m")).alias("v"), T.sitemap_locations(F.col("s")).alias("l")).first()
    assert r["v"] == "1.10.1" and r["l"] == ["a", "b"]


def test_shards_without_faults(spark):
    df = spark.createDataFrame([("a", "j", 1), ("b", "j", 1)], "id string, judge string, chunk long")
    assert merge.doubled_ids(df).count() == 0 and merge.complete_chunks(df).count() == 1


def test_chunk_membership_and_union(spark):
    corpus = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    whole = spark.createDataFrame([(1, 5), (2, 6)], "id long, chunk long")
    assert {(r["id"], r["chunk"]) for r in merge.with_chunk(corpus, whole).collect()} == {(1, 5), (2, 6)}
    with pytest.raises(ValueError, match=r"\[2\]"):
        merge.with_chunk(corpus, whole.where("id = 1"))
    parts = [spark.createDataFrame([(3, "x")], "id long, a string"), spark.createDataFrame([(1, "y")], "id long, b string")]
    assert [tuple(r) for r in merge.union_shards(parts).collect()] == [(1, None, "y"), (3, "x", None)]


def test_posterior_repair(spark):
    items = spark.createDataFrame([(1,), (2,)], "id long")
    long = spark.createDataFrame([(1, 0, 0.2), (1, 3, 0.6)], "id long, label int, p double")
    got = {r["id"]: [round(r[f"p_{k}"], 9) for k in range(5)] for r in V.repaired_posteriors(items, long).collect()}
    assert got == {1: [0.25, 0.0, 0.0, 0.75, 0.0], 2: [0.2] * 5}


def test_errors_become_verdicts():
    from corpusloom.sources.judges import verdict_or_error

    def broken(text):
        raise TimeoutError("no answer " + "x" * 200)

    got = verdict_or_error(broken)("t")
    assert got["label"] == "other" and got["confidence"] == 0.0 and got["reason"].startswith("error: no answer") and len(got["reason"]) == 80
    assert verdict_or_error(lambda t: {"label": "hindi"})("t") == {"label": "hindi"}


SIDECARS = "judge string, chunk int, date string, prompt_file_sha256 string, repo string, seed int"


def test_run_manifest(spark):
    import hashlib

    sha = hashlib.sha256(b"judge this").hexdigest()
    side = spark.createDataFrame([("a", 1, "2024-01-02", sha, "r/a", 42), ("a", 2, "not recorded", sha, "r/a", 42), ("b", 1, "2024-01-05", sha, "r/b", 42)], SIDECARS)
    master = spark.createDataFrame([(1, "x", "subjective", None), (2, "x", None, "objective"), (2, "y", "odd", "objective")], "id long, source string, judge_a_subjectivity string, judge_b_subjectivity string")
    build = lambda s, prompt="judge this": manifest.run_manifest(master, s, ["a", "b"], ["repo"], ["seed"], prompt, ["source"], {"judge_a_subjectivity": ["subjective"], "source": ["x", "y"]}, {"version": "1.2"})
    m = build(side)
    assert m["roster"] == {"a": {"repo": "r/a"}, "b": {"repo": "r/b"}} and m["decoding"] == {"seed": 42}
    assert m["prompt"] == {"sha256": sha, "words": 2} and m["run_dates"]["a"] == {"first": "2024-01-02", "last": "2024-01-02"}
    assert m["counts"] == {"rows": 3, "ids": 2, "verdicts": {"a": 2, "b": 2}, "decisions": 4, "by": {"source": {"x": 2, "y": 1}}}
    assert m["types"]["judge_b_subjectivity"] == "null|string" and m["values"]["source"]["unexpected"] == []
    assert {r["value"] for r in m["values"]["judge_a_subjectivity"]["unexpected"]} == {None, "odd"}
    with pytest.raises(ValueError, match="hash"):
        build(side, "another")
    with pytest.raises(ValueError, match="a: repo has 2 values"):
        build(side.withColumn("repo", F.concat("repo", F.col("chunk").cast("string"))))
    with pytest.raises(ValueError, match="all: seed has 3 values"):
        build(side.withColumn("seed", F.hash("judge", "chunk")))


def test_report_holds_all_rows(spark):
    import json

    df = spark.range(3).withColumn("p", F.lit(0.5))
    text, machine = manifest.report("R", [("One", "words", df), ("Two", "only words", None)])
    assert "# R" in text and "| 2 | 0.5000 |" in text and json.loads(machine)["sections"]["One"]["rows"][2] == {"id": 2, "p": 0.5}
    with pytest.raises(ValueError, match="more than 2 rows"):
        manifest.markdown_table(df, most=2)


def test_revisions(spark):
    found = manifest.resolved_revisions(spark, {"a": "r/a", "b": "r/b", "c": "r/c"}, lambda repo: ("new", "2024-05-01T00:00:00" if repo != "r/c" else "2024-03-01"))
    runs = spark.createDataFrame([("a", "old", "2024-04-01"), ("b", None, "2024-04-01"), ("c", None, "2024-04-01")], "judge string, revision string, run_date string")
    assert {tuple(r) for r in manifest.revision_drift(runs, found).collect()} == {("a", "old", "new"), ("b", None, "new")}
    with pytest.raises(RuntimeError, match="a: no revision of r/a"):
        manifest.resolved_revisions(spark, {"a": "r/a"}, lambda repo: 1 / 0)


def test_identifiability_text(spark):
    ratios = spark.createDataFrame([(0, 1.0, 0.2, 0.2), (3, 4.5, 0.45, 0.1)], "label int, ratio double, share double, raw double")
    assert "label 3 is given 4.5 times" in manifest.identifiability(ratios, "m") and "45.0% against 10.0%" in manifest.identifiability(ratios, "m")
    assert "no label" in manifest.identifiability(ratios.where("label = 0"), "m")


def test_chunks_are_ranked_over_all_ranges_of_a_cell(spark):
    """One cell of nearly all rows, a cell of null: as ranked by one sorted list."""
    import hashlib

    rows = [(i, "hot" if i % 50 else None, i * 2) for i in range(3_000)]
    df = spark.createDataFrame(rows, "id long, cell string, chunk long")
    got = {r["id"]: r["chunk"] for r in sample.chunks(df, ["cell"], 7, 5).collect()}
    assert len(got) == 3_000
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    for cell in ("hot", None):
        ids = sorted((i for i, c, _ in rows if c == cell), key=lambda i: (md5(f"{i}:5"), i))
        shift = int(md5(f"{cell or ''}:5")[:6], 16)
        assert [got[i] for i in ids] == [(n + shift) % 7 + 1 for n in range(len(ids))]


def test_failed_judges_preparation_and_order(spark):
    df = spark.createDataFrame([(0.0, "error: x"), (0.0, "fine"), (0.5, "unparseable")], "c double, r string")
    assert [r[0] for r in df.select(enrich.lid_failed(F.col("c"), F.col("r"))).collect()] == [True, False, False]
    text = spark.createDataFrame([("<b>a</b>\nwww.x.y  b",)], "t string")
    ways = text.select(*[T.prepared(F.col("t"), m).alias(m) for m in ("none", "pii", "pii_flat", "all")]).first().asDict()
    assert ways == {"none": "<b>a</b>\nwww.x.y  b", "pii": "<b>a</b>\n   b", "pii_flat": "<b>a</b> b", "all": "a b"}
    with pytest.raises(ValueError):
        T.prepared(F.col("t"), "other")
    lists = spark.createDataFrame([(["b", "a", "b"],)], "l array<string>")
    assert lists.select(dedup.ordered_unique(F.col("l"))).first()[0] == ["b", "a"]
    ids = spark.createDataFrame([(1,), (2,)], "id long")
    assert [r["id"] for r in dedup.resume(ids, ids.where("id = 1")).collect()] == [2]
