"""Judge shards: discovery checks, coverage, completeness, and the master table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ["subjectivity", "polarity", "confidence", "domain", "narrative_voice", "sentiment_target", "rationale"]


def with_origin(shards: DataFrame) -> DataFrame:
    """Adds judge and chunk from paths such as chunk_3/<judge>__<prompt>.jsonl."""
    path = F.input_file_name()
    return shards.withColumn("judge", F.regexp_extract(path, r"([^/]+?)__[^/]*$", 1)).withColumn("chunk", F.regexp_extract(path, r"chunk_(\d+)/", 1).cast("long"))


def doubled_shards(files: DataFrame) -> DataFrame:
    """judge, chunk, n of pairs that several files claim."""
    return files.groupBy("judge", "chunk").agg(F.countDistinct("file").alias("n")).where("n > 1")


def doubled_ids(shards: DataFrame) -> DataFrame:
    """judge, id, n, where: `shard` if one chunk holds an id twice, `chunks` if several do."""
    per = shards.groupBy("judge", "id").agg(F.count("*").alias("n"), F.countDistinct("chunk").alias("chunks"))
    return per.where("n > 1").select("judge", "id", "n", F.when(F.col("chunks") > 1, "chunks").otherwise("shard").alias("place"))


def chunk_coverage(shards: DataFrame, membership: DataFrame) -> DataFrame:
    """judge, chunk, missing, extra per judge and chunk that has a shard, against the chunk's ids."""
    present = shards.select("judge", "chunk").distinct()
    expected = present.join(membership.select("chunk", "id"), "chunk").withColumn("want", F.lit(1))
    found = shards.select("judge", "chunk", "id").distinct().withColumn("have", F.lit(1))
    both = expected.join(found, ["judge", "chunk", "id"], "full_outer")
    return both.groupBy("judge", "chunk").agg(F.count_if(F.col("have").isNull()).alias("missing"), F.count_if(F.col("want").isNull()).alias("extra"))


def inconsistent_configs(shards: DataFrame, config: list[Column]) -> DataFrame:
    """Judges whose rows carry more than one configuration."""
    return shards.groupBy("judge").agg(F.countDistinct(F.to_json(F.struct(*config))).alias("configs")).where("configs > 1")


def complete_chunks(shards: DataFrame) -> DataFrame:
    """Relational division: chunks for which every judge has delivered."""
    judges = shards.agg(F.countDistinct("judge").alias("judges"))
    return shards.groupBy("chunk").agg(F.countDistinct("judge").alias("n")).crossJoin(judges).where("n = judges").select("chunk", "n")  # one row on the right


def expected_grid(judges: DataFrame, chunks: DataFrame, found: DataFrame) -> DataFrame:
    """judge, chunk pairs without a sidecar. The grid is judges times chunks, both short lists."""
    return judges.select("judge").distinct().crossJoin(chunks.select("chunk").distinct()).join(found.select("judge", "chunk").distinct(), ["judge", "chunk"], "left_anti")


def with_chunk(corpus: DataFrame, membership: DataFrame, most: int = 20) -> DataFrame:
    """corpus with its chunk; an id without one is an error that names some of them."""
    chunk = membership.select("id", "chunk").distinct()
    lost = [r["id"] for r in corpus.select("id").join(chunk, "id", "left_anti").orderBy("id").limit(most).collect()]
    if lost:
        raise ValueError(f"ids without a chunk: {lost}")
    return corpus.join(chunk, "id")


def union_shards(shards: list[DataFrame]) -> DataFrame:
    """All shards of a judge as one table in order of id; a column that a shard lacks is null there."""
    first, *rest = shards
    for s in rest:
        first = first.unionByName(s, allowMissingColumns=True)
    return first.orderBy("id")


def master(corpus: DataFrame, shards: DataFrame, judges: list[str], fields: list[str] = FIELDS) -> DataFrame:
    """corpus with judge_<name>_<field> columns and n_judges: judges are pivoted in one aggregation and joined once."""
    one = lambda j, f: F.max(F.when(F.col("judge") == j, F.col(f))).alias(f"judge_{j}_{f}")
    wide = shards.groupBy("id").agg(F.countDistinct(F.when(F.col("judge").isin(judges), F.col("judge"))).alias("n_judges"), *[one(j, f) for j in judges for f in fields])
    return corpus.join(wide, "id", "left").withColumn("n_judges", F.coalesce("n_judges", F.lit(0).cast("long")))


def foreign_ids(shards: DataFrame, corpus: DataFrame) -> DataFrame:
    return shards.select("judge", "id").join(corpus.select("id"), "id", "left_anti")


def nested(flat: DataFrame, judges: list[str], fields: list[str] = FIELDS) -> DataFrame:
    """judges struct of structs instead of flat columns; null for a judge without a verdict."""
    own = lambda j: F.when(F.col(f"judge_{j}_{fields[0]}").isNotNull(), F.struct(*[F.col(f"judge_{j}_{f}").alias(f) for f in fields]))
    rest = [c for c in flat.columns if not c.startswith("judge_")]
    return flat.select(*rest, F.struct(*[own(j).alias(j) for j in judges]).alias("judges"))


def rescue(shards: DataFrame, parsed: Column) -> DataFrame:
    """Rows that failed get another parse: parsed is a reply struct of raw_response; adds rescued."""
    failed = F.coalesce("parse_failed", F.lit(False))
    out = shards.withColumn("__p", F.when(failed, parsed))
    ok = F.col("__p").isNotNull()
    fields = [F.when(ok, F.col(f"__p.{f}")).otherwise(F.col(f)).alias(f) for f in FIELDS]
    rest = [c for c in shards.columns if c not in (*FIELDS, "parse_failed", "raw_response")]
    return out.select(*rest, *fields, (failed & ~ok).alias("parse_failed"), F.when(~ok, F.col("raw_response")).alias("raw_response"), (failed & ok).alias("rescued"))


def rescue_counts(rescued: DataFrame) -> DataFrame:
    n, bad = F.count_if("rescued"), F.count_if("parse_failed")
    return rescued.agg(n.alias("recovered"), bad.alias("still_failed"), F.try_divide(n, n + bad).alias("rate"))


def signature(shards: DataFrame) -> DataFrame:
    """judge, chunk, n, subjectivity_pct, <polarity>_pct of subjective rows, mean_confidence; failed rows do not count."""
    ok = shards.where(~F.coalesce("parse_failed", F.lit(False))) if "parse_failed" in shards.columns else shards
    subjective = F.count_if(F.col("subjectivity") == "subjective")
    share = lambda p: (100 * F.try_divide(F.count_if((F.col("subjectivity") == "subjective") & (F.col("polarity") == p)), subjective)).alias(f"{p}_pct")
    return ok.groupBy("judge", "chunk").agg(F.count("*").alias("n"), (100 * subjective / F.count("*")).alias("subjectivity_pct"), *map(share, ("positive", "negative", "neutral", "mixed")), F.avg("confidence").alias("mean_confidence"))


def drift(signatures: DataFrame, a: int, b: int, points: float = 5.0) -> DataFrame:
    """judge, pct_a, pct_b, delta, drifted between two chunks."""
    at = lambda c: F.max(F.when(F.col("chunk") == c, F.col("subjectivity_pct")))
    both = signatures.groupBy("judge").agg(at(a).alias("pct_a"), at(b).alias("pct_b")).where("pct_a is not null and pct_b is not null")
    return both.withColumn("delta", F.col("pct_b") - F.col("pct_a")).withColumn("drifted", F.abs("delta") > points)


def confusion(rows: DataFrame, true: str, predicted: str) -> DataFrame:
    """true, predicted, n for every pair of a true class and a predicted one."""
    n = rows.groupBy(F.col(true).alias("true"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    grid = n.select("true").distinct().crossJoin(n.select("predicted").distinct())  # classes times classes
    return grid.join(n, ["true", "predicted"], "left").select("true", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def scores(rows: DataFrame, true: str, predicted: str) -> DataFrame:
    """class, support, precision, recall, f1 of true classes, rounded to 4, zero for zero denominators; accuracy."""
    cells = rows.groupBy(F.col(true).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    support = cells.groupBy(F.col("t").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).alias("hit"))
    given = cells.groupBy(F.col("p").alias("class")).agg(F.sum("n").alias("given"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = support.join(given, "class", "left").withColumn("precision", ratio(F.col("hit"), F.col("given"))).withColumn("recall", ratio(F.col("hit"), F.col("support")))
    out = out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    accuracy = cells.agg(F.coalesce(F.try_divide(F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)), F.sum("n")), F.lit(0.0)).alias("accuracy"))
    return out.crossJoin(accuracy).select("class", "support", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1", "accuracy")])  # one row on the right
