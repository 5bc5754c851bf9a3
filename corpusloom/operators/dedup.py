"""Duplicate removal, identifiers, and set proofs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .store import written


def corpus_dedup(rows: DataFrame, order: list[str], min_chars: int = T.MIN_CHARS, script: str = T.DEVANAGARI) -> DataFrame:
    """Greedy deduplication as one minimum per key.

    rows: id, cleaned_text, raw_text and the order columns. Adds clean_text, norm_key and reject_reason (null: kept), one of
    filtered_junk_or_short, title_chrome, exact_dupe, near_dupe. Right where id determines the text, as content ids do;
    strict_order_dedup holds without that.
    """
    return _decided(written(_prepared(rows, min_chars, script), "prepared"), order)


def _prepared(rows: DataFrame, min_chars: int, script: str) -> DataFrame:
    out = rows.withColumn("clean_text", T.first_text("cleaned_text", "raw_text"))
    for step in (T.strip_markup, T.strip_pii, T.squeezed, T.nfc):  # a step at a time: an expression within another is evaluated at each place it has there
        out = out.withColumn("clean_text", step(F.col("clean_text")))
    reason = F.when(T.gate_reason(F.col("clean_text"), min_chars, script).isNotNull(), "filtered_junk_or_short").when(T.is_title_chrome(F.col("clean_text")), "title_chrome")
    return out.withColumn("refused", reason).withColumn("norm_key", F.when(F.col("refused").isNull(), T.norm_key(F.col("clean_text"))))


def _decided(rows: DataFrame, order: list[str]) -> DataFrame:
    """The first row of each key is kept. Rows refused already are not compared; the first row per key is a pre-aggregated
    minimum, joined back by the key's 128-bit hash, so that a hot key can be split and no text is a key of a shuffle."""
    place = F.struct(*order)
    passed = rows.where("refused is null").withColumn("key_hash", F.md5("norm_key"))
    first = passed.groupBy("key_hash").agg(F.min(F.struct(place.alias("place"), F.col("id").alias("id"))).alias("first"))
    first = first.select("key_hash", F.col("first.place").alias("first_place"), F.col("first.id").alias("first_id"))
    judged = passed.join(first, "key_hash").withColumn("reject_reason", F.when(place == F.col("first_place"), F.lit(None).cast("string")).when(F.col("id").eqNullSafe(F.col("first_id")), "exact_dupe").otherwise("near_dupe"))
    refused = rows.where("refused is not null").withColumn("reject_reason", F.col("refused"))
    return judged.drop("key_hash", "first_place", "first_id").unionByName(refused).drop("refused")


#: Undecided rows that one task may decide by itself (some 100 bytes each); more go on in rounds.
FEW_ROWS = 200_000


def strict_order_dedup(rows: DataFrame, order: list[str], min_chars: int = T.MIN_CHARS, script: str = T.DEVANAGARI, few: int = FEW_ROWS) -> DataFrame:
    """The greedy rule itself, for foreign ids: ids and keys count only once a row that has them was kept.

    Parallel greedy selection: an undecided row is kept once it is the first undecided one of its id and of its key, and
    then all that share its id or key are decided. Firsts are pre-aggregated minima and only hashes take part, so a hot id
    or key is never gathered. A round decides at least the first row of every group; rounds grow with the longest chain
    in which each row waits for the one before. Once `few` rows or less wait, one task decides them in order.
    At most one row of an id is kept, so the reason of a refused row is its id's kept row, if that is earlier: exact_dupe.

    Rows of equal order go as they were stored; a null id is an id.
    """
    prepared = written(_prepared(rows, min_chars, script).withColumn("__n", F.monotonically_increasing_id()), "prepared")
    place = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col("__n").alias("n"))
    hashed = F.md5(F.coalesce(F.concat(F.lit("i"), F.col("id").cast("string")), F.lit(""))).alias("id_hash")
    judged = prepared.where("refused is null").select("*", hashed, F.md5("norm_key").alias("key_hash"), place.alias("__place"))
    waiting = written(judged.select("id_hash", "key_hash", F.col("__place").alias("place")), "waiting")
    kept: list[DataFrame] = []
    while waiting.limit(few + 1).count() > few:
        by_id = waiting.groupBy("id_hash").agg(F.min(F.struct("place", "key_hash")).alias("m")).select("id_hash", "m.key_hash", "m.place")
        by_key = waiting.groupBy("key_hash").agg(F.min(F.struct("place", "id_hash")).alias("m")).select("key_hash", "m.id_hash", "m.place")
        first = written(by_id.join(by_key, ["id_hash", "key_hash", "place"]), "first")
        kept.append(first)
        waiting = written(waiting.join(first.select("id_hash"), "id_hash", "left_anti").join(first.select("key_hash"), "key_hash", "left_anti"), "waiting")

    def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, keys = set(), set()
        for batch in batches:
            chosen = []
            for i, (a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if a not in ids and b not in keys:
                    ids.add(a)
                    keys.add(b)
                    chosen.append(i)
            yield batch.take(pa.array(chosen, pa.int64()))

    last = waiting.select("id_hash", "key_hash", "place").repartition(1).sortWithinPartitions("place").mapInArrow(in_order, waiting.select("id_hash", "key_hash", "place").schema)
    of_id = written(reduce(DataFrame.union, [f.select("id_hash", "place") for f in kept], last.select("id_hash", "place")), "kept").select(F.col("id_hash").alias("kept_id"), F.col("place").alias("kept_place"))
    reason = F.when(F.col("kept_place") == F.col("__place"), F.lit(None).cast("string")).when(F.col("kept_place") < F.col("__place"), "exact_dupe").otherwise("near_dupe")
    fields = [c for c in prepared.columns if c not in ("refused", "__n")]
    decided = judged.join(of_id, F.col("id_hash") == F.col("kept_id"), "left").withColumn("reject_reason", reason).select(*fields, "reject_reason")
    refused = prepared.where("refused is not null").withColumn("reject_reason", F.col("refused")).select(*fields, "reject_reason")
    return decided.unionByName(refused)


def not_yet_there(new: DataFrame, existing: DataFrame, key: str = "id") -> DataFrame:
    """Rows to append: one per key, none whose key is there already. Equal keys: any one row, as keys name contents."""
    return new.dropDuplicates([key]).join(existing.select(key).distinct(), key, "left_anti")


def coverage(expected: DataFrame, found: DataFrame, key: str = "id") -> DataFrame:
    """Keys of one side only: key, state missing or extra."""
    missing = expected.select(key).distinct().join(found.select(key).distinct(), key, "left_anti").select(key, F.lit("missing").alias("state"))
    extra = found.select(key).distinct().join(expected.select(key).distinct(), key, "left_anti").select(key, F.lit("extra").alias("state"))
    return missing.union(extra)


def partition_proof(parts: DataFrame, whole: DataFrame, key: str = "id", part: str = "chunk") -> DataFrame:
    """One row of counts, all zero if parts split whole: repeated keys, keys of several parts, missing, extra."""
    per_key = parts.groupBy(key).agg(F.count("*").alias("n"), F.countDistinct(part).alias("parts"))
    own = per_key.agg(F.coalesce(F.sum((F.col("n") > 1).cast("long")), F.lit(0)).alias("repeated"), F.coalesce(F.sum((F.col("parts") > 1).cast("long")), F.lit(0)).alias("overlapping"))
    sides = coverage(whole, parts, key).agg(F.count_if(F.col("state") == "missing").alias("missing"), F.count_if(F.col("state") == "extra").alias("extra"))
    return own.crossJoin(sides)  # one row each


def unexpected_values(df: DataFrame, column: str, expected: list[str]) -> DataFrame:
    """Values of a column that are not expected; null counts as a value."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).where(F.col("value").isNull() | ~F.col("value").isin(expected))


def ordered_unique(values: Column) -> Column:
    return F.array_distinct(values)


def resume(rows: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Rows without a finished result yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")
