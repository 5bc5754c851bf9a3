"""Reproducible allocation and sampling: largest remainders, hash ranks, chunks, routing sets.

A draw is a rank by md5 of id and seed. So a sample is the same on every cluster and engine, and rows are ranked within
a cell by a window that keeps no more rows per task than the largest allocation asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_rank(key: Column | str, seed: str | int) -> Column:
    return F.md5(F.concat_ws(":", F.col(key) if isinstance(key, str) else key, F.lit(str(seed))))


def cell_key(cells: list[str]) -> Column:
    return F.concat_ws("|", *cells)


def allocate(rows: DataFrame, cells: list[str], target: int, seed: str | int | None = None) -> DataFrame:
    """Largest-remainder allocation of min(target, rows) over cells: cells, n, alloc. Ties of fractions go by cell, or
    with a seed by a hash of the cell. Only cell counts are in the global windows."""
    n = rows.groupBy(*cells).agg(F.count("*").alias("n"))
    all_ = Window.partitionBy()
    total = F.sum("n").over(all_)
    exact = F.col("n") * F.least(total, F.lit(target)) / total
    with_base = n.withColumn("exact", exact).withColumn("base", F.floor("exact")).withColumn("rest", F.least(total, F.lit(target)) - F.sum("base").over(all_))
    tie = [F.col(c) for c in cells] if seed is None else [hash_rank(cell_key(cells), seed), *map(F.col, cells)]
    ranked = with_base.withColumn("rank", F.row_number().over(Window.orderBy(F.round(F.col("exact") - F.col("base"), 9).desc(), *tie)))
    return ranked.select(*cells, "n", (F.col("base") + (F.col("rank") <= F.col("rest")).cast("long")).alias("alloc"))


def top_per_cell(rows: DataFrame, allocation: DataFrame, cells: list[str], order: list[Column], most: int) -> DataFrame:
    """The first alloc rows of each cell in the given order. most: no allocation is larger; it bounds what a task sends."""
    ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*cells).orderBy(*order))).where(F.col("__rank") <= most)
    alloc = allocation.select(*[F.col(c).alias(f"__{c}") for c in cells], F.col("alloc").alias("__alloc"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in cells]
    return ranked.join(alloc, same).where("__rank <= __alloc").select(*rows.columns)


def stratified_sample(rows: DataFrame, cells: list[str], target: int, seed: str | int = 42, key: str = "id") -> DataFrame:
    return top_per_cell(rows, allocate(rows, cells, target), cells, [hash_rank(key, seed), F.col(key)], target)


def with_minority(rows: DataFrame, sample: DataFrame, minority: Column, least: int, seed: str | int = 42, key: str = "id") -> DataFrame:
    """Swap rows of a sample until it holds `least` minority rows, as far as there are any: unused minority rows come in
    by hash rank, as many of the others go out by hash rank."""
    have = sample.agg(F.count_if(minority).alias("n")).first()["n"]
    order = [hash_rank(key, seed), F.col(key)]
    unused = rows.where(minority).join(sample.select(key), key, "left_anti").orderBy(*order).limit(max(0, least - have)) if have < least else None
    if unused is None:
        return sample
    deficit = unused.count()
    out = sample.where(~F.coalesce(minority, F.lit(False))).orderBy(*[order[0].desc(), order[1]]).limit(deficit).select(key)
    return sample.join(out, key, "left_anti").unionByName(unused.select(*sample.columns))


def calibration_sets(rows: DataFrame, strata: list[tuple[str, Column]], each: int, preferred: Column, seed: str | int = 42, key: str = "id") -> DataFrame:
    """Sequential draws: from each stratum `each` rows not used before, those of the preferred length first. Adds stratum."""
    used: DataFrame | None = None
    for name, condition in strata:
        free = rows.where(condition)
        if used is not None:
            free = free.join(used.select(key), key, "left_anti")
        drawn = free.orderBy((~preferred).cast("int"), hash_rank(key, seed), key).limit(each).withColumn("stratum", F.lit(name))
        used = drawn if used is None else used.unionByName(drawn)
    return used


def chunks(rows: DataFrame, cells: list[str], n: int, seed: str | int = 42, key: str = "id") -> DataFrame:
    """Adds chunk 1..n: every cell is dealt evenly, chunk sizes within a cell differ by one at most.

    Rank by hash within the cell, modulo n, shifted by a hash of the cell so that remainders do not pile up in chunk 1. A
    cell is ranked in 4,096 ranges of the hash, each from the number of rows before it, so a cell that holds most of the
    rows is no single task. Null is a cell of its own.
    """
    cell = F.to_json(F.struct(*[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(cells)]))
    ranged = rows.withColumn("__hash", hash_rank(key, seed)).withColumn("__cell", F.md5(cell)).withColumn("__range", F.substring("__hash", 1, 3))
    counts = ranged.groupBy("__cell", "__range").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy("__cell").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("__cell", "__range", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__cell", "__range").orderBy("__hash", key)) - 1
    shift = F.conv(F.substring(hash_rank(cell_key(cells), seed), 1, 6), 16, 10).cast("long")
    placed = ranged.withColumn("__own", own).join(before, ["__cell", "__range"])
    return placed.select(*[F.col(c) for c in rows.columns if c != "chunk"], (F.pmod(F.col("__before") + F.col("__own") + shift, F.lit(n)) + 1).cast("long").alias("chunk"))


def chunk_tolerance(chunked: DataFrame, fields: list[str], points: float = 1.0) -> DataFrame:
    """field, value, chunk, share in chunk, share in all, ok: whether shares differ by at most so many points."""
    long = chunked.select("chunk", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("s")).select("chunk", "s.*")
    per = long.groupBy("field", "value", "chunk").agg(F.count("*").alias("n"))
    sizes = chunked.groupBy("chunk").agg(F.count("*").alias("size"))
    grid = per.groupBy("field", "value").agg(F.sum("n").alias("all_n")).crossJoin(sizes)  # values times chunks, both small
    total = sizes.agg(F.sum("size").alias("total"))
    share = grid.join(per, ["field", "value", "chunk"], "left").crossJoin(total).select("field", "value", "chunk", (100 * F.coalesce("n", F.lit(0)) / F.col("size")).alias("pct"), (100 * F.col("all_n") / F.col("total")).alias("all_pct"))
    return share.select("field", "value", "chunk", F.round("pct", 6).alias("pct"), F.round("all_pct", 6).alias("all_pct"), (F.abs(F.col("pct") - F.col("all_pct")) <= points).alias("ok"))


def quota(rows: DataFrame, category: str, most: int, order: list[str]) -> DataFrame:
    """The first `most` rows of each category in order."""
    return rows.withColumn("__rank", F.row_number().over(Window.partitionBy(category).orderBy(*order))).where(F.col("__rank") <= most).drop("__rank")


def uniform(rows: DataFrame, n: int, seed: str | int = 42, key: str = "id") -> DataFrame:
    return rows.orderBy(hash_rank(key, seed), key).limit(n)


def routing_sets(items: DataFrame, cells: list[str], routed: int, control: int, random: int, reliability: int, seed: str | int = 42, key: str = "id", entropy: str = "entropy") -> dict[str, DataFrame]:
    """Disjoint sets routed (highest entropy per cell), control (lowest), random, and reliability, a part of routed."""
    pick = lambda rows, n, order: top_per_cell(rows, allocate(items, cells, n, seed), cells, [*order, F.col(key)], n)
    high = pick(items, routed, [F.col(entropy).desc()])
    rest = items.join(high.select(key), key, "left_anti")
    low = pick(rest, control, [F.col(entropy)])
    free = rest.join(low.select(key), key, "left_anti")
    return {"routed": high, "control": low, "random": uniform(free, random, seed, key), "reliability": uniform(high, reliability, seed, key)}


#: What an annotator may see, and what no column's name may hold.
BLIND_COLUMNS = ["id", "raw_text", "cleaned_text", "source_name", "register", "text_type", "script", "human_label"]
FORBIDDEN = ["posterior", "entropy", "rationale", "confidence", "judge_", "dawid", "mace", "glad", "majority"]


def assert_blind(df: DataFrame) -> DataFrame:
    bad = [c for c in df.columns if c not in BLIND_COLUMNS or any(x in c.lower() for x in FORBIDDEN)]
    missing = [c for c in BLIND_COLUMNS if c not in df.columns]
    if bad or missing:
        raise ValueError(f"not blind: {bad}; missing: {missing}")
    return df


def blinded_sheet(df: DataFrame) -> DataFrame:
    """The allowed columns and an empty one for the annotator."""
    return assert_blind(df.select(*[F.col(c) for c in BLIND_COLUMNS[:-1]], F.lit("").alias("human_label")))
