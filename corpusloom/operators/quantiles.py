"""Exact quantiles without a buffer of values: distributed selection.

Per group and wanted rank a range is kept that holds the value of that rank. A round counts the values of each range in
equal bins, pre-aggregated, and narrows the range to the least and greatest value of the bin where the rank falls; only
values within ranges go on to the next round. A range of one value is the answer; one of few values is ranked value by value. Bins are monotonous in the value, so no
rounding can misplace one. Rounds depend on how uneven the values are, not on how many there are: three digits a round, of
what spread is left.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written

#: Bins a round, and distinct values of a range that are ranked as they are.
BINS, FEW = 1024, 10_000


def _same(a: str, b: str, names: list[str]) -> Column:
    return reduce(Column.__and__, [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names])


def exact_quantiles(rows: DataFrame, groups: list[str], x: str, shares: dict[str, float], weight: str | None = None, bins: int = BINS, few: int = FEW) -> DataFrame:
    """groups and one column per name of `shares`: the quantile at that share, linear between neighbours as numpy's default.

    weight: how many times a row counts, a whole number. Null values do not count; a group without values is not there; a
    null group is a group. NaN counts as greater than all and gives NaN where it takes part."""
    keys = [f"g{i}" for i in range(len(groups))]
    values = rows.where(F.col(x).isNotNull()).select(*[F.col(g).alias(k) for g, k in zip(groups, keys, strict=True)], F.col(x).cast("double").alias("x"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("w"))
    values = written(values.where("w > 0").groupBy(*keys, "x").agg(F.sum("w").alias("w")), "values")
    sized = written(values.groupBy(*keys).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("w").alias("n")), "sized")
    at = {name: F.lit(share) * (F.col("n") - 1) for name, share in shares.items()}
    ranks = F.explode(F.array_distinct(F.array(*[f(p).cast("long") for p in at.values() for f in (F.floor, F.ceil)]))).alias("rank")
    wanted = written(sized.select(*keys, "lo", "hi", F.lit(0).cast("long").alias("before"), ranks), "wanted")
    found, left = [], values
    while True:
        found.append(wanted.where("lo = hi").select(*keys, "rank", F.col("lo").alias("value")))
        wanted = wanted.where("lo < hi")
        if wanted.isEmpty():
            break
        ranges = wanted.select(*keys, "lo", "hi", "before").distinct()
        inside = left.alias("v").join(ranges.alias("r"), _same("v", "r", keys) & F.col("x").between(F.col("lo"), F.col("hi"))).select(*[F.col(f"v.{k}") for k in keys], "lo", "hi", "before", "x", "w")
        inside = written(inside, "inside")
        held = inside.groupBy(*keys, "lo", "hi").agg((F.count("*") <= few).alias("few"))
        sorted_out = inside.alias("v").join(held.alias("r"), _same("v", "r", [*keys, "lo", "hi"])).select("v.*", "few")
        # halves, as the whole width of doubles does not fit a double; NaN and infinities are bins of their own
        part = F.try_divide(F.col("x") / 2 - F.col("lo") / 2, F.col("hi") / 2 - F.col("lo") / 2)
        part = F.coalesce(part, (F.col("x") > F.col("lo")).cast("double"))  # neighbours among the least doubles
        endless = F.lit(float("inf"))
        bin_ = F.when(F.isnan("x"), bins + 1).when(F.col("x") == endless, bins).when(F.col("x") == -endless, -2).when(F.isnan("hi") | (F.col("hi") == endless) | (F.col("lo") == -endless), -1).otherwise(F.least(F.floor(part * bins), F.lit(bins - 1)))
        bin_ = F.when(F.col("few"), F.col("x")).otherwise(bin_.cast("double"))
        counted = sorted_out.groupBy(*keys, "lo", "hi", "before", bin_.alias("bin")).agg(F.sum("w").alias("w"), F.min("x").alias("least"), F.max("x").alias("most"))
        upto = F.sum("w").over(Window.partitionBy(*keys, "lo", "hi").orderBy("least"))
        counted = counted.select(*keys, "lo", "hi", "least", "most", "w", (F.col("before") + upto - F.col("w")).alias("start"))
        hit = wanted.alias("v").join(counted.alias("r"), _same("v", "r", [*keys, "lo", "hi"]) & (F.col("v.rank") >= F.col("start")) & (F.col("v.rank") < F.col("start") + F.col("r.w")))
        wanted = written(hit.select(*[F.col(f"v.{k}") for k in keys], F.col("least").alias("lo"), F.col("most").alias("hi"), F.col("start").alias("before"), "v.rank"), "wanted")
        left = inside.groupBy(*keys, "x").agg(F.first("w").alias("w"))  # a value may lie in the ranges of two ranks
    of_rank = reduce(DataFrame.union, found).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("of_rank"))
    both = sized.alias("v").join(of_rank.alias("r"), _same("v", "r", keys)).select(*[F.col(f"v.{k}") for k in keys], "n", "of_rank")

    def value(p: Column) -> Column:
        low, high = F.col("of_rank")[F.floor(p).cast("long")], F.col("of_rank")[F.ceil(p).cast("long")]
        return F.when(low == high, low).otherwise(low + (high - low) * (p - F.floor(p)))

    return both.select(*[F.col(k).alias(g) for g, k in zip(groups, keys, strict=True)], *[value(p).alias(name) for name, p in at.items()])
