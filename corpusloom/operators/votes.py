"""Votes of judges in long form: id, judge (0..J-1), vote (0..K-1), confidence; a missing vote is an absent row.

All statistics are conditional sums over votes or over items' vote counts: one shuffle on id, pre-aggregated, and then
costs that do not depend on the number of items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import exact_quantiles

# Label order (also the order of ties) and judges.
LABELS = ["objective", "positive", "negative", "neutral", "mixed"]
JUDGES = ["aya", "gemma", "llama", "mistral", "qwen"]


def label_of(subjectivity: Column, polarity: Column) -> Column:
    """Five-class label; null without a verdict."""
    return F.when(subjectivity.isNull(), F.lit(None).cast("string")).when(subjectivity == "objective", "objective").otherwise(polarity)


def label_index(label: Column, labels: list[str] | None = None) -> Column:
    """Position in label order; null if unknown."""
    return F.nullif(F.array_position(F.array(*map(F.lit, labels or LABELS)), label), F.lit(0).cast("long")).cast("int") - 1


def long_votes(master: DataFrame, judges: list[str] | None = None) -> DataFrame:
    """From the flat master (judge_<name>_<field>): one row per cast vote."""
    each = [F.struct(F.lit(i).alias("judge"), label_index(label_of(F.col(f"judge_{j}_subjectivity"), F.col(f"judge_{j}_polarity"))).alias("vote"), F.col(f"judge_{j}_confidence").alias("confidence")) for i, j in enumerate(judges or JUDGES)]
    return master.select("id", F.explode(F.array(*each)).alias("v")).select("id", "v.*").where("vote is not null")


def wide_votes(votes: DataFrame, n_judges: int = 5) -> DataFrame:
    return votes.groupBy("id").agg(*[F.max(F.when(F.col("judge") == j, F.col("vote"))).alias(f"vote_{j}") for j in range(n_judges)])


def reduced(votes: DataFrame, dropped: int) -> DataFrame:
    """A label less: votes for it become missing."""
    return votes.where(F.col("vote") != dropped)


def raw_frequency(votes: DataFrame, n_labels: int = 5) -> DataFrame:
    """label, n, share of votes cast, for every label."""
    n = votes.agg(*[F.count_if(F.col("vote") == k).alias(str(k)) for k in range(n_labels)], F.count("*").alias("all"))
    rows = F.array(*[F.struct(F.lit(k).alias("label"), F.col(str(k)).alias("n")) for k in range(n_labels)])
    return n.select(F.explode(rows).alias("r"), "all").select("r.label", "r.n", (F.col("r.n") / F.col("all")).alias("share"))


def counted(items: DataFrame, votes: DataFrame, n_labels: int = 5) -> DataFrame:
    """id, counts array<long> per label, n_votes; items without a vote have zeros."""
    own = votes.groupBy("id").agg(*[F.count_if(F.col("vote") == k).alias(f"c{k}") for k in range(n_labels)])
    zero = F.lit(0).cast("long")
    out = items.select("id").join(own, "id", "left").select("id", F.array(*[F.coalesce(f"c{k}", zero) for k in range(n_labels)]).alias("counts"))
    return out.withColumn("n_votes", F.aggregate("counts", zero, lambda t, x: t + x))


def majority(items: DataFrame, votes: DataFrame, n_labels: int = 5) -> DataFrame:
    """id, label, tie, p_0..p_K-1. The first label in order wins a tie; without a vote label 0, zero posteriors, a tie."""
    c = counted(items, votes, n_labels)
    top = F.array_max("counts")
    posteriors = [(F.get("counts", F.lit(k)) / F.greatest("n_votes", F.lit(1))).alias(f"p_{k}") for k in range(n_labels)]
    return c.select("id", (F.array_position("counts", top) - 1).cast("int").alias("label"), (F.size(F.filter("counts", lambda x: x == top)) > 1).alias("tie"), *posteriors)


def unanimous(votes: DataFrame) -> DataFrame:
    """id, label of items with two votes or more, all equal."""
    return votes.groupBy("id").agg(F.count("*").alias("n"), F.min("vote").alias("label"), F.max("vote").alias("hi")).where("n >= 2 and label = hi").select("id", "label")


def unanimity_check(labels: DataFrame, votes: DataFrame) -> DataFrame:
    """One row: n_unanimous, violations, rate: unanimous items that a method labels otherwise."""
    both = unanimous(votes).join(labels.select("id", F.col("label").alias("given")), "id")
    n, bad = F.count("*"), F.count_if(F.col("label") != F.col("given"))
    return both.agg(n.alias("n_unanimous"), bad.alias("violations"), F.when(n == 0, 0.0).otherwise(bad / F.greatest(n, F.lit(1))).alias("rate"))


def unanimity_examples(labels: DataFrame, votes: DataFrame, most: int = 10) -> DataFrame:
    both = unanimous(votes).join(labels.select("id", F.col("label").alias("given")), "id")
    return both.where("label != given").orderBy("id").limit(most)


def class_ratio(labels: DataFrame, votes: DataFrame, n_labels: int = 5, most: float = 3.0) -> DataFrame:
    """label, share, raw share, ratio, ok. No raw vote: infinite if the label is given, else 1."""
    raw = raw_frequency(votes, n_labels).select("label", F.col("share").alias("raw"))
    total = labels.agg(F.count("*").alias("total"))
    share = raw.join(labels.groupBy("label").agg(F.count("*").alias("n")), "label", "left").crossJoin(total)
    share = share.select("label", (F.coalesce("n", F.lit(0)) / F.greatest("total", F.lit(1))).alias("share"), "raw")
    ratio = F.when(F.col("raw") > 0, F.try_divide("share", "raw")).when(F.col("share") > 0, F.lit(float("inf"))).otherwise(1.0)
    return share.withColumn("ratio", ratio).withColumn("ok", F.col("ratio") <= most)


def pairwise_agreement(votes: DataFrame, n_judges: int = 5) -> DataFrame:
    """judge_a < judge_b, n items both voted on, agreement (null if none): conditional sums, no self join."""
    wide = wide_votes(votes, n_judges)
    pairs = [(a, b) for a in range(n_judges) for b in range(a + 1, n_judges)]
    sums = [x for a, b in pairs for x in (F.count_if(F.col(f"vote_{a}").isNotNull() & F.col(f"vote_{b}").isNotNull()).alias(f"n_{a}_{b}"), F.count_if(F.col(f"vote_{a}") == F.col(f"vote_{b}")).alias(f"s_{a}_{b}"))]
    rows = F.array(*[F.struct(F.lit(a).alias("judge_a"), F.lit(b).alias("judge_b"), F.col(f"n_{a}_{b}").alias("n"), F.col(f"s_{a}_{b}").alias("same")) for a, b in pairs])
    return wide.agg(*sums).select(F.explode(rows).alias("r")).select("r.judge_a", "r.judge_b", "r.n", F.try_divide("r.same", "r.n").alias("agreement"))


def label_agreement(labelled: DataFrame, methods: list[str]) -> DataFrame:
    """method_a, method_b, share of items with equal labels; labelled: one column per method."""
    pairs = [(a, b) for i, a in enumerate(methods) for b in methods[i + 1 :]]
    sums = labelled.agg(*[F.avg((F.col(a) == F.col(b)).cast("double")).alias(f"{a}|{b}") for a, b in pairs])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(a).alias("method_a"), F.lit(b).alias("method_b"), F.col(f"{a}|{b}").alias("agreement")) for a, b in pairs])).alias("r")).select("r.*")


def fleiss_kappa(votes: DataFrame, n_labels: int = 5) -> DataFrame:
    """One row: n_items, p_bar, p_e, kappa, with varying numbers of raters; null where chance agreement is certain."""
    c = votes.groupBy("id").agg(F.count("*").alias("n"), *[F.count_if(F.col("vote") == k).alias(f"c{k}") for k in range(n_labels)]).where("n >= 2")
    squares = sum((F.col(f"c{k}") * F.col(f"c{k}") for k in range(n_labels)), F.lit(0))
    sums = c.agg(F.count("*").alias("n_items"), F.avg((squares - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("p_bar"), F.sum("n").alias("cast"), *[F.sum(f"c{k}").alias(f"s{k}") for k in range(n_labels)])
    p_e = sum((F.pow(F.try_divide(f"s{k}", "cast"), 2) for k in range(n_labels)), F.lit(0.0))
    out = sums.select("n_items", "p_bar", p_e.alias("p_e"))
    return out.withColumn("kappa", F.when(F.col("p_e") < 1, (F.col("p_bar") - F.col("p_e")) / (1 - F.col("p_e"))))


def krippendorff_alpha(votes: DataFrame, n_labels: int = 5) -> DataFrame:
    """One row: nominal alpha over items with two votes or more, from the coincidence matrix's closed form."""
    c = votes.groupBy("id").agg(F.count("*").alias("m"), *[F.count_if(F.col("vote") == k).alias(f"c{k}") for k in range(n_labels)]).where("m >= 2")
    unlike = sum((F.col(f"c{k}") * (F.col("m") - F.col(f"c{k}")) for k in range(n_labels)), F.lit(0))
    sums = c.agg(F.sum("m").alias("n"), F.sum(unlike / (F.col("m") - 1)).alias("observed"), *[F.sum(f"c{k}").alias(f"s{k}") for k in range(n_labels)])
    expected = sum((F.col(f"s{k}") * (F.col("n") - F.col(f"s{k}")) for k in range(n_labels)), F.lit(0))
    return sums.select("n", F.when(expected > 0, 1 - (F.col("n") - 1) * F.col("observed") / expected).alias("alpha"))


#: Upper edges of the ten bins but the last, as binary doubles: multiples of a tenth are not all exact.
EDGES = [0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9]


def confidence_bin(confidence: Column) -> Column:
    """Right-closed bins 0..9; the first holds 0 as well."""
    return F.size(F.filter(F.array(*map(F.lit, EDGES)), lambda e: confidence > e))


def calibration(votes: DataFrame, labels: DataFrame) -> DataFrame:
    """judge, n, mean_confidence, share_90, share_95, agreement, ece, brier against a consensus (id, label)."""
    right = F.when(F.col("vote") == F.col("label"), 1.0).otherwise(0.0)
    rows = votes.join(labels.select("id", "label"), "id").select("judge", "confidence", right.alias("right"), confidence_bin(F.col("confidence")).alias("bin"))
    bins = rows.groupBy("judge", "bin").agg(F.count("*").alias("n"), F.sum("confidence").alias("conf"), F.sum("right").alias("right"), F.sum(F.pow(F.col("confidence") - F.col("right"), 2)).alias("sq"), F.count_if(F.col("confidence") >= 0.9).alias("n90"), F.count_if(F.col("confidence") >= 0.95).alias("n95"))
    total = F.sum("n")
    return bins.groupBy("judge").agg(total.alias("n"), (F.sum("conf") / total).alias("mean_confidence"), (F.sum("n90") / total).alias("share_90"), (F.sum("n95") / total).alias("share_95"), (F.sum("right") / total).alias("agreement"), (F.sum(F.abs(F.col("right") - F.col("conf"))) / total).alias("ece"), (F.sum("sq") / total).alias("brier"))


def repaired_posteriors(items: DataFrame, long: DataFrame, n_labels: int = 5) -> DataFrame:
    """id, p_0..p_K-1 for every item from rows id, label, p: what is missing counts as 0, nothing at all as uniform, sums are 1."""
    wide = long.groupBy("id").agg(*[F.sum(F.when(F.col("label") == k, F.col("p"))).alias(f"p_{k}") for k in range(n_labels)])
    full = items.select("id").join(wide, "id", "left").select("id", *[F.coalesce(f"p_{k}", F.lit(0.0)).alias(f"p_{k}") for k in range(n_labels)])
    total = sum((F.col(f"p_{k}") for k in range(n_labels)), F.lit(0.0))
    return full.select("id", *[F.when(total > 0, F.try_divide(F.col(f"p_{k}"), total)).otherwise(1 / n_labels).alias(f"p_{k}") for k in range(n_labels)])


def entropy(posteriors: list[Column]) -> Column:
    """Natural entropy of a row's posteriors."""
    return -sum((F.when(p > 0, p * F.log(F.greatest(p, F.lit(1e-300)))).otherwise(0.0) for p in posteriors[1:]), F.when(posteriors[0] > 0, posteriors[0] * F.log(F.greatest(posteriors[0], F.lit(1e-300)))).otherwise(0.0))


QUARTILES = {"p25": 0.25, "median": 0.5, "p75": 0.75}
#: Distinct values that an aggregation buffer may hold; quantiles of more are found by selection.
MOST_VALUES = 100_000


def describe(x: str) -> list[Column]:
    """Mean, population deviation, shares below 0.3 and above 0.7."""
    return [F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.avg((F.col(x) < 0.3).cast("double")).alias("below_03"), F.avg((F.col(x) > 0.7).cast("double")).alias("above_07")]


def breakdown(items: DataFrame, dims: list[str], x: str = "entropy", most_values: int = MOST_VALUES) -> DataFrame:
    """dimension, value, n and description of x, per value of each dimension and overall, in one pass of grouping sets.

    Quartiles are exact. Entropies of few raters take few values, which a buffer of counts per value holds; where there are
    more than most_values they are selected in rounds, and no task holds the values of a dimension."""
    few = items.select(x).distinct().limit(most_values + 1).count() <= most_values
    quartiles = [F.percentile(x, F.lit(q)).alias(name) for name, q in QUARTILES.items()] if few else []
    sets = items.groupingSets([[F.col(d)] for d in dims] + [[]], *dims).agg(F.grouping_id().alias("g"), F.count("*").alias("n"), *describe(x), *quartiles)
    full = (1 << len(dims)) - 1
    name = F.when(F.col("g") == full, "overall")
    value = F.when(F.col("g") == full, "all")
    for i, d in enumerate(dims):
        only = full & ~(1 << (len(dims) - 1 - i))
        name, value = name.when(F.col("g") == only, d), value.when(F.col("g") == only, F.col(d))
    out = sets.select(name.alias("dimension"), value.alias("value"), "n", "mean", "std", "below_03", "above_07", *(QUARTILES if few else [])).where("value is not null")
    if not few:
        each = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims], F.struct(F.lit("overall").alias("dimension"), F.lit("all").alias("value")))
        counted = items.groupBy(*dims, x).agg(F.count("*").alias("w"))  # before the rows are multiplied
        long = counted.select(F.explode(each).alias("d"), x, "w").select("d.dimension", "d.value", x, "w").where("value is not null")
        out = out.join(exact_quantiles(long, ["dimension", "value"], x, QUARTILES, "w"), ["dimension", "value"], "left")
    return out.select("dimension", "value", "n", "mean", "median", "std", "p25", "p75", "below_03", "above_07")
