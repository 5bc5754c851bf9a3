"""Exact quantiles by selection against numpy, and both ways of the breakdown against each other."""

import math

import numpy as np
import pytest

from corpusloom.operators import quantiles, votes

SHARES = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}


def test_quantiles_like_numpy(spark):
    draw = np.random.default_rng(6)
    values = {"even": draw.random(3000), "steep": 10.0 ** draw.uniform(-4, 4, 500), "ties": draw.integers(0, 3, 400).astype(float), "one": np.array([2.5]), None: draw.normal(size=101), "wide": np.array([-1.7e308, 1.7e308, 0.0, -0.0, 5e-324])}
    rows = [(g, float(x)) for g, xs in values.items() for x in xs] + [("even", None), ("nothing", None)]
    got = {r["g"]: r for r in quantiles.exact_quantiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", SHARES, bins=64, few=30).collect()}
    assert set(got) == set(values)
    for g, xs in values.items():
        for name, q in SHARES.items():
            if g != "wide" or q in (0.0, 0.5, 1.0):  # numpy's difference of neighbours overflows there
                assert got[g][name] == pytest.approx(float(np.quantile(xs, q)), rel=1e-12, abs=1e-300), (g, name)


def test_weights_nan_and_infinities(spark):
    rows = [("w", 1.0, 3), ("w", 2.0, 1), ("w", 9.0, 0), ("n", 1.0, 1), ("n", math.inf, 1), ("n", math.nan, 1), ("n", -math.inf, 1), ("n", 3.0, 1)]
    got = {r["g"]: r for r in quantiles.exact_quantiles(spark.createDataFrame(rows, "g string, x double, w int"), ["g"], "x", {"low": 0.0, "mid": 0.5, "high": 0.75, "top": 1.0}, "w").collect()}
    assert (got["w"]["low"], got["w"]["mid"], got["w"]["top"]) == (1.0, 1.0, 2.0)
    assert (got["n"]["low"], got["n"]["mid"], got["n"]["high"]) == (-math.inf, 3.0, math.inf) and math.isnan(got["n"]["top"])
    assert quantiles.exact_quantiles(spark.createDataFrame([], "g string, x double"), ["g"], "x", SHARES).count() == 0


def test_breakdown_both_ways(spark):
    draw = np.random.default_rng(7)
    rows = [(str(draw.integers(3)), None if i % 9 == 0 else str(draw.integers(5)), float(draw.random() * 1.6)) for i in range(800)]
    df = spark.createDataFrame(rows, "register string, source string, entropy double")
    one, two = (sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in votes.breakdown(df, ["register", "source"], most_values=m).collect()), key=str) for m in (10_000, 5))
    assert one == two and len(one) == 9
