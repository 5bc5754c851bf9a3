"""The greedy rule with foreign ids against a loop, in rounds and in one task."""

import random

import pytest

from corpusloom.operators import dedup

GATE = "[A-Za-z]"


def by_loop(rows):
    ids, keys, out = set(), set(), {}
    for n, i, key in rows:
        out[n] = "exact_dupe" if i in ids else "near_dupe" if key in keys else None
        if out[n] is None:
            ids.add(i)
            keys.add(key)
    return out


def decided(spark, rows, few):
    df = spark.createDataFrame([(i, f"some words of key {key}", None, n) for n, i, key in rows], "id string, cleaned_text string, raw_text string, n long").repartition(3)
    return {r["n"]: r["reject_reason"] for r in dedup.strict_order_dedup(df, ["n"], 5, GATE, few=few).collect()}


@pytest.mark.parametrize("few", [0, 10_000])
def test_random_groups(spark, few):
    draw = random.Random(4)
    rows = [(n, draw.choice([None, *map(str, range(40))]), draw.randrange(60)) for n in range(300)]
    assert decided(spark, rows, few) == by_loop(rows)


def test_a_hot_key_and_a_hot_id_take_few_rounds(spark, monkeypatch):
    """Stars: everything shares a key, or an id, with the first row."""
    rows = [(0, "a", 0)] + [(n, f"b{n}", 0) for n in range(1, 3000)] + [(n, "a", n) for n in range(3000, 6000)]
    tables, plain = [], dedup.written
    monkeypatch.setattr(dedup, "written", lambda df, name: tables.append(name) or plain(df, name))
    assert decided(spark, rows, 0) == by_loop(rows)
    assert tables.count("first") == 1


def test_a_long_chain(spark):
    """Each row shares its id with the one before and its key with the one behind: rows wait for one another."""
    rows = [(n, str((n + 1) // 2), n // 2) for n in range(100_000)]
    assert decided(spark, rows, 200_000) == by_loop(rows)
