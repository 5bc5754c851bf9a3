"""Texts that repeat one sentence: words beside runs are compared once a kind, with the result of comparing each."""

import numpy as np
import pyarrow as pa

from corpusloom.llm import passages as P


class Task:
    """Stands for a session and a table: hands out what rest_pairs maps over its partitions."""

    sparkSession = conf = property(lambda self: self)

    def get(self, *_):
        return "1"

    def repartition(self, *_):
        return self

    sortWithinPartitions = repartition

    def mapInArrow(self, function, schema):
        return function


def rows_beside(times=14):
    """Rows of one key, all free: 12 documents that repeat a sentence of 31 words, one word of which is their own."""
    draw, reach, out = np.random.default_rng(3), P._reach(50), []
    sentence = draw.integers(1, 1 << 30, 31)
    for doc in range(12):
        own = sentence.copy()
        own[28 - doc % 2] = 1000 + doc // 2
        text = np.tile(own, times)
        for at in range(0, times * 31 - P.NEAR, 31):
            low, high = max(0, at - reach), min(len(text), at + P.NEAR + reach)
            out.append((7, doc, at << 16 | 1, at - low, 0, high - low, text[low:high].astype(np.int32)))
    names = ["key", "doc_id", "place", "begin", "bare", "bare_end", "beside"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)


def pairs(batch):
    return [tuple(r.values()) for b in P.rest_pairs(Task(), 50, 80)(iter([batch])) for r in b.to_pylist()]


def test_equal_words_are_compared_once(monkeypatch):
    batch, calls, plain = rows_beside(), [], P.alike
    monkeypatch.setattr(P, "alike", lambda *a: calls.append(1) or plain(*a))
    found = pairs(batch)
    few = len(calls)
    pairs(rows_beside(28))
    assert len(calls) == 2 * few  # texts of twice the length, no comparison more
    monkeypatch.setattr(P, "_kind", lambda key, begin, around: np.arange(len(key), dtype=np.uint64))
    assert found and found == pairs(batch)
    assert len(calls) > 4 * few


def test_a_full_memory_changes_nothing(monkeypatch):
    batch = rows_beside()
    found = pairs(batch)
    monkeypatch.setattr(P, "_KNOWN", 3)
    assert pairs(batch) == found
