"""Steps of the passages that work on many pairs or windows at once, against the plain ones."""

import numpy as np
import pyarrow as pa

from corpusloom.llm import passages as P


def texts(rng, n):
    """Pairs of texts: edited copies, moved and repeated parts, repeated sentences, short ones."""
    for k in range(n):
        a = rng.integers(0, 1 << 32, int(rng.integers(60, 400)), dtype=np.uint64)
        if k % 4 == 1:
            a = np.tile(a[: int(rng.integers(3, 30))], 20)[: len(a)]
        b = a.copy()
        for at in rng.integers(0, len(b), int(rng.integers(0, 8))):
            b[at] = rng.integers(0, 1 << 32)
        cut = int(rng.integers(0, len(b)))
        b = (b, np.concatenate([b[cut:], b[:cut]]), np.concatenate([b[cut:], b, b[:40]]), b[: int(rng.integers(0, 8))])[int(rng.integers(0, 4))]
        where = {}
        for j, w in enumerate(b.tolist()):
            where.setdefault(w, []).append(j)
        every = [(i, j) for i, w in enumerate(a.tolist()) for j in where.get(w, ())]
        seeds = sorted(every[i] for i in rng.choice(len(every), min(len(every), 12), replace=False)) if every else []
        yield a, b, [*seeds, (len(a) + 3, 0)]


def test_pairs_compared_at_once_give_what_each_gives_alone():
    rng = np.random.default_rng(3)
    rows = list(texts(rng, 400))
    lists = [pa.array([x[k].astype(np.uint32).view(np.int32).tolist() for x in rows], pa.list_(pa.int32())) for k in (0, 1)]
    seeds = pa.array([[{"a": i, "b": j} for i, j in x[2]] for x in rows], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
    want = []
    for k, (a, b, own) in enumerate(rows):
        if len(b) >= P.SHINGLE:
            want += [(k, *f, np.array_equal(a[f[0] : f[1]], b[f[2] : f[3]])) for f in P.alike(a, b, own, 50, 80)]
    assert len(want) > 200
    assert sorted(P.alike_all(*lists, seeds, 50, 80)) == sorted(want)
    assert sorted(P.alike_all(*(x.slice(100, 50) for x in (*lists, seeds)), 50, 80)) == sorted((k - 100, *f) for k, *f in want if 100 <= k < 150)


def test_a_short_text_that_shares_its_id(spark):
    """Three words under the doc_id of a long text: compared with what meets the long one."""
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(1, long), (1, "w1 w2 w3"), (2, long + " end"), (2, "one two three")]
    found = P.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["first_word"], r["last_word"], r["of_doc_id"]) for r in found} == {(2, 0, 80, 1)}


def keyed(rng, slices=6, rows=3000, keys=500):
    for k in range(slices):
        yield rng.integers(0, keys, rows).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), rng.integers(0, 40, rows) + 20 * k + (1 << 33) * (k > 3), rng.integers(1, 1 << (34 if k == 2 else 20), rows)


def stars(found):
    """Every window with the first of its key in its slice, and those with the first of all."""
    want, firsts = set(), {}
    for key, doc, place in found:
        rows = sorted(set(zip(key.tolist(), doc.tolist(), place.tolist(), strict=True)))
        least = {}
        for k, d, p in rows:
            first = least.setdefault(k, (d, p))
            if d == first[0]:
                firsts.setdefault(k, []).append((d, p))
            else:
                want.add((d, k))
    met = set()
    for k, own in firsts.items():
        b, q = min(own)
        met |= {(d, b, p, q) for d, p in own if (d, p) != (b, q)}
    return want, met


def test_windows_meet_the_first_of_their_key(spark, monkeypatch):
    found = list(keyed(np.random.default_rng(5)))
    batches = [x for one in found for x in P._starred([one])]
    rows = spark.createDataFrame(pa.Table.from_batches(batches)).selectExpr("seat", "least", "n", "key", "doc_id", "place", "b", "place_b")
    within, across = stars(found)
    got = {tuple(r) for r in P.window_pairs(rows).collect()}
    assert across <= got
    assert {a for a, *_ in got - across} <= {d for d, _ in within}
    assert sum(map(len, (x.to_pylist() for x in (b.column("seat") for b in batches)))) < sum(len(x[0]) for x in found)  # rows are shares, not windows


def test_a_seat_that_is_too_large_is_paired_in_parts(spark, monkeypatch):
    """Beyond the rows that a task holds, every window still meets an earlier document, or an earlier place, of its key."""
    rng = np.random.default_rng(6)
    found = [(np.full(400, 7, np.uint64), np.full(400, 100 - k), np.arange(400)) for k in range(12)] + [(rng.integers(0, 9, 50).astype(np.uint64), np.full(50, 500), np.arange(50))]
    rows = spark.createDataFrame(pa.Table.from_batches([x for one in found for x in P._starred([one])]))
    whole = {tuple(r) for r in P.window_pairs(rows).collect()}
    held = P._SEAT_ROWS
    try:
        P._SEAT_ROWS = 1000
        parts = {tuple(r) for r in P.window_pairs(rows).collect()}
    finally:
        P._SEAT_ROWS = held
    assert {(a, p) for a, _, p, _ in parts} >= {(a, p) for a, _, p, _ in whole} and all((b, q) < (a, p) for a, b, p, q in parts)
