"""Source divergence, repeats by suffix arrays and conversation repair against brute force."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import dialogs, divergence, suffixes


def repeats_by_force(docs, width=50):
    first, texts = {}, [(i, (t or "").encode()) for i, t in docs]
    for i, b in texts:
        for p in range(len(b) - width + 1 if i is not None else 0):
            first[b[p : p + width]] = min(i, first.get(b[p : p + width], i))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1 if i is not None else 0):
            if first[b[p : p + width]] < i:
                gone[p : p + width] = b"\1" * width
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def quoting():
    """Texts cut from a few others, with multi-byte and zero characters, repeated ids and rows, nulls."""
    draw = random.Random(3)
    words = ["alpha", "beta é", "gam\0ma", "日本", "x", "delta " * 3]
    base = [" ".join(draw.choices(words, k=40)) for _ in range(6)]
    rows = []
    for i in range(200):
        b = draw.choice(base)
        a = draw.randrange(len(b))
        rows.append((draw.choice([i, i, i, i // 2, None]), b[a : a + draw.randrange(10, 140)] + draw.choice(words) + draw.choice(base)[draw.randrange(50) :][: draw.randrange(120)]))
    return [*rows, (5, None), (7, ""), (1000, rows[0][1]), rows[0]]


@pytest.mark.parametrize(("families", "batches"), [(None, 4), (3, 7)])
def test_repeats_against_brute_force(spark, quoting, families, batches):
    df = spark.createDataFrame([(i, t, 1, "d") for i, t in quoting], "doc_id long, text string, keys int, digest string").repartition(5)
    found = suffixes.repeats(df, families=families, batches=batches)
    assert sorted((tuple(r) for r in suffixes.digest(found).collect()), key=str) == repeats_by_force(quoting)
    left = sorted(((r["doc_id"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in suffixes.kept_bytes(df, found).collect()), key=str)
    assert left == sorted(((i, h) for i, *_, h in repeats_by_force(quoting)), key=str)


def test_repeats_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.digest(suffixes.repeats(none)).count() == 0


def test_runs_cross_chunks(monkeypatch):
    """Keys do not depend on where a chunk begins."""
    raw, ends = np.frombuffer(np.random.default_rng(1).integers(97, 100, 3000).astype(np.uint8).tobytes(), np.uint8), np.array([700, 700, 1900, 3000])
    each = lambda: {(p, int(k), int(t)) for a, b, k, t in zip(*suffixes.keyed(raw, ends, 50), strict=True) for p in range(a, b)}
    whole = each()
    monkeypatch.setattr(suffixes, "CHUNK", 128)
    assert each() == whole and len(whole) == 651 + 1151 + 1051


def test_levels_grow_geometrically():
    family, text = suffixes.Family(50), np.random.default_rng(2).integers(0, 256, 8000).astype(np.uint8)
    seen = set()
    for batch in range(16):
        part = text[(batch * 400) % 5000 :][:600]
        places = np.arange(len(part) - 49)
        grams = [part[p : p + 50].tobytes() for p in places]
        found = family.add(part, places, np.full(len(places), batch))
        assert found.tolist() == [g in seen for g in grams]
        seen.update(grams)
        sizes = [len(level.places) for level in family.levels]
        assert sum(sizes) == len(seen) and all(a > 2 * b for a, b in zip(sizes, sizes[1:], strict=False))


def divergence_by_force(rows, least, top):
    words, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in ((a or "", b or "", c or "") for a, b, c in rows):
        terms = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text)]
        groups.add((lang, source))
        words[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = [s for x, s in groups if x == lang]
        share = lambda c, kept=kept: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}
        apart = lambda a, b: (a - b) ** 2 // (a + b)
        p, q = {s: share(words[lang, s]) for s in sources}, share(sum((words[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = sorted((-sum(apart(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((-apart(p[s][t], q[t]), t.encode()) for t in kept if words[lang, s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, o.decode(), -v, i + 1) for part, found in (("pair", pairs), ("term", terms)) for i, (v, o) in enumerate(found)]
    return sorted(out)


def test_divergence_against_brute_force(spark):
    draw = random.Random(2)
    rows = [(draw.choice(["en", "en", "fr", None]), draw.choice(["a", "b", "é", "z", None]), " ".join(draw.choices(["Foo", "bar", "ÉÀ", "日本", "x1y"], k=draw.randrange(8)))) for _ in range(120)]
    rows += [("xx", "q", None), ("xx", "r", "one"), ("yy", "solo", "foo"), ("xx", "q", None)]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], "lang string, source string, text string, seat string, n int")
    got = sorted(tuple(r) for r in divergence.audit(df, min_docs=3, top=2, seat_groups=1, slice_terms=2).collect())
    assert got == divergence_by_force(rows, 3, 2)
    assert divergence.audit(df.limit(0)).count() == 0


def test_every_two_seats_meet_once(spark):
    from pyspark.sql import functions as F

    for seats in range(1, 9):
        met = Counter()
        for turn in range(seats + 1):
            at = spark.range(seats).select("id", divergence.partner(F.col("id"), F.lit(seats), turn).alias("to")).collect()
            met.update(frozenset((r["id"], r["to"])) for r in at if r["to"] is not None and r["to"] < r["id"])
        assert len(met) == seats * (seats - 1) // 2 and set(met.values()) <= {1}


def test_shares_are_exact():
    counts = np.array([0, 1, 7, 10**12, 10**15], np.int64)
    whole, terms = int(counts.sum()), 5
    assert divergence.shares(counts, whole, terms).tolist() == [1 + 10**9 * (n + 2) // (whole + 2 * terms) for n in counts.tolist()]


def cheapest(codes):
    heap, done, turned = [(0, "", 0, 0)], set(), {0: 2, 1: 2, 3: 2, 2: 3}
    while True:
        cost, audit, i, state = heapq.heappop(heap)
        if i == len(codes) and state in (0, 3):
            return cost, audit
        if (i, state) in done:
            continue
        done.add((i, state))
        heapq.heappush(heap, (cost + 2, audit + "I", i, turned[state]))
        if i < len(codes):
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state))
            if codes[i] != "-":
                late, to = codes[i].isupper(), {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}.get((state, codes[i].lower()))
                if to:
                    heapq.heappush(heap, (cost + late, audit + "K", i + 1, to))
                heapq.heappush(heap, (cost + 2 + late, audit + "R", i + 1, turned[state]))


def test_edits_against_every_path():
    draw = random.Random(1)
    for _ in range(3000):
        codes = "".join(draw.choice("suaxSUAX-" + "ua" * 4) for _ in range(draw.randint(0, 12)))
        assert dialogs.solved(codes) == cheapest(codes)
        cut = draw.randint(0, len(codes))  # the same in two blocks
        behind = dialogs.layers(codes[cut:])
        before = dialogs.layers(codes[:cut], behind[0])
        one, state = dialogs.walked(codes[:cut], before, 0, False)
        assert one + dialogs.walked(codes[cut:], behind, state, True)[0] == cheapest(codes)[1]


def repaired_by_force(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        new = ("user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        out[conv] += [(turn, *new)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    result = []
    for conv, turns in out.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64], hashlib.md5(r[2].encode()).hexdigest()))
        seen, codes, counts = set(), "", [0, 0, 0]
        for _, role, text in turns:
            fault = 0 if not re.search(r"[^\x20\x09-\x0d]", text) else 1 if (role, text) in seen else 2 if text.strip("\x20\x09\x0a\x0b\x0c\x0d")[-1] not in ".!?" else 3
            seen.add((role, text))
            if fault < 3:
                counts[fault] += 1
            initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
            codes += "-" if fault < 2 else initial.upper() if fault == 2 else initial
        cost, audit = cheapest(codes)
        known = [t for t, *_ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        lines, rest, state = [], iter(turns), 0
        for e in audit:
            _, role, text = next(rest) if e != "I" else (0, "", "")
            if e == "K":
                lines.append(f"{role}:{text}")
                state = {"s": 1, "u": 2, "a": 3}[role[0]]
            elif e != "D":
                state = 3 if state == 2 else 2
                lines.append(f"{dialogs.NAMES[state]}:{text}")
        result.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(result, key=str)


@pytest.mark.parametrize("block", [2, 512])
def test_repair_against_brute_force(spark, monkeypatch, block):
    """Whole conversations in a block, and blocks of two rows over several partitions."""
    draw = random.Random(5)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    rows = [(draw.choice([None, *range(12)]), draw.choice([None, *range(25)]), draw.choice(roles), draw.choice(["Hi.", "Well", "  ", None, "so?\n", "é!", ""])) for _ in range(260)]
    rows += [(900, 1, "user", "x.")] * 3 + [(901, t, "user", "same.") for t in range(30)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, c string, part int").repartition(3)
    damaged = dialogs.damaged(df)
    packed = dialogs.blocks
    monkeypatch.setattr(dialogs, "blocks", lambda rows: packed(rows, block))
    repaired = dialogs.repair(damaged)
    assert sorted((tuple(r) for r in dialogs.digest(repaired).collect()), key=str) == repaired_by_force(rows)
    turns = dialogs.repaired_turns(repaired)
    assert turns.count() == sum(len(r[7].replace("D", "")) for r in repaired_by_force(rows))
    assert dialogs.digest(dialogs.repair(damaged.limit(0))).count() == 0


def test_pipeline_of_nothing(spark, tmp_path):
    """An empty table with a column more goes through all stages."""
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, row string").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_between_slices_and_seats(spark, quoting, monkeypatch):
    """A slice gives a seat one row, however many families there are; before, one for each family and batch."""
    texts = sorted({t.encode() for i, t in quoting if i is not None and t and len(t.encode()) >= 50})
    number = {t: i for i, t in enumerate(texts)}
    keys = pa.array([suffixes.keyed(np.frombuffer(t, np.uint8), np.array([len(t)]), 50)[2].tobytes() for t in texts])
    part = pa.RecordBatch.from_arrays([pa.array(number.values(), pa.int64()), pa.array([hashlib.md5(t).digest() for t in texts]), pa.array([t.decode() for t in texts]), keys], names=["doc_id", "digest", "text", "keys"])
    sent = pa.Table.from_batches([b for b in suffixes._snippets(64, 3, 50)(iter([part])) if len(b)]).to_pylist()
    seats = [r for r in sent if r["q"] >= 0]
    assert sorted(r["q"] for r in seats) == [0, 1, 2]
    families = [np.frombuffer(r["family"], "<u4") for r in seats]
    assert all((f % 3 == r["q"]).all() for f, r in zip(families, seats, strict=True)) and len(np.unique(np.concatenate(families))) > 3
