"""The training-data operators against brute force, libraries and round trips, with odd rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import encode, fingerprints, graph, language, near, packing, passages, pieces, pii, tiff, token_counts, token_files
from corpusloom.llm.common import tokenizer_file

ODD = ["", " ", "a", "A  b\n\n c", "▁x ▁▁ y", "naïve é İ", "😀 x\x1d!y", "<s> <|endoftext|>", "日本語テキスト", "\x00\t\ta", "it's 's 'S", "x" * 3000, "w " * 6000, "same text here", "same text here"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, words string, key string, value long, h long, p int"


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, nulls in every column, repeated rows, extra columns named like inner ones."""
    rows = [(i, t, "en", "s", len(t), "x", "y", "z", 1, 2, 3) for i, t in enumerate(ODD)]
    rows += [(100, None, None, None, None, None, None, None, None, None, None), (None, "no id", *[None] * 9), (13, ODD[13], "en", "s", 1, "x", "y", "z", 1, 2, 3)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def tokenizer(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file(name))
    t.encode_special_tokens = True
    return t


ALPHABET = st.text(st.sampled_from("abXY éß日😀  \n\t.,!'’1२\x1c\xa0▁-"), max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(ALPHABET, min_size=1, max_size=6))
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_units_encode_like_the_library(name, texts):
    own = encode.Encoder.held(name)
    flat, sizes = own.flat(pa.array(texts), 3)
    ids = [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])]
    assert ids == [[*e.ids, 3] for e in tokenizer(name).encode_batch(texts, add_special_tokens=False)]


def test_first_pieces_are_looked_up_together(monkeypatch):
    """One lookup for the first pieces of all texts of a slice and one for all others, however many texts there are."""
    own, calls = encode.Encoder.held("byte_bpe_50k.json"), []
    values = own.memo.values
    monkeypatch.setattr(own.memo, "values", lambda units: calls.append(len(units)) or values(units))
    own.flat(pa.array([f"first{i} next{i}" for i in range(100)]), 3)
    assert len(calls) == 2


@settings(max_examples=200, deadline=None)
@given(st.lists(ALPHABET, min_size=1, max_size=6))
def test_pieces_like_the_library(texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    model = pieces.PieceModel.held()
    flat, sizes = model.encode(pa.array(texts))
    ids = [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])]
    assert ids == library.encode(texts, add_bos=True, add_eos=True)
    assert [model.decode(np.array(x)) for x in ids] == [library.decode(x) for x in ids]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 31999) | st.integers(0, 260), max_size=12))
def test_decoding_any_ids_like_the_library(ids):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    assert pieces.PieceModel.held().decode(np.array(ids, np.int64)) == library.decode(ids)


def test_pieces_digest(odd, none):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    want = sorted((hashlib.sha256(np.array(i := library.encode(t, add_bos=True, add_eos=True), "<u4").tobytes()).hexdigest(), len(i)) for _, t in texts_of(odd))
    got = sorted((r["ids_sha256"], r["n_tokens"]) for r in pieces.digest(pieces.encode_pieces(odd)).collect())
    assert got == want and pieces.digest(pieces.encode_pieces(none)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 24), min_size=1, max_size=40))
def test_patterns_use_every_item(lengths):
    size, histogram = 24, collections.Counter(lengths)
    found = packing.patterns(dict(histogram), size)
    used = collections.Counter()
    for times, filling in found:
        assert sum(filling) <= size and times > 0
        for n in filling:
            used[n] += times
    assert used == histogram
    counts = [histogram.get(n, 0) for n in range(size + 1)]
    bound = packing.lower_bound(counts, size)
    assert bound <= sum(t for t, _ in found) <= bound + 1 + bound // 8


def test_packing(odd, none):
    t = tokenizer("byte_bpe_50k.json")
    rows = packing.pack(odd, size=64).collect()
    want = collections.Counter()
    for d, x in texts_of(odd):
        ids = np.array(t.encode(x, add_special_tokens=False).ids + [0], "<u4")
        head = (len(ids) - 1) % 64 + 1
        for piece, start in enumerate([0, *range(head, len(ids), 64)]):
            end = head if not piece else start + 64
            want[d, piece, start, end - start, zlib.crc32(ids[start:end].tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 64
    assert packing.pack(none).count() == 0


def fewest(lengths, size):
    """The least number of sequences, by trying all."""
    items, best = sorted(lengths, reverse=True), len(lengths)

    def put(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for b in dict.fromkeys(b for b in bins if b + items[i] <= size):
            at = bins.index(b)
            put(i + 1, [*bins[:at], b + items[i], *bins[at + 1 :]])
        put(i + 1, [*bins, items[i]])

    put(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=9))
def test_small_packings_are_the_smallest(lengths):
    assert sum(t for t, _ in packing.patterns(dict(collections.Counter(lengths)), 50)) == fewest(lengths, 50)


def test_packings_that_one_filling_at_a_time_misses():
    for size, lengths in ((24, [12, 11, 4, 15, 6, 5, 5, 8, 13, 11, 7, 11, 11]), (100, [52, 45, 43, 41, 27, 23, 21, 19, 18])):
        assert sum(t for t, _ in packing.patterns(dict(collections.Counter(lengths)), size)) == fewest(lengths, size)


def test_token_files(spark, odd, none, tmp_path):
    t = tokenizer("word_bpe_49k.json")
    want, at = [], 0
    for d, x in sorted(texts_of(odd), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = np.array(t.encode(x, add_special_tokens=False).ids + [1], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = sorted((tuple(r) for r in token_files.token_file_digest(odd, files=3).collect()), key=lambda r: r[1])
    assert got == want and token_files.token_file_digest(none).count() == 0
    where = token_files.write_token_files(odd, str(tmp_path / "orc"), files=2)
    plan = spark.read.schema(token_files.SCHEMA).orc(where).where("doc_id = 5")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,5)]" in plan


def test_token_counts(odd, none):
    costs, unknown = token_counts.unigram()

    def brute(word):
        best = [(0, 0)]
        for d in range(1, len(word) + 1):
            options = []
            for a in range(d):
                p = word[a:d]
                if p in costs:
                    options.append((best[a][0] + costs[p], best[a][1] + 1))
                elif d - a == 1:
                    n = len(p.encode())
                    options.append((best[a][0] + n * unknown, best[a][1] + n))
            best.append(min(options))
        return best[-1][1]

    want = sorted((d is not None, d or 0, sum(brute("▁" + w) for w in set(x.split()) for _ in range(x.split().count(w)) if len(w) < 100)) for d, x in texts_of(odd) if len(x) < 2000)
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"]) for r in token_counts.count_tokens(odd.where("text is null or length(text) < 2000")).collect())
    assert got == want and token_counts.count_tokens(none).count() == 0


def word_sets(rows, k):
    out = {}
    for d, t in rows:
        w = t.encode().lower().split()
        out[d] = frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()
    return out


def linked(rows, k, percent=80):
    sets = word_sets(rows, k)
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}, sets


def copies(seed, bases=6, each=9):
    rng, rows, n = random.Random(seed), [], 0
    for b in range(bases):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.randint(3, 120))]
        for _ in range(each):
            own = [f"e{rng.randrange(10**6)}" if rng.random() < rng.choice([0, 0.02, 0.05, 0.1]) else w for w in words]
            rows.append((n * 3 + b, " ".join(own)))
            n += 1
    return rows


@pytest.mark.parametrize("block", [near.BLOCK_BYTES, 3000])
def test_near_groups(spark, monkeypatch, block):
    monkeypatch.setattr(near, "BLOCK_BYTES", block)
    rows = copies(4)
    want, sets = linked(rows, 2)
    got = near.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {d: len(s) for d, s in sets.items()}


def test_near_groups_of_odd_rows(odd, none):
    got = near.near_groups(odd).collect()
    assert len(got) == odd.count() and near.near_groups(none).count() == 0
    own = {(r["doc_id"], r["n_shingles"]): r for r in got}
    assert own[14, 1]["component_id"] == 13 and not own[14, 1]["kept"] and own[100, 0]["kept"] and own[None, 1]["kept"]


def test_components_both_ways(spark):
    rng = random.Random(3)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(1000 + i, 1001 + i) for i in range(40)]
    df = spark.createDataFrame(links, "a long, b long")
    few, many = ({(r["node"], r["root"]) for r in graph.components(df, few=n).collect()} for n in (10**6, 0))
    assert few == many


def test_odd_sketch_estimates():
    rng = np.random.default_rng(1)
    shared, by = rng.integers(0, 2**63, 900).astype(np.uint64), near._multipliers(near.BANDS * near.ROWS)
    a, b = np.concatenate([shared, rng.integers(0, 2**63, 100).astype(np.uint64)]), np.concatenate([shared, rng.integers(0, 2**63, 100).astype(np.uint64)])
    x, y = (near.odd_sketch(near.min_hashes(s, by)).view(np.uint64) for s in (a, b))
    bits = int(np.bitwise_count(x ^ y).sum())
    assert near.most_bits(900 / 1100 + 0.08, 336) < bits < near.most_bits(900 / 1100 - 0.08, 336)


def test_compact_windows_hold_every_subsequence():
    h = np.random.default_rng(2).integers(0, 30, 80).astype(np.uint64)
    found = passages.compact_windows(h, 10)
    for i in range(80):
        for j in range(i + 9, 80):
            hit = [c for left, c, right in found if left <= i <= c <= j <= right]
            assert len(hit) == 1 and h[hit[0]] == h[i : j + 1].min()


def planted(seed=7):
    rng, rows = random.Random(seed), []
    new = lambda n: [f"v{rng.randrange(10**7)}" for _ in range(n)]
    line = " ".join(new(20))
    shared = [new(60), new(90), new(51)]
    for d in range(40):
        parts = [new(rng.randint(5, 60)), line.split(), new(rng.randint(5, 40))]
        if d % 4 < 3:
            parts.insert(rng.randrange(4), shared[d % 4])
        rows.append((d, " ".join(w for p in parts for w in p)))
    return rows


def test_passages(spark):
    rows = planted()
    text = dict(rows)
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in found} == {d for d, _ in rows if d % 4 < 3 and d > 2}
    for r in found:
        assert text[r["doc_id"]][r["start"] : r["end"]] and r["of_doc_id"] < r["doc_id"] and r["last_word"] - r["first_word"] >= 50
    cut = {r["doc_id"]: r["text"] for r in passages.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert cut[0] == text[0] and cut[3] == text[3] and len(cut[4].split()) < len(text[4].split()) - 49


def test_edited_passages_under_a_hot_line(spark):
    """40 earlier documents hold a line; pairs share a passage with that line in it and one word changed in its middle."""
    rng = random.Random(23)
    fresh = lambda n: [f"v{rng.randrange(10**7)}" for _ in range(n)]
    line = fresh(12)
    rows = [(d, " ".join(fresh(40) + line + fresh(40))) for d in range(40)]
    for pair in range(60):
        shared = fresh(6) + line + fresh(36)
        edited = [*shared[:27], *fresh(1), *shared[28:]]
        rows += [(100 + 2 * pair, " ".join(fresh(15) + shared + fresh(15))), (101 + 2 * pair, " ".join(fresh(15) + edited + fresh(15)))]
    found = {(r["doc_id"], r["of_doc_id"]) for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found <= {(101 + 2 * p, 100 + 2 * p) for p in range(60)} and len(found) >= 58


def test_edited_passages_that_others_quote_from(spark):
    """Pairs share a passage of 80 words with one changed; documents before them quote 20 words of it each."""
    rng = random.Random(5)
    fresh = lambda n: [f"v{rng.randrange(10**7)}" for _ in range(n)]
    rows, n = [], 0
    for pair in range(60):
        shared = fresh(80)
        for k in range(4):
            rows.append((n, " ".join(fresh(40) + shared[20 * k : 20 * k + 20] + fresh(40))))
            n += 1
        at = rng.randrange(10, 70)
        edited = [*shared[:at], *fresh(1), *shared[at + 1 :]]
        rows += [(1000 + 2 * pair, " ".join(fresh(15) + shared + fresh(15))), (1001 + 2 * pair, " ".join(fresh(15) + edited + fresh(15)))]
    found = {(r["doc_id"], r["of_doc_id"]) for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {(1001 + 2 * p, 1000 + 2 * p) for p in range(60)}
    assert found <= want and len(found) >= 57


def all_passages(rows, passage=50):
    """Brute force: documents that share an exact run of `passage` words with an earlier one."""
    seen, out = {}, set()
    for d, t in sorted(rows):
        w = t.lower().split()
        own = {tuple(w[i : i + passage]) for i in range(len(w) - passage + 1)}
        if any(g in seen for g in own):
            out.add(d)
        for g in own:
            seen.setdefault(g, d)
    return out


def test_passages_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = texts_of(docs)
    want = all_passages(rows)
    found = passages.repeated_passages(docs).collect()
    own = {r["doc_id"] for r in found}
    assert len(want) > 30 and len(want & own) >= 0.98 * len(want)
    words = {d: t.lower().split() for d, t in rows}
    for r in found:
        a, b = words[r["doc_id"]][r["first_word"] : r["last_word"]], words[r["of_doc_id"]][r["of_first_word"] : r["of_last_word"]]
        x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
        assert min(len(a), len(b)) >= 50 and len(x & y) >= 0.8 * len(x | y)


def uncovered(rows, found, passage=50):
    """Brute force: runs of `passage` words that an earlier document holds and no found passage covers, and how many there are."""
    first, missed, n = {}, [], 0
    spans = {}
    for r in found:
        spans.setdefault(r["doc_id"], []).append((r["first_word"], r["last_word"]))
    for d, t in sorted(rows):
        w = t.lower().split()
        for i in range(len(w) - passage + 1):
            if first.setdefault(tuple(w[i : i + passage]), d) < d:
                n += 1
                if not any(a <= i and i + passage <= b for a, b in spans.get(d, ())):
                    missed.append((d, i))
    return missed, n


def quoted_passages(pairs=40):
    """Pairs share a passage of 52 to 70 words; documents before them quote 46 words of it each, at every tenth word."""
    rng = random.Random(31)
    fresh = lambda n: [f"v{rng.randrange(10**7)}" for _ in range(n)]
    rows, n = [], 0
    for pair in range(pairs):
        shared = fresh(rng.randrange(52, 71))
        for k in [*range(0, len(shared) - 46, 10), len(shared) - 46]:
            rows.append((n, " ".join(fresh(40) + shared[k : k + 46] + fresh(40))))
            n += 1
        rows += [(1000 + 2 * pair, " ".join(fresh(15) + shared + fresh(15))), (1001 + 2 * pair, " ".join(fresh(15) + shared + fresh(15)))]
    return rows


@pytest.mark.parametrize("parts", [1, 7])
def test_every_exact_passage_that_others_quote_is_found(spark, parts):
    """In one slice (windows) and across slices (window_pairs) alike."""
    rows = quoted_passages()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    found = passages.repeated_passages(docs).collect()
    missed, n = uncovered(rows, found)
    assert n > 300 and missed == []
    assert {(r["doc_id"], r["of_doc_id"]) for r in found} == {(1001 + 2 * p, 1000 + 2 * p) for p in range(40)}


def test_a_longer_passage_of_a_later_document_is_found(spark):
    """One document shares 55 words, another the 90 words around them: nothing of the 90 is left over."""
    rng = random.Random(3)
    fresh = lambda n: [f"v{rng.randrange(10**7)}" for _ in range(n)]
    rows = []
    for k in range(20):
        shared = fresh(90)
        rows += [(3 * k, " ".join(fresh(20) + shared[20:75] + fresh(20))), (3 * k + 1, " ".join(fresh(20) + shared + fresh(20))), (3 * k + 2, " ".join(fresh(20) + shared + fresh(20)))]
    missed, n = uncovered(rows, passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect())
    assert n > 900 and missed == []


def test_every_exact_passage_of_the_documents_is_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    missed, n = uncovered(texts_of(docs), passages.repeated_passages(docs).collect())
    assert n > 500 and missed == []


def test_edited_passages_that_longer_lines_quote_from(spark):
    """As above, but 30 words are quoted: more than a block around a shingle."""
    rng = random.Random(6)
    fresh = lambda n: [f"v{rng.randrange(10**7)}" for _ in range(n)]
    rows, n = [], 0
    for pair in range(60):
        shared = fresh(80)
        for k in (0, 25, 50):
            rows.append((n, " ".join(fresh(40) + shared[k : k + 30] + fresh(40))))
            n += 1
        at = rng.randrange(10, 70)
        edited = [*shared[:at], *fresh(1), *shared[at + 1 :]]
        rows += [(1000 + 2 * pair, " ".join(fresh(15) + shared + fresh(15))), (1001 + 2 * pair, " ".join(fresh(15) + edited + fresh(15)))]
    found = {(r["doc_id"], r["of_doc_id"]) for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {(1001 + 2 * p, 1000 + 2 * p) for p in range(60)}


def test_edited_passages_between_many_that_quote_from_them(spark):
    """Every run of an edited passage is held by 25 documents before both, and by 25 between the two."""
    import corpus_pipeline

    rng = random.Random(7)
    fresh = lambda n: [f"v{rng.randrange(10**7)}" for _ in range(n)]
    rows = []
    for pair in range(10):
        shared = fresh(60)
        at = rng.randrange(25, 50)
        kept = shared[:at]
        quotes = lambda: [" ".join(fresh(40) + kept + fresh(40)) for _ in range(25)] + [" ".join(fresh(40) + shared[at + 1 :] + fresh(40)) for _ in range(25)]  # noqa: E731, B023
        texts = [*quotes(), " ".join(fresh(15) + shared + fresh(15)), *quotes(), " ".join(fresh(15) + kept + fresh(1) + shared[at + 1 :] + fresh(15))]
        rows += [(1000 * pair + k, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {(r["doc_id"], r["of_doc_id"]) for r in passages.repeated_passages(docs).collect()}
    assert found == {(1000 * p + 101, 1000 * p + 50) for p in range(10)}
    left = {r["doc_id"]: len(r["text"].split()) for r in corpus_pipeline.without_passages(spark, docs, "").collect()}
    assert [left[1000 * p + 101] for p in range(10)] == [30] * 10


def test_rows_of_runs_that_many_documents_hold_are_linear(spark, monkeypatch):
    """300 documents hold a line that goes on over a changed word, but not for a passage; two share a passage around it."""
    rng = random.Random(17)
    fresh = lambda n: [f"v{rng.randrange(10**7)}" for _ in range(n)]
    line, more, rest = fresh(25), fresh(10), fresh(20)
    rows = [(d, " ".join(fresh(40) + line + fresh(1) + more + fresh(40))) for d in range(300)]
    rows += [(d, " ".join(fresh(20) + line + fresh(1) + more + rest + fresh(20))) for d in (350, 400)]
    kept, n = passages.rest_pairs, []

    def counted(found, *options):
        out = kept(found, *options)
        n.append((found.where("place % 2 = 1").count(), out.count()))
        return out

    monkeypatch.setattr(passages, "rest_pairs", counted)
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {(r["doc_id"], r["of_doc_id"]) for r in found} == {(400, 350)}
    ((free, out),) = n
    assert free >= 300 and out <= free


def test_passages_on_either_side_of_a_run_that_many_hold(spark):
    """One document shares an edited passage before the run, one another behind it; 60 hold the run and go on over an edit."""
    rng = np.random.default_rng(9)
    fresh = lambda n: rng.integers(-(2**31), 2**31, n).tolist()
    before, run, behind = fresh(40), fresh(20), fresh(40)
    texts = [fresh(60) + run + fresh(1) + behind[1:12] + fresh(60) for _ in range(60)]
    texts += [fresh(60) + before[:20] + fresh(1) + before[21:] + run + fresh(60), fresh(60) + run + behind[:20] + fresh(1) + behind[21:] + fresh(60)]
    texts += [fresh(60) + run + fresh(1) + behind[1:12] + fresh(60) for _ in range(60)]
    texts += [fresh(60) + before + run + behind + fresh(60)]
    rows = [(d, w, [next(i for i in range(len(w)) if w[i : i + 20] == run)], []) for d, w in enumerate(texts)]
    words = spark.createDataFrame(rows, "doc_id long, words array<int>, runs array<int>, covered array<struct<first_word:int,last_word:int,exact:boolean>>")
    pairs = [(r["a"], r["b"]) for r in passages.rest_pairs(passages.contexts(words, 50), 50, 80).collect()]
    assert {(122, 60), (122, 61)} <= set(pairs) and len(pairs) <= 4 * len(texts)


def test_the_table_of_runs_goes_before_the_rest_is_compared(spark, monkeypatch):
    from pathlib import Path

    from corpusloom.llm.common import shared_path

    kept, there = passages.rest_pairs, []

    def looked(*args):
        there.append({p.name.split("-")[0] for p in Path(shared_path(spark, "x").removeprefix("file:")).parent.iterdir()})
        return kept(*args)

    monkeypatch.setattr(passages, "rest_pairs", looked)
    passages.repeated_passages(spark.createDataFrame(planted(), "doc_id long, text string")).collect()
    assert len(there) == 1 and "words" in there[0] and not there[0] & {"runs", "met"}


def test_new_words_take_bounded_memory():
    """The first slice of a worker has all its words to score, and their features are many times as large."""
    import tracemalloc

    scores = np.random.default_rng(2).random((1 << 10, 4), np.float32)
    words = [f"word{i:x}abcd".translate(str.maketrans("0123456789", "ghijklmnop")) for i in range(60_000)]
    tracemalloc.start()
    rows = language.WordScores(scores).of(words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    assert np.array_equal(rows[-100:], language.WordScores(scores).scored(words[-100:]))


def test_the_pipeline_leaves_no_exact_passage(spark):
    """Of passages that others quote, across slices, the stage leaves the first occurrence alone."""
    import corpus_pipeline

    rows = quoted_passages(20)
    docs = spark.createDataFrame([(d, t, len(t)) for d, t in rows], "doc_id long, text string, n_chars long").repartition(5)
    left = corpus_pipeline.without_passages(spark, docs, "").collect()
    assert {r["doc_id"]: len(r["text"].split()) for r in left if r["doc_id"] >= 1000 and r["doc_id"] % 2} == {1001 + 2 * p: 30 for p in range(20)}
    assert uncovered([(r["doc_id"], r["text"]) for r in left], [])[1] == 0


def test_texts_of_one_doc_id_are_told_apart(spark):
    rng = random.Random(8)
    fresh = lambda n: [f"v{rng.randrange(10**7)}" for _ in range(n)]
    shared = fresh(60)
    rows = [(1, " ".join(shared + fresh(30))), (2, " ".join(shared + fresh(10))), (2, " ".join(fresh(100))), (2, " ".join(shared + fresh(10)))]
    left = sorted(len(r["text"].split()) for r in passages.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert left == [10, 10, 90, 100]


def test_passages_of_odd_rows(odd, none):
    assert passages.repeated_passages(none).count() == 0
    assert {r["doc_id"] for r in passages.repeated_passages(odd).collect()} <= {11, 12}
    assert passages.without_repeats(odd).columns == odd.columns


def test_word_spans():
    for t in ODD:
        starts, ends = passages.word_spans(t)
        assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]


def test_fingerprints(odd, none, spark):
    got = fingerprints.compare_with_next(odd).collect()
    assert len(got) == odd.count() and fingerprints.compare_with_next(none).count() == 0
    rows = sorted(((d, t) for d, t in texts_of(odd) if d is not None and d != 13), key=lambda r: r[0])
    simple = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in fingerprints.compare_with_next(simple).collect()}
    for (d, t), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        assert got[d]["n_chars"] == len(t) and got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        own, nxt = ({x.split("@")[0] for x in got[i]["fingerprint"].split()} for i in (d, rows[(rows.index((d, t)) + 1) % len(rows)][0]))
        assert got[d]["near_next"] == pytest.approx(len(own & nxt) / len(own | nxt) if own | nxt else 1.0)
        places = [int(x.split("@")[1]) for x in got[d]["fingerprint"].split()]
        assert all(0 < b - a <= fingerprints.WINDOW for a, b in zip(places, places[1:], strict=False))


def test_winnowing_guarantee(spark):
    rng = random.Random(9)
    shared = " ".join(f"s{rng.randrange(10**6)}" for _ in range(fingerprints.K + fingerprints.WINDOW - 1))
    rows = [(i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(30)) + f" {shared} " + " ".join(f"t{rng.randrange(10**6)}" for _ in range(25))) for i in range(8)]
    chosen = [set(r["h"]) for r in fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).select(fingerprints.hashes(F.col("chosen")).alias("h")).collect()]
    assert set.intersection(*chosen)


def brute_winnow(t, k, window):
    import xxhash

    mask = (1 << 64) - 1 ^ fingerprints.LOW
    value = lambda s: xxhash.xxh64_intdigest(s.encode(), seed=42)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    grams = [value(t) & mask] if 0 < len(t) < k else []
    for i in range(len(t) - k + 1):
        h = 0
        for c in t[i : i + k]:
            h = (h << 1 ^ value(c)) & (1 << 64) - 1
        grams.append(h & mask)
    out = []
    for i in range(max(1, len(grams) - window + 1) if grams else 0):
        own = [signed(x) for x in grams[i : i + window]]
        at = i + max(j for j, x in enumerate(own) if x == min(own))
        if not out or out[-1][1] != at:
            out.append((grams[at] >> 31, at))
    return out


@pytest.mark.parametrize(("k", "window", "part"), [(8, 64, fingerprints.PART), (4, 16, 64), (2, 24, 32)])
def test_fingerprints_against_brute_force(spark, monkeypatch, k, window, part):
    monkeypatch.setattr(fingerprints, "PART", part)
    rng = random.Random(k)
    texts = ["", "a", "abc", "日本語テキスト" * 30, *("".join(rng.choice("ab é日😀\n") for _ in range(rng.choice([5, 8, 20, 39, 40, 70, 71, 72, 150, 400]))) for _ in range(40))]
    df = spark.createDataFrame([(3 * i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in fingerprints.compare_with_next(df, k, window).collect()}
    shown = lambda c: " ".join(f"{h:X}@{p}" for h, p in c)
    alike = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
    for i, t in enumerate(texts):
        following = texts[(i + 1) % len(texts)]
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        own, new, other = (brute_winnow(x, k, window) for x in (t, edited, following))
        r = got[3 * i]
        assert (r["fingerprint"], r["edited_fingerprint"]) == (shown(own), shown(new))
        own, new, other = ({h for h, _ in x} for x in (own, new, other))
        assert r["near_edited"] == pytest.approx(alike(own, new)) and r["near_next"] == pytest.approx(alike(own, other))


def test_shared_passages_without_spaces_share_a_hash(spark):
    rng = random.Random(4)
    new = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(n))
    shared = new(fingerprints.K + fingerprints.WINDOW - 1)
    rows = [(i, new(50 + 7 * i) + shared + new(90)) for i in range(8)]
    chosen = [set(r["h"]) for r in fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).select(fingerprints.hashes(F.col("chosen")).alias("h")).collect()]
    assert set.intersection(*chosen)


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(text):
    found = []
    for n, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")) or kind == "card" and 14 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 10 <= len(digits) <= 15:
                found.append((m.start(), n, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


PRIVATE = ["a@b.co_x@d.e.f é@x.y", "😀 4111 1111 1111 1111 x 4111-1111-1111-1112", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.4", "+1 (234) 567-8901 +1 2", "9" * 5000, "a" * 5000 + "@", "x@y", "+1" * 50, "1.1.1.1" * 30, "5555 5555 5555 4444 5555 5555 5555 4444"]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(st.sampled_from("a_@.-+ 0123456789()é"), max_size=80), min_size=1, max_size=30))
def test_base_spans(spark, texts):
    rows = list(enumerate([*texts, *PRIVATE]))
    got = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", pii.joined(pii.base_spans(F.col("text"))).alias("s")).collect()
    assert {r["doc_id"]: r["s"] for r in got} == {i: base_spans(t) for i, t in rows}


def test_contexts_find_new_identifiers(spark):
    rows = [(i, f"please call my cell +1 (234) 567-{1000 + i} now") for i in range(8)] + [(50, "please call my cell 2345678901 now"), (51, "order number 2345678901 shipped"), (52, "nothing here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in pii.find(df).collect()}
    assert got[50] == [(20, 30, 3)] and got[51] == [] and got[52] == []
    clean = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert clean[50] == "please call my cell <phone> now" and clean[0] == "please call my cell <phone> now" and clean[51] == rows[9][1]


def test_found_identifiers_induce_patterns(spark):
    """Seeds teach `my cell _`; the numbers it finds teach `_ when home`, which finds a number of another context."""
    rows = [(i, f"please call my cell +1 (234) 567-{1000 + i} now ok") for i in range(100)]
    rows += [(200 + i, f"please call my cell 234567{8900 + i} when home dear") for i in range(12)]
    rows += [(300, "fax line goes 998877000 when home dear"), (301, "order number 2345678901 shipped"), (302, 'key "0123456789abcdef0123456789abcdef01" x')]
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[200 + i] == [(20, 30, 3)] for i in range(12)) and got[300] == [(14, 23, 3)]
    assert got[301] == [] and got[302] == [(5, 39, 4)]


def test_pii_digest(spark):
    rows = list(enumerate(PRIVATE))
    for r in pii.digest(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect():
        want = base_spans(PRIVATE[r["doc_id"]])
        kinds = [x.split(":")[0] for x in want.split(",") if x]
        assert [r[f"n_{k}"] for k in BASE] == [kinds.count(k) for k in BASE]
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest() and set(want.split(",")) - {""} <= set(r["spans"].split(","))


def test_spans_beyond_base_ones(spark):
    found = pii.digest(pii.find(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))).collect()
    assert sum(r["n_spans"] for r in found) > sum(r[f"n_{k}"] for r in found for k in BASE)


def test_candidates_with_digits_before_the_at_and_in_groups(spark):
    tokens = ["john@corp", "john99@corp", "a1@b", "1234@5678", "u2@mail_host.com", "0664 123 45 67", "(555) 123-4567", "x1234567"]
    rows = [(i, f"mine is {t} today") for i, t in enumerate(tokens)] + [(20, "in 2020 and 12 more"), (21, "from 10.0.0.1 1234567 now")]
    got = {r["doc_id"]: [s["value"] for s in r["tokens"]] for r in pii.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**{i: [t] for i, t in enumerate(tokens)}, 6: ["(555) 123-4567", "123-4567"], 20: [], 21: ["1234567"]}


def test_pii_of_odd_rows(odd, none):
    assert pii.digest(pii.find(odd)).count() == odd.count() and pii.digest(pii.find(none)).count() == 0
    assert pii.redact(odd).columns == odd.columns and pii.redact(odd).count() == odd.count()


def test_language(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held_out", language.held_out())
    model = language.train(docs.where("not held_out"))
    rows = language.predict(docs, model, keep=["doc_id", "lang", "held_out"]).where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows) and all(0 <= r["score"] <= 1 for r in rows)
    own = {(r["doc_id"], r["lang_pred"], r["score"]) for r in language.predict(odd, model).collect()}
    assert {(100, "und", 0.0), (0, "und", 0.0), (1, "und", 0.0)} <= own and language.predict(none, model).count() == 0
    kept = language.predict(docs, model, reject=True, keep=["doc_id"]).where("lang_pred <> 'und'").count()
    assert kept >= 0.99 * docs.count()
    assert {r["lang_pred"] for r in language.predict(odd, language.train(none)).collect()} == {"und"}


def test_language_rejects_what_it_does_not_know(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model, again = (language.train(docs) for _ in range(2))
    assert np.array_equal(model.scores, again.scores) and model.threshold == again.threshold
    rows = spark.createDataFrame([(1, "123 !?"), (2, None), (3, docs.first()["text"])], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language.predict(rows, model).collect()}
    assert got[1]["rejected"] and got[2]["rejected"] and got[1]["lang_pred"] == "und" and not got[3]["rejected"]


def test_every_label_is_learned(spark):
    rows = [(i, f"w{i % 90}a w{i % 90}b w{i % 90}c " * 10, f"l{i % 90}") for i in range(900)]
    assert len(language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string")).languages) == 90


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000) | st.text("ab ", max_size=3000).map(str.encode))
def test_codecs(data):
    assert tiff.unpackbits(tiff.packbits(data)) == data and tiff.unlzw(tiff.lzw(data)) == data


def test_tiff(odd, none):
    payload = np.random.default_rng(1).integers(0, 256, 192 * 1300).astype(np.uint8).tobytes()
    for k in range(len(tiff.LAYOUTS)):
        found = list(tiff.read_tiff(tiff.write_tiff(payload, k)))
        assert len(found) == 3 and b"".join(p["pixels"] for p in found) == payload
    got = tiff.describe(tiff.pages(tiff.store_as_tiff(odd))).collect()
    want = sorted((len(b := t.encode()), hashlib.sha256(b.ljust(max(1, -(-len(b) // 192)) * 192)).hexdigest()) for _, t in texts_of(odd))
    assert sorted((r["n_bytes"], r["payload_sha256"]) for r in got) == want
    assert tiff.describe(tiff.pages(tiff.store_as_tiff(none))).count() == 0


def test_broken_tiff(spark):
    good = tiff.write_tiff(b"x" * 192)
    rows = [(1, 1, b"II*\0"), (2, 1, b"junk"), (3, 1, good[:-30]), (4, 1, None), (5, 1, good)]
    got = {r["doc_id"]: r for r in tiff.pages(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    assert set(got) == {1, 2, 3, 5} and got[5]["error"] is None and all(got[i]["error"] for i in (1, 2, 3))


def foreign(order, tags, blobs):
    """A TIFF by hand: tags (number, kind, values), where 273 and 324 name blobs by index."""
    import struct

    out = bytearray((b"II*\0" if order == "<" else b"MM\0*") + b"\0" * 4)
    at = []
    for b in blobs:
        at.append(len(out))
        out += b + b"\0" * (len(b) % 2)
    entries = []
    for tag, kind, values in sorted(tags):
        values = [at[i] for i in values] if tag in (273, 324) else values
        data = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
        if len(data) > 4:
            data, place = struct.pack(f"{order}I", len(out)), data
            out += place
        entries.append(struct.pack(f"{order}HHI", tag, kind, len(values)) + data.ljust(4, b"\0"))
    struct.pack_into(f"{order}I", out, 4, len(out))
    return bytes(out + struct.pack(f"{order}H", len(entries)) + b"".join(entries) + b"\0" * 4)


def test_foreign_tiffs():
    rng = np.random.default_rng(3)
    bilevel = rng.integers(0, 2, (5, 13)).astype(np.uint8)
    blob = tiff.packbits(np.packbits(bilevel, axis=1).tobytes())
    (page,) = tiff.read_tiff(foreign(">", [(256, 3, [13]), (257, 3, [5]), (258, 3, [1]), (259, 3, [32773]), (262, 3, [1]), (273, 4, [0]), (278, 3, [5]), (279, 4, [len(blob)])], [blob]))
    assert page["pixels"] == bilevel.tobytes() and page["bits"] == 1
    planes, blobs = rng.integers(0, 65536, (3, 20, 30)).astype(np.uint16), []
    for plane in planes:
        for y in (0, 16):
            for x in (0, 16):
                tile = np.zeros((16, 16), np.int64)
                part = plane[y : y + 16, x : x + 16]
                tile[: part.shape[0], : part.shape[1]] = part
                tile[:, 1:] = np.diff(tile, axis=1)
                blobs.append(zlib.compress(tile.astype(np.uint16).astype(">u2").tobytes()))
    tags = [(256, 3, [30]), (257, 3, [20]), (258, 3, [16] * 3), (259, 3, [8]), (262, 3, [2]), (277, 3, [3]), (284, 3, [2]), (317, 3, [2]), (322, 3, [16]), (323, 3, [16]), (324, 4, list(range(12))), (325, 4, [len(b) for b in blobs])]
    (page,) = tiff.read_tiff(foreign(">", tags, blobs))
    assert page["pixels"] == np.moveaxis(planes, 0, -1).astype("<u2").tobytes()
    broken = foreign("<", [(256, 3, [4]), (257, 3, [4]), (258, 3, [8]), (322, 3, [0]), (323, 3, [4]), (324, 4, [0]), (325, 4, [4])], [b"abcd"])
    ((page, error),) = tiff.pages_of(broken)
    assert page is None and error.startswith("ValueError")


def test_good_pages_of_a_broken_file_stand():
    whole = tiff.write_tiff(np.random.default_rng(1).integers(0, 256, 192 * 1300).astype(np.uint8).tobytes(), 0)
    second = list(tiff.directories(whole))[1]
    torn = bytearray(whole)
    torn[second[273][0] : second[273][0] + 8] = b"\xff" * 8
    assert [page is not None for page, _ in tiff.pages_of(bytes(torn))] == [True, False, True]


def test_known_lzw_codes():
    """The example of the format's specification: 7 7 7 8 8 7 7 6 6 gives codes 256 7 258 8 8 258 6 6 257."""
    data, codes = bytes([7, 7, 7, 8, 8, 7, 7, 6, 6]), [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    want = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff.lzw(data) == want and tiff.unlzw(want) == data


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, docs, sf).checkpoint()
        assert new.dtypes == docs.dtypes and 0.8 * docs.count() <= new.count() <= docs.count(), name
        docs = new
    sets = word_sets([(r["doc_id"], r["text"]) for r in docs.collect()], 5)
    assert len(sets) == docs.count()
    packed = corpus_pipeline.run(spark, sf)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(sets)


def test_pieces_are_digested_by_the_worker_that_encodes(spark, odd):
    from corpusloom.llm import registry

    def workers(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")

    assert workers(registry.op4_sentencepiece(spark, "/root/testdata/sf0.001")) == 1
    assert sorted(map(str, pieces.encode_digest(odd).collect())) == sorted(map(str, pieces.digest(pieces.encode_pieces(odd)).collect()))


CLASHES = "__id long, __tag long, __spans string, __key string, __salt int, doc_id long, text string, tag string, row string, spans string, cut string, key string, salt string, id string"


def test_clashing_columns_stay(spark):
    """Names that the operators use within, or once used, are the caller's: values and order stay."""
    words = [f"w{i}" for i in range(80)]
    rows = [(i, 2, "s", "k", 3, doc, text, "t", "r", "p", "c", "y", "l", "i") for i, (doc, text) in enumerate([(1, " ".join(words)), (2, "before " + " ".join(words) + " after"), (3, "mail a@b.de now"), (None, " ".join(words)), (4, None)])]
    df = spark.createDataFrame(rows, CLASHES)
    for done in (passages.without_repeats(df), pii.redact(df)):
        assert done.columns == df.columns
        others = lambda found: sorted(((r[0], [v for c, v in zip(df.columns, r, strict=True) if c not in ("__id", "text")]) for r in found), key=lambda x: x[0])
        assert others(done.collect()) == others(rows)
    cut = {r["__id"]: r["text"] for r in passages.without_repeats(df).collect()}
    assert (cut[0], cut[1].split(), cut[3], cut[4]) == (" ".join(words), ["before", "after"], " ".join(words), None)
    assert {r["__id"]: r["text"] for r in pii.redact(df).collect()}[2] == "mail <email> now"
