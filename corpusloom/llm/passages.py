"""Near-duplicate passages by compact windows.

For each of a few hash functions a text's five-word shingles are hashed, and the Cartesian tree over the hashes (least
value at the root, recursively on both sides) groups all its subsequences: a node with span l..r and least position c
stands for every subsequence that holds c and stays within l..r, since all of them have the same min-hash. Nodes
narrower than a passage are left out, so there are about 2n/t windows per function. Two passages of similarity J share
the shingle at c per function with probability J.

A window is looked up not by the shingle at c alone, which a frequent line may hold as well, but by exact blocks of words
that have the shingle in a known place: the HALF words that begin with it, the HALF words that end with it, and the BLOCK
words around it. Two passages alike at 0.8 have an exact run of some 24 words (an edit spoils five shingles, so edits are
45 words apart), and every run of 24 words has a block of HALF words on one side of any shingle; so blocks cost little
recall, one function is enough for a comparison, and a line that thousands quote leads astray only those windows of which
every block lies within the line. For an exact passage that takes a line of more than BLOCK words, for all functions.

Windows of equal blocks are joined in a star: with a first document that has the block, never all with all, and within a
slice of the input before anything is shuffled, so that a block that a third of all documents share is one row a slice.
Then the intervals are joined: what two windows both cover around c must be as wide as a passage, but for SLACK shingles
that words put in or left out may cost.

The first document of a block may hold the block without the passage, so no window is dropped for what it shares with the
first one: every place that shares a block is looked up again, by all the runs of `passage` words around it. Equal runs
are equal passages, so there a star loses nothing: each run that an earlier document holds is found. Then, for what no
found passage covers, runs of NEAR words (chosen by least hash, so that any 24 words in a row hold one) are compared with
the first and the PARTNERS nearest earlier documents that hold them, which finds edited passages; see `near_runs`.

A pair of documents is compared on words: exact runs around the shared blocks, runs a few words apart joined, and a
passage counts if it has `passage` words and its sides' shingle sets have the wanted similarity.

Defined cases: null, empty and short texts have no passage; a document that repeats itself is no match; copies are
passages as long as the text; rows that share a doc_id are not compared with each other, and a passage belongs to the one
of their texts that holds it (`tag`, a hash of the text); rows without doc_id are not compared.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_ROWS, arrow_rows, bucketed, columns_of, id_and_text, list_array, quoted, row_of, scratch, slices, stored, text_parts
from .shingles import Blocks, flat_words, mix

SHINGLE, PASSAGE, FUNCTIONS = 5, 50, 3
#: Words that may differ between two exact runs of one passage.
GAP = 12
#: Shingles by which what two windows share may be narrower than a passage.
SLACK = 12
#: Words of the block on either side of a window's shingle, and of the block around it.
HALF, BLOCK = 15, 30
#: Words of a run by which edited passages are looked up again; any NEAR + NEAR_OF - 1 words in a row hold a chosen one.
NEAR, NEAR_OF = 20, 5
#: Nearest earlier documents with the run that one is compared with, beside the first.
PARTNERS = 16
#: Words whose trees are made at once.
_GROUP = 1 << 18
#: Rows with the words of two documents that go to Python at once.
_PAIRS_AT_ONCE = 200
#: Bytes of such rows that are compared at once.
_GATHERED = 6 << 20
#: Runs whose shingles beside them are sorted at once.
_ROWS = 16_384
#: Runs that one is compared with at once.
_AT_ONCE = 512
_NOWHERE = 1 << 30
#: Comparisons of words beside runs that a task remembers.
_KNOWN = 200_000


def _nodes(order: np.ndarray, bits: int, begins: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """l, c, r (inclusive) of the Cartesian trees' nodes that span at least `least` positions.

    order: hashes with their position in the low bits; begins, ends: of the sequences in it, ascending, each with a tree
    of its own. A node spans `least` positions if and only if it is the least of some `least` positions in a row, and what
    bounds a node on either side is such a node itself, so only these few are looked at further."""
    mask = np.uint64((1 << bits) - 1)
    wide = ends - begins >= least
    begins, ends = begins[wide], ends[wide]
    if not len(begins):
        return (np.zeros(0, np.int64),) * 3
    low = _lows(order, least)
    sizes = ends - begins - least + 1
    low = low[np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
    low = low[np.concatenate([[True], low[1:] != low[:-1]])]
    c = (low & mask).astype(np.int64)
    of = np.searchsorted(begins, c, "right") - 1
    # each sequence between two bounds that are less than anything in it; from there the next lesser value on each side
    at = np.arange(len(c)) + of + 1
    value = np.zeros(len(c) + len(begins) + 1, np.uint64)
    value[at] = low + np.uint64(1)
    bounds = np.flatnonzero(np.isin(np.arange(len(value)), at, invert=True))
    sides = []
    for step, outer in ((-1, np.append(begins - 1, 0)), (1, np.concatenate([[0], ends]))):
        place = np.empty(len(value), np.int64)
        place[at], place[bounds] = c, outer
        to = np.arange(len(value)) + step
        todo = at
        while len(todo := todo[value[to[todo]] > value[todo]]):
            to[todo] = to[to[todo]]
        sides.append(place[to[at]] - step)
    return sides[0], c, sides[1]


def compact_windows(hashes: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Nodes l, c, r (inclusive) of the Cartesian tree that span at least `least` positions; the leftmost of equal values is the root."""
    bits = max(1, len(hashes).bit_length())
    rank = np.empty(len(hashes), np.uint64)
    rank[np.argsort(hashes, kind="stable")] = np.arange(len(hashes), dtype=np.uint64)
    found = _nodes(rank << np.uint64(bits) | np.arange(len(hashes), dtype=np.uint64), bits, np.array([0]), np.array([len(hashes)]), least)
    return list(zip(*(x.tolist() for x in found), strict=True))


def _groups(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about _GROUP words each."""
    upto, i = np.cumsum(sizes), 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + _GROUP, "right")))
        yield i, j
        i = j


def _orders(blocks: Blocks, functions: int) -> Iterator[tuple[np.ndarray, int]]:
    """For each function the hashes of all shingles, with their place in the low bits, and how many bits that takes."""
    shingles = blocks.every(SHINGLE)
    bits = max(1, len(shingles).bit_length())
    for seed in mix(np.arange(1, functions + 1, dtype=np.uint64)):
        yield mix(shingles ^ seed) >> np.uint64(bits) << np.uint64(bits) | np.arange(len(shingles), dtype=np.uint64), bits


def _lows(order: np.ndarray, least: int) -> np.ndarray:
    """The least of every `least` values in a row."""
    low, span = order, 1
    while 2 * span <= least:
        low, span = np.minimum(low[:-span], low[span:]), 2 * span
    return np.minimum(low[: span - least], low[least - span :]) if least > span else low


def keyed_windows(words: np.ndarray, sizes: np.ndarray, passage: int, functions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all windows of some texts (word hashes end to end, words a text), the index of each one's text, and its
    place: c above bit 16, c - l and r - c in 8 bits each, clipped. A position that is the root of windows of several
    functions has one place, with the widest of them."""
    ends = np.cumsum(sizes)
    begins = ends - sizes
    blocks, found = Blocks(words), []
    for order, bits in _orders(blocks, functions):
        found.append(_nodes(order, bits, begins, ends - SHINGLE + 1, passage - SHINGLE + 1))
    left, c, right = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(c):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(c, kind="stable")
    left, c, right = left[order], c[order], right[order]
    first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    left, right, c = np.minimum.reduceat(left, first), np.maximum.reduceat(right, first), c[first]
    of = np.searchsorted(begins, c, "right") - 1
    begin, end = begins[of], ends[of]
    place = c - begin << 16 | np.minimum(c - left, 255) << 8 | np.minimum(right - c, 255)
    keys, texts, places = [], [], []
    for kind, (shift, size) in enumerate(((0, HALF), (SHINGLE - HALF, HALF), ((SHINGLE - BLOCK) // 2, BLOCK))):
        ok = (c + shift >= begin) & (c + shift + size <= end)
        keys.append(mix(blocks.at(c[ok] + shift, size) ^ np.uint64(kind)))
        texts.append(of[ok])
        places.append(place[ok])
    return np.concatenate(keys), np.concatenate(texts), np.concatenate(places)


def _may_hold(passage: int) -> Column:
    """Interval join: whether what both windows cover around their shingle is as wide as a passage, but for SLACK."""
    left, right = (F.least(F.shiftright("place_a", bits).bitwiseAND(255), F.shiftright("place_b", bits).bitwiseAND(255)) for bits in (8, 0))
    return left + right + 1 >= min(passage - SHINGLE + 1 - SLACK, 256)


#: As many ranges of keys, and pairs a row, as go through the exchange as one; rows of a range that a task holds.
_SEAT_BITS, _PAIRS, _SEAT_ROWS = 12, 128, 1 << 20
_SEATS = 1 << _SEAT_BITS
SEATED = "seat long, least long, n int, key binary, doc_id binary, place binary, b binary, place_b binary"


def _packed(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Parts of some whole numbers as bytes: 4 a number where all numbers are small, else 8."""
    small = len(values) > 0 and values.min() >= 0 and values.max() < 1 << 32
    data = np.ascontiguousarray(values.astype(np.uint32 if small else np.int64))
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * data.itemsize).astype(np.int32)), pa.py_buffer(data)])


def _unpacked(parts: list[bytes], sizes: list[int]) -> np.ndarray:
    wide = [len(part) == 8 * n for part, n in zip(parts, sizes, strict=True)]
    if all(wide):
        return np.frombuffer(b"".join(parts), np.int64)
    if not any(wide):
        return np.frombuffer(b"".join(parts), np.uint32).astype(np.int64)
    return np.concatenate([np.frombuffer(part, np.int64 if w else np.uint32).astype(np.int64) for part, w in zip(parts, wide, strict=True)])


def _starred(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """SEATED of keys, documents and places of a slice. A row is a seat's share of the slice (a seat is a range of keys),
    in order: of each key the windows of its least doc_id. The other documents' windows come as pairs with the first of
    them (b, place_b), in rows whose seat is _SEATS or more. Documents are counted from `least`."""
    key, doc, place = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(key):
        return
    order = np.argsort(key)
    again = key[order][1:] == key[order][:-1]
    ties = np.flatnonzero(np.append(again, False) | np.append(False, again))
    order[ties] = order[ties][np.lexsort((order[ties], doc[order[ties]], key[order[ties]]))]
    key, doc, place = key[order], doc[order], place[order]
    first = np.flatnonzero(np.append(True, ~again))
    of = np.repeat(first, np.diff(np.append(first, len(key))))
    own = doc == doc[of]
    least = int(doc.min())
    doc = doc - least
    seats = (key[own] >> np.uint64(64 - _SEAT_BITS)).astype(np.int64)
    begins = np.flatnonzero(np.append(True, seats[1:] != seats[:-1]))
    parts = [(seats[begins], np.append(begins, len(seats)), key[own].view(np.int64), doc[own], place[own], None, None)]
    other = np.flatnonzero(~own)
    if len(other):
        begins = np.arange(0, len(other), _PAIRS)
        parts.append((_SEATS + (least + begins) % 100_003, np.append(begins, len(other)), None, doc[other], place[other], doc[of[other]], place[of[other]]))
    for seat, offsets, *columns in parts:
        n = len(seat)
        yield pa.RecordBatch.from_arrays([pa.array(seat), pa.array(np.full(n, least)), pa.array(np.diff(offsets).astype(np.int32)), *(pa.nulls(n, pa.binary()) if x is None else _packed(x, offsets) for x in columns)], names=[x.split()[0] for x in SEATED.split(", ")])


def windows(docs: DataFrame, passage: int = PASSAGE, functions: int = FUNCTIONS) -> DataFrame:
    """SEATED of windows, joined within a slice of the input before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words, sizes = flat_words(part.column(1))
            words >>= np.uint64(32)  # as hashed_words keeps them
            ids = part.column(0)
            usable = (sizes >= passage) & np.asarray(ids.is_valid())
            words, sizes, ids = words[np.repeat(usable, sizes)], sizes[usable], ids.filter(pa.array(usable)).to_numpy()
            found, at = [], 0
            for i, j in _groups(sizes):
                n = int(sizes[i:j].sum())
                key, text, place = keyed_windows(words[at : at + n], sizes[i:j], passage, functions)
                found.append((key, ids[i:j][text], place))
                at += n
            if found:
                yield from _starred(found)

    return docs.select("doc_id", "text").mapInArrow(run, SEATED)


def _met(a: np.ndarray, b: np.ndarray, place_a: np.ndarray, place_b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, place_a, place_b)], names=["a", "b", "place_a", "place_b"])


def window_pairs(found: DataFrame) -> DataFrame:
    """a, b, place_a, place_b: every window with one of the first document that has its key, in one exchange. The first
    document's other places with that key come with it as well (a = b).

    First windows of the slices meet by seat; a task holds some seats at a time. Of a seat beyond _SEAT_ROWS rows (one key
    that very many slices have) what has come so far is paired with the first documents so far, and of these the first
    row stays, so that whoever comes later meets it; seats come in order of the slices' least documents."""

    def pairs(held: list[list[np.ndarray]]) -> tuple[pa.RecordBatch, list[np.ndarray]]:
        key, doc, place = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(key)
        again = key[order][1:] == key[order][:-1]
        rows = order[np.append(again, False) | np.append(False, again)]  # of keys with several
        rows = rows[np.lexsort((place[rows], doc[rows], key[rows]))]
        first = np.flatnonzero(np.append(True, key[rows][1:] != key[rows][:-1])) if len(rows) else np.zeros(0, np.int64)
        to = rows[np.repeat(first, np.diff(np.append(first, len(rows))))]
        stay = np.ones(len(key), bool)
        stay[rows], stay[to] = False, True
        ok = (doc[rows] != doc[to]) | (place[rows] != place[to])
        rows, to = rows[ok], to[ok]
        return _met(doc[rows], doc[to], place[rows], place[to]), [key[stay], doc[stay], place[stay]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # rows of the seat that is not complete, and of complete ones before it
        n, most, last = 0, _SEAT_ROWS, -1
        for batch in batches:
            seat = np.minimum(batch.column("seat").to_numpy(), _SEATS)
            begins = np.flatnonzero(np.append(True, seat[1:] != seat[:-1])).tolist() if len(seat) else []
            for i, j in zip(begins, [*begins[1:], len(seat)], strict=False):
                part = batch.slice(i, j - i)
                sizes = part.column("n").to_numpy()
                least, columns = np.repeat(part.column("least").to_numpy(), sizes), part.columns[3:] if seat[i] < _SEATS else part.columns[4:]
                columns = [_unpacked(x.to_pylist(), sizes.tolist()) for x in columns if x.null_count == 0]
                if seat[i] == _SEATS:
                    a, place_a, b, place_b = columns
                    yield _met(a + least, b + least, place_a, place_b)
                    continue
                if seat[i] != last and n >= _SEAT_ROWS // 4:
                    yield pairs(held)[0]
                    held, n, most = [], 0, _SEAT_ROWS
                key, doc, place = columns
                held.append([key, doc + least, place])
                n, last = n + len(key), seat[i]
                if n >= most:
                    met, left = pairs(held)
                    yield met
                    held, n = [left], len(left[0])
                    most = max(_SEAT_ROWS, 2 * n)
        if held:
            yield pairs(held)[0]

    return found.repartition("seat").sortWithinPartitions("seat", "least").mapInArrow(run, "a long, b long, place_a long, place_b long")


def hashed_words(docs: DataFrame) -> DataFrame:
    """doc_id, tag, places, words array<int>: the word hashes of each text, 32 bits each. Equal rows side by side give one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for part in slices(batches):
            own = list(zip(part.column("doc_id").to_pylist(), part.column("tag").to_pylist(), strict=True))
            new = pa.array([x != y for x, y in zip(own, [last, *own], strict=False)])
            last = own[-1]
            part = part.filter(new)
            words, sizes = flat_words(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tag"), part.column("places"), list_array((words >> np.uint64(32)).astype(np.uint32).view(np.int32), sizes, pa.int32())], names=["doc_id", "tag", "places", "words"])

    return docs.select("doc_id", "tag", "places", "text").mapInArrow(run, "doc_id long, tag long, places array<int>, words array<int>")


def _ranges(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in any of the ranges (ends exclusive)."""
    edges = np.bincount(np.clip(starts, 0, n), minlength=n + 1) - np.bincount(np.clip(ends, 0, n), minlength=n + 1)
    return np.cumsum(edges)[:n] > 0


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Words of lists end to end, and where each list begins and the last one ends."""
    offsets = lists.offsets.to_numpy()
    return lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.int32, copy=False).view(np.uint32).astype(np.uint64), offsets - offsets[0]


def _at(lists: pa.ListArray, words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the lists, as places in the words end to end, and where their texts end."""
    offsets = lists.offsets.to_numpy()
    text = np.repeat(np.arange(len(lists)), np.diff(offsets))
    at = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.int64)
    ok = at < (ends[1:] - ends[:-1])[text]  # texts of one doc_id share the list of places
    return at[ok] + ends[text[ok]], text[ok]


def _covered(lists: pa.ListArray, ends: np.ndarray, size: int, exact: bool, n: int) -> np.ndarray:
    """At which of n words a run of `size` words begins that lies within one of the found passages, or one of the exact ones."""
    offsets = lists.offsets.to_numpy()
    text = np.repeat(np.arange(len(lists)), np.diff(offsets))
    first, last, same = (lists.values.field(k).to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]] for k in range(3))
    ok = same.astype(bool) | (not exact)
    first, last = first[ok].astype(np.int64) + ends[text[ok]], last[ok].astype(np.int64) + ends[text[ok]]
    return _ranges(first, np.maximum(first, last - size + 1), n)


def whole_runs(words: DataFrame, passage: int, functions: int) -> DataFrame:
    """words: doc_id, words, places, covered. SEATED of the runs of `passage` words that another document may hold.

    If one does, the least shingles of the run, by every function, are at places that share a block; other runs are
    left out. So are runs within an exact passage that was found: its earlier document holds them, so whoever holds a run
    first is not left out, and others that hold it meet that one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            flat, ends = _flat(part.column("words"))
            if len(flat) < passage:
                continue
            shared = np.zeros(len(flat), bool)
            shared[_at(part.column("places"), flat, ends)[0]] = True
            blocks = Blocks(flat)
            ok = ~_covered(part.column("covered"), ends, passage, True, len(flat))[: len(flat) - passage + 1]
            for order, bits in _orders(blocks, functions):
                ok &= shared[(_lows(order, passage - SHINGLE + 1) & np.uint64((1 << bits) - 1)).astype(np.int64)]
            s = np.flatnonzero(ok)
            of = np.searchsorted(ends, s, "right") - 1
            within = s + passage <= ends[of + 1]
            s, of = s[within], of[within]
            yield from _starred([(mix(blocks.at(s, passage)), part.column("doc_id").to_numpy()[of], s - ends[of] << 16)])

    return words.select("doc_id", "words", "places", "covered").mapInArrow(run, SEATED)


def near_runs(words: DataFrame, passage: int) -> DataFrame:
    """words: doc_id, words, places, covered. key, doc_id, place of chosen runs of NEAR
    words within `passage` words of a place; the lowest bit of place says that no found passage covers the run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            flat, ends = _flat(part.column("words"))
            if len(flat) < NEAR + NEAR_OF:
                flat = np.append(flat, np.zeros(NEAR + NEAR_OF, np.uint64))
            c, text = _at(part.column("places"), flat, ends)
            near = _ranges(np.maximum(c - passage, ends[text]), np.minimum(c + passage, ends[text + 1]), len(flat))
            keys = mix(Blocks(flat).every(NEAR))
            low = np.lib.stride_tricks.sliding_window_view(keys, NEAR_OF).argmin(axis=1) + np.arange(len(keys) - NEAR_OF + 1)
            s = np.unique(low)
            of = np.minimum(np.searchsorted(ends, s, "right") - 1, len(ends) - 2)
            ok = (s + NEAR <= ends[of + 1]) & near[s] & near[np.minimum(s + NEAR - 1, len(flat) - 1)]
            s, of = s[ok], of[ok]
            place = s - ends[of] << 16 | ~_covered(part.column("covered"), ends, NEAR, False, len(flat))[s]
            yield pa.RecordBatch.from_arrays([pa.array(keys[s].view(np.int64)), pa.array(part.column("doc_id").to_numpy()[of]), pa.array(place)], names=["key", "doc_id", "place"])

    return words.select("doc_id", "words", "places", "covered").mapInArrow(run, "key long, doc_id long, place long")


def near_pairs(found: DataFrame) -> DataFrame:
    """a, b, place_a, place_b: runs that no found passage covers, with those of the first document that has the same run
    and of the PARTNERS nearest ones before. Where no more documents hold a run, that is all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3  # the first row of each document that may be a partner: the key's first and its last ones
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [batch.column(c).to_numpy() for c in ("key", "doc_id", "place")]
            n = len(held[0])
            key, doc, place = (np.concatenate(x) for x in zip(held, own, strict=True))
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])
            begin = np.flatnonzero(new)
            unit = np.cumsum(new) - 1  # a document's rows of a key
            of_key = key[begin]
            first = np.flatnonzero(np.concatenate([[True], of_key[1:] != of_key[:-1]]))
            first = np.repeat(first, np.diff(np.append(first, len(of_key))))
            rows = np.flatnonzero((place & 1 == 1) & (np.arange(len(key)) >= n))
            out = []
            for lag in range(PARTNERS + 1):
                to = unit[rows] - lag if lag else first[unit[rows]]
                ok = to >= first[unit[rows]] if lag else unit[rows] - to > PARTNERS
                a, b = rows[ok], begin[to[ok]]
                out.append((doc[a], doc[b], place[a], place[b]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["a", "b", "place_a", "place_b"])
            last = len(begin) - 1
            keep = begin[np.unique(np.append(np.arange(max(first[last], last - PARTNERS), last + 1), first[last]))]
            held = [key[keep], doc[keep], place[keep]]

    return found.repartition("key").sortWithinPartitions("key", "doc_id", "place").mapInArrow(run, "a long, b long, place_a long, place_b long")


def _reach(passage: int) -> int:
    """Words on either side of a run that an edited passage is looked for in: more than twice a passage in all."""
    return 2 * passage - NEAR + GAP + SHINGLE - 1


def _around(blocks: Blocks, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Values of the words from low to high."""
    return mix((blocks.sums[high] - blocks.sums[low]) * blocks.down[low] ^ mix((high - low).astype(np.uint64)))


def _kind(key: np.ndarray, begin: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Equal for rows of one key with equal words around the run."""
    return mix(key.view(np.uint64) ^ mix(around ^ begin.astype(np.uint64)))


def _first_equal(kind: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which rows, in order of documents, are free, or the first of their kind."""
    keep = place & 1 == 1
    keep[np.unique(kind, return_index=True)[1]] = True
    return keep


def contexts(words: DataFrame, passage: int) -> DataFrame:
    """words: doc_id, words, runs, covered. A row for each run of NEAR words at `runs`: key, doc_id, place as near_runs has
    it, begin and beside: the words around it, as far as an edited passage goes on beside it, and where the run is in them;
    bare, bare_end: from where to where not all of these words are covered.
    Of runs that overlap equal ones (repeated words), the first and the last: an edited passage goes on from one of these.
    Of runs with equal words around them that found passages cover, a slice gives the first document's only."""
    reach = _reach(passage)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            flat, ends = _flat(part.column("words"))
            at, of = _at(part.column("runs"), flat, ends)
            ok = at + NEAR <= ends[of + 1]
            at, of = at[ok], of[ok]
            if not len(at):
                continue
            key = mix(Blocks(flat).at(at, NEAR)).view(np.int64)
            order = np.lexsort((at, key, of))
            at, of, key = at[order], of[order], key[order]
            apart = (key[1:] != key[:-1]) | (of[1:] != of[:-1]) | (at[1:] - at[:-1] > NEAR)
            ok = np.concatenate([[True], apart]) | np.concatenate([apart, [True]])
            at, of, key = at[ok], of[ok], key[ok]
            place = at - ends[of] << 16 | ~_covered(part.column("covered"), ends, NEAR, False, len(flat))[at]
            low, high = np.maximum(at - reach, ends[of]), np.minimum(at + NEAR + reach, ends[of + 1])
            order = np.argsort(part.column("doc_id").to_numpy()[of], kind="stable")
            order = order[_first_equal(_kind(key[order], (at - low)[order], _around(Blocks(flat), low[order], high[order])), place[order])]
            at, of, key, place, low, high = (x[order] for x in (at, of, key, place, low, high))
            open_at = np.flatnonzero(~_covered(part.column("covered"), ends, 1, False, len(flat)))
            near = np.searchsorted(open_at, low), np.searchsorted(open_at, high) - 1
            has = near[0] <= near[1]  # none open: the run itself, which no one passage covers
            bare, bare_end = at.copy(), at + NEAR
            bare[has], bare_end[has] = open_at[near[0][has]], open_at[near[1][has]] + 1
            doc, flat = part.column("doc_id").to_numpy()[of], flat.astype(np.uint32).view(np.int32)
            for i in range(0, len(at), SLICE_ROWS):
                own = slice(i, i + SLICE_ROWS)
                sizes = (high - low)[own]
                beside = flat[np.repeat(low[own] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
                yield pa.RecordBatch.from_arrays([pa.array(key[own]), pa.array(doc[own]), pa.array(place[own]), *(pa.array((x - low)[own].astype(np.int32)) for x in (at, bare, bare_end)), list_array(beside, sizes, pa.int32())], names=["key", "doc_id", "place", "begin", "bare", "bare_end", "beside"])

    return words.select("doc_id", "words", "runs", "covered").mapInArrow(run, "key long, doc_id long, place long, begin int, bare int, bare_end int, beside array<int>")


def _over_edits(key: np.ndarray, place: np.ndarray, begin: np.ndarray, blocks: Blocks, ends: np.ndarray, passage: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles beside runs that several rows of a key have, behind different words: value, kind (of the words between
    shingle and run) and row, by value and row."""
    free, kept = place & 1 == 1, []
    at, low, high = ends[:-1] + begin, ends[:-1], ends[1:]
    parts = max(1, len(key) // _ROWS)  # parts of the shingles' hashes, one after the other
    for part in range(parts):
        keys, kinds, rows = [], [], []
        for side in (0, 1):
            for between in range(passage - NEAR + GAP):
                shingle = at - between - SHINGLE if side else at + NEAR + between
                own = np.flatnonzero((shingle >= low) & (shingle + SHINGLE <= high))
                value = mix(key[own].view(np.uint64) ^ mix(blocks.at(shingle[own], SHINGLE) ^ np.uint64(side)))
                if parts > 1:
                    mine = value % np.uint64(parts) == part
                    own, value = own[mine], value[mine]
                keys.append(value)
                rows.append(own)
                kinds.append(mix(blocks.at((at[own] - between) if side else at[own] + NEAR, between) ^ np.uint64(between)))
        value, kind, row = (np.concatenate(x) for x in (keys, kinds, rows))
        order = np.argsort(value)
        value, kind, row = value[order], kind[order], row[order]
        # shingles with one kind only are dropped: what the run and the shingle span is equal in all
        first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(value)))
        ok = np.zeros(len(first), bool)
        if len(first):
            ok = (np.minimum.reduceat(kind, first) != np.maximum.reduceat(kind, first)) & np.logical_or.reduceat(free[row], first)
        ok = np.repeat(ok, size)
        value, kind, row = value[ok], kind[ok], row[ok]
        order = np.lexsort((row, value))  # rows are in order of documents
        kept.append((value[order], kind[order], row[order]))
    value, kind, row = (np.concatenate(x) for x in zip(*kept, strict=True))
    return value, kind, row


def _carried_on(free: np.ndarray, value: np.ndarray, kind: np.ndarray, row: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each free row the rows of its key before it that share a shingle beside the run behind other words than those
    between the two in the other, ascending: the run goes on over an edit. value, kind, row: as `_over_edits` says."""
    if not len(value):
        return
    first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    first = np.repeat(first, np.diff(np.append(first, len(value))))
    entries = np.flatnonzero(free[row])
    entries = entries[np.argsort(row[entries], kind="stable")]
    for own in np.split(entries, np.flatnonzero(np.diff(row[entries])) + 1):
        sizes = own - first[own]
        to = np.repeat(first[own] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        to = to[kind[to] != np.repeat(kind[own], sizes)]
        if len(to):
            before = np.zeros(row[own[0]], bool)
            before[row[to[row[to] < len(before)]]] = True
            yield len(before), np.flatnonzero(before)


def _furthest(own: int, rows: np.ndarray, begin: np.ndarray, bare: tuple[int, int], flat: np.ndarray, ends: np.ndarray, codes: np.ndarray, place_of: np.ndarray, passage: int, percent: int, kind: np.ndarray, known: dict[tuple[int, int], list[tuple[int, int, int, int]]]) -> list[int]:
    """Of rows that an edited passage may join with the row `own`, those that leave nothing of it out: what lies around
    its run and is alike in any of the rows (`alike` on the words beside) lies within what is alike in the two returned
    that reach furthest before and behind. Where that does not reach an end at which the words beside are cut off, the
    row with most shingles in common that goes on there is returned as well, as a longer passage may be alike.

    bare: from where to where no found passage covers all words beside the run: it is enough to reach these. codes: numbers of the shingles that begin at each word of flat; place_of: -1 for every number. kind: equal for rows with
    equal words beside the run, which a text that repeats itself has many of; known: what `alike` said of two kinds."""
    low, high, at = int(ends[own]), int(ends[own + 1]), int(begin[own])
    n, words, reach = high - low - SHINGLE + 1, flat[low:high], _reach(passage)
    distinct, place = np.unique(codes[low : low + n], return_inverse=True)
    place_of[distinct] = np.arange(len(distinct))
    open_ends = at == reach, len(words) - at - NEAR == reach
    best, by, most, goes_on = [at, at + NEAR], [-1, -1], [0, 0], [-1, -1]
    for i in range(0, len(rows), _AT_ONCE):
        if by[0] >= 0 and best[0] <= bare[0] and best[1] >= bare[1]:
            break
        part = rows[i : i + _AT_ONCE]
        sizes = np.maximum(0, ends[part + 1] - ends[part] - SHINGLE + 1)
        hit = place_of[codes[np.repeat(ends[part] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]]
        of, to = np.repeat(np.arange(len(part)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes + begin[part], sizes)
        of, to, hit = of[hit >= 0], to[hit >= 0], hit[hit >= 0]
        met = np.full((len(part), len(distinct)), _NOWHERE, np.int32)  # where the row has the shingle, from its run on
        met[of, hit] = to
        again = np.bincount(of, minlength=len(part)) > (met != _NOWHERE).sum(axis=1)
        if len(distinct) < n:
            again[:] = True
        met = met[:, place]
        shared = met != _NOWHERE
        count = shared.sum(axis=1)
        # the widest ranges around the run that share enough shingles bound what a row may give; where a shingle is there
        # twice, how wide a range is in the row is not known: there, by the shingles of `own` alone
        sums = np.zeros((len(part), n + 1), np.int32)
        np.cumsum(np.where(again[:, None], 100 * shared - (percent - 5), (100 + percent) * shared - 2 * percent), axis=1, out=sums[:, 1:])
        shift = np.where(again[:, None] | ~shared, 0, percent * (met - (np.arange(n) - at)))
        before = np.where(shared, sums[:, :-1] - shift, _NOWHERE)[:, : at + 1]
        behind = np.where(shared, sums[:, 1:] - shift, -_NOWHERE)[:, at + NEAR - SHINGLE :]
        start = (before <= behind.max(axis=1)[:, None]).argmax(axis=1)
        end = len(words) - (behind >= before.min(axis=1)[:, None])[:, ::-1].argmax(axis=1)
        may = (behind.max(axis=1) >= before.min(axis=1)) & (end - start >= passage)
        start, end = np.maximum(start, bare[0]), np.minimum(end, bare[1])
        todo = np.argsort(-count, kind="stable")
        todo = todo[may[todo]]
        while len(todo := todo[(by[0] < 0) | (start[todo] < best[0]) | (end[todo] > best[1])]):
            row, todo = int(part[todo[0]]), todo[1:]
            both = int(kind[own]), int(kind[row])
            if both not in known:
                known[both] = alike(words, flat[ends[row] : ends[row + 1]], [(at, int(begin[row]))], passage, percent)
            for found in known[both]:
                if found[0] <= at and at + NEAR <= found[1]:
                    if found[0] < best[0] or by[0] < 0:
                        best[0], by[0] = found[0], row
                    if found[1] > best[1] or by[1] < 0:
                        best[1], by[1] = found[1], row
        for side, edge in enumerate((shared[:, : GAP + SHINGLE], shared[:, -GAP - SHINGLE :])):
            if open_ends[side]:
                on = np.where(edge.any(axis=1), count, 0)
                if on.max() > most[side]:
                    most[side], goes_on[side] = int(on.max()), int(part[on.argmax()])
    place_of[distinct] = -1
    further = [row for row, done in zip(goes_on, (best[0] <= bare[0], best[1] >= bare[1]), strict=True) if by[0] < 0 or not done]
    return sorted({*by, *further} - {-1})


def rest_pairs(found: DataFrame, passage: int, percent: int) -> DataFrame:
    """a, b, place_a, place_b: for runs that more documents hold than near_pairs compares. Of all documents
    with the run, every two that an edited passage may join (those of which the run goes on over an edit) are compared
    within the task, on the words beside it. What leaves it are at most four partners of each run that no found passage
    covers, as `_furthest` says; so rows are linear. Of equal words beside a run the first document's stand for all."""

    def pairs(groups: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(groups).combine_chunks().to_batches()[0]
        key, doc, place, begin = (rows.column(c).to_numpy() for c in ("key", "doc_id", "place", "begin"))
        begin = begin.astype(np.int64)
        flat, ends = _flat(rows.column("beside"))
        kind = _kind(key, begin, _around(Blocks(flat), ends[:-1], ends[1:]))
        keep = _first_equal(kind, place)
        own = np.flatnonzero(keep)
        kind = np.unique(kind[own], return_inverse=True)[1]
        flat = flat[np.repeat(keep, np.diff(ends))]
        ends = np.concatenate([[0], np.cumsum(np.diff(ends)[own])])
        key, doc, place, begin = key[own], doc[own], place[own], begin[own]
        bare = [tuple(x) for x in zip(*(rows.column(c).to_numpy()[own].tolist() for c in ("bare", "bare_end")), strict=True)]
        blocks = Blocks(flat)
        edits = _over_edits(key, place, begin, blocks, ends, passage)
        looked = np.zeros(len(key), bool)
        looked[edits[2]] = True  # only these rows are compared
        at = np.flatnonzero(np.repeat(looked, np.diff(ends))[: max(0, len(flat) - SHINGLE + 1)])
        codes = np.zeros(len(flat) + SHINGLE, np.int64)
        codes[at] = np.unique(blocks.every(SHINGLE)[at], return_inverse=True)[1] if len(at) else 0
        place_of, out = np.full(len(at) + 1, -1, np.int64), []
        often, known = np.bincount(kind) > 1, {}
        for row, others in _carried_on(place & 1 == 1, *edits):
            others = others[doc[others] != doc[row]]
            again = often[kind[others]]
            if again.any():  # later ones of a kind give nothing more
                several = others[again]
                others = np.sort(np.concatenate([others[~again], several[np.unique(kind[several], return_index=True)[1]]]))
            if len(known) > _KNOWN:
                known.clear()
            out += [(row, to) for to in _furthest(row, others, begin, bare[row], flat, ends, codes, place_of, passage, percent, kind, known if often[kind[row]] else {})]
        a, b = np.array(out, np.int64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[a], doc[b], place[a], place[b])], names=["a", "b", "place_a", "place_b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the key that is not complete, and of complete ones before it
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            last = int(np.searchsorted(key, key[-1]))  # where the last key of the batch begins
            whole = bool(held) and held[-1].column("key")[-1].as_py() != key[0]
            if n >= _ROWS // 4 and (whole or last):
                to = 0 if whole else int(np.searchsorted(key, key[0], "right"))
                yield pairs([*held, batch.slice(0, to)] if to else held)
                held, n, batch = [], 0, batch.slice(to)
            held.append(batch)
            n += batch.num_rows
        if held:
            yield pairs(held)

    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number: few bytes take much work, and would be joined
    return found.repartition(parts, "key").sortWithinPartitions("key", "doc_id", "place").mapInArrow(run, "a long, b long, place_a long, place_b long")


def word_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in code points."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.diff(np.concatenate([[0], word.astype(np.int8), [0]]))
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return points[np.flatnonzero(edge == 1)], points[np.flatnonzero(edge == -1)]


def _same(a: np.ndarray, b: np.ndarray) -> int:
    """How many words two sequences begin with in common."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        differ = a[at : min(n, at + step)] != b[at : min(n, at + step)]
        first = int(differ.argmax())
        if differ[first]:
            return at + first
        at, step = at + step, 4 * step
    return n


def _exact_run(a: np.ndarray, b: np.ndarray, ca: int, cb: int) -> tuple[int, int, int, int]:
    """The longest run of equal words around equal words at ca and cb."""
    right, left = _same(a[ca:], b[cb:]), _same(a[:ca][::-1], b[:cb][::-1])
    return ca - left, ca + right, cb - left, cb + right


def _neighbours(x: np.ndarray, y: np.ndarray, run: tuple[int, int, int, int]) -> list[tuple[int, int]]:
    """Places of the nearest equal shingles within GAP words after and before a run; x, y: the texts' shingles."""
    out = []
    after = x[run[1] : run[1] + GAP + 1, None] == y[None, run[3] : run[3] + GAP + 1]
    left, low = run[0] - SHINGLE, run[2] - SHINGLE
    before = x[max(0, left - GAP) : max(0, left + 1), None][::-1] == y[None, max(0, low - GAP) : max(0, low + 1)][:, ::-1]
    for found, at in ((after, lambda i, j: (run[1] + i, run[3] + j)), (before, lambda i, j: (left - i, low - j))):
        i, j = np.nonzero(found)
        if len(i):
            nearest = int((i + j).argmin())
            out.append(at(int(i[nearest]), int(j[nearest])))
    return out


def alike(a: np.ndarray, b: np.ndarray, seeds: list[tuple[int, int]], passage: int, percent: int) -> list[tuple[int, int, int, int]]:
    """Verified passages as word ranges a0, a1, b0, b1 (ends exclusive) of two texts' word hashes.

    A run that a seed lies in is carried on over edits, so that one seed is enough for a passage of several runs."""
    seen: set[tuple[int, int, int, int]] = set()
    begun: dict[int, list[tuple[int, int]]] = {}  # ranges of runs by diagonal, ascending; they never overlap
    distinct, both = np.unique(np.concatenate([Blocks(w).every(SHINGLE) for w in (a, b)]), return_inverse=True)
    if 100 * (len(both) - len(distinct)) < percent * (passage - SHINGLE + 1):  # a passage's shared and repeated shingles are more
        return []
    x, y = np.split(both, [len(a) - SHINGLE + 1])
    known = -1
    for seed in seeds:
        if seed[0] < known:  # within an exact run of a whole passage
            continue
        todo = [seed]
        while todo:
            ca, cb = todo.pop()
            if ca >= len(a) or cb >= len(b) or a[ca] != b[cb]:
                continue
            ranges = begun.setdefault(ca - cb, [])
            k = bisect_right(ranges, (ca, len(a)))
            if k and ca < ranges[k - 1][1]:
                continue
            run = _exact_run(a, b, ca, cb)
            seen.add(run)
            ranges.insert(k, run[:2])
            if run[1] - run[0] >= passage and (ca, cb) == seed:
                known = max(known, run[1])
            todo += _neighbours(x, y, run)
    return _joined(sorted(seen), x, y, passage, percent)


def _joined(runs: list[tuple[int, int, int, int]], x: np.ndarray, y: np.ndarray, passage: int, percent: int) -> list[tuple[int, int, int, int]]:
    """Passages out of exact runs in ascending order, a few words apart; x, y: shingles at the runs' places in either text."""
    chains: list[list[tuple[int, int, int, int]]] = []
    growing: list[list[tuple[int, int, int, int]]] = []  # those that end no more than GAP words before the run
    for r in runs:
        growing = [chain for chain in growing if r[0] - chain[-1][1] <= GAP]
        for chain in reversed(growing):
            last = chain[-1]
            if -4 <= r[0] - last[1] and -4 <= r[2] - last[3] <= GAP:
                chain.append(r)
                break
        else:
            chains.append([r])
            growing.append(chains[-1])
    out = []
    for chain in chains:
        found = (chain[0][0], max(r[1] for r in chain), chain[0][2], max(r[3] for r in chain))
        if min(found[1] - found[0], found[3] - found[2]) < passage:
            continue
        if len(chain) == 1:  # equal
            out.append(found)
            continue
        start_a, end_a, start_b, end_b = np.array(chain).T
        low_a, low_b = found[0], int(start_b.min())
        p = x[low_a : found[1] - SHINGLE + 1]
        number = np.unique(np.concatenate([p, y[low_b : found[3] - SHINGLE + 1]]), return_inverse=True)[1]
        p, q = number[: len(p)], number[len(p) :]
        of_a, of_b = np.zeros((2, int(number.max()) + 1), bool)

        def passes(one: tuple[int, int, int, int]) -> bool:
            if min(one[1] - one[0], one[3] - one[2]) < passage:
                return False
            own, other = p[one[0] - low_a : one[1] - SHINGLE + 1 - low_a], q[one[2] - low_b : one[3] - SHINGLE + 1 - low_b]  # noqa: B023
            of_a[own], of_b[other] = True, True  # noqa: B023
            in_a, in_b = int(np.count_nonzero(of_a)), int(np.count_nonzero(of_b))  # noqa: B023
            both = int(np.count_nonzero(of_a & of_b))  # noqa: B023
            of_a[own], of_b[other] = False, False  # noqa: B023
            return 100 * both >= percent * (in_a + in_b - both)

        if passes(found):
            out.append(found)
            continue
        # the longest part that passes from each run on, unless it ends within an earlier one; shared shingles are about those of the runs
        end_a, end_b = np.maximum.accumulate(end_a), np.maximum.accumulate(end_b)
        shared = np.concatenate([[0], np.cumsum(np.maximum(0, [r[1] - r[0] - SHINGLE + 1 for r in chain]))])
        wide, high, both = end_a[None] - start_a[:, None], end_b[None] - start_b[:, None], shared[None, 1:] - shared[:-1, None]
        likely = (np.minimum(wide, high) >= passage) & (100 * both >= (percent - 2) * (wide + high - 2 * (SHINGLE - 1) - both))
        reach = 0
        for i in np.flatnonzero(likely.any(axis=1)).tolist():
            for j in np.flatnonzero(likely[i])[::-1].tolist():
                one = (int(start_a[i]), int(end_a[j]), int(start_b[i]), int(end_b[j]))
                if one[1] <= reach:
                    break
                if passes(one):
                    out.append(one)
                    reach = one[1]
                    break
    return out


def _common(blocks: Blocks, i: np.ndarray, j: np.ndarray, most: np.ndarray, side: int) -> np.ndarray:
    """How many words are equal from places i and j on (side 1), or before them (side -1): at most `most`."""
    n = np.zeros(len(i), np.int64)
    step = 1 << int(most.max(initial=0)).bit_length()
    while step := step >> 1:
        at = np.flatnonzero(n + step <= most)
        shift = n[at] if side > 0 else -n[at] - step
        n[at[blocks.at(i[at] + shift, step) == blocks.at(j[at] + shift, step)]] += step
    return n


def _all_neighbours(shingles: np.ndarray, edge: np.ndarray, edge_b: np.ndarray, bound: np.ndarray, bound_b: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As `_neighbours`, for many runs: which of them have one after (side 1) or before them, and its places. edge: where
    the first shingle beside the run is, in either text; bound: the last place there that has a shingle, or the first."""
    by = np.arange(GAP + 1)
    found = []
    for at, to in ((edge, bound), (edge_b, bound_b)):
        place = at[:, None] + side * by
        found.append((shingles[np.clip(place, 0, len(shingles) - 1)], (place - to[:, None]) * side <= 0))
    (p, in_a), (q, in_b) = found
    equal = (p[:, :, None] == q[:, None]) & in_a[:, :, None] & in_b[:, None]
    far = np.where(equal, (by[:, None] + by).astype(np.int8), np.int8(127)).reshape(len(edge), -1)
    nearest = far.argmin(axis=1)
    has = np.flatnonzero(far[np.arange(len(far)), nearest] < 127)
    return has, edge[has] + side * (nearest[has] // (GAP + 1)), edge_b[has] + side * (nearest[has] % (GAP + 1))


def alike_all(words_a: pa.ListArray, words_b: pa.ListArray, seeds: pa.ListArray, passage: int, percent: int) -> list[tuple[int, int, int, int, int, bool]]:
    """What `alike` says of each of many pairs of texts: number of the pair, a0, a1, b0, b1, whether the words are equal.

    The runs of all pairs are found at once: those that seeds lie in, then those beside them, and so on."""
    (flat_a, ends), (flat_b, ends_b) = _flat(words_a), _flat(words_b)
    words = np.concatenate([flat_a, flat_b])
    ends_b = ends_b + len(flat_a)
    if len(words) < SHINGLE:
        return []
    blocks = Blocks(words)
    shingles = blocks.every(SHINGLE)
    offsets = seeds.offsets.to_numpy()
    of = np.repeat(np.arange(len(seeds)), np.diff(offsets))
    i, j = (seeds.values.field(k).to_numpy()[offsets[0] : offsets[-1]].astype(np.int64) + x[of] for k, x in enumerate((ends, ends_b)))
    ok = (i < ends[of + 1]) & (j < ends_b[of + 1])
    of, i, j = of[ok], i[ok], j[ok]
    ok = words[i] == words[j]
    order = np.lexsort((j[ok], i[ok]))
    of, i, j = of[ok][order], i[ok][order], j[ok][order]
    seed_at, seed_of, seed_key = i, of, None
    keys, rows, links = [np.zeros(0, np.int64)], [], []
    met = keys[0]  # keys in order
    source = None  # runs that the places lie beside
    while len(i):
        right = _common(blocks, i, j, np.minimum(ends[of + 1] - i, ends_b[of + 1] - j), 1)
        left = _common(blocks, i, j, np.minimum(i - ends[of], j - ends_b[of]), -1)
        key = i - left << 32 | j - left  # a place in words_a is of one pair
        if source is None:
            seed_key = key
        else:
            links.append((source, key))
        new = np.argsort(key)
        new = new[np.concatenate([[True], np.diff(key[new]) > 0])]
        if len(met):
            new = new[met[np.minimum(np.searchsorted(met, key[new]), len(met) - 1)] != key[new]]
        if not len(new):
            break
        own = np.stack([of[new], (i - left)[new], (i + right)[new], (j - left)[new], (j + right)[new]])
        keys.append(key[new])
        met = np.sort(np.concatenate([met, key[new]]))
        rows.append(own)
        beside = []
        for at in range(0, len(new), 4096):
            pair, low, high, low_b, high_b = own[:, at : at + 4096]
            for side, edges in ((1, (high, high_b, ends[pair + 1] - SHINGLE, ends_b[pair + 1] - SHINGLE)), (-1, (low - SHINGLE, low_b - SHINGLE, ends[pair], ends_b[pair]))):
                has, to, to_b = _all_neighbours(shingles, *edges, side)
                beside.append((pair[has], to, to_b, key[new][at : at + 4096][has]))
        of, i, j, source = (np.concatenate(x) for x in zip(*beside, strict=True))
    if not rows:
        return []
    runs = np.concatenate(rows, axis=1)
    runs = runs[:, np.argsort(np.concatenate(keys))]
    # a seed within an exact passage that an earlier seed gave is passed over, with what only it leads to
    wide = runs[2] - runs[1] >= passage
    seed_run = np.searchsorted(met, seed_key)
    passed = np.zeros(len(ends) - 1, bool)
    passed[seed_of[wide[seed_run]]] = True
    keep = ~passed[runs[0]]
    if passed.any():
        after: dict[int, list[int]] = {}
        for source, to in links:
            mine = np.flatnonzero(passed[runs[0][np.searchsorted(met, source)]])
            for r, k in zip(np.searchsorted(met, source[mine]).tolist(), np.searchsorted(met, to[mine]).tolist(), strict=True):
                after.setdefault(r, []).append(k)
        mine = passed[seed_of]
        known, seen, high = -1, set(), runs[2].tolist()
        is_wide = wide.tolist()
        for at, r in zip(seed_at[mine].tolist(), seed_run[mine].tolist(), strict=True):
            if at < known or r in seen:  # places of later pairs are beyond what is known
                continue
            if is_wide[r]:
                known = max(known, high[r])
            todo = [r]
            while todo:
                one = todo.pop()
                if one not in seen:
                    seen.add(one)
                    todo += after.get(one, ())
        keep[list(seen)] = True
    runs = runs[:, keep]
    # runs no more than GAP words apart, pair by pair; others join no passage
    runs = runs[:, np.lexsort((runs[3], runs[2], runs[1]))]
    reach = np.maximum.accumulate(runs[2])
    begins = np.flatnonzero(np.concatenate([[True], (runs[1][1:] - reach[:-1] > GAP) | (runs[0][1:] != runs[0][:-1])]))
    stops = np.append(begins[1:], runs.shape[1])
    out = []
    for k in np.flatnonzero(reach[stops - 1] - runs[1][begins] >= passage).tolist():
        pair = int(runs[0, begins[k]])
        a, b = int(ends[pair]), int(ends_b[pair])
        for one in _joined(list(zip(*runs[1:, begins[k] : stops[k]].tolist(), strict=True)), shingles, shingles, passage, percent):
            out.append((pair, one[0] - a, one[1] - a, one[2] - b, one[3] - b, np.array_equal(words[one[0] : one[1]], words[one[2] : one[3]])))
    return out


FOUND = "doc_id long, tag long, first_word int, last_word int, of_doc_id long, of_first_word int, of_last_word int, exact boolean"


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together, so that steps over many small ones are few, up to _GATHERED bytes."""
    held, size = [], 0
    for batch in slices(batches):
        if held and size + batch.nbytes > _GATHERED:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield pa.concat_batches(held)


def verified(pairs: DataFrame, words: DataFrame, passage: int, percent: int) -> DataFrame:
    """pairs: a, b, shared (places of equal blocks). Passages of a that b has, as ranges of words, and whether they are equal."""
    left = words.select(F.col("doc_id").alias("a"), "tag", F.col("words").alias("words_a"))
    both = pairs.join(left, "a").join(words.select(F.col("doc_id").alias("b"), F.col("words").alias("words_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
        names = [x.split()[0] for x in FOUND.split(", ")]
        for part in _gathered(batches):
            ids = [part.column(c).to_pylist() for c in ("a", "tag", "b")]
            rows = [(ids[0][i], ids[1][i], *found[:2], ids[2][i], *found[2:]) for i, *found in alike_all(*(part.column(c) for c in ("words_a", "words_b", "shared")), passage, percent)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return both.select("a", "tag", "b", "shared", "words_a", "words_b").mapInArrow(run, FOUND)


def _in_characters(found: DataFrame, docs: DataFrame) -> DataFrame:
    """found with start and end in code points of the document's text."""
    own = found.groupBy("doc_id", "tag").agg(F.collect_set(F.struct(*[c for c in found.columns if c not in ("doc_id", "tag")])).alias("rows"))
    out = "doc_id long, tag long, start int, end int, first_word int, last_word int, of_doc_id long, of_first_word int, of_last_word int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            lists = part.column("rows")
            ends, flat = lists.offsets.to_numpy(), lists.values
            first, last = (flat.field(c).to_numpy() for c in ("first_word", "last_word"))
            start, end = np.zeros(len(first), np.int32), np.zeros(len(first), np.int32)
            for i, text in enumerate(part.column("text").to_pylist()):
                own = slice(ends[i], ends[i + 1])
                starts, stops = word_spans(text)
                start[own], end[own] = starts[first[own]], stops[last[own] - 1]
            docs_, tags = (np.repeat(part.column(c).to_numpy(), np.diff(ends)) for c in ("doc_id", "tag"))
            own = slice(ends[0], ends[-1])
            columns = [pa.array(docs_), pa.array(tags), pa.array(start[own]), pa.array(end[own])] + [flat.field(c).slice(ends[0], ends[-1] - ends[0]) for c in ("first_word", "last_word", "of_doc_id", "of_first_word", "of_last_word")]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in out.split(", ")])

    return docs.join(own, ["doc_id", "tag"]).select("doc_id", "tag", "text", "rows").mapInArrow(run, out)


def _tagged(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return id_and_text(df, id_col, text_col).withColumn("tag", F.xxhash64("text"))


def found_passages(docs: DataFrame, passage: int = PASSAGE, percent: int = 80, functions: int = FUNCTIONS, placed: DataFrame | None = None) -> DataFrame:
    """docs: doc_id, text, tag. FOUND with start and end in code points, as repeated_passages says. placed: the same rows
    dealt by doc_id, if there are such, for the joins; windows are read in the order of docs, slice by slice."""
    spark = docs.sparkSession
    placed = docs if placed is None else placed

    def paired(met: DataFrame) -> DataFrame:
        at = F.shiftright("place_a", 16).cast("int").alias("a"), F.shiftright("place_b", 16).cast("int").alias("b")
        return met.where("a != b").groupBy("a", "b").agg(F.collect_set(F.struct(*at)).alias("shared"))

    def compared(pairs: DataFrame, name: str) -> DataFrame:
        with arrow_rows(spark, _PAIRS_AT_ONCE):
            return stored(verified(pairs, words, passage, percent), name)

    with scratch(spark):
        with scratch(spark):
            met = stored(window_pairs(windows(docs, passage, functions)), "met")
            each = F.explode(F.array(*[F.struct(F.col(x).alias("doc_id"), F.shiftright(f"place_{x}", 16).cast("int").alias("c")) for x in "ab"]))
            places = stored(met.select(each.alias("x")).groupBy("x.doc_id").agg(F.collect_set("x.c").alias("places")), "places", keep=True)
            pairs = stored(paired(met.where(_may_hold(passage))), "pairs", keep=True)
        words = stored(hashed_words(placed.join(places, "doc_id").sortWithinPartitions("doc_id", "tag")), "words")
        def left_of(rows: DataFrame, *found: DataFrame) -> DataFrame:
            covered = reduce(DataFrame.union, found).groupBy("doc_id", "tag").agg(F.collect_set(F.struct("first_word", "last_word", "exact")).alias("covered"))
            none = F.array().cast("array<struct<first_word:int,last_word:int,exact:boolean>>")
            return rows.join(covered, ["doc_id", "tag"], "left").withColumn("covered", F.coalesce("covered", none))

        found = compared(pairs, "passages")
        left = left_of(words, found)
        with scratch(spark):  # a table at a time, so that the shuffle files of one are gone when the next is made
            runs = stored(near_runs(left, passage), "runs")
            met = [stored(window_pairs(whole_runs(left, passage, functions)), "met"), stored(near_pairs(runs), "met")]
            more = stored(paired(met[0].union(met[1])), "more", keep=True)  # pairs met before are compared at new places
            held = runs.groupBy("key", "doc_id").agg(F.max(F.col("place").bitwiseAND(1)).alias("free"))
            often = stored(held.groupBy("key").agg(F.count("*").alias("n"), F.max("free").alias("free")).where(f"n > {PARTNERS + 1} and free = 1"), "often")
            many = stored(runs.join(often, "key", "left_semi").groupBy("doc_id").agg(F.collect_set(F.shiftright("place", 16).cast("int")).alias("runs")), "many", keep=True)
        again = compared(more, "again")
        with scratch(spark):
            left = stored(left_of(words.join(many, "doc_id"), found, again), "left")
            pairs = stored(paired(rest_pairs(contexts(left, passage), passage, percent)), "rest_pairs", keep=True)
        rest = compared(pairs, "rest")
        return stored(_in_characters(found.union(again).union(rest).drop("exact"), placed), "placed", keep=True)


def repeated_passages(df: DataFrame, passage: int = PASSAGE, percent: int = 80, functions: int = FUNCTIONS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per passage of at least `passage` words that a document with a smaller doc_id has as well: doc_id, start,
    end (code points, end exclusive), first_word, last_word (exclusive), of_doc_id, of_first_word, of_last_word."""
    return found_passages(_tagged(df, id_col, text_col), passage, percent, functions).drop("tag").distinct()


def merged_spans(found: DataFrame) -> DataFrame:
    """doc_id, tag, spans: the union of the repeated ranges of a document's text, sorted, as arrays of start and end."""
    ordered = F.array_sort(F.collect_set(F.struct("start", "end")))
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc, s):
        last = F.try_element_at(acc, F.lit(-1))
        longer = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (s["start"] <= last["end"]), longer).otherwise(F.concat(acc, F.array(s)))

    return found.groupBy("doc_id", "tag").agg(ordered.alias("all")).select("doc_id", "tag", F.aggregate("all", empty, step).alias("spans"))


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """df with every passage cut out that a document with a smaller doc_id has as well; the first occurrence stays.
    A document of which nothing is left goes. Other columns are as they were, whatever their names; rows without an id
    are left alone. Texts are dealt once, to buckets by doc_id, where all joins with them take place."""
    spark = df.sparkSession
    rows = df.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))).alias("tag"), row_of(df))
    text = F.col("row").getField(text_col).cast("string")
    known = rows.where(F.col("doc_id").isNotNull())
    texts = lambda df: df.select("doc_id", F.coalesce(text, F.lit("")).alias("text"), "tag")
    parts = text_parts(spark, rows.agg(F.sum(F.octet_length(text))).first()[0] or 0)
    with scratch(spark):
        placed = bucketed(known.repartition(parts, "doc_id"), "documents", parts, "doc_id", keep=True)
        found = found_passages(texts(known), placed=texts(placed), **options)
        spans = stored(merged_spans(found), "spans", keep=True)
    joined = placed.join(spans, ["doc_id", "tag"], "left")
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate("spans", zero, lambda acc, s: F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"])).alias("out")))
    cut = F.element_at(F.transform(F.array(done), lambda d: F.concat(d["out"], F.substring(text, d["at"] + 1, F.length(text)))), 1)
    kept = joined.withColumn("cut", F.when(F.col("spans").isNotNull(), cut)).where(F.col("spans").isNull() | (F.trim("cut") != ""))
    new = F.when(F.col("spans").isNull(), F.col("row").getField(text_col)).otherwise(F.col("cut"))
    return kept.select(*columns_of(df, {text_col: new})).unionByName(rows.where(F.col("doc_id").isNull()).select(*columns_of(df, {})))
