"""Best-fit packing by bin completion.

Lengths are whole numbers up to the sequence length, so a corpus of any size is described by one count per length:
that histogram (at most `size` rows) is all the driver sees. Bin completion works on it: take the largest length that
is left, enumerate undominated fillings of the room beside it, depth first from large to small, pruned by the waste
of the best filling so far (the incumbent starts as the best-fit filling), and use the filling as often as the counts
allow. The result is a list of patterns.

Where that needs more sequences than the lower bound (Martello and Toth's L2), the sequences of most waste are opened and
packed anew by branch and bound: branching over the undominated fillings beside their largest item, least waste first, cut
off where sequences so far and the lower bound of what is left reach the incumbent. Small inputs are opened whole. The
search ends after BRANCHES nodes, TAIL items at a time; then the incumbent stands, so a packing is never worse for it, but
beyond that budget it is not proven to be the smallest.

A piece finds its sequence by arithmetic from its rank among the pieces of its length; ranks are counted inside each task
and shifted by the counts of the tasks before it, so neither a hot length nor a hot source gathers anywhere.

Defined cases: null or empty text is one piece of the end id alone; equal texts are packed like any other; an empty
table gives no rows; a null doc_id is kept.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, slices, stored
from .encode import Encoder

#: Fillings looked at for one pattern before the incumbent is taken; the number of patterns is bounded by the lengths.
NODES = 1500
#: Items that the search, not the incumbent, may put in one filling.
DEPTH = 60
#: Items that are opened together for branch and bound, and fillings that it branches into before the incumbent stands.
TAIL, BRANCHES = 64, 20_000


def completion(counts: list[int], lengths: list[int], room: int, nodes: int = NODES) -> list[int]:
    """The least wasteful filling of `room` with available lengths (ascending `lengths`, `counts` by length).

    Only undominated fillings are visited: within a filling lengths descend, and where an item fits exactly into the
    rest, any split of it into smaller items is dominated and skipped. Ties prefer larger and so fewer items.
    """
    best: list[int] = []
    rest = room
    for i in range(bisect_right(lengths, room) - 1, -1, -1):  # the incumbent: best fit, largest first
        n = lengths[i]
        while n <= rest and counts[n] > best.count(n):
            best.append(n)
            rest -= n
        if not rest:
            return best
    waste, seen, upto = rest, 0, [0]
    for n in lengths:
        upto.append(upto[-1] + n * counts[n])

    def search(top: int, rest: int, taken: list[int]) -> bool:
        nonlocal best, waste, seen
        if rest - upto[top + 1] >= waste:  # all that is left would waste as much
            return False
        seen += 1
        if rest < waste:
            best, waste = list(taken), rest
            if not waste:
                return True
        if seen > nodes:
            return True
        if len(taken) == DEPTH:
            return False
        if rest <= (taken[-1] if taken else rest) and counts[rest] > taken.count(rest):
            best, waste = [*taken, rest], 0
            return True
        i = min(top, bisect_right(lengths, rest) - 1)
        while i >= 0:
            n = lengths[i]
            if counts[n] > taken.count(n):
                taken.append(n)
                if search(i, rest - n, taken):
                    return True
                taken.pop()
            if seen > nodes:
                return True
            i -= 1
        return False

    search(len(lengths) - 1, room, [])
    return best


def lower_bound(counts: list[int], size: int) -> int:
    """Martello and Toth's L2: sequences that any packing needs."""
    n = np.asarray(counts, dtype=object)
    lengths = np.arange(size + 1)
    total = int((n * lengths).sum())
    most = -(-total // size)
    for k in range(0, size // 2 + 1):
        large = int(n[size - k + 1 :].sum()) if k else 0
        mid_n = n[size // 2 + 1 : size - k + 1] if k else n[size // 2 + 1 :]
        mid = int(mid_n.sum())
        room = mid * size - int((mid_n * np.arange(size // 2 + 1, size // 2 + 1 + len(mid_n))).sum())
        small = int((n[k : size // 2 + 1] * np.arange(k, size // 2 + 1)).sum())
        most = max(most, large + mid + max(0, -(-(small - room) // size)))
    return most


def patterns(histogram: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """(times, lengths of one sequence): a packing of the histogram; every length is used exactly as often as it occurs."""
    counts = [0] * (size + 1)
    for n, k in histogram.items():
        counts[n] += k
    lengths = [n for n in range(1, size + 1) if counts[n]]
    out = []
    while lengths:
        first = lengths[-1]
        counts[first] -= 1
        filling = [first, *completion(counts, lengths, size - first)]
        counts[first] += 1
        times = min(counts[n] // filling.count(n) for n in set(filling))
        for n in filling:
            counts[n] -= times
        out.append((times, filling))
        lengths = [n for n in lengths if counts[n]]
    return improved(out, size)


def fillings(left: list[int], room: int, limit: int) -> list[tuple[int, ...]]:
    """Undominated fillings of `room` with items of `left` (descending), least waste first; at most `limit` are looked at.

    A filling is dominated, and skipped, if an item outside it could take the place of one or two within it, or be added."""
    out: list[tuple[int, ...]] = []
    looked = 0

    def dominated(taken: list[int], rest: int) -> bool:
        outside = list(left)
        for n in taken:
            outside.remove(n)
        for x in dict.fromkeys(outside):
            if x <= rest:
                return True
            for i, n in enumerate(taken):
                if n < x <= n + rest or any(n + m <= x <= n + m + rest for m in taken[i + 1 :]):
                    return True
        return False

    def extend(at: int, rest: int, taken: list[int]) -> None:
        nonlocal looked
        looked += 1
        if looked > limit:
            return
        last = None
        for i in range(at, len(left)):
            n = left[i]
            if n <= rest and n != last:
                last = n
                extend(i + 1, rest - n, [*taken, n])
        if not dominated(taken, rest):
            out.append(tuple(taken))

    extend(0, room, [])
    return sorted(dict.fromkeys(out), key=lambda f: (-sum(f), len(f)))


def branch_and_bound(items: list[int], size: int, incumbent: int, nodes: int = BRANCHES) -> list[list[int]] | None:
    """A packing of these items into fewer than `incumbent` sequences, the fewest that `nodes` fillings led to, or none."""
    best: list[list[int]] | None = None
    most, seen = incumbent, 0

    def bound(left: list[int]) -> int:
        counts = [0] * (size + 1)
        for n in left:
            counts[n] += 1
        return lower_bound(counts, size)

    least = bound(items)

    def search(left: list[int], done: list[list[int]]) -> bool:
        nonlocal best, most, seen
        if not left:
            best, most = done, len(done)
            return most <= least
        if len(done) + max(1, -(-sum(left) // size)) >= most or len(done) + bound(left) >= most:
            return False
        first, rest = left[0], left[1:]
        for filling in fillings(rest, size - first, 500):
            seen += 1
            if seen > nodes:
                return True
            after = list(rest)
            for n in filling:
                after.remove(n)
            if search(after, [*done, [first, *filling]]):
                return True
        return False

    search(sorted(items, reverse=True), [])
    return best


def improved(found: list[tuple[int, list[int]]], size: int, tail: int = TAIL, nodes: int = BRANCHES) -> list[tuple[int, list[int]]]:
    """The packing with sequences of most waste packed anew, as long as that saves some and the lower bound is not met."""
    counts = [0] * (size + 1)
    for times, filling in found:
        for n in filling:
            counts[n] += times
    least, now = lower_bound(counts, size), sum(times for times, _ in found)
    while now > least:
        opened, kept, items = 0, [], []
        for times, filling in sorted(found, key=lambda f: (sum(f[1]), len(f[1]), f[1])):
            some = min(times, (tail - len(items)) // len(filling)) if len(items) < tail else 0
            items += filling * some
            opened += some
            if times > some:
                kept.append((times - some, filling))
        better = branch_and_bound(items, size, opened, nodes)
        if better is None:
            break
        found = kept + [(1, sorted(f, reverse=True)) for f in better]
        now += len(better) - opened
    return found


def intervals(found: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: rank from which an entry holds, first sequence, items a sequence, place of the first item."""
    used: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    base = 0
    for times, filling in found:
        at = 0
        for n in dict.fromkeys(filling):
            k = filling.count(n)
            rows.setdefault(n, []).append((used.get(n, 0), base, k, at))
            used[n] = used.get(n, 0) + times * k
            at += n * k
        base += times
    return {n: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for n, r in rows.items()}


def pieces(docs: DataFrame, size: int, end_id: int, tokenizer: str, path: str | None = None) -> DataFrame:
    """One row per piece, with its rank among this task's pieces of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, ranks = Encoder.held(tokenizer, path), TaskContext.get().partitionId(), {}
        for part in slices(batches):
            rows = []
            ids, sizes = encoder.flat(part.column(1), end_id)
            data, base = memoryview(ids.tobytes()), 0
            for doc, n in zip(part.column(0).to_pylist(), sizes.tolist(), strict=True):
                view = data[4 * base : 4 * (base + n)]
                base += n
                start = 0
                for piece in range(-(-n // size)):
                    stop = start + ((n - 1) % size + 1 if not piece else size)
                    k = stop - start
                    rank = ranks.get(k, 0)
                    ranks[k] = rank + 1
                    rows.append((task, rank, doc, piece, start, k, zlib.crc32(view[4 * start : 4 * stop])))
                    start = stop
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["task", "rank", "doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.mapInArrow(run, "task int, rank long, doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(df: DataFrame, size: int = 2048, end_id: int = 0, tokenizer: str = "byte_bpe_50k.json", path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most `size` tokens: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = stored(pieces(id_and_text(df, id_col, text_col), size, end_id, tokenizer, path), "pieces", keep=True)
    by_task = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = by_task.select("task", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    table = intervals(patterns(histogram, size))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy() + batch.column("before").to_numpy()
            order = np.argsort(length, kind="stable")
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(own):
                    n = int(length[own[0]])
                    since, base, k, at = table[n]
                    i = np.searchsorted(since, rank[own], "right") - 1
                    r = rank[own] - since[i]
                    sequence[own], offset[own] = base[i] + r // k[i], at[i] + r % k[i] * n
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return cut.join(before, ["task", "length"]).mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
