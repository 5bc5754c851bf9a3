"""Exact repeats of `width` bytes by a logarithmic family of suffix arrays.

Documents come in batches of ascending doc_id. Each batch gets a suffix array: its suffixes in the order of their first
`width` bytes. It is merge-scanned against the levels of the family, each the suffix array of some earlier batches: where
a suffix meets an equal one the match is `width` bytes or longer, and a run of such suffixes is a longer match. What the
batch brings that is new becomes a level; levels of equal size class merge, so that there are logarithmically many and a
suffix moves that often.

Suffixes are dealt by content: the key of a place is the least hash of SEED bytes within its `width` bytes, so equal
strings have equal keys wherever they stand, and a family per part of the keys finds every match. Neighbouring places
mostly have the same key; they travel as one snippet of text. Two things keep what travels small, and lose nothing: exact
copies of a text are told by a digest and never enter, and of other texts only the places whose key two of them have; a
first pass exchanges the keys alone, 8 bytes for some 18 places. A snippet that several documents of one slice of the
input hold leaves the slice once, from the least of them, and the others are matches already; so a passage that a third
of all documents hold is a row a slice.

Defined cases: a document with a null doc_id is neither compared nor changed; rows of one doc_id are not compared with
each other; null text is empty; texts under `width` bytes are never changed; a repeat within one document stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, id_and_text, only, scratch, slices, stored, text_parts
from .shingles import _BYTES, mix

#: Bytes hashed for a key, and bytes of text hashed in one go.
SEED, CHUNK = 16, 1 << 19
#: Bytes of text behind one part of the keys and behind one family.
KEYS_A_PART, TEXT_A_FAMILY = 48 << 20, 4 << 20
#: Bytes of text behind one seat: the families that one task builds, one after another. Rows between slices of the input
#: and seats grow with the square of the input, so a seat is as large as a task can hold.
TEXT_A_SEAT = 16 << 20
#: Batches that the documents come in.
BATCHES = 4
_RAW = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def keyed(raw: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """raw: texts end to end, each ending at ends. Runs of places of one key: first place, place behind the last, key, text.

    A run that crosses the bounds of a chunk is two runs."""
    out: list[tuple[np.ndarray, ...]] = []
    reach = width - SEED + 1
    for low in range(0, max(len(raw) - width + 1, 0), CHUNK):
        part = raw[low : low + CHUNK + width - 1]
        n = len(part)
        up, down = _BYTES.upto(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_RAW[part] * up[:n], out=sums[1:])
        least = mix((sums[SEED:] - sums[:-SEED]) * down[: n - SEED + 1])
        places, span = len(least) - reach + 1, 1
        while span * 2 <= reach:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < reach:
            least = np.minimum(least[:places], least[reach - span : reach - span + places])
        at = low + np.arange(places)
        i, j = np.searchsorted(ends, [low, low + places - 1], "right")
        counts = np.diff(np.concatenate([[low], np.minimum(ends[i : j + 1], low + places)]))
        text = np.repeat(np.arange(i, j + 1), counts)
        within = at + width <= np.repeat(ends[i : j + 1], counts)
        edge = np.ones(places + 1, bool)
        edge[1:-1] = (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | (within[1:] != within[:-1])
        edge = np.flatnonzero(edge)
        good = within[edge[:-1]]
        start, stop = edge[:-1][good], edge[1:][good]
        out.append((start + low, stop + low, least[start], text[start]))
    return tuple(map(np.concatenate, zip(*out, strict=True))) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    wide = texts.cast(pa.large_binary())
    _, at, data = wide.buffers()
    if not len(wide) or data is None:
        return np.zeros(0, np.uint8), np.cumsum(lengths)
    first = int(np.frombuffer(at, np.int64)[wide.offset])
    return np.frombuffer(data, np.uint8)[first : first + int(lengths.sum())], np.cumsum(lengths)


def _batch(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=names)


def _new(*sorted_: np.ndarray) -> np.ndarray:
    """Where a row of sorted columns differs from the one before."""
    new = np.ones(len(sorted_[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in sorted_])
    return new


def _packed(digests: list[bytes], own: np.ndarray, keys: np.ndarray, back: int) -> list[tuple[int, bytes, bytes, bytes]]:
    """Keys (of the texts own, in order) by the part they go back to: part, digests, how many keys each, keys."""
    cut = np.append(np.flatnonzero(_new(own)), len(own))
    blob, out = keys.tobytes(), {}
    for a, b in zip(cut, cut[1:], strict=False):
        name = digests[own[a]]
        out.setdefault(int.from_bytes(name[:8], "little") % back, []).append((name, (b - a).tobytes(), blob[8 * a : 8 * b]))
    return [(to, *map(b"".join, zip(*rows, strict=True))) for to, rows in out.items()]


def _several(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys: where each begins, and which stand there several times."""
    first = _new(keys)
    return first, np.repeat(n := np.diff(np.append(np.flatnonzero(first), len(keys))), n) > 1


def shared_keys(texts: DataFrame, parts: int, back: int, width: int) -> DataFrame:
    """texts: digest, text. Gives digest, keys (binary): of each text the keys that another text has as well.

    Keys meet in `parts` parts and go back to the texts by way of `back` others, packed both times, so that rows are few.
    A key that texts of one slice share is known to be shared there, and one of them goes on for all."""

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("suffixes")
        for part in slices(batches):
            raw, ends = _flat(part.column(1))
            _, _, keys, own = keyed(raw, ends, width)
            order = np.argsort(keys, kind="stable")
            keys, own = keys[order], own[order]
            pairs = _new(keys, own)
            keys, own = keys[pairs], own[pairs]
            first, here = _several(keys)
            digests = part.column(0).to_pylist()
            order = np.lexsort((keys[here], own[here]))
            out = [(to % parts, k, n, d, to) for to, d, n, k in _packed(digests, own[here][order], keys[here][order], back)]
            keys, own = keys[first], own[first]
            order = np.argsort(to := keys % np.uint64(parts), kind="stable")
            bounds = np.searchsorted(to[order], np.arange(parts + 1, dtype=np.uint64))
            for q in range(parts):
                mine = order[bounds[q] : bounds[q + 1]]
                if len(mine):
                    held, at = np.unique(own[mine], return_inverse=True)
                    out.append((q, keys[mine].tobytes(), at.astype(np.uint32).tobytes(), b"".join(digests[i] for i in held), None))
            yield _batch(out, [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32()], ["q", "keys", "own", "digests", "back"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        kinds, names = [pa.int32(), *[pa.binary()] * 3], ["back", "digests", "sizes", "keys"]

        def of_part() -> Iterator[pa.RecordBatch]:
            number: dict[bytes, int] = {}
            keys = np.concatenate([k for k, _, _ in held])
            own = np.concatenate([np.array([number.setdefault(d[i : i + 16], len(number)) for i in range(0, len(d), 16)])[o] for _, o, d in held])
            held.clear()
            order = np.lexsort((own, keys))
            keys, own = keys[order], own[order]
            pairs = _new(keys, own)
            keys, own = keys[pairs], own[pairs]
            shared = _several(keys)[1]
            order = np.lexsort((keys[shared], own[shared]))
            yield _batch(_packed(list(number), own[shared][order], keys[shared][order], back), kinds, names)

        for batch in batches:
            for q, keys, own, digests, to in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if to is not None:
                    yield _batch([(to, digests, own, keys)], kinds, names)
                    continue
                if q != now and held:
                    yield from of_part()
                now = q
                held.append((np.frombuffer(keys, np.uint64), np.frombuffer(own, np.uint32), digests))
        if held:
            yield from of_part()

    def returned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}

        def of_part() -> Iterator[pa.RecordBatch]:
            rows = [(name, b"".join(keys)) for name, keys in held.items()]
            held.clear()
            for i in range(0, len(rows), 5000):
                yield _batch(rows[i : i + 5000], [pa.binary(), pa.binary()], ["digest", "keys"])

        for batch in batches:
            for to, digests, sizes, keys in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if to != now:
                    yield from of_part()
                now, at = to, 0
                for i, n in enumerate(np.frombuffer(sizes, np.int64).tolist()):
                    held.setdefault(digests[16 * i : 16 * i + 16], []).append(keys[8 * at : 8 * (at + n)])
                    at += n
        yield from of_part()

    blobs = texts.select("digest", "text").mapInArrow(sent, "q int, keys binary, own binary, digests binary, back int")
    shared = blobs.repartition("q").sortWithinPartitions("q").mapInArrow(found, "back int, digests binary, sizes binary, keys binary")
    return shared.repartition("back").sortWithinPartitions("back").mapInArrow(returned, "digest binary, keys binary")


class Level:
    """A suffix array: text, and the places of its suffixes in the order of their first width bytes, all different."""

    def __init__(self, text: np.ndarray, places: np.ndarray):
        self.text, self.places = text, places

    def suffixes(self, width: int) -> np.ndarray:
        return _starts(self.text, self.places, width)


def _starts(text: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
    """The first width bytes of suffixes. Compared as bytes of equal length, which zeros do not shorten."""
    if not len(places):
        return np.zeros(0, f"S{width}")
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, width)[places]).view(f"S{width}").ravel()


class Family:
    """Levels of geometric sizes. `add` takes the suffixes of a batch and tells which stand in an earlier document."""

    def __init__(self, width: int):
        self.width, self.levels = width, []

    def add(self, text: np.ndarray, places: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """places: where suffixes begin in text; docs: their documents, above or equal to those of earlier batches' (and
        above them all where they differ in batch). Gives which suffixes an earlier document holds."""
        by_doc = np.argsort(docs, kind="stable")
        suffixes = _starts(text, places[by_doc], self.width)
        order = np.argsort(suffixes, kind="stable")  # equal ones by document
        suffixes, order = suffixes[order], by_doc[order]
        new = np.ones(len(suffixes), bool)
        new[1:] = suffixes[1:] != suffixes[:-1]
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        found = docs[order] != docs[order[first]][group]
        distinct, places = suffixes[first], places[order[first]]
        known = np.zeros(len(first), bool)
        for level in self.levels:
            known |= _merged(level.suffixes(self.width), distinct)[1]
        found |= known[group]
        self._insert(Level(text, places[~known]))
        out = np.zeros(len(order), bool)
        out[order] = found
        return out

    def _insert(self, level: Level) -> None:
        level = _compact(level, self.width)
        while self.levels and len(self.levels[-1].places) <= 2 * len(level.places):
            older = self.levels.pop()
            places = np.concatenate([older.places, level.places + len(older.text)])
            order, _ = _merged(older.suffixes(self.width), level.suffixes(self.width))
            level = Level(np.concatenate([older.text, level.text]), places[order])
        if len(level.places):
            self.levels.append(level)


def _compact(level: Level, width: int) -> Level:
    """Without the text that no suffix of the level reads."""
    if not len(level.places):
        return Level(level.text[:0], level.places)
    begin = np.bincount(level.places, minlength=len(level.text) + 1)
    begin[width:] -= np.bincount(level.places, minlength=len(begin))[: len(begin) - width]
    used = np.cumsum(begin[:-1]) > 0
    return Level(level.text[used], (np.cumsum(used) - 1)[level.places])


def _merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted lists merged by one scan (a stable sort of two runs): the order, and which of b stand next to an equal one of a."""
    both = np.concatenate([a, b])
    order = np.argsort(both, kind="stable")
    scan = both[order]
    equal = np.zeros(len(b), bool)
    at = np.flatnonzero(order >= len(a))
    at = at[at > 0]
    equal[order[at] - len(a)] = scan[at] == scan[at - 1]
    return order, equal


_SENT = "q int, text binary, sizes binary, place binary, own binary, ids binary, digests binary, family binary, doc_id long"
_HITS = "doc_id long, digest binary, spans binary"


def _hits(ids: np.ndarray, digests: np.ndarray, own: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    """Spans of places per text, as pairs of little-endian 64-bit integers."""
    order = np.argsort(own, kind="stable")
    own, pairs = own[order], np.stack([start[order], stop[order]], 1).astype("<i8").tobytes()
    cut = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]])) if len(own) else np.zeros(1, np.int64)
    rows = [(int(ids[own[a]]), digests[own[a]].tobytes(), pairs[16 * a : 16 * b]) for a, b in zip(cut, cut[1:], strict=False)]
    return _batch(rows, [pa.int64(), pa.binary(), pa.binary()], ["doc_id", "digest", "spans"])


def _snippets(families: int, seats: int, width: int):
    """A row per slice and seat: the snippets of its families, in their order; q -1: spans found within the slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("suffixes")
        kinds = [pa.int32(), *[pa.binary()] * 7, pa.int64()]
        names = ["q", "text", "sizes", "place", "own", "ids", "digests", "family", "doc_id"]
        for part in slices(batches):
            part = part.take(pc.sort_indices(part.column(0)))
            ids = part.column(0).to_numpy(zero_copy_only=False)
            digests = np.frombuffer(b"".join(part.column(1).to_pylist()), "V16")
            raw, ends = _flat(part.column(2))
            begins = np.concatenate([[0], ends[:-1]])
            start, stop, key, text = keyed(raw, ends, width)
            good = np.isin(key, np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint64))  # a key that one text shares is shared in all
            start, stop, key, text = start[good], stop[good], key[good], text[good]
            data, seen, here, gone = raw.tobytes(), {}, [], []
            for i, (a, b, t) in enumerate(zip(start.tolist(), stop.tolist(), text.tolist(), strict=True)):
                snippet = data[a : b + width - 1]
                of = seen.setdefault(snippet, t)
                (gone if ids[of] != ids[t] else here).append(i)
            gone = np.array(gone, np.int64)
            if len(gone):  # an earlier document of the slice has the whole snippet
                hit = _hits(ids, digests, text[gone], (start - begins[text])[gone], (stop - begins[text])[gone])
                yield _batch([(-1, spans, None, None, None, None, digest, None, id_) for id_, digest, spans in zip(*(hit.column(i).to_pylist() for i in range(3)), strict=True)], kinds, names)
            here = np.array(here, np.int64)
            to = ((key[here] >> np.uint64(20)) % np.uint64(families)).astype(np.int64)
            order = np.lexsort((to, to % seats))
            seat = (to % seats)[order]
            cut = np.flatnonzero(np.concatenate([[True], seat[1:] != seat[:-1], [True]])) if len(order) else np.zeros(1, np.int64)
            out = []
            for a, b in zip(cut, cut[1:], strict=False):
                mine = here[order[a:b]]
                held, own = np.unique(text[mine], return_inverse=True)
                sizes = (stop - start)[mine]
                blob = b"".join(data[x:y] for x, y in zip(start[mine].tolist(), (stop[mine] + width - 1).tolist(), strict=True))
                out.append((int(seat[a]), blob, sizes.astype("<u4").tobytes(), (start - begins[text])[mine].astype("<i8").tobytes(), own.astype("<u4").tobytes(), ids[held].astype("<i8").tobytes(), digests[held].tobytes(), to[order[a:b]].astype("<u4").tobytes(), None))
            yield _batch(out, kinds, names)

    return run


def _scanned(bounds: list[int], width: int):
    """bounds: the last doc_id of each batch but the last one."""

    def of_seat(held: list[list[bytes]]) -> pa.RecordBatch:
        sizes, place, own, ids, digests, family = (np.concatenate([np.frombuffer(h[i], kind) for h in held]) for i, kind in zip(range(1, 7), ("<u4", "<i8", "<u4", "<i8", "V16", "<u4"), strict=True))
        counts, texts = [len(h[3]) // 4 for h in held], [len(h[4]) // 8 for h in held]
        text = np.concatenate([np.frombuffer(h[0], np.uint8) for h in held])
        held.clear()
        sizes, own = sizes.astype(np.int64), own + np.repeat(np.cumsum(texts) - texts, counts)
        stop = np.cumsum(sizes + width - 1)
        begin = stop - (sizes + width - 1)
        group = family.astype(np.int64) * (len(bounds) + 1) + np.searchsorted(bounds, ids, "left")[own]
        order = np.argsort(group, kind="stable")  # by family, then by batch
        cut = np.flatnonzero(np.append(_new(group[order]), True))
        now, levels, spans = None, None, []
        for a, b in zip(cut, cut[1:], strict=False):
            mine = order[a:b]
            if family[mine[0]] != now:
                now, levels = family[mine[0]], Family(width)
            n = sizes[mine]
            which = np.repeat(np.arange(len(mine)), n)
            inner = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            own_text = np.concatenate([text[x:y] for x, y in zip(begin[mine].tolist(), stop[mine].tolist(), strict=True)])
            at = np.cumsum(n + width - 1) - (n + width - 1)
            found = levels.add(own_text, at[which] + inner, ids[own[mine]][which])
            edge = np.ones(len(found) + 1, bool)
            edge[1:-1] = (which[1:] != which[:-1]) | (found[1:] != found[:-1])
            edge = np.flatnonzero(edge)
            hit = found[edge[:-1]]
            c, d = edge[:-1][hit], edge[1:][hit] - 1
            of = mine[which[c]]
            spans.append((own[of], place[of] + inner[c], place[of] + inner[d] + 1))
        return _hits(ids, digests, *map(np.concatenate, zip(*spans, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("suffixes")
        now, held = None, []
        for batch in batches:
            for q, *row in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                if q != now and held:
                    yield of_seat(held)
                now = q
                held.append(row)
        if held:
            yield of_seat(held)

    return run


def _left(data: bytes, starts: list[int], stops: list[int]) -> bytes:
    return b"".join(data[a:b] for a, b in zip([0, *stops], [*starts, len(data)], strict=True))


def _cut(width: int):
    """Spans of places to maximal runs of bytes, and the hash of what is left of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for id_, digest, text, blobs in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                spans = np.frombuffer(b"".join(blobs), "<i8").reshape(-1, 2)
                spans = spans[np.argsort(spans[:, 0], kind="stable")]
                ends = np.maximum.accumulate(spans[:, 1] + width - 1)
                new = np.ones(len(spans) + 1, bool)
                new[1:-1] = spans[1:, 0] > ends[:-1]
                new = np.flatnonzero(new)
                start, stop = spans[new[:-1], 0], ends[new[1:] - 1]
                start, stop = start.tolist(), stop.tolist()
                spans = [{"start": a, "stop": b} for a, b in zip(start, stop, strict=True)]
                out.append((id_, digest, sum(stop) - sum(start), spans, hashlib.sha256(_left(text.encode(), start, stop)).hexdigest()))
            span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield _batch(out, [pa.int64(), pa.binary(), pa.int64(), span, pa.string()], ["doc_id", "digest", "n_removed", "spans", "kept_sha256"])

    return run


_SPANS = "array<struct<start: long, stop: long>>"


def _found(rows: DataFrame, width: int, batches: int, families: int | None) -> tuple[DataFrame, DataFrame]:
    """rows: doc_id, text, digest. Gives the first owner of each text, and what is removed from owners' texts."""
    long = rows.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= width))
    spark = rows.sparkSession
    with scratch(spark):
        owners = stored(long.groupBy("digest").agg(F.min("doc_id").alias("doc_id")), "owners", keep=True)  # exact copies are told here
        sizes = long.agg(F.sum(F.octet_length("text")), F.percentile_approx("doc_id", [i / batches for i in range(1, batches)])).first()
        total, bounds = sizes[0] or 0, sorted(set(sizes[1] or []))
        families = families or max(1, -(-total // TEXT_A_FAMILY))
        seats = min(families, max(-(-total // TEXT_A_SEAT), 4 * spark.sparkContext.defaultParallelism))
        at, parts = ["digest", "doc_id"], text_parts(spark, total)
        keys = stored(shared_keys(long, max(1, -(-total // KEYS_A_PART)), parts, width).join(owners, "digest"), "keys")
        mine = long.select("doc_id", "digest", "text").repartition(parts, *at).join(keys, at).dropDuplicates(at)
        texts = bucketed(mine, "texts", parts, *at)
        with scratch(spark):
            sent = stored(texts.select("doc_id", "digest", "text", "keys").mapInArrow(_snippets(families, seats, width), _SENT), "snippets", codec="zstd")
            scanned = sent.where("q >= 0").drop("doc_id").repartitionById(seats, "q").mapInArrow(_scanned(bounds, width), _HITS)  # a task a seat
            local = sent.where("q < 0").select("doc_id", F.col("digests").alias("digest"), F.col("text").alias("spans"))
            hits = stored(scanned.union(local), "hits", keep=True)
        hits = hits.groupBy(*at).agg(F.collect_list("spans").alias("spans"))
        cut = texts.select("doc_id", "digest", "text").join(hits, at).select("doc_id", "digest", "text", "spans")
        return owners, stored(cut.mapInArrow(_cut(width), f"doc_id long, digest binary, n_removed long, spans {_SPANS}, kept_sha256 string"), "found", keep=True)


def repeats(docs: DataFrame, width: int = 50, batches: int = BATCHES, families: int | None = None) -> DataFrame:
    """Every row of docs: doc_id, digest (md5 of the text), n_bytes, n_removed, spans (start and stop, in bytes, of what
    earlier documents hold), kept_sha256 (of the bytes that are left)."""
    if width < 2 * SEED:
        raise ValueError(f"width must be at least {2 * SEED}")
    rows = id_and_text(docs).withColumn("digest", F.unhex(F.md5("text")))
    owners, found = _found(rows, width, batches, families)
    every = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest", F.sha2("text", 256).alias("own_sha256"))
    at = every.join(owners.withColumn("owner", F.lit(True)), ["doc_id", "digest"], "left").join(found, ["doc_id", "digest"], "left")
    copy = F.col("doc_id").isNotNull() & F.col("owner").isNull() & (F.col("n_bytes") >= width)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop")))
    return at.select(
        "doc_id",
        "digest",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, whole).otherwise(F.coalesce("spans", F.array().cast(_SPANS))).alias("spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "own_sha256")).alias("kept_sha256"),
    )


def kept_bytes(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, kept (binary: a cut can fall within a character) for every row of docs, by the spans of `repeats`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
            yield _batch([(i, _left(t.encode(), [s["start"] for s in spans], [s["stop"] for s in spans])) for i, t, spans in rows], [pa.int64(), pa.binary()], ["doc_id", "kept"])

    rows = id_and_text(docs).withColumn("digest", F.unhex(F.md5("text")))
    spans = found.where("n_removed > 0").select(F.col("doc_id").alias("of"), F.col("digest").alias("with"), "spans").dropDuplicates(["of", "with"])
    at = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("with")), "left")
    return at.select("doc_id", "text", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans")).mapInArrow(run, "doc_id long, kept binary")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
