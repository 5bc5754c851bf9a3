"""How sources of a language differ from each other and from their language, by systolic rotation.

Terms are counted per (lang, source); those in enough documents of their language are kept and dealt to slices of the
vocabulary. Within a slice every group has a vector, compressed to its non-zero counts. A few groups of a language take a
seat; a seat stays in its partition, while the compressed vectors of the others come by in the rounds of a round-robin
tournament (circle method: one seat fixed, the others turn), so that every two seats meet once and a vector travels once a
round. A meeting gives the values of both directions, in whole numbers; sums over slices and ranks follow. At home a seat
also meets its language's vector, where local heaps keep the terms that rank first.

Nothing grows with a group's rows: a hot source has a vector as any other, counts are pre-aggregated before they are
shuffled, and a meeting holds two seats of one slice.

Defined cases: null text, lang and source count as ''; a group without terms, and a language without kept terms (all
values 0), have their pairs; a source that is the only one of its language has none; ties go by the term's or the source's
UTF-8 bytes; every row counts as a document, also where doc_ids repeat.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, only, scratch, slices, stored

#: Documents of its language that a kept term is in, ranks of terms, terms of a slice, groups of a seat.
MIN_DOCS, TOP, SLICE_TERMS, SEAT_GROUPS = 10, 10, 1 << 15, 8
#: Distinct (group, term) that a task counts before it sends them on.
_HELD = 500_000
#: A-Z to a-z; every other byte below 128 that is no letter to a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("terms")
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        seen = 0

        def sent() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in held.items():
                terms = list(n)
                for i in range(0, len(terms), 50_000):
                    some = terms[i : i + 50_000]
                    columns = [pa.array([lang] * len(some)), pa.array([source] * len(some)), pa.array(some, pa.binary()).cast(pa.string()), pa.array([n[t] for t in some], pa.int64()), pa.array([docs[t] for t in some], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
            held.clear()

        for part in slices(batches):
            for lang, source, text in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                terms = text.encode().translate(_FOLD).split()
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                before = len(n)
                n.update(terms)
                docs.update(set(terms))
                seen += len(n) - before
                if seen > _HELD:
                    yield from sent()
                    seen = 0
        yield from sent()

    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    parts = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / (total + 2 terms)), exact: three digits at a time, so that no product leaves 64 bits."""
    whole, rest, out = total + 2 * terms, counts + 2, np.zeros(len(counts), np.int64)
    for _ in range(3):
        rest = rest * 1000
        digit = rest // whole
        out, rest = out * 1000 + digit, rest - digit * whole
    return out + 1


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    apart = p - q
    return apart * apart // (p + q)


def packed_counts(ids: np.ndarray, counts: np.ndarray) -> bytes:
    """Steps between ids and counts, compressed."""
    return zlib.compress(np.diff(ids, prepend=0).astype("<u4").tobytes() + counts.astype("<u8").tobytes(), 1)


def unpacked_counts(blob: bytes, size: int) -> np.ndarray:
    raw = zlib.decompress(blob)
    k = len(raw) // 12
    out = np.zeros(size, np.int64)
    out[np.cumsum(np.frombuffer(raw, "<u4", k).astype(np.int64))] = np.frombuffer(raw, "<u8", k, 4 * k)
    return out


def partner(seat: Column, seats: Column, turn: int) -> Column:
    """The seat that a seat meets in a round of its language's tournament; its own where it rests; null past the last round."""
    ring = seats - 1 + seats % 2  # odd; an even number of seats leaves one beside the ring
    across = F.pmod(F.lit(2 * turn) - seat, ring)
    met = F.when(seat == ring, F.lit(turn) % ring).when(across == seat, F.when(ring < seats, ring).otherwise(seat)).otherwise(across)
    return F.when(F.lit(turn) < ring, met)


_MEMBERS = "array<struct<source: string, total: long, vector: binary>>"


def _members(rows: list[dict], size: int, terms: int) -> list[tuple[str, np.ndarray]]:
    return [(m["source"], shares(unpacked_counts(m["vector"], size), m["total"], terms)) for m in rows]


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Meetings (lang, size, terms, members, peers) to lang, source, item, value; without peers the members among themselves."""
    for batch in batches:
        sums: Counter = Counter()
        for lang, size, terms, members, peers in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            own = _members(members, size, terms)
            pairs = combinations(own, 2) if peers is None else ((a, b) for b in _members(peers, size, terms) for a in own)
            for (a, p), (b, q) in pairs:
                value = int(distances(p, q).sum())
                sums[lang, a, b] += value
                sums[lang, b, a] += value
        rows = [(*key, value) for key, value in sums.items()]
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, [pa.string()] * 3 + [pa.int64()], strict=True)], names=["lang", "source", "item", "value"])


def _heaps(top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Seats with their language's vector to lang, source, slice, id, value of the terms that rank first in the slice."""
        for batch in batches:
            rows = []
            for b in batch.to_pylist():
                q = shares(unpacked_counts(b["whole"], b["size"]), b["lang_total"], b["terms"])
                for m in b["members"]:
                    counts = unpacked_counts(m["vector"], b["size"])
                    p = shares(counts, m["total"], b["terms"])
                    at = np.flatnonzero((counts > 0) & (p > q))
                    first = heapq.nsmallest(top, zip((-distances(p[at], q[at])).tolist(), at.tolist(), strict=True))
                    rows += [(b["lang"], m["source"], b["slice"], i, -minus) for minus, i in first]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()], strict=True)], names=["lang", "source", "slice", "id", "value"])

    return run


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(batch.num_columns - 1)
        out = []
        for i in range(len(lists)):
            values = lists[i].values
            ids, counts = (np.zeros(0, np.int64),) * 2 if values is None else (values.field(k).to_numpy() for k in range(2))
            order = np.argsort(ids, kind="stable")
            out.append(packed_counts(ids[order], counts[order]))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.binary())], names=[*batch.schema.names[:-1], "vector"])


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, slice_terms: int = SLICE_TERMS, seat_groups: int = SEAT_GROUPS) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    spark = docs.sparkSession
    with scratch(spark):
        counts = stored(term_counts(docs), "terms")
        known = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")).where(F.col("docs") >= min_docs).select("lang", "term", "n")
        known = stored(known, "vocabulary")
        groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
        languages = groups.select("lang").distinct().join(known.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total")), "lang", "left")
        languages = stored(languages.select("lang", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"), F.greatest(F.lit(1), F.ceil(F.col("terms") / slice_terms)).cast("long").alias("slices")), "languages")
        # places in the vocabulary: a slice by hash, in it by the term's bytes
        placed = known.join(languages, "lang").withColumn("slice", F.pmod(F.xxhash64("term"), "slices"))
        placed = stored(placed.select("lang", "term", "n", "slice", (F.row_number().over(Window.partitionBy("lang", "slice").orderBy("term")) - 1).cast("long").alias("id")), "placed")
        sizes = placed.groupBy("lang", "slice").agg(F.count("*").alias("size"))
        entries = stored(counts.join(placed.select("lang", "term", "slice", "id"), ["lang", "term"]).select("lang", "source", "slice", "id", "n"), "entries")
        totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        nth = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
        seated = groups.join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.floor(nth / seat_groups).alias("seat"))
        seated = stored(seated.withColumn("seats", F.max("seat").over(Window.partitionBy("lang")) + 1), "seated")
        every = seated.join(languages, "lang").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice")).join(sizes, ["lang", "slice"], "left")
        every = every.select("lang", "slice", "source", "total", "terms", "lang_total", "seat", "seats", F.coalesce("size", F.lit(0)).alias("size"))
        lists = entries.groupBy("lang", "slice", "source").agg(F.collect_list(F.struct("id", "n")).alias("list"))
        wholes = placed.groupBy("lang", "slice").agg(F.collect_list(F.struct("id", "n")).alias("list"))
        head = "lang string, slice long, source string, total long, terms long, lang_total long, seat long, seats long, size long"
        with arrow_rows(spark, 64):
            vectors = stored(every.join(lists, ["lang", "slice", "source"], "left").mapInArrow(_compressed, f"{head}, vector binary"), "vectors")
            whole = stored(wholes.mapInArrow(_compressed, "lang string, slice long, vector binary"), "wholes").withColumnRenamed("vector", "whole")
            seats = stored(vectors.groupBy("lang", "slice", "seat", "seats", "size", "terms", "lang_total").agg(F.collect_list(F.struct("source", "total", "vector")).alias("members")), "seats")
            most = seats.agg(F.max("seats")).first()[0] or 0
            rounds = max(0, most - 1 + most % 2) if most > 1 else 0
            alone = F.lit(None).cast(_MEMBERS)
            met = "lang string, source string, item string, value long"
            values = [stored(seats.select("lang", "size", "terms", "members", alone).mapInArrow(_values, met), "home")]
            first = stored(seats.join(whole, ["lang", "slice"]).mapInArrow(_heaps(top), "lang string, source string, slice long, id long, value long"), "heaps")
            at = ["lang", "slice", "seat"]
            parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
            resident = seats.repartition(parts, *at).persist(StorageLevel.MEMORY_AND_DISK)
            try:
                for turn in range(rounds):
                    peers = seats.withColumn("to", partner(F.col("seat"), F.col("seats"), turn)).where("to < seat").select("lang", "slice", F.col("to").alias("seat"), F.col("members").alias("peers"))
                    meeting = resident.join(peers.hint("merge"), at).select("lang", "size", "terms", "members", "peers")
                    values.append(stored(meeting.mapInArrow(_values, met), "round"))
            finally:
                resident.unpersist()
        summed = values[0]
        for v in values[1:]:
            summed = summed.unionByName(v)
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        pairs = summed.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
        named = first.join(placed.select("lang", "slice", "id", F.col("term").alias("item")), ["lang", "slice", "id"])
        terms = named.select("lang", "source", F.lit("term").alias("part"), "item", "value", F.row_number().over(order).alias("rank")).where(F.col("rank") <= top)
        return stored(pairs.unionByName(terms), "divergence", keep=True)
