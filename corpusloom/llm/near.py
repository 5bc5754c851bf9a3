"""MinHash near-duplicate groups with odd sketches.

Signature: `bands` x `rows` min-hashes of a document's set of word shingles. Bands of equal values propose candidates;
the same samples are folded into a parity bitmap (an odd sketch), and the population count of the XOR of two bitmaps
estimates their similarity closely enough at high values to drop most candidates without touching texts. What remains
is confirmed on the full sets.

Equal sets are one class from the start. Within a bucket no pairs are listed: its members are compared with one centre
each, and confirmed links are joined into components. Where a bucket then holds several components, all members outside
its largest one are compared with all others, block by block inside a task, by sketch and on the full sets; only links
that join components leave the task. A bucket is cut into blocks of bounded size on both sides, so no group is gathered
whole. Thus no link between components is lost, members of one component are not compared again, and rows stay linear.

With 48 bands of 7 rows, a pair at similarity 0.8 shares no bucket with probability 1.3e-5; a linked pair fails the
sketch bound (`slack` below the threshold, over five standard deviations) with less.

Defined cases: null, empty and wordless texts have an empty set and are linked with nothing; equal texts share a
class; rows that share a doc_id are one node; rows without doc_id are linked with nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, list_array, scratch, slices, stored
from .graph import components
from .shingles import Shingler, mix

BANDS, ROWS, BITS = 48, 7, 1024
#: Bytes of sets on each side of a block.
BLOCK_BYTES = 8 << 20
_HELD: dict[int, Shingler] = {}


def _shingler(size: int) -> Shingler:
    return _HELD.setdefault(size, Shingler(size))


def _multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)


def min_hashes(values: np.ndarray, by: np.ndarray) -> np.ndarray:
    low = None
    for at in range(0, len(values), 1024):
        part = np.multiply.outer(by, values[at : at + 1024]).min(axis=1)
        low = part if low is None else np.minimum(low, part)
    return low


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Each sample flips one bit: the parity bitmap as 64-bit words."""
    place = (mix(samples + np.arange(len(samples), dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(64 - int(math.log2(BITS)))).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=BITS) & 1).astype(np.uint8)).view(np.int64)


def most_bits(threshold: float, samples: int) -> int:
    """The population count that stands for this similarity: equal samples cancel, each other pair flips two bits."""
    return int(BITS / 2 * (1 - (1 - 2 / BITS) ** (2 * samples * (1 - threshold))))


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, by = _shingler(shingle), _multipliers(BANDS * ROWS)
        weigh = _multipliers(2 * ROWS)[ROWS:]
        names = mix(np.arange(BANDS, dtype=np.uint64))
        for part in slices(batches):
            digest, sizes, bands, sketches, has = [], [], [], [], []
            for own in shingler.sets(part.column(1)):
                digest.append(blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                sizes.append(len(own))
                has.append(bool(len(own)))
                if len(own):
                    low = min_hashes(own, by)
                    bands.append((mix((mix(low).reshape(BANDS, ROWS) * weigh).sum(axis=1, dtype=np.uint64) ^ names)).view(np.int64))
                    sketches.append(odd_sketch(low))
            has = np.array(has)
            flat = lambda x, n: list_array(np.concatenate(x) if x else np.zeros(0, np.int64), has * n, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digest, pa.binary()), pa.array(sizes, pa.int64()), flat(bands, BANDS), flat(sketches, BITS // 64)], names=["doc_id", "digest", "n_shingles", "bands", "sketch"])

    return docs.mapInArrow(run, "doc_id long, digest binary, n_shingles long, bands array<long>, sketch array<long>")


def full_sets(docs: DataFrame, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            own = _shingler(shingle).sets(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), list_array(np.concatenate(own).view(np.int64), np.array([len(x) for x in own]), pa.int64())], names=["node", "members"])

    return docs.mapInArrow(run, "node long, members array<long>")


def _confirmed(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int, slack: float) -> DataFrame:
    """Pairs a, b that are similar: by size, then by sketch, then by the full sets."""
    left, right = (sketches.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}")) for x in "ab")
    near = pairs.join(left, "a").join(right, "b")
    near = near.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    bits = F.aggregate(F.zip_with("s_a", "s_b", lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda t, x: t + x)
    near = near.where(bits <= most_bits(percent / 100 - slack, BANDS * ROWS)).select("a", "b")
    left, right = (sets.select(F.col("node").alias(x), F.col("members").alias(f"m_{x}")) for x in "ab")
    both = near.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("m_a", "m_b"))
    return both.where(100 * shared >= percent * (F.size("m_a") + F.size("m_b") - shared)).select("a", "b").distinct()


def near_groups(df: DataFrame, shingle: int = 5, percent: int = 80, slack: float = 0.16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable), kept (doc_id = component_id); one row per document."""
    docs = id_and_text(df, id_col, text_col)
    with scratch(df.sparkSession):
        signed = stored(signatures(docs, shingle), "signatures")
        sizes = stored(signed.select("doc_id", "digest", "n_shingles"), "sizes", keep=True)
        of_class = stored(_memberships(docs, signed, shingle, percent, slack), "membership", keep=True)
    found = sizes.join(of_class, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _memberships(docs: DataFrame, signed: DataFrame, shingle: int, percent: int, slack: float) -> DataFrame:
    """digest, root: the component of each class of equal sets."""
    classes = stored(signed.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("node")), "classes")
    own = signed.join(classes, "digest").where("doc_id = node")
    sketches = stored(own.select("node", "n_shingles", "sketch", "bands"), "sketches")
    buckets = sketches.select("node", F.explode("bands").alias("bucket"))
    shared = stored(buckets.groupBy("bucket").agg(F.min("node").alias("centre"), F.max("node").alias("last")).where("centre < last").select("bucket", "centre"), "buckets")
    members = stored(buckets.join(shared, "bucket").select("bucket", "node", "centre"), "members")
    sketches = sketches.select("node", "n_shingles", "sketch")
    sets = stored(full_sets(docs.join(members.select(F.col("node").alias("doc_id")).distinct(), "doc_id").select("doc_id", "text"), shingle), "sets")
    star = members.where("node != centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    links = stored(_confirmed(star, sketches, sets, percent, slack), "confirmed")
    roots = stored(components(links), "roots")
    more = _between(_mixed(members.select("bucket", "node"), roots), sets.join(sketches, "node"), percent, slack)
    roots = stored(components(links.union(stored(more, "confirmed"))), "roots")
    return classes.join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("root"))


def _mixed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """bucket, node, root of the buckets that hold more than one component."""
    rows = stored(members.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root")), "open")
    mixed = stored(rows.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("bucket"), "mixed")
    return stored(rows.join(mixed, "bucket"), "open")


def _between(rows: DataFrame, sets: DataFrame, percent: int, slack: float) -> DataFrame:
    """Links a, b between components of a bucket: its minority (all but its largest component) against all its members.

    Sides are cut into p and q blocks; a bucket that fits one block is sent once, its minority marked."""
    sized = rows.join(sets.select("node", (8 * F.col("n_shingles") + 256).alias("bytes")), "node")
    of_root = sized.groupBy("bucket", "root").agg(F.sum("bytes").alias("bytes"))
    plan = of_root.groupBy("bucket").agg(F.max_by("root", F.struct("bytes", "root")).alias("major"), F.sum("bytes").alias("total"), F.max("bytes").alias("largest"))
    blocks = lambda x: F.ceil(x / BLOCK_BYTES).cast("int")
    plan = stored(plan.select("bucket", "major", F.when(F.col("total") <= BLOCK_BYTES, 1).otherwise(F.greatest(F.lit(1), blocks(F.col("total") - F.col("largest")))).alias("p"), blocks(F.col("total")).alias("q")), "plan")
    planned = rows.join(plan, "bucket").withColumn("minor", F.col("root") != F.col("major"))
    whole = (F.col("p") == 1) & (F.col("q") == 1)
    block = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    once = planned.where(whole).select("bucket", F.lit(0).alias("i"), F.lit(0).alias("j"), "node", "root", "minor", F.lit(True).alias("met"))
    asks = planned.where(~whole & F.col("minor")).withColumn("i", block(F.col("p"))).select("bucket", "i", every(F.col("q")).alias("j"), "node", "root", F.lit(True).alias("minor"), F.lit(False).alias("met"))
    answers = planned.where(~whole).withColumn("j", block(F.col("q"))).select("bucket", every(F.col("p")).alias("i"), "j", "node", "root", F.lit(False).alias("minor"), F.lit(True).alias("met"))
    sent = once.unionByName(asks).unionByName(answers).join(sets, "node")
    bits = most_bits(percent / 100 - slack, BANDS * ROWS)

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        node, n = group.column("node").to_numpy(), group.column("n_shingles").to_numpy()
        lists, sketches = group.column("members").combine_chunks(), group.column("sketch").combine_chunks()
        starts = lists.offsets.to_numpy()
        sketch = sketches.flatten().to_numpy().view(np.uint64).reshape(len(node), -1)
        values, codes = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        starts = starts - starts[0]
        seen = np.zeros(len(values), np.int32)
        met = group.column("met").to_numpy()
        roots = group.column("root").to_numpy().copy()
        a, b = [], []
        for x in np.flatnonzero(group.column("minor").to_numpy()):
            may = met & (roots != roots[x]) & (100 * np.minimum(n, n[x]) >= percent * np.maximum(n, n[x]))
            if may.any():
                may[may] = np.bitwise_count(sketch[may] ^ sketch[x]).sum(axis=1) <= bits
            if not may.any():
                continue
            own = codes[starts[x] : starts[x + 1]]
            seen[own] = 1
            shared = np.add.reduceat(seen[codes], starts[:-1])
            seen[own] = 0
            for y in np.flatnonzero(may & (100 * shared >= percent * (n + n[x] - shared))):
                if roots[y] != roots[x]:
                    a.append(node[x])
                    b.append(node[y])
                    roots[roots == roots[y]] = roots[x]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return sent.groupBy("bucket", "i", "j").applyInArrow(compare, "a long, b long").distinct()
