"""Token ids in ORC: integer run-length encoding, row indexes and Bloom filters on document ids.

Documents are dealt by ranges of doc_id and sorted, tokenized in that order and written as ORC by Spark's own writer:
the id lists are integer run-length encoded, every `stride` rows get minimum and maximum, and doc_id gets a Bloom
filter, so a lookup of one document skips files, stripes and row groups. Stripes are the unit of parallel reads: a
large file is read by several tasks. A row holds its place within its file; the ids before a file come from one small
sum per file.

Defined cases: null or empty text is the end id alone; equal doc_ids are ordered by text; a null doc_id comes first;
an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, list_array, shared_path, slices, stored
from .encode import Encoder

SCHEMA = "shard int, doc_id long, local_start long, n_tokens long, ids array<int>"


def write_token_files(df: DataFrame, to: str, end_id: int = 1, tokenizer: str = "word_bpe_49k.json", path: str | None = None, files: int | None = None, id_col: str = "doc_id", text_col: str = "text", stripe_mb: int = 16, stride: int = 1000) -> str:
    """Tokenize all documents into ORC files at `to`, in ascending doc_id order. files: how many (default: shuffle partitions)."""
    docs = id_and_text(df, id_col, text_col)
    n = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, at = Encoder.held(tokenizer, path), TaskContext.get().partitionId(), 0
        for part in slices(batches):
            ids, sizes = encoder.flat(part.column(1), end_id)
            starts = at + np.cumsum(sizes) - sizes
            at += int(sizes.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sizes), shard, np.int32)), part.column(0), pa.array(starts), pa.array(sizes), list_array(ids.view("<i4"), sizes, pa.int32())], names=["shard", "doc_id", "local_start", "n_tokens", "ids"])

    dealt = docs.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, SCHEMA)
    options = {"compression": "lz4", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": str(stride), "orc.stripe.size": str(stripe_mb << 20)}
    dealt.write.options(**options).orc(to)
    return to


def read_token_files(spark, at: str) -> DataFrame:
    """Rows of the files with `start`, the ids of all documents before it. Filters on doc_id prune files, stripes and row groups."""
    rows = spark.read.schema(SCHEMA).orc(at)
    sums = stored(rows.groupBy("shard").agg(F.sum("n_tokens").alias("n")), "sums")  # one row per file
    base = sums.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    if sums.count() <= 1_000_000:  # some 30 MB at most
        base = F.broadcast(base)
    return rows.join(base, "shard").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def checksums(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            offsets = ids.offsets.to_numpy()
            flat = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "start", "n_tokens")] + [pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_digest(df: DataFrame, **options) -> DataFrame:
    """Write, read back, and digest what was read."""
    spark = df.sparkSession
    return checksums(read_token_files(spark, write_token_files(df, shared_path(spark, "tokens"), **options)))
