"""What the training-data operators share: tables, the shared folder, worker-side memos."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows turned from Arrow into Python at once; long texts make a slice end sooner.
SLICE_ROWS, SLICE_BYTES = 4096, 10 << 20
#: What a worker holds for an operator (memos, tokenizers): name -> how to let go of it.
_HELD_BY: dict[str, Callable[[], None]] = {}
_now: list[str] = []
try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def tidy() -> None:
    """Give freed memory back to the machine: several workers share an executor's memory."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def holds(name: str, let_go: Callable[[], None]) -> None:
    _HELD_BY[name] = let_go


def only(name: str) -> None:
    """A worker serves many stages. When one of another operator begins, what the last one held goes."""
    if _now != [name]:
        for other, let_go in _HELD_BY.items():
            if other != name:
                let_go()
        _now[:] = [name]
        gc.collect()
        tidy()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, local mode (tests) gets one of
    our own; on a cluster that is an error, as a machine's own folder is not shared."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="corpusloom-shared-")
        spark.sparkContext.setCheckpointDir(base)
    return base


#: Applications whose folder goes when they end.
_ending: set[str] = set()


def shared_path(spark: SparkSession, name: str) -> str:
    app = spark.sparkContext.applicationId
    base = f"{shared_dir(spark).rstrip('/')}/corpusloom/{app}"
    if app not in _ending:  # tables that no scratch deletes go with the application
        at = spark._jvm.org.apache.hadoop.fs.Path(base)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(at)  # only what exists is deleted on exit
        fs.deleteOnExit(at)
        _ending.add(app)
    return f"{base}/{name}-{uuid.uuid4().hex}"


#: Tables written since each open scratch began: path, and name where the catalog has one.
_scratch: list[list[tuple[str, str | None]]] = []


def stored(df: DataFrame, name: str, keep: bool = False, codec: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors.

    Within a scratch the table goes when the scratch ends; with keep it outlives this scratch, as results that are read
    later must, and goes with the one around it, if there is one."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    if len(_scratch) > keep:
        _scratch[-1 - keep].append((path, None))
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, parts: int, *keys: str, keep: bool = False) -> DataFrame:
    """Like stored, but in buckets by keys, so that later joins on them leave these rows, texts above all, where they are.
    df should be dealt by the same keys and number already: a bucket is a file then."""
    spark = df.sparkSession
    path, table = shared_path(spark, name), f"corpusloom_{name}_{uuid.uuid4().hex}"
    df.write.option("path", path).option("compression", "zstd").bucketBy(parts, *keys).saveAsTable(table)
    if len(_scratch) > keep:
        _scratch[-1 - keep].append((path, table))
    release(spark)
    return spark.table(table)


def text_parts(spark: SparkSession, total: int, each: int = 32 << 20) -> int:
    """In how many parts `total` bytes of text are dealt: some 32 MB each, and as many as shuffles have at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // each))


def release(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of a finished query once the driver collects its garbage: have it do so now."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    spark._jvm.System.gc()


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Rows that go to Python at once while tables are stored within: few where rows are large, to bound memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the tables stored within, but for kept ones, on the way out."""
    _scratch.append([])
    try:
        yield
    finally:
        for path, table in _scratch.pop():
            if table:
                spark.sql(f"DROP TABLE IF EXISTS {table}")
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns under our own names, so that extra columns cannot clash; a null text counts as empty."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def row_of(df: DataFrame) -> Column:
    """All columns of df as one, `row`, so that no name of ours can clash with them."""
    return F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("row")


def columns_of(df: DataFrame, new: dict[str, Column]) -> list[Column]:
    """The columns of df out of `row`, some of them anew."""
    return [new.get(c, F.col("row").getField(c)).alias(c) for c in df.columns]


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that only a few MB are Python objects at a time."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, SLICE_ROWS)
            if part.nbytes > SLICE_BYTES and part.num_rows > 1:
                part = part.slice(0, max(1, int(SLICE_ROWS * SLICE_BYTES / part.nbytes)))
            yield part
            at += part.num_rows
        if batch.nbytes > SLICE_BYTES // 10:
            tidy()


@contextmanager
def uncollected() -> Iterator[None]:
    """No search for cycles within: it would go over all strings of a memo time and again, and there are none."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


class Memo:
    """A bounded word memo: word -> value, filled in bulk for the words of a slice that it lacks.

    Two generations: when the young one is half of `most`, it becomes the old one; a word met again moves back. So words
    in use stay, and memory is flat. Words too long to recur are not kept.
    """

    def __init__(self, fill, most: int = 400_000, longest: int = 256):
        self.fill, self.most, self.longest = fill, most, longest
        self.young: dict = {}
        self.old: dict = {}

    def clear(self) -> None:
        self.young, self.old = {}, {}

    def values(self, words: list) -> list:
        """The value of each of these distinct words."""
        found = list(map(self.young.get, words))
        missing = [i for i, v in enumerate(found) if v is None]
        if missing:
            lost = [words[i] for i in missing]
            values = list(map(self.old.get, lost))
            unknown = [w for w, v in zip(lost, values, strict=True) if v is None]
            new = iter(self.fill(unknown))
            values = [next(new) if v is None else v for v in values]
            for i, v in zip(missing, values, strict=True):
                found[i] = v
            if len(self.young) + len(lost) > self.most // 2:
                self.old, self.young = self.young, {}
            self.young.update(zip(lost, values, strict=True))
            for w in [w for w in unknown if len(w) > self.longest]:
                self.young.pop(w, None)
        return found


def coded(pieces: pa.ListArray) -> tuple[np.ndarray, np.ndarray, list]:
    """Lists of words as codes, the end of each list among them, and the distinct words: Python meets a word once a slice."""
    ends = pieces.offsets.to_numpy()
    words = pieces.flatten().dictionary_encode()
    return words.indices.to_numpy(), ends[1:] - ends[0], words.dictionary.to_pylist()


def spread(parts: list[np.ndarray] | list[bytes], codes: np.ndarray, ends: np.ndarray, kind: str = "<u4") -> tuple[np.ndarray, np.ndarray]:
    """parts[code] for all codes, end to end, and where each list of codes ends in the result."""
    flat = np.frombuffer(b"".join(parts), kind)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // np.dtype(kind).itemsize
    starts = np.cumsum(sizes) - sizes
    own = sizes[codes]
    upto = np.cumsum(own)
    total = int(upto[-1]) if len(upto) else 0
    at = np.repeat(starts[codes] - (upto - own), own) + np.arange(total)
    return flat[at], np.concatenate([[0], upto])[ends]


def list_array(flat: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def tokenizer_file(name: str, path: str | None = None) -> str:
    """Where a public tokenizer's file lies on this machine. The path is a parameter; nothing is copied."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(name)


def quiet_tokenizers() -> None:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
