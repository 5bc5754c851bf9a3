"""Readers and writers of the interchange files."""

from __future__ import annotations

import hashlib
import re
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import not_yet_there
from ..operators.merge import with_origin
from ..schema import SIDECAR, struct

CORRUPT = "_corrupt_record"


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Strict: a malformed line is an error."""
    return spark.read.schema(struct(schema)).option("mode", "FAILFAST").json(path)


def read_jsonl_tolerant(spark: SparkSession, path: str | list[str], schema: str) -> tuple[DataFrame, DataFrame]:
    """Good rows, and malformed lines as text."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    own = struct(schema)
    parsed = lines.select("value", F.from_json("value", struct(f"{schema}, {CORRUPT} string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r"))
    bad = F.col("r").isNull() | F.col(f"r.{CORRUPT}").isNotNull()
    return parsed.where(~bad).select(*[F.col("r")[c].alias(c) for c in own.names]), parsed.where(bad).select(F.col("value").alias(CORRUPT))


def read_corpus(spark: SparkSession, pattern: str, schema: str, excluded: list[str]) -> DataFrame:
    """All files of a glob but those with an excluded name, with file and row_in_file, by which deduplication orders rows."""
    rows = spark.read.schema(struct(schema)).json(pattern)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    rows = rows.select("*", name.alias("file"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("row_in_file"))
    return rows.where(~F.col("file").isin(excluded)) if excluded else rows


def read_sidecars(spark: SparkSession, pattern: str) -> DataFrame:
    """One row per run sidecar (a JSON object per file), with judge and chunk from its path."""
    return with_origin(spark.read.schema(struct(SIDECAR)).option("multiLine", "true").json(pattern))


def require_filled(df: DataFrame, column: str, key: str = "id", most: int = 20) -> DataFrame:
    """df, if no row has a blank in the column; otherwise an error that names some of the keys."""
    blank = [r[key] for r in df.where(F.trim(F.coalesce(F.col(column), F.lit(""))) == "").select(key).orderBy(key).limit(most).collect()]
    if blank:
        raise ValueError(f"{column} is blank for {blank}")
    return df


def split_by(df: DataFrame, condition, matching: str, rest: str) -> None:
    """Two outputs of one table by a predicate; null goes to the rest."""
    held = df.persist()
    try:
        write_jsonl(held.where(condition), matching)
        write_jsonl(held.where(~F.coalesce(condition, F.lit(False))), rest)
    finally:
        held.unpersist()


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header, all strings; a byte-order mark before the first name is dropped."""
    rows = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    return rows.toDF(*[c.lstrip("﻿") for c in rows.columns])


def write_csv(df: DataFrame, path: str, columns: list[str], blank: list[str] = ()) -> None:
    """Fixed columns, blank ones for people to fill, and a byte-order mark for spreadsheet programs."""
    out = df.select(*[F.lit("").alias(c) if c in blank else F.col(c) for c in columns])
    first = out.columns[0]
    out.withColumnRenamed(first, f"﻿{first}").write.mode("errorifexists").csv(path, header=True, escape='"', quoteAll=False, emptyValue="")


def write_jsonl(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Nulls are written; without overwrite an existing path is an error."""
    df.write.mode("overwrite" if overwrite else "errorifexists").option("ignoreNullFields", "false").json(path)


def append_new(new: DataFrame, path: str, schema: str, key: str = "id") -> None:
    """Append rows whose key is not there yet; one row per key."""
    spark = new.sparkSession
    jvm = spark._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    exists = there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)
    existing = spark.read.schema(struct(schema)).json(path) if exists else spark.createDataFrame([], struct(schema))
    not_yet_there(new, existing, key).write.mode("append").option("ignoreNullFields", "false").json(path)


def write_tagged(df: DataFrame, tag: str, kept: str, rejected: str) -> None:
    """Two files from one tagged table: rows without a reason, and the rest with it. Computed once."""
    held = df.persist()
    try:
        write_jsonl(held.where(F.col(tag).isNull()).drop(tag), kept)
        write_jsonl(held.where(F.col(tag).isNotNull()), rejected)
    finally:
        held.unpersist()


def _opened(path: str):
    """A file of any file system as a stream of bytes."""
    if path.startswith("file:"):
        return open(re.sub("^file:/+", "/", path), "rb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(quote(path, safe=":/@"))
    return system.open_input_stream(inner)


def integrity(spark: SparkSession, paths: list[str], piece: int = 1 << 20) -> DataFrame:
    """path, bytes, sha256 of files, or of the files of folders. Spark lists them; tasks read them in pieces, so files may be
    of any size. Empty files, which Spark passes over, are not listed."""
    files = spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("bytes"))

    def hashed(batches):
        for b in batches:
            sums = []
            for path in b["path"]:
                h = hashlib.sha256()
                with _opened(path) as f:
                    while part := f.read(piece):
                        h.update(part)
                sums.append(h.hexdigest())
            yield b.assign(sha256=sums)

    return files.mapInPandas(hashed, "path string, bytes long, sha256 string")
