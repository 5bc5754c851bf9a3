"""Manifest and provenance: counts, run dates, single-valued settings, value checks, schemas, reports."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dedup import unexpected_values

UNRECORDED = "not recorded"


def counts_by(df: DataFrame, dims: list[str]) -> DataFrame:
    """dimension, value, n for each dimension and the total, in one pass of grouping sets."""
    sets = df.groupingSets([[F.col(d)] for d in dims] + [[]], *dims).agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    full = (1 << len(dims)) - 1
    name, value = F.when(F.col("g") == full, "total"), F.when(F.col("g") == full, "all")
    for i, d in enumerate(dims):
        only = full & ~(1 << (len(dims) - 1 - i))
        name, value = name.when(F.col("g") == only, d), value.when(F.col("g") == only, F.col(d).cast("string"))
    return sets.select(name.alias("dimension"), F.coalesce(value, F.lit("null")).alias("value"), "n")


def run_dates(df: DataFrame, column: str, by: list[str] = ()) -> DataFrame:
    """first, last of the recorded dates, of all or by some columns."""
    date = F.nullif(F.col(column), F.lit(UNRECORDED))
    return df.groupBy(*by).agg(F.min(date).alias("first"), F.max(date).alias("last"))


def several_valued(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """group, column, n of settings that are not the same throughout a group. Null counts as a value."""
    own = lambda c: (F.countDistinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(c)
    wide = df.groupBy(group).agg(*map(own, columns))
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in columns])
    return wide.select(group, F.explode(rows).alias("r")).select(group, "r.column", "r.n").where("n > 1")


def inferred_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, types: the types of its values as JSON values, sorted, joined by a bar; null among them."""
    kind = lambda c: F.when(F.col(c).isNull(), "null").otherwise(F.regexp_extract(F.lower(F.schema_of_variant(F.try_parse_json(F.to_json(F.struct(F.col(c).alias("v")))))), "^object<v: (.*)>$", 1))
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), kind(c).alias("type")) for c in columns])).alias("r")).select("r.*")
    return rows.groupBy("column").agg(F.array_join(F.array_sort(F.collect_set("type")), "|").alias("types"))


def run_log(spark: SparkSession, markdown: str) -> DataFrame:
    """Rows of the first Markdown table in a text, all strings."""
    lines = [line.strip().strip("|") for line in markdown.splitlines() if line.strip().startswith("|")]
    cells = [[c.strip() for c in line.split("|")] for line in lines]
    head, body = cells[0], [r for r in cells[1:] if not all(re.fullmatch(r":?-+:?", c) for c in r)]
    return spark.createDataFrame([tuple(r) for r in body if len(r) == len(head)], ", ".join(f"`{h}` string" for h in head))


def revision_drift(recorded: DataFrame, resolved: DataFrame) -> DataFrame:
    """judge, recorded, resolved where a revision found later is not the one of the run, or was changed after it."""
    both = recorded.join(resolved, "judge")
    changed = F.to_date(F.substring("last_modified", 1, 10)) > F.to_date("run_date")
    return both.where(F.coalesce(F.col("revision") != F.col("resolved"), F.lit(False)) | (F.col("revision").isNull() & changed)).select("judge", F.col("revision").alias("recorded"), "resolved")


def resolved_revisions(spark: SparkSession, repos: dict[str, str], resolve: Callable[[str], tuple[str, str | None]]) -> DataFrame:
    """judge, resolved, last_modified of each judge's repository, asked of `resolve` (repository -> revision, time of the
    last change as ISO text) once per judge. What it raises is an error that names the judge."""
    found = []
    for judge, repo in repos.items():
        try:
            found.append((judge, *resolve(repo)))
        except Exception as e:
            raise RuntimeError(f"{judge}: no revision of {repo}: {e}") from e
    return spark.createDataFrame(found, "judge string, resolved string, last_modified string")


def log_text(raw: str) -> str:
    """The text of a log that is a JSON array of {stream_name, time, data}; other logs as they are."""
    try:
        return "".join(x["data"] for x in json.loads(raw))
    except (ValueError, KeyError, TypeError):
        return raw


def small(df: DataFrame, most: int = 10_000) -> list[dict]:
    """The rows of a table of figures; more than `most` are an error, not a part of them."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: not a table of figures")
    return [r.asDict(recursive=True) for r in rows]


def roster(sidecars: DataFrame, own: list[str], shared: list[str]) -> dict:
    """judges (settings by judge) and decoding (settings of all), each with one value only: another is an error."""
    together = sidecars.withColumn("all", F.lit("all"))
    for rows, group, columns in ((sidecars, "judge", own), (together, "all", shared)):
        differing = [f"{r[group]}: {r['column']} has {r['n']} values" for r in small(several_valued(rows, group, columns))] if columns else []
        if differing:
            raise ValueError("; ".join(sorted(differing)))
    judges = small(sidecars.groupBy("judge").agg(*[F.max(c).alias(c) for c in own]).orderBy("judge")) if own else []
    decoding = small(sidecars.agg(*[F.max(c).alias(c) for c in shared]))[0] if shared else {}
    return {"judges": {r.pop("judge"): r for r in judges}, "decoding": decoding}


def prompt_record(text: str, recorded: str) -> dict:
    """sha256 and word count of a prompt, whose hash must be the one that the runs recorded."""
    found = hashlib.sha256(text.encode()).hexdigest()
    if found != recorded:
        raise ValueError(f"the prompt's hash is {found}, the runs recorded {recorded}")
    return {"sha256": found, "words": len(text.split())}


def run_manifest(master: DataFrame, sidecars: DataFrame, judges: list[str], own: list[str], shared: list[str], prompt: str, dims: list[str], expected: dict[str, list[str]], provenance: dict, files: DataFrame | None = None) -> dict:
    """Everything about a master table in one dict: roster, decoding, prompt, run dates, counts (rows, ids, verdicts by judge,
    rows by each of dims), types and values of its columns, provenance, and integrity of the written files.

    sidecars: judge, chunk, date, prompt_file_sha256 and the settings own (by judge) and shared (by all). expected: the
    values that a column may hold; others are listed as unexpected.
    """
    who = roster(sidecars, own, [*shared, "prompt_file_sha256"])
    has = lambda j: F.count(f"judge_{j}_subjectivity").alias(j)
    total = small(master.agg(F.count("*").alias("rows"), F.countDistinct("id").alias("ids"), *map(has, judges)))[0]
    by: dict[str, dict] = {d: {} for d in dims}
    for r in small(counts_by(master, dims)):
        if r["dimension"] != "total":
            by[r["dimension"]][r["value"]] = r["n"]
    verdicts = {j: total[j] for j in judges}
    values = {c: {"expected": sorted(v), "unexpected": small(unexpected_values(master, c, v))} for c, v in expected.items()}
    return {
        "roster": who["judges"],
        "decoding": who["decoding"],
        "prompt": prompt_record(prompt, who["decoding"].pop("prompt_file_sha256")),
        "run_dates": {r.pop("judge"): r for r in small(run_dates(sidecars, "date", ["judge"]))},
        "counts": {"rows": total["rows"], "ids": total["ids"], "verdicts": verdicts, "decisions": sum(verdicts.values()), "by": by},
        "types": {r["column"]: r["types"] for r in small(inferred_types(master, master.columns))},
        "values": values,
        "provenance": provenance,
        "integrity": small(files) if files is not None else [],
    }


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """A small result as a Markdown table; one of more than `most` rows is an error."""
    rows = small(df, most)
    line = lambda cells: "| " + " | ".join("" if c is None else f"{c:.4f}" if isinstance(c, float) else str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), line(["-"] * len(df.columns)), *(line(r.values()) for r in rows)])


def report(title: str, sections: list[tuple[str, str, DataFrame | None]]) -> tuple[str, str]:
    """A report as Markdown and as JSON. sections: heading, a paragraph, and a small table or None."""
    lines, held = [f"# {title}"], {}
    for heading, paragraph, table in sections:
        lines += [f"## {heading}", *([paragraph] if paragraph else []), *([markdown_table(table)] if table is not None else [])]
        held[heading] = {"text": paragraph, "rows": small(table) if table is not None else []}
    return "\n\n".join(lines) + "\n", json.dumps({"title": title, "sections": held}, ensure_ascii=False, default=str)


def identifiability(ratios: DataFrame, method: str, most: float = 3.0) -> str:
    """One paragraph on whether a consensus method gives labels far from the votes cast."""
    worst = ratios.orderBy(F.desc("ratio"), "label").first()
    if worst is None or worst["ratio"] <= most:
        return f"{method}: no label is given more than {most:g} times as often as it was voted."
    return f"{method}: label {worst['label']} is given {worst['ratio']:.1f} times as often as it was voted ({worst['share']:.1%} against {worst['raw']:.1%}); the model is not identified by these votes."
