"""Judge replies: fences, the first balanced object, strict validation. One Arrow pass gives a struct or null."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The keys and values of a reply.
SUBJECTIVITY = ["objective", "subjective"]
POLARITY = ["positive", "negative", "neutral", "mixed"]
VOICE = ["first_person", "third_person", "mixed"]
KEYS = ["subjectivity", "polarity", "confidence", "domain", "narrative_voice", "sentiment_target", "rationale"]
REPLY = "subjectivity string, polarity string, confidence double, domain string, narrative_voice string, sentiment_target string, rationale string"

_FENCE = re.compile(r"```(?:json)?\s*(.*?)\s*```", re.S)
_STEP = re.compile(r'["{}]')
_STRING_END = re.compile(r'(?:[^"\\]|\\.)*"', re.S)


def unfenced(text: str) -> str:
    whole = _FENCE.fullmatch(text.strip())
    return whole.group(1) if whole else text


def first_object(text: str) -> str | None:
    """From the first brace to the one that closes it; braces in strings do not count."""
    begin = at = text.find("{")
    depth = 0
    while at >= 0 and (m := _STEP.search(text, at)):
        at = m.end()
        if m.group() == '"':
            closing = _STRING_END.match(text, at)
            at = closing.end() if closing else -1
        else:
            depth += 1 if m.group() == "{" else -1
            if not depth:
                return text[begin:at]
    return None


def is_valid(reply: object, rationale: bool = True) -> bool:
    wanted = set(KEYS if rationale else KEYS[:-1])
    if not isinstance(reply, dict) or reply.keys() != wanted:
        return False
    filled = lambda v: isinstance(v, str) and v.strip() != ""
    sure, polarity, target = reply["confidence"], reply["polarity"], reply["sentiment_target"]
    return (
        reply["subjectivity"] in SUBJECTIVITY
        and (polarity is None) == (reply["subjectivity"] == "objective")
        and (polarity is None or polarity in POLARITY)
        and type(sure) in (int, float)
        and 0 <= sure <= 1
        and reply["narrative_voice"] in VOICE
        and filled(reply["domain"])
        and (target is None or isinstance(target, str))
        and (not rationale or filled(reply["rationale"]))
    )


def parse_text(text: str | None, rationale: bool = True) -> dict | None:
    try:
        reply = json.loads(first_object(unfenced(text or "")) or "null")
        return reply if is_valid(reply, rationale) else None
    except (ValueError, TypeError):
        return None


def parse_reply(raw: Column, rationale: bool = True) -> Column:
    """Struct of the reply's fields, null where the reply is not valid."""

    @F.pandas_udf(f"ok boolean, {REPLY}")
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            found = [parse_text(t, rationale) for t in s]
            rows = [(r is not None, *((r or {}).get(k) for k in KEYS)) for r in found]
            yield pd.DataFrame(rows, columns=["ok", *KEYS], index=s.index).astype({"confidence": "float64"})

    parsed = parse(raw)
    return F.when(parsed["ok"], F.struct(*[parsed[k].alias(k) for k in KEYS]))


def parse_lid_reply(raw: Column, labels: list[str]) -> Column:
    """label (lower case, `other` if unknown), confidence clamped to 0..1, reason of at most 80 characters."""
    body = F.from_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0), "label string, confidence double, reason string")
    label = F.lower(F.trim(F.coalesce(body["label"], F.lit(""))))
    return F.struct(
        F.when(label.isin(labels), label).otherwise("other").alias("label"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(body["confidence"], F.lit(0.0)))).alias("confidence"),
        F.substring(F.coalesce(body["reason"], F.lit("")), 1, 80).alias("reason"),
    )
