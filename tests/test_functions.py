"""Text functions against written expectations, judge replies against their cases."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import judge_json as J
from corpusloom.functions import text as T

SAMPLES = [
    "", "  ", "सादा वाक्य बा।", "मेल a.b+c@d-e.co.in करीं", "फोन +91 9876543210 आ 09876543210x", "@राम @ab x@yy", "http://x.y/z?q www.a.b c",
    "<ref name=x>a\nb</ref> {{t|u}} [[l|m]] File:a.jpg|x <b>q</b> चित्र:क.png]", "a b\tc\x1cd e", "thumb bright px 12", "Profile:xy image:ab",
    "०९८७६५४३२१० 9८७६५४३२१०", "NFD é é", "x" * 300, "1-abc", "दि० १", "ends with dot. New? Yes! \n\nline।two॥three",
]


def applied(spark, column):
    rows = spark.createDataFrame(list(enumerate(SAMPLES)), "n int, t string").select("n", column(F.col("t")).alias("r")).orderBy("n").collect()
    return [r["r"] for r in rows]


#: What markup stripping makes of samples, where it changes them.
STRIPPED = {
    "<ref name=x>a\nb</ref> {{t|u}} [[l|m]] File:a.jpg|x <b>q</b> चित्र:क.png]": "       |x  q   ]",
    "Profile:xy image:ab": "Profile:xy  ",
}
#: What the removal of personal data makes of samples, where it changes them.
PRIVATE = {
    "मेल a.b+c@d-e.co.in करीं": "मेल   करीं",
    "@राम @ab x@yy": "@राम   x@yy",
    "http://x.y/z?q www.a.b c": "    c",
}
#: Sentences of samples that have several, or none.
SPLIT = {
    "": [], "  ": [],
    "सादा वाक्य बा।": ["सादा वाक्य बा"],
    "ends with dot. New? Yes! \n\nline।two॥three": ["ends with dot", "New", "Yes", "line", "two", "three"],
}


@pytest.mark.parametrize(("column", "cases"), [(T.strip_markup, STRIPPED), (T.strip_pii, PRIVATE)])
def test_stripping(spark, column, cases):
    got = dict(zip(SAMPLES, applied(spark, column), strict=True))
    assert {t: got[t] for t in cases} == cases
    plain = ("", "  ", "सादा वाक्य बा।", "a b\tc\x1cd e", "thumb bright px 12", "x" * 300, "1-abc", "दि० १", "ends with dot. New? Yes! \n\nline।two॥three")
    assert all(got[t] == t for t in plain)


def test_phone_numbers(spark):
    rows = [("फोन +91 9876543210 आ", "फोन   आ"), ("call 09876543210.", "call  ."), ("n 5876543210 n", "n 5876543210 n"), ("n 987654321 n", "n 987654321 n")]
    got = spark.createDataFrame(rows, "t string, want string").select(T.strip_pii(F.col("t")).alias("r"), "want").collect()
    assert all(r["r"] == r["want"] for r in got), got


def test_normalize(spark):
    assert applied(spark, T.normalize) == [" ".join(unicodedata.normalize("NFC", t).split()) for t in SAMPLES]


def test_sentences(spark):
    got = dict(zip(SAMPLES, applied(spark, T.sentences), strict=True))
    assert {t: got[t] for t in SPLIT} == SPLIT


def test_gates_of_devanagari(spark):
    rows = [("भोजपुरी में लिखल एगो लमहर वाक्य", None, "devanagari"), ("भोजपुरी में", "short", "devanagari"), ("an english sentence of some length", "script", "latin"), ("भोजपुरी में लिखल english शब्द mixed together", None, "mixed")]
    got = spark.createDataFrame(rows, "t string, reason string, script string").select("reason", "script", T.gate_reason(F.col("t")).alias("r"), T.script_of(F.col("t")).alias("s"), T.passes_filter(F.col("t")).alias("f")).collect()
    assert all((r["r"], r["s"]) == (r["reason"], r["script"]) for r in got), got
    assert [r["f"] for r in got] == [True, False, False, False]


def test_scripts_and_gates(spark):
    assert applied(spark, T.script_of)[:3] == ["other", "other", "devanagari"]
    gates = applied(spark, T.gate_reason)
    assert gates[:4] == ["short", "short", "short", None] and gates[SAMPLES.index("x" * 300)] == "script"
    assert applied(spark, T.is_boilerplate)[SAMPLES.index("thumb bright px 12")] is True
    assert applied(spark, T.is_boilerplate)[SAMPLES.index("1-abc")] is True


GOOD = '{"subjectivity": "subjective", "polarity": "mixed", "confidence": 0.5, "domain": "a {b} \\" c", "narrative_voice": "mixed", "sentiment_target": null, "rationale": "r"}'


@pytest.mark.parametrize(
    "text, ok",
    [
        (GOOD, True), (f"{GOOD} | {GOOD}", True), (f"{GOOD}\nNote: x }}", True), (f"```json\n{GOOD}\n```", True), (GOOD[:-5], False), (f"text {GOOD}", True),
        (GOOD.replace('"mixed", "confidence"', 'null, "confidence"'), False), (GOOD.replace("subjective\"", "objective\"", 1), False), (GOOD.replace("0.5", "true"), False),
        (GOOD.replace("0.5", '"0.9"'), False), (GOOD.replace("0.5", "-0.1"), False), (GOOD.replace("0.5", "1"), True), (GOOD.replace("0.5", "NaN"), False), (GOOD.replace('"r"', '" "'), False),
        (GOOD.replace('null, "rationale"', '3, "rationale"'), False), (GOOD.replace('"rationale": "r"', '"other": 1'), False), ("[1]", False), ("", False), (None, False),
    ],
)
def test_replies(text, ok):
    assert (J.parse_text(text) is not None) == ok


def test_reply_without_rationale():
    short = GOOD.replace(', "rationale": "r"', "")
    assert J.parse_text(short, rationale=False) and not J.parse_text(short)


def test_reply_column(spark):
    rows = spark.createDataFrame([(GOOD,), ("no",), (None,)], "t string").select(J.parse_reply(F.col("t")).alias("p")).collect()
    assert [r["p"] is not None for r in rows] == [True, False, False] and rows[0]["p"]["domain"] == 'a {b} " c'
