"""Text functions: markup, personal data, white space, sentences, gates.

Regular expressions are written for Java and match what Python's Unicode classes match: white space and word characters
are spelled out, because Java's own classes are narrower (or, with the U flag, wider).

What every sentence goes through (splitting, squeezing, NFC, the fixed gates, keys, scripts) is done by Arrow within the
tasks: its expressions (RE2) read a text once for all alternatives, where Java tries each of them at each character. All
else are Column expressions.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType

WS = r"[\s\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NOT_WS = WS.replace("[", "[^", 1)
WORD = r"[\p{L}\p{N}_]"
EDGE = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"

# Patterns that results depend on.
REFERENCE = r"(?s)<ref[^>]*>.*?</ref>|<ref[^>]*/?>"
TEMPLATE = r"\{\{[^}]*\}\}"
WIKILINK = r"\[\[[^\]]*\]\]"
MEDIA = rf"(?iu)(?<!{WORD})(?:File|Image|चित्र|फाइल):[^\]\|]*"
TAG = r"<[^>]+>"
URL = rf"https?://{NOT_WS}+|www\.{NOT_WS}+"
EMAIL = rf"{EDGE}[\p{{L}}\p{{N}}_.+-]+@[\p{{L}}\p{{N}}_-]+\.[\p{{L}}\p{{N}}_.-]+{EDGE}"
PHONE = rf"(?:(?:\+?91(?:-|{WS})?)|0)?[6-9]\p{{Nd}}{{9}}{EDGE}"
HANDLE = rf"(?<!{WORD})@{WORD}{{2,}}"
SENTENCE_END = rf"[।॥?!]+|\.{WS}|\n+"
BOILERPLATE = [
    r"ग्रेगरियन कैलेंडर में साल के",
    r"साल के खतम होखे में अबहिन",
    rf"^तिहुआर,?{WS}*छुट्टी",
    r"^इहो देखल जाय",
    r"बाहरी कड़ी",
    rf"^घटना{WS}+जनम{WS}+निधन",
    r"^संदर्भ$",
    rf"thumb|right|left|px{EDGE}",
    rf"मौलिक{WS}*(?:व|एवं|और|आ)?{WS}*अप्रकाशित|अप्रकासित",
    r"आवश्यक सूचना|सभी सदस्यों से अनुरोध",
    r"क्लिक कर|Download OBO|Query/Feedback",
    r"महत्वपूर्ण लिंक्स|ग़ज़ल की कक्षा|ओबीओ प्रबन्धन",
    rf"देवनागरी.*टाइप करने हेतु|साधन{WS}*-{WS}*[12]",
    rf"ओपन बुक्स|ओ{WS}+बी{WS}+ओ|ओबीओ|डाट कॉम|OBO",
    r"आमंत्रण भेजे|नियम देखे|अनिवार्य है|रन करा दे|दर्ज करने हेतु",
    r"विज्ञापन योजना|सुझाव एवं शिकायत",
    r"ग़ज़ल से सम्बंधित|मात्रा गणना|तकतीअ|बहर परिचय|बहर के भेद",
    r"प्रबन्धन|वर्जित है",
    r"^दि०|^\p{Nd}-",
]
TITLE_CHROME = rf"मुख्य पेज|मुख्य पन्ना|Bhojpuria Lokraag|Launda Naach|^{WS}*\(?मुख्य|blog-post|Read more|Older Posts|Newer Posts"
STUBS = ["ग्रेगरियन कैलेंडर", "जनवरी-मार्च", "अप्रैल-जून", "जुलाई-सितंबर", "अक्टूबर-दिसंबर", "अज्ञात तिथि", "निधन तिहुआर", "छुट्टी अउरी खास महत्व"]
KEY_DROPPED = rf"(?:{WS}|[।॥.,!?\-–—:;\"'()])+"
DEVANAGARI, LATIN = r"[\x{0900}-\x{097F}]", "[A-Za-z]"
MIN_CHARS = 15

# The same for RE2, which has no look-around, ends `$` at the end only and lets a dot match other line ends than \n.
_SPACES = r"\t-\r\x1c- \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_LINE_END = r"\n\r\x{85}\x{2028}\x{2029}"


def _re2(pattern: str) -> str:
    """A pattern of this module for RE2, to find it, not to replace it: an edge, always behind a word character here, takes the next one."""
    out = pattern.replace(EDGE, r"(?:\z|[^\p{L}\p{N}_])").replace(WS, f"[{_SPACES}]").replace(".*", f"[^{_LINE_END}]*")
    return f"{out[:-1]}(?:\\r\\n|[{_LINE_END}])?\\z" if out.endswith("$") else out


_BOILERPLATE = "|".join(f"(?:{_re2(p)})" for p in BOILERPLATE)
_CHROME, _STUB = _re2(TITLE_CHROME), "|".join(STUBS)
_DROPPED, _END = _re2(KEY_DROPPED), _re2(SENTENCE_END)
_SOME_UNEVEN = f"  |[{_SPACES.replace('- ', '-' + chr(92) + 'x1f')}]"


def nfc(text: Column) -> Column:
    return _nfc(text)


@F.arrow_udf(StringType())
def _nfc(texts: pa.Array) -> pa.Array:
    """Unicode NFC, which Spark lacks; text that is NFC already, as all ASCII is, is passed on."""
    other = np.flatnonzero(~pc.fill_null(pc.string_is_ascii(texts), True).to_numpy(zero_copy_only=False))
    changed = {}
    for i, t in zip(other.tolist(), texts.take(pa.array(other)).to_pylist(), strict=True):
        if not unicodedata.is_normalized("NFC", t):
            changed[i] = unicodedata.normalize("NFC", t)
    if not changed:
        return texts
    mask = np.zeros(len(texts), bool)
    mask[list(changed)] = True
    return pc.replace_with_mask(texts, pa.array(mask), pa.array(changed.values(), texts.type))


def _flat(texts: pa.Array) -> pa.Array:
    """White-space runs to one space, ends trimmed; most texts have single spaces already and are passed on."""
    some = pc.fill_null(pc.match_substring_regex(texts, _SOME_UNEVEN), False)
    if pc.any(some).as_py():
        texts = pc.replace_with_mask(texts, some, pc.replace_substring_regex(texts.filter(some), f"[{_SPACES}]+", " "))
    return pc.ascii_trim(texts, " ")


@F.arrow_udf(StringType())
def _squeezed(texts: pa.Array) -> pa.Array:
    return _flat(texts)


@F.arrow_udf(ArrayType(StringType()))
def _split(texts: pa.Array) -> pa.Array:
    parts = pc.split_pattern_regex(texts, _END)
    counts = pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False)
    flat = _flat(parts.flatten())
    full = pc.not_equal(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    offsets = pa.array(before[np.concatenate([[0], np.cumsum(counts)])], pa.int32())
    return pa.ListArray.from_arrays(offsets, flat.filter(full), mask=texts.is_null())


@F.arrow_udf(StringType())
def _key(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, _DROPPED, "")


@F.arrow_udf(BooleanType())
def _is_boilerplate(texts: pa.Array) -> pa.Array:
    return pc.match_substring_regex(texts, _BOILERPLATE)


@F.arrow_udf(BooleanType())
def _is_chrome(texts: pa.Array) -> pa.Array:
    return pc.match_substring_regex(texts, _CHROME)


@F.arrow_udf(BooleanType())
def _is_stub(texts: pa.Array) -> pa.Array:
    return pc.match_substring_regex(texts, _STUB)


@F.arrow_udf(StringType())
def _stripped(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, rf"\A[{_SPACES}]+|[{_SPACES}]+\z", "")


@F.arrow_udf(StringType())
def _script(texts: pa.Array) -> pa.Array:
    """Letters counted on the bytes of a batch: in UTF-8 a Devanagari character is E0 with A4 or A5 behind it."""
    wide = texts.cast(pa.large_string())
    _, at, data = wide.buffers()
    ends = np.frombuffer(at, np.int64)[wide.offset : wide.offset + len(wide) + 1] if len(wide) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    deva = np.zeros(len(raw), bool)
    deva[:-1] = (raw[:-1] == 0xE0) & ((raw[1:] & 0xFE) == 0xA4)
    latin = ((raw | 0x20) - np.uint8(ord("a"))) < 26
    deva, latin = (np.diff(np.concatenate([[0], np.cumsum(marks)])[ends - ends[0]]) for marks in (deva, latin))
    both = deva + latin
    some = np.maximum(both, 1)
    missing = texts.is_null().to_numpy(zero_copy_only=False)
    kinds = np.select([missing, both == 0, deva / some >= 0.9, latin / some >= 0.9], ["mixed", "other", "devanagari", "latin"], "mixed")
    return pa.array(kinds.tolist(), pa.string())


#: White space but for single spaces, which stay as they are.
_UNEVEN = rf" {WS}+|[{WS[1:-1]}&&[^ ]]{WS}*"


def squeeze(text: Column) -> Column:
    """White-space runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, _UNEVEN, " "))


def normalize(text: Column) -> Column:
    return squeeze(nfc(text))


def _replaced(text: Column, patterns: tuple[str, ...], some: str) -> Column:
    """All patterns replaced by a space, in order; texts without `some`, which every match holds, are passed on."""
    out = text
    for pattern in patterns:
        out = F.regexp_replace(out, pattern, " ")
    return F.when(text.rlike(some), out).otherwise(text)


def strip_markup(text: Column) -> Column:
    return _replaced(text, (REFERENCE, TEMPLATE, WIKILINK, MEDIA, TAG), r"[<{\[]|(?iu)[ert\x{0930}\x{0932}]:")


def strip_pii(text: Column) -> Column:
    return _replaced(text, (URL, EMAIL, PHONE, HANDLE), r"@|://|www\.|\p{Nd}{9}")


def sentences(text: Column) -> Column:
    """Array of non-empty sentences of a text in NFC, without markup, white space squeezed."""
    return _split(strip_markup(text))


def prepared(text: Column, mode: str) -> Column:
    """What collectors do before splitting: none, pii, pii_flat (white space squeezed as well), all (markup too)."""
    if mode == "none":
        return text
    if mode == "pii":
        return strip_pii(text)
    if mode == "pii_flat":
        return squeeze(strip_pii(text))
    if mode == "all":
        return squeeze(strip_pii(strip_markup(text)))
    raise ValueError(mode)


def squeezed(text: Column) -> Column:
    """squeeze, by Arrow; not for use within a lambda."""
    return _squeezed(text)


def cleaned(text: Column) -> Column:
    """Markup and personal data stripped, white space squeezed. The caller brings NFC."""
    return squeezed(strip_pii(strip_markup(text)))


def has_script(text: Column, script: str = DEVANAGARI) -> Column:
    return text.rlike(script)


def is_boilerplate(text: Column, patterns: list[str] | None = None) -> Column:
    return text.rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else _is_boilerplate(text)


def gate_reason(text: Column, min_chars: int = MIN_CHARS, script: str = DEVANAGARI, boilerplate: list[str] | None = None) -> Column:
    """Why a cleaned sentence is refused: short, script, boilerplate; null if it passes."""
    return F.when(F.length(text) < min_chars, "short").when(~has_script(text, script), "script").when(is_boilerplate(text, boilerplate), "boilerplate")


def is_title_chrome(text: Column) -> Column:
    return _is_chrome(text)


def passes_filter(text: Column, stubs: list[str] | None = None, foreign: str = "[a-zA-Z]", most_foreign: float = 0.3) -> Column:
    """Length 15 to 400, no stub phrase, few characters of the foreign script, no orphaned punctuation at the start."""
    t = _stripped(text)
    stub = _is_stub(t) if stubs is None else t.rlike("|".join(stubs)) if stubs else F.lit(False)
    return F.length(t).between(15, 400) & ~stub & (F.regexp_count(t, F.lit(foreign)) <= F.length(t) * most_foreign) & ~t.rlike(r"^[)}\].,]")


def script_of(text: Column) -> Column:
    """devanagari, latin, mixed or other, by shares of 0.9."""
    return _script(text)


def latin_ratio(text: Column) -> Column:
    """Latin letters among all letters, 0 without a letter."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return F.when(letters == 0, 0.0).otherwise(F.regexp_count(text, F.lit(LATIN)) / letters)


def is_romanised(text: Column) -> Column:
    return (F.length(text) >= 15) & (latin_ratio(text) > 0.5)


def norm_key(text: Column) -> Column:
    """Key of near-identical sentences: white space and punctuation dropped, case kept. The caller brings NFC."""
    return _key(text)


def content_id(text: Column) -> Column:
    return F.substring(F.sha1(text), 1, 16)


def first_text(*columns: str) -> Column:
    """First non-empty of several columns, else the empty string."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns], F.lit(""))


def slug(url: Column) -> Column:
    """Last segment of a URL's path, lower case."""
    return F.lower(F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1))


def slug_allowed(url: Column, include: list[str], exclude: list[str]) -> Column:
    """Exclusion wins; without inclusion patterns all others pass; case does not count."""
    any_of = lambda patterns: slug(url).rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))
    allowed = any_of(include) if include else F.lit(True)
    return allowed & ~any_of(exclude) if exclude else allowed


def category_label(url: Column) -> Column:
    return F.when(url.contains("/category/"), F.regexp_replace(F.substring_index(url, "/category/", -1), "^/+|/+$", "")).otherwise(url)


def sitemap_locations(xml: Column) -> Column:
    """<loc> values of a sitemap, those of images left out."""
    plain = F.regexp_replace(xml, r"(?s)<image:image>.*?</image:image>|<image>.*?</image>", "")
    return F.transform(F.regexp_extract_all(plain, F.lit(r"(?s)<loc>(.*?)</loc>"), F.lit(1)), squeeze)


def rendered(template: str, sentence: Column, addendum: str | None = None) -> Column:
    one_line = F.trim(F.regexp_replace(sentence, "\n", " "))
    return F.replace(F.lit(template + (f"\n{addendum}" if addendum else "")), F.lit("{{SENTENCE}}"), one_line)


def protocol_version(markdown: Column) -> Column:
    """Greatest semantic version named in a change log, as text."""
    found = F.transform(F.regexp_extract_all(markdown, F.lit(r"(\d+\.\d+(?:\.\d+)?)"), F.lit(1)), lambda v: F.struct(F.transform(F.split(v, r"\."), lambda x: x.cast("int")).alias("k"), v.alias("v")))
    return F.array_max(found)["v"]
