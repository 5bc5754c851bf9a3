"""Personal data by bootstrapped contextual extraction, with SQL functions only.

Base spans: four kinds of identifiers by pattern and check. They and secrets (long hexadecimal strings) are the seeds. The
two words before an identifier, the two words after it, and the words on both sides are its lexical patterns; a token that
looks like an identifier (six digits or an @) and is no seed is a candidate. Patterns and instances form a graph, scored in
rounds: a pattern's confidence in a kind is the summed belief in its known instances over the number of all its instances,
an instance's belief is the chance that not all patterns it stands in are wrong. Patterns with enough distinct known
instances and a high confidence are accepted; candidates that they make certain enough become known and so induce further
patterns. Nothing known is forgotten, so the rounds end by themselves, when one accepts no new pattern. Accepted patterns
then mark their candidates as spans of their kind. Base spans always stay.

One pass over the texts extracts seeds and candidates; the graph is built from those small rows, counts are
pre-aggregated, and a very frequent pattern is a sum. A split by a pattern gives the parts between its matches, and
lengths in code points add up to positions. Possessive quantifiers and one look-behind keep matching linear in the
length of the text; they do not change what matches.

Defined cases: null text is empty and has no span; rows that share doc_id and text get the same spans; ties between
spans go by start, then kind.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of, id_and_text, quoted, row_of, scratch, stored
from .fingerprints import let

#: Base kinds, and all kinds.
BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "secret"]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![0-9A-Za-z])(?=[A-Fa-f]*+[0-9])(?=[0-9]*+[A-Fa-f])[0-9A-Fa-f]{32,}+(?![0-9A-Za-z])",
}
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"(?:[0-9][\x20-]?){14}", "phone": r"\+[0-9]", "secret": "[0-9A-Fa-f]{32}"}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Characters on each side of a span that its patterns are taken from.
CONTEXT_CHARS = 48
#: Distinct known instances that a pattern needs; confidence that it, and belief that an instance, needs.
SUPPORT, CONFIDENCE = 3, 0.8
#: Parts that rows of one text are dealt to in joins.
SALTS = 16


def _luhn(match: Column) -> Column:
    digits = F.split(F.reverse(F.regexp_replace(match, "[^0-9]", "")), "")
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    values = F.transform(F.filter(digits, lambda d: d != ""), lambda d, i: F.when(i % 2 == 1, twice(d.cast("int"))).otherwise(d.cast("int")))
    return F.aggregate(values, F.lit(0), lambda t, x: t + x) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    digits = F.length(F.regexp_replace(match, "[^0-9]", ""))
    if kind == "ip":
        return match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.when(digits.between(14, 19), _luhn(match)).otherwise(False)
    if kind == "phone":
        return digits.between(10, 15)
    return F.lit(True)


SPAN = "struct<start:int,end:int,kind:int,value:string,before:string,after:string>"


def matches(text: Column, kind: int, pattern: str, valid) -> Column:
    """All matches that pass, with start and end in code points, the matched text, and what stands beside it, as far as the next match."""
    empty = F.array().cast(f"array<{SPAN}>")

    def placed(p: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), empty.alias("spans"))

        def step(acc: Column, i: Column) -> Column:
            part, match = F.get(p["parts"], i), F.get(p["found"], i)
            start = acc["at"] + F.length(part)
            end = start + F.length(match)
            span = F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), match.alias("value"), F.right(part, F.lit(CONTEXT_CHARS)).alias("before"), F.left(F.get(p["parts"], i + 1), F.lit(CONTEXT_CHARS)).alias("after"))
            return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span.cast(SPAN))).alias("spans"))

        spans = F.aggregate(F.sequence(F.lit(0), F.size(p["found"]) - 1), zero, step)["spans"]
        return F.filter(spans, lambda s: valid(s["value"]))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(found, lambda f: F.when(F.size(f) == 0, empty).otherwise(let(F.struct(f.alias("found"), F.split(text, pattern, -1).alias("parts")), placed)))


def base_spans(text: Column) -> Column:
    """Base spans of all kinds, by start, then kind."""
    empty = F.array().cast(f"array<{SPAN}>")
    each = [F.when(text.rlike(NEEDS[k]), matches(text, i, PATTERNS[k], lambda m, k=k: _valid(k, m))).otherwise(empty) for i, k in enumerate(BASE)]
    return _in_order(F.flatten(F.array(*each)))


def _in_order(spans: Column) -> Column:
    return F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"]))


def candidates(text: Column) -> Column:
    """Tokens with an @ or at least six digits, and numbers of six digits or more in groups that blanks part.

    A number in groups takes the place of the token that it begins with; tokens further on in it stay candidates as well."""
    token = r"(?<!\S)(?:[^\s@]*+@|(?:[^\s0-9]*+[0-9]){6})\S*+"
    grouped = r"(?<!\S)[^\s@0-9\p{L}]*+[0-9](?:[().\x20/-]{0,3}+[0-9]){5,}+\S*+"
    of = lambda pattern, valid: matches(text, -1, pattern, valid)
    return F.concat(of(grouped, lambda m: m.contains(" ")), of(token, lambda m: F.lit(True)))


def _patterns(s: Column) -> Column:
    """The lexical patterns of a span, in lower case: two words before, two words after, one on each side."""
    words = lambda x: F.filter(F.split(F.lower(x), r"\s+"), lambda w: w != "")
    before, after = words(s["before"]), words(s["after"])
    last = F.array_join(F.slice(before, F.greatest(F.size(before) - 1, F.lit(1)), 2), " ")
    both = F.concat(F.element_at(F.slice(before, -1, 1), 1), F.lit(" _ "), F.get(after, 0))
    found = F.array(F.when(F.size(before) > 0, F.concat(last, F.lit(" _"))), F.when(F.size(after) > 0, F.concat(F.lit("_ "), F.array_join(F.slice(after, 1, 2), " "))), F.when((F.size(before) > 0) & (F.size(after) > 0), both))
    return F.filter(found, lambda p: p.isNotNull())


def scan(docs: DataFrame) -> DataFrame:
    """key, base spans, other seeds and candidates of every text; no text is carried on."""
    text = F.col("text")
    some = text.rlike("[@0-9]")
    empty = F.array().cast(f"array<{SPAN}>")
    secret = F.when(text.rlike(NEEDS["secret"]), matches(text, KINDS.index("secret"), PATTERNS["secret"], lambda m: F.lit(True))).otherwise(empty)
    found = docs.select("doc_id", F.md5("text").alias("key"), F.when(some, base_spans(text)).otherwise(empty).alias("base"), F.when(some, secret).otherwise(empty).alias("other"), F.when(some, candidates(text)).otherwise(empty).alias("tokens"))
    apart = lambda t, b: (t["end"] <= b["start"]) | (t["start"] >= b["end"])
    found = found.withColumn("other", F.filter("other", lambda t: F.forall("base", lambda b: apart(t, b))))
    found = found.withColumn("tokens", F.filter("tokens", lambda t: F.forall("base", lambda b: apart(t, b)) & F.forall("other", lambda b: apart(t, b))))
    return found.withColumn("tokens", F.filter("tokens", lambda t: ~F.exists("tokens", lambda o: (o["start"] == t["start"]) & (o["end"] > t["end"]))))


def learned_patterns(scanned: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """pattern, kind, confidence: accepted patterns."""

    def exploded(name: str) -> DataFrame:
        spans = scanned.where(F.size(name) > 0).select(F.explode(name).alias("s"))
        return spans.select(F.explode(_patterns(F.col("s"))).alias("pattern"), "s.kind", F.lower("s.value").alias("instance"))

    edges = stored(exploded("base").union(exploded("other")).union(exploded("tokens")).distinct(), "edges")  # kind -1: a candidate
    total = edges.groupBy("pattern").agg(F.count_distinct("instance").alias("n"))
    seeds = edges.where("kind >= 0").select("instance", "kind").distinct().withColumn("belief", F.lit(1.0))
    # a pattern whose instances are too few can never be accepted, and no other candidates can become known
    total = stored(total.where(F.col("n") >= support), "total")
    links = stored(edges.select("pattern", "instance").distinct().join(total.select("pattern"), "pattern"), "links")
    unknown = stored(edges.where("kind = -1").select("pattern", "instance").distinct().join(total.select("pattern"), "pattern"), "unknown")
    known, accepted, last = stored(seeds, "known"), None, -1
    while True:
        scored = links.join(known, "instance").groupBy("pattern", "kind").agg(F.count("*").alias("k"), F.sum("belief").alias("mass")).where(F.col("k") >= support)
        scored = scored.join(total, "pattern").select("pattern", "kind", F.least(F.col("mass") / F.col("n"), F.lit(1.0)).alias("confidence"))
        accepted = stored(scored.where(F.col("confidence") >= confidence), "accepted")
        now = accepted.count()
        if now == last:
            return accepted
        last = now
        belief = unknown.join(accepted, "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))).alias("belief"))
        known = stored(seeds.union(belief.where(F.col("belief") >= confidence).join(seeds, ["instance", "kind"], "left_anti").select("instance", "kind", "belief")), "known")


def joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _dealt(rows: DataFrame, by: Column) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))


def _for_each_salt(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def find(df: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key (md5 of the text), base, spans: arrays of start, end, kind; one row per document."""
    narrow = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    scanned = stored(scan(id_and_text(df, id_col, text_col)), "scanned", keep=True)
    with scratch(df.sparkSession):
        patterns = learned_patterns(scanned, support, confidence)
        tokens = scanned.where(F.size("tokens") > 0).select("key", F.explode("tokens").alias("t")).select("key", "t.start", "t.end", F.explode(_patterns(F.col("t"))).alias("pattern")).distinct()
        best = F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind")
        marked = tokens.join(patterns, "pattern").groupBy("key", "start", "end").agg(best)
        new = stored(marked.groupBy("key").agg(F.collect_list(F.struct("start", "end", "kind")).alias("new")), "learned", keep=True)
    own = scanned.select("doc_id", "key", narrow(F.col("base")).alias("base"), narrow(F.col("other")).alias("other"), (F.size("tokens") > 0).alias("asks"))
    asking = _dealt(own.where("asks"), F.col("doc_id")).join(_for_each_salt(new), ["key", "salt"], "left").drop("salt")
    both = own.where("not asks").withColumn("new", F.lit(None).cast(new.schema["new"].dataType)).unionByName(asking)
    added = F.concat(F.col("other"), F.coalesce("new", F.array().cast(new.schema["new"].dataType)))
    return both.select("doc_id", "key", "base", F.when(F.size(added) == 0, F.col("base")).otherwise(_in_order(F.concat("base", added))).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts of base spans by kind, their hash, all spans, and how many these are."""
    of_kind = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    count = [of_kind(i).alias(f"n_{k}") for i, k in enumerate(BASE)]
    return found.select("doc_id", *count, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span, overlapping ones together, replaced by its kind in angle brackets."""
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        put = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.get(names, s["kind"]))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], put).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(spans, zero, step)
    return let(done, lambda d: F.concat(d["out"], F.substring(text, d["at"] + 1, F.length(text))))


def may_hold(text: Column) -> Column:
    """Whether a text may hold a span: what it must have for any kind, or the beginning of a candidate."""
    needs = [text.rlike(n) for n in NEEDS.values()]
    return text.rlike("[@0-9]") & (reduce(Column.__or__, needs) | text.rlike(r"@|[0-9](?:[().\x20/-]{0,3}+[0-9]){5}|(?<!\S)(?:[^\s0-9]*+[0-9]){6}"))


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """df with its texts redacted; other columns as they are, whatever their names. A null text stays null.

    Texts that cannot hold a span, as nearly all, stay where they are; only the others meet the spans that were found."""
    with scratch(df.sparkSession):
        found = find(df, id_col=id_col, text_col=text_col, **options).where(F.size("spans") > 0).groupBy("key").agg(F.first("spans").alias("spans"))
        found = stored(found, "found", keep=True)
    whole = df.select(row_of(df), F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias("text"), F.col(quoted(id_col)).alias("id"))
    asks = F.coalesce(may_hold(F.col("text")), F.lit(False))
    keyed = whole.where(asks).select("row", "text", F.md5("text").alias("key"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    done = keyed.join(_for_each_salt(found), ["key", "salt"], "left")
    new = F.when(F.col("spans").isNotNull(), redacted(F.col("text"), F.col("spans"))).otherwise(F.col("row").getField(text_col))
    return done.select(*columns_of(df, {text_col: new})).unionByName(whole.where(~asks).select(*columns_of(df, {})))
