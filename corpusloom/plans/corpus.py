"""Queries of cleaning, deduplication and enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import judge_json as J
from ..functions import text as T
from ..operators import dedup, enrich, merge
from ..sources import html
from .tables import CORPUS_SQL, corpus, table

#: The gate that the test documents pass: they hold no Devanagari.
GATE = "[A-Za-z]"
#: Benchmark shingles that every task may hold.
MOST_BROADCAST = 500_000
REGISTERS = {"src0": "news", "src1": "news", "src2": "encyclopedic", "src3": "verse", "src4": "literary", "src5": "opinion"}


def content_hash_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.content_id(F.col("text")).alias("content_id"))


def sentence_split_counts(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select("doc_id", T.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.aggregate("s", F.lit(0).cast("long"), lambda t, x: t + F.length(x)).alias("n_chars"))


def sentence_rows(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("n", "sentence"))
    return s.select("doc_id", F.col("n").cast("long").alias("n"), F.md5("sentence").alias("sentence_md5"))


def strip_markup_pages(spark, sf_dir):
    clean = T.squeeze(T.strip_markup(F.col("html")))
    return table(spark, sf_dir, "pages").select("page_id", F.length(clean).cast("long").alias("n_chars"), F.md5(clean).alias("md5"))


def strip_pii_docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.strip_pii(F.col("text"))).alias("md5"))


def strip_handles(spark, sf_dir):
    """Handles of texts in which every fifth document is addressed to one."""
    text = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("@ab1 @@cd x@ef "), "text")).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_count(text, F.lit(T.HANDLE)).cast("long").alias("n_handles"), F.md5(T.strip_pii(text)).alias("md5"))


#: Latin letters to Devanagari ones: the test documents hold no Devanagari.
LETTERS = ("abcdeghiklmnoprstuv", "अबचदएगहइकलमनओपरसतउव")
_LINES = [T.STUBS[0] + " में साल के", "इहो देखल जाय", "बाहरी कड़ी", "मुख्य पन्ना", "(मुख्य"]


def _devanagari(spark, sf_dir):
    """Sentences of the documents in Devanagari letters, before them a line that some gate refuses."""
    line = F.element_at(F.array(*[F.lit(x) for x in _LINES]), (F.col("doc_id") % len(_LINES) + 1).cast("int"))
    text = F.concat(line, F.lit("\n"), F.translate("text", *LETTERS))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text")).select("doc_id", F.explode(T.sentences(F.col("text"))).alias("s"))


def devanagari_gates(spark, sf_dir):
    """The gates as they are for Devanagari, by their outcome."""
    s = F.col("s")
    state = F.coalesce(T.gate_reason(s), F.when(T.is_title_chrome(s), "title_chrome").otherwise("passed"))
    rows = _devanagari(spark, sf_dir).select(state.alias("state"), T.script_of(s).alias("script"), T.passes_filter(s).alias("fine"), F.length(T.norm_key(s)).alias("n_key"))
    return rows.groupBy("state", "script").agg(F.count("*").alias("n"), F.count_if("fine").alias("fine"), F.sum("n_key").alias("key_chars"))


def collected_texts(spark, sf_dir):
    """What collectors make of pages before splitting, in each of the four ways."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", *[F.md5(T.prepared(F.col("html"), m)).alias(m) for m in ("none", "pii", "pii_flat", "all")])


def clean_gate_reasons(spark, sf_dir):
    reason = T.gate_reason(T.squeeze(F.col("text")), 60, GATE)
    return table(spark, sf_dir, "documents").groupBy(F.coalesce(reason, F.lit("passed")).alias("reason")).agg(F.count("*").alias("n"))


def corpus_filter_rules(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.sentences(F.col("text"))).alias("s"))
    return s.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(T.passes_filter(F.col("s"), [], "[éèñüöäßçêíóá]", 0.1)).alias("kept"))


def script_profile(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy(T.script_of(F.col("text")).alias("script"), "lang").agg(F.count("*").alias("n"), F.round(F.avg(F.regexp_count("text", F.lit("[A-Za-z]"))), 6).alias("mean_latin"))


def text_coalesce_enrich(spark, sf_dir):
    c = corpus(spark, sf_dir).select("id", F.when(F.col("id") % 7 == 0, "").when(F.col("id") % 11 == 0, F.lit(None)).otherwise(F.col("cleaned_text")).alias("cleaned_text"), "raw_text", "source_name", F.concat(F.lit("http://x/"), F.when(F.col("id") % 3 == 0, "kavita-1/").otherwise("page")).alias("source_url"), F.when(F.col("id") % 2 == 0, "sitemap").alias("category"))
    out = enrich.enrich(c.withColumn("n", F.length(T.first_text("cleaned_text", "raw_text"))), REGISTERS, {"src2": enrich.LICENSE["bhojpuri_wikipedia"]}, ["src3"], genre_source="src6")
    return out.groupBy("register", "license_class", "text_type", F.coalesce("category", F.lit("-")).alias("category")).agg(F.count("*").alias("n"), F.sum("n").alias("n_chars"))


def _dedup(spark, sf_dir):
    rows = corpus(spark, sf_dir).select(T.content_id(F.col("cleaned_text")).alias("id"), "cleaned_text", "raw_text", F.col("id").alias("n"))
    return dedup.corpus_dedup(rows, ["n"], 15, GATE)


def norm_key_dedup_kept(spark, sf_dir):
    return _dedup(spark, sf_dir).where("reject_reason is null").select(F.col("n").alias("doc_id"), F.md5("norm_key").alias("key_md5"))


def norm_key_reject_reasons(spark, sf_dir):
    return _dedup(spark, sf_dir).where("reject_reason is not null").select(F.col("n").alias("doc_id"), "reject_reason")


def strict_order_dedup(spark, sf_dir):
    """The greedy rule with foreign ids: five rows in a row share one."""
    rows = corpus(spark, sf_dir).select(F.floor(F.col("id") / 5).cast("string").alias("id"), "cleaned_text", "raw_text", F.col("id").alias("n"))
    return dedup.strict_order_dedup(rows, ["n"], 15, GATE).select(F.col("n").alias("doc_id"), F.coalesce("reject_reason", F.lit("kept")).alias("state"))


def append_dedup_antijoin(spark, sf_dir):
    c = corpus(spark, sf_dir).select(T.content_id(F.col("cleaned_text")).alias("id"), F.col("id").alias("n"))
    return dedup.not_yet_there(c.where("n % 3 <> 0").select("id"), c.where("n % 3 = 0").select("id"))


def benchmark_containment(spark, sf_dir):
    """Benchmark passages that a document holds, by equality of 8-word shingles; counts of shared ones."""
    def shingled(df, key, text):  # repeated ones included
        w = F.split(F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " ")), " ")
        own = df.select(key, w.alias("w")).where(F.size("w") >= 8)
        return own.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 7), lambda i: F.array_join(F.slice("w", i, 8), " "))).alias("g"))
    b = shingled(table(spark, sf_dir, "benchmark"), "item_id", F.col("text")).distinct()
    d = shingled(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))
    small = b.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST  # beyond it both sides are shuffled
    met = d.join(F.broadcast(b) if small else b, "g").distinct()
    return met.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"))


def source_verdict_crosstab(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("source_name"), enrich.lid_verdict(F.col("lang"), {"en": "bhojpuri", "de": "hindi", "fr": "maithili"}).alias("lid_verdict"))
    return enrich.verdict_crosstab(rows)


def clean_rates(spark, sf_dir):
    """Sentences of whole texts that the filter keeps and drops, by source."""
    d = table(spark, sf_dir, "documents").select("source", F.explode(T.sentences(F.col("text"))).alias("s"))
    keep = T.passes_filter(F.col("s"), [], "[éèñüöäßçêíóá]", 0.05)
    return d.groupBy("source").agg(F.count("*").alias("gross"), F.count_if(keep).alias("kept"), F.round(100 * F.count_if(~keep) / F.count("*"), 6).alias("drop_pct"))


def lid_two_judge_combine(spark, sf_dir):
    d = F.col("doc_id")
    name = lambda x: F.when(x % 5 < 2, "bhojpuri").when(x % 5 < 4, "hindi").otherwise("other")
    reason = F.when(d % 4 == 0, "error: x").when(d % 4 == 1, "unparseable").otherwise("fine")
    rows = table(spark, sf_dir, "documents").select("doc_id", name(d).alias("g_label"), ((d * 7 % 100) / 100.0).alias("g_confidence"), reason.alias("g_reason"), name(F.floor(d / 3)).alias("m_label"), ((d * 11 % 100) / 100.0).alias("m_confidence"), F.lit("fine").alias("m_reason"))
    return enrich.combine_lid(rows).groupBy("lid_label", F.coalesce("lid_note", F.lit("-")).alias("lid_note")).agg(F.count("*").alias("n"), F.round(F.sum(F.round(F.col("lid_confidence") * 1000)), 0).cast("long").alias("sum_milli"))


def lid_agreement_rates(spark, sf_dir):
    d = F.col("doc_id")
    name = lambda x: F.when(x % 5 < 2, "bhojpuri").when(x % 5 < 4, "hindi").otherwise("other")
    rows = table(spark, sf_dir, "documents").select(name(d).alias("g_label"), F.when(d % 4 == 0, 0.0).otherwise(0.9).alias("g_confidence"), F.when(d % 4 == 0, "error: x").otherwise("fine").alias("g_reason"), name(F.floor(d / 3)).alias("m_label"), F.lit(0.8).alias("m_confidence"), F.lit("fine").alias("m_reason"))
    return enrich.agreement_rates(rows, "bhojpuri").select("n", "n_fine", F.round("rate", 6).alias("rate"), F.round("rate_fine", 6).alias("rate_fine"))


def leaf_category_prefix_anti(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.concat_ws("/", F.concat(F.lit("c"), F.col("page_id") % 7), F.when(F.col("page_id") % 3 > 0, F.concat(F.lit("s"), F.col("page_id") % 5)), F.when(F.col("page_id") % 3 > 1, F.concat(F.lit("t"), F.col("page_id") % 11))).alias("label")).distinct()
    return enrich.leaves_only(p, excluded=["s4"])


def page_extraction(spark, sf_dir):
    out = html.extracted(table(spark, sf_dir, "pages"), selector="article")
    return out.select("page_id", F.length("page_text").cast("long").alias("n_chars"), F.size("links").cast("long").alias("n_links"))


def page_links_by_regex(spark, sf_dir):
    links = F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))
    return table(spark, sf_dir, "pages").select("page_id", F.size(links).cast("long").alias("n_links"), F.md5(F.array_join(links, "|")).alias("links_md5"))


def url_slugs(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", T.slug(F.col("url")).alias("slug"), T.category_label(F.col("url")).alias("label"), T.slug_allowed(F.col("url"), [], ["1$"]).alias("allowed"))


def parse_judge_json(spark, sf_dir):
    """events.props as judge replies: wrapped in prose and fences, cut off, or well formed."""
    body = F.to_json(F.struct(F.when(F.col("event_id") % 2 == 0, "objective").otherwise("subjective").alias("subjectivity"), F.when(F.col("event_id") % 2 == 1, F.when(F.col("event_id") % 3 == 0, "positive").otherwise("mixed")).alias("polarity"), ((F.col("event_id") % 101) / 100.0).alias("confidence"), F.col("event_type").alias("domain"), F.lit("third_person").alias("narrative_voice"), F.lit(None).cast("string").alias("sentiment_target"), F.col("props").alias("rationale")), {"ignoreNullFields": "false"})
    raw = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("Sure: "), body, F.lit(" | done {}"))).when(F.col("event_id") % 5 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("event_id") % 5 == 2, F.expr("left(b, length(b) - 3)")).otherwise(body)
    rows = table(spark, sf_dir, "events").withColumn("b", body).select("event_id", raw.alias("raw"))
    p = rows.select("event_id", J.parse_reply(F.col("raw")).alias("p"))
    return p.select("event_id", F.col("p").isNotNull().alias("ok"), "p.subjectivity", "p.polarity", F.round("p.confidence", 6).alias("confidence"), "p.domain")


def rescue_parse(spark, sf_dir):
    good = F.lit('x {"subjectivity": "objective", "polarity": null, "confidence": 1, "domain": "d", "narrative_voice": "mixed", "sentiment_target": null, "rationale": "r"} y')
    none = F.lit(None).cast("string")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), *[none.cast("double").alias(f) if f == "confidence" else none.alias(f) for f in merge.FIELDS], (F.col("event_id") % 4 == 0).alias("parse_failed"), F.when(F.col("event_id") % 8 == 0, good).otherwise("no object").alias("raw_response"))
    return merge.rescue_counts(merge.rescue(rows, J.parse_reply(F.col("raw_response")))).select("recovered", "still_failed", F.round("rate", 6).alias("rate"))


TEMPLATE = "Judge this sentence:\n{{SENTENCE}}\nReply in JSON."


def prompt_rendering(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(T.rendered(TEMPLATE, F.col("text"))).alias("prompt_md5"))


def lid_reply_parse(spark, sf_dir):
    """Replies of a language judge: wrapped objects, unknown labels, confidences out of range, long reasons."""
    e = F.col("event_id")
    label = F.when(e % 3 == 0, " Hindi ").when(e % 3 == 1, "bhojpuri").otherwise("klingon")
    raw = F.concat(F.lit('so: {"label": "'), label, F.lit('", "confidence": '), ((e % 30) / 20.0).cast("string"), F.lit(', "reason": "'), F.repeat(F.lit("ab "), (e % 40).cast("int")), F.lit('"} ok'))
    parsed = table(spark, sf_dir, "events").select("event_id", J.parse_lid_reply(raw, ["bhojpuri", "hindi", "maithili"]).alias("p"))
    return parsed.select("event_id", "p.label", F.round("p.confidence", 6).alias("confidence"), F.length("p.reason").cast("long").alias("n_reason"))


def romanised_share(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(T.is_romanised(F.col("text"))).alias("romanised"), F.round(F.avg(F.regexp_count("text", F.lit(T.LATIN)) / F.length("text")), 6).alias("mean_latin"))


def conversation_ends(spark, sf_dir):
    """First and last turn of each conversation by pre-aggregated extremes."""
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.count("*").alias("n"), F.min_by("role", "turn").alias("first_role"), F.md5(F.max_by("text", "turn")).alias("last_md5"))


def flagship(spark, sf_dir):
    """documents to sentences, cleaned, deduplicated, enriched, counted by register, script and text type."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(T.sentences(F.col("text"))).alias("n", "cleaned_text"))
    rows = d.select(T.content_id(F.col("cleaned_text")).alias("id"), "cleaned_text", F.col("cleaned_text").alias("raw_text"), F.col("source").alias("source_name"), "doc_id", "n", F.lit("").alias("source_url"), F.lit(None).cast("string").alias("category"))
    kept = dedup.corpus_dedup(rows, ["doc_id", "n"], 15, GATE).where("reject_reason is null").drop("cleaned_text").withColumnRenamed("clean_text", "cleaned_text")
    out = enrich.enrich(kept, REGISTERS, {}, ["src3"])
    return out.groupBy("register", "script", "text_type").agg(F.count("*").alias("n"), F.sum(F.length("cleaned_text")).alias("n_chars"))


_SENT = r"list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)<ref[^>]*>.*?</ref>|<ref[^>]*/?>', ' ', 'g'), '\{\{[^}]*\}\}', ' ', 'g'), '\[\[[^\]]*\]\]', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[।॥?!]+|\.\s|\n+'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '')"
_CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(cleaned_text, 'https?://\S+|www\.\S+', ' ', 'g'), '[A-Za-z0-9_À-ÿ.+-]+@[A-Za-z0-9_À-ÿ-]+\.[A-Za-z0-9_À-ÿ.-]*[A-Za-z0-9_À-ÿ]', ' ', 'g'), '(?:(?:\+?91(?:-|\s)?)|0)?[6-9][0-9]{9}\b', ' ', 'g'), '\s+', ' ', 'g'))"
_DEDUP = rf"""WITH {CORPUS_SQL},
c AS (SELECT id AS n, substr(sha1(cleaned_text), 1, 16) AS id, nfc_normalize({_CLEAN}) AS t FROM corpus),
p AS (SELECT *, CASE WHEN length(t) < 15 OR NOT regexp_matches(t, '[A-Za-z]') OR regexp_matches(t, 'thumb|right|left|px\b|Download OBO|Query/Feedback|OBO|^[0-9]-') THEN 'filtered_junk_or_short'
  WHEN regexp_matches(t, 'Bhojpuria Lokraag|Launda Naach|blog-post|Read more|Older Posts|Newer Posts') THEN 'title_chrome' END AS refused,
  regexp_replace(t, '[\s।॥.,!?–—:;"''()-]+', '', 'g') AS k FROM c),
r AS (SELECT *, row_number() OVER w AS rn, first_value(id) OVER w AS first_id FROM p WHERE refused IS NULL WINDOW w AS (PARTITION BY k ORDER BY n))"""
_FLAG = rf"""WITH x AS (SELECT doc_id, source, i, s[i] AS cleaned_text FROM (SELECT doc_id, source, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, source, {_SENT} AS s FROM documents))),
c AS (SELECT doc_id, i, source, {_CLEAN} AS t FROM x), p AS (SELECT *, regexp_replace(t, '[\s।॥.,!?–—:;"''()-]+', '', 'g') AS k FROM c WHERE length(t) >= 15 AND regexp_matches(t, '[A-Za-z]')
 AND NOT regexp_matches(t, 'thumb|right|left|px\b|Download OBO|Query/Feedback|OBO|^[0-9]-') AND NOT regexp_matches(t, 'Bhojpuria Lokraag|Launda Naach|blog-post|Read more|Older Posts|Newer Posts')),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS rn FROM p)
SELECT CASE source WHEN 'src0' THEN 'news' WHEN 'src1' THEN 'news' WHEN 'src2' THEN 'encyclopedic' WHEN 'src3' THEN 'verse' WHEN 'src4' THEN 'literary' WHEN 'src5' THEN 'opinion' ELSE 'unknown' END AS register, 'latin' AS script,
CASE source WHEN 'src3' THEN 'verse' ELSE 'prose' END AS text_type, count(*)::BIGINT AS n, sum(length(t))::BIGINT AS n_chars FROM r WHERE rn = 1 GROUP BY ALL"""
_PII = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, 'https?://\S+|www\.\S+', ' ', 'g'), '[A-Za-z0-9_À-ÿ][A-Za-z0-9_À-ÿ.+-]*@[A-Za-z0-9_À-ÿ-]+\.[A-Za-z0-9_À-ÿ.-]*[A-Za-z0-9_À-ÿ]', ' ', 'g'), '(?:(?:\+?91(?:-|\s)?)|0)?[6-9][0-9]{{9}}\b', ' ', 'g'), '(^|[^\pL\pN_])@[\pL\pN_]{{2,}}', '\1 ', 'g')"""
_FLAT = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_MARKUP = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '(?s)<ref[^>]*>.*?</ref>|<ref[^>]*/?>', ' ', 'g'), '\{{\{{[^}}]*\}}\}}', ' ', 'g'), '\[\[[^\]]*\]\]', ' ', 'g'), '<[^>]+>', ' ', 'g')"""
_re2 = lambda pattern: pattern.replace(T.WS, r"\s").replace(T.EDGE, r"\b")
_DEVA = rf"""WITH x AS (SELECT unnest({_SENT}) AS s FROM (SELECT [{", ".join(f"'{x}'" for x in _LINES)}][doc_id % {len(_LINES)} + 1] || chr(10) || translate(text, '{LETTERS[0]}', '{LETTERS[1]}') AS text FROM documents)),
y AS (SELECT s, len(regexp_extract_all(s, '[\x{{0900}}-\x{{097F}}]')) AS d, len(regexp_extract_all(s, '[A-Za-z]')) AS l, CASE WHEN length(s) < 15 THEN 'short' WHEN NOT regexp_matches(s, '[\x{{0900}}-\x{{097F}}]') THEN 'script' WHEN regexp_matches(s, '{"|".join(f"(?:{_re2(p)})" for p in T.BOILERPLATE)}') THEN 'boilerplate' WHEN regexp_matches(s, '{_re2(T.TITLE_CHROME)}') THEN 'title_chrome' ELSE 'passed' END AS state FROM x)
SELECT state, CASE WHEN d + l = 0 THEN 'other' WHEN d / (d + l) >= 0.9 THEN 'devanagari' WHEN l / (d + l) >= 0.9 THEN 'latin' ELSE 'mixed' END AS script, count(*)::BIGINT AS n,
count(*) FILTER (length(s) BETWEEN 15 AND 400 AND NOT regexp_matches(s, '{"|".join(T.STUBS)}') AND l <= length(s) * 0.3 AND NOT regexp_matches(s, '^[)}}\].,]'))::BIGINT AS fine,
sum(length(regexp_replace(s, '[\s।॥.,!?–—:;"''()-]+', '', 'g')))::BIGINT AS key_chars FROM y GROUP BY ALL"""
#: The greedy rule row by row, with the ids and keys of the rows kept so far.
_STRICT = f"""{_DEDUP.replace("WITH ", "WITH RECURSIVE ", 1)}, o AS MATERIALIZED (SELECT row_number() OVER (ORDER BY n) AS i, n, n // 5 AS own, hash(k) AS h FROM p WHERE refused IS NULL),
g AS (SELECT 0::BIGINT AS i, 0::BIGINT AS n, '' AS state, []::BIGINT[] AS ids, []::UBIGINT[] AS keys
 UNION ALL SELECT i, n, state, CASE state WHEN 'kept' THEN list_append(ids, own) ELSE ids END, CASE state WHEN 'kept' THEN list_append(keys, h) ELSE keys END
 FROM (SELECT o.i, o.n, o.own, o.h, g.ids, g.keys, CASE WHEN list_contains(g.ids, o.own) THEN 'exact_dupe' WHEN list_contains(g.keys, o.h) THEN 'near_dupe' ELSE 'kept' END AS state FROM g JOIN o ON o.i = g.i + 1))
SELECT n AS doc_id, state FROM g WHERE i > 0 UNION ALL SELECT n, refused FROM p WHERE refused IS NOT NULL"""
_CAT = """WITH c AS (SELECT DISTINCT concat_ws('/', 'c' || page_id % 7, CASE WHEN page_id % 3 > 0 THEN 's' || page_id % 5 END, CASE WHEN page_id % 3 > 1 THEN 't' || page_id % 11 END) AS label FROM pages)"""

ORACLE = {
    "content_hash_ids": "SELECT doc_id, substr(sha1(text), 1, 16) AS content_id FROM documents",
    "sentence_split_counts": f"SELECT doc_id, len(s)::BIGINT AS n_sentences, coalesce(list_sum(list_transform(s, lambda x: length(x))), 0)::BIGINT AS n_chars FROM (SELECT doc_id, {_SENT} AS s FROM documents)",
    "sentence_rows": f"SELECT doc_id, (i - 1)::BIGINT AS n, md5(s[i]) AS sentence_md5 FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, {_SENT} AS s FROM documents))",
    "strip_markup_pages": r"""SELECT page_id, length(t)::BIGINT AS n_chars, md5(t) AS md5 FROM (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<ref[^>]*>.*?</ref>|<ref[^>]*/?>', ' ', 'g'), '\{\{[^}]*\}\}', ' ', 'g'), '\[\[[^\]]*\]\]', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM pages)""",
    "strip_pii_docs": f"SELECT doc_id, md5({_PII.format('text')}) AS md5 FROM documents",
    "strip_handles": f"SELECT doc_id, len(regexp_extract_all(t, '(?:^|[^\\pL\\pN_])@[\\pL\\pN_]{{2,}}'))::BIGINT AS n_handles, md5({_PII.format('t')}) AS md5 FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '@ab1 @@cd x@ef ' || text ELSE text END AS t FROM documents)",
    "devanagari_gates": _DEVA,
    "collected_texts": f"SELECT page_id, md5(html) AS none, md5({_PII.format('html')}) AS pii, md5({_FLAT.format(_PII.format('html'))}) AS pii_flat, md5({_FLAT.format(_PII.format(_MARKUP.format('html')))}) AS all FROM pages".replace("AS all", 'AS "all"'),
    "strict_order_dedup": _STRICT,
    "clean_gate_reasons": r"""SELECT reason, count(*)::BIGINT AS n FROM (SELECT CASE WHEN length(t) < 60 THEN 'short' WHEN NOT regexp_matches(t, '[A-Za-z]') THEN 'script' WHEN regexp_matches(t, 'thumb|right|left|px\b|Download OBO|Query/Feedback|OBO|^[0-9]-') THEN 'boilerplate' ELSE 'passed' END AS reason FROM (SELECT trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)) GROUP BY reason""",
    "corpus_filter_rules": rf"""SELECT doc_id, count(*)::BIGINT AS n, count(*) FILTER (length(x) BETWEEN 15 AND 400 AND len(regexp_extract_all(x, '[éèñüöäßçêíóá]')) <= length(x) * 0.1 AND NOT regexp_matches(x, '^[)}}\].,]'))::BIGINT AS kept FROM (SELECT doc_id, unnest({_SENT}) AS x FROM documents) GROUP BY doc_id""",
    "script_profile": r"""SELECT script, lang, count(*)::BIGINT AS n, round(avg(l), 6) AS mean_latin FROM (SELECT lang, len(regexp_extract_all(text, '[A-Za-z]')) AS l, CASE WHEN len(regexp_extract_all(text, '[\x{0900}-\x{097F}]')) + len(regexp_extract_all(text, '[A-Za-z]')) = 0 THEN 'other' WHEN len(regexp_extract_all(text, '[\x{0900}-\x{097F}]')) > 0 THEN 'mixed' ELSE 'latin' END AS script FROM documents) GROUP BY script, lang""",
    "text_coalesce_enrich": rf"""WITH {CORPUS_SQL}, c AS (SELECT id, CASE WHEN id % 7 = 0 THEN '' WHEN id % 11 = 0 THEN NULL ELSE cleaned_text END AS cleaned_text, raw_text, source_name, id % 3 = 0 AS kavita, CASE WHEN id % 2 = 0 THEN 'sitemap' END AS category FROM corpus),
e AS (SELECT *, CASE WHEN source_name = 'src6' AND (category IS NULL OR category = 'sitemap') AND kavita THEN 'कविता' ELSE category END AS cat, length(coalesce(nullif(cleaned_text, ''), nullif(raw_text, ''), '')) AS n_c FROM c)
SELECT CASE source_name WHEN 'src0' THEN 'news' WHEN 'src1' THEN 'news' WHEN 'src2' THEN 'encyclopedic' WHEN 'src3' THEN 'verse' WHEN 'src4' THEN 'literary' WHEN 'src5' THEN 'opinion' ELSE 'unknown' END AS register,
CASE source_name WHEN 'src2' THEN 'redistributable_cc_by_sa' ELSE 'pointer_only' END AS license_class, CASE WHEN cat = 'कविता' OR source_name = 'src3' THEN 'verse' ELSE 'prose' END AS text_type, coalesce(cat, '-') AS category, count(*)::BIGINT AS n, sum(n_c)::BIGINT AS n_chars FROM e GROUP BY ALL""",
    "norm_key_dedup_kept": f"{_DEDUP} SELECT n AS doc_id, md5(k) AS key_md5 FROM r WHERE rn = 1",
    "norm_key_reject_reasons": f"{_DEDUP} SELECT n AS doc_id, CASE WHEN id = first_id THEN 'exact_dupe' ELSE 'near_dupe' END AS reject_reason FROM r WHERE rn > 1 UNION ALL SELECT n, refused FROM p WHERE refused IS NOT NULL",
    "append_dedup_antijoin": f"WITH {CORPUS_SQL}, c AS (SELECT id AS n, substr(sha1(cleaned_text), 1, 16) AS id FROM corpus) SELECT DISTINCT id FROM c WHERE n % 3 <> 0 AND id NOT IN (SELECT id FROM c WHERE n % 3 = 0)",
    "benchmark_containment": r"""WITH w AS (SELECT 'd' AS t, doc_id AS k, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM documents UNION ALL SELECT 'b', item_id, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') FROM benchmark),
g AS (SELECT DISTINCT t, k, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT t, k, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8))
SELECT d.k AS doc_id, b.k AS item_id, count(*)::BIGINT AS n_shared FROM g d JOIN g b ON d.g = b.g AND d.t = 'd' AND b.t = 'b' GROUP BY ALL""",
    "source_verdict_crosstab": "SELECT source AS source_name, v AS lid_verdict, count(*)::BIGINT AS n, round(100 * count(*) / sum(count(*)) OVER (PARTITION BY source), 6) AS pct FROM (SELECT source, CASE lang WHEN 'en' THEN 'bhojpuri' WHEN 'de' THEN 'hindi' WHEN 'fr' THEN 'maithili' ELSE 'other' END AS v FROM documents) GROUP BY source, v",
    "clean_rates": rf"""SELECT source, count(*)::BIGINT AS gross, count(*) FILTER (k)::BIGINT AS kept, round(100 * count(*) FILTER (NOT k) / count(*), 6) AS drop_pct FROM (SELECT source, length(x) BETWEEN 15 AND 400 AND len(regexp_extract_all(x, '[éèñüöäßçêíóá]')) <= length(x) * 0.05 AND NOT regexp_matches(x, '^[)}}\].,]') AS k FROM (SELECT source, unnest({_SENT}) AS x FROM documents)) GROUP BY source""",
    "lid_two_judge_combine": """WITH r AS (SELECT CASE WHEN doc_id % 5 < 2 THEN 'bhojpuri' WHEN doc_id % 5 < 4 THEN 'hindi' ELSE 'other' END AS g, CASE WHEN (doc_id // 3) % 5 < 2 THEN 'bhojpuri' WHEN (doc_id // 3) % 5 < 4 THEN 'hindi' ELSE 'other' END AS m, (doc_id * 7 % 100) / 100.0::DOUBLE AS gc, (doc_id * 11 % 100) / 100.0::DOUBLE AS mc, CASE doc_id % 4 WHEN 0 THEN 'api_error' WHEN 1 THEN 'unparseable' ELSE 'both_judges_other' END AS note FROM documents)
SELECT CASE WHEN g = m THEN g ELSE 'disagree' END AS lid_label, CASE WHEN g <> m THEN g || '_vs_' || m WHEN g = 'other' THEN note ELSE '-' END AS lid_note, count(*)::BIGINT AS n, sum(round(1000 * CASE WHEN g = m THEN (gc + mc) / 2 ELSE least(gc, mc) END))::BIGINT AS sum_milli FROM r GROUP BY ALL""",
    "lid_agreement_rates": "SELECT count(*)::BIGINT AS n, count(*) FILTER (f)::BIGINT AS n_fine, round(avg((b)::INT), 6) AS rate, round(avg(b::INT) FILTER (f), 6) AS rate_fine FROM (SELECT doc_id % 4 <> 0 AS f, doc_id % 5 < 2 AND (doc_id // 3) % 5 < 2 AS b FROM documents)",
    "leaf_category_prefix_anti": f"{_CAT} SELECT label FROM c WHERE label NOT LIKE '%s4%' AND label <> 'uncategorized' AND NOT EXISTS (SELECT 1 FROM c o WHERE o.label <> c.label AND starts_with(o.label, c.label || '/'))",
    "page_links_by_regex": """SELECT page_id, len(l)::BIGINT AS n_links, md5(array_to_string(l, '|')) AS links_md5 FROM (SELECT page_id, list_filter(a, lambda x, i: list_position(a, x) = i) AS l FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS a FROM pages))""",
    "url_slugs": r"""SELECT page_id, lower(string_split(regexp_replace(url, '/+$', ''), '/')[-1]) AS slug, CASE WHEN contains(url, '/category/') THEN regexp_replace(string_split(url, '/category/')[-1], '^/+|/+$', '', 'g') ELSE url END AS label, NOT regexp_matches(lower(string_split(regexp_replace(url, '/+$', ''), '/')[-1]), '1$') AS allowed FROM pages""",
    "rescue_parse": "SELECT count(*) FILTER (event_id % 8 = 0)::BIGINT AS recovered, count(*) FILTER (event_id % 4 = 0 AND event_id % 8 <> 0)::BIGINT AS still_failed, round(count(*) FILTER (event_id % 8 = 0) / count(*) FILTER (event_id % 4 = 0), 6) AS rate FROM events",
    "parse_judge_json": "SELECT event_id, event_id % 5 <> 2 AND trim(coalesce(props, '')) <> '' AS ok, CASE WHEN event_id % 5 <> 2 THEN CASE WHEN event_id % 2 = 0 THEN 'objective' ELSE 'subjective' END END AS subjectivity, CASE WHEN event_id % 5 <> 2 AND event_id % 2 = 1 THEN CASE WHEN event_id % 3 = 0 THEN 'positive' ELSE 'mixed' END END AS polarity, CASE WHEN event_id % 5 <> 2 THEN round((event_id % 101) / 100.0::DOUBLE, 6) END AS confidence, CASE WHEN event_id % 5 <> 2 THEN event_type END AS domain FROM events",
    "flagship": _FLAG,
    "prompt_rendering": "SELECT conv_id, turn, md5(replace('Judge this sentence:' || chr(10) || '{{SENTENCE}}' || chr(10) || 'Reply in JSON.', '{{SENTENCE}}', trim(replace(text, chr(10), ' ')))) AS prompt_md5 FROM conversations",
    "lid_reply_parse": "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'hindi' WHEN 1 THEN 'bhojpuri' ELSE 'other' END AS label, round(least(1.0, (event_id % 30) / 20.0::DOUBLE), 6) AS confidence, least(80, 3 * (event_id % 40))::BIGINT AS n_reason FROM events",
    "romanised_share": r"SELECT lang, count(*)::BIGINT AS n, count(*) FILTER (length(text) >= 15 AND a * 2 > b)::BIGINT AS romanised, round(avg(a::DOUBLE / length(text)), 6) AS mean_latin FROM (SELECT lang, text, len(regexp_extract_all(text, '[A-Za-z]')) AS a, len(regexp_extract_all(text, '\pL')) AS b FROM documents) GROUP BY lang",
    "conversation_ends": "SELECT conv_id, count(*)::BIGINT AS n, arg_min(role, turn) AS first_role, md5(arg_max(text, turn)) AS last_md5 FROM conversations GROUP BY conv_id",
}
QUERIES = {f.__name__: f for f in (lid_agreement_rates, content_hash_ids, sentence_split_counts, sentence_rows, strip_markup_pages, strip_pii_docs, strip_handles, devanagari_gates, collected_texts, clean_gate_reasons, corpus_filter_rules, script_profile, text_coalesce_enrich, norm_key_dedup_kept, norm_key_reject_reasons, strict_order_dedup, append_dedup_antijoin, benchmark_containment, source_verdict_crosstab, clean_rates, lid_two_judge_combine, leaf_category_prefix_anti, page_extraction, page_links_by_regex, url_slugs, parse_judge_json, rescue_parse, prompt_rendering, lid_reply_parse, romanised_share, conversation_ends, flagship)}
