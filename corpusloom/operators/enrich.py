"""Register, licence, script, category and text type of sentences; language verdicts."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Lookups by source, patterns by category.
REGISTER = {
    "khabarbhojpuri": "news",
    "bhojpurinews": "news",
    "bhojpuri_wikipedia": "encyclopedic",
    "bhojpurisahityasarita": "literary",
    "jogira": "literary",
    "kavitakosh": "verse",
    "kavitakosh_geet": "verse",
    "sirijan": "literary",
    "openbooksonline": "literary",
    "bhojpuri_blogspot": "opinion",
    "parichaydas_bihari": "literary",
    "pandiji": "commentary",
}
LICENSE = {"bhojpuri_wikipedia": "redistributable_cc_by_sa"}
DEFAULT_LICENSE = "pointer_only"
VERSE_CATEGORY = "(?iu)कविता|गीत|गजल|ग़ज़ल|kavita|geet|gazal|ghazal|poem|verse"
VERSE_SOURCES = ["kavitakosh", "kavitakosh_geet"]
GENRES = [
    ("laghu-katha", "लघुकथा"), ("laghu", "लघुकथा"), ("kahani", "कहानी"), ("katha", "कथा"), ("kavita", "कविता"), ("gazal", "गजल"), ("ghazal", "गजल"),
    ("geet", "गीत"), ("proverb", "कहावत"), ("paheli", "पहेली"), ("bujhauwal", "पहेली"), ("rachna", "रचना"), ("composition", "रचना"), ("sahity", "साहित्य"),
]
VERDICTS = {"bho_Deva": "bhojpuri", "hin_Deva": "hindi", "mai_Deva": "maithili"}


def looked_up(key: Column, table: dict[str, str], default: str) -> Column:
    """A literal map: a lookup of a few fixed keys needs no join."""
    return F.coalesce(F.try_element_at(F.create_map(*map(F.lit, chain(*table.items()))), key), F.lit(default))


def genre_of(url: Column, genres: list[tuple[str, str]] | None = None) -> Column:
    """Genre of the first key, in list order, that the URL's last segment holds."""
    out = None
    for key, genre in genres or GENRES:
        hit = T.slug(url).contains(key)
        out = F.when(hit, genre) if out is None else out.when(hit, genre)
    return out


def enrich(rows: DataFrame, registers: dict[str, str] | None = None, licences: dict[str, str] | None = None, verse_sources: list[str] | None = None, verse_category: str = VERSE_CATEGORY, genre_source: str = "jogira") -> DataFrame:
    """Adds register, license_class, script, text_type; fills the category of one source from its URL."""
    source = F.col("source_name")
    missing = (source == genre_source) & (F.col("category").isNull() | (F.col("category") == "sitemap"))
    out = rows.withColumn("category", F.when(missing, F.coalesce(genre_of(F.coalesce("source_url", F.lit(""))), F.col("category"))).otherwise(F.col("category")))
    verse = F.coalesce("category", F.lit("")).rlike(verse_category) | F.coalesce(source.isin(VERSE_SOURCES if verse_sources is None else verse_sources), F.lit(False))
    return out.select(
        "*",
        looked_up(source, REGISTER if registers is None else registers, "unknown").alias("register"),
        looked_up(source, LICENSE if licences is None else licences, DEFAULT_LICENSE).alias("license_class"),
        T.script_of(F.coalesce("cleaned_text", F.lit(""))).alias("script"),
        F.when(verse, "verse").otherwise("prose").alias("text_type"),
    )


def lid_verdict(label: Column, verdicts: dict[str, str] | None = None) -> Column:
    return looked_up(label, VERDICTS if verdicts is None else verdicts, "other")


def lid_failed(confidence: Column, reason: Column) -> Column:
    return (confidence == 0.0) & reason.rlike("error|retries|unparseable")


def combine_lid(rows: DataFrame, agreed: tuple[str, ...] = ("bhojpuri", "hindi", "other")) -> DataFrame:
    """Two verdicts (g_label, g_confidence, g_reason, m_label, ...) to lid_label, lid_confidence, lid_note."""
    g, m = F.col("g_label"), F.col("m_label")
    gc, mc = F.col("g_confidence"), F.col("m_confidence")
    same = (g == m) & g.isin(*agreed)
    reasons = F.concat_ws(" ", "g_reason", "m_reason")
    note = F.when(reasons.rlike("error|retries"), "api_error").when(reasons.contains("unparseable"), "unparseable").otherwise("both_judges_other")
    return rows.select(
        "*",
        F.when(same, g).otherwise("disagree").alias("lid_label"),
        F.round(F.when(same, (gc + mc) / 2).otherwise(F.least(gc, mc)), 3).alias("lid_confidence"),
        F.when(~same, F.concat_ws("_vs_", g, m)).when(g == "other", note).alias("lid_note"),
    )


def agreement_rates(rows: DataFrame, target: str) -> DataFrame:
    """One row: n, both judges' share of the target label, and the same over rows that no judge failed on."""
    both = (F.col("g_label") == target) & (F.col("m_label") == target)
    fine = ~(lid_failed(F.col("g_confidence"), F.col("g_reason")) | lid_failed(F.col("m_confidence"), F.col("m_reason")))
    fine = F.coalesce(fine, F.lit(True))
    n, good = F.count("*"), F.count_if(fine)
    return rows.agg(n.alias("n"), good.alias("n_fine"), F.try_divide(F.count_if(both), n).alias("rate"), F.try_divide(F.count_if(both & fine), good).alias("rate_fine"))


def verdict_crosstab(rows: DataFrame, by: str = "source_name", verdict: str = "lid_verdict") -> DataFrame:
    """by, verdict, n, share of the rows of by."""
    n = rows.groupBy(by, verdict).agg(F.count("*").alias("n"))
    total = n.groupBy(by).agg(F.sum("n").alias("total"))
    return n.join(total, by).select(by, verdict, "n", F.round(100 * F.col("n") / F.col("total"), 6).alias("pct"))


def leaves_only(categories: DataFrame, label: str = "label", excluded: list[str] = (), root: str = "uncategorized") -> DataFrame:
    """Labels that no other label continues after a slash. Every proper prefix of a label is listed once, so the
    prefix condition is an equality and the anti join needs no nested loop."""
    parts = F.split(F.col(label), "/")
    prefixes = categories.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("prefix"), F.col(label).alias("full")).where("prefix != full").select(F.col("prefix").alias(label)).distinct()
    kept = categories.join(prefixes, label, "left_anti").where(F.col(label) != root)
    for word in excluded:
        kept = kept.where(~F.lower(F.try_url_decode(F.col(label))).contains(word))
    return kept
