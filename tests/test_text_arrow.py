"""What Arrow does of the text functions, against the same patterns as Java reads them; each step is evaluated once."""

import random

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import dedup
from corpusloom.plans import corpus, tables

PIECES = [
    "px", "px ", "pxé", "px1", "thumb", "OBO", "संदर्भ", "देवनागरी", "टाइप करने हेतु", "साधन", " - ", "1", "तिहुआर,", "छुट्टी", "मुख्य", "(मुख्य", "blog-post", "मौलिक", "व", "अप्रकाशित", "१-", "दि०", "ओ बी ओ",
    " ", "  ", "\n", "\r\n", "\r", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", " ", " ", " ", " ", " ", "　", "​", ".", ". ", "।", "?!", "-–—", "\"'()", ":;", "é", "क़", "\U0001f600", "é", "abc", "Z", "@", "[", "`", "{", "जनवरी-मार्च", "ࣿ", "ঀ", "ऀ", "ॿ",
]


def texts(n=3000):
    random.seed(5)
    return [None, "", " ", *PIECES, *["".join(random.choices(PIECES, k=random.randint(1, 7))) for _ in range(n)]]


def test_arrow_reads_as_java(spark):
    t = F.col("t")
    java_stripped = F.regexp_replace(t, f"^{T.WS}+|{T.WS}+$", "")
    deva, latin = F.regexp_count(t, F.lit(T.DEVANAGARI)), F.regexp_count(t, F.lit(T.LATIN))
    pairs = {
        "boilerplate": (T.is_boilerplate(t), t.rlike("|".join(f"(?:{p})" for p in T.BOILERPLATE))),
        "chrome": (T.is_title_chrome(t), t.rlike(T.TITLE_CHROME)),
        "key": (T.norm_key(t), F.regexp_replace(t, T.KEY_DROPPED, "")),
        "squeezed": (T.squeezed(t), T.squeeze(t)),
        "sentences": (T.sentences(t), F.filter(F.transform(F.split(T.strip_markup(t), T.SENTENCE_END), T.squeeze), lambda s: s != "")),
        "filter": (T.passes_filter(t), F.length(java_stripped).between(15, 400) & ~java_stripped.rlike("|".join(T.STUBS)) & (F.regexp_count(java_stripped, F.lit("[a-zA-Z]")) <= F.length(java_stripped) * 0.3) & ~java_stripped.rlike(r"^[)}\].,]")),
        "script": (T.script_of(t), F.when(deva + latin == 0, "other").when(deva / (deva + latin) >= 0.9, "devanagari").when(latin / (deva + latin) >= 0.9, "latin").otherwise("mixed")),
    }
    rows = spark.createDataFrame([(x,) for x in texts()], "t string").repartition(3)
    for name, (arrow, java) in pairs.items():
        got = rows.select("t", arrow.alias("a"), java.alias("j"))
        assert got.where(~F.col("a").eqNullSafe(F.col("j"))).head() is None, name


def test_corpus_text_is_squeezed(spark, tmp_path):
    rows = [(i, x, "en", "src0", 1) for i, x in enumerate(texts())]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = tables.corpus(spark, str(tmp_path)).withColumn("want", F.trim(F.regexp_replace("raw_text", r"\s+", " ")))
    assert got.where(~F.col("cleaned_text").eqNullSafe(F.col("want"))).head() is None


def test_cleaning_is_evaluated_once(spark):
    """Before, markup was stripped at each of nine places that read the clean text."""
    rows = spark.createDataFrame([("a", "x y", "x y")], "id string, cleaned_text string, raw_text string")
    plan = dedup._prepared(rows, 15, corpus.GATE)._jdf.queryExecution().executedPlan().toString()
    assert plan.count(T.TAG) == 1, plan
