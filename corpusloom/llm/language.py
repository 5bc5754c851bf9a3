"""Language identification: averaged hashed subword embeddings, linear softmax, calibrated rejection.

A word is its letters in lower case between two border marks; its features are its character n-grams (1 to 4) and the
word itself, hashed into a fixed number of buckets. A text is the average of the embeddings of all its features, and a
linear layer with softmax gives the language. Embeddings and layer are trained by stochastic gradient descent in numpy
on short passages spread over whole texts, from a bounded sample of labelled rows (`rows_per_language` distinct texts of
each label, those of least hash, so that the same table gives the same model). A tenth of the passages is held back to fit a
temperature and a threshold, below which a prediction is rejected (`rejected`; as `und`, where that is asked for).

Prediction covers every whole text. As the layer is linear, a bucket is its vector of language scores, a token between
blanks has the summed scores of its words, which each worker remembers, and a text is a sum over tokens.

Defined cases: null, empty and letterless texts are `und` with score 0; ties go to the first language in order; with
no labelled row every text is `und`; the label, source and id of a row are never inputs of its prediction.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .common import coded, holds, id_and_text, only, slices

_HELD: dict[str, WordScores] = {}
holds("language", _HELD.clear)
_LETTERS = re.compile(r"[^\W\d_]+")
UND = "und"
#: Tokens whose features are held at once: a token has some 30, and a slice may have 100,000 new ones.
_AT_ONCE = 8192


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


@dataclass
class LanguageModel:
    languages: list[str]
    scores: np.ndarray  # buckets x languages
    temperature: float = 1.0
    threshold: float = 0.0
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def words(self) -> WordScores:
        """The word memo of the model in use; a worker keeps one."""
        only("language")
        if self.name not in _HELD:
            _HELD.clear()
            _HELD[self.name] = WordScores(self.scores)
        return _HELD[self.name]

    def logits(self, texts: pa.StringArray) -> np.ndarray:
        """Mean scores of each text's features; NaN without a letter."""
        codes, ends, tokens = coded(pc.ascii_split_whitespace(texts))
        rows = self.words().of(tokens)[codes]
        out = np.full((len(texts), len(self.languages)), np.nan)
        sizes = np.diff(np.concatenate([[0], ends]))
        some = np.flatnonzero(sizes)
        if len(some):
            total = np.add.reduceat(rows, (ends - sizes)[some], axis=0, dtype=np.float64)
            lettered = total[:, -1] > 0
            out[some[lettered]] = total[lettered, :-1] / total[lettered, -1:]
        return out

    def predict(self, texts: pa.StringArray, reject: bool = False) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether the score is too low; a text without a letter is always too low."""
        if not self.languages:
            return [UND] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        logits = self.logits(texts)
        none = np.isnan(logits).any(axis=1)
        p = softmax(np.where(none[:, None], 0.0, logits) / self.temperature)
        score = np.where(none, 0.0, p.max(axis=1))
        low = none | (score < self.threshold)
        return [UND if n else self.languages[i] for n, i in zip(low if reject else none, p.argmax(axis=1), strict=True)], score, low


class WordScores:
    """Token -> row of summed scores and feature count; bounded like a Memo."""

    def __init__(self, scores: np.ndarray, most: int = 300_000):
        self.scores, self.most = scores, most
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1 << 16, scores.shape[1] + 1), np.float32)

    def of(self, tokens: list[str]) -> np.ndarray:
        """The rows of these distinct tokens."""
        missing = [t for t in tokens if t not in self.at]
        if len(self.at) + len(missing) > self.most:
            self.at, missing = {}, tokens
        if missing:
            base = len(self.at)
            while base + len(missing) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            for at in range(0, len(missing), _AT_ONCE):
                self.rows[base + at : base + min(at + _AT_ONCE, len(missing))] = self.scored(missing[at : at + _AT_ONCE])
            self.at.update(zip(missing, range(base, base + len(missing)), strict=True))
        return self.rows[np.fromiter(map(self.at.__getitem__, tokens), np.int64, len(tokens))]

    def scored(self, tokens: list[str]) -> np.ndarray:
        words = [_LETTERS.findall(t.lower()) for t in tokens]
        of_word = np.repeat(np.arange(len(tokens)), np.fromiter(map(len, words), np.int64, len(words)))
        found, word = features([w for ws in words for w in ws], len(self.scores))
        of = of_word[word]
        out = np.empty((len(tokens), self.scores.shape[1] + 1), np.float32)
        for k in range(self.scores.shape[1]):
            out[:, k] = np.bincount(of, self.scores[found, k], len(tokens))
        out[:, -1] = np.bincount(of, minlength=len(tokens))
        return out


def features(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' hashed n-grams, between marks, and of the words themselves, and the index of each one's word.

    Polynomial hashes, so that the n-grams of all words come from a few array steps."""
    out = [np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace")) for w in words), np.uint64, len(words))]
    of = [np.arange(len(words))]
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(of[0], sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))  # code points to the end of the word
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, min(4, len(codes)) + 1):
        h = h[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] + np.uint64(n)
        within = left[: len(h)] >= n
        own = h[within]
        out.append(own ^ (own >> np.uint64(29)))
        of.append(word[: len(h)][within])
    return ((np.concatenate(out) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)).astype(np.int64) % buckets, np.concatenate(of)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def passages_of(text: str, passage: int = 25, passages: int = 4) -> list[list[str]]:
    """Words of passages of `passage` and of 5 words in turn, spread over a whole text."""
    words = _LETTERS.findall(text.lower())
    starts = range(0, len(words), max(passage, len(words) // passages)) if words else ()
    return [words[at : at + (passage if k % 2 == 0 else 5)] for k, at in enumerate(starts)]


def fit(passages: list[list[str]], labels: list[str], buckets: int = 1 << 16, dim: int = 16, epochs: int = 5, rate: float = 0.5, seed: int = 7) -> LanguageModel:
    """Train on passages, as lists of words, with their labels. They are used in a fixed order: the same ones give the same model."""
    languages = sorted(set(labels))
    if len(languages) < 2:
        return LanguageModel(languages, np.zeros((buckets, len(languages)), np.float32))
    rng = np.random.default_rng(seed)
    rows = sorted(zip(passages, labels, strict=True))
    known = {w: i for i, w in enumerate(dict.fromkeys(w for words, _ in rows for w in words))}
    found, word = features(list(known), buckets)
    order = np.argsort(word, kind="stable")
    each = np.split(found[order], np.cumsum(np.bincount(word, minlength=len(known)))[:-1])
    examples = [(np.concatenate([each[known[w]] for w in words]), languages.index(label)) for words, label in rows]
    order = rng.permutation(len(examples))
    back = [examples[i] for i in order[: len(order) // 10]]
    train = [examples[i] for i in order[len(order) // 10 :]]
    emb = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    layer = np.zeros((dim, len(languages)), np.float32)
    steps, step = epochs * len(train), 0
    for _ in range(epochs):
        for i in rng.permutation(len(train)):
            idx, y = train[i]
            lr = rate * (1 - step / steps)
            step += 1
            hidden = emb[idx].mean(axis=0)
            z = hidden @ layer
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back_to = layer @ p
            layer -= lr * np.outer(hidden, p)
            np.subtract.at(emb, idx, lr * back_to / len(idx) * 8)
    model = LanguageModel(languages, (emb @ layer).astype(np.float32))
    if back:
        z = np.array([model.scores[idx].mean(axis=0) for idx, _ in back])
        y = np.array([y for _, y in back])
        grid = np.geomspace(0.05, 20, 60)
        loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        p = softmax(z / model.temperature)
        right = np.sort(p.max(axis=1)[p.argmax(axis=1) == y])
        model.threshold = float(min(0.5, right[len(right) // 1000])) if len(right) else 0.0
    return model


def train(df: DataFrame, lang_col: str = "lang", text_col: str = "text", rows_per_language: int = 500, most_rows: int = 100_000) -> LanguageModel:
    """Learn from a bounded sample of the labelled rows in df: rows_per_language distinct texts of each label, those of
    least hash; fewer of each where labels are so many that there would be over most_rows in all. Every label is learned.
    What reaches the driver are some passages of these rows, of at most 25 words each.
    """
    labelled = df.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null").withColumn("h", F.xxhash64("text"))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}  # one row a label
    if not counts:
        return LanguageModel([], np.zeros((1, 0), np.float32))
    each = max(1, min(rows_per_language, most_rows // len(counts)))
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, 1.5 * each / max(n, 1))])
    spread = F.pmod(F.xxhash64("h"), F.lit(1 << 30)) / float(1 << 30)
    some = labelled.where(spread < F.try_element_at(share, F.col("lang"))).dropDuplicates(["lang", "h"])
    least = Window.partitionBy("lang").orderBy("h", "text")
    some = some.withColumn("k", F.row_number().over(least)).where(F.col("k") <= each)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = [(lang, words) for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True) for words in passages_of(text)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.string()))], names=["lang", "words"])

    rows = some.select("lang", "text").mapInArrow(run, "lang string, words array<string>").collect()
    return fit([list(r["words"]) for r in rows], [r["lang"] for r in rows])


def predict(df: DataFrame, model: LanguageModel, reject: bool = False, keep: list[str] | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, lang_pred, score, rejected; with `keep`, those columns of df instead of doc_id. With `reject`, what is rejected is `und`."""
    docs = df.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text")) if keep else id_and_text(df, id_col, text_col)
    held = df.sparkSession.sparkContext.broadcast(model)  # a few MB: the number of buckets is fixed
    names = keep or ["doc_id"]
    kept = docs.select(*names).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for part in slices(batches):
            lang, score, low = m.predict(part.column(part.num_columns - 1), reject)
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), pa.array(lang, pa.string()), pa.array(score), pa.array(low)], names=[*names, "lang_pred", "score", "rejected"])

    return docs.mapInArrow(run, StructType([*kept.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())]))
