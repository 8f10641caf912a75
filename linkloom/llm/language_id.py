"""Language identification by words, backing off to shorter and shorter character n-grams for unseen words.

The model holds, per language, the log frequency of words and of n-grams of 4, 3, 2 and 1 characters. A known word is
scored by its own frequencies; an unseen one by those n-grams of its padded form that are known, of the longest order
that has any. Each feature's row of log frequencies is shifted to a log posterior over languages, which changes no
comparison and lets features of different orders be added.

Features are known by 64-bit hashes, in sorted arrays: the model is a few MB per 100,000 features, and prediction looks
the words of many texts up at once. The tables are counted by Spark over a bounded, hash-drawn sample of labelled rows;
prediction is one Arrow pass over whole texts, without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, small_batches

UNKNOWN = "und"
ORDERS = (4, 3, 2, 1)
#: The sample has about so many labelled rows of each language.
SAMPLE_ROWS = 3000
#: Texts looked at together, and counters flushed at so many entries.
SLICE, COUNTERS = 256, 200_000
#: How many times the mean log posterior of a word is counted in a score. A text of one language alone has means far
#: apart, whatever its length; in one of none they are close.
SHARPNESS = 2.0

_RUNS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> Counter:
    """Counts of the runs of letters of text, in lower case. Numeric signs such as ½ are no letters."""
    found = Counter(_RUNS.findall(text.lower()))
    for mixed in [w for w in found if not w.isalpha()]:
        n = found.pop(mixed)
        for word in "".join(c if c.isalpha() else " " for c in mixed).split():
            found[word] += n
    return found


def grams_of(word: str, n: int) -> list[str]:
    """N-grams of word between a start and an end mark; single characters without the marks."""
    padded = f"^{word}$" if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def key_of(feature: str, order: int) -> int:
    """The hash by which a word (order 0) or an n-gram is known."""
    return xxhash.xxh64_intdigest(feature.encode("utf-8", "surrogatepass"), order)


@dataclass
class LanguageModel:
    """languages in order; keys[order], sorted, and scores[order] of each key: log posteriors of the languages."""

    languages: list[str]
    keys: dict[int, np.ndarray]
    scores: dict[int, np.ndarray]

    def _rows(self, order: int, hashes: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """For each hash its place in keys[order], and whether it is there."""
        known, wanted = self.keys[order], np.array(hashes, dtype=np.uint64)
        if not len(known):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
        return at, known[at] == wanted

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log posteriors of each word, and which words have any."""
        at, known = self._rows(0, [key_of(w, 0) for w in words])
        out = np.zeros((len(words), len(self.languages)))
        out[known] = self.scores[0][at[known]]
        rest = np.flatnonzero(~known)
        for order in ORDERS:
            if not len(rest):
                break
            hashes, owner = [], []
            for i, w in enumerate(rest.tolist()):
                grams = grams_of(words[w], order)
                hashes += [key_of(g, order) for g in grams]
                owner += [i] * len(grams)
            at, hit = self._rows(order, hashes)
            owners = np.array(owner, dtype=np.int64)[hit]
            n = np.bincount(owners, minlength=len(rest))
            for k in range(len(self.languages)):
                sums = np.bincount(owners, weights=self.scores[order][at[hit], k], minlength=len(rest))
                out[rest, k] = np.where(n > 0, sums / np.maximum(n, 1), 0.0)
            known[rest] = n > 0
            rest = rest[n == 0]
        return out, known

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text."""
        numbers: dict[str, int] = {}
        doc: list[int] = []
        word: list[int] = []
        count: list[int] = []
        for d, text in enumerate(texts):
            counts = words_of(text) if text else {}
            doc += [d] * len(counts)
            word += [numbers.setdefault(w, len(numbers)) for w in counts]
            count += counts.values()
        lettered = np.bincount(np.array(doc, dtype=np.int64), minlength=len(texts)) > 0
        if not self.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        scores, known = self.word_scores(list(numbers))
        docs, words = np.array(doc, dtype=np.int64), np.array(word, dtype=np.int64)
        weights = np.array(count, dtype=np.float64) * known[words]
        size = np.bincount(docs, weights=weights, minlength=len(texts))
        means = np.stack([np.bincount(docs, weights=weights * scores[words, k], minlength=len(texts)) / np.maximum(size, 1.0) for k in range(len(self.languages))], axis=1)
        best = means.argmax(axis=1)
        spread = np.exp(SHARPNESS * (means - means.max(axis=1, keepdims=True))).sum(axis=1)
        return [(self.languages[b], float(1.0 / s)) if there else (UNKNOWN, 0.0) for b, s, there in zip(best.tolist(), spread.tolist(), lettered.tolist(), strict=True)]


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, grams, key, n) of some texts; counters are bounded, so a feature may come in several rows."""
    counts: dict[str, Counter] = {}

    def flushed() -> Iterator[pa.RecordBatch]:
        for lang, words in counts.items():
            for order in (0, *ORDERS):
                features = Counter() if order else words
                for w, n in words.items() if order else ():
                    for gram in grams_of(w, order):
                        features[gram] += n
                keys = np.array([key_of(f, order) for f in features], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(keys), pa.string()), "grams": pa.array([order] * len(keys), pa.int32()), "key": pa.array(keys), "n": pa.array(list(features.values()), pa.int64())})
        counts.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
            counts.setdefault(lang.as_py(), Counter()).update(words_of(text.as_py()))
            if sum(map(len, counts.values())) > COUNTERS:
                yield from flushed()
    yield from flushed()


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, features: int | None = None, smoothing: float = 0.1) -> LanguageModel:
    """A model of the languages in lang_col, from rows that have a language and a text.

    Of each language about sample_rows rows are drawn by a hash of id and counted whole, and all their features are kept: the
    drawn rows bound what reaches the driver. With `features` a smaller model is made on request: of an order with more than
    that many, those above the least count that leaves no more, counted over all languages, stay with the counts of every
    language. Without labelled rows the model has no languages and answers und.
    """
    small_batches(docs.sparkSession)
    labelled = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # one row a language
    if not sizes:
        return LanguageModel([], {}, {})
    share: Column = F.lit(0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, min(1_000_000, -(-sample_rows * 1_000_000 // n))).otherwise(share)
    drawn = labelled.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share)
    languages = sorted(sizes)
    per_lang = [F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).alias(f"n{k}") for k, lang in enumerate(languages)]
    counted = cut(drawn.select("lang", "text").mapInArrow(_count_features, "lang string, grams int, key long, n long").groupBy("grams", "key").agg(F.sum("n").alias("n"), *per_lang))
    steps = counted.groupBy("grams", F.least("n", F.lit(1000)).alias("n")).count().collect() if features is not None else []  # at most 1000 rows an order
    least = {}
    for order in (0, *ORDERS) if features is not None else ():
        left = features
        for n, rows in sorted(((r["n"], r["count"]) for r in steps if r["grams"] == order), reverse=True):
            left -= rows
            if left < 0:
                least[order] = n + 1
                break
    wanted = F.lit(True)
    for order, n in least.items():
        wanted = wanted & ((F.col("grams") != order) | (F.col("n") >= n))
    table = counted.filter(wanted).drop("n").toArrow()

    order_of = table.column("grams").to_numpy()
    all_keys = table.column("key").to_numpy().view(np.uint64)
    all_counts = np.stack([table.column(f"n{k}").to_numpy() for k in range(len(languages))], axis=1)
    keys, scores = {}, {}
    for order in (0, *ORDERS):
        mine = np.flatnonzero(order_of == order)
        mine = mine[np.argsort(all_keys[mine], kind="stable")]
        log_p = np.log(all_counts[mine] + smoothing)
        log_p -= np.log((all_counts[mine] + smoothing).sum(axis=0))
        keys[order] = all_keys[mine]
        scores[order] = (log_p - np.log(np.exp(log_p).sum(axis=1, keepdims=True))).astype(np.float32)
    return LanguageModel(languages, keys, scores)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """docs with the predicted language and its score (0 to 1) as columns lang_name and score_name.

    The score is the posterior by the mean over a text's words, so it tells how clear a text is whatever its length. A
    null text and one without letters get und and 0. A text none of whose words or characters the model knows gets the
    first language with 1 / number of languages. Very long texts are counted whole; repeated rows get the same answer.
    An empty table gives no rows. Other columns pass through; columns of the two names are replaced.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("struct<lang: string, score: double>")
    def predict(texts: pa.Array) -> pa.Array:
        found = []
        for at in range(0, len(texts), SLICE):
            found += shared.value.predict(texts.slice(at, SLICE).to_pylist())
        return pa.array([{"lang": lang, "score": score} for lang, score in found], kind)

    # a filter on the result would otherwise be planned with a prediction of its own, in a second worker beside the first
    out = docs.withColumn("__language", predict.asNondeterministic()(F.col(text_col)))
    return out.withColumn(lang_name, F.col("__language.lang")).withColumn(score_name, F.col("__language.score")).drop("__language")


def held_out(id_col: Column) -> Column:
    """Rows kept from training: crc32 of the id as text leaves 1 when divided by 3; a null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))
