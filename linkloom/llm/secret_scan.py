"""Secret scan: fixed patterns, and character Markov models for the random strings that no pattern names.

Native: a projection of regular expressions and higher-order functions over each row, with no shuffle. The Markov
models are bigram tables of random strings and of ordinary identifiers, counted from labelled samples by Spark; the
table of log-likelihood ratios has at most (alphabet + 1) squared entries and is folded into the plan as one literal.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The base patterns, with the length that a match (for assign: its value) must reach.
ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
ASSIGN_CHARS, ACCESS_CHARS = 6, 20

#: Runs that the models judge: 16 and more characters of an encoding's alphabet. Shorter ones hold too little to tell.
CANDIDATE = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+"
#: Whole words of letters, as samples of ordinary text, and documents that they are drawn from.
SAMPLE_WORD = "(?<![A-Za-z0-9+/_=-])[A-Za-z]{4,15}(?![A-Za-z0-9+/_=-])"
SAMPLE_DOCS = 200
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
MIN_LLR = 12.0

#: Words that made-up identifiers are made of.
IDENTIFIER_WORDS = (
    "get set user name file path data list item count index value key node page link host port time date text line word "
    "load save read write open close start stop first last next prev parent child left right table column row field type "
    "default config option result error message request response client server session version update create remove"
).split()


@dataclass(frozen=True)
class MarkovModel:
    """Log-likelihood ratios random : ordinary of character pairs; index (place of first) * (alphabet + 1) + place of second, places from 1, 0 for other characters."""

    ratios: tuple[float, ...]


def labelled_samples(spark: SparkSession, n: int = 3000) -> DataFrame:
    """Rows (text, random): random strings in base 64, hexadecimal and base 36 from hashes of numbers; identifiers, paths and numbered names from words."""
    i = F.col("id")
    digest = F.sha2(F.concat(F.lit("sample-"), i.cast("string")), 256)
    words = F.array(*map(F.lit, IDENTIFIER_WORDS))
    pick = lambda salt: F.element_at(words, (F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(len(IDENTIFIER_WORDS))) + 1).cast("int"))
    number = F.pmod(F.xxhash64(i, F.lit(9)), F.lit(1000)).cast("string")
    base36 = F.concat(*[F.conv(F.substring(digest, 1 + 12 * k, 12), 16, 36) for k in range(4)])
    random = F.array(F.base64(F.unhex(digest)), digest, base36, F.lower(base36))
    ordinary = F.array(
        F.concat_ws("_", pick(1), pick(2), pick(3), number),
        F.concat(pick(1), F.initcap(pick(2)), F.initcap(pick(3)), F.initcap(pick(4)), number),
        F.concat_ws("/", pick(1), pick(2), pick(3), F.concat(pick(4), number)),
        F.concat_ws("-", pick(1), pick(2), F.concat_ws("-", F.lit("2024"), F.lpad(number, 4, "0"))),
        F.upper(F.concat_ws("_", pick(1), pick(2), pick(3), number)),
    )
    ids = spark.range(n)
    return ids.select(F.explode(random).alias("text"), F.lit(True).alias("random")).unionByName(ids.select(F.explode(ordinary).alias("text"), F.lit(False).alias("random")))


def corpus_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Rows (text, random = false): the words of about sample_docs documents, drawn by a hash of id, outside what the base patterns match."""
    total = docs.count()
    share = min(1_000_000, -(-sample_docs * 1_000_000 // max(1, total)))
    drawn = docs.filter(F.pmod(F.xxhash64(F.lit("words"), id_col), F.lit(1_000_000)) < share)
    outside = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), f"{ASSIGN}|{ACCESS}|{HEX}", " ")
    return drawn.select(F.explode(F.regexp_extract_all(outside, F.lit(SAMPLE_WORD), F.lit(0))).alias("text"), F.lit(False).alias("random"))


def train_markov(samples: DataFrame, text_col: str = "text", label_col: str = "random", smoothing: float = 0.5) -> MarkovModel:
    """Bigram models of both labels from samples (text, boolean), with additive smoothing. Null texts and labels and texts under two characters add nothing; without samples all ratios are 0."""
    side = len(ALPHABET) + 1
    pairs = samples.filter(F.col(label_col).isNotNull() & (F.length(text_col) > 1)).select(
        F.col(label_col).alias("label"), F.explode(F.transform(F.sequence(F.lit(1), F.length(text_col) - 1), lambda i: F.col(text_col).substr(i, F.lit(2)))).alias("pair")
    )
    first, second = (F.instr(F.lit(ALPHABET), F.col("pair").substr(k, 1)) for k in (1, 2))
    rows = pairs.select("label", (first * side + second).alias("cell")).groupBy("label", "cell").count().collect()  # at most 2 * side * side rows
    counts = {(r["label"], r["cell"]): r["count"] for r in rows}

    def log_p(label: bool, cell: int) -> float:
        return math.log((counts.get((label, cell), 0) + smoothing) / (before[label][cell // side] + smoothing * side))

    before = {label: [0] * side for label in (True, False)}
    for (label, cell), n in counts.items():
        before[label][cell // side] += n
    return MarkovModel(tuple(round(log_p(True, c) - log_p(False, c), 6) for c in range(side * side)))


def _placed(text: Column, pattern: str, kind: int) -> Column:
    """Spans (start, kind, end, hit, value) of all matches, in code points: the pieces between matches give the places."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == 0 else hits
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), hits.alias("hit"), values.alias("value"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,hit:string,value:string>>")
    state = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["piece"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["hit"].alias("hit"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(x["hit"].isNull(), acc["spans"]).otherwise(F.array_append(acc["spans"], span)).alias("spans"))

    found = F.aggregate(zipped, state, step, lambda acc: acc["spans"])
    return F.when(text.rlike(pattern), found).otherwise(none)


def _llr(value: Column, model: MarkovModel) -> Column:
    """Sum of the ratios of value's character pairs; value is taken apart once, so the work is linear in its length."""
    side = len(ALPHABET) + 1
    ratios = F.from_json(F.lit(json.dumps(model.ratios)), "array<double>")
    places = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    score = lambda p: F.aggregate(F.sequence(F.lit(1), F.size(p) - 1), F.lit(0.0), lambda acc, i: acc + F.get(ratios, F.get(p, i - 1) * side + F.get(p, i)))
    return F.get(F.transform(F.array(places), score), F.lit(0))


def scan_secrets(docs: DataFrame, model: MarkovModel, text_col: str = "text", min_llr: float = MIN_LLR) -> DataFrame:
    """docs with a column secrets: array of (start, kind, end, hit) sorted by start, then kind as in KINDS.

    Kinds assign, access and hex are the leftmost non-overlapping matches of the base patterns that are long enough.
    random is a run of 16 and more characters of the encodings' alphabet whose log-likelihood ratio reaches min_llr and
    which no base span covers whole. A very long run is judged whole; repeated rows get the same spans. Offsets are code points, the end is exclusive. A null or empty text has no spans. Other columns stay; one named secrets is replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    assign = F.filter(_placed(text, ASSIGN, 0), lambda s: F.length(s["value"]) >= ASSIGN_CHARS)
    access = F.filter(_placed(text, ACCESS, 1), lambda s: F.length(s["hit"]) >= ACCESS_CHARS)
    out = docs.select("*", F.concat(assign, access, _placed(text, HEX, 2)).alias("__secret_base"), _placed(text, CANDIDATE, 3).alias("__secret_runs"))
    free = F.filter("__secret_runs", lambda r: ~F.exists("__secret_base", lambda b: (b["start"] <= r["start"]) & (r["end"] <= b["end"])))
    random = F.filter(free, lambda r: _llr(r["hit"], model) >= min_llr)
    spans = F.transform(F.array_sort(F.concat(F.col("__secret_base"), random)), lambda s: F.struct(s["start"].alias("start"), F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1).alias("kind"), s["end"].alias("end"), s["hit"].alias("hit")))
    return out.withColumn("secrets", spans).drop("__secret_base", "__secret_runs")
