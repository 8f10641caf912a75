"""A pipeline over documents: language ID, line dedup, near duplicates, mixing, SentencePiece.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes what each returns as Parquet and rereads it
as the next one's docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from linkloom.llm import language_id, line_dedup, mixing, ngram_join, piece_transducer
from linkloom.llm.common import cut, table

#: Bytes of an Arrow batch of the stages with Python: whole texts are held by the JVM and by Python at once, however long they are.
BATCH_BYTES = 8 << 20
#: A document whose language has a lower posterior is rejected, as is one without letters.
MIN_SCORE = 0.5


#: Environment of Python workers: what they free goes back to the system, as they stay while stages without Python run.
WORKER_ENVIRONMENT = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "1", "MALLOC_TRIM_THRESHOLD_": "131072", "MALLOC_MMAP_THRESHOLD_": "131072"}


def bounded(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES, or one text, and workers that give memory back, from here on."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.sparkContext.environment.update(WORKER_ENVIRONMENT)


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; lang becomes what the text was recognised as.

    Null texts and texts without letters go. Rows without id and repeated rows are told like any other; extra columns
    pass through. Without labelled rows no language is known and nothing is left. An empty table gives no rows.
    """
    bounded(spark)
    model = language_id.train(docs)
    named = language_id.identify(docs, model, lang_name="__lang", score_name="__score")
    kept = named.filter((F.col("__lang") != language_id.UNKNOWN) & (F.col("__score") >= MIN_SCORE))
    return kept.withColumn("lang", F.col("__lang")).select(docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that earlier documents have; documents of which nothing but white space is left go.

    Rows without id only lose lines that they repeat themselves; rows of one id are not held against each other. Null
    texts go. Extra columns pass through. An empty table gives no rows.
    """
    kept = line_dedup.dedup_lines(docs).filter(F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of smallest id; rows without id or words stay. An empty table gives no rows."""
    bounded(spark)
    return ngram_join.keep_one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for; a null source is one of its own, rows without id share one draw."""
    return mixing.mix(docs)


def in_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their ids, and whether these decode to the text; a null text has none. An empty table gives no rows."""
    bounded(spark)
    transducer = piece_transducer.compile_transducer(piece_transducer.read_vocabulary())
    made = piece_transducer.encode_and_decode(docs, transducer)
    return made.withColumn("round_trip", piece_transducer.round_trips(F.col("text"), F.col("decoded"))).drop("decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", by_language),
    ("line dedup", without_repeated_lines),
    ("n-gram Jaccard join", without_near_copies),
    ("mixing sources to target weights", mixed),
    ("SentencePiece encoding and decoding", in_pieces),
]

#: No SQL: language ID, the edit join and SentencePiece are beyond it. tests/llm hold the stages against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
