"""Exact deduplication by progressive refinement, on DataFrame functions alone.

Rows are told apart by ever dearer keys: the length of the normalised text, then a hash of its head, then a hash of all
of it. A stage looks only at groups in which the stage before left two rows or more, so a full text takes part in a
shuffle only when another text has the same length and head. No stage gathers a group: groups are counted with
map-side partial sums, and the verdict of a group is joined back as one row. The few keys that hold much of all rows are
joined by broadcast, so their rows stay where they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut, squeezed

HEAD_CHARS = 256
#: Keys with more than a HOT_PART-th of all rows are fewer than HOT_PART, whatever the table: that bounds what is broadcast.
HOT_PART = 1000


def _parted(sizes: DataFrame, size: str) -> tuple[DataFrame, DataFrame]:
    """sizes (keys…, size, …) in two: keys with more than a HOT_PART-th of the sum of sizes, and the others."""
    total = sizes.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    hot = F.col(size) * HOT_PART > total
    return sizes.filter(hot), sizes.filter(~hot)


def _matched(rows: DataFrame, sizes: DataFrame, keys: list[str], size: str) -> DataFrame:
    """rows with the columns of sizes, null where it lacks their keys; rows of hot keys are not shuffled."""
    hot, others = _parted(sizes, size)
    cool = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(cool.join(others, keys, "left"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head_chars: int = HEAD_CHARS, digest_all: bool = False) -> DataFrame:
    """One row per input row: id, n_chars, norm_length, content_hash, keep_id, group_size, kept.

    Texts are equal when they are identical without white space; a null text counts as empty, so nulls, empty and blank
    texts form one group. Of a group the row with the longest original text stays, of these the one with the smallest
    id; a null id sorts first. Rows that repeat an id with the same text carry the same verdict. content_hash is the
    SHA-256 of the normalised text, null for a row that no other row resembled so far; digest_all=True hashes every
    row while it is scanned (for a report of all digests), which leaves the stages and their groups as they are.
    Other columns of docs are not read, so clashing names do no harm. An empty table gives no rows, and texts of any length
    are compared whole.
    """
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.length(text), F.lit(0)).alias("n_chars"), squeezed(text).alias("norm"))
    rows = rows.withColumn("norm_length", F.length("norm"))
    keyed = rows.withColumn("head", F.xxhash64(F.substring("norm", 1, head_chars)))

    full_hash = F.sha2(F.col("norm"), 256)
    if digest_all:  # texts are read once, and the stages work on this narrow table
        keyed = cut(keyed.select("id", "n_chars", "norm_length", "head", full_hash.alias("content_hash")))
    lengths = keyed.groupBy("norm_length").count().filter("count > 1").select("norm_length")
    heads = keyed.groupBy("norm_length", "head").count().join(lengths, "norm_length", "left_semi").filter("count > 1")
    heads = cut(heads.select("norm_length", "head", "count", F.lit(True).alias("alike")))

    if digest_all:
        small = _matched(keyed, heads, ["norm_length", "head"], "count")
    else:
        key = ["norm_length", "head"]
        hot, others = (t.select(*key) for t in _parted(heads, "count"))
        cool = keyed.join(F.broadcast(hot), key, "left_anti")
        alike = keyed.join(F.broadcast(hot), key, "left_semi").unionByName(cool.join(others, key, "left_semi"))
        alike = alike.select("id", "n_chars", "norm_length", full_hash.alias("content_hash"), F.lit(True).alias("alike"))
        alone = cool.select("id", "n_chars", "norm_length", "head").join(others, key, "left_anti")
        small = alike.unionByName(alone.select("id", "n_chars", "norm_length", F.lit(None).cast("string").alias("content_hash"), F.lit(None).cast("boolean").alias("alike")))
    small = cut(small.select("id", "n_chars", "norm_length", "content_hash", F.coalesce("alike", F.lit(False)).alias("alike")))

    best = F.min(F.struct((-F.col("n_chars")).alias("shorter"), F.col("id").alias("id")))
    groups = small.filter("alike").groupBy("norm_length", "content_hash").agg(best.alias("best"), F.count("*").alias("group_size"))
    groups = cut(groups.filter("group_size > 1").select("norm_length", "content_hash", F.col("best.id").alias("keep_id"), "group_size"))

    out = _matched(small, groups, ["norm_length", "content_hash"], "group_size")
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    out = out.withColumn("keep_id", keep).withColumn("group_size", F.coalesce("group_size", F.lit(1)).cast("long"))
    return out.select(F.col("id").alias(id_col), "n_chars", "norm_length", "content_hash", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_groups drops; ids should be unique, as rows are dropped by id."""
    dropped = exact_groups(docs, id_col, text_col).filter(~F.col("kept")).select(id_col)
    return docs.join(dropped, id_col, "left_anti")
