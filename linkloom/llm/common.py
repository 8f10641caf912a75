"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Fixed value: the white space that the contracts name, U+0020 and U+0009 to U+000D.
WHITE_SPACE = " \t\n\x0b\x0c\r"
#: Fixed value: a word is a run of anything else.
WORD = "[^\\x20\\x09-\\x0D]+"

#: Rows of an Arrow batch, where the session allows more.
BATCH_ROWS = 500

_own_dir: list[str] = []


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows from here on: a batch of whole texts is held by the JVM and by Python at once."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= BATCH_ROWS:
        spark.conf.set(setting, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode, where that is unset, a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="linkloom-"))
    return _own_dir[0]


def cut(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: lineage ends there, and its size is known to the planner."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def squeezed(text: Column) -> Column:
    """text without white space; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in WHITE_SPACE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Bits of the table by which may_be_in tells ids: 512 rows of 4 KB, whatever the number of ids.
MARKS = 1 << 24


def may_be_in(rows: DataFrame, key: Column, ids: DataFrame) -> DataFrame:
    """rows without most of those whose key is not in the one column of ids; none whose key is there goes.

    A reducer before a join, so that rows without a partner are not shuffled: a broadcast bitmap of MARKS bits, built by
    aggregates. With many more ids than bits it lets all rows pass, and the join does the work alone.
    """
    place = lambda c: F.pmod(F.xxhash64(F.lit("mark"), c), F.lit(MARKS))
    marked = ids.select(place(F.col(ids.columns[0])).alias("p"))
    bits = marked.groupBy(F.bitmap_bucket_number("p").alias("__mark_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("__mark_bits"))
    own = rows.withColumn("__mark", place(key))
    bit = F.bitmap_bit_position(F.col("__mark"))
    joined = own.join(F.broadcast(bits), F.bitmap_bucket_number(F.col("__mark")) == F.col("__mark_bucket"))
    byte = F.conv(F.hex(F.substring(F.col("__mark_bits"), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.call_function("shiftright", byte, (bit % 8).cast("int")).bitwiseAND(1) == 1
    return joined.filter(hit).select(*rows.columns)
