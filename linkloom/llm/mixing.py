"""Mixing sources to target weights, on DataFrame functions alone.

Two passes: tokens are summed per source (map-side partial sums), targets follow from the table of sources, and each
document is then emitted floor(rate) times plus one more time with probability equal to the fraction, decided by a
seeded hash of its id. A draw can miss the target of a source with few or uneven documents, so SEEDS draws are summed up
side by side and each source takes the one that comes nearest. Only the table of sources is joined; documents of one
source never have to meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut, word_count

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
SEED = "mix"
#: Draws, each by 8 hexadecimal digits of SHA-256 digests.
SEEDS = 32


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Rows (source, source_size, target, rate) from rows (source, size).

    Sources stand in code-point order, null last, and take the weights in turn. share times all sizes is dealt out by
    weight; a source gets cap times its own size at most and what it leaves goes to the others by weight. With sources
    sorted by the level at which they fill up, the ones that are full are a prefix, so running sums give the level
    without iteration. cap must be share at least. A source of size 0, and each source of an empty corpus, gets 0.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    filling = Window.orderBy("fills_at", "place")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("place", F.row_number().over(by_name)).withColumn("weight", weight)
    per_source = per_source.withColumn("fills_at", F.lit(cap) * F.col("source_size") / F.col("weight"))
    full_before = F.coalesce(F.sum(F.lit(cap) * F.col("source_size")).over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_before = F.coalesce(F.sum("weight").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = (F.lit(share) * F.sum("source_size").over(everything) - full_before) / (F.sum("weight").over(everything) - weight_before)
    per_source = per_source.withColumn("level", level).withColumn("full", F.col("fills_at") <= F.col("level"))
    shared_level = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    target = F.when(F.col("full"), F.lit(cap) * F.col("source_size")).otherwise(shared_level * F.col("weight"))
    out = per_source.select("source", "source_size", target.alias("target"))
    return out.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row per input row: id, size (words, null text: 0), source_size, target, rate, copies, taken.

    copies is floor(rate) plus one where the source's draw falls below the fraction, so reruns agree and rows that
    repeat an id are all treated alike, as are rows without id. Null is a source of its own. An empty table gives no rows.
    """
    sizes = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")))
    return _with_copies(sizes, _chosen(sizes, seed, weights, share, cap), seed).select(F.col("id").alias(id_col), "size", "source_size", "target", "rate", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def _draw(seed: str, key: Column, number: Column) -> Column:
    """The number-th draw (from 0) in [0, 1) of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.floor(number / 8).cast("string"), F.lit(":"), F.coalesce(key.cast("string"), F.lit("null"))), 256)
    digits = digest.substr((number % 8 * 8 + 1).cast("int"), F.lit(8))
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 32))


def _joined(rows: DataFrame, targets: DataFrame) -> DataFrame:
    return rows.join(targets.withColumnRenamed("source", "target_source"), F.col("source").eqNullSafe(F.col("target_source"))).drop("target_source")


def _chosen(sizes: DataFrame, seed: str, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """source_targets with the number of each source's draw: the nearest to its target, of equals the first."""
    targets = cut(source_targets(sizes, weights, share, cap))
    rated = _joined(sizes, targets.select("source", "rate"))
    extra = [F.sum(F.when(_draw(seed, F.col("id"), F.lit(k)) < F.col("rate") - F.floor("rate"), F.col("size")).otherwise(0)).alias(f"d{k}") for k in range(SEEDS)]
    drawn = rated.groupBy("source").agg(*extra).withColumnRenamed("source", "drawn_source")
    both = targets.join(drawn, F.col("source").eqNullSafe(F.col("drawn_source")))
    off = lambda k: F.abs(F.floor("rate") * F.col("source_size") + F.col(f"d{k}") - F.col("target"))
    nearest = F.array_min(F.array(*[F.struct(off(k).alias("off"), F.lit(k).alias("k")) for k in range(SEEDS)]))["k"]
    return cut(both.select("source", "source_size", "target", "rate", nearest.alias("draw")))


def _with_copies(rows: DataFrame, targets: DataFrame, seed: str) -> DataFrame:
    whole = F.floor("rate")
    return _joined(rows, targets).withColumn("copies", (whole + (_draw(seed, F.col("id"), F.col("draw")) < F.col("rate") - whole).cast("long")).cast("long"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """The mixed corpus: each row of docs as often as mix_plan's copies says, with the columns of docs, whatever their names."""
    sizes = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")))
    targets = _chosen(sizes, seed, weights, share, cap).select("source", "rate", "draw")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"))
    emitted = _with_copies(rows, targets, seed).withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return emitted.select("row.*")
