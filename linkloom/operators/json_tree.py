"""Walks through JSON texts of any shape, level by level inside Spark.

A text becomes a VARIANT value, and a walk opens it some levels a job: what these leave open is written to the shared
folder, so plans don't grow with depth and the next levels are spread over all tasks anew. Nesting ends
where the parser does, at 1,000 levels; a text beyond that, and one that is no JSON, gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .graph import written

AT = "array<int>"
#: Levels that are opened in one job.
LEVELS = 8


@contextmanager
def _repeated_keys(spark: SparkSession) -> Iterator[None]:
    """Within it, of a key that an object repeats the last value counts, where else the whole text would be refused."""
    setting = "spark.sql.variant.allowDuplicateKeys"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def _opened(rows: DataFrame, value: str = "v") -> DataFrame:
    """rows with pos, key and value of each member of a variant; one row with nulls where there is none to open."""
    return rows.lateralJoin(rows.sparkSession.tvf.variant_explode_outer(F.col(value).outer()))


def _first_level(rows: DataFrame, text: str, keep: list[str], start: Callable[[Column], Column]) -> DataFrame:
    with _repeated_keys(rows.sparkSession):
        parsed = rows.select(*keep, start(F.try_parse_json(F.col(text))).alias("v"), F.array().cast(AT).alias("at"))
        return written(parsed.filter("v is not null"))


def leaves(rows: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Rows (keep…, at, path, kind, value) of all values in JSON texts that hold no others, at any depth.

    at has the positions from the outside in, members of an object in order of their keys, and sorts a text's values;
    path has the keys and, in arrays, the positions. kind is string, number, boolean, null, or object and array
    where these are empty; value is the string itself, or else the JSON. Null texts and malformed ones have no rows,
    what follows a text's first value is not read, and repeated rows are walked each for itself.
    """
    level = _first_level(rows, text, keep, lambda v: v).withColumn("path", F.array().cast("array<string>"))
    done = []
    while not level.isEmpty():
        for _ in range(LEVELS):  # what has no members passes through
            inside = F.col("pos").isNotNull()
            grown = lambda path, step: F.when(inside, F.array_append(path, step)).otherwise(F.col(path)).alias(path)  # noqa: B023, E731
            level = _opened(level.select(*keep, "at", "path", "v"))
            level = level.select(*keep, grown("at", F.col("pos")), grown("path", F.coalesce("key", F.col("pos").cast("string"))), (~inside).alias("ends"), F.coalesce("value", "v").alias("v"))
        below = written(level)
        done.append(below.filter("ends").drop("ends"))
        level = below.filter("not ends").drop("ends")
    found = reduce(DataFrame.unionByName, done) if done else level
    json = F.to_json("v")
    kinds = {'"': "string", "{": "object", "[": "array", "t": "boolean", "f": "boolean", "n": "null"}
    first = F.substring(json, 1, 1)
    kind = reduce(lambda out, k: F.when(first == k, F.lit(kinds[k])).otherwise(out), kinds, F.lit("number"))
    return found.select(*keep, "at", "path", kind.alias("kind"), F.when(first == '"', F.variant_get("v", "$", "string")).otherwise(json).alias("value"))


def strings(rows: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Rows (keep…, at, value) of all string values in JSON texts."""
    return leaves(rows, text, keep).filter("kind = 'string'").select(*keep, "at", "value")


def tree_items(rows: DataFrame, text: str, keep: list[str], root: str, children: str, items: str) -> DataFrame:
    """Rows (keep…, at, item) of the items of all nodes of trees in JSON texts, item as JSON.

    root is the path of the list of top nodes; each node may have a list of nodes under the name children and a list
    of items under the name items. What is no list where one is due has nothing in it. at sorts a text's items depth
    first, a node's own before those of its children.
    """
    under = lambda v, name: F.try_variant_get(v, f"$.{name}", "variant")
    level = _first_level(rows, text, keep, lambda v: under(v, root))
    found = []
    while not level.isEmpty():
        nodes = _opened(level).filter("pos is not null and key is null").select(*keep, F.array_append("at", F.col("pos")).alias("at"), "value")
        nodes = written(nodes.select(*keep, "at", under("value", items).alias("items"), under("value", children).alias("v")))
        own = _opened(nodes.filter("items is not null"), "items").filter("pos is not null and key is null")
        found.append(own.select(*keep, F.concat("at", F.array(F.lit(-1), F.col("pos"))).alias("at"), F.to_json("value").alias("item")))
        level = nodes.filter("v is not null")
    return reduce(DataFrame.unionByName, found) if found else level.select(*keep, "at", F.lit("").alias("item"))
