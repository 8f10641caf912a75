"""Near-duplicate documents by an n-gram Jaccard self-join with adaptive multi-match prefixes.

A document is the set of its distinct 5-word shingles, as 128-bit hashes; 64 bits of each, in one order that all documents
share, find candidates, and 96 bits decide. Of two
sets x and y that reach the threshold, the prefixes of |x| - ceil(t |x|) + l and |y| - ceil(t |y|) + l shingles share l
shingles at least, for each l. A longer prefix with a higher l meets more shingles but leaves fewer pairs to verify, so
each document takes the l of least estimated cost from the frequencies of its own prefix shingles.

Any common order is right; the one here puts shingles that a sample finds frequent last, so boilerplate hardly stands in
a prefix. Documents with equal sets are merged before the join. Pairs of a group of near copies are not all formed:
first each document is held against the one in the middle of those it shares prefix shingles with, and what these links
connect is one component; the full join then forms only pairs of different components.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut, may_be_in, small_batches

WORDS = 5
#: The threshold as a fraction, for exact comparisons in integers.
NUMERATOR, DENOMINATOR = 4, 5
LEVELS = 4
#: Cost of verifying a pair, in looked-up prefix entries.
VERIFY_COST = 50
SAMPLE_EVERY, FREQUENT = 32, 50_000
#: Digests of words that a worker remembers.
MEMO = 50_000

#: Bytes of a shingle in a set that is shuffled, 96 bits.
PACKED = 12

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SALT = 0x9E3779B97F4A7C15
_PLACES = np.array([[pow(base, k + 1, 1 << 64) for base in (0xD1342543DE82EF95, 0xDA942042E4DD58B5)] for k in range(64)], dtype=np.uint64)


class _Digests(dict):
    """128-bit digests of words, remembered up to MEMO of them."""

    def __missing__(self, word: bytes) -> bytes:
        digest = blake2b(word, digest_size=16).digest()
        if len(self) < MEMO:
            self[word] = digest
        return digest


_digests = _Digests()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The set of shingles of text, A-Z in lower case, as sorted distinct rows of two 64-bit numbers; under `words` words their sequence is the one shingle.

    The two numbers are independent sums over 128-bit BLAKE2 digests of the words, so different shingles agree in both
    only by chance, whatever the texts. bytes.split() without arguments splits at just the white space of the contract.
    """
    found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not found:
        return np.zeros((0, 2), dtype=np.uint64)
    word = np.frombuffer(b"".join(map(_digests.__getitem__, found)), dtype=np.uint64).reshape(-1, 2)
    size = min(words, len(word))
    n = len(word) - size + 1
    total = np.full((n, 2), size, dtype=np.uint64)
    for k in range(size):
        total += word[k : k + n] * _PLACES[k]
    total = _mixed(total)
    total = total[np.argsort(total[:, 0], kind="stable")]
    same = total[1:, 0] == total[:-1, 0]
    if (same & (total[1:, 1] != total[:-1, 1])).any():
        return np.unique(total, axis=0)
    return total[np.concatenate([[True], ~same])]


def packed(both: np.ndarray) -> bytes:
    """A set as it is shuffled: PACKED bytes a shingle, the first number and the lower half of the second."""
    return both[:, 0].tobytes() + both[:, 1].astype(np.uint32).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    n = len(data) // PACKED
    return np.stack([np.frombuffer(data, np.uint64, n), np.frombuffer(data, np.uint32, n, 8 * n).astype(np.uint64)], axis=1)


def in_common(x: np.ndarray, y: np.ndarray) -> int:
    """How many shingles two sets share."""
    _, i, j = np.intersect1d(x[:, 0], y[:, 0], return_indices=True)
    agree = int((x[i, 1] == y[j, 1]).sum())
    if agree == len(i) and len(np.unique(x[:, 0])) == len(x) and len(np.unique(y[:, 0])) == len(y):
        return agree
    return len({*map(tuple, x.tolist())} & {*map(tuple, y.tolist())})


def _frequent_shingles(rows: DataFrame) -> np.ndarray:
    """At most FREQUENT shingles that a hash sample of the documents repeats, from rare to frequent. They only steer the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text"):
                yield pa.RecordBatch.from_pydict({"shingle": pa.array(shingles(text.as_py())[:, 0].view(np.int64))})

    sample = rows.filter(F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(SAMPLE_EVERY)) == 0).select("text")
    counted = sample.mapInArrow(run, "shingle long").groupBy("shingle").count().filter("count > 2").orderBy(F.desc("count"), "shingle").limit(FREQUENT)
    return np.array([r["shingle"] for r in counted.collect()][::-1], dtype=np.int64)


def _prefixes(rows: DataFrame) -> DataFrame:
    """Rows (id, n, s1, s2, prefix): the set's size, two hashes of it, and the longest prefix, of n // 5 + LEVELS shingles."""
    found = _frequent_shingles(rows)
    by_value = np.argsort(found)
    shared = rows.sparkSession.sparkContext.broadcast((found[by_value], by_value))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, rank = shared.value
        for batch in batches:
            sizes, first, second, prefixes = [], [], [], []
            for text in batch.column("text"):
                both = shingles(text.as_py())
                own = both[:, 0].copy()
                signed = own.view(np.int64)
                size = len(own)
                take = size - -(-NUMERATOR * size // DENOMINATOR) + LEVELS
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, signed), len(frequent) - 1)
                    common = frequent[at] == signed
                    ordered = signed[~common]
                    if len(ordered) < take:
                        late = np.flatnonzero(common)
                        ordered = np.concatenate([ordered, signed[late[np.argsort(rank[at[late]])]]])
                else:
                    ordered = signed
                sizes.append(size)
                first.append(int(own.sum(dtype=np.uint64).view(np.int64)) if size else 0)
                second.append(int(_mixed(both[:, 1] ^ np.uint64(_SALT)).sum(dtype=np.uint64).view(np.int64)) if size else 0)
                prefixes.append(ordered[:take])
            offsets = np.cumsum([0, *map(len, prefixes)])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "n": pa.array(sizes, pa.int64()), "s1": pa.array(first, pa.int64()), "s2": pa.array(second, pa.int64()), "prefix": lists})

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "text").mapInArrow(run, f"id {kind}, n long, s1 long, s2 long, prefix array<long>")


def verified(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold. Sets are built anew, for documents of pairs only."""
    sides = pairs.select(F.col("a").alias("id"), F.lit(True).alias("in_a")).union(pairs.select("b", F.lit(False)))
    ids = cut(sides.groupBy("id").agg(F.max("in_a").alias("in_a"), F.max(~F.col("in_a")).alias("in_b")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                made = {"set": pa.array([packed(shingles(t.as_py())) for t in piece.column("text")], pa.binary())}
                yield pa.RecordBatch.from_pydict({name: piece.column(name) for name in ("id", "in_a", "in_b")} | made)

    kind = rows.schema["id"].dataType.simpleString()
    # a text is shorter than its set, so what has no partner is left out before sets are built
    wanted = may_be_in(rows.select("id", "text"), F.col("id"), ids).join(ids, "id")
    sets = cut(wanted.mapInArrow(run, f"id {kind}, in_a boolean, in_b boolean, set binary"))

    @F.arrow_udf("long")
    def overlap(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([in_common(unpacked(a.as_py()), unpacked(b.as_py())) for a, b in zip(x, y, strict=True)], pa.int64())

    side = lambda name: sets.filter(f"in_{name}").select(F.col("id").alias(name), F.col("set").alias(f"{name}_set"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("common", overlap("a_set", "b_set"))
    union = (F.length("a_set") + F.length("b_set")) / PACKED - F.col("common")
    return both.filter(F.col("common") * DENOMINATOR >= union * NUMERATOR).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Rows (id, root): the least id connected with each id of edges (u, v), roots left out. By large and small stars in turn."""
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = cut(both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        edges = cut(edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).distinct())
        before, state = state, edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))


def _candidates(shared: DataFrame, costs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that share as many prefix shingles as the larger one's level asks for."""
    placed = shared.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")).join(costs, "id")
    mixed = placed.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("shingle")
    placed = cut(placed.join(mixed, "shingle").select("shingle", "id", "n", "at", "root", "chosen"))
    a = placed.select("shingle", *[F.col(c).alias(f"a_{c}") for c in ("id", "n", "at", "root", "chosen")])
    b = placed.select("shingle", *[F.col(c).alias(f"b_{c}") for c in ("id", "n", "at", "root")])
    asked = F.least(F.col("a_chosen"), -F.floor(-F.col("b_n") * NUMERATOR / DENOMINATOR))
    larger = (F.col("b_n") < F.col("a_n")) | ((F.col("b_n") == F.col("a_n")) & (F.col("b_id") < F.col("a_id")))
    fits = larger & (F.col("b_n") * DENOMINATOR >= F.col("a_n") * NUMERATOR) & (F.col("a_root") != F.col("b_root"))
    # sets of these sizes need an overlap that leaves them prefixes shorter than those for any partner
    overlap = -F.floor(-(F.col("a_n") + F.col("b_n")) * NUMERATOR / (NUMERATOR + DENOMINATOR))
    inside = (F.col("a_at") < F.col("a_n") - overlap + asked) & (F.col("b_at") < F.col("b_n") - overlap + asked)
    met = a.join(b, "shingle").filter(fits & inside)
    counted = met.groupBy(F.col("a_id").alias("a"), F.col("b_id").alias("b")).agg(F.count("*").alias("met"), F.max(asked).alias("asked"))
    return counted.filter("met >= asked").select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id (the least id that links reach, its own included).

    Two documents link when their sets' Jaccard similarity is 4/5 or more, which is decided on 96-bit hashes of the whole sets. A text
    without words, or null, has an empty set and links with nothing. Rows that repeat an id are one document in the
    links; a row without id stands alone, with a null component. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    prepared = cut(_prefixes(rows))
    named = prepared.filter("id is not null and n > 0")
    same = named.groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"), F.max("id").alias("last")).filter("rep <> last").drop("last")
    same = cut(same)
    copies = cut(named.select("id", "n", "s1", "s2").join(same, ["n", "s1", "s2"]).select("id", "rep", "n"))
    alone = named.select("id", "n", "prefix").join(copies.filter("id <> rep").select("id"), "id", "left_anti")

    base = F.floor(F.col("n") / DENOMINATOR) + 1
    entries = alone.select("id", "n", F.posexplode("prefix").alias("at", "shingle")).select("id", "n", "shingle", "at")
    repeated = entries.groupBy("shingle").agg(F.count("*").alias("df")).filter("df > 1")
    shared = cut(entries.join(repeated, "shingle").withColumn("level", F.greatest(F.lit(1), F.col("at") - base + 2).cast("int")))

    # the level of least cost: entries looked up, and the pairs that can reach so many matches
    looked_up = [F.sum(F.when(F.col("level") <= k, F.col("df") - 1).otherwise(0)) for k in range(1, LEVELS + 1)]
    cost = F.array(*[F.struct((c * (1 + VERIFY_COST / k)).alias("cost"), F.lit(k).alias("k")) for k, c in enumerate(looked_up, 1)])
    own = F.least(F.array_min(cost)["k"], F.max(-F.floor(-F.col("n") * NUMERATOR / DENOMINATOR)))
    costs = cut(shared.groupBy("id").agg(own.alias("chosen")))

    # star rounds: of the documents with a shingle, the one that shares most of its own prefix stands in the middle of
    # its near copies, which need not be near one another; each document is held against that one and the smallest
    share = shared.groupBy("id").agg((F.count("*") / (F.floor(F.max("n") / DENOMINATOR) + LEVELS)).alias("share"))
    hubs = shared.join(share, "id").groupBy("shingle").agg(F.max(F.struct("share", (-F.col("id")).alias("first"), "id", "n")).alias("middle"), F.min(F.struct("id", "n")).alias("low"))
    ways = F.array(F.struct("middle.id", "middle.n"), F.col("low"))
    held = shared.join(hubs, "shingle").select("id", "n", F.posexplode(ways).alias("way", "met")).select("id", "n", "way", F.col("met.id").alias("hub"), F.col("met.n").alias("hub_n"))
    near = F.least("n", "hub_n") * DENOMINATOR >= F.greatest("n", "hub_n") * NUMERATOR  # other sizes cannot link
    votes = held.filter((F.col("hub") != F.col("id")) & near).groupBy("id", "way", "hub", "n").agg(F.count("*").alias("votes"))
    best = votes.filter(F.col("votes") * 4 >= base).groupBy("id", "way").agg(F.max(F.struct("votes", "hub")).alias("best"))
    edges = cut(verified(rows, cut(best.select(F.col("id").alias("a"), F.col("best.hub").alias("b")).distinct())).select(F.col("a").alias("u"), F.col("b").alias("v")))
    rest = verified(rows, cut(_candidates(shared, costs, components(edges)))).select(F.col("a").alias("u"), F.col("b").alias("v"))
    roots = components(edges.union(rest))

    out = prepared.select("id", "n").join(copies.select(F.col("id"), "n", "rep").distinct(), ["id", "n"], "left").withColumn("rep", F.coalesce("rep", "id"))
    out = out.join(roots.withColumnRenamed("id", "rep"), "rep", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("root", "rep")).otherwise(F.col("id")).alias("component_id"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that link, over others or directly, to a document with a smaller id.

    Rows without id, text or words stay, as do rows that repeat the smallest id of their group. An empty table gives no
    rows; other columns pass through.
    """
    dropped = near_duplicates(docs, id_col, text_col).filter(F.col("component_id") < F.col(id_col)).select(id_col).distinct()
    return docs.join(cut(dropped), id_col, "left_anti")
