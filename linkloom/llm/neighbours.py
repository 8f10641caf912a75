"""Approximate nearest neighbours by cosine: a vantage-point tree for each shard of the vectors.

Vectors of length one have distances whose order is that of the cosine, and these obey the triangle inequality. A node
of a tree has a vantage point, the near half of its other vectors and the far half; a half is passed over when its least
possible distance, times the relaxing factor, is beyond the farthest of the neighbours found so far. Factor one passes
over nothing that could count, so the search is exact then.

Shards are equal slices of the rows, whatever their ids or values. Queries are dealt into blocks, each block meets each
shard's tree in a task of its own, and of what shards find the nearest stay.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut

#: Vectors of a shard, and queries of a block.
SHARD_ROWS, BLOCK_ROWS = 16_384, 16_384
#: Vectors of a leaf, which are compared with all queries that get there.
LEAF_ROWS = 64
#: Least possible distances are taken so many times; measured recall is in the README.
FACTOR = 5.0
#: Found beside the neighbours asked for: the query itself, and some whose last bits may change places.
SPARE = 3
#: Distances of unit vectors are right to far less than this.
SLACK = 1e-7
CHUNK = 2048
INDEX_SCHEMA = "shard long, dim int, tree binary"


def exact_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of a and of b, both doubles; the same two rows give the same bits wherever they stand.

    Rows are scaled by powers of two first, which changes no bit of the result but keeps squares from running out of range.
    """
    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) for x in (a, b))
    dot = lambda x, y: np.ascontiguousarray(x * y).sum(axis=1)
    return dot(a, b) / np.sqrt(dot(a, a) * dot(b, b))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine))


class Tree:
    """A vantage-point tree over distinct vectors, laid out in one array.

    The vectors from lo to hi are a node; from LEAF_ROWS on the one at lo is its vantage point, the nearer half of the
    others follows and then the farther half. bounds[lo] has the greatest distance of the near half and the least of
    the far half. ids has, of each vector, its rows' least ids, as many as can be among the neighbours of any query.
    """

    def __init__(self, vectors: np.ndarray, ids: list[np.ndarray], keep: int):
        values, owner = np.unique(vectors, axis=0, return_inverse=True)
        owner = owner.reshape(-1)
        every = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int64)
        order = np.lexsort((every, owner))
        owner, every = owner[order], every[order]
        new = np.r_[True, (owner[1:] != owner[:-1]) | (every[1:] != every[:-1])]
        owner, every = owner[new], every[new]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        owner, every = owner[place < keep], every[place < keep]
        self.values = values
        self.unit = unit(values)
        self.at = np.arange(len(values))
        self.bounds = np.zeros((len(values), 2))
        self._split(0, len(values))
        self.values, self.unit = self.values[self.at], self.unit[self.at]
        first = np.searchsorted(owner, np.arange(len(values) + 1))
        counts = np.diff(first)[self.at]
        self.first = np.r_[0, np.cumsum(counts)]
        self.ids = every[np.repeat(first[:-1][self.at] - self.first[:-1], counts) + np.arange(self.first[-1])]

    def _split(self, lo: int, hi: int) -> None:
        stack = [(lo, hi)]
        while stack:
            lo, hi = stack.pop()
            if hi - lo <= LEAF_ROWS:
                continue
            rows = self.at[lo:hi]
            edge = rows[np.argmin(self.unit[rows] @ self.unit[rows[0]])]  # far out, where distances spread most
            rows = np.r_[edge, rows[rows != edge]]
            d = _distance(self.unit[rows[1:]] @ self.unit[edge])
            order = np.argsort(d, kind="stable")
            self.at[lo:hi] = np.r_[edge, rows[1:][order]]
            near = len(order) // 2
            self.bounds[lo] = d[order[near - 1]], d[order[near]]
            stack += [(lo + 1, lo + 1 + near), (lo + 1 + near, hi)]

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, values=self.values, bounds=self.bounds, first=self.first, ids=self.ids)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, stored: bytes) -> Tree:
        made = cls.__new__(cls)
        with np.load(io.BytesIO(stored)) as f:
            made.values, made.bounds, made.first, made.ids = (f[c] for c in ("values", "bounds", "first", "ids"))
        made.unit = unit(made.values)
        return made

    def search(self, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Of each unit vector of queries the places of its k nearest vectors and their distances, in no order.

        Each query goes down to the leaf that it would be in first, which gives it a radius; then all queries go over
        the tree together, and a half is entered by those whose radius it can reach.
        """
        n = len(queries)
        self.place, self.d = np.full((n, k), -1), np.full((n, k), np.inf)
        self.home = np.full(n, -1)
        stack = [(0, len(self.unit), np.arange(n))]
        while stack:
            lo, hi, mine = stack.pop()
            if hi - lo <= LEAF_ROWS:
                self.home[mine] = lo
                self._leaf(lo, hi, queries, mine)
                continue
            d = _distance(queries[mine] @ self.unit[lo])
            near = d <= self.bounds[lo].mean()
            mid = lo + 1 + (hi - lo - 1) // 2
            stack += [(a, b, mine[s]) for a, b, s in ((lo + 1, mid, near), (mid, hi, ~near)) if s.any()]
        stack = [(0, len(self.unit), np.arange(n))]
        while stack:
            lo, hi, mine = stack.pop()
            if hi - lo <= LEAF_ROWS:
                self._leaf(lo, hi, queries, mine[self.home[mine] != lo])
                continue
            d = _distance(queries[mine] @ self.unit[lo])
            self._merge(mine, np.full((len(mine), 1), lo), d[:, None])
            radius = self.d[mine].max(axis=1) + SLACK
            mid = lo + 1 + (hi - lo - 1) // 2
            reach_near = (d - self.bounds[lo, 0]) * factor <= radius
            reach_far = (self.bounds[lo, 1] - d) * factor <= radius
            stack += [(a, b, mine[s]) for a, b, s in ((mid, hi, reach_far), (lo + 1, mid, reach_near)) if s.any()]
        return self.place, self.d

    def _leaf(self, lo: int, hi: int, queries: np.ndarray, mine: np.ndarray) -> None:
        for at in range(0, len(mine), CHUNK):
            part = mine[at : at + CHUNK]
            d = _distance(queries[part] @ self.unit[lo:hi].T)
            self._merge(part, np.broadcast_to(np.arange(lo, hi), d.shape), d)

    def _merge(self, mine: np.ndarray, places: np.ndarray, d: np.ndarray) -> None:
        k = self.d.shape[1]
        both, at = np.concatenate([self.d[mine], d], axis=1), np.concatenate([self.place[mine], places], axis=1)
        best = np.argpartition(both, k - 1, axis=1)[:, :k]
        self.d[mine], self.place[mine] = np.take_along_axis(both, best, axis=1), np.take_along_axis(at, best, axis=1)


def usable(vector: Column) -> Column:
    """Whether vector has a direction: no null or non-finite component, and not zero."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vector, lambda x: x != 0)


def _table(rows: pa.Table, dim: int, value: str) -> tuple[np.ndarray, np.ndarray]:
    rows = rows.combine_chunks()
    flat = rows.column(value).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return rows.column("id").to_numpy(), flat.astype(np.float64).reshape(-1, dim)


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", keep: int = 6, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Rows (shard, dim, tree): the trees of equal slices of vectors, of each length of vector its own, as a written table.

    Rows without id, and vectors that are not usable, are not in it. keep is how many of the rows of one and the same
    vector may be found; the least ids of them are.
    """
    n_shards = max(1, -(-vectors.count() // shard_rows))
    v = F.col(vector_col)
    rows = vectors.filter(usable(v) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"))
    dealt = rows.repartition(n_shards).select("id", "v", F.size("v").alias("dim"), F.spark_partition_id().alias("shard"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        shard = 0
        for batch in batches:
            whole = pa.Table.from_batches([batch])
            sizes = batch.column("dim").to_numpy()
            shard = batch.column("shard")[0].as_py() if batch.num_rows else shard
            for dim in np.unique(sizes):
                held.setdefault(int(dim), []).append(_table(whole.filter(pa.array(sizes == dim)), int(dim), "v"))
        for dim, parts in held.items():
            tree = Tree(np.concatenate([x for _, x in parts]), [i for i, _ in parts], keep)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "dim": pa.array([dim], pa.int32()), "tree": pa.array([tree.to_bytes()], pa.binary())})

    return cut(dealt.mapInArrow(build, INDEX_SCHEMA))


def nearest(index: DataFrame, queries: DataFrame, k: int = 5, factor: float = FACTOR, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): of each query its k nearest of the index, found with pruning by factor.

    A query's own id is no neighbour of it. Neighbours have the query's length; score is the cosine of the original
    vectors, ties go to the smaller id, and with fewer vectors all are returned. Rows that repeat an id are one query
    (the smallest vector of them) and one neighbour (with its largest score). Queries without id or direction have no
    rows, nor do any if the index is empty. index needs keep > k.
    """
    v = F.col(vector_col)
    asked = queries.filter(usable(v) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(v.cast("array<double>")).alias("v"))
    asked = cut(asked.withColumn("dim", F.size("v")))
    n_blocks = max(1, -(-asked.count() // block_rows))
    shards = index.agg(F.max("shard")).first()[0]
    blocks = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)))
    each_shard = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards or 0).cast("long"))))
    each_block = index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
    keys = ["shard", "dim", "block"]

    def search(trees: pa.Table, block: pa.Table) -> pa.Table:
        found: dict[str, list[np.ndarray]] = {"query_id": [], "vec_id": [], "score": []}
        if block.num_rows:
            ids, values = _table(block, block.column("dim")[0].as_py(), "v")
            for stored in trees.column("tree"):
                tree = Tree.from_bytes(stored.as_py())
                place, _ = tree.search(unit(values), k + SPARE, factor)
                q, slot = np.nonzero(place >= 0)
                at = place[q, slot]
                score = exact_cosine(values[q], tree.values[at])
                n = np.diff(tree.first)[at]
                q, score = np.repeat(q, n), np.repeat(score, n)
                start = np.repeat(tree.first[at] - (np.cumsum(n) - n), n)
                other = tree.ids[start + np.arange(len(q))]
                q, other, score = (x[other != ids[q]] for x in (q, other, score))
                order = np.lexsort((other, -score, q))
                q, other, score = q[order], other[order], score[order]
                best = np.arange(len(q)) - np.searchsorted(q, q) < k
                for c, x in zip(found, (ids[q], other, score), strict=True):
                    found[c].append(x[best])
        join = lambda c, kind: pa.array(np.concatenate(found[c]) if found[c] else [], kind)
        return pa.table({"query_id": join("query_id", pa.int64()), "vec_id": join("vec_id", pa.int64()), "score": join("score", pa.float64())})

    met = each_block.groupBy(*keys).cogroup(each_shard.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score double")
    once = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
