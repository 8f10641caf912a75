"""Vector codes: each part of a vector becomes the number of the nearest of a few entries (product quantisation).

Vectors are cut into equal parts, each with a codebook of its own that is refined by rounds of assigning and averaging,
all in whole numbers. Assigning is an exponion search: it starts at a part's previous entry a and looks only at entries
within twice the distance to a, along a's list of entries in order of distance; by the triangle inequality no other
entry can be as near. A codebook's size does not depend on the data, so it is what tasks are given; each round reads
the vectors with their codes from a table that the round before wrote.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: A component x counts as floor(SCALE * x), held between -LIMIT and LIMIT so that sums and squares fit 64 bits.
SCALE, LIMIT = 256, 1 << 24
#: Parts of so many vectors are compared at once.
CHUNK = 1024
#: Shares of each label's rows when totals are joined to them.
SALT = 16


def neighbour_lists(book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each entry: all entries in order of squared distance from it (itself among the first), and these distances."""
    apart = ((book[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
    order = np.argsort(apart, axis=1, kind="stable")
    return order, np.take_along_axis(apart, order, axis=1)


def nearest_entries(x: np.ndarray, book: np.ndarray, lists: tuple[np.ndarray, np.ndarray], start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of x (n, width) the nearest entry of book, ties to the lower number, and its squared distance.

    start has each row's previous entry. An entry c with |x - c| <= |x - a| has |a - c| <= 2 |x - a|, so of a's list
    only the head with squared distances up to 4 |x - a|^2 is compared, which ties cannot leave either.
    """
    order, apart = lists
    radius = 4 * ((x - book[start]) ** 2).sum(axis=1)
    within = np.empty(len(x), dtype=np.int64)
    for a in np.unique(start):
        mine = start == a
        within[mine] = np.searchsorted(apart[a], radius[mine], side="right")
    ends = np.cumsum(within)
    begins = ends - within
    row = np.repeat(np.arange(len(x)), within)
    entry = order[start[row], np.arange(len(row)) - begins[row]]
    d = ((x[row] - book[entry]) ** 2).sum(axis=1)
    best = np.minimum.reduceat(d, begins)
    code = np.minimum.reduceat(np.where(d == best[row], entry, len(book)), begins)
    return code, best


def assign(x: np.ndarray, books: np.ndarray, lists: list, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n, parts) of vectors x (n, parts, width), starting from codes, and the sum of each row's squared distances."""
    out, error = np.empty_like(codes), np.zeros(len(x), dtype=np.int64)
    for at in range(0, len(x), CHUNK):
        rows = slice(at, at + CHUNK)
        for p in range(books.shape[0]):
            out[rows, p], d = nearest_entries(x[rows, p], books[p], lists[p], codes[rows, p].astype(np.int64))
            error[rows] += d
    return out, error


def _matrix(column: pa.Array, shape: tuple[int, ...]) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, *shape)


def _assigned(rows: DataFrame, books: np.ndarray, fresh: bool) -> DataFrame:
    """rows with code and error by the nearest entries; fresh rows have no code yet and start at entry 0."""
    parts, _, width = books.shape
    kind = rows.schema["id"].dataType.simpleString(), rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = [neighbour_lists(b) for b in books]
        for batch in batches:
            x = _matrix(batch.column("q"), (parts, width)).astype(np.int64)
            before = np.zeros((len(x), parts), dtype=np.int32) if fresh else _matrix(batch.column("code"), (parts,))
            code, error = assign(x, books, lists, before)
            made = pa.ListArray.from_arrays(pa.array(np.arange(0, code.size + 1, parts), pa.int32()), pa.array(code.reshape(-1), pa.int32()))
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "label": batch.column("label"), "q": batch.column("q"), "code": made, "error": pa.array(error)})

    return rows.mapInArrow(run, f"id {kind[0]}, label {kind[1]}, q array<int>, code array<int>, error long")


def _averaged(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Books of which each entry is the floor of the mean of its parts; entries without parts stay.

    Each task adds up what it has read, one row an entry, and Spark adds these up: parts * entries rows whatever there is.
    """
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts * entries, width), dtype=np.int64), np.zeros(parts * entries, dtype=np.int64)
        for batch in batches:
            x, code = _matrix(batch.column("q"), (width,)), _matrix(batch.column("code"), (parts,))
            key = (np.arange(parts) * entries + code).reshape(-1)
            for k in range(width):
                np.add.at(total[:, k], key, x[:, k].astype(np.int64))
            count += np.bincount(key, minlength=parts * entries)
        used = np.flatnonzero(count)
        sums = pa.ListArray.from_arrays(pa.array(np.arange(0, len(used) * width + 1, width), pa.int32()), pa.array(total[used].reshape(-1)))
        yield pa.RecordBatch.from_pydict({"key": pa.array(used), "n": pa.array(count[used]), "total": sums})

    each = rows.select("q", "code").mapInArrow(run, "key long, n long, total array<long>")
    sums = each.groupBy("key").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[k]).alias(f"s{k}") for k in range(width)])
    out = books.copy().reshape(parts * entries, width)
    for r in sums.collect():
        out[r["key"]] = [r[f"s{k}"] // r["n"] for k in range(width)]
    return out.reshape(books.shape)


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, as decimals joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Rows (id, label, code, error) and the codebooks (parts, entries, width) that code is made by.

    Rows whose vector is null or has a null or non-finite component are left out. Each codebook starts as that part of
    the vectors of smallest id (of equal ids, the smaller vector first; a null id last). The first of these gives the length of a
    vector, the first one that parts divides; a vector of another length keeps its row with null code and error.
    Repeated rows are vectors of their own. With fewer vectors than entries the codebooks are smaller, and an empty table
    gives no rows and no entries. Components beyond LIMIT / SCALE count as that. Other columns are not read.
    """
    v = F.col(vector_col)
    sound = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = lambda x: F.least(F.greatest(F.floor(x.cast("double") * SCALE), F.lit(-LIMIT)), F.lit(LIMIT)).cast("int")
    kept = vectors.filter(sound).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.transform(v, whole).alias("q"))
    smallest = [F.col("id").asc_nulls_last(), F.col("q").asc()]
    fits = (F.size("q") > 0) & (F.size("q") % parts == 0)
    first = kept.filter(fits).select(F.size("q").alias("n"), "id", "q").orderBy(*smallest).limit(1).collect()
    length = first[0]["n"] if first else parts
    starts = [r["q"] for r in kept.filter(F.size("q") == length).select("id", "q").orderBy(*smallest).limit(entries).select("q").collect()]
    books = np.array(starts, dtype=np.int64).reshape(len(starts), parts, length // parts).transpose(1, 0, 2)

    rows, fresh = kept.filter(F.size("q") == length), True
    for _ in range(rounds):
        rows, fresh = cut(_assigned(rows, books, fresh)), False
        books = _averaged(rows, books)
    done = _assigned(rows, books, fresh).select("id", "label", "code", "error")
    odd = kept.filter(F.size("q") != length).select("id", "label", F.lit(None).cast("array<int>").alias("code"), F.lit(None).cast("long").alias("error"))
    return cut(done.unionByName(odd)), books


def with_label_errors(rows: DataFrame) -> DataFrame:
    """rows with label_error, the sum of error over rows of the same label; rows without label are one label.

    Totals are as many as labels; each is joined to SALT shares of its rows, so no label's rows meet in one task.
    """
    totals = rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    shares = rows.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALT)).cast("int"))
    same = shares["label"].eqNullSafe(totals["label"]) & (shares["salt"] == totals["salt"])
    return shares.join(totals, same, "left").select(shares["id"], shares["label"], "code", "error", "label_error")
