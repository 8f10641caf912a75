"""Suffix-array deduplication: bytes under a string of WINDOW bytes that also starts in an earlier document are removed.

Shards of documents build Burrows-Wheeler transforms, and these are merged by refining their interleave: suffixes that
are in order by d bytes are brought in order by d + 2 by a stable sort of the symbols before them, read from the shards'
transforms alone. After WINDOW / 2 rounds the block borders are where common prefixes of neighbours fall short of WINDOW,
so blocks are the repeated intervals, and no suffix of any shard is compared or sorted again.

What makes this affordable is that only text that can repeat is transformed. Every string of WINDOW bytes is named by
the least hash among its k-byte substrings; equal strings have equal names. A first pass finds the names that two
documents share, most names being unique. Neighbouring strings with one name overlap and form one stretch of at most
WINDOW + 31 bytes; stretches of shared names are transformed, in buckets by name, so equal strings meet in one bucket.
Hashes only name: a name that different strings share brings them together and decides nothing. Of stretches of a shard
with the same bytes, known by their 128-bit BLAKE2 digests, one stands for all, the one of the least id; the shard's
other copies are repeats of it as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut

WINDOW = 50
SEED_BYTES = 20
#: Starts in a stretch: they fit the bits of one number.
STRETCH = 32
#: Text of a shard, and names in a bucket, on average.
SHARD_BYTES, BUCKET_NAMES = 8 << 20, 125_000
#: Bytes hashed at once, and stretches unpacked at once: their arrays stay in a core's cache.
PIECE, CHUNK = 1 << 17, 1 << 13
LAST = np.iinfo(np.int64).max

_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2 ** 64, at least n of each."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS.clear()
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(max(n, PIECE * 2), base, dtype=np.uint64)
            p[0] = 1
            _POWERS.append(np.cumprod(p, dtype=np.uint64))
    return _POWERS


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Stretches:
    """The stretches of some documents: name, document, start in it, and number of starts."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        parts = [self._of(d, pieces) for d, pieces in self._pieces()]
        self.name, self.doc, self.at, self.starts = (np.concatenate(x) if parts else np.zeros(0, np.int64) for x in (zip(*parts, strict=True) if parts else [()] * 4))
        if not parts:
            self.name = np.zeros(0, np.uint64)

    def strings(self, which: np.ndarray) -> Iterator[bytes]:
        """The bytes of some stretches."""
        texts = self.texts
        for d, at, n in zip(self.doc[which].tolist(), self.at[which].tolist(), self.starts[which].tolist(), strict=True):
            yield texts[d][at : at + n + WINDOW - 1]

    def _pieces(self) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int]]]]:
        """Bytes of about PIECE, with (document, its offset, length) of what they are made of; long documents are cut with an overlap."""
        held: list[tuple[int, int, int]] = []
        size = 0
        for d, text in enumerate(self.texts):
            for at in range(0, max(1, len(text) - WINDOW + 1), PIECE):
                n = min(len(text) - at, PIECE + WINDOW - 1)
                if n < WINDOW:
                    continue
                held.append((d, at, n))
                size += n
                if size >= PIECE:
                    yield self._joined(held)
                    held, size = [], 0
        if held:
            yield self._joined(held)

    def _joined(self, held):
        return np.frombuffer(b"".join(self.texts[d][at : at + n] for d, at, n in held), dtype=np.uint8), held

    @staticmethod
    def _of(data: np.ndarray, held: list[tuple[int, int, int]]):
        n = len(data)
        power, inverse = _powers(n + 1)
        sums = np.empty(n + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], dtype=np.uint64, out=sums[1:])
        least = _mixed((sums[SEED_BYTES:] - sums[:-SEED_BYTES]) * inverse[: n - SEED_BYTES + 1])
        width, done = WINDOW - SEED_BYTES + 1, 1
        while done < width:
            step = min(done, width - done)
            least = np.minimum(least[:-step], least[step:])
            done += step
        lengths = np.array([x[2] for x in held])
        begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        owner = np.repeat(np.arange(len(held)), lengths)[: n - WINDOW + 1]
        place = np.arange(n - WINDOW + 1) - begins[owner]
        inside = place <= lengths[owner] - WINDOW
        border = np.empty(len(least), dtype=bool)
        border[0] = True
        border[1:] = (least[1:] != least[:-1]) | (inside[1:] != inside[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(border)
        runs = np.diff(np.concatenate([first, [len(least)]]))
        kept = inside[first]
        first, runs = first[kept], runs[kept]
        pieces = -(-runs // STRETCH)
        which = np.repeat(np.arange(len(first)), pieces)
        offset = (np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * STRETCH
        start = first[which] + offset
        starts = np.minimum(STRETCH, runs[which] - offset)
        mine = np.array(held, dtype=np.int64)[owner[start]]
        return least[start], mine[:, 0], mine[:, 1] + place[start], starts.astype(np.int64)


def transform(strings: list[bytes]) -> bytes:
    """The Burrows-Wheeler transform of strings, as little-endian 16-bit symbols: a byte plus 1, or 0 before a string's start.

    Suffixes are sorted by doubling: ranks by d symbols give ranks by 2 d, until all differ. Equal suffixes that
    run to their strings' ends stand in order of the strings. A suffix without equals has its place and is not sorted again.
    Sort keys hold the position in their low bits, so that plain sorts of numbers do.
    """
    lengths = np.array([len(s) + 1 for s in strings])
    ends = np.cumsum(lengths)
    n = int(ends[-1])
    symbols = np.zeros(n, dtype=np.int64)
    symbols[:] = np.frombuffer(b"\0".join(strings) + b"\0", dtype=np.uint8)
    symbols += 1
    symbols[ends - 1] = 0
    to_end = np.repeat(ends, lengths) - np.arange(n)
    # as many symbols at once as fit beside a position, numbered anew as few of them occur
    number = np.cumsum(np.bincount(symbols, minlength=257) > 0) - 1
    bits, width = max(1, n.bit_length()), max(1, int(number[-1]).bit_length())
    done = max(1, (63 - bits) // width)
    dense = np.concatenate([number[symbols], np.zeros(done, dtype=np.int64)])
    key = dense[:n].copy()
    for k in range(1, done):
        key = key << width | np.where(to_end > k, dense[k : n + k], 0)
    order = np.empty(n, dtype=np.int64)
    rank = np.zeros(n + 1, dtype=np.int64)  # place of the first of a suffix's equals so far, plus 1; 0 beyond the end
    places = open_ = np.arange(n)  # places that are not settled yet, and the suffixes there
    while len(places):
        if key.max() < 1 << (63 - bits):
            key = np.sort(key << bits | np.arange(len(key)))
            by_key = key & ((1 << bits) - 1)
            key >>= bits
        else:
            by_key = np.argsort(key, kind="stable")
            key = key[by_key]
        open_ = open_[by_key]
        order[places] = open_
        border = np.ones(len(key) + 1, dtype=bool)
        border[1:-1] = (key[1:] != key[:-1]) | (to_end[open_[1:]] <= done)
        first = np.flatnonzero(border[:-1])
        rank[open_] = np.repeat(places[first] + 1, np.diff(np.append(first, len(key))))
        go_on = ~(border[:-1] & border[1:])
        places = places[go_on]
        open_ = open_[go_on]
        ahead = np.where(to_end[open_] > done, rank[np.minimum(open_ + done, n)], 0)
        key = rank[open_] * (n + 2) + ahead
        done *= 2
    before = np.where(order > 0, symbols[order - 1], 0)
    return before.astype("<u2").tobytes()


def merge_transforms(transforms: list[np.ndarray], counts: list[int], depth: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Repeated intervals of depth symbols over all shards: arrays (string, offset, block) of the suffixes of at least depth symbols, in order, and the strings' lengths.

    Strings are numbered over all shards; transforms[i] has counts[i] of them. Suffixes with one block have a common
    prefix of depth symbols. depth must be even.
    """
    symbol = np.concatenate(transforms).astype(np.int32)
    bases = np.concatenate([[0], np.cumsum([len(t) for t in transforms])[:-1]])
    previous = np.empty(len(symbol), dtype=np.int32)  # of the suffix x in order: where the suffix with one more symbol stands
    for t, base in zip(transforms, bases, strict=True):
        previous[base + np.argsort(t, kind="stable")] = base + np.arange(len(t))

    # walking back from the terminators, which stand first and in order of the strings, places every suffix
    place = np.empty(len(symbol), dtype=np.int64)  # string and distance from its end
    back = previous.astype(np.int64) << 16 | symbol
    x = np.concatenate([base + np.arange(c) for base, c in zip(bases, counts, strict=True)])
    s, k = np.arange(len(x)), 0
    lengths = np.zeros(len(x), dtype=np.int64)
    while len(x):
        place[x] = s << 16 | k
        step = back[x]
        inside = (step & 0xFFFF) != 0
        lengths[s[~inside]] = k
        x, s, k = step[inside] >> 16, s[inside], k + 1

    # the interleave, refined by two symbols a round, and only of suffixes that end as ones of at least depth symbols:
    # these begin depth symbols further on, all in one block, and every round takes them two symbols back
    string = place >> 16
    order = np.flatnonzero(lengths[string] - (place & 0xFFFF) >= depth)
    del string
    # of each suffix: where the one with two more symbols stands, and these two; one look-up a round
    back = previous[previous].astype(np.int64) << 16 | (symbol[previous] - 1 & 0xFF) << 8 | (symbol - 1 & 0xFF)
    block = np.zeros(len(order), dtype=np.int32)
    for _ in range(depth // 2):
        step = back[order]
        pair = (step & 0xFFFF).astype(np.uint16)
        by_symbol = np.argsort(pair, kind="stable")
        pair, block, order = pair[by_symbol], block[by_symbol], (step >> 16)[by_symbol]
        border = np.ones(len(order) + 1, dtype=bool)
        border[1:-1] = (pair[1:] != pair[:-1]) | (block[1:] != block[:-1])
        # a suffix alone in its block stays alone, and so do those that begin before it
        go_on = ~(border[:-1] & border[1:])
        block = np.cumsum(border[:-1], dtype=np.int32)[go_on]
        order = order[go_on]
    string = place[order] >> 16
    return string, lengths[string] - (place[order] & 0xFFFF), block, lengths


def packed(transformed: bytes) -> bytes:
    """A transform as it is shuffled: one byte a symbol, and 255, which UTF-8 does not have, for the place before a string's start; its length, then Zstandard, as transforms have runs."""
    data = (np.frombuffer(transformed, "<u2") - np.uint16(1)).astype(np.uint8).tobytes()
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    plain = pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    return (np.frombuffer(plain, np.uint8) + np.uint8(1)).astype(np.uint16)


def _rows(schema: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def _encoded(texts: pa.Array | pa.ChunkedArray) -> list[bytes]:
    return [(t or "").encode("utf-8") for t in texts.to_pylist()]


def _grouped(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Positions of each key, in order."""
    if not len(keys):
        return
    order = np.argsort(keys, kind="stable")
    values, first = np.unique(keys[order], return_index=True)
    for value, part in zip(values.tolist(), np.split(order, first[1:]), strict=True):
        yield value, part


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, n_bytes, n_removed, n_spans, kept (binary), spans (array of start, end in bytes).

    A byte is removed when a string of WINDOW bytes covers it that also starts in a document of smaller id. Ids are
    integers; a null id counts as larger than all others, and rows of one id as one document. A null text is empty.
    Texts under WINDOW bytes stay whole. An empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_shards = max(4, -(-total // SHARD_BYTES))
    n_buckets = max(4, -(-total // (BUCKET_NAMES * 16)))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "id"), F.lit(n_shards)))

    name_rows = "bucket long, tags binary, shards binary"
    shared_rows = "shard long, kind int, bucket long, data binary"
    block_rows = "bucket long, shard long, transform binary, ids binary"
    out_rows = "id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start: long, end: long>>"
    name_schema, shared_schema, block_schema, out_schema = map(_rows, (name_rows, shared_rows, block_rows, out_rows))

    def tags(name: np.ndarray) -> np.ndarray:
        """A bucket and 32 more bits of a name: what a bucket's names are told apart by. Names with one tag count as one."""
        return (name % np.uint64(n_buckets)) << np.uint64(32) | name >> np.uint64(32)

    def name_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in pa.table(batch).to_batches(max_chunksize=2000)):
            found = Stretches(_encoded(part.column("text")))
            tag, shard, n = _occurrences(tags(found.name), found.doc, part.column("shard").to_numpy(zero_copy_only=False))
            out = [{"bucket": b, "tags": tag[p].astype(np.uint32).tobytes(), "shards": (shard[p] << 1 | (n[p] > 1)).astype(np.uint32).tobytes()} for b, p in _grouped((tag >> np.uint64(32)).astype(np.int64))]
            yield pa.RecordBatch.from_pylist(out, name_schema)

    def shared_names(table: pa.Table) -> pa.Table:
        tag = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("tags").to_pylist()])
        shard = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("shards").to_pylist()])
        order = np.argsort(tag, kind="stable")
        tag, shard = tag[order], shard[order]
        same = tag[1:] == tag[:-1]
        twice = np.concatenate([same, [False]]) | np.concatenate([[False], same]) | (shard & 1 == 1)
        tag, shard = tag[twice], shard[twice] >> 1
        bucket = table.column("bucket")[0].as_py()
        out = [{"shard": s, "kind": 0, "bucket": bucket, "data": (np.unique(tag[p]).astype(np.uint64) | np.uint64(bucket << 32)).tobytes()} for s, p in _grouped(shard.astype(np.int64))]
        return pa.Table.from_pylist(out, shared_schema)

    shared = cut(rows.mapInArrow(name_pass, name_rows).groupBy("bucket").applyInArrow(shared_names, shared_rows))

    def shared_stretches(docs_part: pa.Table, answers: pa.Table):
        """The shard's stretches of shared names; of these the distinct ones by bucket and content, their least id, and what each stretch is of them."""
        texts = _encoded(docs_part.column("text"))
        ids = np.array([LAST if i is None else i for i in docs_part.column("id").to_pylist()], dtype=np.int64)
        found = Stretches(texts)
        names = [np.frombuffer(x["data"], np.uint64) for x in answers.to_pylist() if x["kind"] == 0]
        known = np.sort(np.concatenate(names)) if names else np.zeros(0, np.uint64)
        own = tags(found.name)
        at = np.minimum(np.searchsorted(known, own), max(0, len(known) - 1))
        pick = np.flatnonzero(known[at] == own) if len(known) else np.zeros(0, np.int64)
        bucket = (found.name[pick] % np.uint64(n_buckets)).astype(np.int64)
        digests = b"".join(blake2b(x, digest_size=16).digest() for x in found.strings(pick))
        low, high = np.frombuffer(digests, np.uint64).reshape(-1, 2).T
        # one sort by bucket and digest, then what little of one key has several digests or ids; equal strings have one bucket
        own_id = ids[found.doc[pick]]
        spare = max(1, n_buckets.bit_length())
        key = bucket.astype(np.uint64) << np.uint64(64 - spare) | low >> np.uint64(spare)
        order = np.argsort(key)
        run = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])]) if len(order) else order
        again = np.flatnonzero(np.bincount(run)[run] > 1) if len(order) else order
        tied = order[again]
        order[again] = tied[np.lexsort((own_id[tied], high[tied], low[tied], run[again]))]
        first = np.ones(len(order), dtype=bool)
        first[1:] = (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1]) | (bucket[order][1:] != bucket[order][:-1])
        number = np.empty(len(order), dtype=np.int64)
        number[order] = np.cumsum(first) - 1
        lead = pick[order[first]]
        return texts, ids, found, pick, number, lead, bucket[order[first]]

    def transform_pass(docs_part: pa.Table, answers: pa.Table) -> pa.Table:
        texts, ids, found, _, _, lead, bucket = shared_stretches(docs_part, answers)
        out = []
        for b, p in _grouped(bucket):
            mine = lead[p]
            out.append({"bucket": b, "shard": docs_part.column("shard")[0].as_py(), "transform": packed(transform([*found.strings(mine)])), "ids": ids[found.doc[mine]].tobytes()})
        return pa.Table.from_pylist(out, block_schema)

    def merge_pass(table: pa.Table) -> pa.Table:
        blocks = sorted(table.to_pylist(), key=lambda r: r["shard"])
        ids = [np.frombuffer(r["ids"], np.int64) for r in blocks]
        string, offset, block, lengths = merge_transforms([unpacked(r["transform"]) for r in blocks], [len(i) for i in ids])
        own = np.concatenate(ids)
        mask = np.zeros(len(own), dtype=np.uint32)
        if len(string):
            first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            least = np.repeat(np.minimum.reduceat(own[string], first), np.diff(np.concatenate([first, [len(block)]])))
            hit = least < own[string]
            np.bitwise_or.at(mask, string[hit], np.uint32(1) << offset[hit].astype(np.uint32))
        parts = np.split(mask, np.cumsum([len(i) for i in ids])[:-1])
        return pa.Table.from_pylist([{"shard": r["shard"], "kind": 1, "bucket": r["bucket"], "data": m.tobytes()} for r, m in zip(blocks, parts, strict=True)], shared_schema)

    by_shard = rows.groupBy("shard")
    transforms = by_shard.cogroup(shared.groupBy("shard")).applyInArrow(transform_pass, block_rows)
    masks = cut(transforms.groupBy("bucket").applyInArrow(merge_pass, shared_rows))

    def remove_pass(docs_part: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs_part.num_rows:
            return pa.Table.from_pylist([], out_schema)
        texts, ids, found, pick, number, lead, _ = shared_stretches(docs_part, answers)
        found_masks = {x["bucket"]: np.frombuffer(x["data"], np.uint32) for x in answers.to_pylist() if x["kind"] == 1}
        mask = np.concatenate([found_masks[b] for b in sorted(found_masks)]) if found_masks else np.zeros(0, np.uint32)
        begins = np.cumsum([0, *map(len, texts)])
        starts = np.zeros(begins[-1] + 1, dtype=bool)
        for at in range(0, len(pick), CHUNK):
            mine, which = pick[at : at + CHUNK], number[at : at + CHUNK]
            full = ids[found.doc[mine]] > ids[found.doc[lead[which]]]
            bits = np.where(full, np.uint32(0xFFFFFFFF), mask[which])
            hits = (bits[:, None] >> np.arange(STRETCH, dtype=np.uint32) & 1).astype(bool) & (np.arange(STRETCH) < found.starts[mine][:, None])
            row, shift = np.nonzero(hits)
            starts[(begins[found.doc[mine]] + found.at[mine])[row] + shift] = True
        first, last, owner = spans_of(np.flatnonzero(starts), begins)
        edges = np.searchsorted(owner, np.arange(len(texts) + 1))
        out = []
        for d, (a, b, text) in enumerate(zip(edges, edges[1:], texts, strict=False)):
            spans = list(zip((first[a:b] - begins[d]).tolist(), (last[a:b] - begins[d]).tolist(), strict=True))
            borders = [0, *(x for span in spans for x in span), len(text)]
            kept = b"".join(text[i:j] for i, j in zip(borders[::2], borders[1::2], strict=True)) if spans else text
            out.append((len(text), len(text) - len(kept), len(spans), kept, [{"start": i, "end": j} for i, j in spans]))
        columns = list(zip(*out, strict=True))
        return pa.table([docs_part.column("id"), *(pa.array(c, t) for c, t in zip(columns, out_schema.types[1:], strict=True))], names=out_schema.names).cast(out_schema)

    answers = shared.unionByName(masks)
    return by_shard.cogroup(answers.groupBy("shard")).applyInArrow(remove_pass, out_rows).withColumnRenamed("id", id_col)


def _occurrences(tag: np.ndarray, doc: np.ndarray, shard_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (tag, shard) of some stretches, in order, and in how many documents of these each occurs."""
    order = np.lexsort((doc, shard_of[doc], tag))
    tag, doc = tag[order], doc[order]
    new = np.ones(len(tag), dtype=bool)
    new[1:] = (tag[1:] != tag[:-1]) | (doc[1:] != doc[:-1])
    tag, shard = tag[new], shard_of[doc[new]]
    first = np.ones(len(tag), dtype=bool)
    first[1:] = (tag[1:] != tag[:-1]) | (shard[1:] != shard[:-1])
    at = np.flatnonzero(first)
    return tag[at], shard[at], np.diff(np.concatenate([at, [len(tag)]]))


def spans_of(starts: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs (start, end, document) of the bytes that strings at these sorted starts cover, in documents that begin at begins, one after the other."""
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none
    owner = np.searchsorted(begins, starts, side="right") - 1
    new = np.flatnonzero(np.concatenate([[True], (starts[1:] > starts[:-1] + WINDOW) | (owner[1:] != owner[:-1])]))
    last = np.concatenate([new[1:], [len(starts)]]) - 1
    return starts[new], starts[last] + WINDOW, owner[new]
