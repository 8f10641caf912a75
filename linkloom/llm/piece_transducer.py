"""SentencePiece encoding and decoding as shortest paths in a weighted finite-state transducer.

Three machines are compiled from a vocabulary file: a normaliser (characters to symbols), a lexicon (a trie of pieces
whose final arcs cost minus the piece's score), and a byte fallback (one costly arc a character, which writes the pieces
of its UTF-8 bytes). Composing them with an input gives an acyclic lattice over the input's symbols; its shortest path in
the tropical semiring (costs add along a path, the least path wins) is the encoding of a unigram model.

Scores of a BPE model are ranks of merges and do not add up. Merges start with one arc a symbol; of all neighbours that one
arc of the lexicon spans, those with the cheapest such arc give way to it, the leftmost first, until no two have one. Its path
through the same lattice is the one on which every arc fits after the one before it: merges of the two's symbols leave just
these two. Whether two arcs fit is worked out once and kept with the first one's state, up to a bound.

In no piece does the escaped space follow another symbol or a letter stand next to anything but letters, and digits and some
line characters stand in no piece with others, so every path of the lattice passes through the states at these places, and no
merge spans them. The path is thus the paths of the stretches
between them, one after the other, and stretches seen before are taken from a bounded memo.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import small_batches

#: The escaped space, and where the tokenizer files lie unless a path is given.
SPACE = "▁"
DEFAULT_VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
ALONE = "\n\t\r0123456789"
MEMO, MEMO_CHARS = 100_000, 40
#: Pairs of arcs of which it is remembered whether one fits after the other.
FOLLOWS = 200_000
#: Documents whose ids and texts are held at once.
SLICE = 256
#: What the byte fallback costs above the dearest piece.
FALLBACK_PENALTY = 10.0


class Merges(dict):
    """A lexicon of a BPE model: the costs of its arcs are ranks of merges."""


class Memo(dict):
    """Ids of stretches, as the bytes of 32-bit integers. A full memo becomes the older one, from which what is used comes back."""

    def __init__(self, path: Callable[[str], tuple[int, ...]]):
        self.path, self.older = path, {}

    def __missing__(self, stretch: str) -> bytes:
        ids = self.older.get(stretch)
        if ids is None:
            ids = array("i", self.path(stretch)).tobytes()
        if len(stretch) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.older = dict(self)
                super().clear()
            self[stretch] = ids
        return ids

    def clear(self) -> None:
        self.older = {}
        super().clear()


@dataclass
class PieceTransducer:
    """The compiled machines. root: the lexicon's arcs from its first state, each to (arcs, cost if a piece ends there, its id, length, which
    arcs fit after it, as far as known). follows: which fit at the start. symbols: the normaliser's output of each character that it changes, None to refuse it."""

    root: dict
    symbols: dict[str, str | None]
    byte_ids: list[int]
    fallback_cost: float
    written: list[bytes]
    dummy_prefix: bool
    stretches: re.Pattern | None
    fallback: dict[str, list] = field(default_factory=dict, repr=False)
    follows: dict[int, bool] = field(default_factory=dict, repr=False)
    n_follows: int = 0

    def __post_init__(self):
        self.plain = self.symbols == {" ": SPACE, SPACE: None}
        self.memo = Memo(self.path)
        self.longest, states = 0, [self.root]
        while states := [arc[0] for arcs in states for arc in arcs.values()]:
            self.longest += 1

    def normalise(self, text: str) -> list[tuple[str, str]]:
        """(symbol, character) pairs; an empty symbol stands for a character that only the byte fallback reads."""
        out = []
        for c in text:
            mapped = self.symbols.get(c, c)
            out += [(s, c) for s in mapped] if mapped else [("", c)]
        return out

    def path(self, text: str) -> tuple[int, ...]:
        """Ids on the path that the model takes through the lattice of text."""
        if self.plain and SPACE not in text:
            tape, read = text.replace(" ", SPACE), text
        else:
            pairs = self.normalise(text)
            tape, read = [symbol for symbol, _ in pairs], [c for _, c in pairs]
        return self.merged_path(tape, read) if isinstance(self.root, Merges) else self.shortest_path(tape, read)

    def merged_path(self, tape: str | list[str], read: str | list[str]) -> tuple[int, ...]:
        """Ids on the path that merges leave: the only one of which every two arcs in a row are what merges make of their symbols.

        No merge spans the place where two of its arcs meet, so merges go on either side as they do there alone; and on any
        other path, the first merge that spans such a place is one of the two arcs' own symbols too. Longer arcs are tried
        first. A state is reached by the path of the symbols before it, so no state is reached twice.
        """
        n, longest, at, follows, arcs = len(tape), self.longest, 0, self.follows, None
        taken: list[tuple] = []  # state, what fits there, arcs not tried yet, arc taken
        while at < n:
            if arcs is None:
                arcs, states = [], self.root
                for symbol in tape[at : at + longest]:
                    arc = states.get(symbol)
                    if arc is None:
                        break
                    if arc[2] >= 0:
                        arcs.append(arc)
                    states = arc[0]
                if not arcs or arcs[0][3] > 1:
                    arcs.insert(0, self.fallback_arc(tape[at]))
            while arcs:
                arc = arcs.pop()
                fits = follows.get(arc[2])
                if fits is None:
                    begin, stop = taken[-1][0] if taken else at, at + arc[3]
                    fits = self.merged(tape[begin:stop]) == ([at - begin, stop - begin] if taken else [stop - begin])
                    if self.n_follows < FOLLOWS:
                        self.n_follows += 1
                        follows[arc[2]] = fits
                if fits:
                    taken.append((at, follows, arcs, arc))
                    at, follows, arcs = at + arc[3], arc[4], None
                    break
            else:
                at, follows, arcs, _ = taken.pop()
        path: list[int] = []
        for at, _, _, arc in taken:
            if arc[2] >= 0:
                path.append(arc[2])
            else:
                path += [self.byte_ids[b] for b in read[at].encode("utf-8")]
        return tuple(path)

    def fallback_arc(self, symbol: str) -> list:
        """An arc that reads one symbol and writes bytes; its number is negative, and its own."""
        arc = self.fallback.get(symbol)
        if arc is None:
            arc = [{}, float("inf"), -2 - ord(symbol) if symbol else -1, 1, {}]
            if len(self.fallback) < MEMO:
                self.fallback[symbol] = arc
        return arc

    def merged(self, tape: str | list[str]) -> list[int]:
        """Where the arcs end that merges leave. An arc is known by the place where it starts; end is 0 once it is part of another."""
        n = len(tape)
        states = [self.root.get(symbol) for symbol in tape]
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for left in range(n - 1):
            if states[left] and (joint := states[left][0].get(tape[left + 1])) and joint[2] >= 0:
                queue.append((joint[1], left, left + 2, joint))
        heapify(queue)
        while queue:
            _, left, stop, joint = heappop(queue)
            right = end[left]
            if not right or right == n or end[right] != stop:
                continue
            states[left], end[left], end[right] = joint, stop, 0
            if stop < n:
                before[stop] = left
            for first, second in ((left, stop), (before[left], left)):
                if first < 0 or second == n:
                    continue
                state = states[first]
                for symbol in tape[second : end[second]]:
                    if not state:
                        break
                    state = state[0].get(symbol)
                if state and state[2] >= 0:
                    heappush(queue, (state[1], first, end[second], state))
        return [stop for stop in end if stop]

    def shortest_path(self, tape: str | list[str], read: str | list[str]) -> tuple[int, ...]:
        """Ids on the least path of the lattice; of equal paths the one whose last differing arc is longer."""
        n = len(tape)
        unreached = float("inf")
        cost = [0.0] + [unreached] * n
        came_from, by_piece = [0] * (n + 1), [-1] * (n + 1)
        root, fallback_cost = self.root, self.fallback_cost
        for start in range(n):
            so_far = cost[start]
            arcs, at = root, start
            while at < n:
                node = arcs.get(tape[at])
                if node is None:
                    break
                at += 1
                arcs, final, piece = node[:3]
                final += so_far
                if final < cost[at]:
                    cost[at] = final
                    came_from[at] = start
                    by_piece[at] = piece
            if so_far + fallback_cost < cost[start + 1]:
                cost[start + 1] = so_far + fallback_cost
                came_from[start + 1] = start
                by_piece[start + 1] = -1
        path: list[int] = []
        at = n
        while at:
            start, piece = came_from[at], by_piece[at]
            if piece >= 0:
                path.append(piece)
            else:
                path += [self.byte_ids[b] for b in reversed(read[start].encode("utf-8"))]
            at = start
        return tuple(reversed(path))

    def encode(self, text: str | None) -> array:
        out = array("i")
        if not text:
            return out
        text = f" {text}" if self.dummy_prefix else text
        if self.stretches is None:
            out.extend(self.path(text))
            return out
        out.frombytes(b"".join(map(self.memo.__getitem__, self.stretches.findall(text))))
        return out

    def decode(self, ids) -> str:
        """The text that encode read. Ids that write nothing (control pieces) are skipped; bytes that are no UTF-8 become U+FFFD."""
        text = b"".join(map(self.written.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


def compile_transducer(pieces: list[tuple[str, float, str]], rules: dict[str, str | None] | None = None, dummy_prefix: bool = True) -> PieceTransducer:
    """A transducer of pieces (text, score, kind: piece, merge, byte or control; the place is the id) and of normaliser rules.

    Scores of the kind piece add up, those of the kind merge are ranks; a vocabulary has one of the two.

    The rules escape the space and refuse the escape character itself, which then takes the byte fallback and so stays
    apart from a space; rules may name further characters, at the price of the exact round trip.
    """
    symbols = {" ": SPACE, SPACE: None} | (rules or {})
    root: dict = Merges() if any(kind == "merge" for _, _, kind in pieces) else {}
    byte_ids, written, dearest = [0] * 256, [], 0.0
    for i, (text, score, kind) in enumerate(pieces):
        if kind == "byte":
            value = int(text[3:5], 16)
            byte_ids[value] = i
            written.append(bytes([value]))
        elif kind == "control":
            written.append(b"")
        else:
            written.append(text.replace(SPACE, " ").encode("utf-8"))
            arcs, node = root, None
            for depth, c in enumerate(text, 1):
                node = arcs.setdefault(c, [{}, float("inf"), -1, depth, {}])
                arcs = node[0]
            if node and -score < node[1]:
                node[1:3] = [-score, i]
            if score > -1e8:
                dearest = max(dearest, -score)
    normal = [text for text, _, kind in pieces if kind in ("piece", "merge")]
    whole = any(SPACE in text.lstrip(SPACE) for text in normal) or any(v and SPACE in v for k, v in symbols.items() if k != " ")
    return PieceTransducer(root, symbols, byte_ids, dearest + FALLBACK_PENALTY, written, dummy_prefix, None if whole else _stretches(normal, symbols))


def _stretches(pieces: list[str], symbols: dict[str, str | None]) -> re.Pattern:
    """What no piece spans the borders of, given that in none the escaped space follows another symbol: runs of letters, runs of other characters, either with the spaces before it, and characters of ALONE that stand in no piece with others."""
    next_to: dict[str, set[str]] = {}
    for text in pieces:
        for a, b in zip(text, text[1:]):
            if SPACE not in (a, b):
                next_to.setdefault(a, set()).add(b)
                next_to.setdefault(b, set()).add(a)
    alone = "".join(c for c in ALONE if c not in symbols and not any(c in text for text in pieces if len(text) > 1))
    letters, found = set(), ["e"]
    while found:  # all that pieces lead to from one letter on, so that none has one of these next to another character
        letters.update(found)
        found = {c for a in found for c in next_to.get(a, ())} - letters
    # what rules change may become anything
    runs = "" if set(symbols) - {" ", SPACE} or len(letters) == 1 else re.escape("".join(sorted(letters)))
    return re.compile("|".join([*([f"[{alone}]"] if alone else []), *([f" *[{runs}]+"] if runs else []), f" *[^ {alone}{runs}]+", " +"]))


def read_vocabulary(path: str = DEFAULT_VOCABULARY) -> list[tuple[str, float, str]]:
    """Pieces of a SentencePiece model file, read once on the driver; executors get the compiled machine."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto.FromString(Path(path).read_bytes())
    plain = "merge" if proto.trainer_spec.model_type == proto.trainer_spec.BPE else "piece"
    model = sentencepiece.SentencePieceProcessor(model_proto=Path(path).read_bytes())
    kind = lambda i: "byte" if model.is_byte(i) else "control" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else plain
    return [(model.id_to_piece(i), model.get_score(i), kind(i)) for i in range(model.get_piece_size())]


def encoder(docs: DataFrame, transducer: PieceTransducer):
    """A function of a text column that gives its ids as array<int>: empty for a null or empty text."""
    shared = docs.sparkSession.sparkContext.broadcast(transducer)

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        values, ends = array("i"), array("i", [0])
        for text in texts:
            values.extend(shared.value.encode(text.as_py()))
            ends.append(len(values))
        return pa.ListArray.from_arrays(pa.array(np.frombuffer(ends, dtype=np.int32)), pa.array(np.frombuffer(values, dtype=np.int32) if len(values) else [], pa.int32()))

    return encode


def decoder(docs: DataFrame, transducer: PieceTransducer):
    """A function of a column of ids that gives the text; null for null."""
    shared = docs.sparkSession.sparkContext.broadcast(transducer)

    @F.arrow_udf("string")
    def decode(lists: pa.Array) -> pa.Array:
        ends, values, valid = lists.offsets.to_pylist(), lists.values.to_pylist(), lists.is_valid().to_pylist()
        return pa.array([shared.value.decode(values[a:b]) if ok else None for a, b, ok in zip(ends, ends[1:], valid, strict=False)], pa.string())

    return decode


def encode_documents(docs: DataFrame, transducer: PieceTransducer, text_col: str = "text", ids_name: str = "piece_ids") -> DataFrame:
    """docs with the ids of each whole text as column ids_name (replaced if docs has it). Null and empty texts have no ids."""
    return docs.withColumn(ids_name, encoder(docs, transducer)(F.col(text_col)))


def decode_documents(docs: DataFrame, transducer: PieceTransducer, ids_col: str = "piece_ids", text_name: str = "decoded") -> DataFrame:
    return docs.withColumn(text_name, decoder(docs, transducer)(F.col(ids_col)))


def encode_and_decode(docs: DataFrame, transducer: PieceTransducer, text_col: str = "text", ids_name: str = "piece_ids", text_name: str = "decoded") -> DataFrame:
    """encode_documents and decode_documents of its ids in one Arrow pass, so that a task has one Python worker.

    A null or empty text has no ids and decodes to an empty text; repeated rows get the same ids; an empty table gives no
    rows. Columns of the two names are replaced, others pass through.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(transducer)

    kept = docs.drop(ids_name, text_name)
    schema = StructType([*kept.schema.fields, StructField(ids_name, ArrayType(IntegerType())), StructField(text_name, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (batch.slice(at, SLICE) for batch in batches for at in range(0, batch.num_rows, SLICE)):
            values, ends, decoded = array("i"), array("i", [0]), []
            for text in part.column(text_col):
                ids = shared.value.encode(text.as_py())
                values.extend(ids)
                ends.append(len(values))
                decoded.append(shared.value.decode(ids))
            lists = pa.ListArray.from_arrays(pa.array(np.frombuffer(ends, dtype=np.int32)), pa.array(np.frombuffer(values, dtype=np.int32) if len(values) else [], pa.int32()))
            yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(decoded, pa.string())], names=schema.names)
        shared.value.memo.clear()  # workers are used again, by stages that have no use for it
        pa.default_memory_pool().release_unused()

    return kept.mapInArrow(run, schema)


def round_trips(text: Column, decoded: Column) -> Column:
    return F.coalesce(text, F.lit("")) == decoded
