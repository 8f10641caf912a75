"""Chat formatting: a hidden Markov model recovers who speaks in a raw transcript, then turns are rendered canonically.

A step of the model is a line. Its states are a role's first line and a role's further lines; what it sees of a line is
the class of a speaker marker at its start and a few coarse features. Parameters are counted by Spark from labelled
turns; the tables have one entry per state and feature value.

Decoding works on any length of transcript. A transcript is cut into blocks of rows. Viterbi steps are products of
matrices over (max, +), which associate, so each block is first multiplied out by itself, the few block matrices of a
transcript then fix the states at block borders, and each block is decoded between its two border states.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: The roles, and the words by which transcripts mark them.
ROLES = ("system", "user", "assistant")
MARKER_WORDS = {"system": "system instruction instructions context", "user": "user human question customer q", "assistant": "assistant ai bot gpt model answer a"}
BLOCK_TURNS = 512
END = "<|end|>"

_WORD_ROLE = {w: role for role, words in MARKER_WORDS.items() for w in words.split()}
_MARKER = re.compile(r"^\s*(?:<\|(?P<tag>[A-Za-z]+)\|>|\[(?P<bracket>[A-Za-z]+)\]:?|#{1,4}\s*(?P<hash>[A-Za-z]+):?|\*{0,2}(?P<name>[A-Za-z]+)\*{0,2}\s*:\*{0,2})\s*")
STATES = [(role, first) for role in ROLES for first in (True, False)]


def marker_of(line: str) -> tuple[str, int]:
    """The role that a marker at the start of line names, or other or none, and where the line's own text begins."""
    found = _MARKER.match(line)
    if not found:
        return "none", 0
    role = _WORD_ROLE.get(next(g for g in found.groups() if g).lower())
    return (role, found.end()) if role else ("other", 0)


def features(line: str, after_break: bool) -> tuple[str, ...]:
    body, marker = line.strip(), marker_of(line)[0]
    return (
        f"marker={marker}",
        f"place={'marked' if marker in ROLES else 'break' if after_break else 'run'}",
        f"size={min(10, len(body).bit_length())}",
        f"asks={body.endswith('?')}",
        f"capital={body[:1].isupper()}",
    )


def row_features(text: str | None) -> list[tuple[str, ...]]:
    """Features of the lines of one row's text; a null text is one empty line. A break is a row's begin or an empty line."""
    lines = (text or "").split("\n")
    return [features(line, i == 0 or not lines[i - 1].strip()) for i, line in enumerate(lines)]


@dataclass(frozen=True)
class ChatModel:
    """Log probabilities: start and steps over STATES, seen[state][feature], and unseen[state] for other features."""

    start: np.ndarray
    steps: np.ndarray
    seen: tuple[dict[str, float], ...]
    unseen: tuple[float, ...]

    def emissions(self, rows: list[tuple[str, ...]]) -> np.ndarray:
        return np.array([[sum(seen.get(f, miss) for f in fs) for seen, miss in zip(self.seen, self.unseen, strict=True)] for fs in rows])


def train(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", smoothing: float = 0.5) -> ChatModel:
    """A model of labelled turns: rows with a role of ROLES. Others are left out; without any row all is equally likely.

    Turn order is counted by joining each turn with the next number of its transcript, so no transcript has to meet in
    one task. What reaches the driver is one count per state and feature value, or pair of roles.
    """
    known = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.lower(role_col).alias("role"), F.col(text_col).alias("text")).filter(F.col("role").isin(*ROLES)).dropDuplicates()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                rows = row_features(text)
                for i, fs in enumerate(rows):
                    total.update((role, i == 0, f) for f in (*fs, "lines"))
                    total[role, i == 0, "last" if i == len(rows) - 1 else "goes on"] += 1
        keys = list(total)
        yield pa.RecordBatch.from_pydict({"role": pa.array([k[0] for k in keys], pa.string()), "first": pa.array([k[1] for k in keys], pa.bool_()), "feature": pa.array([k[2] for k in keys], pa.string()), "n": pa.array([total[k] for k in keys], pa.int64())})

    seen = {(r["role"], r["first"], r["feature"]): r["n"] for r in known.select("role", "text").mapInArrow(count, "role string, first boolean, feature string, n long").groupBy("role", "first", "feature").agg(F.sum("n").alias("n")).collect()}
    heads = known.select("conv", "turn", "role")
    follows = heads.join(heads.select("conv", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next_role")), ["conv", "turn"])
    after = {(r["role"], r["next_role"]): r["count"] for r in follows.groupBy("role", "next_role").count().collect()}
    begins = {r["role"]: r["count"] for r in heads.join(heads.groupBy("conv").agg(F.min("turn").alias("turn")), ["conv", "turn"]).groupBy("role").count().collect()}

    n = lambda s, f: seen.get((*s, f), 0)
    values = Counter(k[2].split("=")[0] for k in {(None, None, f) for _, _, f in seen} if "=" in k[2])
    emit = tuple({f: math.log((n(s, f) + smoothing) / (n(s, "lines") + smoothing * (values[f.split("=")[0]] + 1))) for _, _, f in seen if "=" in f} for s in STATES)
    unseen = tuple(math.log(smoothing / (n(s, "lines") + smoothing * (len(values) + 1))) for s in STATES)
    total = sum(begins.values())
    start = np.array([math.log((begins.get(role, 0) + smoothing) / (total + 3 * smoothing)) if first else -1e3 for role, first in STATES])
    steps = np.full((len(STATES), len(STATES)), -1e3)
    for i, (role, first) in enumerate(STATES):
        ends = (n((role, first), "last") + smoothing) / (n((role, first), "last") + n((role, first), "goes on") + 2 * smoothing)
        out_of = sum(after.get((role, r), 0) for r in ROLES)
        for j, (to, to_first) in enumerate(STATES):
            if to_first:
                steps[i, j] = math.log(ends) + math.log((after.get((role, to), 0) + smoothing) / (out_of + 3 * smoothing))
            elif to == role:
                steps[i, j] = math.log(1 - ends)
    return ChatModel(start, steps, emit, unseen)


def block_matrix(model: ChatModel, emissions: np.ndarray) -> np.ndarray:
    """Entry (i, j): the best score of a way through these lines that comes from state i and ends in state j."""
    out = model.steps + emissions[0]
    for e in emissions[1:]:
        out = (out[:, :, None] + model.steps[None]).max(axis=1) + e
    return out


def decode_block(model: ChatModel, emissions: np.ndarray, before: int, last: int) -> list[int]:
    """The best states of these lines after state before (-1: the transcript begins) that end in state last."""
    score = (model.start if before < 0 else model.steps[before]) + emissions[0]
    back = []
    for e in emissions[1:]:
        ways = score[:, None] + model.steps
        back.append(ways.argmax(axis=0))
        score = ways.max(axis=0) + e
    path = [last]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def render(text: str | None, states: list[int]) -> tuple[list[str], str]:
    """Roles of the turns that begin in this row, and its canonical lines: a header for each turn, text without markers."""
    roles, out = [], []
    for line, state in zip((text or "").split("\n"), states, strict=True):
        role, first = STATES[state]
        if first:
            roles.append(role)
            out.append(f"{END}\n<|{role}|>")
            line = line[marker_of(line)[1] :]
        out.append(line)
    return roles, "\n".join(out)


def _by_block(rows: DataFrame, work: Callable, schema: str) -> DataFrame:
    """work over the rows of each block, in order. Blocks are sorted runs of a partition, held one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (row for batch in batches for row in batch.to_pylist())
        made: list[dict] = []
        for _, block in groupby(stream, key=lambda r: (r["conv"], r["block"])):
            made += work(list(block))
            if len(made) >= 2000:
                yield pa.RecordBatch.from_pylist(made, arrow_schema)
                made = []
        if made:
            yield pa.RecordBatch.from_pylist(made, arrow_schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow_schema = to_arrow_schema(StructType.fromDDL(schema))
    return rows.repartition("conv", "block").sortWithinPartitions("conv", "block", "turn", "text").mapInArrow(run, schema)


def recover_roles(transcripts: DataFrame, model: ChatModel, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """One row per distinct input row (conv, turn, text): roles of the turns that begin in it, and its rendered lines.

    Rows of a transcript are read in order of turn, null first, ties by text; rows that repeat all three are one row. A
    null text is an empty line, and null transcripts are one. Concatenating rendered in that order gives the transcript.
    Only the three columns are read. An empty table gives no rows.
    """
    rows = transcripts.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(text_col).alias("text")).dropDuplicates()
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(-(1 << 62))))
    conv = rows.schema["conv"].dataType.simpleString()

    def lines(block: list[dict]) -> np.ndarray:
        return model.emissions([fs for row in block for fs in row_features(row["text"])])

    def multiply(block: list[dict]) -> list[dict]:
        e = lines(block)
        alone = block_matrix(model, e)
        first = (model.start + e[0])[None, :]
        for x in e[1:]:
            first = (first[:, :, None] + model.steps[None]).max(axis=1) + x
        return [{"conv": block[0]["conv"], "block": block[0]["block"], "first": first[0].tolist(), "alone": alone.ravel().tolist()}]

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (row for batch in batches for row in batch.to_pylist())
        out: list[dict] = []
        for conv_id, blocks in groupby(stream, key=lambda r: r["conv"]):
            blocks = list(blocks)
            scores, backs = np.array(blocks[0]["first"]), []
            for b in blocks[1:]:
                ways = scores[:, None] + np.array(b["alone"]).reshape(len(STATES), -1)
                backs.append(ways.argmax(axis=0))
                scores = ways.max(axis=0)
            ends = [int(scores.argmax())]
            for back in reversed(backs):
                ends.append(int(back[ends[-1]]))
            ends = ends[::-1]
            out += [{"conv": conv_id, "block": b["block"], "before": before, "last": last} for b, before, last in zip(blocks, [-1, *ends], ends, strict=False)]
            if len(out) > 5000:
                yield pa.RecordBatch.from_pylist(out, border_schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, border_schema)

    from pyspark.sql.pandas.types import to_arrow_type

    border_schema = pa.schema([("conv", to_arrow_type(rows.schema["conv"].dataType)), ("block", pa.int64()), ("before", pa.int32()), ("last", pa.int32())])
    matrices = _by_block(rows, multiply, f"conv {conv}, block long, first array<double>, alone array<double>")
    known = matrices.repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(borders, f"conv {conv}, block long, before int, last int")

    def decode(block: list[dict]) -> list[dict]:
        states = decode_block(model, lines(block), block[0]["before"], block[0]["last"])
        out, at = [], 0
        for row in block:
            n = (row["text"] or "").count("\n") + 1
            roles, rendered = render(row["text"], states[at : at + n])
            out.append({"conv": row["conv"], "turn": row["turn"], "text": row["text"], "role": STATES[states[at]][0], "roles": roles, "rendered": rendered})
            at += n
        return out

    known = known.withColumnsRenamed({"conv": "border_conv", "block": "border_block"})
    joined = rows.join(known, F.col("conv").eqNullSafe(F.col("border_conv")) & (F.col("block") == F.col("border_block"))).drop("border_conv", "border_block")
    out = _by_block(joined, decode, f"conv {conv}, turn long, text string, role string, roles array<string>, rendered string")
    return out.withColumnsRenamed({"conv": conv_col, "turn": turn_col, "text": text_col})


#: Styles of raw transcripts, as markers of system, user and assistant.
STYLES = (("System: ", "User: ", "Assistant: "), ("System: ", "Human: ", "AI: "), ("### Instructions\n", "### Question\n", "### Answer\n"), ("<|system|>", "<|user|>", "<|assistant|>"), ("[system] ", "[user] ", "[bot] "))


def raw_transcripts(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", bare_every: int = 8) -> DataFrame:
    """turns with their role moved into the text as a marker, in one style per transcript; about one turn of bare_every gets none.

    The labelled turns of a corpus thus become transcripts in which roles have to be found. Turns of other or null roles get no marker.
    """
    style = F.pmod(F.xxhash64(F.lit("style"), F.col(conv_col)), F.lit(len(STYLES)))
    bare = F.pmod(F.xxhash64(F.lit("bare"), F.col(conv_col), F.col(turn_col)), F.lit(bare_every)) == 0
    marker = F.lit("")
    for s, names in enumerate(STYLES):
        for role, name in zip(ROLES, names, strict=True):
            marker = F.when((style == s) & (F.lower(role_col) == role) & ~bare, F.lit(name)).otherwise(marker)
    return turns.withColumn(text_col, F.concat(marker, F.coalesce(text_col, F.lit(""))))
