"""Fill-in-the-middle: texts cut into prefix, middle and suffix at whole lines, and put together in another order.

A cut is a number of lines, and pieces are measured in bytes and in code points. While a text's lines are counted, the
byte and code-point offsets of every STEP-th line go into a sparse list of checkpoints; a cut is found by binary search
in that list and a short scan from the checkpoint before it. No list of all lines is ever held.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import small_batches

#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Lines between checkpoints, and bytes that are looked at together while lines are counted.
STEP, WINDOW = 64, 1 << 16
#: Of 100 texts, so many are put in another order; of 100 of these, so many begin with the suffix.
RATE, SPM_RATE = 100, 50
SEED = "7"


@dataclass(frozen=True)
class Checkpoints:
    """Offsets of lines 0, STEP, 2 * STEP, ... of a text, and how many lines and code points it has."""

    lines: list[int]
    bytes_at: list[int]
    chars_at: list[int]
    n_lines: int
    n_chars: int


def _chars(data: np.ndarray) -> int:
    """Code points that begin in data, which is UTF-8: all bytes but the continuing ones."""
    return len(data) - int(np.count_nonzero((data & 0xC0) == 0x80))


def checkpoints(data: bytes, step: int = STEP, window: int = WINDOW) -> Checkpoints:
    """One pass over data: lines are counted by their line feeds, and each step-th one leaves its offsets behind."""
    whole = np.frombuffer(data, dtype=np.uint8)
    lines, bytes_at, chars_at = [0], [0], [0]
    ended = chars = 0
    for at in range(0, len(whole), window):
        part = whole[at : at + window]
        feeds = np.flatnonzero(part == 10)
        first = -ended % step or step  # the feed of this window, from 1, after which a checkpoint is due
        last = 0
        for k in range(first, len(feeds) + 1, step):
            end = int(feeds[k - 1]) + 1
            chars += _chars(part[last:end])
            last = end
            lines.append(ended + k)
            bytes_at.append(at + end)
            chars_at.append(chars)
        chars += _chars(part[last:])
        ended += len(feeds)
    open_end = len(data) > 0 and not data.endswith(b"\n")
    return Checkpoints(lines, bytes_at, chars_at, ended + open_end, chars)


def offsets(data: bytes, marks: Checkpoints, line: int) -> tuple[int, int]:
    """Byte and code-point offset at which so many lines of data end."""
    if line >= marks.n_lines:
        return len(data), marks.n_chars
    k = bisect_right(marks.lines, line) - 1
    start = at = marks.bytes_at[k]
    for _ in range(line - marks.lines[k]):
        at = data.index(b"\n", at) + 1
    return at, marks.chars_at[k] + _chars(np.frombuffer(data, dtype=np.uint8, count=at - start, offset=start))


def rearranged(data: bytes, draws: tuple[int, int, int, int], rate: int = RATE, spm_rate: int = SPM_RATE) -> dict:
    """What becomes of a text in UTF-8, given four numbers drawn for it."""
    marks = checkpoints(data)
    out = {"n": marks.n_lines, "form": "plain", "prefix_chars": None, "middle_chars": None, "output": data}
    if not data or any(m.encode() in data for m in (PREFIX, SUFFIX, MIDDLE)) or draws[2] % 100 >= rate:
        return out
    first, second = sorted(d % (marks.n_lines + 1) for d in draws[:2])
    (a, a_chars), (b, b_chars) = offsets(data, marks, first), offsets(data, marks, second)
    prefix, middle, suffix = (m.encode() + piece for m, piece in ((PREFIX, data[:a]), (MIDDLE, data[a:b]), (SUFFIX, data[b:])))
    form = "spm" if draws[3] % 100 < spm_rate else "psm"
    output = suffix + prefix + middle if form == "spm" else prefix + suffix + middle
    return out | {"form": form, "prefix_chars": a_chars, "middle_chars": b_chars - a_chars, "output": output}


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = RATE, spm_rate: int = SPM_RATE, seed: str = SEED) -> DataFrame:
    """One row per row: id, text (null: empty), n lines, form (plain, psm or spm), prefix_chars, middle_chars, output.

    Cuts and form are drawn from the SHA-256 of seed and id, so reruns and repeated rows agree; rows without id share
    one draw. Empty texts and texts that have one of the marks stay as they are, with null lengths. A line is a run up
    to and with its line feed, or what follows the last one; a text of many MB or of one line is worked on like any
    other. An empty table gives no rows, and other columns of docs are not read.
    """
    small_batches(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))), 256)
    drawn = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k}") for k in range(4)]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), *drawn)
    kind = rows.schema["id"].dataType.simpleString()
    types = {"n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                draws = zip(*(part.column(f"h{k}").to_pylist() for k in range(4)), strict=True)
                made = [rearranged(t.as_py(), d, rate, spm_rate) for t, d in zip(part.column("text"), draws, strict=True)]
                yield pa.RecordBatch.from_pydict({"id": part.column("id"), "text": part.column("text")} | {c: pa.array([m[c] for m in made], t) for c, t in types.items()})

    out = rows.mapInArrow(run, f"id {kind}, text binary, n long, form string, prefix_chars long, middle_chars long, output binary")
    return out.select(F.col("id").alias(id_col), F.col("text").cast("string").alias(text_col), "n", "form", "prefix_chars", "middle_chars", F.col("output").cast("string").alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that fill_in_middle made output of; null only where either is null."""

    def head(x: Column, mark: str) -> tuple[Column, Column]:
        """x up to the mark, and what follows that."""
        before = F.substring_index(x, mark, 1)
        return before, F.substr(x, F.length(before) + len(mark) + 1)

    body = F.substr(output, F.lit(4))
    prefix, rest = head(body, SUFFIX)
    suffix, middle = head(rest, MIDDLE)
    last, rest = head(body, PREFIX)
    first, inner = head(rest, MIDDLE)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(first, inner, last)).otherwise(output)
