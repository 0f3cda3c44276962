"""Problem 2: cutting oversized code at natural boundaries by lexical cohesion.

The code is taken as units (its lines; a line that is too long falls into parts at blanks and marks). At
each boundary between units the words of the block before are compared with those of the block after; a
valley of this sliding similarity marks a change of topic. Within the window of sizes that a piece may
have, the deepest valley is the cut. The next piece starts up to `overlap` characters before its cut.
Rows are split on their own, so the operator adds no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT = 2000
OVERLAP = 200
#: Units in a block of the sliding comparison, longest unit, least share of the window that a piece fills.
BLOCK, UNIT, LEAST = 6, 160, 0.4
#: Units whose cohesion is computed at once (bounds memory for very long texts), and the decimals in which depths are compared.
STRETCH, DECIMALS = 512, 2
_WORDS = re.compile(r"[^\W\d_]{2,}")
_SOFT = re.compile(r"[\s,;{}()\[\]]")


def unit_starts(code: str) -> list[int]:
    """Offsets where units begin; the last entry is the length."""
    starts, at = [], 0
    for line in code.splitlines(keepends=True) if "\r" not in code and "\x0b" not in code else re.findall(r"[^\n]*\n|[^\n]+", code):
        end = at + len(line)
        while end - at > UNIT:
            starts.append(at)
            soft = max((m.end() for m in _SOFT.finditer(code, at + UNIT // 2, at + UNIT)), default=at + UNIT)
            at = soft
        starts.append(at)
        at = end
    return [*starts, len(code)]


def valley_depths(code: str, starts: list[int]) -> np.ndarray:
    """depth[i] of the boundary before unit i: how far similarity falls there below the peaks on both sides."""
    n = len(starts) - 1
    out = np.zeros(n + 1)
    for low in range(0, n, STRETCH):
        first, last = max(0, low - 2 * BLOCK), min(n, low + STRETCH + 2 * BLOCK)
        m = last - first
        classes: dict[str, int] = {}
        rows, cols = [], []
        for i in range(m):
            for word in _WORDS.findall(code, starts[first + i], starts[first + i + 1]):
                rows.append(i + 1)
                cols.append(classes.setdefault(word, len(classes)))
        bag = np.zeros((m + 1, max(len(classes), 1)), dtype=np.float32)
        np.add.at(bag, (rows, cols), 1)
        total = np.cumsum(bag, axis=0)
        gap = np.arange(m + 1)
        left = total - total[np.maximum(gap - BLOCK, 0)]
        right = total[np.minimum(gap + BLOCK, m)] - total
        norm = np.sqrt((left * left).sum(1) * (right * right).sum(1))
        similar = (left * right).sum(1) / np.maximum(norm, 1e-9)
        peaks = np.lib.stride_tricks.sliding_window_view(np.pad(similar, BLOCK, mode="edge"), BLOCK + 1)
        before, after = peaks[: m + 1].max(1), peaks[BLOCK : BLOCK + m + 1].max(1)
        depth = before + after - 2 * similar
        stop = min(n, low + STRETCH)
        out[low:stop] = depth[low - first : stop - first]
    return out


def split_code(code: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, core, end) of each piece: code[start:end], of which code[start:core] repeats the piece before."""
    n = len(code)
    if n <= limit:
        return [(0, 0, n)]
    starts = unit_starts(code)
    depth = valley_depths(code, starts)
    edges = np.asarray(starts)
    # Layout only breaks ties: a blank line before, or a line that starts at the margin. Starts of lines come before places within lines.
    layout = np.zeros(len(starts))
    for i in range(1, len(starts) - 1):
        at = starts[i]
        if code[at - 1] == "\n":
            blank = code[at - 2 : at] == "\n\n" or code[at - 3 : at] == "\n\r\n"
            layout[i] = 1 + 2 * blank + (not code[at].isspace())
    score = np.where(layout > 0, 10, 0) + np.round(depth, DECIMALS) + layout / 10 ** (DECIMALS + 2)
    pieces, start, core = [], 0, 0
    while n - start > limit:
        low = np.searchsorted(edges, core + max(1, int((limit - (core - start)) * LEAST)))
        high = np.searchsorted(edges, start + limit, side="right")
        if low < high:
            end = int(edges[low + int(np.argmax(score[low:high]))])
        else:
            high_edge = int(edges[high - 1])
            end = high_edge if high_edge > core else start + limit
        pieces.append((start, core, end))
        core = end
        start = _overlap_start(code, core, pieces[-1][1], overlap)
    pieces.append((start, core, n))
    return pieces


def _overlap_start(code: str, core: int, floor: int, overlap: int) -> int:
    """The first line start within the overlap; else as far back as the overlap reaches (never before the last cut)."""
    low = max(core - overlap, floor + 1, 0)
    newline = code.find("\n", max(low - 1, 0), core - 1)
    return newline + 1 if newline >= 0 else low


def split_oversized(elements: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(id, piece, start_line, end_line, n_overlap, code): the pieces of each row whose code exceeds `limit` characters.

    start_line and end_line count from the row's start_line (1 where it is null). `code` without its first
    `n_overlap` characters, joined in the order of `piece`, is the row's code. Rows with null, empty or short
    code give nothing; repeated rows give the same pieces again. Needs limit > 2 * overlap.
    """
    if limit <= 2 * overlap:
        raise ValueError("limit must exceed twice the overlap")
    kind = elements.schema["id"].dataType
    schema = T.StructType([T.StructField("id", kind), *(T.StructField(c, T.IntegerType(), False) for c in ("piece", "start_line", "end_line", "n_overlap")), T.StructField("code", T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column(0), []
            for row, (first, code) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                for piece, (start, core, end) in enumerate(split_code(code, limit, overlap)):
                    top = first + code.count("\n", 0, start)
                    out.append((row, piece, top, top + code.count("\n", start, end - 1), core - start, code[start:end]))
            rows, *columns = zip(*out, strict=True) if out else [()] * 6
            arrays = [ids.take(pa.array(rows, pa.int64())), *(pa.array(c, pa.int32()) for c in columns[:-1]), pa.array(columns[-1], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    large = elements.where(F.char_length("code") > limit)
    return large.select("id", F.coalesce(F.col("start_line").cast("int"), F.lit(1)), "code").mapInArrow(run, schema)
