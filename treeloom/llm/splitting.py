"""Cut oversized texts at natural boundaries, with a fixed overlap between consecutive pieces."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Strength of the boundary before a character, from a paragraph's end down to the inside of a word;
#: a boundary before a combining mark or between CR and LF is the last choice.
PARAGRAPH, LINE, SENTENCE, CLAUSE, COMMA, BLANK, INSIDE, JOINED = 7, 6, 5, 4, 3, 2, 1, 0

#: A piece that is cut has at least this share of the limit, unless there is no natural boundary so far up.
LEAST_SHARE = 0.5

_NEWLINE, _SPACE, _STOP, _WIDE_STOP, _CLAUSE, _COMMA, _WIDE_COMMA, _MARK, _CLOSE = range(1, 10)
_CLASSES = {_NEWLINE: "\n\r  \x0b\x0c\x85", _STOP: ".!?…", _WIDE_STOP: "。！？｡", _CLAUSE: ";:", _COMMA: ",", _WIDE_COMMA: "、，；：", _CLOSE: "\"'”’»)]）」』"}


@functools.cache
def _class_of(code: int) -> int:
    char = chr(code)
    for k, chars in _CLASSES.items():
        if char in chars:
            return k
    if char.isspace():
        return _SPACE
    if unicodedata.category(char) in ("Mn", "Me", "Mc") or code == 0x200D or 0xFE00 <= code <= 0xFE0F or 0x1F3FB <= code <= 0x1F3FF:
        return _MARK
    return 0


def _classes(codes: np.ndarray) -> np.ndarray:
    kinds, back = np.unique(codes, return_inverse=True)
    return np.array([_class_of(int(c)) for c in kinds], np.uint8)[back]


def boundary_strengths(text: str) -> np.ndarray:
    """Strength of the boundary before each code point; index 0 and the text's end are not asked for."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _classes(codes)
    n = len(kind)
    strength = np.full(n, INSIDE, np.int8)
    if n < 2:
        return strength
    blank = (kind == _SPACE) | (kind == _NEWLINE)
    at = np.arange(n)
    before = np.empty(n, np.int64)  # the last character before i that is no blank, and before that no closing mark
    solid = np.maximum.accumulate(np.where(~blank, at, -1))
    before[0], before[1:] = -1, solid[:-1]
    firm = np.maximum.accumulate(np.where(~blank & (kind != _CLOSE), at, -1))
    stop_at = np.where(before >= 0, firm[np.maximum(before, 0)], -1)
    after_blank = np.zeros(n, bool)
    after_blank[1:] = blank[:-1]
    start = after_blank & ~blank
    last = np.where(stop_at >= 0, kind[np.maximum(stop_at, 0)], 0)
    direct = np.where(before >= 0, kind[np.maximum(before, 0)], 0)
    breaks = np.concatenate(([0], np.cumsum(codes == 10)))  # line feeds before i
    other = np.concatenate(([0], np.cumsum((kind == _NEWLINE) & (codes != 10) & ~((codes == 13) & np.append(codes[1:] == 10, False)))))
    gap = (breaks + other)[at] - (breaks + other)[before + 1]
    strength[start] = BLANK
    strength[start & (direct == _COMMA)] = COMMA
    strength[(kind != _WIDE_COMMA) & np.concatenate(([False], kind[:-1] == _WIDE_COMMA))] = COMMA
    strength[start & (direct == _CLAUSE)] = CLAUSE
    strength[start & ((last == _STOP) | (last == _WIDE_STOP))] = SENTENCE
    strength[(kind != _WIDE_STOP) & (kind != _CLOSE) & np.concatenate(([False], (kind[:-1] == _WIDE_STOP) | ((kind[:-1] == _CLOSE) & (last[1:] == _WIDE_STOP))))] = SENTENCE
    strength[start & (gap == 1)] = LINE
    strength[start & (gap > 1)] = PARAGRAPH
    strength[kind == _MARK] = JOINED
    strength[np.concatenate(([False], codes[:-1] == 0x200D))] = JOINED
    strength[np.concatenate(([False], (codes[:-1] == 13) & (codes[1:] == 10)))] = JOINED
    return strength


class RangeMaximum:
    """Sparse table over a block of strengths: place of the greatest value in any range, the rightmost of equal ones."""

    def __init__(self, values: np.ndarray, widest: int):
        self.values = values
        self.levels = [np.arange(len(values), dtype=np.int32)]
        width = 1
        while 2 * width <= min(widest, len(values)):
            held = self.levels[-1]
            left, right = held[: len(held) - width], held[width:]
            self.levels.append(np.where(values[right] >= values[left], right, left))
            width *= 2

    def at(self, low: int, high: int) -> int:
        """Place of the maximum of values[low:high + 1]."""
        k = (high - low + 1).bit_length() - 1
        a, b = int(self.levels[k][low]), int(self.levels[k][high - (1 << k) + 1])
        return b if self.values[b] >= self.values[a] else a


def cut(text: str, limit: int, overlap: int, block: int = 1 << 16) -> list[tuple[int, int, int]]:
    """(begin, end, strength of the boundary at the end) of each piece; code points.

    Every piece has at most ``limit`` characters; every piece but the first begins exactly ``overlap`` characters
    before the end of the one before.  An overlap of the limit or more is lowered to limit - 1.
    A cut inside a word is only made where the whole range behind the overlap has no natural boundary.
    """
    size = len(text)
    if size <= limit:
        return [(0, size, PARAGRAPH)]
    overlap = max(0, min(overlap, limit - 1))
    shortest = max(overlap + 1, int(np.ceil(limit * LEAST_SHARE)))
    strengths = boundary_strengths(text)
    pieces, begin, base, table = [], 0, 0, None
    block = max(block, 4 * limit)
    while size - begin > limit:
        low, high = begin + shortest, begin + limit
        if table is None or high >= base + block:
            base = begin + overlap + 1
            table = RangeMaximum(strengths[base : base + block], limit + 1)
        end = base + table.at(low - base, high - base)
        if strengths[end] <= INSIDE:
            end = base + table.at(begin + overlap + 1 - base, high - base)
        pieces.append((begin, end, int(strengths[end])))
        begin = end - overlap
    pieces.append((begin, size, PARAGRAPH))
    return pieces


def split_oversized(df: DataFrame, text: str, limit: str, overlap: str, keep: list[str], with_text: bool = True) -> DataFrame:
    """The pieces of all texts with more characters (code points) than their limit.

    Output: the columns ``keep`` of ``df``, then n_pieces, piece_no (from 1), piece_begin, piece_end (from 0, end
    excluded), boundary (strength at the end) and, if asked for, piece.  Texts within the limit, null texts and
    rows whose limit is null or not positive give no rows; a null or negative overlap is 0.  Only oversized texts
    reach Python, and no shuffle takes place.  ``keep`` must not name an output column.
    """
    wanted = df.filter(F.col(text).isNotNull() & (F.col(limit) > 0) & (F.char_length(text) > F.col(limit)))
    wanted = wanted.select(*keep, F.col(text).alias("_text"), F.col(limit).cast("int").alias("_limit"), F.coalesce(F.col(overlap), F.lit(0)).cast("int").alias("_overlap"))
    fields = [T.StructField("n_pieces", T.IntegerType()), T.StructField("piece_no", T.IntegerType()), T.StructField("piece_begin", T.IntegerType()), T.StructField("piece_end", T.IntegerType()), T.StructField("boundary", T.IntegerType())]
    if with_text:
        fields.append(T.StructField("piece", T.StringType()))
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, numbers, pieces, cuts = [], [], [], []
            for i, (t, most, over) in enumerate(zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), batch.column(n + 2).to_pylist())):
                found = cut(t, most, over)
                rows += [i] * len(found)
                numbers += [(len(found), k + 1) for k in range(len(found))]
                cuts += found
                if with_text:
                    pieces += [t[a:b] for a, b, _ in found]
            kept = batch.take(pa.array(rows, pa.int64()))
            arrays = [kept.column(k) for k in range(n)]
            arrays += [pa.array([x[0] for x in numbers], pa.int32()), pa.array([x[1] for x in numbers], pa.int32()), pa.array([x[0] for x in cuts], pa.int32()), pa.array([x[1] for x in cuts], pa.int32()), pa.array([x[2] for x in cuts], pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array(pieces, pa.string())] if with_text else []), [*keep, *(f.name for f in fields)])

    return wanted.mapInArrow(run, T.StructType([*(wanted.schema[c] for c in keep), *fields]))
