"""Byte-level BPE encoding of a whole corpus in batched numpy merge rounds.

The vocabulary is read once on the driver from a public tokenizer's file and sent to the
workers as sorted arrays.  In a batch, texts are split into words by the tokenizer's
pattern; the symbols of all words not met before lie in one flat array, and each round
looks up all neighbouring pairs by binary search and merges every word's lowest-ranked
pair wherever it occurs in the word.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

TOKENIZERS = "/opt/tokenizers"
_HELD_WORDS = 400_000
_TEXTS_AT_ONCE = 512
_CHARS_AT_ONCE = 2_000_000


@dataclass(frozen=True)
class Vocabulary:
    """Byte ids, and the merges as sorted pair keys (left * width + right) with their ranks and resulting ids."""

    byte_ids: np.ndarray
    width: int
    keys: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray


def _byte_chars() -> list[str]:
    """The character by which the file writes each byte: printable ones stand for themselves, the rest follow from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def load_vocabulary(path: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    ids, width = model["vocab"], max(model["vocab"].values()) + 1
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    keys = np.array([ids[a] * width + ids[b] for a, b in pairs], np.int64)
    merged = np.array([ids[a + b] for a, b in pairs], np.int32)
    order = np.argsort(keys)
    return Vocabulary(np.array([ids[c] for c in _byte_chars()], np.int32), width, keys[order], np.arange(len(keys), dtype=np.int32)[order], merged[order])


#: Bytes from which a word is merged by itself: a round for each rank over a word of megabytes would take hours.
LONG_WORD = 4096


def merge_long(word: bytes, v: Vocabulary) -> list[int]:
    """Ids of one long word: the lowest rank first, of equal ones the leftmost, from a heap of pairs."""
    ranks = dict(zip(v.keys.tolist(), zip(v.ranks.tolist(), v.merged.tolist())))
    symbol = v.byte_ids[np.frombuffer(word, np.uint8)].tolist()
    n, width = len(symbol), v.width
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(known[0], i, a, b, known[1]) for i, (a, b) in enumerate(zip(symbol, symbol[1:])) if (known := ranks.get(a * width + b))]
    heapq.heapify(heap)
    while heap:
        _, i, a, b, merged = heapq.heappop(heap)
        j = after[i]
        if symbol[i] != a or j >= n or symbol[j] != b:
            continue  # one of the two has been merged meanwhile
        symbol[i], symbol[j] = merged, -1
        k, h = after[j], before[i]
        after[i] = k
        if k < n:
            before[k] = i
            if known := ranks.get(merged * width + symbol[k]):
                heapq.heappush(heap, (known[0], i, merged, symbol[k], known[1]))
        if h >= 0 and (known := ranks.get(symbol[h] * width + merged)):
            heapq.heappush(heap, (known[0], h, symbol[h], merged, known[1]))
    return [x for x in symbol if x >= 0]


def merge_words(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """CSR (offsets, ids) of the given words: all merged together round by round, but for very long ones."""
    long = {i: np.array(merge_long(w, v), np.int32) for i, w in enumerate(words) if len(w) > LONG_WORD}
    if long:
        offsets, ids = merge_words([b"" if i in long else w for i, w in enumerate(words)], v)
        parts = [long.get(i, ids[a:b]) for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist()))]
        return np.concatenate(([0], np.cumsum([len(x) for x in parts]))), np.concatenate(parts)
    lengths = np.array([len(w) for w in words], np.int64)
    symbols = v.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    word = np.repeat(np.arange(len(words)), lengths)
    done_word, done_symbol = [], []
    none = np.int32(2**31 - 1)
    while len(symbols):
        rank, place = np.full(len(symbols), none), np.zeros(len(symbols), np.int64)
        inner = np.flatnonzero(word[1:] == word[:-1])
        keys = symbols[inner].astype(np.int64) * v.width + symbols[inner + 1]
        at = np.minimum(np.searchsorted(v.keys, keys), len(v.keys) - 1)
        hit = v.keys[at] == keys
        rank[inner[hit]], place[inner[hit]] = v.ranks[at[hit]], at[hit]
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        lowest = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(word))))
        over = lowest == none
        if over.any():
            done_word.append(word[over])
            done_symbol.append(symbols[over])
        chosen = (rank == lowest) & ~over
        if not chosen.any():
            break
        # of a run of overlapping occurrences (aaa), every second one counts, from the left
        here = np.flatnonzero(chosen)
        follows = np.concatenate(([False], here[1:] == here[:-1] + 1))
        if follows.any():
            number = np.arange(len(here))
            run = np.maximum.accumulate(np.where(~follows, number, 0))
            here = here[(number - run) % 2 == 0]
        symbols = symbols.copy()
        symbols[here] = v.merged[place[here]]
        keep = ~over
        keep[here + 1] = False
        symbols, word = symbols[keep], word[keep]
    if not done_word:
        return np.zeros(len(words) + 1, np.int64), np.empty(0, np.int32)
    word, symbols = np.concatenate(done_word), np.concatenate(done_symbol)
    order = np.argsort(word, kind="stable")
    return np.searchsorted(word[order], np.arange(len(words) + 1)), symbols[order]


class Encoder:
    """Encodes lists of texts; words met before are kept, up to a fixed number of them."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.pattern = regex.compile(PATTERN)
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.begin, self.length, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def _learn(self, words: set[str]) -> None:
        new = sorted(words)
        offsets, ids = merge_words([w.encode("utf-8", "surrogatepass") for w in new], self.v)
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
        self.begin = np.concatenate((self.begin, offsets[:-1] + len(self.flat)))
        self.length = np.concatenate((self.length, np.diff(offsets)))
        self.flat = np.concatenate((self.flat, ids))

    def encode(self, texts: list[str | None], only_lengths: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """CSR (offsets, ids); with ``only_lengths`` no ids."""
        split = [self.pattern.findall(t) if t else [] for t in texts]
        new = set(chain.from_iterable(split))
        if len(self.number) > _HELD_WORDS:
            self._clear()
        new.difference_update(self.number)
        if new:
            self._learn(new)
        counts = np.array([len(s) for s in split], np.int64)
        word = np.fromiter(map(self.number.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        lengths = self.length[word]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        offsets = ends[np.concatenate(([0], np.cumsum(counts)))]
        if only_lengths:
            return offsets, np.empty(0, np.int32)
        return offsets, self.flat[np.repeat(self.begin[word] - ends[:-1], lengths) + np.arange(ends[-1])]


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    begin, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= _CHARS_AT_ONCE or i + 1 - begin >= _TEXTS_AT_ONCE:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def encode_corpus(df: DataFrame, key: str, text: str, path: str = f"{TOKENIZERS}/byte_bpe_50k.json", only_counts: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, ids) or, with ``only_counts``, (key, *keep, n_tokens), of every row.

    No special tokens are added, and their spellings in a text are ordinary text.  Null and empty texts give an
    empty list (0 tokens).  One Arrow pass, no shuffle; rows stay as they are, repeated keys included.
    """
    vocabulary = df.sparkSession.sparkContext.broadcast(load_vocabulary(path))
    columns = [key, *keep]
    source = df.select(*columns, F.col(text).alias("_text"))
    last = T.StructField("n_tokens", T.LongType()) if only_counts else T.StructField("ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value)
        for batch in batches:
            texts = batch.column(len(columns)).to_pylist()
            for begin, end in _chunks(texts):
                offsets, ids = encoder.encode(texts[begin:end], only_counts)
                value = pa.array(np.diff(offsets), pa.int64()) if only_counts else pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                part = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(columns))), value], [*columns, last.name])

    return source.mapInArrow(run, T.StructType([*(source.schema[c] for c in columns), last]))
