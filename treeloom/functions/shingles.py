"""Vectorised word and word-shingle hashing over Arrow string columns.

A *word* is a maximal run of letters and digits (any script) of the lower-cased
text; everything else separates words.  A *shingle* is a run of ``width``
consecutive words inside one text.  Whole Arrow batches are hashed with a few
numpy passes over their UTF-8 bytes, so no Python code runs per word.

Nulls have no words.  Texts of any length are processed whole: they are walked
in byte segments cut at separators, which bounds the working memory.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SEGMENT_BYTES = 1 << 20


@functools.cache
def _word_code_points() -> np.ndarray:
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


@functools.cache
def _ascii_tables() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    word = np.zeros(256, bool)
    word[48:58] = word[65:91] = word[97:123] = True
    return lower, word


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64, kept for segments of the usual size."""
    room = max(SEGMENT_BYTES * 2, 1 << max(size, 1).bit_length())
    if room not in _powers:
        up = np.full(room, _MULTIPLIER)
        down = np.full(room, _INVERSE)
        up[0] = down[0] = 1
        tables = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if room > SEGMENT_BYTES * 2:
            return tables
        _powers[room] = tables
    return _powers[room]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lower_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of the lower-cased texts (ASCII upper case is left to the byte table)."""
    texts = texts.cast(pa.large_string())
    plain = pc.fill_null(pc.string_is_ascii(texts), True)
    if not pc.all(plain).as_py():
        odd = [t.lower() for t in texts.filter(pc.invert(plain)).to_pylist()]
        texts = pc.replace_with_mask(texts, pc.invert(plain), pa.array(odd, pa.large_string()))
    texts = pa.concat_arrays([texts])
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1 + texts.offset)[texts.offset :] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and texts.buffers()[2] is not None else np.empty(0, np.uint8)
    if texts.null_count:  # a null's slot may span bytes; give it none
        lengths = np.diff(offsets)
        valid = texts.is_valid().to_numpy(zero_copy_only=False)
        if lengths[~valid].any():
            return lower_texts(pc.fill_null(texts, ""))
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _is_word_byte(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to a word; all bytes of one code point agree."""
    word = _ascii_tables()[1][data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        first = data[lead]
        extra = 1 + (first >= 0xE0).astype(np.int64) + (first >= 0xF0)
        code = (first & (0x3F >> extra)).astype(np.int64)
        for k in (1, 2, 3):
            more = extra >= k
            at = np.minimum(lead[more] + k, len(data) - 1)
            code[more] = (code[more] << 6) | (data[at] & 0x3F)
        inside = _word_code_points()[np.minimum(code, 0x10FFFF)]
        for k in range(4):
            at = lead[inside & (extra >= k)] + k
            word[at[at < len(data)]] = True
    return word


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text index, 64-bit word hash) of every word, in order."""
    data, offsets = lower_texts(texts)
    owners, hashes = [], []
    lower, _ = _ascii_tables()
    begin, size = 0, len(data)
    while begin < size:
        end = min(size, begin + SEGMENT_BYTES)
        if end < size:  # cut at a text's end or else before a separator
            whole = offsets[np.searchsorted(offsets, end, "right") - 1]
            if whole > begin:
                end = int(whole)
            else:
                last = int(offsets[np.searchsorted(offsets, end, "right")])
                while end < last:
                    piece = data[end : min(last, end + 4096)]
                    gap = np.flatnonzero((piece < 0x80) & ~_ascii_tables()[1][piece])
                    if len(gap):
                        end += int(gap[0])
                        break
                    end += len(piece)
        own, hashed = _segment(lower[data[begin:end]], begin, offsets)
        owners.append(own)
        hashes.append(hashed)
        begin = end
    if not owners:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(owners), np.concatenate(hashes)


def _segment(data: np.ndarray, begin: int, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    word = _is_word_byte(data)
    cut = np.zeros(len(data) + 1, bool)
    inner = offsets[(offsets > begin) & (offsets < begin + len(data))] - begin
    cut[inner] = True
    starts = word.copy()
    starts[1:] &= ~word[:-1] | cut[1:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    up, down = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data * up[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return np.searchsorted(offsets, starts + begin, "right") - 1, hashes


def shingle_hashes(texts: pa.Array, width: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(text index, 64-bit hash) of every run of ``width`` consecutive words of one text, in order, repeats kept."""
    owner, word = word_hashes(texts)
    n = len(word) - width + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    acc = np.full(n, np.uint64(width))
    for k in range(width):
        acc = mix(acc * np.uint64(0xD6E8FEB86659FD93) + word[k : k + n])
    same = owner[:n] == owner[width - 1 :]
    return owner[:n][same], acc[same]


HASH_BITS = 48
_OWNERS = 1 << (64 - HASH_BITS)


def distinct_sets(owner: np.ndarray, values: np.ndarray, n_owners: int) -> tuple[np.ndarray, np.ndarray]:
    """CSR offsets and sorted distinct 48-bit values of each owner; ``owner`` must be non-decreasing.

    Owner and value share one 64-bit sort key, so each run of 65,536 owners is one plain numpy sort.
    """
    offsets, parts = [np.zeros(1, np.int64)], []
    done = 0
    for first in range(0, max(n_owners, 1), _OWNERS):
        last = min(n_owners, first + _OWNERS)
        lo, hi = np.searchsorted(owner, (first, last))
        key = ((owner[lo:hi] - first).astype(np.uint64) << np.uint64(HASH_BITS)) | (values[lo:hi] >> np.uint64(64 - HASH_BITS))
        key.sort()
        if len(key):
            key = key[np.concatenate(([True], key[1:] != key[:-1]))]
        bounds = np.searchsorted(key, np.arange(1, last - first, dtype=np.uint64) << np.uint64(HASH_BITS)) if last > first else np.empty(0, np.int64)
        offsets.append(np.append(bounds, len(key))[: last - first] + done)
        parts.append(key & np.uint64((1 << HASH_BITS) - 1))
        done += len(key)
    return np.concatenate(offsets).astype(np.int64), np.concatenate(parts)


def list_shingle_sets(lists: pa.Array, width: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """CSR (offsets, sorted distinct hashes) of the shingles of each row of a list<string> column.

    Shingles never cross from one text to the next.  Null rows and null texts have none.
    """
    lists = lists.cast(pa.large_list(pa.large_string()))
    offsets = np.zeros(len(lists) + 1, np.int64)
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    np.cumsum(lengths, out=offsets[1:])
    text, value = shingle_hashes(pc.list_flatten(lists), width)
    owner = np.searchsorted(offsets, text, "right") - 1
    return distinct_sets(owner, value, len(lists))
