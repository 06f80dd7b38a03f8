"""Text statistics of every document, and a model on them that tells prose from lists, tables and junk.

Boosted trees are trained on weak labels - documents that strict rules take for prose or for structural
junk, and mixtures of both with known proportions - and their scores are calibrated on a hand-checked
holdout.  Samples for fitting are bounded by parameters; statistics and predictions cover every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeloom.functions.shingles import _power_tables, mix
from treeloom.session import write_table

#: Documents drawn for weak labels, documents of those that are mixed, and labelled documents for calibration.
WEAK_SAMPLE, MIXED_SAMPLE, HOLDOUT_SAMPLE = 8000, 1500, 20_000

#: Marks that end a line or a sentence, bullets, vowels, and the ranges of wide scripts.
_END, _STOP, _WIDE_STOP = ".!?…。！？:;”\"'»)", ".!?…。！？", "。！？"
_BULLETS, _CELLS, _VOWELS = "-*•–+", "|;", "aeiouyäöüéèêàáíóúâîôûœ"
_KANA, _WIDE = ((0x3040, 0x30FF),), ((0x3040, 0x30FF), (0x3400, 0x9FFF), (0xAC00, 0xD7A3))

FEATURES = (
    "word_count", "mean_word_length", "symbol_share", "punct_line_share", "common_share",
    "log_chars", "digit_share", "digit_word_share", "upper_share", "damage_share", "kana_share", "distinct_word_share", "top_word_share",
    "char_entropy", "run_share", "longest_word", "mean_line_words", "short_line_share", "bullet_share", "cell_share", "tag_share",
    "stop_line_share", "repeated_line_share", "prose_share", "listed_share", "common_gap", "vowel_share", "sentence_words", "distinct_pair_share", "blank_share",
)
PUBLIC = FEATURES[:5]


# -- code points

_FLAGS = ("word", "digit", "decimal", "space", "upper", "kana", "wide", "line", "end", "stop", "vowel", "wide_stop", "cell")
_BIT = {name: np.uint16(1 << k) for k, name in enumerate(_FLAGS)}
_KNOWN = np.uint16(1 << 15)
_kinds = np.zeros(0x110000, np.uint16)


def _flags_of(code: int) -> int:
    c = chr(code)
    inside = lambda ranges: any(a <= code <= b for a, b in ranges)
    facts = (c.isalnum(), c.isdigit(), c.isdecimal(), c.isspace(), c.isupper(), inside(_KANA), inside(_WIDE), len(f"a{c}b".splitlines()) > 1, c in _END, c in _STOP, c in _VOWELS, c in _WIDE_STOP, c in _CELLS)
    return sum(1 << k for k, x in enumerate(facts) if x)


def _kinds_of(codes: np.ndarray) -> np.ndarray:
    """Flags of each code point; the table of all of them is filled as they turn up."""
    kinds = _kinds[codes]
    unknown = kinds == 0
    if unknown.any():
        new = np.unique(codes[unknown])
        _kinds[new] = np.array([_flags_of(int(c)) for c in new], np.uint16) | _KNOWN
        kinds = _kinds[codes]
    return kinds


def _sum(owner: np.ndarray, number: int, weight: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(owner, weight, number).astype(np.float64)


def _most(owner: np.ndarray, value: np.ndarray, number: int) -> np.ndarray:
    """The largest value of each owner, 0 without any; owners come in order."""
    out = np.zeros(number)
    if len(owner):
        first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        out[owner[first]] = np.maximum.reduceat(value, first)
    return out


def _runs(inside: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of true values; a run also ends before a cut."""
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | cut[1:-1]
    end[:-1] &= ~inside[1:] | cut[1:-1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def _range_hashes(codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of code points."""
    up, down = _power_tables(len(codes))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[: len(codes)], out=sums[1:])
    return mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def common_hashes(words: frozenset[str]) -> np.ndarray:
    """Sorted hashes of the lower-cased common words."""
    listed = sorted(w for w in words if w)
    if not listed:
        return np.empty(0, np.uint64)
    end = np.cumsum([len(w) for w in listed])
    return np.sort(_range_hashes(_codes(listed), end - [len(w) for w in listed], end))


def _distinct(owner: np.ndarray, values: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of distinct values, largest count of one) of each owner; values of 64 bits, of which the upper 40 are compared."""
    if not len(owner):
        return np.zeros(number), np.zeros(number)
    key = np.sort((owner.astype(np.uint64) << np.uint64(40)) | (values >> np.uint64(24)))
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    count = np.diff(np.append(first, len(key)))
    whose = (key[first] >> np.uint64(40)).astype(np.int64)
    return _sum(whose, number), _most(whose, count, number)


def statistics(texts: list[str | None], common: np.ndarray) -> np.ndarray:
    """The features of each text, a row each: numpy passes over the code points of all of them at once.

    ``common`` are :func:`common_hashes`.  Null, empty and blank texts have 0 everywhere.  word_count: maximal runs of letters
    and digits of the lower-cased text; mean_word_length: their mean length; symbol_share: characters that are neither letters, digits nor white
    space, of all characters; punct_line_share: lines ending in punctuation, of lines that are not blank; common_share: words in
    the common words of any language, of all words.
    """
    texts = [t or "" for t in texts]
    n = len(texts)
    out = np.zeros((n, len(FEATURES)))
    codes = _codes(texts)
    if not len(codes):
        return out
    lengths = np.array([len(t) for t in texts])
    edge = np.concatenate(([0], np.cumsum(lengths)))
    lowered = "".join(texts).lower()
    if len(lowered) == len(codes):
        low, low_edge = np.frombuffer(lowered.encode("utf-32-le", "surrogatepass"), np.uint32), edge
    else:  # a capital that becomes two characters
        lows = [t.lower() for t in texts]
        low, low_edge = _codes(lows), np.concatenate(([0], np.cumsum([len(t) for t in lows])))
    kind = _kinds_of(codes)
    is_ = lambda name, kinds=kind: (kinds & _BIT[name]) != 0
    owner = np.repeat(np.arange(n), lengths)
    cut = np.zeros(len(codes) + 1, bool)
    cut[edge] = True
    size = np.maximum(lengths, 1).astype(np.float64)
    nxt = np.append(codes[1:], 0)
    nxt[cut[1:]] = 10  # what follows a text's last character counts as a line end
    space, wide, kana = is_("space"), is_("wide"), is_("kana")
    next_space = np.append(space[1:], True) | cut[1:]
    solid = _sum(owner[~space], n)

    # words
    low_kind = kind if low is codes else _kinds_of(low)
    low_cut = np.zeros(len(low) + 1, bool)
    low_cut[low_edge] = True
    letterlike = (low_kind & _BIT["word"]) != 0
    begin, end = _runs(letterlike, low_cut)
    long = end - begin
    low_owner = owner if len(low) == len(codes) else np.repeat(np.arange(n), np.diff(low_edge))
    word_owner = low_owner[begin]
    hashed = _range_hashes(low, begin, end)
    words = _sum(word_owner, n)
    at_least = np.maximum(words, 1)
    is_common = np.isin(hashed, common)
    low_digits = np.concatenate(([0], np.cumsum((low_kind & _BIT["digit"]) != 0)))
    is_figure = low_digits[end] - low_digits[begin] == long
    hits = _sum(word_owner[is_common], n)
    kinds_of_words, top_word = _distinct(word_owner, hashed, n)
    together = word_owner[1:] == word_owner[:-1]
    pairs, _ = _distinct(word_owner[1:][together], mix(hashed[:-1] * np.uint64(0xD6E8FEB86659FD93) + hashed[1:])[together], n)
    longest = _most(word_owner, long, n)
    letters = letterlike & ((low_kind & _BIT["decimal"]) == 0)
    vowels = _sum(low_owner[letters & ((low_kind & _BIT["vowel"]) != 0)], n)

    # characters
    plain = codes < 256
    cell = np.bincount(owner[plain] * 256 + codes[plain].astype(np.int64), minlength=n * 256).reshape(n, 256)
    share = cell / size[:, None]
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
    key = np.sort((owner[~plain].astype(np.uint64) << np.uint64(21)) | codes[~plain])
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    count = np.diff(np.append(first, len(key)))
    whose = (key[first] >> np.uint64(21)).astype(np.int64)
    share = count / size[whose]
    entropy -= _sum(whose, n, share * np.log2(np.where(share > 0, share, 1)))
    changes = np.concatenate(([0], np.flatnonzero((codes[1:] != codes[:-1]) | cut[1:-1]) + 1, [len(codes)]))
    same = np.diff(changes)
    long_run = same >= 5
    run_begin, run_size = changes[:-1][long_run], same[long_run]
    after = nxt != 10
    is_code = lambda c: codes == ord(c)
    damaged = is_code("\ufffd") | (is_code("Ã") & after) | (is_code("â") & (nxt == ord("€"))) | (is_code("Â") & (next_space | (nxt == ord("°"))) & ~cut[1:]) | (codes <= 8) | ((codes >= 14) & (codes <= 31))
    gap_begin, gap_end = _runs(space, cut)
    tabs = np.concatenate(([0], np.cumsum(codes == 9)))
    not_tab = np.flatnonzero(np.append(codes != 9, True))
    lead = np.minimum(not_tab[np.searchsorted(not_tab, gap_begin)], gap_end) - gap_begin  # tabs that a gap begins with
    gaps = lead + (gap_end - gap_begin - lead >= 2)
    cells = _sum(owner[gap_begin], n, gaps) + _sum(owner[is_("cell") | (is_code(",") & ~next_space)], n)
    sentences = _sum(owner[is_("stop") & (codes != ord("…")) & (is_("wide_stop") | next_space)], n)
    tags = _tag_sizes(codes, nxt, owner, n)

    # lines that are not blank, from their first to their last solid character
    breaks = np.concatenate(([0], np.cumsum(is_("line"))))[:-1]
    at = np.flatnonzero(~space)
    line_of = breaks[at] + owner[at] * (len(codes) + 1)
    new = np.flatnonzero(np.concatenate(([True], line_of[1:] != line_of[:-1]))) if len(at) else np.empty(0, np.int64)
    head = at[new]
    tail = at[np.append(new[1:], len(at)) - 1] + 1 if len(at) else head
    line_owner, line_size = owner[head], (tail - head).astype(np.float64)
    m, lines = len(head), _sum(line_owner, n)
    at_most = np.maximum(lines, 1)
    total = lambda mask: np.concatenate(([0], np.cumsum(mask)))
    within = lambda sums: sums[tail] - sums[head]
    broad, broad_kana, harm = within(total(wide)), within(total(kana)), within(total(damaged))
    runs_in = np.searchsorted(run_begin, tail) - np.searchsorted(run_begin, head)
    # words of each line; where lower-casing changed lengths, lines are found in the lower-cased text by their place from the text's end
    place = begin if low is codes or len(low) == len(codes) else np.maximum(edge[word_owner], begin - low_edge[word_owner] + edge[word_owner])
    word_line = np.clip(np.searchsorted(head, place, "right") - 1, 0, max(m - 1, 0)) if m else np.empty(0, np.int64)
    absent = _absent(low, begin, long)  # n/a is one figure, not two words
    counted = ~np.concatenate(([False], absent[:-1])) if len(absent) else absent
    line_words = _sum(word_line[counted], m)
    line_common = _sum(word_line[is_common & (long > 1) & counted], m)
    line_figures = _sum(word_line[(is_figure | absent) & counted], m)
    good = np.where(broad > 0.4 * line_size, (broad >= 12) & (broad_kana >= 0.25 * broad) & (runs_in == 0), (line_words >= 6) & (line_common >= 0.15 * line_words) & (line_figures < 0.3 * line_words) & (20 * harm <= line_size))
    few, begins = line_words <= 6, _bullets(codes, space, head, tail)
    last = kind[tail - 1] if m else kind[:0]
    sized = np.maximum(_sum(line_owner, n, line_size), 1)
    different, _ = _distinct(line_owner, _range_hashes(codes, head, tail), n)

    by_line = lambda mask: _sum(line_owner[mask], n)
    wide_n, kana_n = _sum(owner[wide], n), _sum(owner[kana], n)
    columns = (
        words, _sum(word_owner, n, long) / at_least, _sum(owner[~is_("word") & ~space], n) / size, by_line((last & _BIT["end"]) != 0) / at_most, hits / at_least,
        np.log1p(lengths), _sum(owner[is_("digit")], n) / size, _sum(word_owner[is_figure], n) / at_least, _sum(owner[is_("upper")], n) / size, _sum(owner[damaged], n) / size, np.where(wide_n > 0.2 * solid, kana_n / np.maximum(wide_n, 1), 0.0),
        kinds_of_words / at_least, np.where(words > 0, top_word / at_least, 1.0),
        entropy, _sum(owner[run_begin], n, run_size) / size, longest, words / at_most, by_line(few) / at_most, by_line(begins) / at_most, cells / at_least, tags / size,
        by_line((last & _BIT["stop"]) != 0) / at_most, 1 - different / at_most, _sum(line_owner, n, line_size * good) / sized, _sum(line_owner, n, line_size * (~good & (begins | few))) / sized, (words + 1) / (hits + 1), vowels / np.maximum(_sum(low_owner[letters], n), 1), words / np.maximum(sentences, 1), pairs / np.maximum(words - 1, 1), 1 - solid / size,
    )
    out = np.stack(columns, axis=1)
    out[solid == 0] = 0.0
    return out


def _absent(low: np.ndarray, begin: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Which words are the n of "n/a"."""
    absent = np.zeros(len(begin), bool)
    if len(begin) > 1:
        one = (long[:-1] == 1) & (long[1:] == 1) & (begin[1:] == begin[:-1] + 2)
        i = np.flatnonzero(one)
        absent[i[(low[begin[i]] == ord("n")) & (low[begin[i] + 1] == ord("/")) & (low[begin[i + 1]] == ord("a"))]] = True
    return absent


def _tag_sizes(codes: np.ndarray, nxt: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Characters in markup tags: a bracket, perhaps a slash, a Latin letter, at most 80 more characters without brackets, a bracket."""
    angle = np.flatnonzero((codes == ord("<")) | (codes == ord(">")))
    if len(angle) < 2:
        return np.zeros(n)
    a, b = angle[:-1], angle[1:]
    ok = (codes[a] == ord("<")) & (codes[b] == ord(">")) & (owner[a] == owner[b])
    a, b = a[ok], b[ok]
    slash = (nxt[a] == ord("/")).astype(np.int64)
    at = np.minimum(a + 1 + slash, len(codes) - 1)
    letter = codes[at] | 32
    ok = (at < b) & (letter >= ord("a")) & (letter <= ord("z")) & (b - at - 1 <= 80)
    return _sum(owner[a[ok]], n, (b - a + 1)[ok])


def _bullets(codes: np.ndarray, space: np.ndarray, head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """Which lines begin with a bullet, a number of up to four digits or a letter with a mark, and a blank behind it."""
    if not len(head):
        return np.zeros(0, bool)
    inside = lambda at: at < tail
    get = lambda at: np.where(inside(at), codes[np.minimum(at, len(codes) - 1)], 0)
    blank = lambda at: inside(at) & space[np.minimum(at, len(codes) - 1)]
    c = get(head)
    mark = np.isin(c, [ord(x) for x in _BULLETS]) & blank(head + 1)
    letter = (c >= ord("a")) & (c <= ord("z")) & np.isin(get(head + 1), [ord("."), ord(")")]) & blank(head + 2)
    at = head + (c == ord("("))
    digits, going = np.zeros(len(head), np.int64), np.ones(len(head), bool)
    for k in range(5):
        d = get(at + k)
        going &= (d >= ord("0")) & (d <= ord("9"))
        digits += going
    behind = at + digits
    behind = behind + np.isin(get(behind), [ord(x) for x in ".):"])
    return mark | letter | ((digits >= 1) & (digits <= 4) & blank(behind))


#: Characters that one numpy pass takes at most, but for a longer single text.
_CHARACTERS_AT_ONCE = 1 << 19


def _slices(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of bounded length in all; a row above the bound is a range of its own."""
    begin = held = 0
    for k, size in enumerate(lengths.tolist()):
        if k > begin and held + size > _CHARACTERS_AT_ONCE:
            yield begin, k
            begin, held = k, 0
        held += size
    if begin < len(lengths):
        yield begin, len(lengths)


def _list_batch(keys: pa.Array, x: np.ndarray, key: str) -> pa.RecordBatch:
    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel()))
    return pa.RecordBatch.from_arrays([keys, pa.array(~x.any(axis=1)), flat], [key, "blank", "x"])


def document_statistics(df: DataFrame, key: str, text: str, common_words: DataFrame) -> DataFrame:
    """(key, blank, x): all features of every row as one array; ``blank`` tells null, empty and blank texts.

    ``common_words`` is a fixed table of a few hundred words; nulls in it are left out.
    """
    shared = df.sparkSession.sparkContext.broadcast(common_hashes(_common(common_words)))
    source = df.select(key, F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in _slices(pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)):
                part = batch.slice(begin, end - begin)
                yield _list_batch(part.column(0), statistics(part.column(1).to_pylist(), shared.value), key)

    return source.mapInArrow(run, T.StructType([source.schema[key], T.StructField("blank", T.BooleanType()), T.StructField("x", T.ArrayType(T.DoubleType()))]))


def _common(common_words: DataFrame) -> frozenset[str]:
    return frozenset(r["word"].lower() for r in common_words.select("word").filter("word is not null").distinct().collect())


def weak_label(x: np.ndarray) -> np.ndarray:
    """0 for sure prose, 1 for sure structural junk, -1 where the rules don't say."""
    f = {name: x[:, k] for k, name in enumerate(FEATURES)}
    tongue = (f["common_share"] >= 0.25) | (f["kana_share"] >= 0.35)
    prose = tongue & (f["prose_share"] >= 0.9) & (f["damage_share"] < 0.004) & (f["symbol_share"] < 0.12) & (f["digit_word_share"] < 0.2) & (f["run_share"] < 0.05)
    junk = ((f["prose_share"] <= 0.02) & (f["common_share"] < 0.12) & (f["kana_share"] < 0.3)) | (f["run_share"] > 0.4) | (f["damage_share"] > 0.03) | ((f["distinct_pair_share"] < 0.12) & (f["word_count"] >= 40))
    return np.where(prose & ~junk, 0, np.where(junk & ~prose, 1, -1))


@dataclass
class Trees:
    """Boosted trees of fixed depth on binned features: arrays over trees and nodes, evaluated without recursion."""

    edges: list[np.ndarray]
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - (2**self.depth - 1)]
        return total


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.12, bins: int = 48, ridge: float = 1.0) -> Trees:
    """Logistic gradient boosting with histograms of quantile bins and second-order leaf values."""
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(d)]
    code = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], axis=1)
    width = bins
    share = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    score = np.full(n, base)
    inner, leaves = 2**depth - 1, 2**depth
    features, thresholds, values = [], [], []
    offsets = np.arange(d) * width
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, number = 2**level - 1, 2**level
            place = ((node - first)[:, None] * (d * width) + offsets + code).ravel()
            size = number * d * width
            gs = np.bincount(place, np.repeat(g, d), size).reshape(number, d, width)
            hs = np.bincount(place, np.repeat(h, d), size).reshape(number, d, width)
            gl, hl = gs.cumsum(axis=2), hs.cumsum(axis=2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            for k, e in enumerate(edges):
                gain[:, k, len(e) :] = -1
            gain[(hl < 1) | (ht - hl < 1)] = -1
            flat = gain.reshape(number, -1)
            best = flat.argmax(axis=1)
            for m in range(number):
                if flat[m, best[m]] > 1e-9:
                    k, b = divmod(int(best[m]), width)
                    feature[first + m], threshold[first + m] = k, edges[k][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + ridge)
        score += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Trees(edges, np.array(features), np.array(thresholds), np.array(values), base, depth)


def calibrate(score: np.ndarray, y: np.ndarray, weight: float = 1.0) -> tuple[float, float]:
    """Slope and offset of a logistic curve through (score, label), with a weak pull towards (1, 0)."""
    a, b = 0.3, 0.0

    def loss(a: float, b: float) -> float:
        z = a * score + b
        return float((np.logaddexp(0, z) - y * z).sum() + weight / 2 * ((a - 1) ** 2 + b * b))

    held = loss(a, b)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * score + b, -30, 30)))
        v = np.maximum(p * (1 - p), 1e-9)
        grad = np.array([((p - y) * score).sum() + weight * (a - 1), (p - y).sum() + weight * b])
        hess = np.array([[(v * score * score).sum() + weight, (v * score).sum()], [(v * score).sum(), v.sum() + weight]])
        step = np.linalg.solve(hess, grad)
        size = 1.0
        while size > 1e-6 and loss(a - size * step[0], b - size * step[1]) > held:
            size /= 2
        a, b = a - size * step[0], b - size * step[1]
        before, held = held, loss(a, b)
        if before - held < 1e-9:
            break
    return float(a), float(b)


def mixtures(prose: list[str], junk: list[str], common: frozenset[str], number: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of texts put together from a prose and a junk text with a known share of junk: 1 where it is more than half."""
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    if not prose or not junk:
        return np.empty((0, len(FEATURES))), np.empty(0)
    for _ in range(number):
        p, q = prose[rng.integers(len(prose))], junk[rng.integers(len(junk))]
        share = rng.uniform(0.1, 0.9)
        size = min(len(p) / (1 - share), len(q) / share)
        a, b = p[: max(1, int(size * (1 - share)))], q[: max(1, int(size * share))]
        parts = [a, b] if rng.random() < 0.7 else [b, a]
        rows.append("\n".join(parts))
        labels.append(float(share > 0.5))
    hashes, ends = common_hashes(common), [*range(0, number, 64), number]  # few at once: texts may be long
    return np.concatenate([statistics(rows[a:b], hashes) for a, b in zip(ends, ends[1:])]), np.array(labels)


@dataclass
class Model:
    trees: Trees
    slope: float
    offset: float
    report: dict[str, float]

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability that a text is no prose."""
        return 1 / (1 + np.exp(-np.clip(self.slope * self.trees.score(x) + self.offset, -30, 30)))


def _features(table: pa.Table) -> np.ndarray:
    return table["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))


def fit(documents: DataFrame, key: str, text: str, stats: DataFrame, common_words: DataFrame, labels: DataFrame, kind: str = "kind", prose: str = "prose") -> Model:
    """Train on weak labels of a bounded sample and calibrate on the hand-checked holdout (bounded too, and kept out of training).

    ``labels``: (key, kind); null kinds and repeated keys with differing kinds are left out.  Without any labels the scores stay uncalibrated.
    """
    common = _common(common_words)
    checked = labels.filter(F.col(kind).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min(kind).alias("kind"), F.max(kind).alias("other")).filter("kind = other").select(key, F.lower(F.trim("kind")).alias("kind"))
    order = F.xxhash64(key, F.lit(11))
    free = stats.filter("not blank").join(checked, key, "left_anti").orderBy(order, key).limit(WEAK_SAMPLE).select(key, "x")
    drawn = free.toArrow()
    x = _features(drawn)
    weak = weak_label(x)
    keys = np.array(drawn[key].to_pylist())
    seldom = keys[weak >= 0][:MIXED_SAMPLE]
    told = dict(zip(keys.tolist(), weak.tolist()))
    few = documents.filter(F.col(key).isin([k.item() for k in seldom])).filter(F.length(text) <= 20_000).select(key, text).distinct().orderBy(key).collect() if len(seldom) else []
    mixed, label = mixtures([r[text] for r in few if told[r[key]] == 0], [r[text] for r in few if told[r[key]] == 1], common, MIXED_SAMPLE)
    sure = weak >= 0
    xs, ys = np.concatenate((x[sure], mixed)), np.concatenate((weak[sure], label)).astype(float)
    holdout = stats.filter("not blank").join(checked, key).orderBy(order, key).limit(HOLDOUT_SAMPLE).select("x", "kind").toArrow()
    hx = _features(holdout)
    hy = np.array([float(k != prose) for k in holdout["kind"].to_pylist()])
    if len(set(ys.tolist())) < 2:  # too little text to learn from: the rules' main statistic alone
        xs, ys = np.concatenate((xs, np.zeros((2, len(FEATURES))))), np.concatenate((ys, [0.0, 1.0]))
        xs[-2, FEATURES.index("prose_share")] = 1.0
    weight = np.where(ys == 1, len(ys) / max(1, 2 * ys.sum()), len(ys) / max(1, 2 * (1 - ys).sum()))
    trees = boost(xs, ys, weight)
    slope, offset = calibrate(trees.score(hx), hy) if len(hy) else (1.0, 0.0)
    # accuracy on labels that neither the trees nor the curve saw: each half is judged by the curve of the other
    score, half, right = trees.score(hx) if len(hy) else np.empty(0), np.arange(len(hy)) % 2, 0
    for k in (0, 1) if len(hy) > 1 else ():
        a, b = calibrate(score[half != k], hy[half != k])
        right += int(((a * score[half == k] + b >= 0) == (hy[half == k] == 1)).sum())
    return Model(trees, slope, offset, {"weak": float(sure.sum()), "mixed": float(len(label)), "holdout": float(len(hy)), "held_out_accuracy": right / max(1, len(hy))})


def predict(stats: DataFrame, key: str, model: Model) -> DataFrame:
    """(key, blank, probability of being no prose) of every row; blank texts have probability 0."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(2).flatten().to_numpy(), np.float64).reshape(-1, len(FEATURES))
            blank = batch.column(1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.where(blank, 0.0, shared.value.probability(x)))], [key, "blank", "probability"])

    return stats.select(key, "blank", "x").mapInArrow(run, T.StructType([stats.schema[key], T.StructField("blank", T.BooleanType()), T.StructField("probability", T.DoubleType())]))


def not_prose(documents: DataFrame, key: str, text: str, common_words: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, probability) of the documents that are for the most part no prose; null, empty and blank texts are no cases."""
    stats, _ = write_table(document_statistics(documents, key, text, common_words), "stats")
    model = fit(documents, key, text, stats, common_words, labels)
    return predict(stats, key, model).filter("not blank and probability >= 0.5").select(key, "probability")


