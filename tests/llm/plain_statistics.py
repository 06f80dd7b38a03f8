"""Text statistics in plain Python, to compare the vectorised ones with."""

import re
from collections import Counter

import numpy as np

from treeloom.llm import quality

_WORD = re.compile(r"[^\W_]+")
_LETTERS = re.compile(r"[^\W\d_]+")
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,80}>")
_BULLET = re.compile(r"\s*(?:[-*•–+]|\(?[0-9]{1,4}[.):]?|[a-z][.)])\s")
_DAMAGE = re.compile(r"�|Ã.|â€.|Â(?=[\s°])|[\x00-\x08\x0e-\x1f]")
_KANA = re.compile(r"[぀-ヿ]")
_WIDE = re.compile(r"[぀-ヿ㐀-鿿가-힣]")
_CELL = re.compile(r"[\t|;]|\s{2,}|,(?=\S)")
_END = tuple(".!?…。！？:;”\"'»)")
_STOP = tuple(".!?…。！？")
_RUN = re.compile(r"(.)\1{4,}", re.S)


def plain_statistics(text, common):
    """The features of one text, one after another in plain Python."""
    if not text or not text.strip():
        return [0.0] * len(quality.FEATURES)
    size = len(text)
    lower = text.lower()
    words = _WORD.findall(lower)
    n = len(words)
    solid = sum(map(len, words))
    blank = sum(map(len, text.split()))
    kinds = Counter(text)
    symbols = sum(k for c, k in kinds.items() if not c.isalnum() and not c.isspace())
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    ends = sum(x.endswith(_END) for x in lines)
    stops = sum(x.endswith(_STOP) for x in lines)
    is_common = [w in common for w in words]
    hits = sum(is_common)
    digits = sum(w.isdigit() for w in words)
    counts = Counter(words)
    chars = np.array(list(kinds.values()), float) / size
    wide = sum(k for c, k in kinds.items() if _WIDE.match(c))
    kana = sum(k for c, k in kinds.items() if _KANA.match(c))
    tags = sum(map(len, _TAG.findall(text)))
    prose = listed = short = bullets = 0
    cells = len(_CELL.findall(text))
    for x in lines:
        w = _WORD.findall(x.lower().replace("n/a", "0"))
        share = sum(len(a) > 1 and a in common for a in w) / len(w) if w else 0.0
        figures = sum(a.isdigit() for a in w)
        broad = len(_WIDE.findall(x)) if wide else 0
        if broad > 0.4 * len(x):
            good = broad >= 12 and len(_KANA.findall(x)) >= 0.25 * broad and not _RUN.search(x)
        else:
            good = len(w) >= 6 and share >= 0.15 and figures < 0.3 * len(w) and not _damaged(x)
        prose += len(x) * good
        begins = bool(_BULLET.match(x))
        bullets += begins
        few = len(w) <= 6
        short += few
        listed += len(x) * (not good and (begins or few))
    gaps, last = [], -1
    for i, hit in enumerate(is_common):
        if hit:
            gaps.append(i - last)
            last = i
    gaps.append(n - last)
    letters = "".join(_LETTERS.findall(lower))
    vowels = sum(k for c, k in Counter(letters).items() if c in "aeiouyäöüéèêàáíóúâîôûœ")
    sentences = max(1, len(re.findall(r"[.!?。！？](?:\s|$|(?<=[。！？]))", text)))
    pairs = set(zip(words, words[1:]))
    values = (
        n, solid / n if n else 0.0, symbols / size, ends / len(lines) if lines else 0.0, hits / n if n else 0.0,
        np.log1p(size), sum(k for c, k in kinds.items() if c.isdigit()) / size, digits / n if n else 0.0, sum(k for c, k in kinds.items() if c.isupper()) / size, len(_DAMAGE.findall(text)) / size, kana / max(1, wide) if wide > 0.2 * blank else 0.0,
        len(counts) / n if n else 0.0, max(counts.values()) / n if n else 1.0,
        float(-(chars * np.log2(chars)).sum()), sum(len(m.group()) for m in _RUN.finditer(text)) / size, max(map(len, words)) if n else 0, n / max(1, len(lines)), short / max(1, len(lines)), bullets / max(1, len(lines)), cells / max(1, n), tags / size,
        stops / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)), prose / max(1, sum(map(len, lines))), listed / max(1, sum(map(len, lines))), float(np.mean(gaps)), vowels / max(1, len(letters)), n / sentences, len(pairs) / max(1, n - 1), 1 - blank / size,
    )
    return [float(v) for v in values]


def _damaged(line: str) -> bool:
    return 20 * len(_DAMAGE.findall(line)) > len(line)
