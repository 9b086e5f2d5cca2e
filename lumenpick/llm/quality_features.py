"""Document statistics used by the quality classifier.

Every statistic is a function of the text alone; language, source and ids are
never looked at.  The transforms (logs, square roots of rates) bring the
statistics close to bell shapes, which is what a Gaussian discriminant needs.  Rates carry small
pseudo-counts, so that one symbol or number in a very short text stays a weak sign.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np

FEATURES = (
    "log_words",
    "log_lines",
    "word_len",
    "word_len_spread",
    "letters",
    "capitals",
    "sentence_ends",
    "commas",
    "symbols",
    "brackets",
    "distinct_words",
    "top_word",
    "repeated_lines",
    "log_line_len",
    "char_entropy",
    "compression",
    "symbol_words",
)

_LETTER, _UPPER, _END, _COMMA, _SYMBOL, _BRACKET, _SPACE = range(7)


def _byte_classes() -> np.ndarray:
    table = np.zeros((256, 7))
    for b in range(256):
        ch = chr(b)
        if b >= 128 or ch.isalpha():
            table[b, _LETTER] = 1
        if b < 128 and ch.isupper():
            table[b, _UPPER] = 1
        if ch in ".!?":
            table[b, _END] = 1
        elif ch in ",;:":
            table[b, _COMMA] = 1
        elif ch in "()[]{}<>|":
            table[b, _BRACKET] = 1
        elif b in (9, 10, 11, 12, 13, 32):
            table[b, _SPACE] = 1
        elif b < 128 and not ch.isalnum():
            table[b, _SYMBOL] = 1
    return table


_CLASSES = _byte_classes()


def document_features(text: str | None) -> np.ndarray:
    """One row of FEATURES.  Null and blank texts give the row of an empty text."""
    out = np.zeros(len(FEATURES))
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    if not words:
        return out
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(float)
    per_class = counts @ _CLASSES
    solid = max(1.0, len(raw) - per_class[_SPACE])
    n = len(words)
    lengths = np.fromiter(map(len, words), np.float64, n)
    tally = Counter(words)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    p = counts[counts > 0] / len(raw)
    packed = len(zlib.compress(raw, 1))
    odd = sum(c for w, c in tally.items() if w[-1:] in b"%*#$&@~^=+_|")
    root = np.sqrt
    out[:] = (
        np.log1p(n),
        np.log1p(len(lines)),
        lengths.mean(),
        np.log1p(lengths.std()),
        (per_class[_LETTER] + 38) / (solid + 40),
        root((per_class[_UPPER] + 1) / (solid + 40)),
        root((per_class[_END] + 1) / (n + 8)),
        root((per_class[_COMMA] + 1) / (n + 8)),
        root(per_class[_SYMBOL] / (solid + 80)),
        root(per_class[_BRACKET] / (solid + 80)),
        np.log(len(tally) / n) / max(1.0, np.log1p(n)),
        root((max(tally.values()) + 1) / (n + 20)),
        root((len(lines) - len(set(lines))) / (len(lines) + 8)),
        np.log1p(len(raw) / max(1, len(lines))),
        -(p * np.log2(p)).sum(),
        packed / len(raw) + 8 / len(raw),
        root(odd / (n + 16)),
    )
    return out
