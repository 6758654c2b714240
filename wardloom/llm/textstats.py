"""Statistics of single texts, as used by the classifiers."""

from __future__ import annotations

import numpy as np

from .common import hash_words, windows

#: Characters that count as symbols.
SYMBOLS = b"[#*$%&|<>]"
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\x0b\x0c\r")] = True
_TAIL = np.zeros(256, bool)
_TAIL[0x80:0xC0] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[list(b"!?.,;:'\"()-")] = True


def byte_counts(text: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(text, np.uint8), minlength=256)


def repeated_words(hashes: np.ndarray, width: int = 3) -> int:
    """Words that stand in a window of ``width`` words found twice or more."""
    if len(hashes) < width:
        return 0
    got = windows(hashes, width)
    _, back, count = np.unique(got, return_inverse=True, return_counts=True)
    twice = count[back] > 1
    if not twice.any():
        return 0
    covered = np.zeros(len(hashes), bool)
    for j in range(width):
        covered[j : j + len(twice)] |= twice
    return int(covered.sum())


def repeated_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and all lines with a word."""
    seen: set[bytes] = set()
    again = lines = 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                again += 1
            else:
                seen.add(line)
    return again, lines


def base_counts(text: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; all 0 for null."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.split()
    counts = byte_counts(text)
    chars = int(counts[~_TAIL & ~_SPACE].sum())
    return len(words), chars, int(counts[_SYMBOL].sum()), repeated_lines(text)[0], repeated_words(hash_words(words))


N_QUALITY = 18


def quality_features(text: bytes | None) -> list[float]:
    """``N_QUALITY`` statistics of a text; a text without words gives zeros."""
    words = text.split() if text else []
    n = len(words)
    if not n:
        return [0.0] * N_QUALITY
    counts = byte_counts(text)
    size = len(text)
    h = hash_words(words)
    length = np.fromiter(map(len, words), np.int64, n)
    _, each = np.unique(h, return_counts=True)
    again, lines = repeated_lines(text)
    share = each / n
    last = np.fromiter((w[-1] for w in words), np.uint8, n)
    first = np.fromiter((w[0] for w in words), np.uint8, n)
    chars = max(1, int(counts[~_TAIL & ~_SPACE].sum()))
    letters = max(1, int(counts[_UPPER | _LOWER].sum() + counts[0xC0:].sum()))
    return [
        float(np.log1p(n)),
        chars / n,
        float(length.std()),
        len(each) / n,
        float(-(share * np.log(share)).sum() / np.log(n + 1.0)),
        float(each.max() / n),
        repeated_words(h) / n,
        again / max(1, lines),
        float(np.log1p(n / max(1, lines))),
        int(counts[_SYMBOL].sum()) / chars,
        int(counts[_DIGIT].sum()) / chars,
        int(counts[_PUNCT].sum()) / chars,
        int(counts[_UPPER].sum()) / letters,
        int(counts[33]) / n,
        int(counts[0xC0:].sum()) / chars,
        float((_SYMBOL[last] | (last == 33)).mean()),
        float(_UPPER[first].mean()),
        (size - int(counts[_SPACE].sum())) / size,
    ]
