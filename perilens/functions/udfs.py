"""The few functions that SQL lacks, as vectorised UDFs: exact Unicode folding, all character references, similarity."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Sequence
from html.entities import html5

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _folded(text: pd.Series) -> pd.Series:
    return text.fillna("").map(lambda t: "".join(unicodedata.normalize("NFKC", t).split()).casefold().replace("臺", "台"))


def _unescaped(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else html.unescape(t))


_CLOSED = re.compile("&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def _closed_unescaped(text: pd.Series) -> pd.Series:
    known = lambda m: html.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0]
    return text.map(lambda t: None if t is None else _CLOSED.sub(known, t))


def compact_exact(text: Column) -> Column:
    """NFKC, no white space, casefold, 臺 as 台; missing gives the empty text."""
    return F.pandas_udf(_folded, "string")(text)


def unescape(text: Column, closed: bool = False) -> Column:
    """All character references decoded; with ``closed`` only those that a semicolon ends, so what a cut left of one stays as it is."""
    return F.pandas_udf(_closed_unescaped if closed else _unescaped, "string")(text)


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, one bit per character of ``a``."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """2 * LCS / (len a + len b): 1 for equal texts, two empty ones included."""
    return 2 * common_subsequence(a, b) / (len(a) + len(b)) if a or b else 1.0


def partial(a: str, b: str) -> float:
    """The best ratio of the shorter text with a window of its length in the longer one, windows at the ends shortened."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return float(not long)
    n = len(short)
    return max(ratio(short, long[max(0, i) : i + n]) for i in range(1 - n, len(long)))


def by_tokens(a: str, b: str) -> tuple[str, str, str, str, str]:
    x, y = set(a.split()), set(b.split())
    common = " ".join(sorted(x & y))
    left, right = (" ".join([common, *sorted(z)]).strip() for z in (x - y, y - x))
    return " ".join(sorted(a.split())), " ".join(sorted(b.split())), common, left, right


def token_set(a: str, b: str) -> float:
    _, _, common, left, right = by_tokens(a, b)
    if common and (left == common or right == common):
        return 1.0
    return max(ratio(left, right), *((ratio(common, left), ratio(common, right)) if common else (0.0, 0.0)))


def weighted(a: str, b: str) -> float:
    """The best of the plain, token and (for texts of unlike length) partial ratios, the latter scaled down."""
    if not a or not b:
        return 0.0
    sort_a, sort_b, *_ = by_tokens(a, b)
    scale = max(len(a), len(b)) / min(len(a), len(b))
    best = ratio(a, b)
    if scale < 1.5:
        return max(best, 0.95 * max(ratio(sort_a, sort_b), token_set(a, b)))
    part = 0.9 if scale <= 8 else 0.6
    return max(best, part * partial(a, b), 0.95 * part * max(partial(sort_a, sort_b), token_set(a, b)))


def name_similarity(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    sort_a, sort_b, *_ = by_tokens(a, b)
    return max(ratio(sort_a, sort_b), partial(a, b), weighted(a, b))


MOST_BITS = 63


def _codes(texts: Sequence[str], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Characters of texts as a matrix padded with ``pad``, and the texts' lengths."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.full((len(texts), max(1, int(lengths.max(initial=0)))), pad, np.int32)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.int32)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out, lengths


def _common(a: np.ndarray, n: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``common_subsequence`` of each row of ``a`` (lengths n, at most MOST_BITS) and of ``b``, one column of ``b`` at a time."""
    bit = np.uint64(1) << np.arange(a.shape[1], dtype=np.uint64)
    full = (np.uint64(1) << n.astype(np.uint64)) - np.uint64(1)
    row = full.copy()
    for j in range(b.shape[1]):
        hit = row & ((a == b[:, j : j + 1]) * bit).sum(1, dtype=np.uint64)
        row = ((row + hit) | (row - hit)) & full
    return n - np.bitwise_count(row)


def ratios(pairs: Sequence[tuple[str, str]]) -> list[float]:
    """``ratio`` of many pairs at once; texts beyond MOST_BITS characters one by one."""
    out = [0.0] * len(pairs)
    short = [i for i, (a, b) in enumerate(pairs) if min(len(a), len(b)) <= MOST_BITS]
    for i in set(range(len(pairs))) - set(short):
        out[i] = ratio(*pairs[i])
    for start in range(0, len(short), 4096):
        some = short[start : start + 4096]
        ordered = [sorted(pairs[i], key=len) for i in some]
        (a, n), (b, m) = _codes([x for x, _ in ordered], -1), _codes([y for _, y in ordered], -2)
        both = n + m
        found = np.where(both > 0, 2 * _common(a, n, b) / np.maximum(both, 1), 1.0)
        for i, r in zip(some, found.tolist()):
            out[i] = r
    return out


def partials(pairs: Sequence[tuple[str, str]]) -> list[float]:
    """``partial`` of many pairs at once: all windows of one end together."""
    out = [0.0] * len(pairs)
    short = [i for i, (a, b) in enumerate(pairs) if 0 < min(len(a), len(b)) <= MOST_BITS]
    for i in set(range(len(pairs))) - set(short):
        out[i] = partial(*pairs[i])
    for start in range(0, len(short), 4096):
        some = short[start : start + 4096]
        ordered = [(a, b) if len(a) <= len(b) else (b, a) for a, b in (pairs[i] for i in some)]
        (a, n), (b, m) = _codes([x for x, _ in ordered], -1), _codes([y for _, y in ordered], -2)
        best = np.zeros(len(some))
        step = np.arange(a.shape[1])
        for stop in range(1, int((n + m).max())):
            begin, end = np.maximum(0, stop - n), np.minimum(stop, m)
            at = begin[:, None] + step
            window = np.where(at < end[:, None], np.take_along_axis(b, np.minimum(at, b.shape[1] - 1), 1), -2)
            size = np.maximum(0, end - begin)
            best = np.maximum(best, np.where(size > 0, 2 * _common(a, n, window) / (n + size), 0.0))
        for i, r in zip(some, best.tolist()):
            out[i] = r
    return out


def name_similarities(pairs: Sequence[tuple[str, str]]) -> list[float]:
    """``name_similarity`` of many pairs: each distinct pair once, and their ratios and partial ratios all at once."""
    distinct = {p: None for p in pairs if p[0] and p[1]}
    tokens = {p: by_tokens(*p) for p in distinct}
    plain = {q: 0.0 for p, (x, y, common, left, right) in tokens.items() for q in (p, (x, y), (left, right), (common, left), (common, right))}
    windows = {q: 0.0 for p, (x, y, *_) in tokens.items() for q in (p, (x, y))}
    plain.update(zip(plain, ratios(list(plain))))
    windows.update(zip(windows, partials(list(windows))))
    for p, (x, y, common, left, right) in tokens.items():
        tokens_alike = 1.0 if common and (left == common or right == common) else max(plain[left, right], *((plain[common, left], plain[common, right]) if common else (0.0, 0.0)))
        scale = max(map(len, p)) / min(map(len, p))
        part = 0.9 if scale <= 8 else 0.6
        if scale < 1.5:
            best = max(plain[p], 0.95 * max(plain[x, y], tokens_alike))
        else:
            best = max(plain[p], part * windows[p], 0.95 * part * max(windows[x, y], tokens_alike))
        distinct[p] = max(plain[x, y], windows[p], best)
    return [distinct.get(p, 0.0) for p in pairs]


class Texts:
    """Distinct texts that one text at a time is held against, by one bit per character of it for all of them at once.

    Texts with a common beginning share the steps over it. What has white space (if ``words``) or is too long counts as alike.
    """

    def __init__(self, texts: Sequence[str], words: bool = False):
        distinct = sorted(set(texts))
        place = {t: i for i, t in enumerate(distinct)}
        self.texts, self.words = distinct, words
        self.of = np.fromiter((place[t] for t in texts), np.int64, len(texts))
        codes, self.lengths = _codes(distinct, -1)
        self.alphabet = np.unique(codes[codes >= 0])
        self.codes = np.where(codes < 0, len(self.alphabet), np.searchsorted(self.alphabet, codes))
        self.odd = np.array([words and t.split() != [t] and t != "" for t in distinct], bool)
        self.steps, start, above = [], np.zeros(len(distinct), bool), np.zeros(len(distinct), np.int64)
        start[:1] = True
        for j in range(self.codes.shape[1]):
            start[1:] |= self.codes[1:, j] != self.codes[:-1, j]
            first = np.flatnonzero(start)
            self.steps.append((above[first], self.codes[first, j]))
            above = np.cumsum(start) - 1
        self.last = above

    def _masks(self, text: str) -> np.ndarray:
        masks = np.zeros(len(self.alphabet) + 1, np.uint64)
        for i, ch in enumerate(text):
            at = int(np.searchsorted(self.alphabet, ord(ch)))
            if at < len(self.alphabet) and self.alphabet[at] == ord(ch):
                masks[at] |= np.uint64(1 << i)
        return masks

    def most(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """An upper bound of ``partial`` and ``ratio`` with each text (0 where either is empty), and the best of the windows at the beginning of texts of equal length.

        With l characters in common and the shorter text's n, a window that holds them has no fewer: 2l / (n + l).
        """
        n = len(text)
        if not n:
            return np.zeros(len(self.texts)), np.zeros(len(self.texts))
        if n > MOST_BITS or self.words and text.split() != [text]:
            return np.where(self.lengths > 0, 1.0, 0.0), np.zeros(len(self.texts))
        masks, full = self._masks(text), np.uint64((1 << n) - 1)
        row, best = np.array([full]), np.zeros(1)
        for j, (above, code) in enumerate(self.steps):
            row = row[above]
            hit = row & masks[code]
            row = ((row + hit) | (row - hit)) & full
            best = best[above]
            if j < n:
                best = np.maximum(best, np.where(code < len(self.alphabet), 2 * (n - np.bitwise_count(row).astype(np.int64)) / (n + j + 1), 0.0))
        common = n - np.bitwise_count(row[self.last]).astype(np.int64)
        bound = 2 * common / (np.minimum(self.lengths, n) + common).clip(1)
        return np.where(self.odd, 1.0, bound), best[self.last]

    def exact(self, text: str, some: np.ndarray, best: np.ndarray) -> np.ndarray:
        """``partial``, or ``name_similarity`` if ``words``, with the texts ``some``; ``best`` as ``most`` gives it. ``text`` isn't empty."""
        n, out = len(text), np.zeros(len(some))
        easy = (self.lengths[some] == n) & ~self.odd[some] if n <= MOST_BITS and not (self.words and text.split() != [text]) else np.zeros(len(some), bool)
        at = np.flatnonzero(easy)
        if len(at):
            masks, full = self._masks(text[::-1]), np.uint64((1 << n) - 1)
            codes, row, found = self.codes[some[at]], np.full(len(at), full), best[some[at]]
            for j in range(n):
                hit = row & masks[codes[:, n - 1 - j]]
                row = ((row + hit) | (row - hit)) & full
                found = np.maximum(found, 2 * (n - np.bitwise_count(row).astype(np.int64)) / (n + j + 1))
            out[at] = found
        if len(at := np.flatnonzero(~easy)):
            out[at] = (name_similarities if self.words else partials)([(text, self.texts[i]) for i in some[at]])
        return out


def _names(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(name_similarities(list(zip(a.fillna(""), b.fillna("")))), dtype="float64")


def _partials(a: pd.Series, b: pd.Series) -> pd.Series:
    pairs = list(zip(a.fillna(""), b.fillna("")))
    distinct = {p: 0.0 for p in pairs}
    distinct.update(zip(distinct, partials(list(distinct))))
    return pd.Series([distinct[p] for p in pairs], dtype="float64")


def name_score(a: Column, b: Column) -> Column:
    """0 to 1 for two normalised names; 0 where either is empty."""
    # Not called again where a filter follows: Spark repeats what it takes for deterministic.
    return F.pandas_udf(_names, "double").asNondeterministic()(a, b)


def address_score(a: Column, b: Column, district: Column, raw: Column, off_district: float = 0.3) -> Column:
    """Partial similarity of two normalised addresses, cut to ``off_district`` where the raw one lacks the district.

    0.5 where both are empty, 0 where one is.
    """
    base = F.when((a == "") & (b == ""), 0.5).when((a == "") | (b == ""), 0.0).otherwise(F.pandas_udf(_partials, "double").asNondeterministic()(a, b))
    inside = (F.coalesce(district, F.lit("")) == "") | F.coalesce(raw.contains(district), F.lit(False))
    return F.when((a == "") & (b == ""), base).otherwise(F.least(F.lit(1.0), base * F.when(inside, 1.0).otherwise(off_district)))


__all__: Sequence[str] = ("address_score", "compact_exact", "name_score", "unescape")
