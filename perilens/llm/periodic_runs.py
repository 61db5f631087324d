"""Operator 13: periodic runs of words, by the branching-tandem test over the LCP intervals of a suffix array."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import tidied

#: Words of several documents that share one suffix array; a longer document has one of its own.
LOT_WORDS = 1 << 16
NONE = np.zeros(0, np.int64)


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix array, its inverse, LCP of each suffix with the one before it) of a text of numbers from 0 whose last one occurs once.

    Prefix doubling: a suffix's rank is the place of the first suffix with the same prefix, so only suffixes that still share
    theirs are sorted again. The ranks of all rounds then tell the LCPs: two suffixes of equal rank in round t share 2 ** t words.
    """
    n = len(text)
    sizes = np.bincount(text)
    rank = (np.cumsum(sizes) - sizes)[text]
    rounds = [rank.astype(np.int32)]
    left, width = np.flatnonzero(sizes[text] > 1), 1
    while len(left):
        key = rank[left] * n + rank[left + width]
        order = np.argsort(key)
        left, key = left[order], key[order]
        old = rank[left]
        place = np.arange(len(left))
        top = np.maximum.accumulate(np.where(np.append(True, old[1:] != old[:-1]), place, 0))
        new = np.append(True, key[1:] != key[:-1])
        first = np.maximum.accumulate(np.where(new, place, 0))
        rank = rank.copy()
        rank[left] = old + first - top
        rounds.append(rank.astype(np.int32))
        left, width = left[~(new & np.append(new[1:], True))], 2 * width
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    lcp = np.zeros(n, np.int64)
    at = np.arange(1, n)
    levels = []
    for ranks in rounds:
        at = at[ranks[suffixes[at - 1]] == ranks[suffixes[at]]]
        levels.append(at)
    for t in range(len(rounds) - 1, -1, -1):
        at = levels[t]
        same = at[rounds[t][suffixes[at - 1] + lcp[at]] == rounds[t][suffixes[at] + lcp[at]]]
        lcp[same] += 1 << t
    return suffixes, rank, lcp


def intervals(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, head) of each place k of an LCP array: the next smaller value to the left, the next that isn't greater to the
    right, and the first place of the same value in k's LCP interval, which names the interval.

    The suffixes k to right[k] - 1 are a child of the interval; its first child goes from left to head - 1.
    """
    n, values = len(lcp), lcp.tolist()
    left, right, head = [0] * n, [n] * n, list(range(n))
    places, held = [0], [-1]
    for k in range(1, n):
        value, first = values[k], k
        while held[-1] >= value:
            top = places.pop()
            right[top] = k
            if held.pop() == value:
                first = head[top]
        left[k], head[k] = places[-1], first
        places.append(k)
        held.append(value)
    return np.array(left), np.array(right), np.array(head)


def branching_squares(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, root length) of every square ww of ``text`` that the word after it does not carry on, each once.

    Such a square of root length d starts at i exactly if i and i + d are in one LCP interval of depth d, and in different
    children of it. One of the two is outside the interval's largest child, so for each suffix of the smaller children
    the inverse suffix array is asked for i + d and i - d: n log n questions in all, however long the repeats are.
    """
    suffixes, inverse, lcp = suffix_array(text)
    left, right, head = intervals(lcp)
    k = np.flatnonzero(lcp > 0)
    if not len(k):
        return NONE, NONE
    last = np.zeros(len(lcp), np.int64)
    np.maximum.at(last, head[k], right[k])
    first = k[head[k] == k]
    begin, end, owner = np.concatenate((k, left[first])), np.concatenate((right[k], first)), np.concatenate((head[k], first))
    size = end - begin
    most = np.zeros(len(lcp), np.int64)
    np.maximum.at(most, owner, size)
    largest, full = np.zeros(len(lcp), np.int64), np.flatnonzero(size == most[owner])
    largest[owner[full]] = full  # of several the last; any one will do
    small = np.flatnonzero(largest[owner] != np.arange(len(owner)))
    size = size[small]
    x = np.repeat(begin[small] - np.cumsum(size) + size, size) + np.arange(size.sum())
    owner = np.repeat(owner[small], size)
    depth, low, high, i = lcp[owner], left[owner], last[owner], suffixes[x]
    starts, roots = [], []
    for j, start in ((i + depth, i), (i - depth, i - depth)):
        there = inverse[np.maximum(j, 0)]
        met = np.flatnonzero((j >= 0) & (low <= there) & (there < high))
        s, d = start[met], depth[met]
        apart = text[s + d] != text[s + 2 * d]
        starts.append(s[apart])
        roots.append(d[apart])
    key = np.unique(np.concatenate(starts) * len(text) + np.concatenate(roots))
    return key // len(text), key % len(text)


def _start(text: np.ndarray, start: int, root: int) -> int:
    """Where the run of a square begins: the square is moved to the left as long as its words come back ``root`` later."""
    high, width = start, 64
    while high:
        low = max(0, high - width)
        other = np.flatnonzero(text[low:high] != text[low + root : high + root])
        if len(other):
            return low + int(other[-1]) + 1
        high, width = low, 4 * width
    return 0


def runs(text: np.ndarray, least: int = 24, powers: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run of at least ``least`` words and ``powers`` periods, by start and period.

    ``text``: numbers from 0, the first and the last of which occur once, and any that no run may cross. Each run has
    one branching square of its period, at its end. Moved to the left it gives the run's start. Squares whose
    root is itself a power lie in the run of a smaller root with the same end, and are left out.
    """
    if powers < 2:
        raise ValueError("a run has two periods or more")
    start, root = branching_squares(text)
    need = np.maximum(least, powers * root) - 2 * root
    for step in range(1, max(1, min(need.min(initial=least), 16)) + 1):
        ok = (need < step) | (start >= step)
        ok[ok] = (need[ok] < step) | (text[start[ok] - step] == text[start[ok] - step + root[ok]])
        start, root, need = start[ok], root[ok], need[ok]
    order = np.lexsort((root, start + 2 * root))
    found, end, here = [], -1, []
    for s, d in zip(start[order].tolist(), root[order].tolist()):
        if s + 2 * d != end:
            end, here = s + 2 * d, []
        if any(d % q == 0 and 2 * d <= length for q, length in here):
            continue
        begin = _start(text, s, d)
        here.append((d, end - begin))
        if end - begin >= max(least, powers * d):
            found.append((begin, end - begin, d))
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """True for each of ``n`` words that no run holds after its first period."""
    kept = np.ones(n, bool)
    for start, length, period in found:
        kept[start + period : start + length] = False
    return kept


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def lot_runs(lot: list[list[bytes]], least: int, powers: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each of several lists of words, found in one text in which a number of its own stands before each list and at the end."""
    numbers = _Numbers()
    bounds = np.concatenate(([0], np.cumsum([len(words) + 1 for words in lot])))
    text = np.empty(bounds[-1] + 1, np.int64)
    for at, words in zip(bounds.tolist(), lot):
        text[at + 1 : at + 1 + len(words)] = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    text[bounds] = len(numbers) + np.arange(len(bounds))
    out = [[] for _ in lot]
    found = runs(text, least, powers)
    for (start, length, period), k in zip(found, np.searchsorted(bounds, [r[0] for r in found], "right").tolist()):
        out[k - 1].append((start - int(bounds[k - 1]) - 1, length, period))
    return out


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 24, powers: int = 3) -> DataFrame:
    """(doc_id, n_words, runs array<struct<start, length, period>>, collapsed) for every row of ``docs``.

    A run is a maximal stretch of words ``[^\\x20\\x09-\\x0D]+``, compared as they are, whose smallest period occurs ``powers`` times or
    more, of at least ``least`` words. Runs come by start and period, starts count words from 0. ``collapsed`` is the text's words,
    without those that a run holds after its first period, joined by single spaces.

    Nothing is shuffled: a task reads its rows once. Documents share a suffix array in lots of about LOT_WORDS words; a longer one is
    treated whole by itself, with some 200 bytes a word. A null or empty text, or one of white space, has no words, no runs and the
    empty text. Null and repeated ids are rows like any other; an empty table gives an empty one.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    number = pa.int64()
    struct = pa.struct([("start", number), ("length", number), ("period", number)])

    def settled(ids: list, lot: list[list[bytes]]) -> pa.RecordBatch:
        found = lot_runs(lot, least, powers)
        texts = [b" ".join([w for w, keep in zip(words, kept_words(len(words), own)) if keep] if own else words) for words, own in zip(lot, found)]
        flat = np.array([r for own in found for r in own], np.int64).reshape(-1, 3)
        offsets = np.concatenate(([0], np.cumsum([len(own) for own in found]))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in flat.T], fields=list(struct)))
        columns = [pa.concat_arrays(ids), pa.array([len(words) for words in lot], number), lists, pa.array(texts, pa.binary()).view(pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lot, held = [], [], 0
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            for i in range(b.num_rows):
                words = (texts[i].as_py() or b"").split()
                if lot and held + len(words) > LOT_WORDS:
                    yield settled(ids, lot)
                    ids, lot, held = [], [], 0
                ids.append(b.column(0).slice(i, 1))
                lot.append(words)
                held += len(words)
        if lot:
            yield settled(ids, lot)

    return rows.mapInArrow(run, f"doc_id {id_type}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
