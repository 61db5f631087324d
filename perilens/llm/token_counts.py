"""Operator 1: token counts that follow edits, from a segment tree of pre-tokens per document."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import tidied

#: Fixed value: the pre-token pattern of the byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: How far beyond its end a pre-token's match can look: the next character, and one more after white space.
LOOKS = 2
LEAF = 64

EDITS = "array<struct<start:int,end:int,text:string>>"
TREE = "struct<length:array<int>,tokens:array<int>,leaf:array<int>,char_sums:array<int>,token_sums:array<int>>"


def default_vocabulary() -> str:
    """Path of the public 50k rank file; BYTE_BPE_RANKS in the environment overrides it."""
    return os.environ.get("BYTE_BPE_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")


class Counter(dict):
    """Pre-token to its number of tokens, remembered for up to ``most`` of them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, most: int = 100_000):
        import tiktoken

        super().__init__()
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern, self.most, self.misses = regex.compile(pattern), most, 0

    @classmethod
    def load(cls, path: str) -> Counter:
        return cls(_ranks(path))

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.most:
            self.clear()
        self.misses += 1
        n = self[piece] = len(self.encoding.encode_ordinary(piece))
        return n


class CountTree:
    """Pre-token lengths and token counts in leaves of about LEAF, below a binary tree of character and token sums.

    ``leaf`` holds the number of pre-tokens of each leaf; node i of the tree has children 2i and 2i + 1, node 1
    is the whole text. A leaf takes or gives pre-tokens as edits come; one that outgrows 4 * LEAF makes the tree anew.
    """

    def __init__(self, lengths: list[int], tokens: list[int], leaf: list[int] | None = None, sums: tuple | None = None):
        n = len(lengths)
        leaf = [min(LEAF, n - i) for i in range(0, n, LEAF)] or [0] if leaf is None else leaf
        self.lengths, self.tokens, at = [], [], 0
        for k in leaf:
            self.lengths.append(lengths[at : at + k])
            self.tokens.append(tokens[at : at + k])
            at += k
        if sums is None:
            self._sum()
        else:
            self.char_sums, self.token_sums = (list(x) for x in sums)
        self.size = len(self.char_sums) // 2

    def _sum(self) -> None:
        self.size = 1 << max(0, len(self.lengths) - 1).bit_length()
        both = []
        for leaves in (self.lengths, self.tokens):
            level = [sum(x) for x in leaves] + [0] * (self.size - len(leaves))
            tree = [level]
            while len(level) > 1:
                level = [level[i] + level[i + 1] for i in range(0, len(level), 2)]
                tree.append(level)
            both.append([0] + [x for level in reversed(tree) for x in level])
        self.char_sums, self.token_sums = both

    @property
    def total(self) -> int:
        return self.token_sums[1]

    def find(self, position: int) -> tuple[int, int, int]:
        """(leaf, place in it, start) of the first pre-token that ends after ``position``; past the end, one beyond."""
        if position >= self.char_sums[1]:
            last = len(self.lengths) - 1
            return last, len(self.lengths[last]), self.char_sums[1]
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if start + self.char_sums[node] <= position:
                start += self.char_sums[node]
                node += 1
        k = node - self.size
        for i, n in enumerate(self.lengths[k]):
            if start + n > position:
                return k, i, start
            start += n
        raise AssertionError("sums and leaves differ")

    def splice(self, first: tuple[int, int], last: tuple[int, int], lengths: list[int], tokens: list[int]) -> None:
        """Pre-tokens from ``first`` up to but not including ``last`` give way to others; sums follow."""
        (a, i), (b, j) = first, last
        self.lengths[a], rest = self.lengths[a][:i] + lengths, (self.lengths[b][j:], self.tokens[b][j:])
        self.tokens[a] = self.tokens[a][:i] + tokens
        if a == b:
            self.lengths[a] += rest[0]
            self.tokens[a] += rest[1]
        else:
            for k in range(a + 1, b):
                self.lengths[k], self.tokens[k] = [], []
            self.lengths[b], self.tokens[b] = rest
        if len(self.lengths[a]) > 4 * LEAF:
            flat = [x for own in self.lengths for x in own], [x for own in self.tokens for x in own]
            self.__init__(*flat)
            return
        for k in range(a, b + 1):
            node = self.size + k
            chars, tokens_ = sum(self.lengths[k]) - self.char_sums[node], sum(self.tokens[k]) - self.token_sums[node]
            while node and (chars or tokens_):
                self.char_sums[node] += chars
                self.token_sums[node] += tokens_
                node //= 2

    def edit(self, text: str, start: int, end: int, new: str, counter: Counter) -> tuple[str, int]:
        """The text after one edit, and how many pre-tokens were encoded again.

        Matches before the edit stay if they end LOOKS characters before it. From the next one on the text is cut
        anew until a cut falls on an old one behind the edit: from there on both texts and so all matches are equal.
        """
        start = min(max(0, start), len(text))
        end = min(max(start, end), len(text))
        k, i, at = self.find(max(0, start - LOOKS))
        edited = text[:start] + new + text[end:]
        shift, safe = len(new) - (end - start), start + len(new)
        b, j, old = k, i, at
        lengths, tokens, place = [], [], at
        while True:
            if place >= safe:
                while old < place - shift and b < len(self.lengths):
                    if j < len(self.lengths[b]):
                        old += self.lengths[b][j]
                        j += 1
                    elif b + 1 < len(self.lengths):
                        b, j = b + 1, 0
                    else:
                        break
                if old == place - shift:
                    break
            m = counter.pattern.match(edited, place)
            if m is None:
                break
            lengths.append(m.end() - place)
            tokens.append(counter[m[0]])
            place = m.end()
        self.splice((k, i), (b, j), lengths, tokens)
        return edited, len(lengths)


_counters: dict[str, Counter] = {}


def _counter(shipped) -> Counter:
    path, ranks = shipped.value
    if path not in _counters:
        _counters[path] = Counter(ranks)
    _counters[path].clear()  # the encoder stays, what the last task remembered goes
    return _counters[path]


def _shipped(spark, path: str):
    """The rank table, of fixed size, goes to the tasks; each worker makes its encoder once."""
    return spark.sparkContext.broadcast((path, _ranks(path)))


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _pieces(batch: pa.RecordBatch, column: int, most: int = 4 << 20, rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` bytes of text; a longer text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for stop, size in enumerate(sizes.tolist()):
        if stop > start and (held + size > most or stop - start >= rows):
            yield batch.slice(start, stop - start)
            start, held = stop, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def _tree_array(trees: list[CountTree | None]) -> pa.Array:
    def flat(nested):
        return [x for own in nested for x in own]

    rows = [
        None if t is None else {"length": flat(t.lengths), "tokens": flat(t.tokens), "leaf": [len(x) for x in t.lengths], "char_sums": t.char_sums, "token_sums": t.token_sums}
        for t in trees
    ]
    ints = pa.list_(pa.int32())
    fields = ("length", "tokens", "leaf", "char_sums", "token_sums")
    valid = [r is not None for r in rows]
    columns = []
    for f in fields:
        own = [np.asarray(r[f] if r else [], np.int32) for r in rows]
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in own]))).astype(np.int32)
        columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(own) if own else np.zeros(0, np.int32))))
    return pa.StructArray.from_arrays(columns, fields=[pa.field(f, ints) for f in fields], mask=pa.array([not v for v in valid]))


def with_trees(docs: DataFrame, text_col: str = "text", out_col: str = "tree", vocabulary: str | None = None) -> DataFrame:
    """``docs`` with ``out_col``, the segment tree of each whole text, and ``n_tokens``, its root's token sum.

    A null text has a null tree and null n_tokens, an empty one an empty tree and 0. Columns of those names are
    replaced, all others kept; one pass, no shuffle; a document's tree is the only thing held beside its text.
    """
    rows = docs.drop(out_col, "n_tokens")
    schema = rows.select("*", F.lit(None).cast(TREE).alias(out_col), F.lit(None).cast("int").alias("n_tokens")).schema
    at = [c.lower() for c in rows.columns].index(text_col.lower())
    shipped = _shipped(docs.sparkSession, vocabulary or default_vocabulary())

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(shipped)
        for whole in batches:
            for b in _pieces(whole, at):
                trees = []
                for text in b.column(at).to_pylist():
                    pieces = counter.pattern.findall(text) if text is not None else None
                    trees.append(None if pieces is None else CountTree(list(map(len, pieces)), list(map(counter.__getitem__, pieces))))
                totals = pa.array([None if t is None else t.total for t in trees], pa.int32())
                yield pa.RecordBatch.from_arrays([*b.columns, _tree_array(trees), totals], names=[*whole.schema.names, out_col, "n_tokens"])

    return rows.mapInArrow(run, schema)


def apply_edits(rows: DataFrame, text_col: str = "text", edits_col: str = "edits", tree_col: str = "tree", vocabulary: str | None = None) -> DataFrame:
    """``rows`` after their edits: text, tree and n_tokens are the edited ones, ``n_encoded_again`` counts pre-tokens.

    ``edits_col`` holds structs (start, end, text) in characters of the text as it was; they are clamped to it, and
    one that starts before the end of the one before it starts there instead. They are applied from the last to the
    first, each encoding again only what it touches and the context that its boundaries need. Null or no
    edits change nothing; a null text stays null; a null replacement deletes.
    """
    out = rows.drop("n_tokens", "n_encoded_again")
    schema = out.select("*", F.lit(None).cast("int").alias("n_tokens"), F.lit(None).cast("int").alias("n_encoded_again")).schema
    names = [c.lower() for c in out.columns]
    t_at, e_at, tree_at = (names.index(c.lower()) for c in (text_col, edits_col, tree_col))
    shipped = _shipped(rows.sparkSession, vocabulary or default_vocabulary())

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(shipped)
        for whole in batches:
            for b in _pieces(whole, t_at):
                texts, trees, again = b.column(t_at).to_pylist(), [], []
                column = b.column(tree_at)
                parts = [column.field(f) for f in ("length", "tokens", "leaf", "char_sums", "token_sums")]
                for r, edits in enumerate(b.column(e_at).to_pylist()):
                    if texts[r] is None or not column[r].is_valid:
                        trees.append(None)
                        again.append(None)
                        continue
                    lengths, tokens, leaf, *sums = (x[r].values.to_numpy().tolist() for x in parts)
                    tree = CountTree(lengths, tokens, leaf, sums)
                    todo, floor, n = [], 0, len(texts[r])
                    for e in sorted((e for e in edits or [] if e and e["start"] is not None), key=lambda e: e["start"]):
                        first = min(max(e["start"], floor), n)
                        floor = min(max(first, e["end"] if e["end"] is not None else first), n)
                        todo.append((first, floor, e["text"] or ""))
                    count = 0
                    for first, last, new in reversed(todo):
                        texts[r], k = tree.edit(texts[r], first, last, new, counter)
                        count += k
                    trees.append(tree)
                    again.append(count)
                columns = list(b.columns)
                columns[t_at], columns[tree_at] = pa.array(texts, pa.string()), _tree_array(trees)
                totals = pa.array([None if t is None else t.total for t in trees], pa.int32())
                yield pa.RecordBatch.from_arrays([*columns, totals, pa.array(again, pa.int32())], names=[*whole.schema.names, "n_tokens", "n_encoded_again"])

    return out.mapInArrow(run, schema)


def sample_edits(text: Column) -> Column:
    """Three edits that a text itself decides: a deletion, an insertion and a replacement at its end."""
    n = F.length(text)
    spot = F.pmod(F.crc32(text.cast("binary")), n + 1).cast("int")
    third = (n / 3).cast("int")
    one = F.struct(third.alias("start"), (third + 5).alias("end"), F.lit("").alias("text"))
    two = F.struct(spot.alias("start"), spot.alias("end"), F.lit(" inserted words ").alias("text"))
    three = F.struct((n - 4).alias("start"), n.alias("end"), F.lit("'s end.").alias("text"))
    return F.when(text.isNotNull(), F.array(one, two, three)).cast(EDITS)
