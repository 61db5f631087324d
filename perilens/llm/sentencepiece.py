"""Operator 9: SentencePiece encoding and decoding as a shortest path through a weighted transducer."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import tidied

SPACE = "▁"
#: Segments end where a piece never continues: before a space that follows a word, and around line ends.
SEGMENT = re.compile(r"\n| *[^ \n]+| +")
LONG = 48
START, UNKNOWN = -1, -2
NEVER = 1 << 30  # the infinite weight


def default_model() -> str:
    """Path of the public 32k model with byte fallback; PIECE_MODEL in the environment overrides it."""
    return os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


class Memory(dict):
    """Segment to its number, and each number's piece ids; new segments wait in ``new``. Forgets all beyond ``most`` characters."""

    def __init__(self, most: int = 3 << 19):
        self.most, self.chars, self.new, self.blobs = most, 0, [], []

    def __missing__(self, segment: str) -> int:
        self[segment] = number = len(self)
        self.new.append(segment)
        self.chars += len(segment)
        return number

    def forget(self) -> None:
        if self.chars > self.most:
            self.clear()
            self.chars, self.blobs = 0, []


class Transducer:
    """The compiled machine: normaliser, piece trie, byte fallback and the weights of following pieces.

    Normaliser: a space before the text, and every space as U+2581. Piece arcs come from the trie of all pieces; a character
    that no piece starts with takes its UTF-8 bytes as arcs. A state is (position, last piece). An arc weighs 1, the
    tropical weight of one more piece, if its piece may follow the last one, and infinity if not; ``paths`` relaxes all
    arcs into a position by (min, +) and keeps the least sum with the arc that gave it.

    Why this is the model's own output. Let a sequence of pieces be *stable* if every piece alone, and every two neighbours
    joined, are merged back into themselves by the model's merges. (1) The model's output is stable: its merges inside a
    piece, or inside two neighbours, are made in the same order as in the whole text, as a merge across the border of two output
    pieces was never the best one while it was open. (2) No other sequence is: take the first merge by which the merging of
    the text leaves the sequence's pieces; it joins symbols on both sides of a border between two of them, and as it is
    the best one of the whole text then, it is the best one of those two pieces joined, which are thus not merged back into
    themselves. So there is exactly one path of finite weight, one last piece at each position that it can reach is enough
    (a prefix of a stable sequence is stable, and unique for its text), and the least sum is its number of pieces.
    """

    def __init__(self, pieces: list[str], scores: list[float], special: set[int], byte_ids: list[int]):
        self.pieces, self.byte_ids = pieces, byte_ids
        self.rank = {p: (-s, i) for i, (p, s) in enumerate(zip(pieces, scores)) if i not in special}
        self.ids = {p: i for i, p in enumerate(pieces) if i not in special}
        special_text = {i: bytes([byte_ids.index(i)]) if i in byte_ids else b"" for i in special}
        self.output = [special_text[i] if i in special else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.follows: dict[tuple[int, int], bool] = {}
        # Merges by turn: characters first, then pieces, the best one first; what each alone was last merged from.
        turns = sorted(self.ids, key=lambda p: (len(p) > 1, self.rank[p] if len(p) > 1 else (0, self.ids[p])))
        at = {p: k for k, p in enumerate(turns)}
        self.turn = np.full(len(pieces), -1, np.int64)
        self.turn[[self.ids[p] for p in turns]] = np.arange(len(turns))
        self.first, self.second = np.arange(len(pieces)), np.arange(len(pieces))
        self.alone, joins = set(), []
        for p, i in self.ids.items():
            parts = [p] if len(p) == 1 else self.merged(list(p), 2)
            if len(p) == 1 or (len(parts) == 2 and self.merged(list(p)) == [p] and parts[0] in at and parts[1] in at):
                self.alone.add(i)
                if len(p) > 1:
                    self.first[at[p]], self.second[at[p]] = at[parts[0]], at[parts[1]]
                    joins.append((at[parts[0]] * len(pieces) + at[parts[1]], at[p]))
        self.joins, self.joined = np.array(sorted(joins), np.int64).reshape(-1, 2).T.copy()
        # The trie, as one sorted table of (node, character) keys.
        children: dict[tuple[int, str], int] = {}
        piece_at = [-1]
        for p, i in self.ids.items():
            node = 0
            for ch in p:
                nxt = children.get((node, ch))
                if nxt is None:
                    nxt = children[node, ch] = len(piece_at)
                    piece_at.append(-1)
                node = nxt
            piece_at[node] = i if i in self.alone else -1
        self.piece_at = np.array(piece_at, np.int32)
        self.child, self.piece_list = {(n << 21) | ord(ch): to for (n, ch), to in children.items()}, piece_at
        keys = np.fromiter(self.child, np.int64, len(children))
        order = np.argsort(keys)
        self.keys, self.next = keys[order], np.fromiter(children.values(), np.int64)[order]
        self.longest = max(map(len, self.ids))
        self.width = np.array([len(p) for p in pieces], np.int64)

    @classmethod
    def load(cls, model: str) -> Transducer:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=model)
        n = sp.vocab_size()
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)}
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        # What the machine takes for granted; a model that is otherwise would get other ids than its library gives.
        inner = [p for i in range(n) if i not in special and (SPACE in (p := sp.id_to_piece(i)).lstrip(SPACE) or "\n" in p)]
        probe = "ﬁ Ａ①  x\u00a0y\n z\t\U0001f9ff e\u0301 "
        if inner or not all(map(sp.is_byte, byte_ids)) or sp.decode(sp.encode(probe)) != probe or not sp.id_to_piece(sp.encode("a")[0]).startswith(SPACE):
            raise ValueError(f"{model}: only models with byte fallback, an identity normaliser and a space put first, whose pieces have no inner spaces or line ends, are served")
        return cls([sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)], special, byte_ids)

    def merged(self, symbols: list[str], most: int = 1) -> list[str]:
        """What the model's merges make of a list of symbols: the best-ranked neighbours first, left before right; stops at ``most``."""
        while len(symbols) > most:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                rank = self.rank.get(symbols[i] + symbols[i + 1])
                if rank is not None and (best is None or rank[0] < best[0]):
                    best, at = rank, i
            if best is None:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def may_follow(self, last: int, piece: int) -> bool:
        if last < 0:
            return True
        ok = self.follows.get((last, piece))
        if ok is None:
            if len(self.follows) > 50_000:
                self.follows.clear()
            ok = self.follows[last, piece] = bool(self.may_follow_all(np.array([last]), np.array([piece]))[0])
        return ok

    def may_follow_all(self, last: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether two neighbours joined are merged back into themselves, for arrays of them.

        Goes back through the merges that made both, latest first: the symbols that face each other at the border at a time
        are the last piece's right parts and the next one's left parts. The border holds unless two of them make a piece whose
        merge comes before the merges that took them away.
        """
        n = len(self.turn)
        ok = np.ones(len(last), bool)
        live = np.flatnonzero(last >= 0)
        a, b = self.turn[last[live]], self.turn[piece[live]]
        limit = np.full(len(live), n, np.int64)
        while len(live):
            key = a * n + b
            slot = np.searchsorted(self.joins, key)
            slot[slot == len(self.joins)] = 0
            early = (self.joins[slot] == key) & (self.joined[slot] < limit)
            ok[live[early]] = False
            left, right = self.first[b], self.second[a]
            no_left, no_right = left == b, right == a
            undo_a = np.where(a > b, ~no_right, no_left & ~no_right)
            undo_b = ~undo_a & ~no_left
            limit = np.where(undo_a, a, b + 1)
            a, b = np.where(undo_a, right, a), np.where(undo_b, left, b)
            go = ~early & (undo_a | undo_b)
            live, a, b, limit = live[go], a[go], b[go], limit[go]
        return ok

    def path(self, segment: str) -> bytes:
        """The shortest path for one segment (spaces already as U+2581) of any length, as int32 piece ids."""
        n, child = len(segment), self.child.get
        least, last, back = [0] + [NEVER] * n, [START] + [UNKNOWN] * n, [0] * (n + 1)
        for i in range(n):
            if least[i] == NEVER:
                continue
            node, j = 0, i
            while j < n and (node := child((node << 21) | ord(segment[j]))) is not None:
                j += 1
                p = self.piece_list[node]
                if p >= 0 and least[i] + 1 < least[j] and self.may_follow(last[i], p):
                    least[j], last[j], back[j] = least[i] + 1, p, i
            if segment[i] not in self.ids and least[i] + 1 < least[i + 1]:
                least[i + 1], last[i + 1], back[i + 1] = least[i] + 1, UNKNOWN, i
        out, j = [], n
        while j:
            i = back[j]
            out += [last[j]] if last[j] >= 0 else [self.byte_ids[b] for b in reversed(segment[i:j].encode("utf-8", "surrogatepass"))]
            j = i
        return np.array(out[::-1], np.int32).tobytes()

    def paths(self, segments: list[str]) -> list[bytes]:
        """``path`` for many segments of up to LONG characters at once, position by position."""
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        chars = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        ends = np.cumsum(lengths)
        begin = ends - lengths
        left = np.repeat(ends, lengths) - np.arange(len(chars))
        arcs = np.full((min(self.longest, int(lengths.max())), len(chars)), -1, np.int32)
        at, node = np.arange(len(chars)), np.zeros(len(chars), np.int64)
        for d in range(len(arcs)):
            key = (node << 21) | chars[at + d]
            slot = np.searchsorted(self.keys, key)
            slot[slot == len(self.keys)] = 0
            hit = self.keys[slot] == key
            at, node = at[hit], self.next[slot[hit]]
            if not len(at):
                break
            arcs[d, at] = self.piece_at[node]
            more = left[at] > d + 1
            at, node = at[more], node[more]
        last = np.full(len(chars) + 1, UNKNOWN, np.int32)  # of the prefix that ends before this position + 1
        least = np.full(len(chars) + 1, NEVER, np.int64)
        order = np.argsort(-lengths, kind="stable")
        falling = lengths[order]
        for j in range(1, int(lengths.max()) + 1):
            words = order[: np.searchsorted(-falling, -j, "right")]
            here = begin[words] + j - 1
            for k in range(1, min(j, len(arcs)) + 1):
                piece = arcs[k - 1, here - k + 1]
                some = np.flatnonzero((piece >= 0) & (least[here] == NEVER))  # a finite sum is the only one (see above)
                if k < j:
                    some = some[least[here[some] - k] < NEVER]
                if not len(some):
                    continue
                at, piece = here[some], piece[some]
                before = last[at - k] if k < j else np.full(len(at), START, np.int32)
                cost = np.where(self.may_follow_all(before, piece), (least[at - k] if k < j else 0) + 1, NEVER)
                better = cost < least[at]
                least[at[better]], last[at[better]] = cost[better], piece[better]
        known = least[ends - 1] < NEVER  # else byte fallback, one by one
        words = np.flatnonzero(known)
        pos, owner, place, ids = lengths[words].copy(), [], [], []
        while len(words):
            p = last[begin[words] + pos - 1]
            owner.append(words)
            place.append(pos.copy())
            ids.append(p)
            pos = pos - self.width[p]
            go = pos > 0
            words, pos = words[go], pos[go]
        out = [b""] * len(segments)
        if owner:
            owner, place, ids = np.concatenate(owner), np.concatenate(place), np.concatenate(ids)
            order = np.argsort(owner * (LONG + 1) + place)
            flat = ids[order].astype(np.int32).tobytes()
            stop = (np.cumsum(np.bincount(owner, minlength=len(segments))) * 4).tolist()
            start = 0
            for i, s in enumerate(stop):
                out[i] = flat[start:s]
                start = s
        for i in np.flatnonzero(~known).tolist():
            out[i] = self.path(segments[i])
        return out

    def encode(self, texts: list[str | None], memory: Memory) -> Iterator[np.ndarray]:
        """Piece ids of each text; ``memory`` is the task's own, for segments that recur."""
        memory.forget()
        cut = [list(map(memory.__getitem__, SEGMENT.findall(" " + t.replace(SPACE, " ")))) if t else [] for t in texts]
        new, memory.new = memory.new, []
        blobs: list[bytes | None] = [None] * len(new)
        short = [i for i, s in enumerate(new) if len(s) <= LONG and s != "\n"]
        for at in range(0, len(short), 40_000):
            part = short[at : at + 40_000]
            for i, blob in zip(part, self.paths([new[i].replace(" ", SPACE) for i in part])):
                blobs[i] = blob
        memory.blobs += [self.path(s.replace(" ", SPACE)) if blob is None else blob for s, blob in zip(new, blobs)]
        for numbers in cut:
            yield np.frombuffer(b"".join(map(memory.blobs.__getitem__, numbers)), np.int32)

    def decode(self, ids: list[int]) -> str:
        """The text of piece ids, without the space that encoding put first; bad byte runs give U+FFFD."""
        text = b"".join([self.output[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_machines: dict[str, Transducer] = {}


def _shipped(spark, model: str):
    """The machine's vocabulary, a table of bounded size, goes to the tasks; each worker compiles it once."""
    machine = Transducer.load(model)
    special = {i for i in range(len(machine.pieces)) if machine.pieces[i] not in machine.ids}
    scores = [-machine.rank[p][0] if p in machine.rank else 0.0 for p in machine.pieces]
    return spark.sparkContext.broadcast((model, machine.pieces, scores, special, machine.byte_ids))


def _machine(shipped) -> Transducer:
    model, *rest = shipped.value
    if model not in _machines:
        _machines[model] = Transducer(*rest)
    return _machines[model]


def encode(docs: DataFrame, text_col: str = "text", out_col: str = "piece_ids", model: str | None = None, chunk: int = 1 << 20, decoded_col: str | None = None) -> DataFrame:
    """``docs`` with the piece ids of each whole text in ``out_col`` (replaced if it is there already).

    The ids are those of the library that the model is made for. A null text gives null, an empty one an empty
    list. Texts are taken in chunks of about ``chunk`` characters, so memory doesn't grow with a batch; a
    longer text is a chunk of its own. One pass without a shuffle; all other columns are kept. ``decoded_col``, if given,
    takes what ``decode`` makes of the ids, in the same pass and so with one worker a task.
    """
    more = [decoded_col] if decoded_col else []
    rows = docs.drop(out_col, *more)
    schema = rows.select("*", F.lit(None).cast("array<int>").alias(out_col), *[F.lit(None).cast("string").alias(c) for c in more]).schema
    at = [c.lower() for c in rows.columns].index(text_col.lower())
    shipped = _shipped(docs.sparkSession, model or default_model())

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, memory = _machine(shipped), Memory()
        for b in batches:
            size = np.cumsum(np.concatenate(([0], _bytes(b.column(at)))))
            start = 0
            while start < b.num_rows:
                stop = max(start + 1, int(np.searchsorted(size, size[start] + chunk, "right")) - 1)
                part = b.slice(start, stop - start)
                texts = part.column(at).to_pylist()
                ids = list(machine.encode(texts, memory))
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                mask = pa.array([t is None for t in texts])
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)), mask=mask)
                back = [pa.array([None if t is None else machine.decode(x.tolist()) for t, x in zip(texts, ids)], pa.string())] if more else []
                yield pa.RecordBatch.from_arrays([*part.columns, lists, *back], names=[*b.schema.names, out_col, *more])
                start = stop

    return rows.mapInArrow(run, schema)


def _bytes(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def decode(rows: DataFrame, ids_col: str = "piece_ids", out_col: str = "decoded", model: str | None = None) -> DataFrame:
    """``rows`` with the text of the piece ids in ``out_col``; null ids give null, an empty list the empty text.

    What ``encode`` made comes back as it was, but that a U+2581 in the text comes back as a space, and a text
    that isn't valid Unicode with U+FFFD. Ids outside the vocabulary raise an error.
    """
    rows = rows.drop(out_col)
    schema = rows.select("*", F.lit(None).cast("string").alias(out_col)).schema
    at = [c.lower() for c in rows.columns].index(ids_col.lower())
    shipped = _shipped(rows.sparkSession, model or default_model())

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(shipped)
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                texts = [None if not x.is_valid else machine.decode(x.values.to_numpy().tolist()) for x in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*b.schema.names, out_col])

    return rows.mapInArrow(run, schema)
