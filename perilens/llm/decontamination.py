"""Operator 4: benchmark passages inside documents, by size-partitioned MinHash containment search.

Only the items are sketched: a document's shingle hashes are looked up whole, so no document sketch can miss an item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import EDGE, WordHash, cut_lineage, rolling, tidied

#: Upper item sizes (in distinct shingles) of the size partitions; beyond the last one they go on doubling.
SIZES = (8, 16, 32, 64, 128)

def loose_words(text: str | None) -> list[str]:
    """Words in lower case without ASCII punctuation at their ends; words of punctuation alone are left out."""
    return [w for raw in (text or "").split() if (w := raw.strip(EDGE).lower())]


def shingles(words: list[str], width: int) -> set[str]:
    """Distinct runs of ``width`` words; a shorter text is one run, an empty text has none."""
    if not words:
        return set()
    width = min(width, len(words))
    return {" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}


class Index:
    """Benchmark items in size partitions, each with a MinHash sketch that no match can miss.

    The sketch of an item holds the least hashes of its n distinct shingles. Where containment is to be t, at most
    floor((1 - t) * n) shingles are absent from the document; a partition with items of up to u shingles keeps
    floor((1 - t) * u) + 1 of them, so one at least is there. Shorter widths (items under ``width`` words) have
    tables of their own, as their one shingle has fewer words. It holds the items' texts and sketches (as arrays) only,
    so it is hardly larger than the texts; an item's shingles are made when a document has a sketch hash of it.
    """

    def __init__(self, items: list[tuple], width: int, threshold: float):
        self.width, self.threshold, self.items = width, threshold, []
        found: dict[int, list[np.ndarray]] = {}
        memo = WordHash(loose=True)
        for item_id, text in items:
            words = loose_words(text)
            if not words:
                continue
            wide = min(width, len(words))
            hashes = np.unique(rolling(memo.of([w.encode("utf-8", "surrogatepass") for w in words]), wide))
            upper = next((s for s in SIZES if len(hashes) <= s), 1 << len(hashes).bit_length())
            sketch = hashes[: int((1 - threshold) * upper + 1e-9) + 1]
            found.setdefault(wide, []).append(np.stack((sketch, np.full(len(sketch), len(self.items), np.uint64))))
            self.items.append((item_id, text))
        self.tables = {}
        for wide, parts in found.items():
            keys, numbers = np.concatenate(parts, axis=1)
            order = np.lexsort((numbers, keys))
            self.tables[wide] = keys[order], numbers[order].astype(np.int32)
        self.recent: dict[int, set[str]] = {}

    def shingles_of(self, number: int) -> set[str]:
        """An item's shingles; those of the last items asked for are at hand while their texts are under a megabyte."""
        own = self.recent.get(number)
        if own is None:
            own = shingles(loose_words(self.items[number][1]), self.width)
            if sum(len(self.items[k][1]) for k in self.recent) + len(self.items[number][1]) > 1 << 20:
                self.recent.clear()
            self.recent[number] = own
        return own

    def candidates(self, hashes: np.ndarray) -> list[int]:
        out = []
        for wide, (keys, numbers) in self.tables.items():
            if len(hashes) >= wide:
                own = np.unique(rolling(hashes, wide))
                low, high = np.searchsorted(keys, own), np.searchsorted(keys, own, "right")
                for a, b in zip(low[high > low].tolist(), high[high > low].tolist()):
                    out += numbers[a:b].tolist()
        return sorted(set(out))

    def matches(self, text: str | None, memo: WordHash) -> dict:
        """item_id to (containment, n_shared, n_shingles) for the items that a whole text contains."""
        best: dict = {}
        if not text:
            return best
        hashes = memo.of([w.encode("utf-8", "surrogatepass") for w in text.split()])  # cut as loose_words does
        hits = self.candidates(hashes[hashes != 0])
        words = loose_words(text) if hits else []
        wide: dict[int, set[str]] = {}
        for k in hits:
            own = self.shingles_of(k)
            w = next(iter(own)).count(" ") + 1
            if w not in wide:
                wide[w] = shingles(words, w)
            shared = len(own & wide[w])
            if shared >= self.threshold * len(own) - 1e-9:
                row = (shared / len(own), shared, len(own))
                item_id = self.items[k][0]
                best[item_id] = max(best.get(item_id, row), row)
        return best


def _indexes(items: DataFrame, item_col: str, item_text_col: str, width: int, threshold: float, block_bytes: int) -> list:
    """The items as broadcasts of at most about ``block_bytes`` of text each, after their bytes were counted."""
    bench = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("item")).where("item_id is not null and item is not null").distinct()
    total = bench.agg(F.coalesce(F.sum(F.octet_length("item")), F.lit(0))).first()[0]
    blocks = int(total) // block_bytes + 1
    out = []
    for block in range(blocks):
        part = bench.where(F.pmod(F.xxhash64("item_id", "item"), F.lit(blocks)) == block)
        known = sorted((r.item_id, r.item) for r in part.toLocalIterator())
        out.append(items.sparkSession.sparkContext.broadcast(Index(known, width, threshold)))
    return out


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 5,
    threshold: float = 0.8,
    block_bytes: int = 8 << 20,
) -> DataFrame:
    """(doc_id, item_id, containment, n_shared, n_shingles) for each pair with containment >= threshold.

    Containment is the share of an item's distinct word shingles that occur anywhere in the whole document. The
    items are a query set that goes to every task in blocks: their bytes are counted first, and one pass over
    the documents serves at most about ``block_bytes`` of item text (a larger benchmark takes several passes,
    none holding more). A candidate shares a sketch hash with the item and is then verified on the shingles'
    text. Documents aren't shuffled, joined or collected, so copies and hot sources make no hot task.

    Null or empty texts and items match nothing; items of fewer than ``width`` words are one shingle of all their
    words; a repeated (item_id, text) gives one row, an item_id with several texts its best one; repeated
    documents each get their rows, a null doc_id too; a null item_id is left out; ids keep their types; an empty table
    gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    bench = items.select(F.col(item_col).alias("item_id"))
    kinds = rows.schema["doc_id"].dataType.simpleString(), bench.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, containment double, n_shared int, n_shingles int"
    item_kind = to_arrow_type(bench.schema["item_id"].dataType)
    shipped = _indexes(items, item_col, item_text_col, width, threshold, block_bytes)
    out = None
    for index in shipped:

        @tidied
        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            memo, tables = WordHash(loose=True), index.value
            for b in batches:
                at, item_ids, facts = [], [], []
                for i, text in enumerate(b.column(1)):
                    best = tables.matches(text.as_py(), memo)
                    for item_id in sorted(best):
                        at.append(i)
                        item_ids.append(item_id)
                        facts.append(best[item_id])
                shares, shared, sizes = zip(*facts) if facts else ((), (), ())
                own = [pa.array(x, t) for x, t in ((item_ids, item_kind), (shares, pa.float64()), (shared, pa.int32()), (sizes, pa.int32()))]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *own], names=["doc_id", "item_id", "containment", "n_shared", "n_shingles"])

        part_out = rows.select("doc_id", "text").mapInArrow(search, schema)
        out = part_out if out is None else out.union(part_out)
    if len(shipped) > 1:
        best = F.max(F.struct("containment", "n_shared", "n_shingles")).alias("b")
        out = out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")
    return out


def uncontaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 5, threshold: float = 0.8, block_bytes: int = 8 << 20) -> DataFrame:
    """The rows of ``docs`` whose text contains no item with a containment of ``threshold`` or more, all columns as they are.

    Each row is decided by its own text, so null and repeated ids make no difference; null and empty texts stay. Nothing
    is shuffled; where the items take several blocks, what is left after one is written before the next.
    """
    at = [c.lower() for c in docs.columns].index(text_col.lower())
    shipped = _indexes(items, item_col, item_text_col, width, threshold, block_bytes)
    for k, index in enumerate(shipped):

        @tidied
        def keep(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            memo, tables = WordHash(loose=True), index.value
            for b in batches:
                yield b.filter(pa.array([not tables.matches(text.as_py(), memo) for text in b.column(at)], pa.bool_()))

        docs = (cut_lineage(docs) if k else docs).mapInArrow(keep, docs.schema)
    return docs
