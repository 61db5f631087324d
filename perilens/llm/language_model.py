"""Operator 6: a Katz back-off n-gram model, counted, normalised and evaluated in key ranges.

Texts are cut into chunks of bounded size and stored once, as numbers of the chunk's own words. From then on a chunk
and a key range of n-grams exchange rows that carry arrays: a chunk tells every range which n-grams it has and how
often (each once, however often it occurs), the range adds up and answers. No row is made per document and n-gram, so
a word that every document has, the end included, is one entry a chunk like any other.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import GOLDEN, WordHash, ascii_words, drop_folder, fold, shared_folder, tidied, tidy

END, BEGIN = np.uint64(0x45), np.uint64(0x42)
#: Counts of counts n[1] to n[TOP] that the discounts are fitted on.
TOP = 8
#: Fixed points of the sums behind a back-off weight: integers add up to the same whatever the order.
COUNT_UNIT, SHARE_UNIT = float(1 << 32), float(1 << 48)


def squeeze(x: np.ndarray) -> bytes:
    """An array as bytes: first all lowest bytes, then the next ones, compressed."""
    return zstandard.compress(np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), 1)


def spread(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).view(kind).reshape(-1)


def squeeze_keys(keys: np.ndarray) -> bytes:
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def spread_keys(data: bytes) -> np.ndarray:
    return np.cumsum(spread(data, np.uint64), dtype=np.uint64)


def mixed(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A 64-bit key for each context key followed by a word key."""
    with np.errstate(over="ignore"):
        x = context * GOLDEN + word
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each of ``parts`` key ranges starts in sorted keys; one position more than ranges."""
    return np.searchsorted(((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32), np.arange(parts + 1))


class Level:
    """The distinct n-grams of one order in a chunk, in key order.

    ``of`` has the number of the n-gram at each token; for each n-gram, ``context`` and ``lower`` have the numbers of the
    (n-1)-grams that it starts and ends with. The context of a text's first token is BEGIN alone, number len(keys).
    """

    def __init__(self, keys: np.ndarray, of: np.ndarray, context: np.ndarray | None, lower: np.ndarray | None, at: np.ndarray | None):
        self.keys, self.of, self.context, self.lower, self.at = keys, of, context, lower, at


def levels(vocabulary: np.ndarray, tokens: np.ndarray, lengths: np.ndarray, order: int) -> Iterator[Level]:
    """Orders 1 to ``order`` of a chunk; ``tokens`` are numbers into the sorted word keys ``vocabulary``."""
    last = Level(vocabulary, tokens, None, None, None)
    yield last
    for n in range(2, order + 1):
        at = np.empty(len(tokens), np.int64)
        at[1:] = last.of[:-1]
        at[np.cumsum(lengths) - lengths] = len(last.keys)
        found, rep, back = np.unique(at * len(vocabulary) + tokens, return_index=True, return_inverse=True)
        context = found // len(vocabulary)
        keys = mixed(np.append(last.keys, BEGIN + np.uint64(n))[context], vocabulary[found % len(vocabulary)])
        rank = np.argsort(keys)
        place = np.empty(len(rank), np.int64)
        place[rank] = np.arange(len(rank))
        last = Level(keys[rank], place[back], context[rank], last.of[rep[rank]], at)
        yield last


def slope(histogram: list[float]) -> float:
    """b of the law n[r] = a * r ** b through the counts of counts n[1] to n[TOP], by least squares on the logarithms.

    Half an n-gram, shared out as 1 / (r * (r + 1)), is added to the counts, so that an empty one has a logarithm; b is
    held between -4 and -1.05, where discounts are between 0 and 1. The law is the same for tables of any size.
    """
    r = np.arange(1, TOP + 1)
    x, y = np.log(r), np.log(np.asarray(histogram) + 0.5 / (r * (r + 1)))
    return float(np.clip(np.polyfit(x, y, 1)[0], -4.0, -1.05))


def discounted(counts: np.ndarray, b: float) -> np.ndarray:
    """Good-Turing counts r * d[r] = (r + 1) n[r + 1] / n[r] with the smoothed n: d[r] = (1 + 1 / r) ** (b + 1)."""
    c = np.maximum(counts, 1).astype(np.float64)
    return np.where(counts > 0, counts * (1 + 1 / c) ** (b + 1), 0.0)


class Model:
    """The global constants: N, V, each order's slope, and the mass of the unseen words as one event."""

    def __init__(self, total: int, distinct: int, slopes: list[float], known: float):
        self.total, self.distinct, self.slopes = total, distinct, slopes
        self.unseen = 1 - known / total if total else 1.0

    def p1(self, counts: np.ndarray) -> np.ndarray:
        """Unigram probability by training count; 0 gives the unseen mass."""
        return np.where(counts > 0, discounted(counts, self.slopes[0]) / max(1, self.total), self.unseen)


def _listed(table: pa.Table, *names: str) -> list[list]:
    return [table.column(n).to_pylist() for n in names]


def _split(x: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    return np.split(x, np.cumsum(sizes)[:-1])


def count(level: int, bucket: int, table: pa.Table) -> list[dict]:
    """Training counts of a key range's n-grams, for each chunk in its own order, and how many n-grams have which count.

    Each distinct n-gram is owned by the first chunk that has it, which later speaks for it once.
    """
    order = np.argsort(table.column("chunk").to_numpy())
    chunk, a, b = ([x[i] for i in order] for x in _listed(table, "chunk", "a", "b"))
    keys = [spread_keys(x) for x in a]
    sizes = [len(x) for x in keys]
    distinct, first, back = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    totals = np.bincount(back, np.concatenate([spread(x, np.int32) for x in b]), minlength=len(distinct)).astype(np.int64)
    own = np.zeros(len(back), np.uint8)
    own[first] = 1
    values, times = np.unique(totals[totals > 0], return_counts=True)
    out = [dict(what="stats", level=level, bucket=bucket, a=squeeze(values), b=squeeze(times))]
    for c, x, o in zip(chunk, _split(totals[back], sizes), _split(own, sizes)):
        out.append(dict(what="counts", level=level, bucket=bucket, chunk=c, a=squeeze(x), b=squeeze(o)))
    return out


def weigh(row: dict, replies: pa.Table, model: Model, parts: list[int], least: int) -> list[dict]:
    """A chunk's document sums, what it adds to the back-off weights, and the contexts whose weights it asks for."""
    lengths, docs = spread(row["a"], np.int32).astype(np.int64), len(row["ids"])
    vocabulary, tokens = spread_keys(row["c"]), spread(row["d"], np.int32).astype(np.int64)
    of_level, of_bucket, a, b = _listed(replies, "level", "bucket", "a", "b")
    doc = np.repeat(np.arange(docs), lengths)
    out, needs = [], []
    before = lower = seen = value = None
    for n, grams in enumerate(levels(vocabulary, tokens, lengths, len(parts)), 1):
        mine = sorted((of_bucket[i], i) for i in range(len(of_level)) if of_level[i] == n)
        counts = np.concatenate([spread(a[i], np.int64) for _, i in mine])
        if n == 1:
            p = model.p1(counts)
            value = np.log10(p)[tokens]
            known = np.bincount(doc, (counts > 0)[tokens], minlength=docs)
            base = np.bincount(doc, np.log10((counts + 1.0) / (model.total + model.distinct + 1))[tokens], minlength=docs)
            seen = np.append(counts, counts[np.searchsorted(vocabulary, END)])
        else:
            kept = counts >= least
            left = np.where(kept, discounted(counts, model.slopes[n - 1]), 0.0)
            p = left / np.maximum(seen[grams.context], 1)
            used = kept[grams.of]
            value[used] = np.log10(p[grams.of[used]])
            # What this chunk's own n-grams take from their contexts, then the contexts that an n-gram falls back from.
            speak = np.concatenate([spread(b[i], np.uint8) for _, i in mine]).astype(bool) & kept
            where = grams.context[speak]
            taken = np.zeros((3, len(seen)), np.int64)
            np.add.at(taken[0], where, counts[speak])
            np.add.at(taken[1], where, np.rint((counts[speak] - left[speak]) * COUNT_UNIT).astype(np.int64))
            np.add.at(taken[2], where, np.rint(lower[grams.lower[speak]] * SHARE_UNIT).astype(np.int64))
            falls = np.flatnonzero(~used & (seen[grams.at] > 0))
            cells, times = np.unique(grams.at[falls] * docs + doc[falls], return_counts=True)
            asked = np.zeros(len(seen), bool)
            asked[cells // docs] = True
            # The context BEGIN has key 0 and so comes first.
            turn = np.concatenate(([len(seen) - 1], np.arange(len(seen) - 1)))
            turn = turn[asked[turn] | (taken[0][turn] > 0)]
            keys = np.append(before, np.uint64(0))[turn]
            edges = cuts(keys, parts[n - 2])
            for bucket in np.flatnonzero(np.diff(edges)).tolist():
                s = slice(edges[bucket], edges[bucket + 1])
                t = turn[s]
                sums = [squeeze(x) for x in (*taken[:, t], np.where(asked[t], seen[t], 0))]
                out.append(dict(what="sums", level=n, bucket=bucket, chunk=row["chunk"], a=squeeze_keys(keys[s])) | dict(zip("bcde", sums)))
            number = np.zeros(len(seen), np.int64)
            turn = turn[asked[turn]]
            number[turn] = np.arange(len(turn))
            needs.append(np.array((np.full(len(cells), n), number[cells // docs], cells % docs, times)))
            seen = np.append(counts, seen[-1])
        before, lower = grams.keys, p
    facts = np.concatenate((lengths, known, base, np.bincount(doc, value, minlength=docs)))
    asks = np.concatenate([x.ravel() for x in needs]) if needs else np.zeros(0, np.int64)
    sizes = np.array([x.shape[1] for x in needs], np.int64)
    return [*out, dict(what="docs", level=0, bucket=row["chunk"] % 2147483647, chunk=row["chunk"], a=squeeze(facts), b=row["b"], c=squeeze(asks), d=squeeze(sizes), ids=row["ids"])]


def back_off(level: int, bucket: int, table: pa.Table) -> list[dict]:
    """log10 alpha of the contexts in a key range, to every chunk that asked, in the chunk's own order.

    alpha(h) = (1 - sum of kept p(w|h)) / (1 - sum of the same words' lower-order p), so all of p(.|h) sums to one.
    A context without kept n-grams has alpha 1.
    """
    chunk, a, *sums = _listed(table, *"chunk a b c d e".split())
    keys = [spread_keys(x) for x in a]
    distinct, back = np.unique(np.concatenate(keys), return_inverse=True)
    where = _split(back, [len(x) for x in keys])
    kept, lost, share, seen = np.zeros((4, len(distinct)), np.int64)
    asks = [spread(x, np.int64) for x in sums[3]]
    for at, x, y, z, ask in zip(where, *sums[:3], asks):
        for total, part in ((kept, x), (lost, y), (share, z)):
            total[at] += spread(part, np.int64)
        seen[at] = np.maximum(seen[at], ask)
    left = (seen - kept + lost / COUNT_UNIT) / np.maximum(seen, 1)
    alpha = np.log10(np.where(seen > 0, left, 1.0) / (1 - share / SHARE_UNIT))
    return [dict(what="alpha", level=level, bucket=bucket, chunk=c, a=squeeze(alpha[at[ask > 0]])) for c, at, ask in zip(chunk, where, asks)]


def finish(row: dict, replies: pa.Table) -> tuple:
    """(ids, held, tokens, known, base, score) of a chunk: the sums so far and the weights that it asked for."""
    docs = len(row["ids"])
    lengths, known, base, score = spread(row["a"], np.float64).reshape(4, docs)
    asks, sizes = spread(row["c"], np.int64), spread(row["d"], np.int64)
    level, bucket, a = _listed(replies, "level", "bucket", "a")
    for need in np.split(asks, np.cumsum(4 * sizes)[:-1]) if len(asks) else []:
        n, number, place, times = need.reshape(4, -1)
        if len(n):
            mine = sorted((bucket[i], i) for i in range(len(level)) if level[i] == n[0])
            alpha = np.concatenate([spread(a[i], np.float64) for _, i in mine])
            score = score + np.bincount(place, alpha[number] * times, minlength=docs)
    return row["ids"], spread(row["b"], np.uint8).astype(bool), lengths.astype(np.int64), known.astype(np.int64), base, score


def scores(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: tuple[int, int] = (7, 2), order: int = 2, least: int = 1, part_grams: int = 1 << 18, chunk_bytes: int = 6 << 20
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    Learns from the rows whose crc32(doc_id as text) mod folds[0] isn't folds[1], over whole texts, n-grams up to ``order``.
    Each token is evaluated recursively: by p(w|h) of its n-gram if training has it ``least`` times (Katz's cut-off: 1
    keeps all), else by alpha(h) times the probability under the context without its first word, down to single words. Counts
    are Good-Turing discounted by counts of counts smoothed along a line (``slope``); the mass that unseen words get is
    one event, and probabilities sum to one at every level.

    The texts are read once and stored in chunks of about ``chunk_bytes`` (a longer text is a chunk of its own); n-grams are
    counted in key ranges of about ``part_grams`` entries, whose number grows with the table. Chunks and counts are
    tables in the shared checkpoint folder, bucketed by chunk so that they stay where they are when answers join them, and
    are dropped when the result is written there: a lost executor costs a task's work.

    A null text counts as empty (one token, the end); a null id hashes as the empty text and stays null; ids keep their type;
    repeated rows count as often as they come; without training rows every probability is that of the unseen event; an empty
    table gives an empty one. Other columns are not looked at.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), (fold(id_col, folds[0]) == folds[1]).alias("held"), F.col(text_col).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    name = f"language_model_{uuid.uuid4().hex}"
    folder = f"{shared_folder(spark)}/{name}"
    id_type = rows.schema["doc_id"].dataType.simpleString()
    stored = f"what string, level int, bucket int, chunk long, a binary, b binary, c binary, d binary, e binary, ids array<{id_type}>, n_words long, n_tokens long"

    def rows_of(batch_ids: pa.DataType):
        fields = [("what", pa.string()), ("level", pa.int32()), ("bucket", pa.int32()), ("chunk", pa.int64()), *[(x, pa.binary()) for x in "abcde"]]
        return pa.schema([*fields, ("ids", pa.list_(batch_ids)), ("n_words", pa.int64()), ("n_tokens", pa.int64())])

    def as_batch(found: list[dict], ids: pa.DataType) -> pa.RecordBatch:
        schema = rows_of(ids)
        return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in found], f.type) for f in schema], schema=schema)

    def id_kind(table) -> pa.DataType:
        return table.schema.field("ids").type.value_type

    @tidied
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, chunk, ids, held, words, size, kind = WordHash(100_000), TaskContext.get().partitionId() << 24, [], [], [], 0, None

        def packed() -> pa.RecordBatch:
            lengths = np.fromiter(map(len, words), np.int32, len(words)) + np.int32(1)
            stops = np.cumsum(lengths) - 1
            flat = np.full(int(lengths.sum()), END)
            inside = np.ones(len(flat), bool)
            inside[stops] = False
            flat[inside] = np.concatenate(words)
            vocabulary, tokens = np.unique(flat, return_inverse=True)
            data = squeeze(lengths), squeeze(np.array(held, np.uint8)), squeeze_keys(vocabulary), squeeze(tokens.astype(np.int32))
            return as_batch([dict(what="chunk", chunk=chunk, ids=ids, n_words=len(vocabulary), n_tokens=len(flat)) | dict(zip("abcd", data))], kind)

        for b in batches:
            kind = b.schema.field(0).type
            for doc_id, is_held, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                ids.append(doc_id)
                held.append(is_held)
                words.append(memo.of(ascii_words(text.as_py())))
                size += 6 * len(words[-1]) + 64
                if size >= chunk_bytes:
                    yield packed()
                    chunk, ids, held, words, size = chunk + 1, [], [], [], 0
        if ids:
            yield packed()

    buckets = int(size) // (2 * chunk_bytes) + 4
    rows.mapInArrow(cut, stored).write.bucketBy(buckets, "chunk").option("path", f"{folder}/chunks").saveAsTable(name)
    chunks = spark.table(name)
    n_words, n_tokens = (x or 0 for x in chunks.agg(F.sum("n_words"), F.sum("n_tokens")).first())
    parts = [int(n_words) // part_grams + 4, *[int(n_tokens) // part_grams + 4] * (order - 1)]

    @tidied
    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                lengths, training = spread(r["a"], np.int32).astype(np.int64), ~spread(r["b"], np.uint8).astype(bool)
                weight = np.repeat(training, lengths)
                for n, grams in enumerate(levels(spread_keys(r["c"]), spread(r["d"], np.int32).astype(np.int64), lengths, order), 1):
                    times = np.bincount(grams.of, weight, minlength=len(grams.keys)).astype(np.int32)
                    edges = cuts(grams.keys, parts[n - 1])
                    found = []
                    for k in np.flatnonzero(np.diff(edges)).tolist():
                        s = slice(edges[k], edges[k + 1])
                        found.append(dict(level=n, bucket=k, chunk=r["chunk"], a=squeeze_keys(grams.keys[s]), b=squeeze(times[s])))
                    yield as_batch(found, id_kind(b))

    def total(key, table):
        return pa.Table.from_batches([as_batch(count(*(k.as_py() for k in key), table), id_kind(table))])

    told = chunks.select("chunk", "a", "b", "c", "d", "ids").mapInArrow(tell, stored)
    tasks = max(8, sum(parts) // 2)  # as many as the ranges ask for, whatever the session's number: a task's share stays the same as tables grow
    told.repartition(tasks, "level", "bucket").groupBy("level", "bucket").applyInArrow(total, stored).write.partitionBy("what").parquet(f"{folder}/counted")
    counted = spark.read.schema(stored).parquet(f"{folder}/counted")

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for level, a, c in zip(*(b.column(x).to_pylist() for x in range(3))):
                r, n = spread(a, np.int64), spread(c, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), level, np.int32)), pa.array(r), pa.array(n)], names=["level", "r", "n"])

    stats = counted.where("what = 'stats'").select("level", "a", "b").mapInArrow(histogram, "level int, r long, n long")
    of_counts = stats.groupBy("level").agg(*[F.sum(F.when(F.col("r") == r, F.col("n")).otherwise(0)).alias(f"n{r}") for r in range(1, TOP + 1)])
    lines = {x.level: slope([float(x[f"n{r}"]) for r in range(1, TOP + 1)]) for x in of_counts.collect()}
    slopes = [lines.get(n, slope([0.0] * TOP)) for n in range(1, order + 1)]
    still = F.col("n") * F.col("r") * F.pow(1 + 1 / F.col("r"), F.lit(slopes[0] + 1))
    n_train, distinct, known = (x or 0 for x in stats.where("level = 1").agg(F.sum(F.col("r") * F.col("n")), F.sum("n"), F.sum(still)).first())
    model = Model(int(n_train), int(distinct), slopes, float(known))

    def weighed(key, own, replies):
        found = [y for x in own.to_pylist() for y in weigh(x, replies, model, parts, least)]
        tidy()
        return pa.Table.from_batches([as_batch(found, id_kind(own))])

    def answer(key, table):
        level, bucket = (k.as_py() for k in key)
        return pa.Table.from_batches([as_batch(back_off(level, bucket, table), id_kind(table))]) if level else table

    def ended(key, table):
        rows = table.to_pylist()
        row = next(x for x in rows if x["what"] == "docs")
        ids, held, tokens, n_known, base, score = finish(row, table.filter(pa.array([x["what"] == "alpha" for x in rows])))
        return pa.table(
            {
                "doc_id": pa.array(ids, id_kind(table)), "held_out": held, "n_tokens": tokens, "n_known": n_known,
                "train_tokens": np.full(len(ids), model.total), "base_score": base, "score": score,
            }
        )

    replies = counted.where("what = 'counts'").select("chunk", "level", "bucket", "a", "b")
    own = chunks.select("chunk", "a", "b", "c", "d", "ids")
    sums = own.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(weighed, stored)
    answers = sums.repartition(tasks, "level", "bucket").groupBy("level", "bucket").applyInArrow(answer, stored)
    out = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    answers.groupBy("chunk").applyInArrow(ended, out).write.parquet(f"{folder}/scores")
    spark.sql(f"DROP TABLE {name}")
    drop_folder(spark, f"{folder}/chunks")
    drop_folder(spark, f"{folder}/counted")
    return spark.read.schema(out).parquet(f"{folder}/scores")
