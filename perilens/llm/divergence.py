"""Operator 11: how far the sources of a language differ in their terms, by chunk factorization."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .language_model import spread, squeeze
from .shared import cut_lineage, drop_folder, shared_folder, tidied, tidy

#: UTF-8 bytes of text that share one list of chunks; a longer document is a block of its own.
BLOCK_BYTES = 28 << 20
#: Chunk counts of documents that are spread out into terms at once.
SLICE = 300_000
#: Sources and terms of a piece of the comparison of sources.
PIECE_SOURCES, PIECE_TERMS = 256, 4096
#: What a share is counted in, and what every count is raised by.
UNIT, RAISED = 1_000_000_000, 5

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text: Column) -> Column:
    """The terms of a text in order: stretches of ASCII letters and characters beyond ASCII, A-Z in lower case."""
    return F.regexp_extract_all(F.translate(text, LETTERS, LETTERS.lower()), F.lit("(" + TERM + ")"), F.lit(1))


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _strings(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).view(pa.string())


def blocks(docs: DataFrame) -> DataFrame:
    """Documents (text, lang, source) as blocks of their chunk counts.

    A block has the chunks ``[^\\x20\\x09-\\x0D]+`` of its documents once each, and for every document its group, its distinct chunks
    (numbers into the block's list, as differences) and their counts; further in how many documents of which language each chunk is.
    """
    pair = pa.struct([("lang", pa.string()), ("source", pa.string())])
    names = ["block", "groups", "of_doc", "sizes", "ids", "counts", "chunks", "df_lang", "df_chunk", "df"]

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, made = TaskContext.get().partitionId() << 32, 0

        def block() -> pa.RecordBatch:
            sizes = np.array([len(x) for x in ids])
            flat, times = np.concatenate(ids), np.concatenate(counts)
            steps = np.diff(flat, prepend=0)
            starts = np.cumsum(sizes) - sizes
            full = sizes > 0
            steps[starts[full]] = flat[starts[full]]
            langs = np.array([lang for lang, _ in groups], object)
            known, of_group = np.unique(langs, return_inverse=True)
            keys, df = np.unique(np.repeat(of_group[of_doc], sizes) * len(numbers) + flat, return_counts=True)
            listed = [dict(lang=a, source=b) for a, b in groups]
            packed = [squeeze(x) for x in (np.array(of_doc), sizes, steps, times)]
            chunks = zstandard.compress(b" ".join(numbers), 1)
            shares = [pa.array([list(known)], pa.list_(pa.string())), pa.array([squeeze(keys)]), pa.array([squeeze(df)])]
            columns = [pa.array([first + made]), pa.array([listed], pa.list_(pair)), *[pa.array([x], pa.binary()) for x in packed], pa.array([chunks], pa.binary()), *shares]
            return pa.RecordBatch.from_arrays(columns, names=names)

        numbers, groups, of_doc, ids, counts, held = _Numbers(), {}, [], [], [], 0
        for b in batches:
            texts = b.column(0).cast(pa.binary())
            for i, (lang, source) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                text = texts[i].as_py() or b""
                if of_doc and held + len(text) > BLOCK_BYTES:
                    yield block()
                    made += 1
                    numbers, groups, of_doc, ids, counts, held = _Numbers(), {}, [], [], [], 0
                words = text.split()
                own, times = np.unique(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)), return_counts=True)
                of_doc.append(groups.setdefault((lang or "", source or ""), len(groups)))
                ids.append(own)
                counts.append(times)
                held += len(text)
        if of_doc:
            yield block()

    schema = "block long, groups array<struct<lang: string, source: string>>, of_doc binary, sizes binary, ids binary, counts binary, chunks binary, df_lang array<string>, df_chunk binary, df binary"
    return docs.select("text", "lang", "source").mapInArrow(run, schema)


def _listed(chunks: pa.Scalar) -> list[bytes]:
    return zstandard.decompress(chunks.as_py()).split()


def chunk_documents(stored: DataFrame) -> DataFrame:
    """(chunk, lang, df) of each block."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                chunks, langs = _listed(b.column(0)[i]), b.column(1)[i].as_py()
                if chunks:
                    lang, chunk = np.divmod(spread(b.column(2)[i].as_py(), np.int64), len(chunks))
                    listed, df = _strings(chunks), spread(b.column(3)[i].as_py(), np.int64)
                    for at in range(0, len(chunk), 50_000):
                        s = slice(at, at + 50_000)
                        yield pa.RecordBatch.from_arrays([listed.take(pa.array(chunk[s])), pa.array(langs).take(pa.array(lang[s])), pa.array(df[s])], names=["chunk", "lang", "df"])

    return stored.select("chunks", "df_lang", "df_chunk", "df").mapInArrow(run, "chunk string, lang string, df long")


def chunk_places(stored: DataFrame) -> DataFrame:
    """(block, place, chunk): every block's list of chunks as rows."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                chunks = _listed(b.column(1)[i])
                for at in range(0, len(chunks), 50_000):
                    some = chunks[at : at + 50_000]
                    block = pa.array(np.full(len(some), b.column(0)[i].as_py()))
                    yield pa.RecordBatch.from_arrays([block, pa.array(np.arange(at, at + len(some))), _strings(some)], names=["block", "place", "chunk"])

    return stored.select("block", "chunks").mapInArrow(run, "block long, place long, chunk string")


def term_counts(stored: DataFrame, found: DataFrame) -> DataFrame:
    """(lang, source, term, docs, n) from the blocks and the terms (block, place, term) of their chunks.

    A document counts once for a term, in however many of its chunks the term is.
    """

    def count(_, block, has):
        out = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("docs", pa.int64()), ("n", pa.int64())])
        if not block.num_rows or not has.num_rows:
            return out.empty_table()
        row = {c: block.column(c)[0].as_py() for c in ("groups", "of_doc", "sizes", "ids", "counts")}
        sizes, of_doc = spread(row["sizes"], np.int64), spread(row["of_doc"], np.int64)
        steps, times = spread(row["ids"], np.int64), spread(row["counts"], np.int64)
        total = np.cumsum(steps)
        starts = np.cumsum(sizes) - sizes
        before = np.zeros(len(sizes), np.int64)
        full = sizes > 0
        before[full] = total[starts[full]] - steps[starts[full]]
        chunk = total - np.repeat(before, sizes)
        words = has.column("term").combine_chunks().dictionary_encode()
        term, place = words.indices.to_numpy().astype(np.int64), has.column("place").to_numpy()
        order = np.argsort(place, kind="stable")
        term, place = term[order], place[order]
        edge = np.searchsorted(place, np.arange(int(max(chunk.max(initial=0), place[-1])) + 2))
        v, held = len(words.dictionary), []
        # Documents in slices of some SLICE chunk counts, so that what is spread out at once is bounded.
        cuts = np.append(np.unique(np.searchsorted(starts + sizes, np.arange(0, len(chunk), SLICE), "right")), len(sizes))
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            at = slice(int(starts[low]), int(starts[high - 1] + sizes[high - 1])) if high > low else slice(0, 0)
            some = chunk[at]
            many = np.diff(edge)[some]
            where = np.repeat(edge[some] - np.cumsum(many) + many, many) + np.arange(many.sum())
            doc = np.repeat(np.repeat(np.arange(low, high), sizes[low:high]), many)
            keys, back = np.unique(doc * v + term[where], return_inverse=True)
            n = np.bincount(back, np.repeat(times[at], many), minlength=len(keys)).astype(np.int64)
            cells, back, docs = np.unique(of_doc[keys // v] * v + keys % v, return_inverse=True, return_counts=True)
            held.append((cells, docs, np.bincount(back, n, minlength=len(cells)).astype(np.int64)))
        cells, docs, n = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (zip(*held) if held else ((), (), ())))
        cells, back = np.unique(cells, return_inverse=True)
        docs, n = (np.bincount(back, x, minlength=len(cells)).astype(np.int64) for x in (docs, n))
        group, term = np.divmod(cells, v)
        lang, source = (pa.array([g[c] for g in row["groups"]], pa.string()).take(pa.array(group)) for c in ("lang", "source"))
        made = pa.table([lang, source, words.dictionary.take(pa.array(term)), pa.array(docs), pa.array(n)], schema=out)
        del row, steps, total, chunk, times, held, cells, back, words, order, edge
        tidy()
        return made

    held = stored.select("block", "groups", "of_doc", "sizes", "ids", "counts")
    both = held.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(count, "lang string, source string, term string, docs long, n long")
    return both.groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


def share(n: str, total: str, kept: str) -> Column:
    """1 + floor(UNIT * (n + RAISED) / (total + RAISED * kept)) of long columns, exact at any size; missing without kept terms."""
    top = f"cast({n} + {RAISED} as decimal(20,0)) * cast({UNIT} as decimal(10,0))"
    return F.expr(f"1 + ({top}) div cast(nullif({total} + {RAISED} * {kept}, 0) as decimal(20,0))")


def compared(groups: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, source, item, value): for every two sources of a language the sum of |p - q| over its kept terms.

    ``groups``: (lang, source, kept, zero), one row a source, with the share of a term that it doesn't have; ``counts``: (lang, source,
    term, p). Sources in blocks meet in pairs of blocks, terms in buckets: a piece holds at most 2 * PIECE_SOURCES sources and about
    PIECE_TERMS terms as a matrix. Terms that none of a piece's sources has weigh |zero - zero| each, and are added by number.
    """
    sources = groups.groupBy("lang").agg(F.expr(f"int((count(*) - 1) div {PIECE_SOURCES} + 1)").alias("n_blocks"), F.expr(f"int(any_value(kept) div {PIECE_TERMS} + 1)").alias("n_buckets"))
    own = groups.join(sources, "lang").withColumn("own", F.pmod(F.xxhash64("source"), F.col("n_blocks")).cast("int"))
    blocks = F.explode(F.expr("transform(sequence(0, n_blocks - 1), o -> struct(least(own, o) as a, greatest(own, o) as b))")).alias("piece")
    facts = own.select("lang", "source", "own", "n_buckets", "kept", "zero", blocks)
    bucket = F.pmod(F.xxhash64("term"), F.col("n_buckets")).cast("int")
    cells = counts.join(facts, ["lang", "source"]).select("lang", "piece", bucket.alias("bucket"), "source", "own", "kept", "zero", "term", "p")
    heads = facts.select("lang", "piece", F.explode(F.expr("sequence(0, n_buckets - 1)")).alias("bucket"), "source", "own", "kept", "zero", F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("p"))
    rows = heads.unionByName(cells).select("lang", "piece.a", "piece.b", "bucket", "source", "own", "kept", "zero", "term", "p")

    def compare(key, rows):
        lang, a, b = (x.as_py() for x in key[:3])
        head = np.asarray(rows.column("term").is_null())
        code = rows.column("source").combine_chunks().dictionary_encode()
        names, source = code.dictionary, code.indices.to_numpy()
        zero, block = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        zero[source[head]] = rows.column("zero").to_numpy()[head]
        block[source[head]] = rows.column("own").to_numpy()[head]
        kept = rows.column("kept")[0].as_py()
        cells = rows.filter(pa.array(~head))
        term = cells.column("term").combine_chunks().dictionary_encode()
        p = np.repeat(zero[:, None], len(term.dictionary), axis=1)
        p[source[~head], term.indices.to_numpy()] = cells.column("p").to_numpy()
        left, right, value, gap = [], [], [], []
        others = np.flatnonzero(block == b)
        for i in np.flatnonzero(block == a):
            j = others[others != i]
            apart = np.abs(zero[i] - zero[j])
            left.append(np.full(len(j), i))
            right.append(j)
            value.append(np.abs(p[j] - p[i]).sum(1) - apart * p.shape[1])
            gap.append(apart)
        i, j, value, gap = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (left, right, value, gap))
        if a != b:
            i, j, value, gap = np.append(i, j), np.append(j, i), np.tile(value, 2), np.tile(gap, 2)
        return pa.table({"lang": pa.array([lang] * len(i), pa.string()), "source": names.take(pa.array(i)), "item": names.take(pa.array(j)), "part_value": value, "gap": gap * kept})

    parts = rows.groupBy("lang", "a", "b", "bucket").applyInArrow(compare, "lang string, source string, item string, part_value long, gap long")
    return parts.groupBy("lang", "source", "item").agg((F.sum("part_value") + F.any_value("gap")).alias("value"))


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from its others, and its own terms.

    A language keeps the terms that at least ``least_docs`` of its documents hold. A group (lang, source), and a language, gives
    each of them a share p = 1 + floor(10^9 * (count + 5) / (N + 5 * V)), with N its occurrences of all V kept terms. Part ``pair``
    has for each other source of the language the sum of |p - q| over the kept terms; part ``term`` has the ``top`` kept terms that the
    group holds with a larger share than the language, by how much larger. Ranks are by value, then by item as UTF-8.

    Documents are cut into chunks at white space and stored in blocks as counts of each block's chunks. Every chunk that occurs
    anywhere is cut into terms once. Terms that too few documents can hold, by the sum over their chunks, are settled there;
    the others go back to the blocks that have their chunks, where documents and occurrences are counted exactly.

    All rows are documents of their own, repeated ones too. A null text, language or source counts as ''. A group without kept terms
    has count 0 for each; a language without kept terms gives pairs of value 0 and no terms; a language of one source gives
    no pairs. Empty tables give empty ones.
    """
    spark = docs.sparkSession
    text, lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source")))
    folder = f"{shared_folder(spark)}/divergence_{uuid.uuid4().hex}"

    def stored(name: str, df: DataFrame) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    try:
        held = stored("blocks", blocks(docs.select(text, lang, source)))
        # Chunks lie together once: first counted by language, then listed once each.
        by_lang = chunk_documents(held).repartition("chunk").groupBy("chunk", "lang").agg(F.sum("df").alias("df"))
        chunks = by_lang.groupBy("chunk").agg(F.collect_list(F.struct("lang", "df")).alias("held")).select("chunk", terms(F.col("chunk")).alias("terms"), "held")
        chunks = stored("chunks", chunks)
        pairs = chunks.select(F.explode("held").alias("h"), F.array_distinct("terms").alias("terms")).select("h.lang", "h.df", F.explode("terms").alias("term"))
        likely = pairs.groupBy("lang", "term").agg(F.sum("df").alias("df")).where(F.col("df") >= least_docs)
        likely = stored("likely", likely.select("term").distinct())
        parts = stored("terms", chunks.select("chunk", F.explode("terms").alias("term")).join(likely, "term", "left_semi").select("chunk", "term"))
        places = chunk_places(held).join(parts, "chunk").select("block", "place", "term")
        counts = cut_lineage(term_counts(held, places))
        groups = cut_lineage(held.select(F.explode("groups").alias("g")).select("g.lang", "g.source").distinct())
    finally:
        drop_folder(spark, folder)
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all_n")).where(F.col("docs") >= least_docs).drop("docs")
    kept = cut_lineage(kept)
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("all_n").alias("all_total"))
    own = counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "all_n")
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    facts = groups.join(langs, "lang", "left").join(totals, ["lang", "source"], "left").na.fill(0, ["kept", "all_total", "total"])
    facts = cut_lineage(facts.withColumn("zero", F.coalesce(share("0L", "total", "kept"), F.lit(0).cast("long"))))
    shares = own.join(facts, ["lang", "source"]).withColumns({"p": share("n", "total", "kept"), "q": share("all_n", "all_total", "kept")})
    shares = cut_lineage(shares.select("lang", "source", "term", "p", "q"))
    order = [F.desc("value"), F.asc("item")]
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))
    pair = compared(facts.select("lang", "source", "kept", "zero"), shares.drop("q")).withColumn("rank", place)
    term = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")).withColumn("rank", place).where(F.col("rank") <= top)
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(pair, "pair").unionByName(columns(term, "term"))
