"""Operator 2: near-duplicate documents by SimHash fingerprints, found in BK-trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import components
from .shared import GOLDEN, Groups, WordHash, ascii_words, cut_lineage, rolling, tidied, tidy

_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int32)


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a text's word shingles, repeats included; 0 for a text without words."""
    words = ascii_words(text)
    if not words:
        return 0
    if len(words) <= width:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-width] + 1)).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(line[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist())), np.uint64, len(words) - width + 1)
    columns = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(columns[:, i], minlength=256) @ _BYTE_BITS for i in range(8)])
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > len(hashes)).tolist()))


class BKTree:
    """A BK-tree over distinct fingerprints: a node's children are keyed by their Hamming distance to it.

    A fingerprint is a row of 64-bit words. Built and searched level by level on arrays; ``edges`` holds
    parent * span + distance of every child, sorted. ``groups``, if given, is told of every node that an item meets
    within ``radius`` on its way down.
    """

    def __init__(self, keys: np.ndarray, groups: Groups | None = None, radius: int = -1):
        self.keys = keys
        self.span = 64 * keys.shape[1] + 1
        n = len(keys)
        edge, child = [], []
        items, at = np.arange(1, n), np.zeros(max(0, n - 1), np.int64)
        while len(items):
            far = self.distance(keys[items], at)
            if groups is not None:
                near = far <= radius
                groups.link(items[near], at[near])
            new, first, back = np.unique(at * self.span + far, return_index=True, return_inverse=True)
            edge.append(new)
            child.append(items[first])
            down = items[first][back]
            rest = down != items
            items, at = items[rest], down[rest]
        edges = np.concatenate(edge) if edge else np.zeros(0, np.int64)
        order = np.argsort(edges)
        self.edges = edges[order]
        self.children = (np.concatenate(child) if child else np.zeros(0, np.int64))[order]

    def distance(self, queries: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        return np.bitwise_count(queries ^ self.keys[nodes]).sum(1, dtype=np.int64)

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query position, node) pairs at distance <= radius; follows only edges within the radius."""
        for start in range(0, len(queries), 256):
            q = np.arange(start, min(start + 256, len(queries)))
            node = np.zeros(len(q), np.int64)
            while len(q):
                far = self.distance(queries[q], node)
                near = far <= radius
                if near.any():
                    yield q[near], node[near]
                low = np.searchsorted(self.edges, node * self.span + np.maximum(far - radius, 0))
                high = np.searchsorted(self.edges, node * self.span + np.minimum(far + radius, self.span - 1), "right")
                count = high - low
                q = np.repeat(q, count)
                node = self.children[np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())]


def connect(keys: np.ndarray, radius: int) -> np.ndarray:
    """For each distinct fingerprint the first one that it is connected with by steps of at most ``radius``.

    Building the tree links what meets on the way down. What is left are pairs in different groups, and all but one
    group's members query for those: a tight cluster, one group after the building, costs no queries.
    """
    groups = Groups(len(keys))
    tree = BKTree(keys, groups, radius)
    roots = groups.roots()
    asks = np.flatnonzero(roots != np.bincount(roots).argmax())
    for q, node in tree.within(keys[asks], radius):
        groups.link(asks[q], node)
    return groups.roots()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row's whole text as a signed 64-bit number."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.fromiter((fingerprint(t.as_py(), width, seed) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {id_type}, fp long")


def in_pieces(rows: DataFrame) -> DataFrame:
    """``rows`` (node, bucket, shards int and more) once for every piece (x, y) of the bucket that the node's shard is in."""
    own = F.pmod(F.xxhash64("node", "bucket"), F.col("shards")).cast("int")
    rows = rows.withColumn("own", own)
    # Shards a < b meet in piece (a, b); with two shards or more that covers the pairs inside each one as well.
    others = F.filter(F.sequence(F.lit(0), F.col("shards") - 1), lambda p: (p != F.col("own")) | (F.col("shards") == 1))
    pieces = F.explode(F.transform(others, lambda p: F.struct(F.least("own", p).alias("x"), F.greatest("own", p).alias("y"))))
    return rows.withColumn("p", pieces).withColumns({"x": F.col("p.x"), "y": F.col("p.y")}).drop("p", "own", "shards")


def in_buckets(rows: DataFrame, radius: int, shard_rows: int = 4096) -> DataFrame:
    """Links (a, b) of nodes that connect exactly what lies within ``radius`` and shares a bucket.

    ``rows``: (node, bucket, fp array<long>), one row for each bucket that a node is in. A bucket is cut by a hash
    into shards of about ``shard_rows``, and every two shards make a piece with a BK-tree of its own: a bucket that holds
    a third of all rows becomes many tasks of bounded size. A piece gives back a spanning set of the links
    that it finds (fewer than it has rows), never all pairs.
    """
    sizes = rows.groupBy("bucket").count().where("count > 1").withColumn("shards", F.expr(f"int((count - 1) div {shard_rows} + 1)"))
    held = sizes.agg(F.coalesce(F.sum(F.col("count") * F.greatest(F.lit(1), F.col("shards") - 1)), F.lit(0))).first()[0]
    rows = in_pieces(rows.join(sizes.select("bucket", "shards"), "bucket"))

    def search(_, piece):
        node = piece.column("node").to_numpy()
        order = np.argsort(node)
        node = node[order]
        flat = piece.column("fp").combine_chunks().flatten().to_numpy()
        roots = connect(flat.reshape(len(node), -1)[order].view(np.uint64), radius)
        moved = np.flatnonzero(roots != np.arange(len(roots)))
        return pa.table({"a": node[roots[moved]], "b": node[moved]})

    # The rows are few bytes and much work: tasks by their number, not by their size.
    rows = rows.repartition(int(held) // shard_rows + 8, "bucket", "x", "y")
    return rows.groupBy("bucket", "x", "y").applyInArrow(search, "a long, b long")


def masks(radius: int, levels: int) -> list[list[int]]:
    """For each level the bits that a bucket of each path agrees on; path p has the paths p * (radius + 1) + j below it.

    A level cuts the bits that are left into radius + 1 blocks, and two fingerprints within the radius agree on one of them.
    """
    out, blocks = [[0]], radius + 1
    for _ in range(levels):
        deeper = []
        for mask in out[-1]:
            left = [b for b in range(64) if not mask >> b & 1]
            cut = [left[len(left) * i // blocks : len(left) * (i + 1) // blocks] for i in range(blocks)]
            deeper += [mask | sum(1 << b for b in own) for own in cut]
        out.append(deeper)
    return out[1:]


def linked(distinct: DataFrame, radius: int = 2, shard_rows: int = 4096, levels: int = 3) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that connect exactly what lies within ``radius``.

    Two fingerprints within the radius agree on at least one of radius + 1 bit blocks, so each goes to that many
    buckets, and only what shares one is compared. A bucket of over ``shard_rows`` is cut again by the bits that are left,
    and again, so that its size grows by a factor and not by its square; what then still agrees on most bits goes to
    the pieces of ``in_buckets``.
    """
    blocks, done = radius + 1, None
    rows = distinct.select(F.col("fp").alias("node"), F.lit(0).alias("path"))
    for level, table in enumerate(masks(radius, levels)):
        of = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in table])
        below = F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda j: F.col("path") * blocks + j))
        rows = rows.select("node", below.alias("path"))
        rows = rows.withColumn("bucket", F.xxhash64("path", F.col("node").bitwiseAND(F.element_at(of, F.col("path") + 1))))
        sizes = rows.groupBy("bucket").count().where("count > 1")
        rows = cut_lineage(rows.join(sizes, "bucket"))
        final = rows if level == levels - 1 else rows.where(f"count <= {shard_rows}")
        final = final.select("node", "bucket")
        done = final if done is None else done.unionByName(final)
        rows = rows.where(f"count > {shard_rows}").select("node", "path")
        if level < levels - 1 and rows.isEmpty():
            break
    return in_buckets(done.withColumn("fp", F.array("node")), radius, shard_rows)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42, radius: int = 2
) -> DataFrame:
    """(doc_id, fingerprint, component_id, fp_rows) for every row of ``docs``.

    component_id is the smallest doc_id that a chain of links reaches, the row's own included; two rows are linked
    when their fingerprints differ in ``radius`` bits or fewer. Rows with one fingerprint are collapsed before
    any comparison, so a group of copies of any size is one node. A null or empty text, or one of white space,
    has fingerprint zero and is linked like any other. Repeated ids are kept as rows; a null id never is a
    component's smallest (a component of null ids alone has a null component_id). An empty table gives an empty one.
    """
    prints = cut_lineage(fingerprints(docs, id_col, text_col, width, seed))
    nodes = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("fp_rows")))
    member = components(linked(nodes.select("fp"), radius))
    joined = nodes.join(member, nodes.fp == member.node, "left").select("fp", "least", "fp_rows", F.coalesce("component", "fp").alias("c"))
    least = joined.groupBy("c").agg(F.min("least").alias("component_id"))
    classes = joined.join(least, "c").select("fp", "component_id", "fp_rows")
    out = prints.join(classes, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp_rows")


#: Bands of MinHash values and values a band: two sets at Jaccard 0.8 agree in a band in 999,994 of a million cases.
BANDS, BAND_ROWS = 40, 6
#: Runs (8 bytes each) that a shard of a piece takes, and that small groups are packed to.
SHARD_RUNS, PACK_RUNS = 1 << 20, 1 << 18

_FACTORS = np.random.default_rng(5).integers(0, 2**63, BANDS * BAND_ROWS, dtype=np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)


def bands(runs: np.ndarray) -> np.ndarray:
    """A key for each band of the MinHash values of a set of run hashes; a set without runs has none."""
    if not len(runs):
        return runs
    least = np.full(BANDS * BAND_ROWS, ~np.uint64(0))
    with np.errstate(over="ignore"):
        for start in range(0, len(runs), 256):
            np.minimum(least, (runs[start : start + 256, None] * _FACTORS).min(0), out=least)
        keys = np.arange(1, BANDS + 1, dtype=np.uint64)
        for values in least.reshape(BAND_ROWS, BANDS):
            keys = (keys ^ values) * GOLDEN
            keys ^= keys >> np.uint64(29)
    return keys


def alike(runs: np.ndarray, sizes: np.ndarray, similarity: float) -> np.ndarray:
    """For each set of run hashes the first that it is connected with by steps of at least the Jaccard ``similarity``.

    Exact: a set is held against all sets that no group has yet, so a tight cluster of any size takes few rounds.
    """
    n = len(sizes)
    roots = np.full(n, -1)
    _, ids, times = np.unique(runs, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    shared = times[ids] > 1
    owner, ids = owner[shared], ids[shared]
    bounds = np.searchsorted(owner, np.arange(n + 1))
    left, left_ids, mark = owner, ids, np.zeros(len(times), bool)
    free = before = n
    for seed in range(n):
        if roots[seed] >= 0:
            continue
        roots[seed] = seed
        free -= 1
        asks = [seed]
        while asks and free:
            ask = asks.pop()
            own = ids[bounds[ask] : bounds[ask + 1]]
            if len(own) < similarity * sizes[ask] - 1e-9:
                continue
            if free < before / 2:
                still = roots[left] < 0
                left, left_ids, before = left[still], left_ids[still], free
            mark[own] = True
            both = np.bincount(left[mark[left_ids]], minlength=n)
            mark[own] = False
            near = np.flatnonzero((roots < 0) & (both > 0) & (both >= similarity * (sizes[ask] + sizes - both) - 1e-9))
            roots[near] = seed
            free -= len(near)
            asks += near.tolist()
    return roots


def verified(places: DataFrame, runs: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that connect exactly what is at ``similarity`` or more and meets in a piece under the same ``held``.

    ``places``: (node, bucket, x, y, held); ``runs``: (node, runs), one row a node. A piece gives a spanning set of links.
    """

    def search(_, piece):
        node, held = piece.column("node").to_numpy(), piece.column("held").to_numpy()
        order = np.lexsort((node, held))
        node, held = node[order], held[order]
        lists = piece.column("runs").combine_chunks().take(pa.array(order))
        sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
        flat, ends = lists.flatten().to_numpy(), np.cumsum(sizes)
        first, second = [], []
        cuts = np.flatnonzero(np.append(True, held[1:] != held[:-1]))
        for a, b in zip(cuts, np.append(cuts[1:], len(held))):
            if b - a > 1:
                roots = alike(flat[ends[a] - sizes[a] : ends[b - 1]], sizes[a:b], similarity)
                moved = np.flatnonzero(roots != np.arange(b - a))
                first.append(node[a + roots[moved]])
                second.append(node[a + moved])
        del lists, flat
        tidy()
        none = [np.zeros(0, np.int64)]
        return pa.table({"a": np.concatenate(first or none), "b": np.concatenate(second or none)})

    return places.join(runs, "node").groupBy("bucket", "x", "y").applyInArrow(search, "a long, b long")


def _run_sets(texts: pa.Array, width: int, memo: WordHash) -> Iterator[np.ndarray]:
    for text in texts:
        hashes = memo.of((text.as_py() or "").encode("utf-8", "surrogatepass").split())
        yield np.unique(rolling(hashes[hashes != 0], width))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in parts], dtype=np.int32))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*parts, np.zeros(0, np.uint64)]).view(np.int64)))


def _names(own: np.ndarray) -> tuple[int, int]:
    """Two hashes that stand for a set of runs."""
    return xxhash.xxh64_intdigest(own.tobytes(), 1), xxhash.xxh64_intdigest(own.tobytes(), 2)


def _named(docs: DataFrame, text_col: str, width: int) -> DataFrame:
    """``docs`` with the names k1 and k2 of each text's set of runs."""
    at = [c.lower() for c in docs.columns].index(text_col.lower())

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHash(loose=True)
        for b in batches:
            keys = np.array([_names(x) for x in _run_sets(b.column(at), width, memo)], np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(np.ascontiguousarray(k)) for k in keys.T)], names=[*b.schema.names, "k1", "k2"])

    return docs.mapInArrow(run, docs.select("*", F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2")).schema)


#: The table of bits that tells ids without a part in any group at once: bits for each id, most bits (64 MB), bits in one of its rows (4 KB each).
BITS_AN_ID, MOST_BITS, ROW_BITS = 16, 1 << 29, 1 << 15


def marks(ids: DataFrame, id_col: str) -> tuple[DataFrame, int]:
    """((_row, _bits), number of bits): a bit for the hash value of each id, in a table that grows with the ids up to MOST_BITS.

    One in sixteen other ids or fewer has its bit set by chance, up to some 30 million ids; beyond that the share grows. The table only
    filters: what it lets through is decided by the ids themselves.
    """
    ids = cut_lineage(ids.select(id_col).distinct())
    size = max(ROW_BITS, min(MOST_BITS, 1 << (BITS_AN_ID * ids.count() - 1).bit_length()))
    place = F.pmod(F.xxhash64(id_col), F.lit(size))
    rows = ids.select((place / ROW_BITS).cast("int").alias("_row"), (place % ROW_BITS).alias("_at"))
    return cut_lineage(rows.groupBy("_row").agg(F.bitmap_construct_agg("_at").alias("_bits"))), size


def marked(docs: DataFrame, id_col: str, bits: tuple[DataFrame, int]) -> DataFrame:
    """``docs`` with ``_marked``: false where the id is surely none of those in ``bits``. Nothing is shuffled."""
    table, size = bits
    place = F.pmod(F.xxhash64(id_col), F.lit(size))
    rows = docs.withColumns({"_row": (place / ROW_BITS).cast("int"), "_at": place % ROW_BITS}).join(F.broadcast(table), "_row", "left")
    bit = F.expr("getbit(int(conv(hex(substring(_bits, int(_at div 8) + 1, 1)), 16, 10)), int(_at % 8)) = 1")
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce(bit, F.lit(False)).alias("_marked"))


def print_links(prints: DataFrame, radius: int, shard_rows: int = 4096) -> DataFrame:
    """Links (a, b) that connect the nodes k1 of ``prints`` (fp, k1) whose fingerprints are connected within ``radius``.

    A fingerprint is a node of its own, named by a hash: linked to those within the radius, as the BK-trees find them, and to
    each k1 that has it. So texts of one fingerprint are never paired, and fingerprints that connect nothing are left out.
    """
    pairs = cut_lineage(prints.select("fp", "k1").distinct())
    near = cut_lineage(linked(pairs.select("fp").distinct(), radius, shard_rows))
    shared = pairs.groupBy("fp").count().where("count > 1").select("fp")
    used = near.select(F.col("a").alias("fp")).union(near.select("b")).union(shared).distinct()
    name = lambda fp: F.xxhash64(F.lit("fingerprint"), fp)
    return near.select(name("a").alias("a"), name("b").alias("b")).union(pairs.join(used, "fp", "left_semi").select(name("fp"), "k1"))


def _classes(rows: DataFrame, width: int, similarity: float, shard_rows: int, most_shards: int, radius: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(prints, classes) of rows (doc_id, text): k1 and k2 for each row; for each (k1, k2) its least id and its group c.

    With a ``radius`` the groups are those of ``near_duplicates`` as well: its fingerprints, linked by its BK-trees.
    """

    @tidied
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHash(loose=True)
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                b = whole.slice(start, 1000)
                keys, sizes, found = np.zeros((b.num_rows, 3), np.uint64), np.zeros(b.num_rows, np.int64), []
                for i, own in enumerate(_run_sets(b.column(1), width, memo)):
                    keys[i, :2], sizes[i] = _names(own), len(own)
                    found.append(bands(own))
                    if radius is not None:
                        keys[i, 2] = fingerprint(b.column(1)[i].as_py())
                k1, k2, fp = (pa.array(np.ascontiguousarray(k).view(np.int64)) for k in keys.T)
                yield pa.RecordBatch.from_arrays([b.column(0), k1, k2, fp, pa.array(sizes), _lists(found)], names=["doc_id", "k1", "k2", "fp", "n_runs", "bands"])

    @tidied
    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHash(loose=True)
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                own = list(_run_sets(whole.column(1).slice(start, 500), width, memo))
                keys = np.array([_names(x)[0] for x in own], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), _lists(own)], names=["node", "runs"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    prints = cut_lineage(rows.mapInArrow(sign, f"doc_id {id_type}, k1 long, k2 long, fp long, n_runs long, bands array<long>"))
    nodes = prints.groupBy("k1", "k2").agg(F.min("doc_id").alias("least"), F.any_value("n_runs").alias("n_runs"), F.any_value("bands").alias("bands"))
    nodes = cut_lineage(nodes)
    keyed = nodes.select(F.col("k1").alias("node"), F.explode("bands").alias("bucket"))
    met = keyed.groupBy("bucket").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").select("bucket", "a")
    met = keyed.join(met, "bucket").where("a <> node")
    group = components(met.select("a", F.col("node").alias("b")))
    members = group.join(nodes.select(F.col("k1").alias("node"), "n_runs", "least"), "node")
    size = members.groupBy("component").agg(F.count("*").alias("n"), F.sum("n_runs").alias("runs"))
    shards = F.expr(f"int(greatest((n - 1) div {shard_rows}, (runs - 1) div {SHARD_RUNS}) + 1)")
    members = cut_lineage(members.join(size.select("component", shards.alias("shards")), "component"))
    total, most = members.agg(F.coalesce(F.sum(F.when(F.col("shards") == 1, F.col("n_runs"))), F.lit(0)), F.coalesce(F.max("shards"), F.lit(0))).first()

    packed = F.when(F.col("shards") == 1, F.pmod(F.xxhash64("component"), F.lit(int(total) // PACK_RUNS + 1))).otherwise(F.col("component"))
    whole = members.where(F.col("shards") <= most_shards)
    places = in_pieces(whole.select("node", packed.alias("bucket"), F.col("component").alias("held"), "shards"))
    if most > most_shards:
        wide = members.where(F.col("shards") > most_shards).select("node", "n_runs")
        wide = keyed.join(wide, "node")
        size = wide.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("n_runs").alias("runs")).where("n > 1")
        wide = wide.join(size.select("bucket", shards.alias("shards")), "bucket").select("node", "bucket", F.col("bucket").alias("held"), "shards")
        places = places.unionByName(in_pieces(wide))
    asked = members.select(F.col("least").alias("asked")).distinct()
    texts = marked(rows, "doc_id", marks(asked, "asked")).where("_marked").join(asked, F.expr("doc_id <=> asked"), "left_semi").select("doc_id", "text")
    runs = texts.mapInArrow(again, "node long, runs array<long>").groupBy("node").agg(F.any_value("runs").alias("runs"))
    links = verified(places, runs, similarity)
    if radius is not None:
        links = links.union(print_links(prints, radius, shard_rows))
    member = components(links)
    joined = nodes.join(member, nodes.k1 == member.node, "left").select("k1", "k2", "least", F.coalesce("component", "k1").alias("c"))
    return prints.select("doc_id", "k1", "k2"), joined


def similar_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, shard_rows: int = 4096, most_shards: int = BANDS
) -> DataFrame:
    """(doc_id, component_id) for every row: groups of documents whose sets of ``width``-word runs are alike.

    Two documents are linked if the Jaccard similarity of their sets of runs is at least ``similarity``: each link is
    checked on the runs themselves (as 64-bit hashes). Candidates share one of BANDS keys of BAND_ROWS MinHash values,
    whatever the number of rows: a pair at 0.8 does but for 6 in a million, one at 0.9 but for less than one in 10 ** 12.
    The candidates' own groups go to pieces of bounded size: small ones are packed, larger ones are cut into shards of about
    ``shard_rows`` or SHARD_RUNS that meet in pairs, and one of over ``most_shards`` is cut along its keys instead.
    ``docs`` is read twice, the second time for what has a candidate, and must hold the same rows both times, in any order.

    Words are compared in lower case and without punctuation at their ends. Texts with equal runs are one node. Texts
    without words (null, empty, white space, punctuation alone) are alike and form one group. Ids may be of any ordered
    type; repeated ids are rows of their own; a null id never is a component's smallest; an empty table gives an empty one.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    prints, joined = _classes(rows, width, similarity, shard_rows, most_shards)
    least = joined.groupBy("c").agg(F.min("least").alias("component_id"))
    return prints.join(joined.join(least, "c").select("k1", "k2", "component_id"), ["k1", "k2"]).select("doc_id", "component_id")


def distinct_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    similarity: float = 0.8,
    shard_rows: int = 4096,
    most_shards: int = BANDS,
    radius: int = 2,
) -> DataFrame:
    """The rows of ``docs`` that stay if each group of near copies keeps exactly one: its smallest id.

    Near copies are those of ``near_duplicates``: SimHash fingerprints within ``radius`` of each other, found in BK-trees. A radius of
    2 of 64 bits reaches copies with few words changed; the rest, links of ``similar_documents``, is joined to them. A group is what
    links of both kinds connect: every group of either operator lies whole in one.

    All columns are kept as they are. A null id comes after all others, so a group of null ids alone keeps one of them.
    Where a group's smallest id occurs in several of its rows, or in rows of other groups, the row is found by its text
    and, between texts of equal words, by the least hash of the whole row; of rows that are equal in all columns one stays.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    prints, joined = _classes(rows, width, similarity, shard_rows, most_shards, radius)
    order = F.struct(F.col("least").isNull(), F.col("least"), "k1", "k2")
    keepers = cut_lineage(joined.groupBy("c").agg(F.min_by(F.struct("k1", "k2", "least"), order).alias("k")).select("k.*"))
    # A row whose id has no part in a group of several rows stays. An id of one row decides by itself; only rows whose id is
    # null or repeated are named by their texts again.
    ids = prints.groupBy("doc_id").agg(F.count("*").alias("n"))
    repeated = ids.where("n > 1 or doc_id is null").select(F.col("doc_id").alias("_id"))
    sizes = joined.join(prints.groupBy("k1", "k2").agg(F.count("*").alias("n")), ["k1", "k2"])
    several = sizes.join(sizes.groupBy("c").agg(F.sum("n").alias("rows")).where("rows > 1"), "c", "left_semi").select("k1", "k2")
    bits = marks(prints.join(several, ["k1", "k2"], "left_semi").select(F.col("doc_id").alias("_id")).union(repeated), "_id")
    both = marked(docs, id_col, bits)
    docs = both.where("_marked").drop("_marked")
    single = keepers.join(ids.where("n = 1"), F.col("least") == F.col("doc_id")).select(F.col("least").alias("_id"))
    same = F.col(f"d.{id_col}").eqNullSafe(F.col("r._id"))
    clear = docs.alias("d").join(single.alias("r"), F.col(f"d.{id_col}") == F.col("r._id"), "left_semi")
    named = _named(docs.alias("d").join(repeated.alias("r"), same, "left_semi").select(F.struct("*").alias("row"), F.col(id_col).alias("_id"), F.col(text_col).alias("text")), "text", width)
    found = named.join(keepers, ["k1", "k2"]).where(F.col("_id").eqNullSafe(F.col("least")))
    place = F.row_number().over(Window.partitionBy("k1", "k2").orderBy(F.xxhash64("row"), F.to_json("row")))
    kept = clear.unionByName(found.withColumn("_k", place).where("_k = 1").select("row.*"))
    return both.where("not _marked").drop("_marked").unionByName(kept)
