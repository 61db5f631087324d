"""Operator 8: near-duplicate vectors by an inverted multi-index over two half-vector codebooks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import Groups, cut_lineage, tidied


def codebook(points: np.ndarray, size: int, rounds: int = 12, seed: int = 8) -> np.ndarray:
    """k-means centres of half-vectors: spread-out starts, then Lloyd rounds."""
    rng = np.random.default_rng(seed)
    centres = points[:1]
    far = ((points - centres[0]) ** 2).sum(1)
    while len(centres) < min(size, len(points)) and far.sum() > 0:
        centres = np.vstack((centres, points[rng.choice(len(points), p=far / far.sum())]))
        far = np.minimum(far, ((points - centres[-1]) ** 2).sum(1))
    for _ in range(rounds):
        own = np.concatenate([distances(points[at : at + 1024], centres).argmin(1) for at in range(0, len(points), 1024)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        counts = np.bincount(own, minlength=len(centres))[:, None]
        centres = np.where(counts > 0, sums / np.maximum(counts, 1), centres)
    return centres


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)


def nearest(far: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` least of each row, or all if there are fewer, in order."""
    if k >= far.shape[1]:
        return np.argsort(far, 1, kind="stable")
    some = np.argpartition(far, k - 1, 1)[:, :k]
    return np.take_along_axis(some, np.argsort(np.take_along_axis(far, some, 1), 1, kind="stable"), 1)


class MultiIndex:
    """Two codebooks whose pairs (i, j) are the cells; a cell's number is i * size of the second + j."""

    def __init__(self, unit: np.ndarray, size: int):
        self.half = unit.shape[1] // 2
        self.first, self.second = codebook(unit[:, : self.half], size), codebook(unit[:, self.half :], size)
        self.visits = 1

    def order(self, unit: np.ndarray, visits: int) -> np.ndarray:
        """The ``visits`` nearest cells of each vector, nearest first.

        Multi-sequence traversal: cells come by the sum of their two half distances. With both halves sorted, the
        pair of the r-th and s-th nearest centres has at least r * s pairs before it, so only pairs with
        (r + 1) * (s + 1) <= visits can be among the first ``visits``; those few are ranked at once.
        """
        d1, d2 = distances(unit[:, : self.half], self.first), distances(unit[:, self.half :], self.second)
        o1, o2 = nearest(d1, visits), nearest(d2, visits)
        pairs = [(r, s) for r in range(min(visits, d1.shape[1])) for s in range(min(visits // (r + 1), d2.shape[1]))]
        r, s = np.array(pairs).T
        total = np.take_along_axis(d1, o1[:, r], 1) + np.take_along_axis(d2, o2[:, s], 1)
        least = np.argsort(total, 1, kind="stable")[:, :visits]
        return np.take_along_axis(o1[:, r] * len(self.second) + o2[:, s], least, 1)

    def calibrate(self, unit: np.ndarray, cosine: float, recall: float, seed: int = 9) -> None:
        """Sets how many cells a search visits: enough that partners at exactly the least cosine are met with ``recall``.

        Partners are made from the sample by turning each vector by the limiting angle in a random direction; closer
        ones are met more often, so ``recall`` is what the worst links get.
        """
        rng = np.random.default_rng(seed)
        side = rng.normal(size=unit.shape)
        side -= (side * unit).sum(1, keepdims=True) * unit
        side /= np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-12)
        partner = cosine * unit + math.sqrt(1 - cosine**2) * side
        home = self.order(partner, 1)[:, 0]
        d1, d2 = distances(unit[:, : self.half], self.first), distances(unit[:, self.half :], self.second)
        i, j = np.divmod(home, len(self.second))
        rows = np.arange(len(unit))
        cost, d2 = d1[rows, i] + d2[rows, j], np.sort(d2, 1)
        # Cells at most as far as the partner's own: for each first half, how many second halves still fit.
        ranks = np.array([np.searchsorted(d2[k], cost[k] - d1[k] + 1e-12, "right").sum() for k in rows])
        self.visits = int(max(1, np.quantile(ranks, recall, method="higher")))


def unit_rows(vectors: list, dims: int) -> np.ndarray:
    """Double-precision unit vectors, padded with zeros to ``dims``."""
    out = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cosine: float = 0.98,
    recall: float = 0.999,
    cell_rows: int = 64,
    sample: int = 65_536,
    chunk: int = 2048,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    Rows are linked when their labels are equal and not null and their cosine, in double precision, is at least
    ``cosine``. Equal vectors of a label become one entry with a count before anything else, so a vector that
    a third of all rows repeat costs one entry. The product grid has about one cell for ``cell_rows`` entries, so the number of
    comparisons grows with the table, not with its square; the codebooks (its square root each) are fitted on eight sampled
    entries a centre, 4,096 at least and ``sample`` at most (the documented bound: it serves 4 billion entries), and the
    number of cells to visit for the target ``recall`` on 1,024 of them. All entries are indexed, and each visits its nearest
    cells, where every candidate is verified exactly. A cell is dealt out in blocks of ``chunk`` entries by
    ``4 * chunk`` visitors, so a crowded cell becomes many tasks; a block gives one row per linked entry.

    Vectors that are null, empty, zero, or hold null or non-finite components, and rows without a label or an id,
    link with nothing: n_links 0 and a component of their own. Vectors of different lengths never link. Ids may be of any
    ordered type; rows that repeat an id are vectors of their own, and each links by its own components. An empty table gives an empty one.
    """
    x = F.col(vector_col)
    single = "array<float>" in vectors.select(x).dtypes[0][1]
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), (x if single else x.cast("array<double>")).alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & finite & F.exists("v", lambda c: c != 0), F.lit(False))
    # -0.0 and 0.0 are one value, with one hash.
    rows = rows.withColumn("v", F.when(usable, F.transform("v", lambda c: c + F.lit(0.0).cast("float" if single else "double"))))
    rows = rows.withColumns({"k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit(1), "v")})
    keys = ["label", "k1", "k2"]
    entries = rows.where("v is not null").groupBy(*keys).agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.any_value("v").alias("v"))
    # An entry's number is its node: ids can repeat. It stands once the table is written.
    entries = cut_lineage(entries.select("*", F.size("v").alias("dims"), F.monotonically_increasing_id().alias("rep")))
    n, dims = entries.agg(F.count("*"), F.max("dims")).first()
    blank = rows.select("vec_id", *keys)
    if not n:
        return blank.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    size = max(2, round(math.sqrt(n / cell_rows)))
    picked = entries.select("v").orderBy(F.xxhash64("k1", "k2"), "rep").limit(min(sample, max(4096, 8 * size))).collect()
    unit = unit_rows([r.v for r in picked], dims)
    index = MultiIndex(unit, size)
    index.calibrate(unit[:1024], cosine, recall)
    shipped = vectors.sparkSession.sparkContext.broadcast(index)

    @tidied
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multi = shipped.value
        rows = max(1, (1 << 20) // max(len(multi.first), len(multi.second)))
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                b = whole.slice(start, rows)
                cells = multi.order(unit_rows(b.column("v").to_pylist(), dims), multi.visits)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, cells.size + 1, cells.shape[1]), pa.int32()), pa.array(cells.astype(np.int32).ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*b.schema.names, "cells"])

    schema = entries.select("label", "rep", "copies", "v", "dims", F.lit(None).cast("array<int>").alias("cells")).schema
    placed = cut_lineage(entries.select("label", "rep", "copies", "v", "dims").mapInArrow(place, schema))
    cell = ["label", "dims", "cell"]
    visits = placed.select("label", "dims", "rep", F.posexplode("cells").alias("rank", "cell"))
    sizes = visits.groupBy(*cell).agg(
        F.expr(f"int((count_if(rank = 0) - 1) div {chunk} + 1)").alias("m_parts"), F.expr(f"int((count(*) - 1) div {4 * chunk} + 1)").alias("v_parts"), F.count_if(F.col("rank") == 0).alias("m")
    )
    sizes = sizes.where("m > 0").drop("m")
    full = placed.select("label", "dims", "rep", "copies", "v", F.posexplode("cells").alias("rank", "cell")).join(sizes, cell)
    part = F.pmod(F.xxhash64("rep"), F.lit(1 << 30))
    members = full.where("rank = 0").select(*cell, "rep", "copies", "v", (part % F.col("m_parts")).alias("m_part"), F.explode(F.expr("sequence(0, v_parts - 1)")).alias("v_part"), F.lit(True).alias("member"))
    visitors = full.select(*cell, "rep", "copies", "v", F.explode(F.expr("sequence(0, m_parts - 1)")).alias("m_part"), (part % F.col("v_parts")).alias("v_part"), F.lit(False).alias("member"))
    both = members.withColumn("m_part", F.col("m_part").cast("int")).unionByName(visitors.withColumn("v_part", F.col("v_part").cast("int")))

    def verify(_, block):
        member = block.column("member").to_numpy()
        reps, copies = block.column("rep").to_numpy(), block.column("copies").to_numpy()
        flat = block.column("v").combine_chunks()
        unit = flat.flatten().to_numpy().astype(np.float64).reshape(len(reps), -1)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        m, v = np.flatnonzero(member), np.flatnonzero(~member)
        nodes, at = np.unique(reps, return_inverse=True)
        counts, groups = np.zeros(len(nodes), np.int64), Groups(len(nodes))
        for start in range(0, len(v), 512):
            some = v[start : start + 512]
            near = (unit[some] @ unit[m].T >= cosine) & (reps[some][:, None] != reps[m])
            counts[at[some]] += near @ copies[m]
            a, b = np.nonzero(near)
            groups.link(at[some[a]], at[m[b]])
        roots = groups.roots()
        linked = np.flatnonzero((counts > 0) | (np.bincount(roots, minlength=len(nodes))[roots] > 1))
        return pa.table({"rep": nodes[linked], "n": counts[linked], "root": nodes[roots[linked]]})

    found = cut_lineage(both.groupBy(*cell, "m_part", "v_part").applyInArrow(verify, "rep long, n long, root long"))
    member = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("rep").agg(F.sum("n").alias("n"))
    facts = entries.select(*keys, "rep", "least", "copies").join(links, "rep", "left").join(member, F.col("rep") == F.col("node"), "left")
    facts = facts.select(*keys, "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("c"))
    least = facts.groupBy("c").agg(F.min("least").alias("component_id"))
    out = blank.join(facts.join(least, "c").drop("c", "least"), keys, "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
