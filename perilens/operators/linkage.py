"""Linking records: exact lookups with fall-backs, unique prefixes, candidate scoring and overrides."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from perilens.functions.scalars import geo_score
from perilens.functions.text import NAME_RULES, charset_similarity, normal_address, normal_name
from perilens.functions.udfs import Texts, address_score, name_score

#: Weights of name, address and place, and the thresholds of the status ladder.
WEIGHTS = (0.50, 0.35, 0.15)
AUTO, MANUAL, PLAUSIBLE = 0.88, 0.72, 0.50


def lookup(rows: DataFrame, table: DataFrame, exact: Sequence[str], loose: Sequence[str], name: str, value: str) -> DataFrame:
    """``value`` by the exact keys, else by the loose keys and the name without brackets and spaces (least value wins)."""
    bare = lambda c: F.regexp_replace(c, r"[\s()（）\[\]【】]", "")
    first = table.groupBy(*exact).agg(F.min(value).alias("_a"))
    second = table.groupBy(*loose, bare(name).alias("_bare")).agg(F.min(value).alias("_b"))
    out = rows.join(first, list(exact), "left").withColumn("_bare", bare(name)).join(second, [*loose, "_bare"], "left")
    return out.withColumn(value, F.coalesce("_a", "_b")).drop("_a", "_b", "_bare")


def unique_prefix(aliases: DataFrame, table: DataFrame, alias: str, name: str, key: str, blocks: Sequence[str] = (), width: int = 3) -> DataFrame:
    """(alias, key) where exactly one name starts with the alias; joined on the blocks and the first characters.

    Aliases must have ``width`` characters; the prefix itself is verified on the pairs that meet.
    """
    a = aliases.where(F.length(alias) >= width).withColumn("_p", F.left(alias, F.lit(width)))
    t = table.withColumn("_p", F.left(name, F.lit(width)))
    pairs = a.join(t, [*blocks, "_p"]).where(F.col(name).startswith(F.col(alias)))
    return pairs.groupBy(alias, *blocks).agg(F.count("*").alias("_n"), F.min(key).alias(key)).where("_n = 1").drop("_n")


def match_status(score: Column, district: Column, address: Column, auto: float = AUTO, manual: float = MANUAL, plausible: float = PLAUSIBLE) -> Column:
    """AUTO_ACCEPT needs the district in the address; a plausible score without it is a mismatch before it is a review."""
    inside = F.coalesce((district != "") & address.contains(district), F.lit(False))
    return (
        F.when((score >= auto) & inside, "AUTO_ACCEPT").when(~inside & (score >= plausible), "DISTRICT_MISMATCH").when(score >= manual, "MANUAL_REVIEW").otherwise("REJECTED")
    )


def scored_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs (name, address, district, lat, lng; place_name, place_address, place_lat, place_lng) with their scores and status."""
    rules = NAME_RULES["matcher"]
    name = name_score(normal_name("name", rules), normal_name("place_name", rules))
    address = address_score(normal_address("address"), normal_address("place_address"), F.col("district"), F.col("place_address"))
    out = pairs.withColumns({"name_score": name, "address_score": address, "geo_score": geo_score("lat", "lng", "place_lat", "place_lng")})
    return _with_status(out)


def scored_pairs_simple(pairs: DataFrame, name: Column | None = None) -> DataFrame:
    """The plain scorer, in SQL only: common characters (``name``, if they are known), address containment, district in the address."""
    a, b = F.coalesce("address", F.lit("")), F.coalesce("place_address", F.lit(""))
    inside = F.when((a == "") | (b == ""), False).otherwise(a.contains(b) | b.contains(a))
    here = F.coalesce((F.col("district") != "") & b.contains(F.col("district")), F.lit(False))
    scores = {"name_score": charset_similarity("name", "place_name") if name is None else name, "address_score": inside.cast("double"), "geo_score": here.cast("double")}
    return _with_status(pairs.withColumns(scores))


def best_matches_simple(institutions: DataFrame, places: DataFrame, blocks: Sequence[str], key: str, tie: str, least: float) -> DataFrame:
    """``best_match`` of ``scored_pairs_simple`` over all pairs that agree on ``blocks``, without a row for each pair.

    Names count by their sets of characters alone, and what else a score has depends on the two addresses and the district. So
    rows that agree on these are one class. Sets meet sets once; of the places of one address the most alike set is the best for
    every institution with a set, as the score grows with it, and of places with both alike the least ``tie``. Only these meet
    the institutions. Where all rows differ, classes are rows and the pairs are all met, in tasks of bounded size.
    Gives (key, tie, scores, match_status).
    """
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    chars = lambda c: F.array_join(F.array_sort(F.array_distinct(F.split(F.coalesce(c, F.lit("")), ""))), "")
    left = institutions.select(*blocks, key, chars("name").alias("_a"), blank("address"), blank("district"))
    right = places.groupBy(*blocks, chars("place_name").alias("_b"), blank("place_address")).agg(F.min(F.struct(tie)).alias("_t"))
    sets = _sliced(left.select(*blocks, "_a").distinct(), right.select(*blocks, "_b").distinct(), blocks, 50_000)
    sets = sets.withColumn("_n", charset_similarity("_a", "_b"))
    near = sets.join(right, [*blocks, "_b"]).groupBy(*blocks, "_a", "place_address").agg(F.min(F.struct((-F.col("_n")).alias("_n"), "_t")).alias("_m"))
    classes = [*blocks, "_a", "address", "district"]
    scored = left.select(*classes).distinct().join(near, [*blocks, "_a"])
    scored = scored_pairs_simple(scored, -F.col("_m._n")).where(F.col("match_score") >= least)
    kept = ["address_score", "geo_score", "match_status"]
    first = F.min(F.struct((-F.col("match_score")).alias("match_score"), (-F.col("name_score")).alias("name_score"), "_m._t", *kept)).alias("_m")
    best = left.join(scored.groupBy(*classes).agg(first), classes)
    best = best.select(key, F.col(f"_m._t.{tie}").alias(tie), (-F.col("_m.match_score")).alias("match_score"), (-F.col("_m.name_score")).alias("name_score"), *[f"_m.{c}" for c in kept])
    return best_match(best, key, tie, least)


def _bagged(df: DataFrame, text: Column, name: str) -> DataFrame:
    """``df`` with ``<name>``, the text, and ``<name>_bag``: its characters as numbers, the same character's second, third ... occurrence as others."""
    df = df.withColumn(name, F.coalesce(text, F.lit(""))).withColumn("_c", F.filter(F.split(name, ""), lambda c: c != ""))
    nth = lambda c, i: F.ascii(c).cast("long") * 65536 + F.least(F.size(F.filter(F.slice("_c", F.lit(1), i + 1), lambda x: x == c)), F.lit(65535))
    return df.withColumn(f"{name}_bag", F.transform("_c", nth)).drop("_c")


def _most_alike(a: str, b: str) -> Column:
    """An upper bound of the partial and plain ratios of two bagged texts: with m characters in common and the shorter text's n, 2m / (n + m).

    A common subsequence has at most m characters, and the window of the other text that holds it has no fewer than the subsequence.
    """
    m = F.size(F.array_intersect(f"{a}_bag", f"{b}_bag"))
    n = F.least(F.size(f"{a}_bag"), F.size(f"{b}_bag"))
    return F.when(n > 0, 2.0 * m / (n + m)).otherwise(0.0)


def _sliced(left: DataFrame, right: DataFrame, blocks: Sequence[str], task_pairs: int) -> DataFrame:
    """The equi-join on ``blocks`` in tasks of about ``task_pairs`` pairs: the right rows of a block are dealt into slices, the left ones go to each."""
    n = left.groupBy(*blocks).agg(F.count("*").alias("_l")).join(right.groupBy(*blocks).agg(F.count("*").alias("_r")), list(blocks))
    n = n.withColumn("_slices", F.expr(f"least(_r, _l * _r div {task_pairs} + 1)"))
    total = n.agg(F.coalesce(F.sum("_slices"), F.lit(1))).first()[0]
    n = n.select(*blocks, "_slices")
    own = F.pmod(F.xxhash64(*right.columns), F.col("_slices"))
    right = right.join(n, list(blocks)).withColumn("_slice", own).drop("_slices").repartition(int(total), *blocks, "_slice")
    left = left.join(n, list(blocks)).withColumn("_slice", F.explode(F.expr("sequence(0L, _slices - 1)"))).drop("_slices")
    return left.join(right, [*blocks, "_slice"]).drop("_slice")


def place_matches(institutions: DataFrame, places: DataFrame, blocks: Sequence[str], least: float = MANUAL, task_pairs: int = 50_000) -> DataFrame:
    """The pairs of ``scored_pairs`` that score ``least`` or more, of all that agree on ``blocks``; the others are left out before they are scored.

    Institutions: (name, address, district, lat, lng), places: (place_name, place_address, place_lat, place_lng). Names and addresses become
    bags of characters once each. A pair's bags bound both similarities in SQL, the place's score is exact, so only pairs that can still
    reach ``least`` get their address scored, and of these again only those that can get their name scored. A block of many pairs is cut
    into tasks of about ``task_pairs`` of them, as scoring is what takes long. Names with
    repeated words or more than single spaces, for which the bound wouldn't hold, count as alike until they are scored.
    """
    rules = NAME_RULES["matcher"]
    left = _bagged(_bagged(institutions, normal_name("name", rules), "_a"), normal_address("address"), "_x")
    right = _bagged(_bagged(places, normal_name("place_name", rules), "_b"), normal_address("place_address"), "_y")
    odd = lambda c: (F.size(F.array_distinct(F.split(c, " "))) < F.size(F.split(c, " "))) | F.col(c).rlike(r"(?U)^\s|\s$|\s\s|[\s&&[^ ]]")
    left, right = left.withColumn("_odd_a", odd("_a")), right.withColumn("_odd_b", odd("_b"))
    w, floor = WEIGHTS, least - 1e-4
    inside = (F.coalesce("district", F.lit("")) == "") | F.coalesce(F.col("place_address").contains(F.col("district")), F.lit(False))
    empty = (F.col("_x") == "") | (F.col("_y") == "")
    address_most = F.when((F.col("_x") == "") & (F.col("_y") == ""), 0.5).when(empty, 0.0).otherwise(_most_alike("_x", "_y") * F.when(inside, 1.0).otherwise(0.3))
    name_most = F.when((F.col("_a") == "") | (F.col("_b") == ""), 0.0).when(F.col("_odd_a") | F.col("_odd_b"), 1.0).otherwise(_most_alike("_a", "_b"))
    pairs = _sliced(left, right, blocks, task_pairs).withColumn("geo_score", geo_score("lat", "lng", "place_lat", "place_lng"))
    pairs = pairs.withColumns({"_n": name_most, "_d": address_most}).drop("_a_bag", "_b_bag", "_x_bag", "_y_bag")
    pairs = pairs.where(F.col("_n") * w[0] + F.col("_d") * w[1] + F.col("geo_score") * w[2] >= floor)
    pairs = pairs.withColumn("address_score", address_score(F.col("_x"), F.col("_y"), F.col("district"), F.col("place_address")))
    pairs = pairs.where(F.col("_n") * w[0] + F.col("address_score") * w[1] + F.col("geo_score") * w[2] >= floor)
    pairs = pairs.withColumn("name_score", name_score(F.col("_a"), F.col("_b")))
    pairs = pairs.drop("_a", "_b", "_x", "_y", "_n", "_d", "_odd_a", "_odd_b")
    return _with_status(pairs).where(F.col("match_score") >= least)


def _tiled(left: DataFrame, right: DataFrame, blocks: Sequence[str], left_rows: int, right_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of an equi-join on ``blocks``, dealt into tiles (_i, _j) of about ``left_rows`` times ``right_rows`` of a block; every pair is in one tile."""
    n = left.groupBy(*blocks).agg(F.count("*").alias("_l")).join(right.groupBy(*blocks).agg(F.count("*").alias("_r")), list(blocks))
    n = n.select(*blocks, F.expr(f"(_l - 1) div {left_rows} + 1").alias("_l"), F.expr(f"(_r - 1) div {right_rows} + 1").alias("_r"))
    total = int(n.agg(F.coalesce(F.sum(F.col("_l") * F.col("_r")), F.lit(1))).first()[0])
    own = lambda df, count: F.pmod(F.xxhash64(*df.columns), F.col(count))
    each = lambda count: F.explode(F.expr(f"sequence(0L, {count} - 1)"))
    tiles = []
    for df, i, j in ((left, own(left, "_l"), each("_r")), (right, each("_l"), own(right, "_r"))):
        tiles.append(df.join(n, list(blocks)).withColumn("_i", i).withColumn("_j", j).drop("_l", "_r").repartition(total, *blocks, "_i", "_j"))
    return tiles[0], tiles[1]


def _geo_bounds(lat: float | None, lng: float | None, lats: np.ndarray, lngs: np.ndarray, missing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the most that ``geo_score`` can be by a distance that is a little off."""
    if lat is None or lng is None:
        return (np.full(len(lats), 0.5),) * 2
    a, b = np.radians(lat), np.radians(lats)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lngs - lng) / 2) ** 2
    km = 2 * 6371.0 * np.arcsin(np.sqrt(np.clip(np.nan_to_num(h), 0, 1)))
    score = lambda km, odd: np.where(missing, 0.5, np.where(np.isnan(h), odd, np.select([km <= 0.5, km <= 1, km <= 2, km <= 5], [1.0, 0.8, 0.5, 0.2], 0.0)))
    return score(km * 1.01 + 0.001, 0.0), score(km * 0.99 - 0.001, 1.0)


def best_place_matches(institutions: DataFrame, places: DataFrame, blocks: Sequence[str], key: str, tie: str, least: float = MANUAL, left_rows: int = 2048, right_rows: int = 16_384) -> DataFrame:
    """``best_match`` of ``scored_pairs`` over all pairs that agree on ``blocks``; columns as for ``place_matches``.

    Pairs are dealt into tiles. In a tile an institution is held against all of its places at once by upper bounds (``Texts``) of
    both similarities. The places of the highest bounds are scored; then all whose bound reaches the best of them. Only those that can be
    the best, or tie with it, leave the tile, so no table has a row for each pair.
    """
    rules = NAME_RULES["matcher"]
    left = institutions.withColumns({"_a": normal_name("name", rules), "_x": normal_address("address")})
    right = places.withColumns({"_b": normal_name("place_name", rules), "_y": normal_address("place_address")})
    left, right = _tiled(left, right, blocks, left_rows, right_rows)
    keys = [*blocks, "_i", "_j"]
    mine = [c for c in left.columns if c not in ("_i", "_j", "_a", "_x")]
    theirs = [c for c in right.columns if c not in (*keys, "_b", "_y")]
    schema = StructType([*[left.schema[c] for c in mine], *[right.schema[c] for c in theirs], *[StructField(c, DoubleType()) for c in ("name_score", "address_score")]])
    w, slack = WEIGHTS, 1.1e-4  # scores are rounded to four places

    def tile(own: pa.Table, held: pa.Table) -> pa.Table:
        picked = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))]
        if own.num_rows and held.num_rows:
            names, addresses = Texts(held.column("_b").to_pylist(), words=True), Texts(held.column("_y").to_pylist())
            raws = held.column("place_address").to_pylist()
            raw_of = {t: i for i, t in enumerate(dict.fromkeys(raws))}
            raw = np.fromiter((raw_of[t] for t in raws), np.int64, len(raws))
            lats, lngs = (held.column(c).to_numpy().astype(np.float64) for c in ("place_lat", "place_lng"))
            missing = np.array([held.column(c).is_null().to_numpy() for c in ("place_lat", "place_lng")]).any(0)
            addresses_seen, inside_seen = {}, {}
            for row, (a, x, district, lat, lng) in enumerate(zip(*(own.column(c).to_pylist() for c in ("_a", "_x", "district", "lat", "lng")))):
                if district not in inside_seen:
                    inside_seen[district] = np.array([1.0 if not district or t is not None and district in t else 0.3 for t in raw_of])
                inside = inside_seen[district][raw]
                if x not in addresses_seen:
                    if len(addresses_seen) * len(addresses.texts) > 1 << 22:
                        addresses_seen.clear()
                    addresses_seen[x] = addresses.most(x)
                near, near_first = addresses_seen[x]
                empty = (addresses.lengths == 0)[addresses.of]
                fixed = np.where(empty, 0.0 if x else 0.5, np.nan if x else 0.0)  # not a number: by similarity
                alike, alike_first = names.most(a)
                low, high = _geo_bounds(lat, lng, lats, lngs, missing)
                most = w[0] * alike[names.of] + w[1] * np.where(np.isnan(fixed), near[addresses.of] * inside, fixed) + w[2] * high
                best, todo, some = least, np.flatnonzero(most >= least - slack), 32
                found = []
                while len(todo):
                    if len(todo) > some:
                        todo = todo[np.argpartition(-most[todo], some)]
                    now, todo = todo[:some], todo[some:]
                    n, at = names.of[now], addresses.of[now]
                    by_name, by_address = np.zeros(len(now)), fixed[now]
                    if len(scored := np.flatnonzero(np.isnan(by_address))):
                        each, back = np.unique(at[scored], return_inverse=True)
                        by_address[scored] = np.minimum(1.0, addresses.exact(x, each, near_first)[back] * inside[now][scored])
                    can = np.flatnonzero(w[0] * alike[n] + w[1] * by_address + w[2] * high[now] >= best - slack) if a else np.zeros(0, np.int64)
                    if len(can := can[names.lengths[n[can]] > 0]):
                        each, back = np.unique(n[can], return_inverse=True)
                        by_name[can] = names.exact(a, each, alike_first)[back]
                    can = by_name * w[0] + by_address * w[1] + high[now] * w[2] >= best - slack
                    now, by_name, by_address = now[can], by_name[can], by_address[can]
                    found.append((now, by_name, by_address))
                    best = max(best, float((by_name * w[0] + by_address * w[1] + low[now] * w[2]).max(initial=0.0)))
                    todo, some = todo[most[todo] >= best - slack], 4096
                if found:
                    now, by_name, by_address = (np.concatenate(c) for c in zip(*found))
                    can = by_name * w[0] + by_address * w[1] + high[now] * w[2] >= best - slack
                    picked.append((np.full(int(can.sum()), row), now[can], by_name[can], by_address[can]))
        i, j, by_name, by_address = (np.concatenate(c) for c in zip(*picked))
        columns = [*[own.column(c).take(pa.array(i)) for c in mine], *[held.column(c).take(pa.array(j)) for c in theirs], pa.array(by_name), pa.array(by_address)]
        return pa.table(columns, names=schema.names)

    pairs = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(tile, schema)
    pairs = pairs.withColumn("geo_score", geo_score("lat", "lng", "place_lat", "place_lng"))
    return best_match(_with_status(pairs), key, tie, least)


def _with_status(df: DataFrame) -> DataFrame:
    w = WEIGHTS
    total = F.round(F.col("name_score") * w[0] + F.col("address_score") * w[1] + F.col("geo_score") * w[2], 4)
    df = df.withColumn("match_score", total)
    return df.withColumn("match_status", match_status(F.col("match_score"), F.coalesce("district", F.lit("")), F.coalesce("place_address", F.lit(""))))


def best_match(scored: DataFrame, key: str, tie: str, least: float = MANUAL) -> DataFrame:
    """The best candidate of each key by score, name score and tie-break; none below ``least``."""
    w = Window.partitionBy(key).orderBy(F.desc("match_score"), F.desc("name_score"), tie)
    return scored.where(F.col("match_score") >= least).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def overridden(matches: DataFrame, overrides: DataFrame, key: str, fields: Sequence[str], status: str = "match_status", label: str = "MANUAL_OVERRIDE") -> DataFrame:
    """A manual row replaces the automatic one, and comes in where there is none."""
    o = overrides.select(key, F.struct(*fields).alias("_o"))
    out = matches.join(o, key, "full")
    out = out.withColumns({c: F.when(F.col("_o").isNotNull(), F.col(f"_o.{c}")).otherwise(F.col(c)) for c in fields})
    return out.withColumn(status, F.when(F.col("_o").isNotNull(), label).otherwise(F.col(status))).drop("_o")


def merged_directory(old: DataFrame, new: DataFrame, keys: Sequence[str], key_id: str, fill: Sequence[str], provenance: str) -> DataFrame:
    """New rows take the id of the one old row with the same keys, its values where theirs are blank, and both provenances.

    Keys with several old rows count as unknown: the row comes in with a missing id.
    """
    o = old.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.first(c).alias(f"_{c}") for c in (key_id, *fill, provenance)]).where("_n = 1")
    out = new.drop(key_id).join(o, list(keys), "left").withColumn(key_id, F.col(f"_{key_id}"))
    out = out.withColumns({c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.col(f"_{c}")) for c in fill})
    out = out.withColumn(provenance, F.array_distinct(F.concat(F.coalesce(f"_{provenance}", F.array().cast("array<string>")), provenance)))
    return out.drop("_n", *[f"_{c}" for c in (key_id, *fill, provenance)])


def catalogue_filled(entities: DataFrame, catalogue: DataFrame, stored: DataFrame, keys: Sequence[str], item: str, level: str, score: str) -> DataFrame:
    """Every item of a catalogue for every entity, stored values where there are any, else N/A and 0.

    The result is entities times items. The items travel in lists of about a thousand, and each entity meets each list by its
    number, an equi-join; a short catalogue is one list, which Spark broadcasts by its size.
    """
    known = catalogue.select(item).distinct()
    lists = known.count() // 1000 + 1
    known = known.groupBy(F.pmod(F.xxhash64(item), F.lit(lists)).alias("_list")).agg(F.collect_list(item).alias("_items"))
    numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lists - 1).cast("long"))).alias("_list")
    grid = entities.select(*keys, numbers).join(known, "_list").select(*keys, F.explode("_items").alias(item))
    out = grid.join(stored, [*keys, item], "left")
    return out.withColumns({level: F.coalesce(level, F.lit("N/A")), score: F.coalesce(score, F.lit(0))})
