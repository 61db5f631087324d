"""Source divergence (11), exact top-k (12) and periodic runs (13)."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from perilens.llm import divergence, metric_tree, periodic_runs, registry

DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# 11


def brute_divergence(rows, least=30, top=50):
    lower = str.maketrans(divergence.LETTERS, divergence.LETTERS.lower())
    rows = [(t or "", a or "", s or "") for t, a, s in rows]
    found = [(re.findall(divergence.TERM, t.translate(lower)), a, s) for t, a, s in rows]
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for words, a, s in found:
        docs[a].update(set(words))
        counts[a, s].update(words)
    kept = {a: [t for t, n in docs[a].items() if n >= least] for _, a, _ in found}
    shares = {}
    for (a, s), n in counts.items():
        total = sum(n[t] for t in kept[a])
        shares[a, s] = {t: 1 + 10**9 * (n[t] + 5) // (total + 5 * len(kept[a])) for t in kept[a]}
    out = set()
    for (a, s), p in shares.items():
        whole = Counter()
        for (b, _), n in counts.items():
            whole += n if b == a else Counter()
        total = sum(whole[t] for t in kept[a])
        pairs = [(-sum(abs(p[t] - q[t]) for t in kept[a]), r.encode()) for (b, r), q in shares.items() if b == a and r != s]
        own = [(-(p[t] - q), t.encode()) for t in kept[a] if counts[a, s][t] for q in [1 + 10**9 * (whole[t] + 5) // (total + 5 * len(kept[a]))] if p[t] > q]
        for part, listed in (("pair", sorted(pairs)), ("term", sorted(own)[:top])):
            out |= {(a, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(listed, 1)}
    return out


def divergence_rows(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, n long, term string")
    found = divergence.source_divergence(df, **more).collect()
    assert all(set(r.asDict()) == {"lang", "source", "part", "item", "value", "rank"} for r in found)
    got = {(r.lang, r.source, r.part, r.item, r.value, r.rank) for r in found}
    assert len(got) == len(found)
    return got


def test_divergence_of_odd_rows(spark):
    rng = random.Random(4)
    bits = ["the", "The", "the,", "(the)", "a-a", "a", "é b", "Ünd", "zwölf", "x1y", "...", "12", " ", "İ", "ab\x00cd", "[b]"]
    rows = [(" ".join(rng.choice(bits) for _ in range(rng.randint(0, 9))), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "s3", None, "ß"])) for _ in range(150)]
    rows += [(None, "en", "nothing"), ("", "xx", "alone"), ("a b c " * 30_000, "en", "s1"), ("b" * 200_000 + ".x", "en", "s2")] + [("the the", "en", "copies")] * 40
    assert divergence_rows(spark, rows, least_docs=6, top=4) == brute_divergence(rows, 6, 4)


def test_divergence_with_blocks_and_pieces_of_few(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_BYTES", 200)
    monkeypatch.setattr(divergence, "PIECE_SOURCES", 3)
    monkeypatch.setattr(divergence, "PIECE_TERMS", 4)
    rng = random.Random(5)
    rows = [(" ".join(f"w{chr(97 + min(rng.randrange(26), rng.randrange(26)))}{rng.choice(['', '.', '!'])}" for _ in range(12)), rng.choice("ab"), f"s{rng.randrange(11)}") for _ in range(200)]
    assert divergence_rows(spark, rows, least_docs=5) == brute_divergence(rows, 5)


def test_divergence_without_terms_or_rows(spark):
    assert divergence_rows(spark, [("12 34", "en", "a"), ("", "en", "b")]) == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}
    assert divergence_rows(spark, [("12 34", "en", "a")]) == set() and divergence_rows(spark, []) == set()


def test_shares_beyond_64_bits(spark):
    n = 10**13
    got = spark.range(1).select(F.lit(n).alias("n"), F.lit(3 * n).alias("t"), F.lit(7).cast("long").alias("v")).select(divergence.share("n", "t", "v").alias("p")).first().p
    assert got == 1 + 10**9 * (n + 5) // (3 * n + 35)


# 12


def brute_products(rows, every, k=5):
    usable = [(n, i, [int(np.floor(256.0 * x)) for x in v]) for n, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and np.isfinite(256.0 * x) for x in v)]
    out = Counter()
    for n, i, v in usable:
        if i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), j, m) for m, j, w in usable if m != n and len(w) == len(v))[:k]
            out.update((i, rank, j, -s) for rank, (s, j, _) in enumerate(found, 1))
    return out


def products(spark, rows, every=3, kind="double", **more):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], f"vec_id long, embedding array<{kind}>, query string, node long")
    return Counter(map(tuple, metric_tree.top_products(df, F.col("vec_id") % every == 0, **more).collect()))


@pytest.mark.parametrize("sizes", [dict(), dict(fan_out=8, page_rows=40, probes=2, most_levels=2), dict(fan_out=3, page_rows=5, probes=1, most_levels=1)])
def test_products_equal_brute_force(spark, sizes):
    rng = np.random.default_rng(6)
    rows = [(int(i), [float(x) for x in np.float32(v)]) for i, v in enumerate(rng.normal(size=(160, 5)) * rng.choice([0.01, 0.3, 2.0], (160, 1)))]
    rows += [(1000 + i, rows[7][1]) for i in range(30)] + [(3 * i, [0.0] * 5) for i in range(20)] + [rows[3], rows[3], (3, rows[9][1])]
    assert products(spark, rows, kind="float", **sizes) == brute_products(rows, 3)


def test_products_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (None, [9.0, 9.0]), (3, None), (6, []), (9, [None, 1.0]), (12, [nan, 1.0]), (15, [inf, 1.0]), (18, [-1.0, -0.0]), (21, [1.0, 2.0, 3.0]), (1, [1e300, 1e300]), (2, [-0.001, 0.0]), (-3, [5e7, -3e7]), (24, [4e6, 4e6])]
    got = products(spark, rows)
    top = (1 << 63) - 1
    want = Counter({(i, r, j, max(min(s, top), -top - 1)): n for (i, r, j, s), n in brute_products(rows, 3).items()})
    assert {x[:2] for x in got} == {x[:2] for x in want} and all(abs(x[3]) <= top + 1 for x in got)
    small = [r for r in rows if r[0] != 1]
    assert products(spark, small) == brute_products(small, 3)
    assert products(spark, [(0, [1.0])]) == Counter() and products(spark, []) == Counter()


def test_no_stored_table_of_products_holds_pairs_of_queries_and_leaves(spark, monkeypatch):
    sizes, plain = [], metric_tree.cut_lineage
    monkeypatch.setattr(metric_tree, "cut_lineage", lambda df: (out := plain(df), sizes.append(out.count()))[0])
    rows = [(i, [float(x) for x in np.float32(v)]) for i, v in enumerate(np.random.default_rng(3).normal(size=(300, 16)))]
    want = brute_products(rows, 1)
    for most in (metric_tree.BROADCAST, 300):  # one block and deals by a broadcast; many blocks and deals by a shuffle
        monkeypatch.setattr(metric_tree, "BROADCAST", most)
        assert products(spark, rows, every=1, kind="float", fan_out=8, page_rows=12) == want
    assert max(sizes) <= 6 * len(rows)


# 13


def brute_runs(words, least=24, powers=3):
    ids = {}
    t = np.array([ids.setdefault(w, len(ids)) for w in words])
    out = []
    for q in range(1, len(t) // powers + 1):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (t[:-q] == t[q:]).astype(int), [0]))))
        for x, y in edges.reshape(-1, 2).tolist():
            length = y - x + q
            if length >= max(least, powers * q) and not any((t[x : x + length - r] == t[x + r : x + length]).all() for r in range(1, q)):
                out.append((x, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize(("least", "powers"), [(24, 3), (4, 2), (6, 3)])
def test_runs_equal_brute_force(least, powers):
    rng = random.Random(7)
    for _ in range(150):
        lot = []
        for _ in range(rng.randint(1, 5)):
            n = rng.randint(0, 100)
            words = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 30])) for _ in range(n)]
            for _ in range(rng.randint(0, 3) if n else 0):
                a, p = rng.randrange(n), rng.randint(1, 25)
                for i in range(a + p, min(n, a + rng.randint(1, 90))):
                    words[i] = words[i - p]
            lot.append(words)
        assert periodic_runs.lot_runs(lot, least, powers) == [brute_runs(words, least, powers) for words in lot]


def test_squares_are_the_branching_ones():
    rng = np.random.default_rng(8)
    for _ in range(60):
        t = np.concatenate(([9], rng.integers(0, 3, int(rng.integers(0, 60))), [10]))
        want = [(i, d) for i in range(1, len(t)) for d in range(1, len(t)) if i + 2 * d < len(t) and (t[i : i + d] == t[i + d : i + 2 * d]).all() and t[i + d] != t[i + 2 * d]]
        start, root = periodic_runs.branching_squares(np.unique(t, return_inverse=True)[1])
        assert sorted(zip(start.tolist(), root.tolist())) == want


def test_runs_of_odd_rows(spark):
    long = "a " * 60_000 + " ".join(f"{i}" for i in range(30_000)) + " x y" * 40_000
    texts = [None, "", " \t\n", "one", "b b " * 30, "c\x0bc\x0c" * 20, "A a " * 12, long, "é ü " * 13 + "é", "é ü " * 13 + "é"]
    df = spark.createDataFrame([(None if i == 3 else i // 2, t, 7, "old") for i, t in enumerate(texts)], "doc_id long, text string, n_words long, runs string")
    out = periodic_runs.periodic_runs(df).collect()
    for text, r in zip(texts, sorted(out, key=lambda r: texts.index(r.collapsed) if r.collapsed in texts else 99) and out):
        words = WORD.findall(text or "")
        assert r.n_words == len(words)
    assert [[tuple(x) for x in r.runs] for r in out[:7]] == [[], [], [], [], [(0, 30, 1)], [(0, 40, 1)], [(0, 24, 2)]]
    assert [[tuple(x) for x in r.runs] for r in out[7:]] == [[(0, 60_000, 1), (90_000, 80_000, 2)], [(0, 27, 2)], [(0, 27, 2)]]
    assert out[4].collapsed == "b b" and out[8].collapsed == "é ü" and out[7].collapsed.split()[:2] == ["a", "0"] and out[7].collapsed.endswith("29999 x y")
    assert periodic_runs.periodic_runs(df.limit(0)).count() == 0


def test_runs_query_equals_brute_force(spark):
    def want(i, text):
        words = WORD.findall(text or "")
        n, h = len(words), zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (k - a) % p] for k in range(a, n)]
        found = brute_runs(words)
        best = None
        for s, length, q in found:
            if best is None or length * best[2] > best[1] * q:
                best = (s, length, q)
        gone = {k for s, length, q in found for k in range(s + q, s + length)}
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        return (i, len(found), *top, sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))

    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, registry.op13_periodic_runs(spark, DIR).collect()))
    assert got == sorted(want(r.doc_id, r.text) for r in docs)


def test_planting_leaves_rows_without_ids_or_words(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    df = spark.createDataFrame([(ids[0], None), (ids[1], " \n"), (None, "a b"), (ids[2], "w")], "doc_id long, text string")
    assert {(r.doc_id, r.text) for r in registry.with_planted_repeats(df).collect()} == {(ids[0], None), (ids[1], " \n"), (None, "a b"), (ids[2], "w")}
