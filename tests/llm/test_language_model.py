import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from perilens.llm import language_model as lm
from perilens.llm import registry

TABLE = "/root/testdata/sf0.001/documents.parquet"


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x20\x09-\x0d]+", low) + [None]


def fitted(counts):
    """The exponent of the counts of counts 1 to 8, by the textbook least-squares formula."""
    of = Counter(counts.values())
    xs = [math.log(r) for r in range(1, 9)]
    ys = [math.log(of.get(r, 0) + 0.5 / (r * (r + 1))) for r in range(1, 9)]
    mx, my = sum(xs) / 8, sum(ys) / 8
    b = sum((x - mx) * (y - my) for x, y in zip(xs, ys)) / sum((x - mx) ** 2 for x in xs)
    return min(-1.05, max(-4.0, b))


def brute(rows, least=1, order=2):
    """The same model with dictionaries: Good-Turing by the smoothed counts of counts, p(w|h) by recursion for each token."""
    train = [tokens(t) for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    grams = {n: Counter() for n in range(1, order + 1)}
    contexts = Counter()

    def before(ts, k, n):
        return tuple((["<s>"] * (n - 1) + [("w", x) for x in ts[max(0, k - n + 1) : k]])[-(n - 1) :]) if n > 1 else ()

    for ts in train:
        for k, w in enumerate(ts):
            for n in grams:
                grams[n][before(ts, k, n), w] += 1
                contexts[before(ts, k, n)] += 1
    b = {n: fitted(c) for n, c in grams.items()}
    total, distinct = sum(grams[1].values()), len(grams[1])

    def star(c, n):  # r* = (r + 1) n[r + 1] / n[r] on the fitted line
        return (c + 1) * ((c + 1) / c) ** b[n]

    unseen = 1 - sum(star(c, 1) for c in grams[1].values()) / total if total else 1.0
    kept = defaultdict(dict)
    for n in range(2, order + 1):
        for (h, w), c in grams[n].items():
            if c >= least:
                kept[h][w] = star(c, n) / contexts[h]

    def p(h, w):
        if not h:
            return star(grams[1][h, w], 1) / total if (h, w) in grams[1] else unseen
        return kept[h][w] if w in kept.get(h, {}) else weight(h) * p(h[1:], w)

    alpha = {}

    def weight(h):
        if h not in kept:
            return 1.0
        if h not in alpha:
            alpha[h] = (1 - sum(kept[h].values())) / (1 - sum(p(h[1:], w) for w in kept[h]))
        return alpha[h]

    words = [w for _, w in grams[1]]
    for h in [(), *list(kept)[:20], *list(kept)[-20:]]:
        # All words and, as one more, the event of an unseen word.
        chain, own = 1.0, h
        while own:
            chain, own = chain * weight(own), own[1:]
        assert math.isclose(sum(p(h, w) for w in words) + chain * unseen, 1, rel_tol=1e-9)
    out = []
    for i, t in rows:
        ts = tokens(t)
        score = sum(math.log10(p(before(ts, k, order), w)) for k, w in enumerate(ts))
        base = sum(math.log10((grams[1].get(((), w), 0) + 1) / (total + distinct + 1)) for w in ts)
        out.append((i, len(ts), sum(((), w) in grams[1] for w in ts), total, base, score))
    return out


def compare(spark, rows, order=2, least=1, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = lm.scores(docs, order=order, least=least, **options).collect()
    by = lambda r: (r[0] is None, r[0], round(r[-1], 6))
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=by)
    want = sorted(brute(rows, least, order), key=by)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    for g, w in zip(got, want):
        assert g[4:] == pytest.approx(w[4:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("order, least", [(2, 1), (3, 1), (2, 2)])
def test_equals_brute_force_on_the_documents(spark, order, least):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(TABLE).collect()]
    compare(spark, rows, order, least, chunk_bytes=100_000, part_grams=10_000)


def test_nulls_empties_and_repeats(spark):
    rows = [(1, "a b a b A"), (1, "a b a b A"), (None, None), (3, ""), (4, "a b c " * 50), (5, "x"), (9, " \t\n"), (10, "é É z")]
    compare(spark, rows)
    compare(spark, rows, order=3, chunk_bytes=100)


def test_very_long_texts_text_ids_and_other_columns(spark):
    long = " ".join(f"w{i * i % 977}" for i in range(200_000))
    rows = [("x", long, 1.0, "s"), ("y", long, 2.0, None), ("z", "w1 w4 w9", None, "t"), (None, "w1", 0.5, "u")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, score double, what string")
    got = {r.doc_id: r for r in lm.scores(docs, chunk_bytes=1 << 20).collect()}
    want = {w[0]: w for w in brute([r[:2] for r in rows])}
    assert set(got) == set(want)
    for k, w in want.items():
        assert (got[k].n_tokens, got[k].n_known, got[k].train_tokens) == w[1:4]
        assert (got[k].base_score, got[k].score) == pytest.approx(w[4:], rel=1e-9)


def test_a_table_that_gives_its_rows_in_another_order_each_time(spark):
    rows = [(i, f"a b c{i % 5} d{i % 3} " * (i % 7)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).orderBy("text")
    want = {w[0]: w[-1] for w in brute(rows)}
    assert {r.doc_id: r.score for r in lm.scores(docs, chunk_bytes=2000).collect()} == pytest.approx(want, rel=1e-9)


def test_intermediate_tables_are_dropped(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    before = set(spark.catalog.listTables())
    lm.scores(docs).collect()
    assert set(spark.catalog.listTables()) == before


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, score double")
    assert lm.scores(docs).count() == 0


def test_no_training_rows(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = lm.scores(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.score) == (True, 3, 0, 0, 0.0)


def test_query_keeps_pairs_seen_once(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(TABLE).collect()]
    want = {w[0]: w[-1] for w in brute(rows)}
    got = {r.doc_id: r.score for r in registry.op6_language_model(spark, "/root/testdata/sf0.001").collect()}
    assert len(want) == len(rows) and got == pytest.approx(want, rel=1e-9, abs=1e-9)
