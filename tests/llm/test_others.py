"""HTML extraction (3), embeddings (8), components and the pipeline."""

import html
import re
from collections import defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from perilens.llm import components, decontamination, embeddings, html_text, registry, simhash
from tests.llm.test_documents import brute_fingerprint

DIR = "/root/testdata/sf0.001"


def test_articles_equal_the_template(spark):
    pages = spark.read.parquet(f"{DIR}/pages.parquet").collect()
    got = {r.page_id: (r.text, r.n_chars) for r in registry.op3_html_text(spark, DIR).collect()}
    for p in pages:
        body = p.html[p.html.index("<article>") + 9 :].split("</article>")[0].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)[^>]*>", body)]
        want = "\n".join(b for b in blocks if b)
        assert got[p.page_id] == (want, len(want))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("just text", "just text"),
        ("<p>a", "a"),
        ("<script>x</script><!-- y", ""),
        ("<nav>menu</nav><div><p>One paragraph only &amp; no more.</div><footer>f</footer>", "One paragraph only & no more."),
        (
            '<body><div id=top-nav><a href=1>x</a></div><div class=content><h1>T</h1><p>Long enough paragraph of text, with a <a href=2>link</a> in it.</p><p>Another  one,\n longer than the first by far.</p></div>'
            '<div class="reader-comments"><p>I like this very much, thanks to the author for it all.</p></div><aside>side</aside></body>',
            "T\nLong enough paragraph of text, with a link in it.\nAnother one, longer than the first by far.",
        ),
        ("<main><article><header><h1>Title</h1></header><p>Text<br>goes on.</p><form>f</form><div class=ad>buy</div></article></main>", "Title\nText goes on."),
    ],
)
def test_main_text(page, want):
    assert html_text.main_text(page) == want


BODY = "<h1>Title</h1><p>A first paragraph of the article, long enough to count.</p><p>And a second one that goes on for a while.</p>"
ARTICLE = "Title\nA first paragraph of the article, long enough to count.\nAnd a second one that goes on for a while."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<div class='content-sidebar-wrap'><article>{BODY}</article><div class=sidebar>links</div></div>", ARTICLE),
        (f"<div id='page' class='right-sidebar'><main>{BODY}</main></div>", ARTICLE),
        (f"<div class='no-comments'><div>{BODY}</div></div>", ARTICLE),
        (f"<form action=x><nav>menu</nav><article>{BODY}</article><footer>end</footer></form>", ARTICLE),
        (f"<article><div class='search'>{BODY}</div><div class=related>more</div></article>", ARTICLE),
        (f"<article>{BODY}</article><div class=comments><article><p>{'I like it. ' * 50}</p></article></div>", ARTICLE),
        (f"<div class=side><p>One.</p></div><div class=alert><p>Two.</p></div>", "One.\nTwo."),
    ],
)
def test_names_and_forms_do_not_cover_the_article(page, want):
    assert html_text.main_text(page) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<article>{BODY}<div class='related-work'><p>What others did.</p></div><div id='search-algorithms'>How to find.</div></article>", ARTICLE + "\nWhat others did.\nHow to find."),
        (f"<article>{BODY}<div class='related-posts'><a href=1>One post</a> and <a href=2>another post</a></div></article>", ARTICLE),
        (f"<article>{BODY}<div class='related-posts'><a href=1><div>One post</div></a></div></article>", ARTICLE),
        (f"<article>{BODY}<div class='adSlot'>buy</div><div class=ad_box>buy</div><div class='cookie-notice'>We use them.</div></article>", ARTICLE),
        (f"<div><div>{BODY}</div></div><div><a href=1>Home</a> <a href=2>About</a></div>", ARTICLE),
        (f"<div><div>{BODY}</div><ul><li><a href=1>Home</a><li><a href=2>About us and all others</a></ul></div>tail &amp; end", ARTICLE),
    ],
)
def test_names_inside_an_article_need_evidence(page, want):
    assert html_text.main_text(page) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<article>{BODY}<h2 id='comments'>Comments</h2><p>On how to read them.</p><h2 id=search>Search</h2></article>", ARTICLE + "\nComments\nOn how to read them.\nSearch"),
        (f"<article>{BODY}<section id='search'><h3>Search</h3><p>How it is done.</p></section></article>", ARTICLE + "\nSearch\nHow it is done."),
        (f"<article>{BODY}<section id='comments'><p>First!</p></section><section class='search'><p>Find</p></section></article>", ARTICLE),
        (f"<article>{BODY}<p>One <button type=button>Subscribe now</button>line<label for=x>Name</label>.</p></article>", ARTICLE + "\nOne line."),
        (f"<article>{BODY}<p>Two <span class='ad'>Advert: <span>buy</span> this</span>lines.</p><p><button>open</p><p>After.</p></article>", ARTICLE + "\nTwo lines.\nAfter."),
        (f"<main>{BODY}<article class='post-reply'><p>I disagree.</p></article></main>", ARTICLE),
        (f"<main><article class='post'>{BODY}</article><article class='comment'><p>Me too.</p></article></main>", ARTICLE),
    ],
)
def test_headings_stay_and_controls_adverts_and_comments_go(page, want):
    assert html_text.main_text(page) == want


def test_densities_equal_a_plain_recursion(spark):
    """Composite densities and their sums by recursion over the same tree, and the greatest sum by trying every node."""
    import math

    def count(node):
        own = [node.chars, node.tags, node.link_chars, node.link_tags]
        return [a + sum(x) for a, *x in zip(own, *(count(c) for c in node.parts if isinstance(c, html_text.Node) and not c.apart))]

    def density(node, page):
        c, t, lc, lt = count(node)
        if not c:
            return 0.0
        base = math.log(c / max(1, c - lc) * lc + page[2] / max(1, page[0]) * c + math.e)
        return max(0.0, c / t * math.log(max(1.0, c / max(1, lc) * t / max(1, lt)) + 1e-9) / max(1.0, math.log(base) if base > math.e else 1.0))

    rng = np.random.default_rng(3)
    made = []
    for _ in range(40):
        parts = []
        for _ in range(30):
            kind = rng.choice(["<div>", "</div>", "<p>", "<a href=x>", "</a>", "<section>", "</section>", "<ul><li>", "</ul>", "<b>"])
            parts.append(kind + " ".join("w" * int(k) for k in rng.integers(1, 9, int(rng.integers(0, 20)))))
        made.append("".join(parts))
    for page in [*(r.html for r in spark.read.parquet(f"{DIR}/pages.parquet").limit(15).collect()), *made]:
        root, twin = html_text.set_apart(html_text.dom(page)), html_text.set_apart(html_text.dom(page))
        order, plain, stack, total = html_text.weigh(root), [], [twin], count(twin)
        while stack:
            node = stack.pop()
            if not node.apart:
                plain.append(node)
                stack += [c for c in reversed(node.parts) if isinstance(c, html_text.Node)]
        assert len(order) == len(plain)
        for a, b in zip(order, plain):
            assert a.density == pytest.approx(density(b, total))
            inner = [density(c, total) for c in b.parts if isinstance(c, html_text.Node) and not c.apart]
            assert a.total == pytest.approx(sum(inner) if inner else density(b, total))


def test_html_edges(spark):
    rows = [(1, "u", None, "old"), (None, None, "<p>" + "word " * 50_000, "old"), (2, "u", "<p>a</p>", "old"), (2, "u", "<p>a</p>", "old")]
    out = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted(len(r.text) for r in out) == [0, 1, 1, 249_999] and set(out[0].asDict()) == {"page_id", "url", "html", "text"}
    assert html_text.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


def brute_vectors(rows, cosine=0.98):
    usable = [(k, i, l, np.array(v, float)) for k, (i, v, l) in enumerate(rows) if i is not None and l is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, parent = defaultdict(int), {k: k for k, *_ in usable}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (a, _, la, x) in enumerate(usable):
        for b, _, lb, y in usable[:n]:
            if la == lb and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= cosine:
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    least = {}
    for k, i, *_ in usable:
        least[find(k)] = min(i, least.get(find(k), i))
    return [(i, links[k], least[find(k)] if k in parent else i) for k, (i, _, _) in enumerate(rows)]


def check_vectors(rows, out):
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in out), key=key) == sorted(brute_vectors(rows), key=key)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in out)


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 16))
    rows = []
    for i in range(400):
        v = base[i % 60] + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.3])
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 60 % 4)))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for chunk in (2048, 16):
        check_vectors(rows, embeddings.near_vectors(frame, chunk=chunk).collect())


def test_vector_recall_on_the_test_table(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{DIR}/embeddings.parquet").collect()]
    got = {r.vec_id: r.n_links for r in registry.op8_embeddings(spark, DIR).collect()}
    want = {i: n for i, n, _ in brute_vectors(rows)}
    assert all(got[i] <= n for i, n in want.items()) and sum(got.values()) >= 0.9 * sum(want.values())


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 0.0], [1.0, 0.0], [2.0, 0.0], None, [], [0.0, 0.0], [nan, 1.0], [inf, 1.0], [None, 1.0], [1.0, 0.0, 0.0], [1.0, 0.01]]
    rows = [(i, v, 1) for i, v in enumerate(vectors)] + [(50, [1.0, 0.0], None), (51, [1.0, 0.0], 2), (None, [1.0, 0.0], 1)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, rep int, cells string")
    check_vectors(rows, embeddings.near_vectors(frame).collect())
    assert embeddings.near_vectors(frame.limit(0)).count() == 0


def test_repeated_ids_are_vectors_of_their_own(spark):
    rows = [(5, [1.0, 0.0], 1), (5, [0.0, 1.0], 1), (6, [1.0, 0.01], 1), (7, [0.0, 1.0], 2), (8, [-0.0, 1.0], 2), (5, [0.0, 2.0], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(tuple(r) for r in embeddings.near_vectors(frame).collect())
    # The first and third rows link, and so do the second and the last, which share an id; 7 and 8 are one vector.
    assert got == sorted([(5, 1, 5, True), (5, 1, 5, True), (6, 1, 5, False), (7, 1, 7, True), (8, 1, 7, False), (5, 1, 5, True)])


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 102: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_stages_and_decisions(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = corpus_pipeline.run(spark, DIR).collect()
    ids = [r.doc_id for r in out]
    assert all(r.round_trip and len(r.piece_ids) > 0 for r in out)
    assert len(set(ids)) == len(ids) and 0 < len(ids) < docs.count()
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, DIR)
        assert kept.columns == docs.columns, name
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert set(texts) == set(ids)
    runs = [decontamination.shingles(decontamination.loose_words(t), 5) for t in texts.values()]
    assert not any(a and len(a & b) >= 0.9 * len(a | b) for i, a in enumerate(runs) for b in runs[:i])
    items = spark.read.parquet(f"{DIR}/benchmark.parquet").select("item_id", "text")
    for r in items.collect():
        own = decontamination.shingles(decontamination.loose_words(r.text), 5)
        assert not any(len(own & decontamination.shingles(decontamination.loose_words(t), 5)) >= 0.8 * len(own) for t in texts.values())


def test_stages_on_odd_rows(spark):
    schema = spark.read.parquet(f"{DIR}/documents.parquet").schema
    rows = [(1, "", "en", "s", 0), (2, None, None, None, None), (None, "null id", "en", "s", 7), (3, "a b c d e f g", "en", "s", 13), (4, "a b c d e f g", "en", "s", 13)]
    for frame in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in corpus_pipeline.STAGES:
            frame = stage(spark, frame, DIR)
            frame.collect()


def test_near_duplicates_keep_the_right_row_of_null_and_repeated_ids(spark):
    one, two, three, four = ("the first text of all is here now", "another text that is not alike at all", "some third thing to read and keep", "a last one that nobody else has")
    rows = [
        (1, one), (None, one), (None, two), (7, three), (7, four), (3, four.upper()), (8, two + " "), (9, "x y"), (9, "x y"), (None, "q r s"), (None, "Q r, s"), (10, None), (11, ""),
    ]
    frame = spark.createDataFrame([(i, t, "en", "s", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars int")
    out = corpus_pipeline.drop_near_duplicates(spark, frame, DIR)
    kept = sorted(r.n_chars for r in out.collect())
    # Null ids lose to id 1 and id 8; of the two rows with id 7 the copy of id 3 goes; one of each repeated row and of each text without words stays.
    assert out.columns == frame.columns
    assert [k for k in kept if k not in (7, 8, 9, 10)] == [0, 3, 5, 6, 11]
    assert len({7, 8} & set(kept)) == 1 and len({9, 10} & set(kept)) == 1 and len(kept) == 7
    assert simhash.distinct_documents(frame.limit(0)).count() == 0


def test_decontamination_decides_each_row_by_its_text(spark):
    item = spark.read.parquet(f"{DIR}/benchmark.parquet").where("length(text) > 80").first().text
    rows = [(None, item), (None, "a clean text"), (5, f"before {item} after"), (5, "clean too"), (6, None), (6, "")]
    frame = spark.createDataFrame([(i, t, "en", "s", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars int")
    assert sorted(r.n_chars for r in corpus_pipeline.drop_contaminated(spark, frame, DIR).collect()) == [1, 3, 4, 5]
    items = spark.createDataFrame([("x", item), ("y", "nothing of this kind"), (None, item)], "item_id string, text string")
    few = decontamination.uncontaminated(frame, items, block_bytes=10).collect()
    assert sorted(r.n_chars for r in few) == [1, 3, 4, 5]
    found = decontamination.contaminated(frame, items, block_bytes=10).collect()
    assert sorted((str(r.doc_id), r.item_id) for r in found) == [("5", "x"), ("None", "x")]


def test_similar_documents_find_near_copies_and_leave_others(spark):
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(3000)]
    texts, group = [], []
    for g in range(80):
        base = list(rng.choice(words, int(rng.integers(60, 400))))
        for copy in range(1 + 3 * (g % 2)):
            own = list(base)
            for _ in range(copy * len(base) // 150):
                own[int(rng.integers(len(own)))] = "new" + str(rng.integers(999))
            texts.append(" ".join(own).upper() if copy == 1 else " ".join(own))
            group.append(g)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for shard in (4096, 8):
        got = {r.doc_id: r.component_id for r in simhash.similar_documents(frame, shard_rows=shard).collect()}
        assert got == brute_groups(texts)
    assert len(set(got.values())) < len(texts) - 60


def test_similar_documents_on_odd_rows(spark):
    rows = [(1, ""), (2, None), (3, " *** "), (None, "some words that have no id at all"), (5, "long " * 20_000), (6, "Long, " * 20_000), (7, "one"), (7, "one")]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, prints string, component_id string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.similar_documents(frame).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (3, 1), (None, None), (5, 5), (6, 5), (7, 7), (7, 7)], key=str)
    assert simhash.similar_documents(frame.limit(0)).count() == 0


def brute_groups(texts, similarity=0.8):
    runs = [decontamination.shingles(decontamination.loose_words(t), 5) for t in texts]
    root = list(range(len(runs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(runs):
        for j, b in enumerate(runs[:i]):
            if len(a & b) >= similarity * len(a | b) - 1e-9:
                hi, lo = sorted((find(i), find(j)), reverse=True)
                root[hi] = lo
    return {i: find(i) for i in range(len(runs))}


def near_copies(rng, bases, change):
    """Texts and copies of them: scattered words changed, a passage changed, a passage added, by ``change`` of their words."""
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(3000)]
    for g in range(bases):
        base = list(rng.choice(words, int(rng.integers(60, 400))))
        yield base
        n = max(1, int(change(g) * len(base)))
        at = int(rng.integers(len(base) - n))
        yield [f"new{g}" if i % 50 == 7 and i // 50 < n // 5 + 1 else w for i, w in enumerate(base)]
        yield base[:at] + list(rng.choice(words, n)) + base[at + n :]
        yield base[:at] + list(rng.choice(words, n)) + base[at:]


def test_a_full_table_of_bits_changes_nothing(spark, monkeypatch):
    """Every id marked by chance, and a table that has grown to many rows: the same documents stay."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet").where("doc_id < 150")
    want = sorted(r.doc_id for r in simhash.distinct_documents(docs).collect())
    ids = spark.range(5000).withColumnRenamed("id", "k")
    table, size = simhash.marks(ids, "k")
    assert size == 1 << 17 and table.count() == 4 and simhash.marked(spark.range(20_000).withColumnRenamed("id", "k"), "k", (table, size)).where("_marked").count() < 7000
    assert simhash.marked(ids, "k", (table, size)).where("_marked").count() == 5000
    full = lambda ids, c: (spark.range(1).select(F.lit(0).alias("_row"), F.lit(b"\xff" * 4096).alias("_bits")), simhash.ROW_BITS)
    monkeypatch.setattr(simhash, "marks", full)
    assert sorted(r.doc_id for r in simhash.distinct_documents(docs).collect()) == want


def test_pairs_at_the_threshold_meet_whatever_the_number_of_rows():
    rng = np.random.default_rng(8)
    missed = 0
    for _ in range(2000):
        pool = rng.integers(0, 2**63, 220, dtype=np.int64).view(np.uint64)
        a, b = pool[:200], np.concatenate((pool[:178], pool[200:]))  # 178 of 222, Jaccard 0.8 and a little
        missed += not np.any(simhash.bands(a) == simhash.bands(b))
    assert missed == 0 and len(simhash.bands(pool)) == simhash.BANDS


def test_similar_documents_equal_brute_force_at_the_threshold(spark):
    rng = np.random.default_rng(9)
    texts = [" ".join(t) for t in near_copies(rng, 120, lambda g: 0.04 + 0.002 * g)]
    want = brute_groups(texts)
    assert 150 < len(set(want.values())) < len(texts) - 50
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for options in ({}, {"shard_rows": 2}, {"shard_rows": 2, "most_shards": 1}):
        assert {r.doc_id: r.component_id for r in simhash.similar_documents(frame, **options).collect()} == want, options


def brute_near_copies(texts):
    """Groups by links of either kind: fingerprints of operator 2 within two bits, runs of five words at 0.8."""
    prints = [brute_fingerprint(t) for t in texts]
    root = list(brute_groups([t or "" for t in texts]).values())
    for i, a in enumerate(prints):
        for j, b in enumerate(prints[:i]):
            if (a ^ b).bit_count() <= 2 and root[i] != root[j]:
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    return prints, root


def test_the_stage_drops_what_operator_2_links(spark):
    rng = np.random.default_rng(10)
    texts = [" ".join(t) for t in near_copies(rng, 60, lambda g: 0.04 + 0.004 * g)]
    texts += ["", None, " ", "***", texts[0].title(), texts[1] + " !", "one two", "one two three four", "one two three five"]
    prints, root = brute_near_copies(texts)
    by_runs = brute_groups([t or "" for t in texts])
    # Both kinds of links are needed: some copies are only within two bits, many only at 0.8.
    assert len(set(root)) < len(set(by_runs.values())) < len(set(prints)) - 20
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, frame, DIR).collect()) == sorted(set(root))
    cut = simhash.distinct_documents(frame, shard_rows=2, most_shards=1)
    assert sorted(r.doc_id for r in cut.collect()) == sorted(set(root))
    # No group of the operator itself keeps two rows, here and on the given table.
    for docs in (frame, spark.read.parquet(f"{DIR}/documents.parquet")):
        kept = corpus_pipeline.drop_near_duplicates(spark, docs, DIR).select("doc_id")
        groups = simhash.near_duplicates(docs).join(kept, "doc_id").groupBy("component_id").count()
        assert groups.where("count > 1").count() == 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql_twins(spark, name):
    from tests.oracle import connect, difference

    assert difference(registry.queries()[name](spark, DIR), connect(DIR), registry.oracle_sql()[name]) == ""
