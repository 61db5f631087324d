"""Rules of single operators on hand rows: risk index, opinion, linkage, writes, text, sources, streams."""

import duckdb
import pytest
from pyspark.sql import functions as F

from perilens.functions import scalars as S
from perilens.functions import text as T
from perilens.functions import udfs
from perilens.operators import linkage, listing, opinion, quality, riskindex, upsert
from perilens.sources import directory, payloads, sinks, statements
from perilens.streaming import jobs
from tests.oracle import difference


def one(spark, column, **values):
    kinds = {int: "long", float: "double", str: "string", bool: "boolean", type(None): "string"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("r")).first().r


@pytest.mark.parametrize(
    ("cell", "want"),
    [("1,234", 1234.0), ("(1,234)", -1234.0), ("$ 5", 5.0), ("-", None), ("—", None), ("", None), ("abc", None), ("＄1,000.5", 1000.5), (None, None), ("nan", None)],
)
def test_money(spark, cell, want):
    assert one(spark, S.money("c"), c=cell) == want
    assert one(spark, S.money_whole("c"), c=cell) == int(want or 0)


def test_small_values(spark):
    assert one(spark, S.fine("c"), c="罰鍰：50,000 元") == 50000
    assert str(one(spark, S.date_in("c"), c="on 2024/3/5.")) == "2024-03-05"
    assert one(spark, S.date_in("c"), c="2024-13-45") is None
    assert str(one(spark, S.feed_date("c"), c="Tue, 05 Mar 2024 10:00:00 GMT")) == "2024-03-05"
    assert one(spark, S.mask_email("c"), c="parent@example.org") == "p*****@example.org"
    assert one(spark, S.number("c"), c="1,200名") == 1200.0 and one(spark, S.capacity("c"), c="核定 30 人") == 30
    assert [x.state for x in one(spark, S.steps(F.col("c")), c="investigating")] == ["done", "current", "todo"]
    assert one(spark, S.directions("c"), c="high+x+ shift") == ["HIGH", "SHIFT"]
    assert one(spark, S.clamp("c"), c=140.0) == 100.0 and one(spark, S.clamp(F.lit(None).cast("double")), c=1) is None


def test_text(spark):
    assert one(spark, T.canonical_url("c"), c="HTTPS://News.Example.org/a?utm_source=x&b=1&fbclid=2#top") == "https://news.example.org/a?b=1"
    assert one(spark, T.canonical_url("c"), c="http://example.org") == "http://example.org/"
    assert one(spark, T.canonical_url("c"), c="javascript:alert(1)") is None
    assert one(spark, T.canonical_url("c", credentials=False), c="http://u:p@example.org/") is None
    assert one(spark, T.compact("c"), c="ＡＢ c　臺") == "abc台" == one(spark, udfs.compact_exact(F.col("c")), c="ＡＢ c　臺")
    assert one(spark, T.normal_name("c"), c="新北市私立ABC幼兒園") == "ABC幼兒園"
    assert one(spark, T.aliases("c"), c="新北市私立大同幼兒園") == ["新北市私立大同幼兒園", "大同幼兒園"]
    assert one(spark, T.ownership(F.lit(None).cast("string"), names=["c"]), c="社團法人某某非營利幼兒園") == "NONPROFIT"
    assert one(spark, T.ownership(F.lit("公立"), names=["c"]), c="私立") == "PUBLIC"
    assert one(spark, T.district(F.lit(""), F.col("c"), ["板橋區", "三峽區"]), c="新北市三峽區板橋區") == "三峽區"
    assert one(spark, T.content_hash("c", F.lit(0), zero_is_blank=(1,)), c="a") == one(spark, T.content_hash("c", F.lit(None).cast("string")), c="a")
    assert one(spark, T.json_in(F.col("c"), "a int")["a"], c='text {"a": 5} more') == 5 and one(spark, T.json_in(F.col("c"), "a int")["a"], c="none") is None
    assert one(spark, udfs.unescape(F.col("c")), c="&eacute;&#65;") == "éA"


def test_references_that_a_cut_left_stay(spark, tmp_path):
    from perilens.plans import text_queries

    for raw, closed in (("&eacute;&#65;&#x42;", "éAB"), ("a&amp;&amp", "a&&amp"), ("&ampx; &#65 &", "&ampx; &#65 &"), ("&amp;lt;", "&lt;"), (None, None)):
        assert one(spark, udfs.unescape(F.col("c"), closed=True), c=raw) == closed
    titles = ["x&amp;&amp; y&amp", "The &quot;Straße&quot", "&lt;A&gt", "&amp;amp;", "&"]
    spark.createDataFrame([(i, f"https://a.example/{i}", f"<h1>{t}</h1><p>p</p>") for i, t in enumerate(titles)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert difference(text_queries.l7_exact_folding(spark, str(tmp_path)), con, text_queries.ORACLE["l7_exact_folding"]) == ""


def test_similarity():
    assert udfs.ratio("abc", "abc") == 1 and udfs.ratio("abcd", "bcde") == pytest.approx(0.75) and udfs.ratio("", "") == 1
    assert udfs.partial("大同", "新北大同幼兒園") == 1 and udfs.token_set("a b c", "c b a d") == 1
    assert udfs.name_similarity("", "x") == 0


def test_missing_weights_are_shared_equally(spark):
    rows = [(1, 10.0, 1, 2, 20.0, 1, 5.0), (2, None, 0, 0, 20.0, 1, 100000.0), (3, None, 0, 0, None, 1, 100001.0), (4, 90.0, 0, 0, 90.0, 0, 0.0)]
    df = spark.createDataFrame(rows, "id int, finance_index double, open_reports int, total_reports int, opinion_raw double, penalty_count int, fine_total double")
    scores = riskindex.dimension_scores() | {"opinion": F.when(F.col("opinion_raw").isNotNull(), S.clamp(F.col("opinion_raw") * 2.5))}
    out = {r.id: r for r in riskindex.scored(df, scores).collect()}
    for r in out.values():
        assert sum(r[f"{k}_weight"] for k in riskindex.WEIGHTS) == pytest.approx(3.0, abs=1e-3)
    assert (out[3].parent_report_weight, out[3].compliance_weight) == (1.625, 1.375)
    assert out[2].compliance_score == 50.0 and out[3].compliance_score == 100.0 and out[4].finance_score == 100.0


def test_opinion_score_counts_problems_not_reports(spark):
    item = ("s1", "confirmed", ["行政裁罰"], None, True)
    rows = [item] * 10 + [("s1", "unrelated", ["超收"], 1.0, False), ("s1", "confirmed", ["made up"], 1.0, True), ("s2", "ambiguous", ["超收"], 1.0, True)]
    df = spark.createDataFrame(rows, "scan_id string, attribution string, tags array<string>, negative_score double, verified boolean")
    assert {r.scan_id: r.opinion_score for r in opinion.scores(df, df).collect()} == {"s1": 20.0, "s2": 0.0}
    every = spark.createDataFrame([("s", "confirmed", list(opinion.RULES), 1.0, True)], df.schema)
    assert opinion.scores(every, every).first().opinion_score == 100.0


def test_greedy_dedup_is_order_dependent(spark):
    rows = [("s", 1, "u1", "t1"), ("s", 2, "u2", "t1"), ("s", 3, "u2", "t3"), ("s", 4, "u1", "t9"), ("z", 5, "u1", "t1")]
    df = spark.createDataFrame(rows, "scan_id string, seq long, url_hash string, title_hash string").withColumn("on_topic", F.lit(True))
    assert sorted(r.seq for r in opinion.deduplicated(df).collect()) == [1, 3, 5]


def test_greedy_dedup_equals_a_loop(spark):
    import random

    rng = random.Random(3)
    rows = [(f"s{i % 5}", i, f"u{rng.randint(0, 12)}", f"t{rng.randint(0, 12)}", rng.random() < 0.8) for i in range(400)]
    seen, want = {}, []
    for scan, seq, u, t, topic in rows:
        urls, titles = seen.setdefault(scan, (set(), set()))
        if u in urls or not topic or t in titles:
            continue
        urls.add(u)
        titles.add(t)
        want.append(seq)
    df = spark.createDataFrame(rows, "scan_id string, seq long, url_hash string, title_hash string, on_topic boolean").repartition(7)
    assert sorted(r.seq for r in opinion.deduplicated(df).collect()) == want


def test_match_status_ladder(spark):
    def status(score, inside):
        return one(spark, linkage.match_status(F.lit(score), F.lit("板橋區"), F.col("c")), c="板橋區某路" if inside else "別處")

    assert [status(0.9, True), status(0.88, False), status(0.5, False), status(0.72, True), status(0.71, True), status(0.4, False)] == [
        "AUTO_ACCEPT", "DISTRICT_MISMATCH", "DISTRICT_MISMATCH", "MANUAL_REVIEW", "REJECTED", "REJECTED",
    ]


def test_writes_are_idempotent(spark):
    old = spark.createDataFrame([("h1", 1, 1), ("h2", 2, 2)], "h string, first int, last int")
    new = spark.createDataFrame([("h2", 5, 5), ("h3", 6, 6), ("h3", 7, 7)], old.schema)
    once = upsert.touch(old, new, "h", "first", "last")
    assert sorted(map(tuple, once.collect())) == [("h1", 1, 1), ("h2", 2, 5), ("h3", 6, 7)]
    assert sorted(map(tuple, upsert.touch(once, new, "h", "first", "last").collect())) == sorted(map(tuple, once.collect()))
    named = spark.createDataFrame([("n1", "p", "h1", 1, 1)], "name string, place string, h string, first int, last int")
    seen = spark.createDataFrame([("n1", "p", "changed", 9, 9), (None, "p", "h1", 10, 10), ("n2", "p", "h9", 3, 3)], named.schema)
    rows = {r.h: (r.first, r.last) for r in upsert.match_then_touch(named, seen, ["name", "place", "h"], "h", "first", "last").collect()}
    assert rows["h1"][0] == 1 and rows["h1"][1] in (9, 10) and rows["h9"] == (3, 3)


def test_insert_ignore(spark):
    table = spark.createDataFrame([(1, "u1", "t1")], "seq int, u string, t string")
    new = spark.createDataFrame([(2, "u1", "t2"), (3, "u2", "t1"), (4, "u3", "t3"), (5, "u3", "t4"), (6, "u4", "t5")], table.schema)
    assert sorted(r.seq for r in upsert.insert_ignore(table, new, ["u", "t"], "seq").collect()) == [4, 6]
    # A row that clashes with the table on its second key blocks nobody on its first one.
    table = spark.createDataFrame([(0, "z", "t0")], table.schema)
    new = spark.createDataFrame([(1, "x", "t0"), (2, "x", "t9"), (3, None, "t9"), (4, None, None), (5, None, None), (2, "x", "t9")], table.schema)
    kept = upsert.insert_ignore(table, new, ["u", "t"], "seq")
    assert sorted(r.seq for r in kept.collect()) == [2, 4, 5]
    tags = spark.createDataFrame([(2, "a"), (2, "a"), (3, "b")], "seq int, tag string")
    assert [(r.seq, r.tag) for r in upsert.with_parent(tags, kept, "seq", "tag").collect()] == [(2, "a")]
    assert upsert.insert_ignore(table, new.limit(0), ["u", "t"], "seq").count() == 0


def test_insert_ignore_equals_a_loop(spark):
    import random

    rng = random.Random(8)
    rows = [(i, f"u{rng.randint(0, 60)}" if rng.random() < 0.9 else None, f"t{rng.randint(0, 60)}" if rng.random() < 0.9 else None) for i in range(500)]
    old, new = rows[:40], rows[40:]
    urls, titles, want = {u for _, u, _ in old if u}, {t for _, _, t in old if t}, []
    for i, u, t in new:
        if u not in urls and t not in titles:
            urls |= {u} - {None}
            titles |= {t} - {None}
            want.append(i)
    schema = "seq int, u string, t string"
    got = upsert.insert_ignore(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema).repartition(5), ["u", "t"], "seq")
    assert sorted(r.seq for r in got.collect()) == want


def test_paging_parameters():
    assert listing.page_bounds("3", "50") == (100, 50) and listing.page_bounds("x", None) == (0, 20) and listing.page_bounds(0, 1000) == (0, 100)
    assert listing.parse_day("2024-02-30") is None


def test_record_validity(spark):
    def reason(kind, city, address):
        return one(spark, quality.valid_record(F.col("k"), F.lit(city), F.col("a")), k=kind, a=address)

    assert [reason("PUBLIC", True, "x"), reason("PRIVATE", True, "x"), reason("PUBLIC", False, "x"), reason("PUBLIC", True, " ")] == [None, "not_public:private", "other_city", "missing_address"]


def test_statement_files(spark, tmp_path):
    root = tmp_path / "in" / "113學年度" / "甲"
    root.mkdir(parents=True)
    files = {
        "N01甲園_113學年度收支餘絀表.csv": "科目,金額\n收入合計,\"1,000\"\n,5\n支出合計,(200)\n",
        "N01甲園_資產負債表.csv": "科目,金額,年度類別\n資產總計,50,本年度\n資產總計,40,前一年度\n現金,7,\n",
        "N01甲園_現金流量表.csv": "項目,113學年度金額,112學年度金額\n期末現金淨增加,3,2\n",
        "N01甲園_附表二_預決算.csv": "項目,預算數,決算數,差異率\n人事費,10,12,20\n",
        "N01甲園_附表三_執行.csv": "項目,113學年度決算數,113學年度執行率,112學年度決算數\n材料費,8,110,7\n",
        "N01甲園_附表四_財產.csv": "財產名稱,帳面價值\n桌,100\n椅,abc\n",
        "N01甲園_資產負債表_驗證.csv": "科目,金額,年度類別\n不算,1,\n",
    }
    for name, text in files.items():
        (root / name).write_text(text, encoding="utf-8")
    rows = {(r.table, r.metric): r.value for r in statements.long_table(spark, str(tmp_path / "in")).where("code = 'N01' and year = 113").collect()}
    assert rows == {
        ("收支餘絀表", "收入合計"): 1000.0, ("收支餘絀表", "支出合計"): -200.0, ("資產負債表", "資產總計"): 50.0, ("資產負債表", "現金"): 7.0, ("現金流量表", "期末現金淨增加"): 3.0,
        ("附表二", "人事費-actual"): 12.0, ("附表二", "人事費-rate"): 20.0, ("附表三", "材料費-actual"): 8.0, ("附表三", "材料費-rate"): 110.0, ("附表四", "rows"): 2.0, ("附表四", "book_value"): 100.0,
    }
    sinks.to_csv(statements.long_table(spark, str(tmp_path / "in")), str(tmp_path / "long"), statements.LONG)
    assert statements.read_long(spark, str(tmp_path / "long")).where("value is not null").count() == 11


def test_statement_files_are_read_by_their_own_headers(spark, tmp_path):
    root = tmp_path / "in" / "113學年度" / "甲"
    root.mkdir(parents=True)
    end = "_113學年度收支餘絀表.csv"
    files = {
        f"N01a{end}": "科目,金額\n學費收入,100\n".encode(), f"N02b{end}": "金額,科目\n200,學費收入\n".encode(), f"N03c{end}": "頁碼,科目,金額\n3,學費收入,300\n4,short\n\n".encode(),
        f"N04d{end}": "\ufeff科目,金額\n\u3000學費收入 ,400\n".encode(), f"N05e{end}": "金額\n500\n".encode(), f"N06+%41f{end}": b"\xe7\xa7\x91\xe7\x9b\xae,x\nn,1\n",
        f"N12b{end}": "科目,金額\na,1\n學費收入,1,2\n".encode(), f"N13c{end}": '科目,金額\n學費收入,"1'.encode(), f"N14d{end}": "科目,金額\n學費".encode("big5"), f"x{end}": "科目,金額\na,1\n".encode(),
        "N07g_附表四_1.csv": "帳面價值\n".encode(), "N08h_附表四_1.csv": "名\nx\ny\n".encode(), "N09i_現金流量表.csv": "項目,金額\na,1\n".encode(), "N10j_附表三_1.csv": "項目,112學年度執行率,111學年度執行率\na,5,6\n,7,8\n".encode(),
    }
    for name, content in files.items():
        (root / name).write_bytes(content)
    rows = statements.read_files(spark, str(tmp_path / "in"))
    got = {(r.code, r.name, r.metric, r.value) for r in statements.long_rows(rows).collect()}
    assert got == {
        *((f"N0{i}", x, "學費收入", 100.0 * i) for i, x in enumerate("abcd", 1)), ("N03", "c", "short", None), ("N06", "+%41f", "n", None),
        ("N07", "g", "rows", 0.0), ("N07", "g", "book_value", 0.0), ("N08", "h", "rows", 2.0), ("N08", "h", "book_value", 0.0), ("N10", "j", "a-rate", 5.0),
    }
    assert {r.path.split("/")[-1][:4] for r in statements.bad_files(rows).collect()} == {"N12b", "N13c", "N14d"}
    assert statements.long_table(spark, str(tmp_path / "in")).count() == len(got)


def test_regular_files_are_read_as_pandas_reads_them():
    import io
    import random

    import pandas as pd

    rng = random.Random(5)
    cells = ["", "a", "1,000", '"q"', " x ", "NA", "null", "-", "é\u3000", "l1\nl2", "\t"]
    for trial in range(400):
        names = rng.sample(["科目", "金額", "a b", "c,d", "e"], rng.randint(1, 4))
        quoted = lambda c: '"' + c.replace('"', '""') + '"' if any(x in c for x in ',"\n') or rng.random() < 0.1 else c
        lines = [names] + [[rng.choice(cells) for _ in range(rng.choice([len(names), len(names), max(1, len(names) - 1)]))] for _ in range(rng.randint(0, 5))]
        text = rng.choice(["\n", "\r\n"]).join(",".join(map(quoted, r)) for r in lines) + rng.choice(["", "\n", "\n\n \n"])
        content = (b"\xef\xbb\xbf" if trial % 3 == 0 else b"") + text.encode()
        want = pd.read_csv(io.BytesIO(content), dtype=str).fillna("")
        assert statements._read(content) == (list(want.columns), want.to_numpy().tolist()), content


def test_directory_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("學校名稱,地址\n甲幼兒園,新北市\n ,x\n".encode("big5"))
    rows = directory.read_csv(spark, str(tmp_path / "a.csv"), {"name": ["名稱", "學校名稱"], "address": ["地址"], "phone": ["電話"]}).collect()
    assert [tuple(r) for r in rows] == [("甲幼兒園", "新北市", None), (None, "x", None)]
    (tmp_path / "j").mkdir()
    for i, text in enumerate(['[{"name": "a"}]', '{"data": [{"name": "b"}, {"name": "c"}]}', '{"records": [{"name": "d"}]}']):
        (tmp_path / "j" / f"{i}.json").write_text(text)
    assert sorted(r.name for r in directory.read_json(spark, str(tmp_path / "j"), "name string").collect()) == ["a", "b", "c", "d"]


def test_payloads(spark):
    body = (
        '<a href="/l?uddg=https%3A%2F%2Fa.org%2Fx&amp;r=1">First</a><td class="result-snippet">one</td><a href="/l?uddg=https%3A%2F%2Fa.org%2Fx">Again</a>'
        '<a href="/l?uddg=ftp%3A%2F%2Fb.org">No</a><a href="/l?uddg=http%3A%2F%2Fc.org">Third</a><td class="result-snippet">two</td>'
    )
    rows = payloads.search_results(spark.createDataFrame([(1, body)], "k int, b string"), "k", "b").orderBy("pos").collect()
    assert [(r.url, r.title, r.snippet) for r in rows] == [("https://a.org/x", "First", "one"), ("http://c.org", "Third", "two")]
    feed = "<rss><item><title>News - Paper</title><link>http://n.org/1</link><pubDate>Tue, 05 Mar 2024 10:00:00 GMT</pubDate><description><![CDATA[<b>Hi</b> there]]></description></item></rss>"
    r = payloads.feed_items(spark.createDataFrame([(1, feed)], "k int, b string"), "k", "b").first()
    assert (r.title, r.url, str(r.published_at), r.snippet) == ("News", "http://n.org/1", "2024-03-05", "Hi there")
    cells = "".join(f"<td>{i}</td>" for i in range(7))
    grid = f"<table><tr><th>h</th></tr><tr>{cells}</tr><tr><td>short</td></tr><tr>{'<td> </td>' * 7}</tr></table>"
    assert [r.cells for r in payloads.grid_rows(spark.createDataFrame([(1, grid)], "k int, b string"), "k", "b").collect()] == [[str(i) for i in range(7)]]
    page = '<a href="/x.json">data</a><a href="/y">CSV file</a><a href="/z">other</a><meta property="og:title" content="T">'
    df = spark.createDataFrame([(1, page)], "k int, b string")
    assert sorted(r.link for r in payloads.resource_links(df, "k", "b").collect()) == ["/x.json", "/y"] and df.select(payloads.meta("b", "og:title")).first()[0] == "T"
    news = spark.createDataFrame([("幼兒園公告", "http://f", 1), ("其他", None, 2), ("教保消息", " ", 3)], "Subject string, Attachment string, No int")
    assert sorted((r.no, r.url[:10]) for r in payloads.announcements(news, "subject", opinion.TOPIC_WORDS, "http://base").collect()) == [(1, "http://f"), (3, "http://bas")]


def test_failing_sources_and_exports_do_not_stop_others(spark, tmp_path):
    def good(spark, _):
        return spark.createDataFrame([("t",)], "title string")

    def bad(spark, _):
        raise OSError("down")

    items, status = opinion.collect(spark, {"a": good, "b": bad}, {}, "title string")
    assert items.count() == 1 and status == {"a": "ok", "b": "failed: OSError"}
    assert sinks.export_all({"x": lambda: None, "y": lambda: 1 / 0}) == {"x": "ok", "y": "failed: ZeroDivisionError"}
    df = spark.range(10)
    row = sinks.logged(spark, "job", df, {"odd": F.col("id") % 2 == 1}, lambda d: d.write.parquet(str(tmp_path / "out")), str(tmp_path / "log"))
    assert row["total"] == 10 and row["counts"] == {"odd": 5} and spark.read.parquet(str(tmp_path / "log")).first().status == "success"
    with pytest.raises(ZeroDivisionError):
        sinks.logged(spark, "job", df, {}, lambda d: 1 / 0, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).where("status = 'failed'").count() == 1


def test_partitioned_sinks(spark, tmp_path):
    df = spark.range(10).selectExpr("id", "id % 2 as part", "'x' as raw_json")
    sinks.by_partition(df, str(tmp_path / "p"), "part")
    assert spark.read.json(str(tmp_path / "p")).where("part = 1").count() == 5
    sinks.replace_slices(df, str(tmp_path / "s"), "part")
    sinks.replace_slices(df.where("id = 1"), str(tmp_path / "s"), "part")
    assert spark.read.parquet(str(tmp_path / "s")).count() == 6
    sinks.to_jsonl(df, str(tmp_path / "l"))
    assert "raw_json" not in spark.read.json(str(tmp_path / "l")).columns
    sinks.archive(df, str(tmp_path / "a"), "part")
    sinks.archive(df, str(tmp_path / "a"), "part")
    assert spark.read.json(str(tmp_path / "a")).count() == 20


def test_review_stream_never_duplicates(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "reviews")
    schema = "content_hash string, first_seen_at int, last_seen_at int"
    for k, rows in enumerate([[("h1", 1, 1), ("h2", 1, 1)], [("h2", 5, 5), ("h3", 5, 5)], [("h2", 9, 9)]]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        jobs.keep_reviews(stream, table, str(tmp_path / "ck")).awaitTermination(120)
    rows, _ = jobs._snapshots(spark, table)
    assert sorted(map(tuple, rows.collect())) == [("h1", 1, 1), ("h2", 1, 9), ("h3", 5, 5)]


def test_refresh_and_state_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, 1, "queued"), (1, 2, "done"), (2, 1, "queued")], "id int, at int, status string").write.parquet(source)
    stream = spark.readStream.schema("id int, at int, status string").parquet(source)
    jobs.refresh_scores(stream, "id", lambda ids: ids.withColumn("score", F.col("id") * 10), str(tmp_path / "scores"), str(tmp_path / "ck")).awaitTermination(120)
    assert {(r.id, r.score) for r in spark.read.parquet(str(tmp_path / "scores")).collect()} == {(1, 10), (2, 20)}
    query = jobs.states(stream, "id", "at", "status").writeStream.format("memory").queryName("states").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert {(r.id, r.status, r.entries) for r in spark.table("states").collect()} == {(1, "done", 2), (2, "queued", 1)}


def test_cooldown_state(spark):
    import datetime

    import pandas as pd

    class Value:
        def __init__(self):
            self.kept = None

        def exists(self):
            return self.kept is not None

        def get(self):
            return self.kept

        def update(self, x):
            self.kept = x

    at = lambda s: pd.Timestamp(datetime.datetime(2024, 1, 1)) + pd.Timedelta(seconds=s)
    p = jobs.Cooldown("k")
    p.last = Value()
    rows = pd.DataFrame({"id": [1, 2, 3], "at": [at(0), at(300), at(700)], "status": ["done", "queued", "queued"]})
    first = next(p.handleInputRows((7,), iter([rows]), None))
    second = next(p.handleInputRows((7,), iter([rows.assign(id=[4, 5, 6], at=[at(500), at(900), at(2000)], status="queued")]), None))
    assert list(first.decision) == ["start", "cooldown", "start"] and list(second.decision) == ["cooldown", "start", "start"]


def test_cooldown_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "id long, institution_id long, at timestamp, status string"
    spark.sql(
        "select * from values (1L, 7L, timestamp'2024-01-01 00:00:00', 'done'), (2L, 7L, timestamp'2024-01-01 00:05:00', 'queued'), (3L, 8L, timestamp'2024-01-01 00:05:00', 'queued') as t(id, institution_id, at, status)"
    ).write.parquet(source)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = jobs.cooldown(spark.readStream.schema(schema).parquet(source), "institution_id")
        query = out.writeStream.format("memory").queryName("decisions").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(180)
        assert {(r.id, r.decision) for r in spark.table("decisions").collect()} == {(1, "start"), (2, "cooldown"), (3, "start")}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_long_catalogue_is_whole(spark):
    from perilens.operators.linkage import catalogue_filled

    entities, catalogue = spark.range(2), spark.range(1500).withColumnRenamed("id", "item")
    stored = spark.createDataFrame([(1, 1400, "RED", 7)], "id long, item long, level string, score int")
    rows = catalogue_filled(entities, catalogue, stored, ["id"], "item", "level", "score").collect()
    assert len(rows) == 3000 and [(r.id, r.item, r.score) for r in rows if r.level == "RED"] == [(1, 1400, 7)]
    assert all((r.level, r.score) == ("N/A", 0) for r in rows if r.level != "RED")


def test_mentions_both_ways_equal_a_loop(spark):
    import random

    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abc é") for _ in range(n))
    texts = [(i, word(rng.randint(0, 300))) for i in range(60)] + [(90, None), (91, ""), (92, "abca" * 20_000)]
    entities = [(k, sorted({w for w in ("".join(word(6).split()) for _ in range(3)) if len(w) >= 4})) for k in range(40)]
    t, e = spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(entities, "entity int, aliases array<string>")
    want = {(i, k) for i, x in texts for k, own in entities if x and any(a in "".join(x.split()) for a in own)}
    for scan_bytes in (1 << 20, -1):
        got = opinion.mentions(t, e, "id", "text", "entity", scan_bytes=scan_bytes)
        assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_many_similarities_equal_one_by_one():
    import random

    from perilens.functions import udfs

    rng = random.Random(6)
    word = lambda most: " ".join("".join(rng.choice("abcé園") for _ in range(rng.randint(0, 7))) for _ in range(rng.randint(0, most))).strip()
    pairs = [(word(4), word(4)) for _ in range(1500)] + [("", ""), ("a", ""), ("", "b"), ("x" * 70, "x" * 69 + "y"), ("ab" * 50, "ab"), ("a b", "b a"), ("\U0001f600a", "a\U0001f600")]
    assert udfs.ratios(pairs) == [udfs.ratio(*p) for p in pairs]
    assert udfs.partials(pairs) == [udfs.partial(*p) for p in pairs]
    assert udfs.name_similarities(pairs) == [udfs.name_similarity(*p) for p in pairs]


def test_place_matching_equals_a_loop(spark):
    """M8 over whole tables: every pair of a nation scored one by one."""
    from decimal import ROUND_HALF_UP, Decimal

    from perilens.functions import udfs
    from perilens.plans import record_queries as R

    d = "/root/testdata/sf0.001"
    pairs = R._pairs(spark, d).withColumns({"a": R.K.normal_name("name", R.K.NAME_RULES["matcher"]), "b": R.K.normal_name("place_name", R.K.NAME_RULES["matcher"]), "x": R.K.normal_address("address"), "y": R.K.normal_address("place_address")})
    best = {}
    for r in pairs.collect():
        at = 0.5 if not r.x and not r.y else 0.0 if not r.x or not r.y else min(1.0, udfs.partial(r.x, r.y) * (1.0 if r.district in r.place_address else 0.3))
        name = udfs.name_similarity(r.a, r.b)
        score = float(Decimal(repr(name * 0.5 + at * 0.35 + 0.5 * 0.15)).quantize(Decimal("0.0001"), ROUND_HALF_UP))
        if score >= 0.72:
            best[r.id] = max(best.get(r.id, (0, 0, 0)), (score, name, -r.place_id))
    got = {r.id: (r.match_score, r.place_id) for r in R.m8_place_matching(spark, d).collect()}
    manual = {i for i in got if i % 50 == 0}
    assert {i: v for i, v in got.items() if i not in manual} == {i: (s, -p) for i, (s, _, p) in best.items() if i not in manual}


def test_quotes_without_end_are_errors_to_pandas_too(monkeypatch):
    import io
    import random

    import pandas as pd

    rng, ended = random.Random(3), 0
    for _ in range(20_000):
        content = "".join(rng.choice(['"', '"', ",", "\n", "\r", " ", "\t", "a", "é", '"\n', "x,y\n"]) for _ in range(rng.randint(1, 12))).encode()
        try:
            statements._read(content)
        except ValueError as problem:
            if "quote without end" in str(problem):
                ended += 1
                with pytest.raises(ValueError):
                    pd.read_csv(io.BytesIO(content), dtype=str)
    assert ended > 200
    monkeypatch.setattr(pd, "read_csv", lambda *a, **b: pytest.fail("pandas was asked"))
    with pytest.raises(ValueError):
        statements._read('科目,金額\nm,1\n"cut'.encode())


def test_statement_files_are_parsed_once(spark):
    """A3: each file is read in one pass, appendix 4 included; files without lines, without the column, with many lines."""
    from perilens.plans import source_queries

    plan = source_queries.a3_statement_files(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Aggregate") == 1
    bodies = {1: "帳面價值,財產名稱", 2: "財產名稱\nx\ny", 3: '財產名稱,帳面價值\na,"1,000"\nb,(3)\nc,abc\nd', 4: "帳面價值\n" + "2\n" * 25_000, 5: '帳面價值\n1\n"cut', 6: ""}
    rows = [(f"in/113學年度/N{k}甲_附表四_1.csv", "appendix4", text.encode()) for k, text in bodies.items()] + [("in/113學年度/none.csv", "income", "科目,金額\na,1".encode())]
    files = spark.createDataFrame(rows, "path string, kind string, content binary")
    got = {(r.code, r.metric): r.value for r in statements.long_rows(statements.parsed(statements.keyed(files))).collect()}
    assert got == {("N1", "rows"): 0.0, ("N1", "book_value"): 0.0, ("N2", "rows"): 2.0, ("N2", "book_value"): 0.0, ("N3", "rows"): 4.0, ("N3", "book_value"): 997.0, ("N4", "rows"): 25_000.0, ("N4", "book_value"): 50_000.0}
    assert got == {(r.code, r.metric): r.value for r in statements.long_rows(statements.parsed(files)).collect()}
    held = statements.parsed(files.withColumn("more", F.length("content")))
    assert held.count() == 1 + 3 + 5 + 25_001 + 1 + 1 + 2 and {r.path[10:12] for r in statements.bad_files(held).collect()} == {"N5", "N6"}


def test_best_simple_matches_equal_all_pairs(spark):
    """Names, addresses, districts and places that repeat, are empty or missing; and no row for each pair."""
    import random

    rng = random.Random(5)
    text = lambda chars, most: rng.choice([None, *["".join(rng.choice(chars) for _ in range(rng.randint(0, most))) for _ in range(9)]])
    at = lambda: rng.choice([None, "", "north", "north 1", "north 12", "south 1", "1"])
    left = spark.createDataFrame([(rng.choice([1, 2, None]), i % 70, text("abcd", 5), at(), rng.choice([None, "", "north", "south"])) for i in range(90)], "block int, id int, name string, address string, district string")
    right = spark.createDataFrame([(rng.choice([1, 2, None]), rng.choice([None, *range(40)]), text("abcde", 5), at()) for i in range(300)], "block int, place_id int, place_name string, place_address string")
    names = ["id", "place_id", "match_score", "name_score", "address_score", "geo_score", "match_status"]
    for least in (0.0, 0.5):
        want = linkage.best_match(linkage.scored_pairs_simple(left.join(right, "block")), "id", "place_id", least).select(*names)
        got = linkage.best_matches_simple(left, right, ["block"], "id", "place_id", least).select(*names)
        same = lambda rows: sorted(tuple(r)[:4] for r in rows)  # noqa: E731  # of places with all alike, any one's other scores
        assert same(got.collect()) == same(want.collect())


def test_simple_matching_has_no_row_for_each_pair(spark, tmp_path, monkeypatch):
    from perilens.plans import record_queries as R

    met, plain = [], linkage.scored_pairs_simple
    monkeypatch.setattr(linkage, "scored_pairs_simple", lambda pairs, *a: (met.append(pairs.count()), plain(pairs, *a))[1])
    spark.createDataFrame([(1, "north")], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    spark.range(300).selectExpr("id as s_suppkey", "concat('Supplier', id) as s_name", "1 as s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(900).selectExpr("id as c_custkey", "concat('Customer', id) as c_name", "1 as c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    for t in ("nation", "supplier", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    assert difference(R.d13_simple_matching(spark, str(tmp_path)), con, R.ORACLE["d13_simple_matching"]) == ""
    assert max(met) < 300 * 900 / 20


def test_bounds_of_texts_hold():
    import random

    import numpy as np

    rng = random.Random(8)
    word = lambda chars: "".join(rng.choice(chars) for _ in range(rng.randint(0, 9)))
    for words, chars in ((True, "abc"), (True, "ab é園"), (False, "ab 1")):
        held = [word(chars) for _ in range(150)] + ["", "x" * 70, "a" * 5]
        texts, score = udfs.Texts(held, words), udfs.name_similarity if words else udfs.partial
        assert [texts.texts[i] for i in texts.of] == held
        for t in [word(chars) for _ in range(25)] + ["y" * 70, "abcab"]:
            most, first = texts.most(t)
            want = [score(t, u) if t and u else 0.0 for u in texts.texts]
            assert all(m >= v - 1e-12 for m, v in zip(most, want)) and (not t or texts.exact(t, np.arange(len(want)), first).tolist()[1:] == want[1:])


def test_best_place_matches_equal_all_pairs(spark):
    """M8: names of several words, repeated and missing ones, coordinates; in one tile of a block and in many."""
    import random

    rng = random.Random(12)
    name = lambda: rng.choice([None, "", *["".join(rng.choice("大同幼園ab\u2003") for _ in range(rng.randint(1, 7))) for _ in range(9)]])
    at = lambda: rng.choice([None, "", "north road 1", "north road 12", "south 1", "elsewhere", "n"])
    place = lambda: rng.choice([(None, 121.0), (25.0, 121.0), (25.004, 121.0), (25.03, 121.01), (float("nan"), 121.0)])
    left = spark.createDataFrame([(rng.choice([1, 2, None]), i % 60, name(), at(), rng.choice([None, "", "north", "south"]), *place()) for i in range(70)], "block int, id int, name string, address string, district string, lat double, lng double")
    right = spark.createDataFrame([(rng.choice([1, 2, None]), i, name(), at(), *place()) for i in range(200)], "block int, place_id int, place_name string, place_address string, place_lat double, place_lng double")
    names = ["id", "place_id", "match_score", "name_score", "address_score", "geo_score", "match_status"]
    scored = linkage.scored_pairs(left.join(right, "block")).localCheckpoint()
    for least, sizes in ((0.72, {}), (0.4, dict(left_rows=9, right_rows=20))):
        want = linkage.best_match(scored, "id", "place_id", least).select(*names)
        got = linkage.best_place_matches(left, right, ["block"], "id", "place_id", least, **sizes).select(*names)
        keys = lambda df: sorted((r.id, r.match_score, r.name_score, r.place_id, r.match_status) for r in df.collect())
        assert keys(got) == keys(want) and len(keys(want)) >= 20


def test_place_matching_has_no_row_for_each_pair(spark, monkeypatch):
    from perilens.plans import record_queries as R

    met, plain = [], linkage._with_status
    monkeypatch.setattr(linkage, "_with_status", lambda pairs: (met.append(pairs.count()), plain(pairs))[1])
    left = spark.range(200).selectExpr("1 as nation", "id", "concat('Supplier#', id) as name", "'north' as district", "concat('north road ', id % 9) as address")
    right = spark.range(600).selectExpr("1 as nation", "id as place_id", "concat('Customer#', id) as place_name", "concat('north road ', id % 9) as place_address")
    monkeypatch.setattr(R, "_both", lambda *a: (left, right))
    assert R.m8_place_matching(spark, "/root/testdata/sf0.001").count() > 100 and met and max(met) < 200 * 600 / 20


def test_gate_twin_equals_a_loop(spark):
    import datetime
    import random

    rng, day = random.Random(1), datetime.datetime(2024, 1, 1)
    rows = [(i, i % 3, day + datetime.timedelta(seconds=rng.randint(0, 4000)), rng.choice(["done", "queued"])) for i in range(200)]
    want, last = {}, {}
    for i, k, at, status in sorted(rows, key=lambda r: (r[2], r[0])):
        want[i] = "cooldown" if k in last and (at - last[k]).total_seconds() < 300 else "start"
        if status == "done":
            last[k] = at
    got = jobs.gated(spark.createDataFrame(rows, "id int, key int, at timestamp, status string"), "key", 300)
    assert {r.id: r.decision for r in got.collect()} == want


def greedy(rows, keys):
    taken, out = set(), []
    for r in rows:
        own = [(k, tuple(r[c] for c in key)) for k, key in enumerate(keys) if all(r[c] is not None for c in key)]
        if not any(x in taken for x in own):
            out.append(r)
            taken.update(own)
    return out


def test_a_long_chain_of_clashes_is_settled_at_once(spark, monkeypatch):
    from perilens.operators import rounds

    made, plain = [], rounds.written
    monkeypatch.setattr(rounds, "written", lambda df: made.append(1) or plain(df))
    chain = [(i, f"a{i // 2}", f"b{(i + 1) // 2}") for i in range(10_000)]
    df = spark.createDataFrame(chain, "at int, x string, y string")
    got = sorted(map(tuple, rounds.first_come(df, [["x"], ["y"]], "at").collect()))
    assert got == greedy(chain, [[1], [2]]) and len(made) < 20


def test_classes_settle_what_rounds_leave(spark):
    import random

    from perilens.operators import rounds

    rng = random.Random(9)
    chains = [(c * 1000 + i, f"{c}a{i // 2}", f"{c}b{(i + 1) // 2}") for c in range(6) for i in range(25)]
    rows = sorted([*chains, *[(10_000 + i, rng.choice("pqrs"), rng.choice([None, "t", "u"])) for i in range(40)], (99_999, None, None)])
    df = spark.createDataFrame(rows, "at int, x string, y string")
    got = sorted(map(tuple, rounds.first_come(df, [["x"], ["y"]], "at", pass_rows=30, rounds=1).collect()), key=str)
    assert got == sorted(greedy(rows, [[1], [2]]), key=str)


def test_exports_are_whole_or_absent(spark, tmp_path):
    df = spark.range(40).selectExpr("id", "concat('d', id % 8) as district", "if(id % 8 = 3, 0, 1) as part")
    bad = df.withColumn("x", F.expr("if(district = 'd3' and id > 20, cast(raise_error('no') as int), 1)"))
    path = str(tmp_path / "out")
    assert sinks.export_slices(df, path, "district") == {f"d{i}": "ok" for i in range(8)}
    status = sinks.export_slices(bad.where("district <> 'd5'").withColumn("id", F.col("id") + 100), path, "district")
    assert {k for k, v in status.items() if v != "ok"} == {"d3"} and len(status) == 7
    held = spark.read.json(path)
    assert {(r.district, r.low, r["count"]) for r in held.groupBy("district").agg(F.min("id").alias("low"), F.count("*").alias("count")).collect()} == {(f"d{i}", i + (0 if i in (3, 5) else 100), 5) for i in range(8)}
    assert not [x for x in (tmp_path / "out").iterdir() if "staging" in x.name]
    for _ in range(2):
        sinks.archive(df, str(tmp_path / "a"), "part", run="r1")
    assert spark.read.json(str(tmp_path / "a")).count() == 40


def test_a_scope_of_many_ids(spark):
    from perilens.operators import upsert

    chosen = spark.range(0, 3_000_000, 3).union(spark.range(-5, 0))
    scope = upsert.scope_snapshot(chosen, "id", {"a": "b"})
    assert scope.agg(F.max(F.length("bits"))).first()[0] == 4096 and scope.first().filters == {"a": "b"}
    rows = spark.range(-10, 3_000_100).withColumn("v", F.lit(1))
    got = upsert.in_scope(rows, scope, "id")
    assert got.columns == ["id", "v"] and got.count() == 1_000_005 and got.where("id % 3 <> 0 and id > 0").count() == 0
    assert upsert.in_scope(rows, upsert.scope_snapshot(chosen.limit(0), "id", {"a": "b"}), "id").count() == 0


def test_pages_by_token_are_the_pages_by_number(spark, tmp_path):
    from perilens.operators import listing

    rows = [(i, None if i % 7 == 0 else i % 5, "x") for i in range(60)]
    df = spark.createDataFrame(rows, "id int, score int, t string")
    for order in ([("score", True), ("id", False)], [("score", False), ("id", True)]):
        path = str(tmp_path / f"t{order[0][1]}")
        listing.in_order(df, order, path, 4)
        table, token, seen = spark.read.parquet(path), None, []
        while (page := listing.page_after(table, order, 13, token)) is not None:
            token = listing.token_of(page, order)
            if token is None:
                break
            seen += [r.id for r in page.collect()]
        assert seen == [r.id for r in df.orderBy(*[F.desc(c) if d else F.asc(c) for c, d in order]).collect()]


def test_versions_and_log_stay_bounded(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "reviews")
    schema = "content_hash string, first_seen_at int, last_seen_at int"
    for k in range(20):
        spark.createDataFrame([(f"h{k % 3}", k, k), (f"n{k}", k, k)], schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    jobs.keep_reviews(stream, table, str(tmp_path / "ck"), parts=2, keep=1).awaitTermination(200)
    rows, newest = jobs._snapshots(spark, table)
    want = {(f"h{i}", i, 18 + i if i < 2 else 17) for i in range(3)} | {(f"n{k}", k, k) for k in range(20)}
    assert set(map(tuple, rows.collect())) == want and newest == 20
    jobs.vacuum(spark, table, keep=1)
    jobs.vacuum(spark, table, keep=1)
    assert set(map(tuple, jobs._snapshots(spark, table)[0].collect())) == want
    parts = [p for v in (tmp_path / "reviews").glob("v*") for p in v.glob("part*")]
    assert len(parts) <= 6 and len(list((tmp_path / "reviews" / "log").glob("part*"))) <= 1


def test_sums_follow_signed_changes(spark, tmp_path):
    import random
    from decimal import Decimal

    rng, source, table = random.Random(3), str(tmp_path / "in"), str(tmp_path / "sums")
    schema, there, changes = "k int, sign int, n int, amount decimal(9,2)", [], []
    for batch in range(4):
        rows = []
        for _ in range(25):
            if there and rng.random() < 0.4:
                k, n, amount = there.pop(rng.randrange(len(there)))
                rows.append((k, -1, n, amount))
            else:
                there.append((rng.randrange(6), rng.randrange(9), Decimal(rng.randrange(10_000)) / 100))
                rows.append((there[-1][0], 1, *there[-1][1:]))
        changes += rows
        spark.createDataFrame([*rows, (None, 1, 1, Decimal(1))], schema).coalesce(1).write.mode("append").parquet(source)
        jobs.keep_sums(spark.readStream.schema(schema).parquet(source), "k", "sign", ["n", "amount"], table, str(tmp_path / "ck"), parts=3).awaitTermination(120)
    want = jobs.summed(spark.createDataFrame(changes, schema), "k", "sign", ["n", "amount"]).where("entries > 0")
    assert sorted(map(tuple, jobs.current_sums(spark, table).select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    plain = {k: (sum(1 for r in there if r[0] == k), sum(r[1] for r in there if r[0] == k), sum(r[2] for r in there if r[0] == k)) for k, *_ in there}
    assert {r.k: (r.entries, r.n, r.amount) for r in want.collect()} == plain
    assert jobs.current_sums(spark, str(tmp_path / "none")) is None


def test_ordered_cooldown_equals_the_batch_twin_and_forgets(spark):
    """The processor by itself: rows in any order, timers as the watermark moves."""
    import datetime
    import random
    from types import SimpleNamespace

    import pandas as pd

    class Value:
        kept = None
        exists = lambda self: self.kept is not None
        get = lambda self: self.kept

        def update(self, x):
            self.kept = x

        def clear(self):
            self.kept = None

    class Listed(list):
        appendValue = list.append
        get = lambda self: iter(list(self))

        def put(self, x):
            self[:] = x

    timers, value, listed = set(), Value(), Listed()
    p = jobs.OrderedCooldown("k", 300)
    p.init(SimpleNamespace(getValueState=lambda *a: value, getListState=lambda *a: listed, registerTimer=timers.add))
    rng, day = random.Random(4), datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    rows = [(i, 7, day + datetime.timedelta(seconds=rng.randrange(5000)), rng.choice(["done", "queued"])) for i in range(80)]
    batches = sorted(rows, key=lambda r: r[2].timestamp() + rng.randrange(600))
    got = {}
    us = lambda t: int(t.timestamp() * 1_000_000)
    seen = 0
    for at in range(0, 80, 10):
        frame = pd.DataFrame([(i, k, us(t), status) for i, k, t, status in batches[at : at + 10]], columns=["id", "k", "us", "status"])
        list(p.handleInputRows((7,), iter([frame]), None))
        seen = max(seen, *frame.us)
        for now in ([(seen - 600_000_000) // 1000] if at < 70 else [seen // 1000, seen // 1000 + 400_000]):
            while fired := sorted(t for t in timers if t <= now):
                timers.remove(fired[0])
                for out in p.handleExpiredTimer((7,), SimpleNamespace(getCurrentWatermarkInMs=lambda: now), None):
                    got |= dict(zip(out.id, out.decision))
    want = jobs.gated(spark.createDataFrame(rows, "id int, k int, at timestamp, status string"), "k", 300)
    assert got == {r.id: r.decision for r in want.collect()}
    assert value.kept is None and not listed and not timers


def test_ordered_cooldown_stream(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "id long, institution_id long, at timestamp, status string"
    lots = ["(2L, 7L, timestamp'2024-01-01 00:05:00', 'queued'), (3L, 8L, timestamp'2024-01-01 00:05:00', 'queued')", "(1L, 7L, timestamp'2024-01-01 00:00:00', 'done')", "(9L, 9L, timestamp'2024-01-03 00:00:00', 'queued')", "(10L, 9L, timestamp'2024-01-03 00:00:01', 'queued')"]
    for rows in lots:
        spark.sql(f"select * from values {rows} as t(id, institution_id, at, status)").coalesce(1).write.mode("append").parquet(source)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = jobs.cooldown_in_order(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), "institution_id")
        query = out.writeStream.format("memory").queryName("ordered").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(180)
        assert {(r.id, r.decision) for r in spark.table("ordered").collect()} == {(1, "start"), (2, "cooldown"), (3, "start")}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
