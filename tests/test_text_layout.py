"""Text quality, markers, layout and pages."""

import duckdb
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as entry
from checks.compare import rows_of
from checks.views import TABLES
from docstruct.functions import text as X
from docstruct.operators import layout as L
from docstruct.operators import quality as Q


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t")).alias("x")).first().x


def test_reasons_in_order(spark):
    cases = [("  \n", 1, "empty"), ("(cid:7)" * 11, 1, "character ids"), ("�" * 11, 1, "replacement characters"), ("ab1234" * 9, None, "few letters"), ("a" * 100, 1, "short pages"), ("a" * 100, None, None)]
    df = spark.createDataFrame([(i, t, n) for i, (t, n, _) in enumerate(cases)], "i int, t string, n int")
    got = df.select("i", Q.garbled_reason(F.col("t"), F.col("n")).alias("r")).orderBy("i").collect()
    assert [r.r for r in got] == [c[2] for c in cases]


def test_tokens_are_ascii_sets(spark):
    assert set(one(spark, "Soil, Water & Air—2024! soil café", X.tokens)) == {"soil", "water", "air", "2024", "caf"}


def test_markdown(spark):
    assert one(spark, "# Head ##\n\n\n\nsome *it* and **bold**  x", X.markdown_to_marked) == "** Head **\n\nsome _it_ and **bold** x"


def test_doubled_characters(spark):
    rows = [(1, 1, 1.0, i, w) for i, w in enumerate(["SSOOIILL", "aa", "ooccccuurr"])] + [(2, 1, 1.0, 0, "XX"), (2, 1, 1.0, 1, "gigabyte")]
    words = spark.createDataFrame(rows, "doc_id int, page_no int, line_top double, at int, text string")
    assert [r.text for r in L.dedup_chars(words).orderBy("doc_id", "at").collect()] == ["SOIL", "a", "occur", "XX", "gigabyte"]


def test_repeated_words(spark):
    words = spark.createDataFrame([(1, 1, 1.0, i, w) for i, w in enumerate(["Roles", "roles,", "and", "*", "&", "and"])], "doc_id int, page_no int, line_top double, at int, text string")
    assert [r.text for r in L.dedup_consecutive(words).orderBy("at").collect()] == ["Roles", "and", "*", "and"]


def test_underline(spark):
    words = spark.createDataFrame([(1, 1, i, t, 0.0 + 50 * i, 40.0 + 50 * i, 100.0, 110.0) for i, t in enumerate(["Data", "(www.x.org)", "tall"])], "doc_id int, page_no int, word_no int, text string, x0 double, x1 double, top double, bottom double")
    rects = spark.createDataFrame([(1, 1, 0.0, 90.0, 111.0, 112.0), (1, 1, 100.0, 140.0, 111.0, 114.0)], "doc_id int, page_no int, x0 double, x1 double, top double, bottom double")
    assert {r.word_no: r.under for r in L.underlined(words, rects).collect()} == {0: True, 1: False, 2: False}


def test_rendering(spark):
    flags = [("Big", 1, 0, 0), ("bold", 1, 1, 0), ("it", 0, 1, 1), ("plain", 0, 0, 0), ("end", 1, 0, 1)]
    words = spark.createDataFrame([(1, 1, 1.0, i, t, bool(e), bool(x), bool(u)) for i, (t, e, x, u) in enumerate(flags)], "doc_id int, page_no int, line_top double, at int, text string, emph boolean, ital boolean, under boolean")
    assert L.render_lines(words).first().text == "** Big _ bold ** ++ it ++ _ plain ** ++ end ++ **"


def test_lines_by_gap_anchor_on_the_first_word(spark):
    tops = [10.0, 11.9, 13.8, 13.9, 12.1]
    words = spark.createDataFrame([(1, 1, 0, i, 10.0 * i, t) for i, t in enumerate(tops)], "doc_id int, page_no int, block_no int, word_no int, x0 double, top double")
    assert [r.line_no for r in L.lines_by_gap(words).orderBy("word_no").collect()] == [1, 1, 2, 2, 2]


def test_lines_by_gap_deal_words_once(spark):
    nan = float("nan")
    rows = [(d, p, b, i, x, t) for d in (1, None) for p in (1, 2) for b in (0, 1) for i, (x, t) in enumerate(
        [(30.0, 10.0), (None, 10.2), (20.0, 11.4), (20.0, 10.6), (5.0, 40.0), (nan, 40.0), (1.0, None), (9.0, 41.0), (2.0, 60.0)]
    )]
    words = spark.createDataFrame(rows, "doc_id int, page_no int, block_no int, word_no int, x0 double, top double")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    given = spark.conf.get(name)
    spark.conf.set(name, 4)  # lines reach over batches
    try:
        lined = L.lines_by_gap(words)
        got = {tuple(r)[:4]: (r.line_no, r.at) for r in lined.collect()}
        again = lined.drop("at").withColumn("at", F.row_number().over(Window.partitionBy("doc_id", "page_no", "block_no", "line_no").orderBy("x0", "word_no")))
        assert got == {tuple(r)[:4]: (r.line_no, r.at) for r in again.collect()} and len(got) == len(rows)
        assert [got[(None, 2, 1, i)] for i in range(9)] == [(2, 4), (2, 1), (2, 2), (2, 3), (3, 1), (3, 3), (1, 1), (3, 2), (4, 1)]
    finally:
        spark.conf.set(name, given)
    plan = lined._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan  # which deals and sorts all words a second time
    assert L.lines_by_gap(words.limit(0)).count() == 0


def test_pages(spark):
    pages = spark.createDataFrame([(1, 1, "Page 1\n\nfirst and\n1 of 3\n"), (1, 2, "then 5\n7\nmore.\n\n"), (1, 3, "3\n \n"), (1, 4, "lower again")], "doc_id int, page_no int, text string")
    assert L.join_pages(pages).first().text == "first and then 5\n7\nmore.\n\nlower again"


def test_markers(spark):
    text = "** A b ** _it_ *st* ++u++\n## Head\nsnake_case_x 2*3*4"
    row = Q.with_marker_counts(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert (row.bold, row.italic, row.underline, row.headings) == (1, 2, 1, 1)


def test_furniture(spark):
    rows = [(1, 1, 0, "page_header", True, "Plan title", 5.0), (1, 1, 1, "page_header", True, "Run  ning", 6.0), (1, 2, 2, "page_header", True, "run ning", 5.0), (1, 1, 3, "text", False, "body", 50.0), (1, 1, 4, "page_footer", True, "1", 1.0)]
    blocks = spark.createDataFrame(rows, "doc_id int, page_no int, block_no int, kind string, furniture boolean, text string, t double")
    assert {r.block_no for r in L.keep_title_header(blocks).collect()} == {0, 3}


def test_page_edges_of_any_length(spark):
    from docstruct.operators.layout import strip_page_edges

    edge = "12\n \nPage 3 of 9\n" * 40000
    rows = [(edge + "text\n7\nmore" + "\n" + edge,), ("a\f3",), ("3 a",), (" \n4\n",), ("",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(strip_page_edges(F.col("t"))).collect()]
    assert got == ["text\n7\nmore", "a", "a", "", "", None]


def test_text_queries_find_their_functions(spark):
    """Queries of `functions.text` beside one of `plans.texts`: both modules must be in reach."""
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    for name in ("l3_is_italic", "l9_looks_like_url", "l13_looks_doubled", "l21_block_text", "l25_markdown_to_marked"):
        df = entry.queries()[name](spark, folder)
        cur = con.execute(entry.oracle_sql()[name])
        assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in cur.description], cur.fetchall()), name
