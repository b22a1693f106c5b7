"""The physical plans the operators are meant to get."""

import re

from docstruct.operators import fields as J
from docstruct.operators import layout as L
from docstruct.operators import match as M
from docstruct.operators import nest as N
from docstruct.operators import quality as Q
from docstruct.operators import rules as R


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_structuring_takes_one_shuffle(spark):
    blocks = spark.range(100).selectExpr("'t' AS tag", "id % 7 AS doc_id", "id AS pos", "'x' AS text", "'answer.text' AS label")
    items = N.to_items(R.apply_rules(N.nest(blocks, chunks=None), long_docs=False), dedup=True, long_docs=False)
    text = plan(items)
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text


def test_losing_texts_are_dropped_before_the_shuffle(spark):
    rows = spark.range(10).selectExpr("id AS doc_id", "'e' AS extractor", "0 AS rank", "'fresh' AS source", "'text' AS text", "1 AS n_pages")
    assert "WindowGroupLimit" in plan(Q.choose_text(rows))


def test_no_token_array_is_a_shuffle_key_or_in_a_posting(spark):
    """Sets travel as identifiers; token arrays are fetched as values of surviving pairs."""
    rows = spark.range(40).selectExpr("'r' AS tag", "id % 5 AS doc_id", "id AS ord", "concat('w', id % 3, ' x y') AS text", "'l' AS label", "id")
    for df in (M.best_label(rows, rows.drop("tag")), M.containment_join(rows.select("id", "text"), rows.select("id", "text")), M.greedy_match(rows.drop("tag"), rows)):
        text = plan(df)
        keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text)
        kept = re.findall(r"Generate posexplode\(.*\), \[([^\]]*)\], false, \[pos", text)
        assert keys and kept and not [k for k in keys + kept if re.search(r"\b[lr]?toks#", k)]


def test_references_and_texts_do_not_go_through_the_driver(spark):
    """Texts that a query makes have guessed sizes; a guess must not turn a table per document into a broadcast."""
    refs = spark.range(10).selectExpr("id AS doc_id", "concat('{\"a\": \"', id, '\"}') AS raw")
    recs = refs.selectExpr("'r' AS run", "'m' AS model", "doc_id", "raw")
    judged, ref_leaves = J.judge(recs, refs), J.leaves(refs, keys=("doc_id",))
    for df in (
        judged, J.aligned_leaves(recs, refs), J.pair_items(recs, refs, "a"), J.field_metrics(judged, J.n_reference_fields(ref_leaves)),
        J.field_wide(J.field_outcomes(judged), judged, ["m"]), M.grounding(J.leaves(recs), refs.withColumnRenamed("raw", "text")),
    ):
        assert "Broadcast" not in plan(df)


def test_records_of_one_partition_are_parsed_in_many(spark):
    recs = spark.range(100, numPartitions=1).selectExpr("id AS doc_id", "concat('{\"a\": [{\"b\": ', id, '}, {\"a\": null}]}') AS raw")
    for df in (*J.split_invalid(recs), J.key_census(recs)):
        text = plan(df)
        assert "REPARTITION_BY_NUM" in text and "parse" not in text[text.index("REPARTITION_BY_NUM"):]
    assert {(r.key, r.n) for r in J.key_census(recs).collect()} == {("a", 200), ("b", 100)}


def test_words_dealt_by_document_are_dealt_by_page_before_lines_are_sorted(spark):
    words = spark.range(20).selectExpr("id % 3 AS doc_id", "id % 2 AS page_no", "id AS word_no", "'w' AS text", "double(id) AS top", "double(id) AS x0").repartition("doc_id")
    text = plan(L.line_affected(L.dedup_consecutive(L.lines_by_top(words))))
    assert re.findall(r"Exchange hashpartitioning\((\w+)#\d+L?, (\w+)#", text) == [("doc_id", "page_no")]


def test_sides_of_a_judged_field_are_constants(spark):
    """A field's one or two rows come from a list of constants: no list of structs is built per field and read value by value."""
    refs = spark.range(4).selectExpr("id AS doc_id", """'{"title": "a b", "language": "eng", "note": " N/A "}' AS raw""")
    recs = refs.selectExpr("'r' AS run", "'m' AS model", "doc_id", """'{"title": "x", "language": "eng", "note": "null"}' AS raw""")
    judged = J.judge(recs, refs)
    assert "inline" not in plan(judged) and "Generate explode" in plan(judged)
    said = {(r.field, r.model_value, r.verdict, r.reason) for r in judged.where("doc_id = 0").collect()}
    assert said == {
        ("title", "x", "Hallucinated", "only 0% of the model's words are in the reference"), ("title", None, "Missed", ""),
        ("language", "eng", "Correct", ""), ("note", "null", "Correct", "both empty"),
    }


def test_words_are_dealt_by_page_once_and_meet_profile_and_boxes_unsorted(spark):
    words = spark.range(40).selectExpr(
        "id % 3 AS doc_id", "id % 2 AS page_no", "id AS word_no", "concat('w', id) AS text", "'F' AS fontname", "double(10) AS size",
        "double(id) AS x0", "double(id + 1) AS x1", "double(id) AS top", "double(id + 9) AS bottom",
    ).repartition("doc_id")
    rects = spark.range(9).selectExpr("id % 3 AS doc_id", "id % 2 AS page_no", "0D AS x0", "90D AS x1", "double(id) AS top", "double(id + 1) AS bottom").repartition("doc_id")
    blocks = spark.range(6).selectExpr("id % 3 AS doc_id", "id % 2 AS page_no", "id AS block_no", "'text' AS kind", "0D AS l", "0D AS t", "90D AS r", "90D AS b").repartition("doc_id")
    profile = L.body_profile(words)
    counted = plan(profile)
    assert re.search(r"HashAggregate\(keys=\[doc_id#\d+L, page_no#\d+L, [^\]]*\], functions=\[(partial_)?sum", counted.replace("knownfloatingpointnormalized", "k"))
    flagged = L.word_flags_plain(words, profile)
    for df in (L.lines_by_top(L.underlined(flagged, rects)), L.heading_override(L.words_in_blocks(flagged, blocks))):
        text = plan(df)
        assert "SortMergeJoin" not in text and "ShuffledHashJoin" in text
        assert len(re.findall(r"Exchange hashpartitioning\(doc_id#\d+L, page_no#\d+L, \d+\)", text)) <= 2  # words, and the lists of boxes
        assert not re.findall(r"Exchange hashpartitioning\([^)]*_band", text)


def test_a_word_meets_each_box_of_its_page_once(spark):
    words = spark.createDataFrame([(1, 1, 1, 10.0, 20.0, 15.0, 25.0), (1, 1, 2, 10.0, 20.0, 40.0, 50.0), (1, 2, 3, 10.0, 20.0, 15.0, 25.0)], "doc_id int, page_no int, word_no int, x0 double, x1 double, top double, bottom double")
    blocks = spark.createDataFrame([(1, 1, 7, "a", 0.0, 0.0, 90.0, 90.0), (1, 1, 8, "b", 0.0, 30.0, 90.0, 90.0), (1, 2, 9, "c", 0.0, 60.0, 90.0, 90.0)], "doc_id int, page_no int, block_no int, kind string, l double, t double, r double, b double")
    met = sorted((r.word_no, r.block_no, r.kind) for r in L.words_in_blocks(words, blocks).collect())
    assert met == [(1, 7, "a"), (2, 7, "a"), (2, 8, "b")]


def test_characters_meet_the_words_around_them_only(spark):
    """A line of n words: compared by line, each of its characters meets all n words."""
    n = 400
    words = spark.range(n).selectExpr("1L AS doc_id", "1 AS page_no", "id AS word_no", "'ab' AS text", "double(id * 40) AS x0", "double(id * 40 + 30) AS x1", "0D AS top", "10D AS bottom")
    chars = words.selectExpr("doc_id", "page_no", "word_no AS of_word", "explode(array(0, 1)) AS k", "x0", "x1", "top", "bottom").selectExpr(
        "doc_id", "page_no", "of_word", "'a' AS text", "x0 + k * 15 AS x0", "x0 + k * 15 + 15 AS x1", "top", "bottom"
    )
    # Edges the wrong way round: over the words 1 to 3, whose boxes both edges pass.
    odd = spark.sql("SELECT 1L AS doc_id, 1 AS page_no, -1L AS of_word, 'x' AS text, 130D AS x0, 60D AS x1, 0D AS top, 10D AS bottom")
    met = L.chars_in_words(chars.unionByName(odd), words)
    assert sorted((r.of_word, r.word_no) for r in met.collect()) == sorted([(-1, 1), (-1, 2), (-1, 3)] + 2 * [(i, i) for i in range(n)])
    text = plan(met)
    assert "ShuffledHashJoin" in text and "Broadcast" not in text and "_column" in re.search("ShuffledHashJoin.*", text)[0]


def test_grounding_is_reported_in_one_pass(spark):
    """Counts and examples read the grounded values once; examples are the first by document, then path."""
    values = spark.sql("SELECT 'r' AS run, 'm' AS model, id % 50 AS doc_id, concat('p', id % 4) AS path, concat('zzz', id) AS value FROM range(200)").dropDuplicates(["doc_id", "path"])
    texts = spark.range(50).selectExpr("id AS doc_id", "'a text' AS text")
    report = M.grounding_report(M.grounding(values.where("doc_id <> 0 OR path = 'p2'"), texts))
    assert plan(report).count("SortMergeJoin") == 1
    row = report.first()
    assert (row.samples, row.invented, row.grounded, row.share_grounded) == (50, 99, 0, 0.0)
    assert [e.split(" = ")[0] for e in row.examples.split("; ")] == ["0 p2", "1 p1", "1 p3"]
