"""Reports on judged fields: their plans and their results on two small documents."""

import re

from pyspark.sql import functions as F

from docstruct.operators import fields as J
from tests.test_plans import plan


def judged_rows(spark):
    """Two documents, two runs, two models; a field of its own, one missed and one wrong. No row stands for document 2 in v2."""
    ref = '{"dmp": {"title": "A plan", "contact": {"name": "Ann"}, "dataset": [{"title": "Soil"}, {"title": "Air"}]}}'
    texts = {"m1": ref, "m2": '{"dmp": {"title": "Other words", "contact": {"name": "Ann"}, "dataset": [{"title": "Air"}], "note": "x"}}'}
    rows = [(run, m, d, text) for run in ("v1", "v2") for m, text in texts.items() for d in (1, 2) if (run, d) != ("v2", 2)]
    records = spark.createDataFrame(rows, "run string, model string, doc_id int, raw string")
    references = spark.createDataFrame([(1, ref), (2, ref)], "doc_id int, raw string")
    return J.judge(records, references), J.leaves(references, keys=("doc_id",))


def test_places_of_the_form_are_looked_up_once_per_field(spark):
    """a path is stripped once, not once per rule, and after outcomes are counted by field."""
    judged, _ = judged_rows(spark)
    parts = J.version_by_part(J.field_outcomes(judged), ["v1", "v2"])
    text = plan(parts.drop("row_order"))
    assert re.search(r"HashAggregate\(keys=\[run#\d+, field#\d+\]", text)
    made = str(J.form_row(F.col("field"))._jc.toString())
    assert made.count("regexp_replace") == 2
    got = {r.row: (r.v1, r.v2) for r in parts.collect()}
    assert got["Plan title & description"] == ("2 / 2 / 0", "1 / 1 / 0") and got["Dataset title"] == ("6 / 0 / 2", "3 / 0 / 1")


def test_pooled_scores_judge_records_once(spark):
    """F6"""
    judged, _ = judged_rows(spark)
    table = J.score_table(judged, ("run", "model"))
    assert plan(table).count("MapInArrow") == 1
    assert sorted((r.run, r.model, r.doc_id or 0, r.correct, r.missed) for r in table.collect() if r.model == "m2") == [
        ("v1", "m2", 0, 4, 4), ("v1", "m2", 1, 2, 2), ("v1", "m2", 2, 2, 2), ("v2", "m2", 0, 2, 2), ("v2", "m2", 1, 2, 2),
    ]
    assert [tuple(r) for r in J.best_run(table, within=["run"]).orderBy("run").collect()] == [("v1", "m1", 1.0), ("v2", "m1", 1.0)]


def test_form_reports_judge_records_once(spark):
    """counts and the number of fields they are shares of come from one reading of the outcomes."""
    judged, _ = judged_rows(spark)
    outcomes = J.field_outcomes(judged)
    matrix, groups = J.field_matrix(outcomes, ("run", "model")), J.group_correct(outcomes, ("run", "model"))
    for df in (matrix, groups):
        assert plan(df).count("MapInArrow") == 1
    rows = {(r.run, r.model, r.row): (r.n_row, r.correct, r.mismatch, r.missed) for r in matrix.collect()}
    assert rows["v2", "m2", "Total"] == (8, 2, 1, 1) and rows["v1", "m1", "Dataset title"] == (4, 4, 0, 0) and rows["v1", "m2", "Dataset title"] == (4, 2, 0, 2)
    assert {(r.n_fields, r.correct) for r in groups.collect() if r.grp == "Contact"} == {(2, 2), (2, 1)}
    assert {(r.row, r.n_row, r.correct) for r in J.field_matrix(outcomes, ()).collect() if r.row == "Total"} == {("Total", 8, 18)}


def test_missed_sections_judge_records_once(spark):
    """a second reading is that of the reference's own leaves."""
    judged, leaves = judged_rows(spark)
    sections = J.missed_by_section(judged, leaves, ["m1", "m2"], within=["run"])
    assert plan(sections).count("MapInArrow") == 2
    assert sorted(map(tuple, sections.collect())) == [
        ("v1", "contact", 2, 0, 0), ("v1", "dataset", 4, 0, 2), ("v1", "title", 2, 0, 2), ("v2", "contact", 2, 0, 0), ("v2", "dataset", 4, 0, 1), ("v2", "title", 2, 0, 1),
    ]
    assert {r.section: r.m2 for r in J.missed_by_section(judged, leaves, ["m2"]).collect()} == {"contact": 0, "dataset": 3, "title": 3}


def test_listing_sorts_by_columns(spark):
    """F8: a pattern among what rows are sorted by is computed at every comparison."""
    judged, _ = judged_rows(spark)
    listing = J.judged_listing(judged)
    assert not any("regexp_replace" in line for line in plan(listing).splitlines() if "Sort [" in line or "rangepartitioning" in line)
    rows = listing.collect()
    assert [(r.run, r.model, r.doc_id) for r in rows] == sorted((r.run, r.model, r.doc_id) for r in rows)
    assert [(r.field, r.verdict) for r in rows if (r.run, r.model) == ("v2", "m2")] == [
        ("dmp.note", "Hallucinated"), ("dmp.title", "Hallucinated"), ("dmp.contact.name", "Correct"), ("dmp.dataset[0].title", "Correct"),
    ]
