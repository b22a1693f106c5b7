"""Whole jobs: record scoring, block text, narratives from answers."""

import json

from docstruct.operators import layout as L
from docstruct.operators import nest as N
from docstruct.plans import narratives, records, texts

RECORD = "run string, model string, doc_id bigint, raw string"


def test_score_records_with_and_without_output(spark, tmp_path):
    ref = {"dmp": {"title": "Plan one", "dataset": [{"title": "A"}, {"title": "B"}]}}
    recs = spark.createDataFrame([
        ("r", "m", 1, json.dumps({"dmp": {"title": "Plan one", "dataset": [{"title": "B"}]}})), ("r", "m", 2, json.dumps(ref)),
        ("r", "m", 3, "[1]"), ("r", "m", 4, None), ("r", "m", 9, json.dumps(ref)),
    ], RECORD)
    refs = spark.createDataFrame([(i, json.dumps(ref)) for i in (1, 2, 3, 4)], "doc_id bigint, raw string")
    plain, kept = records.score_records(recs, refs), records.score_records(recs, refs, out=str(tmp_path / "scores"))
    for name, table in plain.items():
        assert sorted(map(str, table.collect())) == sorted(map(str, kept[name].select(*table.columns).collect())), name
    assert {(r.doc_id, r.n_ref, r.correct, r.missed) for r in plain["per_record"].collect()} == {(1, 3, 2, 1), (2, 3, 3, 0)}
    assert {(r.doc_id, r.reason) for r in plain["invalid"].collect()} == {(3, "not a JSON object"), (4, "not valid JSON")}
    assert {r.name for r in (tmp_path / "scores").iterdir()} == {"every_field", "per_record", "outcomes", "summary", "invalid"}


def words_of(spark, rows):
    return spark.createDataFrame(
        [(1, 1, n, t, f, s, float(x), float(x) + 8, float(y), float(y) + 10) for n, (t, f, s, x, y) in enumerate(rows)],
        "doc_id bigint, page_no bigint, word_no bigint, text string, fontname string, size double, x0 double, x1 double, top double, bottom double",
    )


def test_block_text(spark):
    words = words_of(spark, [
        ("Data", "Roman", 10.0, 0, 0), ("plan", "Roman", 10.0, 20, 1), ("body", "Roman", 10.0, 20, 30), ("The", "Roman", 10.0, 0, 30.5), ("bold", "Bold", 10.0, 40, 30),
        ("link", "Roman", 10.0, 0, 44), ("http:x", "Roman", 10.0, 20, 44), ("footer", "Roman", 10.0, 0, 90), ("text", "Roman", 10.0, 0, 60), ("more", "Roman", 10.0, 20, 60),
    ])
    box = lambda no, kind, furniture, text, t, b: (1, 1, no, kind, furniture, text, 0.0, float(t), 100.0, float(b))
    blocks = spark.createDataFrame([
        box(5, "text", False, "own", 28, 56), box(7, "section_header", False, "own", 0, 12), box(2, "page_footer", True, "footer", 88, 102),
        box(3, "text", False, " kept   text ", 70, 80), box(4, "text", False, "x", 58, 71),
    ], "doc_id bigint, page_no bigint, block_no bigint, kind string, furniture boolean, text string, l double, t double, r double, b double")
    links = spark.createDataFrame([(1, 1, 1, 0.0, 40.0, 44.0, 54.0, "u")], "doc_id bigint, page_no bigint, link_no bigint, x0 double, x1 double, top double, bottom double, uri string")
    assert [r.text for r in texts.block_text(words, blocks, links).collect()] == ["** Data plan **\nThe body ** bold **\n++ link ++ http:x\ntext more\nkept text"]
    assert texts.block_text(words.limit(0), blocks, links).collect() == []


def test_a_block_of_many_words_takes_linear_time(spark):
    n = 100_000
    words = spark.range(n).selectExpr(
        "1L AS doc_id", "1L AS page_no", "1L AS block_no", "id AS word_no", "'w' AS text", "double(id % 50) AS x0", "double(floor(id / 50) * 12 + id % 2) AS top",
    )
    lined = L.lines_by_gap(words)
    assert lined.where("line_no <> floor(word_no / 50) + 1 OR at <> word_no % 50 + 1").count() == 0 and lined.count() == n


def test_narratives_write_only_what_is_new(spark, tmp_path):
    out = str(tmp_path / "run")
    answer = lambda *blocks: json.dumps([{"text": t, "label": x} for t, x in blocks])
    first = answer(("T", "title"), ("S  s", "section.title"), ("", "question.text"), ("a", "answer.text"))
    rows = spark.createDataFrame([("a", 1, first), ("a", 2, "no list"), ("b", 1, first)], "tag string, doc_id bigint, raw string")
    made = narratives.narratives(rows, out=out)
    assert [(r.tag, r.doc_id, r.reason) for r in made["rejected"].collect()] == [("a", 2, "not valid JSON")]
    items = N.to_items(made["filled"], dedup=False).where("tag = 'a'").orderBy("ord").collect()
    assert [(r.label, r.text) for r in items] == [("title", "T"), ("section.title", "S s"), ("question.text", "S s"), ("answer.text", "a")]
    done = spark.read.parquet(f"{out}/filled").select("tag", "doc_id").distinct()
    again = narratives.narratives(rows.unionByName(spark.createDataFrame([("c", 5, first)], rows.schema)), done)
    assert {(r.tag, r.doc_id) for r in again["nested"].collect()} == {("c", 5)}


def test_what_is_still_to_ask(spark):
    text = "A readable text of some length that is long enough to pass every test of the gate. " * 5
    candidates = spark.createDataFrame(
        [(i, "e", 0, "fresh", text, 1) for i in (1, 2, 3)], "doc_id bigint, extractor string, rank int, source string, text string, n_pages int"
    )
    done = spark.createDataFrame([(1,), (2,)], "doc_id bigint")
    record = "doc_id bigint, rda_model string, extractor string, prompt string, prompt_fingerprint string"
    wanted = spark.createDataFrame([(1, "m", "e", "p", "f"), (2, "m", "e", "p", "f")], record)
    manifest = spark.createDataFrame([(1, "m", "e", "p", "f"), (2, "m", "e", "p", "old")], record)
    assert {r.doc_id for r in narratives.to_ask(candidates, done).collect()} == {3}
    assert {r.doc_id for r in narratives.to_ask(candidates, done, wanted, manifest).collect()} == {2, 3}
