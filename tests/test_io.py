"""Stage files and tables, incremental runs."""

import json

import pytest

from docstruct.operators import nest as N
from docstruct.sources import io as IO
from docstruct.streaming import incremental


def write(folder, name, data):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(json.dumps(data), encoding="utf-8")


def test_read_blocks(spark, tmp_path):
    write(tmp_path / "runA", "sample3.json", [{"text": "a"}, {"text": "b", "label": None}, {"text": "c", "label": "title", "confidence": 0.5, "page": 2}])
    write(tmp_path / "runB", "sample12.json", {"blocks": [{"text": "x", "label": "title"}]})
    got = {(r.tag, r.doc_id, r.pos): (r.text, r.label, r.confidence, r.page) for r in IO.read_blocks(spark, str(tmp_path)).collect()}
    assert got == {("runA", 3, 0): ("a", "answer.text", None, None), ("runA", 3, 1): ("b", None, None, None), ("runA", 3, 2): ("c", "title", 0.5, 2), ("runB", 12, 0): ("x", "title", None, None)}


def test_structured_files_round_trip(spark, tmp_path):
    tree = {"template": {"title": "T", "section": [{"title": "S", "description": " ", "question": [{"text": "q", "answer": {"text": "plain"}}, {"text": "", "answer": {"json": {"answer": "deep"}}}]}]}}
    write(tmp_path / "gold", "dmp_sample7_new.json", {"narrative": tree})
    write(tmp_path / "gold", "8.json", tree)
    write(tmp_path / "gold", "s1_v2.json", tree)
    write(tmp_path / "gold", "9.json", [1])
    good, bad = IO.read_structured(spark, str(tmp_path))
    assert bad.count() == 1 and {r.doc_id for r in IO.read_annotations(spark, str(tmp_path)).collect()} == {7, 8}
    items = N.to_items(N.from_structured(good.where("doc_id = 7")), dedup=False)
    assert [(r.label, r.text) for r in items.orderBy("ord").collect()] == [
        ("title", "T"), ("section.title", "S"), ("section.description", ""), ("question.text", "q"), ("answer.text", "plain"), ("answer.text", "deep")
    ]
    with pytest.raises(Exception, match="not a structured document"):
        IO.read_structured(spark, str(tmp_path), strict=True)[0].collect()


def test_stage_tables(spark, tmp_path):
    stage, backup = str(tmp_path / "stage"), str(tmp_path / "backup")
    IO.write_stage(spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "tag string, doc_id bigint, text string"), stage)
    IO.write_stage(spark.createDataFrame([("a", 2, "z")], "tag string, doc_id bigint, text string"), stage)
    rows = spark.read.parquet(stage)
    assert {(r.tag, r.doc_id) for r in rows.collect()} == {("a", 2), ("b", 1)}
    IO.replace_tag(spark, stage, "a", backup, "s1")
    assert [r.tag for r in IO.list_tags(spark.read.parquet(stage)).collect()] == ["b"]
    assert [(r.backup, r.tag, r.doc_id) for r in spark.read.parquet(backup).collect()] == [("s1", "a", 2)]


def test_exports(spark, tmp_path):
    slots = spark.createDataFrame([("t", 1, 0, 0, "title", "T"), ("t", 1, 1, 1, "answer.text", "  "), ("t", 2, 1, 0, "section.title", "S")], "tag string, doc_id bigint, sec int, q int, slot string, text string")
    IO.export_items(slots, str(tmp_path / "items"))
    back = spark.read.option("header", True).csv(str(tmp_path / "items"))
    assert {(int(r.doc_id), r.label, r.text) for r in back.collect()} == {(1, "title", "T"), (2, "section.title", "S")}
    IO.export_scores(str(tmp_path / "scores"), summary=slots, matrix=slots)
    assert spark.read.parquet(str(tmp_path / "scores" / "matrix")).count() == 3
    IO.save_scores(slots, str(tmp_path / "base"))
    assert IO.load_baseline(spark, str(tmp_path / "base")).count() == 3


def test_only_new_files_are_processed(spark, tmp_path):
    schema = "tag string, doc_id bigint, pos bigint, text string, label string"
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for doc in (1, 2):
        spark.createDataFrame([("t", doc, 0, f"title {doc}", "title"), ("t", doc, 1, "a", "answer.text")], schema).coalesce(1).write.mode("append").parquet(source)
        incremental.run_available(incremental.read_new_blocks(spark, source, schema), out, mark).awaitTermination()
    rows = incremental.latest(spark, out)
    assert {(r.doc_id, r.text) for r in rows.where("slot = 'title'").collect()} == {(1, "title 1"), (2, "title 2")}
    # The second batch wrote the document it touched and nothing else.
    assert {(r.batch, r.doc_id) for r in spark.read.parquet(out).collect()} == {(0, 1), (1, 2)}


def test_a_document_in_two_batches_comes_out_whole(spark, tmp_path):
    from docstruct.operators.rules import apply_rules

    schema = "tag string, doc_id bigint, pos bigint, text string, label string"
    rows = [("t", d, p, x, label) for d in (1, 2) for p, (x, label) in enumerate([("T", "title"), ("S", "section.title"), ("q", "question.text"), ("a", "answer.text"), ("b", "answer.text")])]
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for part in (rows[:2] + rows[5:], rows[2:4], rows[4:5]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    incremental.run_available(incremental.read_new_blocks(spark, source, schema, max_files=1), out, mark).awaitTermination()
    whole = apply_rules(N.nest(spark.createDataFrame(rows, schema)))
    def same(folder=out):
        got = incremental.latest(spark, folder)
        return sorted(map(str, got.select(*whole.columns).collect())) == sorted(map(str, whole.collect()))

    assert same()
    assert {(r.batch, r.doc_id) for r in spark.read.parquet(out).collect()} == {(0, 1), (0, 2), (1, 1), (2, 1)}
    incremental.compact(spark, out, out + "2")
    assert same(out + "2") and {(r.batch, r.doc_id) for r in spark.read.parquet(out + "2").collect()} == {(2, 1), (2, 2)}


def test_encoded_names_and_tags(spark, tmp_path):
    write(tmp_path / "in" / "m:1", "Sample 3.json", [{"text": "a"}])
    assert [(r.tag, r.doc_id) for r in IO.read_blocks(spark, str(tmp_path / "in")).collect()] == [("m:1", 3)]
    stage, backup = str(tmp_path / "stage"), str(tmp_path / "backup")
    IO.write_stage(spark.createDataFrame([("m:1", 1, "x"), ("b", 1, "y")], "tag string, doc_id bigint, text string"), stage)
    for _ in range(2):
        IO.replace_tag(spark, stage, "m:1", backup, "s1")
    assert [r.tag for r in IO.list_tags(spark.read.parquet(stage)).collect()] == ["b"]
    assert [(r.tag, r.doc_id) for r in spark.read.parquet(backup).collect()] == [("m:1", 1)]
    slots = "tag string, doc_id bigint, sec int, q int, slot string, text string"
    for tag in ("a", "b"):
        IO.export_items(spark.createDataFrame([(tag, 1, 0, 0, "title", "T")], slots), str(tmp_path / "items"))
    assert {r.tag for r in spark.read.option("header", True).csv(str(tmp_path / "items")).collect()} == {"a", "b"}
