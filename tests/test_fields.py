"""Field records: leaves, pairing, verdicts, outcomes."""

import json
import random
import re
import time

from pyspark.sql import functions as F

from docstruct.operators import fields as J
from docstruct.operators import trees

VERDICTS = [
    ("dmp.title", "soil water air", "soil water air and more", "Correct", ""),
    ("dmp.title", "soil water air fire rock sun", "soil water air", "Hallucinated", "only 50% of the model's words are in the reference"),
    ("dmp.contact.mbox", "A@B.org", "a@b.org", "Correct", ""),
    ("x.license_ref", "https://creativecommons.org/licenses/by/4.0/", "CC BY 4.0", "Correct", ""),
    ("dmp.created", "2024-01-05T10:00:00Z", "2024-01-05", "Correct", ""),
    ("dmp.language", "en", "eng", "Hallucinated", "different value"),
    ("dmp.title", "N/A", "a title", "Hallucinated", "empty where the reference has a value"),
    ("dmp.title", "", "null", "Correct", "both empty"),
    ("dmp.title", "x", None, "Hallucinated", "not in the reference"),
]


def test_verdicts(spark):
    df = spark.createDataFrame([(i, *v[:3]) for i, v in enumerate(VERDICTS)], "i int, path string, m string, r string")
    got = df.select("i", J.verdict(F.col("path"), F.col("m"), F.col("r")).alias("v")).orderBy("i").collect()
    assert [(r.v.verdict, r.v.reason) for r in got] == [v[3:] for v in VERDICTS]


def test_leaves_follow_the_tree(spark):
    doc = {"dmp": {"title": "t", "n": 3, "ok": True, "gone": None, "none": [], "contact": {"contact_id": {"identifier": "i"}}, "dataset": [{"a": 1}, {"b": ["x", "y"]}]}}
    df = spark.createDataFrame([("r", "m", 1, json.dumps(doc)), ("r", "m", 2, "{")], "run string, model string, doc_id bigint, raw string")
    assert {(r.path, r.value) for r in J.leaves(df).collect()} == {
        ("dmp.title", "t"), ("dmp.n", "3"), ("dmp.ok", "true"), ("dmp.gone", None), ("dmp.contact.contact_id[0].identifier", "i"),
        ("dmp.dataset[0].a", "1"), ("dmp.dataset[1].b[0]", "x"), ("dmp.dataset[1].b[1]", "y"),
    }


def pair(model, ref):
    """The pairing rules on lists of key lists."""
    def toks(k):
        return set(re.findall("[a-z0-9]+", k))

    first, out = {}, {}
    for j, ks in enumerate(ref):
        for k in ks:
            first.setdefault(k, j)
    tests = [lambda k, rk: k == rk, lambda k, rk: bool(toks(k)) and len(toks(k) & toks(rk)) / len(toks(k)) >= 0.75]
    for same in tests:
        for i, ks in enumerate(model):
            if i not in out:
                hits = (next((j for rk, j in first.items() if j not in out.values() and same(k, rk)), None) for k in ks)
                hit = next((j for j in hits if j is not None), None)
                if hit is not None:
                    out[i] = hit
    for i in range(len(model)):
        if i not in out:
            free = [j for j in range(len(ref)) if j not in out.values()]
            out[i] = i if i not in out.values() else free[0] if free else len(ref) + sum(j >= len(ref) for j in out.values())
    return [out[i] for i in range(len(model))]


def test_pairing_matches_the_rules():
    rng = random.Random(6)

    def items(most):
        return [[" ".join(rng.choice("abcd") for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(0, 2))] for _ in range(rng.randint(0, most))]

    for _ in range(2_000):
        most = rng.choice([2, 5, 9])
        m, r = items(most), items(most)
        assert trees.pair_lists(m, r) == pair(m, r)


def test_pairing_by_words_free_slot_and_new_index(spark):
    ref = {"dmp": {"dataset": [{"title": "Soil water samples"}, {"title": ""}, {"name": "Maps"}]}}
    model = {"dmp": {"dataset": [{"title": "maps"}, {"title": "new one"}, {"title": "samples of soil water"}, {"title": None}, {"host": {"title": "x"}}]}}
    recs = spark.createDataFrame([("r", "m", 1, json.dumps(model))], "run string, model string, doc_id bigint, raw string")
    refs = spark.createDataFrame([(1, json.dumps(ref))], "doc_id bigint, raw string")
    assert [r.mapping for r in J.pair_items(recs, refs, "dmp.dataset").collect()] == [[2, 1, 0, 3, 4]]
    assert [r.item_keys for r in J.item_keys(recs, "dmp.dataset").orderBy("item").collect()] == [["maps"], ["new one"], ["samples of soil water"], [], ["x"]]


def test_long_lists_pair_in_linear_time():
    names = [[f"title {i}"] for i in range(40_000)]
    start = time.time()
    assert trees.pair_lists(names[::-1], names) == list(range(40_000))[::-1]
    assert trees.pair_lists([[]] * 20_000, names) == list(range(20_000))
    assert time.time() - start < 20


def test_judge_and_outcomes(spark):
    ref = {"dmp": {"title": "Plan one", "dataset": [{"title": "A", "type": "x"}, {"title": "B", "type": "y"}], "contact": {"contact_id": {"identifier": "1"}}, "project": [{"title": "P"}]}}
    model = {"dmp": {"title": "", "dataset": [{"title": "B", "type": "y"}, {"title": "A", "type": "z"}], "contact": {"contact_id": [{"identifier": "1"}]}, "extra": "e"}}
    recs = spark.createDataFrame([("r", "m", 1, json.dumps(model))], "run string, model string, doc_id bigint, raw string")
    refs = spark.createDataFrame([(1, json.dumps(ref))], "doc_id bigint, raw string")
    leaves = J.leaves(refs, keys=("doc_id",))
    rows = J.judge(recs, refs)
    got = {(r.field, r.model_field, r.verdict) for r in rows.collect()}
    assert got == {
        ("dmp.title", "dmp.title", "Hallucinated"), ("dmp.title", None, "Missed"), ("dmp.extra", "dmp.extra", "Hallucinated"),
        ("dmp.dataset[1].title", "dmp.dataset[0].title", "Correct"), ("dmp.dataset[1].type", "dmp.dataset[0].type", "Correct"),
        ("dmp.dataset[0].title", "dmp.dataset[1].title", "Correct"), ("dmp.dataset[0].type", "dmp.dataset[1].type", "Hallucinated"), ("dmp.dataset[0].type", None, "Missed"),
        ("dmp.contact.contact_id[0].identifier", "dmp.contact.contact_id[0].identifier", "Correct"), ("dmp.project[0].title", None, "Missed"),
    }
    outcomes = {r.field: r.outcome for r in J.field_outcomes(rows).collect()}
    assert outcomes["dmp.title"] == "Missed" and outcomes["dmp.dataset[0].type"] == "Mismatch" and outcomes["dmp.dataset[1].type"] == "Correct"
    m = J.field_metrics(rows, J.n_reference_fields(leaves)).first()
    assert (m.n_ref, m.correct, m.hallucinated, m.missed) == (7, 4, 3, 3)


def test_metrics_arithmetic(spark):
    judged = spark.createDataFrame([("r", "m", 1, v) for v in ["Correct"] * 3 + ["Hallucinated"] + ["Missed"] * 2], "run string, model string, doc_id bigint, verdict string")
    n_ref = spark.createDataFrame([(1, 5)], "doc_id bigint, n_ref bigint")
    m = J.field_metrics(judged, n_ref).first()
    assert (m.precision, m.recall, m.f1) == (0.75, 0.6, 0.667)


FORM = {"dmp": {
    "title": "t", "created": "c", "modified": "m", "language": "en", "ethical_issues_exist": "no", "dmp_id": {"identifier": "i", "type": "url"},
    "contact": {"name": "n", "mbox": "m", "contact_id": {"identifier": "i", "type": "orcid"}},
    "dataset": [{
        "title": "t", "description": "d", "type": "x", "personal_data": "no", "sensitive_data": "no", "dataset_id": {"identifier": "i", "type": "doi"},
        "distribution": [{"title": "t", "data_access": "open", "host": {"title": "h"}, "license": [{"license_ref": "l", "start_date": "s"}]}],
        "metadata": [{"description": "d", "language": "en", "metadata_standard_id": [{"identifier": "i", "type": "url"}]}],
    }],
}}

#: Where the form is changed, to what (None: taken away), and the problems that follow.
SPOILT = [
    ("dmp.dataset", None, {("dmp.dataset", "missing")}),
    ("dmp.dataset", [], {("dmp.dataset", "empty list")}),
    ("dmp.dataset", {"title": "t"}, {("dmp.dataset", "wrong kind")}),
    ("dmp.dataset.0.distribution", None, {("dmp.dataset[0].distribution", "missing")}),
    ("dmp.dataset.0.distribution", [], {("dmp.dataset[0].distribution", "empty list")}),
    ("dmp.dataset.0.distribution.0.license", None, {("dmp.dataset[0].distribution[0].license", "missing")}),
    ("dmp.dataset.0.distribution.0.license", [], set()),
    ("dmp.dataset.0.distribution.0.host", {"url": "u"}, {("dmp.dataset[0].distribution[0].host.title", "missing")}),
    ("dmp.dataset.0.distribution.0.host", None, set()),
    ("dmp.dataset.0.distribution.0.data_access", "ajar", {("dmp.dataset[0].distribution[0].data_access", "not allowed value")}),
    ("dmp.dataset.0.metadata", None, {("dmp.dataset[0].metadata", "missing")}),
    ("dmp.dataset.0.metadata", [], {("dmp.dataset[0].metadata", "empty list")}),
    ("dmp.contact.contact_id", None, {("dmp.contact.contact_id", "missing")}),
    ("dmp.contact.contact_id", [], set()),
    ("dmp.title", {"a": 1}, {("dmp.title", "wrong kind")}),
    ("dmp.extra", {"a": [{"b": 1}]}, {("dmp.extra", "extra")}),
    ("dmp.project", [{"title": "t", "funding": [{"funder_id": {}}]}], {
        ("dmp.project[0].description", "missing"), ("dmp.project[0].funding[0].funding_status", "missing"),
        ("dmp.project[0].funding[0].funder_id.identifier", "missing"), ("dmp.project[0].funding[0].funder_id.type", "missing"),
    }),
    ("dmp", None, {("dmp", "missing")}),
]


def test_conformance(spark):
    rows, want = [("r", "m", 1000, json.dumps(FORM)), ("r", "m", 1001, "{"), ("r", "m", 1002, None)], {}
    for i, (at, value, problems) in enumerate(SPOILT):
        record = json.loads(json.dumps(FORM))
        *way, last = at.split(".")
        node = record
        for step in way:
            node = node[int(step)] if step.isdigit() else node[step]
        if value is None:
            del node[last]
        else:
            node[last] = value
        rows.append(("r", "m", i, json.dumps(record)))
        want[i] = problems
    df = spark.createDataFrame(rows, "run string, model string, doc_id bigint, raw string")
    got = {}
    for r in J.conformance(J.record_nodes(df)).collect():
        got.setdefault(r.doc_id, set()).add((r.path, r.problem))
    assert got == {i: p for i, p in want.items() if p}


def test_depth_is_not_capped(spark):
    deep = '{"k1": {"k2": {"k3": {"k4": {"k5": {"k6": {"k7": {"k8": {"k9": {"k10": {"k11": [{"k12": "v [{\\" x"}]}}}}}}}}}}}'
    df = spark.createDataFrame([("r", "m", 1, deep), ("r", "m", 2, '{"a": 1}'), ("r", "m", 3, "{")], "run string, model string, doc_id bigint, raw string")
    path = ".".join(f"k{i}" for i in range(1, 12)) + "[0].k12"
    assert {(r.doc_id, r.path) for r in J.leaves(df).collect()} == {(1, path), (2, "a")}
    assert {(r.doc_id, r.path) for r in J.aligned_leaves(df, df.select("doc_id", "raw")).collect()} == {(1, path), (2, "a")}
    assert {r.key: r.n for r in J.key_census(df).collect()} == {f"k{i}": 1 for i in range(1, 13)} | {"a": 1}


def test_records_nested_hundreds_deep(spark):
    """Neither the plan nor the time grows with the depth of the deepest record."""
    deep = '{"k": [' * 250 + '"v"' + "]}" * 250
    df = spark.createDataFrame([("r", "m", 1, deep), ("r", "m", 2, '{"a": 1}')], "run string, model string, doc_id bigint, raw string")
    start = time.time()
    got = {r.doc_id: (r.field, r.verdict) for r in J.judge(df, df.select("doc_id", "raw")).collect()}
    assert got == {1: ("k[0]." * 249 + "k[0]", "Correct"), 2: ("a", "Correct")}
    assert {r.doc_id: r.path for r in J.leaves(df).collect()} == {1: "k[0]." * 249 + "k[0]", 2: "a"}
    assert {r.key: r.n for r in J.key_census(df).collect()} == {"k": 250, "a": 1}
    assert time.time() - start < 30


def test_leaves_of_odd_texts(spark):
    """Numbers keep the spelling of casts, a repeated key its last value, half a surrogate pair does no harm."""
    raws = ['{"a": 1, "a": "two"}', '{"n": -0, "f": 1.50, "e": 1e3, "b": false}', '{"s": "\\ud800x", "t": "\\ud83d\\ude00"}', '[{"x": 1}, 2]', '{"n": NaN}', "", None, "3"]
    df = spark.createDataFrame([("r", "m", i, x) for i, x in enumerate(raws)], "run string, model string, doc_id bigint, raw string")
    got = {(r.doc_id, r.path): r.value for r in J.leaves(df).collect()}
    assert got == {
        (0, "a"): "two", (1, "n"): "0", (1, "f"): "1.5", (1, "e"): "1000.0", (1, "b"): "false", (2, "s"): "?x", (2, "t"): "\U0001f600",
        (3, "[0].x"): "1", (3, "[1]"): "2", (7, ""): "3",
    }


def test_merge_takes_objects_only(spark):
    a = spark.createDataFrame([(1, '{"dmp": '), (2, "[1]"), (3, '{"a": 1}'), (4, '{"a": 1}')], "doc_id bigint, raw string")
    b = spark.createDataFrame([(1, '{"n": 2}'), (2, '{"n": 2}'), (3, "7"), (4, '{"n": 2}')], "doc_id bigint, raw string")
    got = {r.doc_id: (r.merged, r.reason) for r in J.merge_records(a, b).collect()}
    first, second = (None, "first record is not an object"), (None, "second record is not an object")
    assert got == {1: first, 2: first, 3: second, 4: ('{"a": 1, "n": 2}', None)}


def test_invalid_records(spark):
    raws = ['{"a": 1, "a": 2}', "[1]", "{", None, '{"a": {"b": 1, "b": [2]}}']
    df = spark.createDataFrame([(i, x) for i, x in enumerate(raws)], "doc_id bigint, raw string")
    good, bad = J.split_invalid(df)
    assert sorted(r.doc_id for r in good.collect()) == [0, 4]
    assert {r.doc_id: r.reason for r in bad.collect()} == {1: "not a JSON object", 2: "not valid JSON", 3: "not valid JSON"}
