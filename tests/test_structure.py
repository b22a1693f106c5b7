"""Nesting, runs and rules: golden cases, and random documents against plain folds."""

import random

import pytest

from docstruct.labels import LABELS
from docstruct.operators import blocks as B
from docstruct.operators import nest as N
from docstruct.operators import rules as R

T, S, D, Q, A = LABELS
SCHEMA = "tag string, doc_id bigint, pos bigint, text string, label string, confidence double, page int"


def blocks(spark, docs):
    rows = [("t", d, i, text, label, 0.5 + i / 100, None) for d, items in docs.items() for i, (label, text) in enumerate(items)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def collected(slots):
    out = {}
    for r in slots.collect():
        out.setdefault(r.doc_id, set()).add((r.sec, r.q, r.slot, r.text))
    return out


def fold(items):
    """The nesting rules step by step, in the words of the survey."""
    titles, sections = [], []
    question = None
    for label, text in items:
        text = text.strip()
        if not text or label not in LABELS:
            continue
        if label == T:
            if not titles or not sections:
                titles.append(text)
                continue
            label = A
        if label == S:
            sections.append({"title": text, "about": [], "asked": []})
            question = None
            continue
        if not sections:
            sections.append({"title": None, "about": [], "asked": []})
        if label == D:
            place = sections[-1]["about"] if question is None else question["a"] if question["a"] else question["q"]
            place.append(text)
            continue
        if question is None or (label == Q and question["a"]):
            question = {"q": [], "a": []}
            sections[-1]["asked"].append(question)
        question["q" if label == Q else "a"].append(text)
    out = {(0, 0, T, " ".join(titles))} if titles else set()
    for i, s in enumerate(sections, 1):
        if s["title"] is not None:
            out.add((i, 0, S, s["title"]))
        if s["about"]:
            out.add((i, 0, D, "\n".join(s["about"])))
        for j, x in enumerate(s["asked"], 1):
            out |= {(i, j, k, "\n".join(x[p])) for k, p in ((Q, "q"), (A, "a")) if x[p]}
    return out


GOLDEN = {
    1: ([(T, "one"), (T, "two"), (S, "s"), (Q, "q"), (A, "a")], {(0, 0, T, "one two"), (1, 0, S, "s"), (1, 1, Q, "q"), (1, 1, A, "a")}),
    2: ([(T, "t"), (S, "s"), (A, "a"), (T, "late")], {(0, 0, T, "t"), (1, 0, S, "s"), (1, 1, A, "a\nlate")}),
    3: ([(S, "s"), (Q, "q1"), (Q, "q2"), (A, "a"), (Q, "q3")], {(1, 0, S, "s"), (1, 1, Q, "q1\nq2"), (1, 1, A, "a"), (1, 2, Q, "q3")}),
    4: ([(A, "alone")], {(1, 1, A, "alone")}),
    5: ([(S, "s"), (D, "d1"), (Q, "q"), (D, "d2"), (A, "a"), (D, "d3")], {(1, 0, S, "s"), (1, 0, D, "d1"), (1, 1, Q, "q\nd2"), (1, 1, A, "a\nd3")}),
    6: ([(S, "s"), (A, "  "), ("other", "x"), (Q, "q")], {(1, 0, S, "s"), (1, 1, Q, "q")}),
    7: ([(S, "a"), (Q, "q"), (A, "x"), (S, "b"), (Q, "r"), (A, "y"), (Q, "z"), (A, "w")],
        {(1, 0, S, "a"), (1, 1, Q, "q"), (1, 1, A, "x"), (2, 0, S, "b"), (2, 1, Q, "r"), (2, 1, A, "y"), (2, 2, Q, "z"), (2, 2, A, "w")}),
}


def random_docs(n, length, seed):
    rng = random.Random(seed)
    return {d: [(rng.choice([*LABELS, "other"]), rng.choice(["", " x ", f"w{i}", f"v{i}"])) for i in range(rng.randint(0, length))] for d in range(n)}


def test_golden_documents(spark):
    got = collected(N.nest(blocks(spark, {d: items for d, (items, _) in GOLDEN.items()})))
    for d, (items, want) in GOLDEN.items():
        assert got[d] == want == fold(items), d


@pytest.mark.parametrize("chunks", [None, 5])
def test_random_documents_match_the_fold(spark, chunks):
    docs = random_docs(150, 14, 7)
    docs[999] = [(random.Random(3).choice(LABELS), f"hot{i}") for i in range(10)] * 12
    got = collected(N.nest(blocks(spark, docs), chunks=chunks))
    assert got == {d: fold(items) for d, items in docs.items() if fold(items)}


def test_one_long_document_among_short_ones(spark, monkeypatch):
    """Only the long one is cut; the others keep to one shuffle, and no checkpoint holds a text."""
    from docstruct.operators import ordered

    held = []
    real = ordered.cut_lineage
    monkeypatch.setattr(ordered, "cut_lineage", lambda df: held.append(df.columns) or real(df))
    for module in (N, ordered):
        monkeypatch.setattr(module, "CHUNK_ROWS", 30)
    monkeypatch.setattr(N, "chunks_for", lambda df, keys: ordered.chunks_for(df, keys, 30))
    docs = random_docs(25, 12, 5) | {99: [x for d in random_docs(20, 12, 6).values() for x in d]}
    assert collected(N.nest(blocks(spark, docs))) == collected(N.nest(blocks(spark, docs), chunks=None))
    assert held and not [c for c in held if "text" in c]


@pytest.mark.parametrize("chunks", [None, 4])
def test_join_runs(spark, chunks):
    docs = {1: [(Q, "a"), (Q, "b"), (A, "c"), (None, "d"), (None, "e"), (A, "f")], 2: [(A, "x")] * 9}
    rows = B.join_runs(blocks(spark, docs), chunks=chunks).orderBy("doc_id", "pos").collect()
    assert [(r.doc_id, r.label, r.text, r.n_blocks) for r in rows] == [
        (1, Q, "a b", 2), (1, A, "c", 1), (1, None, "d e", 2), (1, A, "f", 1), (2, A, " ".join("x" * 9), 9)
    ]
    assert rows[0].confidence == 0.5
    runs = {r.doc_id: r.n_runs for r in B.label_runs(blocks(spark, docs), chunks=chunks).collect()}
    assert runs == {1: 4, 2: 1}


def test_rules_follow_the_table(spark):
    """Every emptiness pattern, on trees, by the 16 rows; short and long documents alike."""
    rows, want = [], {}
    for n in range(16):
        doc, head, about, ask = ("x" + c if n >> b & 1 else " " if c == "s" else "" for b, c in ((3, "t"), (2, "s"), (1, "d"), (0, "q")))
        question = {"text": ask, "order": 1, "answer": {"text": None, "json": {"type": "textArea", "answer": "ans", "meta": None}}}
        section = {"title": head, "description": about, "order": 1, "question": [question]}
        rows.append(("t", n, {"download_url": "", "template": {"title": doc, "description": "", "version": "v1", "section": [section]}}))
        values = {T: doc, S: head.strip(), D: about, Q: ask}
        state = "".join("N" if values[k] else "E" for k in (T, S, D, Q))
        after = dict(values)
        for source, target in R.RULE_ACTIONS.get(state, []):
            after[target] = values[source]
        want[n] = (after[S], after[Q])
    docs = spark.createDataFrame(rows, f"tag string, doc_id bigint, narrative {N.NARRATIVE_DDL}")
    for long_docs in (False, True):
        after = N.to_questions(R.apply_rules(N.from_structured(docs), long_docs=long_docs), long_docs=long_docs)
        assert {r.doc_id: (r.sec_title.strip(), r.question) for r in after.collect()} == want


def test_long_and_short_documents_agree(spark):
    slots = N.nest(blocks(spark, random_docs(120, 12, 11)), chunks=None)
    for build in (
        lambda flag: N.to_items(R.apply_rules(slots, long_docs=flag), dedup=True, long_docs=flag),
        lambda flag: N.to_questions(slots, long_docs=flag),
        lambda flag: R.fill(N.to_questions(slots, long_docs=flag), long_docs=flag),
    ):
        assert sorted(build(False).collect()) == sorted(build(True).collect())


def test_items_keep_or_drop_repeated_headings(spark):
    slots = N.nest(blocks(spark, {1: [(S, "Sharing"), (Q, "Sharing"), (A, "yes")]}))
    assert [r.label for r in N.to_items(slots).orderBy("ord").collect()] == [S, A]
    assert [r.label for r in N.to_items(slots, dedup=False).orderBy("ord").collect()] == [S, Q, A]


def test_parse_answers(spark):
    raw = spark.createDataFrame(
        [(1, '```json\n[{"text": "a\\nb", "label": "title"}]\n```'), (2, '{"n": 1, "labels": [{"text": "x"}, {"text": "y", "label": null}]}'), (3, "[{"), (4, None), (5, '{"n": 2}')],
        "doc_id int, raw string",
    )
    got = {r.doc_id: ([tuple(b) for b in r.blocks], r.reason) for r in B.parse_blocks_json(raw).collect()}
    assert got[1] == ([("a\nb", T)], None)
    assert got[2] == ([("x", A), ("y", None)], None)
    assert [got[i][1] for i in (3, 4, 5)] == ["not valid JSON", "empty response", "no list in the response"]


def test_bad_entries_cost_only_themselves(spark):
    from docstruct.operators.blocks import parse_blocks_json

    raw = ['{"note": "[draft]", "labels": [{"text": "a", "label": "title"}]}', '[{"text": "a"}, 5, {"text": "b", "label": null}, [1]]', '{"x": "[\\"a\\"]"}', '{"b": [], "a": [{"text": "z"}]}']
    got = parse_blocks_json(spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, raw string")).orderBy("i").collect()
    assert [[(b.text, b.label) for b in r.blocks] for r in got] == [[("a", "title")], [("a", "answer.text"), ("b", None)], [], []]
    assert [r.bad_entries for r in got] == [[], [1, 3], [], []] and [r.reason for r in got] == [None, None, "no list in the response", None]


def test_repeated_keys_count_with_their_last_value(spark):
    from docstruct.operators.blocks import parse_blocks_json

    raws = [
        '{"a": 1, "a": [{"text": "x", "text": "y", "label": "title"}]}', '```json\n[{"text": "a", "text": "é"}]\n```', '{"a": [], "a": 2}',
        '[{"text": "a", "text": ]', '[{"text": NaN, "text": 1}]', None,
    ]
    got = parse_blocks_json(spark.createDataFrame([(i, x) for i, x in enumerate(raws)], "i int, raw string")).orderBy("i").collect()
    assert [([tuple(b) for b in r.blocks], r.reason) for r in got] == [
        ([("y", "title")], None), ([("é", "answer.text")], None), ([], "no list in the response"), ([], "not valid JSON"), ([], "not valid JSON"), ([], "empty response"),
    ]
