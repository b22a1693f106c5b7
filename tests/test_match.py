"""Claims, best matches and joins against brute force, on both physical paths."""

import random
import re
import time

import pytest

from docstruct.operators import match as M
from docstruct.operators import metrics as A


def words(text):
    return set(re.sub("[^a-z0-9]", " ", text.lower()).split())


def share(a, b):
    return len(words(a) & words(b)) / len(words(a)) if words(a) else 0.0


def claims(gold, pred, threshold):
    used, out = set(), []
    for g, text in enumerate(gold):
        scored = [(share(p, text), -j) for j, p in enumerate(pred) if j not in used]
        best = max((x for x in scored if x[0] >= threshold and x[0] > 0), default=None)
        out.append((g, None if best is None else -best[1]))
        used |= {-best[1]} if best else set()
    return set(out) | {(None, j) for j in range(len(pred)) if j not in used}


def frames(spark, docs):
    gold = [(d, i, t, "title") for d, (g, _) in docs.items() for i, t in enumerate(g)]
    pred = [("r", d, i, t, "title") for d, (_, p) in docs.items() for i, t in enumerate(p)]
    random.Random(5).shuffle(pred)
    return (
        spark.createDataFrame(gold, "doc_id bigint, ord bigint, text string, label string"),
        spark.createDataFrame(pred, "tag string, doc_id bigint, ord bigint, text string, label string"),
    )


def random_docs(n, size, seed):
    rng = random.Random(seed)

    def text():
        return " ".join(rng.choice("abcde") for _ in range(rng.randint(0, 4)))

    return {d: ([text() for _ in range(rng.randint(1, size))], [text() for _ in range(rng.randint(1, size))]) for d in range(n)}


@pytest.mark.parametrize("threshold", [0.5, 0.75])
def test_claims_match_brute_force(spark, threshold):
    docs = random_docs(60, 9, 2)
    docs[100] = (["a b"] * 7 + ["a b c"] * 3, ["c a"] * 2 + ["a b"] * 5 + ["a"] * 6)
    gold, pred = frames(spark, docs)
    got = {}
    for r in M.greedy_match(gold, pred, threshold).collect():
        got.setdefault(r.doc_id, set()).add((r.gold_ord, r.pred_ord))
    assert got == {d: claims(g, p, threshold) for d, (g, p) in docs.items()}


def test_long_chain_of_claims(spark):
    """Each gold item may take one of two predictions, and the first choice decides all others."""
    n = 5_000
    gold = [f"a{i} a{i + 1} a{i + 2}" for i in range(n)]
    pred = [f"a{i + 1} a{i + 2}" for i in range(-1, n)]
    g, p = frames(spark, {1: (gold, pred)})
    start = time.time()
    got = {(r.gold_ord, r.pred_ord) for r in M.greedy_match(g, p).collect()}
    assert time.time() - start < 60
    assert got == {(i, i) for i in range(n)} | {(None, n)}


def test_claims_of_many_copies(spark):
    """Copies are pairs of classes, not of rows."""
    g, p = frames(spark, {1: (["same text"] * 3_000, ["text same"] * 4_000)})
    got = [(r.gold_ord, r.pred_ord) for r in M.greedy_match(g, p).collect()]
    assert sorted(x for x in got if x[0] is not None) == [(i, i) for i in range(3_000)] and len(got) == 4_000


def test_equal_gold_items_claim_once(spark):
    gold, pred = frames(spark, {1: (["same text", "same text"], ["same text"])})
    rows = {(r.gold_ord, r.pred_ord) for r in M.greedy_match(gold, pred).collect()}
    assert rows == {(0, 0), (1, None)}


def test_empty_prediction_is_scored_when_listed(spark):
    gold, pred = frames(spark, {1: (["a"], [])})
    docs = spark.createDataFrame([("r", 1)], "tag string, doc_id bigint")
    assert [(r.gold_ord, r.pred_ord) for r in M.greedy_match(gold, pred, docs=docs).collect()] == [(0, None)]


def test_best_label_with_copies_and_ties(spark):
    docs = random_docs(40, 8, 9)
    gold, pred = frames(spark, docs)
    for r in M.best_label(pred, gold, 0.6).collect():
        g = docs[r.doc_id][0]
        best = max(range(len(g)), key=lambda i: (share(r.text, g[i]), -i))
        assert r.gold_ord == (best if share(r.text, g[best]) >= 0.6 else None)


def test_strict_labels(spark):
    docs = random_docs(60, 7, 4)
    gold, pred = frames(spark, docs)
    for r in M.true_label_strict(pred, gold).collect():
        g = docs[r.doc_id][0]
        best = max(range(len(g)), key=lambda i: (share(r.text, g[i]), -i))
        two = any(i != best and len(words(t)) >= 2 and share(t, r.text) >= 0.9 for i, t in enumerate(g))
        known = len(words(r.text)) >= 3 and share(r.text, g[best]) >= 0.75 and not two
        assert (r.true_label is not None) == known


@pytest.mark.parametrize("threshold", [0.5, 0.75, 1.0])
def test_containment_join(spark, threshold):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 6))) for _ in range(70)]
    left = spark.createDataFrame(list(enumerate(texts[:30])), "id bigint, text string")
    right = spark.createDataFrame(list(enumerate(texts[20:])), "id bigint, text string")
    got = {(r.left_id, r.right_id) for r in M.containment_join(left, right, threshold).collect()}
    assert got == {(i, j) for i, a in enumerate(texts[:30]) for j, b in enumerate(texts[20:]) if words(a) and share(a, b) >= threshold}


def test_swallowed(spark):
    docs = random_docs(40, 8, 21)
    gold, pred = frames(spark, docs)
    got = {(r.doc_id, r.ord, r.gold_ord, r.best_ord) for r in M.swallowed(gold, pred).collect()}
    want = set()
    for d, (g, p) in docs.items():
        for j, text in enumerate(p):
            best = max(range(len(g)), key=lambda i: (share(text, g[i]), -i))
            want |= {(d, j, i, best) for i, one in enumerate(g) if words(one) and words(one) <= words(text)}
    assert got == want


def test_closest_fills_with_zero_scores(spark):
    docs = random_docs(25, 6, 12)
    gold, pred = frames(spark, docs)
    got = {}
    for r in M.closest(gold, pred, 3).collect():
        got.setdefault((r.doc_id, r.gold_ord), []).append((r.rank, r.ord))
    for (d, g), ranked in got.items():
        p = docs[d][1]
        want = sorted(range(len(p)), key=lambda j: (-share(p[j], docs[d][0][g]), j))[:3]
        assert [j for _, j in sorted(ranked)] == want


def test_micro_scores(spark):
    conf = spark.createDataFrame(
        [("a", "title", "title", 2), ("a", "__no_gold__", "title", 8), ("b", "title", "title", 1), ("b", "title", "__missed__", 3), ("c", "title", "title", 2), ("c", "__no_gold__", "title", 100)],
        "tag string, true_label string, pred_label string, n bigint",
    )
    micro = {r.tag: (round(r.precision, 3), round(r.recall, 3)) for r in A.micro_prf(conf).collect()}
    assert micro["a"] == (0.2, 1.0) and micro["b"] == (1.0, 0.25)
    gold = {r.tag: (r.correct, r.total_gold) for r in A.gold_metrics(conf).collect()}
    assert gold["c"] == (2, 2)


def test_grounding(spark):
    values = spark.createDataFrame([(1, "Soil, water"), (1, "unknown"), (1, ""), (1, "soil moon mars venus"), (1, "water soil air rock sun")], "doc_id int, value string")
    docs = spark.createDataFrame([(1, "The soil - water and air; rock.")], "doc_id int, text string")
    assert [r.grounding for r in M.grounding(values, docs).collect()] == ["grounded", "placeholder", "empty", "invented", "grounded"]
