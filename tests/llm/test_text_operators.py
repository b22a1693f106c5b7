"""Operators over documents against brute force, with nulls, blanks, ties and repeats."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docstruct.llm import components as C
from docstruct.llm import exact_dedup, line_dedup, licenses, mixing, ngram_join, pieces, quality

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, rep bigint, id string, token string"


def frame(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "x", "y") for i, t in rows], DOCS)


def prose(rng, n, words=60):
    return " ".join(f"w{int(rng.paretovariate(0.7)) % words}" for _ in range(n))


def near_docs(seed=3):
    """Families of edited copies around bases of several lengths, short and blank texts, repeats."""
    rng = random.Random(seed)
    rows = []
    for base in (12, 25, 60, 200, 900):
        words = [f"v{rng.randrange(5000)}" for _ in range(base)]
        for edits in (0, 0, 0, 1, 1, 2, 3, 5, 9):
            copy = list(words)
            for _ in range(edits):
                copy[rng.randrange(base)] = f"e{rng.randrange(9999)}"
            rows.append(" ".join(copy) if edits != 3 else "  ".join(copy).upper())
    rows += ["", None, " \t\n", "one", "one two", "One  TWO", "one two three", "a b a b a b a b", "a b a b"]
    ids = list(range(10, 10 + len(rows)))
    rng.shuffle(ids)
    return list(zip(ids, rows))


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) >= k:
        return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}
    return {tuple(words)} if words else set()


def brute_components(rows, k, num, den):
    sets, parent = {i: shingles(t, k) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                shared = len(sets[a] & sets[b])
                if shared * den >= (len(sets[a]) + len(sets[b]) - shared) * num:
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("k,num,den,rare", [(3, 9, 10, 64), (5, 4, 5, 64), (3, 9, 10, 1), (2, 4, 5, 2)])
def test_ngram_components(spark, k, num, den, rare):
    rows = near_docs()
    got = ngram_join.ngram_components(frame(spark, rows), words=k, num=num, den=den, rare=rare).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, k, num, den)


def test_ngram_tiles_copy_open_sets_only(spark, monkeypatch):
    """With blocks of 3 sets every frequent tile has many blocks: what passes by all of them are the open sets."""
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    plans, exact = [], ngram_join._exact
    monkeypatch.setattr(ngram_join, "_exact", lambda docs, pairs, *a: plans.append(pairs._jdf.queryExecution().optimizedPlan().toString()) or exact(docs, pairs, *a))
    rows = near_docs()
    got = ngram_join.ngram_components(frame(spark, rows), words=3, num=9, den=10, rare=1).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, 3, 9, 10)
    near, far = plans
    assert "explode(bands_" not in near  # no row per pair of bands
    assert re.search(r"Generate explode\(concat\(.*CASE WHEN open", far)


def test_ngram_edges(spark):
    rows = [(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (9, None)]
    got = sorted(ngram_join.ngram_components(frame(spark, rows), words=3).collect(), key=str)
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in got) == [("4", 2, 4), ("4", 2, 4), ("9", 0, 9), ("None", 2, 4)]
    assert ngram_join.ngram_components(frame(spark, []), words=3).count() == 0


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(200)] + [(500, i) for i in range(501, 560)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in C.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(201)} | {i: 500 for i in range(500, 560)}


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_duplicates(spark, keep):
    rng = random.Random(1)
    texts = ["", None, "x", "x ", "é", "é", "same " * 2000] + [prose(rng, 30) for _ in range(20)]
    rows = [(i, rng.choice(texts) if i % 3 else "hot") for i in range(400)]
    got = exact_dedup.exact_duplicates(frame(spark, rows), keep=keep).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    pick = max if keep == "largest" else min
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == {
        (i, pick(groups[t or ""]), len(groups[t or ""]), i == pick(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows
    }


def test_exact_duplicates_edges(spark):
    got = exact_dedup.exact_duplicates(frame(spark, [(None, "a"), (3, "a"), (3, "a"), (None, "b")]), keep="largest").collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in got) == [
        ("3", "3", 3, False), ("3", "3", 3, True), ("None", "3", 3, False), ("None", "None", 1, True)
    ]
    assert exact_dedup.exact_duplicates(frame(spark, [])).count() == 0


def test_lines(spark):
    rng = random.Random(2)
    base = [prose(rng, n) for n in (1, 2, 4, 5, 9, 20, 40, 90)]
    rows = []
    for i in range(40):
        lines = []
        for line in rng.sample(base, 4):
            words = line.split()
            if len(words) > 4 and rng.random() < 0.6:
                words[rng.randrange(len(words))] = f"n{rng.randrange(99)}"
            lines.append(" ".join(words).upper() if rng.random() < 0.2 else " ".join(words))
        rows.append((i, "\n".join(lines + ["", " "])))
    rows += [(90, None), (91, ""), (92, base[5])]
    got = line_dedup.duplicate_lines(frame(spark, rows)).collect()
    lines = [(i, k, frozenset(x.lower().split())) for i, t in rows for k, x in enumerate((t or "").split("\n"))]
    want = {}
    for i, k, s in lines:
        near = [(j, m) for j, m, u in lines if s and u and (j, m) < (i, k) and 5 * len(s & u) >= 4 * len(s | u)]
        want[i, k] = min(near) if near else None
    assert {(r.doc_id, r.line_no): None if r.kept else (r.match_id, r.match_line) for r in got} == want
    texts = {r.doc_id: r.text for r in line_dedup.without_lines(frame(spark, rows), spark.createDataFrame(got)).collect()}
    for i, t in rows:
        assert texts[i] == (t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if want[i, k] is None))
    assert line_dedup.duplicate_lines(frame(spark, [])).count() == 0


def test_licenses(spark):
    rng = random.Random(4)
    templates = licenses.default_templates()
    rows, want = [(0, None), (1, ""), (2, "released under the"), (None, "x released UNDER the mit-license y")], {(None, "MIT")}
    for i in range(3, 60):
        words = [f"q{rng.randrange(300)}" for _ in range(rng.randrange(0, 400))]
        name, body = rng.choice(templates)
        at = rng.randrange(len(words) + 1)
        rows.append((i, " ".join(words[:at]) + "\n" + body + "\n" + " ".join(words[at:])))
        want.add((i, name))
    got = licenses.scan_licenses(frame(spark, rows), licenses.template_table(spark)).collect()
    found = {(r.doc_id, r.license) for r in got}
    assert want <= found
    split = lambda x: [w for w in re.split(r"[\W_]+", (x or "").lower()) if w]
    for i, t in rows:  # and nothing is found that is not contained
        have = {tuple(split(t)[k : k + 5]) for k in range(len(split(t)) - 4)}
        for name in {n for j, n in found if j == i}:
            sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for n, b in templates if n == name for w in [split(b)]]
            assert any(len(s & have) >= 0.8 * len(s) for s in sets)
    assert min(licenses.collision_probability(1 / 16), licenses.collision_probability(0.2)) > 0.999
    assert licenses.scan_licenses(frame(spark, []), licenses.template_table(spark)).count() == 0
    assert licenses.scan_licenses(frame(spark, rows), licenses.template_table(spark, [("none", "too short")])).count() == 0


def test_licenses_of_few_words(spark):
    filler = " ".join(f"q{i}" for i in range(100))
    rows = [
        (1, filler + "\nAll rights reserved."), (2, "All rights reserved."), (3, filler + " all rights"), (4, "rights reserved all"), (5, f"{filler} MIT License {filler}"),
        (6, "// SPDX-License-Identifier: Apache-2.0\n" + filler), (7, "Apache-2.0"), (8, "all\nreserved rights"), (9, f"{filler} BSD-3-Clause"), (10, "mit"),
    ]
    got = {(r.doc_id, r.license): (r.first_word, r.last_word, r.containment) for r in licenses.scan_licenses(frame(spark, rows), licenses.template_table(spark)).collect()}
    assert got == {
        (1, "proprietary"): (100, 102, 1.0), (2, "proprietary"): (0, 2, 1.0), (5, "MIT"): (100, 101, 1.0), (6, "Apache-2.0"): (0, 5, 1.0),
        (7, "Apache-2.0"): (0, 2, 1.0), (9, "BSD"): (100, 102, 1.0),
    }
    own = licenses.template_table(spark, [("one", "Foo"), ("blank", " -- "), ("four", "a b c d"), ("five", "a b c d e")])
    assert {(r.doc_id, r.license) for r in licenses.scan_licenses(frame(spark, [(1, "x foo"), (2, "a b c d"), (3, "z a b c d e")]), own).collect()} == {
        (1, "one"), (2, "four"), (3, "four"), (3, "five")
    }
    assert licenses.scan_licenses(frame(spark, rows), licenses.template_table(spark, [])).count() == 0


def test_licenses_of_rows_that_share_an_identifier(spark):
    first, second = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [(None, "x " + first), (None, "x " + second), (1, second), (1, first), (1, "x y z")]
    got = licenses.scan_licenses(frame(spark, rows).repartition(5), licenses.template_table(spark)).collect()
    assert {(r.doc_id, r.license) for r in got} == {(i, n) for i in (None, 1) for n in ("MIT", "Apache-2.0")} and len(got) == 4


def test_mixing_matches_the_dense_solution(spark):
    rng = np.random.default_rng(0)
    p = rng.dirichlet([0.3, 0.2, 0.1], 300)
    tokens = rng.integers(1, 2000, 300)
    table = spark.createDataFrame([(int(t), [float(x) for x in row]) for t, row in zip(tokens, p)], "tokens bigint, posterior array<double>")
    weights = {"a": 0.5, "b": 0.3, "c": 0.2}
    for whole, most in ((None, None), ("a", 1.0), ("c", None)):
        rate, target = mixing.fitted_rate(table, weights, whole, most, steps=8)
        got = np.array([r[0] for r in table.select(rate).collect()])
        goal = np.array(list(target.values()))
        dense = np.ones(300)
        scale = 1 / goal
        step = 1 / np.linalg.eigvalsh(np.sqrt(scale)[:, None] * (p.T @ (tokens[:, None] * p)) * np.sqrt(scale)).max()
        for _ in range(8):
            off = (dense * tokens) @ p - goal
            if np.abs(off).max() <= mixing.TOLERANCE * goal.sum():
                break
            dense = np.clip(dense - p @ (step * scale * off), 0, most)
        assert np.allclose(got, dense) and (got >= 0).all()
    rate, target = mixing.fitted_rate(table, weights, "c")
    got = np.array([r[0] for r in table.select(rate).collect()])
    assert np.allclose((got * tokens) @ p, list(target.values()), rtol=1e-3)


def test_mixing_with_a_zero_weight_and_too_much_of_a_domain(spark):
    rng = np.random.default_rng(1)
    kind = rng.choice(3, 400, p=[0.6, 0.1, 0.3])
    p = np.stack([rng.dirichlet([20 if k == d else 0.6 for k in range(3)]) for d in kind])
    tokens = rng.integers(1, 2000, 400)
    table = spark.createDataFrame([(int(t), [float(x) for x in row]) for t, row in zip(tokens, p)], "tokens bigint, posterior array<double>")
    with pytest.warns(UserWarning, match="out of reach"):
        rate, target = mixing.fitted_rate(table, {"clean": 0.98, "rough": 0.0, "toxic": 0.02}, "clean", 1.0)
    got, goal = np.array([r[0] for r in table.select(rate).collect()]), np.array(list(target.values()))
    scale = 1 / np.maximum(goal, mixing.FLOOR * goal.sum())
    off = (got * tokens) @ p - goal
    # No rate within its bounds can be changed to less: the gap to the minimum is closed.
    slope = p @ (scale * off)
    assert (tokens * slope * (got - (slope < 0))).sum() <= 1e-3 * (scale * off * off).sum()
    totals = off + goal
    assert totals[2] < 0.05 * totals.sum() and totals[1] < 0.03 * totals.sum() and (tokens @ p)[2] > 0.25 * tokens.sum()
    assert got[kind == 0].mean() > 0.8 and got[kind == 2].max() < 0.5
    hard = spark.createDataFrame([(100, [1.0, 0.0, 0.0])] * 9 + [(50, [0.0, 0.0, 1.0])] * 9 + [(30, [0.0, 1.0, 0.0])], "tokens bigint, posterior array<double>")
    rate, target = mixing.fitted_rate(hard, {"clean": 0.98, "rough": 0.0, "toxic": 0.02}, "clean", 1.0)
    rows = hard.select("tokens", "posterior", rate.alias("rate")).collect()
    for k, goal in enumerate(target.values()):
        assert abs(sum(r.rate * r.tokens * r.posterior[k] for r in rows) - goal) < 1e-3 * sum(target.values())


def test_mixing_edges(spark):
    rows = [(1, "good words here"), (1, "good words here"), (None, None), (3, ""), (4, "bad stuff"), (5, "good words again")]
    labels = spark.createDataFrame([(1, "a"), (4, "b"), (5, "a"), (5, "b"), (None, "a"), (9, "b"), (3, None), (4, "zzz")], "doc_id bigint, domain string")
    got = mixing.mixed(frame(spark, rows), labels, {"a": 0.5, "b": 0.5}).collect()
    assert len(got) == 6 and all(abs(sum(r.posterior) - 1) < 1e-9 and r.rate >= 0 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[1].posterior[0] > 0.6 > 0.4 > by[4].posterior[0] and by[None].tokens == 0
    assert mixing.mixed(frame(spark, []), labels, {"a": 1.0}).count() == 0
    assert all(r.rate == 1 for r in mixing.mixed(frame(spark, [(1, ""), (2, None)]), labels, {"a": 0.5, "b": 0.5}).collect())


def test_mixing_learns_from_labels_of_its_documents(spark):
    docs = frame(spark, [(1, "good words here"), (2, "bad stuff"), (3, "")])
    schema = "doc_id bigint, domain string"
    near = spark.createDataFrame([(1, "a"), (2, "b")], schema)
    more = near.unionByName(spark.createDataFrame([(i, "b") for i in range(100, 180)], schema))
    want = {r.doc_id: r.posterior for r in mixing.domain_posteriors(docs, near, ["a", "b"]).collect()}
    got = {r.doc_id: r.posterior for r in mixing.domain_posteriors(docs, more, ["a", "b"], max_training=2).collect()}
    assert got == want and np.allclose(got[3], 0.5)


def test_quality_ranks_and_holds_out(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, 80) if i % 4 else " ".join(f"{w.upper()}!!" for w in prose(rng, 80).split())) for i in range(300)] + [(900, ""), (901, None), (None, "a b")]
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(300)] + [(900, None), (None, 1), (5, 0)], "doc_id bigint, quality int")
    held = F.col("doc_id") % 3 == 0
    got = quality.scored(frame(spark, rows), labels, held).collect()
    assert len(got) == 303 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    unseen = [r for r in got if r.held_out and r.doc_id < 300]
    assert unseen and all(r.predicted == int(r.doc_id % 4 > 0) for r in unseen)
    none = quality.scored(frame(spark, rows[:5]), labels.limit(0), held).collect()
    assert all(abs(r.score - 0.7) < 1e-9 for r in none)
    assert quality.scored(frame(spark, []), labels, held).count() == 0


def test_bradley_terry_gradient_is_zero_at_the_fit():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, quality.FEATURES))
    y = (x[:, 0] + rng.normal(size=60) > 0).astype(int)
    m = quality.fit(x, y)
    z = ((x - m.mean) / m.scale).clip(-8, 8)
    d = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, quality.FEATURES)
    gradient = -(d / (1 + np.exp(d @ m.weights))[:, None]).mean(0) + 1e-3 * m.weights
    assert np.abs(gradient).max() < 1e-6
    assert abs((m.score(x) < 0.7).mean() - (y == 0).mean()) < 0.03


def test_pieces_round_trip(spark):
    text = "  Hello  world\n\tx é %%% ▁ 日本語 😀 <s> </s>\x00 " + "long" * 500
    rows = [(1, text), (2, text), (1, text), (3, ""), (4, None), (None, "a  b ")]
    out = pieces.decode(pieces.encode(frame(spark, rows), dropout=0.3)).collect()
    assert [r.decoded for r in out] == [t or "" for _, t in rows]
    by = defaultdict(set)
    for r in out:
        by[r.doc_id].add(tuple(r.token_ids))
    assert len(by[1]) == 1 and by[1] != by[2] and all(r.n_tokens == len(r.token_ids) for r in out)
    again = pieces.encode(frame(spark, rows).repartition(3), dropout=0.3).where("doc_id = 2").first()
    assert tuple(again.token_ids) in by[2]
    assert pieces.encode(frame(spark, [])).count() == 0
    raw = spark.sql("SELECT 1L AS doc_id, cast(X'61FF20C328E29681' AS string) AS text")
    back = pieces.decode(pieces.encode(raw)).select(F.hex(F.col("decoded").cast("binary"))).first()[0]
    assert back == "61FF20C328E29681"


def test_pieces_skip_by_occurrence():
    model = pieces.Pieces(pieces.MODEL)
    unit = next(u for u in (pieces.SPACE + w for w in ("to", "of", "in", "is")) if model.merge(u, 0, 0) == (model.ids[u],))
    n, limit = 20_000, int(0.1 * 2**32)
    encoder = pieces.Encoder(model, 0.1, 1)
    text = " ".join([unit[1:]] * n)
    (ids,) = encoder.encode([text], [7])
    # Each occurrence draws on its own: whole as often as over random keys.
    rng = random.Random(7)
    chance = sum(model.merge(unit, rng.randrange(2**32), limit) == (model.ids[unit],) for _ in range(n)) / n
    assert abs(sum(i == model.ids[unit] for i in ids) / n - chance) < 0.01
    word = pieces.SPACE + "internationalization"
    many = set()
    for d in range(400):
        many.add(tuple(encoder.encode([word[1:]], [d])[0]))
    assert len(many) > 8
    for text in ("".join(rng.choice("aeinrst lo,日\ud800") for _ in range(3000)), "lorem" * 60 + " and lorem " + "日本" * 30):
        keys = encoder._keys(9, len(units := model.unit.findall(model.escaped(text)))).tolist()
        want = [i for u, k in zip(units, keys) for i in model.merge(u, k, limit)]
        assert encoder.encode([text], [9]) == [want]
        for other in (encoder.encode(["a b", text, ""], [1, 9, 2])[1], pieces.Encoder(model, 0.1, 1).encode([text], [9])[0]):
            assert other == want
    for length in (2, 5, 13):
        some = ["".join(rng.choice("▁aeinrstlo,日\ud800") for _ in range(length)) for _ in range(300)]
        keys = [rng.randrange(2**32) for _ in some]
        for chance in (0, limit, 6 * limit):
            assert model.merge_many(some, keys, chance)[0] == [model.merge(u, k, chance) for u, k in zip(some, keys)]


def test_pieces_hold_little_per_unit(spark):
    import tracemalloc

    encoder = pieces.Encoder(pieces.Pieces(pieces.MODEL), 0.1, 1)
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choice("aeinrstlo") for _ in range(8)) for _ in range(4000)) for _ in range(5)]
    tracemalloc.start()
    want = encoder.encode(texts, [1, 2, 3, 4, 5])
    held = tracemalloc.get_traced_memory()[0] - sum(8 * len(x) for x in want)
    tracemalloc.stop()
    n = len(encoder.known[0])
    assert n > 19_000 and held < 500 * n  # as tuples: 672 bytes a unit
    both = [(i, t) for i, t in enumerate(["a  b ", "", None, "日本 ▁ ü" * 3])]
    out = pieces.encode(frame(spark, both), dropout=0.3, decoded="back").collect()
    assert [r.back for r in out] == [t or "" for _, t in both]
    assert [r.token_ids for r in out] == [r.token_ids for r in pieces.encode(frame(spark, both), dropout=0.3).collect()]


def test_pieces_without_dropout_are_the_library_s():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    encoder = pieces.Encoder(pieces.Pieces(pieces.MODEL), 0.0, 1)
    rng = random.Random(6)
    letters = "abcdefghij eiou  \n\té日%&.,AZ09"
    for _ in range(300):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
        assert encoder.encode([text], [1]) == [library.encode(text)]
    for dropout in (0.0, 0.1, 0.6):  # many units at a time are merged as one by one
        one, many = (pieces.Encoder(encoder.pieces, dropout, 3) for _ in "ab")
        units = {(v, "".join(rng.choice("▁aeinrstlo,日\ud800") for _ in range(n))) for v in range(one.variants) for n in range(1, 14) for _ in range(40)}
        many._learn(units)
        for v, u in units:
            one._learn({(v, u)})
        assert one.known == many.known
