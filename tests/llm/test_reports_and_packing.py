"""Phrase mining, filter audit and packing against brute force, with nulls, blanks, ties, repeats and long texts."""

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from docstruct.llm import filter_audit, packing, phrases
from docstruct.llm.queries import packing_tokenizer

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, a bigint, h string, words string, task bigint, part string"


def frame(spark, rows):
    """Documents (id, text, lang, source) with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 1, 1, "x", "y", 2, "z") for r in rows], DOCS)


def texts(seed, n=160):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["É", "naïve", "don't", "A-B", "C#", "The"]
    rows = []
    for i in range(n):
        some = [words[int(rng.paretovariate(0.6)) % len(words)] for _ in range(rng.randrange(1, 90))]
        if i % 3 == 0:
            some[2:2] = ["New", "york", "city", "hall"]
        joined = "".join(w + rng.choice([" ", " ", "  ", "\t", ". ", ", ", "\n", "\x0b", "   "]) for w in some)
        rows.append((i, joined, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", None, ""])))
    rows += [(900, None, "en", "s1"), (901, "", "de", "s1"), (902, " .,; \n", None, None), (None, rows[0][1], "en", "s2"), (5, rows[5][1], "en", "s1"), (2, rows[0][1], "en", "s2"), (0, rows[0][1], "en", "s9")]
    rows.append((903, "b c " * 30_000 + "x" * 200_000, "fr", "long"))
    return rows


def plain_phrases(rows, top, least, share):
    counts = defaultdict(Counter)
    for _, text, lang, _ in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, 5):
                counts["und" if lang is None else lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in found.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i : i + m]] = max(longer[p[i : i + m]], a)
        scored = []
        for p, a in found.items():
            if 100 * longer[p] >= share * a:
                continue
            score, _, l, r = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(scored)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return out


@pytest.mark.parametrize("top,least,share", [(2000, 5, 80), (7, 3, 50)])
def test_phrases_against_plain_counts(spark, top, least, share):
    rows = texts(1)
    got = phrases.phrases(frame(spark, rows).repartition(5), top, least, share)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {tuple(r) for r in got.collect()} == plain_phrases(rows, top, least, share)


def test_phrases_with_many_tries_and_few_buckets(spark, monkeypatch):
    """Shards of tries and a crowded bucket table change nothing."""
    monkeypatch.setattr(phrases, "TRIE_PHRASES", 20)
    monkeypatch.setattr(phrases, "BUCKET_BITS", (12, 12))
    rows = texts(2)
    assert {tuple(r) for r in phrases.phrases(frame(spark, rows), 2000, 4, 80).collect()} == plain_phrases(rows, 2000, 4, 80)


def test_phrases_of_nothing(spark):
    assert phrases.phrases(frame(spark, [])).collect() == []
    assert phrases.phrases(frame(spark, [(1, None, None, None), (2, "", "en", "s")])).collect() == []


def test_shared_hashes_are_found(spark, monkeypatch):
    """Multipliers under which words share hashes are passed over."""
    monkeypatch.setattr(phrases, "MULTIPLIERS", [(1, phrases.MULTIPLIERS[0][1]), phrases.MULTIPLIERS[1]])
    rows = [(i, "ab ba cd " * 3, "en", "s") for i in range(4)]
    assert {tuple(r) for r in phrases.phrases(frame(spark, rows), 2000, 5, 80).collect()} == plain_phrases(rows, 2000, 5, 80)


def test_double_array_holds_exactly_its_phrases():
    rng = random.Random(3)
    some = {k: np.unique(np.array([[rng.randrange(1, 30) for _ in range(k)] for _ in range(400)], np.uint64), axis=0) for k in (2, 3, 4)}
    trie, states = phrases.Trie.build(list(some.values()))
    ids = np.array([rng.randrange(0, 32) for _ in range(20_000)], np.uint64)
    counts = trie.count([ids], 4)
    for (k, found), state in zip(some.items(), states):
        seen = Counter(tuple(ids[i : i + k].tolist()) for i in range(len(ids) - k + 1))
        assert [seen[tuple(p.tolist())] for p in found] == counts[state].tolist()
    assert len(set(np.concatenate(states).tolist())) == sum(map(len, states))


def plain_audit(rows, labels):
    good, toxic = ({i for i, *q in labels if i is not None and q[at] == 1} for at in (0, 1))
    first = {}
    for i, text, *_ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    out = defaultdict(lambda: [0] * 5)
    shapley, unique = Counter(), Counter()
    for i, text, _, source in rows:
        t, part = text or "", source or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = dict(zip("ABCDE", (
            len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)),
            i is not None and t in first and first[t] < i,
        )))
        if sum(fails.values()) == 1:
            unique[part, next(f for f in fails if fails[f])] += 1
        for order in permutations("ABCDE"):
            gone = False
            for step, f in enumerate(order, 1):
                here = fails[f]
                cell = out[part, "".join(order), step]
                for at, value in enumerate((not gone and not here, here and not gone, here and gone, here and not gone and i in good, here and not gone and i in toxic)):
                    cell[at] += value
                shapley[part, f] += here and not gone
                gone |= here
    return {(*key, *cell[:3], unique[key[0], key[1][key[2] - 1]], *cell[3:], shapley[key[0], key[1][key[2] - 1]]) for key, cell in out.items()}


def test_filter_audit_against_plain_chains(spark):
    rows = texts(4)
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 160, 3)] + [(3, 1, 1), (None, 1, 1), (6, None, None), (903, 1, 0)]
    marks = spark.createDataFrame([(*r, "x") for r in labels], "doc_id bigint, quality int, toxic int, part string")
    got = filter_audit.filter_audit(frame(spark, rows).repartition(6), marks)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {tuple(r) for r in got.collect()} == plain_audit(rows, labels)


def test_filter_audit_of_many_parts_and_of_nothing(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "PARTS_IN_TASK", 3)
    marks = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    rows = [(i, "Same" if i % 2 else "other one", "en", f"s{i % 9}") for i in range(40)]
    assert {tuple(r) for r in filter_audit.filter_audit(frame(spark, rows), marks).collect()} == plain_audit(rows, [])
    assert filter_audit.filter_audit(frame(spark, []), marks).collect() == []


def test_wide_fields_do_not_spill():
    """A field takes any count of documents below 2**64 without touching its neighbour."""
    import pyarrow as pa

    n = (1 << 62) + 12345
    total = n * filter_audit.wide_integers()[0b00001]
    row = pa.RecordBatch.from_pydict({"part": ["p"], "packed": pa.array([filter_audit._bytes(total)], pa.binary())})
    out = next(filter_audit._unpacked(iter([row]))).to_pydict()
    assert set(out["removed"]) == {0, n} and set(out["kept"]) == {0, n} and set(out["toxic_lost"]) == {0}


def plain_pieces(rows, capacity):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing_tokenizer())
    out = []
    for i, text, *_ in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        out += [(i, k, s, len(ids[s : s + capacity]), zlib.crc32(ids[s : s + capacity].tobytes())) for k, s in enumerate(range(0, len(ids), capacity))]
    return Counter(out)


@pytest.mark.parametrize("capacity", [2048, 64])
def test_packing_round_trip(spark, capacity):
    rows = texts(5) + [(950, "It's <|endoftext|> <|ENDOFTEXT|> é́ 3. x?! 'S", "en", "s"), (951, "a\x0bb\x1cc\x85d\xa0e　f, (g).", "en", "s")]
    got = packing.pack(frame(spark, rows).repartition(5), packing_tokenizer(), capacity).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == plain_pieces(rows, capacity)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r.length for r in got)
    assert len(sequences) <= 1.02 * total / capacity + 2
    assert packing.pack(frame(spark, []), packing_tokenizer()).collect() == []


def best_fit_decreasing(totals, capacity):
    rooms = []
    for x in sorted((x for x, n in totals.items() for _ in range(n)), reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= x]
        if fits:
            rooms[min(fits)[1]] -= x
        else:
            rooms.append(capacity - x)
    return len(rooms)


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_length_once(seed):
    rng = random.Random(seed)
    capacity = 128
    totals = Counter(min(capacity, int(rng.expovariate(1 / rng.choice([9, 40, 70]))) + 1) for _ in range(900))
    if seed == 5:
        totals = Counter({capacity: 7, capacity // 2: 9, capacity // 2 + 1: 4})
    plan = packing.plan_runs(totals, capacity, groups=12)
    length = np.repeat(list(totals), list(totals.values()))
    rank = np.concatenate([np.arange(n) for n in totals.values()])
    sequence, offset = packing.place(plan, length, rank)
    order = np.lexsort((offset, sequence))
    s, o, x = sequence[order], offset[order], length[order]
    fresh = np.r_[True, s[1:] != s[:-1]]
    assert (o == np.where(fresh, 0, np.r_[0, (o + x)[:-1]])).all()
    assert np.bincount(s, x).max() <= capacity
    assert len(set(s.tolist())) <= 1.03 * best_fit_decreasing(totals, capacity) + 1
