"""HTML text, WARC chunk tables and embedding links."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docstruct.llm import embedding_dedup, html_text, warc
from docstruct.llm.store import written

PROSE = "The house of the old man was on the hill and it was said that he had not been in the town for many years. "


@pytest.mark.parametrize("body,want", [
    (f"<nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>A title</h1><p>{PROSE}<p>Short.<p>Last.</article><footer>&copy; me</footer>", f"A title\n{PROSE.strip()}\nShort.\nLast."),
    (f"<header><h1>Site</h1></header><main><p>a&amp;b &lt;tag&gt; &#233;<br>\n c</p><aside>{PROSE}</aside><p>{PROSE}</p></main>", f"a&b <tag> é c\n{PROSE.strip()}"),
    (f"<div class='menu'>x</div><div><h2>On houses</h2><p>{PROSE * 3}</p><p>Yes.</p><p>{PROSE * 3}</p></div><div id=comments><p>{PROSE * 3}</p></div>", "On houses\n{0}\nYes.\n{0}".format((PROSE * 3).strip())),
    (f"<article><p>{PROSE}</p><div class='ad banner'>{PROSE}</div><form>{PROSE}<input></form><p>end</p><section class=comments><p>{PROSE}</section></article>", f"{PROSE.strip()}\nend"),
    (f"<article><p title='a>b'>{PROSE}</p><script>var t='</p><p>{PROSE}'</script><!-- <p>{PROSE}</p> --><p>tail &am", f"{PROSE.strip()}\ntail &am"),
    (f"<ul>" + "".join(f"<li><a href=/{i}>link number {i} to some page</a></li>" for i in range(9)) + "</ul>", ""),
    ("<p>1 < 2 and 3 > 2", ""), ("", ""), ("<", ""), ("<article>tiny</article>", "tiny"), ("<article><style>x</article>", ""),
])
def test_page_text(body, want):
    assert html_text.page_text(body) == want
    assert html_text.page_text(f"<!DOCTYPE html><html><head><title>t</title></head><body class=has-sidebar>{body}") == want


def test_odd_pages_end(spark):
    for odd in ("<div " * 20000, "<b>" * 50000 + "x", "<a href='" * 20000, "<!--" * 20000, "<textarea>" * 20000, "</div>" * 50000, "<div>" * 50000):
        html_text.page_text(odd)
    rows = [(1, "u", None), (1, None, "<article>x</article>"), (None, "u", "")]
    got = html_text.main_text(spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id bigint, url string, html string, text string, id int")).collect()
    assert [(r.page_id, r.url, r.text, r.n_chars) for r in got] == [(1, "u", "", 0), (1, None, "x", 1), (None, "u", "", 0)]


def pages(spark, rows):
    return spark.createDataFrame([(*r, 0, "k") for r in rows], "page_id bigint, url string, html string, record int, key string")


def test_warc_round_trip(spark, tmp_path):
    rng = random.Random(1)
    big, medium = "é" * 5000 + "\r\n\r\nWARC/1.1\r\n", "m" * 1000
    rows = [(i, f"http://h/{i}", rng.choice([big, medium, "small", "m" * 999, None, ""])) for i in range(60)]
    rows += [(70, None, "z\n" * 4000), (71, "http://x/ y\r\nEvil: 1", medium), (71, "u", medium), (None, "u", medium), (None, "u", "only null " * 200)]
    chunks = written(warc.to_chunks(pages(spark, rows), chunk_bytes=700), "t")
    got = warc.from_chunks(chunks).collect()
    want = []
    groups = {}
    for i, _, t in rows:
        groups.setdefault(t or "", []).append(-1 if i is None else i)
    for i, _, t in rows:
        raw, first = (t or "").encode(), max(groups[t or ""])
        revisit = len(raw) >= 1000 and (-1 if i is None else i) != first
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert chunks.agg(F.max(F.octet_length("data"))).first()[0] < 2500
    files = warc.write_files(chunks, f"file://{tmp_path}/w", 3).collect()
    assert sum(f.records for f in files) == len(rows)
    data = b"".join(open(f.path, "rb").read() for f in files)
    found = []
    while data:  # a reader of its own: header, then a block as long as it says
        head, rest = data.split(b"\r\n\r\n", 1)
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        n = int(fields["Content-Length"])
        found.append((fields["WARC-Type"], rest[:n].split(b"\r\n\r\n", 1)[1]))
        assert rest[n : n + 4] == b"\r\n\r\n"
        data = rest[n + 4 :]
    assert sorted(p for k, p in found if k == "response") == sorted((t or "").encode() for (_, _, t), w in zip(rows, want) if w[3] == "response")
    assert warc.from_chunks(warc.to_chunks(pages(spark, []))).count() == 0


def test_damage_is_found(spark):
    chunks = warc.to_chunks(pages(spark, [(1, "u", "x" * 3000)]), chunk_bytes=1000)
    bad = chunks.withColumn("data", F.when(F.col("chunk") == 1, F.encode(F.regexp_replace(F.decode("data", "UTF-8"), "x$", "y"), "UTF-8")).otherwise(F.col("data")))
    with pytest.raises(Exception, match="damage in chunk 1"):
        warc.from_chunks(written(bad, "t")).collect()


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id bigint, embedding array<float>, label int, c int")


@pytest.mark.parametrize("large,block", [(64, 2048), (3, 4)])
def test_near_vectors(spark, large, block):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 24))
    rows = []
    for k, c in enumerate(centres):
        for _ in range(1 + 3 * k):
            rows.append(c + rng.normal(size=24) * rng.choice([0.0, 0.05, 0.2]) * np.linalg.norm(c) / 5)
    rows += [centres[3] * 2.5, centres[3] * -1]
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(rng.permutation(len(rows)), rows)]
    x = np.array([np.array(v, np.float32).astype(float) for _, v in rows])
    x /= np.sqrt((x * x).sum(1))[:, None]
    linked = x @ x.T >= 0.95
    root = np.array([i for i, _ in rows])
    for _ in range(len(rows)):
        root = np.array([root[linked[i]].min() for i in range(len(rows))])
    want = {i: (int(linked[k].sum()) - 1, int(root[k])) for k, (i, _) in enumerate(rows)}
    nan, inf = float("nan"), float("inf")
    odd = [(1000, None), (1001, []), (1002, [0.0] * 24), (1003, [nan] * 24), (1004, [inf] * 24), (1005, [None] * 24), (1006, [1.0]), (1007, [2.0]), (1008, [-0.0, 1.0]), (1009, [0.0, 1.0])]
    want |= {i: (0, i) for i in range(1000, 1006)} | {1006: (1, 1006), 1007: (1, 1006), 1008: (1, 1008), 1009: (1, 1008)}
    got = embedding_dedup.near_vectors(vectors(spark, rows + odd), large=large, block=block).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_near_vectors_edges(spark):
    got = embedding_dedup.near_vectors(vectors(spark, [(None, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (None, None)])).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got) == [
        ("2", 2, "2", True), ("2", 2, "2", True), ("None", 0, "None", True), ("None", 2, "2", False)
    ]
    assert embedding_dedup.near_vectors(vectors(spark, [])).count() == 0
