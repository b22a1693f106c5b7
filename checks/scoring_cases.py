"""Matching, metrics, confidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import case
from checks.structure_cases import DOC, TAGS, chunks, gold_slots, joined_runs, long, pred_slots
from checks.views import EXPECTED, Views
from docstruct.labels import LABELS
from docstruct.operators import blocks as B
from docstruct.operators import confidence as C
from docstruct.operators import match as M
from docstruct.operators import metrics as A
from docstruct.operators import nest as N
from docstruct.plans import scoring as P

# ---- Spark side --------------------------------------------------------------------------


def slots_at(v: Views, path: P.EvaluationPath):
    n = chunks(v)
    return P.structure(v("gold_blocks"), path, DOC, n), P.structure(v("pred_blocks"), path, chunks=n)


def matches(v: Views, path: P.EvaluationPath = P.PATH_A):
    gold, pred = slots_at(v, path)
    return P.match_run(gold, pred, path, long_docs=long(v))


def conf(v: Views, path: P.EvaluationPath = P.PATH_A):
    return A.confusion(matches(v, path))


def gold_items(v: Views):
    return N.to_items(gold_slots(v), keys=DOC, long_docs=long(v))


def pred_items(v: Views):
    return N.to_items(pred_slots(v), long_docs=long(v))


# ---- expected values ---------------------------------------------------------------------

TOKS = "list_distinct(list_filter(string_split(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> ''))"


def toks(column: str) -> str:
    return TOKS.replace("{c}", column)


def score(left: str, right: str) -> str:
    return f"CASE WHEN len({left}) = 0 THEN 0.0 ELSE CAST(len(list_intersect({left}, {right})) AS DOUBLE) / len({left}) END"


EXPECTED["docs"] = "SELECT DISTINCT p.tag, p.doc_id FROM {pred_slots} p JOIN (SELECT DISTINCT doc_id FROM {gold_slots}) g USING (doc_id)"
for _x in ("a", "b"):
    for _side in ("gold", "pred"):
        EXPECTED[f"{_side}_toks_{_x}"] = f"SELECT *, {toks('text')} AS toks FROM {{{_side}_items_{_x}}}"
    EXPECTED[f"pairs_{_x}"] = (
        f"SELECT p.tag, p.doc_id, g.ord AS g, p.ord AS p, {score('p.toks', 'g.toks')} AS score "
        f"FROM {{pred_toks_{_x}}} p JOIN {{gold_toks_{_x}}} g USING (doc_id)"
    )
    EXPECTED[f"gold_rank_{_x}"] = (
        f"SELECT d.tag, g.doc_id, g.ord, row_number() OVER (PARTITION BY d.tag, g.doc_id ORDER BY g.ord) AS n FROM {{gold_items_{_x}}} g JOIN {{docs}} d USING (doc_id)"
    )
    for _t, _thr in (("", "0.75"), ("_full", "1.0")):
        EXPECTED[f"claims_{_x}{_t}"] = f"""
SELECT tag, doc_id, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS g, CAST(NULL AS BIGINT) AS p FROM {{docs}}
UNION ALL
SELECT tag, doc_id, n + 1, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END, gord, pick FROM (
  SELECT c.tag, c.doc_id, c.n, any_value(c.used) AS used, r.ord AS gord, arg_min(k.p, struct_pack(a := -k.score, b := k.p)) AS pick
  FROM _claims_{_x}{_t} c JOIN {{gold_rank_{_x}}} r ON r.tag = c.tag AND r.doc_id = c.doc_id AND r.n = c.n + 1
  LEFT JOIN {{pairs_{_x}}} k ON k.tag = c.tag AND k.doc_id = c.doc_id AND k.g = r.ord AND k.score >= {_thr} AND k.score > 0 AND NOT list_contains(c.used, k.p)
  GROUP BY c.tag, c.doc_id, c.n, r.ord) z"""
        EXPECTED[f"matches_{_x}{_t}"] = f"""
SELECT r.tag, r.doc_id, r.ord AS gold_ord, g.text AS gold_text, g.label AS gold_label, c.p AS pred_ord, p.text AS pred_text, p.label AS pred_label
FROM {{gold_rank_{_x}}} r JOIN {{gold_items_{_x}}} g ON g.doc_id = r.doc_id AND g.ord = r.ord
JOIN {{claims_{_x}{_t}}} c ON c.tag = r.tag AND c.doc_id = r.doc_id AND c.g = r.ord
LEFT JOIN {{pred_items_{_x}}} p ON p.tag = r.tag AND p.doc_id = r.doc_id AND p.ord = c.p
UNION ALL
SELECT p.tag, p.doc_id, NULL, NULL, NULL, p.ord, p.text, p.label FROM {{pred_items_{_x}}} p JOIN {{docs}} d USING (tag, doc_id)
WHERE NOT EXISTS (SELECT 1 FROM {{claims_{_x}{_t}}} c WHERE c.tag = p.tag AND c.doc_id = p.doc_id AND c.p = p.ord)"""
        EXPECTED[f"conf_{_x}{_t}"] = (
            f"SELECT tag, doc_id, coalesce(gold_label, '__no_gold__') AS true_label, coalesce(pred_label, '__missed__') AS pred_label, count(*) AS n FROM {{matches_{_x}{_t}}} GROUP BY ALL"
        )

FIVE = ", ".join(f"'{x}'" for x in LABELS)
COL = {x: x.replace(".", "_") for x in LABELS}


def sumif(cond: str) -> str:
    return f"CAST(coalesce(sum(n) FILTER ({cond}), 0) AS BIGINT)"


def prf(table: str, keys: str) -> str:
    """Per-label counts and scores."""
    return f"""SELECT {keys}, label, tp, fp, fn, precision, recall, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1, tp + fn AS support FROM (
  SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall FROM (
    SELECT {keys}, label, {sumif("true_label = label AND pred_label = label")} AS tp, {sumif("true_label <> label AND pred_label = label")} AS fp,
      {sumif("true_label = label AND pred_label <> label")} AS fn FROM {table}, (SELECT unnest([{FIVE}]) AS label) l GROUP BY ALL) x) y"""


def micro(table: str, keys: str) -> str:
    return f"""SELECT {keys}, tp, fp, fn, precision, recall, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM (
  SELECT {keys}, tp, np - tp AS fp, ng - tp AS fn, CASE WHEN np = 0 THEN 0.0 ELSE tp / np END AS precision, CASE WHEN ng = 0 THEN 0.0 ELSE tp / ng END AS recall FROM (
    SELECT {keys}, {sumif("true_label = pred_label")} AS tp, {sumif("pred_label <> '__missed__'")} AS np, {sumif("true_label <> '__no_gold__'")} AS ng FROM {table} GROUP BY {keys}) x) y"""


for _x in ("a", "b"):
    EXPECTED[f"prf_{_x}"] = prf(f"{{conf_{_x}}}", "tag")
    EXPECTED[f"prf_doc_{_x}"] = prf(f"{{conf_{_x}}}", "tag, doc_id")
    EXPECTED[f"micro_{_x}"] = micro(f"{{conf_{_x}}}", "tag")
    EXPECTED[f"micro_doc_{_x}"] = micro(f"{{conf_{_x}}}", "tag, doc_id")
EXPECTED["micro_a_full"] = micro("{conf_a_full}", "tag")


def r6(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


# ---- tokens and best match ---------------------------------------------------------------


@case("m1_tokens", f"SELECT doc_id, array_to_string(list_sort({toks('text')}), ' ') AS toks, CAST(len({toks('text')}) AS BIGINT) AS n FROM {{documents}}")
def _(v):
    t = M.with_tokens(v("documents"))
    return t.select("doc_id", F.array_join("toks", " ").alias("toks"), F.col("n_toks").alias("n"))


@case(
    "m2_containment",
    f"SELECT o.doc_id, round({score(toks('e.text'), toks('o.text'))}, 6) AS score FROM {{edited}} e JOIN {{documents}} o USING (doc_id)",
)
def _(v):
    from docstruct.functions.text import containment, tokens

    e = v("edited").select("doc_id", tokens(F.col("text")).alias("a"))
    o = v("documents").select("doc_id", tokens(F.col("text")).alias("b"))
    return e.join(o, "doc_id").select("doc_id", containment(F.col("a"), F.col("b")).alias("score"))


# Blocks of each run against gold items: best pair per block.
EXPECTED["block_toks"] = f"SELECT tag, doc_id, pos AS ord, text, label, confidence, page, {toks('text')} AS toks FROM {{clean}}"
EXPECTED["block_best"] = f"""SELECT b.*, CASE WHEN score >= 0.75 THEN g END AS gold_ord, CASE WHEN score >= 0.75 THEN gl END AS gold_label, CASE WHEN score >= 0.75 THEN score END AS score FROM {{block_toks}} b LEFT JOIN (
  SELECT tag, doc_id, ord, arg_min(g, struct_pack(a := -score, b := g)) AS g, arg_min(gl, struct_pack(a := -score, b := g)) AS gl, max(score) AS score FROM (
    SELECT b.tag, b.doc_id, b.ord, g.ord AS g, g.label AS gl, {score('b.toks', 'g.toks')} AS score FROM {{block_toks}} b JOIN {{gold_toks_a}} g USING (doc_id)) x GROUP BY ALL) y USING (tag, doc_id, ord)"""


def blocks(v: Views):
    return B.clean_blocks(v("pred_blocks")).withColumnRenamed("pos", "ord")


@case("m3_best_label", "SELECT tag, doc_id, ord, gold_label, gold_ord, round(score, 6) AS score FROM {block_best}")
def _(v):
    return M.best_label(blocks(v), gold_items(v)).select("tag", "doc_id", "ord", "gold_label", "gold_ord", "score")


@case("m4_greedy_match", "SELECT * FROM {matches_a}")
def _(v):
    return matches(v)


@case("m4_greedy_match_path_b", "SELECT * FROM {matches_b}")
def _(v):
    return matches(v, P.PATH_B)


@case("m5_unclaimed", "SELECT tag, doc_id, pred_ord, pred_text, pred_label FROM {matches_a} WHERE gold_ord IS NULL")
def _(v):
    return M.unclaimed(matches(v)).select("tag", "doc_id", "pred_ord", "pred_text", "pred_label")


@case("m6_missed", "SELECT tag, doc_id, gold_ord, gold_text, gold_label FROM {matches_a} WHERE pred_ord IS NULL")
def _(v):
    return M.missed(matches(v)).select("tag", "doc_id", "gold_ord", "gold_text", "gold_label")


EXPECTED["run_toks"] = f"SELECT tag, doc_id, pos AS ord, text, label, confidence, {toks('text')} AS toks FROM {{joined_runs}}"
EXPECTED["run_true"] = f"""SELECT i.tag, i.doc_id, i.ord, i.label, i.confidence, i.text, CASE WHEN len(i.toks) >= 3 AND y.score >= 0.75 THEN gl END AS true_label FROM {{run_toks}} i LEFT JOIN (
  SELECT tag, doc_id, ord, arg_min(gl, struct_pack(a := -score, b := g)) AS gl, max(score) AS score FROM (
    SELECT i.tag, i.doc_id, i.ord, g.ord AS g, g.label AS gl, {score('i.toks', 'g.toks')} AS score FROM {{run_toks}} i JOIN {{gold_toks_a}} g USING (doc_id)) x GROUP BY ALL) y USING (tag, doc_id, ord)"""


@case("m7_true_label", "SELECT tag, doc_id, ord, label, true_label FROM {run_true}")
def _(v):
    items = joined_runs(v).withColumnRenamed("pos", "ord")
    return M.true_label(items, gold_items(v)).select("tag", "doc_id", "ord", "label", "true_label")


EXPECTED["block_strict"] = f"""SELECT b.tag, b.doc_id, b.ord, b.label, CASE WHEN len(b.toks) >= 3 AND NOT EXISTS (SELECT 1 FROM {{gold_toks_a}} g WHERE g.doc_id = b.doc_id
  AND g.ord <> b.gold_ord AND len(g.toks) >= 2 AND {score('g.toks', 'b.toks')} >= 0.9) THEN b.gold_label END AS true_label FROM {{block_best}} b"""


def strict(v: Views):
    return M.true_label_strict(blocks(v), gold_items(v))


@case("m8_true_label_strict", "SELECT tag, doc_id, ord, label, true_label FROM {block_strict}")
def _(v):
    return strict(v).select("tag", "doc_id", "ord", "label", "true_label")


@case(
    "m9_block_accuracy",
    "SELECT tag, count(*) FILTER (label IS NOT DISTINCT FROM true_label) AS correct, count(*) FILTER (label IS DISTINCT FROM true_label) AS wrong, "
    "round(avg(CASE WHEN label IS NOT DISTINCT FROM true_label THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM {block_strict} WHERE true_label IS NOT NULL GROUP BY ALL",
)
def _(v):
    return M.block_accuracy(strict(v))


EXPECTED["near"] = """SELECT tag, doc_id, p AS ord, label, score, array_to_string(list_sort(list_filter(ptoks, lambda w: NOT list_contains(gtoks, w))), ', ') AS extra_words FROM (
  SELECT k.tag, k.doc_id, k.p, p.label, p.toks AS ptoks, k.score, g.toks AS gtoks, row_number() OVER (PARTITION BY k.tag, k.doc_id, k.p ORDER BY k.score DESC, k.g) AS rn
  FROM {pairs_a} k JOIN {pred_toks_a} p ON p.tag = k.tag AND p.doc_id = k.doc_id AND p.ord = k.p JOIN {gold_toks_a} g ON g.doc_id = k.doc_id AND g.ord = k.g) x
WHERE rn = 1 AND score >= 0.75 AND score < 1"""


@case("m10_near_misses", "SELECT tag, doc_id, ord, label, round(score, 6) AS score, extra_words FROM {near}")
def _(v):
    return M.near_misses(pred_items(v), gold_items(v)).select("tag", "doc_id", "ord", "label", "score", "extra_words")


@case("m11_near_miss_buckets", "SELECT tag, count(*) FILTER (score >= 0.95) AS few_words, count(*) FILTER (score < 0.95) AS fused FROM {near} GROUP BY ALL")
def _(v):
    return M.near_miss_buckets(M.near_misses(pred_items(v), gold_items(v)))


@case(
    "m12_closest",
    """SELECT tag, doc_id, gold_ord, ord, round(score, 6) AS score, rank, text, label FROM (
      SELECT k.tag, k.doc_id, k.g AS gold_ord, k.p AS ord, k.score, p.text, p.label, row_number() OVER (PARTITION BY k.tag, k.doc_id, k.g ORDER BY k.score DESC, k.p) AS rank
      FROM {pairs_a} k JOIN {pred_items_a} p ON p.tag = k.tag AND p.doc_id = k.doc_id AND p.ord = k.p
      JOIN {gold_items_a} g ON g.doc_id = k.doc_id AND g.ord = k.g WHERE g.label = 'section.title') x WHERE rank <= 3""",
)
def _(v):
    heads = gold_items(v).where("label = 'section.title'")
    return M.closest(heads, pred_items(v), 3)


@case(
    "m13_swallowed",
    f"""SELECT k.tag, k.doc_id, k.p AS ord, p.label, g.ord AS gold_ord, g.label AS gold_label, round(b.score, 6) AS score, b.best_ord, b.best_label
    FROM {{pairs_a}} k JOIN {{pred_toks_a}} p ON p.tag = k.tag AND p.doc_id = k.doc_id AND p.ord = k.p JOIN {{gold_toks_a}} g ON g.doc_id = k.doc_id AND g.ord = k.g
    JOIN (SELECT k.tag, k.doc_id, k.p, max(k.score) AS score, arg_min(k.g, struct_pack(a := -k.score, b := k.g)) AS best_ord, arg_min(g.label, struct_pack(a := -k.score, b := k.g)) AS best_label
      FROM {{pairs_a}} k JOIN {{gold_items_a}} g ON g.doc_id = k.doc_id AND g.ord = k.g GROUP BY k.tag, k.doc_id, k.p) b ON b.tag = k.tag AND b.doc_id = k.doc_id AND b.p = k.p
    WHERE len(g.toks) > 0 AND {score('g.toks', 'p.toks')} = 1""",
)
def _(v):
    return M.swallowed(gold_items(v), pred_items(v))


@case(
    "m14_heading_hits",
    """SELECT p.tag, count(*) AS n_headings, count(*) FILTER (EXISTS (SELECT 1 FROM {pairs_a} k JOIN {gold_items_a} g ON g.doc_id = k.doc_id AND g.ord = k.g
      WHERE k.tag = p.tag AND k.doc_id = p.doc_id AND k.p = p.ord AND g.label = 'section.title' AND k.score >= 0.75)) AS n_hits
    FROM {pred_items_a} p WHERE p.label = 'section.title' GROUP BY ALL""",
)
def _(v):
    return M.heading_hits(pred_items(v), gold_items(v), "section.title")


EXPECTED["sides"] = f"""SELECT 'l' AS side, item_id AS id, {toks('text')} AS toks FROM {{benchmark}} UNION ALL SELECT 'r', doc_id, {toks('text')} FROM {{documents}}"""


@case(
    "m15_containment_join",
    """SELECT l.id AS left_id, r.id AS right_id, round(count(*) / any_value(l.n), 6) AS score
    FROM (SELECT id, len(toks) AS n, unnest(toks) AS t FROM {sides} WHERE side = 'l') l JOIN (SELECT id, unnest(toks) AS t FROM {sides} WHERE side = 'r') r ON l.t = r.t
    GROUP BY l.id, r.id HAVING count(*) / any_value(l.n) >= 0.75""",
)
def _(v):
    return M.containment_join(v("benchmark").select(F.col("item_id").alias("id"), "text"), v("documents").select(F.col("doc_id").alias("id"), "text"))


# ---- confusions and metrics --------------------------------------------------------------


@case("a1_confusion", "SELECT * FROM {conf_a}")
def _(v):
    return conf(v)


@case("a2_pool", "SELECT tag, NULL AS doc_id, true_label, pred_label, CAST(sum(n) AS BIGINT) AS n FROM {conf_a} GROUP BY ALL UNION ALL SELECT tag, doc_id, true_label, pred_label, n FROM {conf_a}")
def _(v):
    return A.pool_rollup(conf(v))


@case("a3_label_prf", f"SELECT tag, label, tp, fp, fn, {r6('precision', 'recall', 'f1')}, support FROM {{prf_a}}")
def _(v):
    return A.label_prf(conf(v))


_MICRO = f"tp, fp, fn, {r6('precision', 'recall', 'f1')}"


@case("a4_micro_prf", f"SELECT tag, {_MICRO} FROM {{micro_a}}")
def _(v):
    return A.micro_prf(conf(v))


@case("a4_micro_prf_path_b", f"SELECT tag, {_MICRO} FROM {{micro_b}}")
def _(v):
    return A.micro_prf(conf(v, P.PATH_B))


@case(
    "a5_gold_metrics",
    f"SELECT tag, {sumif('true_label = pred_label')} AS correct, {sumif('''true_label <> '__no_gold__' AND pred_label <> '__missed__' ''')} AS covered, {sumif('''true_label <> '__no_gold__' ''')} AS total_gold FROM {{conf_a}} GROUP BY ALL",
)
def _(v):
    return A.gold_metrics(conf(v))


CELLS = {**COL, "__missed__": "missed"}
EXPECTED["matrix"] = "SELECT tag, true_label, " + ", ".join(f"{sumif(f'''pred_label = '{k}' ''')} AS {c}" for k, c in CELLS.items()) + ", CAST(sum(n) AS BIGINT) AS all_n FROM {conf_a} WHERE true_label <> '__no_gold__' GROUP BY ALL"


@case("a6_confusion_matrix", "SELECT * EXCLUDE (all_n) FROM {matrix}")
def _(v):
    return A.confusion_matrix(conf(v))


@case("a7_confusion_pct", "SELECT tag, true_label, " + ", ".join(f"round({c} / all_n, 6) AS {c}" for c in CELLS.values()) + " FROM {matrix}")
def _(v):
    return A.confusion_pct(conf(v))


EXPECTED["acc"] = f"SELECT tag, doc_id, CAST(sum(n) AS BIGINT) AS total, {sumif('true_label = pred_label')} AS correct FROM {{conf_a}} GROUP BY ALL"


@case("a8_doc_accuracy", "SELECT *, total - correct AS errors, round(correct / total, 6) AS accuracy, concat(correct, '/', total) AS formula FROM {acc}")
def _(v):
    return A.doc_accuracy(conf(v))


@case("a9_evaluate_run", "SELECT *, total - correct AS errors, round(correct / total, 6) AS accuracy, concat(correct, '/', total) AS formula FROM {acc} WHERE doc_id NOT IN (1, 2)")
def _(v):
    return P.evaluate_run(*slots_at(v, P.PATH_A), P.PATH_A, exclude=[1, 2], long_docs=long(v))[0]


@case(
    "a9_skipped_docs",
    "SELECT t.tag, g.doc_id FROM (SELECT DISTINCT doc_id FROM {gold_slots}) g, (SELECT DISTINCT tag FROM {pred_slots}) t "
    "WHERE NOT EXISTS (SELECT 1 FROM {pred_slots} p WHERE p.tag = t.tag AND p.doc_id = g.doc_id AND (p.doc_id + length(p.tag) + CAST(right(p.tag, 1) AS BIGINT)) % 7 <> 2)",
)
def _(v):
    """Some documents have no prediction in some runs."""
    some = (F.col("doc_id") + F.length("tag") + F.substring("tag", -1, 1).cast("bigint")) % 7 != 2
    return P.skipped_docs(gold_slots(v), pred_slots(v).where(some))


EXPECTED["errors_a"] = """SELECT tag, doc_id, pred_ord, left(pred_text, 120) AS text, coalesce(gold_label, 'no_gold_match') AS true_label, pred_label FROM {matches_a}
  WHERE pred_ord IS NOT NULL AND gold_label IS DISTINCT FROM pred_label"""
EXPECTED["errors_b"] = EXPECTED["errors_a"].replace("matches_a", "matches_b")


@case("a10_errors", "SELECT * FROM {errors_a}")
def _(v):
    return A.errors(matches(v))


EXPECTED["issues"] = """SELECT tag, doc_id, coalesce(gold_label, '(none)') AS true_label, coalesce(pred_label, '(not produced)') AS pred_label,
  CASE WHEN pred_ord IS NULL THEN 'missing' WHEN gold_ord IS NULL THEN 'extra' ELSE 'wrong label' END AS issue, coalesce(pred_text, gold_text) AS text, gold_ord, pred_ord
  FROM {matches_b} WHERE gold_label IS DISTINCT FROM pred_label"""


@case("a11_issues", "SELECT * FROM {issues}")
def _(v):
    return A.issues(matches(v, P.PATH_B))


@case(
    "a11_issue_counts",
    "SELECT tag, doc_id, count(*) FILTER (issue = 'extra') AS extra, count(*) FILTER (issue = 'missing') AS missing, count(*) FILTER (issue = 'wrong label') AS wrong_label FROM {issues} GROUP BY ALL",
)
def _(v):
    return A.issue_counts(A.issues(matches(v, P.PATH_B)))


@case("a12_off_diagonal", "SELECT tag, doc_id, true_label, CASE WHEN issue = 'missing' THEN '(not labeled)' ELSE pred_label END AS pred_label, text FROM {issues} WHERE issue <> 'extra'")
def _(v):
    return A.off_diagonal(matches(v, P.PATH_B))


EXPECTED["kinds"] = "SELECT *, row_number() OVER (PARTITION BY tag ORDER BY n DESC, true_label, pred_label) AS rank FROM (SELECT tag, true_label, pred_label, count(*) AS n FROM {errors_a} GROUP BY ALL) x"


@case("a13_mistake_kinds", "SELECT * FROM {kinds} WHERE rank <= 4")
def _(v):
    return A.mistake_kinds(A.errors(matches(v)), 4)


@case(
    "a14_mistake_change",
    """SELECT tag, true_label, pred_label, coalesce(a.n, 0) AS path_a, coalesce(b.n, 0) AS path_b, coalesce(b.n, 0) - coalesce(a.n, 0) AS change FROM
    (SELECT tag, true_label, pred_label, count(*) AS n FROM {errors_a} GROUP BY ALL) a FULL JOIN
    (SELECT tag, true_label, pred_label, count(*) AS n FROM {errors_b} GROUP BY ALL) b USING (tag, true_label, pred_label)""",
)
def _(v):
    return A.mistake_change(A.errors(matches(v)), A.errors(matches(v, P.PATH_B)))


@case(
    "a15_missing_share",
    "SELECT tag, " + ", ".join(
        f"round(nullif(sum(n) FILTER (true_label = '{k}' AND pred_label = '__missed__') / sum(n) FILTER (true_label = '{k}'), 0), 6) AS {c}" for k, c in COL.items()
    ) + " FROM {conf_a} GROUP BY ALL",
)
def _(v):
    return A.missing_share(conf(v))


EXPECTED["gone"] = "SELECT doc_id, " + ", ".join(f"{sumif(f'''true_label = '{k}' ''')} AS {c}" for k, c in COL.items()) + ", CAST(sum(n) AS BIGINT) AS total FROM {conf_a} WHERE pred_label = '__missed__' GROUP BY ALL"


@case("a16_missing_by_doc", "SELECT * FROM {gone}")
def _(v):
    return A.missing_by_doc(conf(v))


@case(
    "a16_top_share",
    "SELECT CAST(sum(total) FILTER (rn <= 2) AS BIGINT) AS top_total, CAST(sum(total) AS BIGINT) AS total, round(sum(total) FILTER (rn <= 2) / sum(total), 6) AS share FROM (SELECT *, row_number() OVER (ORDER BY total DESC) AS rn FROM {gone}) x",
)
def _(v):
    return A.top_share(A.missing_by_doc(conf(v)))


@case("a17_check_rows", "SELECT tag, true_label, all_n AS row_total, CAST(1 AS DOUBLE) AS row_sum, true AS ok FROM {matrix}")
def _(v):
    return A.check_rows(conf(v))


@case(
    "a18_macro_f1",
    "SELECT tag, label, round(avg(f1), 6) AS mean_f1, round(stddev_pop(f1), 6) AS sd_f1, count(*) AS n_docs FROM {prf_doc_a} WHERE tp + fp + fn > 0 GROUP BY ALL",
)
def _(v):
    return A.macro_f1(conf(v))


_PER_TAG = ", ".join(f"round(max(f1) FILTER (tag = '{t}'), 6) AS {t}" for t in TAGS)


@case(
    "a19_class_report",
    f"SELECT label, max(support) FILTER (tag = 'run1') AS support, {_PER_TAG} FROM (SELECT tag, label, f1, support FROM {{prf_a}} UNION ALL SELECT tag, 'micro avg', f1, tp + fn FROM {{micro_a}}) x GROUP BY ALL",
)
def _(v):
    return A.class_report(conf(v), TAGS)


@case("a20_doc_f1_matrix", f"SELECT doc_id, {_PER_TAG} FROM {{micro_doc_a}} GROUP BY ALL")
def _(v):
    return A.doc_f1_matrix(conf(v), TAGS)


@case("a20_perfect_docs", "SELECT tag, doc_id FROM {micro_doc_a} WHERE f1 = 1")
def _(v):
    return A.perfect_docs(conf(v))


@case(
    "a21_restrict",
    f"SELECT tag, {_MICRO} FROM ({micro('(SELECT c.* FROM {conf_a} c JOIN (SELECT DISTINCT conv_id FROM {conversations} WHERE role = ' + chr(39) + 'system' + chr(39) + ') s ON s.conv_id = c.doc_id) z', 'tag')}) m",
)
def _(v):
    with_system = v("conversations").where("role = 'system'").select(F.col("conv_id").alias("doc_id"))
    return A.micro_prf(A.restrict(conf(v), with_system))


@case(
    "a22_threshold_sweep",
    f"""SELECT m.tag, threshold, m.tp, m.fp, m.fn, round(m.precision, 6) AS precision, round(m.recall, 6) AS recall, round(m.f1, 6) AS f1, round(m.f1 - b.f1, 6) AS f1_change, m.tp - b.tp AS tp_change
    FROM (SELECT CAST(0.75 AS DOUBLE) AS threshold, * FROM {{micro_a}} UNION ALL SELECT CAST(1 AS DOUBLE), * FROM {{micro_a_full}}) m JOIN {{micro_a}} b ON b.tag = m.tag""",
)
def _(v):
    return P.threshold_sweep(*slots_at(v, P.PATH_A), P.PATH_A, [0.75, 1.0], long_docs=long(v))


@case(
    "a23_two_path_scores",
    """SELECT d.tag, d.n_docs, round(a.precision, 6) AS a_precision, round(a.recall, 6) AS a_recall, round(a.f1, 6) AS a_f1, round(b.precision, 6) AS b_precision, round(b.recall, 6) AS b_recall, round(b.f1, 6) AS b_f1
    FROM (SELECT tag, count(DISTINCT doc_id) AS n_docs FROM {conf_a} GROUP BY ALL) d JOIN {micro_a} a USING (tag) JOIN {micro_b} b USING (tag)""",
)
def _(v):
    return P.two_path_scores(conf(v), conf(v, P.PATH_B))


@case(
    "a24_score_delta",
    "SELECT b.tag, round(b.f1, 6) AS f1, round(a.f1, 6) AS base_f1, round(b.f1 - a.f1, 6) AS change, abs(b.f1 - a.f1) < 0.005 AS is_noise FROM {micro_b} b LEFT JOIN {micro_a} a ON a.tag = b.tag",
)
def _(v):
    return A.score_delta(A.micro_prf(conf(v, P.PATH_B)), A.micro_prf(conf(v)))


@case("a25_label_destinations", "SELECT tag, pred_label, CAST(sum(n) AS BIGINT) AS n FROM {conf_a} WHERE true_label = 'question.text' GROUP BY ALL")
def _(v):
    return A.label_destinations(conf(v), "question.text")


_SPREAD = ["tp", "fp", "fn", "precision", "recall", "f1"]


@case(
    "a26_run_spread",
    "SELECT 'all' AS series, " + ", ".join(f"{'CAST(max(' + c + ') - min(' + c + ') AS BIGINT)' if c in ('tp', 'fp', 'fn') else 'round(max(' + c + ') - min(' + c + '), 6)'} AS {c}_spread, round(avg({c}), 6) AS {c}_mean" for c in _SPREAD) + " FROM {micro_a}",
)
def _(v):
    return A.run_spread(A.micro_prf(conf(v)).withColumn("series", F.lit("all")), ["series"], _SPREAD)


@case("a26_label_spread", "SELECT label, round(max(f1) - min(f1), 6) AS f1_spread, round(avg(f1), 6) AS f1_mean FROM {prf_a} GROUP BY ALL")
def _(v):
    return A.run_spread(A.label_prf(conf(v)), ["label"], ["f1"])


EXPECTED["ranked"] = f"""SELECT tag, {sumif('true_label = pred_label')} AS correct, CAST(sum(n) AS BIGINT) AS total, {sumif('''true_label <> '__no_gold__' ''')} AS gold_total FROM {{conf_a}} GROUP BY ALL"""


@case(
    "a27_rank_runs",
    """SELECT tag, correct, total, round(correct / total, 6) AS block_acc, correct AS gold_correct, gold_total, round(correct / gold_total, 6) AS gold_acc,
    correct / total = max(correct / total) OVER () AS best_block, correct / gold_total = max(correct / gold_total) OVER () AS best_gold FROM {ranked}""",
)
def _(v):
    return A.rank_runs(conf(v))


@case(
    "a28_experiment_summary",
    """SELECT model, 'ex' AS extractor, p.path, model || '_ex_whole_doc' AS tag, coalesce(s.correct, 0) AS correct, coalesce(s.total, 0) AS total, round(s.correct / s.total, 6) AS accuracy, s.total IS NOT NULL AS has_results
    FROM (SELECT unnest(['run1', 'run2', 'run9']) AS model) m CROSS JOIN (SELECT unnest(['A', 'B']) AS path) p LEFT JOIN (
      SELECT tag, 'A' AS path, CAST(sum(correct) AS BIGINT) AS correct, CAST(sum(total) AS BIGINT) AS total FROM {acc} GROUP BY ALL) s ON s.tag = m.model AND s.path = p.path""",
)
def _(v):
    acc = A.doc_accuracy(conf(v)).withColumns({"tag": F.concat("tag", F.lit("_ex_whole_doc")), "path": F.lit("A")})
    return A.experiment_summary(acc, ["run1", "run2", "run9"], ["ex"], ["A", "B"])


@case(
    "a29_consistency_report",
    """SELECT r.tag, r.n_blocks, r.n_changes, round(r.n_changes / r.n_blocks, 6) AS changes_per_block, round(m.f1, 6) AS f1 FROM
    (SELECT tag, CAST(sum(n_blocks) AS BIGINT) AS n_blocks, CAST(sum(n_runs) AS BIGINT) AS n_changes FROM {doc_runs} GROUP BY ALL) r JOIN {micro_a} m USING (tag)""",
)
def _(v):
    return A.consistency_report(B.label_runs(B.clean_blocks(v("pred_blocks")), chunks=chunks(v)), A.micro_prf(conf(v)))


@case(
    "a30_report",
    f"""SELECT tag, "row", {r6('precision', 'recall', 'f1')}, support FROM (
      SELECT tag, label AS "row", precision, recall, f1, support FROM {{prf_a}}
      UNION ALL SELECT tag, 'micro avg', precision, recall, f1, tp + fn FROM {{micro_a}}
      UNION ALL SELECT tag, 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM {{prf_a}} GROUP BY ALL
      UNION ALL SELECT tag, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM {{prf_a}} GROUP BY ALL) x""",
)
def _(v):
    return A.report(conf(v))


# ---- confidence --------------------------------------------------------------------------


@case("c1_confidence_rows", "SELECT tag, doc_id, ord, label, round(confidence, 6) AS confidence, gold_label, label = gold_label AS correct, CAST(page AS BIGINT) AS page, left(text, 120) AS text FROM {block_best} WHERE gold_label IS NOT NULL")
def _(v):
    return C.confidence_rows(blocks(v), gold_items(v))


_BUCKET = "CASE WHEN confidence < 0.5 THEN '<0.5' WHEN confidence < 0.6 THEN '0.5-0.6' WHEN confidence < 0.7 THEN '0.6-0.7' WHEN confidence < 0.8 THEN '0.7-0.8' WHEN confidence < 0.9 THEN '0.8-0.9' WHEN confidence < 0.95 THEN '0.9-0.95' ELSE '>=0.95' END"
_MID = "CASE WHEN confidence < 0.5 THEN 0.25 WHEN confidence < 0.6 THEN 0.55 WHEN confidence < 0.7 THEN 0.65 WHEN confidence < 0.8 THEN 0.75 WHEN confidence < 0.9 THEN 0.85 WHEN confidence < 0.95 THEN 0.925 ELSE 0.975 END"
_RIGHT = "CASE WHEN correct THEN 1.0 ELSE 0.0 END"


@case("c2_calibration", f"SELECT tag, {_BUCKET} AS bucket, CAST({_MID} AS DOUBLE) AS mid, count(*) AS n, round(avg({_RIGHT}), 6) AS accuracy FROM {{conf_rows}} WHERE confidence >= 0 AND confidence < 1.01 GROUP BY ALL")
def _(v):
    return C.calibration(v("conf_rows"), ["tag"])


@case(
    "c3_confidence_table",
    f"SELECT tag, count(*) AS n, round(avg({_RIGHT}), 6) AS accuracy, round(avg(confidence), 6) AS mean_confidence, round(avg(confidence) FILTER (correct), 6) AS mean_correct, round(avg(confidence) FILTER (NOT correct), 6) AS mean_incorrect FROM {{conf_rows}} GROUP BY ALL",
)
def _(v):
    return C.confidence_table(v("conf_rows"))


@case(
    "c4_confidence_sd",
    """SELECT tag, round(avg(confidence) FILTER (correct), 6) AS mean_correct, round(stddev_samp(confidence) FILTER (correct), 6) AS sd_correct, round(avg(confidence) FILTER (NOT correct), 6) AS mean_incorrect,
    round(stddev_samp(confidence) FILTER (NOT correct), 6) AS sd_incorrect, round(avg(confidence) FILTER (correct) - avg(confidence) FILTER (NOT correct), 6) AS gap FROM {conf_rows} GROUP BY ALL""",
)
def _(v):
    return C.confidence_sd(v("conf_rows"))


@case("c5_confidence_band", "SELECT tag, correct, round(avg(confidence), 6) AS mean, round(quantile_cont(confidence, 0.1), 6) AS low, round(quantile_cont(confidence, 0.9), 6) AS high FROM {conf_rows} GROUP BY ALL")
def _(v):
    return C.confidence_band(v("conf_rows"))


@case(
    "c6_case_examples",
    """SELECT k.tag, k."case", round(e.confidence, 6) AS confidence, e.gold_label, e.label, coalesce(e.text, '(no items in this case)') AS text FROM (
      SELECT tag, c."case", c.high, c.correct FROM (SELECT DISTINCT tag FROM {conf_rows}) t, (VALUES ('high and right', true, true), ('high and wrong', true, false), ('low and right', false, true), ('low and wrong', false, false)) c("case", high, correct)) k
    LEFT JOIN (SELECT *, confidence >= 0.9 AS high, row_number() OVER (PARTITION BY tag, confidence >= 0.9, correct ORDER BY CASE WHEN confidence >= 0.9 THEN -confidence ELSE confidence END, doc_id, ord) AS rn FROM {conf_rows}) e
    ON e.tag = k.tag AND e.high = k.high AND e.correct = k.correct AND rn = 1""",
)
def _(v):
    return C.case_examples(v("conf_rows"))
