"""Text quality, extractor choice, markers, reading and writing decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import case
from checks.views import EXPECTED, Views
from docstruct.operators import quality as Q
from docstruct.sources import io as IO

# ---- readability -------------------------------------------------------------------------

_SOLID = "length(regexp_replace(text, '\\s', '', 'g'))"
_REASON = f"""CASE WHEN trim(text, ' ' || chr(10) || chr(9)) = '' THEN 'empty' WHEN len(regexp_extract_all(text, '\\(cid:\\d+\\)')) > 10 THEN 'character ids'
  WHEN length(text) - length(replace(text, '�', '')) > 10 THEN 'replacement characters'
  WHEN length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / {_SOLID} < 0.6 THEN 'few letters'
  WHEN n_pages > 0 AND {_SOLID} / n_pages < 150 THEN 'short pages' END"""
EXPECTED["judged_texts"] = f"SELECT *, {_REASON} AS reason FROM {{texts}}"
EXPECTED["judged"] = f"SELECT *, {_REASON} AS reason FROM {{candidates}}"
EXPECTED["judged_fresh"] = f"SELECT *, {_REASON} AS reason FROM {{candidates_fresh}}"


@case("q1_garbled_reason", "SELECT doc_id, reason FROM {judged_texts}")
def _(v):
    return v("texts").select("doc_id", Q.garbled_reason(F.col("text"), F.col("n_pages")).alias("reason"))


@case("q2_quality_report", "SELECT lang, coalesce(reason, 'ok') AS reason, count(*) AS n_docs FROM {judged_texts} GROUP BY ALL")
def _(v):
    return Q.quality_report(v("texts"), ["lang"])


_PICK = """SELECT doc_id, extractor, text, reason IS NULL AS ok, reason FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN reason IS NULL THEN 0 ELSE 1 END, rank) AS rn FROM {src}) x WHERE rn = 1"""


@case("q3_choose_text", _PICK.replace("{src}", "{judged_fresh}"))
def _(v):
    return Q.choose_text(v("candidates_fresh"))


@case(
    "q4_attempts",
    """SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY rank) AS attempt, extractor, reason IS NULL AS ok, reason FROM {judged_fresh} j
    WHERE NOT EXISTS (SELECT 1 FROM {judged_fresh} w WHERE w.doc_id = j.doc_id AND w.reason IS NULL AND w.rank < j.rank)""",
)
def _(v):
    return Q.attempts(v("candidates_fresh"))


EXPECTED["resolved"] = """SELECT doc_id, extractor, rank, CASE WHEN stale THEN NULL ELSE text END AS text, CASE WHEN stale THEN 'unavailable' ELSE reason END AS reason FROM (
  SELECT *, o = 2 AS stale, row_number() OVER (PARTITION BY doc_id, extractor ORDER BY o) AS rn FROM (
    SELECT *, CASE WHEN source = 'cache' AND (reason IS NULL OR rank = 0) THEN 0 WHEN source = 'fresh' THEN 1 ELSE 2 END AS o FROM {judged}) x) y WHERE rn = 1"""


@case("q6_cached_candidates", "SELECT doc_id, extractor, CAST(rank AS BIGINT) AS rank, text, reason FROM {resolved}")
def _(v):
    return Q.cached_candidates(v("candidates")).drop("source", "n_pages")


@case("q6_choose_text_cached", _PICK.replace("{src}", "{resolved}"))
def _(v):
    return Q.choose_text_cached(v("candidates"))


# ---- markers: the derived texts hold a known set -----------------------------------------

_BOLD_B = "CASE WHEN conv_id % 3 = 0 THEN 0 ELSE 1 END"
_UNDER_B = "CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 0 END"


@case("q7_marker_counts", "SELECT conv_id * 100 + turn AS doc_id, 1 AS bold, 2 AS italic, 1 AS underline, 1 AS headings FROM {conversations}".replace("1 AS", "CAST(1 AS BIGINT) AS").replace("2 AS", "CAST(2 AS BIGINT) AS"))
def _(v):
    return Q.with_marker_counts(v("marked_a"))


@case(
    "q8_marker_diff",
    f"""SELECT conv_id * 100 + turn AS doc_id, CAST(1 AS BIGINT) AS bold_a, CAST(2 AS BIGINT) AS italic_a, CAST(1 AS BIGINT) AS underline_a, CAST({_BOLD_B} AS BIGINT) AS bold_b, CAST(2 AS BIGINT) AS italic_b,
    CAST({_UNDER_B} AS BIGINT) AS underline_b, {_BOLD_B} = 1 AND {_UNDER_B} = 1 AS same FROM {{conversations}}""",
)
def _(v):
    return Q.marker_diff(v("marked_a"), v("marked_b"))


@case(
    "q9_extract_summary",
    """SELECT extractor, count(*) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS chars, round(avg(length(text)), 6) AS mean_chars, min(length(text)) AS min_chars, max(length(text)) AS max_chars,
    CAST(sum((length(text) - length(replace(text, '**', ''))) // 2 // 2) AS BIGINT) AS bold_runs, CAST(sum((length(text) - length(replace(text, '_', ''))) // 2) AS BIGINT) AS italic_runs FROM {candidates} GROUP BY ALL""",
)
def _(v):
    return Q.extract_summary(v("candidates"))


EXPECTED["spans"] = f"""SELECT conv_id * 100 + turn AS doc_id, conv_id, turn, unnest(['heading #', '**bold**', '*italic*', '_italic_', '++underline++']) AS marker,
  unnest([concat(CAST(role AS VARCHAR), ' part'), 'Item one', 'star', concat('word', CAST(turn AS VARCHAR)), 'line']) AS span FROM {{conversations}}"""


@case("q10_marked_spans", f"SELECT doc_id, marker, span FROM {{spans}} WHERE NOT (marker = '**bold**' AND conv_id % 3 = 0) AND NOT (marker = '++underline++' AND conv_id % 2 = 1)")
def _(v):
    return Q.marked_spans(v("marked_b")).drop("n")


def fidelity(v: Views):
    signals = {"**bold**": "bold", "*italic*": "italic", "_italic_": "italic", "++underline++": "underline"}
    named = F.create_map(*[F.lit(x) for pair in signals.items() for x in pair])
    ref = Q.marked_spans(v("marked_a")).withColumns({"signal": named[F.col("marker")], "phrase": F.col("span")}).where("signal IS NOT NULL")
    other = v("marked_b").withColumn("run", F.lit("b")).unionByName(v("marked_a").withColumn("run", F.lit("a")))
    return Q.marker_fidelity(ref, other)


# Spans of the derived texts occur inside one another only as built, apart from the short ones
# that may also sit in running text, which leaves their own marker in place.
EXPECTED["fidelity"] = """SELECT doc_id, run, CASE marker WHEN '**bold**' THEN 'bold' WHEN '++underline++' THEN 'underline' ELSE 'italic' END AS signal, span AS phrase,
  CASE WHEN run = 'b' AND marker = '**bold**' AND conv_id % 3 = 0 THEN 'plain' WHEN run = 'b' AND marker = '++underline++' AND conv_id % 2 = 1 THEN 'plain' ELSE marker END AS rendered
  FROM {spans}, (SELECT unnest(['a', 'b']) AS run) r WHERE marker <> 'heading #'"""


@case("q11_marker_fidelity", "SELECT * FROM {fidelity}")
def _(v):
    return fidelity(v).drop("n")


@case(
    "q11_fidelity_summary",
    """SELECT signal, run, count(*) AS n_spans, count(*) FILTER (rendered NOT IN ('plain', 'not found')) AS marked, count(*) FILTER (rendered NOT IN ('plain', 'not found')) AS right_marker,
    count(*) FILTER (rendered = 'not found') AS not_found FROM {fidelity} GROUP BY ALL""",
)
def _(v):
    return Q.fidelity_summary(fidelity(v))


@case(
    "q12_ungrounded_lines",
    """SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, trim(line) AS line, n_words, n_unknown FROM (
      SELECT doc_id, line_no, any_value(line) AS line, count(*) AS n_words, count(*) FILTER (known IS NULL) AS n_unknown FROM (
        SELECT doc_id, line_no, line, unnest(regexp_extract_all(lower(line), '[a-z]{{4,}}')) AS w FROM (
          SELECT doc_id, unnest(range(0, len(l))) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM {edited}) a) b) x
      LEFT JOIN (SELECT DISTINCT doc_id, w, 1 AS known FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{{4,}}')) AS w FROM {documents}) k) y USING (doc_id, w) GROUP BY doc_id, line_no) z
    WHERE n_words >= 4 AND n_unknown >= n_words // 2""",
)
def _(v):
    return Q.ungrounded_lines(v("edited"), v("documents"))


# ---- what still has to run ---------------------------------------------------------------


@case("io6_list_tags", "SELECT tag, count(DISTINCT doc_id) AS n_docs FROM {pred_blocks} GROUP BY ALL")
def _(v):
    return IO.list_tags(v("pred_blocks"))


@case("io6_tags_by_recency", "SELECT event_type AS tag, max(ts) AS newest FROM {events} GROUP BY ALL")
def _(v):
    return IO.tags_by_recency(v("events").select(F.col("event_type").alias("tag"), "ts"), "ts")


@case("io7_pending", "SELECT doc_id, lang FROM {documents} d WHERE NOT EXISTS (SELECT 1 FROM {labels} l WHERE l.doc_id = d.doc_id)")
def _(v):
    return IO.pending(v("documents").select("doc_id", "lang"), v("labels"), ["doc_id"])


_WANTED = "SELECT doc_id, concat('m', doc_id % 3) AS rda_model, source AS extractor, 'v11' AS prompt, 'abc' AS prompt_fingerprint FROM {documents}"
_SAVED = """SELECT l.doc_id, CASE WHEN toxic = 1 THEN NULL ELSE concat('m', l.doc_id % 3) END AS rda_model, d.source AS extractor, CASE WHEN quality = 0 THEN 'v10' ELSE 'v11' END AS prompt,
  'abc' AS prompt_fingerprint FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id"""


@case(
    "io8_stale_runs",
    """SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'no run record' WHEN toxic = 1 AND quality = 0 THEN 'rda_model, prompt' WHEN toxic = 1 THEN 'rda_model' ELSE 'prompt' END AS changed
    FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id WHERE l.doc_id IS NULL OR toxic = 1 OR quality = 0""",
)
def _(v):
    tables = {"documents": v("documents"), "labels": v("labels")}
    return IO.stale_runs(v.spark.sql(_WANTED, documents=tables["documents"]), v.spark.sql(_SAVED, **tables))


@case("io9_fingerprint", "SELECT doc_id, left(sha256(concat(text, lang)), 12) AS fingerprint FROM {documents}")
def _(v):
    return v("documents").select("doc_id", IO.fingerprint(F.col("text"), F.col("lang")).alias("fingerprint"))
