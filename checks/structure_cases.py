"""Blocks, nesting, rules, flattening."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import case
from checks.views import EXPECTED, Views
from docstruct.labels import LABELS
from docstruct.operators import blocks as B
from docstruct.operators import nest as N
from docstruct.operators import rules as R
from docstruct.operators.ordered import chunks_for
from docstruct.plans import narratives as W
from docstruct.plans import scoring as P
from docstruct.sources import io as IO

TAGS = ["run1", "run2", "run3"]
DOC = ("doc_id",)
FIVE = ", ".join(f"'{x}'" for x in LABELS)


def chunks(v: Views) -> int | None:
    """Whether a conversation is too long for one task, told from the key column alone."""
    return chunks_for(v("conversations"), ["conv_id"])


def long(v: Views) -> bool:
    return chunks(v) is not None


def gold_slots(v: Views):
    return N.nest(v("gold_blocks"), DOC, chunks(v))


def pred_slots(v: Views):
    return N.nest(v("pred_blocks"), chunks=chunks(v))


# ---- expected values: the nesting rules in closed form, as SQL ---------------------------

_NEST = f"""
SELECT {{keys}}, sec, q, slot, CASE WHEN slot = 'title' THEN string_agg(text, ' ' ORDER BY pos) ELSE string_agg(text, chr(10) ORDER BY pos) END AS text FROM (
  SELECT {{keys}}, pos, text, CASE WHEN part = 'title' THEN 0 ELSE sec END AS sec, slot,
    CASE WHEN slot IN ('question.text', 'answer.text') THEN sum(starts) OVER (PARTITION BY {{keys}}, sec ORDER BY pos) ELSE 0 END AS q FROM (
    SELECT *, CASE WHEN part = 'question.text' AND coalesce(prev, '') <> 'question.text' THEN 1 WHEN part = 'answer.text' AND prev IS NULL THEN 1 ELSE 0 END AS starts,
      CASE WHEN part = 'section.description' AND prev IS NOT NULL THEN prev ELSE part END AS slot FROM (
      SELECT *, last_value(CASE WHEN part IN ('question.text', 'answer.text') THEN part END IGNORE NULLS)
          OVER (PARTITION BY {{keys}}, sec ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM (
        SELECT *, CASE WHEN part = 'title' THEN 0 ELSE count(*) FILTER (part = 'section.title') OVER (PARTITION BY {{keys}} ORDER BY pos)
            + CASE WHEN first_body_label = 'section.title' THEN 0 ELSE 1 END END AS sec FROM (
          SELECT *, CASE WHEN label = 'title' AND pos <> first_title AND pos > first_body THEN 'answer.text' ELSE label END AS part FROM (
            SELECT {{keys}}, pos, trim(text) AS text, label,
              min(pos) FILTER (label = 'title') OVER (PARTITION BY {{keys}}) AS first_title,
              min(pos) FILTER (label <> 'title') OVER (PARTITION BY {{keys}}) AS first_body,
              first_value(CASE WHEN label <> 'title' THEN label END IGNORE NULLS) OVER (PARTITION BY {{keys}} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_body_label
            FROM {{src}} WHERE trim(text) <> '' AND label IN ({FIVE})
          ) a) b) c) d) e) f GROUP BY {{keys}}, sec, q, slot"""

EXPECTED["gold_slots"] = _NEST.replace("{keys}", "doc_id").replace("{src}", "{gold_blocks}")
EXPECTED["pred_slots"] = _NEST.replace("{keys}", "tag, doc_id").replace("{src}", "{pred_blocks}")

_QUESTIONS = """
SELECT s.{k1} coalesce(t.text, '') AS doc_title, s.sec, coalesce(s.sec_title, '') AS sec_title, coalesce(s.sec_desc, '') AS sec_desc,
  coalesce(q.q, 0) AS q, coalesce(q.question, '') AS question, coalesce(q.answer, '') AS answer
FROM (SELECT {keys}, sec, max(CASE WHEN slot = 'section.title' THEN text END) AS sec_title,
        max(CASE WHEN slot = 'section.description' THEN text END) AS sec_desc FROM {src} WHERE sec > 0 GROUP BY ALL) s
LEFT JOIN (SELECT {keys}, sec, q, max(CASE WHEN slot = 'question.text' THEN text END) AS question,
        max(CASE WHEN slot = 'answer.text' THEN text END) AS answer FROM {src} WHERE q > 0 GROUP BY ALL) q USING ({keys}, sec)
LEFT JOIN (SELECT {keys}, text FROM {src} WHERE sec = 0) t USING ({keys})"""


def _questions(src: str, keys: str) -> str:
    k1 = "doc_id," if keys == "doc_id" else "tag, s.doc_id,"
    return _QUESTIONS.replace("{k1}", k1).replace("{keys}", keys).replace("{src}", src)


# The 16-row table itself, row by row, each filled question judged alone.
EXPECTED["rule_table"] = """
SELECT * FROM (VALUES (1,'EEEE',0,''),(2,'EEEN',0,''),(3,'EENE',2,'section.description'),(4,'EENN',0,''),(5,'ENEE',1,'section.title'),(6,'ENEN',0,''),
 (7,'ENNE',1,'section.title'),(8,'ENNN',0,''),(9,'NEEE',2,'title'),(10,'NEEN',0,''),(11,'NENE',1,'section.description'),(12,'NENN',0,''),
 (13,'NNEE',1,'section.title'),(14,'NNEN',0,''),(15,'NNNE',1,'section.title'),(16,'NNNN',0,'')) r("row", state, n_actions, source)"""

_STATE = " || ".join(f"CASE WHEN trim({c}) = '' THEN 'E' ELSE 'N' END" for c in ("doc_title", "sec_title", "sec_desc", "question"))

_FILLED = f"""
SELECT {{keys}}, doc_title, sec,
  CASE WHEN max(CASE WHEN n_actions = 2 AND q > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY {{keys}}, sec) = 1
       THEN max(CASE WHEN n_actions = 2 AND q > 0 THEN src END) OVER (PARTITION BY {{keys}}, sec) ELSE sec_title END AS sec_title,
  sec_desc, q, CASE WHEN q > 0 AND n_actions > 0 THEN src ELSE question END AS question, answer, question AS was, state, source FROM (
  SELECT x.*, r.n_actions, r.source, CASE r.source WHEN 'title' THEN doc_title WHEN 'section.title' THEN sec_title WHEN 'section.description' THEN sec_desc END AS src
  FROM (SELECT *, {_STATE} AS state FROM {{src}}) x JOIN {{rule_table}} r USING (state)) y"""

for _side, _keys in (("gold", "doc_id"), ("pred", "tag, doc_id")):
    EXPECTED[f"{_side}_questions"] = _questions("{" + _side + "_slots}", _keys)
    EXPECTED[f"{_side}_filled"] = _FILLED.replace("{keys}", _keys).replace("{src}", "{" + _side + "_questions}")

_RANK = "list_position(['title', 'section.title', 'section.description', 'question.text', 'answer.text'], slot) - 1"
_ORD = f"CAST(sec AS BIGINT) * 17179869184 + CAST(q AS BIGINT) * 8 + {_RANK}"
# Items of stage 3 (path A, repeated headings dropped) and stage 4 (path B).
_ITEMS_A = (
    f"SELECT {{keys}}, {_ORD} AS ord, text, slot AS label FROM {{src}} s WHERE NOT (slot = 'question.text' AND EXISTS "
    "(SELECT 1 FROM {src} h WHERE {same} AND h.sec = s.sec AND h.slot = 'section.title' AND h.text = s.text))"
)
_CELLS = (
    "SELECT {keys}, 0 AS sec, 0 AS q, 'title' AS slot, text FROM {slots} WHERE sec = 0 "
    "UNION ALL SELECT DISTINCT {keys}, sec, 0, 'section.title', sec_title FROM {filled} WHERE sec_title <> '' "
    "UNION ALL SELECT DISTINCT {keys}, sec, 0, 'section.description', sec_desc FROM {filled} WHERE sec_desc <> '' "
    "UNION ALL SELECT {keys}, sec, q, 'question.text', question FROM {filled} WHERE q > 0 AND question <> '' "
    "UNION ALL SELECT {keys}, sec, q, 'answer.text', answer FROM {filled} WHERE q > 0 AND answer <> ''"
)
for _side, _keys, _same in (("gold", "doc_id", "h.doc_id = s.doc_id"), ("pred", "tag, doc_id", "h.tag = s.tag AND h.doc_id = s.doc_id")):
    EXPECTED[f"{_side}_items_a"] = _ITEMS_A.replace("{keys}", _keys).replace("{src}", "{" + _side + "_slots}").replace("{same}", _same)
    EXPECTED[f"{_side}_cells_b"] = _CELLS.replace("{keys}", _keys).replace("{slots}", "{" + _side + "_slots}").replace("{filled}", "{" + _side + "_filled}")
    EXPECTED[f"{_side}_items_b"] = f"SELECT {_keys}, {_ORD} AS ord, text, slot AS label FROM {{{_side}_cells_b}}"

# ---- blocks ------------------------------------------------------------------------------

_RAW = """SELECT conv_id * 100 + turn AS doc_id,
 CASE (conv_id + turn) % 6 WHEN 0 THEN '' WHEN 1 THEN concat('```json', chr(10), '[{"text": "', role, '", "label": "title"}]', chr(10), '```')
 WHEN 2 THEN concat('{"n": 1, "labels": [{"text": "', role, '"}, {"text": "two", "label": null}]}') WHEN 3 THEN '[{"text": '
 WHEN 4 THEN '{"n": 1}' ELSE concat('[{"text": "', role, '", "label": "answer.text"}]') END AS raw FROM {conversations}"""


@case(
    "b1_parse_blocks_json",
    """SELECT conv_id * 100 + turn AS doc_id, CASE (conv_id + turn) % 6 WHEN 1 THEN concat(role, '=title') WHEN 2 THEN concat(role, '=answer.text;two=null')
    WHEN 5 THEN concat(role, '=answer.text') ELSE '' END AS blocks,
    CASE (conv_id + turn) % 6 WHEN 0 THEN 'empty response' WHEN 3 THEN 'not valid JSON' WHEN 4 THEN 'no list in the response' END AS reason FROM {conversations}""",
)
def _(v):
    raw = v.spark.sql(_RAW.replace('{"', '{{"').replace('"}', '"}}').replace(": 1}", ": 1}}").replace("null}]}", "null}}]}}"), conversations=v("conversations"))
    parsed = B.parse_blocks_json(raw)
    shown = F.array_join(F.transform("blocks", lambda b: F.concat(b["text"], F.lit("="), F.coalesce(b["label"], F.lit("null")))), ";")
    return parsed.select("doc_id", shown.alias("blocks"), "reason")


_COLLAPSED = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
EXPECTED["clean"] = f"SELECT tag, doc_id, pos, {_COLLAPSED} AS text, label, confidence, page FROM {{pred_blocks}} WHERE {_COLLAPSED} <> ''"


@case("b2_clean_blocks", "SELECT tag, doc_id, pos, text, label FROM {clean}")
def _(v):
    return B.clean_blocks(v("pred_blocks")).select("tag", "doc_id", "pos", "text", "label")


@case("b3_dropped_blocks", "SELECT tag, label, count(*) AS n FROM {pred_blocks} WHERE trim(text) = '' GROUP BY ALL")
def _(v):
    return B.dropped_blocks(v("pred_blocks"))


_COUNTS = ", ".join(f"count(*) FILTER (label = '{x}') AS {x.replace('.', '_')}" for x in LABELS)


@case("b4_label_counts", f"SELECT tag, doc_id, {_COUNTS}, count(*) AS n_blocks FROM {{pred_blocks}} GROUP BY ALL")
def _(v):
    return B.label_counts(v("pred_blocks"))


@case("b5_page_count", "SELECT tag, doc_id, count(DISTINCT page) AS n_pages FROM {pred_blocks} GROUP BY ALL")
def _(v):
    return B.page_count(v("pred_blocks"))


EXPECTED["run_rows"] = """SELECT *, sum(changed) OVER (PARTITION BY tag, doc_id ORDER BY pos) AS run_no FROM (
  SELECT *, CASE WHEN lag(label) OVER w IS NOT DISTINCT FROM label AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS changed
  FROM {clean} WINDOW w AS (PARTITION BY tag, doc_id ORDER BY pos)) x"""
EXPECTED["joined_runs"] = """SELECT tag, doc_id, min(pos) AS pos, any_value(label) AS label, string_agg(text, ' ' ORDER BY pos) AS text,
  min(confidence) AS confidence, count(*) AS n_blocks FROM {run_rows} GROUP BY tag, doc_id, run_no"""


def joined_runs(v: Views):
    return B.join_runs(B.clean_blocks(v("pred_blocks")), chunks=chunks(v))


@case("b6_join_runs", "SELECT * FROM {joined_runs}")
def _(v):
    return joined_runs(v)


@case("b7_item_confidence", "SELECT tag, doc_id, pos, round(confidence, 6) AS confidence, n_blocks FROM {joined_runs}")
def _(v):
    return joined_runs(v).select("tag", "doc_id", "pos", "confidence", "n_blocks")


EXPECTED["doc_runs"] = "SELECT tag, doc_id, count(*) AS n_blocks, CAST(sum(changed) AS BIGINT) AS n_runs FROM {run_rows} GROUP BY ALL"


@case("b8_label_runs", "SELECT *, round(n_runs / n_blocks, 6) AS runs_per_block FROM {doc_runs}")
def _(v):
    return B.label_runs(B.clean_blocks(v("pred_blocks")), chunks=chunks(v))


EXPECTED["disagreements"] = """SELECT a.doc_id, a.pos, a.text, a.label AS label_a, b.label AS label_b FROM {pred_blocks} a JOIN {pred_blocks} b
  ON a.doc_id = b.doc_id AND a.pos = b.pos WHERE a.tag = 'run1' AND b.tag = 'run2' AND a.label IS DISTINCT FROM b.label"""


def two_runs(v: Views):
    p = v("pred_blocks")
    return p.where("tag = 'run1'"), p.where("tag = 'run2'")


@case("b9_label_disagreements", "SELECT * FROM {disagreements}")
def _(v):
    return B.label_disagreements(*two_runs(v))


@case(
    "b9_disagreement_window",
    """SELECT a.doc_id, a.pos, a.text, a.label AS label_a, b.label AS label_b FROM {pred_blocks} a JOIN (
      SELECT doc_id, greatest(0, pos - 1) AS start FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i,
        count(*) OVER (PARTITION BY doc_id) AS n FROM {disagreements}) d WHERE i = n // 2) s ON a.doc_id = s.doc_id AND a.pos >= start AND a.pos < start + 3
    LEFT JOIN {pred_blocks} b ON b.tag = 'run2' AND a.doc_id = b.doc_id AND a.pos = b.pos WHERE a.tag = 'run1'""",
)
def _(v):
    return B.disagreement_window(*two_runs(v), before=1, rows=3, chunks=chunks(v))


@case("b10_labels_wide", "SELECT doc_id, pos, " + ", ".join(f"max(label) FILTER (tag = '{t}') AS {t}" for t in TAGS) + " FROM {pred_blocks} GROUP BY ALL")
def _(v):
    return B.labels_wide(v("pred_blocks"), TAGS)


@case("b11_label_blocks", "SELECT tag, doc_id, pos, CASE WHEN contains(text, '.') THEN 'answer.text' ELSE 'title' END AS label FROM {pred_blocks}")
def _(v):
    def labeler(texts):
        return ["answer.text" if "." in t else "title" for t in texts]

    return B.label_blocks(v("pred_blocks").select("tag", "doc_id", "pos", "text"), labeler).drop("text")


TEMPLATE = "SYSTEM:\nToday is <<TODAY>>.\n\nPROMPT (user):\nSchema {schema_text}\nText: {dmp_text}\nEnd\n"


@case(
    "b12_render_prompts",
    "SELECT doc_id, concat('Today is 2024-05-01.', chr(10)) AS system_prompt, concat('Schema S', chr(10), 'Text: ', text, chr(10), 'End') AS user_prompt FROM {documents}",
)
def _(v):
    return B.render_prompts(v("documents"), TEMPLATE, "S", "2024-05-01").select("doc_id", "system_prompt", "user_prompt")


# ---- nesting -----------------------------------------------------------------------------

_SLOTS = "SELECT tag, doc_id, CAST(sec AS BIGINT) AS sec, CAST(q AS BIGINT) AS q, slot, text FROM {pred_slots}"


@case("n1_nest", _SLOTS)
def _(v):
    return pred_slots(v)


@case("n1_nest_gold", "SELECT doc_id, CAST(sec AS BIGINT) AS sec, CAST(q AS BIGINT) AS q, slot, text FROM {gold_slots}")
def _(v):
    return gold_slots(v)


@case("n1a_document_title", "SELECT tag, doc_id, text FROM {pred_slots} WHERE slot = 'title'")
def _(v):
    return pred_slots(v).where("slot = 'title'").select("tag", "doc_id", "text")


@case("n1b_sections", "SELECT tag, doc_id, CAST(max(sec) AS BIGINT) AS n_sections FROM {pred_slots} GROUP BY ALL")
def _(v):
    return pred_slots(v).groupBy("tag", "doc_id").agg(F.max("sec").alias("n_sections"))


@case("n1c_descriptions", "SELECT tag, doc_id, CAST(sec AS BIGINT) AS sec, text FROM {pred_slots} WHERE slot = 'section.description'")
def _(v):
    return pred_slots(v).where("slot = 'section.description'").select("tag", "doc_id", "sec", "text")


@case("n1d_questions", "SELECT tag, doc_id, CAST(sec AS BIGINT) AS sec, CAST(q AS BIGINT) AS q, text FROM {pred_slots} WHERE slot = 'question.text'")
def _(v):
    return pred_slots(v).where("slot = 'question.text'").select("tag", "doc_id", "sec", "q", "text")


@case("n1e_answers", "SELECT tag, doc_id, CAST(sec AS BIGINT) AS sec, CAST(q AS BIGINT) AS q, text FROM {pred_slots} WHERE slot = 'answer.text'")
def _(v):
    return pred_slots(v).where("slot = 'answer.text'").select("tag", "doc_id", "sec", "q", "text")


@case("n1f_orders", "SELECT tag, doc_id, CAST(sec AS BIGINT) AS sec, CAST(max(q) AS BIGINT) AS last_q FROM {pred_slots} WHERE sec > 0 GROUP BY ALL")
def _(v):
    return pred_slots(v).where("sec > 0").groupBy("tag", "doc_id", "sec").agg(F.max("q").alias("last_q"))


@case(
    "n1g_skipped_blocks",
    f"""SELECT tag, CASE WHEN trim(coalesce(text, '')) = '' THEN 'blank text' ELSE 'unknown label' END AS reason, count(*) AS n FROM {{pred_blocks}}
    WHERE trim(coalesce(text, '')) = '' OR label IS NULL OR label NOT IN ({FIVE}) GROUP BY ALL UNION ALL
    SELECT tag, 'kept', count(*) FROM {{pred_blocks}} WHERE trim(text) <> '' AND label IN ({FIVE}) GROUP BY ALL""",
)
def _(v):
    blocks = v("pred_blocks")
    # What nesting keeps of one-block documents is what it does not skip.
    single = blocks.withColumn("doc_id", F.concat_ws("/", "doc_id", "pos"))
    kept = N.nest(single, chunks=None).groupBy("tag").agg(F.count_distinct("doc_id").alias("n")).select("tag", F.lit("kept").alias("reason"), "n")
    return N.skipped_blocks(blocks).groupBy("tag", "reason").agg(F.count("*").alias("n")).unionByName(kept)


@case(
    "n2_empty_sections",
    """SELECT tag, doc_id, CAST(sec AS BIGINT) AS sec, sec_title, sec = last_sec AS is_last FROM (
      SELECT tag, doc_id, sec, sec_title, max(q) OVER (PARTITION BY tag, doc_id, sec) AS q, max(sec) OVER (PARTITION BY tag, doc_id) AS last_sec FROM {pred_questions}) x WHERE q = 0""",
)
def _(v):
    return N.empty_sections(pred_slots(v))


@case(
    "n1_structured_tree",
    """SELECT tag, doc_id, coalesce(max(doc_title), '') AS title, CAST(count(DISTINCT sec) AS BIGINT) AS n_sections, CAST(sum(CASE WHEN q > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_questions
    FROM (SELECT tag, doc_id, doc_title, sec, q FROM {pred_questions} UNION ALL SELECT tag, doc_id, text, NULL, 0 FROM {pred_slots} WHERE sec = 0) x GROUP BY tag, doc_id""",
)
def _(v):
    sections = F.col("narrative.template.section")
    return N.to_structured(pred_slots(v)).select(
        "tag", "doc_id", F.col("narrative.template.title").alias("title"), F.size(sections).alias("n_sections"),
        F.aggregate(F.transform(sections, lambda s: F.size(s["question"])), F.lit(0), lambda a, b: a + b).alias("n_questions"),
    )


_ROUND_TRIP = (
    _SLOTS + " UNION ALL SELECT tag, doc_id, CAST(sec AS BIGINT), CAST(q AS BIGINT), 'question.text', '' FROM {pred_questions} WHERE q > 0 AND question = '' "
    "UNION ALL SELECT DISTINCT tag, doc_id, CAST(sec AS BIGINT), 0, 'section.title', '' FROM {pred_questions} WHERE sec_title = ''"
)


@case("n1_structured_round_trip", _ROUND_TRIP)
def _(v):
    return N.from_structured(N.to_structured(pred_slots(v)))


# ---- stage files: the tables above as JSON texts, parsed again ---------------------------


def block_files(v: Views):
    """Block files of each run: a list, or for odd documents an object; some hold neither."""
    block = F.struct("text", "label", "confidence", "page")
    listed = v("pred_blocks").groupBy("tag", "doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", block.alias("b")))).alias("l"))
    rows = listed.withColumn("blocks", F.transform("l", lambda x: x["b"]))
    keep = {"ignoreNullFields": "false"}
    text = F.when(F.col("doc_id") % 11 == 5, '{"note": 1}').when(F.col("doc_id") % 2 == 1, F.to_json(F.struct("blocks"), keep)).otherwise(F.to_json("blocks", keep))
    return rows.select("tag", "doc_id", F.format_string("%s/%d.json", "tag", "doc_id").alias("file"), text.alias("raw"))


@case("io1_parse_block_files", "SELECT tag, doc_id, row_number() OVER (PARTITION BY tag, doc_id ORDER BY pos) - 1 AS pos, coalesce(text, '') AS text, label, confidence, CAST(page AS BIGINT) AS page FROM {pred_blocks} WHERE doc_id % 11 <> 5")
def _(v):
    return IO.parse_block_files(block_files(v))[0]


@case("io1_rejected_block_files", "SELECT DISTINCT tag, doc_id, concat(tag, '/', doc_id, '.json') AS file, 'no list of blocks' AS reason FROM {pred_blocks} WHERE doc_id % 11 = 5")
def _(v):
    return IO.parse_block_files(block_files(v))[1]


def structured_files(trees):
    text = F.when(F.col("doc_id") % 11 == 5, "[1]").when(F.col("doc_id") % 2 == 1, F.to_json(F.struct("narrative"))).otherwise(F.to_json("narrative"))
    name = F.when(F.col("doc_id") % 5 == 1, F.format_string("s%d_v2.json", "doc_id")).otherwise(F.format_string("dmp_sample%d_new.json", "doc_id"))
    return trees.select(*[c for c in trees.columns if c != "narrative"], name.alias("file"), text.alias("raw"))


@case("io2_parse_structured_files", "SELECT * FROM (" + _ROUND_TRIP + ") z WHERE doc_id % 11 <> 5")
def _(v):
    return N.from_structured(IO.parse_structured_files(structured_files(N.to_structured(pred_slots(v))))[0])


@case("io2_rejected_structured_files", "SELECT DISTINCT tag, doc_id, 'root is not an object' AS reason FROM {pred_slots} WHERE doc_id % 11 = 5")
def _(v):
    return IO.parse_structured_files(structured_files(N.to_structured(pred_slots(v))))[1].drop("file")


@case(
    "io3_parse_annotations",
    "SELECT doc_id, coalesce(max(text) FILTER (slot = 'title'), '') AS title, count(DISTINCT sec) FILTER (sec > 0) AS n_sections FROM {gold_slots} WHERE doc_id % 5 <> 1 AND doc_id % 11 <> 5 GROUP BY doc_id",
)
def _(v):
    files = structured_files(N.to_structured(gold_slots(v), DOC)).withColumns({"tag": F.lit("gold"), "doc_id": IO.doc_number(F.col("file"))})
    template = F.col("narrative.template")
    return IO.parse_annotations(files).select("doc_id", template["title"].alias("title"), F.size(template["section"]).alias("n_sections"))


@case("io10_export_table", "SELECT tag, doc_id, ord, label, text FROM {pred_items_b}")
def _(v):
    return IO.export_table(R.apply_rules(pred_slots(v), long_docs=long(v)))


# ---- rules -------------------------------------------------------------------------------


@case("io4_rules", 'SELECT CAST(r."row" AS BIGINT) AS "row", state, CAST(n_actions AS BIGINT) AS n_actions, count(x.sec) AS n FROM {rule_table} r LEFT JOIN (SELECT *, ' + _STATE + " AS state FROM {gold_questions} WHERE q > 0) x USING (state) GROUP BY ALL")
def _(v):
    return R.rule_hits(gold_slots(v), DOC, long(v))


@case(
    "io4_rule_actions",
    """SELECT CAST(r."row" AS BIGINT) AS "row", source, target, count(x.sec) AS n FROM (VALUES
      (3,'EENE','section.description','section.title'),(3,'EENE','section.description','question.text'),(5,'ENEE','section.title','question.text'),
      (7,'ENNE','section.title','question.text'),(9,'NEEE','title','section.title'),(9,'NEEE','title','question.text'),
      (11,'NENE','section.description','question.text'),(13,'NNEE','section.title','question.text'),(15,'NNNE','section.title','question.text')) r("row", state, source, target)
    LEFT JOIN (SELECT *, """ + _STATE + """ AS state FROM {gold_questions} WHERE q > 0) x USING (state) GROUP BY ALL""",
)
def _(v):
    """What each row of the table copies where, and how many questions it meets."""
    actions = R.rules_df(v.spark).select("row", F.inline("actions"))
    return R.rule_hits(gold_slots(v), DOC, long(v)).join(actions, "row").select("row", "source", "target", "n")


@case("r1_state", f"SELECT tag, {_STATE} AS state, count(*) AS n FROM {{pred_questions}} WHERE q > 0 GROUP BY ALL")
def _(v):
    q = N.to_questions(pred_slots(v), long_docs=long(v)).where("q > 0")
    s = R.state(F.col("doc_title"), F.col("sec_title"), F.col("sec_desc"), F.col("question"))
    return q.select("tag", s.alias("state")).groupBy("tag", "state").agg(F.count("*").alias("n"))


@case("r2_apply_rules", "SELECT tag, doc_id, doc_title, CAST(sec AS BIGINT) AS sec, sec_title, sec_desc, CAST(q AS BIGINT) AS q, question, answer FROM {pred_filled}")
def _(v):
    return R.fill(N.to_questions(pred_slots(v), long_docs=long(v)), long_docs=long(v))


@case("r3_rule_hits", 'SELECT CAST(r."row" AS BIGINT) AS "row", state, CAST(n_actions AS BIGINT) AS n_actions, count(x.sec) AS n FROM {rule_table} r LEFT JOIN (SELECT *, ' + _STATE + " AS state FROM {pred_questions} WHERE q > 0) x USING (state) GROUP BY ALL")
def _(v):
    return R.rule_hits(pred_slots(v), long_docs=long(v))


@case(
    "r4_convert_run",
    "SELECT tag, (SELECT count(DISTINCT doc_id) FROM {pred_slots} s WHERE s.tag = f.tag) AS n_docs, count(*) FILTER (question <> '') AS n_questions, "
    "count(*) FILTER (was <> question) AS n_filled FROM {pred_filled} f WHERE q > 0 GROUP BY tag",
)
def _(v):
    slots = pred_slots(v)
    filled, docs = P.convert_run(slots, long(v))
    asked = lambda s, name: s.where("slot = 'question.text' AND text <> ''").select("tag", "doc_id", "sec", "q", F.col("text").alias(name))
    both = asked(filled, "now").join(asked(slots, "was"), ["tag", "doc_id", "sec", "q"], "left")
    counts = both.groupBy("tag").agg(F.count("*").alias("n_questions"), F.count_if(~F.col("now").eqNullSafe(F.col("was"))).alias("n_filled"))
    return docs.join(counts, "tag")


@case("r4_converted_items", "SELECT tag, doc_id, ord, text, label FROM {pred_items_b}")
def _(v):
    return N.to_items(P.convert_run(pred_slots(v), long(v))[0], dedup=False)


EXPECTED["clean_slots"] = _NEST.replace("{keys}", "tag, doc_id").replace("{src}", "{clean}")


@case("n1_narratives_from_answers", "SELECT tag, doc_id, CAST(sec AS BIGINT) AS sec, CAST(q AS BIGINT) AS q, slot, text FROM {clean_slots} WHERE doc_id % 11 <> 5 AND doc_id % 3 <> 0")
def _(v):
    """The whole job from raw answers, without the documents that are done; answers that hold no list drop out."""
    answers = block_files(v).drop("file")
    done = answers.where("doc_id % 3 = 0").select("tag", "doc_id")
    return W.narratives(answers, done, chunks=chunks(v))["nested"]


@case("r5_rule_diff", "SELECT tag, doc_id, CAST(sec AS BIGINT) AS sec, CAST(q AS BIGINT) AS q, was, question AS now, source AS filled_from FROM {pred_filled} WHERE q > 0 AND was <> question")
def _(v):
    return R.rule_diff(pred_slots(v), long_docs=long(v))


@case(
    "r6_rules_reproduce",
    """SELECT doc_id, bool_and(same) AS reproduced, count(*) FILTER (NOT same) AS n_different FROM (
      SELECT f.doc_id, trim(f.sec_title) IS NOT DISTINCT FROM trim(g.sec_title) AND trim(f.question) IS NOT DISTINCT FROM trim(g.question) AS same
      FROM {gold_filled} f JOIN {gold_questions} g USING (doc_id, sec, q) WHERE f.q > 0) x GROUP BY ALL""",
)
def _(v):
    old = gold_slots(v)
    return R.rules_reproduce(old, old, DOC, long(v))


@case("r7_fill_state", "SELECT tag, doc_id, CAST(sec AS BIGINT) AS sec, CAST(q AS BIGINT) AS q, trim(question) <> '' AS filled FROM {pred_questions} WHERE q > 0 AND contains(lower(sec_title), 'the')")
def _(v):
    return R.fill_state(pred_slots(v), "The", long_docs=long(v))


# ---- flattening --------------------------------------------------------------------------


@case("f1_to_items", "SELECT tag, doc_id, ord, text, label FROM {pred_items_a}")
def _(v):
    return N.to_items(pred_slots(v), long_docs=long(v))


@case("f1_to_items_keep", "SELECT tag, doc_id, ord, text, label FROM {pred_items_b}")
def _(v):
    return N.to_items(R.apply_rules(pred_slots(v), long_docs=long(v)), dedup=False)


@case("f2_to_label_text", "SELECT tag, doc_id, ord, label, text FROM {pred_items_b}")
def _(v):
    return N.to_label_text(R.apply_rules(pred_slots(v), long_docs=long(v)))


@case("f3_to_questions", "SELECT tag, doc_id, doc_title, CAST(sec AS BIGINT) AS sec, sec_title, sec_desc, CAST(q AS BIGINT) AS q, question, answer FROM {pred_questions}")
def _(v):
    return N.to_questions(pred_slots(v), long_docs=long(v))


@case(
    "f4_doc_shape",
    """SELECT tag, doc_id, count(DISTINCT CASE WHEN sec > 0 THEN sec END) AS n_sections, count(*) FILTER (slot = 'question.text') AS n_questions,
    count(*) FILTER (slot = 'answer.text') AS n_answers FROM {pred_slots} GROUP BY ALL""",
)
def _(v):
    return N.doc_shape(pred_slots(v))


@case("f5_item_summary", f"SELECT tag, doc_id, count(*) AS n_rows, {_COUNTS} FROM {{pred_items_a}} GROUP BY ALL")
def _(v):
    return N.item_summary(N.to_items(pred_slots(v), long_docs=long(v)))
