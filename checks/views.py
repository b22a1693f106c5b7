"""Operator inputs derived from the driver tables, for Spark and as DuckDB CTEs.

Most derivations are plain SQL that both engines read; the few that take texts apart differ in
their table functions and are written twice. Operators and their oracle queries never share code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

RUNS = "(SELECT 'run1' AS tag, 0 AS seed UNION ALL SELECT 'run2' AS tag, 1 AS seed UNION ALL SELECT 'run3' AS tag, 2 AS seed)"

# name -> SQL for both engines. {name} stands for a table or another view.
BOTH: dict[str, str] = {}
# name -> (Spark SQL, DuckDB SQL)
SPLIT: dict[str, tuple[str, str]] = {}
# name -> DuckDB SQL only: what an operator is expected to give, used by later oracles.
EXPECTED: dict[str, str] = {}

# ---- labeled blocks ----------------------------------------------------------------------

BOTH["gold_blocks"] = """
SELECT conv_id AS doc_id, turn AS pos,
  CASE WHEN (conv_id * 5 + turn) % 19 = 6 THEN '   '
       WHEN (conv_id * 5 + turn) % 19 = 8 THEN concat('  ', text, ' ') ELSE text END AS text,
  CASE WHEN (conv_id + turn * 3) % 31 = 7 THEN 'caption'
       WHEN (conv_id + turn * 2) % 9 = 0 THEN 'title'
       WHEN role = 'system' THEN 'section.title'
       WHEN (conv_id + turn) % 7 = 2 THEN 'section.description'
       WHEN (conv_id * 3 + turn) % 5 = 4 THEN 'section.title'
       WHEN role = 'user' THEN 'question.text' ELSE 'answer.text' END AS label
FROM {conversations}"""

BOTH["pred_blocks"] = f"""
SELECT tag, doc_id, pos,
  CASE WHEN h = 3 THEN concat('unrelated words said here about ', label)
       WHEN h = 4 THEN concat('foreign heading fused onto this ', text) ELSE text END AS text,
  CASE WHEN h = 1 THEN 'answer.text' WHEN h = 2 THEN 'question.text' WHEN h = 5 THEN 'section.description' ELSE label END AS label,
  CAST((doc_id * 13 + pos * 7 + seed * 3) % 101 AS DOUBLE) / 100 AS confidence,
  CASE WHEN (doc_id + pos) % 13 = 4 THEN NULL ELSE CAST(floor(pos / 3) AS INT) END AS page
FROM (SELECT tag, doc_id, pos, text, label, seed, (doc_id * 7 + pos * 3 + seed * 5) % 11 AS h
      FROM {{gold_blocks}} CROSS JOIN {RUNS} r) b
WHERE h <> 0"""

# Spark spreads the runs from the row itself, so no join is planned for them.
_RUN_ROWS = "inline(array(struct('run1' AS tag, 0 AS seed), struct('run2' AS tag, 1 AS seed), struct('run3' AS tag, 2 AS seed)))"
_pred = BOTH.pop("pred_blocks")
SPLIT["pred_blocks"] = (_pred.replace(f"{{gold_blocks}} CROSS JOIN {RUNS} r", f"(SELECT *, {_RUN_ROWS} FROM {{gold_blocks}}) g"), _pred)

# ---- texts -------------------------------------------------------------------------------

BOTH["texts"] = """
SELECT doc_id, lang, source,
  CASE doc_id % 50 WHEN 7 THEN concat(repeat('(cid:12) ', 11), text)
    WHEN 9 THEN concat(repeat('�', 12), text) WHEN 11 THEN '  '
    WHEN 13 THEN 'a scanned page with hardly any text' ELSE text END AS text,
  CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 1 + CAST(floor(length(text) / 400) AS INT) END AS n_pages
FROM {documents}"""

BOTH["candidates"] = """
SELECT doc_id, extractor, rnk AS rank, source, n_pages,
  CASE WHEN doc_id % bad = 1 THEN concat(repeat('(cid:7)', 11), text)
       WHEN source = 'cache' AND doc_id % 6 = 1 THEN '' ELSE concat(text, ' ', extractor) END AS text
FROM (
  SELECT doc_id, text, n_pages, 'native' AS extractor, 0 AS rnk, 'cache' AS source, 4 AS bad FROM {texts}
  UNION ALL SELECT doc_id, text, n_pages, 'layout', 1, 'cache', 8 FROM {texts} WHERE doc_id % 2 = 1
  UNION ALL SELECT doc_id, text, n_pages, 'layout', 1, 'fresh', 8 FROM {texts} WHERE doc_id % 5 <> 0
  UNION ALL SELECT doc_id, text, n_pages, 'ocr', 2, 'fresh', 16 FROM {texts} WHERE doc_id % 7 <> 0
) c"""

BOTH["candidates_fresh"] = """
SELECT doc_id, extractor, rank, n_pages, text FROM {candidates} WHERE rank = 0 OR source = 'fresh'"""

_MARKED = """
SELECT conv_id * 100 + turn AS doc_id, concat('# ', role, ' part', chr(10), {bold}, ' plain _word', CAST(turn AS {s}), '_ and *star*',
  {under}, chr(10), replace(replace(replace(replace(text, '*', ' '), '_', ' '), '+', ' '), '#', ' ')) AS text
FROM {{conversations}}"""
for _name, _bold, _under in (
    ("marked_a", "'** Item one **'", "' ++line++'"),
    ("marked_b", "CASE WHEN conv_id % 3 = 0 THEN 'Item one' ELSE '**Item one**' END", "CASE WHEN conv_id % 2 = 0 THEN ' ++line++' ELSE ' line' END"),
):
    SPLIT[_name] = tuple(_MARKED.format(bold=_bold, under=_under, s=s) for s in ("STRING", "VARCHAR"))

BOTH["edited"] = """
SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN concat('these invented sentences never occurred anywhere', chr(10), text)
  WHEN doc_id % 4 = 2 THEN replace(text, ' the ', ' forgotten ') ELSE text END AS text
FROM {documents}"""

BOTH["turn_pages"] = """
SELECT conv_id AS doc_id, turn + 1 AS page_no,
  CASE (conv_id + turn) % 4
    WHEN 0 THEN concat('Page ', turn + 1, chr(10), lower(text), chr(10), chr(10), turn + 1, ' of 9', chr(10))
    WHEN 1 THEN concat(chr(10), text, chr(10), turn + 1)
    WHEN 2 THEN concat(lower(text), ' and', chr(10), '7', chr(10), 'so', chr(10), '  ')
    ELSE concat(turn + 1, chr(10), ' ') END AS text
FROM {conversations}"""

# ---- words -------------------------------------------------------------------------------

_WORD_ROWS = """
SELECT doc_id, CAST(floor(line_no / 20) AS BIGINT) + 1 AS page_no, line_no, word_no + line_no * 100000 AS word_no,
  CASE WHEN (doc_id + line_no) % 9 = 4 THEN {twice}
       WHEN (doc_id + word_no) % 41 = 3 THEN concat('http:', w) ELSE w END AS text,
  CASE WHEN line_no % 20 = 0 THEN 'AAAA+Times-Bold' WHEN (doc_id + line_no + word_no) % 13 < 2 THEN 'Times-Bold'
       WHEN (doc_id + line_no + word_no) % 17 = 3 THEN 'Times-Italic' ELSE 'Times-Roman' END AS fontname,
  CAST(CASE WHEN line_no % 20 = 1 THEN 12 ELSE 10 END AS DOUBLE) AS size,
  CAST(word_no * 40 AS DOUBLE) AS x0, CAST(word_no * 40 + least(38, 5 * length(w)) AS DOUBLE) AS x1,
  CAST((line_no % 20) * 14 AS DOUBLE) + CASE WHEN (doc_id + word_no) % 37 = 5 THEN CAST(0.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS top,
  CAST((line_no % 20) * 14 + 10 AS DOUBLE) AS bottom
FROM {rows}"""

SPLIT["lines"] = (
    "SELECT doc_id, CAST(i AS BIGINT) AS line_no, line FROM (SELECT /*+ REPARTITION(doc_id) */ doc_id, text FROM {documents}) d "
    "LATERAL VIEW posexplode(split(text, '\\n')) x AS i, line",
    "SELECT doc_id, CAST(i - 1 AS BIGINT) AS line_no, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i "
    "FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM {documents}) a) b",
)
# Word 7 of every 23 repeats the one before it, as a text rendered twice would.
SPLIT["words"] = (
    _WORD_ROWS.format(
        twice="regexp_replace(w, '(.)', '$1$1')",
        rows="(SELECT doc_id, line_no, CAST(i AS BIGINT) AS word_no, CASE WHEN i % 23 = 7 THEN ws[i - 1] ELSE w0 END AS w FROM "
        "(SELECT doc_id, line_no, split(line, ' ') AS ws FROM {lines}) LATERAL VIEW posexplode(ws) x AS i, w0) WHERE w <> ''",
    ),
    _WORD_ROWS.format(
        twice="regexp_replace(w, '(.)', '\\1\\1', 'g')",
        rows="(SELECT doc_id, line_no, CAST(i - 1 AS BIGINT) AS word_no, CASE WHEN (i - 1) % 23 = 7 THEN ws[i - 1] ELSE ws[i] END AS w FROM "
        "(SELECT doc_id, line_no, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT doc_id, line_no, string_split(line, ' ') AS ws FROM {lines}) a) b) c WHERE w <> ''",
    ),
)
_CHAR_ROWS = """
SELECT doc_id, page_no, word_no AS of_word, k AS char_no, c AS text, CASE WHEN (doc_id + word_no) % 7 = 1 AND k % 3 <> 0 THEN 'Times-Bold' ELSE fontname END AS fontname,
  size, x0 + (x1 - x0) * k / n AS x0, x0 + (x1 - x0) * (k + 1) / n AS x1, top, bottom
FROM ({rows}) x"""
SPLIT["chars"] = (
    _CHAR_ROWS.format(rows="SELECT w.*, length(text) AS n, k, c FROM {words} w LATERAL VIEW posexplode(split(text, '')) e AS k, c WHERE c <> ''"),
    _CHAR_ROWS.format(rows="SELECT w.* EXCLUDE (text), length(text) AS n, unnest(range(0, length(text))) AS k, unnest(string_split(text, '')) AS c FROM {words} w"),
)
BOTH["plain_pages"] = """
SELECT conv_id AS doc_id, turn + 1 AS page_no, CASE WHEN (conv_id + turn) % 5 = 0 THEN '' ELSE text END AS text FROM {conversations}"""
BOTH["marked_pages"] = """
SELECT conv_id AS doc_id, turn + 1 AS page_no, concat('** ', text, ' **') AS text FROM {conversations} WHERE role = 'assistant'"""
BOTH["markdown"] = """
SELECT conv_id * 100 + turn AS doc_id, concat('## ', role, '   part ##', chr(10), chr(10), chr(10), chr(10), 'some *words* and **bold**   text', chr(10),
  replace(replace(text, '*', ' '), '#', ' ')) AS text, text AS body, role FROM {conversations}"""
BOTH["rects"] = """
SELECT doc_id, CAST(floor(line_no / 20) AS BIGINT) + 1 AS page_no, CAST(40 AS DOUBLE) AS x0,
  CAST(CASE WHEN line_no % 6 = 0 THEN 200 ELSE 44 END AS DOUBLE) AS x1, CAST((line_no % 20) * 14 + 11 AS DOUBLE) AS top,
  CAST((line_no % 20) * 14 + CASE WHEN (doc_id + line_no) % 5 = 0 THEN 14 ELSE 12 END AS DOUBLE) AS bottom
FROM {lines} WHERE (doc_id + line_no) % 3 = 0"""
BOTH["links"] = """
SELECT doc_id, CAST(floor(line_no / 20) AS BIGINT) + 1 AS page_no, line_no AS link_no, CAST(80 AS DOUBLE) AS x0, CAST(200 AS DOUBLE) AS x1,
  CAST((line_no % 20) * 14 AS DOUBLE) AS top, CAST((line_no % 20) * 14 + 10 AS DOUBLE) AS bottom, concat('http://x/', line_no) AS uri
FROM {lines} WHERE (doc_id + line_no) % 4 = 1"""
# Five lines to a block; the last block of a page is drawn over nothing.
BOTH["layout_blocks"] = """
SELECT doc_id, CAST(floor(line_no / 20) AS BIGINT) + 1 AS page_no, CAST(floor(line_no / 5) AS BIGINT) AS block_no,
  CASE WHEN line_no % 20 = 0 AND doc_id % 3 = 0 THEN 'page_header' WHEN line_no % 20 = 0 THEN 'section_header' ELSE 'text' END AS kind,
  (line_no % 20 = 0 AND doc_id % 3 = 0) AS furniture, CASE WHEN doc_id % 6 = 0 THEN 'Running   header' ELSE concat(line, '  end') END AS text,
  CAST(0 AS DOUBLE) AS l, CAST((line_no % 20) * 14 AS DOUBLE) AS t,
  CAST(CASE WHEN line_no % 20 = 15 THEN 1 ELSE 400 END AS DOUBLE) AS r, CAST((line_no % 20) * 14 + 70 AS DOUBLE) AS b
FROM {lines} WHERE line_no % 5 = 0"""

# ---- field records -----------------------------------------------------------------------

_DATASET_A = (
    "concat('{\"title\": \"Account records ', c_custkey, '\", \"description\": \"Balances kept for ', c_name, '\", \"type\": \"dataset\", "
    "\"personal_data\": \"', {personal}, '\", \"sensitive_data\": \"no\", \"dataset_id\": {\"identifier\": \"', c_custkey, '-a\", \"type\": \"other\"}, "
    "\"distribution\": [{\"title\": \"\", \"data_access\": \"open\", \"host\": {\"title\": \"', {host}, '\", \"url\": \"https://www.zenodo.org/\"}, "
    "\"license\": [{\"license_ref\": \"', {licence}, '\", \"start_date\": \"2024-03-01\"}]}], \"metadata\": []}')"
)
_DATASET_B = (
    "concat('{\"title\": \"Segment survey of ', c_mktsegment, '\", \"description\": \"null\", \"type\": \"survey\", \"personal_data\": \"yes\", "
    "\"sensitive_data\": \"unknown\", \"dataset_id\": {\"identifier\": \"', c_custkey, '-b\", \"type\": \"other\"}, \"distribution\": [], "
    "\"metadata\": [{\"description\": \"Codebook\", \"language\": \"eng\", \"metadata_standard_id\": {\"identifier\": \"ddi\", \"type\": \"other\"}}]}')"
)
_RECORD = (
    "concat('{\"dmp\": {\"title\": \"', {title}, '\", \"description\": \"', {about}, '\", \"created\": \"', {created}, '\", \"modified\": \"2024-02-03\", "
    "\"language\": \"eng\", \"ethical_issues_exist\": \"no\", ', {note}, '\"dmp_id\": {\"identifier\": \"https://doi.org/10.5/', c_custkey, '\", \"type\": \"doi\"}, "
    "\"contact\": {\"name\": \"', c_name, '\", \"mbox\": \"', {mbox}, '\", \"contact_id\": ', {ids}, '}, \"dataset\": ', {datasets}, {project}, '}}')"
)


def _fill(template: str, **parts: str) -> str:
    for key, value in parts.items():
        template = template.replace("{" + key + "}", value)
    return template


_ONE_ID = "concat('{\"identifier\": \"0000-', c_custkey, '\", \"type\": \"orcid\"}')"
_PROJECT = (
    "', \"project\": [{\"title\": \"Balance study\", \"description\": \"A study of account balances\", \"funding\": "
    "[{\"funder_id\": {\"identifier\": \"f1\", \"type\": \"ror\"}, \"funding_status\": \"granted\"}]}]'"
)
_REF = _fill(
    _RECORD, title="concat('Plan of ', c_name, ' for ', c_mktsegment)", about="'Account data of one customer'", created="'2024-01-05'",
    note="''", mbox="concat('c', c_custkey, '@example.org')", ids=_ONE_ID, project=_PROJECT,
    datasets="concat('[', " + _fill(_DATASET_A, personal="'yes'", host="'Zenodo open archive'", licence="'https://creativecommons.org/licenses/by/4.0/'") + ", ', ', " + _DATASET_B + ", ']')",
)
_A = _fill(
    _DATASET_A, personal="CASE WHEN h = 2 THEN 'maybe' ELSE 'yes' END", host="CASE WHEN h = 7 THEN 'Zenodo' ELSE 'Zenodo open archive' END",
    licence="CASE WHEN h = 4 THEN 'CC BY 4.0' ELSE 'https://creativecommons.org/licenses/by/4.0/' END",
)
_MOD = _fill(
    _RECORD, title="CASE WHEN h = 1 THEN 'Something else altogether' ELSE concat('Plan of ', c_name, ' for ', c_mktsegment) END",
    about="CASE WHEN h = 6 THEN 'N/A' ELSE 'Account data of one customer' END",
    created="CASE WHEN h = 8 THEN '2024-01-05T10:00:00Z' WHEN h = 6 THEN '2024-01-06' ELSE '2024-01-05' END",
    note="CASE WHEN h = 6 THEN '\"note\": \"extra words\", ' ELSE '' END",
    mbox="CASE WHEN h = 5 THEN concat('C', c_custkey, '@Example.org') ELSE concat('c', c_custkey, '@example.org') END",
    ids="CASE WHEN h = 9 THEN concat('[', " + _ONE_ID + ", ']') ELSE " + _ONE_ID + " END",
    project="CASE WHEN h = 7 THEN '' ELSE " + _PROJECT + " END",
    datasets="CASE WHEN h = 0 THEN concat('[', " + _DATASET_B + ", ', ', " + _A + ", ']') WHEN h = 3 THEN concat('[', " + _A + ", ']') ELSE concat('[', " + _A + ", ', ', " + _DATASET_B + ", ']') END",
)
_MODELS = "(SELECT 'm1' AS model, 1 AS m UNION ALL SELECT 'm2' AS model, 2 AS m)"
_VERSIONS = "(SELECT 'v1' AS run, 1 AS ver UNION ALL SELECT 'v2' AS run, 2 AS ver)"
# {{ }} survive one format() call; view texts are formatted once.
_esc = lambda s: s.replace("{", "{{").replace("}", "}}")
BOTH["references"] = f"SELECT c_custkey AS doc_id, {_esc(_REF)} AS raw FROM {{customer}}"
BOTH["records"] = (
    f"SELECT run, model, c_custkey AS doc_id, CASE WHEN (c_custkey + m * 3 + ver) % 29 = 5 THEN '{{{{\"dmp\": ' ELSE {_esc(_MOD)} END AS raw "
    f"FROM (SELECT c.*, run, model, m, ver, (c_custkey * 3 + m * 7 + ver * 5) % 10 AS h FROM {{customer}} c "
    f"CROSS JOIN {_MODELS} a CROSS JOIN {_VERSIONS} b) x"
)

_RECORD_ROWS = "inline(array(" + ", ".join(
    f"struct('m{m}' AS model, {m} AS m, 'v{r}' AS run, {r} AS ver)" for m in (1, 2) for r in (1, 2)
) + "))"
_recs = BOTH.pop("records")
SPLIT["records"] = (
    _recs.replace("SELECT c.*, run, model, m, ver, ", "SELECT *, ").replace(
        f"{{customer}} c CROSS JOIN {_MODELS} a CROSS JOIN {_VERSIONS} b", f"(SELECT *, {_RECORD_ROWS} FROM {{customer}}) c"
    ),
    _recs,
)

# ---- confidence rows ---------------------------------------------------------------------

SPLIT["conf_rows"] = tuple(
    f"SELECT event_type AS tag, user_id AS doc_id, event_id AS ord, CAST({k} AS DOUBLE) / 100 AS confidence, value > 5 AS correct, "
    "'answer.text' AS gold_label, CASE WHEN value > 5 THEN 'answer.text' ELSE 'title' END AS label, concat('event ', event_id) AS text FROM {events}"
    for k in ("get_json_object(props, '$.k')", "json_extract_string(props, '$.k')")
)


class Views:
    """Spark side: ``v("words")`` is the DataFrame of a table or view of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __call__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        text = BOTH[name] if name in BOTH else SPLIT[name][0]
        return self.spark.sql(text, **{d: self(d) for d in _needs(text)})


def _needs(text: str) -> list[str]:
    known = [*TABLES, *BOTH, *SPLIT, *EXPECTED]
    bare = text.replace("{{", "").replace("}}", "")
    return [n for n in known if "{" + n + "}" in bare]


def oracle(body: str) -> str:
    """A DuckDB query whose {name} places become CTEs, in order of need."""
    done: dict[str, str] = {}

    def render(text: str) -> str:
        for need in _needs(text):
            if need not in TABLES and need not in done:
                inner = BOTH.get(need) or (SPLIT[need][1] if need in SPLIT else EXPECTED[need])
                rendered = render(inner)
                done[need] = rendered
        names = {n: n if n in TABLES else f"_{n}" for n in _needs(text)}
        return text.format(**names)

    tail = render(body)
    if not done:
        return tail
    return "WITH RECURSIVE " + ",\n".join(f"_{n} AS ({t})" for n, t in done.items()) + "\n" + tail
