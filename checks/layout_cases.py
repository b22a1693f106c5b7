"""Words, boxes, lines, pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import case
from checks.views import EXPECTED, Views
from docstruct.functions import text as T
from docstruct.operators import layout as L
from docstruct.plans import texts as X

# ---- expected values ---------------------------------------------------------------------


def top(column: str, name: str) -> str:
    return f"""(SELECT doc_id, arg_min({name}, struct_pack(a := -n, b := first)) AS {name} FROM (
      SELECT doc_id, {column} AS {name}, sum(length(text)) AS n, min(word_no) AS first FROM {{words}} GROUP BY ALL) x GROUP BY doc_id)"""


EXPECTED["profile"] = f"SELECT * FROM {top('fontname', 'body_font')} a JOIN {top('round(size, 1)', 'body_size')} b USING (doc_id)"
ITALIC = "regexp_matches({f}, 'Italic|Oblique|italic|oblique')"
BOLD = "regexp_matches({f}, 'Bold|Black|Heavy|Semibold|bold|black|heavy|semibold')"
ALNUM = "regexp_matches({t}, '[\\p{{L}}\\p{{N}}]')"
URL = "(contains(lower({t}), 'http:') OR contains(lower({t}), 'https:') OR contains(lower({t}), 'www.'))"


def at(template: str, f: str = "fontname", t: str = "text") -> str:
    return template.replace("{f}", f).replace("{t}", t)


EMPH = f"(fontname <> body_font AND NOT {at(ITALIC)}) OR size > body_size + 0.5"
EXPECTED["plain_flags"] = f"""SELECT w.*, CASE WHEN {at(ALNUM)} THEN {EMPH} ELSE {at(BOLD)} OR size > body_size + 0.5 END AS emph, {at(ITALIC)} AS ital
  FROM {{words}} w JOIN {{profile}} p USING (doc_id)"""
EXPECTED["under_words"] = f"""SELECT DISTINCT w.doc_id, w.word_no FROM {{words}} w JOIN {{rects}} r USING (doc_id, page_no)
  WHERE r.bottom - r.top <= 2 AND r.x1 - r.x0 > 5 AND r.top BETWEEN w.bottom - 4 AND w.bottom + 3 AND w.x1 > r.x0 + 1 AND w.x0 < r.x1 - 1 AND NOT {at(URL, t='w.text')}"""
EXPECTED["link_words"] = """SELECT w.doc_id, w.page_no, w.word_no, w.text, l.link_no FROM {words} w JOIN {links} l USING (doc_id, page_no)
  WHERE (w.x0 + w.x1) / 2 BETWEEN l.x0 - 1 AND l.x1 + 1 AND (w.top + w.bottom) / 2 BETWEEN l.top - 1 AND l.bottom + 1"""
EXPECTED["block_words"] = """SELECT w.*, b.block_no, b.kind FROM {words} w JOIN {layout_blocks} b USING (doc_id, page_no)
  WHERE w.x0 >= b.l - 1 AND w.x1 <= b.r + 1 AND w.top >= b.t - 1 AND w.bottom <= b.b + 1"""
LINE = "PARTITION BY doc_id, page_no, line_top"
EXPECTED["lined"] = 'SELECT *, row_number() OVER (PARTITION BY doc_id, page_no, line_top ORDER BY x0, word_no) AS "at" FROM (SELECT *, round(top, 1) AS line_top FROM {plain_flags}) x'
BARE = "lower(regexp_replace(text, '[^\\p{{L}}\\p{{N}}\\p{{M}}_]', '', 'g'))"
EXPECTED["deduped"] = f"""SELECT * FROM (SELECT *, lag({BARE}) OVER ({LINE} ORDER BY "at") AS prev, {BARE} AS bare FROM {{lined}}) x WHERE bare IS DISTINCT FROM prev"""
DOUBLED = "(length(text) >= 2 AND len(list_filter(range(1, length(text), 2), lambda i: text[i] = text[i + 1])) / (length(text) / 2.0) > 0.7)"
# Every second character of each run of equal ones goes.
SINGLE = """array_to_string(list_transform(list_filter(range(1, length(text) + 1), lambda i: (i - list_max(list_filter(range(1, i + 1), lambda j: j = 1 OR text[j] <> text[j - 1]))) % 2 = 0), lambda i: text[i]), '')"""
EXPECTED["affected"] = f"SELECT *, {DOUBLED} AS doubled, coalesce(avg(CASE WHEN length(text) >= 4 THEN CASE WHEN {DOUBLED} THEN 1.0 ELSE 0.0 END END) OVER ({LINE}) > 0.5, false) AS affected FROM {{deduped}}"
EXPECTED["fixed"] = f"SELECT * REPLACE (CASE WHEN (length(text) >= 4 OR affected) AND doubled THEN {SINGLE} ELSE text END AS text) FROM {{affected}}"
EXPECTED["flagged"] = "SELECT f.*, u.word_no IS NOT NULL AS under FROM {fixed} f LEFT JOIN {under_words} u ON u.doc_id = f.doc_id AND u.word_no = f.word_no"
# Flag changes as text between two words; the line is the words with those in between.
_PREV = {c: f"coalesce(lag({c}) OVER w, false)" for c in ("emph", "ital", "under")}
_CLOSE = " || ".join(f"CASE WHEN {_PREV[c]} AND NOT {c} THEN '{m} ' ELSE '' END" for c, m in (("under", "++"), ("ital", "_"), ("emph", "**")))
_OPEN = " || ".join(f"CASE WHEN {c} AND NOT {_PREV[c]} THEN '{m} ' ELSE '' END" for c, m in (("emph", "**"), ("ital", "_"), ("under", "++")))
_END = " || ".join(f"""CASE WHEN arg_max({c}, "at") THEN ' {m}' ELSE '' END""" for c, m in (("under", "++"), ("ital", "_"), ("emph", "**")))
EXPECTED["rendered"] = f"""SELECT doc_id, page_no, line_top, replace(replace(replace(string_agg(piece, ' ' ORDER BY "at") || {_END}, '** **', ' '), '_ _', ' '), '++ ++', ' ') AS text FROM (
  SELECT *, {_CLOSE} || {_OPEN} || text AS piece FROM {{flagged}} WINDOW w AS ({LINE} ORDER BY "at")) x GROUP BY doc_id, page_no, line_top"""
EXPECTED["page_lines"] = "SELECT doc_id, page_no, string_agg(text, chr(10) ORDER BY line_top) AS text FROM {rendered} GROUP BY ALL"

# ---- Spark side --------------------------------------------------------------------------


def flagged(v: Views):
    words = v("words")
    return L.underlined(L.word_flags_plain(words, L.body_profile(words)), v("rects"))


def lined(v: Views):
    words = v("words")
    return L.lines_by_top(L.word_flags_plain(words, L.body_profile(words)))


def marked(v: Views):
    words = v("words")
    return L.marked_lines(words, v("rects"), L.body_profile(words))


# ---- cases -------------------------------------------------------------------------------


@case("l1_body_profile", "SELECT doc_id, body_font, body_size FROM {profile}")
def _(v):
    return L.body_profile(v("words"))


@case("l2_is_emphasized", f"SELECT doc_id, word_no, {EMPH} AS emph FROM {{words}} JOIN {{profile}} USING (doc_id)")
def _(v):
    w = v("words").join(L.body_profile(v("words")), "doc_id")
    return w.select("doc_id", "word_no", L.is_emphasized(*[F.col(c) for c in ("fontname", "size", "body_font", "body_size")]).alias("emph"))


@case("l3_is_italic", f"SELECT fontname, {at(ITALIC)} AS ital, count(*) AS n FROM {{words}} GROUP BY ALL")
def _(v):
    return v("words").groupBy("fontname", T.is_italic(F.col("fontname")).alias("ital")).agg(F.count("*").alias("n"))


@case(
    "l4_word_emphasis",
    f"""SELECT doc_id, of_word AS word_no, avg(CASE WHEN e THEN 1.0 ELSE 0.0 END) > 0.5 AS emph, avg(CASE WHEN i THEN 1.0 ELSE 0.0 END) > 0.5 AS ital FROM (
      SELECT c.doc_id, c.of_word, CASE WHEN {at(ALNUM, t='w.text')} THEN (c.fontname <> body_font AND NOT {at(ITALIC, f='c.fontname')}) OR c.size > body_size + 0.5 ELSE {at(BOLD, f='c.fontname')} OR c.size > body_size + 0.5 END AS e,
        {at(ITALIC, f='c.fontname')} AS i FROM {{chars}} c JOIN {{words}} w ON w.doc_id = c.doc_id AND w.word_no = c.of_word JOIN {{profile}} p ON p.doc_id = c.doc_id) x GROUP BY ALL""",
)
def _(v):
    return L.word_emphasis(v("chars"), v("words"), L.body_profile(v("words"))).select("doc_id", "word_no", "emph", "ital")


@case(
    "l5_word_flags",
    f"""SELECT doc_id, word_no, CASE WHEN {at(ALNUM)} THEN (fontname <> body_font AND NOT {at(ITALIC)}) OR (fontname = body_font AND size > body_size + 0.5) ELSE {at(BOLD)} OR (fontname = body_font AND size > body_size + 0.5) END AS emph,
    {at(ITALIC)} AS ital FROM {{words}} JOIN {{profile}} USING (doc_id)""",
)
def _(v):
    return L.word_flags(v("words"), L.body_profile(v("words"))).select("doc_id", "word_no", "emph", "ital")


@case("l6_chars_in_words", "SELECT doc_id, word_no, length(text) AS n FROM {words}")
def _(v):
    return L.chars_in_words(v("chars"), v("words")).groupBy("doc_id", "word_no").agg(F.count("*").alias("n"))


@case("l7_underlined", "SELECT w.doc_id, w.word_no, u.word_no IS NOT NULL AS under FROM {words} w LEFT JOIN {under_words} u ON u.doc_id = w.doc_id AND u.word_no = w.word_no")
def _(v):
    return L.underlined(v("words"), v("rects")).select("doc_id", "word_no", "under")


@case("l8_in_link", f"SELECT w.doc_id, w.word_no, EXISTS (SELECT 1 FROM {{link_words}} l WHERE l.doc_id = w.doc_id AND l.word_no = w.word_no) AND NOT {at(URL, t='w.text')} AS under FROM {{words}} w")
def _(v):
    return L.in_link(v("words"), v("links")).select("doc_id", "word_no", "under")


@case("l9_looks_like_url", f"SELECT doc_id, {at(URL)} AS is_url, count(*) AS n FROM {{words}} GROUP BY ALL")
def _(v):
    return v("words").groupBy("doc_id", T.looks_like_url(F.col("text")).alias("is_url")).agg(F.count("*").alias("n"))


@case("l10_lines_by_top", 'SELECT doc_id, word_no, line_top, "at" FROM {lined}')
def _(v):
    return L.lines_by_top(v("words")).select("doc_id", "word_no", "line_top", "at")


@case(
    "l11_lines_by_gap",
    """SELECT doc_id, word_no, dense_rank() OVER (PARTITION BY doc_id, line_no // 5 ORDER BY line_no) AS line_no, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY x0, word_no) AS "at" FROM {words}""",
)
def _(v):
    words = v("words").withColumn("block_no", F.floor(F.col("line_no") / 5)).drop("line_no")
    return L.lines_by_gap(words).select("doc_id", "word_no", "line_no", "at")


@case("l12_dedup_consecutive", "SELECT doc_id, word_no FROM {deduped}")
def _(v):
    return L.dedup_consecutive(L.lines_by_top(v("words"))).select("doc_id", "word_no")


@case("l13_looks_doubled", f"SELECT doc_id, word_no, {DOUBLED} AS doubled FROM {{words}}")
def _(v):
    return v("words").select("doc_id", "word_no", T.looks_doubled(F.col("text")).alias("doubled"))


@case("l14_line_affected", "SELECT doc_id, word_no, affected FROM {affected}")
def _(v):
    return L.line_affected(L.dedup_consecutive(L.lines_by_top(v("words")))).select("doc_id", "word_no", "affected")


@case("l15_dedup_chars", "SELECT doc_id, word_no, text FROM {fixed}")
def _(v):
    return L.dedup_chars(L.dedup_consecutive(L.lines_by_top(v("words")))).select("doc_id", "word_no", "text")


@case("l16_render_lines", "SELECT * FROM {rendered}")
def _(v):
    return marked(v)


EXPECTED["block_flags"] = "SELECT f.doc_id, f.word_no, f.emph, f.ital, b.block_no, b.kind FROM {plain_flags} f JOIN {block_words} b ON b.doc_id = f.doc_id AND b.word_no = f.word_no"


@case(
    "l17_heading_override",
    "SELECT doc_id, block_no, word_no, emph OR (kind = 'section_header' AND NOT bool_or(emph OR ital) OVER (PARTITION BY doc_id, block_no)) AS emph FROM {block_flags}",
)
def _(v):
    words = v("words")
    placed = L.words_in_blocks(L.word_flags_plain(words, L.body_profile(words)), v("layout_blocks"))
    return L.heading_override(placed).select("doc_id", "block_no", "word_no", "emph")


@case(
    "l18_words_in_blocks",
    """SELECT b.doc_id, b.page_no, b.block_no, coalesce(w.text, trim(regexp_replace(b.text, '[ \\t]{{2,}}', ' ', 'g'))) AS text, w.text IS NOT NULL AS has_words FROM {layout_blocks} b LEFT JOIN (
      SELECT doc_id, page_no, block_no, string_agg(text, ' ' ORDER BY word_no) AS text FROM {block_words} GROUP BY ALL) w ON w.doc_id = b.doc_id AND w.block_no = b.block_no""",
)
def _(v):
    return L.block_texts(v("words"), v("layout_blocks"))


_KEY = "lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))"
EXPECTED["keyed"] = f"SELECT *, {_KEY} AS key FROM {{layout_blocks}}"


@case(
    "l19_keep_title_header",
    """SELECT doc_id, block_no FROM {keyed} k WHERE NOT furniture OR (page_no = 1 AND kind = 'page_header' AND t < (SELECT min(t) FROM {keyed} b WHERE b.doc_id = k.doc_id AND b.page_no = 1 AND NOT b.furniture)
      AND NOT EXISTS (SELECT 1 FROM {keyed} e WHERE e.doc_id = k.doc_id AND e.furniture AND e.page_no <> 1 AND e.key = k.key))""",
)
def _(v):
    return L.keep_title_header(v("layout_blocks")).select("doc_id", "block_no")


# The whole block-extractor job: kept blocks, words in them, flags, lines, markers, one text.
_L5 = f"CASE WHEN {at(ALNUM)} THEN (fontname <> body_font AND NOT {at(ITALIC)}) OR (fontname = body_font AND size > body_size + 0.5) ELSE {at(BOLD)} OR (fontname = body_font AND size > body_size + 0.5) END"
EXPECTED["kept_blocks"] = """SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY round_even(t, 0), l, block_no) AS place FROM {keyed} k
  WHERE NOT furniture OR (page_no = 1 AND kind = 'page_header' AND t < (SELECT min(t) FROM {keyed} b WHERE b.doc_id = k.doc_id AND b.page_no = 1 AND NOT b.furniture)
    AND NOT EXISTS (SELECT 1 FROM {keyed} e WHERE e.doc_id = k.doc_id AND e.furniture AND e.page_no <> 1 AND e.key = k.key))"""
EXPECTED["kept_words"] = f"""SELECT *, em OR (kind = 'section_header' AND NOT bool_or(em OR ital) OVER (PARTITION BY doc_id, page_no, block_no)) AS emph FROM (
  SELECT w.*, b.block_no, b.kind, {_L5} AS em, {at(ITALIC)} AS ital, u.word_no IS NOT NULL AND NOT {at(URL, t='w.text')} AS under,
    row_number() OVER (PARTITION BY w.doc_id, w.page_no, b.block_no, w.line_no ORDER BY w.x0, w.word_no) AS "at"
  FROM {{words}} w JOIN {{profile}} USING (doc_id) JOIN (SELECT doc_id, page_no, block_no, kind, l, t, r, b FROM {{kept_blocks}}) b ON b.doc_id = w.doc_id AND b.page_no = w.page_no
    AND w.x0 >= b.l - 1 AND w.x1 <= b.r + 1 AND w.top >= b.t - 1 AND w.bottom <= b.b + 1
  LEFT JOIN (SELECT DISTINCT doc_id, word_no FROM {{link_words}}) u ON u.doc_id = w.doc_id AND u.word_no = w.word_no) x"""
EXPECTED["kept_lines"] = f"""SELECT doc_id, page_no, block_no, line_no, replace(replace(replace(string_agg(piece, ' ' ORDER BY "at") || {_END}, '** **', ' '), '_ _', ' '), '++ ++', ' ') AS text FROM (
  SELECT *, {_CLOSE} || {_OPEN} || text AS piece FROM {{kept_words}} WINDOW w AS (PARTITION BY doc_id, page_no, block_no, line_no ORDER BY "at")) x GROUP BY ALL"""


@case(
    "l21_block_text",
    """SELECT doc_id, trim(regexp_replace(string_agg(text, chr(10) ORDER BY page_no, place), '[ \t]{{2,}}', ' ', 'g'), ' ' || chr(9) || chr(10)) AS text FROM (
      SELECT k.doc_id, k.page_no, k.place, coalesce(m.text, trim(regexp_replace(k.text, '[ \t]{{2,}}', ' ', 'g'))) AS text FROM {kept_blocks} k
      LEFT JOIN (SELECT doc_id, page_no, block_no, string_agg(text, chr(10) ORDER BY line_no) AS text FROM {kept_lines} GROUP BY ALL) m USING (doc_id, page_no, block_no)) x
    WHERE text <> '' AND doc_id IN (SELECT doc_id FROM {words}) GROUP BY doc_id""",
)
def _(v):
    return X.block_text(v("words"), v("layout_blocks"), v("links"))


@case("l20_order_blocks", "SELECT doc_id, page_no, block_no, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY round_even(t, 0), l, block_no) AS place FROM {layout_blocks}")
def _(v):
    return L.order_blocks(v("layout_blocks")).select("doc_id", "page_no", "block_no", "place")


@case(
    "l21_assemble_doc",
    """SELECT doc_id, trim(regexp_replace(regexp_replace(string_agg(text, chr(10) || chr(10) ORDER BY page_no), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS text FROM {page_lines} GROUP BY doc_id""",
)
def _(v):
    return L.assemble_doc(L.page_texts(marked(v)))


@case(
    "l22_page_text",
    "SELECT p.doc_id, p.page_no, coalesce(m.text, nullif(p.text, '')) AS text FROM {plain_pages} p LEFT JOIN {marked_pages} m USING (doc_id, page_no) WHERE m.text IS NOT NULL OR p.text <> ''",
)
def _(v):
    return L.page_text(v("marked_pages"), v("plain_pages"))


# The derived pages have known edges; only their texts are left, by kind of page.
EXPECTED["stripped"] = """SELECT conv_id AS doc_id, turn + 1 AS page_no, CASE (conv_id + turn) % 4 WHEN 0 THEN trim(lower(text)) WHEN 1 THEN trim(text)
  WHEN 2 THEN concat(lower(text), ' and', chr(10), '7', chr(10), 'so') ELSE '' END AS text FROM {conversations}"""


@case("l23_strip_page_edges", "SELECT doc_id, page_no, text FROM {stripped}")
def _(v):
    return v("turn_pages").select("doc_id", "page_no", L.strip_page_edges(F.col("text")).alias("text"))


@case(
    "l24_join_pages",
    """SELECT doc_id, string_agg(CASE WHEN last IS NULL THEN '' WHEN regexp_matches(text, '^\\p{{Ll}}') AND NOT contains('.!?:;"''”’)]', last) THEN ' ' ELSE chr(10) || chr(10) END || text, '' ORDER BY page_no) AS text
    FROM (SELECT *, lag(right(text, 1)) OVER (PARTITION BY doc_id ORDER BY page_no) AS last FROM {stripped} WHERE text <> '') x GROUP BY doc_id""",
)
def _(v):
    return L.join_pages(v("turn_pages"))


@case(
    "l25_markdown_to_marked",
    """SELECT doc_id, trim(concat('** ', role, ' part **', chr(10), chr(10), 'some _words_ and **bold** text', chr(10),
      regexp_replace(regexp_replace(replace(replace(body, '*', ' '), '#', ' '), '[ \\t]{{2,}}', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')), ' ' || chr(10)) AS text FROM {markdown}""",
)
def _(v):
    return v("markdown").select("doc_id", T.markdown_to_marked(F.col("text")).alias("text"))


@case(
    "l26_native_summary",
    """SELECT doc_id, page_no, count(*) FILTER (kind = 'w') AS n_words, count(*) FILTER (kind = 'r') AS n_rects, count(*) FILTER (kind = 'l') AS n_links FROM (
      SELECT doc_id, page_no, 'w' AS kind FROM {words} UNION ALL SELECT doc_id, page_no, 'r' FROM {rects} UNION ALL SELECT doc_id, page_no, 'l' FROM {links}) x GROUP BY ALL""",
)
def _(v):
    return L.native_summary(v("words"), v("rects"), v("links"))


@case("l27_font_inventory", "SELECT doc_id, list_extract(string_split(fontname, '+'), -1) AS face, round(size, 1) AS size, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM {words} GROUP BY ALL")
def _(v):
    return L.font_inventory(v("words"))


@case("l27_thin_rects", "SELECT doc_id, count(*) FILTER (bottom - top <= 2) AS n_thin FROM {rects} GROUP BY ALL")
def _(v):
    return L.thin_rects(v("rects"))


@case(
    "l28_bold_prefix",
    """SELECT doc_id, page_no, block_no, CASE WHEN count(*) FILTER (lead) < count(*) THEN coalesce(string_agg(text, ' ' ORDER BY word_no) FILTER (lead), '') ELSE '' END AS bold_prefix FROM (
      SELECT *, min(CASE WHEN contains(fontname, 'Bold') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, block_no ORDER BY word_no) = 1 AS lead FROM {block_words}) x GROUP BY ALL""",
)
def _(v):
    return L.bold_prefix(v("words"), v("layout_blocks"))


@case(
    "l29_text_under_links",
    """SELECT l.doc_id, l.page_no, l.link_no, l.uri, coalesce(w.text, '') AS text FROM {links} l LEFT JOIN (
      SELECT doc_id, link_no, string_agg(text, ' ' ORDER BY word_no) AS text FROM {link_words} GROUP BY ALL) w ON w.doc_id = l.doc_id AND w.link_no = l.link_no""",
)
def _(v):
    return L.text_under_links(v("words"), v("links"))
