"""Marked text of documents from a block extractor's words, boxes and links, as one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstruct.functions.text import strip
from docstruct.operators import layout as L

BLOCK = (*L.PAGE, "block_no")


def block_lines(words: DataFrame, blocks: DataFrame, links: DataFrame) -> DataFrame:
    """Marked lines ``(doc_id, page_no, block_no, line_no, text)`` of the words inside each block: flags
    by face, size and link, lines by gap, a heading that its faces do not show marked whole (L5, L8,
    L11, L16-L18)."""
    flags = L.word_flags(words, L.body_profile(words)).select(*L.PAGE, "word_no", "text", "x0", "x1", "top", "bottom", "emph", "ital")
    flagged = L.in_link(flags, links)
    lined = L.lines_by_gap(L.words_in_blocks(flagged, blocks), BLOCK)
    return L.render_lines(L.heading_override(lined, BLOCK), (*BLOCK, "line_no"))


def block_text(words: DataFrame, blocks: DataFrame, links: DataFrame) -> DataFrame:
    """``(doc_id, text)``: body blocks and a title set as page header (L19), top to bottom (L20), one
    line each; a block without words keeps its own text. A document without words has none."""
    kept = L.order_blocks(L.keep_title_header(blocks))
    lines = block_lines(words, kept, links)
    ordered = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n")
    marked = lines.groupBy(*BLOCK).agg(ordered.alias("marked"))
    own = strip(F.regexp_replace("text", r"[ \t]{2,}", " "))
    texts = kept.join(marked, list(BLOCK), "left").select("doc_id", "page_no", "place", F.coalesce("marked", own).alias("text")).where("text <> ''")
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_no", "place", "text"))), lambda x: x["text"]), "\n")
    docs = texts.groupBy("doc_id").agg(strip(F.regexp_replace(whole, r"[ \t]{2,}", " ")).alias("text"))
    return docs.join(words.select("doc_id").distinct(), "doc_id", "left_semi")
