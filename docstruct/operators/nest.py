"""Labeled blocks -> nested document, and the flat forms every later step works on.

A document is kept as **slots**: one row per filled text place,
``(keys..., sec, q, slot, text)``. ``sec`` and ``q`` count from 1; 0 means "of the document" and
"of the section". The one-row-per-document tree is only built for export, so no step needs a
whole document in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docstruct.functions.text import is_blank, strip
from docstruct.labels import ANSWER, LABELS, QUESTION, SECTION_DESCRIPTION, SECTION_TITLE, TITLE
from docstruct.operators.ordered import CHUNK_ROWS, chunks_for, scan
from docstruct.session import cut_lineage

KEYS = ("tag", "doc_id")

# The nested tree, as a type in DDL form.
NARRATIVE_DDL = (
    "struct<download_url: string, template: struct<title: string, description: string, "
    "version: string, section: array<struct<title: string, description: string, `order`: int, "
    "question: array<struct<text: string, `order`: int, answer: struct<text: string, json: struct<type: string, "
    "answer: string, meta: struct<schemaVersion: string>>>>>>>>>"
)


def slot_rank(slot: Column) -> Column:
    """Place of a slot inside its section or question, 0-4."""
    return F.array_position(F.array(*[F.lit(x) for x in LABELS]), slot) - 1


def order_key(sec: Column, q: Column, slot: Column) -> Column:
    """Document order as one sortable number; needs no window over the document."""
    return F.shiftleft(sec.cast("long"), 34) + q.cast("long") * 8 + slot_rank(slot)


def skipped(text: Column, label: Column) -> Column:
    """N1g: why nesting passes a block over, null if it does not."""
    return F.when(is_blank(text), "blank text").when(~F.coalesce(label.isin(LABELS), F.lit(False)), "unknown label")


def skipped_blocks(blocks: DataFrame) -> DataFrame:
    """N1g: the blocks that `nest` passes over, with the reason."""
    return blocks.withColumn("reason", skipped(F.col("text"), F.col("label"))).where("reason IS NOT NULL")


def nest(blocks: DataFrame, keys: Sequence[str] = KEYS, chunks: int | str | None = "auto") -> DataFrame:
    """Slots of every document from its labeled blocks ``(keys..., pos, text, label)``.

    Blank texts are skipped and rows whose label is none of the five are dropped (readers put
    ``answer.text`` where the label key is absent). *chunks* says into how many chunks the rows
    are cut; None cuts none. "auto" counts rows per document first (one small job) and cuts only the
    documents that are longer than one task should scan; all others keep to one shuffle.
    """
    rows = blocks.select(*keys, "pos", strip("text").alias("text"), "label").where(skipped(F.col("text"), F.col("label")).isNull())
    if chunks == "auto":
        chunks = chunks_for(rows, keys)
        if chunks is not None:
            long = cut_lineage(rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > CHUNK_ROWS).drop("_n"))
            short, cut = rows.join(long, list(keys), "left_anti"), rows.join(long, list(keys), "left_semi")
            return assemble(_placed(short, keys, None), keys).unionByName(assemble(_placed(cut, keys, chunks), keys))
    return assemble(_placed(rows, keys, chunks), keys)


def _placed(rows: DataFrame, keys: Sequence[str], chunks: int | None) -> DataFrame:
    """Section, question and slot of every block. Only identifiers and labels are scanned in chunks;
    the texts are joined back once."""
    if chunks is not None:
        return rows.select(*keys, "pos", "text").join(_scanned(rows.drop("text"), keys, chunks), [*keys, "pos"])
    return _scanned(rows, keys, None)


def _scanned(rows: DataFrame, keys: Sequence[str], chunks: int | None) -> DataFrame:
    # A title counts as the title when nothing came before it but titles, or no title did.
    is_title = F.col("label") == TITLE
    rows = scan(
        rows, keys, "pos", chunks=chunks,
        sums={"titles": is_title.cast("int"), "bodies": (~is_title).cast("int")},
    )
    heads = is_title & ((F.col("titles") == 1) | (F.col("bodies") == 0))
    rows = rows.withColumn("part", F.when(heads, TITLE).when(is_title, ANSWER).otherwise(F.col("label")))

    # Sections: each section title opens one; so does the first body row if it is none.
    body = F.col("part") != TITLE
    opens = (F.col("part") == SECTION_TITLE) | (body & ~is_title & (F.col("bodies") == 1))
    said = (
        F.when(F.col("part") == SECTION_TITLE, "S")
        .when(F.col("part") == QUESTION, "Q")
        .when(F.col("part") == ANSWER, "A")
    )
    rows = scan(
        rows.withColumn("opens", opens.cast("int")), keys, "pos", chunks=chunks,
        sums={"sec": F.col("opens")}, lasts={"said": said},
    )
    asked = F.col("said") == "Q"
    none_yet = F.coalesce(F.col("said") == "S", F.lit(True))
    starts = ((F.col("part") == QUESTION) & ~F.coalesce(asked, F.lit(False))) | ((F.col("part") == ANSWER) & none_yet)
    slot = (
        F.when((F.col("part") == SECTION_DESCRIPTION) & ~none_yet, F.when(asked, QUESTION).otherwise(ANSWER))
        .otherwise(F.col("part"))
    )
    rows = rows.withColumns({"starts": starts.cast("int"), "slot": slot})

    # Questions count on through the document; subtracting the count at the section's start
    # restarts them per section.
    rows = scan(rows, keys, "pos", chunks=chunks, sums={"asked": F.col("starts")})
    at_open = F.when(F.col("opens") == 1, F.col("asked") - F.col("starts"))
    rows = scan(rows.withColumn("at_open", at_open), keys, "pos", chunks=chunks, lasts={"base": F.col("at_open")})
    in_question = F.col("slot").isin(QUESTION, ANSWER)
    number = F.when(in_question, F.col("asked") - F.coalesce("at_open", "base", F.lit(0))).otherwise(0)

    return rows.select(
        *keys, "pos", *[c for c in rows.columns if c == "text"], "slot",
        F.when(F.col("slot") == TITLE, 0).otherwise(F.col("sec")).cast("int").alias("sec"),
        number.cast("int").alias("q"),
    )


def assemble(placed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join the texts of one slot in ``pos`` order: titles by a blank, all else by a newline."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda p: p["text"])
    return placed.groupBy(*keys, "sec", "q", "slot").agg(parts.alias("parts")).select(
        *keys, "sec", "q", "slot",
        F.when(F.col("slot") == TITLE, F.array_join("parts", " ")).otherwise(F.array_join("parts", "\n")).alias("text"),
    )


# ---- flat and nested forms ---------------------------------------------------------------


def is_long(df: DataFrame, keys: Sequence[str], long_docs: bool | None) -> bool:
    """Whether some document is too long for one task; *long_docs* is the caller's answer."""
    return chunks_for(df, keys) is not None if long_docs is None else long_docs


def spread(df: DataFrame, by: Sequence[str], columns: dict[str, Column], long_docs: bool) -> DataFrame:
    """Add aggregates over *by* to every row: by windows, which share one shuffle on the document
    keys with nesting; or, where documents are long, by a join with the aggregated side."""
    if not long_docs:
        w = Window.partitionBy(*by)
        return df.withColumns({n: c.over(w) for n, c in columns.items()})
    return df.join(df.groupBy(*by).agg(*[c.alias(n) for n, c in columns.items()]), on=list(by), how="left")


def _text_of(slot: str) -> Column:
    return F.max(F.when(F.col("slot") == slot, F.col("text")))


def to_questions(slots: DataFrame, keys: Sequence[str] = KEYS, long_docs: bool | None = None) -> DataFrame:
    """one row per question with its section and document title.

    A section without questions gives one row with ``q`` = 0 and blank texts. Columns:
    ``keys, doc_title, sec, sec_title, sec_desc, q, question, answer``.
    """
    long_docs = is_long(slots, keys, long_docs)
    rows = slots.groupBy(*keys, "sec", "q").agg(
        *[_text_of(x).alias(n) for x, n in (
            (TITLE, "_t"), (SECTION_TITLE, "_st"), (SECTION_DESCRIPTION, "_sd"), (QUESTION, "question"), (ANSWER, "answer"))]
    )
    rows = spread(rows, [*keys, "sec"], {"sec_title": F.max("_st"), "sec_desc": F.max("_sd"), "_last_q": F.max("q")}, long_docs)
    rows = spread(rows, keys, {"doc_title": F.max("_t")}, long_docs)
    kept = rows.where((F.col("sec") > 0) & ((F.col("q") > 0) | (F.col("_last_q") == 0)))
    none = F.lit("")
    return kept.select(
        *keys, F.coalesce("doc_title", none).alias("doc_title"), "sec", F.coalesce("sec_title", none).alias("sec_title"),
        F.coalesce("sec_desc", none).alias("sec_desc"), "q", F.coalesce("question", none).alias("question"),
        F.coalesce("answer", none).alias("answer"),
    )


def to_items(slots: DataFrame, dedup: bool = True, keys: Sequence[str] = KEYS, long_docs: bool | None = None) -> DataFrame:
    """F1: scored items ``(keys, ord, text, label)``.

    *dedup* drops a question whose text equals its section's title. A description or answer that
    holds only blanks still yields an item with empty text, as the scoring rules want.
    """
    kept = slots.withColumn("stripped", strip("text")).where(
        F.when(F.col("slot").isin(SECTION_DESCRIPTION, ANSWER), F.col("text") != "").otherwise(F.col("stripped") != "")
    )
    if dedup:
        heading = F.max(F.when(F.col("slot") == SECTION_TITLE, F.col("stripped")))
        kept = spread(kept, [*keys, "sec"], {"_head": heading}, is_long(slots, keys, long_docs))
        kept = kept.where((F.col("slot") != QUESTION) | ~F.col("stripped").eqNullSafe(F.col("_head")))
    return kept.select(
        *keys, order_key(F.col("sec"), F.col("q"), F.col("slot")).alias("ord"),
        F.col("stripped").alias("text"), F.col("slot").alias("label"),
    )


def to_label_text(slots: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """export rows; never dedups, drops texts that hold only blanks."""
    return slots.where(~is_blank(F.col("text"))).select(
        *keys, order_key(F.col("sec"), F.col("q"), F.col("slot")).alias("ord"),
        F.col("slot").alias("label"), strip("text").alias("text"),
    )


def doc_shape(slots: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """sections, questions with text and answers per document."""
    filled = ~is_blank(F.col("text"))
    return slots.groupBy(*keys).agg(
        F.count_distinct(F.when(F.col("sec") > 0, F.col("sec"))).alias("n_sections"),
        F.count_if((F.col("slot") == QUESTION) & filled).alias("n_questions"),
        F.count_if((F.col("slot") == ANSWER) & filled).alias("n_answers"),
    )


def empty_sections(slots: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Sections without a question, and whether they end the document."""
    sections = slots.where(F.col("sec") > 0).groupBy(*keys, "sec").agg(
        F.max("q").alias("last_q"), F.max(F.when(F.col("slot") == SECTION_TITLE, F.col("text"))).alias("sec_title")
    )
    ends = sections.groupBy(*keys).agg(F.max("sec").alias("last_sec"))
    return sections.where("last_q = 0").join(ends, on=list(keys)).select(
        *keys, "sec", F.coalesce("sec_title", F.lit("")).alias("sec_title"), (F.col("sec") == F.col("last_sec")).alias("is_last")
    )


def item_summary(items: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """items per label and document, with the total."""
    return items.groupBy(*keys).agg(
        F.count("*").alias("n_rows"),
        *[F.count_if(F.col("label") == x).alias(x.replace(".", "_")) for x in LABELS],
    )


def to_structured(slots: DataFrame, keys: Sequence[str] = KEYS, url: str = "") -> DataFrame:
    """The nested tree, one row per document, for export. Every other operator uses slots."""
    q = to_questions(slots, keys, long_docs=False)
    answer = F.struct(
        F.lit(None).cast("string").alias("text"),
        F.struct(
            F.lit("textArea").alias("type"), F.col("answer"), F.struct(F.lit("1.0").alias("schemaVersion")).alias("meta")
        ).alias("json"),
    )
    question = F.struct(F.col("q").alias("order"), F.col("question").alias("text"), answer.alias("answer"))
    sections = q.groupBy(*keys, "sec").agg(
        F.first("sec_title").alias("title"), F.first("sec_desc").alias("description"),
        F.sort_array(F.collect_list(F.when(F.col("q") > 0, question))).alias("question"),
    )
    ordered = F.transform(
        F.col("question"), lambda x: F.struct(x["text"].alias("text"), x["order"].alias("order"), x["answer"].alias("answer"))
    )
    tree = sections.groupBy(*keys).agg(
        F.sort_array(
            F.collect_list(F.struct(F.col("sec").alias("order"), "title", "description", ordered.alias("question")))
        ).alias("section")
    )
    title = slots.where(F.col("sec") == 0).select(*keys, F.col("text").alias("title"))
    section = F.transform(
        F.coalesce("section", F.array()),
        lambda s: F.struct(s["title"].alias("title"), s["description"].alias("description"), s["order"].alias("order"), s["question"].alias("question")),
    )
    template = F.struct(
        F.coalesce("title", F.lit("")).alias("title"), F.lit("").alias("description"), F.lit("v1").alias("version"),
        section.alias("section"),
    )
    return title.join(tree, on=list(keys), how="full").select(
        *keys, F.struct(F.lit(url).alias("download_url"), template.alias("template")).alias("narrative")
    )


def from_structured(docs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Slots of nested trees. Orders follow the list positions; the answer may sit in
    ``json.answer`` or, where that is blank, in ``text``."""
    def text(c: Column) -> Column:
        return F.coalesce(c, F.lit(""))

    top = docs.select(
        *keys, F.inline(F.array(F.struct(
            F.lit(0).alias("sec"), F.lit(0).alias("q"), F.lit(TITLE).alias("slot"),
            text(F.col("narrative.template.title")).alias("text"))))
    ).where(~is_blank(F.col("text")))
    sections = docs.select(*keys, F.posexplode("narrative.template.section").alias("i", "s"))
    sections = sections.withColumn("sec", F.col("i") + 1)
    of_section = sections.select(
        *keys, "sec", F.lit(0).alias("q"),
        F.inline(F.array(
            F.struct(F.lit(SECTION_TITLE).alias("slot"), text(F.col("s.title")).alias("text")),
            F.struct(F.lit(SECTION_DESCRIPTION).alias("slot"), text(F.col("s.description")).alias("text")),
        )),
    ).where((F.col("slot") == SECTION_TITLE) | (F.col("text") != ""))
    asked = sections.select(*keys, "sec", F.posexplode("s.question").alias("j", "x"))
    reply = F.coalesce(F.nullif(F.col("x.answer.json.answer"), F.lit("")), F.col("x.answer.text"), F.lit(""))
    of_question = asked.select(
        *keys, "sec", (F.col("j") + 1).alias("q"),
        F.inline(F.array(
            F.struct(F.lit(QUESTION).alias("slot"), text(F.col("x.text")).alias("text")),
            F.struct(F.lit(ANSWER).alias("slot"), reply.alias("text")),
        )),
    ).where((F.col("slot") == QUESTION) | (F.col("text") != ""))
    return top.unionByName(of_section).unionByName(of_question)
