"""The fill rules: blank questions and section titles filled from a truth table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docstruct.functions.text import is_blank, strip
from docstruct.labels import ANSWER, QUESTION, SECTION_DESCRIPTION, SECTION_TITLE, TITLE
from docstruct.operators.nest import KEYS, is_long, order_key, spread, to_questions

# Emptiness (E) or not (N) of document title, section title, section description
# and question text -> what is copied where.
RULE_ACTIONS = {
    "EEEE": [],
    "EEEN": [],
    "EENE": [(SECTION_DESCRIPTION, QUESTION), (SECTION_DESCRIPTION, SECTION_TITLE)],
    "EENN": [],
    "ENEE": [(SECTION_TITLE, QUESTION)],
    "ENEN": [],
    "ENNE": [(SECTION_TITLE, QUESTION)],
    "ENNN": [],
    "NEEE": [(TITLE, QUESTION), (TITLE, SECTION_TITLE)],
    "NEEN": [],
    "NENE": [(SECTION_DESCRIPTION, QUESTION)],
    "NENN": [],
    "NNEE": [(SECTION_TITLE, QUESTION)],
    "NNEN": [],
    "NNNE": [(SECTION_TITLE, QUESTION)],
    "NNNN": [],
}


def rules_df(spark: SparkSession) -> DataFrame:
    """IO4: the 16 rows as data, numbered in binary order with E before N."""
    rows = [(n, state, [{"source": s, "target": t} for s, t in actions]) for n, (state, actions) in enumerate(RULE_ACTIONS.items(), 1)]
    return spark.createDataFrame(rows, "row int, state string, actions array<struct<source: string, target: string>>")


def state(*fields: Column) -> Column:
    """One letter per field, N where it holds text, else E."""
    return F.concat(*[F.when(is_blank(f), "E").otherwise("N") for f in fields])


def _row_state() -> Column:
    return state(F.col("doc_title"), F.col("sec_title"), F.col("sec_desc"), F.col("question"))


def _source(doc: Column, head: Column, about: Column) -> Column:
    """What a blank question is filled with: the first that holds text."""
    return F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in (head, about, doc)])


def _new_heading(doc: Column, about: Column) -> Column:
    """What a blank section title with a blank question is filled with: the one of description
    and document title that holds text; nothing when both do."""
    return F.when(is_blank(doc), F.nullif(strip(about), F.lit(""))).when(is_blank(about), strip(doc))


def fill(questions: DataFrame, keys: Sequence[str] = KEYS, long_docs: bool | None = None) -> DataFrame:
    """R2 on the one-row-per-question form.

    The table boils down to the two expressions above. Each question is judged on the values
    before any fill, so their order does not matter.
    """
    asks_blank = (F.col("q") > 0) & is_blank(F.col("question"))
    rows = spread(questions, [*keys, "sec"], {"_asks": F.bool_or(asks_blank)}, is_long(questions, keys, long_docs))
    new = _new_heading(F.col("doc_title"), F.col("sec_desc"))
    head = F.when(is_blank(F.col("sec_title")) & F.col("_asks"), F.coalesce(new, F.col("sec_title"))).otherwise(F.col("sec_title"))
    source = _source(F.col("doc_title"), F.col("sec_title"), F.col("sec_desc"))
    return rows.select(
        *keys, "doc_title", "sec", head.alias("sec_title"), "sec_desc", "q",
        F.when(asks_blank, F.coalesce(source, F.col("question"))).otherwise(F.col("question")).alias("question"), "answer",
    )


def apply_rules(slots: DataFrame, keys: Sequence[str] = KEYS, long_docs: bool | None = None) -> DataFrame:
    """R2: stage-3 slots -> stage-4 slots.

    Works on slots as they are: a blank place is filled where it has a row, and gets one where
    it has none (a question known only by its answer, a section known only by its content).
    """
    long_docs = is_long(slots, keys, long_docs)

    def text_of(slot: str) -> Column:
        return F.max(F.when(F.col("slot") == slot, F.col("text")))

    def seen(slot: str) -> Column:
        return F.bool_or(F.col("slot") == slot)

    first = F.min(order_key(F.col("sec"), F.col("q"), F.col("slot")))
    rows = spread(slots, [*keys, "sec", "q"], {"_question": text_of(QUESTION), "_has_q": seen(QUESTION)}, long_docs)
    asks = (F.col("q") > 0) & is_blank(F.coalesce("_question", F.lit("")))
    rows = spread(
        rows, [*keys, "sec"],
        {"_head": text_of(SECTION_TITLE), "_about": text_of(SECTION_DESCRIPTION), "_has_head": seen(SECTION_TITLE), "_asks": F.bool_or(asks), "_first": first},
        long_docs,
    )
    rows = spread(rows, keys, {"_doc": text_of(TITLE)}, long_docs)
    none = F.lit("")
    doc, head, about = (F.coalesce(c, none) for c in ("_doc", "_head", "_about"))
    question = F.when(asks, _source(doc, head, about))
    heading = F.when(is_blank(head) & F.col("_asks"), _new_heading(doc, about))
    own = (
        F.when(F.col("slot") == QUESTION, F.coalesce(question, F.col("text")))
        .when(F.col("slot") == SECTION_TITLE, F.coalesce(heading, F.col("text"))).otherwise(F.col("text"))
    )

    def cell(q: Column, slot: Column, text: Column) -> Column:
        return F.struct(q.alias("q"), slot.alias("slot"), text.alias("text"))

    at_start = order_key(F.col("sec"), F.col("q"), F.col("slot")) == F.col("_first")
    # A question without a row of its own is known by its answer alone, so that one row adds it.
    new_question = (F.col("slot") == ANSWER) & ~F.col("_has_q") & question.isNotNull()
    new_heading = at_start & ~F.col("_has_head") & (F.col("sec") > 0) & heading.isNotNull()
    cells = F.array(
        cell(F.col("q"), F.col("slot"), own),
        F.when(new_question, cell(F.col("q"), F.lit(QUESTION), question)),
        F.when(new_heading, cell(F.lit(0), F.lit(SECTION_TITLE), heading)),
    )
    return rows.select(*keys, "sec", F.inline_outer(F.array_compact(cells))).select(*keys, "sec", "q", "slot", "text")


def rule_hits(slots: DataFrame, keys: Sequence[str] = KEYS, long_docs: bool | None = None) -> DataFrame:
    """How many questions meet each row of the table. Only the 16-row side is broadcast."""
    seen = to_questions(slots, keys, long_docs).where("q > 0").select(_row_state().alias("state"))
    counted = seen.groupBy("state").agg(F.count("*").alias("n"))
    return F.broadcast(rules_df(slots.sparkSession)).join(counted, on="state", how="left").select(
        "row", "state", F.size("actions").alias("n_actions"), F.coalesce("n", F.lit(0)).alias("n")
    )


def rule_diff(slots: DataFrame, keys: Sequence[str] = KEYS, long_docs: bool | None = None) -> DataFrame:
    """Questions the rules changed: what they were, are now, and which field filled them."""
    long_docs = is_long(slots, keys, long_docs)
    before = to_questions(slots, keys, long_docs).where("q > 0")
    now = _source(F.col("doc_title"), F.col("sec_title"), F.col("sec_desc"))
    filled = before.where(is_blank(F.col("question")) & now.isNotNull())
    return filled.select(*keys, "sec", "q", F.col("question").alias("was"), now.alias("now"), _filled_from(_row_state()).alias("filled_from"))


def _filled_from(pattern: Column) -> Column:
    return (
        F.when(F.substring(pattern, 2, 1) == "N", SECTION_TITLE)
        .when(F.substring(pattern, 3, 1) == "N", SECTION_DESCRIPTION)
        .otherwise(TITLE)
    )


def changed(before: DataFrame, after: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """R5 for two given stages, each in the one-row-per-question form."""
    was = before.select(*keys, "sec", "q", _row_state().alias("state"), F.col("question").alias("was"))
    now = after.select(*keys, "sec", "q", F.col("question").alias("now"))
    return was.join(now, on=[*keys, "sec", "q"]).where(F.col("was") != F.col("now")).select(
        *keys, "sec", "q", "was", "now", _filled_from(F.col("state")).alias("filled_from")
    )


def rules_reproduce(old: DataFrame, new: DataFrame, keys: Sequence[str] = KEYS, long_docs: bool | None = None) -> DataFrame:
    """Per document, do the rules turn the old annotation's (section title, question) list
    into the new one's? Compared row by row, so no document is gathered into a list."""
    def listed(questions: DataFrame, side: str) -> DataFrame:
        return questions.where("q > 0").select(
            *keys, "sec", "q", F.struct(strip("sec_title"), strip("question")).alias(side)
        )

    filled = fill(to_questions(old, keys, long_docs), keys, long_docs)
    both = listed(filled, "a").join(listed(to_questions(new, keys, long_docs), "b"), on=[*keys, "sec", "q"], how="full")
    same = F.col("a").eqNullSafe(F.col("b"))
    return both.groupBy(*keys).agg(F.every(same).alias("reproduced"), F.count_if(~same).alias("n_different"))


def fill_state(slots: DataFrame, pattern: str, keys: Sequence[str] = KEYS, long_docs: bool | None = None) -> DataFrame:
    """For sections whose title contains *pattern*, whether each question holds text."""
    wanted = F.contains(F.lower("sec_title"), F.lit(pattern.lower()))
    return to_questions(slots, keys, long_docs).where(wanted & (F.col("q") > 0)).select(
        *keys, "sec", "q", (~is_blank(F.col("question"))).alias("filled")
    )
