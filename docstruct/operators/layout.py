"""From a table of words with boxes and fonts to text with ``**``, ``_`` and ``++`` markers.

A line or a page is the largest thing one task has to see; document-wide facts (the body font)
come from small aggregates that are joined back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docstruct.functions.text import (
    LINE_BREAK, bare_word, collapse, has_alnum, is_blank, is_italic, looks_doubled, looks_like_url, names_bold, squeeze_document, strip, undouble,
)

PAGE = ("doc_id", "page_no")
LINE = ("doc_id", "page_no", "line_top")


# ---- fonts -------------------------------------------------------------------------------


def body_profile(words: DataFrame) -> DataFrame:
    """L1: ``body_font`` and ``body_size`` per document: the most frequent over characters, the
    one met first on ties. Words are counted once, by page, face and size, with map-side sums; what comes
    together per document are its distinct pairs of face and size.

    The first word of a page is a plain number, so words are counted through a hash; the least pair of page
    and word would have all words sorted first."""
    of_page = words.groupBy("doc_id", "page_no", F.col("fontname").alias("font"), F.round("size", 1).alias("size")).agg(
        F.sum(F.length("text")).alias("n"), F.min("word_no").alias("word_no")
    )
    counted = of_page.groupBy("doc_id", "font", "size").agg(F.sum("n").alias("n"), F.min(F.struct("page_no", "word_no")).alias("place"))
    faces = counted.groupBy("doc_id").agg(F.collect_list(F.struct("font", "size", "n", "place")).alias("faces"))

    def top(field: str) -> Column:
        def total(value: Column) -> Column:
            of = F.filter("faces", lambda x: x[field].eqNullSafe(value))
            n = F.aggregate(of, F.lit(0).cast("bigint"), lambda acc, x: acc + F.coalesce(x["n"], F.lit(0)))
            return F.struct((-n).alias("neg"), F.array_min(F.transform(of, lambda x: x["place"])).alias("place"), value.alias("value"))

        return F.array_min(F.transform(F.array_distinct(F.transform("faces", lambda x: x[field])), total))["value"]

    return faces.select("doc_id", top("font").alias("body_font"), top("size").alias("body_size"))


def is_emphasized(font: Column, size: Column, body_font: Column, body_size: Column) -> Column:
    """L2"""
    return ((font != body_font) & ~is_italic(font)) | (size > body_size + 0.5)


def char_emphasis(word_text: Column) -> Column:
    """L4 for one character (or a word set in one face) of the word *word_text*: a punctuation
    word needs a face that is bold by name, or a larger size."""
    return _emphasis(has_alnum(word_text))


def _emphasis(alnum: Column) -> Column:
    bigger = F.col("size") > F.col("body_size") + 0.5
    return F.when(
        alnum, is_emphasized(F.col("fontname"), F.col("size"), F.col("body_font"), F.col("body_size"))
    ).otherwise(names_bold(F.col("fontname")) | bigger)


def _with_profile(words: DataFrame, profile: DataFrame) -> DataFrame:
    """Words beside their document's profile. A profile is one short row per document: a task holds those of
    its documents in a hash table and its words pass by unsorted."""
    return words.join(profile.hint("shuffle_hash"), on="doc_id")


def word_emphasis(chars: DataFrame, words: DataFrame, profile: DataFrame) -> DataFrame:
    """L4: words with ``emph`` and ``ital`` by majority of their characters (L6); a word without
    characters has neither."""
    # The profile joins the words: characters are not dealt again for it. Of a word's text only this is needed.
    told = _with_profile(words, profile).withColumn("_alnum", has_alnum(F.col("text")))
    inside = chars_in_words(chars, told, ("body_font", "body_size", "_alnum"))
    per_char = inside.select("doc_id", "page_no", "word_no", _emphasis(F.col("_alnum")).cast("int").alias("e"), is_italic(F.col("fontname")).cast("int").alias("i"))
    votes = per_char.groupBy("doc_id", "page_no", "word_no").agg((F.avg("e") > 0.5).alias("emph"), (F.avg("i") > 0.5).alias("ital"))
    none = F.lit(False)
    return words.join(votes, on=["doc_id", "page_no", "word_no"], how="left").withColumns(
        {"emph": F.coalesce("emph", none), "ital": F.coalesce("ital", none)}
    )


def word_flags_plain(words: DataFrame, profile: DataFrame) -> DataFrame:
    """L2-L4 where every word has one face and size, so all its characters vote alike."""
    return _with_profile(words, profile).withColumns(
        {"emph": char_emphasis(F.col("text")), "ital": is_italic(F.col("fontname"))}
    ).drop("body_font", "body_size")


def word_flags(words: DataFrame, profile: DataFrame) -> DataFrame:
    """The rule for block extractors, whose sizes compare only within the body face."""
    bigger = (F.col("fontname") == F.col("body_font")) & (F.col("size") > F.col("body_size") + 0.5)
    emph = F.when(
        has_alnum(F.col("text")), ((F.col("fontname") != F.col("body_font")) & ~is_italic(F.col("fontname"))) | bigger
    ).otherwise(names_bold(F.col("fontname")) | bigger)
    return _with_profile(words, profile).withColumns({"emph": emph, "ital": is_italic(F.col("fontname"))}).drop(
        "body_font", "body_size"
    )


def font_inventory(chars: DataFrame) -> DataFrame:
    """Characters per face (without subset prefix) and size, most frequent first."""
    face = F.element_at(F.split("fontname", r"\+"), -1)
    return chars.groupBy("doc_id", face.alias("face"), F.round("size", 1).alias("size")).agg(
        F.sum(F.length("text")).alias("n_chars")
    ).orderBy("doc_id", F.desc("n_chars"), "face", "size")


def thin_rects(rects: DataFrame) -> DataFrame:
    """Underline candidates per document."""
    return rects.groupBy("doc_id").agg(F.count_if(F.col("bottom") - F.col("top") <= 2).alias("n_thin"))


def native_summary(words: DataFrame, rects: DataFrame, links: DataFrame) -> DataFrame:
    """Objects per page. All tables are stacked and counted in one shuffle."""
    kinds = {"words": words, "rects": rects, "links": links}
    stacked = None
    for name, table in kinds.items():
        rows = table.select(*PAGE, F.lit(name).alias("kind"))
        stacked = rows if stacked is None else stacked.unionByName(rows)
    return stacked.groupBy(*PAGE).agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds])


# ---- boxes -------------------------------------------------------------------------------

# Height of the horizontal bands that rows are grouped in before boxes are compared, in points.
BAND = 16.0


def _bands(top: Column, bottom: Column) -> Column:
    return F.sequence(F.floor(top / BAND), F.greatest(F.floor(bottom / BAND), F.floor(top / BAND)))


# Height and width of the cells that characters and words of a page meet in, in points: large beside a word, so
# that few words lie in two of them.
CELL = (32.0, 160.0)


def _cells(low: Column, high: Column, side: int) -> Column:
    return F.sequence(F.floor(low / CELL[side]), F.greatest(F.floor(high / CELL[side]), F.floor(low / CELL[side])))


def chars_in_words(chars: DataFrame, words: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Characters with the word whose box holds them (1 pt up and down, 0.5 pt sideways), its text as
    ``word_text`` and its columns *keep*.

    A character is compared with the words of its cell, however long its line is. It lies in one cell, so no pair
    comes twice; one whose right edge is left of its left edge lies in all cells between them, and the first that the
    word reaches counts. Words are held in a hash table by cell and characters, several to a word, pass by unsorted;
    the size of words that a query makes is guessed too low, and without the hint they go through the driver.
    """
    box = words.select(
        *PAGE, "word_no", F.col("text").alias("word_text"), F.col("x0").alias("wx0"), F.col("x1").alias("wx1"),
        F.col("top").alias("wtop"), F.col("bottom").alias("wbottom"), *keep,
    )
    inside = (
        (F.col("top") >= F.col("wtop") - 1) & (F.col("bottom") <= F.col("wbottom") + 1)
        & (F.col("x0") >= F.col("wx0") - 0.5) & (F.col("x1") <= F.col("wx1") + 0.5)
    )
    left = F.least("x0", "x1")
    first = F.col("_column") == F.floor(F.greatest(left, F.col("wx0") - 0.5) / CELL[1])
    at = chars.withColumns({"_band": F.floor(F.col("top") / CELL[0]), "_column": F.explode(_cells(left, F.col("x0"), 1))})
    box = box.withColumn("_band", F.explode(_cells(F.col("wtop") - 1, F.col("wbottom") + 1, 0))).withColumn(
        "_column", F.explode(_cells(F.col("wx0") - 0.5, F.col("wx1") + 0.5, 1))
    )
    met = at.join(box.hint("shuffle_hash"), on=[*PAGE, "_band", "_column"]).where(inside & first)
    return met.drop("_band", "_column", "wx0", "wx1", "wtop", "wbottom")


def underlined(words: DataFrame, rects: DataFrame) -> DataFrame:
    """Add ``under``: a thin wide rectangle lies at the word's baseline; never for URLs."""
    thin = rects.where((F.col("bottom") - F.col("top") <= 2.0) & (F.col("x1") - F.col("x0") > 5)).select(*PAGE, "x0", "x1", "top")

    def hit(r: Column) -> Column:
        near = r["top"].between(F.col("bottom") - 4, F.col("bottom") + 3)
        return near & (F.col("x1") > r["x0"] + 1) & (F.col("x0") < r["x1"] - 1)

    return _flag(words, F.col("bottom"), thin, F.col("top") - 3, F.col("top") + 4, hit)


def in_link(words: DataFrame, links: DataFrame) -> DataFrame:
    """Add ``under``: the word's centre lies in a link's box (1 pt around); never for URLs."""
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("top") + F.col("bottom")) / 2

    def hit(r: Column) -> Column:
        return cx.between(r["x0"] - 1, r["x1"] + 1) & cy.between(r["top"] - 1, r["bottom"] + 1)

    return _flag(words, cy, links.select(*PAGE, "x0", "x1", "top", "bottom"), F.col("top") - 1, F.col("bottom") + 1, hit)


def _beside_boxes(words: DataFrame, at: Column, boxes: DataFrame, top: Column, bottom: Column) -> DataFrame:
    """Every word, with ``_boxes``: a list of those of its page's *boxes* (spanning *top* to *bottom*) that reach
    the band it lies in, null without any. Boxes are few beside words: a page's are one row, a map by band, kept
    in a hash table that words pass by unsorted; words are dealt by page, once for all that is done by page."""
    box = F.struct(*[c for c in boxes.columns if c not in PAGE])
    banded = boxes.select(*PAGE, F.explode(_bands(top, bottom)).alias("_band"), box.alias("_box"))
    near = banded.groupBy(*PAGE, "_band").agg(F.collect_list("_box").alias("_boxes")).groupBy(*PAGE).agg(
        F.map_from_entries(F.collect_list(F.struct("_band", "_boxes"))).alias("_near")
    )
    met = words.join(near.hint("shuffle_hash"), list(PAGE), "left")
    return met.withColumn("_boxes", F.try_element_at("_near", F.floor(at / BAND))).drop("_near")


def _flag(words: DataFrame, at: Column, boxes: DataFrame, top: Column, bottom: Column, hit: Callable[[Column], Column]) -> DataFrame:
    """Add ``under``: some box of the page is *hit* by the word, which is no URL."""
    under = ~looks_like_url(F.col("text")) & F.exists("_boxes", hit)
    return _beside_boxes(words, at, boxes, top, bottom).withColumn("under", F.coalesce(under, F.lit(False))).drop("_boxes")


def _inside(words: DataFrame, at: Column, boxes: DataFrame, top: Column, bottom: Column, holds: Callable[[Column], Column], keep: Sequence[str]) -> DataFrame:
    """Pairs of words and those boxes of their page that *holds* says of, with the columns *keep* of the box.
    A word lies in one band, so no pair comes twice."""
    met = _beside_boxes(words, at, boxes, top, bottom).withColumn("_box", F.explode(F.filter("_boxes", holds)))
    return met.withColumns({c: F.col(f"_box.{c}") for c in keep}).drop("_boxes", "_box")


def _under_links(words: DataFrame, links: DataFrame) -> DataFrame:
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("top") + F.col("bottom")) / 2

    def holds(r: Column) -> Column:
        return cx.between(r["x0"] - 1, r["x1"] + 1) & cy.between(r["top"] - 1, r["bottom"] + 1)

    return _inside(words, cy, links.select(*PAGE, "link_no", "x0", "x1", "top", "bottom"), F.col("top") - 1, F.col("bottom") + 1, holds, ["link_no"])


def text_under_links(words: DataFrame, links: DataFrame) -> DataFrame:
    """The words under each link, in word order; links over no word give an empty text."""
    met = _under_links(words, links)
    texts = met.groupBy(*PAGE, "link_no").agg(F.sort_array(F.collect_list(F.struct("word_no", "text"))).alias("w"))
    return links.select(*PAGE, "link_no", "uri").join(texts, on=[*PAGE, "link_no"], how="left").select(
        *PAGE, "link_no", "uri", F.coalesce(F.array_join(F.col("w.text"), " "), F.lit("")).alias("text")
    )


def words_in_blocks(words: DataFrame, blocks: DataFrame) -> DataFrame:
    """Words with the block whose box holds them (1 pt around); a word may lie in several."""
    def holds(r: Column) -> Column:
        return (
            (F.col("x0") >= r["l"] - 1) & (F.col("x1") <= r["r"] + 1)
            & (F.col("top") >= r["t"] - 1) & (F.col("bottom") <= r["b"] + 1)
        )

    box = blocks.select(*PAGE, "block_no", "kind", "l", "t", "r", "b")
    return _inside(words, F.col("top"), box, F.col("t") - 1, F.col("b") + 1, holds, ["block_no", "kind"])


def block_texts(words: DataFrame, blocks: DataFrame) -> DataFrame:
    """Text of each block from the words in it; a block without words keeps its own text
    with blanks collapsed."""
    found = words_in_blocks(words, blocks).groupBy(*PAGE, "block_no").agg(
        F.sort_array(F.collect_list(F.struct("word_no", "text"))).alias("w")
    )
    own = strip(F.regexp_replace("text", r"[ \t]{2,}", " "))
    return blocks.join(found, on=[*PAGE, "block_no"], how="left").select(
        *PAGE, "block_no", F.coalesce(F.array_join(F.col("w.text"), " "), own).alias("text"), F.col("w").isNotNull().alias("has_words")
    )


def bold_prefix(words: DataFrame, blocks: DataFrame) -> DataFrame:
    """The leading bold words of each block, empty when none or all are bold."""
    met = words_in_blocks(words, blocks)
    bold = F.contains("fontname", F.lit("Bold"))
    w = met.groupBy(*PAGE, "block_no").agg(
        F.sort_array(F.collect_list(F.struct("word_no", bold.alias("bold"), "text"))).alias("w")
    )
    plain_at = F.array_position(F.transform("w", lambda x: x["bold"]), False)
    lead = F.when(plain_at > 1, F.array_join(F.slice(F.col("w.text"), F.lit(1), (plain_at - 1).cast("int")), " ")).otherwise("")
    return w.select(*PAGE, "block_no", lead.alias("bold_prefix"))


# ---- blocks ------------------------------------------------------------------------------


def keep_title_header(blocks: DataFrame) -> DataFrame:
    """Body blocks, and page-1 headers above the first body block whose text recurs as
    furniture on no other page."""
    body, furniture = blocks.where(~F.col("furniture")), blocks.where("furniture")
    first = body.where("page_no = 1").groupBy("doc_id").agg(F.min("t").alias("body_top"))
    key = F.lower(collapse(F.col("text")))
    elsewhere = furniture.where("page_no <> 1").select("doc_id", key.alias("_key")).distinct()
    headers = (
        furniture.where("page_no = 1 and kind = 'page_header'").withColumn("_key", key)
        .join(elsewhere, on=["doc_id", "_key"], how="left_anti").join(first, on="doc_id").where(F.col("t") < F.col("body_top"))
    )
    return body.unionByName(headers.select(*body.columns))


def order_blocks(blocks: DataFrame) -> DataFrame:
    """The block's place on its page, by rounded top, then left. Pages follow each other, so
    (page_no, place) orders a document without a window over all of it."""
    w = Window.partitionBy(*PAGE).orderBy(F.bround("t", 0), "l", "block_no")
    return blocks.withColumn("place", F.row_number().over(w))


# ---- lines -------------------------------------------------------------------------------


def lines_by_top(words: DataFrame) -> DataFrame:
    """``line_top`` (rounded to 0.1) groups words into lines, ``at`` counts along x0.

    Words dealt by document may have been spread by the size of its text, of which they are many times
    as much; dealt by page, what a task sorts follows from their own size."""
    lined = words.withColumn("line_top", F.round("top", 1)).repartition(*PAGE)
    return lined.withColumn("at", F.row_number().over(Window.partitionBy(*LINE).orderBy("x0", "word_no")))


def lines_by_gap(words: DataFrame, keys: Sequence[str] = (*PAGE, "block_no"), tolerance: float = 2.0) -> DataFrame:
    """``line_no`` by distance from the first word of the line, then ``at`` along x0.

    A line's anchor depends on all words before it: sorted words pass by once, and all that is kept of
    them is the line at hand, whose words are counted along x0 when it ends. A word without height stays
    on the line.
    """
    names = list(keys)
    ordered = words.drop("line_no", "at").withColumn("_row", F.bround("top", 0)).repartition(*names).sortWithinPartitions(*names, "_row", "x0", "word_no").drop("_row")
    own, (top, x0, word) = ([ordered.columns.index(k) for k in ks] for ks in (names, ("top", "x0", "word_no")))

    def counted(held: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        """Whole lines with their numbers and the places of their words."""
        rows = pa.Table.from_batches([h[0] for h in held]).combine_chunks().to_batches()[0]
        number, begins = (np.concatenate([h[i] for h in held]) for i in (1, 2))
        starts = np.flatnonzero(begins)
        sizes = np.diff(np.append(starts, len(begins)))
        x = rows.column(x0).cast(pa.float64(), safe=False)
        rank = pc.rank(rows.column(word), sort_keys="ascending", null_placement="at_start", tiebreaker="dense")
        value, known = pc.fill_null(x, 0.0).to_numpy(zero_copy_only=False), pc.is_valid(x).to_numpy(zero_copy_only=False)
        place = np.empty(len(begins), np.int32)
        place[np.lexsort((rank.to_numpy(zero_copy_only=False), value, known, begins.cumsum()))] = np.arange(len(begins)) - np.repeat(starts, sizes) + 1
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(number, pa.int32()), pa.array(place, pa.int32())], [*rows.schema.names, "line_no", "at"])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, anchor, line = None, None, 0
        held: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]] = []  # of the line at hand
        for batch in batches:
            if not len(batch):
                continue
            fresh = _differs(batch, own)
            fresh[0] = block != [batch.column(i)[0].as_py() for i in own]
            block = [batch.column(i)[-1].as_py() for i in own]
            number, begins = [], []
            for new, height in zip(fresh.tolist(), batch.column(top).to_pylist()):
                if new:
                    anchor, line = None, 0
                begin = anchor is None or (height is not None and abs(height - anchor) > tolerance)
                if begin:
                    anchor, line = height, line + 1
                number.append(line)
                begins.append(begin)
            rows = batch, np.array(number, np.int32), np.array(begins, bool)
            if not rows[2].any():
                held.append(rows)
                continue
            last = len(batch) - 1 - int(rows[2][::-1].argmax())
            before = tuple(x[:last] for x in rows)
            if held or last:
                yield counted([*held, before] if last else held)
            held = [tuple(x[last:] for x in rows)]
        if held:
            yield counted(held)

    return ordered.mapInArrow(numbered, f"{ordered._jdf.schema().toDDL()}, line_no int, at int")


def _differs(batch: pa.RecordBatch, columns: Sequence[int]) -> np.ndarray:
    """Which rows differ from the one before in one of *columns*; the first one does not. Nulls are equal."""
    out = np.zeros(len(batch), bool)
    for i in columns:
        here, before = batch.column(i)[1:], batch.column(i)[:-1]
        other = pc.fill_null(pc.not_equal(here, before), pc.xor(pc.is_null(here), pc.is_null(before)))
        out[1:] |= other.to_numpy(zero_copy_only=False)
    return out


def dedup_consecutive(words: DataFrame, line: Sequence[str] = LINE) -> DataFrame:
    """Drop a word equal to the raw word before it, case and punctuation aside."""
    w = Window.partitionBy(*line).orderBy("at")
    marked = words.withColumn("_prev", F.lag(bare_word(F.col("text"))).over(w))
    return marked.where(~bare_word(F.col("text")).eqNullSafe(F.col("_prev"))).drop("_prev")


def line_affected(words: DataFrame, line: Sequence[str] = LINE) -> DataFrame:
    """Add ``affected``: most of the line's words of 4+ characters are doubled."""
    long = F.length("text") >= 4
    share = F.avg(F.when(long, looks_doubled(F.col("text")).cast("int"))).over(Window.partitionBy(*line))
    return words.withColumn("affected", F.coalesce(share > 0.5, F.lit(False)))


def dedup_chars(words: DataFrame, line: Sequence[str] = LINE) -> DataFrame:
    """Collapse doubled characters; words under 4 characters only on affected lines."""
    fix = ((F.length("text") >= 4) | F.col("affected")) & looks_doubled(F.col("text"))
    return line_affected(words, line).withColumn(
        "text", F.when(fix, undouble(F.col("text"))).otherwise(F.col("text"))
    ).drop("affected")


def heading_override(words: DataFrame, block: Sequence[str] = (*PAGE, "block_no")) -> DataFrame:
    """A heading block none of whose words is emphasized or italic is emphasized whole."""
    w = Window.partitionBy(*block)
    says = F.bool_or(F.col("emph") | F.col("ital")).over(w)
    return words.withColumn("emph", F.col("emph") | ((F.col("kind") == "section_header") & ~says))


def render_lines(words: DataFrame, line: Sequence[str] = LINE) -> DataFrame:
    """One marked text per line from words with ``at, emph, ital, under``.

    Markers that end close before those that begin open: close underline, italic, bold; open
    bold, italic, underline; what is open at the line's end closes. Each word only needs its
    neighbours' flags.
    """
    w = Window.partitionBy(*line).orderBy("at")
    no = F.lit(False)

    def edge(flag: str, towards) -> Column:
        return F.col(flag) & ~F.coalesce(towards(flag).over(w), no)

    begins = {f: edge(f, F.lag) for f in ("emph", "ital", "under")}
    ends = {f: edge(f, F.lead) for f in ("emph", "ital", "under")}

    def mark(condition: Column, text: str) -> Column:
        return F.when(condition, F.lit(text))

    piece = F.concat_ws(
        " ", mark(begins["emph"], "**"), mark(begins["ital"], "_"), mark(begins["under"], "++"), F.col("text"),
        mark(ends["under"], "++"), mark(ends["ital"], "_"), mark(ends["emph"], "**"),
    )
    pieces = words.select(*line, "at", piece.alias("piece"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]), " ")
    for mark_ in ("**", "_", "++"):
        text = F.replace(text, F.lit(f"{mark_} {mark_}"), F.lit(" "))
    return pieces.groupBy(*line).agg(text.alias("text"))


def marked_lines(words: DataFrame, rects: DataFrame, profile: DataFrame) -> DataFrame:
    """L1-L16 together: marked lines of a word table in which each word has one face."""
    flagged = underlined(word_flags_plain(words, profile), rects)
    return render_lines(dedup_chars(dedup_consecutive(lines_by_top(flagged))))


# ---- pages -------------------------------------------------------------------------------


def page_texts(lines: DataFrame) -> DataFrame:
    """Lines of a page, top to bottom, joined by newlines."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_top", "text"))), lambda x: x["text"]), "\n")
    return lines.groupBy(*PAGE).agg(text.alias("text"))


def page_text(marked: DataFrame, plain: DataFrame) -> DataFrame:
    """Marked text where a page has any, else its plain text; empty pages are dropped."""
    both = plain.select(*PAGE, F.col("text").alias("plain")).join(marked.select(*PAGE, F.col("text").alias("marked")), on=list(PAGE), how="full")
    return both.select(*PAGE, F.coalesce("marked", F.nullif("plain", F.lit(""))).alias("text")).where(F.col("text").isNotNull())


def assemble_doc(pages: DataFrame) -> DataFrame:
    """Pages joined by a blank line; white space squeezed. The result is one text per
    document by definition."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_no", "text"))), lambda x: x["text"]), "\n\n")
    return pages.groupBy("doc_id").agg(squeeze_document(text).alias("text"))


# A line at a page's edge that is only its number; characters that end a sentence.
EDGE_LINE = r"(?i)^\s*(?:(?:page\s+)?\d+(?:\s+of\s+\d+)?\s*)?$"
TERMINAL = ".!?:;\"'”’)]"


def strip_page_edges(text: Column) -> Column:
    """Drop page numbers and blank lines from both ends of a page, not from its middle. Lines
    are tested one by one: no pattern runs over a page's edge as a whole, however long that is."""
    lines = F.split(text, LINE_BREAK)

    def first_inner(some: Column) -> Column:
        # A page's edge is a line or two; all of its lines are tested only where the first eight are edge.
        def found(xs: Column) -> Column:
            return F.array_position(F.transform(xs, lambda x: ~x.rlike(EDGE_LINE)), True)

        near = found(F.slice(some, 1, 8))
        return F.when(near > 0, near).otherwise(found(some))

    first, behind = first_inner(lines), first_inner(F.reverse(lines))
    return F.when(first == 0, F.when(text.isNotNull(), "")).otherwise(strip(F.array_join(F.slice(lines, first.cast("int"), (F.size(lines) - behind - first + 2).cast("int")), "\n")))


def join_pages(pages: DataFrame) -> DataFrame:
    """Pages of a document as one text. Two pages are joined by a blank when the next
    begins in lower case and the last one does not end a sentence, else by a blank line."""
    cleaned = pages.select("doc_id", "page_no", strip_page_edges(F.col("text")).alias("text")).where("text <> ''")
    w = Window.partitionBy("doc_id").orderBy("page_no")
    last = F.lag(F.substring("text", -1, 1)).over(w)
    first = F.substring("text", 1, 1)
    runs_on = first.rlike(r"\p{Ll}") & ~F.contains(F.lit(TERMINAL), last)
    glue = F.when(last.isNull(), "").when(runs_on, " ").otherwise("\n\n")
    glued = cleaned.select("doc_id", "page_no", F.concat(glue, F.col("text")).alias("text"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_no", "text"))), lambda x: x["text"]), "")
    return glued.groupBy("doc_id").agg(text.alias("text"))
