"""Is a document's text readable, which extractor's text to use, and how markers survive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docstruct.functions.text import is_blank, n_among, strip

# Limits of the readability tests.
MAX_RAW_CHARACTER_IDS = 10
MAX_REPLACEMENT_CHARS = 10
MIN_LETTER_SHARE = 0.60
MIN_CHARS_PER_PAGE = 150


def n_solid_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"(?U)\s", ""))


def letter_share(text: Column) -> Column:
    """ASCII letters among the characters that are not white space."""
    return F.length(F.regexp_replace(text, "[^A-Za-z]", "")) / n_solid_chars(text)


def garbled_reason(text: Column, n_pages: Column | None = None) -> Column:
    """Q1: null for readable text, else the first test it fails."""
    reason = (
        F.when(is_blank(text), "empty")
        .when(F.regexp_count(text, F.lit(r"\(cid:\d+\)")) > MAX_RAW_CHARACTER_IDS, "character ids")
        .when(F.regexp_count(text, F.lit("�")) > MAX_REPLACEMENT_CHARS, "replacement characters")
        .when(letter_share(text) < MIN_LETTER_SHARE, "few letters")
    )
    if n_pages is not None:
        reason = reason.when((n_pages > 0) & (n_solid_chars(text) / n_pages < MIN_CHARS_PER_PAGE), "short pages")
    return reason


def quality_report(docs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Q2: documents per reason; readable ones count under ``ok``."""
    reason = garbled_reason(F.col("text"), F.col("n_pages"))
    return docs.select(*keys, F.coalesce(reason, F.lit("ok")).alias("reason")).groupBy(*keys, "reason").agg(
        F.count("*").alias("n_docs")
    )


def cached_candidates(candidates: DataFrame) -> DataFrame:
    """Q6: one row per document and extractor, with its verdict in ``reason``.

    The first extractor's cached text is judged as it is. A later extractor's cached text is
    used only if it passes; else its fresh text is judged, and where there is none the
    extractor counts as unavailable.
    """
    judged = candidates.withColumn("reason", garbled_reason(F.col("text"), F.col("n_pages")))
    cached, passes = F.col("source") == "cache", F.col("reason").isNull()
    order = F.when(cached & (passes | (F.col("rank") == 0)), 0).when(~cached, 1).otherwise(2)
    w = Window.partitionBy("doc_id", "extractor").orderBy("_order")
    stale = F.col("_order") == 2
    return (
        judged.withColumn("_order", order)
        .withColumn("_n", F.row_number().over(w)).where("_n = 1")
        .select(
            "doc_id", "extractor", "rank", "source", "n_pages",
            F.when(stale, F.lit(None)).otherwise(F.col("text")).alias("text"),
            F.when(stale, "unavailable").otherwise(F.col("reason")).alias("reason"),
        )
    )


def choose_text(candidates: DataFrame) -> DataFrame:
    """Q3: per document the first extractor's text if usable, else the first usable one in rank
    order, else the first one's with ``ok`` false. The rank filter is applied before the shuffle
    too (window group limit), so losing texts mostly stay where they are."""
    judged = candidates.withColumn("reason", garbled_reason(F.col("text"), F.col("n_pages")))
    return _first_usable(judged)


def choose_text_cached(candidates: DataFrame) -> DataFrame:
    """Q6 then Q3."""
    return _first_usable(cached_candidates(candidates))


def _first_usable(judged: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy(F.col("reason").isNotNull(), "rank")
    return judged.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(
        "doc_id", "extractor", "text", F.col("reason").isNull().alias("ok"), "reason"
    )


def attempts(candidates: DataFrame) -> DataFrame:
    """Q4: one row per extractor tried, in order, up to the one that was usable."""
    judged = candidates.select(
        "doc_id", "extractor", "rank", garbled_reason(F.col("text"), F.col("n_pages")).alias("reason")
    )
    w = Window.partitionBy("doc_id")
    winner = F.min(F.when(F.col("reason").isNull(), F.col("rank"))).over(w)
    tried = judged.withColumn("_winner", winner).where(F.col("_winner").isNull() | (F.col("rank") <= F.col("_winner")))
    return tried.select(
        "doc_id", F.row_number().over(w.orderBy("rank")).alias("attempt"), "extractor",
        F.col("reason").isNull().alias("ok"), "reason",
    )


# ---- markers -----------------------------------------------------------------------------

# How each marker is spelled. Bold and underline one way, italic two ways.
BOLD = r"\*\*\s?[^*\n]+?\s?\*\*"
ITALIC_UNDERSCORE = r"(?<![\w*+])_\s?[^_\n]+?\s?_(?![\w])"
ITALIC_STAR = r"(?<![*\w])\*(?!\*)[^*\n]+?\*(?![*\w])"
UNDERLINE = r"\+\+\s?[^+\n]+?\s?\+\+"


def marker_counts(text: Column) -> dict[str, Column]:
    """Q7"""
    def n(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern))

    return {
        "bold": n(BOLD), "italic": n(ITALIC_UNDERSCORE) + n(ITALIC_STAR), "underline": n(UNDERLINE),
        "headings": n(r"(?m)^#+ "),
    }


def with_marker_counts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", *[c.alias(n) for n, c in marker_counts(F.col("text")).items()])


def marker_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Q8: marker counts of two extractors side by side, and whether they all agree."""
    names = ["bold", "italic", "underline"]
    left = with_marker_counts(a).select("doc_id", *[F.col(n).alias(f"{n}_a") for n in names])
    right = with_marker_counts(b).select("doc_id", *[F.col(n).alias(f"{n}_b") for n in names])
    same = F.lit(True)
    for n in names:
        same = same & (F.col(f"{n}_a") == F.col(f"{n}_b"))
    return left.join(right, on="doc_id").withColumn("same", same)


def extract_summary(docs: DataFrame, keys: Sequence[str] = ("extractor",)) -> DataFrame:
    """Q9: documents, characters and marker pairs per extractor."""
    n_chars = F.length("text")

    def pairs(mark: str) -> Column:
        return F.floor(F.regexp_count("text", F.lit(mark)) / 2)

    return docs.groupBy(*keys).agg(
        F.count("*").alias("n_docs"), F.sum(n_chars).alias("chars"), F.avg(n_chars).alias("mean_chars"),
        F.min(n_chars).alias("min_chars"), F.max(n_chars).alias("max_chars"),
        F.sum(pairs(r"\*\*")).alias("bold_runs"), F.sum(pairs("_")).alias("italic_runs"),
    )


def without_markers(text: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(text, "[*_+#]", ""), r"(?U)\s+", " "))


# Marker name -> pattern of a marked span.
SPAN_PATTERNS = {
    "**bold**": r"\*\*(.+?)\*\*",
    "*italic*": r"(?<![*\w])\*(?!\*)(.+?)\*(?![*\w])",
    "_italic_": r"(?<!\w)_(.+?)_(?!\w)",
    "++underline++": r"\+\+(.+?)\+\+",
}

# Markers that render a signal faithfully.
RIGHT_MARKERS = {"bold": ("**bold**", "heading"), "italic": ("*italic*", "_italic_"), "underline": ("++underline++",)}


def _spans(text: Column) -> Column:
    """Every marked span of one text as array of (marker, span)."""
    lines = F.filter(F.split(text, r"\r\n|\r|\n"), lambda x: x.rlike(r"^#+ "))
    headings = F.transform(
        lines,
        lambda x: F.struct(
            F.concat(F.lit("heading "), F.regexp_extract(x, r"^(#+) ", 1)).alias("marker"),
            without_markers(F.regexp_extract(x, r"^#+ (.*)", 1)).alias("span"),
        ),
    )
    def named(marker: str):
        return lambda s: F.struct(F.lit(marker).alias("marker"), without_markers(s).alias("span"))

    marked = [
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), named(marker))
        for marker, pattern in SPAN_PATTERNS.items()
    ]
    return F.concat(headings, *marked)


def marked_spans(docs: DataFrame) -> DataFrame:
    """Q10: one row per marked span."""
    return docs.select("doc_id", F.posexplode(_spans(F.col("text"))).alias("n", "s")).select("doc_id", "n", "s.marker", "s.span")


def marker_fidelity(ref: DataFrame, other: DataFrame) -> DataFrame:
    """Q11: how run *other* ``(doc_id, run, text)`` renders each span of *ref*
    ``(doc_id, n, signal, phrase)``: ``not found``, ``plain`` or its markers in order.

    The other text's spans travel as one array beside it, so each reference span meets its
    document once and no pairs of spans are produced.
    """
    seen = other.select("doc_id", "run", without_markers(F.col("text")).alias("flat"), _spans(F.col("text")).alias("spans"))
    full = F.regexp_replace(without_markers(F.col("phrase")), r"[.:;,]+$", "")
    both = ref.withColumn("full", full).withColumn("key", F.substring("full", 1, 28)).join(seen, on="doc_id")
    carries = F.filter(
        "spans",
        lambda s: F.contains(s["span"], F.col("key"))
        | (F.contains(F.col("full"), s["span"]) & (F.length(s["span"]) >= F.length("full") * 0.6)),
    )
    names = F.array_join(F.array_sort(F.array_distinct(F.transform(carries, lambda s: s["marker"]))), ", ")
    rendered = (
        F.when(~F.contains("flat", "key"), "not found").when(names == "", "plain").otherwise(names)
    )
    return both.select("doc_id", "n", "run", "signal", "phrase", rendered.alias("rendered"))


def fidelity_summary(rendered: DataFrame) -> DataFrame:
    """Q11: spans marked at all, marked right and not found, per signal and run."""
    right = F.lit(False)
    for signal, markers in RIGHT_MARKERS.items():
        for m in markers:
            right = right | ((F.col("signal") == signal) & F.contains("rendered", F.lit(m)))
    return rendered.groupBy("signal", "run").agg(
        F.count("*").alias("n_spans"),
        F.count_if(~F.col("rendered").isin("plain", "not found")).alias("marked"),
        F.count_if(right).alias("right_marker"),
        F.count_if(F.col("rendered") == "not found").alias("not_found"),
    )


def ungrounded_lines(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Q12: lines of *docs* with four or more words of 4+ letters, at least half of which
    (rounded down) do not occur in the same document's text in *vocabulary*."""
    def long_words(text: Column) -> Column:
        return F.regexp_extract_all(F.lower(text), F.lit("[a-z]{4,}"), F.lit(0))

    known = vocabulary.select("doc_id", long_words(F.col("text")).alias("known"))
    lines = F.split("text", r"\r\n|\r|\n")
    split = docs.select("doc_id", lines.alias("lines")).withColumn("words", F.transform("lines", long_words))
    both = split.join(known, on="doc_id").select("doc_id", "lines", "words", F.array_except(F.flatten("words"), "known").alias("unknown"))
    rows = both.select("doc_id", "unknown", F.posexplode(F.arrays_zip("lines", "words")).alias("line_no", "x")).select(
        "doc_id", "line_no", "unknown", F.col("x.lines").alias("line"), F.col("x.words").alias("words")
    )
    n_unknown = n_among(F.col("words"), F.col("unknown"))
    return rows.where(F.size("words") >= 4).select(
        "doc_id", "line_no", strip("line").alias("line"), F.size("words").alias("n_words"), n_unknown.alias("n_unknown")
    ).where(F.col("n_unknown") >= F.floor(F.col("n_words") / 2))
