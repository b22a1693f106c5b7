"""Text expressions. Everything here is a Column in, a Column out; no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# `(?U)` makes \s and \w follow Unicode, as text tools outside the JVM do.
_EDGE_SPACE = r"(?U)^\s+|\s+$"
_SPACES = r"(?U)\s+"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _EDGE_SPACE, "")


def collapse(c: Column) -> Column:
    """Runs of white space become one blank, edges are stripped."""
    return strip(F.regexp_replace(c, _SPACES, " "))


def is_blank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def letters_and_digits(c: Column) -> Column:
    """Lower-cased ASCII letters and digits, everything else one blank."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def tokens(c: Column) -> Column:
    """M1: the set of lower-case ASCII alphanumeric tokens, in first-seen order."""
    words = F.split(letters_and_digits(F.coalesce(c, F.lit(""))), " ")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def containment(left: Column, right: Column) -> Column:
    """M2: share of the *left* token set that lies in *right*; 0 for an empty left."""
    shared = F.size(F.array_intersect(left, right)).cast("double")
    return F.when(F.size(left) > 0, shared / F.size(left)).otherwise(F.lit(0.0))


def n_among(words: Column, some: Column) -> Column:
    """How many of *words*, repeats included, are among *some*. Both are computed once: what they
    share is found through a hash and carried along a fold, as a lambda would compute it per word."""
    start = F.struct(F.lit(0).alias("n"), F.array_intersect(words, some).alias("met"))
    step = lambda acc, w: F.struct((acc["n"] + F.array_contains(acc["met"], w).cast("int")).alias("n"), acc["met"].alias("met"))
    return F.aggregate(words, start, step, lambda acc: acc["n"])


def looks_like_url(c: Column) -> Column:
    """L9"""
    return F.lower(c).rlike(r"https?:|www\.")


def is_italic(font: Column) -> Column:
    """L3"""
    return font.rlike("[Ii]talic|[Oo]blique")


def names_bold(font: Column) -> Column:
    """The face name itself says bold."""
    return font.rlike("[Bb]old|[Bb]lack|[Hh]eavy|[Ss]emibold")


def has_alnum(c: Column) -> Column:
    return c.rlike(r"[\p{L}\p{N}]")


# What separates lines.
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\u0085\u2028\u2029]"


def bare_word(c: Column) -> Column:
    """Lower-cased word characters only; the form two neighbours are compared in."""
    return F.lower(F.regexp_replace(c, r"(?U)\W", ""))


def looks_doubled(c: Column) -> Column:
    """More than 70% of the character pairs (1-2, 3-4, ...) hold the same character."""
    n = F.length(c)
    starts = F.when(n >= 2, F.sequence(F.lit(1), n - 1, F.lit(2)))
    pairs = F.size(F.filter(starts, lambda i: F.substring(c, i, F.lit(1)) == F.substring(c, i + 1, F.lit(1))))
    return F.coalesce((n >= 2) & (pairs / (n / 2) > 0.7), F.lit(False))


def undouble(c: Column) -> Column:
    return F.regexp_replace(c, r"(.)\1", "$1")


def squeeze_document(c: Column) -> Column:
    """Blanks and tabs to one blank, three or more newlines to two, edges stripped."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def markdown_to_marked(c: Column) -> Column:
    """`# x` lines become `** x **`, `*x*` becomes `_x_`, blanks and blank lines collapse."""
    # What a heading and an italic run look like.
    heading = r"^\s{0,3}#{1,6}\s+(.*?)\s*#*\s*$"
    italic = r"(?<!\*)\*(?!\*)([^*\n]+?)\*(?!\*)"

    def one_line(line: Column) -> Column:
        title = strip(F.regexp_extract(line, heading, 1))
        as_heading = F.when(title != "", F.concat(F.lit("** "), title, F.lit(" **"))).otherwise("")
        return F.when(line.rlike(heading), as_heading).otherwise(F.regexp_replace(line, italic, "_$1_"))

    lines = F.array_join(F.transform(F.split(c, LINE_BREAK), one_line), "\n")
    return strip(F.regexp_replace(F.regexp_replace(lines, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n"))


# ---- values of a JSON record -------------------------------------------------------------

# Texts that stand for "nothing here".
EMPTY_TEXTS = ["", "null", "none", "n/a", "na"]
# One of them, whatever its case, between white space: anchored, so most values fail at their first letter.
_IS_EMPTY = r"(?Ui)^\s*(?:" + "|".join(x for x in EMPTY_TEXTS if x) + r")?\s*\z"

# Last path part -> how two values of the field are compared.
IDENTIFIER_FIELDS = ["identifier", "mbox", "url", "access_url", "download_url", "scheme_uri", "license_ref"]
DATE_FIELDS = ["created", "modified", "issued", "start", "end", "start_date", "available_until"]
CONTROLLED_FIELDS = [
    "type", "data_access", "personal_data", "sensitive_data", "ethical_issues_exist",
    "language", "relation_type", "resource_type", "funding_status", "role",
    "certified_with", "geo_location", "pid_system", "currency_code", "is_reused",
]


def norm_text(c: Column) -> Column:
    """J4"""
    return F.lower(collapse(c))


def is_empty_value(c: Column) -> Column:
    """J1 for a scalar rendered as text; containers are dealt with while flattening."""
    return c.isNull() | c.rlike(_IS_EMPTY)


def norm_id(c: Column) -> Column:
    """An identifier without scheme, resolver host or trailing slash; CC licences as cc-x-n.n."""
    bare = norm_text(c)
    # Scheme, resolver hosts, trailing slashes.
    for pattern in (r"^https?://", r"^(www\.|dx\.)?doi\.org/", r"^www\.", r"/+$"):
        bare = F.regexp_replace(bare, pattern, "")
    # The two spellings of a Creative Commons licence.
    deed = r"creativecommons\.org/licenses/([a-z\-]+)/(\d\.\d)"
    short = r"^cc[\s\-]+([a-z][a-z\-]*)[\s\-]+(\d\.\d)$"
    return (
        F.when(bare.rlike(deed), F.regexp_replace(bare, deed, "cc-$1-$2"))
        .when(bare.rlike(short), F.regexp_replace(bare, short, "cc-$1-$2"))
        .otherwise(bare)
    )


def norm_date(c: Column) -> Column:
    """The first day found, else the normalised text."""
    text = norm_text(c)
    day = F.regexp_extract(text, r"\d{4}-\d{2}-\d{2}", 0)
    return F.when(day != "", day).otherwise(text)


def bare_path(path: Column) -> Column:
    """A field path without list indices."""
    return F.regexp_replace(path, r"\[\d+\]", "")


def last_part(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, ".", -1), r"\[\d+\]$", "")


def field_kind(path: Column) -> Column:
    """J7"""
    last = last_part(path)
    return (
        F.when(last.isin(IDENTIFIER_FIELDS), "identifier")
        .when(last.isin(DATE_FIELDS), "date")
        .when(last.isin(CONTROLLED_FIELDS), "controlled")
        .otherwise("text")
    )
