"""Main text of web pages by two passes over their blocks.

First pass: each block of text is decided by where it stands (menu, footer, advert, form, ...),
its link density, its length and its stop-word density. Second pass: blocks too short or too mixed
to decide take the label of the nearest decided block; the page's ends decide nothing.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstruct.llm.words import ALL_STOP_WORDS

SHORT, LONG = 70, 200  # characters
LINKS_FEW, LINKS_MANY = 0.2, 0.5  # share of a block's characters that are links
STOPS_LOW, STOPS_HIGH = 0.08, 0.16  # share of a block's words that are stop words

DROPPED = frozenset("script style noscript template svg math iframe object canvas audio video map select button textarea title datalist applet".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head"
    " header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset(
    "article aside blockquote body details dialog div dl fieldset figure footer form header main menu nav ol section span table ul".split()
)
BAD_TAGS = frozenset("nav footer aside form dialog menu".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner promo promotion sponsor sponsored nav navbar navigation menu"
    " breadcrumb breadcrumbs footer sidebar aside widget related recommended share sharing social cookie cookies consent gdpr notice notices notification"
    " alert popup modal overlay newsletter subscribe subscription signup login search comment comments commentlist disqus reply replies respond"
    " pagination pager copyright masthead toolbar skip paywall disclaimer".split()
)
PAGE_HEADER = frozenset("header masthead topbar".split())

_TAG = re.compile(r"""<(?:!--|(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*+"|'[^']*+'|[^"'>])*+)(?:>|\Z|(?=["']))|[!?][^>]*+(?:>|\Z))""")
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|style|hidden)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD = re.compile(r"[^\W\d_]+")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of *pages*: id, url, text, n_chars (code points of text).

    White space within a block becomes one space; blocks are joined by a line feed in page order.
    A null or empty page has the empty text. Rows are independent: repeated identifiers, null
    identifiers and null urls are passed on as they are, and further columns are ignored.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("link"), F.col(html_col).alias("html"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, link string, text string, n_chars bigint"
    out = rows.mapInArrow(_extract, schema)
    return out.select(F.col("id").alias(id_col), F.col("link").alias(url_col), "text", "n_chars")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [page_text(x or "") for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("link"), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], ["id", "link", "text", "n_chars"]
        )


class Block:
    __slots__ = ("text", "zone", "bad", "heading", "links")

    def __init__(self, text: str, zone: int, bad: bool, heading: bool, links: float):
        self.text, self.zone, self.bad, self.heading, self.links = text, zone, bad, heading, links


def page_text(source: str) -> str:
    blocks = list(page_blocks(source))
    labels = [first_label(b) for b in blocks]
    labels = settled(blocks, labels)
    if any(label and b.zone for b, label in zip(blocks, labels)):
        labels = [label and b.zone > 0 for b, label in zip(blocks, labels)]  # the page says where its article is
    return "\n".join(b.text for b, label in zip(blocks, labels) if label)


def page_blocks(source: str) -> Iterator[Block]:
    """Runs of text between block-level tags, entities decoded. zone numbers the article or main
    element around a block, 0 outside."""
    stack: list[tuple[str, bool, int]] = []  # open containers: tag, bad from here on, zone
    open_count: dict[str, int] = {}
    unclosed: set[str] = set()
    bad, zone, zones, heading, in_link, breaks = False, 0, 0, False, 0, 0
    parts: list[str] = []
    linked = 0
    at = 0

    def flush() -> Block | None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        share, linked = (linked / max(len(text), 1), 0)
        return Block(text, zone, bad, heading, min(share, 1.0)) if text else None

    for match in iter(lambda: _TAG.search(source, at), None):
        if match.start() > at:
            chunk = source[at : match.start()]
            parts.append(chunk)
            if not chunk.isspace():
                breaks = 0
                linked += len(html.unescape(chunk).strip()) if in_link else 0
        at = max(match.end(), match.start() + 1)
        if match[2] is None:
            if source.startswith("<!--", match.start()):
                end = source.find("-->", match.start() + 2)
                at = len(source) if end < 0 else end + 3
            continue
        closing, tag, rest = match[1] == "/", match[2].lower(), match[3]
        if tag in DROPPED:
            parts.append(" ")
            if not closing and not rest.endswith("/") and tag not in unclosed:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, at)
                if end:
                    at = end.end()
                elif tag in ("script", "style"):
                    at = len(source)
                else:
                    unclosed.add(tag)
            continue
        if tag == "a":
            in_link = 0 if closing else 1
            continue
        if tag == "br":
            breaks += 1
            parts.append(" ")
            if breaks >= 2 and (block := flush()):
                yield block
            continue
        if tag not in BLOCKS and tag != "span":
            continue
        if tag != "span":
            if block := flush():
                yield block
            heading = not closing and len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
            in_link, breaks = 0, 0
        if tag not in CONTAINERS:
            continue
        if closing:
            if open_count.get(tag):
                while stack:
                    name, bad, zone = stack.pop()
                    open_count[name] -= 1
                    if name == tag:
                        break
        elif tag != "span" or "class" in rest:
            if tag == "span" and parts and _is_bad(tag, rest, zone):
                if block := flush():
                    yield block
            stack.append((tag, bad, zone))
            open_count[tag] = open_count.get(tag, 0) + 1
            bad = bad or _is_bad(tag, rest, zone)
            if tag in ("article", "main") and not zone:
                zones += 1
                zone = zones
    parts.append(source[at:])
    if block := flush():
        yield block


def _is_bad(tag: str, attributes: str, zone: int) -> bool:
    if tag in BAD_TAGS or (tag == "header" and not zone):
        return True
    if tag in ("body", "html") or not attributes:
        return False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "style" and _HIDDEN.search(value)) or (name == "role" and value in BAD_ROLES):
            return True
        if name in ("class", "id"):
            for one in value.split():
                if not one.startswith(("has-", "with-", "no-")) and "-with-" not in one:
                    tokens = re.split(r"[^a-z]+", one)
                    if not BAD_NAMES.isdisjoint(tokens) or (not zone and not PAGE_HEADER.isdisjoint(tokens)):
                        return True
    return False


def first_label(block: Block) -> bool | None:
    """True, False, or None where the block alone does not decide."""
    text = block.text
    if block.bad or block.links > LINKS_MANY or (len(text) < LONG and text.startswith(("©", "(c) ", "(C) ", "Copyright"))):
        return False
    if block.zone:
        return True if len(text) >= SHORT and not block.heading else None
    if block.links > LINKS_FEW or (len(text) < SHORT and block.links > 0):
        return False
    if len(text) < SHORT or block.heading:
        return None
    words = _WORD.findall(text.lower())
    stops = sum(w in ALL_STOP_WORDS for w in words) / max(len(words), 1)
    if stops >= STOPS_HIGH:
        return True if len(text) >= LONG else None
    return None if stops >= STOPS_LOW else False


def settled(blocks: list[Block], labels: list[bool | None]) -> list[bool]:
    """Undecided blocks take the nearest decided label; of two as near, the one after for a
    heading, else the refusing one. In an article only its own blocks count, and its undecided
    blocks stay where it has none decided."""
    n = len(labels)
    before: list[int | None] = [None] * n
    after: list[int | None] = [None] * n
    for result, order in ((before, range(n)), (after, range(n - 1, -1, -1))):
        last: int | None = None
        for i in order:
            if last is not None and blocks[last].zone == blocks[i].zone:
                result[i] = last
            if labels[i] is not None and not (blocks[i].zone and blocks[i].bad):
                last = i
    out = []
    for i, label in enumerate(labels):
        if label is None:
            near = [j for j in (before[i], after[i]) if j is not None]
            if not near:
                label = blocks[i].zone > 0
            elif len(near) == 2 and i - near[0] == near[1] - i:
                label = labels[near[1]] if blocks[i].heading else labels[near[0]] and labels[near[1]]
            else:
                label = labels[min(near, key=lambda j: abs(i - j))]
        out.append(bool(label))
    return out
