"""Main text of web pages: flat text blocks, judged by a decision tree.

A page is cut into flat blocks at its block tags. A block's features are its word count and link
density, and those of the blocks before and after it: nothing of its markup. The tree is grown (Gini
impurity, on the driver, in a moment) from ``TABLE``, a small table of labelled blocks. What words and
links can't tell, such as a reader's comment of a paragraph, is left out afterwards where an element
around it says what it is (``nav``, a class ``comments``); no markup makes a block main text. Names that
only contain such a word (``comment-list``, ``has-sidebar``) may speak of what is inside or beside: what
they say of an element's state is no role, and an element that holds all but ``BESIDE`` of the text that
the tree found is the page, whatever it is called.

Scale: pages are mapped one by one, nothing is shuffled, and memory follows the longest page. Every
scan over a page moves forward only, so the time is in proportion to its length.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need

BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td"
    " tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content isn't text of the page: scripts, styles, what the head says, what a form holds.
SILENT = frozenset("script style title textarea".split())
#: Elements that end where a like one begins.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

ASIDE_TAGS = frozenset("nav footer aside menu dialog button select fieldset".split())
#: Share of the words that the tree finds that may stand outside an element that is the page, and the least words in it.
BESIDE, PAGE_WORDS = 0.05, 50
#: Parts of a hyphenated name that make it the state of an element, not its role.
STATES = frozenset("has have with without no not is are on off hide hidden show shows can enabled disabled open closed active inactive".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer"
    " discussion disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup promo"
    " promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe tags"
    " toolbar topbar widget widgets contentinfo complementary alert".split()
)

TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*+)((?>[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)>""")
ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORDS = re.compile(r"[a-z]+")
#: How surely an element says that it stands beside the text.
NOT, PERHAPS, SURELY = 0, 1, 2

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after")

#: Labelled blocks: the features in order, then 1 for main text. Counts of 0 mean that there is no such block.
TABLE = [
    # headings and paragraphs amid text, of any length
    (9, 0.0, 10, 0.0, 60, 0.0, 1), (4, 0.0, 8, 0.0, 30, 0.0, 1), (12, 0.0, 12, 0.0, 5, 0.0, 1), (3, 0.0, 5, 0.0, 2, 0.0, 1), (30, 0.0, 13, 0.0, 80, 0.0, 1), (10, 0.0, 4, 0.0, 1, 0.0, 1),
    (60, 0.0, 9, 0.0, 45, 0.0, 1), (2, 0.0, 50, 0.0, 70, 0.0, 1), (1, 0.0, 30, 0.0, 4, 0.0, 1), (1, 0.0, 9, 0.0, 12, 0.0, 1), (90, 0.2, 2, 0.0, 10, 0.0, 1), (25, 0.4, 40, 0.0, 60, 0.0, 1),
    (5, 0.3, 40, 0.0, 60, 0.0, 1), (200, 0.0, 10, 0.0, 13, 0.0, 1), (400, 0.0, 120, 0.0, 9, 0.0, 1), (8, 0.0, 1, 0.0, 1, 0.0, 1), (15, 0.0, 60, 0.0, 13, 0.0, 1), (1, 0.0, 1, 0.0, 10, 0.0, 1),
    (1, 0.0, 300, 0.0, 14, 0.0, 1), (5, 0.0, 2, 0.0, 8, 0.0, 1), (7, 0.0, 7, 0.0, 7, 0.0, 1), (40, 0.1, 70, 0.3, 50, 0.2, 1), (18, 0.0, 6, 0.0, 22, 0.0, 1), (1000, 0.0, 4, 0.0, 16, 0.0, 1),
    # the first of the text: a title, or a paragraph or a title of a long text right after a menu
    (24, 0.0, 0, 0.0, 24, 0.0, 1), (5, 0.0, 0, 0.0, 60, 0.0, 1), (9, 0.0, 0, 0.0, 12, 0.0, 1), (2, 0.0, 0, 0.0, 30, 0.0, 1), (24, 0.0, 2, 1.0, 24, 0.0, 1), (60, 0.0, 1, 1.0, 80, 0.0, 1),
    (35, 0.0, 3, 1.0, 5, 0.0, 1), (6, 0.0, 1, 1.0, 45, 0.0, 1), (8, 0.0, 2, 1.0, 120, 0.0, 1), (3, 0.0, 1, 1.0, 24, 0.0, 1), (120, 0.0, 1, 1.0, 10, 0.0, 1), (40, 0.0, 5, 0.9, 0, 0.0, 1),
    # the last of it, before links or before nothing, or all of it
    (40, 0.0, 60, 0.0, 3, 1.0, 1), (26, 0.0, 80, 0.0, 2, 1.0, 1), (50, 0.0, 60, 0.0, 0, 0.0, 1), (80, 0.0, 9, 0.0, 0, 0.0, 1), (30, 0.0, 100, 0.0, 0, 0.0, 1), (26, 0.0, 26, 0.0, 0, 0.0, 1),
    (24, 0.0, 0, 0.0, 0, 0.0, 1), (120, 0.0, 0, 0.0, 0, 0.0, 1), (300, 0.1, 3, 1.0, 3, 1.0, 1), (45, 0.0, 2, 1.0, 2, 1.0, 1),
    # menus and lists of links
    (1, 1.0, 0, 0.0, 1, 1.0, 0), (2, 1.0, 1, 1.0, 2, 1.0, 0), (3, 1.0, 2, 1.0, 9, 0.0, 0), (5, 0.9, 40, 0.0, 2, 1.0, 0), (12, 0.8, 30, 0.0, 5, 0.9, 0), (25, 0.8, 3, 1.0, 5, 0.5, 0),
    (4, 1.0, 80, 0.0, 60, 0.0, 0), (8, 1.0, 60, 0.0, 0, 0.0, 0), (20, 0.7, 12, 0.0, 10, 1.0, 0), (1, 1.0, 1, 1.0, 13, 0.0, 0), (40, 0.9, 10, 0.0, 20, 0.0, 0), (6, 0.6, 4, 0.8, 70, 0.0, 0),
    # a link or two right before the text, or after it
    (1, 1.0, 0, 0.0, 60, 0.0, 0), (2, 1.0, 0, 0.0, 9, 0.0, 0), (1, 1.0, 0, 0.0, 24, 0.0, 0), (3, 0.9, 0, 0.0, 150, 0.0, 0), (6, 1.0, 0, 0.0, 5, 0.0, 0), (2, 1.0, 60, 0.0, 0, 0.0, 0),
    (1, 1.0, 9, 0.0, 40, 0.0, 0), (10, 0.7, 0, 0.0, 80, 0.0, 0), (4, 0.6, 0, 0.0, 30, 0.0, 0),
    # adverts and notices between a menu and the text
    (10, 0.0, 1, 1.0, 9, 0.0, 0), (4, 0.0, 1, 1.0, 10, 0.0, 0), (13, 0.0, 1, 1.0, 4, 0.0, 0), (7, 0.0, 1, 1.0, 16, 0.0, 0), (11, 0.0, 1, 1.0, 14, 0.0, 0), (12, 0.0, 2, 1.0, 3, 0.0, 0),
    (5, 0.0, 1, 1.0, 5, 0.0, 0), (9, 0.0, 3, 1.0, 12, 0.0, 0), (14, 0.0, 1, 1.0, 11, 0.0, 0), (3, 0.0, 1, 1.0, 2, 0.0, 0), (10, 0.0, 2, 0.9, 1, 0.0, 0),
    # footers and other short ends
    (7, 0.0, 15, 0.0, 0, 0.0, 0), (13, 0.0, 60, 0.0, 0, 0.0, 0), (16, 0.0, 5, 0.0, 0, 0.0, 0), (10, 0.0, 1, 0.0, 0, 0.0, 0), (12, 0.0, 400, 0.0, 0, 0.0, 0), (3, 0.0, 24, 0.0, 0, 0.0, 0),
    (14, 0.0, 150, 0.0, 0, 0.0, 0), (16, 0.0, 1000, 0.0, 0, 0.0, 0), (9, 0.0, 9, 0.0, 0, 0.0, 0), (6, 0.0, 3, 1.0, 0, 0.0, 0), (15, 0.0, 2, 1.0, 0, 0.0, 0), (3, 0.0, 0, 0.0, 0, 0.0, 0),
    # between links, and titles of lists of links
    (3, 0.0, 2, 1.0, 2, 1.0, 0), (10, 0.0, 1, 1.0, 1, 1.0, 0), (2, 0.0, 60, 0.0, 2, 1.0, 0), (3, 0.0, 30, 0.0, 1, 1.0, 0), (14, 0.0, 0, 0.0, 2, 1.0, 0), (4, 0.0, 0, 0.0, 1, 1.0, 0),
    (1, 0.0, 0, 0.0, 0, 0.0, 0), (1, 0.0, 0, 0.0, 1, 1.0, 0),
]


@dataclass
class Leaf:
    share: float


@dataclass
class Split:
    feature: int
    at: float
    low: Leaf | Split
    high: Leaf | Split


def grow(rows: list[tuple], depth: int = 8) -> Leaf | Split:
    """The tree over rows of features and a label, by the split of least weighted Gini impurity."""
    labels = [r[-1] for r in rows]
    share = sum(labels) / len(labels)
    if not depth or share in (0.0, 1.0):
        return Leaf(share)
    gini = lambda part: 2 * sum(part) * (len(part) - sum(part)) / len(part)
    best = None
    for f in range(len(rows[0]) - 1):
        values = sorted({r[f] for r in rows})
        for a, b in zip(values[:-1], values[1:]):
            at = (a + b) / 2
            low, high = [r[-1] for r in rows if r[f] <= at], [r[-1] for r in rows if r[f] > at]
            score = gini(low) + gini(high)
            if best is None or score < best[0] - 1e-12:
                best = score, f, at
    if best is None:
        return Leaf(share)
    _, f, at = best
    return Split(f, at, grow([r for r in rows if r[f] <= at], depth - 1), grow([r for r in rows if r[f] > at], depth - 1))


def share_of(tree: Leaf | Split, row: list[float]) -> float:
    while isinstance(tree, Split):
        tree = tree.low if row[tree.feature] <= tree.at else tree.high
    return tree.share


@dataclass
class Block:
    text: str
    links: float  # share of its characters that stand in links
    aside: bool  # whether the markup around it says that it isn't the page's text
    claims: tuple[int, ...] = ()  # elements around it that perhaps say so


def _aside(name: str, attributes: str, inside: bool) -> int:
    """Whether an element calls itself something beside the text; ``inside`` an article a header belongs to it."""
    if name == "header" and not inside or name in ASIDE_TAGS:
        return SURELY
    found = PERHAPS if name == "form" else NOT
    if attributes and ATTRIBUTE.search(attributes):
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key == "hidden" or key == "aria-hidden" and value == "true":
                return SURELY
            if key == "role" and value in ("navigation", "banner", "search"):
                return SURELY
            if name in ("html", "body", "main", "article"):
                continue
            for own in value.split():
                if own in ASIDE_WORDS:
                    return SURELY
                parts = WORDS.findall(own)
                if not ASIDE_WORDS.isdisjoint(parts) and STATES.isdisjoint(parts):
                    found = PERHAPS
    return found


def blocks_of(page: str) -> list[Block]:
    """The flat text blocks of a page, in order."""
    out: list[Block] = []
    pieces: list[tuple[str, bool]] = []
    open_: list[tuple[str, bool, tuple[int, ...]]] = []  # name, aside, claims; each with what is around it
    link, at, n, claimed = False, 0, len(page), 0

    def end() -> None:
        if not pieces:
            return
        text = " ".join("".join(t for t, _ in pieces).split())
        if text:
            linked = sum(len("".join(t.split())) for t, is_link in pieces if is_link)
            out.append(Block(text, linked / max(1, len("".join(text.split()))), bool(open_) and open_[-1][1], open_[-1][2] if open_ else ()))
        pieces.clear()

    while at < n:
        tag = page.find("<", at)
        if tag < 0:
            tag = n
        if tag > at:
            pieces.append((html.unescape(page[at:tag]), link))
        if tag >= n:
            break
        if page.startswith("<!--", tag):
            at = page.find("-->", tag + 4)
            at = n if at < 0 else at + 3
            continue
        if page[tag + 1 : tag + 2] in ("!", "?"):
            at = page.find(">", tag)
            at = n if at < 0 else at + 1
            continue
        m = TAG.match(page, tag)
        if not m and (page.startswith("</", tag) or page[tag + 1 : tag + 2].isalpha()):  # never closed, or without a name
            stop = page.find(">", tag)
            at = n if stop < 0 else stop + 1
            continue
        if not m:  # a sign
            pieces.append(("<", link))
            at = tag + 1
            continue
        name, closing, at = m[1].lower(), page[tag + 1] == "/", m.end()
        if name == "br":
            pieces.append((" ", link))
        elif name == "a":
            link = not closing
        elif name in SILENT:
            if not closing and not m[2].endswith("/"):
                stop = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
                at = stop.end() if stop else n
        elif name in BLOCKS or "-" in name:
            end()
            if name[0] == "h" and name[1:].isdigit() or name == "p" or name in VOID:
                pass
            elif closing:
                for k in range(len(open_) - 1, -1, -1):
                    if open_[k][0] == name:
                        del open_[k:]
                        break
            else:
                if open_ and open_[-1][0] in SIBLINGS.get(name, ()):
                    open_.pop()
                aside, claims = open_[-1][1:] if open_ else (False, ())
                said = NOT if aside else _aside(name, m[2], any(o[0] in ("article", "main") for o in open_))
                if said == PERHAPS:
                    claimed += 1
                    claims = (*claims, claimed)
                open_.append((name, aside or said == SURELY, claims))
            link = False
    end()
    return out


def features_of(found: list[Block]) -> list[list[float]]:
    sizes = [(0.0, 0.0), *((float(len(b.text.split())), b.links) for b in found), (0.0, 0.0)]
    return [[*sizes[k + 1], *sizes[k], *sizes[k + 2]] for k in range(len(found))]


def main_text(page: str | None, tree: Leaf | Split) -> str:
    found = blocks_of(page or "")
    kept = [b for b, row in zip(found, features_of(found), strict=True) if share_of(tree, row) > 0.5 and not b.aside]
    sizes = [len(b.text.split()) for b in kept]
    inside: dict[int, int] = {}
    for b, words in zip(kept, sizes, strict=True):
        for claim in b.claims:
            inside[claim] = inside.get(claim, 0) + words
    least = max(PAGE_WORDS, (1 - BESIDE) * sum(sizes))
    return "\n\n".join(b.text for b in kept if all(inside[claim] >= least for claim in b.claims))


def extract(pages: DataFrame) -> DataFrame:
    """``row`` (every column of ``pages``) and ``text``, the main text of the column ``html``.

    Null and empty pages give an empty text; so do pages that hold nothing but menus and the like. Equal
    rows give equal texts; a missing column counts as null.
    """
    tree = grow(TABLE)
    whole = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"))
    whole = whole.select("row", (F.col("row.html") if "html" in {c.lower() for c in pages.columns} else F.lit(None)).cast("string").alias("html"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, tree) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "text"])

    return whole.mapInArrow(read, whole.select("row").schema.add("text", "string"))


def op10(spark, sf_dir: str) -> DataFrame:
    pages = need(spark.read.parquet(f"{sf_dir}/pages.parquet"), page_id="long", url="string", html="string")
    # in UTF-8, a code point that isn't a surrogate half has one byte that doesn't continue another
    return extract(pages).select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))
