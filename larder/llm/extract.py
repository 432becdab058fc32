"""Main text of web pages by two passes of block rules."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.base import packed, view

# Common function words by language.
STOP_WORDS = {
    "en": "the of and to in a is that it for on with as are was be this by an or at from have not but they his her you we he she which were their has had will would can been if when who what there all one no so more than into its about only other some then them these out up do".split(),
    "fr": "le la les de des du un une et en que qui dans pour pas sur au aux par est ce cette ces avec il elle ils elles se sa son ses ne plus ou mais nous vous on sont était être avoir a été d l s qu n c leur comme tout deux même sans entre".split(),
    "es": "el la los las de del y en que se con por una un uno su sus al lo como para mi no es son fue era más pero sin sobre este esta esto ha han ser o si ya le les muy entre también cuando hasta desde".split(),
    "de": "der die das und zu den von mit sich auf für ist im dem nicht ein eine einer einem einen als auch es an werden aus er hat dass sie nach wird bei um am sind noch wie über so zum zur war haben nur oder aber vor bis mehr durch man sein ich wir ihr".split(),
}
ALL_STOP_WORDS = frozenset(w for words in STOP_WORDS.values() for w in words)

#: Share of stop words: prose has DENSE or more, a block below SPARSE is none. A page below KNOWN is in another language.
DENSE, SPARSE, KNOWN = 0.2, 0.1, 0.05
#: Characters: a block below SHORT is decided by its neighbours, one of LONG or more needs no dense stop words.
SHORT, LONG = 70, 200
#: Share of characters in links above which a block is no text.
LINKED = 0.33

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr output q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
_ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split()
)
#: An opening tag closes an open element of these, up to the nearest one of the second kind.
_SAME = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
_SAME = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in _SAME.items()}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements without main text. A form may hold a whole page: an article inside counts.
_DROPPED = frozenset("head nav aside footer menu dialog noscript button select label fieldset datalist canvas audio video object svg template applet map".split())
_DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar status".split())

# Words of class and id names.
_DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adslot adbox sponsor sponsored sponsors promo promotion promoted banner banners "
    "nav navbar navigation menu menus breadcrumb breadcrumbs masthead topbar footer foot sidebar aside rail widget widgets cookie cookies consent gdpr notice notices notification alert "
    "popup modal overlay newsletter subscribe subscription signup login register share sharing social related recommended recommendations teaser "
    "comment comments commentlist disqus discussion replies reply respond form search pagination pager copyright legal disclaimer skip toolbar paywall "
    "werbung anzeige kommentar kommentare hinweis navigationsleiste fusszeile publicite commentaire commentaires publicidad comentario comentarios aviso".split()
)
_MAIN_NAMES = frozenset("article articlebody story entry maincontent".split())
#: A name with one of these says what a page has, not what an element is.
_OTHERWISE = frozenset("no not has have with without is show hide before after".split())

_COMMENTS_TITLE = re.compile(
    r"(?:\d+\s+)?(?:reader\s+|user\s+)?(?:comments?|replies|responses|discussion|kommentare?|commentaires?|comentarios?|leserkommentare)(?:\s*\(?\d+\)?)?\s*:?"
    r"|(?:leave a (?:comment|reply)|kommentar schreiben|laisser un commentaire|deja un comentario)", re.I,
)
_NOTICE = re.compile(r"©|\(c\)\s*\d{4}|all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos reservados|\bcookies?\b.*\b(?:accept|consent|policy|settings|agree|use)|enable javascript|privacy policy", re.I)

_RAW = "script|style|textarea|title|xmp|iframe|noembed|noframes|plaintext"
_TOKEN = re.compile(
    rf"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(?P<raw>{_RAW})(?=[\s/>])[^>]*+>.*?(?:</(?P=raw)(?=[\s/>])[^>]*+>?|\Z)"
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*+)(?:>|\Z)|</[^>]*+>?""",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|itemprop|hidden|aria-hidden|style)(?![\w-])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Block(NamedTuple):
    text: str
    links: int  # characters inside links
    heading: int  # level, 0 for none
    main: bool  # inside an article
    dropped: bool  # inside a menu, header, footer, advert or the like


def _kind(tag: str, rest: str) -> tuple[bool, bool]:
    """(has no main text, is the article) by an element's name and attributes."""
    dropped, main = tag in _DROPPED, tag in ("article", "main")
    if tag in ("html", "body") or not rest or rest.isspace():
        return dropped and tag != "body", main
    for m in _ATTRIBUTE.finditer(rest):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden":
            dropped = True
        elif name == "aria-hidden":
            dropped |= value.strip().lower() == "true"
        elif name == "style":
            dropped |= re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) is not None
        elif name == "role":
            dropped |= value.strip().lower() in _DROPPED_ROLES
            main |= value.strip().lower() in ("main", "article")
        elif name == "itemprop":
            main |= value.strip().lower() == "articlebody"
            dropped |= value.strip().lower() == "comment"
        else:
            for one in value.split():
                parts = [p.lower() for p in _NAME_PARTS.findall(one) if tag != "form" or p.lower() != "form"]
                if _OTHERWISE.isdisjoint(parts):
                    dropped |= not _DROPPED_NAMES.isdisjoint(parts)
                    main |= "".join(parts) in _MAIN_NAMES or (len(parts) > 1 and parts[0] in ("article", "post", "entry", "story") and parts[-1] in ("body", "content", "text"))
                    dropped |= parts[-2:] == ["site", "header"] or parts[-2:] == ["page", "header"] or parts == ["header"] or parts == ["top", "bar"] or parts == ["side", "bar"]
    if main and tag in ("article", "main") and not any(x in rest.lower() for x in ("comment", "kommentar", "comentario", "advert", "sponsor", "promo")):
        dropped = False
    return dropped, main and not dropped


def blocks_of(html: str) -> list[Block]:
    """Blocks of text in page order: what stands between two tags that are not inline, references decoded, white space as one space."""
    out: list[Block] = []
    # Open elements: (tag, no main text, inside an article, heading level, is a form that only holds a page).
    stack: list[tuple[str, bool, bool, int]] = []
    open_tags: dict[str, int] = {}
    pieces: list[tuple[str, bool]] = []
    links = breaks = 0
    form = 0

    def close() -> None:
        nonlocal breaks
        breaks = 0
        if pieces:
            text = " ".join("".join(p for p, _ in pieces).split())
            if text:
                linked = sum(len("".join(p.split())) for p, in_link in pieces if in_link)
                _, dropped, main, heading = stack[-1] if stack else ("", False, False, 0)
                out.append(Block(text, linked, heading, main, dropped or (form > 0 and not main)))
            pieces.clear()

    def pop(to: int) -> None:
        nonlocal links, form
        while len(stack) > to:
            tag = stack.pop()[0]
            open_tags[tag] -= 1
            links -= tag == "a"
            form -= tag == "form"

    def pop_nearest(tags: frozenset[str], until: frozenset[str]) -> None:
        if any(open_tags.get(t) for t in tags):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in tags:
                    pop(i)
                    return
                if stack[i][0] in until:
                    return

    def text(raw: str) -> None:
        nonlocal breaks
        if raw:
            if breaks >= 2 and not raw.isspace():
                close()
            if not raw.isspace():
                breaks = 0
            pieces.append((unescape(raw) if "&" in raw else raw, links > 0))

    at = 0
    for m in _TOKEN.finditer(html):
        text(html[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if tag is None:
            if m["raw"]:
                pieces.append((" ", False))
            continue
        tag, rest, ends = tag.lower(), m["rest"] or m["rest2"] or "", bool(m["end"] or m["end2"])
        if tag == "br":
            breaks += 1
            pieces.append((" ", False))
            continue
        if tag not in _INLINE:
            close()
        if ends:
            if open_tags.get(tag):
                i = len(stack) - 1
                while stack[i][0] != tag:
                    i -= 1
                pop(i)
            continue
        if tag in _ENDS_P:
            pop_nearest(frozenset(("p",)), frozenset(("button", "td", "th", "table", "object", "body", "div", "article", "section", "main", "aside", "li", "form")))
        if tag in _SAME:
            pop_nearest(*_SAME[tag])
        if tag == "body":
            pop_nearest(frozenset(("head",)), frozenset())
        if tag in _VOID:
            continue
        _, was_dropped, was_main, heading = stack[-1] if stack else ("", False, False, 0)
        dropped, main = _kind(tag, rest)
        if tag == "header" and not was_main:
            dropped = True
        level = int(tag[1]) if tag in _HEADINGS else heading
        if rest.endswith("/") and tag not in _INLINE and tag not in _ENDS_P and tag not in ("html", "body", "head"):
            continue
        stack.append((tag, was_dropped or dropped, was_main or main, level))
        open_tags[tag] = open_tags.get(tag, 0) + 1
        links += tag == "a"
        form += tag == "form"
    text(html[at:])
    close()
    return out


def _stop_share(text: str) -> tuple[int, int]:
    words = re.findall(r"[^\W\d_]+", text.lower())
    return sum(map(ALL_STOP_WORDS.__contains__, words)), len(words)


def label(blocks: list[Block]) -> list[bool]:
    """Which blocks are main text.

    Pass 1 decides what is sure. Blocks in menus, headers, footers, sidebars,
    adverts, forms and comments, blocks of links, and notices are none. A long
    block, or one dense in stop words, is text; a long block sparse in them is
    none, unless the page is in a language without a list or the block is in the
    article. Where an article is marked and has text, blocks outside it are none.
    Pass 2 gives the short and doubtful blocks the label of the nearest decided
    block before or after, on the same side of the article's border; of two as
    near the text one counts. Without such a neighbour the article's blocks are
    text and others are not.
    """
    n = len(blocks)
    shares = [(0, 0) if b.dropped else _stop_share(b.text) for b in blocks]
    hits, words = sum(h for h, _ in shares), sum(w for _, w in shares)
    listed = hits >= KNOWN * words
    verdict: list[bool | None] = [None] * n
    comments = 0  # heading level of the title above reader comments
    for i, (b, (hit, count)) in enumerate(zip(blocks, shares, strict=True)):
        size, share = len(b.text), hit / count if count else 0.0
        if b.heading and comments and b.heading <= comments:
            comments = 0
        if b.dropped:
            verdict[i] = False
            continue
        if (b.heading or size <= 40) and _COMMENTS_TITLE.fullmatch(b.text) and any(verdict):
            comments = b.heading or 6
        if comments:
            verdict[i] = False
        elif b.links > LINKED * len(b.text.replace(" ", "")) and not (b.heading and b.main):
            verdict[i] = False
        elif b.heading:
            verdict[i] = None
        elif size < LONG and not b.main and _NOTICE.search(b.text):
            verdict[i] = False
        elif size < SHORT:
            verdict[i] = None
        elif share >= DENSE or (not listed and size >= LONG):
            verdict[i] = True
        elif share < SPARSE and listed and not b.main:
            verdict[i] = False
        elif size >= LONG and share >= SPARSE:
            verdict[i] = True
    whole = any(b.main and not b.dropped for b in blocks)
    if whole and not any(v and b.main for v, b in zip(verdict, blocks, strict=True)):
        whole = not any(verdict)  # what is marked as article is empty or only short lines, while there is prose elsewhere
    if whole:
        verdict = [v if b.main else False for v, b in zip(verdict, blocks, strict=True)]
    # Structure says nothing about the blocks beside it, so dropped blocks are no neighbours.
    decided = [i for i, v in enumerate(verdict) if v is not None and not blocks[i].dropped]
    out, k = [], 0
    for i, v in enumerate(verdict):
        if v is not None:
            out.append(v)
            continue
        while k < len(decided) and decided[k] < i:
            k += 1
        near = [(abs(j - i), not verdict[j]) for j in decided[max(k - 1, 0) : k + 1] if blocks[j].main == blocks[i].main or not whole]
        out.append(not min(near)[1] if near else whole and blocks[i].main)
    return out


def main_text(html: str | None) -> tuple[str, int, int]:
    """(text, blocks, blocks that are text) of a page."""
    if not html:
        return "", 0, 0
    blocks = blocks_of(html)
    keep = label(blocks)
    return "\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k), len(blocks), sum(keep)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """The columns of ``pages`` plus ``_main``: text, n_chars, n_blocks, n_kept, in the place of one that it has.

    ``text`` are the blocks of the article in page order, one to a line: menus,
    headers, footers, sidebars, notices, adverts, forms, scripts, styles and
    reader comments are left out, character references decoded, white space inside
    a block one space. A null or empty page has the empty text, as has one without
    prose; broken markup is read as far as it goes; repeated rows get equal
    results. A page is judged whole, whatever its length, and needs no other row.
    """

    @F.pandas_udf("text string, n_blocks int, n_kept int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for htmls in batches:
            yield pd.DataFrame([main_text(h) for h in htmls], columns=["text", "n_blocks", "n_kept"])

    kept = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c != "_main"])
    rows = packed(kept, html_col).select("_row", run(F.col(f"`{html_col}`")).alias("_found"))
    found = F.struct(F.col("_found.text").alias("text"), F.length("_found.text").cast("long").alias("n_chars"), F.col("_found.n_blocks").alias("n_blocks"), F.col("_found.n_kept").alias("n_kept"))
    return rows.select("_row.*", found.alias("_main"))


def query(pages: DataFrame) -> DataFrame:
    found = extract(view(pages, page_id="page_id", url="url", html="html"))
    return found.select("page_id", "url", "_main.text", "_main.n_chars")
