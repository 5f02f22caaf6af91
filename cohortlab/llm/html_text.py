"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags.  First pass: blocks in menus, headers, footers,
forms, adverts, notices, sidebars and reader comments (by element, role, class or id) are
boilerplate; so are blocks that consist mostly of links.  Long blocks are content with a normal
density of function words, and in an article (or main) element with any, as on pages without any such block
(in a language whose words aren't listed).  All others - headings,
short paragraphs, lists, text without function words - are ambiguous.  Second pass: an ambiguous block takes the label of the
nearest decided block of its section (the article, or the rest of the page); ties go to content.
In an article without any decided content its ambiguous blocks are
content; a page without such an element is judged as one section.

A wrapper's name doesn't make an article boilerplate: main elements start anew whatever holds them, and
articles do unless the page has others in fewer boilerplate elements (an article among reader comments,
related or side matter also yields to long content elsewhere).  Forms that hold all of a page's long content
are no boilerplate.  Body and html elements are never boilerplate or hidden;
others are hidden by attribute, class or style.
"""

from __future__ import annotations

import html as html_entities
import re
from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from cohortlab.llm.common import column, map_frames, small_batches
from cohortlab.llm.quality import STOP_WORDS

#: An attribute: quotes delimit only a value that they open (``x=it's`` ends at a space or ``>``).
ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+")
ATTRIBUTES = r"(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+)*+"
TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)({ATTRIBUTES})(?:>|\Z)", re.DOTALL)
#: Styles that hide an element.
UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.IGNORECASE)
#: Classes that show an element at some screen widths ("hidden md:block").
SHOWN = re.compile(r"[a-z0-9]+:(?:block|flex|grid|inline|table|contents|visible)")

# Element names.
BLOCK = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset
    h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td
    tfoot th thead title tr ul""".split()
)
DROPPED = frozenset("script style noscript template svg math iframe object embed applet canvas audio video head title select textarea button".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILER = frozenset("nav header footer aside form menu dialog".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that end an open paragraph.
ENDS_P = BLOCK - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: Words of class, id and role values that name boilerplate.
BOILER_WORDS = frozenset(
    """ad ads advert adverts advertisement advertisements advertising adbox adsense sponsor sponsored promo promotion banner cookie cookies consent
    gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup paywall sidebar sidebars aside rail widget widgets menu
    menus nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar pagination pager share sharing social related
    recommended recommendations comment comments commentlist disqus replies reply discussion respond login search searchbox copyright skip
    complementary contentinfo form""".split()
)
#: Whole names of more than one word that name boilerplate (others do if all of their words are in BOILER_WORDS).
BOILER_NAMES = frozenset(
    """site-header site-footer site-nav site-navigation site-menu page-footer main-nav main-navigation main-menu main-sidebar primary-nav
    primary-navigation primary-menu primary-sidebar secondary-sidebar related-posts related-articles related-links related-content related-stories
    share-buttons share-links share-bar social-links social-media social-share social-icons social-buttons comment-list comment-form comment-section
    comments-area comments-section comments-list comment-body cookie-bar nav-bar nav-links side-bar search-form search-box login-form signup-form
    newsletter-form newsletter-signup contact-form ad-container ad-slot ad-unit ad-wrapper ad-block ad-box skip-link skip-links""".split()
)
#: Words that name boilerplate also in a compound with words of place and kind only (user-comments, inline-ad).
COMPOUND_WORDS = frozenset(
    """ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored promo newsletter cookie cookies breadcrumb
    breadcrumbs pagination comment comments commentlist""".split()
)
PLACE_WORDS = frozenset(
    """user users reader readers visitor post article page site blog story inline box block wrap wrapper container section list item items area
    unit slot inner outer holder panel thread body text content count top bottom left right center middle side desktop mobile""".split()
)
#: Elements and words of matter that may hold article elements of its own (one for each comment or teaser).
COMPANION = frozenset("nav footer aside menu dialog".split())
COMPANION_WORDS = frozenset("comment comments commentlist disqus replies reply discussion respond related recommended recommendations".split())
MAIN_NAMES = frozenset(("main", "main-content", "maincontent", "content-main"))


@dataclass(frozen=True)
class BlockRules:
    long_chars: int = 80
    link_density: float = 0.5
    stop_density: float = 0.15


@dataclass
class Block:
    text: str
    links: int
    boiler: bool
    section: int
    #: Boilerplate elements around the article that holds the block.
    outer: int = 0
    #: Some of them are comments, related or side matter.
    companion: bool = False
    #: Within a form, but in no other boilerplate.
    form: bool = False


def _names(attributes: str) -> tuple[set[str], bool, bool]:
    """Class, id and role names (lower case, words joined by hyphens), whether the element is hidden, whether its role is main."""
    out: set[str] = set()
    hidden = main = False
    for m in ATTRIBUTE.finditer(attributes):
        key = m[1].lower()
        if key == "hidden":
            hidden = True
        elif key == "style" and m[2]:
            hidden = hidden or bool(UNSEEN.search(m[2].strip("\"'")))
        elif key in ("class", "id", "role") and m[2]:
            found = m[2].strip("\"'").split()
            if key == "class" and "hidden" in found and not any(map(SHOWN.fullmatch, found)):
                hidden = True
            main = main or key == "role" and "main" in map(str.lower, found)
            for x in found:
                out.add("-".join(w for w in re.split(r"[-_]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", x).lower()) if w))
    return out, hidden, main


def _boiler_words(names: set[str]) -> set[str]:
    """The words of the names that name boilerplate as a whole."""
    out: set[str] = set()
    for name in names:
        words = set(name.split("-"))
        if name in BOILER_NAMES or words <= BOILER_WORDS or words & COMPOUND_WORDS and words <= COMPOUND_WORDS | PLACE_WORDS:
            out |= words
    return out - {""}


def blocks_of(page: str) -> list[Block]:
    """Blocks in page order with their links' characters, whether a boilerplate element holds them, and their section.

    Section 0 is the page outside any article or main element.  Unclosed and misnested tags are
    tolerated: an end tag closes the nearest open element of its name, if there is one.
    """
    out: list[Block] = []
    stack: list[tuple[str, str]] = []  # (name, kind): kind d dropped, b boilerplate, f form, m main, a link, or plain
    open_names: Counter[str] = Counter()
    parts: list[str] = []
    counts = {"drop": 0, "boiler": 0, "companion": 0, "form": 0, "main": 0, "link": 0}
    links, sections = 0, 0
    kinds = {"d": ("drop",), "b": ("boiler",), "c": ("boiler", "companion"), "f": ("form",), "m": ("main",), "a": ("link",)}
    section_stack = [0]
    around: list[tuple[int, int, int, int, bool]] = []  # at each open article: counts outside it, and what it says of them

    def flush() -> None:
        nonlocal links
        text = " ".join(html_entities.unescape("".join(parts)).split())
        if text:
            outer, companion = around[-1][3:] if around else (0, False)
            out.append(Block(text, links, counts["boiler"] > 0, section_stack[-1], outer, companion, counts["form"] > 0))
        parts.clear()
        links = 0

    def close(index: int) -> None:
        while len(stack) > index:
            name, kind = stack.pop()
            open_names[name] -= 1
            for c in kinds.get(kind, ()):
                counts[c] -= 1
            if kind == "m":
                section_stack.pop()
                counts["boiler"], counts["companion"], counts["form"] = around.pop()[:3]

    def add(text: str) -> None:
        nonlocal links
        if counts["drop"] or not text:
            return
        parts.append(text)
        if counts["link"]:
            links += len(" ".join(text.split()))

    at, size = 0, len(page)
    while at < size:
        m = TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>"))
            continue
        name = m[2].lower()
        if m[1]:  # an end tag
            if not open_names[name]:
                continue
            if name in BLOCK:
                flush()
            close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
            continue
        if name in BLOCK:
            flush()
            if name in ENDS_P and open_names["p"]:  # inline elements opened in the paragraph end with it
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p":
                        close(i)
                        break
                    if stack[i][0] in BLOCK:
                        break
            if name in ("li", "dt", "dd", "td", "th", "tr", "option") and stack and stack[-1][0] == name:
                close(len(stack) - 1)
        elif name == "br":
            add(" ")
        if name in VOID or m[3].rstrip().endswith("/"):
            continue
        names, hidden, main_role = _names(m[3]) if m[3] else (set(), False, False)
        if name in RAW:  # its content isn't markup: skip to its end tag
            end = re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else size
            continue
        kind = "p"
        in_main = counts["main"] > 0
        words = _boiler_words(names) if names else names
        main = name == "main" or main_role
        if name in ("body", "html"):
            kind = "p"
        elif name in DROPPED or hidden:
            kind = "d"
        elif name == "header" and in_main:
            kind = "p"  # an article's own heading
        elif main or name == "article" or name == "div" and names & MAIN_NAMES:
            kind = "m"
        elif name == "form":
            kind = "f"
        elif name in BOILER or words and not names & (MAIN_NAMES | {"article"}):
            kind = "c" if name in COMPANION or words & COMPANION_WORDS else "b"
        elif name == "a":
            kind = "a"
        for c in kinds.get(kind, ()):
            counts[c] += 1
        if kind == "m":
            if not in_main:
                sections += 1
            section_stack.append(sections if not in_main else section_stack[-1])
            # boilerplate outside is noted, not inherited; an article of a boilerplate name is as one within such an element
            outer, companion = (0, False) if main or not around else around[-1][3:]
            if not main:
                outer += counts["boiler"] + bool(words)
                companion = companion or counts["companion"] > 0 or bool(words & COMPANION_WORDS)
            around.append((counts["boiler"], counts["companion"], counts["form"], outer, companion))
            counts.update(boiler=0, companion=0, form=0)
        stack.append((name, kind))
        open_names[name] += 1
    flush()
    return out


def classify(blocks: list[Block], rules: BlockRules = BlockRules()) -> list[bool]:
    """True for content blocks, by the two passes."""
    long_text, dense = [], []
    for b in blocks:
        words = b.text.lower().split()
        stop = sum(w.strip(".,;:!?") in STOP_WORDS for w in words) / len(words)
        long_text.append(len(b.text) >= rules.long_chars and b.links <= rules.link_density * len(b.text))
        dense.append(b.section > 0 or stop >= rules.stop_density)
    if any(x and y and not b.boiler for x, y, b in zip(long_text, dense, blocks, strict=True)):
        long_text = [x and y for x, y in zip(long_text, dense, strict=True)]
    boiler = [b.boiler for b in blocks]
    inner = [(not x, b.outer) for x, b in zip(long_text, blocks, strict=True) if b.section and not b.boiler]
    least = min(inner, default=(False, 0))[1]
    rest = any(x and not b.boiler and not b.section for x, b in zip(long_text, blocks, strict=True))
    for i, b in enumerate(blocks):
        if b.section and (b.outer > least or b.companion and rest):
            boiler[i] = True
    for section in {b.section for b in blocks if b.form}:
        found = {b.form for x, y, b in zip(long_text, boiler, blocks, strict=True) if b.section == section and x and not y}
        if found != {True}:  # the form doesn't hold all of the long content
            boiler = [x or b.form and b.section == section for x, b in zip(boiler, blocks, strict=True)]
    first: list[bool | None] = []
    for b, is_boiler, is_long in zip(blocks, boiler, long_text, strict=True):
        if is_boiler or b.links > rules.link_density * len(b.text):
            first.append(False)
        elif is_long:
            first.append(True)
        else:
            first.append(None)
    has_main = any(b.section and not x for x, b in zip(boiler, blocks, strict=True))
    if has_main:  # what an article or main element doesn't hold isn't the article
        first = [x if b.section else False for x, b in zip(first, blocks, strict=True)]
    out = [bool(x) for x in first]
    by_section: dict[int, list[int]] = {}
    for i, b in enumerate(blocks):
        by_section.setdefault(b.section, []).append(i)
    for section, members in by_section.items():
        good = [k for k, i in enumerate(members) if first[i] is True]
        bad = [k for k, i in enumerate(members) if first[i] is False and not (section and boiler[i])]
        for k, i in enumerate(members):
            if first[i] is not None:
                continue
            if section and not good:
                out[i] = True
                continue
            near = min((abs(k - g) for g in good), default=None)
            far = min((abs(k - g) for g in bad), default=None)
            out[i] = near is not None and (far is None or near <= far)
    return out


def main_text(page: str | None, rules: BlockRules = BlockRules()) -> str:
    """The content blocks of a page joined by line breaks; empty for null, empty and text-free pages."""
    if not page:
        return ""
    blocks = blocks_of(page)
    return "\n".join(b.text for b, good in zip(blocks, classify(blocks, rules), strict=True) if good)


def extract(pages: DataFrame, rules: BlockRules = BlockRules()) -> DataFrame:
    """Per row: page_id, url, text, n_chars (code points).

    Null and empty html give an empty text; null ids and urls and repeated rows pass through;
    other columns are ignored; an empty table gives an empty result.
    """
    small_batches(pages.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = [main_text(h, rules) for h in pdf["html"]]
        return pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    cols = (column("page_id").cast("long").alias("page_id"), column("url").alias("url"), column("html").alias("html"))
    return map_frames(pages.select(*cols), run, "page_id long, url string, text string, n_chars long")
