"""Main text of web pages by tag-path ratios.

Each block of text has a path of tags from the root. Per path, text length and punctuation are aggregated and divided by
the number of its blocks; the two series over the page's blocks are smoothed by a Gaussian, fused by multiplication
and thresholded. The paths that pass name the content; article or main elements that hold most of what they select, or else
the deepest container that holds nearly all of it, are the article: its blocks, and all others of these paths, are the text. Elements that cannot be the article (menus, forms, scripts, adverts, comments, by
tag, role, class or id) take no part.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Fixed lists: elements whose content is no mark-up, whose content is no text, that may stand in head, that end an svg or
#: math left open and the elements of these that hold HTML, that are never part of the article, that don't break a block, that
#: have no content, and what an opening tag closes.
RAW = "script style"
SKIPPED = set("noscript template textarea title svg math iframe object canvas audio video head".split())
HEAD = set("title meta link base basefont bgsound script style noscript template".split())
BREAKOUT = set("b big blockquote br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 hr i img li listing menu nobr ol p pre ruby s small span strong strike sub sup table tt u ul var article main section header footer nav aside".split())
HTML_INSIDE = {"foreignobject", "desc", "title", "annotation-xml"}
NEVER = set("nav footer aside form button select option menu dialog datalist label fieldset dir".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Words in class, id or role that mark what surrounds an article.
MARKS = set(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner banners sponsor sponsored promo promotion promoted comment comments commentlist respond reply replies discussion disqus "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup sidebar side widget widgets related recommended recommendations share sharing social "
    "nav navbar navigation menu menus breadcrumb breadcrumbs footer masthead topbar toolbar login search pagination pager copyright complementary contentinfo hidden".split()
)
#: Words that beside marks leave a class or id a mark as a whole (ad-container), and ids that are as well the anchor of a
#: section of an article (discussion).
NEUTRAL = set("list box container area section block inner site wrap wrapper item items links bar header primary secondary left right top bottom".split())
ANCHORS = set("consent notice notices discussion related recommended recommendations share sharing social search login promotion side notification alert copyright subscription hidden".split())
#: Share of a page's text whose holder is not set apart by a mark.
HOLDS = 0.8
#: Share of the largest fused ratio that a path needs; share of link text at which a block is a menu.
THRESHOLD, MOST_LINKS = 0.1, 0.7
SIGMA = 1.0
#: What an article is by tag; blocks of an article; elements that are no container of one; share of the chosen text that
#: its container holds.
ARTICLES = ("article", "main")
TEXTS = set("h1 h2 h3 h4 p li blockquote pre td th dd dt".split())
PARTS = TEXTS | set("h5 h6 ul ol dl table thead tbody tfoot tr caption figure figcaption".split())
NEARLY = 0.95
NONE, WEAK, STRONG, GONE = range(4)
_RAW = "|".join(RAW.split())
_TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)|<({_RAW})\b(?:[^>"']|"[^"]*"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^<]*\Z""", re.S | re.I)
_MARK = re.compile(r"""\b(class|id|role|aria-hidden|hidden|style)\b\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_CLOSED = re.compile(r"""(?:^|[\s"'])/\s*\Z""")
_PUNCT = re.compile(r"[.,;:!?…。，、]")
_WORDS = re.compile(r"[a-z]+")


def _marked(tag: str, attrs: str) -> tuple[int, str]:
    """How attributes mark an element (NONE, WEAK: a word of a class or id; STRONG: a whole one; GONE: it isn't shown),
    and its class as part of the path."""
    how, label = NONE, ""
    for m in _MARK.finditer(attrs):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id", "role"):
            label += "." + value if key == "class" else ""
            if key == "id" and tag in TEXTS:  # an anchor
                continue
            for token in value.split():
                words = set(_WORDS.findall(token))
                if marks := words & MARKS:
                    whole = words <= MARKS | NEUTRAL and not (key == "id" and marks <= ANCHORS)
                    how = max(how, STRONG if whole else WEAK)
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            how = GONE
    return how, label


def blocks(page: str) -> tuple[list[tuple[tuple[str, ...], str, float, tuple[int, ...]]], dict[int, int], set[int]]:
    """(path, text, share of link text, numbers of the marked elements around it) of each block of text that may be in
    the article, in page order; the marked elements, weak or strong; and those of them that hold an article or main
    element of no mark."""
    found: list[tuple[tuple[str, ...], str, float, tuple[int, ...]]] = []
    stack: list[tuple[str, str, bool, tuple[int, ...]]] = []  # tag, label, whether it or what holds it is outside the article, marked elements
    marked: dict[int, int] = {}
    holders: list[tuple[int, ...]] = []
    parts: list[str] = []
    skip: list[str] = []  # open elements from one whose content is no text
    linked, in_link, at = 0, 0, 0

    def read(piece: str) -> None:
        nonlocal linked
        if skip == ["head"] and piece.strip():
            skip.clear()
        if not skip:
            parts.append(piece)
            linked += len(piece) if in_link else 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html_lib.unescape("".join(parts)).split())
            if text and not (stack and stack[-1][2]):
                found.append((tuple(s[1] for s in stack), text, linked / max(1, len(text)), stack[-1][3] if stack else ()))
            parts.clear()
        linked = 0

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            read(page[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if skip:
            if m[2] and tag in skip:
                while skip.pop() != tag:
                    pass
                continue
            if m[2]:
                ends = any(s[0] == tag for s in stack)
            else:
                ends = tag == "body" or skip == ["head"] and tag not in HEAD or skip[0] in ("svg", "math") and tag in BREAKOUT and HTML_INSIDE.isdisjoint(skip)
            if not ends:
                if not m[2] and tag not in VOID and not _CLOSED.search(m[4]):
                    skip.append(tag)
                continue
            skip.clear()
        if tag in SKIPPED:
            if not m[2] and not (tag in ("svg", "math", "iframe") and _CLOSED.search(m[4])):
                skip.append(tag)
            continue
        if tag == "br":
            parts.append(" ")
        elif tag in INLINE:
            if tag == "a":
                in_link = max(0, in_link + (-1 if m[2] else 1)) if m[2] else 1
        elif m[2]:
            if any(s[0] == tag for s in stack):
                flush()
                while stack.pop()[0] != tag:
                    pass
            in_link = 0
        else:
            flush()
            if tag in VOID:
                continue
            in_link = 0
            if stack and stack[-1][0] == "p":
                stack.pop()
            elif tag in CLOSES and stack and stack[-1][0] in CLOSES[tag]:
                stack.pop()
            how, label = _marked(tag, m[4]) if m[4].strip() else (NONE, "")
            inside = any(s[0] in ARTICLES for s in stack)
            out, around = stack[-1][2:] if stack else (False, ())
            if tag in ARTICLES and how < STRONG and not out:
                holders.append(around)
            if tag in ("html", "body", *ARTICLES):  # themes put state words into these
                how = NONE
            out |= tag in NEVER or tag == "header" and not inside or how == GONE
            if how in (WEAK, STRONG):
                marked[len(marked)] = how
                around = (*around, len(marked) - 1)
            stack.append((tag, tag + label, out, around))
    if at < len(page):
        read(page[at:])
    flush()
    # a mark that all articles by tag stand in sets none of them apart
    return found, marked, set(holders[0]).intersection(*holders) if holders else set()


def _smooth(x: np.ndarray) -> np.ndarray:
    k = np.exp(-0.5 * (np.arange(-2, 3) / SIGMA) ** 2)
    full = np.convolve(x, k, "full")[2:-2] if len(x) > 1 else x * k[2]
    norm = np.convolve(np.ones(len(x)), k, "full")[2:-2] if len(x) > 1 else k[2:3]
    return full / norm


def _tag(path: tuple[str, ...]) -> str:
    return path[-1].split(".")[0]


def extract(page: str | None) -> str:
    """Main text of a page: references decoded, white space in a block as one space, blocks joined by one space."""
    everything, marked, holds = blocks(page or "")
    if marked:
        # a strong mark counts unless its element holds the article
        inside: dict[int, int] = defaultdict(int)
        for _, t, links, around in everything:
            for e in around:
                inside[e] += len(t) if links <= MOST_LINKS else 0
        total = sum(len(t) for _, t, links, _ in everything if links <= MOST_LINKS)
        strong = {e for e, how in marked.items() if how == STRONG and e not in holds and inside[e] < HOLDS * total}
        everything = [b for b in everything if strong.isdisjoint(b[3])]
    found = [b for b in everything if b[2] <= MOST_LINKS]
    if not found:
        return ""
    number: dict[tuple[str, ...], int] = {}
    of = np.array([number.setdefault(p, len(number)) for p, _, _, _ in found])
    chars = np.array([len(t) for _, t, _, _ in found], float)
    points = np.array([len(_PUNCT.findall(t)) for _, t, _, _ in found], float)
    n = np.bincount(of)
    ratio, dots = np.bincount(of, chars) / n, np.bincount(of, points) / n
    fused = _smooth(ratio[of]) * (_smooth(dots[of]) + 0.1)
    score = np.bincount(of, fused) / n
    chosen = score >= THRESHOLD * score.max()
    # outside the container a path must pass by itself, not by rich neighbours
    own = ratio * (dots + 0.1)
    alone = chosen & (own >= THRESHOLD * own.max())
    paths = list(number)
    # articles by tag, if they hold most of the chosen text; else the deepest container that holds nearly all of it
    weight: dict[tuple[str, ...], float] = defaultdict(float)
    for k, p in enumerate(paths):
        if chosen[k]:
            for d in range(1, len(p) + 1):
                weight[p[:d]] += float(chars[of == k].sum())
    whole = sum(float(chars[of == k].sum()) for k in range(len(paths)) if chosen[k])
    tops = [p for p in weight if _tag(p) in ARTICLES and not any(_tag(p[:d]) in ARTICLES for d in range(1, len(p)))]
    semantic = sum(weight[p] for p in tops) >= 0.5 * whole and bool(tops)
    if semantic:
        root = max(tops, key=lambda p: weight[p])
        inside = max((p for p in weight if p[: len(root)] == root and _tag(p) == "article" and weight[p] >= 0.5 * whole), key=lambda p: weight[p], default=root)
        root = inside if weight[inside] >= NEARLY * weight[root] else root
    else:
        root = max((p for p, w in weight.items() if w >= NEARLY * whole and _tag(p) not in PARTS), key=len, default=())
    # of weak marks, only elements without any block of a passing path are set apart
    rich = {e for (_, _, _, around), k in zip(found, of, strict=True) if alone[k] for e in around}
    contained = semantic or bool(root) and _tag(root) not in ("html", "body")
    keep = []
    for p, t, links, around in everything:
        within = p[: len(root)] == root
        if links > MOST_LINKS and not (within and contained):
            continue
        passes = p in number and alone[number[p]]
        if within and (semantic or p in number and chosen[number[p]] or _tag(p) in TEXTS):
            if passes or all(e in rich or e in holds for e in around):
                keep.append(t)
        elif passes and (not semantic or any(p[: len(x)] == x for x in tops)):
            keep.append(t)
    return " ".join(keep)


def _extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [extract(v.as_py()) for v in b.column(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages(page_id, url, html): the whole page is read; null and empty
    pages, and pages without an article, have the text ''. Repeated rows each give a row; other columns are ignored."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(_extract_batches, "page_id long, url string, text string, n_chars long")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
