"""Main text of HTML pages: flat text blocks, classified by a small decision tree.

A page is cut into flat blocks at block-level tags. A block is described by its word count and link density, those of the
blocks before and after it, its box's share of the page's words (a box is the nearest div, section or the like), and by
what its open elements say (main or boilerplate container, words of classes, heading, list item). A decision tree, trained
here on blocks of a small table of labelled pages, says which blocks are article text: its first levels split on words and
links only, so that pages without telling markup are read too, and markup refines them further down.

Each page is handled alone, in a scalar pandas UDF: no shuffle, and memory for a batch of pages. Parsing is linear in
the page's length whatever its markup; attributes are read whole.

Defined results: null or empty html gives empty text; unclosed elements end with the page; a tag, comment or script cut
off by the page's end is dropped, and after a quote in a tag that never ends tags end at the next >; unknown tags are
inline; repeated page_ids give a row each; null urls stay null.
"""

from __future__ import annotations

import html as _html
import random
import re
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import table

BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody tfoot thead tr ul".split()
)
SPACE = frozenset("br td th img wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
SKIP = frozenset("head noscript template svg math object canvas audio video select button datalist".split())
MAIN_TAGS = frozenset("article main".split())
BOILER_TAGS = frozenset("nav aside footer form menu dialog".split())
BOXES = frozenset("article aside body dialog div footer form header main nav section td".split())
#: Words of class and id that name boilerplate.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted banner banners"
    " nav navbar navigation menu menus submenu breadcrumb breadcrumbs pagination pager topbar toolbar masthead header footer colophon copyright"
    " sidebar sidebars aside widget widgets related recommended recommendations trending"
    " notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup paywall disclaimer"
    " comment comments commentlist disqus reply replies"
    " share sharing social search login noprint".split()
)
#: Words that beside one of these leave its meaning as it is; any other word ("share-price") makes it doubtful.
PLAIN = frozenset("site page main top bottom left right upper lower box block wrapper wrap container area section list item items inner outer global primary secondary bar links text body user reader the js".split())
CONTENT_HINTS = frozenset("articlebody postbody entrycontent postcontent articlecontent maincontent storybody".split())
_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTRS = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_NAMED = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Open elements that a start tag of the kind on the left ends.
_ENDS = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr",)}
FEATURES = (
    "words", "link_density", "before_words", "before_link_density", "after_words", "after_link_density", "box_share",
    "in_main", "in_boiler", "hint", "page_has_main", "heading", "list_item", "sentence",
)
TEXT_FEATURES = 6  # the first of them, which the first levels of the tree split on


def _hint(value: str) -> float:
    """1 where a class or id names boilerplate, a half where it may."""
    best = 0.0
    for one in value.split():
        words = [x.lower() for x in _PART.findall(one)]
        if any(x in HINTS for x in words):
            best = max(best, 1.0 if all(x in HINTS or x in PLAIN or x.isdigit() for x in words) else 0.5)
    return best


def _kind(tag: str, attrs: str) -> tuple[bool, bool, float]:
    """(main, boilerplate, hint) of a start tag."""
    main, boiler, hint = tag in MAIN_TAGS, tag in BOILER_TAGS or tag == "header", 0.0
    for name, value in _NAMED.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            boiler = True
        elif name == "role":
            main |= value.lower() in ("main", "article")
            boiler |= value.lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog")
        elif name in ("class", "id", "itemprop"):
            if tag not in ("html", "body", "main"):
                hint = max(hint, _hint(value))
            main |= any("".join(x.lower() for x in _PART.findall(one)) in CONTENT_HINTS for one in value.split())
    return main, boiler, hint


_short_kind = lru_cache(4096)(_kind)
_TELLS = re.compile(r"(?i)class|id|role|style|itemprop")


def _of_tag(tag: str, attrs: str) -> tuple[bool, bool, float]:
    if not attrs or tag == "a" or not _TELLS.search(attrs):
        return _short_kind(tag, "")
    return (_short_kind if len(attrs) <= 200 else _kind)(tag, attrs)  # long ones aren't kept


def blocks(page: str | None) -> list[tuple[str, list[float]]]:
    """(text, features) of a page's flat text blocks, in page order."""
    page = page or ""
    found: list[list] = []  # text, words, linked words, main, boiler, hint, heading, list item, box
    stack: list[tuple[str, bool, bool, float, int]] = []  # tag, main, boiler, hint, box
    text: list[str] = []
    linked = boxes = 0
    at, end, quoted, has_main = 0, len(page), True, False

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            raw = _html.unescape(raw) if "&" in raw else raw
            text.append(raw)
            if any(x[0] == "a" for x in stack):
                linked += len(raw.split())

    def flush() -> None:
        nonlocal linked
        if text:
            words = "".join(text).split()
            if words:
                tags = {x[0] for x in stack}
                found.append([
                    " ".join(words), len(words), linked, any(x[1] for x in stack), any(x[2] for x in stack), max((x[3] for x in stack), default=0.0),
                    bool(tags & {"h1", "h2", "h3", "h4", "h5", "h6"}), "li" in tags, stack[-1][4] if stack else 0,
                ])
            text.clear()
        linked = 0

    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        add(page[at:lt])
        if page.startswith("<!--", lt):
            stop = page.find("-->", lt + 4)
            at = end if stop < 0 else stop + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            stop = page.find(">", lt)
            at = end if stop < 0 else stop + 1
            continue
        m = _OPEN.match(page, lt)
        if not m:
            add("<")
            at = lt + 1
            continue
        close = _ATTRS.match(page, m.end()) if quoted else None
        if close is None:
            stop = page.find(">", m.end())
            quoted = False  # a quote is open to the end: from here on tags end at the next >
            if stop < 0:
                break
            stop += 1
        else:
            stop = close.end()
        attrs, tag, at = page[m.end() : stop - 1], m[2].lower(), stop
        if m[1]:
            if tag in BLOCK:
                flush()
            elif tag in SPACE:
                text.append(" ")
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
                if tag not in BLOCK and stack[i][0] in BLOCK:  # an inline end tag ends nothing outside its block
                    break
            continue
        if tag in BLOCK:
            flush()
        elif tag in SPACE:
            text.append(" ")
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            if stop is None:
                break
            at = stop.end()
            at = page.find(">", at) + 1 or end
            continue
        if tag in SKIP and not attrs.endswith("/"):
            stop = re.compile(rf"</{tag}(?=[\s/>])|<body(?=[\s>])" if tag == "head" else rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            if stop is None:
                if tag == "head":
                    continue
                break
            at = stop.start() if stop[0][1] != "/" else page.find(">", stop.end()) + 1 or end
            continue
        if tag in VOID or (attrs.endswith("/") and tag not in BLOCK):
            continue
        for kind in _ENDS.get(tag, ("p",) if tag in BLOCK else ()):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == kind:
                    del stack[i:]
                    break
                if stack[i][0] in BLOCK:
                    break
        main, boiler, hint = _of_tag(tag, attrs)
        if tag == "header" and any(x[0] in MAIN_TAGS for x in stack):
            boiler = False  # the head of an article, not of the page
        has_main |= main
        boxes += tag in BOXES
        stack.append((tag, main, boiler, hint, boxes if tag in BOXES else stack[-1][4] if stack else 0))
    flush()
    density = [x[2] / x[1] for x in found]
    own: dict[int, int] = {}
    for x in found:
        own[x[8]] = own.get(x[8], 0) + x[1] - x[2]
    total = max(sum(own.values()), 1)
    near = lambda i: min(found[i][1], 100)  # noqa: E731  more words tell no more
    out = []
    for i, x in enumerate(found):
        before, after = (near(i - 1), density[i - 1]) if i else (0, 0.0), (near(i + 1), density[i + 1]) if i + 1 < len(found) else (0, 0.0)
        out.append((x[0], [
            near(i), density[i], *before, *after, own[x[8]] / total,
            float(x[3]), float(x[4]), x[5], float(has_main), float(x[6]), float(x[7]), float(x[0][-1] in ".!?…:;\"'”»"),
        ]))
    return out


def labelled_pages(n: int = 3000, seed: int = 7) -> list[tuple[str, dict[str, int]]]:
    """A small labelled table: pages of many layouts made by rule, and for each block's text 1 (article) or 0.

    A third of the pages mark the article and what surrounds it, a third mark one of both, and a third have plain boxes.
    Some articles are a single paragraph, some boxes of an article have a class word that elsewhere names boilerplate,
    and comments, notices and adverts may be long.
    """
    rng = random.Random(seed)
    pool = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(5000)]
    made = []
    for number in range(n):
        labels: dict[str, int] = {}

        def words(k: int, label: int, stop: str = ".", labels=labels) -> str:
            while True:
                said = " ".join(rng.choices(pool, k=k)).capitalize() + stop
                if said not in labels:
                    labels[said] = label
                    return said

        around, inside = rng.choice([(True, True), (True, True), (True, False), (False, True), (False, False), (False, False), (False, False)])  # what says what it is
        links = lambda k: "".join(f'<li><a href="/{i}">{words(rng.randint(1, 3), 0, "")}</a></li>' for i in range(k))  # noqa: E731, B023

        def box(tag: str, hints: list[str], inner: str, around=around) -> str:
            if around and tag != "div" and rng.random() < 0.5:
                return f"<{tag}>{inner}</{tag}>"
            return f'<div {rng.choice(["class", "id"])}="{rng.choice(hints)}">{inner}</div>' if around else f"<div>{inner}</div>"

        short = rng.random() < 0.25  # an article of one paragraph
        parts = [f"<h1>{words(rng.randint(2, 12), 1, rng.choice(['', '.']))}</h1>"] if rng.random() < 0.85 else []
        far = rng.randint(120, 400)
        lengths = [1, 2, 4, 8, 15, 25, 40, 80, 120, far] if inside else [6, 12, 25, 40, 80, 120, far]
        small = inside and rng.random() < 0.3  # a marked article may be all short lines
        for _ in range(1 if short else rng.randint(2, 10)):
            k = max(1, round(rng.choice(lengths[:4] if small else lengths[-4:] if short else lengths) * rng.uniform(0.6, 1.6)))
            kind = 1.0 if short else rng.random()
            if kind < 0.1:
                parts.append(f"<h2>{words(rng.randint(1, 8), 1, '')}</h2><p>{words(rng.choice(lengths[-4:]), 1)}</p>")
            elif kind < 0.2:
                parts.append("<ul>" + "".join(f"<li>{words(rng.randint(8, 30), 1)}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.3 and inside:
                parts.append(f"<p>{words(k, 1, '')}</p>")
            elif kind < 0.4 and around and inside:
                parts.append(box("aside", ["ad", "related", "promo", "share"], f"<p>{words(rng.randint(3, 40), 0)}</p>"))
            elif kind < 0.45 and inside:
                parts.append(f'<p><a href="/x">{words(rng.randint(1, 6), 1)}</a></p>')
            elif kind < 0.55:
                name = rng.choice(["share-price", "ad-hoc", "menu-prices", "search-results", "cookie-recipes", "social-history", "login-tutorial", "comment-on-law"])
                tag = rng.choice(["div", "section"])
                parts.append(f'<{tag} {rng.choice(["class", "id"])}="{name}"><p>{words(max(k, 12), 1)}</p></{tag}>')
            elif kind < 0.62:
                name = rng.choice(["results", "discussion", "methods", "part-2", "quote", "figure"])
                tag = rng.choice(["div", "section"])
                parts.append(f'<{tag} {rng.choice(["class", "id"])}="{name}"><p>{words(max(k, 8), 1)}</p></{tag}>')
            else:
                parts.append(f"<p>{words(k, 1)}</p>")
        remark = lambda: words(max(1, round(rng.choice([2, 5, 9, 20, 45, 90]) * rng.uniform(0.6, 1.6))), 0)  # noqa: E731, B023
        if rng.random() < 0.4 and around and inside:
            parts.append(f'<section class="{rng.choice(["comments", "user-comments", "replies"])}"><p>{remark()}</p><div class="comment"><p>{remark()}</p></div></section>')
        body = "".join(parts)
        if inside:
            main = rng.choice(["article", "article", "main", 'div class="entry-content"'])
            body = f"<{main}>{body}</{main.split()[0]}>"
        else:
            body = rng.choice(["<div>{}</div>", '<div class="page">{}</div>', '<div id="c1">{}</div>', "{}", "<section>{}</section>"]).format(body)
        told = around or inside  # in plain boxes nothing tells a long notice from text
        say = lambda a, b: words(rng.choice([60, 120, 200, 400]) + rng.randint(0, 50) if told and rng.random() < 0.2 else rng.randint(a, b if told else min(b, 14)), 0)  # noqa: E731, B023
        top = [
            box("nav", ["menu", "main-nav", "navbar"], f"<ul>{links(rng.randint(3, 9))}</ul>"), box("header", ["masthead", "site-header"], f"<p>{words(rng.randint(1, 6), 0, '')}</p>"),
            box("div", ["ad", "advert", "sponsored"], say(3, 60)), box("div", ["cookie-notice", "consent", "newsletter"], f"<p>{say(5, 60)}</p>"),
        ]
        low = [
            box("aside", ["sidebar", "widget"], f"<p>{say(2, 20)}</p><ul>{links(rng.randint(2, 5))}</ul>"), f"<form><label>{words(2, 0, '')}</label><input name=q><p>{say(2, 15)}</p></form>",
            box("section", ["comments", "disqus", "replies"], "".join(f"<p>{say(2, 60)}</p>" for _ in range(rng.randint(1, 4))) if around else f"<p>{say(2, 60)}</p>"), box("footer", ["footer", "colophon"], say(2, 60)),
        ]
        top, low = ([x for x in part if rng.random() < often] for part, often in ((top, rng.choice([0.1, 0.4, 0.7, 0.9])), (low, rng.choice([0.1, 0.4, 0.7, 0.9]))))
        made.append((f"<html><head><title>x{number}</title></head><body>{''.join(top)}{body}{''.join(low)}</body></html>", labels))
    return made


def grow(x: np.ndarray, y: np.ndarray, depth: int = 10, least: int = 8, many: int = 150, text_levels: int = 3, level: int = 0):
    """A decision tree by Gini impurity: (feature, threshold, left where <=, right), or the share of ones at a leaf. The
    first `text_levels` levels split on TEXT_FEATURES only."""
    if level == depth or len(y) < 2 * least or y.min() == y.max():
        return float(y.mean())
    best = (1e-9, None, None)
    impurity = y.mean() * (1 - y.mean())
    few = many if level < text_levels else least  # what a length alone decides must hold for many blocks
    for j in range(TEXT_FEATURES if level < text_levels else x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        v, t = x[order, j], y[order]
        n = np.arange(1, len(t))
        ones = np.cumsum(t)[:-1]
        p, q = ones / n, (t.sum() - ones) / (len(t) - n)
        gain = impurity - (n * p * (1 - p) + (len(t) - n) * q * (1 - q)) / len(t)
        gain[(v[1:] == v[:-1]) | (n < few) | (len(t) - n < few)] = -1
        i = int(np.argmax(gain))
        if gain[i] > best[0]:
            best = (float(gain[i]), j, float((v[i] + v[i + 1]) / 2))
    if best[1] is None:
        return grow(x, y, depth, least, many, text_levels, text_levels) if level < text_levels else float(y.mean())
    left = x[:, best[1]] <= best[2]
    return (best[1], best[2], *(grow(x[part], y[part], depth, least, many, text_levels, level + 1) for part in (left, ~left)))


def classify(tree, features: list[float]) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if features[tree[0]] <= tree[1] else tree[3]
    return tree >= 0.5


@cache
def trained(n: int = 3000, seed: int = 7):
    """The tree for labelled_pages(n, seed); the same on every machine."""
    x, y = [], []
    for page, labels in labelled_pages(n, seed):
        for text, features in blocks(page):
            if text in labels:
                x.append(features)
                y.append(labels[text])
    return grow(np.array(x, dtype=float), np.array(y, dtype=float))


def main_text(page: str | None, tree=None) -> str:
    """Article blocks of a page, joined by an empty line."""
    tree = trained() if tree is None else tree
    return "\n\n".join(text for text, features in blocks(page) if classify(tree, features))


def extract(html: Column) -> Column:
    """The main text of a column of pages."""
    tree = trained()

    @F.pandas_udf("string")
    def text(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in pages:
            yield batch.map(lambda page: main_text(page, tree))

    return text(F.coalesce(html.cast("string"), F.lit("")))


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", extract(F.col("html")).alias("text"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))
