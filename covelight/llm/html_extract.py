"""Main text of web pages by equivalence-class template deduction.

Tokens of a page are its tags and its text nodes, each with the path of open elements above it. Over the pages of a
host, tokens with the same occurrence vector (how often on which page) form a class; vectors are compared by
fingerprints that sum over pages, so no task ever holds a host. Classes on at least three pages and half of
the host's pages, with two tokens or more, make the host's template, ordered by the tokens' mean place. On a page a
class is valid if its tokens stand there in that order, time after time, and if it nests with the valid classes of
more pages, fewer times or more tokens: each time one of the two comes, it lies in one gap of the other. The valid classes
are the page's template, the text between their tokens is slots. A block's text is its slots from the first to the last, so a
word of the template inside a sentence stays. The slots under an article or main element of the page are its text, or,
where there is none, all slots. Slots inside menus, headers, footers, sidebars, notices, adverts, forms and reader
comments are left out, known by element, role or a whole class or id. A name never leaves out html, body, main, the
page's main element or what holds it; other articles go by the names of reader comments alone; under the main element the
names of things that are none of these (sharing, related, search, widgets, pages) leave nothing out. The main element is the
first main, or else article, that is not left out, or the first of all. Versions of one article on a host look like a template:
so under a main element classes of texts alone do not count, nor does a template that would take more than two thirds of
its words. Where the template would leave no text at all, as on a host of copies, its own text stays.

A null or empty page, or one of mark-up alone, gives "" and 0. A null or odd url puts the page on the empty host; a
host of one or two pages has no template. Repeated rows count as pages of their own and get equal results. Pages of
any length are read whole; other columns are not read.
"""

from __future__ import annotations

import html
import re
from bisect import bisect
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .url_filter import host_of

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|svg|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAMING = frozenset(("class", "id", "role"))
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end by themselves; they bound blocks but do not nest.
LOOSE = frozenset("p li dt dd option tr td th thead tbody tfoot b i em strong a span font u s small".split())
#: Elements at whose start an open element of LOOSE ends, where no other element stands between.
_ENDS = {
    **dict.fromkeys(
        "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
        "hgroup hr main menu nav ol p pre search section table ul".split(),
        frozenset(("p",)),
    ),
    "li": frozenset(("li", "p")), **dict.fromkeys(("dt", "dd"), frozenset(("dt", "dd", "p"))), "option": frozenset(("option",)),
    **dict.fromkeys(("td", "th"), frozenset(("td", "th", "p"))), "tr": frozenset(("tr", "td", "th", "p")),
    **dict.fromkeys(("thead", "tbody", "tfoot"), frozenset(("thead", "tbody", "tfoot", "tr", "td", "th", "p"))),
}
MAIN = frozenset(("article", "main"))
MAIN_NAMES = frozenset(("main", "main-content", "maincontent"))
LEFT_OUT = frozenset("head nav footer aside form button select textarea menu dialog".split())
_COMMENTS = frozenset(
    "comment comments commentlist respond disqus comment-list comments-list comment-body comment-form comments-area comments-section "
    "comment-section comment-respond comment-thread comments-container disqus-thread".split()
)
#: Whole classes, ids and roles that mark an element as left out; `_` counts as `-`.
LEFT_OUT_NAMES = _COMMENTS | frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo cookie cookies consent notice notification sidebar menu nav "
    "navbar navigation breadcrumb breadcrumbs masthead footer share sharing social related "
    "newsletter subscribe popup modal widget pagination toolbar contentinfo complementary search "
    "ad-box ad-banner ad-container ad-slot ad-unit ad-wrapper adsbygoogle google-ad banner-ad promo-box cookie-banner cookie-bar cookie-notice "
    "cookie-consent cookie-popup consent-banner left-sidebar right-sidebar sidebar-left sidebar-right side-bar main-sidebar primary-sidebar "
    "sidebar-primary secondary-sidebar site-sidebar main-menu main-nav main-navigation site-nav site-navigation site-menu top-menu top-nav "
    "nav-bar nav-menu nav-links menu-bar primary-menu primary-nav footer-menu footer-nav page-nav post-nav post-navigation posts-navigation "
    "mobile-menu mobile-nav side-nav sidenav breadcrumb-nav breadcrumb-trail site-footer page-footer main-footer footer-widgets widget-area "
    "share-bar share-box share-buttons share-links social-bar social-buttons social-icons social-links social-media social-share related-posts "
    "related-articles related-links related-content newsletter-signup newsletter-form search-form search-box search-bar page-numbers "
    "popup-overlay modal-dialog".split()
)
_HEADS = frozenset("header masthead banner site-header main-header top-header page-header global-header site-banner site-masthead".split())

_NOT_HEADS = LEFT_OUT_NAMES - _HEADS
#: Parts of names that say nothing of a menu, header, footer, sidebar, notice, advert, form or comment: under the main element
#: they leave nothing out.
_BESIDE = frozenset("share sharing social related widget widgets modal popup pagination page-numbers toolbar search".split())
_IN_MAIN = frozenset(n for n in _NOT_HEADS if _BESIDE.isdisjoint((n, n.split("-")[0])) or n.endswith("-form"))
_PAGE = frozenset(("", "html", "body"))


class _Element:
    """An open or closed element: its parent, and whether its kind or its name leaves it out."""

    __slots__ = ("by_kind", "by_name", "dropped", "loose_at", "main", "name", "parent", "path")

    def __init__(self, name: str, path: str, parent: _Element | None, names: frozenset[str] | set[str], loose_at: int = 0) -> None:
        self.name, self.path, self.parent, self.loose_at = name, path, parent, loose_at
        inside = parent is not None and parent.main
        self.main = inside or name in MAIN or (name not in _PAGE and not names.isdisjoint(MAIN_NAMES))
        self.by_kind = name in LEFT_OUT or (name == "header" and not self.main)
        known = _COMMENTS if name == "article" else _IN_MAIN if inside else _NOT_HEADS
        head = name != "article" and not self.main and not names.isdisjoint(_HEADS)
        self.by_name = name not in _PAGE and name != "main" and (head or not names.isdisjoint(known))
        self.dropped = (parent is not None and parent.dropped) or self.by_kind or self.by_name


def _keep_main(elements: list[_Element]) -> None:
    """Takes back what names say of the page's main element and of what holds it."""
    tops = [e for e in elements if e.main and not (e.parent and e.parent.main)]
    mains = [e for e in tops if e.name != "article"] or tops
    if not mains:
        return
    e: _Element | None = next((e for e in mains if not e.dropped), mains[0])
    held = False
    while e:
        held, e.by_name = held or e.by_name, False
        e = e.parent
    if held:
        for e in elements:
            e.dropped = (e.parent is not None and e.parent.dropped) or e.by_kind or e.by_name


def parse(page: str) -> list[tuple[str, bool, bool, bool]]:
    """(token, is text, left out, in main) of the page's tags and text nodes in order; a block's end is the token ""."""
    out: list[tuple[str, _Element | None]] = []
    stack = [_Element("", "", None, frozenset())]
    loose: list[_Element] = []  # the open elements of LOOSE that a name leaves out
    elements: list[_Element] = []
    at = 0

    def inner() -> _Element:
        return loose[-1] if loose and loose[-1].loose_at == len(stack) else stack[-1]

    def end_loose(names: frozenset[str]) -> None:
        for i, e in enumerate(loose):
            if e.loose_at == len(stack) and e.name in names:
                del loose[i:]
                return

    for m in _TOKEN.finditer(page):
        if at < m.start():
            out.append((page[at : m.start()], inner()))
        at = m.end()
        close, name, rest = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        if not name:
            continue
        name = name.lower()
        if name not in INLINE:
            out.append(("", None))
        if loose and (ends := frozenset((name,)) if close else _ENDS.get(name)):
            end_loose(ends)
        if name in VOID or (name in LOOSE and (close or name not in _ENDS)):
            continue
        if close:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].name == name:
                    out.append((f"{stack[depth].path}</", None))
                    del stack[depth:]
                    while loose and loose[-1].loose_at > depth:
                        loose.pop()
                    break
            continue
        names = {w for a in _ATTRIBUTE.finditer(rest) if a[1].lower() in _NAMING for w in (a[2] or a[3] or a[4] or "").lower().replace("_", "-").split()} if rest else frozenset()
        if name in LOOSE:
            e = _Element(name, stack[-1].path, inner(), names, len(stack)) if names else None
            if e and e.by_name:
                loose.append(e)
                elements.append(e)
            continue
        if rest.rstrip().endswith("/"):
            continue
        e = _Element(name, f"{stack[-1].path}/{name}{'.' + '.'.join(sorted(names)) if names else ''}", inner(), names)
        stack.append(e)
        elements.append(e)
        out.append((e.path, None))
    if at < len(page):
        out.append((page[at:], inner()))
    _keep_main(elements)
    return [(token, True, e.dropped, e.main) if e else (token, False, False, False) for token, e in out]


def _keys(tokens: list[tuple[str, bool, bool, bool]]) -> list[int]:
    """A signed 64-bit key of each token: a tag's path (even), or a text node's words under the tag before it (odd); 0 for neither."""
    out, path = [], ""
    for token, is_text, _, _ in tokens:
        if not is_text:
            path = token or path
            out.append(_hash(token) & ~1 or 2 if token else 0)
        else:
            words = " ".join(token.split())
            out.append(_hash(f"{path}\n{words}") | 1 if words else 0)
    return out


def _hash(s: str) -> int:
    return (xxhash.xxh3_64_intdigest(s.encode("utf-8", "replace")) ^ 1 << 63) - (1 << 63)


def _places(keys: list[int]) -> dict[int, list[int]]:
    places: dict[int, list[int]] = {}
    for i, k in enumerate(keys):
        if k:
            places.setdefault(k, []).append(i)
    return places


def deduce_templates(pages: DataFrame) -> DataFrame:
    """(host, template) of each host that has one; template is an array of (token, class, support) in template order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, tokens, marks, places = [], [], [], []
            for host, number, page in zip(batch.column("host").to_pylist(), batch.column("number").to_pylist(), batch.column("html"), strict=True):
                keys = _keys(parse(page.as_py() or ""))
                for k, at in _places(keys).items():
                    hosts.append(host)
                    tokens.append(k)
                    marks.append(xxhash.xxh3_64_intdigest(f"{number} {len(at)}") >> 33)
                    places.append(at[0] / len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(tokens, pa.int64()), pa.array(marks, pa.int64()), pa.array(places, pa.float64())], ["host", "token", "mark", "place"])

    seen = pages.mapInArrow(run, "host string, token long, mark long, place double")
    tokens = seen.groupBy("host", "token").agg(F.count(F.lit(1)).alias("support"), F.sum("mark").alias("vector"), F.avg("place").alias("place")).where("support >= 3")
    sizes = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).where("pages >= 3")
    # From here a host has few rows: each token left is on half of the host's pages or more.
    frequent = tokens.join(sizes, "host").where("2 * support >= pages")
    classes = frequent.groupBy("host", "support", "vector").agg(F.collect_list(F.struct("place", "token")).alias("members")).where(F.size("members") >= 2)
    flat = classes.select("host", F.xxhash64("support", "vector").alias("class"), "support", F.explode("members").alias("m"))
    return flat.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("m.place", "m.token", "class", "support"))).alias("t")).select("host", F.expr("transform(t, x -> struct(x.token, x.class, x.support))").alias("template"))


def _nested(a: tuple[list[tuple[int, ...]], list[int]], b: tuple[list[tuple[int, ...]], list[int]]) -> bool:
    """Does one of two classes, (its rounds, all its places), lie in one gap of the other each time it comes?"""
    return any(all(bisect(outer, r[0]) == bisect(outer, r[-1]) for r in rounds) for rounds, outer in ((a[0], b[1]), (b[0], a[1])))


def tagged_tokens(template: list[dict]) -> set[int]:
    """The tokens of classes that hold a tag. A class of texts alone is what some pages of the host say alike, as versions of one
    article do."""
    tagged = {t["class"] for t in template if t["token"] % 2 == 0}
    return {t["token"] for t in template if t["class"] in tagged}


def valid_tokens(keys: list[int], template: list[dict]) -> set[int]:
    """The tokens of the template's classes that are valid on a page."""
    places = _places(keys)
    classes: dict[int, list[int]] = {}
    support: dict[int, int] = {}
    for t in template:
        classes.setdefault(t["class"], []).append(t["token"])
        support[t["class"]] = t["support"]
    ordered = []
    for c, members in classes.items():
        at = [places.get(k, []) for k in members]
        if not at[0] or len({len(x) for x in at}) > 1:
            continue
        rounds = list(zip(*at, strict=True))
        line = [x for r in rounds for x in r]
        if all(x < y for x, y in zip(line, line[1:], strict=False)):
            ordered.append((-support[c], len(rounds), -len(members), c, (rounds, line)))
    valid: list[tuple[list[tuple[int, ...]], list[int]]] = []
    own: set[int] = set()
    for *_, c, spans in sorted(ordered):
        if all(_nested(spans, v) for v in valid):
            valid.append(spans)
            own.update(classes[c])
    return own


def _join(blocks: list[list[tuple[str, bool]]]) -> str:
    """The text of blocks of (text, is the template's), each without the template's text at its ends."""
    out = []
    for block in blocks:
        slots = [i for i, (text, own) in enumerate(block) if not own and text.strip()]
        if slots:
            out.append(" ".join("".join(html.unescape(text) for text, _ in block[slots[0] : slots[-1] + 1]).split()))
    return " ".join(filter(None, out))


def extract(page: str, template: list[dict]) -> str:
    """The page's main text."""
    tokens = parse(page)
    has_main = any(main and not dropped for _, _, dropped, main in tokens)
    keys = _keys(tokens) if template else [0] * len(tokens)
    own = valid_tokens(keys, template) if template else set()
    if own and has_main:
        own &= tagged_tokens(template)
        kept = [(len(token.split()), key in own) for (token, is_text, dropped, main), key in zip(tokens, keys, strict=True) if is_text and main and not dropped]
        if 3 * sum(n for n, theirs in kept if theirs) > 2 * sum(n for n, _ in kept):
            own = set()
    blocks: list[list[tuple[str, bool]]] = [[]]
    for (token, is_text, dropped, main), key in zip(tokens, keys, strict=True):
        if not is_text:
            if not token and blocks[-1]:
                blocks.append([])
        elif not dropped and (main or not has_main):
            blocks[-1].append((token, key in own))
    return _join(blocks) or _join([[(text, False) for text, _ in block] for block in blocks])


def extract_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars."""
    pages = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).withColumn("host", host_of("url"))
    numbered = pages.select("host", F.coalesce(F.col("page_id"), F.xxhash64("html")).alias("number"), "html")
    templates = cut(deduce_templates(numbered))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page.as_py() or "", template.as_py() or []) for page, template in zip(batch.column("html"), batch.column("template"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    # A host with a third of all pages is a skewed partition of this join, which AQE splits.
    return pages.join(templates, "host", "left").select("page_id", "url", "html", "template").mapInArrow(run, "page_id long, url string, text string, n_chars long")
