"""HTML extraction by tag-path ratios.

A page's text falls into blocks: runs of text and inline markup between block-level tags. Each block has the path of
block-level tags from the root to it. Per path of the page its blocks, characters, punctuation marks and link
characters are added up. Characters per block and punctuation per block, each smoothed over the blocks in page order
by a narrow bell curve, are fused by their geometric mean and weighed by the share of text outside links; a path is
content if its mean is at least `SHARE` of the best path's, unless only its neighbours lift it there: its own value
without smoothing must be `OWN` of the best. No block of a content path is dropped. Where most content
stands in article or main elements, these stay (an article within a main as part of it): headings, lists and
short paragraphs, too. Else the smallest element that holds all content stays, or the page if there is none. What stands
between content there and is no content itself goes if most characters of its path are links: a list of links.

Never content: elements that are scripts, styles, forms, menus, asides, page headers and footers by their tag or role,
and hidden ones. A header within an article stays. Elements are also left out by the last word of a token of their class
or id (`sidebar`, `left-sidebar`, `ad-box`, not `has-sidebar` or `nav-open`), but first what they hold is compared with
what is left, larger elements first. One named for layout stays if it holds more article or main text than is left, or
most of the page's text outside links, and all of one word stay if a quarter of their text or less would be left. One
named for discussion stays only if little else and no article is left, an advertisement only round the sole article.

Null and empty pages, and pages without text, give an empty text. Broken markup is read as browsers do for the cases
that matter here: open paragraphs and list items end at the next one, unknown ends are skipped, and what is cut off at
the end of the page counts up to there. Time grows with the page's length, however deep its elements stand.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventspark.llm.frames import free_name

SHARE, OWN = 0.15, 0.0225
_SMOOTH = (0.06, 0.24, 0.4, 0.24, 0.06)

# Element names of HTML by their part in a page.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg math".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_NEVER = frozenset("head script style form nav aside footer noscript template iframe button select option textarea input dialog menu object canvas audio video map".split())
_ENDS = {
    "li": ("li",), "p": ("p",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
}
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
_LAYOUT, _TALK, _AD = 1, 2, 3
_WORDS = {
    **dict.fromkeys(
        "banner promo promotion notice notification alert popup modal overlay sidebar aside widget menu navbar nav navigation breadcrumb breadcrumbs "
        "pagination pager footer masthead topbar toolbar share sharing social newsletter subscribe subscription signup login search copyright "
        "disclaimer skip".split(), _LAYOUT),
    **dict.fromkeys("comment comments discussion disqus replies reply respond related recommended".split(), _TALK),
    **dict.fromkeys("ad ads adv advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr".split(), _AD),
}
# Parts of a class that say what a page has or how it stands, and last parts that say nothing of what an element holds.
_STATES = frozenset("has have with without no not non is free less open opened closed on off active enabled disabled visible supported".split())
_TAILS = frozenset(
    "area bar bars block box button buttons col column container footer form group header holder icons inner item items left link links list main "
    "outer panel posts primary right row secondary section slot top bottom unit wrap wrapper zone x".split())
_HEADERS = frozenset("header site-header page-header".split())
_BLOCK_END = frozenset("p div section article main body ul ol table blockquote".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)", re.I)
_HEADING = re.compile(r"h[1-6]")
_PUNCTUATION = re.compile(r"[,.;:!?…。、，；：！？]")


def _left_out(name: str, rest: str, in_article: bool) -> tuple[bool, str]:
    """Whether the element is never content, and the word of its class or id by which it may be left out."""
    if name in _NEVER or (name == "header" and not in_article):
        return True, ""
    if not rest or "=" not in rest:
        return bool(rest) and bool(_HIDDEN.search(rest)), ""
    found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(rest)}
    if found.get("role", "").lower() in _ROLES or found.get("aria-hidden") == "true" or _HIDDEN.search(_ATTRIBUTE.sub(" ", rest)):
        return True, ""
    if "display:none" in found.get("style", "").replace(" ", "").lower():
        return True, ""
    if name in ("body", "html", "main", "article"):
        return False, ""
    words = []
    for token in f"{found.get('class', '')} {found.get('id', '')}".lower().split():
        parts = [p for p in re.split(r"[^a-z]+", token) if p]
        if token in _HEADERS and not in_article:
            words.append("banner")
        if not _STATES.isdisjoint(parts):
            continue
        while len(parts) > 1 and parts[-1] in _TAILS and parts[-1] not in _WORDS:
            parts.pop()
        if parts and parts[-1] in _WORDS:
            words += [p for p in parts if p in _WORDS]
    return False, max(words, key=_WORDS.get, default="")


class _Page:
    """Blocks of a page in order: (path, element, outermost article or main or 0, text, characters in links).

    A path is the number of a node in a tree of names with links to parents, an element its number in page order; an
    element holds those with numbers up to its `last`. So nothing here grows with the depth at which it stands, and the
    ends of elements are found by the places where each name is open.
    """

    def __init__(self, page: str):
        self.blocks: list[tuple[int, int, int, str, int]] = []
        self.cut: list[tuple[int, int, int, int, int]] = []  # as blocks, but with first piece and piece after it
        self.open: list[tuple] = []  # name, number, left out, named element or -1, path, innermost block element but p, path's name is a heading
        self.where: dict[str, list[int]] = {}  # places in `open` by name
        self.walls: list[int] = []  # places of block elements
        self.hard: list[int] = []  # of those but p
        self.paths: dict[tuple[int, str], int] = {}
        self.names: list[str] = [""]
        self.parent: list[int] = [0]  # innermost block element but p around each element
        self.last: list[int] = [0]
        self.pieces: list[tuple[str, bool, int, int]] = []  # text, linked, innermost article or main, innermost named element or -1
        self.named: list[tuple[int, str, bool, int]] = []  # number, word, stands in an article, named element around or -1
        self.within = -1
        self.articles: list[int] = []
        self.of_article: dict[int, int] = {}  # named element around an article or main
        self.out = self.links = self.begun = 0
        at = 0
        while True:
            token = _TOKEN.search(page, at)
            if at < (token.start() if token else len(page)):
                self._say(page[at : token.start() if token else len(page)])
            if not token:
                break
            at = token.end()
            if not token[2]:
                continue
            name = token[2].lower()
            if token[1]:
                self._end(name)
            else:
                self._start(name, token[3])
                if name in _RAW and not token[3].endswith("/"):
                    close = re.compile(rf"</{name}\s*(?:>|\Z)", re.I).search(page, at)
                    at = close.end() if close else len(page)
                    self._end(name)
        self._close_block()
        while self.open:
            self._pop()
        closed = self._closed()
        for path, inside, article, a, b in self.cut:
            left = [(t, linked) for t, linked, _, k in self.pieces[a:b] if k < 0 or not closed[k]]
            text = " ".join("".join(t for t, _ in left).split())
            if text:
                self.blocks.append((path, inside, article, text, sum(len(t) for t, linked in left if linked)))

    def _add(self, text: str, linked: bool) -> None:
        self.pieces.append((text, linked, self.articles[-1] if self.articles else 0, self.within))

    def _closed(self) -> list[bool]:
        """For each named element whether it or one around it is left out, after a comparison with what is left."""
        n = len(self.named)
        if not n:
            return []
        size = [0 if linked else len(" ".join(t.split())) for t, linked, _, _ in self.pieces]
        own, own_article, held, articles = [0] * n, [0] * n, [0] * n, [0] * n
        some = [False] * n
        free = free_articles = 0
        for v, (_, _, article, k) in zip(size, self.pieces, strict=True):
            if k < 0:
                free += v
                free_articles += v if article else 0
                continue
            some[k] = True
            own[k] += v
            own_article[k] += v if article else 0
            held[k] += v
            # An article counts for the named elements it stands in, not for those in it.
            if article and self.of_article[article] >= 0:
                articles[self.of_article[article]] += v
        for k in range(n - 1, -1, -1):
            around = self.named[k][3]
            if around >= 0:
                held[around] += held[k]
                articles[around] += articles[k]
                some[around] |= some[k]
        total, dropped = sum(size), [True] * n
        blocked = [False] * n  # an element around stays left out
        for k in sorted(range(n), key=lambda k: (-held[k], k)):
            _, word, inside, around = self.named[k]
            blocked[k] = around >= 0 and (dropped[around] or blocked[around])
            if blocked[k] or not some[k]:
                continue
            if _WORDS[word] == _AD:
                keeps = articles[k] and not free_articles
            elif _WORDS[word] == _TALK:
                keeps = not free_articles and 4 * free < held[k]
            else:
                keeps = articles[k] and articles[k] >= free_articles or 2 * held[k] > total and (inside or 4 * free_articles < held[k])
            if keeps:
                dropped[k] = False
                free += own[k]
                free_articles += own_article[k]
        outer = self._outermost(dropped)
        of: dict[str, int] = {"": sum(v for v, (*_, k) in zip(size, self.pieces, strict=True) if k < 0)}
        for k in range(n):
            word = self.named[outer[k]][1] if outer[k] >= 0 else ""
            of[word] = of.get(word, 0) + own[k]
        for k in range(n):
            word = self.named[k][1]
            if dropped[k] and _WORDS[word] == _LAYOUT and 4 * of[""] < of.get(word, 0):
                dropped[k] = False
        return [k >= 0 for k in self._outermost(dropped)]

    def _outermost(self, dropped: list[bool]) -> list[int]:
        """For each named element the outermost one left out of it and those around it, or -1."""
        out: list[int] = []
        for k, (*_, around) in enumerate(self.named):
            above = out[around] if around >= 0 else -1
            out.append(above if above >= 0 else k if dropped[k] else -1)
        return out

    def _say(self, raw: str) -> None:
        if not self.out:
            cut = raw.rfind("<") if re.search(r"<[a-zA-Z/!][^>]*\Z", raw) else -1
            self._add(html.unescape(raw if cut < 0 else raw[:cut]), self.links > 0)

    def _close_block(self) -> None:
        if len(self.pieces) > self.begun:
            path, inside = self.open[-1][4:6] if self.open else (0, 0)
            self.cut.append((path, inside, self.articles[0] if self.articles else 0, self.begun, len(self.pieces)))
            self.begun = len(self.pieces)

    def _start(self, name: str, rest: str) -> None:
        if name == "br":
            self._add(" ", False)
        if name in _VOID:
            if name == "hr":
                self._close_block()
            return
        block = name not in _INLINE
        if block:
            self._close_block()
            if name in _ENDS or name in _BLOCK_END or name[0] == "h" and name[1:].isdigit():
                self._imply(_ENDS.get(name, ("p",)))
        leave, word = _left_out(name, rest, bool(self.articles))
        number = len(self.parent)
        path, inside = self.open[-1][4:6] if self.open else (0, 0)
        self.parent.append(inside)
        self.last.append(number)
        if block:
            path = self.paths.setdefault((path, name), len(self.names))
            if path == len(self.names):
                self.names.append(name)
            inside = number if name != "p" else inside
        place = len(self.open)
        self.where.setdefault(name, []).append(place)
        if block:
            self.walls.append(place)
            if name != "p":
                self.hard.append(place)
        self.open.append((name, number, leave, len(self.named) if word else -1, path, inside))
        if word:
            self.named.append((number, word, bool(self.articles), self.within))
            self.within = len(self.named) - 1
        self.out += leave
        if name in ("article", "main"):
            self.articles.append(number)
            self.of_article[number] = self.within
        self.links += name == "a"

    def _top(self, names: tuple[str, ...]) -> int:
        """The highest place where one of these names is open, or -1."""
        return max((self.where[n][-1] for n in names if self.where.get(n)), default=-1)

    def _imply(self, names: tuple[str, ...]) -> None:
        """End the open elements of these names that the new one can't stand in."""
        walls = {"li": ("ul", "ol"), "dt": ("dl",), "tr": ("table",), "td": ("table", "tr")}.get(names[0], ())
        wall = self._top(walls) if names != ("p",) else self.hard[-1] if self.hard else -1
        while (place := self._top(names)) > wall:
            while len(self.open) > place:
                self._pop()

    def _pop(self) -> None:
        name, number, leave, named, *_ = self.open.pop()
        self.where[name].pop()
        self.last[number] = len(self.parent) - 1
        if name not in _INLINE:
            self.walls.pop()
            if name != "p":
                self.hard.pop()
        if named >= 0:
            self.within = self.named[named][3]
        self.out -= leave
        if name in ("article", "main"):
            self.articles.pop()
        self.links -= name == "a"

    def _end(self, name: str) -> None:
        inline = name in _INLINE
        if not inline:
            self._close_block()
        place = self._top((name,))
        if place > (self.walls[-1] if inline and self.walls else -1):
            while len(self.open) > place:
                self._pop()

    def holder(self, inside: list[int]) -> int:
        """The smallest element that holds all of these, or 0."""
        low, high = min(inside), max(inside)
        k = low
        while k and self.last[k] < high:
            k = self.parent[k]
        return k


def _smoothed(values: list[float]) -> list[float]:
    half = len(_SMOOTH) // 2
    out = []
    for k in range(len(values)):
        near = [(w, values[k + d]) for d, w in zip(range(-half, half + 1), _SMOOTH, strict=True) if 0 <= k + d < len(values)]
        out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return out


def extract(page: str | None) -> str:
    """The main text's blocks, joined by empty lines."""
    found = _Page(page) if page else None
    blocks = found.blocks if found else []
    if not blocks:
        return ""
    paths: dict[int, list[float]] = {}
    for path, _, _, text, links in blocks:
        sums = paths.setdefault(path, [0, 0, 0, 0])
        for k, v in enumerate((1, len(text), len(_PUNCTUATION.findall(text)), links)):
            sums[k] += v
    length = _smoothed([paths[p][1] / paths[p][0] for p, *_ in blocks])
    marks = _smoothed([(paths[p][2] + 0.5) / paths[p][0] for p, *_ in blocks])
    fused: dict[int, list[float]] = {}
    for (path, *_), a, b in zip(blocks, length, marks, strict=True):
        fused.setdefault(path, []).append(math.sqrt(a * b) * max(0.0, 1 - paths[path][3] / paths[path][1]))
    score = {p: sum(v) / len(v) for p, v in fused.items()}
    alone = {p: math.sqrt(c / n * (m + 0.5) / n) * max(0.0, 1 - linked / c) for p, (n, c, m, linked) in paths.items()}
    best, most = max(score.values()), max(alone.values())
    chosen = {p for p in paths if score[p] >= SHARE * best}
    chosen = {p for p in chosen if alone[p] >= OWN * most} or chosen
    content = [b for b in blocks if b[0] in chosen]
    # Of the other paths around content, those made of links are lists of links and not the article's.
    listed = {p for p, (_, c, _, linked) in paths.items() if p not in chosen and 2 * linked > c and not _HEADING.fullmatch(found.names[p])}
    if 2 * sum(len(b[3]) for b in content if b[2]) >= sum(len(b[3]) for b in content):
        articles = {b[2] for b in content} - {0}
        kept = [b for b in blocks if b[0] in chosen or b[2] in articles and b[0] not in listed]
    else:
        around = found.holder([b[1] for b in content])
        kept = [b for b in blocks if b[0] in chosen or around <= b[1] <= found.last[around] and b[0] not in listed or not around and b[0] not in listed]
    return "\n\n".join(b[3] for b in kept)


def with_main_text(pages: DataFrame, page: str = "html") -> tuple[DataFrame, str]:
    """All rows and columns with the text; returns the new column's name, `main_text` unless taken."""
    name, place = free_name(pages, "main_text"), pages.columns.index(page)
    schema = pages.withColumn(name, F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([extract(p) for p in batch.column(place).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, text], names=[*batch.schema.names, name])

    return pages.mapInArrow(run, schema), name


def text_digest(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    found, name = with_main_text(pages.select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col(name).alias("text"), F.length(name).cast("long").alias("n_chars"))
