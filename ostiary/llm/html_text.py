"""Main text of HTML pages by tree scoring.

A page is read once into a tree of its block elements. Every paragraph passes points for its length and its commas to
the elements around it, in full to the nearest and less to those further out; an element's points are discounted by the
share of its text that is link text. The best element and those siblings that look like it are kept, without the menus,
forms, notices and the like inside them.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from ostiary.llm import common

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|title|svg|math|iframe|object|select|button|canvas|audio|video)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S | re.I)

_BLOCKS = frozenset("""html head body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th
caption blockquote pre figure figcaption header footer nav aside form fieldset legend label address details summary hr center menu dialog""".split())
# An opening tag ends an open element of these kinds (as a paragraph ends at the next block).
_ENDS_PARAGRAPH = _BLOCKS - {"html", "head", "body", "label", "legend"}
_ENDS_LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_LISTS = frozenset(["ul", "ol", "dl", "table", "menu"])
_LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption caption tr".split())
_NEVER = frozenset("head nav aside footer menu dialog fieldset label legend".split())
_WHOLE = frozenset(["html", "body"])
# Words of the names in class, id and role. A name is one item, as post-comments, and its words together say what the element
# is: any word of the first three lists makes it such a thing, whatever else the name holds, unless a word of state or
# layout is among them (has-comments, menu-open). Names of the fourth list count only without a content word.
_READERS = frozenset("comment comments commentlist commenter disqus reply replies respond reaction reactions".split())
_FOOT = frozenset("footer footers foot copyright colophon".split())
_ALIEN = frozenset("""ad ads adv advert adverts advertising advertisement advertisements adsense sponsor sponsored sponsors promo promos promotion
cookie cookies consent gdpr popup modal newsletter subscribe subscription signup
login share sharing sharedaddy social related recommended recommendations breadcrumb breadcrumbs navbar nav navigation menu menus sidebar
sidebars pagination pager banner banners notice notices alert skyscraper outbrain taboola paywall complementary contentinfo search""".split())
_DOUBTFUL = frozenset("header side widget widgets toolbar masthead meta tags tools byline legal disclaimer toc rail links site top bottom".split())
_CONTENT = frozenset("article articles body content entry main post story text hentry page column blog prose".split())
_STATES = frozenset("has with without no open opened closed enabled disabled on off layout".split())
# A form, or an element named like a part of a layout, that holds this share of the page's paragraphs is their container.
_CONTAINS = 0.8
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none|visibility\s*:\s*hidden""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class _Node:
    __slots__ = ("tag", "parent", "gone", "weight", "points", "mixed", "size", "linked", "commas", "doubted", "paragraphs")

    def __init__(self, tag: str, parent: "_Node | None", attributes: str) -> None:
        self.tag, self.parent = tag, parent
        self.points = 0.0
        self.size = self.linked = self.commas = self.paragraphs = 0
        names = [{w.lower() for w in _WORDS.findall(name)} for m in _NAMES.finditer(attributes) for name in (m[2] or m[3] or m[4] or "").split()]
        named = [n for n in names if _STATES.isdisjoint(n)]
        readers, alien, foot = (any(not words.isdisjoint(n) for n in named) for words in (_READERS, _ALIEN, _FOOT))
        content = any(not _CONTENT.isdisjoint(n) and n.isdisjoint(_READERS) and n.isdisjoint(_ALIEN) and n.isdisjoint(_FOOT) for n in names)
        doubtful = any(not _DOUBTFUL.isdisjoint(n) and n.isdisjoint(_CONTENT) for n in named)
        piece = tag in ("article", "main")
        body = piece or content
        self.mixed = body and (readers or alien)
        self.weight = 25.0 * (body and not self.mixed)
        self.gone = parent is not None and parent.gone
        # gone unless it turns out to hold the page's paragraphs
        self.doubted = tag == "form" or alien and not readers and not body and tag not in _WHOLE
        if self.gone or tag in _WHOLE:
            return
        self.gone = (tag in _NEVER or (tag == "header" and not self._inside("article", "main")) or readers and not (piece and content)
                     or foot and not piece or doubtful and not body
                     or bool(attributes) and _HIDDEN.search(_NAMES.sub(" ", attributes)) is not None)

    def _inside(self, *tags: str) -> bool:
        node = self.parent
        while node is not None:
            if node.tag in tags:
                return True
            node = node.parent
        return False

    def density(self) -> float:
        return self.linked / self.size if self.size else 0.0


def _read(page: str) -> tuple[list[_Node], list[tuple[_Node, str, int]]]:
    """Elements, and runs of text between block borders with their element and number of link characters."""
    root = _Node("html", None, "")
    nodes, runs, stack = [root], [], [root]
    parts: list[str] = []
    link_parts: list[int] = []  # numbers of the parts inside links
    in_link = False

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                whole = sum(map(len, parts))
                linked = sum(len(parts[i]) for i in link_parts)
                runs.append((stack[-1], text, len(text) * linked // whole))
            parts.clear()
            link_parts.clear()

    def add(text: str) -> None:
        if text:
            if in_link:
                link_parts.append(len(parts))
            parts.append(text)

    at = 0
    for found in _MARKUP.finditer(page):
        add(page[at:found.start()])
        at = found.end()
        tag = found[3] or found[6]
        if not tag:
            if found[1]:
                add(" ")
            continue
        tag = tag.lower()
        closing = bool(found[2] or found[5])
        if tag == "a":
            in_link = not closing
        elif tag == "br" or tag == "img":
            add(" ")
        elif tag in _BLOCKS:
            flush()
            in_link = False
            if closing:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == tag:
                        del stack[depth:]
                        break
                continue
            if tag in _ENDS_PARAGRAPH and stack[-1].tag == "p":
                stack.pop()
            if tag == "body":  # whatever was left open before the body is over
                del stack[1:]
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in _ENDS_LIKE.get(tag, ()):
                    del stack[depth:]
                elif stack[depth].tag in _LISTS:
                    break
            if tag == "html" or tag == "hr":
                continue
            node = _Node(tag, stack[-1], found[4] or found[7] or "")
            nodes.append(node)
            stack.append(node)
    add(page[at:])
    flush()
    return nodes, runs


def _lasting(nodes: list[_Node], runs: list[tuple[_Node, str, int]]) -> list[tuple[_Node, str, int]]:
    """Runs outside forms and boxes named like parts of a layout; such an element stays if it holds the page's paragraphs."""
    if not any(n.doubted for n in nodes):
        return runs
    total = 0
    for node, text, linked in runs:
        if node.tag == "p":
            total += len(text) - linked
            up = node
            while up is not None:
                up.paragraphs += len(text) - linked
                up = up.parent
    for node in nodes:  # parents come before their children
        node.gone |= node.parent is not None and node.parent.gone
        node.gone |= node.doubted and not (total and node.paragraphs >= _CONTAINS * total)
    return [r for r in runs if not r[0].gone]


def main_text(page: str) -> str:
    """Text of the main article: blocks in page order joined by a blank; empty if there is none."""
    nodes, runs = _read(page)
    runs = _lasting(nodes, [r for r in runs if not r[0].gone])
    if not runs:
        return ""
    for node, text, linked in runs:
        commas = text.count(",")
        up = node
        while up is not None:
            up.size, up.linked, up.commas = up.size + len(text), up.linked + linked, up.commas + commas
            up = up.parent
        points = min(len(text) / 25, 1.0) + commas + min(len(text) / 100, 3.0)
        up = node.parent if node.tag in _LEAVES and node.parent is not None else node
        share = 1.0
        while up is not None and share > 0.05:
            up.points += points * share
            share /= 2
            up = up.parent
    live = [n for n in nodes if not n.gone and n.size and n.tag not in _LEAVES]
    scores = {id(n): (n.points + n.weight * (n.points > 0)) * (1 - n.density()) for n in live}
    best = max(live, key=lambda n: scores[id(n)])
    kept = {id(best)}
    bar = max(10.0, 0.2 * scores[id(best)])
    for n in nodes if best.parent is not None else ():
        if n.parent is best.parent and not n.gone and n.size:
            if scores.get(id(n), 0.0) >= bar or n.tag == "p" and n.size > 80 and n.density() < 0.25:
                kept.add(id(n))
    # what mixes both kinds of names inside what is kept must earn its place like a sibling
    above, up = set(), best
    while up is not None:
        above.add(id(up))
        up = up.parent
    weak = {id(n) for n in nodes if n.mixed and id(n) not in above and scores.get(id(n), 0.0) < bar}
    # lists and boxes of links inside what is kept are menus
    menus = {id(n) for n in nodes if n is not best and n.tag not in ("p", "li", "td", "tr") and n.size and n.density() > 0.5 and n.commas < 10}
    out = []
    for node, text, _ in runs:
        up, inside = node, False
        while up is not None:
            if id(up) in menus or id(up) in weak:
                inside = False
                break
            inside = inside or id(up) in kept
            up = up.parent
        if inside:
            out.append(text)
    return " ".join(out)


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (its code points): whole pages, one pass, no shuffle.

    Null and empty pages, and pages without text, give an empty text. A column of ``pages`` named like one of
    these is replaced.
    """
    def compute(batch: pa.RecordBatch) -> list:
        found = [main_text(page) for page in common.texts_of(batch, column)]
        return [pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())]

    return common.with_columns(pages, "text string, n_chars long", compute)
