"""Main text of web pages by minimum cut.

A page becomes a row of text blocks with their places in the element tree.  A logistic
classifier with set weights (elements above, class and id words, links, length, punctuation)
gives each block the cost of calling it content or boilerplate; these are the capacities to source
and sink.  Neighbours in the page, and blocks with one parent, are joined by edges that weigh
more the closer they stand in the tree.  The minimum cut is the cheapest labelling.

A page without main or article has, in its place, the element that holds most of its prose, so that words in the
classes of wrappers hide no article.  Null and empty pages give an empty text, repeated rows one each; time grows with the page, however deep its elements are.  Character references are decoded, white space inside
a block becomes one space, blocks are joined by line feeds; nothing is cut off.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 1000  # capacities are integers
SMOOTH = 1.2  # weight of an edge between neighbours that share their parent

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*>?|<[a-zA-Z][^>]*>|[^<]+|<""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_UNSHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_COMPOUND = re.compile(r"\b(?:no|has|with)[-_][\w-]*", re.I)  # tells of the page, not of the element
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: Elements whose content is never text of the page.
_SKIPPED = frozenset("script style template noscript head title textarea iframe svg annotation annotation-xml select option button object audio video canvas datalist".split())
_BLOCK = frozenset("html body div section article main nav header footer aside form ul ol li table caption thead tbody tfoot tr td th p h1 h2 h3 h4 h5 h6 blockquote figure figcaption dl dt dd pre details summary fieldset legend address menu dialog center hgroup search".split())
_VOID_BLOCK = frozenset(["hr"])
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_OUTSIDE = frozenset("nav aside form footer menu dialog search".split())
_INSIDE = frozenset("article main".split())
#: Elements that are pieces of what holds them.
_PIECES = frozenset("p blockquote pre li h1 h2 h3 h4 h5 h6 dt dd figcaption".split())
_BAD_WORDS = frozenset("nav navbar navigation menu menus header masthead topbar footer foot sidebar side aside rail ad ads adv advert adverts advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent notice notification gdpr privacy comment comments commentlist reply replies discussion disqus respond share sharing social related recommended recommendations breadcrumb breadcrumbs widget newsletter subscribe subscription signup login popup modal overlay pagination pager toolbar skip copyright legal alert form search tags trending popular outbrain taboola teaser".split())
#: Bad words of parts whose articles are not the page's.
_APART = frozenset("comment comments commentlist reply replies discussion disqus respond related recommended recommendations trending popular outbrain taboola teaser".split())
_GOOD_WORDS = frozenset("article content post entry story main body text prose page".split())


class Open:
    """An open element with what it and those around it say of its text.

    Marks around the page's article, the chief element, tell of the page: of them only those of _APART count.  chief is 1 for a
    main or first article, 2 for an element that is taken for it as it holds most of the page's text, whose own marks tell of the page too.
    """

    __slots__ = ("apart", "bad", "good", "header", "hidden", "inside", "name", "number", "outside")

    def __init__(self, name: str, number: int, marks: tuple[int, bool, bool], chief: int, above: Open | None):
        bad, good, hidden = marks
        self.name, self.number = name, number
        self.inside = name in _INSIDE or above is not None and above.inside
        self.good = good or above is not None and above.good
        self.header = name == "header" or above is not None and above.header
        self.outside = name in _OUTSIDE or above is not None and above.outside
        self.apart = bad == 2 or above is not None and above.apart
        self.bad = bad > (chief == 2) or above is not None and (above.apart if chief else above.bad)
        self.hidden = hidden or above is not None and not chief and above.hidden


class Block:
    __slots__ = ("bad", "common", "depth", "good", "heading", "hidden", "holder", "inside", "linked", "parent", "tag", "text")

    def __init__(self, text: str, linked: int, stack: list[Open], common: int):
        """common: elements that this block and the one before both lie in."""
        self.text, self.linked, self.depth, self.common = text, linked, len(stack), common
        here = stack[-1] if stack else Open("", 0, (0, False, False), 0, None)
        self.tag = here.name
        self.parent = stack[-2].number if len(stack) > 1 else -1
        self.holder = self.parent if here.name in _PIECES else here.number
        self.inside = here.inside
        self.good = here.inside or here.good
        self.bad = here.outside or here.bad or here.header and not here.inside
        self.hidden = here.hidden
        self.heading = len(self.tag) == 2 and self.tag[0] == "h"

    def score(self) -> float:
        """Log-odds of being content."""
        words = self.text.count(" ") + 1
        s = -0.6 + 2.6 * self.good - 7.0 * self.bad - 9.0 * self.hidden - 4.0 * min(1.0, self.linked / max(1, len(self.text)))
        s += 1.6 * min(words, 40) / 40 + 0.6 * (self.text[-1:] in ".!?…\"'”»。！？") + 0.9 * (self.tag in ("p", "blockquote", "pre")) + 0.7 * self.heading
        return s


def attributes_of(text: str) -> dict[str, str]:
    """Attributes of a tag by lower-case name, the first of each; those without value are empty."""
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), html.unescape(value[1:-1] if value[:1] in ("'", '"') else value))
    return found


def marks_of(name: str, text: str) -> tuple[int, bool, bool]:
    """Of a tag: bad words (2 for those of _APART), whether it has good words and is hidden; html and body have none."""
    if not text or name in ("html", "body"):
        return 0, False, False
    a = attributes_of(text)
    named = _COMPOUND.sub(" ", " ".join(a.get(k, "") for k in ("class", "id", "role")))
    words = set(_WORD.findall(_CAMEL.sub(" ", named).lower()))
    hidden = "hidden" in a or a.get("aria-hidden", "").strip().lower() == "true" or bool(_UNSHOWN.search(a.get("style", "")))
    return 2 if words & _APART else int(bool(words & _BAD_WORDS)), bool(words & _GOOD_WORDS), hidden


def title_and_links(page: str) -> tuple[str, list[str]]:
    """The text of the page's first title, and the targets of its a elements in order; what stands in comments and in elements without text of the page is no markup."""
    title, links = None, []
    at, last = 0, page.rfind(">")
    unclosed: set[str] = set()
    while at <= last:
        m = _TOKEN.match(page, at)
        at, name = m.end(), (m[2] or "").lower()
        if not name or m[1]:
            continue
        if name == "a":
            target = attributes_of(m[3]).get("href")
            if target is not None:
                links.append(target.strip())
        elif name in _SKIPPED and name != "head" and name not in unclosed:
            close = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
            if name == "title" and title is None:
                title = page[at : close.start() if close else len(page)]
            if close:
                at = close.end()
            elif name in ("script", "style", "title", "textarea"):
                break
            else:
                unclosed.add(name)
    return " ".join(html.unescape(title or "").split()), links


def chief_holder(blocks: list[Block]) -> int | None:
    """The element that holds half of the page's unlinked prose or more, if the page has neither main nor article and marks would hide that text."""
    if any(b.inside for b in blocks):
        return None
    held: Counter[int] = Counter()
    for b in blocks:
        if b.text.count(" ") >= 7 and b.holder > 0:
            held[b.holder] += len(b.text) - b.linked
    if not held:
        return None
    best, most = max(held.items(), key=lambda x: (x[1], -x[0]))
    return best if 2 * most >= held.total() and any(b.holder == best and b.bad for b in blocks) else None


def blocks_of(page: str, chief: int | None = None) -> list[Block]:
    """The page's text blocks in order; chief is the number of an element to be taken for its article."""
    out: list[Block] = []
    stack: list[Open] = []
    opened: Counter[str] = Counter()  # names in the stack
    common = 0  # the least height of the stack since the last block
    parts: list[str] = []
    linked = link = number = 0
    article = False
    unclosed: set[str] = set()  # elements without an end tag from here on

    def flush() -> None:
        nonlocal linked, common
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append(Block(text, linked, stack, common))
            common = len(stack)
        parts.clear()
        linked = 0

    def close(k: int) -> None:
        """End the element at height k of the stack and all in it."""
        nonlocal common
        opened.subtract(e.name for e in stack[k:])
        del stack[k:]
        common = min(common, k)

    at, end, last = 0, len(page), page.rfind(">")
    while at < end:
        if at > last:  # no tag ends behind here
            rest = page[at:]
            cut = next((k for k in (rest.find("<!"), rest.find("<?")) if k >= 0), len(rest))
            parts.append(rest[:cut])
            linked += link and cut
            break
        m = _TOKEN.match(page, at)
        at, name = m.end(), m[2]
        if name is None:
            if page[m.start()] != "<" or m.end() - m.start() == 1:
                parts.append(m[0])
                linked += link and len(m[0])
            continue
        name = name.lower()
        if name in _SKIPPED:
            if not m[1]:
                tail = None if name in unclosed else re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
                if not tail:
                    unclosed.add(name)
                at = tail.end() if tail else (end if name in ("script", "style", "title", "textarea") else at)
        elif name == "a":
            link = 0 if m[1] else 1
        elif name == "br":
            parts.append(" ")
        elif name in _VOID_BLOCK:
            flush()
        elif name in _BLOCK:
            flush()
            link = 0
            if m[1]:
                if opened[name]:
                    close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k].name == name))
                continue
            if stack and stack[-1].name == "p":
                close(len(stack) - 1)
            if name in _CLOSES and any(opened[x] for x in _CLOSES[name][0]):
                closed, within = _CLOSES[name]
                k = next(k for k in range(len(stack) - 1, -1, -1) if stack[k].name in within or stack[k].name in closed)
                if stack[k].name not in within:
                    close(k)
            number += 1
            stack.append(Open(name, number, marks_of(name, m[3]), 2 if number == chief else int(name == "main" or name == "article" and not article), stack[-1] if stack else None))
            opened[name] += 1
            article = article or name == "article"
    flush()
    return out


def edges_of(blocks: list[Block]) -> dict[tuple[int, int], int]:
    """Smoothness between neighbours, and between blocks with one parent and others between them."""
    edges: dict[tuple[int, int], int] = {}
    last: dict[int, int] = {}
    for k, b in enumerate(blocks):
        if k:
            edges[k - 1, k] = int(SCALE * SMOOTH / max(1, blocks[k - 1].depth + b.depth - 2 * b.common - 1))
        before = last.get(b.parent)
        if before is not None and before < k - 1:
            edges[before, k] = int(SCALE * SMOOTH / 3)
        last[b.parent] = k
    return edges


def minimum_cut(balance: list[int], edges: dict[tuple[int, int], int]) -> list[bool]:
    """Which nodes stay with the source: positive balances hang on the source, negative on the sink, by their size.

    Flow goes from node to node along shortest paths, level by level, until none is left.
    """
    n = len(balance)
    room: list[dict[int, int]] = [{} for _ in range(n)]
    for (a, b), w in edges.items():
        room[a][b] = room[a].get(b, 0) + w
        room[b][a] = room[b].get(a, 0) + w
    rest = list(balance)
    while True:
        level = [-1] * n
        queue = deque(k for k in range(n) if rest[k] > 0)
        for k in queue:
            level[k] = 0
        reached = False
        while queue:
            k = queue.popleft()
            reached = reached or rest[k] < 0
            for j, w in room[k].items():
                if w and level[j] < 0:
                    level[j] = level[k] + 1
                    queue.append(j)
        if not reached:
            return [x >= 0 for x in level]
        ways = [iter(list(r)) for r in room]
        for start in range(n):
            while rest[start] > 0:
                path = [start]
                while path and rest[path[-1]] >= 0:
                    k = path[-1]
                    step = next((j for j in ways[k] if room[k].get(j, 0) and level[j] == level[k] + 1), None)
                    if step is None:
                        path.pop()
                    else:
                        path.append(step)
                if not path:
                    break
                hops = list(zip(path, path[1:], strict=False))
                amount = min(rest[start], -rest[path[-1]], *(room[a][b] for a, b in hops))
                for a, b in hops:
                    room[a][b] -= amount
                    room[b][a] = room[b].get(a, 0) + amount
                rest[start] -= amount
                rest[path[-1]] += amount
                for a in path[:-1]:  # these may still lead on
                    ways[a] = iter(list(room[a]))


def main_text(page: str | None) -> str:
    """The content blocks of a page, a line each."""
    blocks = blocks_of(page or "")
    if (chief := chief_holder(blocks)) is not None:
        blocks = blocks_of(page, chief)
    balance = []
    for b in blocks:
        s = b.score()
        keep, drop = math.log1p(math.exp(-s)), math.log1p(math.exp(s))  # costs of calling it content, boilerplate
        balance.append(int(SCALE * drop) - int(SCALE * keep))
    kept = minimum_cut(balance, edges_of(blocks))
    return "\n".join(b.text for b, k in zip(blocks, kept, strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(p) for p in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return pages.mapInArrow(run, "page_id long, url string, text string, n_chars long")
