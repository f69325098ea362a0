"""Main text of pages by consensus paths of their hosts.

First pass: every page names its best container, the narrowest element that holds most of the page's
good text (text outside menus, adverts, forms and the like, less what stands in links). Names in class,
id or role mark what is left out, but not an element that holds the page's main part or most of its text. Its
generalised path (tags with their classes, numbers masked) is a vote; votes are summed by host and
path in Spark. Second pass: paths with a tenth of a host's votes win, and each page is read anew from
the path that most pages of the host voted for (from its own container, if that holds it), else from
its own path if that won, else from the winner on the page that has most votes, else from its own.

Defined results: null and empty html give an empty text; a page without url belongs to the nameless
host; markup that is cut off or never closed is read as far as it goes; pages are read whole, at any
length; repeated rows are read each on their own; other columns are not looked at. Formulas keep their
text, but not its second spelling in annotations. Drawings, and what object, audio, video and canvas hold
for readers that cannot show them, are no text of the article.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SMALL_BYTES, arrow_stage, durable, lookup

#: A page's container holds this share of its good text; a winning path has this share of votes.
MOST = 0.6
#: An element with this share of the page's text is no part beside the article, whatever its name.
HELD = 0.7
WINNING = 0.1
#: Hosts whose winners may be sent to all tasks (measured); beyond that they are joined.
SMALL_SIDE = 100_000

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>script|style|title|textarea|noscript|template|iframe|svg|annotation-xml|annotation|object|xmp|noembed|noframes)\b"
    r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?[a-zA-Z][^<]*\Z|<", re.S | re.I)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.S)

#: Elements that end a block of text, and those that may hold the article.
BLOCK = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
            "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section "
            "summary table tbody td tfoot th thead tr ul".split())
HOLDER = {"article", "main", "section", "div", "body", "html", "td", "table", "center", "blockquote"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never belong to the article.
DROPPED = set("nav aside footer form button select option datalist dialog menu head header search label fieldset "
              "legend audio video canvas".split())
#: Words in class, id or role that mark what does not belong to the article.
MARKS = set("ad ads adsbygoogle adsense adv advert adverts advertisement advertising banner sponsor sponsored sponsors promo promotion promos "
            "cookie cookies consent gdpr notice notices alert alerts warning disclaimer newsletter subscribe subscription "
            "paywall popup modal overlay sidebar sidebars aside widget widgets related recommended recommendations share "
            "sharing social comments comment commentlist commentary reply replies respond disqus discussion reviews nav "
            "navbar navigation menu menus breadcrumb breadcrumbs pagination pager toolbar masthead header footer copyright "
            "colophon login signin signup search searchbox form contentinfo complementary skip toc hidden".split())
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: What an opening tag closes without being told.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
             "th": {"td", "th"}, "option": {"option"}}
LIMITS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}


class Page:
    """Blocks of text in page order, each with the elements that hold it.

    ``parent``, ``tag``, ``step``, ``path`` and ``last`` (of the elements below) describe elements. A path
    is a number: paths are kept as a tree of steps, so memory grows with elements, not with depth;
    ``path_text`` writes one out, ``find`` gives the number of a written one. ``blocks`` are (element, text, letters in links);
    ``good`` tells whether an element is outside everything dropped.
    """

    def __init__(self, source: str):
        self.parent, self.tag, self.step, self.path, self.good = [-1], [""], [""], [0], [True]
        self._steps: dict[tuple[int, str], int] = {}
        # Open elements by tag.
        self._opened: Counter[str] = Counter()
        # What an element's own tag and attributes say: marked by a name, dropped in any case.
        self._marked, self._dropped = [False], [False]
        self.blocks: list[tuple[int, str, int]] = []
        self._words: list[str] = []
        self._linked = 0
        self._read(source)
        self.last = list(range(len(self.tag)))
        for e in range(len(self.tag) - 1, 0, -1):
            self.last[self.parent[e]] = max(self.last[self.parent[e]], self.last[e])
        self._decide()

    def _flush(self, element: int) -> None:
        if self._words:
            text = " ".join(entities.unescape("".join(self._words)).split())
            if text:
                self.blocks.append((element, text, self._linked))
            self._words = []
        self._linked = 0

    def _open(self, tag: str, parent: int, attrs: str) -> int:
        names, marked, hidden = _names(attrs) if attrs and "=" in attrs or "hidden" in attrs else ("", False, False)
        self.parent.append(parent)
        self.tag.append(tag)
        self.step.append(f"{tag}{names}")
        at = self.path[parent]
        for part in self.step[-1].split(">"):
            at = self._steps.setdefault((at, part), len(self._steps) + 1)
        self.path.append(at)
        self._opened[tag] += 1
        self._marked.append(marked)
        self._dropped.append(tag in DROPPED or hidden and tag not in ("html", "body", "article", "main"))
        return len(self.tag) - 1

    def _close(self, stack: list[int], size: int) -> None:
        """Close open elements until ``size`` are left."""
        while len(stack) > size:
            self._opened[self.tag[stack.pop()]] -= 1

    def path_text(self, element: int) -> str:
        steps = []
        while element > 0:
            steps.append(self.step[element])
            element = self.parent[element]
        return "".join(f">{step}" for step in reversed(steps))

    def find(self, path: str) -> int | None:
        """The number of a written path; None if no element of the page may have it."""
        at: int | None = 0
        for part in path.split(">")[1:]:
            at = self._steps.get((at, part))
            if at is None:
                return None
        return at

    def _decide(self) -> None:
        """Settle ``good`` and keep the blocks that are."""
        n = len(self.tag)
        out = [False] * n
        for e in range(1, n):
            out[e] = out[self.parent[e]] or self._dropped[e]
        weight = [0.0] * n
        for element, text, linked in self.blocks:
            if not out[element]:
                weight[element] += max(0.0, len(text) - 1.5 * linked)
        # Holders of a main part, and of an article that no name marks, up to the next marked element.
        main, article = [False] * n, [False] * n
        for e in range(n - 1, 0, -1):
            up = self.parent[e]
            weight[up] += weight[e]
            if weight[e] and not out[e]:
                main[up] |= main[e] or self.tag[e] == "main"
                article[up] |= article[e] and not self._marked[e] or self.tag[e] == "article" and not self._marked[e]
        # A page with nothing outside marked elements has its article in the heaviest of them.
        plain = {"html", "body", "article", "main"}
        beside = [False] * n
        for e in range(1, n):
            beside[e] = beside[self.parent[e]] or self._marked[e] and self.tag[e] not in plain
        heaviest = -1
        if not any(not beside[e] and not out[e] and len(text) > 1.5 * linked for e, text, linked in self.blocks):
            heaviest = max((e for e in range(1, n) if beside[e] and not out[e] and not beside[self.parent[e]]),
                           key=weight.__getitem__, default=-1)
        # The nearest element at or above that is no header, and whether an article holds an element or is it.
        past, within = list(range(n)), [False] * n
        for e in range(1, n):
            if self.tag[e] in ("header", "hgroup"):
                past[e] = past[self.parent[e]]
            within[e] = within[self.parent[e]] or self.tag[e] in ("article", "main")
        for e in range(1, n):
            keeps = self.tag[e] in plain or e == heaviest or main[e] or article[e] and not article[0] \
                or weight[e] > 0 and weight[e] >= HELD * weight[0]
            dropped = self._dropped[e] or self._marked[e] and not keeps
            up = self.parent[e]
            good = self.good[up] and not dropped
            # A heading of the article may stand in a header inside of it.
            if self.tag[e] in HEADING and not dropped and self.tag[up] in ("header", "hgroup") and within[past[up]] and self.good[past[up]]:
                good = True
            self.good.append(good)
        self.blocks = [b for b in self.blocks if self.good[b[0]]]

    def _read(self, source: str) -> None:
        stack, links, at = [0], 0, 0
        for m in TOKEN.finditer(source):
            if m.start() > at:
                self._text(source[at:m.start()], links)
            at = m.end()
            tag = m["tag"]
            if tag is None:
                if m[0] == "<":
                    self._text("<", links)
                continue
            tag = tag.lower()
            if m["end"]:
                if tag == "a":
                    links = max(0, links - 1)
                if tag == "br" or tag == "p" and not self._opened["p"]:
                    self._text(" ", 0)
                if self._opened[tag]:
                    self._flush(stack[-1])
                    self._close(stack, self._place(stack, tag))
                continue
            if tag == "br":
                self._text(" ", 0)
                continue
            if tag == "a" and not m["attrs"].endswith("/"):
                links = 1
            attrs = m["attrs"]
            if tag not in BLOCK:
                # Inline elements matter only if they are dropped.
                if tag in VOID or not (tag in DROPPED or "=" in attrs and any(_names(attrs)[1:])):
                    continue
                if attrs.endswith("/"):
                    continue
            self._flush(stack[-1])
            if tag in BLOCK:
                while len(stack) > 1 and self.tag[stack[-1]] == "p" or (self.tag[stack[-1]] in HEADING and tag in HEADING):
                    self._close(stack, len(stack) - 1)
                if any(self._opened[t] for t in CLOSED_BY.get(tag, ())):
                    for depth in range(len(stack) - 1, 0, -1):
                        if self.tag[stack[depth]] in LIMITS.get(tag, ()):
                            break
                        if self.tag[stack[depth]] in CLOSED_BY[tag]:
                            self._close(stack, depth)
                            break
                if tag == "body" and self._opened["head"]:
                    self._close(stack, self._place(stack, "head"))
            if tag in VOID:
                continue
            stack.append(self._open(tag, stack[-1], attrs))
        if at < len(source):
            self._text(source[at:], links)
        self._flush(stack[-1])

    def _place(self, stack: list[int], tag: str) -> int:
        """Where the innermost open element of a tag stands."""
        at = len(stack) - 1
        while self.tag[stack[at]] != tag:
            at -= 1
        return at

    def _text(self, text: str, links: int) -> None:
        self._words.append(text)
        if links:
            self._linked += len(text)

    def best(self) -> int:
        """The narrowest element with most of the good text, and all of its own; 0 if there is none.

        Headings, paragraphs and list items that an element holds itself, not in a narrower holder,
        belong to the article as its heavy child does. A quote or a cell is never chosen for its
        weight alone.
        """
        weight = [0.0] * len(self.tag)
        for element, text, linked in self.blocks:
            weight[element] += max(0.0, len(text) - 1.5 * linked) + 0.01
        for e in range(len(self.tag) - 1, 0, -1):
            weight[self.parent[e]] += weight[e]
        if not weight[0]:
            return 0
        best = 0
        # Text that stands in an element itself: by the narrowest holder of the block.
        own: dict[int, list[int]] = {}
        narrowest = list(range(len(self.tag)))
        for e in range(1, len(self.tag)):
            if self.tag[e] not in HOLDER or self.tag[e] in ("blockquote", "td", "table"):
                narrowest[e] = narrowest[self.parent[e]]
        for element, text, linked in self.blocks:
            if len(text) > 2 * linked:
                own.setdefault(narrowest[element], []).append(element)
        children: dict[int, list[int]] = {}
        for e in range(1, len(self.tag)):
            children.setdefault(self.parent[e], []).append(e)
        holder = at = 0
        stopped = False
        while True:
            heavy = max(children.get(at, []), key=weight.__getitem__, default=None)
            if heavy is None or weight[heavy] < MOST * weight[0]:
                break
            # Blocks of the element itself that the heavy child does not hold.
            stopped = stopped or at > 0 and self.tag[at] not in ("html", "table") and any(
                not heavy <= e <= self.last[heavy] for e in own.get(at, []))
            at = heavy
            if self.tag[at] in ("article", "main"):
                holder, best, stopped = at, at, False
            elif self.tag[at] in HOLDER and not stopped and self.tag[at] != "blockquote" and (
                    self.tag[at] != "td" or weight[holder] - weight[at] < 1):
                holder = at
        return best if best and self.tag[best] == "article" else holder

    def text(self, paths: set[int] | None, element: int = 0) -> str:
        """Blocks inside elements with one of the paths, or inside the given element."""
        inside = [False] * len(self.tag)
        for e in range(len(self.tag)):
            up = self.parent[e]
            inside[e] = up >= 0 and inside[up] or (self.path[e] in paths if paths is not None else e == element)
        return "\n\n".join(text for e, text, _ in self.blocks if inside[e])


def _names(attrs: str) -> tuple[str, bool, bool]:
    """Generalised class names of a tag, whether they mark no part of an article, and whether it is hidden."""
    names, marked, hidden = "", False, bool(re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attrs))
    for m in ATTRIBUTE.finditer(attrs):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id", "role"):
            for token in value.split():
                parts = re.split(r"[^a-z]+", token)
                if any(p in MARKS for p in parts):
                    marked = True
                if key == "class":
                    names += "." + re.sub(r"\d+", "#", token)
        elif key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            hidden = True
    return names, marked, hidden


def _vote(columns: list[pa.Array]) -> Iterator[list]:
    paths = []
    for source in columns[1]:
        page = Page(source.as_py() or "")
        paths.append(page.path_text(page.best()))
    yield [columns[0], paths]


def extract(source: str | None, winners: list[str] | None, usual: str | None = None) -> str:
    """``usual`` is the path that more than half of the host's pages voted for."""
    page = Page(source or "")
    best = page.best()
    won, own = winners or [], page.path_text(best)
    present = set(page.path)
    common = page.find(usual) if usual else None
    common = common if common in present else None
    if usual and usual != own and not usual.startswith(f"{own}>"):
        text = page.text({common}) if common is not None else ""
        if text:
            return text
    if own in won:
        return page.text({page.path[best]})
    if common is not None and usual.startswith(f"{own}>"):
        return page.text(None, best)
    chosen = next((at for at in (page.find(p) for p in won if p) if at in present), None)
    text = page.text({chosen}) if chosen is not None else ""
    # A winner that is empty on this page explains nothing.
    return text or page.text(None, best)


def _extract(columns: list[pa.Array]) -> Iterator[list]:
    texts = [extract(s.as_py(), w.as_py(), u.as_py()) for s, w, u in zip(*columns[2:5])]
    yield [columns[0], columns[1], texts, [len(t) for t in texts]]


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def winning_paths(pages: DataFrame) -> DataFrame:
    """host, winners, usual: the paths with a share of a host's votes, most votes first, and that of most pages."""
    votes = arrow_stage(pages.select(host(F.col("url")).alias("host"), "html"), _vote, "host string, path string") \
        .filter("path <> ''").groupBy("host", "path").agg(F.count("*").alias("n"))
    # A host has few paths beside its pages; the sums over them combine before they move.
    total = votes.groupBy("host").agg(F.sum("n").alias("all"))
    return votes.join(total, "host").filter(F.col("n") >= F.col("all") * WINNING).groupBy("host").agg(
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "path"))), lambda s: s["path"]).alias("winners"),
        F.max(F.when(F.col("n") > F.col("all") / 2, F.col("path"))).alias("usual"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    winners = durable(winning_paths(pages))
    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    joined = lookup(rows, winners, "host", bound=SMALL_SIDE, most_bytes=SMALL_BYTES)
    return arrow_stage(joined.select("page_id", "url", "html", "winners", "usual"), _extract,
                       "page_id bigint, url string, text string, n_chars bigint")
