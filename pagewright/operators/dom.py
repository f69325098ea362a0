"""Pages -> element tables.

HTML recovery is the one step SQL cannot express. It runs once per page inside a ``mapInArrow``
stage and yields one row per page: ``nodes`` (elements in document order) and ``tokens``
(visible text pieces with the element that owns them). The tree is encoded by pre-order numbers,
so every later question about ancestors, descendants or subtree text is an array expression on
the same row: no shuffle, and no page is ever spread over several rows until the caller asks.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import let, unfold
from ..session import ship

NODE_TYPE = (
    "struct<id:int,parent:int,last:int,depth:int,tag:string,nth:int,same:int,line:int,"
    "id_attr:string,class_attr:string,attrs:map<string,string>,"
    "tok_from:int,tok_to:int,chars:int>"
)
TOKEN_TYPE = "struct<node:int,text:string>"

# HTML element classes used while repairing tag soup.
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
_RAW = frozenset(("script", "style"))
_HIDDEN = frozenset(("script", "style", "noscript", "template"))
_HEADINGS = "h1 h2 h3 h4 h5 h6"
_FONT = "tt i b u s strike big small"
# A start tag (left) closes the open element on top of the stack if listed (right).
_CLOSED_BY = {
    new: frozenset(old.split()) for news, old in (
        ("p", f"p head {_HEADINGS} {_FONT}"),
        ("div center ul ol dir menu dl pre address blockquote table hr", f"p head {_HEADINGS}"),
        (_HEADINGS, f"p head {_HEADINGS}"),
        ("form", f"form p {_HEADINGS} dl ul ol menu dir address pre blockquote"),
        ("li", f"p {_HEADINGS} dl address pre li"),
        ("dt", "p dd dt"), ("dd", "p dt dd"),
        ("td th", "th td p span font a b u"),
        ("tr", "th td tr caption col colgroup p"),
        ("thead", "caption col colgroup p"),
        ("tbody tfoot", "th td tr caption col colgroup thead tfoot tbody p"),
        ("option", "option"), ("optgroup", "option"), ("a", "a"),
        ("body", "head"), ("fieldset", f"legend p head {_HEADINGS}"),
    ) for new in news.split()
}
# An end tag cannot close through an open element of higher rank.
_RANK = {"div": 150, "td": 160, "th": 160, "tr": 170, "thead": 180, "tbody": 180, "tfoot": 180,
         "table": 190, "head": 200, "body": 200, "html": 220}
_HEAD_ONLY = frozenset("script style meta link title base".split())

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    r"|<(?P<close>/?)(?P<tag>[A-Za-z][^\s/>]*)"
    r"(?P<attrs>(?:[^>\"'=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[=\"'])*+)>",
    re.S,
)
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_BLANK = re.compile(r"\s+")


class _Tree:
    """Open-element stack that records elements and text pieces in document order."""

    def __init__(self) -> None:
        self.tag: list[str] = []
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.line: list[int] = []
        self.attrs: list[dict[str, str]] = []
        self.nth: list[int] = []
        self.first_token: list[int] = []
        self.last: list[int] = []
        self.end_token: list[int] = []
        self.kids: list[dict[str, int]] = []
        self.owner: list[int] = []
        self.text: list[str] = []
        self.stack: list[int] = []
        self.pending: list[str] = []

    def flush(self) -> None:
        if not self.pending:
            return
        text = _BLANK.sub(" ", html.unescape("".join(self.pending))).strip()
        self.pending.clear()
        if not text:
            return
        if not self.stack or self.tag[self.stack[-1]] in ("html", "head"):
            self.imply("p", 1)
            self.push("p", {}, 1)
        self.owner.append(self.stack[-1])
        self.text.append(text)

    def push(self, tag: str, attrs: dict[str, str], line: int) -> None:
        node = len(self.tag)
        up = self.stack[-1] if self.stack else -1
        if up >= 0:
            seen = self.kids[up]
            seen[tag] = seen.get(tag, 0) + 1
            self.nth.append(seen[tag])
        else:
            self.nth.append(1)
        self.tag.append(tag)
        self.parent.append(up)
        self.depth.append(len(self.stack))
        self.line.append(line)
        self.attrs.append(attrs)
        self.first_token.append(len(self.text))
        self.last.append(node)
        self.end_token.append(0)
        self.kids.append({})
        self.stack.append(node)

    def pop(self) -> None:
        node = self.stack.pop()
        self.last[node] = len(self.tag) - 1
        self.end_token[node] = len(self.text)

    def imply(self, tag: str, line: int) -> None:
        """Open the html, head or body element the page left out."""
        if tag == "html":
            return
        if not self.stack:
            self.push("html", {}, line)
        if tag in ("head", "body", "frameset"):
            return
        top = self.tag[self.stack[-1]]
        if tag in _HEAD_ONLY:
            if top == "html" and "head" not in self.kids[0] and "body" not in self.kids[0]:
                self.push("head", {}, line)
        elif top in ("html", "head"):
            if top == "head":
                self.pop()
            self.push("body", {}, line)

    def start(self, tag: str, attrs: dict[str, str], line: int, closed: bool) -> None:
        closes = _CLOSED_BY.get(tag, ())
        while self.stack and self.tag[self.stack[-1]] in closes:
            self.pop()
        if tag in ("html", "body", "head") and tag in self.tag:
            at = self.tag.index(tag)
            for name, value in attrs.items():
                self.attrs[at].setdefault(name, value)
            return
        self.imply(tag, line)
        self.push(tag, attrs, line)
        if closed or tag in VOID:
            self.pop()

    def end(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        rank = _RANK.get(tag, 100)
        for at in range(len(self.stack) - 1, -1, -1):
            open_tag = self.tag[self.stack[at]]
            if open_tag == tag:
                while len(self.stack) > at:
                    self.pop()
                return
            if _RANK.get(open_tag, 100) > rank:
                return

    def close(self) -> None:
        self.flush()
        while self.stack:
            self.pop()


def parse(source: str) -> _Tree:
    tree = _Tree()
    at, line, counted, hidden = 0, 1, 0, []
    while True:
        found = _MARKUP.search(source, at)
        stop = found.start() if found else len(source)
        if not hidden and stop > at:
            tree.pending.append(source[at:stop])
        if not found:
            break
        at = found.end()
        tag = (found["tag"] or "").lower()
        closing = found["close"] == "/"
        attr_text = found["attrs"] or ""
        self_closed = attr_text.endswith("/")
        if tag in _HIDDEN:
            # The element goes, its tail text joins the text before it.
            if closing:
                if hidden and hidden[-1] == tag:
                    hidden.pop()
            elif not self_closed:
                if tag in _RAW:
                    ends = re.compile(rf"</{tag}\s*[^>]*>", re.I).search(source, at)
                    at = ends.end() if ends else len(source)
                else:
                    hidden.append(tag)
            if not hidden and not tree.stack and not closing:
                tree.imply(tag, 1)
            continue
        if hidden:
            continue
        tree.flush()
        if not tag:
            continue
        if closing:
            tree.end(tag)
            continue
        line += source.count("\n", counted, found.start())
        counted = found.start()
        attrs: dict[str, str] = {}
        for name, double, single, bare in _ATTR.findall(attr_text):
            attrs.setdefault(name.lower(), html.unescape(double or single or bare))
        tree.start(tag, attrs, line, self_closed)
    tree.close()
    return tree


def _list_of(values: pa.Array, sizes: list[int]) -> pa.ListArray:
    offsets = [0]
    for size in sizes:
        offsets.append(offsets[-1] + size)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _to_arrow(trees: list[_Tree]) -> tuple[pa.ListArray, pa.ListArray]:
    cols: dict[str, list] = {k: [] for k in (
        "id", "parent", "last", "depth", "tag", "nth", "same", "line", "id_attr", "class_attr",
        "attrs", "tok_from", "tok_to", "chars")}
    owners: list[int] = []
    texts: list[str] = []
    for t in trees:
        n = len(t.tag)
        total = [0]
        for text in t.text:
            total.append(total[-1] + len(text) + 1)
        cols["id"] += range(n)
        cols["parent"] += t.parent
        cols["last"] += t.last
        cols["depth"] += t.depth
        cols["tag"] += t.tag
        cols["nth"] += t.nth
        cols["same"] += [t.kids[p][g] if p >= 0 else 1 for p, g in zip(t.parent, t.tag)]
        cols["line"] += t.line
        cols["id_attr"] += [a.get("id", "") for a in t.attrs]
        cols["class_attr"] += [a.get("class", "") for a in t.attrs]
        cols["attrs"] += [list(a.items()) for a in t.attrs]
        cols["tok_from"] += t.first_token
        cols["tok_to"] += t.end_token
        cols["chars"] += [max(0, total[e] - total[s] - 1)
                          for s, e in zip(t.first_token, t.end_token)]
        owners += t.owner
        texts += t.text
    ints = pa.int32()
    types = {"tag": pa.string(), "id_attr": pa.string(), "class_attr": pa.string(),
             "attrs": pa.map_(pa.string(), pa.string())}
    arrays = [pa.array(v, types.get(k, ints)) for k, v in cols.items()]
    nodes = pa.StructArray.from_arrays(arrays, names=list(cols))
    tokens = pa.StructArray.from_arrays(
        [pa.array(owners, ints), pa.array(texts, pa.string())], names=["node", "text"])
    return (_list_of(nodes, [len(t.tag) for t in trees]),
            _list_of(tokens, [len(t.text) for t in trees]))


def page_trees(pages: DataFrame, keep: tuple[str, ...] = ("page_id",), markup: str = "html") -> DataFrame:
    """One row per page: the kept columns, ``nodes`` and ``tokens``."""
    ship(pages.sparkSession)
    kept = pages.select(*keep, markup)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Small slices keep the Python heap flat whatever the page sizes.
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                sources = part.column(part.num_columns - 1).to_pylist()
                nodes, tokens = _to_arrow([parse(s or "") for s in sources])
                columns = [part.column(i) for i in range(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(
                    [*columns, nodes, tokens], names=[*keep, "nodes", "tokens"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]]
    schema = ", ".join([*fields, f"nodes array<{NODE_TYPE}>", f"tokens array<{TOKEN_TYPE}>"])
    return kept.mapInArrow(convert, schema)


def node_text(node: Column, tokens: Column) -> Column:
    """All text below an element, collapsed."""
    part = F.slice(tokens, node["tok_from"] + 1, node["tok_to"] - node["tok_from"])
    return F.array_join(part["text"], " ")


def identity(node: Column) -> Column:
    return F.concat(node["id_attr"], F.lit(" "), node["class_attr"])


def nearest_marked(nodes: Column, marks: Column) -> Column:
    """Per element the id of the nearest marked strict ancestor, -1 if there is none.

    Every element's link starts at its parent and, while no marked element stops it, is replaced by
    the link of where it points: links double in length, so a page takes log2(depth) passes over its
    elements, however deep it is. ``marks`` should be a lambda variable.
    """
    def double(links, _):
        return F.transform(links, lambda j: F.when((j < 0) | F.get(marks, j), j).otherwise(F.get(links, j)))

    # A number of k binary digits is below 2 to the power of k.
    passes = F.coalesce(F.length(F.bin(F.array_max(nodes["depth"]))), F.lit(0))
    # Behind the last pass a link ends at a marked element or above the root.
    return F.aggregate(F.array_repeat(F.lit(0), passes), nodes["parent"], double)


def nearest_above(nodes: Column, test) -> Column:
    """The same for the elements that pass ``test``."""
    return let(F.transform(nodes, lambda n: F.coalesce(test(n), F.lit(False))), lambda marks: nearest_marked(nodes, marks))


def is_below(node: Column, nearest: Column) -> Column:
    """Has the element a strict ancestor among those that ``nearest`` was made from?"""
    return F.get(nearest, node["id"]) >= 0


#: Ancestors up to this depth are looked up one by one; more of them by one pass over the elements before.
_FEW = 64


def chain_of(node: Column, nodes: Column) -> Column:
    """Ids of the strict ancestors, the root first."""
    def up(ids, _):
        return F.concat(F.array(F.get(nodes, F.get(ids, F.lit(0)))["parent"]), ids)

    near = F.aggregate(F.array_repeat(F.lit(0), node["depth"]), F.array(node["id"]), up)
    far = F.filter(F.slice(nodes, 1, node["id"]), lambda a: a["last"] >= node["id"])["id"]
    return F.when(node["depth"] > _FEW, far).otherwise(F.slice(near, 1, node["depth"]))


def node_path(node: Column, nodes: Column) -> Column:
    """/html/body/p[2]: the index appears only where the tag repeats among siblings."""
    def part(n):
        index = F.when(n["same"] > 1, F.format_string("[%d]", n["nth"])).otherwise("")
        return F.concat(F.lit("/"), n["tag"], index)

    line = F.concat(chain_of(node, nodes), F.array(node["id"]))
    return F.array_join(F.transform(line, lambda a: part(F.get(nodes, a))), "")


def path_to_css(path: Column) -> Column:
    steps = F.split(F.trim(path, F.lit("/")), "/")
    return F.array_join(
        F.transform(steps, lambda s: F.regexp_replace(s, r"\[(\d+)\]", ":nth-of-type($1)")), " > ")


def node_table(trees: DataFrame, *keys: str) -> DataFrame:
    """One row per element, with its text. Subtree text repeats at every level."""
    keys = keys or ("page_id",)
    rows = trees.select(*keys, F.transform("nodes", lambda n: F.struct(
        n.alias("n"), node_text(n, F.col("tokens")).alias("text"))).alias("rows"))
    return unfold(rows, keys, F.col("rows")).select(*keys, "n.*", "text")
