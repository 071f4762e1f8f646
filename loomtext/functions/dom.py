"""HTML and XHTML to text, nodes and paragraphs.

A page is parsed once into a flat list of nodes in document order, with character offsets into
the plain text of the page. Strict XML is tried first, then lenient HTML. Scripts and styles
never contribute text.
"""

from __future__ import annotations

import functools
import html as entities
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from xml.etree import ElementTree

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from . import batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SILENT = frozenset(("script", "style", "head"))
#: Tags that end an open paragraph or list item in lenient parsing.
_BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


@dataclass
class Node:
    tag: str
    attrs: dict[str, str]
    parent: Node | None
    items: list = field(default_factory=list)

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def walk(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += [x for x in reversed(node.items) if isinstance(x, Node)]


def deep(run):
    """``run`` with room for recursion as deep as any page's elements are nested."""

    @functools.wraps(run)
    def wrapped(*args, **kwargs):
        before = sys.getrecursionlimit()
        sys.setrecursionlimit(max(before, 5_000_000))
        try:
            return run(*args, **kwargs)
        finally:
            sys.setrecursionlimit(before)

    return wrapped


class _Lenient(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#document", {}, None)
        self.at = self.root

    def handle_starttag(self, tag, attrs):
        closes = _SELF.get(tag) or ({"p"} if tag in _BLOCKS else set())
        if closes:
            x = self.at
            while x.parent is not None and x.tag not in ("table", "ul", "ol", "dl", "body", "div", "section"):
                if x.tag in closes:
                    self.at = x.parent
                    break
                x = x.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.items.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        x = self.at
        while x.parent is not None:
            if x.tag == tag:
                self.at = x.parent
                return
            x = x.parent

    def handle_data(self, data):
        self.at.items.append(data)


def _from_xml(top: ElementTree.Element, parent: Node | None) -> Node:
    def made(e: ElementTree.Element, parent: Node | None) -> Node:
        node = Node(e.tag.rpartition("}")[2].lower() if isinstance(e.tag, str) else "#comment", {k.rpartition("}")[2]: v for k, v in e.attrib.items()}, parent)
        if e.text and node.tag != "#comment":
            node.items.append(e.text)
        return node

    root = made(top, parent)
    todo = [(top, root)]
    while todo:
        e, node = todo.pop()
        for child in e:
            node.items.append(made(child, node))
            todo.append((child, node.items[-1]))
            if child.tail:
                node.items.append(child.tail)
    return root


def parse(page: str | None, strict: bool = False) -> Node | None:
    """The tree of a page; None for null, or for malformed XML in strict mode."""
    if page is None:
        return None
    try:
        body = re.sub(r"<!DOCTYPE[^>]*>", "", page, count=1)
        root = Node("#document", {}, None)
        root.items.append(_from_xml(ElementTree.fromstring(body), root))
        return root
    except (ElementTree.ParseError, ValueError):
        if strict:
            return None
    parser = _Lenient()
    parser.feed(page)
    parser.close()
    return parser.root


@dataclass
class Options:
    """What text extraction does with special elements: ``keep``, ``normalize`` or ``skip``."""

    math: str = "keep"
    cite: str = "keep"
    tables: str = "keep"
    table_tokens: bool = False
    drop_notes: bool = False


def flatten(root: Node, options: Options = Options(), spans: dict[int, tuple[int, int]] | None = None) -> tuple[str, list[dict]]:  # noqa: B008
    """Plain text below a node, and rows of its element nodes with offsets (end exclusive).

    ``spans`` gets the offsets of every node, left out or replaced ones too, by ``id(node)``.
    """
    out: list[str] = []
    rows: list[dict] = []
    size = 0
    # nodes that are being worked through, with their remaining items; pages may nest deeper than calls can
    stack: list[tuple[Iterator, dict, Node]] = []

    def put(text: str) -> None:
        nonlocal size
        out.append(text)
        size += len(text)

    def replaced(node: Node) -> str | None:
        """What stands for a node; None for one that is worked through."""
        if node.tag in _SILENT or node.tag == "#comment":
            return ""
        classes = node.classes()
        if node.tag == "math" and options.math != "keep":
            return " MathFormula " if options.math == "normalize" else ""
        if node.tag == "cite" and options.cite != "keep":
            return " CiteExpression " if options.cite == "normalize" else ""
        if node.tag == "table" and options.tables != "keep":
            if options.tables == "normalize":
                if {"ltx_equation", "ltx_equationgroup"} & set(classes):
                    return " MathFormula "
                if options.table_tokens:
                    return " TableStructure "
            return ""
        if options.drop_notes and {"ltx_note_mark", "ltx_note_outer"} & set(classes):
            return ""
        return None

    def enter(node: Node, parent_id: int, depth: int) -> None:
        text = replaced(node)
        if text is not None:
            if spans is not None:
                spans[id(node)] = (size, size + len(text))
            put(text)
            return
        rows.append({"node_id": len(rows), "parent_id": parent_id, "tag": node.tag, "class": node.attrs.get("class"), "depth": depth, "start": size, "end": size})
        stack.append((iter(node.items), rows[-1], node))

    enter(root, -1, 0)
    while stack:
        items, row, node = stack[-1]
        for x in items:
            if isinstance(x, Node):
                enter(x, row["node_id"], row["depth"] + 1)
                break
            put(x)
        else:
            row["end"] = size
            if spans is not None:
                spans[id(node)] = (row["start"], size)
            stack.pop()
    return "".join(out), rows


@dataclass
class Step:
    tag: str
    class_name: str | None
    anywhere: bool


def parse_path(path: str) -> list[Step]:
    """Steps of a path like ``//section.ltx_section//div.ltx_para`` or ``//p``."""
    steps = []
    for sep, tag, _, cls in re.findall(r"(//?)([\w*-]+)(\.([\w-]+))?", path):
        steps.append(Step(tag, cls or None, sep == "//"))
    return steps


def select(root: Node, path: str) -> list[Node]:
    """Nodes of a path in document order. A class must be the whole attribute."""
    level = [root]
    for step in parse_path(path):
        found, seen = [], set()
        for node in level:
            pool = (x for x in node.walk() if x is not node) if step.anywhere else (x for x in node.items if isinstance(x, Node))
            for x in pool:
                if id(x) not in seen and step.tag in ("*", x.tag) and (step.class_name is None or x.attrs.get("class") == step.class_name):
                    seen.add(id(x))
                    found.append(x)
        level = found
    return level


def first_nonempty(root: Node, paths: tuple[str, ...]) -> list[Node]:
    """The nodes of the first path that has any: the strict selection, else the relaxed ones."""
    for path in paths:
        found = select(root, path)
        if found:
            return found
    return []


PARAGRAPHS = ("//section.ltx_section//div.ltx_para", "//div.ltx_para", "//p")


def is_definition(node: Node) -> bool:
    """Whether the parent is a div with a class that holds ``ltx_theorem_def``."""
    p = node.parent
    return p is not None and p.tag == "div" and "ltx_theorem_def" in p.attrs.get("class", "")


def plain_text(page: Column, **options) -> Column:
    """Plain text of pages; null stays null."""
    opt = Options(**options)

    return batches.each(page, lambda p: None if p is None else flatten(parse(p), opt)[0], "string")


def nodes(pages: DataFrame, page: str = "html", page_id: str = "page_id", **options) -> DataFrame:
    """The node table: page_id, node_id, parent_id, tag, class, depth, start, end."""
    opt = Options(**options)

    def of(key, p: str | None) -> Iterator[tuple]:
        return ((key, *n.values()) for n in ([] if p is None else flatten(parse(p), opt)[1]))

    kind = _kind(pages, page_id)
    return batches.rows(pages.select(page_id, page), of, f"page_id {kind}, node_id int, parent_id int, tag string, class string, depth int, start int, end int")


def _kind(pages: DataFrame, column: str) -> str:
    return pages.schema[column].dataType.simpleString()


def page_paragraphs(pages: DataFrame, page: str = "html", page_id: str = "page_id", paths: tuple[str, ...] = PARAGRAPHS, **options) -> DataFrame:
    """page_id, para_id (from 1), label (1 in a definition, else -1), text; texts of under 2 characters are left out."""
    opt = Options(**options)

    def of(key, p: str | None) -> Iterator[tuple]:
        found = [] if p is None else first_nonempty(parse(p), paths)
        rows = ((1 if is_definition(x) else -1, flatten(x, opt)[0]) for x in found)
        return ((key, i, a, t) for i, (a, t) in enumerate(((a, t) for a, t in rows if len(t) >= 2), 1))

    return batches.rows(pages.select(page_id, page), of, f"page_id {_kind(pages, page_id)}, para_id int, label int, text string")


def node_at(node_table: DataFrame, offsets: DataFrame) -> DataFrame:
    """Deepest node around each (page_id, offset): an equi-join on the page with a range residual."""
    o = offsets.select(F.col("page_id").alias("p"), "offset")
    hit = o.join(node_table, (F.col("p") == F.col("page_id")) & (F.col("start") <= F.col("offset")) & (F.col("offset") < F.col("end")))
    return hit.groupBy("page_id", "offset").agg(F.max(F.struct("depth", "node_id")).alias("m")).select("page_id", "offset", F.col("m.node_id").alias("node_id"))


def nodes_at(pages: DataFrame, pattern: str, page: str = "html", page_id: str = "page_id", **options) -> DataFrame:
    """``node_at`` for every match of ``pattern`` in the plain text, page by page without a join: page_id, offset, node_id."""
    opt = Options(**options)

    def of(key, p: str | None) -> Iterator[tuple]:
        text, rows = ("", []) if p is None else flatten(parse(p), opt)
        deepest = np.full(len(text), -1, np.int32)
        # a deeper node overwrites what it covers
        for n in sorted(rows, key=lambda n: (n["depth"], n["node_id"])):
            deepest[n["start"] : n["end"]] = n["node_id"]
        at = np.fromiter((m.start() for m in re.finditer(pattern, text, re.ASCII)), np.int32)
        at = at[deepest[at] >= 0]
        return ((key, o, n) for o, n in zip(at.tolist(), deepest[at].tolist()))

    return batches.rows(pages.select(page_id, page), of, f"page_id {_kind(pages, page_id)}, offset int, node_id int")


def node_around(node_table: DataFrame, ranges: DataFrame) -> DataFrame:
    """Deepest node that holds each (page_id, from, to), end exclusive."""
    r = ranges.select(F.col("page_id").alias("p"), "from", "to")
    hit = r.join(node_table, (F.col("p") == F.col("page_id")) & (F.col("start") <= F.col("from")) & (F.col("end") >= F.col("to")))
    return hit.groupBy("page_id", "from", "to").agg(F.max(F.struct("depth", "node_id")).alias("m")).select("page_id", "from", "to", F.col("m.node_id").alias("node_id"))


def node_text(text: Column, start: Column, end: Column) -> Column:
    """A node's own part of the plain text."""
    return F.substring(text, start + 1, end - start)


def has_class(class_attr: Column, name: str) -> Column:
    """Whether a class attribute holds a token."""
    return F.coalesce(F.array_contains(F.split(class_attr, r"\s+"), name), F.lit(False))


def escape(text: str) -> str:
    return entities.escape(text, quote=False)


@deep
def mark_sentences(page: str, options: Options = Options()) -> str:  # noqa: B008
    """The page with each sentence of its text in ``span.ltx_sentence``.

    A sentence is wrapped where its range covers whole children and parts of text of one
    parent; one that would cut an element stays as it is.
    """
    from .sentences import split

    root = parse(page)
    count = 0
    spans: dict[int, tuple[int, int]] = {}
    whole_text, _ = flatten(root, options, spans)

    def piece_of(node: Node) -> str:
        # what lies in a part left out has no place in the whole text
        return whole_text[slice(*spans[id(node)])] if id(node) in spans else flatten(node, options)[0]

    def render(node: Node) -> str:
        nonlocal count
        if node.tag in ("#comment",):
            return ""
        parts, text = [], ""
        for x in node.items:
            piece = piece_of(x) if isinstance(x, Node) else x
            parts.append((len(text), len(text) + len(piece), x))
            text += piece
        opens, closes = {}, {}
        if node.tag not in _SILENT and any(not isinstance(x, Node) and x.strip() for _, _, x in parts):
            for a, b in split(text):
                whole = all(not isinstance(x, Node) or y <= a or x0 > b or (a <= x0 and y <= b + 1) for x0, y, x in parts)
                if whole:
                    count += 1
                    opens[a], closes[b + 1] = f'<span class="ltx_sentence" id="sentence.{count}">', "</span>"
        out = []
        for a, b, x in parts:
            if isinstance(x, Node):
                out.append((closes.pop(a, "") + opens.pop(a, "")) + render(x) + (closes.pop(b, "") if b > a else ""))
                continue
            last = a
            for k in sorted({*(k for k in opens if a <= k < b), *(k for k in closes if a < k <= b)}):
                out += [escape(x[last - a : k - a]), closes.pop(k, ""), opens.pop(k, "")]
                last = k
            out.append(escape(x[last - a :]))
        inner = "".join(out)
        if node.tag == "#document":
            return inner
        attrs = "".join(f' {k}="{entities.escape(v)}"' for k, v in node.attrs.items())
        return f"<{node.tag}{attrs}>" if node.tag in VOID else f"<{node.tag}{attrs}>{inner}</{node.tag}>"

    return render(root)


def with_sentences(page: Column) -> Column:
    """Pages with their sentences marked; null stays null."""

    return batches.each(page, lambda p: None if p is None else mark_sentences(p), "string")
