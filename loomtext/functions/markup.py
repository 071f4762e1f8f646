"""Normalising, purifying and token-marking of XML documents with mathematics.

All functions work on the tree of :mod:`loomtext.functions.dom`; the column wrappers give
NULL for documents that aren't well-formed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from . import batches
from .dom import Node, deep, escape, parse
from .sentences import ABBREVIATIONS, split

UNSUPPORTED = frozenset(("acronym", "anchor", "rule", "note"))
METADATA = frozenset("abstract title toctitle creator keywords classification acknowledgements bibliography".split())
_TEXTUAL = frozenset("td caption contact date personname quote title toctitle p".split())
_NESTED = re.compile(r"m\d+\.m\d+")


def text_of(node: Node) -> str:
    """All text below a node."""
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, Node):
            todo += reversed(x.items)
        else:
            out.append(x)
    return "".join(out)


def serialize(node: Node) -> str:
    """A canonical string of a subtree."""
    out: list[str] = []
    # a node with the place of its opening tag waits below its items until they are written
    todo: list[tuple[Node | str, int]] = [(node, -1)]
    while todo:
        x, opened = todo.pop()
        if isinstance(x, str):
            if x:
                out.append(escape(x))
        elif opened < 0:
            todo.append((x, len(out)))
            todo += [(y, -1) for y in reversed(x.items)]
            out.append(f"<{x.tag}" + "".join(f' {k}="{escape(v)}"' for k, v in x.attrs.items()))
        else:
            empty = len(out) == opened + 1
            out[opened] += "/>" if empty else ">"
            if not empty:
                out.append(f"</{x.tag}>")
    return "".join(out)


def mark_of(element_id: str, doc: str) -> str:
    """A position mark: parts after dots that begin with a digit get a p, parts without a final digit a 0."""
    parts = element_id.split(".")
    parts = parts[:1] + [f"p{x}" if x[:1].isdigit() else x for x in parts[1:]]
    parts = [x if x[-1:].isdigit() or i == len(parts) - 1 else x + "0" for i, x in enumerate(parts)]
    return f"{doc}-{'-'.join(parts)}"


@dataclass
class Normalized:
    """A document with marks for mathematics, citations and references, and what they stand for."""

    root: Node
    mode: str = "position"
    doc: str = "doc0"
    table: dict[str, str] = field(default_factory=dict)
    _syntax: dict[tuple[str, str], int] = field(default_factory=dict)

    def entry(self, mark: str) -> str | None:
        """The serialised node that a mark word replaced."""
        return self.table.get(mark.strip().rstrip(")"))

    def elements(self, tag: str) -> list[str]:
        """Trimmed texts of all elements with a tag."""
        return [_trim(text_of(x)) for x in self.root.walk() if x.tag == tag]

    @deep
    def body(self) -> str:
        """Text of the paragraphs outside of metadata."""
        out: list[str] = []

        def visit(node: Node) -> None:
            for x in node.items:
                if isinstance(x, Node) and x.tag not in METADATA:
                    if x.tag == "p":
                        out.append(text_of(x))
                    else:
                        visit(x)

        visit(self.root)
        return _trim(" ".join(t for t in out if t.strip()))

    def text(self) -> str:
        return _trim(text_of(self.root))


def _trim(text: str) -> str:
    return re.sub(r"\s\s+", " ", text).strip()


@deep
def normalize(root: Node, mode: str = "position", doc: str = "doc0") -> Normalized:
    """Marks in place of equations, inline mathematics, citations and references; unsupported tags go.

    ``position`` marks are made from element ids, ``syntax`` marks number the distinct
    serialised nodes, ``generic`` marks are the bare word.
    """
    out = Normalized(root, mode, doc if doc[-1:].isdigit() else doc + "0")
    numbers = {"ourcitation": 0, "ourreference": 0, "fake": 0}

    def word(kind: str, node: Node) -> str:
        if mode == "generic":
            return kind
        if mode == "syntax":
            family = "MathExpr" if kind.startswith("Math") else kind
            body = re.sub(r"\s+", " ", serialize(node).replace("\n", ""))
            number = out._syntax.get((family, body))
            if number is None:
                number = out._syntax[family, body] = numbers[family] = numbers.get(family, 0) + 1
            mark = f"{kind}-{number}"
        elif kind in numbers:
            mark = f"{kind}-{out.doc}-{kind[3]}{numbers[kind]}"
            numbers[kind] += 1
        else:
            own = next((x.attrs["id"] for x in node.walk() if x.tag in ("equationgroup", "equation", "math") and x.attrs.get("id")), None)
            if own is None and kind == "MathExprEquation" and not any(x.tag == "math" for x in node.walk()):
                numbers["fake"] += 1
                own = f"fake{numbers['fake']}"
            mark = f"{kind}-{mark_of(own, out.doc)}" if own else f"{kind}-NoID"
        out.table[mark] = serialize(node)
        return mark

    def visit(node: Node, textual: bool) -> None:
        items: list = []
        for x in node.items:
            if not isinstance(x, Node):
                items.append(x)
            elif x.tag in UNSUPPORTED or x.tag == "#comment":
                continue
            elif x.tag == "break":
                items.append("\n")
            elif x.tag in ("equationgroup", "equation"):
                p = Node("p", {}, node)
                p.items.append(f" {word('MathExprEquation', x)} ")
                items.append(p)
            elif x.tag == "math" and textual and not _NESTED.search(x.attrs.get("id", "")):
                items.append(f" {word('MathExpr', x)}")
            elif x.tag == "cite" and textual:
                items.append(f" {word('ourcitation', x)} ")
            elif x.tag == "ref" and textual:
                items.append(f" {word('ourreference', x)} ")
            else:
                visit(x, textual or x.tag in _TEXTUAL)
                items.append(x)
        node.items = items

    visit(root, False)
    return out


#: Operator names that stay one token in mathematics.
OPERATORS = frozenset("sin cos tan cot sec csc arcsin arccos arctan sinh cosh tanh coth exp log ln lim liminf limsup sup inf max min arg det dim gcd hom ker deg mod sgn tr rank diag".split())


@deep
def purify(root: Node, text_math: bool = True, complex_tokens: bool = True, math_text: bool = True, merge: bool = True, words: frozenset[str] = frozenset()) -> Node:
    """Four rewrites: text to math, spelt-out tokens joined, words out of math, neighbours merged."""
    from .markup_rules import demote_text, join_tokens, merge_math, promote_text

    if text_math:
        promote_text(root)
    if complex_tokens:
        join_tokens(root, OPERATORS | words)
    if math_text:
        demote_text(root)
    if merge:
        merge_math(root)
    return root


_TOKEN = re.compile(r"MathExpr(?:Equation)?[\w-]*|our(?:citation|reference)[\w-]*|[^\W_]+(?:[-'][^\W_]+)*|[^\w\s]|_")


def kind_of(token: str) -> str:
    first = token[:1]
    if first not in ("M", "o"):
        return "word" if first.isalnum() else "punct"
    if token.startswith("MathExpr"):
        return "formula"
    if token.startswith("ourcitation"):
        return "citation"
    if token.startswith("ourreference"):
        return "reference"
    return "word"


def mark_tokens(text: str) -> list[dict]:
    """Rows of the marked tokens of a normalised text: sentence, token id, kind, text; ids from 1."""
    found = [(s, t) for s, (a, b) in enumerate(split(text, ABBREVIATIONS), 1) for t in _TOKEN.findall(text, a, b + 1)]
    return [{"sentence": s, "token": n, "kind": kind_of(t), "text": t} for n, (s, t) in enumerate(found, 1)]


def normalized_body(doc: Column, mode: str = "position") -> Column:
    """Body text of XML documents with marks."""

    return batches.each(doc, lambda d: _body(d, mode), "string")


def _body(doc: str | None, mode: str = "position") -> str | None:
    root = parse(doc, strict=True)
    return None if root is None else normalize(root, mode).body()


def tokens_of(docs: DataFrame, doc: str = "doc", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, sentence, token, kind, text: the marked tokens of the bodies of XML documents."""

    def of(ids: list, bodies: list[str | None]) -> Iterator[tuple]:
        # numbers of the documents and their sentences, and tokens of each sentence
        doc, sentence, many, found = [], [], [], []
        for k, d in enumerate(bodies):
            body = _body(d) or ""
            for s, (a, b) in enumerate(split(body, ABBREVIATIONS), 1):
                words = _TOKEN.findall(body, a, b + 1)
                doc.append(k)
                sentence.append(s)
                many.append(len(words))
                found += words
        at = np.repeat(np.array(doc, np.int64), many)
        text = pa.array(found, pa.string())
        distinct = text.dictionary_encode()
        kinds = pa.array([kind_of(t) for t in distinct.dictionary.to_pylist()], pa.string()).take(distinct.indices)
        first = np.searchsorted(at, np.arange(len(ids)))
        yield pa.array(ids, key).take(pa.array(at)), np.repeat(np.array(sentence, np.int32), many), (np.arange(len(at)) - first[at] + 1).astype(np.int32), kinds, text

    key = to_arrow_type(docs.schema[doc_id].dataType)
    return batches.columns(docs.select(doc_id, doc), of, f"{doc_id} {docs.schema[doc_id].dataType.simpleString()}, sentence int, token int, kind string, text string")


def marks(doc: Column, mode: str = "position") -> Column:
    """Array of (mark, node) of XML documents, for look-up by join."""

    def one(d: str | None) -> list[dict] | None:
        root = parse(d, strict=True)
        return None if root is None else [{"mark": k, "node": v} for k, v in normalize(root, mode).table.items()]

    return batches.each(doc, one, "array<struct<mark:string,node:string>>")


def marked_tokens(text: Column) -> Column:
    """Array of marked tokens of normalised texts."""

    return batches.each(text, lambda t: mark_tokens(t or ""), "array<struct<sentence:int,token:int,kind:string,text:string>>")
