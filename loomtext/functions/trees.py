"""Equivalence of subtrees by bottom-up structural hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F

from . import batches
from .dom import Node, parse


def classify(root: Node, attributes: tuple[str, ...] | None = None, skip_tags: frozenset[str] = frozenset(), with_text: bool = True) -> list[dict]:
    """Rows of the element nodes: node_id, tag, height, arity, head, tree.

    ``head`` names a node by tag, chosen attributes (all where None, but ids) and own text;
    ``tree`` names it with its children, so equal names mean equal subtrees. Without text the
    classification is the light one, by structure alone.
    """
    rows: list[dict] = []

    # nodes that are being worked through: their row, head, children left, and trees and heights of those done
    stack: list[tuple[dict, str, Iterator[Node], list[str], list[int]]] = []

    def enter(node: Node) -> None:
        rows.append({"node_id": len(rows), "tag": node.tag})
        kept = sorted((k, v) for k, v in node.attrs.items() if (k != "id" if attributes is None else k in attributes))
        own = " ".join("".join(x for x in node.items if isinstance(x, str)).split()) if with_text else ""
        head = hashlib.md5(repr((node.tag, kept, own)).encode()).hexdigest()
        stack.append((rows[-1], head, iter([x for x in node.items if isinstance(x, Node) and x.tag not in skip_tags]), [], []))

    enter(root)
    while stack:
        me, head, left, trees, heights = stack[-1]
        child = next(left, None)
        if child is not None:
            enter(child)
            continue
        stack.pop()
        tree = hashlib.md5((head + "".join(trees)).encode()).hexdigest()
        me.update(height=1 + max(heights, default=-1), arity=len(trees), head=head, tree=tree)
        if stack:
            stack[-1][3].append(tree)
            stack[-1][4].append(me["height"])
    return rows


def tree_classes(pages: DataFrame, page: str = "html", page_id: str = "page_id", with_text: bool = True) -> DataFrame:
    """page_id, node_id, tag, height, arity, head, tree of all element nodes."""

    def of(key, p: str | None) -> Iterator[tuple]:
        return ((key, *n.values()) for n in ([] if p is None else classify(parse(p), with_text=with_text)))

    kind = pages.schema[page_id].dataType.simpleString()
    return batches.rows(pages.select(page_id, page), of, f"page_id {kind}, node_id int, tag string, height int, arity int, head string, tree string")


def class_sizes(classes: DataFrame) -> DataFrame:
    """tree, tag, members: how many nodes each equivalence class has."""
    return classes.groupBy("tree", "tag").agg(F.count(F.lit(1)).alias("members"))


def differing_children(left: Column, right: Column) -> Column:
    """Positions (from 1) at which two arrays of children's classes differ; null where lengths differ."""
    zipped = F.zip_with(left, right, lambda a, b: ~a.eqNullSafe(b))
    places = F.filter(F.transform(zipped, lambda x, i: F.when(x, i + 1)), lambda x: x.isNotNull())
    return F.when(F.size(left) == F.size(right), places)
