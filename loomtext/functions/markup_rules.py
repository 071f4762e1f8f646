"""The rewrites of :func:`loomtext.functions.markup.purify`."""

from __future__ import annotations

import re

from .dom import Node

_CONSONANTS = "bcdfghjklmnpqrstvwxz"
_MATH = re.compile(
    rf"[0-9]+|[0-9]*\.[0-9]+|[0-9]+/[0-9]+|\S*[<>=+*]\S*|[b-hj-zB-HJ-Z]|[{_CONSONANTS}]{{2,3}}|[{_CONSONANTS}][{_CONSONANTS.upper()}]|[{_CONSONANTS}]yr"
)
_TEXTUAL = frozenset("p td caption title quote".split())


def is_math_word(word: str) -> bool:
    return bool(_MATH.fullmatch(word))


def _token(char: str, parent: Node) -> Node:
    role = "NUMBER" if re.fullmatch(r"[0-9.]+", char) else "UNKNOWN"
    node = Node("xmtok", {"role": role, "meaning": char} if role == "NUMBER" else {"role": role}, parent)
    node.items.append(char)
    return node


def promote_text(root: Node) -> None:
    """Words of running text that look like mathematics become math nodes with one token each part."""
    count = 0
    for node in list(root.walk()):
        if node.tag not in _TEXTUAL:
            continue
        items: list = []
        for x in node.items:
            if isinstance(x, Node):
                items.append(x)
                continue
            for piece in re.split(r"(\s+)", x):
                word = piece.rstrip(".,;:?!)")
                if not word or not is_math_word(word):
                    items.append(piece)
                    continue
                count += 1
                math = Node("math", {"id": f"purify.m{count}", "mode": "inline", "tex": word}, node)
                body = Node("xmath", {}, math)
                body.items += [_token(t, body) for t in re.findall(r"[0-9.]+|.", word)]
                math.items.append(body)
                items += [math, piece[len(word) :]] if piece[len(word) :] else [math]
        merged: list = []
        for x in items:
            if merged and isinstance(x, str) and isinstance(merged[-1], str):
                merged[-1] += x
            else:
                merged.append(x)
        node.items = merged


def _letter(x: object) -> bool:
    return isinstance(x, Node) and x.tag == "xmtok" and len(x.items) == 1 and isinstance(x.items[0], str) and x.items[0].isalpha() and x.items[0].isascii()


def join_tokens(root: Node, known: frozenset[str]) -> None:
    """Runs of letter tokens that spell a known word, or four letters with a vowel and more, become one token."""
    for node in list(root.walk()):
        if node.tag not in ("xmath", "xmarg", "xmwrap", "xmapp"):
            continue
        items: list = []
        run: list[Node] = []

        def flush() -> None:
            word = "".join(t.items[0] for t in run)
            spelt = len(run) > 1 and (word.lower() in known or (len(word) > 3 and word.islower() and any(c in "aeiou" for c in word)))
            if spelt:
                one = Node("xmtok", {"role": "UNKNOWN", "meaning": "UNKNOWN", "font": run[0].attrs.get("font", "italic")}, run[0].parent)
                one.items.append(word)
                items.append(one)
            else:
                items.extend(run)
            run.clear()

        for x in node.items:
            if _letter(x):
                run.append(x)
            else:
                flush()
                items.append(x)
        flush()
        node.items = items


def _space(x: object) -> bool:
    return isinstance(x, Node) and x.tag == "xmhint"


def demote_text(root: Node) -> None:
    """A math node whose tokens are one word between space hints becomes text."""
    for node in list(root.walk()):
        for i, x in enumerate(node.items):
            if not isinstance(x, Node) or x.tag != "math":
                continue
            inner = [y for w in x.items if isinstance(w, Node) and w.tag == "xmath" for y in w.items if isinstance(y, Node)]
            hints, words = [y for y in inner if _space(y)], [y for y in inner if not _space(y)]
            if hints and words and all(_letter(y) for y in words) and _space(inner[0]) and _space(inner[-1]):
                node.items[i] = " " + "".join(y.items[0] for y in words) + " "


def merge_math(root: Node) -> None:
    """Neighbouring math nodes become one; equations without mathematics are unwrapped."""
    for node in list(root.walk()):
        items: list = []
        for x in node.items:
            if isinstance(x, Node) and x.tag == "equation" and not any(y.tag == "math" for y in x.walk()):
                items.extend(x.items)
            elif isinstance(x, Node) and x.tag == "math" and items and isinstance(items[-1], Node) and items[-1].tag == "math":
                bodies = [w for w in items[-1].items if isinstance(w, Node) and w.tag == "xmath"]
                if bodies:
                    bodies[-1].items += [y for w in x.items if isinstance(w, Node) and w.tag == "xmath" for y in w.items]
                    items[-1].attrs["tex"] = items[-1].attrs.get("tex", "") + x.attrs.get("tex", "")
                else:
                    items.append(x)
            else:
                items.append(x)
        node.items = items
