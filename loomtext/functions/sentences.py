"""Sentence splitter: a state machine over characters, run in Arrow batches.

A sentence ends at ``.``, ``?``, ``!``, at an empty line, and at a line break before a
capitalised function word. Dots don't end one before a lower-case letter, after an
abbreviation or an initial, or alone in quotes or brackets. Ranges are inclusive and trimmed;
a range without a letter or digit isn't emitted.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F

from . import batches
from .stopwords import EXTENDED

_STOP = frozenset(EXTENDED)
ABBREVIATIONS = frozenset("approx assoc cf ch chap conj cor corp def dept dr e.g ed eds eq eqn eqs etc ex fig figs gen i.e inc jr lem lemma ltd max min mr mrs ms no nos nr p pp prof prop ref refs resp sec sect sen sr st thm thms univ viz vol vols vs".split())
_TAIL = re.compile(r"(?:^|[^A-Za-z.])([A-Za-z](?:[A-Za-z.]*[A-Za-z])?)$")
_SIGN, _CONTENT = re.compile(r"[.?!\n]"), re.compile(r"[^\W_]")
_NEXT = re.compile(r"[A-Za-z]{1,19}")
_LONE_MATH = re.compile(r"\s*MathFormula\s*\n")
_PAIRED = {'"': '"', "[": "]", "(": ")", "{": "}"}


def _word_at(text: str, i: int) -> str:
    m = _NEXT.match(text, i)
    return m.group() if m else ""


def _skip(text: str, i: int) -> int:
    while i < len(text) and text[i].isspace():
        i += 1
    return i


def split(text: str | None, abbreviations: frozenset[str] = ABBREVIATIONS) -> list[tuple[int, int]]:
    """Inclusive (start, end) ranges of the sentences of a text."""
    if not text:
        return []
    found: list[tuple[int, int]] = []
    start, content, i, n = 0, False, 0, len(text)

    def close(end: int) -> None:
        """Emit start..end, end exclusive, if it has content."""
        nonlocal start, content
        if content:
            a, b = start, end
            while a < b and text[a].isspace():
                a += 1
            while b > a and text[b - 1].isspace():
                b -= 1
            if b > a:
                found.append((a, b - 1))
        start, content = end, False

    while True:
        sign = _SIGN.search(text, i)
        at = sign.start() if sign else n
        content = content or _CONTENT.search(text, i, at) is not None
        if sign is None:
            break
        i, c = at, sign.group()
        if c != "\n":
            enclosed = 0 < i < n - 1 and _PAIRED.get(text[i - 1]) == text[i + 1]
            if not enclosed and (c != "." or _dot_ends(text, i, abbreviations)):
                close(i + 1)
        else:
            if i and text[i - 1] == "\n":
                m = _LONE_MATH.match(text, i + 1)
                after = _skip(text, m.end() if m else i + 1)
                word = _word_at(text, after)
                if m:
                    content_before = content
                    content = True
                    if not content_before or text[after : after + 1].isupper():
                        close(after)
                    i = after
                    continue
                if not (word[:1].islower() and word in _STOP):
                    close(after)
                    i = after
                    continue
            else:
                word = _word_at(text, _skip(text, i + 1))
                if word[:1].isupper() and word.lower() in _STOP:
                    close(i + 1)
        i += 1
    close(n)
    return found


def _dot_ends(text: str, i: int, abbreviations: frozenset[str]) -> bool:
    after = _skip(text, i + 1)
    if after >= len(text):
        return True
    if not text[after].isupper():
        return False
    if _word_at(text, after).lower() in _STOP:
        return True
    tail = _TAIL.search(text, max(0, i - 9), i)
    if tail and tail.group(1).lower() in abbreviations:
        return False
    initial = i > 0 and text[i - 1].isalpha() and text[i - 1] != "I" and (i == 1 or not text[i - 2].isalnum())
    return not initial


_RANGES = "array<struct<start:int,end:int>>"


def sentence_ranges(text: Column, more_abbreviations: tuple[str, ...] = ()) -> Column:
    """Array of (start, end) ranges, 0-based and inclusive."""
    known = ABBREVIATIONS | frozenset(a.lower() for a in more_abbreviations)

    return batches.each(text, lambda t: [{"start": a, "end": b} for a, b in split(t, known)], _RANGES)


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, sent_id (from 0), start, end, digest: the sentences of each text with the MD5 of their characters."""

    def of(key, t: str | None) -> Iterator[tuple]:
        return ((key, i, a, b, hashlib.md5(t[a : b + 1].encode()).hexdigest()) for i, (a, b) in enumerate(split(t)))

    return batches.rows(docs.select(doc_id, text), of, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, sent_id int, start int, end int, digest string")


def range_text(text: Column, start: Column, end: Column) -> Column:
    """The characters of an inclusive range."""
    return F.substring(text, start + 1, end - start + 1)
