"""Licence scan by ordered signature rules.

Words are the runs of ASCII letters and digits and characters beyond ASCII, after A-Z is
lower-cased. Word hashes of whole texts settle, vectorised, which texts hold a *base phrase*
and which hold all gate words of any rule; only the latter are decoded and matched, rule by
rule in order. A rule's gates are derived from its pattern: what it matches always holds all
words of one of them, so the gate loses nothing. Detections that lie within, or overlap, one of higher priority (then longer,
then earlier) are suppressed. The scan is one map over the rows without a shuffle.

Defined results: null and empty texts have no words, no labels and score 0; null ids pass
through; repeated rows give repeated results; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from re import _constants as sre, _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import bytesvec as bv
from .license_rules import load

#: Phrases whose every place is counted, with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Confidence of a base phrase.
BASE_CONFIDENCE = 0.8
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

SCHEMA = "doc_id {id}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


#: Left out of a gate that has other words: too common to keep a text from being matched.
COMMON = frozenset("a and any are as be by do for from in is may not of on or org some the this to under use with you".split())
#: Stands for what a pattern leaves open.
_OPEN = "\0"


def _spellings(parsed) -> set[str]:
    """What a parsed pattern matches, with ``_OPEN`` for wide classes and long repeats."""
    out = {""}
    for op, arg in parsed:
        if op is sre.LITERAL:
            part = {chr(arg)}
        elif op is sre.IN:
            part = {chr(x) for kind, v in arg for x in ([v] if kind is sre.LITERAL else range(v[0], v[1] + 1) if kind is sre.RANGE else ())}
            if len(part) > 4 or any(kind not in (sre.LITERAL, sre.RANGE) for kind, _ in arg):
                part = {_OPEN}
        elif op is sre.SUBPATTERN:
            part = _spellings(arg[-1])
        elif op is sre.BRANCH:
            part = set().union(*map(_spellings, arg[1]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] == 1:
            part = _spellings(arg[2]) | ({""} if arg[0] == 0 else set())
        else:
            part = {_OPEN}
        out = {x + y for x in out for y in part}
    return out


def gates_of(pattern: str) -> list[frozenset[str]]:
    """Smallest sets of words of which a text that the pattern matches holds at least one whole."""
    sets = set()
    for spelling in _spellings(_parser.parse(pattern)):
        # v2 opens what 2 opens
        words = {w[1:] if w[0] == "v" and w[1:].isdigit() else w for w in spelling.split(" ") if w and _OPEN not in w}
        sets.add(frozenset(words - COMMON or words))
    return sorted((x for x in sets if not any(y < x for y in sets)), key=sorted)


class Rules:
    """Compiled rules with the gates that open them."""

    def __init__(self, rules=None):
        rules = load() if rules is None else rules
        self.rules = [(label, pr, conf, gates_of(pat), re.compile(rf"(?<![^ ])(?:{pat})(?![^ ])")) for label, pr, conf, _, pat in rules]
        # a version's digit may stand as v2
        self.gate_words = sorted({v for r in self.rules for gate in r[3] for w in gate for v in ((w, f"v{w}") if w.isdigit() else (w,))})
        hashes = np.array([bv.word_hashes(*_raw(w), latin=False)[1][0] for w in self.gate_words], np.uint64)
        self.known = bv.HashSet(hashes)
        place = np.searchsorted(self.known.values, hashes)
        self.word_at = {int(p): w for p, w in zip(place, self.gate_words)}
        #: Each gate is filed under its rarest-looking (longest) word.
        self.by_word: dict[str, list[tuple[int, frozenset[str]]]] = {}
        #: Rules whose pattern demands no word are tried on every text.
        self.always = {i for i, r in enumerate(self.rules) if frozenset() in r[3]}
        for i, r in enumerate(self.rules):
            for gate in r[3]:
                if gate:
                    self.by_word.setdefault(max(gate, key=lambda w: (len(w), w)), []).append((i, gate))

    def open(self, present: set[str]) -> list[int]:
        """Numbers of the rules of which these words open a gate."""
        present = present | {w[1:] for w in present if w[0] == "v" and w[1:].isdigit()}
        return sorted(self.always | {i for w in present for i, gate in self.by_word.get(w, ()) if gate <= present})

    def detect(self, text: str, which: list[int] | None = None) -> list[tuple[str, int, int, float]]:
        """Kept detections of a text: label, first word, end word, confidence."""
        words = _WORD.findall(text.translate(_UPPER))
        joined = " ".join(words)
        starts, at = [], 0
        for w in words:
            starts.append(at)
            at += len(w) + 1
        found = []
        for i in range(len(self.rules)) if which is None else which:
            label, priority, conf, _, pattern = self.rules[i]
            for m in pattern.finditer(joined):
                a, b = bisect_right(starts, m.start()) - 1, bisect_right(starts, m.end() - 1)
                found.append((-priority, a - b, a, i, b, label, conf))
        return suppress(found)


def suppress(found: list[tuple]) -> list[tuple[str, int, int, float]]:
    """Without detections that overlap a kept one of higher rank: priority, length, place, rule order.

    Kept intervals don't overlap, so a sorted list of their starts settles each candidate.
    """
    starts: list[int] = []
    kept: list[tuple[int, int, str, float]] = []
    for _, _, a, _, b, label, conf in sorted(found):
        k = bisect_right(starts, a)
        if (k and kept[k - 1][1] > a) or (k < len(kept) and kept[k][0] < b):
            continue
        starts.insert(k, a)
        kept.insert(k, (a, b, label, conf))
    return [(label, a, b, conf) for a, b, label, conf in kept]


def _raw(word: str) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(word.encode(), np.uint8)
    return raw, np.array([0, len(raw)])


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rules=None) -> DataFrame:
    """One row per row of ``docs``; see the module for what the columns hold.

    ``rules`` replaces the built-in table: (label, priority, confidence, hint, pattern). Gates
    come from the pattern; the hint, a rule's tell-tale words, decides nothing.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = Rules(rules)
        phrases = [(np.array([bv.word_hashes(*_raw(w), latin=False)[1][0] for w in p.split()]), label) for p, label in PHRASES.items()]
        for batch in batches:
            yield _scan(batch, engine, phrases)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(bv.lean(run), SCHEMA.format(id=kind))


def _scan(batch: pa.RecordBatch, engine: Rules, phrases: list) -> pa.RecordBatch:
    rows = batch.num_rows
    data, offsets = bv.column_bytes(batch.column(1))
    n_words, n_base = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    first, last = np.full(rows, np.iinfo(np.int64).max), np.full(rows, -1)
    base: dict[int, set[str]] = {}
    more: dict[int, list] = {}
    for i, j in bv.slices(offsets):
        offs = offsets[i : j + 1] - offsets[i]
        doc, h, _, _ = bv.word_hashes(data[offsets[i] : offsets[j]], offs, latin=False)
        counts = np.bincount(doc, minlength=j - i)
        n_words[i:j] = counts
        before = np.concatenate(([0], np.cumsum(counts)))
        for want, label in phrases:
            at = np.flatnonzero(h == want[0])
            at = at[at + len(want) <= len(h)]
            for k in range(1, len(want)):
                at = at[h[at + k] == want[k]]
            at = at[doc[at] == doc[at + len(want) - 1]]
            d, w = doc[at], at - before[doc[at]]
            np.add.at(n_base, d + i, 1)
            np.minimum.at(first, d + i, w)
            np.maximum.at(last, d + i, w)
            for x in np.unique(d):
                base.setdefault(int(x) + i, set()).add(label)
        at, place = engine.known.find(h)
        if len(at):
            for d, p in np.unique(np.stack([doc[at], place]), axis=1).T:
                more.setdefault(int(d) + i, []).append(engine.word_at[int(p)])
    labels, score = [""] * rows, np.zeros(rows)
    for d in range(rows) if engine.always else base.keys() | more.keys():
        which = engine.open(set(more.get(d, ())))
        got = set(base.get(d, ()))
        conf = [BASE_CONFIDENCE] if got else []
        if which:
            for label, _, _, c in engine.detect(data[offsets[d] : offsets[d + 1]].tobytes().decode("utf-8", "replace"), which):
                got.add(label)
                conf.append(c)
        labels[d] = ",".join(sorted(got))
        score[d] = max(conf, default=0.0)
    none = n_base == 0
    return pa.RecordBatch.from_arrays(
        [
            batch.column(0),
            pa.array(n_words),
            pa.array(n_base),
            pa.array(np.where(none, 0, first), mask=none),
            pa.array(np.where(none, 0, last), mask=none),
            pa.array([",".join(sorted(base.get(d, ()))) for d in range(rows)], pa.string()),
            pa.array(labels, pa.string()),
            pa.array(score),
        ],
        names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    )
