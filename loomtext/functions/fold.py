"""Folding of accented Latin letters and transliteration to ASCII, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_PAIRS = {
    "A": "ÀÁÂÃÄÅ", "E": "ÈÉÊË", "I": "ÌÍÎÏ", "N": "Ñ", "O": "ÒÓÔÕÖ", "U": "ÙÚÛÜ", "Y": "Ý",
    "a": "àáâãäå", "e": "èéêë", "i": "ìíîï", "n": "ñ", "o": "òóôõö", "u": "ùúûü", "y": "ýÿ",
}
FROM = "".join(_PAIRS.values())
TO = "".join(k * len(v) for k, v in _PAIRS.items())

#: Replacements of single characters by several, or of signs by their ASCII look-alikes.
EXPANSIONS = {
    "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ß": "ss", "ø": "o", "Ø": "O", "ç": "c", "Ç": "C",
    "“": '"', "”": '"', "„": '"', "‘": "'", "’": "'", "–": "-", "—": "-", "…": "...", " ": " ",
}


def fold_latin(text: Column) -> Column:
    """Accented Latin-1 vowels, n and y without their accents; ç, ø, ß, æ and others stay."""
    return F.translate(text, FROM, TO)


def to_ascii(text: Column) -> Column:
    """Fold, expand ligatures and typographic signs, and drop what is still not ASCII."""
    out = fold_latin(text)
    for old, new in EXPANSIONS.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.regexp_replace(out, r"[^\x00-\x7F]", "")
