"""Tokens and token predicates, as column expressions that stay in the JVM; only offsets of tokens and rewritten sentences don't."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from . import batches

#: Pattern of a plain term, after lower-casing.
TERM = "[a-z]+"
#: Words, clitics, hyphenated heads, numbers and single signs.
WORD = r"'s|n't|[A-Za-z]+-(?=[A-Za-z])|[A-Za-z]+|[0-9]+(?:[.,][0-9]+)*|[^\sA-Za-z0-9]"
STRICT = r"[A-Za-z]+(?:-+[A-Za-z]+)*"
NUMERIC = r"[0-9]+(?:\.[0-9]+)?(?:[eE][0-9]+)?|" + STRICT
TAGGED = r"[0-9]+(?:\.[0-9]+)?(?:[eE][0-9]+)?|[A-Za-z]+(?:[-/]+[A-Za-z]+)*"

# a word that begins with a digit, or ends in two or more of the signs of numerals
_NUMERAL = r"[+0-9=ivx]['()+,\-./0-9=ivx]+"


def terms(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", pattern: str = TERM) -> DataFrame:
    """doc_id, pos (from 1), w: the lower-case terms of each text."""
    found = F.regexp_extract_all(F.lower(F.col(text)), F.lit(pattern), 0)
    return docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(found).alias("pos", "w")).withColumn("pos", F.col("pos") + 1)


def paragraphs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, para_id (from 1), para: the lines of each text."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(F.col(text), "\n")).alias("para_id", "para")).withColumn("para_id", F.col("para_id") + 1)


def paragraph_terms(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, para_id, pos, w: terms by line."""
    found = F.regexp_extract_all(F.lower("para"), F.lit(TERM), 0)
    return paragraphs(docs, text, doc_id).select("doc_id", "para_id", F.posexplode(found).alias("pos", "w")).withColumn("pos", F.col("pos") + 1)


def sentence_terms(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, sent, pos, w: terms by piece between full stops, question and exclamation marks, and line feeds."""
    s = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(F.lower(F.col(text)), r"[.!?\n]+")).alias("sent", "s"))
    return s.select("doc_id", "sent", F.posexplode(F.regexp_extract_all("s", F.lit(TERM), 0)).alias("pos", "w"))


def words(text: Column, alpha_only: bool = False) -> Column:
    """Array of word tokens; ``alpha_only`` keeps those with a letter."""
    found = F.regexp_extract_all(text, F.lit(WORD), 0)
    return F.filter(found, lambda x: has_alpha(x)) if alpha_only else found


def starts(text: Column, pattern: str = WORD) -> Column:
    """Array of the 0-based offsets at which the tokens of a text begin; null stays null."""

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        # blanks are ASCII only, as in the JVM's patterns
        token = re.compile(pattern, re.ASCII)
        return texts.map(lambda t: None if t is None else np.fromiter((m.start() for m in token.finditer(t)), np.int32))

    return run(text)


def has_alpha(word: Column) -> Column:
    return word.rlike("[A-Za-z]")


def has_alnum(word: Column) -> Column:
    return word.rlike("[A-Za-z0-9]")


def normalize_number(word: Column, parity: bool = False) -> Column:
    """``nnumber`` for numerals. In parity mode a numeral ending suffices: ``matrix`` and ``six`` are hit."""
    hit = word.rlike(f"^[0-9]|{_NUMERAL}$") if parity else word.rlike(f"^[0-9].*$|^{_NUMERAL}$")
    return F.when(hit, F.lit("nnumber")).otherwise(word)


def simple_number(word: Column) -> Column:
    """``[number]`` for words of digits and dots only, the empty word included."""
    return F.when(word.rlike(r"^[0-9.]*$"), F.lit("[number]")).otherwise(word)


def starts_ngram(word: Column) -> Column:
    """Whether a word may stand in an n-gram: it begins with a letter, digit or apostrophe and ends no sentence."""
    return word.rlike("^[A-Za-z0-9']") & (word != "endofsentence")


def trim_spaces(text: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\r]{2,}", " "))


def chunks(text: Column) -> Column:
    """Pieces between commas, semicolons, colons, quotes and spaced dashes, without final dots."""
    t = F.regexp_replace(text, "[–—]", "-")
    t = F.regexp_replace(t, "[“”„‘’]", '"')
    t = F.regexp_replace(t, r"\.+(\n|$)", "$1")
    pieces = F.split(t, "[,;:\"'`\n]| - ")
    return F.filter(F.transform(pieces, lambda x: F.trim(x)), lambda x: x != "")


def is_math(word: Column) -> Column:
    """Whether a word looks like mathematics: numbers, operators, single letters, short consonant runs."""
    return (
        word.rlike(r"^[0-9]+$|^[0-9]*\.[0-9]+$|^[0-9]+/[0-9]+$")
        | word.rlike("[<>=+*]")
        | word.rlike("^[b-hj-zB-HJ-Z]$")
        | word.rlike("^[bcdfghjklmnpqrstvwxz]{2,3}$")
        | word.rlike("^[bcdfghjklmnpqrstvwxz][BCDFGHJKLMNPQRSTVWXZ]$")
        | word.rlike("^[bcdfghjklmnpqrstvwxz]yr$")
    )


#: Stand-ins while sentences are rewritten: a line break to be, and a dash, which counts as a letter.
_BREAK, _DASH = "\ue000", "qzdashzq"
_W = r"[\p{L}\p{N}_]"
_MARK = r"MathExpr[\p{L}\p{N}_\-]*"
#: Rewrites of a sentence in their order: pattern and replacement, with $ before group numbers.
SENTENCE_REWRITES = (
    (" +", " "),
    ("^ +| +$", ""),
    # a mark before a capital ends a line; marks and citations stand apart from words
    (rf"\(?({_MARK})\)?\s+([A-Z])", f"$1{_BREAK}$2"),
    (rf"({_W})(\(?MathExpr)", "$1 $2"),
    (rf"(\({_MARK}\))({_W})", "$1 $2"),
    (rf"({_W})ourcitation", "$1 ourcitation"),
    (rf"ourcitation({_W})", "ourcitation $1"),
    ("[—–-]", _DASH),
    ("[“”]", '"'),
    ("[`‘’]", "'"),
    # genitives, then signs beside words
    ("([a-zA-Z])('s)", "$1 $2"),
    (rf" ({_W}+)([:;,\"'])", " $1 $2 "),
    (rf"([:;,\"'])({_W}+)", " $1 $2 "),
    ("(') (s)", "$1$2"),
    (r"([()])(.)", "$1 $2"),
    (r"(.)([()])", "$1 $2"),
    (r"(,)([^0-9])", "$1 $2"),
    (r"([^0-9])(,)", "$1 $2"),
    (r" ((?:[0-9]\.)*)(,)", " $1 $2"),
    (rf" ({_W}+[.!?]*)(\")", " $1 $2"),
    (rf" ({_W}+)('')", " $1 $2"),
    (rf"({_MARK})([,.?!])", "$1 $2"),
    (r"\(\s*ourreference\s*\)", "ourreference"),
    (_DASH, "-"),
    (r"-\s+\.", "-."),
    # final signs end a line unless a bracket closes after them
    (r"( [.?!]) ( *)([^ )])", f" $1 {_BREAK}$2$3"),
    (r"([.?!] +\)) ", f" $1 {_BREAK}"),
    (r" ([.?!])( *\r*\n)", f"$1 {_BREAK}"),
    (r"([.?!]) (\))", " $1 $2"),
    ("[∎▮‣■□▪]", f"ourQED {_BREAK} "),
    (r"[ \t\n\r\f]+", " "),
    (rf" ([\p{{L}}\p{{N}}_,;'\"]*)([.?!]) {_BREAK}", f" $1 $2 {_BREAK}"),
    (r" ([\p{L}\p{N}_,;'\"]*)([.?!])$", " $1 $2"),
    (f"{_BREAK} *", "\n"),
    (" +", " "),
    ("^ +| +$", ""),
    (r"\.\.\s+\.", "..."),
)


#: The same rewrites without those of one blank by one blank.
_FEWER = {" +": " {2,}", r"[ \t\n\r\f]+": r"[ \t\n\r\f]{2,}|[\t\n\r\f]"}


def normalize_sentence(text: Column) -> Column:
    """Dashes and quotes folded, signs, marks, citations and genitives spaced out, end-of-proof glyphs named, lines broken after final signs.

    The patterns are RE2's, as they are in SQL: an end is the end of the text, and all but a line feed is a character.
    """
    rules = [(_FEWER.get(pattern, pattern), re.sub(r"\$([0-9])", r"\\\1", to)) for pattern, to in SENTENCE_REWRITES]

    def of(part: pa.Array) -> pa.Array:
        for pattern, to in rules:
            part = pc.replace_substring_regex(part, pattern=pattern, replacement=to)
        return part

    return batches.arrays(text, of, "string")


def merge_equations(text: Column) -> Column:
    """Adjacent equation marks become the first of them."""
    return F.regexp_replace(text, r"(MathExprEquation-[0-9A-Za-z\-]+)(?: MathExprEquation-[0-9A-Za-z\-]+)+", "$1")


def xml_id(mark: Column) -> Column:
    """The element id that a position mark was made from: ``MathExpr-S1-p2-m3`` gives ``S1.p2.m3``."""
    return F.regexp_replace(F.regexp_replace(mark, "^MathExpr(?:Equation)?-|^ourcitation-|^ourreference-", ""), "-", ".")


def position_mark(prefix: str, element_id: Column) -> Column:
    """A mark word for an element id."""
    return F.concat(F.lit(prefix + "-"), F.regexp_replace(element_id, r"\.", "-"))


def base_kind(token: Column) -> Column:
    """Kind of a marked token: punct, formula, citation, reference or word."""
    return (
        F.when(token.rlike("^[.?!:,;\"'`]+$"), "punct")
        .when(token.startswith("MathExpr"), "formula")
        .when(token.startswith("ourcitation"), "citation")
        .when(token.startswith("ourreference"), "reference")
        .otherwise("word")
    )


def replace_word(text: Column, word: str, new: str) -> Column:
    """Whole words between blanks replaced."""
    import re

    return F.regexp_replace(text, f"(?<![^ ]){re.escape(word)}(?![^ ])", new.replace("\\", "\\\\").replace("$", "\\$"))


def utc_time(moment: Column) -> Column:
    """A readable time in UTC."""
    return F.concat(F.date_format(F.to_utc_timestamp(moment, F.current_timezone()), "yyyy-MM-dd HH:mm:ss"), F.lit(" GMT"))
