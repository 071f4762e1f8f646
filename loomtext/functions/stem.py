"""English inflectional stems: irregular forms, then suffix rules, lower-cased.

One pass strips one inflection of each word; the fixpoint repeats until nothing changes.
Stems are a function of the word, so callers stem distinct words and join them back.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from . import batches

IRREGULAR = {
    **dict.fromkeys("am are is was were been being".split(), "be"),
    **dict.fromkeys("has had having".split(), "have"),
    **dict.fromkeys("does did done doing".split(), "do"),
    **dict.fromkeys("goes went gone".split(), "go"),
    "said": "say", "made": "make", "took": "take", "taken": "take", "came": "come", "saw": "see", "seen": "see",
    "knew": "know", "known": "know", "got": "get", "gotten": "get", "gave": "give", "given": "give", "found": "find",
    "thought": "think", "told": "tell", "became": "become", "left": "leave", "felt": "feel", "brought": "bring",
    "began": "begin", "begun": "begin", "kept": "keep", "held": "hold", "wrote": "write", "written": "write",
    "stood": "stand", "heard": "hear", "meant": "mean", "met": "meet", "ran": "run", "paid": "pay", "sat": "sit",
    "spoke": "speak", "spoken": "speak", "led": "lead", "grew": "grow", "grown": "grow", "lost": "lose", "fell": "fall",
    "fallen": "fall", "sent": "send", "built": "build", "understood": "understand", "drew": "draw", "drawn": "draw",
    "broke": "break", "broken": "break", "spent": "spend", "rose": "rise", "risen": "rise", "drove": "drive",
    "driven": "drive", "bought": "buy", "wore": "wear", "worn": "wear", "chose": "choose", "chosen": "choose",
    "shown": "show", "proven": "prove", "men": "man", "women": "woman", "children": "child", "feet": "foot", "teeth": "tooth",
    "mice": "mouse", "geese": "goose", "indices": "index", "vertices": "vertex", "matrices": "matrix", "axes": "axis",
    "phenomena": "phenomenon", "criteria": "criterion", "lives": "life", "wives": "wife", "knives": "knife", "halves": "half",
    "leaves": "leaf", "selves": "self", "shelves": "shelf", "wolves": "wolf",
}
KEPT = frozenset(
    """this his its us thus plus bus gas yes always perhaps as has was series species news means lens physics mathematics
    during anything everything nothing something thing king ring sing bring string spring wing swing morning evening
    ceiling red bed need seed feed speed indeed exceed proceed succeed hundred sacred led shed wed us bias canvas atlas
    chaos cosmos""".split()
)
#: Stems whose last consonant is doubled before -ed and -ing.
DOUBLED = frozenset("admit bar beg begin bid cap chat chop clap commit compel concur control cut dig dip drag drop equip excel fit flip forget get grab hit hop incur infer jog knit label let map model net nod occur omit pad permit pin plan plot pop prefer program propel put quit rebel refer regret rid rip rob rot rub run scan set ship shop shut sit skip slip snap spin split stem step stop strip submit sum swap swim tag tap tip transfer transmit trap travel trim win wrap".split())
_VOWEL = set("aeiouy")
_WORD = re.compile(r"[A-Za-z]+(?:'[sS](?![A-Za-z]))?|[^A-Za-z]+")


def _has_vowel(s: str) -> bool:
    return any(c in _VOWEL for c in s)


def _closed(s: str) -> bool:
    """Whether a bare stem takes a final e: one consonant after one vowel, or c, s, v, z, u, or a consonant and l."""
    if s[-1] in "cuvz" or s.endswith(("rs", "ns", "ls", "ps", "ts")):
        return True
    if len(s) >= 2 and s[-1] == "l" and s[-2] not in _VOWEL and s[-2] not in "lr":
        return True
    return s[-1] not in "aeiouwxy" and s[-2:-1] in tuple("aiou") and (len(s) < 3 or s[-3] not in "aeiou") and not s.endswith(("en", "er", "on", "or", "it", "ow", "op", "om", "in", "an", "ish", "ain", "al", "el", "il", "ol"))


def _unsuffixed(s: str) -> str:
    if len(s) > 2 and s[-1] == s[-2] and s[-1] not in _VOWEL and s[:-1] in DOUBLED:
        return s[:-1]
    if len(s) > 3 and s[-1] == s[-2]:
        return s
    if s in _TAKES_E or (s not in _BARE and _closed(s)):
        return s + "e"
    return s


_TAKES_E = frozenset("us mak tak giv hav com writ prov defin combin determin describ requir includ provid produc reduc introduc til fil rul scal tim nam not denot stat relat creat generat compar prepar shar car stor ignor explor restor clos los chang rang arrang judg manag achiev believ receiv observ serv solv involv evolv improv remov mov liv lov leav".split())
_BARE = frozenset("follow visit limit edit exist assert bound expand extend consider open happen develop answer order offer number enter remember gather deliver alter cover discover contain obtain remain explain train gain mail fail detail appear hear fear clear near near need read lead spread load add end find kind bind mind send tend depend spend lend test list exist cost boost host post group look book work mark ask risk link think rank thank talk walk fix mix box tax relax show know grow draw flow allow view review go do be see free agree".split())


def stem_word(word: str) -> str:
    """The word in lower case without one inflection."""
    w = word.lower()
    if w.endswith("'s"):
        return stem_word(w[:-2]) + "'s"
    if w in IRREGULAR:
        return IRREGULAR[w]
    if len(w) < 3 or w in KEPT:
        return w
    if w.endswith("ing") and len(w) > 4 and _has_vowel(w[:-3]):
        return _unsuffixed(w[:-3])
    if w.endswith("eed"):
        return w
    if w.endswith("ied") and len(w) > 4:
        return w[:-3] + "y"
    if w.endswith("ed") and len(w) > 3 and _has_vowel(w[:-2]):
        return _unsuffixed(w[:-2])
    if w.endswith("la") and len(w) > 3:
        return w[:-1] + "um"
    if w.endswith(("us", "ss", "sis")):
        return w
    if w.endswith("ies") and len(w) > 4:
        return w[:-3] + "y"
    if w.endswith("wives"):
        return w[:-3] + "fe"
    if w.endswith(("ches", "shes", "sses", "zzes", "xes")):
        return w[:-2]
    if w.endswith("oes") and len(w) > 4:
        return w[:-2]
    if w.endswith("men") and len(w) > 4:
        return w[:-2] + "an"
    if w.endswith("s") and not w.endswith("'s"):
        return w[:-1]
    return w


def stem_text(text: str | None) -> str | None:
    """One pass over a text: its words stemmed, all else kept."""
    return None if text is None else "".join(stem_word(x) if x[0].isalpha() else x for x in _WORD.findall(text))


def full_stem(text: str | None) -> str | None:
    """Passes until nothing changes."""
    while text is not None:
        once = stem_text(text)
        if once == text:
            break
        text = once
    return text


def stem(text: Column, fixpoint: bool = False) -> Column:
    return batches.each(text, full_stem if fixpoint else stem_text, "string")


def stem_terms(tokens: DataFrame, word: str = "w", fixpoint: bool = True) -> DataFrame:
    """``tokens`` with column ``stem``: distinct words are stemmed once and joined back."""
    vocabulary = tokens.select(F.col(word).alias("__w")).distinct().withColumn("stem", stem(F.col("__w"), fixpoint))
    return tokens.join(vocabulary, F.col(word) == F.col("__w")).drop("__w")
