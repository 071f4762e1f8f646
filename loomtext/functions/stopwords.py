"""English function words, as a literal list or from a JSON array."""

from __future__ import annotations

import json

from pyspark.sql import Column, SparkSession, functions as F

BASIC = tuple(
    """a about after all also an and any are as at be because been before being between both but by can could did do does
    during each either for from further had has have having he her here hers him his how i if in into is it its just may
    me might more most must my no nor not of off on once only or other our ours out over own same shall she should so
    some such than that the their them then there these they this those through to too under until up upon us very was
    we were what when where which while who whom why will with would you your yours""".split()
)
EXTENDED = tuple(sorted({*BASIC, *"again against across along although among anyway around became become besides beyond cannot else ever every few hence however indeed instead latter least less many meanwhile moreover much namely neither never nevertheless next none now often otherwise perhaps quite rather really several since sometimes somewhat still therefore thereby though thus together toward towards unless usually via well whatever whenever whereas wherever whether within without yet".split()}))


def is_stopword(word: Column, words: tuple[str, ...] = EXTENDED) -> Column:
    """Whether the lower-cased word is in the list."""
    return F.lower(word).isin(list(words))


def read_stopwords(spark: SparkSession, path: str) -> tuple[str, ...]:
    """A list from a JSON array of strings; a list of words is small by nature and checked to be."""
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    words = json.loads(rows[0][0])
    if len(words) > 100_000:
        raise ValueError("a stopword list of more than 100,000 words is a table; join it instead")
    return tuple(words)
