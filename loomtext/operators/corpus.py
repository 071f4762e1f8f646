"""The corpus drivers: language filter and folding of documents, and words by paragraph of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import dom, fold, sentences, stem as stems, stopwords, tokens
from . import textcat

END = "endofsentence"


def prepare(docs: DataFrame, models: DataFrame | None = None, language: str | None = None, ascii_fold: bool = True, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): documents in the language with folded text, and the ids of others with their guess.

    Without a language all documents are kept. The filter runs before any other work on texts.
    """
    rejected = docs.select(doc_id).where("false").withColumn("lang_pred", F.lit(None).cast("string"))
    if language is not None:
        guess = textcat.classify(textcat.distances(docs, models, doc_id, text), doc_id).select(doc_id, "lang_pred")
        rejected = docs.select(doc_id).join(guess, doc_id, "left").where(~F.col("lang_pred").eqNullSafe(language))
        docs = docs.join(guess.where(F.col("lang_pred") == language).select(doc_id), doc_id, "left_semi")
    return (docs.withColumn(text, fold.to_ascii(F.col(text))) if ascii_fold else docs), rejected


def paragraph_words(text: Column, alpha_only: bool = False, drop_stopwords: bool = False, normalize: bool = False, stem: bool = False, mark_end: bool = False) -> Column:
    """Array of a paragraph's words, sentence after sentence; all of it without a shuffle."""
    spoken = F.transform(sentences.sentence_ranges(text), lambda r: sentences.range_text(text, r["start"], r["end"]))

    def of(sentence: Column) -> Column:
        w = tokens.words(sentence, alpha_only)
        if drop_stopwords:
            w = F.filter(w, lambda x: ~stopwords.is_stopword(x))
        if normalize:
            w = F.transform(w, lambda x: tokens.normalize_number(x))
        return F.concat(w, F.array(F.lit(END))) if mark_end else w

    words = F.flatten(F.transform(spoken, lambda s: of(s)))
    if stem:
        words = F.filter(F.split(stems.stem(F.array_join(words, " "), fixpoint=True), " "), lambda x: x != "")
    return words


def words_at(pages: DataFrame, paths: tuple[str, ...] = dom.PARAGRAPHS, page: str = "html", page_id: str = "page_id", dom_options: dict | None = None, **options) -> DataFrame:
    """page_id, para_id, label, words of the selected paragraphs that have at least two characters."""
    p = dom.page_paragraphs(pages, page, page_id, paths, **(dom_options or {}))
    return p.select("page_id", "para_id", "label", paragraph_words(F.col("text"), **options).alias("words"))


def zip_tags(rows: DataFrame, words: str, tags: str, keys: list[str]) -> DataFrame:
    """keys, word_id (from 1), word, tag by position; the shorter array is padded with nulls."""
    z = F.arrays_zip(F.col(words).alias("w"), F.col(tags).alias("t"))
    out = rows.select(*keys, F.posexplode(z).alias("word_id", "z"))
    return out.select(*keys, (F.col("word_id") + 1).alias("word_id"), F.col("z.w").alias("word"), F.col("z.t").alias("tag"))


def lookup(marks: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes of mark words: trailing blanks and a closing bracket don't count."""
    clean = marks.withColumn("mark", F.regexp_replace(F.rtrim("mark"), r"\)$", ""))
    return clean.join(table, [*keys, "mark"], "left")
