"""Scalar functions over whole texts and tokens."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import fold, sentences, stem, stopwords, tokens
from .common import BASIC_SQL, STOP_SQL, TOK, documents, doc_terms, table, with_


def fold_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.md5(fold.fold_latin(F.col("text"))).alias("digest"))


def transliterate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("doc_id", fold.to_ascii(F.col("text")).alias("t"))
    return d.select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("n_chars"))


def token_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)
    return documents(spark, sf_dir).select("doc_id", F.size(a).cast("long").alias("n_tokens"), F.md5(F.array_join(a, " ")).alias("digest"))


def stopword_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = doc_terms(spark, sf_dir).where(stopwords.is_stopword(F.col("w")))
    return t.groupBy("w").agg(F.count(F.lit(1)).alias("n"))


def stopword_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = doc_terms(spark, sf_dir).where(~stopwords.is_stopword(F.col("w")))
    return t.groupBy("w").agg(F.count(F.lit(1)).alias("n"))


def stopword_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = [spark.createDataFrame([(w,) for w in x], "w string") for x in (stopwords.EXTENDED, stopwords.BASIC)]
    return lists[0].exceptAll(lists[1])


_ALNUM = r"[a-z0-9][a-z0-9.,/+='-]*"


def _alnum_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.terms(documents(spark, sf_dir), pattern=_ALNUM).groupBy("w").agg(F.count(F.lit(1)).alias("n"))


def number_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alnum_words(spark, sf_dir).groupBy(tokens.normalize_number(F.col("w")).alias("w")).agg(F.sum("n").alias("n"))


def number_norm_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alnum_words(spark, sf_dir).groupBy(tokens.normalize_number(F.col("w"), parity=True).alias("w")).agg(F.sum("n").alias("n"))


def simple_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alnum_words(spark, sf_dir).groupBy(tokens.simple_number(F.col("w")).alias("w")).agg(F.sum("n").alias("n"))


def token_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.explode(F.regexp_extract_all("text", F.lit(r"[^ \n]+"), 0)).alias("w")
    t = documents(spark, sf_dir).select(w).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    flags = t.select("n", tokens.has_alpha(F.col("w")).alias("alpha"), tokens.has_alnum(F.col("w")).alias("alnum"), tokens.starts_ngram(F.col("w")).alias("ngram"))
    return flags.groupBy("alpha", "alnum", "ngram").agg(F.sum("n").alias("n"))


def _word_tokens(pattern: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        a = F.regexp_extract_all("text", F.lit(pattern), 0)
        return documents(spark, sf_dir).select("doc_id", F.size(a).cast("long").alias("n_tokens"), F.md5(F.array_join(a, " ")).alias("digest"))

    return query


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("doc_id", tokens.chunks(F.col("text")).alias("c"))
    return d.select("doc_id", F.size("c").cast("long").alias("n_chunks"), F.md5(F.array_join("c", "|")).alias("digest"))


def trim_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.md5(tokens.trim_spaces(F.col("text"))).alias("digest"))


def math_construct(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9<>=+*/.]+"), 0)).alias("w")
    t = documents(spark, sf_dir).select(w).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return t.where(tokens.is_math(F.col("w")))


def base_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z]+|[.?!:,;]"), 0)).alias("w")
    t = documents(spark, sf_dir).select(w).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return t.groupBy(tokens.base_kind(F.col("w")).alias("kind")).agg(F.sum("n").alias("n"))


def equation_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks made from page ids, merged where adjacent, and read back."""
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("S"), F.col("page_id").cast("string"), F.lit(".p1.m2")).alias("id"))
    m = p.select("page_id", tokens.position_mark("MathExprEquation", F.col("id")).alias("mark"))
    line = F.concat(F.lit("see "), "mark", F.lit(" "), "mark", F.lit(" end"))
    return m.select("page_id", tokens.merge_equations(line).alias("line"), tokens.xml_id(F.col("mark")).alias("id"))


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.digests(documents(spark, sf_dir))


def sentence_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = documents(spark, sf_dir).withColumn("r", F.explode(sentences.sentence_ranges(F.col("text"))))
    w = s.select("doc_id", F.size(tokens.words(sentences.range_text(F.col("text"), F.col("r.start"), F.col("r.end")))).alias("n"))
    return w.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.sum("n").alias("n_words"))


def normalized_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.md5(tokens.normalize_sentence(F.col("text"))).alias("digest"))


def stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = doc_terms(spark, sf_dir).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return stem.stem_terms(v, fixpoint=False).groupBy("stem").agg(F.sum("n").alias("n"))


def stem_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = doc_terms(spark, sf_dir).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return stem.stem_terms(v, fixpoint=True).groupBy("stem").agg(F.sum("n").alias("n"))


QUERIES = {f.__name__: f for f in (fold_ascii, transliterate, token_stream, stopword_semi, stopword_anti, stopword_difference, number_norm, number_norm_parity, simple_number, token_predicates, chunks, trim_spaces, math_construct, base_kinds, equation_marks, sentence_split, sentence_words, normalized_sentences, stems, stem_fixpoint)} | {
    "word_tokens_strict": _word_tokens(tokens.STRICT),
    "word_tokens_num": _word_tokens(tokens.NUMERIC),
    "word_tokens_pos": _word_tokens(tokens.TAGGED),
}


def _ascii_sql() -> str:
    out = f"translate(text, '{fold.FROM}', '{fold.TO}')"
    for old, new in fold.EXPANSIONS.items():
        quoted = new.replace("'", "''")
        out = f"replace({out}, '{old}', '{quoted}')"
    return f"regexp_replace({out}, '[^\\x00-\\x7F]', '', 'g')"


def _words_sql(pattern: str) -> str:
    return f"SELECT doc_id, len(a) AS n_tokens, md5(array_to_string(a, ' ')) AS digest FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS a FROM documents)"


_ALNUM_SQL = "aw AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '" + _ALNUM.replace("'", "''") + "')) AS w FROM documents) GROUP BY w)"
_NUMERAL = "[+0-9=ivx]['()+,\\-./0-9=ivx]+".replace("'", "''")
_CONS = "bcdfghjklmnpqrstvwxz"

def _rewrites_sql() -> str:
    """The text after all rewrites of sentences, in the other dialect's replacements."""
    out = "text"
    for pattern, to in tokens.SENTENCE_REWRITES:
        quoted = ("'" + x.replace("'", "''") + "'" for x in (pattern, re.sub(r"\$([0-9])", r"\\\1", to)))
        out = f"regexp_replace({out}, {', '.join(quoted)}, 'g')"
    return out


ORACLES = {
    "normalized_sentences": f"SELECT doc_id, md5({_rewrites_sql()}) AS digest FROM documents",
    "fold_ascii": f"SELECT doc_id, md5(translate(text, '{fold.FROM}', '{fold.TO}')) AS digest FROM documents",
    "transliterate": f"SELECT doc_id, md5(t) AS digest, length(t) AS n_chars FROM (SELECT doc_id, {_ascii_sql()} AS t FROM documents)",
    "token_stream": "SELECT doc_id, len(a) AS n_tokens, md5(array_to_string(a, ' ')) AS digest FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS a FROM documents)",
    "stopword_semi": with_(TOK) + f"SELECT w, count(*) AS n FROM tok WHERE w IN {STOP_SQL} GROUP BY w",
    "stopword_anti": with_(TOK) + f"SELECT w, count(*) AS n FROM tok WHERE w NOT IN {STOP_SQL} GROUP BY w",
    "stopword_difference": "SELECT unnest([" + STOP_SQL[1:-1] + "]) AS w EXCEPT ALL SELECT unnest([" + BASIC_SQL[1:-1] + "]) AS w",
    "number_norm": with_(_ALNUM_SQL) + f"SELECT CASE WHEN regexp_matches(w, '^[0-9].*$|^{_NUMERAL}$') THEN 'nnumber' ELSE w END AS w, CAST(sum(n) AS BIGINT) AS n FROM aw GROUP BY 1",
    "number_norm_parity": with_(_ALNUM_SQL) + f"SELECT CASE WHEN regexp_matches(w, '^[0-9]|{_NUMERAL}$') THEN 'nnumber' ELSE w END AS w, CAST(sum(n) AS BIGINT) AS n FROM aw GROUP BY 1",
    "simple_number": with_(_ALNUM_SQL) + "SELECT CASE WHEN regexp_full_match(w, '[0-9.]*') THEN '[number]' ELSE w END AS w, CAST(sum(n) AS BIGINT) AS n FROM aw GROUP BY 1",
    "token_predicates": r"SELECT regexp_matches(w, '[A-Za-z]') AS alpha, regexp_matches(w, '[A-Za-z0-9]') AS alnum, regexp_matches(w, '^[A-Za-z0-9'']') AND w <> 'endofsentence' AS ngram, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[^ \n]+')) AS w FROM documents) GROUP BY 1, 2, 3",
    "word_tokens_strict": _words_sql(tokens.STRICT),
    "word_tokens_num": _words_sql(tokens.NUMERIC),
    "word_tokens_pos": _words_sql(tokens.TAGGED),
    "chunks": r"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[–—]', '-', 'g'), '[“”„‘’]', '"', 'g'), '\.+(\n|$)', '\1', 'g') AS t FROM documents),
b AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(t, '[,;:"''`\n]| - '), lambda x: trim(x)), lambda x: x <> '') AS c FROM a)
SELECT doc_id, len(c) AS n_chunks, md5(array_to_string(c, '|')) AS digest FROM b""",
    "trim_spaces": r"SELECT doc_id, md5(trim(regexp_replace(text, '[ \t\n\r]{2,}', ' ', 'g'))) AS digest FROM documents",
    "math_construct": rf"""SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9<>=+*/.]+')) AS w FROM documents)
WHERE regexp_matches(w, '^[0-9]+$|^[0-9]*\.[0-9]+$|^[0-9]+/[0-9]+$|[<>=+*]|^[b-hj-zB-HJ-Z]$|^[{_CONS}]{{2,3}}$|^[{_CONS}][{_CONS.upper()}]$|^[{_CONS}]yr$') GROUP BY w""",
    "base_kinds": "SELECT CASE WHEN regexp_full_match(w, '[.?!:,;]') THEN 'punct' WHEN starts_with(w, 'MathExpr') THEN 'formula' WHEN starts_with(w, 'ourcitation') THEN 'citation' WHEN starts_with(w, 'ourreference') THEN 'reference' ELSE 'word' END AS kind, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+|[.?!:,;]')) AS w FROM documents) GROUP BY 1",
    "equation_marks": "SELECT page_id, 'see MathExprEquation-S' || page_id || '-p1-m2 end' AS line, 'S' || page_id || '.p1.m2' AS id FROM pages",
}
