"""Frequencies, IDF, TF-IDF, n-grams and language fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import stopwords, tokens
from ..operators import counts as C, inplace as P, ngrams as G, textcat
from ..sources.staging import stage
from .common import CNT, DF, IDF, SENT, SIZE, STOP_SQL, TOK, documents, doc_terms, spread, table, with_


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.term_counts(doc_terms(spark, sf_dir))


def _staged_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For plans that read the counts more than once."""
    return stage(_counts(spark, sf_dir), "counts")


def term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir)


def corpus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.corpus_counts(doc_terms(spark, sf_dir)).orderBy(F.desc("n"), "w")


def doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.document_frequencies(_counts(spark, sf_dir))


def corpus_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.corpus_size(_counts(spark, sf_dir))


def max_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.max_counts(_counts(spark, sf_dir))


def idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _staged_counts(spark, sf_dir)
    return C.idf(C.document_frequencies(n), C.corpus_size(n)).select("w", "df", F.round("idf", 6).alias("idf"))


def tf_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _staged_counts(spark, sf_dir)
    return C.tf_idf(n, C.document_frequencies(n), C.corpus_size(n)).select("doc_id", "w", "n", F.round("score", 6).alias("score"))


def tf_idf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.top_terms(tf_idf(spark, sf_dir), 5)


def good_turing(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = C.good_turing(stage(C.corpus_counts(doc_terms(spark, sf_dir)), "corpus-counts"))
    return g.select("r", "n_r", F.round("p", 9).alias("p"))


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.sentence_terms(documents(spark, sf_dir))


def _gram_table(spark: SparkSession, sf_dir: str, *sizes: int, **options) -> DataFrame:
    return P.ngram_counts(P.sentence_texts(documents(spark, sf_dir)), sizes, **options)


def _grams(n: int):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _gram_table(spark, sf_dir, n).select("ngram", "cnt", "df")

    return query


def ngram_idf(spark: SparkSession, sf_dir: str, parity: bool = False) -> DataFrame:
    size = table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n_docs"))
    g = _grams(2)(spark, sf_dir).crossJoin(F.broadcast(size))
    value = G.idf_of(F.col("df"), F.col("n_docs"), parity)
    return g.where(F.col("df") + 1 <= F.col("n_docs")).select("ngram", "cnt", "df", F.round(value, 6).alias("idf"))


def ngram_idf_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_idf(spark, sf_dir, parity=True)


def ngrams_frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grams(2)(spark, sf_dir).where("cnt > 5").select("ngram", "cnt")


def union_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gram_table(spark, sf_dir, 1, 2, 3).select("size", "ngram", "cnt")


def nonstop_run_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = G.content_runs(_sentences(spark, sf_dir), stopwords.is_stopword(F.col("w")))
    grams = G.ngrams(r, 2, ["sent", "run"])
    return grams.groupBy("doc_id", "ngram").agg(F.count(F.lit(1)).alias("cnt"))


def ngram_idf_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IDF of uni-, bi- and trigrams."""
    size = table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n_docs"))
    g = _gram_table(spark, sf_dir, 1, 2, 3).crossJoin(F.broadcast(size))
    return g.where(F.col("df") + 1 <= F.col("n_docs")).select("size", "ngram", "cnt", "df", F.round(G.idf_of(F.col("df"), F.col("n_docs")), 6).alias("idf"))


def content_run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uni-, bi- and trigrams of the runs between stopwords, counted over the corpus."""
    return _gram_table(spark, sf_dir, 1, 2, 3, stopwords=stopwords.EXTENDED).select("size", "ngram", "cnt")


def stemmed_run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after stemming, which also decides what is a stopword."""
    return _gram_table(spark, sf_dir, 1, 2, 3, stopwords=stopwords.EXTENDED, stemmed=True).select("size", "ngram", "cnt")


def freq_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts through JSON text and back: both the writer and the reader of dictionaries."""
    from ..sources import writers

    j = writers.by_doc_json(_counts(spark, sf_dir), "doc_id", "w", "n")
    d = j.select(F.from_json("value", "doc bigint, terms map<string,bigint>").alias("j"))
    return d.select(F.col("j.doc").alias("doc_id"), F.explode("j.terms").alias("w", "n"))


def _languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))


def lang_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textcat.profiles(_languages(spark, sf_dir)).select("lang", "gram", F.col("rank").cast("long").alias("rank"))


def _distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _languages(spark, sf_dir)
    return textcat.distances(d, textcat.profiles(d))


def lang_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textcat.classify(_distances(spark, sf_dir))


def lang_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textcat.candidates(_distances(spark, sf_dir))


def non_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_classify(spark, sf_dir).where("lang_pred <> 'en'").select("doc_id", "lang_pred")


QUERIES = {f.__name__: f for f in (term_counts, corpus_counts, doc_freq, corpus_size, max_tf, idf, tf_idf, tf_idf_topk, good_turing, ngram_idf, ngram_idf_parity, ngrams_frequent, union_ngrams, nonstop_run_ngrams, freq_json, lang_profiles, lang_classify, lang_candidates, non_english, ngram_idf_sizes, content_run_counts, stemmed_run_counts)} | {"unigrams": _grams(1), "bigrams": _grams(2), "trigrams": _grams(3)}

_TFIDF = "ti AS (SELECT doc_id, w, n, round((0.5 + 0.5 * n / max(n) OVER (PARTITION BY doc_id)) * log2(n_docs / (1.0 + df)), 6) AS score FROM cnt JOIN dfq USING (w), sz)"


def _gram_sql(n: int) -> str:
    parts = ", ".join(f"lead(w, {k}) OVER x AS w{k}" for k in range(1, n))
    text = " || ' ' || ".join(["w", *(f"w{k}" for k in range(1, n))])
    last = f"w{n - 1}" if n > 1 else "w"
    return f"g{n} AS (SELECT doc_id, {text} AS ngram FROM (SELECT doc_id, w{', ' + parts if parts else ''} FROM stok WINDOW x AS (PARTITION BY doc_id, sent ORDER BY pos)) WHERE {last} IS NOT NULL)"


def _gram_counts(n: int) -> str:
    return with_(SENT, _gram_sql(n)) + f"SELECT ngram, count(*) AS cnt, count(DISTINCT doc_id) AS df FROM g{n} GROUP BY ngram"


_LW = r"lw AS (SELECT {key}, '_' || w || '_' AS p, count(*) AS c FROM (SELECT {key}, unnest(regexp_extract_all(lower(text), '[\p{{L}}]+')) AS w FROM documents) GROUP BY 1, 2)"
_LG = "{name} AS (SELECT {key}, gram, CAST(row_number() OVER (PARTITION BY {key} ORDER BY n DESC, gram) AS BIGINT) AS rank FROM (SELECT {key}, gram, sum(c) AS n FROM (SELECT {key}, c, substr(p, i, k) AS gram FROM {words}, (SELECT unnest([1,2,3,4,5]) AS k), (SELECT unnest(generate_series(1, 300)) AS i) WHERE i + k - 1 <= length(p)) WHERE gram <> '_' GROUP BY 1, 2) QUALIFY rank <= 400)"
_PROF = _LW.format(key="lang").replace("lw AS", "lw AS", 1) + ",\n" + _LG.format(key="lang", name="prof", words="lw")
_DOCG = _LW.format(key="doc_id").replace("lw AS", "dw AS", 1) + ",\n" + _LG.format(key="doc_id", name="dg", words="dw")
_DIST = "dm AS (SELECT doc_id, count(*) AS m FROM dg GROUP BY doc_id), dist AS (SELECT dg.doc_id, prof.lang, CAST(sum(abs(dg.rank - prof.rank)) + 400 * (any_value(m) - count(*)) AS BIGINT) AS distance FROM dg JOIN prof USING (gram) JOIN dm USING (doc_id) GROUP BY 1, 2)"
_BEST = "best AS (SELECT doc_id, lang AS lang_pred, distance FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY distance, lang) AS r FROM dist) WHERE r = 1)"

ORACLES = {
    "term_counts": with_(TOK, CNT) + "SELECT * FROM cnt",
    "corpus_counts": with_(TOK) + "SELECT w, count(*) AS n FROM tok GROUP BY w",
    "doc_freq": with_(TOK, CNT, DF) + "SELECT * FROM dfq",
    "corpus_size": with_(TOK, CNT, SIZE) + "SELECT * FROM sz",
    "max_tf": with_(TOK, CNT) + "SELECT doc_id, max(n) AS max_n FROM cnt GROUP BY doc_id",
    "idf": with_(TOK, CNT, DF, SIZE, IDF) + "SELECT w, df, round(idf, 6) AS idf FROM idfq",
    "tf_idf": with_(TOK, CNT, DF, SIZE, _TFIDF) + "SELECT * FROM ti",
    "tf_idf_topk": with_(TOK, CNT, DF, SIZE, _TFIDF) + "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, w) AS INTEGER) AS rank FROM ti) WHERE rank <= 5",
    "good_turing": with_(TOK, "c AS (SELECT w, count(*) AS n FROM tok GROUP BY w)", "f AS (SELECT n AS r, count(*) AS n_r FROM c GROUP BY n)", "t AS (SELECT sum(n) AS total FROM c)")
    + "SELECT f.r, f.n_r, round(CASE WHEN f.r <= 5 THEN CAST((f.r + 1) * coalesce(u.n_r, 0) AS DOUBLE) / f.n_r / total ELSE CAST(f.r AS DOUBLE) / total END, 9) AS p FROM f LEFT JOIN f u ON u.r = f.r + 1, t",
    "unigrams": _gram_counts(1),
    "bigrams": _gram_counts(2),
    "trigrams": _gram_counts(3),
    "ngram_idf": "SELECT ngram, cnt, df, round(1 + log2(n_docs / (1.0 + df)), 6) AS idf FROM (" + _gram_counts(2) + "), (SELECT count(*) AS n_docs FROM documents) WHERE df + 1 <= n_docs",
    "ngram_idf_parity": "SELECT ngram, cnt, df, round(1 + log2(n_docs // (1 + df)), 6) AS idf FROM (" + _gram_counts(2) + "), (SELECT count(*) AS n_docs FROM documents) WHERE df + 1 <= n_docs",
    "ngrams_frequent": with_(SENT, _gram_sql(2)) + "SELECT ngram, count(*) AS cnt FROM g2 GROUP BY ngram HAVING count(*) > 5",
    "union_ngrams": with_(SENT, _gram_sql(1), _gram_sql(2), _gram_sql(3)) + " UNION ALL ".join(f"SELECT CAST({n} AS INTEGER) AS size, ngram, count(*) AS cnt FROM g{n} GROUP BY ngram" for n in (1, 2, 3)),
    "nonstop_run_ngrams": with_(SENT, f"f AS (SELECT *, w IN {STOP_SQL} AS stop FROM stok)", "r AS (SELECT *, sum(CAST(stop AS INTEGER)) OVER (PARTITION BY doc_id, sent ORDER BY pos) AS run FROM f)", "b AS (SELECT doc_id, w, lead(w) OVER (PARTITION BY doc_id, sent, run ORDER BY pos) AS w1 FROM r WHERE NOT stop)")
    + "SELECT doc_id, w || ' ' || w1 AS ngram, count(*) AS cnt FROM b WHERE w1 IS NOT NULL GROUP BY 1, 2",
    "ngram_idf_sizes": " UNION ALL ".join(f"SELECT CAST({n} AS INTEGER) AS size, ngram, cnt, df, round(1 + log2(n_docs / (1.0 + df)), 6) AS idf FROM ({_gram_counts(n)}), (SELECT count(*) AS n_docs FROM documents) WHERE df + 1 <= n_docs" for n in (1, 2, 3)),
    "content_run_counts": with_(SENT, f"f AS (SELECT *, w IN {STOP_SQL} AS stop FROM stok)", "r AS (SELECT *, sum(CAST(stop AS INTEGER)) OVER (PARTITION BY doc_id, sent ORDER BY pos) AS run FROM f)", "b AS (SELECT doc_id, w, lead(w) OVER x AS w1, lead(w, 2) OVER x AS w2 FROM r WHERE NOT stop WINDOW x AS (PARTITION BY doc_id, sent, run ORDER BY pos))", "g AS (SELECT 1 AS size, w AS ngram FROM b UNION ALL SELECT 2, w || ' ' || w1 FROM b WHERE w1 IS NOT NULL UNION ALL SELECT 3, w || ' ' || w1 || ' ' || w2 FROM b WHERE w2 IS NOT NULL)")
    + "SELECT CAST(size AS INTEGER) AS size, ngram, count(*) AS cnt FROM g GROUP BY 1, 2",
    "freq_json": with_(TOK, CNT) + "SELECT * FROM cnt",
    "lang_profiles": with_(_PROF) + "SELECT lang, gram, rank FROM prof",
    "lang_classify": with_(_PROF, _DOCG, _DIST, _BEST) + "SELECT * FROM best",
    "lang_candidates": with_(_PROF, _DOCG, _DIST) + "SELECT doc_id, string_agg('[' || lang || ']', '' ORDER BY distance, lang) AS labels FROM (SELECT *, min(distance) OVER (PARTITION BY doc_id) AS b FROM dist) WHERE distance <= 1.03 * b GROUP BY doc_id",
    "non_english": with_(_PROF, _DOCG, _DIST, _BEST) + "SELECT doc_id, lang_pred FROM best WHERE lang_pred <> 'en'",
}
