"""Feature vectors, dictionaries, splits and scaling; a document's lines are its paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import stopwords, tokens
from ..operators import counts as C, features as X, inplace as P, ml, ngrams as G
from ..sources.staging import stage
from .common import LABELS, PARA, documents, labels, para_terms, table, with_

CUTOFF, TRAIN_FOLDS = 7.0, 5


#: Words that go to all tasks at most. Those below the cutoff are in more than one document of 64,
#: so they are fewer than 64 times the words of a mean document.
MODEL = 200_000


class _Words:
    """Gathered texts, the staged document frequencies, idf and bins of their words, and the words below the cutoff."""

    def __init__(self, spark: SparkSession, sf_dir: str, content: bool = False):
        self.without = stopwords.EXTENDED if content else ()
        self.docs = P.gathered(documents(spark, sf_dir))
        found = stage(P.frequencies(self.docs, self.without), "frequencies")
        self.idf = C.idf(found.where("w <> ''"), found.where("w = ''").select(F.col("df").alias("n_docs")))
        self.bins = X.bins(self.idf, CUTOFF)

    def model(self) -> P.Model | None:
        """Bin and idf by word; None if there are too many, and the relations have to be joined."""
        rows = self.bins.limit(MODEL + 1).collect()
        return {r["w"]: (r["bin"], r["idf"]) for r in rows} if len(rows) <= MODEL else None

    def tokens(self) -> DataFrame:
        t = tokens.paragraph_terms(self.docs)
        return t.where(~F.col("w").isin(list(self.without))) if self.without else t

    def counts(self) -> DataFrame:
        return stage(X.paragraph_counts(self.tokens()), "paragraph-counts")


def bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _Words(spark, sf_dir).bins.select("w", "bin")


def _tfidf(w: _Words) -> DataFrame:
    model = w.model()
    f = X.tfidf_vectors(w.counts(), w.bins) if model is None else P.tfidf_vectors(w.docs, model, without=w.without)
    return f.withColumn("val", F.round("val", 6))


def tfidf_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tfidf(_Words(spark, sf_dir))


def tfc_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _Words(spark, sf_dir)
    model = w.model()
    f = X.tfc_vectors(w.counts(), w.bins) if model is None else P.tfc_vectors(w.docs, model)
    return f.withColumn("val", F.round("val", 6))


def content_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length-normalised vectors over content words only."""
    return _tfidf(_Words(spark, sf_dir, content=True))


def doc_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _Words(spark, sf_dir)
    model = w.model()
    n = X.doc_norms(X.document_counts(w.counts()), w.bins) if model is None else P.doc_norms(w.docs, model)
    return n.select("doc_id", F.round("norm", 5).alias("norm"))


def occurrence_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _Words(spark, sf_dir)
    model = w.model()
    f = X.occurrence_vectors(w.tokens(), w.counts(), w.bins, w.idf) if model is None else P.occurrence_vectors(w.docs, model, w.idf)
    return f.withColumn("val", F.round("val", 6))


def _dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The n-grams of the benchmark items that occur in at least two of them."""
    bench = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    t = tokens.paragraph_terms(bench)
    parts = [G.ngram_counts(G.ngrams(t, n, ["para_id"])).where("df >= 2").select("ngram", F.lit(n).alias("size")) for n in (1, 2, 3)]
    from ..operators.ranking import number_rows

    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return number_rows(both, [F.col("size"), F.substring("ngram", 1, 2)], [F.col("ngram")], "n").select("ngram", "size", (F.col("n") + 2).cast("long").alias("idx"))


def ngram_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.ngram_presence(para_terms(spark, sf_dir), _dictionary(spark, sf_dir))


def paragraph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each paragraph, its ordinal among paragraphs with words, and how many those are."""
    from pyspark.sql import Window

    w = X.lengths(X.paragraph_counts(para_terms(spark, sf_dir)))
    doc = Window.partitionBy("doc_id")
    return w.select("doc_id", "para_id", "wc", F.count(F.lit(1)).over(doc).alias("n_paras"), F.row_number().over(doc.orderBy("para_id")).cast("long").alias("ordinal"))


def term_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.term_dictionary(P.gathered(documents(spark, sf_dir))).select("w", "term_id")


def encode_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = P.gathered(documents(spark, sf_dir))
    return P.encode(docs, stage(P.term_dictionary(docs), "dictionary")).select("doc_id", "para_id", F.md5("ids").alias("digest"))


def decode_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = P.gathered(documents(spark, sf_dir))
    d = stage(P.term_dictionary(docs), "dictionary")
    lab = labels(spark, sf_dir)
    return X.decode_counts(P.encode(docs.join(lab, "doc_id", "left_semi"), d), d, lab)


def lm_unk(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = para_terms(spark, sf_dir)
    lines = X.lm_lines(t, C.document_frequencies(C.term_counts(t))).join(labels(spark, sf_dir), "doc_id")
    return lines.select("doc_id", "para_id", "label", F.md5("line").alias("digest"))


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.posexplode("embedding").alias("idx", "val"))
    return e.select("doc_id", F.col("idx").cast("long").alias("idx"), F.col("val").cast("double").alias("val"))


def minmax_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _dense(spark, sf_dir)
    return X.min_max_scale(f, f.where(F.col("doc_id") % TRAIN_FOLDS != 0)).withColumn("val", F.round("val", 6))


def libsvm_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _Words(spark, sf_dir)
    model = w.model()
    if model is None:
        per = w.counts()
        f = X.lengths(per).select("doc_id", "para_id", F.lit(1).cast("long").alias("idx"), F.col("wc").cast("double").alias("val"))
        g = per.join(w.bins, "w").select("doc_id", "para_id", (F.col("bin") + 1).alias("idx"), F.col("k").cast("double").alias("val"))
        lines = X.libsvm_lines(f.unionByName(g), labels(spark, sf_dir), ["doc_id", "para_id"])
    else:
        lines = P.libsvm_lines(w.docs.join(X.distinct_labels(labels(spark, sf_dir)), "doc_id"), model)
    return lines.select("doc_id", "para_id", F.md5("line").alias("digest"))


def label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id").join(labels(spark, sf_dir), "doc_id", "left")


def cv_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", ml.fold(F.col("doc_id"), 5, hashed=False).alias("fold"))


def random_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml.subset(labels(spark, sf_dir), "doc_id", 100)


def linear_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings of even against odd label, trained on four folds of five and applied to the last."""
    e = table(spark, sf_dir, "embeddings")
    lab = e.select(F.col("vec_id").alias("doc_id"), F.when(F.col("label") % 2 == 0, 1).otherwise(-1).alias("label"))
    v = ml.vectors(_dense(spark, sf_dir).withColumn("idx", F.col("idx") + 1), lab, 64)
    part = ml.fold(F.col("doc_id"), TRAIN_FOLDS)
    return ml.train_predict(v.where(part != 0), v.where(part == 0), max_iter=10)


QUERIES = {f.__name__: f for f in (bins, tfidf_features, tfc_features, content_features, doc_norm, occurrence_features, ngram_presence, paragraph_counts, term_dictionary, encode_documents, decode_counts, lm_unk, minmax_scale, libsvm_lines, label_join, cv_split, random_subset, linear_svm)}

_BASE = (
    PARA,
    "cnt AS (SELECT doc_id, w, count(*) AS n FROM ptok GROUP BY doc_id, w)",
    "dfq AS (SELECT w, count(*) AS df FROM cnt GROUP BY w)",
    "sz AS (SELECT count(DISTINCT doc_id) AS n_docs FROM cnt)",
    "idfq AS (SELECT w, df, 1 + log2(n_docs / (1.0 + df)) AS idf FROM dfq, sz)",
    f"binq AS (SELECT w, idf, row_number() OVER (ORDER BY df DESC, w) AS bin FROM idfq WHERE idf < {CUTOFF})",
)
_OCC = "per AS (SELECT doc_id, para_id, w, count(*) AS k FROM ptok GROUP BY ALL), tf AS (SELECT doc_id, w, 0.5 + 0.5 * n / max(n) OVER (PARTITION BY doc_id) AS tf FROM cnt), wt AS (SELECT doc_id, para_id, bin, k, tf, idf FROM per JOIN tf USING (doc_id, w) JOIN binq USING (w)), len AS (SELECT doc_id, para_id, count(*) AS wc FROM ptok GROUP BY ALL)"
_TFIDF = "SELECT doc_id, para_id, bin, round(k * tf * idf / wc, 6) AS val FROM wt JOIN len USING (doc_id, para_id) WHERE k * tf * idf > 0.001"
_DICT = "dict AS (SELECT w, row_number() OVER (ORDER BY doc_id, para_id, pos) - 1 AS term_id FROM (SELECT w, doc_id, para_id, pos FROM ptok QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, para_id, pos) = 1))"
_NORM = "norm AS (SELECT doc_id, sqrt(sum((n * coalesce(idf, 13)) * (n * coalesce(idf, 13)))) AS norm FROM cnt LEFT JOIN {0} USING (w) GROUP BY doc_id)"


def _gram_cte(name: str, src: str, key: str) -> str:
    return f"""{name} AS (SELECT {key}, para_id, w AS g1, w || ' ' || w1 AS g2, w || ' ' || w1 || ' ' || w2 AS g3
  FROM (SELECT {key}, para_id, w, lead(w, 1) OVER x AS w1, lead(w, 2) OVER x AS w2 FROM {src} WINDOW x AS (PARTITION BY {key}, para_id ORDER BY pos)))"""


_BTOK = """bpara AS (SELECT item_id, CAST(generate_subscripts(p, 1) AS INTEGER) AS para_id, unnest(p) AS para FROM (SELECT item_id, string_split(text, chr(10)) AS p FROM benchmark)),
btok AS (SELECT item_id, para_id, generate_subscripts(a, 1) AS pos, unnest(a) AS w FROM (SELECT item_id, para_id, regexp_extract_all(lower(para), '[a-z]+') AS a FROM bpara))"""
_BDICT = """bd AS (SELECT size, ngram, row_number() OVER (ORDER BY size, ngram) + 2 AS idx FROM (
  SELECT 1 AS size, g1 AS ngram FROM bg GROUP BY g1 HAVING count(DISTINCT item_id) >= 2
  UNION ALL SELECT 2, g2 FROM bg WHERE g2 IS NOT NULL GROUP BY g2 HAVING count(DISTINCT item_id) >= 2
  UNION ALL SELECT 3, g3 FROM bg WHERE g3 IS NOT NULL GROUP BY g3 HAVING count(DISTINCT item_id) >= 2))"""
_DENSE = "d AS (SELECT vec_id AS doc_id, generate_subscripts(embedding, 1) - 1 AS idx, CAST(unnest(embedding) AS DOUBLE) AS val FROM embeddings)"

ORACLES = {
    "bins": with_(*_BASE) + "SELECT w, bin FROM binq",
    "tfidf_features": with_(*_BASE, _OCC) + _TFIDF,
    "tfc_features": with_(*_BASE, _OCC, "n AS (SELECT doc_id, para_id, sqrt(1 + sum(k * (tf * idf) * (tf * idf))) AS d FROM wt GROUP BY ALL)") + "SELECT doc_id, para_id, bin, round(k * (tf * idf) / d, 6) AS val FROM wt JOIN n USING (doc_id, para_id) WHERE k * (tf * idf) > 0.001",
    "doc_norm": with_(*_BASE, _NORM.format("binq")) + "SELECT doc_id, round(norm, 5) AS norm FROM norm",
    "occurrence_features": with_(
        *_BASE,
        _NORM.format("idfq"),
        "o AS (SELECT doc_id, para_id, pos, w, bin, idf, row_number() OVER (PARTITION BY doc_id, w ORDER BY para_id, pos) - 1 AS i, n * idf / norm AS v FROM ptok JOIN binq USING (w) JOIN cnt USING (doc_id, w) JOIN norm USING (doc_id))",
        "r AS (SELECT *, sum(v) OVER (PARTITION BY doc_id, para_id, w ORDER BY pos ROWS UNBOUNDED PRECEDING) AS running FROM o)",
        "f AS (SELECT doc_id, para_id, i, unnest(list_filter([CASE WHEN idf > 7.5 THEN 0 END, CASE WHEN idf > 4 THEN 1 END, CASE WHEN running > 0.12 THEN 2 END, CASE WHEN running > 0.4 THEN 3 END], lambda x: x IS NOT NULL)) AS f FROM r WHERE i < 3)",
    )
    + """SELECT doc_id, para_id, CAST(4 * i + f AS BIGINT) AS idx, CAST(count(*) AS DOUBLE) AS val FROM f GROUP BY 1, 2, 3
UNION ALL SELECT doc_id, para_id, CAST(13 + bin AS BIGINT), round(sum(v), 6) FROM r GROUP BY 1, 2, 3 HAVING sum(v) > 0.0005
UNION ALL SELECT doc_id, para_id, 13, CAST(count(*) AS DOUBLE) FROM ptok GROUP BY 1, 2""",
    "ngram_presence": with_(PARA, _BTOK, _gram_cte("bg", "btok", "item_id"), _BDICT, _gram_cte("dg", "ptok", "doc_id"), "h AS (SELECT doc_id, para_id, a.idx AS i1, b.idx AS i2, CASE WHEN b.idx IS NOT NULL THEN c.idx END AS i3 FROM dg JOIN bd a ON a.size = 1 AND a.ngram = g1 LEFT JOIN bd b ON b.size = 2 AND b.ngram = g2 LEFT JOIN bd c ON c.size = 3 AND c.ngram = g3)")
    + "SELECT DISTINCT doc_id, para_id, idx FROM (SELECT doc_id, para_id, unnest([i1, i2, i3]) AS idx FROM h) WHERE idx IS NOT NULL",
    "paragraph_counts": with_(PARA, "l AS (SELECT doc_id, para_id, count(*) AS wc FROM ptok GROUP BY ALL)") + "SELECT doc_id, para_id, wc, count(*) OVER (PARTITION BY doc_id) AS n_paras, row_number() OVER (PARTITION BY doc_id ORDER BY para_id) AS ordinal FROM l",
    "term_dictionary": with_(PARA, _DICT) + "SELECT w, term_id FROM dict",
    "encode_documents": with_(PARA, _DICT) + "SELECT doc_id, para_id, md5(string_agg(CAST(term_id AS VARCHAR), ' ' ORDER BY pos)) AS digest FROM ptok JOIN dict USING (w) GROUP BY doc_id, para_id",
    "decode_counts": with_(PARA, LABELS) + "SELECT w, count(*) FILTER (label = 1) AS in_pos, count(*) FILTER (label = -1) AS in_neg FROM ptok JOIN lab USING (doc_id) GROUP BY w",
    "lm_unk": with_(PARA, LABELS, "dfq AS (SELECT w, count(DISTINCT doc_id) AS df FROM ptok GROUP BY w)") + "SELECT doc_id, para_id, label, md5(string_agg(CASE WHEN df > 4 THEN w ELSE '<unk>' END, ' ' ORDER BY pos)) AS digest FROM ptok JOIN dfq USING (w) JOIN lab USING (doc_id) GROUP BY doc_id, para_id, label",
    "minmax_scale": with_(_DENSE, f"r AS (SELECT idx, min(val) AS lo, max(val) AS hi FROM d WHERE doc_id % {TRAIN_FOLDS} <> 0 GROUP BY idx)") + "SELECT doc_id, d.idx, round(CASE WHEN hi > lo THEN 0.0 + 1.0 * (val - lo) / (hi - lo) ELSE 0.0 END, 6) AS val FROM d JOIN r USING (idx)",
    "libsvm_lines": with_(*_BASE, LABELS, "f AS (SELECT doc_id, para_id, 1 AS idx, count(*) AS val FROM ptok GROUP BY 1, 2 UNION ALL SELECT doc_id, para_id, bin + 1, count(*) FROM ptok JOIN binq USING (w) GROUP BY 1, 2, 3)")
    + "SELECT doc_id, para_id, md5(label || ' ' || string_agg(idx || ':' || format('{:.6f}', CAST(val AS DOUBLE)), ' ' ORDER BY idx)) AS digest FROM f JOIN lab USING (doc_id) GROUP BY doc_id, para_id, label",
    "label_join": with_(LABELS) + "SELECT documents.doc_id, label FROM documents LEFT JOIN lab USING (doc_id)",
    "cv_split": "SELECT doc_id, CAST(doc_id % 5 AS INTEGER) AS fold FROM documents",
}


def _content() -> str:
    from .common import STOP_SQL

    return ORACLES["tfidf_features"].replace("regexp_extract_all(lower(para), '[a-z]+') AS a FROM para))", "list_filter(regexp_extract_all(lower(para), '[a-z]+'), lambda x: x NOT IN " + STOP_SQL + ") AS a FROM para))")


ORACLES["content_features"] = _content()
