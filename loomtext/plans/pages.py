"""Pages: text, paragraphs, nodes and trees; range joins; streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import dom, markup, sentences, tokens, trees
from ..operators import corpus, textcat
from ..streaming import terms
from .common import documents, spread, table, with_
from .statistics import _BEST, _DIST, _DOCG, _PROF
from .text import _ascii_sql

_SILENT = r"(?is)<head.*?</head>|<script.*?</script>|<style.*?</style>|<!--.*?-->"


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text by expressions alone: silent elements, then tags, become blanks."""
    t = F.regexp_replace(F.regexp_replace("html", _SILENT, " "), "<[^>]*>", " ")
    return table(spark, sf_dir, "pages").select("page_id", F.md5(t).alias("digest"), F.length(t).cast("long").alias("n_chars"))


def html_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.regexp_extract_all("html", F.lit("(?s)<p>(.*?)</p>"), 1)
    x = table(spark, sf_dir, "pages").select("page_id", F.posexplode(p).alias("para_id", "text"))
    return x.select("page_id", F.col("para_id").cast("long").alias("para_id"), F.md5("text").alias("digest"))


def page_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.regexp_extract_all("html", F.lit("<a [^>]*>([^<]*)</a>"), 1)
    return table(spark, sf_dir, "pages").select("page_id", F.explode(a).alias("anchor")).groupBy("page_id", "anchor").agg(F.count(F.lit(1)).alias("n"))


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Math and citation elements, planted around every anchor, become marker words."""
    h = F.regexp_replace("html", "(?s)<a [^>]*>(.*?)</a>", "<math><mi>x</mi></math><cite>$1</cite>")
    h = F.regexp_replace(F.regexp_replace(h, "(?is)<math.*?</math>", " MathFormula "), "(?is)<cite.*?</cite>", " CiteExpression ")
    return table(spark, sf_dir, "pages").select("page_id", F.md5(h).alias("digest"))


def page_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start tags by name and page."""
    t = F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), 1)
    return table(spark, sf_dir, "pages").select("page_id", F.explode(t).alias("tag")).groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


def _in_lines(d: DataFrame, marks: DataFrame) -> DataFrame:
    """Number and first offset of the marks (doc_id, offset) in each line, by an equi-join on the document with a range residual."""
    lines = tokens.paragraphs(d).withColumn("size", F.length("para"))
    from pyspark.sql import Window

    before = F.coalesce(F.sum(F.col("size") + 1).over(Window.partitionBy("doc_id").orderBy("para_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = lines.select(F.col("doc_id").alias("d"), "para_id", before.alias("start"), (before + F.col("size")).alias("end"))
    hit = marks.join(spans, (F.col("doc_id") == F.col("d")) & (F.col("start") <= F.col("offset")) & (F.col("offset") < F.col("end")))
    return hit.groupBy("doc_id", "para_id").agg(F.count(F.lit(1)).alias("n"), F.min("offset").cast("long").alias("first_offset"))


def range_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens in the line that holds them: the join of offsets with ranges."""
    # shuffled once, as texts: lines and tokens are cut where they are joined
    d = table(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id")
    return _in_lines(d, d.select("doc_id", F.explode(tokens.starts(F.col("text"))).alias("offset")))


def dom_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "pages").select("page_id", dom.plain_text(F.col("html"), math="normalize", cite="normalize", drop_notes=True).alias("t"))
    return t.select("page_id", F.length("t").alias("n_chars"), F.md5("t").alias("digest"))


def dom_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dom.nodes(table(spark, sf_dir, "pages"))


def dom_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = dom.page_paragraphs(table(spark, sf_dir, "pages"))
    return p.select("page_id", "para_id", "label", F.md5("text").alias("digest"))


def node_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deepest node around the first character of every token of a page."""
    return dom.nodes_at(table(spark, sf_dir, "pages"), tokens.WORD)


def node_enclosing(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = dom.nodes(table(spark, sf_dir, "pages"))
    p = n.where("tag = 'p' and end > start").select("page_id", F.col("start").alias("from"), F.col("end").alias("to"))
    return dom.node_around(n, p)


def page_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraph driver with all steps on."""
    w = corpus.words_at(table(spark, sf_dir, "pages"), dom_options={"math": "normalize"}, normalize=True, stem=True, mark_end=True)
    return w.select("page_id", "para_id", "label", F.size("words").alias("n_words"), F.md5(F.array_join("words", " ")).alias("digest"))


def english_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents guessed to be English, folded to ASCII."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    kept, _ = corpus.prepare(d, textcat.profiles(d), "en")
    return kept.select("doc_id", F.md5("text").alias("digest"))


def page_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of the paragraphs of pages, end to end."""
    p = dom.page_paragraphs(table(spark, sf_dir, "pages"))
    s = p.select("page_id", "para_id", "text", F.posexplode(sentences.sentence_ranges(F.col("text"))).alias("sent_id", "r"))
    return s.select("page_id", "para_id", "sent_id", F.md5(sentences.range_text(F.col("text"), F.col("r.start"), F.col("r.end"))).alias("digest"))


def marked_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "pages").select("page_id", dom.with_sentences(F.col("html")).alias("h"))
    return m.select("page_id", F.size(F.regexp_extract_all("h", F.lit('<span class="ltx_sentence"'), 0)).alias("n_sentences"), F.md5("h").alias("digest"))


def _xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An XML document around each whole text; signs that XML can't hold become blanks."""
    d = documents(spark, sf_dir)
    text = F.regexp_replace("text", r"[\x00-\x08\x0B\x0C\x0E-\x1F\uFFFE\uFFFF]", " ")
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    doc = F.concat(F.lit("<document><para><p>"), text, F.lit(' by <Math xml:id="S'), F.col("doc_id").cast("string"), F.lit('.p1.1.m1" tex="x"><XMath><XMTok>x</XMTok></XMath></Math> and <cite>'), F.col("doc_id").cast("string"), F.lit("</cite>.</p></para></document>"))
    return d.select("doc_id", doc.alias("doc"))


def normalized_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _xml(spark, sf_dir).select("doc_id", F.explode(markup.marks(F.col("doc"))).alias("m")).select("doc_id", "m.mark", "m.node")


def mark_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.tokens_of(_xml(spark, sf_dir))


def tree_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.class_sizes(trees.tree_classes(table(spark, sf_dir, "pages")))


def tree_classes_light(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.class_sizes(trees.tree_classes(table(spark, sf_dir, "pages"), with_text=False))


def stream_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term counts of the conversations, read as a stream."""
    src = table(spark, sf_dir, "conversations")
    # as a pattern, since a stream takes a single file by no other name; it names a folder of files as well
    stream = spark.readStream.schema(src.schema).parquet(f"{sf_dir}/conversations[.]parquet")
    terms.run_available(terms.running_counts(stream), "loomtext_terms", "complete")
    return spark.table("loomtext_terms")


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts by type; the streaming query's plan over the table as it is."""
    out = terms.windowed_counts(table(spark, sf_dir, "events"))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


QUERIES = {f.__name__: f for f in (html_text, html_paragraphs, page_anchors, markers, page_tags, range_tokens, dom_text, dom_nodes, dom_paragraphs, node_lookup, node_enclosing, page_words, english_folded, page_sentences, marked_sentences, normalized_marks, mark_tokens, tree_classes, tree_classes_light, stream_terms, event_windows)}

#: ``tokens.WORD`` for a dialect without look-ahead: a dash between letters is a match of its own, left out afterwards.
_WORD_SQL = r"''s|n''t|[A-Za-z]+|[0-9]+(?:[.,][0-9]+)*|[^\s\x0bA-Za-z0-9]"

ORACLES = {
    "english_folded": with_(_PROF, _DOCG, _DIST, _BEST) + f"SELECT doc_id, md5({_ascii_sql()}) AS digest FROM documents JOIN best USING (doc_id) WHERE lang_pred = 'en'",
    "html_text": rf"SELECT page_id, md5(t) AS digest, length(t) AS n_chars FROM (SELECT page_id, regexp_replace(regexp_replace(html, '{_SILENT}', ' ', 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages)",
    "html_paragraphs": "SELECT page_id, generate_subscripts(a, 1) - 1 AS para_id, md5(unnest(a)) AS digest FROM (SELECT page_id, regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1) AS a FROM pages)",
    "page_anchors": "SELECT page_id, anchor, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*>([^<]*)</a>', 1)) AS anchor FROM pages) GROUP BY 1, 2",
    "markers": r"SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<a [^>]*>(.*?)</a>', '<math><mi>x</mi></math><cite>\1</cite>', 'g'), '(?is)<math.*?</math>', ' MathFormula ', 'g'), '(?is)<cite.*?</cite>', ' CiteExpression ', 'g')) AS digest FROM pages",
    "page_tags": "SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY 1, 2",
    # a token or else one sign at a time, so that the lengths before a token are its offset
    "range_tokens": f"""WITH l AS (SELECT doc_id, CAST(generate_subscripts(p, 1) AS INTEGER) AS para_id, length(unnest(p)) AS size FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
s AS (SELECT doc_id, para_id, coalesce(sum(size + 1) OVER (PARTITION BY doc_id ORDER BY para_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, size FROM l),
u AS (SELECT doc_id, generate_subscripts(a, 1) AS i, unnest(a) AS t FROM (SELECT doc_id, regexp_extract_all(text, '(?:{_WORD_SQL})|(?s:.)') AS a FROM documents)),
o AS (SELECT doc_id, t, coalesce(sum(length(t)) OVER (x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o, coalesce(lag(t) OVER x, '') AS before, coalesce(lead(t) OVER x, '') AS after FROM u WINDOW x AS (PARTITION BY doc_id ORDER BY i)),
m AS (SELECT doc_id, o FROM o WHERE regexp_full_match(t, '{_WORD_SQL}') AND NOT (t = '-' AND regexp_full_match(before, '[A-Za-z]+') AND regexp_matches(after, '^[A-Za-z]')))
SELECT m.doc_id, para_id, count(*) AS n, CAST(min(o) AS BIGINT) AS first_offset FROM m JOIN s ON m.doc_id = s.doc_id AND start <= o AND o < start + size GROUP BY 1, 2""",
    "stream_terms": "SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM conversations) GROUP BY w",
    "event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}
