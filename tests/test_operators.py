import math

from pyspark.sql import functions as F

from loomtext.functions import tokens
from loomtext.operators import corpus, counts, features, ml, ngrams, ranking, textcat
from loomtext.sources import readers, writers
from loomtext.streaming import terms


def toks(spark):
    return tokens.terms(spark.createDataFrame([(1, "a a b"), (2, "a"), (3, None), (4, "")], "doc_id long, text string"))


def test_idf_and_tfidf(spark):
    n = counts.term_counts(toks(spark))
    df, size = counts.document_frequencies(n), counts.corpus_size(n)
    idf = {r.w: r.idf for r in counts.idf(df, size).collect()}
    assert math.isclose(idf["a"], 1 + math.log2(2 / 3)) and math.isclose(idf["b"], 1.0)
    got = {(r.doc_id, r.w): (r.tf, r.idf) for r in counts.tf_idf(n, df, size).collect()}
    assert got[1, "b"] == (0.75, 0.0) and math.isclose(got[1, "a"][1], math.log2(2 / 3))


def test_good_turing(spark):
    n = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("d", 9)], "w string, n long")
    p = {r.r: r.p for r in counts.good_turing(n).collect()}
    assert math.isclose(p[1], 2 * 1 / 2 / 13) and p[2] == 0 and math.isclose(p[9], 9 / 13)


def test_ngrams(spark):
    t = tokens.sentence_terms(spark.createDataFrame([(1, "x y z. x y")], "doc_id long, text string"))
    sizes = {n: {r.ngram: r.cnt for r in ngrams.ngram_counts(ngrams.ngrams(t, n, ["sent"])).collect()} for n in (1, 2, 3)}
    assert sizes == {1: {"x": 2, "y": 2, "z": 1}, 2: {"x y": 2, "y z": 1}, 3: {"x y z": 1}}
    runs = ngrams.content_runs(t, F.col("w") == "y")
    assert ngrams.ngrams(runs, 2, ["sent", "run"]).count() == 0


def test_number_rows(spark):
    df = spark.range(100).select((F.col("id") * 37 % 100).alias("x"))
    got = ranking.number_rows(df, [F.floor(F.col("x") / 10)], [F.col("x")]).collect()
    assert all(r.x + 1 == r.rank for r in got)


def test_encoding_round_trip(spark):
    t = tokens.paragraph_terms(spark.createDataFrame([(1, "b a\nb c"), (2, "a")], "doc_id long, text string"))
    d = features.term_dictionary(t)
    assert {r.w: r.term_id for r in d.collect()} == {"b": 0, "a": 1, "c": 2}
    e = features.encode(t, d)
    assert [r.ids for r in e.orderBy("doc_id", "para_id").collect()] == ["0 1", "0 2", "1"]
    labels = spark.createDataFrame([(1, 1), (2, -1)], "doc_id long, label int")
    got = {r.w: (r.in_pos, r.in_neg) for r in features.decode_counts(e, d, labels).collect()}
    assert got == {"a": (1, 1), "b": (2, 0), "c": (1, 0)}


def test_lm_lines_and_libsvm(spark):
    t = tokens.paragraph_terms(spark.createDataFrame([(i, "a b" if i else "a c") for i in range(6)], "doc_id long, text string"))
    df = counts.document_frequencies(counts.term_counts(t))
    assert {r.doc_id: r.line for r in features.lm_lines(t, df).collect()}[0] == "a <unk>"
    f = spark.createDataFrame([(1, 5, 0.12), (1, 2, 1.0)], "doc_id long, idx int, val double")
    lines = features.libsvm_lines(f, spark.createDataFrame([(1, -1)], "doc_id long, label int"), ["doc_id"], 2)
    assert lines.collect()[0].line == "-1 2:1.00 5:0.12"


def test_min_max(spark):
    f = spark.createDataFrame([(1, 1, 2.0), (2, 1, 4.0), (3, 1, 5.0)], "doc_id long, idx int, val double")
    got = {r.doc_id: r.val for r in features.min_max_scale(f, f.where("doc_id < 3")).collect()}
    assert got == {1: 0.0, 2: 1.0, 3: 1.5}


def test_textcat(spark):
    docs = spark.createDataFrame([(1, "en", "the cat and the dog"), (2, "de", "der hund und die katze")], "doc_id long, lang string, text string")
    pred = textcat.classify(textcat.distances(docs, textcat.profiles(docs)))
    assert {r.doc_id: r.lang_pred for r in pred.collect()} == {1: "en", 2: "de"}
    joined = textcat.distances(docs, textcat.profiles(docs), max_models=0)
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, textcat.distances(docs, textcat.profiles(docs)).collect()))
    assert textcat.candidates(textcat.distances(docs, textcat.profiles(docs))).count() == 2


def test_json_round_trips(spark, tmp_path):
    n = spark.createDataFrame([("a", 3), ("b", 1)], "w string, n long")
    path = str(tmp_path / "f")
    writers.text_lines(writers.as_json_object(n, "w", "n"), "value", path, single_file=True)
    assert {r.term: r.n for r in readers.counts_json(spark, path).collect()} == {"a": 3, "b": 1}
    writers.dictionary(spark.createDataFrame([(0, "x"), (1, "y")], "term_id long, w string"), str(tmp_path / "m"))
    assert {r.term: r.term_id for r in readers.word_map(spark, str(tmp_path / "m")).collect()} == {"x": 0, "y": 1}


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1 0 1 2\n-1 3\n")
    assert [(r.label, r.term_id) for r in readers.encoded(spark, str(tmp_path / "a.txt")).collect()] == [(1, 0), (1, 1), (1, 2), (-1, 3)]
    (tmp_path / "l.list").write_text("a b\n\nc\n")
    assert [(r.ngram, r.id) for r in readers.ngram_list(spark, str(tmp_path / "l.list")).collect()] == [("a b", 0), ("c", 1)]
    (tmp_path / "xx.lm").write_text("_\t9\ne\t5\n")
    assert [(r.lang, r.gram, r["rank"]) for r in readers.language_model(spark, str(tmp_path / "xx.lm")).orderBy("rank").collect()] == [("xx", "_", 1), ("e", "e", 2)][:1] + [("xx", "e", 2)]
    assert readers.corpus(spark, str(tmp_path), "*.txt").count() == 1
    (tmp_path / "v").write_text("1 1:0.5 3:0.25\n")
    assert [(r.idx, r.val) for r in readers.libsvm(spark, str(tmp_path / "v")).collect()] == [(1, 0.5), (3, 0.25)]
    p = spark.createDataFrame([("/a/b/c.x.txt",)], "p string").select(readers.path_parts(F.col("p")).alias("s")).collect()[0].s
    assert (p.dir, p.name, p.ext) == ("/a/b/", "c.x", "txt")
    x = spark.createDataFrame([(1, "<a/>"), (2, "<a>")], "i int, d string")
    assert [r.d for r in readers.well_formed(x, "d").orderBy("i").collect()] == ["<a/>", None]


def test_side_outputs(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    assert [r.doc_id for r in writers.rejected(docs, docs.where("doc_id = 1")).collect()] == [2]
    j = writers.job_response(spark.createDataFrame([("{}", "ok", -1)], "a string, l string, s int"), "a", "l", "s").collect()[0].value
    assert j == '{"annotations":"{}","log":"ok","status":-1}'


def test_folds(spark):
    df = spark.range(50).withColumn("f", ml.fold(F.col("id"), 5))
    assert {r.f for r in df.collect()} <= set(range(5)) and ml.subset(df, "id", 7).count() == 7


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a b a",)], "text string").write.parquet(src)
    terms.run_available(terms.running_counts(spark.readStream.schema("text string").parquet(src)), "t_terms", "complete", str(tmp_path / "cp"))
    assert {r.w: r.n for r in spark.table("t_terms").collect()} == {"a": 2, "b": 1}


def test_words_at(spark):
    pages = spark.createDataFrame([(1, '<div class="ltx_para">There are 12 numbers. Studies go.</div>'), (2, None)], "page_id int, html string")
    got = corpus.words_at(pages, normalize=True, stem=True, mark_end=True).collect()
    assert [r.words for r in got] == ["there be nnumber number . endofsentence study go . endofsentence".split()]
    assert corpus.words_at(pages, alpha_only=True, drop_stopwords=True).collect()[0].words == ["numbers", "Studies", "go"]


def test_prepare(spark):
    docs = spark.createDataFrame([(1, "en", "the cat and the dog"), (2, "de", "der hünd und die katze"), (3, "en", None)], "doc_id long, lang string, text string")
    kept, rejected = corpus.prepare(docs, textcat.profiles(docs), "de")
    assert [(r.doc_id, r.text) for r in kept.collect()] == [(2, "der hund und die katze")]
    assert sorted(r.doc_id for r in rejected.collect()) == [1, 3]
    assert corpus.prepare(docs)[0].count() == 3


def test_tags_and_lookup(spark):
    rows = spark.createDataFrame([(1, ["a", "b"], ["X"])], "k int, w array<string>, t array<string>")
    assert [(r.word_id, r.word, r.tag) for r in corpus.zip_tags(rows, "w", "t", ["k"]).collect()] == [(1, "a", "X"), (2, "b", None)]
    table = spark.createDataFrame([(1, "MathExpr-1", "<m/>")], "k int, mark string, node string")
    marks = spark.createDataFrame([(1, "MathExpr-1) "), (1, "no")], "k int, mark string")
    assert {r.mark: r.node for r in corpus.lookup(marks, table, ["k"]).collect()} == {"MathExpr-1": "<m/>", "no": None}


def test_replace_word_and_time(spark):
    row = spark.createDataFrame([("a b ab a",)], "x string").select(tokens.replace_word(F.col("x"), "a", "$").alias("y"), tokens.utc_time(F.timestamp_seconds(F.lit(0))).alias("t")).collect()[0]
    assert (row.y, row.t) == ("$ b ab $", "1970-01-01 00:00:00 GMT")
