"""The registered queries and the pipeline over the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_pipeline_stages(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids, sizes = docs.columns, {r.doc_id for r in docs.collect()}, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= ids and docs.count() == len(now)
        ids = now
        sizes.append(len(now))
    assert sizes[0] > sizes[1] > sizes[2] > 0
    rows = docs.orderBy("start").collect()
    assert rows[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))


def test_names():
    names = entry.queries()
    assert [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in names)] == [] and "pipeline" in names


def test_oracles(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name in ("op1_topk", "op7_warc"):
        df = entry.queries()[name](spark, SF)
        want = con.sql(entry.oracle_sql()[name]).df()
        got = sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)
        rows = [tuple(None if v is None or v != v else v for v in row) for row in want[sorted(want.columns)].astype(object).where(want.notna(), None).itertuples(index=False, name=None)]
        assert got == sorted(rows, key=repr), name


def _rows(spark):
    from loomtext.llm import scratch

    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omikron pi rho sigma tau phi chi psi omega".split()
    text = lambda k, n=40: " ".join(words[(k * 7 + i * (k % 5 + 1) + i * i) % len(words)] + str(k) for i in range(n))
    rows = [(k, text(k), ["en", None, "de"][k % 3], ["a", None, "b"][k % 3], 1) for k in range(30)]
    rows += [(40, None, "en", "a", None), (41, "", None, None, 0), (42, "12 ?!", "en", "a", 5), (None, text(50), None, "a", 1), (None, None, None, None, None), (43, text(3), "en", "b", 2), (5, text(5), "en", "b", 3), (5, text(5), "en", "b", 3), (44, text(60, 9000), "de", "b", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("key", "size", "rank", "__h", "__n", "__bad", "__r", "label"):
        docs = docs.selectExpr("*", f"'x' AS `{name}`")
    path = scratch.new_path(spark, "benchmark") + "/benchmark.parquet"
    spark.createDataFrame([(1, text(7)), (2, None), (3, "few"), (None, "")], "item_id long, text string").write.parquet(path)
    return docs, path.rsplit("/", 1)[0]


def test_stages_with_nulls_repeats_and_clashing_names(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs, folder = _rows(spark)
    want = [{*range(30), None, 43, 5, 44}, {*range(30), None, 44}, {*range(30), None, 44} - {7}, {*range(30), None, 44} - {7}]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        rows = out.collect()
        if k < 4:
            assert out.columns == docs.columns and {r.doc_id for r in rows} == want[k], name
            assert all(r.key == r["__h"] == r.label == "x" for r in rows)
            docs = spark.createDataFrame(rows, out.schema)
        else:
            assert {r.doc_id for r in rows} == want[3] and len(rows) == docs.count()


def test_stages_on_an_empty_table(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs, folder = _rows(spark)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), folder).count() == 0, name
