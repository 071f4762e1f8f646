"""Queries over pages and ranges against brute force."""

import re
from collections import defaultdict

from loomtext.functions import dom, tokens
from loomtext.plans import pages


def starts(text):
    return [m.start() for m in re.finditer(tokens.WORD, text, re.ASCII)]


def test_range_tokens(spark, tmp_path):
    texts = {1: "One, two\n\nit's 3.5 " + "long " * 40 + "\n \nx\n", 2: "", 3: None, 4: "\U0001d400 été y\nend"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = defaultdict(list)
    for i, t in texts.items():
        for o in starts(t or ""):
            want[i, t.count("\n", 0, o) + 1].append(o)
    got = {(r.doc_id, r.para_id): (r.n, r.first_offset) for r in pages.range_tokens(spark, str(tmp_path)).collect()}
    assert got == {k: (len(v), v[0]) for k, v in want.items()} and (1, 5) in got and len(got) == 5


def test_node_lookup(spark, tmp_path):
    html = {1: "<div>ab <p>cd<b>ef</b> gh</p><p>i</p><p>" + "word " * 60 + "</p></div>", 2: "", 3: None}
    spark.createDataFrame(list(html.items()), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    text, nodes = dom.flatten(dom.parse(html[1]))
    want = {o: max((n["depth"], n["node_id"]) for n in nodes if n["start"] <= o < n["end"])[1] for o in starts(text)}
    got = {r.offset: r.node_id for r in pages.node_lookup(spark, str(tmp_path)).collect()}
    assert got == want and len(got) > 60


def test_marks_of_whole_documents(spark, tmp_path):
    texts = {1: "a < b & c ]]> d", 2: "bad \x01 sign\uffff", 3: "word " * 20_000, 4: "", 5: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = pages.normalized_marks(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in found) == [1, 1, 2, 2, 3, 3, 4, 4]
    words = [(r.doc_id, r.text) for r in pages.mark_tokens(spark, str(tmp_path)).collect() if r.kind == "word"]
    assert words.count((3, "word")) == 20_000 and {(1, "d"), (2, "sign")} <= set(words)


def test_deeply_nested_pages():
    from loomtext.functions import dom, markup, trees

    n = 10_000
    for page in ("<div>" * n + "One is here. Two is there." + "</div>" * n, "<div>" * n + "One is here. Two is there."):
        root = dom.parse(page)
        text, rows = dom.flatten(root)
        assert text == "One is here. Two is there." and len(rows) == n + 1 and rows[-1]["depth"] == n and rows[0]["end"] == len(text)
        assert len(dom.select(root, "//div")) == n
        classes = trees.classify(root)
        assert len(classes) == n + 1 and classes[0]["height"] == n and len({c["tree"] for c in classes}) == n + 1
        assert dom.mark_sentences(page).count("ltx_sentence") == 2
        assert markup.normalize(dom.parse(page)).text() == "One is here. Two is there."
        assert len(markup.serialize(root)) > 10 * n


def test_stream_of_a_folder_of_files(spark, tmp_path):
    rows = [(1, 0, "user", "a b a"), (1, 1, "bot", "B c"), (2, 0, "user", None)]
    for folder, files in (("one", 1), ("many", 3)):
        d = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(files)
        d.write.parquet(f"{tmp_path}/{folder}/conversations.parquet")
        d.write.parquet(f"{tmp_path}/{folder}/conversations.parquet.old")
        assert {r.w: r.n for r in pages.stream_terms(spark, f"{tmp_path}/{folder}").collect()} == {"a": 2, "b": 2, "c": 1}
    import shutil

    (tmp_path / "file").mkdir()
    shutil.copy(next((tmp_path / "one/conversations.parquet").glob("*.parquet")), tmp_path / "file/conversations.parquet")
    assert {r.w: r.n for r in pages.stream_terms(spark, f"{tmp_path}/file").collect()} == {"a": 2, "b": 2, "c": 1}


def test_few_rows_at_a_time(spark, tmp_path):
    """No whole batch of results as Python objects: rows go through in slices, and marks in one pass."""
    texts = [(i, f"Sentence {i} is here. " * (i % 7) + "\n\nThe end? No.") for i in range(300)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, f"<p>{t}</p>") for i, t in texts], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    from loomtext.functions import sentences
    from loomtext.plans import text

    for query, name in ((text.sentence_split, "MapInArrow"), (pages.dom_paragraphs, "MapInArrow"), (pages.mark_tokens, "MapInArrow"), (pages.page_words, "MapInArrow"), (pages.marked_sentences, "ArrowEvalPython")):
        found = query(spark, str(tmp_path))
        plan = found._jdf.queryExecution().executedPlan().toString()
        # 200 is the kind of function that gets a batch and gives a batch
        assert name in plan and "MapInPandas" not in plan and not re.search(r"ArrowEvalPython.*, 200\b", plan)
    got = {(r.doc_id, r.sent_id): (r.start, r.end) for r in text.sentence_split(spark, str(tmp_path)).collect()}
    assert got == {(i, k): x for i, t in texts for k, x in enumerate(sentences.split(t))}
