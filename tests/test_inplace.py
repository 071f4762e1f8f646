"""Queries that work through whole texts, against their SQL on odd tables, and without shuffling tokens."""

import duckdb
import pytest

import __spark_entry__ as entry

WORDS = "the cat sat on a mat while Dogs run, running. It was RUN! why not? ünï x1 one two three".split()
#: Repeated ids with the same and other texts, a missing id, nulls, empties, and words of many documents and of one.
TEXTS = [
    *((i, " ".join(WORDS[(i * 7 + j * j) % len(WORDS)] for j in range(40)) + f" only{chr(97 + i % 26)}q\n" + " ".join(WORDS[(i + j) % 11] for j in range(9))) for i in range(150)),
    (1, "the the cat\nsat again\n\nlast line here"), (210, "cat"), (210, "cat"), (7, "mat mat mat mat\n"),
    (None, "cat of nobody\nthe cat"), (200, None), (201, ""), (202, "12 34\n\n"), (203, "Istanbul Kelvin ſ Straße. a\nb"),
]
LABELS = [(i, i % 3 % 2) for i in range(0, 210, 2)] + [(4, 1), (None, 1)]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return _tables(spark, str(tmp_path_factory.mktemp("odd")), TEXTS)


@pytest.fixture(scope="module")
def unique(spark, tmp_path_factory):
    return _tables(spark, str(tmp_path_factory.mktemp("unique")), list(dict(TEXTS).items()))


def _tables(spark, folder, texts):
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(LABELS, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return folder, con


def rows(names: list[str], found: list[tuple]) -> list:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(r[i] for i in order) for r in found), key=repr)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def matches_sql(spark, odd, name):
    folder, con = odd
    df = entry.queries()[name](spark, folder)
    want = con.sql(entry.oracle_sql()[name])
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())
    return df


#: Queries whose tokens were shuffled, to windows or to groups of paragraphs.
IN_PLACE = ["occurrence_features", "libsvm_lines", "tfidf_features", "tfc_features", "doc_norm", "content_features", "decode_counts", "normalized_sentences"]
#: Those whose SQL leaves the order of words open where an id is repeated.
ORDERED = ["encode_documents", "union_ngrams", "ngram_idf_sizes", "content_run_counts"]


@pytest.mark.parametrize("name", IN_PLACE)
def test_without_windows(spark, odd, name):
    assert "Window" not in plan(matches_sql(spark, odd, name))


@pytest.mark.parametrize("name", ORDERED)
def test_without_windows_in_order(spark, unique, name):
    assert "Window" not in plan(matches_sql(spark, unique, name))


def test_bins(spark, odd):
    matches_sql(spark, odd, "bins")


def test_joined_beyond_the_bound(spark, odd, monkeypatch):
    from loomtext.plans import features

    monkeypatch.setattr(features, "MODEL", 0)
    for name in ("tfidf_features", "libsvm_lines"):
        matches_sql(spark, odd, name)


def test_encoded_with_words_of_tasks_and_of_joins(spark, odd):
    from loomtext.operators import inplace

    docs = inplace.gathered(spark.read.parquet(f"{odd[0]}/documents.parquet"))
    d = inplace.term_dictionary(docs)
    got = [sorted(map(tuple, inplace.encode(docs, d, most).collect()), key=repr) for most in (0, 200_000)]
    assert got[0] == got[1] and len(got[0]) > 300


def test_stemmed_runs(spark, odd):
    """Against the counts by windows; each task hands on few grams at a time."""
    from loomtext.functions import tokens
    from loomtext.functions.stopwords import EXTENDED
    from loomtext.operators import inplace, ngrams

    docs = spark.createDataFrame([(i, t) for i, t in enumerate(dict.fromkeys(t for _, t in TEXTS))], "doc_id long, text string")
    want = ngrams.content_ngrams(tokens.sentence_terms(docs), stemmed=True)
    for most in (inplace.GRAMS, 5):
        inplace_grams, inplace.GRAMS = inplace.GRAMS, most
        got = inplace.ngram_counts(inplace.sentence_texts(docs), stopwords=EXTENDED, stemmed=True)
        inplace.GRAMS = inplace_grams
        assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
        assert "Window" not in plan(got)


def test_grams_of_any_alphabet():
    """Numbers of grams against strings, for small and large alphabets, counts and owners."""
    from collections import Counter

    from loomtext.operators import textcat

    many = [chr(0x4E00 + i) + chr(0x4E01 + i % 50) for i in range(0, 6000, 3)]
    for words in ([Counter("the cat the hat a ünï".split()), Counter(), Counter({"the": 3 << 33, "𝔘x": 1})], [Counter(many), Counter(many[:7])], [Counter()]):
        got, want = ((o.tolist(), names(g).to_pylist(), n.tolist()) for o, g, n, names in (textcat._counted(words), textcat._counted_strings(words)))
        assert sorted(zip(*got)) == sorted(zip(*want))
        order = [g for o, g in zip(got[0], got[1]) if o == 0]
        assert order == sorted(order)


@pytest.mark.parametrize("name", ["lang_classify", "lang_candidates", "english_folded", "lang_profiles"])
def test_languages_in_place(spark, odd, name, tmp_path):
    folder = str(tmp_path)
    texts = [(i, t, ("en", "de")[i % 2]) for i, t in enumerate(t for _, t in TEXTS)] + [(900, "ÄÖ straße été, été! 中文 ещё", "fr")]
    spark.createDataFrame(texts, "doc_id long, text string, lang string").write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    df = matches_sql(spark, (folder, con), name)
    # words aren't shuffled, nor handed over as pandas
    assert "Pandas" not in plan(df) and "Generate" not in plan(df)
