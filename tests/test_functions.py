import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from loomtext.functions import dom, fold, markup, sentences, stem, stopwords, tokens, trees


def column(spark, values, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in rows.orderBy("i").select(expr(F.col("x"))).collect()]


def test_fold(spark):
    assert column(spark, ["Poincaré and æ", "rándôm", "", None], fold.to_ascii) == ["Poincare and ae", "random", "", None]
    assert column(spark, ["ÀÿçÑ"], fold.fold_latin) == ["AyçN"]


def test_stopwords(spark):
    assert column(spark, ["the", "be", "IN", "group"], stopwords.is_stopword) == [True, True, True, False]


def test_read_stopwords(spark, tmp_path):
    (tmp_path / "s.json").write_text('["uno", "dos"]')
    assert stopwords.read_stopwords(spark, str(tmp_path / "s.json")) == ("uno", "dos")


def test_numbers(spark):
    assert column(spark, ["12", "1.2", "3d", "a1", "matrix"], tokens.normalize_number) == ["nnumber"] * 3 + ["a1", "matrix"]
    assert column(spark, ["matrix", "six", "a1", "p12"], lambda c: tokens.normalize_number(c, parity=True)) == ["nnumber", "nnumber", "a1", "nnumber"]
    assert column(spark, ["", "1.2", "x"], tokens.simple_number) == ["[number]", "[number]", "x"]


def test_words(spark):
    assert column(spark, ["multi-symplectic, Birkhoff's"], tokens.words) == [["multi-", "symplectic", ",", "Birkhoff", "'s"]]
    assert column(spark, ["a , b2 3"], lambda c: tokens.words(c, alpha_only=True)) == [["a", "b"]]


def test_chunks_and_trim(spark):
    assert column(spark, ['one, "two" - three; four.'], tokens.chunks) == [["one", "two", "three", "four"]]
    assert column(spark, ["  a \n\n b  "], tokens.trim_spaces) == ["a b"]


def test_math_words(spark):
    assert column(spark, ["12", "a", "x", "xy", "pq", "tree", "a+b", "1/2", "xyr"], tokens.is_math) == [True, False, True, False, True, False, True, True, True]


def test_marks(spark):
    assert column(spark, ["S1.p1.m2"], lambda c: tokens.xml_id(tokens.position_mark("MathExpr", c))) == ["S1.p1.m2"]
    assert column(spark, ["MathExprEquation-S1 MathExprEquation-S2 x"], tokens.merge_equations) == ["MathExprEquation-S1 x"]
    assert column(spark, [".", "MathExpr-1", "ourcitation-2", "dog"], tokens.base_kind) == ["punct", "formula", "citation", "word"]


@pytest.mark.parametrize(
    "text, stems",
    [
        ("there are numbers", "there be number"),
        ("Let x be the greatest common denominator of y we are going to prove the following", "let x be the greatest common denominator of y we be go to prove the follow"),
        ("formula", "formulum"),
        ("studies stopped planned making used wives boxes", "study stop plan make use wife box"),
    ],
)
def test_stem(text, stems):
    assert stem.stem_text(text) == stems


def test_stem_fixpoint():
    assert stem.full_stem("tilings") == "tile"
    assert stem.full_stem(None) is None and stem.full_stem("") == ""


@settings(max_examples=50, deadline=None)
@given(st.text("abcdefgilmnorstuxyz", min_size=1, max_size=12))
def test_stem_fixpoint_is_idempotent(word):
    once = stem.full_stem(word)
    assert stem.full_stem(once) == once


def spans(text):
    return [text[a : b + 1] for a, b in sentences.split(text)]


@pytest.mark.parametrize(
    "text, parts",
    [
        ("One two. Three four.", ["One two.", "Three four."]),
        ("See Fig. Nine now. It ends.", ["See Fig. Nine now.", "It ends."]),
        ("By J. Smith et al. and others! Yes?", ["By J. Smith et al. and others!", "Yes?"]),
        ("at 3.5 units. more", ["at 3.5 units. more"]),
        ("A head\n\nText here", ["A head", "Text here"]),
        ("a line\nThe next", ["a line", "The next"]),
        ("a line\nnext", ["a line\nnext"]),
        ("... !!! ...", []),
        ("", []),
    ],
)
def test_sentences(text, parts):
    assert spans(text) == parts


@settings(max_examples=100, deadline=None)
@given(st.text("aB .?!\n\"()M", max_size=40))
def test_sentence_ranges_are_ordered(text):
    last = -1
    for a, b in sentences.split(text):
        assert last < a <= b < len(text) and not text[a].isspace() and not text[b].isspace()
        last = b


PAGE = """<html><head><title>T</title></head><body><section class="ltx_section"><div class="ltx_theorem_def"><div class="ltx_para">A <math><mi>x</mi></math> by <cite>B</cite>.</div></div>
<div class="ltx_para">Two<table class="ltx_equation"><tr><td>e</td></tr></table><table><tr><td>t</td></tr></table><span class="ltx_note_mark">1</span> é</div></section><script>no</script></body></html>"""


def test_dom_flags():
    root = dom.parse(PAGE)
    options = dom.Options(math="normalize", cite="normalize", tables="normalize", table_tokens=True, drop_notes=True)
    paras = dom.first_nonempty(root, dom.PARAGRAPHS)
    assert [dom.flatten(p, options)[0] for p in paras] == ["A  MathFormula  by  CiteExpression .", "Two MathFormula  TableStructure  é"]
    assert [dom.is_definition(p) for p in paras] == [True, False]
    assert "no" not in dom.flatten(root)[0] and "T" not in dom.flatten(root)[0].split()[0:0]


def test_dom_lenient_and_relaxed(spark):
    pages = spark.createDataFrame([(1, "<p>One<p>Two<br>x</div>"), (2, ""), (3, None), (4, '<div class="ltx_para">only</div>')], "page_id int, html string")
    got = [(r.page_id, r.para_id, r.text) for r in dom.page_paragraphs(pages).orderBy("page_id", "para_id").collect()]
    assert got == [(1, 1, "One"), (1, 2, "Twox"), (4, 1, "only")]


def test_node_lookups(spark):
    pages = spark.createDataFrame([(1, "<div>ab<p>cd<b>ef</b></p></div>")], "page_id int, html string")
    nodes = dom.nodes(pages)
    tag = {r.node_id: r.tag for r in nodes.collect()}
    at = dom.node_at(nodes, spark.createDataFrame([(1, 0), (1, 2), (1, 5)], "page_id int, offset int"))
    assert [tag[r.node_id] for r in at.orderBy("offset").collect()] == ["div", "p", "b"]
    around = dom.node_around(nodes, spark.createDataFrame([(1, 1, 3), (1, 3, 5)], "page_id int, from int, to int"))
    assert [tag[r.node_id] for r in around.orderBy("from").collect()] == ["div", "p"]


def test_marked_sentences():
    assert dom.mark_sentences("<p>One two. Three four.</p>").count('class="ltx_sentence"') == 2


DOC = '<document><abstract><p>An abstract</p></abstract><section><para><p>With <Math xml:id="S1.p1.1.m1"><XMath/></Math> and <cite>k</cite> in <ref>r</ref>.<note>n</note></p><equation xml:id="S1.E1"><Math/></equation></para></section></document>'


def test_normalize():
    n = markup.normalize(dom.parse(DOC, strict=True))
    assert n.elements("abstract") == ["An abstract"]
    assert n.body() == "With MathExpr-doc0-S1-p1-p1-m1 and ourcitation-doc0-c0 in ourreference-doc0-r0 . MathExprEquation-doc0-S1-E1"
    assert n.entry("ourreference-doc0-r0") == "<ref>r</ref>"
    assert "MathExpr-1" in markup.normalize(dom.parse(DOC, strict=True), "syntax").body()


def test_purify():
    root = dom.parse("<p>ASCII 1+2=3 math</p>", strict=True)
    markup.purify(root)
    assert markup.normalize(root).text() == "ASCII MathExpr-doc0-purify0-m1 math"
    toks = "".join(f"<XMTok>{c}</XMTok>" for c in "jaguar")
    joined = markup.purify(dom.parse(f"<Math><XMath>{toks}</XMath></Math>", strict=True))
    assert [x.items for x in joined.walk() if x.tag == "xmtok"] == [["jaguar"]]


def test_mark_tokens():
    rows = markup.mark_tokens("A MathExpr-1 here. So ourcitation-2!")
    assert [(r["sentence"], r["kind"]) for r in rows] == [(1, "word"), (1, "formula"), (1, "word"), (1, "punct"), (2, "word"), (2, "citation"), (2, "punct")]


def test_trees(spark):
    a = trees.classify(dom.parse("<a><b x='1'>t</b><b x='1'>t</b><b/></a>", strict=True))
    b = [r["tree"] for r in a if r["tag"] == "b"]
    assert b[0] == b[1] != b[2] and a[1]["height"] == 1
    row = spark.range(1).select(trees.differing_children(F.array(F.lit("x"), F.lit("y")), F.array(F.lit("x"), F.lit("z"))).alias("d"), trees.differing_children(F.array(F.lit("x")), F.array(F.lit("x"), F.lit("z"))).alias("n")).collect()[0]
    assert row.d == [2] and row.n is None


def test_sentence_rewrites(spark):
    from loomtext.functions import tokens
    from pyspark.sql import functions as F

    cases = {
        "It is so. So be it! \u25a0 End": "It is so. So be it! ourQED \nEnd",
        "the dog's bone": "the dog 's bone",
        "a (b) c": "a ( b ) c",
        "well\u2014known": "well-known",
        "by ourcitationand xMathExpr-1, then": "by ourcitation and x MathExpr-1 , then",
        "as MathExpr-2 We go": "as MathExpr-2\nWe go",
        "": "",
    }
    rows = spark.createDataFrame(list(cases.items()) + [(None, None)], "t string, want string")
    got = rows.withColumn("got", tokens.normalize_sentence(F.col("t"))).collect()
    assert all(r.got == r.want for r in got), [(r.got, r.want) for r in got]


def test_ngrams_of_content_runs(spark):
    from loomtext.operators.ngrams import content_ngrams

    words = "the numbers of great prime numbers and primes".split()
    rows = spark.createDataFrame([(1, 1, i, w) for i, w in enumerate(words)] + [(1, 2, 0, "prime")], "doc_id int, sent int, pos int, w string")
    got = {(r.size, r.ngram): r.cnt for r in content_ngrams(rows).collect()}
    assert got == {(1, "numbers"): 2, (1, "great"): 1, (1, "prime"): 2, (1, "primes"): 1, (2, "great prime"): 1, (2, "prime numbers"): 1, (3, "great prime numbers"): 1}
    got = {(r.size, r.ngram): r.cnt for r in content_ngrams(rows, stemmed=True).collect()}
    assert got[1, "prime"] == 3 and got[1, "number"] == 2 and got[3, "great prime number"] == 1
