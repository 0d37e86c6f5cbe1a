"""Analysis, stemming, HTML blocks."""

import pytest
from pyspark.sql import functions as F

from quern.functions import html, text
from quern.functions.stem import stem


def analysed(spark, value, config):
    row = spark.createDataFrame([(value,)], "t string").select(text.terms(F.col("t"), config).alias("x")).first()
    return [(t["term"], t["pos"]) for t in row["x"]]


PURE = text.Analyzer(stop_words=(), stemming=False)


@pytest.mark.parametrize("value, want", [
    ("//DeadServer_time//With.PunctuationStuff", ["dead", "server", "time", "with", "punctuation", "stuff"]),
    ("plot(1:10,rand(1,10))", ["plot", "rand"]),
    ("cgPATHcg CGPath cgPATH PATHcg", ["cg", "pat", "hcg", "cg", "path", "cg", "path", "pat", "hcg"]),
    ("don't can't", ["dont", "cant"]),
    ("see https://x.org/a or www.y.z or me@b.de ok", ["see", "or", "or", "ok"]),
    ("Crème Brûlée", ["creme", "brulee"]),
    ("a.b  c\n\td", ["a", "b", "c", "d"]),
    ("", []), (None, []), (" \n", []),
])
def test_analyzer(spark, value, want):
    assert [t for t, _ in analysed(spark, value, PURE)] == want


def test_positions_keep_the_gaps_of_stop_words(spark):
    assert analysed(spark, "King of the Hill", text.Analyzer(stemming=False)) == [("king", 0), ("hill", 3)]
    assert analysed(spark, "running quickly", text.Analyzer()) == [("run", 0), ("quick", 1)]


def test_kept_variables_have_parts_without_positions(spark):
    got = analysed(spark, "call snake_case now fooBar", PURE.keep_variables())
    assert got == [("call", 0), ("snake_case", 1), ("now", 2), ("foobar", 3), ("snake", -1), ("case", -1), ("foo", -1), ("bar", -1)]


def test_modes(spark):
    assert [t for t, _ in analysed(spark, "x1y22 a-b", text.Analyzer(digits="split", punctuation="keep", stop_words=(), stemming=False))] == ["x", "1", "y", "22", "a-b"]
    assert [t for t, _ in analysed(spark, "a-b don't", text.Analyzer(punctuation="remove", contractions="remove", stop_words=(), stemming=False))] == ["ab"]
    assert [t for t, _ in analysed(spark, "http://a.b me", text.Analyzer(links="keep", stop_words=(), stemming=False))] == ["http", "a", "b", "me"]


@pytest.mark.parametrize("word, want", [
    ("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("cats", "cat"), ("gas", "gas"), ("agreed", "agre"), ("hopping", "hop"), ("hoping", "hope"), ("falling", "fall"),
    ("happy", "happi"), ("relational", "relat"), ("conditional", "condit"), ("rational", "ration"), ("valency", "valenc"), ("digitizer", "digit"), ("operator", "oper"), ("feudalism", "feudal"),
    ("decisiveness", "decis"), ("hopefulness", "hope"), ("formality", "formal"), ("sensibility", "sensibl"), ("triplicate", "triplic"), ("formative", "format"), ("electrical", "electr"), ("goodness", "good"),
    ("revival", "reviv"), ("allowance", "allow"), ("adjustment", "adjust"), ("adoption", "adopt"), ("controlling", "control"), ("generate", "generat"), ("skis", "ski"), ("dying", "die"), ("news", "news"), ("succeed", "succeed"), ("by", "by"), ("", ""), ("consisting", "consist"), ("knightly", "knight"),
])
def test_stemmer(word, want):
    assert stem(word) == want


def test_blocks_inherit_and_tails_belong_to_parents():
    b = html.parse_blocks("<h2>one <strong>strong or <i>both</i> tail</strong> text</h2><p>a <code>x()</code> z</p><pre><code>block</code></pre><div>lost</div>")
    assert [(x["text"], x["text_size"], x["flags"]) for x in b[:5]] == [("one ", 2, []), ("strong or ", 2, ["bold"]), ("both", 2, ["bold", "italic"]), (" tail", 2, ["bold"]), (" text", 2, [])]
    assert [(x["kind"], x["in_line"]) for x in b[5:]] == [("text", False), ("code", True), ("text", False), ("code", False)]
    assert [x["block_id"] for x in b] == list(range(len(b))) and all("lost" not in x["text"] for x in b)


def test_links_lists_and_broken_markup():
    b = html.parse_blocks('<ul><li>x<li>y <a href="/u" alt="t">go <code>c</code></a></ul><p>open<p>next &amp; last</b></p><dl><dt>k<dd>v</dl>')
    assert ("link", "/u", "t") in [(x["kind"], x["href"], x["alt_text"]) for x in b]
    assert [x["text"] for x in b if "list_item" in x["flags"]][:2] == ["x", "y "] and "next & last" in [x["text"] for x in b]
    assert [x["text"] for x in b if "description" in x["flags"]] == ["k", "v"]
    assert html.parse_blocks(None) == html.parse_blocks("") == html.parse_blocks("plain") == []
    assert html.parse_blocks("<p>" + "<b>x" * 3000)


def test_blocks_as_a_column(spark):
    df = spark.createDataFrame([(1, "<p>a</p>", "x"), (2, None, "y"), (3, "", "z")], "id int, html string, blocks string")
    rows = {r["id"]: r["blocks"] for r in html.with_blocks(df).collect()}
    assert rows[1][0]["text"] == "a" and rows[2] == rows[3] == []
    assert df.select(html.raw_blocks(F.col("html")).alias("b")).first()["b"][0]["text"] == "<p>a</p>"


def test_small_functions(spark):
    df = spark.createDataFrame([("|a|b|", "if(x)\n y;", "well-known a@b.de"), (None, None, None)], "t string, c string, w string")
    rows = df.select(text.split_tags(F.col("t")).alias("t"), text.join_tags(text.split_tags(F.col("t"))).alias("j"), text.code_tokens(F.col("c")).alias("c"), text.classic_tokens(F.col("w")).alias("w")).collect()
    assert rows[0]["t"] == ["a", "b"] and rows[0]["j"] == "|a|b|" and rows[0]["c"] == ["if", "(", "x", ")", "y", ";"] and rows[0]["w"] == ["well", "known", "a@b.de"]
    assert rows[1]["t"] == [] and rows[1]["j"] == "" and rows[1]["w"] == []
    words = spark.createDataFrame([([["w"] * 20, ["v"] * 20, ["u"]],), ([],)], "b array<array<string>>")
    assert [len(r[0].split()) for r in words.select(text.snippet(F.col("b"))).collect()] == [40, 0]


def test_other_alphabets_in_latin_letters(spark):
    from pyspark.sql import functions as F

    from quern.functions import text

    cases = {"Привет, Ærø Straße": "Privet, AEro Strasse", "Ελληνικά": "Ellenika", "Ώρα ἀρχή Ёлка й": "Ora arkhe Iolka i", "東京 café": "東京 cafe", "it’s – “x”…": "it's - \"x\"...", "": "", "Łódź": "Lodz"}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    got = {r[0]: r[1] for r in df.select("t", text.transliterate(F.col("t"))).collect()}
    assert got.pop(None) is None and got == cases


def test_punctuation_kept_as_tokens(spark):
    from quern.functions import text

    config = text.Analyzer(links="keep", contractions="keep", digits="keep", punctuation="keep-split", stop_words=(), stemming=False)
    row = spark.createDataFrame([("plot(1:10) a_b...",)], "t string").select(text.terms(__import__("pyspark").sql.functions.col("t"), config).alias("x")).first()
    assert [t["term"] for t in row["x"]] == ["plot", "(", "1", ":", "10", ")", "a", "b", ".", ".", "."]


def test_stop_words_of_a_corpus(spark):
    from quern.functions import text

    terms = spark.createDataFrame([("the", 9), ("of", 5), ("rare", 1), ("and", 5)], "term string, df long")
    assert text.corpus_stop_words(terms, 10, 0.4) == ("the", "and", "of") and text.corpus_stop_words(terms, 10, 0.4, 1) == ("the",)


def test_patterns_run_over_whole_texts(spark):
    """One split a text: on single tokens, Spark compiles its pattern each time."""
    df = spark.createDataFrame([("fooBar don't x1y www.a.b snake_case",)], "t string").select(text.terms(F.col("t"), text.Analyzer(stemming=False)).alias("x"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    assert [(r["term"], r["pos"]) for r in df.first()["x"]] == [("foo", 0), ("bar", 1), ("dont", 2), ("x", 3), ("y", 4), ("snake", 5), ("case", 6)]
