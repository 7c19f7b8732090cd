"""Hand fixtures for the cleaning and token operators (quirks of SURVEY section 2)."""

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from issuelens import fixed
from issuelens.functions import text as T
from issuelens.functions import tokens as K
from issuelens.plans import chains as C


def one(spark, col_fn, value, schema="t string"):
    df = spark.createDataFrame([(value,)], schema)
    return df.select(col_fn(F.col("t")).alias("o")).collect()[0]["o"]


def test_stopwords_equal_spark_default(spark):
    assert fixed.ENGLISH_STOPWORDS == StopWordsRemover.loadDefaultStopWords("english")
    assert len(fixed.ENGLISH_STOPWORDS) == 181
    assert "move" not in fixed.ENGLISH_STOPWORDS


def test_camel_case_needs_two_humps(spark):
    out = one(spark, T.strip_camel_case, "Use FooBar and fooBar, Foo, HTTPServer now")
    assert out == "Use  and fooBar, Foo, HTTPServer now"


def test_camel_case_unicode_boundary(spark):
    # an accented letter is a word character, so no boundary before "FooBar"
    assert one(spark, T.strip_camel_case, "éFooBar x") == "éFooBar x"


def test_url_takes_trailing_comma(spark):
    assert one(spark, lambda c: T.strip_urls(c, ""), "see https://a.b/c?d=1#e, then stop") == "see  then stop"


def test_fenced_before_inline(spark):
    out = one(spark, lambda c: T.strip_inline_code(T.strip_fenced_code(c)), "```x\ny``` then `z` span")
    assert out == " then  span"


def test_jira_markup(spark):
    s = "p {code:java}a{code} q {noformat}b{noformat} {color:red}c{color} r"
    out = one(spark, lambda c: T.strip_jira_color(T.strip_jira_noformat(T.strip_jira_code(c))), s)
    assert out == "p   q   c{color} r"


def test_jira_bad_opener_quirk(spark):
    s = "p {code:title=A.java}X{code} keep {code}Y{code} q"
    assert "keep" not in one(spark, T.strip_jira_code, s)
    out = one(spark, T.strip_jira_code, s)
    assert "X" in out and "Y" in out
    strict = one(spark, lambda c: T.strip_jira_code(c, True), s)
    assert "keep" in strict and "X" not in strict


def test_whitespace_unicode(spark):
    assert one(spark, T.collapse_whitespace, "\t a\r\n b c  \t") == "a b c"


def test_clean_ascii_deletes_punct(spark):
    assert one(spark, T.clean_ascii, "A.b 12 été!") == "ab  t"


def test_split_words_no_empty(spark):
    assert one(spark, K.split_words, "  a  b ") == ["a", "b"]
    assert one(spark, K.split_words, "") == []


def test_punct_tokens(spark):
    toks = one(spark, lambda c: K.drop_punct_tokens(K.split_words(c)), "() -- . x")
    assert toks == ["--", "x"]


def test_ngrams_short_and_long(spark):
    assert one(spark, lambda c: K.ngrams(K.split_words(c), 3), "a b") == []
    assert one(spark, lambda c: K.ngrams(K.split_words(c), 2), "a b c") == ["a b", "b c"]
    assert one(spark, lambda c: K.ngrams(K.split_words(c), 1), "a b") == ["a", "b"]


def test_is_repetitive(spark):
    assert one(spark, K.is_repetitive, '"foo foo"') is True
    assert one(spark, K.is_repetitive, "foo bar") is False
    assert one(spark, K.is_repetitive, "") is False


def test_labelling_chain_keeps_move_and_lemmatises(spark):
    toks = one(spark, C.labelling_tokens, "We moved the FooBar module, then move it https://x.y again.")
    assert "move" in toks and "module" in toks
    assert "foobar" not in toks and "the" not in toks and "," not in toks


def test_map_pos_tag(spark):
    df = spark.createDataFrame([("JJ",), ("VBD",), ("NN",), ("RB",), ("DT",)], "t string")
    assert [r[0] for r in df.select(K.map_pos_tag(F.col("t"))).collect()] == ["a", "v", "n", "r", "n"]


def test_null_policies(spark):
    df = spark.createDataFrame([(None,)], "t string")
    r = df.select(T.null_text(F.col("t"), "empty").alias("e"), T.null_text(F.col("t"), "nan").alias("n")).collect()[0]
    assert (r["e"], r["n"]) == ("", "nan")


def test_combine_keeps_separator(spark):
    df = spark.createDataFrame([(None, None)], "s string, d string")
    assert df.select(T.combine_text(F.col("s"), F.col("d"), " - ")).collect()[0][0] == " - "


def test_kept_lemmas_are_the_lemmas_of_the_kept_tags(spark):
    lexicon = [("moved", "VERB", "move"), ("the", "DET", "the"), ("12", "NOUN", "twelve"), ("odd", None, "odd"), ("nil", "NOUN", None)]
    toks = ["moved", "the", "12", "13", "!", "x1", "odd", "nil", "é", "", "_", "run", "every"]
    df = spark.createDataFrame([(toks,), ([],), (None,)], "t array<string>")
    for lex in (lexicon, [], None):
        for keep in (["NOUN", "VERB", "ADJ"], ["NUM", "DET"], ["SYM", "NOUN"], ["NUM", "SYM", "NOUN"], ["VERB"]):
            found = df.select(K.lemmas(K.filter_pos(K.tag_tokens(F.col("t"), lex), keep)).alias("old"),
                              K.kept_lemmas(F.col("t"), keep, lex).alias("new")).collect()
            assert all(r["old"] == r["new"] for r in found)
        both = df.select(K.lemmas(K.tag_tokens(F.col("t"), lex)).alias("old"), K.kept_lemmas(F.col("t"), None, lex).alias("new")).collect()
        assert all(r["old"] == r["new"] for r in both)
