from pyspark.sql import functions as F

from corpuskit.functions import text as X


def _one(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("o")).collect()[0].o


def test_preview(spark):
    assert _one(spark, lambda c: X.preview(c, 500), "a" * 500) == "a" * 500
    assert _one(spark, lambda c: X.preview(c, 500), "a" * 501) == "a" * 500 + "... (truncated)"


def test_word_count_and_clean(spark):
    assert _one(spark, X.word_count, "  a\tb\n c  ") == 3
    assert _one(spark, X.word_count, "   ") == 0
    assert _one(spark, X.clean_text, "  a\t\tb \n c ") == "a b c"


def test_rfind(spark):
    assert _one(spark, lambda c: X.rfind(c, "."), "a.b.c") == 3
    assert _one(spark, lambda c: X.rfind(c, " and "), "x and y and z") == 7
    assert _one(spark, lambda c: X.rfind(c, "?"), "abc") == -1


def test_sentence_filter_5_vs_6_words(spark):
    t = "one two three four five. one two three four five six."
    got = _one(spark, lambda c: X.keep_long_sentences(X.split_sentences(X.clean_text(c)), 5), t)
    assert got == ["one two three four five six."]
    assert _one(spark, lambda c: X.keep_long_clean_sentences(X.split_sentences(X.clean_text(c)), 5), t) == got


def test_safe_text_and_prefix(spark):
    assert _one(spark, X.safe_text, None) == ""
    assert _one(spark, lambda c: X.model_prefix(c, "t5-base"), "x") == "summarize: x"
    assert _one(spark, lambda c: X.model_prefix(c, "pegasus"), "x") == "x"
