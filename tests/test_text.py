import pytest
from pyspark.sql import functions as F

from textrill.functions import text as X


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "c string").select(column.alias("r")).first()["r"]


def test_fold():
    assert len(X.FOLD_ONE) + len(X.FOLD_MANY) == 182
    assert X.fold_text("Ciències ÀÉÎÕÜ ß Æœ Þ Łódź ŉ ĳ") == "Ciencies AEIOU ss AEoe TH Lodz n ij"
    assert X.fold_text("ŨũŪūŊŋĸſ") == "ŨũŪūŊŋĸſ"


def test_fold_column(spark):
    for s in ("Ciències ß Æœ", "İstanbul ŁŁ", "", None):
        assert one(spark, s, X.fold("c")) == (X.fold_text(s) if s is not None else None)


def test_tokens(spark):
    assert one(spark, "L'estel, d’Àfrica_2 --", X.tokens("c")) == ["l", "estel", "d", "africa", "2"]
    assert one(spark, None, X.tokens("c")) == []
    assert one(spark, "", X.tokens("c")) == []
    assert one(spark, "  a  b ", X.word_count("c")) == 2


@pytest.mark.parametrize(
    ("text", "budget", "kept", "cut"),
    [("àçò àçò àçò", 10, "àçò", True), ("aa bb cc", 6, "aa bb", True), ("ààààà", 8, "àààà", True), (" abcdef", 4, " abc", True), ("sortida", 0, "", True), ("sortida al museu", 16, "sortida al museu", False), ("ab\n cd", 4, "ab", True)],
)
def test_budget(spark, text, budget, kept, cut):
    from textrill.extract.common import Sink

    assert one(spark, text, X.budget_cut(F.col("c"), budget)) == kept
    assert one(spark, text, X.overflows(F.col("c"), budget)) is cut
    sink = Sink(budget)
    sink.accept(text)
    assert (sink.text(), sink.overflowed) == (kept, cut)


@pytest.mark.parametrize(("text", "plain"), [("a\tb\r\nc", True), ("a\x01b", False), ("a\x00b", False), ("a\u0085b", False), ("a﻿", False), ("a­b", False)])
def test_plain(spark, text, plain):
    assert one(spark, text, X.is_plain(F.col("c"))) is plain


@pytest.mark.parametrize(("title", "ext"), [("a/b.PDF", "pdf"), ("a.b/c", ""), ("x.tar.gz", "gz"), (None, ""), ("", ""), (".txt", "txt")])
def test_extension(spark, title, ext):
    assert one(spark, title, X.path_extension(F.col("c"))) == ext


def test_base64(spark):
    assert one(spark, "aG9sYQ==", F.decode(X.decode_base64(F.col("c")), "UTF-8")) == "hola"
    assert one(spark, "!!", X.decode_base64(F.col("c"))) is None


def test_excerpt(spark):
    text = "a" * 60 + "museu" + "b" * 300
    assert one(spark, text, X.excerpt(F.col("c"), "museu")) == text[20:220]
    text = "a" * 60 + "les ciències naturals" + "b" * 300
    assert one(spark, text, X.excerpt(F.col("c"), "ciencies")) == text[24:224]
    assert one(spark, text, X.excerpt(F.col("c"), "+a -b")) == text[:200]
    assert one(spark, None, X.excerpt(F.col("c"), "x")) == ""
    assert one(spark, "curt", X.excerpt(F.col("c"), "")) == "curt"
