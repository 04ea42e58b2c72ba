"""Edits of dictated texts: the recent node, cases of letters, and long texts in one scan."""

import time

from pyspark.sql import functions as F

from parchment.functions import text as T
from parchment.streaming import events


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v")).alias("r")).first().r


def test_places_are_found_in_the_text_itself(spark):
    assert one(spark, "İ the end", lambda c: T.replace_first(c, "THE", "A")) == "İ A end"
    assert one(spark, "say É twice: é", lambda c: T.replace_first(c, "é", "$1\\")) == "say $1\\ twice: é"
    assert one(spark, "a.b axb", lambda c: T.replace_first(c, "x", "-")) == "a.b a-b"
    assert one(spark, "keep", lambda c: T.replace_first(c, "  ", "-")) == "keep"
    assert one(spark, "one \n THE \t two  three", lambda c: T.delete_text(c, "the")) == "one two three"


def test_ends_of_texts(spark):
    sentence = {"A. B.": "A. ", "One two": "One two", "Hi!' Then \"left.\" ": "Hi! ", "no  stop": "no stop", "Bad.'\"": "Bad.'\"", "": "", "  ": " ", "x?": " "}
    assert {k: one(spark, k, T.without_last_sentence) for k in sentence} == sentence
    word = {"one two ": "one ", "one": " ", "": "", " \t ": " ", "a b": "a "}
    assert {k: one(spark, k, T.without_last_word) for k in word} == word


def test_the_most_recent_node_is_edited(spark):
    nodes = ["The first", "the second the", None, "   ", "last"]
    edit = lambda f: one(spark, nodes, f, "array<string>")
    assert edit(lambda c: T.replace_recent(c, " the ", "A")) == ["The first", "A second the", None, "   ", "last"]
    assert edit(lambda c: T.replace_recent(c, "the", "A", F.lit(0))) == ["A first", "the second the", None, "   ", "last"]
    assert edit(lambda c: T.replace_recent(c, "the", "A", F.lit(4))) == ["The first", "A second the", None, "   ", "last"]
    assert edit(lambda c: T.delete_recent(c, "SECOND")) == ["The first", "the the", None, "   ", "last"]
    assert edit(lambda c: T.without_recent_word(c)) == ["The first", "the second the", None, "   ", " "]
    assert edit(lambda c: T.replace_recent(c, "none", "A")) == nodes
    assert one(spark, [], lambda c: T.delete_recent(c, "x"), "array<string>") == [] and one(spark, None, lambda c: T.delete_recent(c, "x"), "array<string>") is None


def test_long_texts_take_one_scan(spark):
    rows = [("word " * 200_000,), ("x" * 1_000_000,), (" " * 1_000_000 + "y",), ("word " * 200_000 + "end.",)]
    docs = spark.createDataFrame(rows, "t string").cache()
    assert docs.count() == 4
    for f in (T.without_last_sentence, T.without_last_word, T.stripped, lambda c: T.delete_text(c, "zebra"), lambda c: T.replace_first(c, "zebra", "q")):
        began = time.perf_counter()
        got = docs.select(F.length(f(F.col("t"))).alias("n")).collect()
        assert time.perf_counter() - began < 8 and len(got) == 4


def test_messages_that_are_no_objects_are_text(spark):
    told = {'"quoted"': '"quoted"', "12": "12", "[1]": "[1]", "null": "null", " plain ": "plain", '{"text": "x", "role": "user"}': "x", '{"role": "user"}': '{"role": "user"}', '{"text": 0}': '{"text": 0}', '{"text": 7}': "7"}
    assert {k: one(spark, k, lambda c: events.message(c, "end")).text for k in told} == told
    assert one(spark, " \n", lambda c: events.message(c, "end")) is None and one(spark, None, lambda c: events.message(c, "end")) is None
    assert one(spark, '{"type": "end", "text": "x"}', lambda c: events.message(c, "end")).control
