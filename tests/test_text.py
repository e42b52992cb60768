"""Sentences keep their digits: the place of a sentence isn't what is trimmed off."""

from pyspark.sql import functions as F

from feldspar.functions.text import sentences


def test_sentences_keep_digits_that_are_their_place(spark):
    said = ["00 a.", "1 b.", " 22 c2.", "33", "4245 d!", "5. "]
    got = spark.createDataFrame([("  ".join(said),)], "t string").select(sentences(F.col("t")).alias("s")).first().s
    assert got == ["00 a.", "1 b.", "22 c2.", "33  4245 d!", "5."]
