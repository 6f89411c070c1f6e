"""Templates against each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def families(templates: DataFrame) -> DataFrame:
    """family, members, words (a few): templates alike but for one word, which * stands for. No pairs are made."""
    words = F.split("template", " ", -1)
    cut = templates.select(F.posexplode(words).alias("pos", "word"), words.alias("words"))
    key = F.array_join(F.transform("words", lambda w, i: F.when(i == F.col("pos"), F.lit("*")).otherwise(w)), " ")
    found = cut.select(key.alias("family"), "word").groupBy("family").agg(F.count("*").alias("members"), F.min("word").alias("first_word"), F.max("word").alias("last_word"))
    return found.where("members > 1")
