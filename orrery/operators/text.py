"""Operators on phrases and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators.joins import small


def phrase_class(phrases: DataFrame, classes: DataFrame) -> DataFrame:
    """phrases (phrase), classes (part, class, idx): the first class whose part stands in the phrase, else null."""
    found = phrases.join(small(classes), F.contains(F.lower("phrase"), F.col("part"))).groupBy("phrase").agg(F.min_by("class", "idx").alias("class"))
    return phrases.join(found, "phrase", "left")


def caption_spans(words: DataFrame) -> DataFrame:
    """words (image, idx, word): the place of each word in the caption "a . b . c" of its image."""
    from pyspark.sql import Window

    before = Window.partitionBy("image").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("word") + 3).over(before), F.lit(0)).cast("long")
    return words.withColumn("start", start).withColumn("stop", (F.col("start") + F.length("word")).cast("long"))


def token_classes(logits: DataFrame, tokens: DataFrame, least: float) -> DataFrame:
    """(q, class, score): token probabilities above the limit times the weights of tokens (tok, class, w)."""
    return logits.join(small(tokens), "tok").groupBy("q", "class").agg(F.sum(F.when(F.col("p") > least, F.col("p") * F.col("w")).otherwise(0.0)).alias("score"))


def batch_edits(bodies: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, prompt) of JSON maps, without labels that are not known."""
    pairs = bodies.select(F.explode(F.from_json("body", "map<string,string>")).alias("label", "prompt"))
    return pairs.join(small(labels), "label", "left_semi")
