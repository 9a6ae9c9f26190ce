"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

Language ID drops documents of no known language; line dedup drops boilerplate lines of a host; of near duplicates one
document stays; documents that hold a benchmark item go; what is left is packed into sequences.

Cases. Null texts, and texts without a letter, have no language and go in the first stage; so no later stage meets them
in a run, though each takes them: line dedup, near dedup and decontamination keep them as they are, packing counts them
as empty. Texts of an unlearned language go as far as their cosine shows it. Null sources are one host. Rows with a null
doc_id stay and are never near copies; rows that share a doc_id stay or go together in near dedup and decontamination. Of
equal texts, and of ties, the smallest doc_id stays. Very long texts are whole everywhere but in packing, which cuts them
into pieces. An empty table runs through and gives no rows. Other columns, whatever their names are, come through all stages but the
last; names that begin with orrery_ are reserved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import decontaminate, language, lines, near, packing
from orrery.llm.common import discard, materialize, settle, table


#: Stages call texts near duplicates from this similarity on; op9's own threshold is higher.
PERCENT = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies count once, as they are still there; n_chars follows the text that is left."""
    left = lines.drop_lines(docs, F.col("source"), "text", distinct=True)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("orrery_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return left.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.keep_first(docs, PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("best_fit_packing", best_fit_packing)]

#: SQL can express neither the k-means of the first stage nor best-fit packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage's input is deleted when its output is written; packing writes its bins before it returns."""
    docs, spent = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        discard(*spent)
        spent = [docs]
        settle(spark)
    out = STAGES[-1][1](spark, docs, sf_dir)
    discard(*spent)
    return out
