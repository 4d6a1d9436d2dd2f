"""A corpus pipeline of five stages over `documents`, each on what the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next one's
docs. All but the last return the columns of documents.

Nulls, empty and long texts, ties, repeated rows and extra columns: a null, empty or wordless text is no near duplicate, has
nothing to cut and no benchmark window, so it stays unless the toxicity model rejects empty texts; the mix takes 0 words of
it. Texts are judged whole at any length. Repeated rows are near duplicates, of which one stays; among equals
the one with the smallest doc_id. A null doc_id is an ordinary row that comes after others. Extra columns pass through all
stages but the last, whatever their names. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, jaccard, mixing, suffix, toxicity
from tessera.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score 0.3 or more go; the model learns from the labels of docs."""
    return toxicity.accept(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates stays."""
    return jaccard.distinct_documents(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that also occur elsewhere are cut from the texts; all rows stay, n_chars follows the text."""
    from pyspark.sql import functions as F

    return suffix.dedup_text(docs, **suffix.PASSAGE).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a benchmark window go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of each row that the mix takes."""
    return mixing.mix_sources(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("suffix_dedup", cut_repeats), ("decontamination", drop_contaminated), ("mixing", mix)]

#: SQL can't express trained scores, merged transforms or the balanced rounding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
