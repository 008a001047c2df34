"""The corpus pipeline: quality rules, language ID, near-duplicates, source mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of docs, and returns the columns of documents, but
for the last, which returns packed pieces. run() writes each stage's rows to the shared folder and reads
them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderspring.llm import decision_list, kneser_ney, packing, pivotal, probminhash
from tenderspring.llm.shared import drop_path, free_name, new_path, scratch, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that neither the base rules nor the learned list reject, each judged by its own text, in one scan.

    Null and empty texts have no words and go. Rows that repeat are judged alike, null ids too. Columns may have
    any names. No documents: no rows. No labels: the base rules alone.
    """
    learned = decision_list.learn(docs, table(spark, sf_dir, "labels"))
    return docs.where(decision_list.verdict(F.col("text"), learned)["kept"])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is one that was learned; the others are rejected. The predicted language isn't kept:
    a stage returns the columns of documents, and lang stays as given.

    Null texts and those without a letter go, and all if no row has a language. Rows that repeat are judged
    alike. A text in several learned languages stays. No documents: no rows.
    """
    name = free_name("found", docs)
    return kneser_ney.identified(docs, carry=docs.columns, result=name).where(~F.col(name)["rejected"]).select(*(F.col(f"`{c}`") for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of equal and near-equal texts: that with the smallest id. Rows that repeat become
    one, null texts all stay, of equal texts with null ids one stays. No documents: no rows."""
    return probminhash.keep_one(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: 0, 1 or 2 times. Null and empty texts have no words to take and are
    as often in it as is sure; a null source is one of its own. Ties are told by pivotal.mixed. No documents: no rows."""
    name, copy = free_name("mix", docs), free_name("copy", docs)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = pivotal.mixed(docs, carry=docs.columns, result=name).where(F.col(name)["copies"] > 0)
    return rows.select(*columns, F.explode(F.sequence(F.lit(1), F.col(name)["copies"])).alias(copy)).select(*columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens. Null and empty texts are their end id; rows that
    repeat are packed each. No documents: no rows."""
    return packing.with_checksums(packing.packed(docs))


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("source_mixing", source_mixing),
    ("packing", packed),
]

#: Learned rules, language models and random rounding can't be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; returns the last one's rows. A stage's rows go once the next are written."""
    rows, held = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch():
            path = new_path(spark, name, outer=True)
            stage(spark, rows, sf_dir).write.parquet(path)
        if held:
            drop_path(spark, held)
        rows, held = spark.read.parquet(path), path
    return rows
