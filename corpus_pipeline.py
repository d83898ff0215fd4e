"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept;
its result is written as Parquet and read again as the next one's documents.
All but the last return the columns of documents, as they were, whatever the
names of further columns.  An empty table stays empty through all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solvefront.llm import mixing, ngram_join, packing, quality_crf, quality_rules
from solvefront.llm.common import fold, stage, table

#: Near copies: five-word shingles, similarity 0.8 or more.
NEAR = {"shingle": 5, "num": 80, "den": 100}
#: The classifier rejects a document whose lines are more bad than good.
REJECT_BELOW = 0.5


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the line frequencies of their source reject, without their frequent lines.

    Null, empty and wordless texts go (under 50 words).  A null source is a
    source of its own.  Repeated rows are kept or go together.  ``n_chars``
    follows the text where there is such a column.
    """
    kept = quality_rules.clean(spark, docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines the field finds good; all of them where the labels teach nothing.

    Null and empty texts are scored as one empty line.  Rows with a null id
    are scored, not learnt from.  Repeated rows get one verdict.
    """
    learn = ~F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    field = quality_crf.fit(docs.where(learn), table(spark, sf_dir, "labels").where(learn))
    return quality_crf.keep_good(spark, docs, field, threshold=REJECT_BELOW)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the least id.

    Texts without words are no one's copies and stay, as rows without an id
    do.  Of repeated rows one stays.
    """
    return ngram_join.keep_one(spark, docs, **NEAR)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them; texts without words at their source's rate as well."""
    return mixing.mix(spark, docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their ids, sequence and offset; a null or empty text is its end id."""
    return packing.pack_documents(spark, docs)


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("near_duplicates", near_duplicates_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Hashing, a fitted model and packing are beyond SQL; tests/llm runs the stages and holds their operators against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(spark, step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
