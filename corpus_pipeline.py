"""A training-data pipeline over ``documents``: rules, classifier, near duplicates, mixture, token ids.

Each stage gets all that the one before kept, reread from where it was written. All but the last return
the columns of ``documents``. Rules and classifier are fitted on labelled rows of the whole table, since
what earlier stages kept has few bad rows to learn from. Columns of ``documents`` beyond its own may have any
names, as long as they are not repeated; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from zephyrine.llm import bpe, mixing, nearcopies, quality, queries, rules
from zephyrine.llm.common import shared_folder, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed rules and the isolation forest keep.

    Null and empty texts go, by the rules. Equal rows share a verdict; ids may be missing or repeated.
    """
    forest = rules.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rules.keep(docs, forest)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good.

    Null and empty texts have a score too. Equal rows share a verdict; ids may be missing or repeated.
    """
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.keep(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash, completed to five-word shingles with a similarity
    of 0.8 or more.

    Texts without words are copies of one another. The least id stays, a missing one last; ties go by a hash
    of the text, and of equal rows one stays.
    """
    return nearcopies.one_of_each(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which sources are interleaved to their weights.

    A missing source is a source of its own. Of one source, rows with equal ids follow one another by text.
    """
    return mixing.mix(docs, ties=("text",))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place in the mixture, token count and digests of the ids and of what they decode to.

    ``docs`` is read from the files of the stage before. Null texts count as empty.
    """
    return bpe.round_trip(mixing.ordered(docs), queries.vocabulary("byte_bpe_50k.tiktoken"), place="position")


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("byte_bpe", byte_bpe),
]

#: The models of the first two stages have no SQL form; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written as Parquet below the checkpoint folder."""
    out = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{out}/{name}")
        docs = spark.read.parquet(f"{out}/{name}")
    return docs
