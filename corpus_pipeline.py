"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is
written as Parquet and read again as the next one's ``docs``. All but the last give back the columns
of ``documents``.

For every stage: an empty table gives an empty one; texts are read whole, however long; extra columns pass through,
whatever their names, all but the last stage's, which reads doc_id and text only. Rows that repeat are decided alike, and
near_duplicates keeps one of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import decontaminate, language, neardup, packing, queries, toxicity
from pagemill.llm.common import WorkTables

#: SQL can't train the classifiers, nor plan best fit; tests compare the stages with plain versions.
ORACLE_SQL = None


def _documents(found: DataFrame, docs: DataFrame) -> DataFrame:
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model is sure of; those without a letter go as well, null and empty texts among them.

    The model learns from ``docs``, from rows with a ``lang`` that op5 doesn't hold out; where none is left, no
    language is known and every document goes. A null doc_id or lang changes nothing in a document's own decision.
    """
    model = queries.language_model(spark, docs)
    found, name = language.identify(docs, model)
    return _documents(found.where(~F.col(f"`{name}`.rejected")), docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity under 0.7. A null or empty text has no hits and stays.

    The model learns from the texts of ``docs`` and the labels that op7 doesn't hold out; without labels of both kinds
    every document stays.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found, name = toxicity.score(docs, queries.toxicity_model(spark, docs, labels))
    return _documents(found.where(F.col(f"`{name}`.score") < 0.7), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest doc_id.

    Of rows with equal id and words one stays; rows with a null id all stay, and texts without words are
    near nothing. An id that repeats with other words is decided for each.
    """
    return neardup.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of any benchmark item; a null or empty text stays, and all do without items."""
    return decontaminate.clean_only(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces, with their ids and their places in sequences of 1024 tokens.

    A null or empty text is its end id alone, a null doc_id stays null, and rows that repeat are packed each.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    work = WorkTables(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        before = work.frames()
        docs = work.keep(stage(spark, docs, sf_dir), name)
        work.drop(*before)
    return STAGES[-1][1](spark, docs, sf_dir)
