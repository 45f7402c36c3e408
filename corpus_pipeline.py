"""The corpus pipeline: each stage reads what the one before wrote and its decisions take effect.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, written as Parquet and read again as the next one's
``docs``. All but the last return the columns of ``documents``.

For all stages: an empty table gives an empty table; any column may be null; columns beside ``doc_id`` and
``text`` are passed on as they are, whatever their names; texts of any length are read whole; rows that are
equal get equal decisions, unless a stage is there to leave one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.decontaminate import clean
from tabulon.llm.langid import UNKNOWN, identify
from tabulon.llm.ngramjoin import representatives
from tabulon.llm.packing import pack
from tabulon.llm.secrets import redact
from tabulon.llm.store import written

#: A document is rejected if less of its letters belong to one language.
LEAST_SHARE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without a letter, or without a leading language, go.

    A null or empty text has no letter and goes. Repeated rows stay or go together. Of equal shares the first
    language by name leads. A table without any label has no language, and all its rows go. A null
    ``lang`` or ``doc_id`` only keeps a row out of training.
    """
    judged = identify(docs, keep=docs.columns)
    return judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SHARE)).select([F.col(f"kept_{c}").alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one with the least id.

    Rows without words are classes of their own and stay. Of rows that share the least id one stays, the least
    by its columns; a class without any id keeps one row, a class with an id keeps none without.
    """
    return representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item.

    A null or empty text covers nothing and stays. Items that are null or without a word are in no text. Repeated
    rows stay or go together; items may repeat, and need no id. With an empty benchmark all rows stay.
    """
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked; ``n_chars``, where there is one, follows the text.

    A null text stays null and has no characters to count. Spans that touch or overlap become one mask.
    """
    out = redact(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in out.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences.

    A null or empty text is one piece, the end token. Repeated rows are packed as often as they occur, and a
    null ``doc_id`` stays null. Pieces of equal length are interchangeable; their places follow the input's order.
    """
    return pack(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]
#: Tokens, classifiers and hashes are beyond SQL; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
