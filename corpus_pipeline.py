"""The corpus pipeline: language ID, line dedup, SimHash near-dedup, suffix-array dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. ``run``
writes each stage's result to the shared folder and gives the next stage what it reads back.

Nulls and odd input: language ID drops null texts and texts without letters; later stages keep a null text as it is and
count it as empty. Documents without a doc_id are kept by all stages and come first where order matters; of rows that are
equal in doc_id and text near-duplicate removal keeps one. Texts of any length pass whole. Columns other than those of
documents are dropped by the first stage, whatever their names. An empty table gives empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netstrata.llm import langid, lines, packing, simhash, suffix
from netstrata.llm.common import materialise, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars of the text as it is now."""
    return df.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; a missing lang becomes the predicted one."""
    docs = docs.select(*COLUMNS)
    model = langid.train(langid.training_texts(docs))
    limits = langid.calibrate(docs, model)
    kept = langid.predict(docs, model).filter(langid.accepted(limits))
    return _documents(kept.withColumn("lang", F.coalesce("lang", "_lang")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that stand on many sites and came before."""
    return _documents(lines.dedup_lines(docs.select(*COLUMNS)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return _documents(simhash.near_duplicates(docs.select(*COLUMNS)))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without bytes of 100-byte strings that came before."""
    return _documents(suffix.dedup(docs.select(*COLUMNS)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    pieces = materialise(packing.tokenised_pieces(docs), "pieces")
    return packing.pack(pieces, pieces.count())


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("packing", pack)]

#: Models, similarities and tokens can't be said in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
