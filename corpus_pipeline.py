"""Cleaning of a training corpus in five stages, each written and read again.

language ID, line dedup, n-gram Jaccard join, mixing, packing.

Every stage takes documents with at least the columns of ``COLUMNS`` and all
but the last return exactly these: further columns of the input are dropped by
the first stage. A stage over an empty table returns an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomvec.llm import langid, linededup, mixing, ngram_join, packing
from loomvec.session import bound_batches, materialize, read_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier rejects go.

    A null text, and one without a letter, is rejected. Rows without a language
    or an id are judged like all others, and never learned from; repeated rows
    are judged each; without any usable label all documents are rejected.
    """
    bound_batches(spark)
    return langid.identify(docs, langid.fit(docs)).where("not rejected").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; so does a document that loses lines and keeps nothing but space.

    The earliest line by id and line number stays, a null id first. Rows equal
    in id and text are one document and keep the same lines. A null text stays
    null, and a document that loses nothing stays as it is.
    """
    found = linededup.dedup_lines(docs)
    found = found.where((F.col("lines_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    length = F.when(F.col("lines_dropped") == 0, F.col("n_chars")).otherwise(F.char_length("text").cast("long"))
    return found.select("doc_id", "text", "lang", "source", length.alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest id.

    Of several rows with one id the first text stays. Documents without words
    or without an id are duplicates of nothing and stay.
    """
    groups = materialize(ngram_join.jaccard_components(docs), "groups")
    return ngram_join.one_of_each_group(docs, groups).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, at most twice.

    Documents without words, null texts among them, are not taken. Rows without
    a source are a source of their own; repeated rows and ids count each.
    """
    mixed = mixing.mix(docs, keep=True).where("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: a row for each piece of each document.

    A null text counts as empty and still gives its end id; a null id is kept;
    repeated rows, as the mix makes them, are packed each.
    """
    bound_batches(spark)
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mix", mix), ("pack", pack)]
#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's rows written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
