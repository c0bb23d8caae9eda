"""A corpus from documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns
a DataFrame; it is written as Parquet and read again as the next one's ``docs``.
All but the last return the columns of ``docs``.  Null texts pass the first stage
and come out of later ones as texts without content; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyfield.llm import lines, packing, shingles, suffixes, toxicity
from tallyfield.llm.shared import written

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None

#: Bytes from which the pipeline cuts repeated strings: passages of over 50 words have nearly always as many.
PASSAGE = 256


def _packed_row(docs: DataFrame) -> DataFrame:
    """``row``, and the id and text again under names that can't clash with its columns."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))


def _with_text(found: DataFrame, columns: list[str], text: Column) -> DataFrame:
    """The columns of ``__row`` with another text and its length."""
    new = {"text": text, "n_chars": F.coalesce(F.length(text), F.lit(0)).cast("long")}
    return found.select(*[new[c].alias(c) if c in new else F.col("__row")[c].alias(c) for c in columns])


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the lexicon is learned from the labelled ones."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    lexicon = toxicity.learn(docs, labels)
    return toxicity.score(_packed_row(docs), lexicon, keep=["__row"]).where("predicted = 0").select("__row.*")


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go from all documents but the first; every document stays."""
    return _with_text(lines.deduplicated(_packed_row(docs), keep=["__row"]), docs.columns, F.col("kept"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts whose five-word shingles are similar at 0.8 or more stays, that of the smallest id; SimHash fingerprints and MinHash keys find candidates."""
    return shingles.one_of_each(docs)


def remove_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of ``PASSAGE`` bytes that stand earlier too are cut out, their first place stays; every document stays."""
    return _with_text(suffixes.remove_repeats(_packed_row(docs), keep=["__row"], length=PASSAGE, keep_first=True, as_text=True), docs.columns, F.col("kept"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: a row for each piece of a document."""
    return packing.packed(docs, keep=["doc_id"])


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_recurring_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", remove_repeated_strings),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
