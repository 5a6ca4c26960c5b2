"""Corpus preparation as stages over ``documents``.

Each stage works on all rows its predecessor kept; every stage but the last
returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from addrloom.llm import jaccard_join, langid, mixing, packing, quality_classifier
from addrloom.llm.common import dataset, free_name, materialize
from addrloom.llm.queries import tokenizer_path

#: A text goes only where the classifier is this sure of low quality.
LEAST_QUALITY = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those between two languages, go."""
    model = langid.fit(docs.where(~langid.held_out() & F.col("doc_id").isNotNull()))
    name = free_name(docs, "_language")
    own = F.col(name)
    return langid.with_language(docs, model, out=name).where((own.lang_pred != langid.UNKNOWN) & ~own.ambiguous).drop(name)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half go."""
    model = quality_classifier.fit_on(docs, dataset(spark, sf_dir, "labels"))
    name = free_name(docs, "_quality")
    return quality_classifier.with_score(docs, model, out=name).where(F.col(name) >= LEAST_QUALITY).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest id stays; rows without an id stay."""
    gone = jaccard_join.join(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the target weights take it."""
    name = free_name(docs, "_mix")
    return mixing.emit(mixing.mix(docs, out=name), name)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mix in sequences of 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_path(), 2048)


STAGES = [
    ("language ID", language_id),
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mix),
    ("best-fit packing", pack),
]

#: Learned models and exact similarity joins aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dataset(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{k}")
    return docs
