"""The stages of the corpus pipeline, for corpus_pipeline.py. Each takes (spark, docs, sf_dir) and gives a frame; all but the last give the columns of `docs`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, made_since, mark, place_of, stored, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are more probably harmless than not."""
    from .toxicity import keep_harmless, train

    return keep_harmless(docs, train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many sites share; none goes."""
    from .line_dedup import drop_boilerplate

    out = drop_boilerplate(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: that with the smallest id. Documents without an id stay, and rows that repeat an id stay or go together."""
    from .ngram_join import jaccard_components

    gone = jaccard_components(docs).where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    from .decontamination import without_leaks

    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    import public_tokenizers

    from .packing import pack_documents

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`. A stage's own tables and its predecessor's result go when its result is written; nothing else does."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, step in STAGES[:-1]:
        number = mark()
        docs = stored(step(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        result = place_of(docs)
        delete(spark, [*before, *(p for p in made_since(number) if p != result)])
        before = [result]
    return STAGES[-1][1](spark, docs, sf_dir)
