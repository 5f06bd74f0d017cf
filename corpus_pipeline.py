"""Training-data pipeline: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.llm import line_dedup, minhash_dedup, packing, quality_classifier, secret_scans
from lodeline.llm.common import released, table, tables_so_far, visible, written


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; null and empty texts have nothing against them. Rows of a rejected id all go, null ids stay."""
    visible(spark)
    judged = quality_classifier.quality_classifier(docs)
    return _without(docs, judged.where("not kept").select("doc_id"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each line once, at its first document; documents of which nothing is left go, null and empty texts stay as they are. Rows of one id with different texts are documents each."""
    visible(spark)
    return _sized(line_dedup.without_duplicate_lines(docs))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: shingles of five words, similarity 0.8. Texts without words and null ids stay; equal rows stay once."""
    visible(spark)
    found = minhash_dedup.near_duplicates(docs, words=5)
    return _without(docs, found.where("not kept").select("doc_id")).dropDuplicates(["doc_id", "text"])


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets replaced by a mark; owners (sources) and repositories (what one holds in a language) of a value are counted over the documents that are left. Null texts stay null, repeated rows stay, no rows give none."""
    held = docs.withColumn("__repository", F.concat_ws("/", "source", "lang"))
    return _sized(secret_scans.redacted(held, repository="__repository").drop("__repository"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in sequences of 2048 tokens; a null text is the end token alone."""
    visible(spark)
    import public_tokenizers

    pieces = packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return packing.packed(pieces)


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids.where("doc_id is not null").distinct(), "doc_id", "left_anti").select(*docs.columns)


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES = [
    ("quality classifier", classify),
    ("line dedup", dedup_lines),
    ("near dedup", dedup_documents),
    ("secret scans", remove_secrets),
    ("packing", pack),
]

#: The classifier, the edit join and packing have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents. What a stage wrote on its way goes once its result is written, and so does the stage before."""
    docs, before = table(spark, sf_dir, "documents"), tables_so_far()
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        released(spark, before, tables_so_far() - 1)
    return docs
