"""A corpus pipeline: rules, language, near-duplicates and contamination take documents out, and what is left is encoded.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame; all but the last
return the columns of ``docs``. Between stages the rows are a Parquet table, so each stage's plan begins with a scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plinth.llm import decontaminate, langid, pieces, quality, simhash
from plinth.llm.queries import documents, tokenizer_file
from plinth.session import staged, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition and base rules keep."""
    return quality.keep_clean(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language a model, trained on the labelled ones among them, accepts."""
    return langid.keep_identified(docs, langid.train(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each group whose 5-word shingles are similar at 0.8 or more."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth are words of benchmark windows."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's pieces, and whether decoding gives its text back."""
    keep = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_pieces", "pieces", "lossless"))
    return pieces.encode(docs, tokenizer_file("piece_bpe_32k.model"), keep=keep)


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: Trained models and sampled draws aren't SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0].lower())
    return docs
