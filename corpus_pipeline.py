"""The corpus pipeline: toxic documents go, one of each group of near-duplicates stays, repeated passages are cut, contaminated
documents go, and what is left becomes SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs, of any length; all but the last return the columns of
documents, and further columns of any name along with them. Verdicts go by a row's id and text together, so rows that share an id
but not a text don't share a verdict. An empty table passes through as an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orbweave.llm import common, decontaminate, minhash, pieces, suffixes, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: rejects predicted documents. Equal texts share a verdict, so repeated rows stay or go together; null and empty
    texts stay."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10 on shingles of five words and a similarity of 0.8 or more: of a group the row of least id, then least hash of
    the text, stays, one of equal rows; rows without words or id all stay."""
    return minhash.drop_near_duplicates(docs, k=5, percent=80, bands=50, rows=5)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: bytes of 50-byte strings that a smaller document has go, and n_chars follows; a document may become empty, its
    row stays. Rows of equal id cut nothing from each other; null texts stay null."""
    return suffixes.cut_repeats(docs, n_chars="n_chars")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: rejects contaminated documents; repeated rows stay or go together, texts without words stay."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: doc_id, ids, n_tokens, one row for each that is left; a null text has no ids."""
    return pieces.encode(docs, pieces.piece_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("minhash", keep_one_of_near),
    ("suffix_dedup", cut_repeats),
    ("decontaminate", drop_contaminated),
    ("sentencepiece", to_pieces),
]

#: A trained model and a tokenizer aren't expressible in SQL; tests/llm/test_pipeline.py holds each stage and the whole run against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written as Parquet and read again."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
