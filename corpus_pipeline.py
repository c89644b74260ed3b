"""From raw documents to training tokens: the stages one after the other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` hands each stage the Parquet
files that its predecessor wrote. All but the last return the columns of docs. Null texts count as
empty; rows without an id cannot be told apart and are never dropped as near copies; empty tables
pass through; extra columns stay up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm import exact_dedup, jaccard_join, mixing, piece_codec, quality_mil
from gaugeline.llm.common import fresh, table
from gaugeline.llm.queries import KEEP_SCORE, piece_model
from gaugeline.operators.staging import stage


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier, learned from the labels of these documents: what it rejects goes."""
    model = quality_mil.fit(docs, table(spark, sf_dir, "labels"))
    score = fresh(docs, "score")
    return quality_mil.score(docs, model, out=score).filter(F.col(score) >= KEEP_SCORE).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts, the smallest id stays."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each component of near copies, the smallest id stays."""
    kept = jaccard_join.near_duplicates(docs).filter(F.col("component_id") == F.col("doc_id")).select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.filter("doc_id IS NULL"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources to target weights by Poisson replication, in a global hashed order."""
    return mixing.mix(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids with the byte span of each piece, in the order of the mix: its files come in that of shuffle_key."""
    ordered = mixing.restore_order(docs.select("doc_id", "source", "text"))
    coded = piece_codec.encode(ordered, piece_model(), drop_text=True)
    return coded.select("shuffle_key", "copy_no", "doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "begins", "ends")


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("n-gram jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("sentencepiece encoding and decoding", encode),
]

# a trained classifier and BPE are not SQL: tests/llm holds the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
