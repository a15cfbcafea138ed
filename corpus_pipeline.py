"""A corpus from raw documents to packed sequences, stage by stage.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before it wrote, and returns rows with the columns of
documents; the last returns the pieces of the packed sequences. Those are the five of COLUMNS: others are not carried, whatever
their names. An empty table gives an empty table in every stage, and texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxpanel.llm.exact_dedup import exact_dedup
from fluxpanel.llm.minhash import near_dedup
from fluxpanel.llm.packing import pack
from fluxpanel.llm.queries import tokenizer_path
from fluxpanel.llm.shared import written
from fluxpanel.llm.substring_dedup import substring_dedup
from fluxpanel.llm.toxicity import toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model, trained on the labelled ones among them, does not reject.

    Null and empty texts and null ids are scored like others; equal texts, repeated rows among them, go or stay together; a score that
    ties with the cut stays. Without labels nothing goes.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity(docs, labels, carry=COLUMNS).filter("kept").select(COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one of the smallest id.

    A null id comes last. A null text equals an empty one: one of all such documents stays. Of rows that tie, repeated rows among them, one stays.
    """
    return exact_dedup(docs, carry=COLUMNS).filter("kept").select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at a similarity of 0.8 on five-word shingles, the one of the smallest id.

    Documents without words (null texts too) are linked with nothing and stay, as do rows with a null id. Rows that share an id stay or go together.
    """
    gone = near_dedup(docs, size=5, percent=80).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(COLUMNS)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 20 words or more that an earlier document has; those left without words go.

    A document that loses nothing stays as it is, a null text and a null n_chars too; one that loses words has the length of what is left as
    n_chars. Earlier is the smaller id; null ids come last, rows that share an id are ordered by their place.
    """
    out = substring_dedup(docs, carry=["doc_id", "lang", "source", "n_chars"], with_text=True)
    changed = F.col("n_removed") > 0
    out = out.filter(~changed | (F.col("n_removed") < F.col("n_words")))
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.when(changed, F.length("kept_text").cast("bigint")).otherwise(F.col("n_chars")).alias("n_chars"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens, packed. A null or empty text is one piece of one id; repeated rows and null ids have pieces of their own."""
    return pack(docs, tokenizer_path("byte_bpe_50k.json"), "spaces", end=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", drop_passages),
    ("packing", pack_sequences),
]

#: A trained model and a linear program have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
