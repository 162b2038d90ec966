"""Documents to training sequences: the stages, each on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from condense.llm import chosen_path, packing, pii, rules, toxicity
from condense.llm.queries import TOKENIZER, TOXIC_FROM, held_out
from condense.session import written

#: Learned models decide and sequences are any valid packing, which SQL can't say; the tests compare with brute force.
ORACLE_SQL = None

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _clean(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject; it learns from the folds that are not held out.

    A NULL or empty text stays; repeated rows are judged alike; an empty table stays empty.
    """
    model = toxicity.fit(docs, _labels(spark, sf_dir).filter(~held_out()))
    return toxicity.score(_clean(docs), model).filter(F.col("score") < TOXIC_FROM).select(*COLUMNS)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the learned decision list.

    A NULL or empty text has too few words and goes; repeated rows are judged alike; an empty table stays empty.
    """
    found = rules.learn_from(docs, _labels(spark, sf_dir))
    return rules.judge(_clean(docs), found).filter("kept").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id (a NULL id last).

    Rows are documents of their own, whatever their ids: of repeated rows one stays, and rows of
    one id with different texts all do.
    """
    rows = written(_clean(docs).withColumn("_n", F.monotonically_increasing_id()), "numbered")
    found = chosen_path.near_duplicates(rows.select(F.col("_n").alias("doc_id"), "text"))
    named = found.select(F.col("doc_id").alias("_n"), "component_id").join(rows.select("_n", "doc_id"), "_n")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_n")
    kept = named.groupBy("component_id").agg(F.min(first)["_n"].alias("_n")).select("_n")
    return rows.join(kept, "_n", "left_semi").select(*COLUMNS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by the name of its kind; ``n_chars`` follows the text.

    A NULL text stays NULL, as its number of characters; every row stays, repeated ones too; an empty table stays empty.
    """
    masked = pii.redact(_clean(docs), pii.fit(docs))
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens.

    A NULL text is an end token alone; repeated rows are packed one by one; an empty table gives no pieces.
    """
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), limit=2048, end_id=0)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("near copies", drop_near_copies),
    ("personal data", redact),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table ``documents``, each written before the next; the last one's pieces."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, "stage")
    return docs
