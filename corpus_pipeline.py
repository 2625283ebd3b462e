"""The corpus pipeline: five stages, each by one of the operators for training data.

``run`` applies them to the documents.  Each stage's output is written as
Parquet in the folder that executors share and read again as the next one's
input.  Empty tables pass through; stages keep further columns' names out of
their own (they begin with an underscore).
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sagefold.llm import jaccard, mixing, pieces, pii, queries, toxicity
from sagefold.llm.common import hand_back, materialise

#: No SQL expresses the stages; tests hold them against brute force.
ORACLE_SQL = None

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = toxicity.fit(docs, queries.table(spark, sf_dir, "labels"), toxicity.learnable())
    return toxicity.score(docs, model.classifier, COLUMNS).filter(F.col("score") < queries.TOXIC_FROM).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, that with the smallest id."""
    return jaccard.keep_one(docs.select(COLUMNS), jaccard.link(docs)).select(COLUMNS)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to their kinds; n_chars follows."""
    rest = ["doc_id", "lang", "source"]
    clean = pii.scan(docs, keep=rest).withColumn("text", pii.sanitise(F.col("_text"), F.col("spans")))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, 0 to 3 times."""
    times = mixing.repeats(docs).withColumnRenamed("doc_id", "_id")
    joined = docs.select(COLUMNS).join(times, F.col("doc_id").eqNullSafe(F.col("_id")), "left").withColumn("_times", F.coalesce("times", F.lit(1)).cast("int"))
    return joined.filter("_times > 0").withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids and their digest."""
    model = queries.tokenizer("piece_bpe_32k.model")
    return queries.pieces_digest(pieces.encode_documents(docs, model), model)


def _tidy(stage):
    """``stage``, before which the driver hands back what those before it have freed: one driver runs them all."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        hand_back(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("toxicity", _tidy(drop_toxic)),
    ("n-gram Jaccard join", _tidy(drop_near_copies)),
    ("PII", _tidy(hide_personal_data)),
    ("mixing sources", _tidy(mix_sources)),
    ("SentencePiece", _tidy(encode_pieces)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"stage{k}")
    return docs
