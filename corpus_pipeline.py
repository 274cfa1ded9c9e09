"""Documents through five stages: toxicity, quality, near-duplicates, personal data, packing.

Each stage reads what the one before has kept. All but the last return the
columns of ``documents``. A null text is kept or rejected like an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.llm import minhash, pii, quality, toxicity
from lumenloom.llm.common import materialize
from lumenloom.llm.queries import DEMO_KEY, pack_tokens


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a probability of being toxic under 0.3, by a machine trained on labelled ones among them."""
    machine = toxicity.fit(docs, _labels(spark, sf_dir))
    return toxicity.score(docs, machine).where("predicted = 0").select(*docs.columns)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the counts and the model, trained on labelled ones among them."""
    model = quality.fit(docs, _labels(spark, sf_dir))
    return quality.judge(docs, model).where("kept").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that with the smallest id; rows without an id stay, as no group has them.

    Of several rows with that id the one with the least hash of its text stays.
    """
    found = minhash.near_duplicates(docs).where("doc_id IS NOT NULL")
    stay = docs.join(found.where("NOT kept").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
    repeated = materialize(found.where("kept").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc_id"))
    if repeated.isEmpty():
        return stay
    order = F.struct(F.xxhash64("text").alias("text_hash"), *docs.columns)
    one = stay.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(order).alias("row"))
    return stay.join(repeated, "doc_id", "left_anti").unionByName(one.select(*[F.col("row")[c].alias(c) for c in docs.columns]))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with pseudonyms; n_chars, if there, follows the new text."""
    hidden = pii.pseudonymize(docs, DEMO_KEY)
    if "n_chars" in docs.columns:
        hidden = hidden.withColumn("n_chars", F.when(F.col("pii").isNull() | (F.size("pii") == 0), F.col("n_chars")).otherwise(F.char_length("text")))
    return hidden.select(*[F.col(c).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document: where its token ids stand in which training sequence, and their checksum."""
    return pack_tokens(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_duplicates", drop_copies),
    ("personal_data", hide_personal_data),
    ("packing", pack),
]

#: Trained models and best fit are not for SQL; the tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
