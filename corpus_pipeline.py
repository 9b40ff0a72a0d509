"""From documents to packed token sequences, in five stages that each reread what the one before has written.

A stage takes (spark, docs, sf_dir) and returns the documents it keeps with all their
columns; the last returns the pieces of the packed sequences. Every stage handles
null texts, languages, sources and ids, repeated rows and empty tables as the
operator it calls does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.llm import mixing, neardup, outliers, packing, toxicity
from rowmill.llm.tokens import word_tokenizer
from rowmill.llm.words import word_count
from rowmill.plans.lineage import scratch

#: The stages depend on iterative and learned operators, which SQL cannot express.
ORACLE_SQL = None


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """Documents with a key of all they are judged by, under a name that is free; equal rows have the same key."""
    taken = {c.lower() for c in docs.columns}
    name = next(n for n in ("row_key", *(f"row_key_{i}" for i in range(len(taken) + 1))) if n not in taken)
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.hex(F.xxhash64("text", "lang", "source")))
    return docs.withColumn(name, key), name


def toxic_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a toxicity below 0.3, by a lexicon learned from labels that aren't held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out(F.col("doc_id")))
    return docs.where(toxicity.score(F.col("text"), toxicity.learn(docs, labels)) < 0.3)


def poor_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and are no outliers of their language and source."""
    keyed, key = _keyed(docs)
    rejected = outliers.quality_rules(keyed, carry=[key]).where(~F.col("kept")).select(key).distinct()
    return keyed.join(rejected, key, "left_anti").select(*docs.columns)


def one_of_each_group_stays(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the one with the smallest doc_id, null last. Texts without words are no duplicates of each other.

    Groups are told apart by their texts: unrelated documents with one doc_id, or
    without any, stay. Of equal rows one stays.
    """
    keyed, key = _keyed(docs)
    found = neardup.near_duplicates(keyed, carry=[key], component="component")
    group = F.coalesce(F.hex("component"), F.concat(F.lit("-"), F.col(key)))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", key))
    stay = found.groupBy(group.alias("group")).agg(first.alias("first")).select(F.col(f"first.{key}").alias(key)).distinct()
    return keyed.join(stay, key, "left_semi").dropDuplicates([key]).select(*docs.columns)


def sources_meet_their_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, up to three times."""
    keyed, key = _keyed(docs)
    mixed = mixing.mix(keyed, word_count(F.col("text")), carry=[key]).where("taken > 0")
    copies = mixed.groupBy(key).agg(F.sum((F.col("taken") / F.col("size")).cast("int")).alias("copies_taken")).select(F.col(key).alias("taken_key"), "copies_taken")
    once = keyed.dropDuplicates([key])
    taken = once.join(copies, F.col(key) == F.col("taken_key"))
    return taken.select(*docs.columns, F.explode(F.sequence(F.lit(1), copies["copies_taken"].cast("int"))).alias(f"{key}_copy")).select(*docs.columns)


def sequences_are_packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all rows in sequences of at most 4096 tokens."""
    return packing.pack(packing.cut_pieces(docs, word_tokenizer(), end_id=1))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic_documents_go),
    ("quality rules", poor_documents_go),
    ("near-duplicates", one_of_each_group_stays),
    ("mixing", sources_meet_their_weights),
    ("packing", sequences_are_packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder of tables; each result is written below the shared folder, read back, and deleted when the session's process ends."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = scratch(spark, "corpus")
    for i, (_, stage) in enumerate(STAGES):
        path = f"{base}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
