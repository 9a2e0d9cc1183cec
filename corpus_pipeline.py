"""A training corpus from ``documents``: STAGES in order, each over all that the one before kept.

Every stage but the last returns the columns of documents; its result is written as Parquet
and read again as the next one's input. An empty table passes through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from replicakit.llm import byte_bpe, quality
from replicakit.llm.common import crc_mod, table, text_of
from replicakit.llm.exact_dedup import exact_dedup
from replicakit.llm.mixing import copies, mix
from replicakit.llm.queries import TOKENIZER
from replicakit.llm.simhash import simhash_near_dedup
from replicakit.session import delete_path, scratch_path, scratch_scope


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier gives 0.3 or more stay. It learns from the labelled
    rows among them whose crc32 modulo 5 is not 0."""
    labels = table(spark, sf_dir, "labels").filter(crc_mod(F.col("doc_id"), 5) != 0)
    weights = quality.train(docs, labels)
    return docs.filter(quality.score_column(docs, weights, text_of(docs)) >= 0.3)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest identifier stays."""
    return exact_dedup(docs, carry=docs.columns).filter("kept").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (4-word shingles, 4 bits) the document with the smallest
    identifier stays; where several share it, the one with the smallest digest, once."""
    text = text_of(docs)
    key = F.concat_ws(":", F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.sha2(text, 256))
    keyed = docs.select(key.alias("_key"), F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    ids = F.struct(F.isnull("doc_id").alias("last"), "doc_id", key.alias("k"))
    found = simhash_near_dedup(docs.select(ids.alias("id"), text.alias("text")),
                               shingle=4, radius=4, id_col="id")
    stay = found.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id.k").alias("_key")).distinct()
    once = F.row_number().over(W.partitionBy("_key").orderBy("_key")) == 1
    return keyed.join(stay, "_key").withColumn("_once", once).filter("_once").select("_row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row per whole copy, and one with the first words of a document taken in part."""
    return copies(mix(docs, carry=docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every copy, and the digest of what they decode to."""
    import public_tokenizers

    ranks = byte_bpe.load_ranks(public_tokenizers.path(TOKENIZER))
    out = byte_bpe.round_trip(docs, ranks, public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("exact_dedup", drop_copies),
    ("simhash", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: Training, xxHash64 fingerprints and BPE have no SQL form; the stages are tested against
#: brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over what the one before wrote. What a stage left in the scratch folder goes once
    its result is written, and that result once the next stage's is."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch_scope(spark):
            kept = stage(spark, docs, sf_dir)
            path = scratch_path(spark, f"stage-{name}")
            kept.write.parquet(path)
        if before:
            delete_path(spark, before)
        docs, before = spark.read.schema(kept.schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
