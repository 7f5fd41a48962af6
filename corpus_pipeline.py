"""The corpus pipeline: toxicity, near-deduplication, benchmark decontamination,
mixing and sharding, each over all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finsift.llm import decontam, minhash, mixing, sharding, toxicity
from finsift.llm.common import remove, stage_path


def screen_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less those that score as toxic; labels only train the model.  Null
    and empty texts stay, repeated rows stay or go together, and without labels all stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.train(docs, labels)
    return toxicity.score(docs, model).where("predicted = 0").select(*[F.col(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one of least id.  Rows of equal
    id stay or go together; null, empty and blank texts are equal texts each; where no
    row of a class has an id, the rows of one of its texts stay."""
    return minhash.near_dedup(docs).where("kept").select(*[F.col(c) for c in docs.columns])


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less those that hold a test item.  Null and empty texts stay, items
    without words take nothing, repeated rows stay or go together."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to three times.  Texts without
    words move no words; rows equal in id, source and size get the same copies; a null
    source is one of its own, the last."""
    return mixing.mix(docs)


def make_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in eight contiguous shards of nearly equal bytes.  Null ids come first,
    a null text counts one byte, ties and copies each get a slot; columns named like
    those added (size, text_crc32, shard, slot) are replaced."""
    return sharding.shard(docs, 8)


STAGES = [
    ("toxicity", screen_toxicity),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("sharding", make_shards),
]
ORACLE_SQL = None  # a learned score, sampled candidates and random rounding are not SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written in the shared
    folder, read again by the next and then deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = stage_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
