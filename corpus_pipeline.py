"""A training corpus from raw documents: five stages, each over all that the one before kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame. ``run`` writes what a stage returns as Parquet into the
shared folder and hands the table to the next one. All stages but the last return the columns of ``docs``; the last adds
the ids. A stage treats null, empty and repeated rows as its operator's docstring says; an empty table stays empty.
"""

from __future__ import annotations

import functools
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alignframe.llm import mixing, quality, sentencepieces, simhash, toxicity
from alignframe.llm.common import reachable, stored, table
from alignframe.llm.queries import tokenizer_path


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def with_folder(stage: Stage) -> Stage:
    """Workers find the package; in local mode, where driver and executors are one process, a folder is chosen if none is
    configured."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _local_folder(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


def _local_folder(spark: SparkSession) -> None:
    reachable(spark)
    sc = spark.sparkContext
    if sc.master.startswith("local[") and not spark.conf.get("spark.checkpoint.dir", None) and not sc.getCheckpointDir():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="alignframe-"))


@with_folder
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose toxicity score is 0.5 or more."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score(F.col("text"), model) < 0.5)


@with_folder
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose quality score reaches the threshold."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.score(F.col("text"), model) >= quality.THRESHOLD)


@with_folder
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one document: the one with the smallest id, one without an id only where none has one.

    Groups are those of the SimHash operator, with the shingles and the distance it uses by default. Rows that share an id
    but not a text are documents of their own; the survivor among several rows of an id is chosen by hashes of the whole
    row, so that reruns agree. Rows equal in every column are one document. Columns of any name pass through.
    """
    names = [F.col(f"`{c}`") for c in docs.columns]
    # Two 64-bit hashes name a row by its content; nothing else of it takes part in the search.
    row = F.struct(F.xxhash64(*names).alias("h"), F.xxhash64(F.lit(1), *names).alias("g"))
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), row["h"].alias("h"), row["g"].alias("g"))
    found = simhash.near_duplicates(docs.select(key.alias("key"), "text"), key="key")
    first = found.where("key = component_id").select(F.struct(F.col("key.h").alias("h"), F.col("key.g").alias("g")).alias("row")).distinct()
    # The same partitioning serves the rows that repeat and the choice, so the texts move once.
    one = docs.select(row.alias("row"), F.struct(*names).alias("doc")).dropDuplicates(["row"])
    return one.join(first, "row", "left_semi").select("doc.*")


@with_folder
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as the mix takes it."""
    return mixing.mixed_documents(docs)


@with_folder
def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, source, n_tokens, ids``: the token ids of every document of the mix."""
    pieces = sentencepieces.Pieces.read(tokenizer_path("piece_bpe_32k.model"))
    encoded = sentencepieces.encode(docs.select("doc_id", "source", "text"), pieces)
    return encoded.select("doc_id", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_good),
    ("simhash", one_of_each_group),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

# The classifiers and the piece model have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    _local_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
