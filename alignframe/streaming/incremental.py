"""Two jobs that keep their progress between runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from alignframe.operators.judging import net_outcome, verdict_points


def append_unscored_stream(spark: SparkSession, in_dir: str, schema: StructType, out_dir: str, checkpoint: str, key: str,
                           score: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Score the input files that are new since the last run, then stop.

    Keys that are done live in the stream's state store, one row per key, dealt over tasks by key and kept with the checkpoint:
    a batch looks its own keys up there and reads nothing of earlier results. Copies of a key count once, in a batch and
    between batches. Each batch is one folder of the output, written with overwrite: one that is run again after a failure
    replaces its own files. For very many keys, set the session's state store to RocksDB, which keeps them on disk.
    """
    arriving = spark.readStream.schema(schema).parquet(in_dir)

    def write(batch: DataFrame, batch_id: int) -> None:
        # The scorer may read its input more than once.
        fresh = batch.persist()
        try:
            score(fresh).write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}")
        finally:
            fresh.unpersist()

    return (
        arriving.dropDuplicates([key])
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _read_if_there(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The rows of a folder, or none before anything was written to it."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def scoreboard_stream(verdicts: DataFrame, idx: str = "idx") -> DataFrame:
    """The pair scoreboard over a stream of verdicts, in whatever order they arrive; use update or complete mode."""
    board = verdicts.where(F.col("output").isNotNull()).groupBy(idx).agg(F.sum(verdict_points()).alias("net"))
    return board.withColumn("outcome", net_outcome(F.col("net")))


_BOARD = "net bigint, outcome string"


def keep_board(board: DataFrame, out_dir: str, checkpoint: str, idx: str = "idx", compact_every: int = 10) -> StreamingQuery:
    """Keep a scoreboard stream as a table of its last states, which ``read_board`` reads.

    Each batch adds the questions it changed, in a folder of its own. Every ``compact_every`` batches a snapshot of the whole
    board is written aside, and then a pointer to it; readers follow the last pointer and add the changes since. A batch or a
    compaction that is run again replaces its own files, and a snapshot that was pointed to is never touched.
    """
    def write(batch: DataFrame, n: int) -> None:
        batch.select(idx, F.col("net").cast("bigint").alias("net"), "outcome").write.mode("overwrite").parquet(f"{out_dir}/changes/n={n}")
        if (n + 1) % compact_every == 0:
            compact_board(batch.sparkSession, out_dir, n, idx, board.schema[idx].dataType.simpleString())

    return (
        board.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _pointer(spark: SparkSession, out_dir: str) -> int:
    """The last batch that the current snapshot holds; one row per snapshot."""
    rows = _read_if_there(spark, f"{out_dir}/current", "id bigint, upto bigint")
    last = rows.agg(F.max("upto")).first()[0]
    return -1 if last is None else last


def compact_board(spark: SparkSession, out_dir: str, upto: int, idx: str = "idx", kind: str = "bigint") -> None:
    if _pointer(spark, out_dir) >= upto:
        return
    read_board(spark, out_dir, idx, kind, upto).write.mode("overwrite").parquet(f"{out_dir}/snapshots/upto={upto}")
    # Readers see the snapshot from here on.
    spark.range(1).write.mode("overwrite").parquet(f"{out_dir}/current/upto={upto}")


def read_board(spark: SparkSession, out_dir: str, idx: str = "idx", kind: str = "bigint", upto: int | None = None) -> DataFrame:
    """``idx, net, outcome``: the last state of every question, from one snapshot and the changes since."""
    schema = f"`{idx}` {kind}, {_BOARD}"
    at = _pointer(spark, out_dir)
    since = _read_if_there(spark, f"{out_dir}/changes", f"{schema}, n bigint").where(F.col("n") > at)
    if upto is not None:
        since = since.where(F.col("n") <= upto)
    if at >= 0:
        since = since.unionByName(spark.read.schema(schema).parquet(f"{out_dir}/snapshots/upto={at}").withColumn("n", F.lit(at)))
    last = since.groupBy(idx).agg(F.max_by(F.struct("net", "outcome"), "n").alias("_state"))
    return last.select(idx, "_state.net", "_state.outcome")
