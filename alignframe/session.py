"""Session settings the jobs rely on."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, as named by ``spark.checkpoint.dir`` or set on the Spark context.

    There is no fallback: a folder of one machine would lose what other machines wrote.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    named = spark.sparkContext.getCheckpointDir()
    if not named:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path nobody has written yet, inside the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows from the shared folder: later steps neither plan nor compute the earlier ones again."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys`` into as many tasks as the session uses, for work that is heavy per row.

    Adaptive execution sizes tasks by bytes and would gather small rows in few tasks; a stated number prevents that.
    """
    tasks = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return df.repartition(int(tasks), *keys) if tasks.isdigit() else df.repartition(*keys)


def joined_rows(left: DataFrame, right: DataFrame, on: str | list[str] | Column, how: str = "inner") -> DataFrame:
    """A join of two tables that grow with the input, by shuffle and sort.

    Spark guesses sizes from those of the files. Rows that were built from short columns or exploded are far larger, and a
    table that is guessed to be small would be gathered in the driver to be broadcast.
    """
    return left.join(right.hint("merge"), on, how)


def reachable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, whatever folder they start in.

    A cluster whose machines do not share that path ships the package itself, as with ``--py-files``.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
