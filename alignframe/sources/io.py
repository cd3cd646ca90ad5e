"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, StringType

CORRUPT = "_corrupt_record"


def read_parquet_set(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Several Parquet files or folders as one table."""
    return spark.read.parquet(*paths)


def read_json_records(spark: SparkSession, path: str, schema: StructType, multi_line: bool = False) -> DataFrame:
    """JSON records under an explicit schema; unreadable ones keep their text in ``_corrupt_record``.

    One record per line can be split over tasks; ``multi_line`` is for files that hold one array.
    """
    full = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    return spark.read.schema(full).json(path, multiLine=multi_line, columnNameOfCorruptRecord=CORRUPT)


def read_subsets(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Named Parquet subsets as one table with a ``subset`` column."""
    parts = [spark.read.parquet(p).withColumn("subset", F.lit(name)) for name, p in paths.items()]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def read_templates(spark: SparkSession, path: str) -> dict[str, str]:
    """Prompt templates from a JSON object of texts: configuration, a few lines."""
    row = spark.read.json(path, multiLine=True).first()
    return {} if row is None else row.asDict()


def append_unscored(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Inputs that have no result yet, by key and not by position: the order of the input may change between runs."""
    return inputs.join(done.select(key), key, "left_anti")


def append_results(results: DataFrame, path: str, run: str | None = None) -> None:
    """Add a run's results; those of other runs stay as they are.

    With a name, a run's rows go to a partition of their own, staged aside and put in place by one rename when the job has
    ended: an append that is tried again replaces its own rows, one that is killed leaves none. Readers of ``path`` see a column
    ``run``. Without a name files are added as they come, once for each call.
    """
    if run is None:
        results.write.mode("append").parquet(path)
    else:
        _replace(results.withColumn("run", F.lit(run)), path, ["run"])


def _replace(rows: DataFrame, path: str, partitions: list[str]) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def metric_rows(df: DataFrame, metrics: dict[str, Column], run: str, subset: str | None = None) -> DataFrame:
    """``run, subset, metric, value`` lines: all metrics in one aggregate, then unpivoted."""
    keys = [] if subset is None else [subset]
    values = [m.cast("double").alias(name) for name, m in metrics.items()]
    wide = df.groupBy(*keys).agg(*values)
    lines = wide.unpivot(keys, [f"`{name}`" for name in metrics], "metric", "value")
    group = F.lit("all") if subset is None else F.col(subset)
    return lines.select(F.lit(run).alias("run"), group.alias("subset"), "metric", "value")


def append_metrics(lines: DataFrame, path: str, step: str = "all") -> None:
    """Add the metric lines of a run's step; an append that is tried again replaces its own lines."""
    _replace(lines.withColumn("step", F.lit(step)), path, ["run", "step"])
