"""Whitening of embeddings with distributed block matrices.

Every entry becomes a whole number. Sums per dimension are exact, so rows are centred before anything is multiplied. Centred
rows, in the order in which they are stored, make blocks of equally many rows; each task fills up its last block with rows of
zeros, which add nothing to any product. The blocks are a ``BlockMatrix``: its transpose times itself is the scatter matrix, whose
small eigenproblem the driver solves, and it times the whitening matrix gives the projected rows.

What travels: a product deals its middle dimension over tasks, a few blocks each, and adds up what they give, so no task
holds more than these blocks and one square matrix. The driver holds matrices of the dimensions alone: 32 KB at 64
dimensions, 128 MB at 4,096. Spark's product compares lists of block numbers on the driver, so matrices of more than
``SLAB`` blocks are multiplied slab by slab.

Vectors that are null, or hold null or non-finite entries, take no part. Neither do entries that are no exact whole number
after scaling (2^53 and more), nor vectors of another length than most have (of equally common lengths the longer); empty
vectors give no rows. Repeated rows and null ids are rows of their own. A component without variance (eigenvalue below
rounding error of the largest) has a null ``whitened`` and takes no part in ``identity_error``; without any variance
``explained`` is null. A ``deviation`` beyond 64 bits is null. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alignframe.llm.common import small_batches, stored, tasks

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 32
# Entries of a block: two megabytes.
BLOCK_ENTRIES = 1 << 18
# Blocks that one part of a product holds, and blocks of one matrix.
PART = 8
SLAB = 4096

_RESULT = (
    "id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
)


def whole_entries(vector: Column) -> Column:
    """The scaled entries as whole numbers; null for vectors that take no part."""
    limit = float(1 << 53)

    def usable(c: Column) -> Column:
        return F.coalesce(F.abs(c.cast("double") * SCALE) < limit, F.lit(False))

    return F.when(
        F.forall(vector, usable), F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("bigint") + OFFSET)
    )


def _blocks(rows: int, dimensions: int):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = seq = 0

        def block(parts: list[pd.DataFrame]) -> pd.DataFrame:
            whole = pd.concat(parts)
            values = np.zeros((rows, dimensions))
            values[: len(whole)] = np.stack(whole["centred"].to_numpy())
            return pd.DataFrame({
                "task": whole["task"].iloc[:1], "seq": [seq], "ids": [whole["id"].tolist()],
                "deviations": [whole["deviation"].tolist()], "entries": [values.ravel()],
            })

        for batch in batches:
            while len(batch):
                part, batch = batch.iloc[: rows - size], batch.iloc[rows - size :]
                held.append(part)
                size += len(part)
                if size == rows:
                    yield block(held)
                    held, size, seq = [], 0, seq + 1
        if held:
            yield block(held)

    return cut


def _times(left: BlockMatrix, right: BlockMatrix, parts: int) -> BlockMatrix:
    """The product, its middle dimension dealt over ``parts``: Spark's own method takes that argument, the wrapper does not."""
    product = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, parts)
    return BlockMatrix(product, left.rowsPerBlock, right.colsPerBlock)


def _scatter(matrix: BlockMatrix, blocks: int) -> np.ndarray:
    return _times(matrix.transpose(), matrix, -(-blocks // PART)).toLocalMatrix().toArray()


def whiten(table: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS,
           block_entries: int = BLOCK_ENTRIES, slab: int = SLAB) -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error``: one row per vector and component."""
    spark = table.sparkSession
    renamed = F.col("id").alias(key)
    empty = spark.createDataFrame([], _RESULT).select(renamed, "component", "n", "deviation", "whitened", "explained", "identity_error")
    rows = table.select(F.col(key).cast("bigint").alias("id"), whole_entries(F.col(vector)).alias("x")).where("x is not null")
    rows = stored(rows, "whole_entries")
    # Most have this length; few lengths exist.
    common = rows.groupBy(F.size("x").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    if common is None or not common["size"]:
        return empty
    dimensions, n = common["size"], common["n"]
    rows = rows.where(F.size("x") == dimensions)
    # Exact beyond 64 bits; one number per dimension.
    sums = rows.select(F.posexplode("x").alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast("decimal(25,0)")).alias("sum"))
    total = [int(r["sum"]) for r in sums.orderBy("at").collect()]

    exact = "decimal(38,0)"
    totals = F.array(*[F.lit(str(t)).cast(exact) for t in total])
    # n times the distance from the mean.
    gaps = F.zip_with("x", totals, lambda x, t: (x.cast("decimal(17,0)") * F.lit(n).cast("decimal(19,0)")).cast(exact) - t)
    gaps = F.transform(gaps, lambda g: g.cast("decimal(38,0)"))
    # Squares of long numbers stay exact and fast where they fit.
    squares = F.aggregate(F.transform("gaps", lambda g: g.try_cast("bigint")), F.lit(0).cast("bigint"), lambda a, g: F.try_add(a, F.try_multiply(g, g)))
    centred = rows.withColumn("gaps", gaps).select(
        "id", squares.alias("deviation"), F.transform("gaps", lambda g: g.cast("double") / n).alias("centred"),
        F.spark_partition_id().alias("task"),
    )
    # Enough blocks for every task, none above its size.
    per_block = max(1, min(block_entries // dimensions, -(-n // (4 * tasks(spark)))))
    small_batches(spark, 500)
    cut = centred.mapInPandas(
        _blocks(per_block, dimensions), "task int, seq int, ids array<bigint>, deviations array<bigint>, entries array<double>"
    )
    cut = stored(cut, "cut_blocks")
    # One row per block.
    numbered = cut.select("task", "seq", (F.row_number().over(Window.orderBy("task", "seq")) - 1).alias("block"))
    blocks = stored(cut.join(numbered, ["task", "seq"]).drop("task", "seq"), "blocks")
    count = blocks.count()

    def part(start: int) -> tuple[BlockMatrix, int]:
        """The blocks of one slab, numbered from 0."""
        here = blocks.where(F.col("block").between(start, start + slab - 1)).select("block", "entries")
        pairs = here.rdd.map(lambda r: ((r[0] - start, 0), DenseMatrix(per_block, dimensions, r[1], True)))
        return BlockMatrix(pairs, per_block, dimensions), min(slab, count - start)

    starts = range(0, count, slab)
    covariance = sum(_scatter(*part(s)) for s in starts) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    values, vectors, trace = values[order], vectors[:, order], float(np.trace(covariance))
    # The entry of largest size is positive, so that reruns agree.
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
    flat = values <= max(values[0], 0.0) * dimensions * np.finfo(float).eps
    scale = np.where(flat, 0.0, 1 / np.sqrt(np.where(flat, 1.0, values)))
    k, projection = len(order), vectors * scale
    whitening = BlockMatrix(spark.sparkContext.parallelize([((0, 0), DenseMatrix(dimensions, k, projection.ravel(order="F")))], 1), dimensions, k)

    projected, identity, means = None, np.zeros((k, k)), np.zeros(k)
    for s in starts:
        matrix, size = part(s)
        product = _times(matrix, whitening, 1)
        identity += _scatter(product, size)
        means += product.blocks.map(lambda b: b[1].toArray().sum(axis=0)).treeReduce(np.add)
        out = product.blocks.map(lambda b, s=s: (b[0][0] + s, b[1].toArray().ravel().tolist()))
        out = stored(spark.createDataFrame(out, "block int, entries array<double>", verifySchema=False), "projected")
        projected = out if projected is None else projected.unionByName(out)
    off = identity / n - np.outer(means / n, means / n) - np.eye(k)
    error = float(np.abs(off[~flat][:, ~flat]).max()) if (~flat).any() else None

    of_row = F.transform(
        F.arrays_zip("ids", "deviations"),
        lambda r, i: F.struct(r["ids"].alias("id"), r["deviations"].alias("deviation"), F.slice("entries", i * k + 1, F.lit(k)).alias("z")),
    )
    vectors_out = blocks.select("block", "ids", "deviations").join(projected, "block").select(F.inline(of_row))
    exploded = vectors_out.select("id", "deviation", F.posexplode("z").alias("at", "z"))
    shares = F.array(*[F.lit(float(v) / trace if trace > 0 else None).cast("double") for v in values])
    flats = F.array(*[F.lit(bool(f)) for f in flat])
    return exploded.select(
        renamed, (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation",
        F.when(~F.get(flats, F.col("at")), F.col("z")).alias("whitened"),
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
