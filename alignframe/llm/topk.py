"""Exact top-k search by inner product with block-at-a-time pruning.

Terms are a vector's dimensions, weights its integer components. Documents lie in blocks, ranges of ids within a label, each with
the largest and smallest weight of every term and a forward index of its rows. For a query, the sum over terms of the larger
of weight times maximum and weight times minimum bounds every score of a block. Blocks are taken in order of their
bounds and scored through the forward index until the bound falls below the query's k-th best score.

In Spark this takes two rounds. The first scores each query in its ``SEEDS`` blocks of highest bound, which gives a k-th best
score from below. Queries with the same best block then share a chunk, and the bounds alone tell which blocks a chunk
can still need: only those are sent to it, in slabs of bounded size. A task goes through its slab's blocks in order of bounds,
leaves out those below the threshold and raises the threshold as it finds better rows. Ties go to the smaller id, so a block whose
bound equals the threshold is still scored.

Vectors that are null or hold null or non-finite components, or have no id, take no part, nor do rows whose
length differs from the query's. Rows that repeat an id are each a candidate; a query is never its own candidate, so no row with
its id is. A repeated query id answers once, with the smallest of its vectors. Empty vectors are never found. Components beyond the
range of a long are taken as its ends, and so are scores; all others are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alignframe.llm.common import stored

K = 10
SCALE = 1024
BLOCK_IDS = 4096
SLAB_BLOCKS = 16
CHUNK_QUERIES = 1024
# Blocks whose bounds a task compares with a chunk of queries; they travel without their forward indexes.
BOUND_BLOCKS = 2048
SEEDS = 2
_LONG = (1 << 63) - 1


def integers(vector: str, scale: int = SCALE) -> Column:
    """Floors of scaled components, or null for a vector that takes no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(F.col(vector).isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def blocks(rows: DataFrame, block_ids: int = BLOCK_IDS) -> DataFrame:
    """``block, width, ids, weights, high, low``: forward index and term bounds of every block.

    ``rows``: ``id, label, weights``. A block holds the ids of one range and label, ``block_ids`` of them at most unless ids
    repeat.
    """

    def build(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        x = np.array(group["weights"].tolist(), dtype=np.int64).reshape(len(group), -1)
        ids = group["id"].to_numpy(dtype=np.int64)
        return pd.DataFrame([(key[0], x.shape[1], ids.tobytes(), x.tobytes(), x.max(axis=0).tobytes(), x.min(axis=0).tobytes())],
                            columns=["block", "width", "ids", "weights", "high", "low"])

    placed = rows.withColumn(
        "block", F.concat_ws(":", F.size("weights"), F.floor(F.col("id") / block_ids), F.coalesce(F.col("label").cast("string"), F.lit("")))
    ).where(F.size("weights") > 0)
    return placed.groupBy("block").applyInPandas(
        build, "block string, width int, ids binary, weights binary, high binary, low binary"
    )


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.int64).reshape(-1, width)


def bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """``queries x blocks``: no row of the block scores more."""
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    if _fits(queries, high, 62) and _fits(queries, low, 62):
        return _products(up, high) + _products(down, low)
    wide = [x.astype(object) for x in (up, high, down, low)]
    return _to_long(wide[0] @ wide[1].T + wide[2] @ wide[3].T)


def _fits(a: np.ndarray, b: np.ndarray, bits: int) -> bool:
    """Whether no sum of products can reach so many bits."""
    largest = [float(np.abs(x.astype(np.float64)).max()) if x.size else 0.0 for x in (a, b)]
    return a.shape[1] * largest[0] * largest[1] < 2.0**bits


def _to_long(x: np.ndarray) -> np.ndarray:
    return np.clip(x, -_LONG - 1, _LONG).astype(np.int64) if x.size else x.astype(np.int64)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products; by doubles where those are exact, by unbounded integers where longs are too short."""
    if _fits(a, b, 53):
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T if _fits(a, b, 63) else _to_long(a.astype(object) @ b.astype(object).T)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by score, then smaller id."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= kth)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))


def _search(query_ids, queries, thresholds, slab: pd.DataFrame, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per query the best rows of the slab that can be among its k best."""
    width = queries.shape[1]
    bound = bounds(queries, _matrix(slab["high"], width), _matrix(slab["low"], width))
    forward = [(np.frombuffer(i, dtype=np.int64), np.frombuffer(w, dtype=np.int64).reshape(-1, width)) for i, w in zip(slab["ids"], slab["weights"], strict=True)]
    order = np.argsort(-bound, axis=1, kind="stable")
    best = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)) for _ in query_ids]
    thresholds = thresholds.copy()
    # One rank of every query's order at a time; queries that take the same block score it together.
    live = np.arange(len(query_ids))
    for rank in range(len(forward)):
        live = live[bound[live, order[live, rank]] >= thresholds[live]]
        if not len(live):
            break
        for at in np.unique(order[live, rank]):
            mine = live[order[live, rank] == at]
            ids, x = forward[at]
            scores = _products(queries[mine], x)
            for q, row in zip(mine, scores, strict=True):
                fit = np.flatnonzero((row >= thresholds[q]) & (ids != query_ids[q]))
                if not len(fit):
                    continue
                all_ids, all_scores = np.concatenate([best[q][0], ids[fit]]), np.concatenate([best[q][1], row[fit]])
                top = _best(all_ids, all_scores, k)
                best[q] = (all_ids[top], all_scores[top])
                if len(top) == k:
                    thresholds[q] = max(thresholds[q], best[q][1][-1])
    for q, (ids, scores) in enumerate(best):
        if len(ids):
            yield int(query_ids[q]), ids, scores


_LEAST = -(1 << 63)
_FOUND = "query_id bigint, vec_id bigint, score bigint"


def _found(items: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> pd.DataFrame:
    items = list(items)
    return pd.DataFrame({
        "query_id": np.repeat(np.array([q for q, _, _ in items], dtype=np.int64), [len(i) for _, i, _ in items]),
        "vec_id": np.concatenate([i for _, i, _ in items]) if items else np.zeros(0, dtype=np.int64),
        "score": np.concatenate([s for _, _, s in items]) if items else np.zeros(0, dtype=np.int64),
    })


def top_k(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", k: int = K,
          scale: int = SCALE, block_ids: int = BLOCK_IDS, seeds: int = SEEDS, slab_blocks: int = SLAB_BLOCKS,
          chunk_queries: int = CHUNK_QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best other rows of every row that ``is_query`` marks."""
    rows = vectors.where(F.col(key).isNotNull()).select(
        F.col(key).cast("bigint").alias("id"), F.col(label).alias("label"), integers(vector, scale).alias("weights"), is_query.alias("ask")
    ).where("weights is not null")
    index = stored(blocks(rows, block_ids), "blocks")
    asked = stored(
        rows.where("ask").groupBy("id").agg(F.min("weights").alias("weights"))
        .select("id", F.size("weights").alias("width"), F.pmod(F.xxhash64("id"), F.lit(1 << 20)).alias("hash"), "weights").where("width > 0"),
        "queries",
    )
    chunks = -(-asked.count() // chunk_queries) or 1
    started, first = _seeded(asked.withColumn("chunk", (F.col("hash") % chunks).cast("int")), index, chunks, k, seeds)
    best = started.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list("score"), False), 1, k).alias("s"))
    threshold = best.select(F.col("query_id").alias("id"), F.when(F.size("s") == k, F.element_at("s", k)).otherwise(F.lit(_LEAST)).alias("threshold"))
    ready = stored(
        _near_chunks(asked, first, chunks, chunk_queries).join(threshold, "id", "left")
        .select("id", "width", "weights", "chunk", F.coalesce("threshold", F.lit(_LEAST)).alias("threshold")), "thresholds"
    )
    needed = stored(_needed(ready, index, chunks, slab_blocks), "needed")

    def score_slab(key: tuple, asking: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asking) or not len(held):
            return _found(iter(()))
        q = np.array(asking["weights"].tolist(), dtype=np.int64)
        return _found(_search(asking["id"].to_numpy(), q, asking["threshold"].to_numpy(), held, k))

    pair = ["chunk", "width", "slab"]
    # Renamed to themselves, or both sides of the cogroup would bear the same columns.
    slabs = needed.select(*[F.col(c).alias(c) for c in pair]).distinct()
    asking = ready.join(slabs, ["chunk", "width"]).select(*pair, "id", "weights", "threshold")
    held = needed.join(index, ["block", "width"]).select(*pair, "block", "ids", "weights", "high", "low")
    scored = asking.groupBy(*pair).cogroup(held.groupBy(*pair)).applyInPandas(score_slab, _FOUND)
    # At most k rows per query and slab.
    # The bitwise complement turns the order of all longs around, the negative not that of the smallest.
    order = F.struct(F.bitwise_not("score").alias("worse"), "vec_id")
    top = scored.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(order)), 1, k).alias("top"))
    return top.select("query_id", F.posexplode("top").alias("place", "t")).select(
        "query_id", (F.col("place") + 1).cast("int").alias("rank"), "t.vec_id", F.bitwise_not("t.worse").alias("score")
    )


def _bounded(queries: DataFrame, columns: list[str], index: DataFrame, chunks: int, of, schema: str) -> DataFrame:
    """Every chunk of queries with the bounds of all blocks, ``BOUND_BLOCKS`` at a time; the forward indexes stay behind."""
    parts = -(-index.count() // BOUND_BLOCKS) or 1
    pair = ["width", "part", "chunk"]
    part = F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int").alias("part")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    to_parts = queries.select("width", "chunk", *columns, every(parts).alias("part"))
    to_chunks = index.select("width", part, "block", "high", "low", every(chunks).alias("chunk"))
    return to_parts.groupBy(*pair).cogroup(to_chunks.groupBy(*pair)).applyInPandas(of, schema)


def _seeded(asked: DataFrame, index: DataFrame, chunks: int, k: int, seeds: int) -> tuple[DataFrame, DataFrame]:
    """Scores of every query in its blocks of highest bound; and these blocks, best first."""

    def candidates(key: tuple, asking: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asking) and len(held):
            q = np.array(asking["weights"].tolist(), dtype=np.int64)
            bound = bounds(q, _matrix(held["high"], key[0]), _matrix(held["low"], key[0]))
            for i, row in zip(asking["id"], bound, strict=True):
                for at in np.argsort(-row.astype(np.float64), kind="stable")[:seeds]:
                    out.append((i, held["block"].iloc[at], row[at]))
        return pd.DataFrame(out, columns=["id", "block", "bound"])

    found = _bounded(asked, ["id", "weights"], index, chunks, candidates, "id bigint, block string, bound bigint")
    first = stored(found.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct("bound", "block")), False), 1, seeds).alias("b")), "seeds")

    def score_seed(key: tuple, asking: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asking) or not len(held):
            return _found(iter(()))
        q = np.array(asking["weights"].tolist(), dtype=np.int64)
        return _found(_search(asking["id"].to_numpy(), q, np.full(len(q), _LEAST), held, k))

    seeded = first.select("id", F.explode("b.block").alias("block")).join(asked.select("id", "weights"), "id")
    started = seeded.groupBy("block").cogroup(index.groupBy("block")).applyInPandas(score_seed, _FOUND)
    return started, first


def _near_chunks(asked: DataFrame, first: DataFrame, chunks: int, chunk_queries: int) -> DataFrame:
    """Queries with ``chunk``: those of one best block together, or cut in several chunks where they are many."""
    best = first.select("id", F.col("b")[0]["block"].alias("best"))
    many = best.groupBy("best").agg(F.ceil(F.count(F.lit(1)) / chunk_queries).alias("cuts"))
    cut = F.pmod("hash", F.col("cuts"))
    placed = asked.join(best, "id").join(many, "best")
    return placed.withColumn("chunk", F.pmod(F.xxhash64("best", cut), F.lit(chunks)).cast("int"))


def _needed(ready: DataFrame, index: DataFrame, chunks: int, slab_blocks: int) -> DataFrame:
    """``chunk, width, block, slab``: blocks whose bound reaches the threshold of some query of the chunk."""

    def reached(key: tuple, asking: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        names = held["block"].iloc[:0]
        if len(asking) and len(held):
            q = np.array(asking["weights"].tolist(), dtype=np.int64)
            bound = bounds(q, _matrix(held["high"], key[0]), _matrix(held["low"], key[0]))
            names = held["block"][(bound >= asking["threshold"].to_numpy()[:, None]).any(axis=0)]
        return pd.DataFrame({"chunk": key[2], "width": key[0], "block": names}).astype({"chunk": "int32", "width": "int32"})

    found = _bounded(ready, ["id", "weights", "threshold"], index, chunks, reached, "chunk int, width int, block string")
    sizes = found.groupBy("chunk", "width").agg(F.ceil(F.count(F.lit(1)) / slab_blocks).alias("slabs"))
    return found.join(sizes, ["chunk", "width"]).select(
        "chunk", "width", "block", F.pmod(F.xxhash64("block"), F.col("slabs")).cast("int").alias("slab")
    )
