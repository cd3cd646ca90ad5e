"""Helpers shared by the operators: stored tables, hold-out rule, word codes, connected components."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alignframe.session import fresh_path

# Fixed value: what separates words, the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """The same rows as a Parquet table in the shared folder, computed once and readable after any executor is lost."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a missing id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def reachable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, whatever folder they start in.

    A cluster whose machines do not share that path ships the package itself, as with ``--py-files``.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Let Python workers take at most so many rows at a time: whole texts are large rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def local_path(uri: str) -> str | None:
    """The plain path of a folder that is mounted on every machine, or None for another kind of store."""
    parts = urlparse(uri)
    return parts.path if parts.scheme in ("", "file") else None


def write_file(uri: str, data: bytes) -> None:
    """Write a file whole: a repeated or parallel attempt of the same task leaves the same bytes under the same name."""
    import uuid

    from pyarrow import fs

    path = local_path(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{os.path.dirname(path)}/.{uuid.uuid4().hex}"
        with open(part, "wb") as out:
            out.write(data)
        os.replace(part, path)
        return
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    head, _, name = path.rpartition("/")
    part = f"{head}/.{uuid.uuid4().hex}-{name}"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, path)


def utf8(texts: pd.Series) -> pa.Array:
    """A text column as Arrow strings, with null as the empty text."""
    return pc.fill_null(pa.Array.from_pandas(texts, type=pa.large_string()), "")


class WordCodes:
    """The words of a batch of texts as numbers: ``codes`` index into ``words``, ``starts`` delimits the texts."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        split = pc.ascii_split_whitespace(texts)
        offsets = np.asarray(split.offsets, dtype=np.int64)
        flat = split.flatten()
        encoded = flat.dictionary_encode()
        self.words = encoded.dictionary.to_pylist()
        codes = np.asarray(encoded.indices, dtype=np.int64)
        if lower:
            # Word by word: Arrow's own kernel misreads slices of long string arrays.
            index: dict[str, int] = {}
            merged = [index.setdefault(w.encode().lower().decode(), len(index)) for w in self.words]
            self.words, codes = list(index), np.array(merged, dtype=np.int64)[codes]
        # White space at either end of a text leaves an empty word there.
        empty = self.words.index("") if "" in self.words else -1
        if empty >= 0:
            keep = codes != empty
            before = np.concatenate([[0], np.cumsum(keep)])
            codes, self.starts = codes[keep], before[offsets - offsets[0]]
        else:
            self.starts = offsets - offsets[0]
        self.codes = codes


def ragged_take(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenation of the slices ``starts[i] : starts[i] + lengths[i]``."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


class Forest:
    """Union-find; the smallest number of a set is its root."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


_FOREST_NODES = 1 << 20


def _spanning(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Drop links whose ends are connected already by links of the same task."""
    forest = Forest()
    for batch in batches:
        kept = [(a, b) for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True) if forest.join(a, b)]
        yield pd.DataFrame(kept, columns=["a", "b"]).astype("int64")
        if len(forest.parent) > _FOREST_NODES:
            # Forgetting only keeps a few more links; memory stays bounded.
            forest = Forest()


def components(links: DataFrame) -> DataFrame:
    """``node, component``: the smallest node reachable from each end of the links ``a, b`` (both bigint).

    Each task first reduces its links to a forest. Large-star and small-star steps (Kiveris et al. 2014) then hang all
    nodes of a component below its smallest one in a logarithmic number of rounds; every round's links are written
    to the shared folder.
    """
    spark = links.sparkSession
    edges = links.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    edges = stored(edges.distinct().mapInPandas(_spanning, "a bigint, b bigint"), "links")
    state = _fingerprint(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b")))
        edges = stored(small.where("a <> b").distinct(), "links")
        before, state = state, _fingerprint(edges)
        if before == state:
            break
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    ) if state[0] else spark.createDataFrame([], "node bigint, component bigint")


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
    return row[0], row[1]


SPACE = re.compile(r"[\x20\x09-\x0D]+")
