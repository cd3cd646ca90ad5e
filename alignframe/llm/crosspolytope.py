"""Near-duplicate vectors by cross-polytope hashing.

Signs and fast Hadamard transforms, three times over, rotate a vector at random; its hash is the axis nearest to it, one of
twice the dimension. A table's bucket is made of the hashes of ``HASHES`` rotations and the label. Every vector is listed
in its own bucket of each table and looks into further ones, those of its second nearest axis in each rotation. Who meets in a
bucket is verified by cosine in double precision; a pair that meets more than once is counted where it meets first.

Equal vectors of a label form a class, and only classes are hashed. A bucket of many classes is cut into tiles of
about ``TILE`` by ``TILE`` classes that different tasks verify. A tile returns a count of links per class and a forest of links,
never its pairs.

Vectors that are null, all zero, or hold null or non-finite components, and those without label or id, link with
nothing; vectors of different lengths do not link either. Such a vector is its own component. Repeated rows are vectors
of their own that link with each other. ``n_links`` counts rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alignframe.llm.common import Forest, components, stored, tasks

LEAST_COSINE = 0.93
TABLES = 8
HASHES = 2
TILE = 512
SHARE = 8192
_ROWS = 1024


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of every row; the width is a power of two."""
    n, width = x.shape
    step = 1
    while step < width:
        x = x.reshape(n, width // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return x / np.sqrt(width)


def axes(x: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest and second nearest signed axis of every row after a pseudo-random rotation."""
    width = 1 << max(x.shape[1] - 1, 1).bit_length()
    rng = np.random.default_rng(seed)
    y = np.zeros((len(x), width))
    y[:, : x.shape[1]] = x
    for _ in range(3):
        y = hadamard(y * rng.choice([-1.0, 1.0], width))
    size = np.abs(y)
    rows = np.arange(len(x))
    out = []
    for _ in range(2):
        at = size.argmax(axis=1)
        out.append(2 * at + (y[rows, at] < 0))
        size[rows, at] = -1.0
    return out[0], out[1]


def buckets(x: np.ndarray, tables: int = TABLES, hashes: int = HASHES, seed: int = 0) -> np.ndarray:
    """``rows x tables x (1 + hashes)``: the own bucket, then the further ones to look into."""
    out = np.zeros((len(x), tables, 1 + hashes), dtype=np.int64)
    if len(x) > _ROWS:
        # Few rows at a time: all the transforms of one stretch stay in the processor's cache.
        for at in range(0, len(x), _ROWS):
            out[at : at + _ROWS] = buckets(x[at : at + _ROWS], tables, hashes, seed)
        return out
    base = 2 << max(x.shape[1] - 1, 1).bit_length()
    for t in range(tables):
        found = [axes(x, seed + t * hashes + h) for h in range(hashes)]
        for probe in range(1 + hashes):
            for h, (near, second) in enumerate(found):
                out[:, t, probe] = out[:, t, probe] * base + (second if h == probe - 1 else near)
    return out


def usable(vector: str, label: str, key: str) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        F.col(vector).isNotNull() & F.col(label).isNotNull() & F.col(key).isNotNull() & ~F.coalesce(bad, F.lit(True))
        & F.exists(vector, lambda x: x != 0)
    )


def _unit(rows: pd.Series) -> np.ndarray:
    x = np.array(rows.tolist(), dtype=np.float64)
    # Scaling first keeps squares of very small and very large components in range.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _verify(least: float, tables: int, hashes: int):
    """Links between the classes listed in a bucket and those that look into it, for all tiles of a share."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids, sizes, own = rows["id"].to_numpy(), rows["size"].to_numpy(), rows["own"].to_numpy()
        widths = rows["width"].to_numpy()
        shaped = np.array(rows["buckets"].tolist(), dtype=np.int64).reshape(-1, tables, 1 + hashes)
        met = [np.zeros((2, 0), dtype=np.int64)]
        for width in np.unique(widths):
            mine = np.flatnonzero(widths == width)
            unit = _unit(rows["vector"].iloc[mine])
            tile = rows["tile"].to_numpy()[mine]
            order = np.argsort(tile, kind="stable")
            ends = np.flatnonzero(np.diff(tile[order])) + 1
            for members in np.split(order, ends):
                listed = own[mine[members]]
                u, v = members[listed], members[~listed]
                i, j = np.nonzero(unit[u] @ unit[v].T >= least - 1e-9)
                pairs = np.stack([u[i], v[j]])
                pairs = pairs[:, (unit[pairs[0]] * unit[pairs[1]]).sum(axis=1) >= least]
                met.append(mine[pairs])
        i, j = np.concatenate(met, axis=1)
        keep = ids[i] != ids[j]
        i, j = i[keep], j[keep]
        slot, bucket = rows["slot"].to_numpy()[i], rows["bucket"].to_numpy()[i]
        x, y = shaped[i], shaped[j]
        # Where the two can meet: in the own bucket of either, if the other looks into it.
        in_x, in_y = (y == x[:, :, :1]).any(axis=2), (x == y[:, :, :1]).any(axis=2)
        first = (in_x | in_y).argmax(axis=1) if len(i) else np.zeros(0, dtype=np.int64)
        at = np.arange(len(i))
        bx, by, x_open, y_open = x[at, slot, 0], y[at, slot, 0], in_x[at, slot], in_y[at, slot]
        place = np.where(x_open & y_open, np.minimum(bx, by), np.where(x_open, bx, by))
        # Both listed in this bucket: the pair is seen from either side, and counted from the smaller id's.
        twice = (bx == by) & (ids[i] > ids[j])
        keep = (first == slot) & (place == bucket) & ~twice
        i, j = i[keep], j[keep]
        both = pd.DataFrame({"a": np.concatenate([ids[i], ids[j]]), "n": np.concatenate([sizes[j], sizes[i]])})
        counts = both.groupby("a", as_index=False)["n"].sum().assign(b=-1, link=False)
        forest = Forest()
        tree = [(p, q) for p, q in zip(ids[i].tolist(), ids[j].tolist(), strict=True) if forest.join(p, q)]
        links = pd.DataFrame(tree, columns=["a", "b"]).assign(n=0, link=True)
        return pd.concat([counts, links])[["a", "b", "n", "link"]].astype({"a": "int64", "b": "int64", "n": "int64", "link": bool})

    return run


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                    least: float = LEAST_COSINE, tables: int = TABLES, hashes: int = HASHES, tile: int = TILE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``."""
    rows = vectors.select(F.col(key).cast("bigint").alias("vec_id"), F.col(vector).alias("vector"), F.col(label).alias("label"))
    rows = rows.withColumn("usable", usable("vector", "label", "vec_id"))
    good = rows.where("usable").select("vec_id", "vector", "label")
    classes = good.groupBy("label", "vector").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("size"))

    @F.pandas_udf("array<bigint>")
    def bucket_of(batch: pd.Series) -> pd.Series:
        out = np.empty(len(batch), dtype=object)
        lengths = batch.map(len).to_numpy()
        for n in np.unique(lengths):
            mine = np.flatnonzero(lengths == n)
            found = buckets(_unit(batch.iloc[mine]), tables, hashes).reshape(len(mine), -1)
            for at, row in zip(mine, found, strict=True):
                out[at] = row
        return pd.Series(out, index=batch.index)

    # Two labels may hold the same vector of one id when rows repeat an id: the class is named by its smallest id and label.
    hashed = stored(classes.withColumn("buckets", bucket_of("vector")), "classes")
    per_table = F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), lambda t: F.struct(
        t.alias("slot"),
        F.array_distinct(F.slice("buckets", t * (1 + hashes) + 1, 1 + hashes)).alias("looks"),
    ))
    listed = hashed.select("label", F.size("vector").alias("width"), "id", "size", F.explode(per_table).alias("t")).select(
        "label", "width", "id", "size", "t.slot", F.posexplode("t.looks").alias("probe", "bucket")
    )
    where = ["label", "width", "slot", "bucket"]
    # A bucket matters if a class is listed in it and another one is listed or looks in.
    sizes = listed.groupBy(*where).agg(
        F.sum((F.col("probe") == 0).cast("bigint")).alias("owners"), F.count(F.lit(1)).alias("lookers")
    ).where("owners > 0 and lookers > 1")
    across, down = F.ceil(F.col("owners") / tile).cast("int"), F.ceil(F.col("lookers") / tile).cast("int")
    dealt = listed.join(sizes.select(*where, across.alias("across"), down.alias("down")), where)
    row = F.pmod(F.hash("id"), F.col("across")).alias("row")
    column = F.pmod(F.hash("id"), F.col("down")).alias("column")
    owners = dealt.where("probe = 0").select(*where, "id", F.lit(True).alias("own"), row, F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("column"))
    lookers = dealt.select(*where, "id", F.lit(False).alias("own"), F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("row"), column)
    tiles = owners.select(*where, "id", "own", "row", "column").union(lookers.select(*where, "id", "own", "row", "column"))
    # Most tiles are small; a share holds many of them, about SHARE rows.
    shares = max(tasks(vectors.sparkSession), -(-hashed.count() * tables * (1 + hashes) // SHARE))
    tile_key = F.xxhash64(*where, "row", "column")
    full = tiles.join(hashed.select("label", "id", "vector", "size", "buckets"), ["label", "id"]).select(
        F.pmod(tile_key, F.lit(shares)).alias("share"), tile_key.alias("tile"), "width", "slot", "bucket", "id", "own", "size", "vector", "buckets"
    )
    found = stored(full.groupBy("share").applyInPandas(_verify(least, tables, hashes), "a bigint, b bigint, n bigint, link boolean"), "links")
    joined = components(found.where("link").select("a", "b"))
    counts = found.where("not link").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    named = hashed.select("label", "vector", "id", "size").join(counts, "id", "left").join(
        joined.withColumnRenamed("node", "id"), "id", "left"
    ).select(
        "label", "vector", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
    )
    linked = good.join(named, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
