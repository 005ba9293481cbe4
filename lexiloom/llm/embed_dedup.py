"""Embedding near-dedup with cross-polytope hashing.

Each unit vector is rotated by three rounds of random signs and a fast
Hadamard transform and hashed to its nearest signed axis; ``DEPTH`` hashes
make a bucket and ``TABLES`` tables are kept.  Multiprobe: a vector also goes
to the buckets where one hash is replaced by its next best axes.  Vectors are
only compared with those of equal label and length that share a bucket, and
every reported link is verified by the cosine in double precision.

Equal vectors of a label are one class before anything is compared, so copies
are never paired.  Buckets are formed over numbers alone.  Those that have the
same least class are one group, as near vectors share most of their buckets,
so a vector is sent once for each such group and not for each bucket.  A group
beyond ``TILE`` classes is cut into tiles of ``TILE`` by ``TILE``, which count
links and emit, by a union-find over all verified pairs, one edge from each
class to the least class that it reaches, never the pairs; a pair that meets
in several groups is counted in the first of them only.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components, and those with a null label, have no links and are their own
component; rows with a null id are linked like others, but name no component
(null where all its ids are null) and are not kept; rows that share an id count
as separate vectors with that id; labels of any type; other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .exact_dedup import SPREAD
from .graph import components
from .storage import durable, shuffle_width

TABLES = 6
DEPTH = 2
PROBES = 1
TILE = 1024
#: Vectors hashed and dealt out together.
SLICE = 200
#: Rows of groups that are compared together, and the largest group that is not a matrix of its own.
SHARE = 20_000
SMALL = 24
THRESHOLD = 0.98


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of rows whose length is a power of two, scaled to keep norms."""
    n, width, h = x.shape[0], x.shape[1], 1
    while h < width:
        y = x.reshape(n, width // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, width)
        h *= 2
    return x / np.sqrt(width)


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    signs = np.random.default_rng(seed)
    for _ in range(3):
        x = hadamard(x * signs.choice(np.array([-1.0, 1.0]), x.shape[1]))
    return x


def buckets(unit: np.ndarray, tables: int = TABLES, depth: int = DEPTH, probes: int = PROBES) -> np.ndarray:
    """Bucket numbers of unit vectors, one column for each table and probe; equal columns of a row may repeat."""
    n, d = unit.shape
    width = max(2, 1 << (d - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :d] = unit
    out = []
    best = min(probes + 1, width)
    for t in range(tables):
        axes = []
        for k in range(depth):
            y = rotate(padded, 1_000 * t + k)
            near = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :best]
            side = np.take_along_axis(y, near, axis=1) > 0
            axes.append(near * 2 + side)
        picks = [tuple([0] * depth)] + [tuple(p if k == j else 0 for k in range(depth)) for j in range(depth) for p in range(1, best)]
        for pick in picks:
            code = np.full(n, t, dtype=np.int64)
            for k in range(depth):
                code = code * (2 * width) + axes[k][:, pick[k]]
            out.append(code % ((1 << 31) - 1))
    return np.stack(out, axis=1)


def _units(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    # by the largest component first, so that very small and very large ones neither vanish nor overflow
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _members(tables: int, depth: int, probes: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for size, part in ((n, g.iloc[at : at + SLICE]) for n, g in pdf.groupby(pdf["vec"].map(len)) for at in range(0, len(g), SLICE)):
                codes = np.sort(buckets(_units(part["vec"]), tables, depth, probes), axis=1)
                keep = np.ones(codes.shape, dtype=bool)
                keep[:, 1:] = codes[:, 1:] != codes[:, :-1]
                row, col = np.nonzero(keep)
                yield pd.DataFrame({"label": part["label"].to_numpy()[row], "dims": np.int32(size), "code": codes[row, col].astype(np.int32), "cid": part["cid"].to_numpy()[row]})

    return run


def _near(unit: np.ndarray, keys: np.ndarray, part: np.ndarray, p: np.ndarray, q: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one tile within the threshold; rows are in order of ``keys``."""
    cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    ends = np.append(cuts[1:], len(keys))
    small = np.repeat(ends - cuts <= SMALL, ends - cuts)
    # small groups, all at once: each row with the one k places on
    for k in range(1, SMALL):
        i = np.flatnonzero(small[:-k] & (keys[:-k] == keys[k:]) & ((p[:-k] == q[:-k]) | (part[:-k] != part[k:])))
        if not len(i):
            break
        i = i[(unit[i] * unit[i + k]).sum(axis=1) >= threshold]
        yield i, i + k
    for lo, hi in zip(cuts.tolist(), ends.tolist(), strict=True):
        if hi - lo <= SMALL:
            continue
        same = p[lo] == q[lo]
        left = np.arange(lo, hi) if same else np.arange(lo, hi)[part[lo:hi] == p[lo]]
        right = left if same else np.arange(lo, hi)[part[lo:hi] == q[lo]]
        for at in range(0, len(left), 256):
            rows = left[at : at + 256]
            i, j = np.nonzero(unit[rows] @ unit[right].T >= threshold)
            i, j = rows[i], right[j]
            if same:
                keep = i < j
                i, j = i[keep], j[keep]
            yield i, j


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union-find in place: ``root[x]`` is the least number of x's set, before and after the pairs ``a, b`` are joined."""
    while True:
        a, b = root[a], root[b]
        apart = a != b
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root[:] = up


def _tiles(threshold: float):
    """Links within a share of the groups; each pair counts in the first group (least leader) that both are in."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, own in pdf.groupby("dims"):
            key = pd.util.hash_pandas_object(own[["label", "leader", "p", "q"]].astype({"label": object}), index=False).to_numpy()
            own = own.iloc[np.argsort(key, kind="stable")]
            key = np.sort(key)
            cid, copies, leader = own["cid"].to_numpy(), own["copies"].to_numpy(), own["leader"].to_numpy()
            unit = _units(own["vec"])
            many = own["leaders"].map(len).to_numpy()
            leaders = np.full((len(own), int(many.max())), -1, dtype=np.int64)
            leaders[np.arange(leaders.shape[1]) < many[:, None]] = np.concatenate(own["leaders"].to_list())
            links = np.zeros(len(cid), dtype=np.int64)
            # a class has a row in each of its groups; sets go across the groups of the share
            nodes, node = np.unique(cid, return_inverse=True)
            root = np.arange(len(nodes))
            for i, j in _near(unit, key, own["part"].to_numpy(), own["p"].to_numpy(), own["q"].to_numpy(), threshold):
                for at in range(0, len(i), 20_000):
                    a, b = i[at : at + 20_000], j[at : at + 20_000]
                    before = np.zeros(len(a), dtype=bool)
                    for c in range(leaders.shape[1]):  # an earlier group of both?
                        mine = leaders[a, c]
                        before |= (mine >= 0) & (mine < leader[a]) & (leaders[b] == mine[:, None]).any(axis=1)
                    np.add.at(links, a[~before], copies[b[~before]])
                    np.add.at(links, b[~before], copies[a[~before]])
                    _unite(root, node[a], node[b])
            low = nodes[root[node]]
            met = (links > 0) | (low != cid)
            out.append(pd.DataFrame({"cid": cid[met], "links": links[met], "low": low[met]}))
        return pd.concat(out)

    return run


def link_embeddings(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, tables: int = TABLES, depth: int = DEPTH, probes: int = PROBES) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``."""
    spark = df.sparkSession
    # single-precision vectors stay so until they are compared, which loses nothing
    kind = "array<float>" if df.schema[vec_col].dataType == T.ArrayType(T.FloatType()) else "array<double>"
    vec = F.col(f"`{vec_col}`").cast(kind)
    fit = F.col("label").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0) & F.expr("forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))") & F.expr("exists(vec, x -> x <> 0)")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("string").alias("label"), vec.alias("vec")).withColumn("vec", F.when(fit, F.col("vec")))
    # -0.0 and 0.0 are equal vectors
    rows = rows.withColumn("vec", F.transform("vec", lambda x: F.when(x == 0, 0.0).otherwise(x).cast(kind[6:-1])))
    # equal vectors of a label are one class, told by a 128-bit digest; vectors themselves are no keys
    rows = rows.withColumn("d1", F.xxhash64("vec", F.lit(1))).withColumn("d2", F.xxhash64(F.lit(2), "vec"))
    alone = rows.where("vec is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    classes, _ = durable(rows.where("vec is not null").groupBy("label", "d1", "d2").agg(F.first("vec").alias("vec"), F.min("vec_id").alias("first"), F.count("*").alias("copies")).withColumn("cid", F.monotonically_increasing_id()), "classes")

    hashed = classes.select("label", "vec", "cid").mapInPandas(_members(tables, depth, probes), "label string, dims int, code int, cid long")
    members, _ = durable(hashed.select(F.xxhash64("label", "dims", "code").alias("bucket"), "cid"), "members")
    # numbers only: a group for the least class of each bucket that has several
    full = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("cid").alias("leader")).where("n > 1").select("bucket", "leader")
    placed = members.join(full, "bucket").select("leader", "cid").distinct()
    sizes = placed.groupBy("leader").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts"))
    # at most a group for each bucket of a class
    groups, _ = durable(placed.join(sizes, "leader").groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("leader", "parts"))).alias("groups")), "groups")
    # from here on vectors: one row for each group (and tile) of a class
    dealt = classes.select("label", "vec", "cid", "copies").join(groups, "cid").select("label", F.size("vec").alias("dims"), "vec", "cid", "copies", F.col("groups.leader").alias("leaders"), F.explode("groups").alias("g")).select("*", "g.leader", "g.parts").drop("g")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    tiles = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiles = tiles.withColumn("p", F.least("part", "with")).withColumn("q", F.greatest("part", "with"))
    # many small groups share a task's; a tile stays whole
    shares = max(shuffle_width(spark), -(-members.count() // SHARE))
    shared = tiles.withColumn("share", F.pmod(F.xxhash64("leader", "p", "q"), F.lit(shares)))
    met, _ = durable(shared.groupBy("share").applyInPandas(_tiles(threshold), "cid long, links long, low long"), "met")

    named = components(met.where("low <> cid").select(F.col("cid").alias("u"), F.col("low").alias("v")))
    counts = met.groupBy("cid").agg(F.sum("links").alias("links"))
    own = classes.join(counts, "cid", "left").join(named.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = own.groupBy("component").agg(F.min("first").alias("component_id"))
    own, _ = durable(own.join(least, "component").select("label", "d1", "d2", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"), "named")
    # classes that hold much of a shuffle partition are few: at most SPREAD for each, and broadcast
    limit = max(1, own.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).first()["n"] // (SPREAD * shuffle_width(spark)))
    large, small = own.where(F.col("copies") > limit).drop("copies").withColumn("is_large", F.lit(True)), own.where(F.col("copies") <= limit).drop("copies")
    met = rows.where("vec is not null").select("vec_id", "label", "d1", "d2").join(F.broadcast(large), ["label", "d1", "d2"], "left")
    rest = met.where("is_large is null").select("vec_id", "label", "d1", "d2").join(small, ["label", "d1", "d2"])
    found = met.where("is_large").select("vec_id", "n_links", "component_id").union(rest.select("vec_id", "n_links", "component_id"))
    return found.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
