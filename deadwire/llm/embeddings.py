"""Embedding near-duplicates by collision-counting projections.

Unit vectors with cosine >= c lie within d = sqrt(2 - 2c) of each other. Each vector is projected
onto M orthonormal directions and each projection is sorted; around every query's
value a window of half-width w = d / sqrt(t + 1) is opened, and the windows that hold the
other vector are counted. Since the squared differences of orthonormal projections add up
to at most d^2, no more than t of them can exceed w: a pair in range collides at least M - t
times. The count M - t is thus calibrated for a recall of 1, and what passes it is verified
by the exact cosine in double precision.

Spark: exact copies collapse to one representative (pre-aggregated), representatives of a
label are dealt into blocks of about ``BLOCK`` by a hash, and each pair of blocks of one label
is one group of bounded size, however large the label. A pair of blocks whose
bounding boxes in the projections are further apart than d is skipped. A group returns for
each vector its number of links (weighted by copies) and an edge to its local group's
first member; links themselves are never written out, and ``components`` joins the groups.

Work within a label grows with the square of its distinct vectors (at 64 dimensions and
cosine 0.93 one-dimensional windows cannot do less at this recall); it is spread evenly over
bounded groups.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deadwire.llm.common import join_back, materialize
from deadwire.llm.components import components

BLOCK, PROJECTIONS, MISSES, SEED = 1536, 32, 7, 20240229


def directions(dim: int, count: int = PROJECTIONS) -> np.ndarray:
    """[dim, min(count, dim)] orthonormal columns from a fixed seed."""
    q, _ = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q[:, :count]


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def collisions(left: np.ndarray, right: np.ndarray, half: float) -> np.ndarray:
    """[left, right] number of projections in which the query's window holds the other."""
    counts = np.zeros((len(left), len(right)), np.uint8)
    for i in range(left.shape[1]):
        order = np.argsort(right[:, i], kind="stable")
        ordered = right[order, i]
        rank = np.empty(len(order), np.uint16 if len(order) < 1 << 16 else np.int64)
        rank[order] = np.arange(len(order))
        low = np.searchsorted(ordered, left[:, i] - half, side="left").astype(rank.dtype)
        many = np.searchsorted(ordered, left[:, i] + half, side="right").astype(rank.dtype) - low
        counts += (rank[None, :] - low[:, None]) < many[:, None]  # unsigned: below low wraps round
    return counts


def similar(left: np.ndarray, right: np.ndarray, cosine: float, misses: int = MISSES) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of unit vectors with cosine >= ``cosine``."""
    none = np.zeros(0, np.int64)
    q = directions(left.shape[1])
    a, b = left @ q, right @ q
    reach = np.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-9
    gap = np.maximum(0, np.maximum(a.min(0) - b.max(0), b.min(0) - a.max(0)))
    if (gap * gap).sum() > reach * reach:
        return none, none
    misses = min(misses, q.shape[1] - 1)
    enough = q.shape[1] - misses
    i, j = np.nonzero(collisions(a, b, reach / np.sqrt(misses + 1)) >= enough)
    hit = np.zeros(len(i), bool)
    for s in range(0, len(i), 1 << 16):
        p = slice(s, s + (1 << 16))
        hit[p] = np.einsum("ij,ij->i", left[i[p]], right[j[p]]) >= cosine
    return i[hit], j[hit]


def _group(cosine: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        side = rows["side"].to_numpy()
        vectors = np.array(rows["vector"].tolist(), np.float64)
        rep, copies = rows["rep"].to_numpy(), rows["copies"].to_numpy()
        if rows["i"].iloc[0] == rows["j"].iloc[0]:
            x = unit(vectors)
            a, b = similar(x, x, cosine)
            a, b = a[a != b], b[a != b]
            n_links = np.bincount(a, copies[b], len(rows)).astype(np.int64)
        else:
            at, to = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(at) or not len(to):
                return pd.DataFrame({"rep": rep[:0], "root": rep[:0], "n": copies[:0]})
            a, b = similar(unit(vectors[at]), unit(vectors[to]), cosine)
            a, b = at[a], to[b]
            n_links = np.bincount(a, copies[b], len(rows)).astype(np.int64)
            n_links += np.bincount(b, copies[a], len(rows)).astype(np.int64)
        root = _roots(len(rows), a, b)
        some = np.flatnonzero(n_links)
        return pd.DataFrame({"rep": rep[some], "root": rep[root[some]], "n": n_links[some]})

    return run


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes."""
    root = np.arange(n)
    while len(a):
        before = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = root[root]
        if np.array_equal(before, root):
            break
    return root


def near_duplicates(table: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label",
                    cosine: float = 0.93) -> DataFrame:
    """(id, n_links, component_id, kept): one row per row of ``table``.

    Rows link if their labels are equal and not null, their vectors have equal length and
    their cosine is ``cosine`` or more. A vector that is null, empty, zero or holds a null or
    non-finite component links with nothing, nor does a row with a null label; such a row is its own
    component. ``n_links`` counts the other rows linked directly, repeated rows one by one.
    ``component_id`` is the smallest id reachable (null only if all of them are); ``kept`` is
    whether that is the row's own id. Other columns are ignored; an empty table gives no rows."""
    # adding 0.0 makes -0.0 and 0.0 one key
    plain = F.transform(F.col(vector).cast("array<double>"), lambda v: v + F.lit(0.0))
    fits = (F.size(plain) > 0) & F.forall(plain, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) \
        & F.exists(plain, lambda v: v != 0) & F.col(label).isNotNull()
    rows = table.select(F.col(id_col).alias("id"), F.col(label).alias("label"), plain.alias("vector"),
                        F.coalesce(fits, F.lit(False)).alias("fits"))
    copies = rows.where("fits").groupBy("label", "vector").agg(F.count("*").alias("copies"), F.min("id").alias("least"))
    reps = materialize(copies.withColumn("rep", F.monotonically_increasing_id()).withColumn("dim", F.size("vector")),
                       "vectors")
    parts = reps.groupBy("label", "dim").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    dealt = (reps.join(parts, ["label", "dim"])
             .withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select("label", "dim", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"),
                     (F.col("part") > F.col("other")).cast("int").alias("side"), "rep", "copies", "vector"))
    found = materialize(dealt.groupBy("label", "dim", "i", "j").applyInPandas(
        _group(cosine), "rep long, root long, n long"), "links")
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    known = (reps.join(counts, "rep", "left").join(roots, reps.rep == roots.node, "left")
             .select("label", "vector", "least", F.coalesce("root", "rep").alias("root"),
                     (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    named = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = join_back(known, named, "root").select("label", "vector", "n_links", "component_id")
    linked = rows.where("fits").join(known, ["label", "vector"]).select("id", "n_links", "component_id")
    alone = rows.where("not fits").select("id", F.lit(0).cast("long").alias("n_links"),
                                          F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
