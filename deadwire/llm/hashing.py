"""Approximate nearest neighbours: multi-index hashing of learned rotated binary codes.

Largest inner product becomes largest cosine by one more coordinate: with M the largest norm, a vector x is
placed at (x, sqrt(M^2 - |x|^2)), a query q at (q, 0). ``ROTATIONS`` orthogonal rotations, each learned by
alternating between codes and the rotation that fits them best (iterative quantization), turn a vector into
the signs of its rotated coordinates. A code is cut into 16-bit substrings and each substring is an index of its own.
Two codes that differ in r bits or fewer differ in few bits of some substring (pigeonhole): with r = m q + a, in
at most q bits of one of the first a + 1, or at most q - 1 of one of the others. Probing every substring index within
that many bits and checking what is found returns every code within r, and these are ranked by the
inner products of the vectors themselves.

The radius is calibrated, not guessed: for ``CALIBRATION`` queries the true nearest of *all* rows are found by
brute force, and the radius is the smallest that holds ``TARGET`` of them. A query with fewer than k within the
radius is searched again without one, so every query gets its k.

Spark: equal vectors collapse to one row with their k + 1 smallest ids (only those can be among anyone's nearest k).
The rows are dealt by hash into shards of about ``SHARD``, each with its own substring indexes, and every query
goes to every shard: rows once, queries once per shard, k + 1 finds a query and shard back. So memory is a shard,
whatever is hot; the work is queries times rows, cut by what the indexes prune. Without neighbours closer than
chance, as in independent random vectors, they prune little.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deadwire.llm.common import materialize

#: Rows that the rotations are learned from, queries that the radius is calibrated with (both bounds), rows of a shard.
SAMPLE, CALIBRATION, SHARD = 8192, 256, 8192
ROTATIONS, ROUNDS, TARGET, SEED = 2, 25, 0.98, 20240311
BITS = 16  # of a substring

_DISTANCE = np.bitwise_count(np.arange(1 << BITS, dtype=np.uint16))


@dataclass(frozen=True)
class Coder:
    """``planes``: [dim + 1, bits] with bits a multiple of 16; ``center``: [dim + 1]; ``norm``: largest norm."""
    planes: np.ndarray
    center: np.ndarray
    norm: float

    def codes(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """[n, m] 16-bit substrings of the vectors' codes."""
        scaled = vectors / self.norm
        if query:
            length = np.sqrt((scaled * scaled).sum(1, keepdims=True))
            scaled, more = scaled / length, np.zeros((len(scaled), 1))
        else:
            more = np.sqrt(np.maximum(0, 1 - (scaled * scaled).sum(1, keepdims=True)))
        signs = (np.hstack([scaled, more]) - self.center) @ self.planes > 0
        return np.packbits(signs, axis=1).view(np.uint16)

    @staticmethod
    def fit(sample: np.ndarray, norm: float) -> Coder:
        rng = np.random.default_rng(SEED)
        scaled = sample / norm
        lifted = np.hstack([scaled, np.sqrt(np.maximum(0, 1 - (scaled * scaled).sum(1, keepdims=True)))])
        center = lifted.mean(0)
        lifted = lifted - center
        values, axes = np.linalg.eigh(lifted.T @ lifted)
        axes = axes[:, values > values[-1] * 1e-6] if values[-1] > 0 else axes[:, -1:]
        flat = lifted @ axes
        planes = []
        for _ in range(ROTATIONS):
            turn, _ = np.linalg.qr(rng.standard_normal((axes.shape[1],) * 2))
            for _ in range(ROUNDS):
                u, _, v = np.linalg.svd(np.where(flat @ turn > 0, 1.0, -1.0).T @ flat)
                turn = (u @ v).T
            planes.append(axes @ turn)
        planes = np.hstack(planes)
        full = -(-planes.shape[1] // BITS) * BITS
        if full > planes.shape[1]:  # fill the last substring with random planes
            planes = np.hstack([planes, rng.standard_normal((len(planes), full - planes.shape[1]))])
        return Coder(planes, center, norm)


def distances(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Differing bits of every code and one."""
    return np.bitwise_count(codes ^ code).sum(axis=-1, dtype=np.int32)


class Shard:
    """Codes with one index per substring: the places that hold a value, value by value."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.index = codes, []
        for j in range(codes.shape[1]):
            values, of = np.unique(codes[:, j], return_inverse=True)
            order = np.argsort(of, kind="stable")
            self.index.append((values, of, order, np.searchsorted(of[order], np.arange(len(values) + 1))))

    def within(self, code: np.ndarray, radius: int | None) -> np.ndarray:
        """Places of every code that differs in ``radius`` bits or fewer (None: all)."""
        m = self.codes.shape[1]
        if radius is None or radius >= m * BITS:
            return np.arange(len(self.codes))
        q, a = divmod(radius, m)
        met = np.zeros(len(self.codes), bool)
        for j, (values, of, order, starts) in enumerate(self.index):
            near = _DISTANCE[values ^ code[j]] <= (q if j <= a else q - 1)
            hit = np.flatnonzero(near)
            if 8 * len(hit) > len(values):  # many buckets: one look per code is cheaper than the lists
                met |= near[of]
            elif len(hit):
                size = starts[hit + 1] - starts[hit]
                run = np.repeat(starts[hit] - np.cumsum(size) + size, size)
                met[order[run + np.arange(len(run))]] = True
        found = np.flatnonzero(met)
        return found[distances(self.codes[found], code) <= radius]


# -- Spark -----------------------------------------------------------------------------------------

def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _best(score: np.ndarray, least: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    if len(score) > 4 * k:
        some = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    else:
        some = np.arange(len(score))
    return some[np.lexsort((least[some], -score[some]))][:k]


def _answers(coder: Coder, radius: int | None, k: int):
    """(shard, side, h1, h2, ids, vector) by shard, its rows before the queries -> (q1, q2, id, score), k a query."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ids, shard = None, [], [], None
        vectors = least = None
        for batch in batches:
            numbers, sides = (batch.column(i).to_numpy() for i in (0, 1))
            cuts = np.flatnonzero(np.diff(numbers) | np.diff(sides)) + 1
            for at, end in zip([0, *cuts], [*cuts, len(numbers)]):
                part = batch.slice(at, end - at)
                if numbers[at] != now:
                    now, held, ids, shard = numbers[at], [], [], None
                if not sides[at]:
                    held.append(_matrix(part.column(5)))
                    ids += part.column(4).to_pylist()
                    continue
                if not held:  # no row fell into this shard
                    continue
                if shard is None:
                    vectors, least = np.vstack(held), np.array([x[0] for x in ids])
                    shard = Shard(coder.codes(vectors, False))
                asked = _matrix(part.column(5))
                out: list[tuple] = []
                for i, (code, q) in enumerate(zip(coder.codes(asked, True), asked)):
                    found = shard.within(code, radius)
                    score = (vectors[found] * q).sum(1)
                    best = _best(score, least[found], k)
                    rows = [(-score[b], x) for b in best.tolist() for x in ids[found[b]]]
                    out += [(i, x, -s) for s, x in sorted(rows)[:k]]
                if out:
                    who, named, scores = zip(*out)
                    who = pa.array(who)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(2).take(who), part.column(3).take(who), pa.array(named, pa.int64()),
                         pa.array(scores, pa.float64())], names=["q1", "q2", "id", "score"])

    return run


def _truth(coder: Coder, asked: np.ndarray, names: np.ndarray, k: int):
    """(h1, h2, vector) -> per task the k nearest of each query by brute force: (q, score, bits)."""
    codes = coder.codes(asked, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = np.full((len(asked), k), -np.inf)
        bits = np.zeros((len(asked), k), np.int32)
        for batch in batches:
            vectors = _matrix(batch.column(2))
            own = np.column_stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
            score = asked @ vectors.T
            score[(names[:, None, :] == own[None]).all(2)] = -np.inf
            near = np.argsort(-score, axis=1)[:, :k]
            far = np.stack([distances(c, q) for c, q in zip(coder.codes(vectors, False)[near], codes)])
            scores, bits = np.hstack([scores, np.take_along_axis(score, near, 1)]), np.hstack([bits, far])
            best = np.argsort(-scores, axis=1)[:, :k]
            scores, bits = np.take_along_axis(scores, best, 1), np.take_along_axis(bits, best, 1)
        q, at = np.nonzero(np.isfinite(scores))
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(scores[q, at]), pa.array(bits[q, at], pa.int32())],
                                         names=["q", "score", "bits"])

    return run


def _share(limit: int, of: int) -> Column:
    """True for about ``limit`` of ``of`` rows, by their hash."""
    return F.pmod("h2", F.lit(1 << 30)) < min(1 << 30, -(-(limit << 30) // max(1, of)))


def _calibrate(part: DataFrame, coder: Coder, asked: int, k: int, target: float) -> int:
    """Smallest radius that holds ``target`` of the true nearest of some queries, found by brute force over all rows."""
    some = part.where("asked").where(_share(CALIBRATION, asked)).select("h1", "h2", "vector").limit(2 * CALIBRATION).toArrow()
    some = some.sort_by([("h2", "ascending")]).slice(0, CALIBRATION).combine_chunks()
    bits = coder.planes.shape[1]
    if not len(some):
        return bits
    names = np.column_stack([some.column(i).to_numpy() for i in (0, 1)])
    found = part.select("h1", "h2", "vector").mapInArrow(
        _truth(coder, _matrix(some.column(2).chunk(0)), names, k), "q int, score double, bits int")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "bits"))
    held = found.withColumn("r", rank).where(F.col("r") <= k).groupBy("bits").count().collect()
    total, seen = sum(r["count"] for r in held), 0
    for r in sorted(held):
        seen += r["count"]
        if seen >= target * total:
            return r["bits"]
    return bits


def _search(part: DataFrame, asked: DataFrame, coder: Coder, radius: int | None, shards: int, k: int) -> DataFrame:
    rows = part.select(F.pmod("h1", F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("side"), "h1", "h2", "ids", "vector")
    sent = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("side"), "h1", "h2",
                        F.array().cast("array<long>").alias("ids"), "vector")
    dealt = rows.unionByName(sent).repartition(4 * shards, "shard").sortWithinPartitions("shard", "side")
    found = dealt.mapInArrow(_answers(coder, radius, k), "q1 long, q2 long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "id"))
    return materialize(found.withColumn("r", rank).where(F.col("r") <= k).drop("r"), "answers")


def nearest(table: DataFrame, asked: Column, id_col: str = "vec_id", vector: str = "embedding", k: int = 20,
            target: float = TARGET, shard_rows: int = SHARD) -> DataFrame:
    """(query_id, rank, id, score): for each row where ``asked`` holds, the k others of largest inner product found,
    nearest first, ties to the smaller id; all others if they are fewer than k.

    Approximate: about ``target`` of the true nearest are among them; the scores are exact (double precision on the vectors
    themselves). Vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do
    rows with a null id. Vectors are compared with those of equal length only (lengths should be few: each has rotations of
    its own). Rows that repeat id and vector are one; a row is never its own neighbour, nor is another of its id.
    Other columns are ignored; an empty table, or one without queries, gives no rows."""
    plain = F.transform(F.col(vector).cast("array<double>"), lambda v: v + F.lit(0.0))  # -0.0 and 0.0 are one key
    fits = (F.size(plain) > 0) & F.forall(plain, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) \
        & F.exists(plain, lambda v: v != 0) & F.col(id_col).isNotNull()
    rows = table.where(F.coalesce(fits, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"), plain.alias("vector"), F.coalesce(asked, F.lit(False)).alias("asked"))
    rows = materialize(rows.withColumns({"h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit(1), "vector")}), "vectors")
    key = ["h1", "h2"]
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("id"))
    least = (rows.select(*key, "id").distinct().withColumn("r", rank).where(F.col("r") <= k + 1)
             .groupBy(*key).agg(F.array_sort(F.collect_list("id")).alias("ids")))
    reps = rows.groupBy(*key).agg(F.any_value("vector").alias("vector"), F.bool_or("asked").alias("asked"))
    # the largest component is a column of its own: inside the sum it would be searched once per component
    big = reps.withColumn("big", F.array_max(F.transform("vector", F.abs)))
    norm = F.col("big") * F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, v: s + (v / F.col("big")) * (v / F.col("big"))))
    reps = materialize(big.join(least, key).withColumns({"dim": F.size("vector"), "norm": norm}).drop("big"),
                       "distinct-vectors")
    facts = reps.groupBy("dim").agg(F.count("*").alias("n"), F.max("norm").alias("norm"), F.count_if("asked").alias("asked"),
                                    F.sum(F.size("ids")).alias("named")).collect()
    found = [_of_length(reps.where(F.col("dim") == f["dim"]), f, k, target, shard_rows) for f in facts if f["asked"]]
    if not found:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, id long, score double")
    answers = found[0]
    for more in found[1:]:
        answers = answers.unionByName(more)
    queries = rows.where("asked").select(F.col("id").alias("query_id"), F.col("h1").alias("q1"), F.col("h2").alias("q2")).distinct()
    nearest_first = Window.partitionBy("query_id", "q1", "q2").orderBy(F.desc("score"), "id")
    return (queries.join(answers, ["q1", "q2"]).where("id <> query_id")
            .withColumn("rank", F.row_number().over(nearest_first)).where(F.col("rank") <= k)
            .select("query_id", "rank", "id", "score"))


def _of_length(part: DataFrame, facts, k: int, target: float, shard_rows: int) -> DataFrame:
    """(q1, q2, id, score): k + 1 answers per distinct query vector, itself among them, over vectors of one length."""
    sample = part.where(_share(SAMPLE, facts["n"])).select("vector").limit(2 * SAMPLE).toArrow().combine_chunks()
    if not len(sample):
        sample = part.select("vector").limit(SAMPLE).toArrow().combine_chunks()
    coder = Coder.fit(_matrix(sample.column(0).chunk(0)), facts["norm"])
    radius = _calibrate(part, coder, facts["asked"], k, target)
    shards = -(-facts["n"] // shard_rows)
    asked = part.where("asked").select("h1", "h2", "vector")
    first = _search(part, asked, coder, radius, shards, k + 1)
    counts = first.groupBy("q1", "q2").count()
    need = min(k + 1, facts["named"])
    short = materialize(asked.join(counts, (F.col("h1") == F.col("q1")) & (F.col("h2") == F.col("q2")), "left")
                        .where(F.coalesce("count", F.lit(0)) < need).select("h1", "h2", "vector"), "short-queries")
    if short.isEmpty():
        return first
    names = short.select(F.col("h1").alias("q1"), F.col("h2").alias("q2"))
    return first.join(names, ["q1", "q2"], "left_anti").unionByName(_search(part, short, coder, None, shards, k + 1))
