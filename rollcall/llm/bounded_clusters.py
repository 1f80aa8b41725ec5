"""Exact k-means on whole-number vectors with heap-ordered bounds.

The nearest centroid of a vector can't change while the gap between the upper bound of its
distance to its own centroid and the lower bound of that to all others is open. Centroids
move, so in every round the gap of each vector of a cluster shrinks by at most the same
amount: how far the cluster's own centroid went plus the farthest that any other went. The
amounts a cluster has gathered are its drift, and a vector whose exact gap was g when the
drift was d stays where it is until the drift passes g + d. Each cluster of a block of vectors
keeps these sums in a heap; a round pops those that have expired, scans only them exactly
against all centroids, and pushes them onto the heap of the cluster they now belong to.

Vectors are written once, in blocks of a fixed number of rows, bucketed by block. The heaps are
a second table, a few bytes a vector, written anew in each round, so a lost executor costs its
tasks only. The driver holds the centroids (k times the dimension), nothing that grows.

Everything that decides is exact: components, distances and sums are whole numbers, and bounds
are rounded towards expiry, so a vector that isn't scanned has one nearest centroid for certain.
"""

from __future__ import annotations

import hashlib
import heapq
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.shared import materialised

BLOCK_ROWS = 8192
# Whole numbers of this size keep a squared distance of 64 components within 63 bits.
LARGEST = (1 << 27) - 1
# Relative error allowed for in bounds, far above that of a few operations in double precision.
SLACK = 1e-9
STATE = "block long, cluster binary, place binary, key binary, scanned long"


def whole_vectors(vectors: DataFrame, column: str, components: int, scale: float) -> DataFrame:
    """Rows whose vector has the given number of components, all of them finite, with ``x``: floor(scale * component).

    Rows with a null, a wrong length, a null or non-finite component go; so do those with a
    component beyond 2^27 once scaled, whose squared distances would not fit 64 bits.
    """
    v = F.col(column)
    value = lambda e: F.floor(e.cast("double") * F.lit(scale))
    sound = F.forall(v, lambda e: F.coalesce(F.abs(e.cast("double") * scale) < float(LARGEST), F.lit(False)))
    kept = vectors.where(v.isNotNull() & (F.size(v) == components)).where(sound)
    return kept.withColumn("x", F.transform(v, value))


def first_centroids(kept: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The ``k`` vectors with the smallest SHA-256 of salt and id, in that order; ties by components, null ids last."""
    digest = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    rows = kept.select(digest.alias("digest"), "x").orderBy(F.asc_nulls_last("digest"), "x").limit(k).collect()
    return [list(r["x"]) for r in rows]


def blocks(kept: DataFrame, components: int) -> DataFrame:
    """block, ids and vectors (rows of 32-bit numbers) in a table bucketed by block."""

    def pack(batches):
        ids, parts, held, made = [], [], 0, 0

        def block():
            nonlocal made
            made += 1
            number = TaskContext.get().partitionId() << 32 | made
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([sum(ids, [])], pa.list_(pa.int64())),
                 pa.array([np.concatenate(parts).tobytes()], pa.binary())], ["block", "ids", "vectors"])

        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(-1, components)
            for at in range(0, len(x), BLOCK_ROWS):
                part = x[at:at + BLOCK_ROWS]
                if held + len(part) > BLOCK_ROWS:
                    yield block()
                    ids, parts, held = [], [], 0
                ids.append(batch.column(0).slice(at, len(part)).to_pylist())
                parts.append(part)
                held += len(part)
        if held:
            yield block()

    spark = kept.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"vectors_{uuid.uuid4().hex}"
    packed = kept.select(F.col("vec_id").cast("long"), "x").mapInArrow(pack, "block long, ids array<long>, vectors binary")
    packed.repartition(n, "block").write.bucketBy(n, "block").format("parquet").saveAsTable(name)
    return spark.table(name)


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all centroids; by floating point where that is exact."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) < 1 << 22 and x.shape[1] <= 64:
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)
    a, c = x.astype(np.int64), centroids.astype(np.int64)
    return np.stack([((a - row) ** 2).sum(1) for row in c], axis=1)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the nearest centroid (ties: the smaller number) and a safe lower bound of its gap."""
    d = squared_distances(x, centroids)
    own = d.argmin(1)
    if d.shape[1] == 1:
        return own, np.full(len(x), np.inf)
    rows = np.arange(len(x))
    near = np.sqrt(d[rows, own].astype(np.float64))
    d[rows, own] = np.iinfo(np.int64).max
    other = np.sqrt(d.min(1).astype(np.float64))
    return own, other * (1 - SLACK) - near * (1 + SLACK)


class Heaps:
    """The vectors of one block by cluster, those whose gap closes first on top."""

    def __init__(self, k: int):
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(k)]

    @staticmethod
    def read(k: int, cluster: bytes, place: bytes, key: bytes) -> Heaps:
        """From arrays that hold the heaps one after the other, each in heap order."""
        out = Heaps(k)
        clusters, entries = np.frombuffer(cluster, np.int32), zip(
            np.frombuffer(key, np.float64).tolist(), np.frombuffer(place, np.int32).tolist())
        for c, n in enumerate(np.bincount(clusters, minlength=k).tolist()):
            out.heaps[c] = [next(entries) for _ in range(n)]
        return out

    def arrays(self) -> tuple[bytes, bytes, bytes]:
        sizes = [len(h) for h in self.heaps]
        flat = [e for h in self.heaps for e in h]
        return (np.repeat(np.arange(len(sizes), dtype=np.int32), sizes).tobytes(),
                np.array([p for _, p in flat], np.int32).tobytes(), np.array([g for g, _ in flat], np.float64).tobytes())

    def expired(self, drift: list[float]) -> list[tuple[int, int]]:
        """Takes off every (place, cluster) whose gap may have closed."""
        out = []
        for c, heap in enumerate(self.heaps):
            while heap and heap[0][0] <= drift[c]:
                out.append((heapq.heappop(heap)[1], c))
        return out

    def push(self, place: int, cluster: int, key: float) -> None:
        heapq.heappush(self.heaps[cluster], (key, place))


def _round(batches, centroids: np.ndarray, drift: list[float], first: bool):
    """One round over blocks: state and what moved, as rows of ``block, cluster, ..``."""
    k = len(centroids)
    for batch in batches:
        for i in range(batch.num_rows):
            block, vectors = batch.column("block")[i].as_py(), batch.column("vectors")[i].as_buffer()
            x = np.frombuffer(vectors, np.int32).reshape(-1, centroids.shape[1])
            if first:
                heaps, popped = Heaps(k), [(p, -1) for p in range(len(x))]
            else:
                heaps = Heaps.read(k, *(batch.column(c)[i].as_buffer() for c in ("cluster", "place", "key")))
                popped = heaps.expired(drift)
            places, before = (np.array([p[j] for p in popped], np.int64) for j in (0, 1))
            chosen = x[places]
            now, gap = nearest(chosen, centroids) if len(places) else (places, places.astype(np.float64))
            for place, c, g in zip(places.tolist(), now.tolist(), gap.tolist()):
                heaps.push(place, c, g + drift[c])
            went = before != now
            sums, counts = np.zeros((k, x.shape[1]), np.int64), np.zeros(k, np.int64)
            np.add.at(sums, now[went], chosen[went])
            np.add.at(counts, now[went], 1)
            left = went & (before >= 0)
            np.subtract.at(sums, before[left], chosen[left])
            np.subtract.at(counts, before[left], 1)
            yield block, heaps, len(places), sums, counts


def _bounded_rounds(table: DataFrame, state: DataFrame | None, centroids: np.ndarray, drift: list[float]) -> DataFrame:
    """The heaps after a round, and per block the change of every cluster's sum and count, written out."""
    first = state is None

    def run(batches):
        for block, heaps, scanned, sums, counts in _round(batches, centroids, drift, first):
            cluster, place, key = heaps.arrays()
            change = np.concatenate([sums, counts[:, None]], axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), *(pa.array([b], pa.binary()) for b in (cluster, place, key)),
                 pa.array([scanned], pa.int64()), pa.array([change.tobytes()], pa.binary())],
                ["block", "cluster", "place", "key", "scanned", "change"])

    columns = ["block", "vectors"] if first else ["block", "vectors", "cluster", "place", "key"]
    rows = table if first else table.join(state.select("block", "cluster", "place", "key"), "block")
    return materialised(rows.select(*columns).mapInArrow(run, STATE + ", change binary"), "heaps")


def _change(state: DataFrame, k: int, d: int) -> tuple[np.ndarray, int]:
    """Sum over all blocks of the changes: a table of k times (d + 1) numbers, and how many vectors were scanned."""

    def add(batches):
        total = None
        for batch in batches:
            for raw in batch.column(0):
                part = np.frombuffer(raw.as_buffer(), np.int64).reshape(k, d + 1)
                total = part if total is None else total + part
        if total is not None:
            at = np.flatnonzero(total.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total.ravel()[at], pa.int64())], ["at", "value"])

    out = np.zeros(k * (d + 1), dtype=object)
    for r in state.select("change").mapInArrow(add, "at int, value long").groupBy("at").agg(
            F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():
        out[r["at"]] = int(r["value"])
    scanned = state.agg(F.sum("scanned")).first()[0] or 0
    return out.reshape(k, d + 1), int(scanned)


def clustered(vectors: DataFrame, k: int, rounds: int, salt: str, column: str = "embedding", components: int = 64,
              scale: float = 256.0, log: list | None = None) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of every kept vector.

    Starts from :func:`first_centroids` (all vectors where there are fewer than ``k``). A round
    assigns every vector to the nearest centroid and moves each centroid with vectors to the
    floor of their mean; after the last, vectors are assigned once more. Rows with one id, and
    equal vectors, are vectors of their own. No vectors give no rows. ``log`` gets the number
    of vectors scanned in each round.
    """
    spark = vectors.sparkSession
    kept = whole_vectors(vectors, column, components, scale)
    start = first_centroids(kept, k, salt)
    if not start:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids, k = np.array(start, np.int64), len(start)
    table, state, drift = blocks(kept, components), None, [0.0] * k
    totals = np.zeros((k, components + 1), dtype=object)
    for number in range(rounds + 1):
        state = _bounded_rounds(table, state, centroids, drift)
        change, scanned = _change(state, k, components)
        if log is not None:
            log.append(scanned)
        if number == rounds:
            break
        totals = totals + change
        moved = centroids.copy()
        for c in range(k):
            if totals[c, -1]:
                moved[c] = [int(s) // int(totals[c, -1]) for s in totals[c, :-1]]
        far = np.sqrt(((moved - centroids).astype(np.float64) ** 2).sum(1)) * (1 + SLACK)
        for c in range(k):
            others = np.delete(far, c)
            drift[c] = (drift[c] + float(far[c]) + float(others.max(initial=0.0))) * (1 + SLACK)
        centroids = moved
    return _result(table, state, centroids)


def _result(table: DataFrame, state: DataFrame, centroids: np.ndarray) -> DataFrame:
    k, d = centroids.shape

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, x = batch.column("ids")[i], np.frombuffer(batch.column("vectors")[i].as_buffer(), np.int32).reshape(-1, d)
                own = np.empty(len(x), np.int32)
                own[np.frombuffer(batch.column("place")[i].as_buffer(), np.int32)] = np.frombuffer(
                    batch.column("cluster")[i].as_buffer(), np.int32)
                apart = x.astype(np.int64) - centroids[own]
                yield pa.RecordBatch.from_arrays(
                    [ids.values, pa.array(own, pa.int32()), pa.array((apart * apart).sum(1), pa.int64())],
                    ["vec_id", "cluster", "distance"])

    rows = table.join(state.select("block", "cluster", "place"), "block").select("ids", "vectors", "cluster", "place")
    assigned = materialised(rows.mapInArrow(run, "vec_id long, cluster int, distance long"), "assigned")
    sums = {r["cluster"]: r["inertia"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    totals = table.sparkSession.createDataFrame(  # a row per cluster
        [(c, sums[c], sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
         for c in sorted(sums)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(totals), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
