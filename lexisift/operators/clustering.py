"""Density clusters, k-means and latent vectors."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisift.operators import density as dn
from lexisift.operators import matrix as mx
from lexisift.operators import scoring as so
from lexisift.operators.stages import in_batches, staged

EPS, WIDE = dn.EPS, 0.75


def density_labels(z: DataFrame, eps: float = EPS, least: int = dn.MIN_POINTS) -> DataFrame:
    """(vec_id, cluster) of the density clusters, -1 for noise."""
    return dn.density(z, eps, least).select("vec_id", "cluster")


class KMeans(NamedTuple):
    """One start of k-means: from centroids that k-means|| draws by the seed, until none moves by more than ``MOVED`` or for ``maxIter`` rounds."""

    k: int
    seed: int
    maxIter: int


class Fits(NamedTuple):
    """A table and the centroids that were fitted to it, by their number."""

    z: DataFrame
    centroids: dict


MOVED, STEPS, TILE = 1e-4, 2, 4096


def _tiles(batches):
    for batch in batches:
        for a in range(0, batch.num_rows, TILE):
            part = batch.slice(a, TILE)
            yield part, dn.matrix(part.column("z"))


def _far(x, sets):
    """For each set of centroids half the squared distances of the rows, less the half of a row's own square."""
    both = np.concatenate(sets)
    far = 0.5 * (both * both).sum(1) - x @ both.T
    return np.split(far, np.cumsum([len(c) for c in sets])[:-1], 1)


def _sums(z: DataFrame, sets: list) -> list:
    """For each set of centroids: the sum of each one's nearest rows, their numbers, and the sum of all squared distances. One pass for all sets."""
    sent = z.sparkSession.sparkContext.broadcast(sets)
    edge = np.concatenate([[0], np.cumsum([len(c) for c in sets])])
    width = sets[0].shape[1]

    def run(batches):
        own = sent.value
        total = np.zeros((edge[-1], width + 2))
        for _, x in _tiles(batches):
            square, row = (x * x).sum(), np.arange(len(x))
            near = np.zeros((len(x), edge[-1]))
            for a, far in zip(edge[:-1], _far(x, own), strict=True):
                at = far.argmin(1)
                near[row, a + at] = 1
                total[a, -1] += 2 * far[row, at].sum() + square
            total[:, :-2] += near.T @ x
            total[:, -2] += near.sum(0)
        yield from mx.rows_of(np.arange(edge[-1]), total)

    try:
        total = mx.added(in_batches(z.select("z"), run, "i int, x binary"), int(edge[-1]), width + 2)
    finally:
        sent.unpersist()
    return [(t[:, :-2], t[:, -2], max(t[0, -1], 0.0)) for t in np.split(total, edge[1:-1])]


def _chance(key: np.ndarray, seed: int, step: int) -> np.ndarray:
    """A number from 0 to 1 for each key, another one for each seed and step."""
    with np.errstate(over="ignore"):
        x = key.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(1 + step + (seed << 8))
        for by, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(by))) * np.uint64(times)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53


def _drawn(z: DataFrame, starts: list, sets: list | None, cost: list, step: int) -> list:
    """For each start the rows that are drawn as centroids: without sets the one with the least chance, with them each by its share of the cost,
    about 2k of them. In one pass."""
    sent = z.sparkSession.sparkContext.broadcast(([(s.k, s.seed) for s in starts], sets, cost))

    def run(batches):
        each, own, whole = sent.value
        least: dict = {}
        for part, x in _tiles(batches):
            key = part.column("_key").to_numpy()
            square = (x * x).sum(1)
            fars = _far(x, own) if own else [None] * len(each)
            for j, ((k, seed), far) in enumerate(zip(each, fars, strict=True)):
                chance = _chance(key, seed, step)
                if far is None:
                    i = int(chance.argmin())
                    if j not in least or chance[i] < least[j][0]:
                        least[j] = chance[i], x[i].copy()
                elif whole[j] > 0:
                    apart = np.maximum(2 * far.min(1) + square, 0)
                    some = np.flatnonzero(chance < 2 * k * apart / whole[j])
                    yield from _told(j, chance[some], x[some])
        for j, (chance, x) in least.items():
            yield from _told(j, np.array([chance]), x[None])

    found = in_batches(z.select("_key", "z"), run, "start int, chance double, z array<double>").toArrow()  # a few rows for each centroid
    start, chance, x = found.column("start").to_numpy(), found.column("chance").to_numpy(), dn.matrix(found.column("z"))
    sent.unpersist()
    own = [np.flatnonzero(start == j) for j in range(len(starts))]
    return [x[at[np.argsort(chance[at], kind="stable")]][: None if sets else 1] for at in own]


def _told(j: int, chance, x):
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), j, np.int32)), pa.array(chance), lists], ["start", "chance", "z"])


def _few(x: np.ndarray, weight: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k of the candidates by k-means++, then k-means of them by their weights."""
    rng = np.random.default_rng(seed)
    c = x[[rng.choice(len(x), p=weight / weight.sum())]]
    while len(c) < k:
        share = weight * np.maximum(((x[:, None] - c[None]) ** 2).sum(2).min(1), 0)
        c = np.concatenate([c, x[[rng.choice(len(x), p=share / share.sum() if share.sum() > 0 else None)]]])
    for _ in range(30):
        at = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        own = (at[:, None] == np.arange(k)) * weight[:, None]
        new = np.where(own.sum(0)[:, None] > 0, own.T @ x / np.maximum(own.sum(0), 1e-300)[:, None], c)
        if (new == c).all():
            break
        c = new
    return c


def _begun(z: DataFrame, starts: list) -> list:
    """The first centroids of each start by k-means||, fewer than k where no more rows differ."""
    z = z.select(F.xxhash64("vec_id").alias("_key"), "z")
    sets = _drawn(z, starts, None, [], 0)
    for step in range(1, STEPS + 1):
        cost = [s[2] for s in _sums(z, sets)]
        sets = [np.concatenate([c, new]) if len(new) else c for c, new in zip(sets, _drawn(z, starts, sets, cost, step), strict=True)]
    sets = [np.unique(c, axis=0) for c in sets]
    return [c if len(c) <= s.k else _few(c, n, s.k, s.seed) for s, c, (_, n, _) in zip(starts, sets, _sums(z, sets), strict=True)]


def fitted(z: DataFrame, starts: list) -> list:
    """(centroids, cost) of each start; a pass over the rows is one round of all that still move. ``z`` should be a table."""
    sets = _begun(z, starts)
    cost, going, done = [0.0] * len(starts), list(range(len(starts))), 0
    while going:
        done += 1
        still = []
        for j, (total, n, now) in zip(going, _sums(z, [sets[j] for j in going]), strict=True):
            new = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], sets[j])
            moved = ((new - sets[j]) ** 2).sum(1).max()
            sets[j], cost[j] = new, now
            if moved > MOVED**2 and done < starts[j].maxIter:
                still.append(j)
        going = still
    return list(zip(sets, cost, strict=True))


def clustered(z: DataFrame, k: int = 8, tries: int = 10, rounds: int = 300) -> DataFrame:
    """(vec_id, cluster) of the best of several starts by cost."""
    z = staged(z.select("vec_id", "z"))
    if not z.take(1):
        return z.select("vec_id", F.lit(0).alias("cluster"))
    return assigned(z, min(fitted(z, [KMeans(k=k, seed=42 + i, maxIter=rounds) for i in range(tries)]), key=lambda f: f[1])[0])


def _searched(k: int) -> KMeans:
    return KMeans(k=k, seed=42, maxIter=100)


def silhouette(z: DataFrame | Fits, k: int) -> float:
    """The mean over all rows by cosine distance, -1 where the vectors make one cluster only. ``z`` should be a table, or its fits."""
    z, c = (z.z, z.centroids[k]) if isinstance(z, Fits) else (z, fitted(z, [_searched(k)])[0][0])
    total, n, _ = _sums(z, [c])[0]
    if (n > 0).sum() < 2:
        return -1.0
    sent = z.sparkSession.sparkContext.broadcast((c, total, n))

    def run(batches):
        c, total, n = sent.value
        out = np.zeros((1, 1))
        for _, x in _tiles(batches):
            own, row = _nearest(x, c)[0], np.arange(len(x))
            apart = np.where(n > 0, 1 - (x @ total.T) / np.maximum(n, 1), np.inf)  # the mean distance to each cluster's rows
            inside = apart[row, own] * n[own] / np.maximum(n[own] - 1, 1)  # without the row itself
            apart[row, own] = np.inf
            beside = apart.min(1)
            most = np.maximum(inside, beside)
            out += np.where((n[own] > 1) & (most > 0), (beside - inside) / np.where(most > 0, most, 1), 0).sum()
        yield from mx.rows_of(np.zeros(1, np.int64), out)

    try:
        return float(mx.added(in_batches(z.select("z"), run, "i int, x binary"), 1, 1)[0, 0] / n.sum())
    finally:
        sent.unpersist()


def select_k(z: DataFrame, most: int = 12) -> list[tuple[int, float]]:
    """Every number of clusters from 2 with its silhouette: the whole range that a swarm would search. The rows are written once for all fits,
    and a pass over them is one round of all fits."""
    z = staged(z.select("vec_id", "z"))
    n = z.count()
    ks = list(range(2, min(most, n - 1) + 1))
    fits = Fits(z, {k: f[0] for k, f in zip(ks, fitted(z, [_searched(k) for k in ks]), strict=True)} if ks else {})
    return [(k, float(silhouette(fits, k))) for k in ks]


def swarm_costs(z: DataFrame, particles):
    """For each particle, k centroids, the sum of all rows' cosine distances to the nearest of them; all particles in one pass."""
    c = particles / (np.linalg.norm(particles, axis=2, keepdims=True) + 1e-10)
    sent = z.sparkSession.sparkContext.broadcast(c)

    def run(batches):
        own = sent.value
        total = np.zeros(len(own))
        for batch in batches:
            x = dn.matrix(batch.column("z"))
            for a in range(0, len(x), 4096):
                near = (x[a : a + 4096] @ own.reshape(-1, own.shape[2]).T).reshape(-1, *own.shape[:2])
                total += (1 - near.max(2)).sum(0)
        yield from mx.rows_of(np.zeros(1, np.int64), total[None])

    try:
        return mx.added(in_batches(z.select("z"), run, "i int, x binary"), 1, len(c))[0]
    finally:
        sent.unpersist()


def swarm_centroids(z: DataFrame, k: int, swarm: int = 20, rounds: int = 15, seed: int = 42):
    """Centroids that a particle swarm moves to the least sum of distances over all rows: a job a round scores all particles.
    The driver holds the particles, swarm x k vectors each for their places, speeds and best places. ``z`` should be a table."""
    each = z.select(F.posexplode("z").alias("i", "x")).groupBy("i").agg(F.min("x").alias("low"), F.max("x").alias("high")).orderBy("i").collect()  # a row per dimension
    low, high = np.array([r["low"] for r in each]), np.array([r["high"] for r in each])
    high = np.where(high == low, low + 1e-6, high)
    rng = np.random.default_rng(seed)
    at = rng.uniform(low, high, (swarm, k, len(low)))
    speed = np.zeros_like(at)
    own, own_cost = at.copy(), swarm_costs(z, at)
    for _ in range(rounds):
        lead = own[own_cost.argmin()]
        speed = 0.5 * speed + 0.5 * rng.random(at.shape) * (own - at) + 0.5 * rng.random(at.shape) * (lead - at)
        at = np.clip(at + speed, low, high)
        now = swarm_costs(z, at)
        better = now < own_cost
        own[better], own_cost[better] = at[better], now[better]
    return own[own_cost.argmin()], float(own_cost.min())


def _nearest(x, c):
    """The nearest of the centroids for each row, of equally near ones the first, and half the squared distance less the row's."""
    far = 0.5 * (c * c).sum(1) - x @ c.T
    own = far.argmin(1)
    return own, far[np.arange(len(own)), own]


def assigned(z: DataFrame, c) -> DataFrame:
    """(vec_id, cluster): the nearest of the centroids, in one pass."""
    sent = z.sparkSession.sparkContext.broadcast(np.asarray(c, float))
    kind = z.schema["vec_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            own = _nearest(dn.matrix(batch.column("z")), sent.value)[0] if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(own.astype(np.int32))], ["vec_id", "cluster"])

    return in_batches(z.select("vec_id", "z"), run, f"vec_id {kind}, cluster int")


def started(z: DataFrame, c, rounds: int = 200) -> DataFrame:
    """(vec_id, cluster): k-means over all rows from the given centroids, one start. A centroid without rows stays. ``z`` should be a table."""
    c = np.asarray(c, float)
    for _ in range(rounds):
        total, n, _ = _sums(z, [c])[0]
        new = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        moved, c = ((new - c) ** 2).sum(1).max(), new
        if moved <= 1e-8:
            break
    return assigned(z, c)


def mini_batches(z: DataFrame, c, rounds: int = 200, size: int = 1024, seed: int = 42, patience: int = 20):
    """Centroids after k-means in batches from the given ones. A round draws its rows by a hash of vec_id, seed and round,
    about ``size`` of them or a 20th of all, whichever is more; each centroid moves toward its rows' mean by their share of
    all rows that it has had so far. It ends when the smoothed cost of the batches has not fallen for ``patience`` rounds. The state, a
    centroid and a count each, is kept between the rounds; rows of one seed give one result."""
    c, n = np.array(c, float), z.count()
    share = min(1.0, max(size / max(n, 1), 0.05))
    held, best, smooth, since = np.zeros(len(c)), np.inf, None, 0
    for t in range(rounds):
        drawn = z if share == 1.0 else z.where(F.pmod(F.xxhash64("vec_id", F.lit(seed), F.lit(t)), F.lit(1 << 20)) < int(share * (1 << 20)))
        total, count, cost = _sums(drawn, [c])[0]
        if not count.any():
            continue
        cost /= count.sum()  # before the move
        held += count
        c += (total - count[:, None] * c) / np.maximum(held, 1)[:, None]
        smooth = cost if smooth is None else smooth + (cost - smooth) * min(1.0, 2 * count.sum() / (n + 1))
        best, since = (smooth, 0) if smooth < best - 1e-12 else (best, since + 1)
        if since >= patience:
            break
    return c


def noise(z: DataFrame, labels: DataFrame) -> DataFrame:
    return z.join(labels.where("cluster < 0").select("vec_id"), "vec_id", "left_semi")


def best_k(scores: list[tuple[int, float]]) -> int:
    """The least number of clusters with the largest silhouette."""
    return max(scores, key=lambda x: (x[1], -x[0]))[0]


def noise_swarm(z: DataFrame):
    """Centroids that the swarm finds for the noise, at length 1 and with the chosen number of clusters, and their cost."""
    c, cost = swarm_centroids(z, best_k(select_k(z)))
    return c / (np.linalg.norm(c, axis=1, keepdims=True) + 1e-10), cost


def main_labels(z: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(vec_id, cluster) of the main model: density clusters, then k-means of the noise in batches from the swarm's centroids,
    numbered after them. Under three points of noise are one cluster. ``labels``: a table of the density clusters, where there is one."""
    labels = staged(density_labels(z)) if labels is None else labels
    rest = staged(noise(z, labels))
    n = rest.count()
    if not n:
        return labels
    first = labels.agg(F.max("cluster")).first()[0] + 1
    own = assigned(rest, mini_batches(rest, noise_swarm(rest)[0])) if n >= 3 else rest.select("vec_id", F.lit(0).alias("cluster"))
    return labels.where("cluster >= 0").unionByName(own.select("vec_id", (F.col("cluster") + first).alias("cluster")))


def own_distance(z: DataFrame, labels: DataFrame) -> DataFrame:
    """(vec_id, cluster, distance): to the own cluster's centroid; noise to the nearest, 0 where there is no cluster."""
    own = z.select("vec_id", "z").join(labels, "vec_id").withColumnRenamed("cluster", "label")
    cents = so.centroids(own)
    near = so.nearest(own, cents)
    at = near.join(F.broadcast(cents.withColumnRenamed("cluster", "_k")), F.col("label") == F.col("_k"), "left")
    own_d = F.lit(1.0) - so.dot(F.col("z"), F.col("c"))
    return at.select("vec_id", F.col("label").alias("cluster"), F.coalesce(F.when(F.col("label") >= 0, own_d), F.col("distance"), F.lit(0.0)).alias("distance"))
