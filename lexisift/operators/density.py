"""Neighbours of unit vectors, and density clusters over cells, so that dense groups list no pairs.

Two vectors are neighbours within a cosine distance eps, which is a chord of r = sqrt(2 eps). Equal vectors become one row with a
weight. A cell holds what lies within r / 2 of a centre, so all its members are neighbours: with ``least`` vectors or more they are
cores at once and of one cluster, without a comparison. Centres are drawn from what no dense cell holds yet, in a few rounds,
as long as they find anything. Of what is left over, the loose vectors, blocks tell the numbers of neighbours, then as few pairs of cores
as keep them linked, then the least component beside each border vector: pairs are not listed.

A loose vector counts its neighbours in each dense cell within reach, one row for each cell and block, whatever the cell holds. Two
dense cells whose centres are neighbours are linked by these; of other cells within reach the members near the other
one are compared in blocks, until one pair is found. Clusters are the components of loose cores and dense cells.

Vectors meet in blocks, as products of matrices. A side has ``PARTS`` blocks at most, so that a vector is sent a bounded number of times
whatever the number of rows, until a block would hold more than ``HELD`` numbers; within a block a task multiplies ``TILE`` rows at a
time. Where pivots leave little out, vectors are dealt out by hash and each pair of parts meets once. Cells and their links are bounded by
parameters, and are all that is broadcast. A vector of zeros has no neighbours and is noise. vec_id is a key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisift.operators import scoring as so
from lexisift.operators.stages import in_batches, ship_package, staged

EPS, MIN_POINTS = 0.1, 10
PIVOTS, CENTRES, ROUNDS, BLOCK = 64, 128, 4, 512
PARTS, HELD, TILE = 12, 1 << 23, 1024


def matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def close(x: np.ndarray, y: np.ndarray, eps: float) -> np.ndarray:
    far = 1 - x @ y.T
    near = far <= eps + 1e-8
    at = np.nonzero(near & (far > eps - 1e-8))  # only these hang on the rounding
    near[at] = np.round(far[at], 9) <= eps
    return near


def tiles(left, right, eps: float):
    """(a, b, near): from which row of each side a tile starts, and who are neighbours in it."""
    if not len(left) or not len(right):
        return
    x, y = matrix(left.column("z")), matrix(right.column("z"))
    for a in range(0, len(x), TILE):
        for b in range(0, len(y), TILE):
            yield a, b, close(x[a : a + TILE], y[b : b + TILE], eps)


def listed(left, right, eps: float, both: bool):
    """Tables (a, b) of the neighbours, tile by tile; with ``both`` in both orders."""
    x, y = left.column("id").combine_chunks(), right.column("id").combine_chunks()
    for a, b, near in tiles(left, right, eps):
        i, j = np.nonzero(near)
        one, two = x.take(pa.array(i + a)), y.take(pa.array(j + b))
        yield pa.table({"a": one, "b": two})
        if both:
            yield pa.table({"a": two, "b": one})


def weighed(left, right, eps: float, both: bool):
    """Tables (id, n): the weight, ``w`` or one a row, of the neighbours of each row that has any."""
    weight = lambda t: t.column("w").to_numpy() if "w" in t.column_names else np.ones(len(t), np.int64)
    x, y = weight(left), weight(right)
    n, m = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)
    for a, b, near in tiles(left, right, eps):
        i, j = np.nonzero(near)
        n[a : a + TILE] += np.bincount(i, y[b + j], near.shape[0]).astype(np.int64)
        if both:
            m[b : b + TILE] += np.bincount(j, x[a + i], near.shape[1]).astype(np.int64)
    for t, k in ((left, n), (right, m)):
        yield pa.table({"id": t.column("id"), "n": k}).filter(pa.array(k > 0))


def forest(left, right, eps: float, both: bool):
    """Tables (a, b), in both orders, of as few pairs of neighbours as keep all rows linked that pairs of these blocks link."""
    n = len(left)
    up = list(range(n + len(right)))
    if left is right:
        up[n:] = range(n)
    ids = pa.concat_arrays([left.column("id").combine_chunks(), right.column("id").combine_chunks()])
    own = np.array(up)
    edges: list = []

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b, near in tiles(left, right, eps):
        while True:  # each round every row with links to another tree takes one of them
            near &= own[a : a + near.shape[0], None] != own[None, n + b : n + b + near.shape[1]]
            some = np.flatnonzero(near.any(1))
            if not len(some):
                break
            for i, j in zip((some + a).tolist(), (near[some].argmax(1) + n + b).tolist(), strict=True):
                x, y = find(i), find(j)
                if x != y:
                    up[x] = y
                    edges.append((i, j))
            own = np.array(up)
            while (own[own] != own).any():
                own = own[own]
    i, j = np.array(edges, np.int64).reshape(-1, 2).T
    yield pa.table({"a": ids.take(pa.array(np.concatenate([i, j]))), "b": ids.take(pa.array(np.concatenate([j, i])))})


def least_beside(left, right, eps: float, both: bool):
    """Tables (id, low): for each left row the least ``low`` of its neighbours on the right, where it has any."""
    names, code = np.unique(right.column("low").to_numpy(), return_inverse=True) if len(right) else (np.zeros(0), np.zeros(0, int))
    low = np.full(len(left), len(names))
    for a, b, near in tiles(left, right, eps):
        own = np.where(near, code[None, b : b + TILE], len(names)).min(1)
        low[a : a + TILE] = np.minimum(low[a : a + TILE], own)
    some = np.flatnonzero(low < len(names))
    yield pa.table({"id": left.column("id").take(pa.array(some)), "low": pa.array(names[low[some]]).cast(right.schema.field("low").type)})


def block_rows(rows: int, width: int) -> int:
    """Rows of a block: a ``PARTS``-th of all, but not under ``BLOCK`` and no more than ``HELD`` numbers."""
    return max(BLOCK, min(-(-rows // PARTS), HELD // max(width, 1)))


def chords(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * x @ y.T, 0))


def drawn(rows: DataFrame, most: int, key: str, salt: int = 0) -> np.ndarray:
    """At most ``most`` vectors, those with the least hashes; of equal ones one."""
    own = rows.orderBy(F.xxhash64(F.col(key), F.lit(salt)), key).limit(most).select("z").collect()
    return np.array(list(dict.fromkeys(tuple(r["z"]) for r in own)))


def met(left: DataFrame, right: DataFrame, kernel, schema: str) -> DataFrame:
    """kernel(left block, right block, False) for all blocks of left and right rows of one cell. Both are tables with cell, id and z, and there
    are few cells."""
    ship_package(left.sparkSession)
    count = lambda df, n: df.groupBy("cell").agg(F.count(F.lit(1)).alias(n))
    sizes = staged(count(left, "_nl").join(count(right, "_nr"), "cell").withColumnRenamed("cell", "_c"))
    total = sizes.agg(F.sum("_nl"), F.sum("_nr")).first()
    one = left.select(F.size("z")).first()
    rows = [block_rows(n or 0, one[0] if one else 1) for n in total]
    sizes = F.broadcast(sizes.select("_c", *[F.ceil(F.col(n) / k).cast("int").alias(n) for n, k in zip(("_nl", "_nr"), rows, strict=True)]))
    lot = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sides = []
    for df, own, other in ((left, "_nl", "_nr"), (right, "_nr", "_nl")):
        df = df.join(sizes, F.col("cell") == F.col("_c")).withColumn("_own", lot(own)).withColumn("_other", each(other))
        l, r = ("_own", "_other") if own == "_nl" else ("_other", "_own")
        df = df.withColumnsRenamed({l: "_l", r: "_r"}).withColumn("_right", F.lit(own == "_nr")).drop("_nl", "_nr", "_c")
        sides.append(df.select(*[F.col(c).alias(c) for c in df.columns]))  # columns of its own, as both may be of one table
    return _in_groups(sides[0].unionByName(sides[1], allowMissingColumns=True), ("cell", "_l", "_r"), kernel, schema, False)


def paired(rows: DataFrame, n: int, width: int, kernel, schema: str) -> DataFrame:
    """kernel for all pairs of the n rows: they are dealt out by hash, and two parts meet in one group, for both orders."""
    parts = -(-n // block_rows(n, width))
    own, other = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    sent = rows.withColumn("_own", own).withColumn("_other", other)
    sent = sent.select(*rows.columns, F.least("_own", "_other").alias("_l"), F.greatest("_own", "_other").alias("_r"), (F.col("_own") > F.col("_other")).alias("_right"))
    return _in_groups(sent, ("_l", "_r"), kernel, schema, True)


def _in_groups(sent: DataFrame, keys: tuple, kernel, schema: str, both: bool) -> DataFrame:
    """kernel(left rows, right rows, both) of each group, its tables batch by batch. With ``both`` a group of one part has it on both sides."""
    ship_package(sent.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(list(batches))
        left, right = group.filter(pc.invert(group.column("_right"))), group.filter(group.column("_right"))
        alone = both and group.column("_l")[0] == group.column("_r")[0]
        del group
        for t in kernel(left, left if alone else right, both and not alone):
            yield from t.to_batches(1 << 16)

    return sent.groupBy(*keys).applyInArrow(run, schema)


def reached(rows: DataFrame, centres: np.ndarray, reach: float, keep: tuple = ("id", "z")) -> DataFrame:
    """Rows with ``own``, their nearest centre, and ``cells``, all centres from which they could be reached: those no farther
    away than ``reach`` beyond the plane halfway to the own one."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast((centres, chords(centres, centres)))

    def run(batches):
        c, apart = sent.value
        for batch in batches:
            half = -(matrix(batch.column("z")) @ c.T)  # squared chords less 2, by halves
            own = half.argmin(1)
            beyond = half - half[np.arange(len(own)), own][:, None] <= reach * apart[own] + 1e-9
            row, cell = np.nonzero(beyond)
            edge = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(own)))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(edge), pa.array(cell.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array(own.astype(np.int32)), lists], [*keep, "own", "cells"])

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keep)
    return in_batches(rows.select(*keep), run, f"{kinds}, own int, cells array<int>")


def _by_cells(rows: DataFrame, eps: float, keep: tuple, kernel, schema: str, sides: tuple | None = None) -> DataFrame:
    """Two vectors are at least as far apart as one of them is from the plane halfway between their pivots, so a vector
    meets the vectors of its own cell and of those whose plane is within reach: no pair is lost. Where the planes
    leave it more than ``PARTS`` cells, pairs of parts are cheaper. ``sides``: conditions of the left and of the right rows."""
    n = rows.count()
    centres = drawn(rows, max(1, min(PIVOTS, math.isqrt(n) // 2)), "id")
    left, right = sides or (F.lit(True), F.lit(True))
    both = reached(rows, centres, math.sqrt(2 * eps) + 1e-9, keep)
    if both.agg(F.avg(F.size("cells"))).first()[0] > min(PARTS, len(centres) / 4):
        if not sides:
            return paired(rows.select(*keep), n, centres.shape[1], kernel, schema)
        whole = rows.select(F.lit(0).alias("cell"), *keep)
        return met(whole.where(left), whole.where(right), kernel, schema)
    both = staged(both)
    own = both.where(left).select(F.col("own").alias("cell"), *keep)
    return met(own, both.where(right).select(F.explode("cells").alias("cell"), *keep), kernel, schema)


def neighbours(z: DataFrame, eps: float = EPS) -> DataFrame:
    """(a, b): unit vectors within a cosine distance of eps, each with itself. Lists all pairs, as many as there are."""
    rows = staged(z.select(F.col("vec_id").alias("id"), "z"))
    kind = rows.schema["id"].dataType.simpleString()
    if not rows.take(1):
        return rows.select(F.col("id").alias("a"), F.col("id").alias("b"))
    return _by_cells(rows, eps, ("id", "z"), lambda a, b, both: listed(a, b, eps, both), f"a {kind}, b {kind}")


def counts(z: DataFrame, eps: float = EPS, least: int = MIN_POINTS) -> DataFrame:
    """(vec_id, n, is_core) of the vectors with neighbours: blocks send counts, not pairs."""
    rows = staged(z.select(F.col("vec_id").alias("id"), "z"))
    kind = rows.schema["id"].dataType.simpleString()
    if not rows.take(1):
        return rows.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n"), F.lit(False).alias("is_core"))
    own = _by_cells(rows, eps, ("id", "z"), lambda a, b, both: weighed(a, b, eps, both), f"id {kind}, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return own.select(F.col("id").alias("vec_id"), "n", (F.col("n") >= least).alias("is_core"))


def dense_cells(classes: DataFrame, eps: float, least: int) -> tuple[DataFrame, dict]:
    """classes: id, w, z. They with their dense cell, -1 for the loose ones; and cell -> (centre, least id)."""
    spark, found, parts = classes.sparkSession, {}, []
    rest = classes.withColumn("cell", F.lit(-1))
    near = eps / 4 - 1e-9  # a chord of r / 2
    for t in range(ROUNDS if near > 0 else 0):
        n = rest.count()
        if not n:
            break
        centres = drawn(rest, max(1, min(CENTRES, math.isqrt(n))), "id", t)
        sent = spark.sparkContext.broadcast(centres)

        def run(batches, sent=sent, t=t):
            for batch in batches:
                far = 1 - matrix(batch.column("z")) @ sent.value.T
                own = far.argmin(1)
                cell = np.where(far[np.arange(len(own)), own] <= near, t * CENTRES + own, -1)
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in ("id", "w", "z")], pa.array(cell.astype(np.int32))], ["id", "w", "z", "cell"])

        kinds = ", ".join(f"{k} {classes.schema[k].dataType.simpleString()}" for k in ("id", "w", "z"))
        now = staged(in_batches(rest.select("id", "w", "z"), run, f"{kinds}, cell int"))
        sums = now.where("cell >= 0").groupBy("cell").agg(F.sum("w").alias("w"), F.min("id").alias("low"), F.count(F.lit(1)).alias("n"))
        good = [r for r in sums.collect() if r["w"] >= least]  # a row per centre
        found |= {r["cell"]: (centres[r["cell"] - t * CENTRES], r["low"]) for r in good}
        inside = F.col("cell").isin([r["cell"] for r in good]) if good else F.lit(False)
        parts.append(now.where(inside))
        rest = now.where(~inside).withColumn("cell", F.lit(-1))
        if 50 * sum(r["n"] for r in good) < n:
            break
    for part in parts:
        rest = rest.unionByName(part)
    return rest, found


def _beside(loose: DataFrame, dense: DataFrame, found: dict, eps: float, kind: str) -> DataFrame:
    """(id, cell, n): for each loose vector how many vectors of each dense cell are its neighbours, where any is."""
    reach, names = 1.5 * math.sqrt(2 * eps) + 1e-6, sorted(found)
    sent = loose.sparkSession.sparkContext.broadcast((np.array([found[k][0] for k in names]), np.array(names, np.int32)))

    def near(batches):
        centres, cell = sent.value
        for batch in batches:
            row, at = np.nonzero(chords(matrix(batch.column("z")), centres) <= reach)
            yield pa.RecordBatch.from_arrays([pa.array(cell[at]), *[batch.column(k).take(pa.array(row)) for k in ("id", "z")]], ["cell", "id", "z"])

    dims = loose.schema["z"].dataType.simpleString()
    left = staged(in_batches(loose.select("id", "z"), near, f"cell int, id {kind}, z {dims}"))

    def run(left, right, _):
        for t in weighed(left, right, eps, False):
            yield pa.table({"id": t.column("id"), "cell": left.column("cell").slice(0, 1).take(pa.array(np.zeros(len(t), np.int64))) if len(t) else pa.array([], pa.int32()), "n": t.column("n")})

    return met(left, dense.select("cell", "id", "w", "z"), run, f"id {kind}, cell int, n long").groupBy("id", "cell").agg(F.sum("n").alias("n"))


def _linked(dense: DataFrame, found: dict, eps: float, kind: str) -> list[tuple[int, int]]:
    """Pairs of dense cells with neighbours across; of cells that are linked by way of others not all pairs are told."""
    names = sorted(found)
    c = np.array([found[k][0] for k in names])
    links = [(names[i], names[j]) for i, j in zip(*np.nonzero(np.triu(close(c, c, eps), 1)), strict=True)]
    up = {k: k for k in names}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[find(a)] = find(b)
    r = math.sqrt(2 * eps)
    maybe = [(i, j) for i, j in zip(*np.nonzero(np.triu(chords(c, c) <= 2 * r + 1e-6, 1)), strict=True) if find(names[i]) != find(names[j])]
    if not maybe:
        return links
    beside: dict[int, list] = {}
    for i, j in maybe:
        beside.setdefault(names[i], []).append((j, i * len(names) + j, 0))
        beside.setdefault(names[j], []).append((i, i * len(names) + j, 1))
    sent = dense.sparkSession.sparkContext.broadcast((c, beside))

    def near(batches):
        centres, to = sent.value
        for batch in batches:
            x, cell = matrix(batch.column("z")), batch.column("cell").to_numpy()
            for own in np.unique(cell):
                at = np.flatnonzero(cell == own)
                for other, pair, side in to.get(int(own), ()):
                    some = at[chords(x[at], centres[other : other + 1])[:, 0] <= 1.5 * r + 1e-6]
                    if len(some):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), pair)), pa.array(np.full(len(some), side)), *[batch.column(k).take(pa.array(some)) for k in ("id", "z")]], ["cell", "side", "id", "z"])

    dims = dense.schema["z"].dataType.simpleString()
    both = staged(in_batches(dense.select("cell", "id", "z"), near, f"cell long, side long, id {kind}, z {dims}"))

    def run(left, right, _):
        if any(near.any() for _, _, near in tiles(left, right, eps)):
            yield pa.table({"cell": left.column("cell").slice(0, 1)})

    pairs = met(both.where("side = 0"), both.where("side = 1"), run, "cell long").distinct().collect()  # at most a row per pair of cells
    return links + [(names[p["cell"] // len(names)], names[p["cell"] % len(names)]) for p in pairs]


def _components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, low): the least node of each one's component; edges (a, b) go both ways, and each node has one to itself."""
    labels = nodes.select("node", F.col("node").alias("low"))
    while True:  # least labels pass along edges, then along labels, so that the rounds are few
        seen = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("low").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("low").alias("far"))
        moved = staged(seen.join(jump, "low").select(F.col("a").alias("node"), F.least("low", "far").alias("low")))
        if not moved.join(labels.withColumnRenamed("low", "was"), "node").where("low <> was").limit(1).count():
            return labels
        labels = moved


def density(z: DataFrame, eps: float = EPS, least: int = MIN_POINTS) -> DataFrame:
    """(vec_id, cluster, is_core): cores by components, border vectors in the least component beside them, the rest -1.
    Clusters are numbered from 0 by their least core's vec_id."""
    spark = z.sparkSession
    rows = staged(z.select("vec_id", "z", (so.dot(F.col("z"), F.col("z")) > 0.5).alias("solid")))
    some = rows.where("solid").select("vec_id", "z")
    classes = staged(some.groupBy("z").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("w")))
    kind = classes.schema["id"].dataType.simpleString()
    cells, found = dense_cells(classes, eps, least)
    cells = staged(cells)
    loose, dense = cells.where("cell < 0"), cells.where("cell >= 0")

    schema = f"a {kind}, b {kind}"
    empty = lambda s: spark.createDataFrame([], s)
    beside = staged(_beside(loose, dense, found, eps, kind)) if found else empty(f"id {kind}, cell int, n long")
    some_loose = bool(loose.take(1))
    thin = _by_cells(loose, eps, ("id", "w", "z"), lambda a, b, both: weighed(a, b, eps, both), f"id {kind}, n long") if some_loose else empty(f"id {kind}, n long")
    tall = thin.unionByName(beside.select("id", "n")).groupBy("id").agg(F.sum("n").alias("n"))
    core = staged(tall.where(F.col("n") >= least).select("id"))

    node = spark.createDataFrame([(k, low) for k, (_, low) in found.items()], f"cell int, node {kind}")  # a row per dense cell
    by_cell = beside.join(F.broadcast(node), "cell").select("id", "node")
    cores = staged(loose.join(core, "id", "left_semi").select("id", "z"))
    inner = _by_cells(cores, eps, ("id", "z"), lambda a, b, both: forest(a, b, eps, both), schema) if cores.take(1) else empty(schema)
    own = by_cell.join(core, "id", "left_semi")
    low = {k: v for k, (_, v) in found.items()}
    links = spark.createDataFrame([(low[a], low[b]) for a, b in _linked(dense, found, eps, kind)] if found else [], f"a {kind}, b {kind}")
    nodes = core.select(F.col("id").alias("node")).unionByName(node.select("node"))
    edges = inner.unionByName(own.select(F.col("id").alias("a"), F.col("node").alias("b"))).unionByName(own.select(F.col("node").alias("a"), F.col("id").alias("b")))
    edges = edges.unionByName(links).unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(nodes.select(F.col("node").alias("a"), F.col("node").alias("b")))
    labels = _components(staged(edges), nodes)

    lows = labels.select("node", "low")
    told = staged(loose.select("id", "z").join(lows.withColumnRenamed("node", "id"), "id", "left").select("id", "z", "low"))
    no_core = F.col("low").isNull()
    near = empty(f"id {kind}, low {kind}")
    if told.where(no_core).take(1) and told.where(~no_core).take(1):
        near = _by_cells(told, eps, ("id", "z", "low"), lambda a, b, both: least_beside(a, b, eps, both), f"id {kind}, low {kind}", (no_core, ~no_core))
    reached_ = near.unionByName(by_cell.join(lows, "node").select("id", "low"))
    reached_ = reached_.groupBy("id").agg(F.min("low").alias("beside"))
    by_class = told.join(reached_, "id", "left")
    by_class = by_class.select("z", F.coalesce("low", "beside").alias("low"), F.col("low").isNotNull().alias("is_core"))
    packed = dense.join(F.broadcast(node), "cell").join(lows, "node").select("z", "low", F.lit(True).alias("is_core"))
    numbers = labels.select("low").distinct().select("low", F.dense_rank().over(so.W.orderBy("low")).alias("k"))
    every = by_class.unionByName(packed).join(numbers, "low", "left").select("z", F.coalesce(F.col("k") - 1, F.lit(-1)).cast("int").alias("cluster"), "is_core")
    out = some.join(every, "z").select("vec_id", "cluster", "is_core")
    return out.unionByName(rows.where("NOT solid").select("vec_id", F.lit(-1).cast("int").alias("cluster"), F.lit(False).alias("is_core")))


def summary(z: DataFrame, eps: float = EPS, least: int = MIN_POINTS) -> DataFrame:
    """One row: clusters, core points, noise, and border points, which lie in a cluster but are no cores."""
    inside = F.col("cluster") >= 0
    return density(z, eps, least).agg(
        F.count_distinct(F.when(inside, F.col("cluster"))).alias("clusters"), F.count_if("is_core").alias("core"), F.count_if(~inside).alias("noise"), F.count_if(inside & ~F.col("is_core")).alias("border")
    )
