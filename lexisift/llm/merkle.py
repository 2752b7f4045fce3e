"""A Merkle manifest of a table: a digest of each row, a tree for each language and one over the languages' roots.

Every row is a leaf: the SHA-256, in hexadecimal, of its fields, each as its length in bytes and its value. In a language the
leaves ascend by doc_id; as long as several nodes remain, each run of eight becomes the digest of its digests. What remains is
the subroot. The subroots, in the order of the languages, become the root in the same way.

Rows are sorted by range and numbered from the counts of the partitions, so no language meets in one task. Blocks of 512
leaves are reduced to a node each, in parallel. While more than ``TOP`` nodes are left they are reduced by blocks again; then
the driver builds the top of the tree and broadcasts, for each of its at most ``TOP`` nodes, the suffix path up to the
root. Executors make each block's own paths, lengthen them by the suffix, and fold every row's leaf along its path. Between
the broadcast top and the rows, where blocks were reduced more than once, paths go down by a join of blocks.

Defined cases: a null field counts as ``-`` and so differs from an empty one; a null lang is the first language, a null doc_id the first
of its language, never tampered with; rows with one doc_id are ordered by their digests, equal rows get places of
their own; a lone leaf is its own subroot, a lone subroot the root, a path without siblings has the digest of nothing; an empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexisift.llm.common import ship_package, staged

FAN, LEVELS, TOP = 8, 3, 4096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NODES = "g long, total long, pos long, digest string"
_PATHS = "g long, pos long, sides array<string>, subroot string, root string"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def levels(nodes: list[str], total: int, most: int | None = None) -> list[list[str]]:
    """The nodes of a block, then those above them, until the tree of ``total`` nodes is reduced to one or ``most`` levels are done."""
    out = [nodes]
    while total > 1 and (most is None or len(out) <= most):
        nodes = [digest("".join(nodes[i : i + FAN])) for i in range(0, len(nodes), FAN)]
        out.append(nodes)
        total = -(-total // FAN)
    return out


def sides(tree: list[list[str]], i: int) -> list[str]:
    """What stands left and right of the node in its run, level by level."""
    out = []
    for nodes in tree[:-1]:
        run = i - i % FAN
        out += ["".join(nodes[run:i]), "".join(nodes[i + 1 : run + FAN])]
        i //= FAN
    return out


def fold(leaf: str, path: list[str]) -> str:
    for left, right in zip(path[::2], path[1::2], strict=True):
        leaf = digest(left + leaf + right)
    return leaf


def _field(c: Column) -> Column:
    c = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))


def leaf_of(text: Column | None = None) -> Column:
    """The digest of a row's fields, or of the row with another text."""
    return F.sha2(F.concat(*[_field(text if text is not None and c == "text" else F.col(c)) for c in FIELDS]).cast("binary"), 256)


def tampered_text() -> Column:
    low = "abcdefghijklmnopqrstuvwxyz"
    return F.translate("text", low.upper(), low)


def is_tampered() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))


def placed(rows: DataFrame) -> DataFrame:
    """rows: lang, doc_id, leaf, other. Adds g, the place of the language, total, its number of rows, and pos, the row's place there.

    A partition of the sorted rows knows its own counts; theirs are summed up over one row for each partition and language.
    """
    order = [F.col("lang").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf")]
    numbered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = staged(numbered.withColumns({"part": F.spark_partition_id(), "k": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "manifest-rows")
    runs = rows.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first"))
    by_part = W.partitionBy("lang").orderBy("part")
    runs = runs.withColumn("base", F.sum("n").over(by_part) - F.col("n") - F.col("first"))
    # languages are ranked within the partition where they begin; partitions alone are ranked in one task
    langs = runs.groupBy("lang").agg(F.min("part").alias("home"), F.sum("n").alias("total"))
    homes = langs.groupBy("home").agg(F.count(F.lit(1)).alias("c"))
    homes = homes.select(F.col("home").alias("at"), (F.sum("c").over(W.orderBy("home")) - F.col("c")).alias("before"))
    langs = langs.join(homes, F.col("home") == F.col("at"))
    local = F.row_number().over(W.partitionBy("home").orderBy(F.col("lang").asc_nulls_first())) - 1
    langs = langs.select(F.col("lang").alias("of"), (F.col("before") + local).alias("g"), "total")
    places = runs.join(langs, F.col("lang").eqNullSafe(F.col("of"))).select(F.col("lang").alias("of"), F.col("part").alias("in"), "base", "g", "total")
    both = rows.join(places, F.col("lang").eqNullSafe(F.col("of")) & (F.col("part") == F.col("in")))
    return both.select("doc_id", "leaf", "other", "g", "total", (F.col("base") + F.col("k")).alias("pos"))


def _block() -> Column:
    return F.floor(F.col("pos") / FAN**LEVELS).alias("block")


def _sorted(table: pa.Table) -> pa.Table:
    return table.sort_by("pos")


def reduced(nodes: DataFrame) -> DataFrame:
    """A node for each block; a tree's only node stays as it is."""

    def run(key, table):
        table = _sorted(table)
        total = table.column("total")[0].as_py()
        top = levels(table.column("digest").to_pylist(), total, LEVELS)[-1][0]
        return pa.table({"g": [key[0].as_py()], "total": [-(-total // FAN**LEVELS)], "pos": [key[1].as_py()], "digest": [top]}, pa.schema([("g", pa.int64()), ("total", pa.int64()), ("pos", pa.int64()), ("digest", pa.string())]))

    many = nodes.where("total > 1").select("g", "total", "pos", "digest").groupBy("g", _block()).applyInArrow(run, _NODES)
    return many.unionByName(nodes.where("total = 1").select("g", "total", "pos", "digest"))


def crown(nodes: list[tuple]) -> dict:
    """(g, pos) -> (sides, subroot, root) of the given nodes (g, total, pos, digest): the top of all trees."""
    trees: dict[int, list] = {}
    for g, _, _, d in sorted(nodes):
        trees.setdefault(g, []).append(d)
    own = {g: levels(t, len(t)) for g, t in trees.items()}
    top = levels([t[-1][0] for t in own.values()], len(own))
    out = {}
    for rank, (g, tree) in enumerate(own.items()):
        above = sides(top, rank)
        out |= {(g, i): (sides(tree, i) + above, tree[-1][0], top[-1][0]) for i in range(len(tree[0]))}
    return out


def descended(rows: DataFrame, upper, finish, schema: str) -> DataFrame:
    """finish(sorted rows of a block, their tree, the suffix path of its top), for each block. ``upper`` is the broadcast
    crown or a table of paths."""

    def tree_of(table):
        table = _sorted(table)
        return table, levels(table.column("digest").to_pylist(), table.column("total")[0].as_py(), LEVELS)

    if isinstance(upper, DataFrame):

        def both(key, table, above):
            if not table.num_rows:  # a path that no row of this call is below
                return finish(table, [[]], ([], None, None))
            path = above.to_pylist()[0]
            return finish(*tree_of(table), (path["sides"], path["subroot"], path["root"]))

        return rows.groupBy("g", _block()).cogroup(upper.groupBy("g", "pos")).applyInArrow(both, schema)

    def one(key, table):
        return finish(*tree_of(table), upper.value[key[0].as_py(), key[1].as_py()])

    return rows.groupBy("g", _block()).applyInArrow(one, schema)


def _lengthened(table, tree, above):
    path, subroot, root = above
    n = table.num_rows
    return pa.table(
        [table.column("g"), table.column("pos"), pa.array([sides(tree, i) + path for i in range(n)], pa.list_(pa.string())), pa.array([subroot] * n, pa.string()), pa.array([root] * n, pa.string())],
        names=["g", "pos", "sides", "subroot", "root"],
    )


def _folded(kind: str, proofs: bool):
    def finish(table, tree, above):
        path, subroot, root = above
        n = table.num_rows
        paths = [sides(tree, i) + path for i in range(n)]
        leaf, other = table.column("digest").to_pylist(), table.column("other").to_pylist()
        ends = [fold(o or x, p) for x, o, p in zip(leaf, other, paths, strict=True)]
        text = lambda x: pa.array(x, pa.string())
        columns = {
            "doc_id": table.column("doc_id"),
            "leaf": text(leaf),
            "subroot": text([subroot] * n),
            "root": text([root] * n),
            "proof_sha256": text([digest("".join(p)) for p in paths]),
            "folded_root": text(ends),
            "verified": pa.array([x == root for x in ends], pa.bool_()),
        }
        return pa.table(columns | ({"proof": pa.array(paths, pa.list_(pa.string()))} if proofs else {}))

    return finish, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + (", proof array<string>" if proofs else "")


def proven(rows: DataFrame, top: int = TOP, proofs: bool = False) -> DataFrame:
    """rows: lang, doc_id, leaf and other, a digest to fold in the leaf's place (null: the leaf). With ``proofs`` the siblings
    themselves too, left and right of each level in turn."""
    spark = rows.sparkSession
    leaves = staged(placed(rows).withColumnRenamed("leaf", "digest"), "manifest-leaves")
    stages, at, joined = [leaves], staged(reduced(leaves), "manifest-nodes"), None
    while at.count() > top:
        stages.append(at)
        if joined is None and not at.where("total > 1").limit(1).count():  # subroots alone, more than the driver takes
            joined = len(stages)
            at = at.select(F.lit(0).cast("long").alias("g"), F.lit(at.count()).cast("long").alias("total"), F.col("g").alias("pos"), "digest")
            stages.append(at)
        at = staged(reduced(at), "manifest-nodes")
    nodes = [tuple(r) for r in at.select("g", "total", "pos", "digest").collect()]  # at most ``top``
    upper = spark.sparkContext.broadcast(crown(nodes))
    for i in range(len(stages) - 1, 0, -1):
        if i + 1 == joined:  # the trees' own roots: each has the path of its place among them
            below = stages[i].select(F.col("g").alias("of"), "digest")
            upper = below.join(upper, F.col("of") == F.col("pos")).select(F.col("of").alias("g"), F.lit(0).cast("long").alias("pos"), "sides", F.col("digest").alias("subroot"), "root")
            continue
        upper = staged(descended(stages[i], upper, _lengthened, _PATHS), "manifest-paths")
    finish, schema = _folded(rows.schema["doc_id"].dataType.simpleString(), proofs)
    return descended(leaves, upper, finish, schema)


def manifest(docs: DataFrame, top: int = TOP, proofs: bool = False) -> DataFrame:
    """Digest, subroot, root and proof of every document; those that are tampered with fail at the fold."""
    ship_package(docs.sparkSession)
    rows = docs.select("lang", "doc_id", leaf_of().alias("leaf"), F.when(is_tampered(), leaf_of(tampered_text())).alias("other"))
    return proven(staged(rows, "manifest-digests"), top, proofs)


def _sql(depth: int = 8, above: int = 4) -> str:
    """For up to 8**depth documents of a language and 8**above languages."""
    crc = "list_reduce(flatten(list_transform(range(0, strlen(k) + 1), lambda i: CASE WHEN i = 0 THEN [4294967295] ELSE [ascii(k[i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] END)), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)"
    value = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    row = lambda text: "sha256(" + " || ".join(value(text if c == "text" else c) for c in FIELDS) + ")"
    low = "abcdefghijklmnopqrstuvwxyz"
    out = f"""WITH k AS (SELECT *, doc_id::VARCHAR AS k FROM documents), c AS (SELECT *, xor({crc}, 4294967295) AS crc FROM k),
lf AS (SELECT doc_id, lang, {row('text')} AS leaf, CASE WHEN crc % 3 = 0 THEN {row(f"translate(text, '{low.upper()}', '{low}')")} END AS other FROM c),
pl AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM lf),
a0 AS (SELECT g, i, n, leaf AS h FROM pl)"""

    def tree(name: str, levels_: int) -> str:
        text = ""
        for k in range(levels_):
            text += f""", {name}{k + 1} AS (SELECT g, i // 8 AS i, (any_value(n) + 7) // 8 AS n, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {name}{k} GROUP BY g, i // 8),
s{name}{k} AS (SELECT x.g, x.i, any_value(x.n) AS n, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i < x.i), '') AS l, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i > x.i), '') AS r FROM {name}{k} x JOIN {name}{k} y ON x.g = y.g AND x.i // 8 = y.i // 8 GROUP BY x.g, x.i)"""
        return text

    out += tree("a", depth)
    out += f", b0 AS (SELECT 0 AS g, g AS i, count(*) OVER () AS n, h FROM a{depth})" + tree("b", above)
    out += ", f0 AS (SELECT doc_id, leaf, g, i, '' AS p, coalesce(other, leaf) AS f FROM pl)"
    last = "f0"
    for name, count in (("a", depth), ("b", above)):
        if name == "b":
            out += f", fm AS (SELECT f.doc_id, f.leaf, f.g AS own, 0 AS g, f.g AS i, f.p, f.f FROM {last} f)"
            last = "fm"
        own = "f.own, " if name == "b" else ""
        for k in range(count):
            step = f"f{name}{k}"
            out += f", {step} AS (SELECT f.doc_id, f.leaf, {own}f.g, f.i // 8 AS i, CASE WHEN s.n > 1 THEN f.p || s.l || s.r ELSE f.p END AS p, CASE WHEN s.n > 1 THEN sha256(s.l || f.f || s.r) ELSE f.f END AS f FROM {last} f JOIN s{name}{k} s ON f.g = s.g AND f.i = s.i)"
            last = step
    return out + f" SELECT f.doc_id, f.leaf, a.h AS subroot, b.h AS root, sha256(f.p) AS proof_sha256, f.f AS folded_root, f.f = b.h AS verified FROM {last} f JOIN a{depth} a ON a.g = f.own, b{above} b"


SQL = _sql()
