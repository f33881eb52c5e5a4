"""Merkle manifest of a table: one digest that vouches for every row, and a proof for each row.

Every row is a leaf.  The leaves of one group (a language), in the order of their ids, are
the bottom of a tree in which every ``FAN`` consecutive nodes become their digest, until one
is left; these subroots, in the order of the groups, are the bottom of one more such tree.

Digests go up and proofs come down in supersteps over RDDs whose vertices are inner nodes,
keyed by (tree, place in its level).  Upwards, a node that has heard from all its children
hashes them and sends the digest to its parent.  Downwards, a node sends each child the
siblings on the way to the root.  Leaves live with their parents and are no vertices of
their own, so that one path is sent for ``FAN`` leaves.  A level has a ``FAN``-th of the nodes
of the one below; only two numbers, from which the heights follow, reach the driver.

Defined results: a null field is written ``-`` and so differs from an empty one; texts of
any length are hashed whole; rows with a null id come first in their group and are not
tampered with; equal rows are leaves side by side; a null group comes before the others;
a row alone in its group is its subroot; an empty table gives no rows; further columns
take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

#: Children of a node.
FAN = 8
#: Columns of a leaf, in the order in which they are hashed.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Vertices that one task holds: at most, and at least where there are that many.
MOST, LEAST = 50_000, 2_000


def field(column) -> F.Column:
    """A value with its number of bytes before it, ``-`` for null."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*columns) -> F.Column:
    """SHA-256 of a row's fields, as bytes."""
    return F.unhex(F.sha2(F.concat(*map(field, columns)), 256))


def digest(joined: bytes) -> bytes:
    """A node, of the joined digests of its children, which are hashed as hexadecimal text."""
    return hashlib.sha256(joined.hex().encode()).digest()


def in_order(rows: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(``rows`` with their ``_part`` and place ``_at`` of a range-partitioned sort, counts by part and group with ``_offset``).

    ``_at + _offset`` is the number of rows of the same group before a row.  Rows that agree in
    all of ``order`` are told apart by where they were read, so that copies do not meet in one part.
    """
    by = [F.asc_nulls_first(c) for c in (group, *order, "_read")]
    parts = rows.withColumn("_read", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("_read")
    parts = cut(parts.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    counts = parts.groupBy("_part", group).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_part")) - F.col("_n")
    return parts, counts.select("_part", group, "_n", (before - F.col("_first")).alias("_offset"))


def numbered_leaves(leaves: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``leaves`` with ``tree`` (rank of the group from 0), ``place`` in the tree and ``size`` of the tree."""
    parts, offsets = in_order(leaves, group, order)
    sizes = offsets.groupBy(group).agg(F.sum("_n").alias("size")).withColumn("_all", F.lit(0))
    groups, shifts = in_order(sizes, "_all", [group])
    groups = groups.join(shifts.select("_part", "_offset"), "_part").select(F.col(group).alias("_of"), "size", (F.col("_at") + F.col("_offset")).alias("tree"))
    offsets = offsets.join(groups, F.col(group).eqNullSafe(F.col("_of"))).drop("_of").withColumnsRenamed({"_part": "_p", group: "_g"})
    rows = parts.join(offsets, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    return rows.withColumn("place", F.col("_at") + F.col("_offset")).drop("_at", "_part", "_p", "_g", "_n", "_offset")


def gathered(messages: RDD, tasks: int) -> RDD:
    """((tree, place), (size of the level below, children)) of nodes that have heard (slot, digest, size of the level below, …) from each child."""

    def completed(vertex):
        (tree, place), heard = vertex
        children = sorted(heard, key=lambda m: m[0])
        below = children[0][2]
        if [c[0] for c in children] != list(range(min(FAN, below - place * FAN))):
            raise RuntimeError(f"node {place} of tree {tree} has not heard from each of its children once")
        return (tree, place), (below, children)

    return messages.groupByKey(tasks).map(completed, preservesPartitioning=True)


def hashed(below: int, children: list[tuple]) -> bytes:
    """The digest of a node; a node alone at the bottom of its tree stands for itself."""
    return digest(b"".join(c[1] for c in children)) if below > 1 else children[0][1]


def upward(vertex) -> Iterator[tuple]:
    """The message of a node to its parent, if it has one."""
    (tree, place), (below, children) = vertex
    if below > FAN:
        yield (tree, place // FAN), (place % FAN, hashed(below, children), -(-below // FAN))


def longer(children: list[tuple], k: int, path: tuple) -> tuple:
    """The path of child k: its siblings' digests before and after it, then the path of its parent."""
    return ((b"".join(c[1] for c in children[:k]), b"".join(c[1] for c in children[k + 1 :])), *path)


def downward(vertex) -> Iterator[tuple]:
    """The messages of a node to its children."""
    (tree, place), ((below, children), (path, seal)) = vertex
    for k in range(len(children)):
        yield (tree, place * FAN + k), (longer(children, k, path), seal)


def at_leaves(vertex) -> Iterator[tuple]:
    """(leaf, path, seal) of the leaves that live with a node."""
    _, ((below, children), (path, seal)) = vertex
    for k, leaf in enumerate(children):
        yield leaf, longer(children, k, path) if below > 1 else path, seal


def fold(leaf: bytes, path: tuple) -> bytes:
    """The root that a leaf and its path lead to."""
    for before, after in path:
        leaf = digest(before + leaf + after)
    return leaf


class Forest:
    """Trees over leaves ((tree, place // FAN), (place % FAN, digest, leaves of the tree, …)).

    ``leaves`` is their number at most, ``tallest`` that of the largest tree, ``tasks`` the wanted parallelism.
    """

    def __init__(self, messages: RDD, leaves: int, tallest: int, trees: int, tasks: int):
        self.levels = []
        while True:
            leaves, tallest = leaves // FAN + trees, -(-tallest // FAN)
            dealt = max(-(-leaves // MOST), min(tasks, -(-leaves // LEAST)))
            self.levels.append(gathered(messages, dealt))
            if tallest <= 1:
                break
            messages = self.levels[-1].flatMap(upward)

    def tops(self, level: RDD) -> RDD:
        """(tree, node) of the trees that end in a level."""
        return level.filter(lambda v: v[1][0] <= FAN).map(lambda v: (v[0][0], v[1]))

    def roots(self) -> RDD:
        """(tree, root)."""
        every = [self.tops(level) for level in self.levels]
        return every[0].context.union(every).map(lambda v: (v[0], hashed(*v[1])))

    def proofs(self, above: RDD) -> RDD:
        """(leaf, path, seal) of all leaves; ``above`` has (tree, (path beyond its root, seal)), and seals are handed down as they are."""
        paths = None
        for level in reversed(self.levels):
            n = level.getNumPartitions()
            heard = self.tops(level).join(above, n).map(lambda v: ((v[0], 0), v[1]))
            if paths is not None:
                heard = heard.union(level.filter(lambda v: v[1][0] > FAN).join(paths, n))
            paths = heard.flatMap(downward)
        return heard.flatMap(at_leaves)


def leaf_paths(leaves: DataFrame, group: str, order: list[str], payload: list[str]) -> RDD:
    """((payload…), leaf digest, path, subroot, root) of rows with a binary column ``leaf``."""
    rows = cut(numbered_leaves(leaves, group, order).select("tree", "place", "size", "leaf", *payload))
    n, trees, tallest = rows.agg(F.count(F.lit(1)), F.max("tree"), F.max("size")).first()
    context, tasks = rows.sparkSession.sparkContext, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if not n:
        return context.emptyRDD()
    trees += 1
    messages = rows.rdd.map(lambda r: ((r[0], r[1] // FAN), (r[1] % FAN, bytes(r[3]), r[2], tuple(r[4:]))))
    forest = Forest(messages, n, tallest, trees, tasks)
    subroots = forest.roots().map(lambda t: ((0, t[0] // FAN), (t[0] % FAN, t[1], trees, t[0])))
    crown = Forest(subroots, trees, trees, 1, tasks)
    above = crown.proofs(crown.roots().map(lambda t: (t[0], ((), t[1])))).map(lambda x: (x[0][3], (x[1], (x[0][1], x[2]))))
    return forest.proofs(above).map(lambda x: (x[0][3], x[0][1], x[1], *x[2]))


def proofs(rows: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof) of every row: all hexadecimal; a proof has the siblings (before, after) of each level from the leaf up."""
    leaves = rows.select("doc_id", "lang", leaf_digest(*map(F.col, FIELDS)).alias("leaf"))
    found = leaf_paths(leaves, "lang", ["doc_id", "leaf"], ["doc_id"])
    cells = lambda x: (x[0][0], x[1].hex(), x[3].hex(), x[4].hex(), [(a.hex(), b.hex()) for a, b in x[2]])
    schema = "doc_id long, leaf string, subroot string, root string, proof array<struct<before:string,after:string>>"
    return rows.sparkSession.createDataFrame(found.map(cells), schema, verifySchema=False)


def folded(leaf, proof) -> F.Column:
    """The root that a leaf (hexadecimal) and a proof lead to: anyone who has them can check a row against the root."""
    return F.aggregate(proof, leaf, lambda d, s: F.sha2(F.concat(s["before"], d, s["after"]), 256))


def verified(rows: DataFrame, found_text) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row, whose text is now ``found_text``, a column.

    ``folded_root`` is worked out at the leaf from what is there now and the siblings sent
    down; it is the root only if the row is as it was.
    """
    now = leaf_digest(*[found_text if c == "text" else F.col(c) for c in FIELDS])
    leaves = rows.select("doc_id", "lang", leaf_digest(*map(F.col, FIELDS)).alias("leaf"), now.alias("now"))
    leaves = leaves.withColumn("now", F.when(F.col("now") != F.col("leaf"), F.col("now")))

    def check(x):
        (doc_id, changed), leaf, path, subroot, root = x
        back = fold(leaf if changed is None else bytes(changed), path)
        siblings = digest(b"".join(a + b for a, b in path))
        return doc_id, leaf.hex(), subroot.hex(), root.hex(), siblings.hex(), back.hex(), back == root

    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return rows.sparkSession.createDataFrame(leaf_paths(leaves, "lang", ["doc_id", "leaf"], ["doc_id", "now"]).map(check), schema, verifySchema=False)


def lowered(doc_id, text) -> F.Column:
    """The query's way to tamper: capital letters become small where 3 divides the CRC-32 of the id."""
    capitals = "".join(map(chr, range(65, 91)))
    return F.when(F.crc32(doc_id.cast("string")) % 3 == 0, F.translate(text, capitals, capitals.lower())).otherwise(text)
