"""A Merkle manifest of a dataset, by supersteps of messages between tree nodes.

Rows are leaves: the hash of their columns. The leaves of a group ascend by its order column,
and every ``ARITY`` consecutive nodes become the hash of their digests until one node is left,
the group's root; the groups' roots, in order of their groups, give the dataset's root alike.

Leaves and inner nodes send their digest to the parent they lie under; a parent that
has all its children (their number follows from the group's) hashes and sends on. On the way back
every parent sends each child the digests beside its path, the last of them first, and
leaves have their proof. A vertex of a superstep is a subtree of ``LEVELS`` levels, so one has at most
``ARITY ** LEVELS`` children, a group of any size is spread over its subtrees, and there are
few supersteps. Their number follows from the largest group's size. Leaves are written once in the
shared folder, which all later steps read; what a lost executor held is made again from there.

Defined results: a null column hashes as ``-``, any other as its length in bytes, ``:`` and its
value; leaves of equal order (null first) go by their digests, so repeated rows have equal leaves
and neighbouring places; null is a group of its own, the first; an empty table has an empty manifest;
values of any length are hashed whole; columns that are neither hashed nor carried are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from floorwise.llm.shared import Written, shielded
from floorwise.operators.ids import numbered

ARITY = 3
#: Levels of the tree that one superstep goes through.
LEVELS = 5

Node = tuple  # (place among the group's nodes of its level, digest, what is carried)


def leaf(columns: list[str]) -> Column:
    """The digest of a row: each column as its length in bytes, ``:`` and its value, ``-`` if null."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(part, columns)).cast("binary"), 256)


def parent(digests: list[bytes]) -> bytes:
    return sha256(b"".join(digests).hex().encode()).digest()


def climb(nodes: list[bytes], total: int, levels: int) -> list[list[bytes]]:
    """The levels of a subtree over ``nodes``, at most ``levels`` above them; the group has ``total`` nodes on theirs."""
    rows = [nodes]
    while total > 1 and len(rows) <= levels:
        nodes = [parent(nodes[i : i + ARITY]) for i in range(0, len(nodes), ARITY)]
        total = -(-total // ARITY)
        rows.append(nodes)
    return rows


def beside(rows: list[list[bytes]], place: int) -> list[bytes]:
    """The digests beside the path of a node in ``climb``'s levels, the lowest first."""
    found = []
    for row in rows[:-1]:
        first = place - place % ARITY
        found += row[first:place] + row[place + 1 : first + ARITY]
        place //= ARITY
    return found


def fold(digest: bytes, place: int, total: int, proof: list[bytes]) -> bytes:
    """The root that a digest gives with the digests beside its path; ``proof`` loses those that were taken."""
    while total > 1:
        first = place - place % ARITY
        others = proof[: min(ARITY, total - first) - 1]
        del proof[: len(others)]
        digest = parent(others[: place - first] + [digest] + others[place - first :])
        place, total = place // ARITY, -(-total // ARITY)
    return digest


def _up(nodes: RDD, width: int, partitions: int) -> RDD:
    """One superstep: ((group, place of subtree), (total, nodes in order)) from ((group), (total, node))."""
    sent = nodes.map(lambda x: ((x[0], x[1][1][0] // width), x[1]))
    gathered = sent.groupByKey(partitions)  # at most ``width`` nodes of one total

    def subtree(found) -> tuple[int, list[Node]]:
        found = list(found)
        return found[0][0], sorted((n for _, n in found), key=lambda n: n[0])

    return gathered.mapValues(subtree)


def _forward(subtrees: RDD, levels: int) -> RDD:
    """Completed subtrees send their upper digest on."""

    def send(x):
        (group, place), (total, nodes) = x
        rows = climb([n[1] for n in nodes], total, levels)
        return group, (-(-total // ARITY**levels), (place, rows[-1][0], None))

    return subtrees.map(send)


def _down(subtrees: RDD, messages: RDD, partitions: int, levels: int) -> RDD:
    """The reverse superstep: (group, total, node, proof of it) from what lies beside each subtree's path upward."""
    met = subtrees.cogroup(messages, partitions)

    def spread(x) -> Iterator[tuple]:
        (group, _), (state, above) = x
        for (total, nodes), (rest, root) in zip(state, above):
            rows = climb([n[1] for n in nodes], total, levels)
            for i, node in enumerate(nodes):
                yield group, total, node, (beside(rows, i) + rest, root)

    return met.flatMap(spread)


def tree(leaves: RDD, largest: int, partitions: int, levels: int = LEVELS) -> tuple[RDD, list[RDD]]:
    """(group, (1, root node)) of all groups, and the subtrees of every superstep from the leaves up.

    ``leaves`` are (group, (leaves of the group, node)); the largest group has ``largest``.
    """
    width, steps, nodes = ARITY**levels, [], leaves
    while True:
        steps.append(_up(nodes, width, partitions))
        nodes = _forward(steps[-1], levels)
        largest = -(-largest // width)
        if largest <= 1:
            return nodes, steps


def proofs(steps: list[RDD], above: RDD, partitions: int, levels: int = LEVELS) -> RDD:
    """(group, total, leaf node, (proof, root)) of all leaves; ``above`` has ((group), (rest of the proof, root)) of all groups."""
    messages = above.map(lambda x: ((x[0], 0), x[1]))
    for step in steps[:0:-1]:
        spread = _down(step, messages, partitions, levels)
        messages = spread.map(lambda x: ((x[0], x[2][0]), x[3]))
    return _down(steps[0], messages, partitions, levels)


_MANIFEST = "digest binary, place long, leaves long, subroot binary, group_place long, groups long, root binary, proof binary"


def manifest(df: DataFrame, columns: list[str], group: str, order: str, carried: list[str] = (), levels: int = LEVELS) -> DataFrame:
    """One row per row of ``df``: ``order``, ``group`` and ``carried`` columns, the leaf's digest, its
    place among the group's leaves, the group's root, the dataset's root, and the proof: the digests
    beside the path to the root, from below and from left to right."""
    spark, own = df.sparkSession, [order, group, *carried]
    plain, _ = shielded(df, list({*columns, *own}))
    rows = plain.select(F.col(group).alias("_group"), F.col(order).alias("_order"), F.unhex(leaf(columns)).alias("_digest"), F.struct(*own).alias("_own"))
    placed = Written(numbered(Written(rows, "leaves").df, ["_group", "_order", "_digest"], "_n"), "placed").df
    groups = placed.groupBy("_group").agg(F.min("_n").alias("_first"), F.count("*").alias("_leaves"))
    groups = Written(numbered(groups, ["_group"], "_g"), "groups").df
    top = groups.agg(F.max("_leaves"), F.count("*")).first()
    schema = T.StructType([*plain.select(*own).schema.fields, *T._parse_datatype_string(_MANIFEST).fields])
    if not top[1]:
        return spark.createDataFrame([], schema)
    known = placed.join(groups, placed["_group"].eqNullSafe(groups["_group"])).select("_g", "_leaves", (F.col("_n") - F.col("_first")).alias("_place"), "_digest", "_own")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    leaves = known.rdd.map(lambda r: (r[0], (r[1], (r[2], bytes(r[3]), tuple(r[4])))))
    roots, steps = tree(leaves, top[0], partitions, levels)
    n_groups = top[1]
    of_groups = roots.map(lambda x: (0, (n_groups, (x[0] - 1, x[1][1][1], None))))
    whole, group_steps = tree(of_groups, n_groups, partitions, levels)
    above = proofs(group_steps, whole.map(lambda x: (0, ([], x[1][1][1]))), partitions, levels)
    above = above.map(lambda x: (x[2][0] + 1, (x[3][0], (x[2][1], x[2][0], x[3][1]))))
    found = proofs(steps, above, partitions, levels)

    def row(x) -> tuple:
        _, total, (place, digest, mine), (proof, (subroot, group_place, root)) = x
        return (*mine, digest, place, total, subroot, group_place, n_groups, root, b"".join(proof))

    return spark.createDataFrame(found.map(row), schema, verifySchema=False)


def verified(proven: DataFrame, digest: str = "digest", folded: str = "folded_root", out: str = "verified") -> DataFrame:
    """Add the root that column ``digest`` gives with the rows' proofs, and whether it is the dataset's root."""
    fields = [f for f in proven.schema.fields if f.name not in (folded, out)]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = []
            for own, place, total, group_place, groups, proof in zip(*(batch.column(c).to_pylist() for c in (digest, "place", "leaves", "group_place", "groups", "proof"))):
                rest = [proof[i : i + 32] for i in range(0, len(proof), 32)]
                roots.append(fold(fold(own, place, total, rest), group_place, groups, rest))
            same = [a == b for a, b in zip(roots, batch.column("root").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(roots, pa.binary()), pa.array(same, pa.bool_())], [*names, folded, out])

    return proven.mapInArrow(run, T.StructType([*fields, T.StructField(folded, T.BinaryType()), T.StructField(out, T.BooleanType())]))
