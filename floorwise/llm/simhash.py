"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

Distinct fingerprints become nodes; copies never pair up. A 64-bit fingerprint is cut into
two segments A and B of 23 bits and a rest C of 18. The perfect Golay code puts every
23-bit word within 3 bits of one codeword; the codewords within 4 bits of a word (one or
six) are its several keys. Words that differ in one bit share the codeword of the one with
the keys of the other, words that differ in two bits share one of their several keys.

For at most 3 differing bits (a, b, c in A, B and C), the pigeonhole principle leaves five
families of keys, of 30 bits and more, one of which any linked pair shares:

    c = 0            C whole and the codeword of A (a <= 1), or of B (b <= 1)
    c = 1, a, b <= 1 the codewords of A and B and one whole half of C
    c >= 1, b = 0    B whole and several codewords of A (a <= 2)
    c >= 1, a = 0    A whole and several codewords of B (b <= 2)

Equal keys join, the exact distance verifies, and alternating large-star and small-star
steps give the components. A key's nodes are compared with its smallest one first; only where
that leaves several components under a key are its other pairs compared. Everything stays
distributed; each round is a written table.

``keep_one_of_each`` removes copies by similarity. Of texts of a Jaccard index of 0.8 the
fingerprints differ in 10 bits on average, beyond any radius that keys can cover, so the pairs
that the fingerprints give are verified first and ``neardup`` completes them.

Defined results: a null or empty text has fingerprint zero and links like any other; fewer
words than a shingle are one shingle; texts of any length count whole; repeated rows fall
together; null ids are passed over when a component's smallest id is taken, unless it has no
other; an empty table gives an empty one. ``near_duplicate_classes`` gives its own columns alone,
``keep_one_of_each`` all columns of the documents whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from floorwise.llm import neardup
from floorwise.llm.shared import Written, shielded, slices, tidy
from floorwise.operators.graph import components

SEED = 42
MOST_BITS = 3
#: Shingles of one text that are hashed at a time.
STEP = 1 << 16

#: Fixed value: the generator polynomial of the binary Golay code [23, 12, 7].
GENERATOR = 0b101011100011
LENGTH, CHECKS = 23, 11


def _remainder(word: int) -> int:
    for shift in range(LENGTH - 1, CHECKS - 1, -1):
        if word >> shift & 1:
            word ^= GENERATOR << (shift - CHECKS)
    return word


class Golay:
    """Decoding of 23-bit words to the 12-bit index of their codeword."""

    def __init__(self):
        self.high = np.array([_remainder(m << CHECKS) for m in range(1 << (LENGTH - CHECKS))], dtype=np.int64)
        self.error = np.zeros(1 << CHECKS, dtype=np.int64)
        bits = [1 << i for i in range(LENGTH)]
        for i, x in enumerate(bits):
            for j, y in enumerate(bits[: i + 1]):
                for z in bits[: j + 1]:
                    pattern = x | y | z
                    self.error[_remainder(pattern)] = pattern
        self.flips = np.array([0, *bits], dtype=np.int64)

    def index(self, words: np.ndarray) -> np.ndarray:
        syndrome = (words & ((1 << CHECKS) - 1)) ^ self.high[words >> CHECKS]
        return (words ^ self.error[syndrome]) >> CHECKS

    def keys(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and codeword indices of all codewords within 4 bits of each word."""
        found = np.sort(self.index(words[:, None] ^ self.flips[None, :]), axis=1)
        new = np.ones(found.shape, dtype=bool)
        new[:, 1:] = found[:, 1:] != found[:, :-1]
        return np.nonzero(new)[0], found[new]


def fingerprint(text: str | None, words: int) -> int:
    """The SimHash of a text's shingles, as an unsigned integer."""
    from xxhash import xxh64_intdigest

    parts = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII white space count
    if not parts:
        return 0
    n = max(1, len(parts) - words + 1)
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, n, STEP):
        some = parts[start : min(start + STEP, n) + words - 1]
        shingles = map(b" ".join, zip(*(some[i:] for i in range(words)))) if len(some) >= words else [b" ".join(some)]
        hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def majority(hashes: np.ndarray) -> np.int64:
    """The SimHash of 64-bit hashes, as a signed integer."""
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), STEP):
        some = hashes[start : start + STEP].astype("<i8")
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0]


def with_fingerprints(df: DataFrame, words: int = 3, text: str = "text", out: str = "fingerprint", keep_text: bool = False) -> DataFrame:
    """Add the fingerprint as a signed BIGINT; the text goes unless it is to be kept."""
    kept = [f for f in df.schema.fields if f.name.lower() != out.lower() and (keep_text or f.name != text)]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            for start, end in slices(texts):
                found = np.array([fingerprint(t, words) for t in texts[start:end]], dtype=np.uint64).view(np.int64)
                few = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([*(few.column(n) for n in names), pa.array(found)], [*names, out])

    return df.mapInArrow(run, T.StructType([*kept, T.StructField(out, T.LongType(), False)]))


_golay: list[Golay] = []


def keys_of(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all families, the row of each, and whether it is looked up or looked for."""
    if not _golay:
        _golay.append(Golay())
    golay, x = _golay[0], fingerprints.view(np.uint64)
    low = np.uint64((1 << LENGTH) - 1)
    a, b, c = (x & low).astype(np.int64), (x >> np.uint64(LENGTH) & low).astype(np.int64), (x >> np.uint64(2 * LENGTH)).astype(np.int64)
    rows = np.arange(len(x))
    one_a, one_b = golay.index(a), golay.index(b)
    (rows_a, all_a), (rows_b, all_b) = golay.keys(a), golay.keys(b)
    halves = [(h << 9) | (c >> (9 * h) & 511) for h in (0, 1)]
    found = []  # family, value, rows, looked up, looked for
    for family, one, (of, several) in ((1, one_a, (rows_a, all_a)), (2, one_b, (rows_b, all_b))):
        found += [(family, c << 12 | one, rows, True, False), (family, c[of] << 12 | several, of, False, True)]
    for half in halves:
        found += [(3, (all_a << 12 | one_b[rows_a]) << 10 | half[rows_a], rows_a, True, False), (3, (one_a[rows_b] << 12 | all_b) << 10 | half[rows_b], rows_b, False, True)]
    found += [(4, b[rows_a] << 12 | all_a, rows_a, True, True), (5, a[rows_b] << 12 | all_b, rows_b, True, True)]
    keys = np.concatenate([np.int64(family) << 40 | value for family, value, *_ in found])
    which = np.concatenate([of for _, _, of, _, _ in found])
    sides = [np.concatenate([np.full(len(f[2]), f[side]) for f in found]) for side in (3, 4)]
    return keys, which, sides[0], sides[1]


def _keys(nodes: DataFrame, side: int, key: str, node: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy()
            found = keys_of(fps)
            wanted = found[2 + side]
            yield pa.RecordBatch.from_arrays([pa.array(found[0][wanted]), pa.array(fps[found[1][wanted]])], [key, node])

    return nodes.mapInArrow(run, f"{key} long, {node} long")


def links(nodes: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """All pairs a < b of distinct fingerprints (the one column of ``nodes``) that link."""
    _covered(most_bits)
    upper, lower = _keys(nodes, 0, "key", "a"), _keys(nodes, 1, "key_b", "b")
    near = F.expr(f"bit_count(a ^ b) <= {most_bits}")
    return upper.join(lower, (F.col("key") == F.col("key_b")) & (F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def _covered(most_bits: int) -> None:
    if not 0 <= most_bits <= MOST_BITS:
        raise ValueError(f"the key families cover 0 to {MOST_BITS} bits")


def joining_links(nodes: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """Linked pairs (a, b) that join all fingerprints which links join, without all pairs of a dense group."""
    _covered(most_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy()
            keys, which, *_ = keys_of(fps)
            order = np.lexsort((keys, which))
            keys, which = keys[order], which[order]
            new = np.ones(len(keys), dtype=bool)
            new[1:] = (keys[1:] != keys[:-1]) | (which[1:] != which[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(keys[new]), pa.array(fps[which[new]])], ["key", "node"])

    near = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= most_bits
    of_key = Window.partitionBy("key")
    with tidy():
        grouped = nodes.mapInArrow(run, "key long, node long").withColumns({"r": F.min("node").over(of_key), "last": F.max("node").over(of_key)})
        members = Written(grouped.where("r <> last").drop("last"), "groups").df
        stars = Written(members.where((F.col("node") != F.col("r")) & near("node", "r")).select(F.col("r").alias("a"), F.col("node").alias("b")).distinct(), "stars").df
        labels = Written(components(stars), "labels").df
        flat = Written(members.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label")), "members").df
        mixed = flat.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
        left = flat.join(mixed, "key", "left_semi")
        x, y = (left.select("key", F.col("node").alias(n), F.col("label").alias(f"l{n}")) for n in "ab")
        cross = x.join(y, "key").where((F.col("la") != F.col("lb")) & (F.col("a") < F.col("b")) & near("a", "b"))
        return Written(stars.union(cross.select("a", "b").distinct()), "links", keep=True).df


def classes(rows: DataFrame, most_bits: int = MOST_BITS, id_column: str = "doc_id") -> DataFrame:
    """(fingerprint, component_id) for the distinct fingerprints of ``rows``, a written table."""
    with tidy():
        nodes = Written(rows.groupBy("fingerprint").agg(F.min(id_column).alias("first_id")), "fingerprints").df
        linked = components(joining_links(nodes.select("fingerprint"), most_bits)).withColumnRenamed("node", "fingerprint")
        firsts = Written(nodes.join(linked, "fingerprint", "left"), "firsts").df
        smallest = firsts.where("label is not null").groupBy("label").agg(F.min("first_id").alias("component_id"))
        found = firsts.join(smallest, "label", "left")
        return Written(found.select("fingerprint", F.when(F.col("label").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id")), "classes", keep=True).df


def near_duplicate_classes(docs: DataFrame, words: int = 3, most_bits: int = MOST_BITS, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its id, ``fingerprint`` (16 hex digits) and ``component_id``."""
    rows = Written(with_fingerprints(docs.select(id_column, text), words, text), "rows", keep=True).df
    found = rows.join(classes(rows, most_bits, id_column), "fingerprint")
    return found.select(id_column, F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def candidate_pairs(nodes: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """Pairs (a, b) of nodes, from (node, fingerprint): every node with the smallest of its fingerprint, and those of linked ones."""
    first = Written(nodes.groupBy("fingerprint").agg(F.min("node").alias("first")), "fingerprints").df
    equal = nodes.join(first, "fingerprint").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    of = lambda end: first.select(F.col("fingerprint").alias(end), F.col("first").alias(f"first_{end}"))
    linked = joining_links(first.select("fingerprint"), most_bits).join(of("a"), "a").join(of("b"), "b")
    return equal.union(linked.select("first_a", "first_b"))


def keep_one_of_each(docs: DataFrame, words: int = neardup.WORDS, similarity: float = neardup.SIMILARITY, most_bits: int = MOST_BITS, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of copies and near copies: the smallest id, and of equal ids any one.

    Groups join texts of a Jaccard index of at least ``similarity``; pairs of fingerprints at
    ``most_bits`` or fewer bits are verified first, ``neardup.links`` finds the others.
    """
    plain, back = shielded(docs, [id_column, text])
    node, row = "node", "row_number"
    with tidy():
        table = neardup.with_nodes(plain, words, text, node, "size", "parity", "fingerprint").withColumn(row, F.monotonically_increasing_id())
        table = Written(table, "documents", keep=True).df
        nodes = table.select(node, "fingerprint").distinct()
        found = neardup.links(table.select(node, F.col(text).alias("text"), "size", "parity", *neardup.PARITY), candidate_pairs(nodes, most_bits), words, similarity)
        rows = table.select(F.col(id_column).alias("id"), node, F.col(row).alias("row"))
        best = F.min(F.struct(F.col("id").isNull(), "id", "row"))
        of_node = rows.groupBy(node).agg(best.alias("best")).join(components(found), node, "left").select(node, "best", F.coalesce("label", node).alias("label"))
        of_node = Written(of_node, "classes").df
        first = of_node.groupBy("label").agg(F.min("best").getField("row").alias("kept"))
        kept = Written(of_node.join(first, "label").select(node, "kept"), "kept").df
        extra = Written(rows.join(kept, node).where("row <> kept").select(F.col("row").alias(row)), "extra", keep=True).df
    few = extra.count() <= neardup.MOST_SENT
    return back(table.join(F.broadcast(extra) if few else extra, row, "left_anti"))
