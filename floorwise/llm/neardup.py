"""Near copies by word shingles: all pairs of a Jaccard index of at least 0.8, none missed.

A text is its set of distinct five-word shingles, each a 64-bit hash; equal sets are one
node. One candidate of each node is verified first: the smallest of the caller's (SimHash's, in
``simhash.keep_one_of_each``) and the smallest that leads one of its keys. What these join is
left out of what follows: pairs with another leader of each key, then all pairs. So a large group
of near copies costs no square.

Keys are prefixes: shingles have one order everywhere, those that are frequent in a sample
last, the others by hash. Of sets x and y with a Jaccard index of t or more, the first
|x| - ceil(t |x|) + 1 and |y| - ceil(t |y|) + 1 shingles in that order have one in common,
whatever the order is. Frequent ones last only keeps groups small.

All pairs of a key in different groups are candidates, unless sizes, positions or sketches rule
out the similarity: a sketch tells of each bucket of hashes whether it holds an odd number,
and has as many buckets as its text has shingles, or more. Of the candidates between two
groups one is verified, by an exact count of the common hashes; where that joins the groups
the others are settled, and where it does not, ``MORE`` times as many are verified next, until
none is left. Components of links are the groups.

Defined results: texts compare in lower case (A-Z) by words between ASCII white space; a null
text is an empty one, and empty texts are copies of each other; fewer words than a shingle are
one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from floorwise.llm.shared import Written, slices, tidy
from floorwise.operators.graph import components

SEED, WORDS, SIMILARITY = 42, 5, 0.8
#: Nodes in the sample, and in how many of them a shingle is frequent; both only order keys.
SAMPLE, FREQUENT = 8192, 4
#: Bits of the map that tells which texts are needed for comparison; false hits do no harm.
BITS = 1 << 24
LEAST_BUCKETS = 256
#: Candidates between two groups that are verified next, for each one verified before.
MORE = 64
#: The sketch folded to 256 buckets, as four integers.
PARITY = ["p0", "p1", "p2", "p3"]
#: Up to so many rows an anti join's right side of row numbers is sent to all tasks (8 bytes each).
MOST_SENT = 4_000_000


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending."""
    from xxhash import xxh64_intdigest

    parts = (text or "").encode().lower().split()
    found = map(b" ".join, zip(*(parts[i:] for i in range(words)))) if len(parts) >= words else [b" ".join(parts)]
    return np.unique(np.fromiter(map(xxh64_intdigest, found, repeat(SEED)), dtype=np.uint64).view(np.int64))


def sketch(found: np.ndarray) -> bytes:
    """For each bucket of hashes a bit: whether it holds an odd number of them."""
    buckets = max(LEAST_BUCKETS, 1 << (len(found) - 1).bit_length())
    return np.packbits(np.bincount(found & (buckets - 1), minlength=buckets).astype(np.uint8) & 1).tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """A number of hashes that at least differ between the sets of two sketches."""
    size = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum())


def folded(x: bytes, size: int) -> np.ndarray:
    """A sketch with fewer buckets, of ``size`` bytes: halves fall together."""
    a = np.frombuffer(x, np.uint8)
    while len(a) > size:
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return a


def with_nodes(df: DataFrame, words: int, text: str, node: str, size: str, parity: str, fingerprint: str) -> DataFrame:
    """Add each text's node, number of shingles, sketch, and SimHash of its set of shingles."""
    from floorwise.llm.simhash import majority

    added = [T.StructField(node, T.LongType(), False), T.StructField(size, T.LongType(), False), T.StructField(parity, T.BinaryType(), False), T.StructField(fingerprint, T.LongType(), False), *(T.StructField(c, T.LongType(), False) for c in PARITY)]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), *(pa.int64() for _ in PARITY)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            texts = batch.column(text).to_pylist()
            for start, end in slices(texts):
                rows = []
                for t in texts[start:end]:
                    found = shingles(t, words)
                    odd = sketch(found)
                    rows.append((int(np.uint64(xxh64_intdigest(found.tobytes(), SEED)).view(np.int64)), len(found), odd, int(majority(found)), *folded(odd, LEAST_BUCKETS // 8).view("<i8").tolist()))
                few = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([*few.columns, *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], [*few.schema.names, *(f.name for f in added)])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *added]))


def _frequent(texts: DataFrame, words: int) -> np.ndarray:
    """Hashes of shingles that many nodes of a sample have; the sample's size is fixed."""
    share = max(1, texts.count() // SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, text in zip(batch.column(0).to_numpy(), batch.column(1).to_pylist()):
                found = shingles(text, words)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.full(len(found), node))], ["key", "node"])

    some = texts.where(F.pmod(F.xxhash64("node"), F.lit(share)) == 0).mapInArrow(run, "key long, node long")
    counted = some.distinct().groupBy("key").count().where(F.col("count") >= FREQUENT)
    return np.sort(counted.select("key").toArrow().column(0).to_numpy())


def _keys(texts: DataFrame, words: int, least: Fraction, frequent: np.ndarray) -> DataFrame:
    """(key, node, n, at): the first shingles of every node, its size, and their positions."""
    shared = texts.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, seen = shared.value, set()  # copies within a task give their keys once
        for batch in batches:
            new = []
            for node in batch.column(0).to_pylist():
                new.append(node not in seen)
                seen.add(node)
            batch = batch.filter(pa.array(new, pa.bool_()))
            nodes, all_texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for start, end in slices(all_texts):
                keys, sizes, counts = [], [], []
                for text in all_texts[start:end]:
                    found = shingles(text, words)
                    n = len(found)
                    if len(often):
                        hot = often[np.minimum(np.searchsorted(often, found), len(often) - 1)] == found
                        found = np.concatenate([found[~hot], found[hot]])
                    prefix = n - -(-least.numerator * n // least.denominator) + 1
                    keys.append(found[:prefix])
                    sizes.append(n)
                    counts.append(prefix)
                at = np.concatenate([np.arange(c) for c in counts])
                columns = [np.concatenate(keys), np.repeat(nodes[start:end], counts), np.repeat(np.array(sizes), counts).astype(np.int32), at.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "node", "n", "at"])

    return texts.mapInArrow(run, "key long, node long, n int, at int")


def _sets(texts: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, hashes) of the wanted nodes, and of a few more."""
    bit = F.pmod(F.col("node"), F.lit(BITS))
    by_word = nodes.groupBy(F.floor(bit / 32).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 32).cast("int"))).alias("b")).toArrow()
    bits = np.zeros(BITS // 32, dtype=np.uint32)
    bits[by_word.column(0).to_numpy()] = by_word.column(1).to_numpy().astype(np.uint32)
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in batches:
            of = batch.column(0).to_numpy() % BITS
            batch = batch.filter(pa.array((wanted[of >> 5] >> (of & 31).astype(np.uint32) & 1).astype(bool)))
            all_nodes, all_texts = batch.column(0), batch.column(1).to_pylist()
            for start, end in slices(all_texts):
                found = [shingles(t, words).tobytes() for t in all_texts[start:end]]
                yield pa.RecordBatch.from_arrays([all_nodes.slice(start, end - start), pa.array(found, pa.binary())], ["node", "hashes"])

    return texts.mapInArrow(run, "node long, hashes binary").groupBy("node").agg(F.first("hashes").alias("hashes"))


def _verified(pairs: DataFrame, sets: DataFrame, least: Fraction) -> DataFrame:
    """The pairs (a, b) whose Jaccard index is at least ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(s.as_buffer(), dtype=np.int64) for s in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                near.append(common * least.denominator >= least.numerator * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    of = lambda end: sets.select(F.col("node").alias(end), F.col("hashes").alias(f"of_{end}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long")


def _near(pairs: DataFrame, sketches: DataFrame, least: Fraction) -> DataFrame:
    """The pairs, with their other columns, whose sketches allow the similarity; and ``differ``."""
    others = [c for c in pairs.columns if c not in ("a", "b")]
    p, q = least.numerator, least.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = batch.column("size_a").to_numpy() + batch.column("size_b").to_numpy()
            differ = np.array([least_difference(x, y) for x, y in zip(batch.column("of_a").to_pylist(), batch.column("of_b").to_pylist())], dtype=np.int64)
            out = batch.select(["a", "b", *others]).append_column("differ", pa.array(differ))
            yield out.filter(pa.array(differ * (p + q) <= both * (q - p)))  # of the union at most 1 - t differ

    of = lambda end: sketches.select(F.col("node").alias(end), F.col("size").alias(f"size_{end}"), F.col("parity").alias(f"of_{end}"))
    kinds = dict(pairs.dtypes)
    found = pairs.join(of("a"), "a").join(of("b"), "b")
    return found.mapInArrow(run, "a long, b long, " + "".join(f"{c} {kinds[c]}, " for c in others) + "differ long")


def links(texts: DataFrame, candidates: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Verified pairs (a, b) of ``texts`` (node, text, size, parity, p0 to p3) that join all nodes which similar pairs join.

    ``candidates`` are pairs (a, b) of nodes to begin with; they may be none.
    """
    least = Fraction(str(similarity))
    if not 0 < least <= 1:
        raise ValueError("a similarity is above 0 and at most 1")
    sketches = texts.select("node", "size", "parity", *PARITY).groupBy("node").agg(F.first("size").alias("size"), F.first("parity").alias("parity"), *(F.first(c).alias(c) for c in PARITY))
    texts = texts.select("node", "text")

    def verified(near: DataFrame) -> DataFrame:
        with tidy():
            sets = Written(_sets(texts, near.select(F.explode(F.array("a", "b")).alias("node")).distinct(), words), "sets").df
            return Written(_verified(near.select("a", "b"), sets, least), "links", keep=True).df

    def settled(pairs: DataFrame, found: DataFrame) -> DataFrame:
        """``found`` and what links pairs (a, b, lx, ly) of nodes in different groups verify to join."""
        open_pairs, share = Written(_near(pairs, sketches, least), "near"), 1
        while not open_pairs.df.isEmpty():
            # of the candidates between two groups those that differ least, one of each of ``share`` parts
            part = F.pmod(F.xxhash64("a", "b"), F.lit(share)).alias("part")
            some = open_pairs.df.groupBy("lx", "ly", part).agg(F.min(F.struct("differ", "a", "b")).alias("m"))
            some = Written(some.select("m.a", "m.b", "lx", "ly"), "some")
            now = verified(some.df)
            found = found.union(now)
            rest = open_pairs.df.join(some.df, ["a", "b"], "left_anti")
            if not now.isEmpty():
                joined = components(now.join(some.df, ["a", "b"]).select(F.col("lx").alias("a"), F.col("ly").alias("b")))
                joined = Written(joined, "labels").df
                of = lambda end: joined.select(F.col("node").alias(end), F.col("label").alias(f"n_{end}"))  # noqa: E731, B023
                rest = rest.join(of("lx"), "lx", "left").join(of("ly"), "ly", "left").select("a", "b", F.coalesce("n_lx", "lx").alias("x"), F.coalesce("n_ly", "ly").alias("y"), "differ")
                rest = rest.where("x <> y").select("a", "b", F.least("x", "y").alias("lx"), F.greatest("x", "y").alias("ly"), "differ")
            following = Written(rest, "near")
            open_pairs.discard()
            open_pairs, share = following, MORE * share
        return found

    # the common part is at least t / (1 + t) of both sizes; before the first common shingle there is none
    p, q = least.numerator, least.denominator
    may = lambda x, y: F.least(x["n"] - x["at"], y["n"] - y["at"]).cast("long") * (p + q) >= (x["n"] + y["n"]).cast("long") * p
    ordered = lambda x, y: (F.least(x, y), F.greatest(x, y))
    with tidy():
        keys = _keys(texts, words, least, _frequent(texts, words))
        of_key = Window.partitionBy("key")
        groups = keys.select("key", F.struct("node", "n", "at").alias("m")).withColumns({"r": F.min("m").over(of_key), "last": F.max("m.node").over(of_key)})
        members = Written(groups.where("r.node <> last").select("key", "m", "r").distinct(), "groups")
        # each node tries the smallest one that leads one of its keys, and the smallest of the caller's
        stars = members.df.where((F.col("m.node") != F.col("r.node")) & may(F.col("r"), F.col("m"))).groupBy(F.col("m.node").alias("b")).agg(F.min("r.node").alias("a"))
        a, b = ordered("a", "b")
        given = candidates.where("a <> b").select(a.alias("a"), b.alias("b")).groupBy("b").agg(F.min("a").alias("a"))
        found = verified(Written(_near(given.union(stars).select("a", "b").distinct(), sketches, least), "near").df)

        parities = sketches.select(F.col("node").alias("_node"), F.struct(*PARITY).alias("s"))

        def mixed(found: DataFrame) -> DataFrame:
            """(key, m, label, s) of keys with nodes of several groups; ``s`` has the folded sketch."""
            labels = Written(components(found), "labels").df
            flat = members.df.select("key", "m", F.col("m.node").alias("node")).join(labels, "node", "left").select("key", "m", F.coalesce("label", "node").alias("label"))
            flat = Written(flat, "members").df
            several = flat.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
            return Written(flat.join(several, "key", "left_semi").join(parities, F.col("m.node") == F.col("_node")).drop("_node"), "mixed").df

        def between(x: DataFrame, y: DataFrame) -> DataFrame:
            """Pairs of nodes x and y under a key that lie in different groups."""
            lx, ly = ordered("lx", "ly")
            differ = sum((F.bit_count(F.col(f"sx.{c}").bitwiseXOR(F.col(f"sy.{c}"))).cast("long") for c in PARITY), F.lit(0))
            alike = differ * (p + q) <= (F.col("x.n") + F.col("y.n")).cast("long") * (q - p)
            pairs = x.join(y, "key").where((F.col("lx") != F.col("ly")) & may(F.col("x"), F.col("y")) & alike)
            a, b = ordered("x.node", "y.node")
            return pairs.select(a.alias("a"), b.alias("b"), lx.alias("lx"), ly.alias("ly")).distinct()

        left = mixed(found)
        side = lambda df, n: df.select("key", F.col("m").alias(n), F.col("label").alias(f"l{n}"), F.col("s").alias(f"s{n}"))
        leaders = left.groupBy("key").agg(F.min(F.struct(F.xxhash64("m.node"), "m", "label", "s")).alias("r"))
        leaders = leaders.select("key", F.col("r.m").alias("y"), F.col("r.label").alias("ly"), F.col("r.s").alias("sy"))
        found = Written(settled(between(side(left, "x"), leaders), found), "links").df
        left = mixed(found)
        found = settled(between(side(left, "x"), side(left, "y")).where("a < b"), found)
        return Written(found, "links", keep=True).df
