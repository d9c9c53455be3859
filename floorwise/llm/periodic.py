"""Periodic runs of words by a scan of all lags, and texts without the repetitions.

A run is a stretch of consecutive words with smallest period q (words q apart are identical)
and a length of at least ``least_words`` and ``exponent`` times q, that no neighbouring word
extends keeping that period. The array of word numbers is compared with itself shifted by
every lag up to n / ``exponent``, many lags in one array operation; stretches of equal words
that are long enough are runs. A stretch that a multiple of the period finds again has
the same two ends, so the least lag of each pair of ends is the period.

A document is one range of lags as long as a task scans it in about a second; the ranges of longer
ones are dealt out over the cluster, and the runs they find meet at the document again.

Defined results: a null text has no words, as an empty one, and its collapsed text is empty; texts
of any length are scanned whole; repeated rows each get the same runs; an empty table stays empty;
all other columns pass through unchanged (an existing column of an output's name is replaced).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from floorwise.llm.shared import shielded, slices

#: The shortest run in words, and in periods.
LEAST_WORDS, EXPONENT = 12, 2
#: Comparisons in a range of lags; texts of fewer bytes than ``_short`` gives have one range.
RANGE_COMPARISONS = 1 << 31
#: Cells of one array of comparisons.
CELLS = 1 << 22
_ALL_TRUE = np.uint64(0x0101010101010101)

RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])
RUNS = T.ArrayType(RUN, False)
_ARROW_RUN = pa.struct([pa.field(n, pa.int64(), False) for n in ("start", "length", "period")])


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal numbers for equal words, in the smallest type that has one more."""
    seen: dict[bytes, int] = {}
    ids = [seen.setdefault(w, len(seen)) for w in words]
    return np.array(ids, dtype=np.min_scalar_type(len(seen)))


def scan(ids: np.ndarray, first: int, last: int, least_words: int = LEAST_WORDS, exponent: int = EXPONENT) -> dict[tuple[int, int], int]:
    """The least lag from ``first`` to ``last`` of every (start, end) of long enough equal stretches."""
    n, found = len(ids), {}
    padded = np.concatenate([ids, np.full(last, np.iinfo(ids.dtype).max, ids.dtype)])
    shifted = np.lib.stride_tricks.sliding_window_view(padded, n)  # row q: the words q further on
    q = first
    while q <= last:
        width = n - q
        columns = (width // 8 + 1) * 8  # at least one column is false, so no stretch goes on in the next row
        rows = min(last - q + 1, max(1, CELLS // columns))
        equal = np.zeros((rows, columns), bool)
        np.equal(shifted[q : q + rows, :width], ids[:width], out=equal[:, :width])
        lags = np.arange(q, q + rows)
        need = np.maximum(least_words, exponent * lags) - lags
        # a stretch of 15 has eight true cells that one aligned 64-bit number shows
        rows_of = np.flatnonzero((need < 15) | (equal.view(np.uint64) == _ALL_TRUE).any(axis=1))
        if len(rows_of):
            flat = equal[rows_of].ravel()
            edges = np.flatnonzero(flat[1:] != flat[:-1]) + 1
            edges = np.r_[0, edges] if flat[0] else edges
            starts, stops = edges[0::2], edges[1::2]
            of, length = starts // columns, stops - starts
            enough = length >= need[rows_of][of]
            for lag, start, stretch in zip(lags[rows_of][of[enough]].tolist(), (starts[enough] % columns).tolist(), length[enough].tolist()):
                found.setdefault((start, start + stretch + lag), lag)
        q += rows
    return found


def last_lag(n: int, least_words: int, exponent: int) -> int:
    return n // exponent if n >= least_words else 0


def ranges(n: int, least_words: int, exponent: int, comparisons: int) -> list[tuple[int, int]]:
    """Ranges of lags of a document of ``n`` words, each of about as many comparisons."""
    last = last_lag(n, least_words, exponent)
    found, first, size = [], 1, 0
    for lag in range(1, last + 1):
        size += n - lag
        if size >= comparisons or lag == last:
            found.append((first, lag))
            first, size = lag + 1, 0
    return found


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words that no run (start, length, period) has after its first period, joined by one space."""
    if not found:
        return b" ".join(words)
    dropped = bytearray(len(words))
    for start, length, period in found:
        dropped[start + period : start + length] = b"\1" * (length - period)
    return b" ".join([w for w, d in zip(words, dropped) if not d])


def _runs(column: list[list[tuple[int, int, int]]]) -> pa.Array:
    flat = np.array([r for runs in column for r in runs], dtype=np.int64).reshape(-1, 3)
    offsets = np.cumsum([0, *map(len, column)]).astype(np.int32)
    values = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(_ARROW_RUN))
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def with_runs(df: DataFrame, text: str = "text", runs: str = "runs", collapsed_text: str = "collapsed", least_words: int = LEAST_WORDS, exponent: int = EXPONENT, range_comparisons: int = RANGE_COMPARISONS) -> DataFrame:
    """Add ``runs`` (start, length, period), by start and period, and ``collapsed_text``."""
    if exponent < 2:
        raise ValueError("runs repeat their period at least twice")
    replaced = {runs.lower(), collapsed_text.lower()}
    plain, _ = shielded(df, [text])
    kept = {new: old for new, old in zip(plain.columns, df.columns) if old.lower() not in replaced}
    plain = plain.select(*kept, *([text] if text not in kept.values() else []))
    short = F.octet_length(F.col(text)) < _short(exponent, range_comparisons)
    names, inputs = ("_found_runs", "_collapsed"), plain.columns

    def one_range(text: bytes, known: list | None) -> tuple[list, bytes]:
        words = text.split()  # of bytes: at space and \t to \r
        if known is None:
            last = last_lag(len(words), least_words, exponent)
            known = [(s, e - s, q) for (s, e), q in scan(numbered(words), 1, last, least_words, exponent).items()] if last else []
        known = sorted(known, key=lambda r: (r[0], r[2]))
        return known, collapsed(words, known)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).cast(pa.binary()).to_pylist()
            known = batch.column("_known").to_pylist() if "_known" in batch.schema.names else None
            for start, stop in slices(texts):
                done = [one_range(texts[i] or b"", [(r["start"], r["length"], r["period"]) for r in known[i] or ()] if known else None) for i in range(start, stop)]
                few = batch.slice(start, stop - start).select(inputs)
                yield pa.RecordBatch.from_arrays([*few.columns, _runs([d[0] for d in done]), pa.array([d[1] for d in done], pa.binary()).cast(pa.string())], [*inputs, *names])

    schema = T.StructType([*plain.schema.fields, T.StructField(names[0], RUNS, False), T.StructField(names[1], T.StringType(), False)])
    near = plain.where(short | F.col(text).isNull()).mapInArrow(apply, schema)
    far = plain.where(~short).withColumn("_key", F.sha2(F.col(text).cast("binary"), 256))
    found = _dealt(far.select("_key", text).dropDuplicates(["_key"]), text, least_words, exponent, range_comparisons)
    met = far.join(found, "_key", "left").select(*plain.columns, "_known").mapInArrow(apply, schema)
    both = near.unionByName(met)
    return both.select(*(F.col(new).alias(old) for new, old in kept.items()), F.col(names[0]).alias(runs), F.col(names[1]).alias(collapsed_text))


def _short(exponent: int, comparisons: int) -> int:
    """Texts of fewer bytes have one range: n words take at least 2 n - 1 bytes, and at most n * n / ``exponent`` comparisons."""
    return int(2 * (comparisons * exponent) ** 0.5)


def _dealt(texts: DataFrame, text: str, least_words: int, exponent: int, comparisons: int) -> DataFrame:
    """(_key, _known) of long texts: ranges of lags go to tasks of their own, with the word numbers alone."""

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, value in zip(batch.column("_key").to_pylist(), batch.column(text).cast(pa.binary())):
                ids = numbered(value.as_py().split()).astype("<u4")
                for first, last in ranges(len(ids), least_words, exponent, comparisons):
                    yield pa.RecordBatch.from_pydict({"_key": [key], "first": [first], "last": [last], "ids": [ids.tobytes()]})

    def scans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, first, last, raw in zip(*(batch.column(c).to_pylist() for c in ("_key", "first", "last", "ids"))):
                found = scan(np.frombuffer(raw, "<u4"), first, last, least_words, exponent)
                rows = np.array([(s, e - s, q) for (s, e), q in found.items()], dtype=np.int64).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(rows), pa.string()), *(pa.array(rows[:, i]) for i in range(3))], ["_key", "start", "length", "period"])

    dealt = texts.mapInArrow(units, "_key string, first long, last long, ids binary").repartition("_key", "first")
    found = dealt.mapInArrow(scans, "_key string, start long, length long, period long")
    least = found.groupBy("_key", "start", "length").agg(F.min("period").alias("period"))
    return least.groupBy("_key").agg(F.collect_list(F.struct("start", "length", "period")).alias("_known"))  # fewer than the document has words


def longest(runs: str = "runs"):
    """The run of greatest length, of equal ones the first, of these the one of the smallest period."""
    first = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.when(first.isNotNull(), F.struct((-first["start"]).alias("start"), first["length"].alias("length"), (-first["period"]).alias("period")))
