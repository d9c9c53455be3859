"""Benchmark decontamination with an Aho-Corasick automaton over normalised items.

An item's windows of ``window`` consecutive words (an item of fewer words is one window)
are patterns of word numbers in one automaton. A text is normalised to words, the words to
numbers (0 where no pattern has the word), and the numbers are scanned once. Hits are spans
of words; ``spans`` maps them to byte offsets of the original text.

Items are counted before any is sent to the executors. Items of more windows than one
automaton may hold are dealt to several by a hash, and the texts are scanned once for each,
with the hits written in between; so only one automaton's items are ever in a process.

Defined results: a null text has no words; a null item id counts as the string ``null``;
items of no words match nothing; equal items and repeated rows all count; texts of any length
are scanned whole, a batch of them piece by piece; empty documents give an empty table and an
empty benchmark no hits; documents' own columns with the names of ``FOUND`` give way to these.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from floorwise.llm.shared import Written, fresh, shielded, slices

WINDOW = 10
#: Windows that one automaton may hold; further items get automata of their own.
MOST_WINDOWS = 400_000

_DIGITS, _UPPER, _LOWER = range(0x30, 0x3A), range(0x41, 0x5B), range(0x61, 0x7B)
_TABLE = bytes(b + 32 if b in _UPPER else b if b in _DIGITS or b in _LOWER or b >= 0x80 else 0x20 for b in range(256))
_WORD = re.compile(rb"[^\x20]+")


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words: ASCII letters and digits and all that is not ASCII."""
    return (text or "").encode().translate(_TABLE).split()


class Automaton:
    """Patterns of one block of items."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        import ahocorasick

        self.numbers: dict[bytes, int] = {}
        patterns: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            words = words_of(text)
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                patterns.setdefault(tuple(ids[i : i + window]), set()).add(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for pattern, owners in patterns.items():
            self.automaton.add_word(pattern, (len(pattern), tuple(owners)))
        self.empty = not patterns
        self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> Iterator[tuple[int, int, tuple[str, ...]]]:
        """First word, end and items of each occurrence."""
        if self.empty or not words:
            return
        numbers = tuple(map(self.numbers.get, words, repeat(0)))
        for last, (length, owners) in self.automaton.iter(numbers):
            yield last + 1 - length, last + 1, owners


_built: dict[tuple, Automaton] = {}


def _automaton(digest: str, items: list[tuple[str, str]], window: int) -> Automaton:
    """The items' automaton, built once in a process as long as it scans for the same items."""
    if (digest, window) not in _built:
        _built.clear()
        _built[digest, window] = Automaton(items, window)
    return _built[digest, window]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans joined where they touch or overlap."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def original_offsets(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte offsets in the text's UTF-8 of spans of words."""
    at = [m.span() for m in _WORD.finditer(text.encode().translate(_TABLE))] if spans else []
    return [(at[s][0], at[e - 1][1]) for s, e in spans]


FOUND = T.StructType([
    T.StructField("n_words", T.LongType(), False),
    T.StructField("n_hit", T.LongType(), False),
    T.StructField("n_items", T.LongType(), False),
    T.StructField("items", T.ArrayType(T.StringType(), False), False),
    T.StructField("items_sha256", T.StringType(), False),
    T.StructField("contaminated", T.BooleanType(), False),
    T.StructField("hit_spans", T.ArrayType(T.ArrayType(T.LongType(), False), False), False),
])
_ARROW = {"n_words": pa.int64(), "n_hit": pa.int64(), "n_items": pa.int64(), "items": pa.list_(pa.string()), "items_sha256": pa.string(), "contaminated": pa.bool_(), "hit_spans": pa.list_(pa.list_(pa.int64()))}


_HIT = T.ArrayType(T.StructType([T.StructField("s", T.LongType()), T.StructField("e", T.LongType()), T.StructField("item", T.StringType())]))
_HIT_ARROW = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64()), ("item", pa.string())]))


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", item_id: str = "item_id", item_text: str = "text", keep_text: bool = False) -> DataFrame:
    """Add ``FOUND`` to each document: counts, items and hit spans as byte offsets of its text."""
    known = benchmark.where(F.col(item_text).isNotNull()).select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("id"), F.col(item_text).alias("text"))
    windows = F.greatest(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")) - (window - 1), F.lit(1))
    total = known.agg(F.sum(windows)).first()[0] or 0
    parts = max(1, -(-total // MOST_WINDOWS))
    made = {f.name for f in FOUND.fields}
    plain = docs.select(*(c for c in docs.columns if c.lower() not in made))
    names = [c for c in plain.columns if keep_text or c != text]
    hits = fresh(plain, "hits")
    for part in range(parts):
        items = known if parts == 1 else known.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == part)
        plain = _scanned(plain, sorted(map(tuple, items.toLocalIterator())), window, text, hits, names, part == parts - 1)
        if part < parts - 1:
            plain = Written(plain, "hits").df
    return plain


def _scanned(docs: DataFrame, items: list[tuple[str, str]], window: int, text: str, hits: str, names: list[str], last: bool) -> DataFrame:
    """One automaton's hits: added to the column ``hits``, or at last summed up with it as ``FOUND``."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    digest = sha256(repr(items).encode()).hexdigest()
    before = hits in docs.columns
    passed = names if last else [c for c in docs.columns if c != hits]
    kinds = {f.name: f for f in docs.schema.fields}

    def found(value: str | None, spans: list[dict], n: int) -> tuple:
        joined = merged([(x["s"], x["e"]) for x in spans])
        owners = sorted({x["item"] for x in spans})
        return n, sum(e - s for s, e in joined), len(owners), owners, sha256(",".join(owners).encode()).hexdigest(), bool(joined), [list(x) for x in original_offsets(value or "", joined)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(digest, shared.value, window)
        for batch in batches:
            texts = batch.column(text).to_pylist()
            for start, end in slices(texts):
                few = batch.slice(start, end - start)
                earlier = few.column(hits).to_pylist() if before else repeat([])
                rows, counts = [], []
                for value, own in zip(texts[start:end], earlier):
                    words = words_of(value)
                    counts.append(len(words))
                    rows.append([*own, *({"s": s, "e": e, "item": o} for s, e, several in automaton.scan(words) for o in several)])
                if last:
                    rows = [found(*x) for x in zip(texts[start:end], rows, counts)]
                    columns = {k: pa.array([r[i] for r in rows], kind) for i, (k, kind) in enumerate(_ARROW.items())}
                else:
                    columns = {hits: pa.array(rows, _HIT_ARROW)}
                yield pa.RecordBatch.from_arrays([*(few.column(n) for n in passed), *columns.values()], [*passed, *columns])

    added = FOUND.fields if last else [T.StructField(hits, _HIT)]
    return docs.mapInArrow(run, T.StructType([*(kinds[n] for n in passed), *added]))


def decontaminated(docs: DataFrame, benchmark: DataFrame, most_share: float = 0.0, **options) -> DataFrame:
    """Documents of which at most ``most_share`` of the words lie in benchmark windows."""
    plain, back = shielded(docs, [options.get("text", "text")])
    found = scan(plain, benchmark, keep_text=True, **options)
    return back(found.where(F.col("n_hit") <= F.col("n_words") * F.lit(most_share)))
