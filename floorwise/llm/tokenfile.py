"""Token-id files: ids in blocks, each block transposed into bit or byte planes.

A file holds consecutive documents: a header, the documents' ids and lengths, a chunk index
and the planes. Blocks have a fixed number of ids; every plane of a block is compressed
with zstandard by itself and the chunk index gives its place, so a reader decodes only
the blocks it needs. Files are the rows of a Parquet dataset (``payload`` is the file), so
Spark's writers commit them in any store and a lost executor's files are made again.

Documents go by ascending id into range partitions and in order into files; (part, file)
orders the files. Texts are encoded by the tokenizers library, of which each distinct
pre-token is asked once while the worker's cache holds it.

Defined results: a null text is an empty document, of the end id alone; null ids come
first; rows of one id follow each other, ordered by text; an empty table gives no files. A
text of any length is written whole, in as many blocks as it takes. Files hold ids and lengths
alone: other columns of the documents are not written, whatever their names.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from floorwise.llm import bpe
from floorwise.llm.shared import slices

MAGIC = b"FWTK0001"
BLOCK_IDS, FILE_IDS = 1 << 16, 1 << 19
LEVEL = 1


def to_planes(block: np.ndarray, kind: str) -> list[bytes]:
    """Planes of a block of unsigned 32-bit ids, the lowest bits first."""
    octets = block.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [octets[:, i].tobytes() for i in range(4)]
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(bits[:, i]).tobytes() for i in range(32)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "byte":
        return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).reshape(-1).view("<u4")
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")


def pack(doc_ids: list[int | None], documents: list[bytes], kind: str = "byte", block_ids: int = BLOCK_IDS) -> bytes:
    """One file of documents whose ids are little-endian unsigned 32-bit integers."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=LEVEL).compress
    ids = np.frombuffer(b"".join(documents), dtype="<u4")
    index, body, at = [], [], 0
    for start in range(0, len(ids), block_ids):
        for plane in to_planes(ids[start : start + block_ids], kind):
            body.append(squeeze(plane))
            index.append(at)
            at += len(body[-1])
    index.append(at)
    known = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    missing = np.packbits([d is None for d in doc_ids]).tobytes()
    table = squeeze(known.tobytes() + np.array([len(d) // 4 for d in documents], dtype="<i8").tobytes() + missing)
    places = squeeze(np.array(index, dtype="<i8").tobytes())
    head = json.dumps({"documents": len(documents), "ids": len(ids), "block_ids": block_ids, "planes": kind, "table": len(table), "index": len(places)}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, table, places, *body])


class TokenFile:
    """Reads documents or any range of ids from a packed file."""

    def __init__(self, payload: bytes):
        import zstandard

        if payload[:8] != MAGIC:
            raise ValueError("this is no token file")
        self._open = zstandard.ZstdDecompressor().decompress
        size = struct.unpack_from("<I", payload, 8)[0]
        self.head = json.loads(payload[12 : 12 + size])
        at, n = 12 + size, self.head["documents"]
        table = self._open(payload[at : at + self.head["table"]])
        missing = np.unpackbits(np.frombuffer(table, np.uint8, offset=16 * n), count=n)
        self.doc_ids = [None if m else d for d, m in zip(np.frombuffer(table, "<i8", n).tolist(), missing.tolist())]
        self.lengths = np.frombuffer(table, "<i8", n, 8 * n)
        at += self.head["table"]
        self.index = np.frombuffer(self._open(payload[at : at + self.head["index"]]), "<i8")
        self.body, self.payload = at + self.head["index"], payload

    def block(self, number: int) -> np.ndarray:
        each = 4 if self.head["planes"] == "byte" else 32
        size = self.head["block_ids"]
        n = min(size, self.head["ids"] - number * size)
        spans = self.index[number * each : number * each + each + 1] + self.body
        return from_planes([self._open(self.payload[s:e]) for s, e in zip(spans, spans[1:])], n, self.head["planes"])

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file; only their blocks are decoded."""
        size = self.head["block_ids"]
        if stop <= start:
            return np.zeros(0, dtype="<u4")
        first = start // size
        found = np.concatenate([self.block(b) for b in range(first, (stop - 1) // size + 1)])
        return found[start - first * size : stop - first * size]


class LibraryBPE(bpe.PairIndexBPE):
    """The same pre-tokens and cache, with ids from the tokenizers library."""

    def __init__(self, source: str):
        super().__init__(source)
        import os

        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.most = 300_000  # no second Python stage shares the executor's memory here
        self.library = Tokenizer.from_str(source)
        self.library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)  # words are split already
        self.library.no_truncation()
        self.library.no_padding()

    def encode_words(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for start in range(0, len(words), 5000):
            some = words[start : start + 5000]
            found = self.library.encode(some, is_pretokenized=True, add_special_tokens=False)
            raw = np.array(found.ids, dtype="<u4").tobytes()
            ends = (np.searchsorted(np.array(found.word_ids), np.arange(len(some)), side="right") * 4).tolist()
            out += [raw[s:e] for s, e in zip([0, *ends], ends)]
        return out


FILES = "part int, file long, first_id long, documents long, ids long, payload binary"


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, kind: str = "byte", id_column: str = "doc_id", text: str = "text") -> None:
    """Encode texts, append ``end_id`` to each, and write the files in ascending order of ids."""
    shared = docs.sparkSession.sparkContext.broadcast(bpe.vocabulary(tokenizer_path))
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, file, ids, documents, size = TaskContext.get().partitionId(), 0, [], [], 0

        def full() -> pa.RecordBatch:
            row = [part, file, ids[0], len(ids), size // 4, pack(ids, documents, kind)]
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], ["part", "file", "first_id", "documents", "ids", "payload"])

        library = bpe.load(LibraryBPE, shared.value)
        for batch in batches:
            texts, of = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for start, stop in slices(texts, bpe.STRETCH):
                for doc, found in zip(of[start:stop], library.encode(texts[start:stop])):
                    ids.append(doc)
                    documents.append(found + end)
                    size += len(documents[-1])
                    if size >= 4 * FILE_IDS:
                        yield full()
                        file, ids, documents, size = file + 1, [], [], 0
        if ids:
            yield full()

    ordered = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text")).repartitionByRange(F.col("id")).sortWithinPartitions("id", "text")
    files = ordered.mapInArrow(run, FILES)
    files.write.option("compression", "uncompressed").option("parquet.block.size.row.check.min", "2").option("parquet.block.size", str(16 << 20)).parquet(path)


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row per document: part, file, doc_id, place in the file, n_tokens, ids, ids_crc32."""
    names = ["part", "file", "doc_id", "at", "n_tokens", "ids_crc32", *["ids"] * with_ids]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * with_ids]
    schema = "part int, file long, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, file, payload in zip(*(batch.column(i).to_pylist() for i in range(3))):
                opened = TokenFile(payload)
                raw = opened.ids(0, opened.head["ids"]).tobytes()
                ends = np.cumsum(opened.lengths).tolist()
                starts = [0, *ends[:-1]]
                each = [raw[4 * s : 4 * e] for s, e in zip(starts, ends)]
                columns = [[part] * len(each), [file] * len(each), opened.doc_ids, starts, opened.lengths.tolist(), [crc32(x) for x in each], each]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return spark.read.schema(FILES).parquet(path).select("part", "file", "payload").mapInArrow(run, schema)


def starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, file, before): the ids of all files before each, from the files' headers alone."""
    files = spark.read.schema(FILES).parquet(path).select("part", "file", "ids")
    parts = files.groupBy("part").agg(F.sum("ids").alias("of_part"))  # a row for each partition of the writer
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("of_part").over(earlier), F.lit(0)).alias("parts_before"))
    inside = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("part", "file", F.coalesce(F.sum("ids").over(inside), F.lit(0)).alias("files_before"))
    return files.join(parts, "part").select("part", "file", (F.col("parts_before") + F.col("files_before")).alias("before"))


def documents(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Documents as read back, with ``start``: the ids of all documents before each."""
    found = read(spark, path, with_ids).join(starts(spark, path), ["part", "file"])
    return found.select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
