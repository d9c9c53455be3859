"""BPE encoding and decoding by a pair occurrence index.

New pre-tokens of a stretch of documents are laid out in one symbol array. An index maps
each adjacent pair that has a merge rank to all its positions; active ranks are applied in
ascending order, each to all its positions from left to right, and the lists of the pairs
that a merge makes are updated. A pre-token is encoded once while a bounded cache holds it.

Defined results: a null text encodes as an empty one; null ids decode to an empty text; texts
of any length are encoded whole; repeated rows and ties are encoded alike; an empty table stays
empty; all other columns pass through unchanged (an existing column of an output's name is
replaced).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from floorwise.llm.shared import slices

#: Pre-tokens in each of the two generations of a worker's cache. A full generation becomes
#: the older one, of which only what is used again moves on.
CACHE_ENTRIES = 120_000
#: Text that is encoded in one go: the longer, the more positions an active rank has.
STRETCH = 3 << 20
#: A rank with fewer positions is applied one by one, without array operations.
FEW = 24

#: Letters, numbers and white space below U+0250, where all Unicode versions agree.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_FAST = re.compile(rf" ?[{_L}]++|'(?:[stmd]|re|ve|ll)| ?[{_N}]++| ?[^{_S}{_L}{_N}]++|[{_S}]+(?![^{_S}])|[{_S}]+")
_BEYOND = re.compile("[^\x00-\u024f]")
_CUT = re.compile(r" (?=\S)")


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PairIndexBPE:
    """A byte-level BPE vocabulary in the tokenizers library's JSON format."""

    def __init__(self, source: str):
        from tokenizers import Tokenizer

        spec = json.loads(source)
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or before.get("type") != "ByteLevel" or spec["normalizer"]:
            raise ValueError("a byte-level BPE vocabulary without a normalizer is needed")
        if before["add_prefix_space"] or not before["use_regex"] or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("prefix spaces, own patterns, ignore_merges and dropout are not supported")
        vocab, stand_in = model["vocab"], byte_alphabet()
        self.byte_id = np.array([vocab[stand_in[b]] for b in range(256)], dtype=np.int64)
        self.special = {}
        for added in spec["added_tokens"] or ():
            if added["lstrip"] or added["rstrip"] or added["single_word"] or added["normalized"]:
                raise ValueError("added tokens with options are not supported")
            self.special[added["content"]] = np.array([added["id"]], dtype="<u4").tobytes()
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.left, self.right, self.made, self.rank = [], [], [], {}
        for r, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.left.append(vocab[a])
            self.right.append(vocab[b])
            self.made.append(vocab[a + b])
            self.rank.setdefault(vocab[a] << 32 | vocab[b], r)
        self.keys = np.array(sorted(self.rank), dtype=np.int64)
        self.ranks = np.array([self.rank[k] for k in self.keys.tolist()], dtype=np.int64)
        self.pre_tokenizer = Tokenizer.from_str(source).pre_tokenizer
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.most = CACHE_ENTRIES

    def pre_tokens(self, text: str) -> list[str]:
        """The pre-tokens of a text without special tokens.

        Beyond U+024F pattern engines differ by Unicode version, so the library's own
        pre-tokenizer splits such parts. They are cut before a space that a non-space
        follows, where a pre-token begins in any case.
        """
        if not _BEYOND.search(text):
            return _FAST.findall(text)
        first, *rest = _CUT.split(text)
        found: list[str] = []
        for piece in [first, *(" " + p for p in rest)]:
            found += [piece[a:b] for _, (a, b) in self.pre_tokenizer.pre_tokenize_str(piece)] if _BEYOND.search(piece) else _FAST.findall(piece)
        return found

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each pre-token as little-endian unsigned 32-bit integers."""
        raw = [w.encode() for w in words]
        joined = np.frombuffer(b"\0".join(raw) + b"\0", dtype=np.uint8)
        ends = np.cumsum([len(b) + 1 for b in raw]) - 1
        laid = self.byte_id[joined]
        laid[ends] = -1  # no pair reaches over the end of a pre-token
        pairs = laid[:-1] << 32 | (laid[1:] & 0xFFFFFFFF)
        pairs[(laid[:-1] < 0) | (laid[1:] < 0)] = -1
        found = np.searchsorted(self.keys, pairs)
        found[found == len(self.keys)] = 0
        at = np.flatnonzero(self.keys[found] == pairs) if len(self.keys) else np.zeros(0, dtype=np.int64)
        of = self.ranks[found[at]] if len(at) else at
        order = np.argsort(of, kind="stable")
        at, of = at[order], of[order]
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else of
        index = {int(of[s]): at[s:e].tolist() for s, e in zip(first, [*first[1:], len(at)])}

        self._merge(laid, index)
        kept = laid >= 0
        ids = laid[kept].astype("<u4").tobytes()
        upto = (np.cumsum(kept)[ends] * 4).tolist()
        return [ids[s:e] for s, e in zip([0, *upto], upto)]

    def _merge(self, laid: np.ndarray, index: dict[int, list[int]]) -> None:
        """Apply active ranks in ascending order; a symbol that a merge takes becomes -2."""
        after = np.arange(1, len(laid) + 1)
        before = np.arange(-1, len(laid) - 1)
        symbols, nexts, previous = memoryview(laid), memoryview(after), memoryview(before)
        active, rank = list(index), self.rank.get
        heapify(active)
        while active:
            r = heappop(active)
            a, b, new = self.left[r], self.right[r], self.made[r]
            places = index.pop(r)
            if len(places) < FEW or a == b:  # of overlapping places, the left one merges
                pairs = []
                for i in sorted(places):
                    j = nexts[i]
                    if symbols[i] != a or symbols[j] != b:
                        continue  # an earlier merge took one of the two
                    symbols[i], symbols[j] = new, -2
                    k = nexts[i] = nexts[j]
                    previous[k] = i
                    p = previous[i]
                    if p >= 0 and (x := symbols[p]) >= 0 and (s := rank(x << 32 | new)) is not None:
                        pairs.append((s, p))
                    if (y := symbols[k]) >= 0 and (s := rank(new << 32 | y)) is not None:
                        pairs.append((s, i))
            else:
                i = np.array(places)
                j = after[i]
                valid = (laid[i] == a) & (laid[j] == b)
                i, j = i[valid], j[valid]
                k = after[j]
                laid[i], laid[j] = new, -2
                after[i], before[k] = k, i
                p = before[i]
                x, y = laid[p], laid[k]
                x[p < 0] = -1
                has, had = x >= 0, y >= 0
                made = np.concatenate((x[has] << 32 | new, new << 32 | y[had]))
                where = np.concatenate((p[has], i[had]))
                found = np.searchsorted(self.keys, made)
                found[found == len(self.keys)] = 0
                ranked = self.keys[found] == made
                pairs = zip(self.ranks[found[ranked]].tolist(), where[ranked].tolist())
            for s, place in pairs:
                if s in index:
                    index[s].append(place)
                else:
                    index[s] = [place]
                    heappush(active, s)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        rows: list[list[bytes | list[str]]] = []
        for text in texts:
            parts: list = [text or ""]
            if self.special_pattern and any(s in parts[0] for s in self.special):
                parts = self.special_pattern.split(parts[0])
            rows.append([self.special[p] if p in self.special else self.pre_tokens(p) for p in parts if p])
        used: set[str] = set()
        for row in rows:
            for part in row:
                if type(part) is list:
                    used.update(part)
        missing = self.unknown(used)
        if missing:
            self.words.update(zip(missing, self.encode_words(missing)))
        known = self.words.__getitem__
        return [b"".join([b"".join(map(known, part)) if type(part) is list else part for part in row]) for row in rows]

    def unknown(self, used: set[str]) -> list[str]:
        """Those pre-tokens that the cache lacks; what its older generation has moves on."""
        missing = used - self.words.keys()
        if len(self.words) + len(missing) > self.most:
            self.older, self.words = self.words, {}
            missing = used
        again = missing & self.older.keys()
        self.words.update((w, self.older[w]) for w in again)
        return list(missing - again)


class Decoder:
    """The bytes that each id of a byte-level vocabulary stands for."""

    def __init__(self, source: str):
        spec, back = json.loads(source), {c: b for b, c in byte_alphabet().items()}
        tokens = {i: token for token, i in spec["model"]["vocab"].items()} | {a["id"]: a["content"] for a in spec["added_tokens"] or ()}
        self.bytes_of = {i: bytes(back[c] for c in token) if all(c in back for c in token) else token.encode() for i, token in tokens.items()}

    def decode(self, ids: bytes | None) -> str:
        """The text of ids in the form that ``encode`` gives."""
        known, out = self.bytes_of.__getitem__, []
        numbers = np.frombuffer(ids or b"", dtype="<u4")
        for start in range(0, len(numbers), 1 << 18):
            out.append(b"".join(map(known, numbers[start : start + (1 << 18)].tolist())))
        return b"".join(out).decode("utf-8", "replace")


_loaded: dict[tuple, object] = {}


def load(kind: type, source: str):
    """``kind(source)``, built once in a worker and kept until another vocabulary comes; its cache serves all tasks there."""
    key = (kind, hash(source))
    if key not in _loaded:
        for other in [k for k in _loaded if k[1] != key[1]]:
            del _loaded[other]
        _loaded[key] = kind(source)
    return _loaded[key]


def vocabulary(path: str, most_bytes: int = 64 << 20) -> str:
    """The JSON of a tokenizer, small enough to be sent to every executor."""
    with open(path, encoding="utf-8") as file:
        source = file.read(most_bytes + 1)
    if len(source) > most_bytes:
        raise ValueError(f"{path} has over {most_bytes} bytes")
    return source


def _mapped(df: DataFrame, column: str, tokenizer_path: str, ids: str | None, text: str | None) -> DataFrame:
    """Add what is named: ``ids`` of a text column, the ``text`` of these or else of an id column."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary(tokenizer_path))  # a fixed file of checked size
    made = [T.StructField(n, k, False) for n, k in ((ids, T.BinaryType()), (text, T.StringType())) if n is not None]
    kept = [f for f in df.schema.fields if f.name.lower() not in {m.name.lower() for m in made}]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(column).to_pylist()
            for start, end in slices(values, STRETCH):
                found = values[start:end]
                columns = []
                if ids is not None:
                    found = load(PairIndexBPE, shared.value).encode(found)
                    columns.append(pa.array(found, pa.binary()))
                if text is not None:
                    columns.append(pa.array(map(load(Decoder, shared.value).decode, found), pa.string()))
                few = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([*(few.column(n) for n in names), *columns], [*names, *(m.name for m in made)])

    return df.mapInArrow(run, T.StructType([*kept, *made]))


def encode(df: DataFrame, tokenizer_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids``: the text's ids as little-endian unsigned 32-bit integers, in one BINARY."""
    return _mapped(df, text, tokenizer_path, ids, None)


def decode(df: DataFrame, tokenizer_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add ``text``: what the ids stand for; bytes that are no UTF-8 become U+FFFD."""
    return _mapped(df, ids, tokenizer_path, None, text)


def encode_and_decode(df: DataFrame, tokenizer_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``decode`` of ``encode`` in one pass, so that a task has one worker."""
    return _mapped(df, text, tokenizer_path, ids, decoded)
