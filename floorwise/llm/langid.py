"""Language identification by averaged hashed subword embeddings and a linear softmax.

Words are runs of letters with a boundary mark at both ends. Every character n-gram of a word of one to
``LONGEST`` characters, boundary marks included, is hashed to one of ``BUCKETS`` rows of an embedding
table; a text is the mean of its n-grams' rows, and a linear softmax over that mean gives the
language. Both are trained by stochastic gradient descent in numpy. Held back examples calibrate
the softmax by one temperature, and give the score under which a prediction is rejected:
the least one at which those that score as much are right as often as is asked.

Training takes a bounded sample: of every language at most ``per_language`` distinct texts, those of
smallest hash, fewer where there are very many languages, and of each a stretch of at most ``piece`` characters that begins anywhere in the text.
Prediction takes every text whole, in blocks that keep sums of each text alone.

Defined results: a null text, an empty one and one without a letter are ``UNKNOWN`` with a score of
0 and are rejected; so is every text if nothing was there to learn from; null labels are not learned
from; repeated rows are predicted alike and learned from once; of equal scores the
language that sorts first wins; an empty table stays empty; other columns pass through unchanged
(an existing column of an output's name is replaced).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from floorwise.llm.shared import slices

UNKNOWN = "und"
BUCKETS, WIDTH, LONGEST = 1 << 16, 16, 4
#: The sample: texts of each language, of all languages, characters of each, and languages at most (those of most texts).
PER_LANGUAGE, IN_ALL, PIECE, MOST_LANGUAGES = 1500, 40_000, 600, 1000
#: Training: passes and steps at least, examples in a step, first step size; every fifth example is held back for calibration.
PASSES, STEPS, BATCH, RATE = 4, 600, 32, 2.0
#: How often predictions that are not rejected are to be right.
PRECISION = 0.99
#: Code points of text that are hashed in one go.
BLOCK = 1 << 19


_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def code_points(text: str) -> np.ndarray:
    """A text's letters in lower case between boundary marks, which are 0."""
    found = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(letters()[found], found, 0).astype(np.uint32)


def subwords(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of words in ``points``, and where each begins, in order of n.

    An n-gram holds no boundary mark inside, and at least one letter.
    """
    inner = points != 0
    hashed = np.zeros(len(points), np.uint64)
    buckets, places = [], []
    unbroken = np.ones(len(points), bool)  # all but the first character are letters
    for n in range(1, LONGEST + 1):
        m = len(points) - n + 1
        if m <= 0:
            break
        with np.errstate(over="ignore"):
            hashed = (hashed[:m] ^ (points[n - 1 :].astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
            hashed ^= hashed >> np.uint64(29)
        if n > 2:
            unbroken = unbroken[:m] & inner[n - 2 : n - 2 + m]
        valid = np.flatnonzero(unbroken if n > 2 else inner[:m] | inner[n - 1 :])
        buckets.append((hashed[valid] * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(40)).astype(np.int64) % BUCKETS)
        places.append(valid)
    return (np.concatenate(buckets), np.concatenate(places)) if buckets else (np.zeros(0, np.int64), np.zeros(0, np.int64))


@dataclass
class Model:
    labels: list[str]
    embedding: np.ndarray  # BUCKETS x WIDTH
    weights: np.ndarray  # WIDTH x labels
    bias: np.ndarray
    temperature: float = 1.0
    least_score: float = 0.0

    def __post_init__(self):
        # with few languages an n-gram's share of the logits is shorter than its embedding
        self.table = self.embedding @ self.weights if len(self.labels) <= self.embedding.shape[1] else self.embedding

    def scores(self, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Calibrated probabilities from sums of ``table`` rows."""
        means = sums / np.maximum(counts, 1)[:, None]
        logits = (means if self.table is not self.embedding else means @ self.weights) + self.bias
        return softmax(logits / self.temperature)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        sums = np.zeros((len(texts), self.table.shape[1]))
        counts, lettered = np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
        for of, points in blocks(texts):
            buckets, places = subwords(points)
            rows = of[places]
            counts += np.bincount(rows, minlength=len(texts))
            for k in range(sums.shape[1]):
                sums[:, k] += np.bincount(rows, weights=self.table[buckets, k], minlength=len(texts))
            lettered[of[points != 0]] = True
        if not self.labels:
            return [(UNKNOWN, 0.0)] * len(texts)
        found = self.scores(sums, counts)
        best = found.argmax(1)
        return [(self.labels[b], float(p[b])) if has else (UNKNOWN, 0.0) for b, p, has in zip(best.tolist(), found, lettered.tolist())]


def blocks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of each code point, code points) of at most about ``BLOCK`` code points. A longer text is cut
    at boundary marks, and where it has none every ``BLOCK`` letters, so what lies around it changes nothing."""
    held, rows, size = [], [], 0
    for i, text in enumerate(texts):
        points = code_points(text or "")
        while len(points):
            cut = len(points)
            if cut > BLOCK:
                marks = np.flatnonzero(points[:BLOCK] == 0)
                cut = int(marks[-1]) + 1 if len(marks) else BLOCK
            if size and size + cut > BLOCK:
                yield np.concatenate(rows), np.concatenate(held)
                held, rows, size = [], [], 0
            held.append(np.concatenate([[0], points[:cut], [0]]).astype(np.uint32))
            rows.append(np.full(cut + 2, i))
            size += cut + 2
            points = points[cut:]
    if held:
        yield np.concatenate(rows), np.concatenate(held)


def softmax(logits: np.ndarray) -> np.ndarray:
    shifted = np.exp(logits - logits.max(1, keepdims=True))
    return shifted / shifted.sum(1, keepdims=True)


def fitted(examples: list[tuple[str, str]], seed: int = 1, precision: float = PRECISION) -> Model:
    """A model of (text, language) examples in a given order, so that equal examples give equal models."""
    labels = sorted({lang for _, lang in examples})
    number = {lang: i for i, lang in enumerate(labels)}
    rows = []
    for text, lang in examples:
        buckets, _ = subwords(np.concatenate([[0], code_points(text), [0]]).astype(np.uint32))
        if len(buckets):
            ids, times = np.unique(buckets, return_counts=True)
            rows.append((ids, (times / times.sum()).astype(np.float32), number[lang]))
    held = rows[4::5] or rows
    learned = [r for i, r in enumerate(rows) if i % 5 != 4 or held is rows]
    draw = np.random.default_rng(seed)
    embedding = draw.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    weights, bias = np.zeros((WIDTH, len(labels)), np.float32), np.zeros(len(labels), np.float32)
    # languages count alike however many texts they have
    sizes = np.bincount([r[2] for r in learned], minlength=len(labels)).astype(np.float32)
    balance = len(learned) / np.maximum(sizes, 1) / max(len(labels), 1)
    in_pass, done = max(1, -(-len(learned) // BATCH)), 0
    passes = max(PASSES, -(-STEPS // in_pass)) if learned else 0
    steps = passes * in_pass
    for _ in range(passes):
        order = draw.permutation(len(learned))
        for start in range(0, len(order), BATCH):
            some = [learned[i] for i in order[start : start + BATCH]]
            rate = RATE * (1 - done / steps)
            done += 1
            ids, shares = np.concatenate([r[0] for r in some]), np.concatenate([r[1] for r in some])
            starts = np.cumsum([0, *(len(r[0]) for r in some[:-1])])
            of = np.repeat(np.arange(len(some)), [len(r[0]) for r in some])
            right = np.array([r[2] for r in some])
            hidden = np.add.reduceat(embedding[ids] * shares[:, None], starts, axis=0)
            wrong = softmax(hidden @ weights + bias)
            wrong[np.arange(len(some)), right] -= 1
            wrong *= balance[right][:, None] / len(some)
            back = wrong @ weights.T
            weights -= rate * hidden.T @ wrong
            bias -= rate * wrong.sum(0)
            # gradients of one bucket are summed over its places
            step = shares[:, None] * back[of] * (rate * BATCH)
            by = np.argsort(ids, kind="stable")
            first = np.flatnonzero(np.r_[True, ids[by][1:] != ids[by][:-1]])
            embedding[ids[by][first]] -= np.add.reduceat(step[by], first, axis=0)
    model = Model(labels, embedding, weights, bias)
    if held:
        _calibrate(model, held, precision)
    return model


def _calibrate(model: Model, held: list[tuple], precision: float) -> None:
    """One temperature of least loss on the held back examples, and the least score to accept."""
    hidden = np.stack([(model.embedding[ids] * shares[:, None]).sum(0) for ids, shares, _ in held])
    right = np.array([r[2] for r in held])
    logits = hidden @ model.weights + model.bias
    loss = lambda t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(right)), right], 1e-12)).mean()
    model.temperature = float(min(np.exp(np.linspace(-4, 3, 141)), key=loss))
    found = softmax(logits / model.temperature)
    score, hit = found.max(1), found.argmax(1) == right
    order = np.argsort(-score, kind="stable")
    enough = np.flatnonzero(np.cumsum(hit[order]) >= precision * np.arange(1, len(order) + 1))
    model.least_score = float(score[order][enough[-1]]) if len(enough) else 1.0


def sample(df: DataFrame, text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, piece: int = PIECE) -> list[tuple[str, str]]:
    """At most ``per_language`` (stretch, language) of each of at most ``MOST_LANGUAGES`` languages, by hash of the text."""
    known = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    sizes = known.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
    per_language = min(per_language, IN_ALL // max(1, sizes.count()))
    share = 2.0 * per_language / F.greatest("n", F.lit(1))
    drawn = known.join(F.broadcast(sizes), "lang").where(F.pmod(F.xxhash64("h"), F.lit(1 << 31)) < share * (1 << 31))
    room = F.greatest(F.length("text") - piece + 1, F.lit(1))
    # of a whole text some stretch, which the text's hash chooses
    stretch = F.substr("text", F.pmod(F.xxhash64("h", F.lit(7)), room.cast("long")).cast("int") + 1, F.lit(piece))
    few = drawn.select("lang", "h", stretch.alias("text")).dropDuplicates(["lang", "h"])
    ranked = few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("h"), "h")))  # about twice per_language rows of each
    rows = ranked.where(F.col("r") <= per_language).select("text", "lang").collect()
    return sorted(((r.text, r.lang) for r in rows), key=lambda e: (hash_of(e[0]), e))


def hash_of(text: str) -> int:
    from zlib import crc32

    return crc32(text.encode("utf-8", "surrogatepass"))


def train(df: DataFrame, text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, piece: int = PIECE, precision: float = PRECISION) -> Model:
    return fitted(sample(df, text, lang, per_language, piece), precision=precision)


def identified(df: DataFrame, model: Model, text: str = "text", out: str = "lang_pred", score: str = "score", rejected: str = "rejected") -> DataFrame:
    """Add the language of every whole text, its calibrated score, and whether the score is too low."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows, and WIDTH numbers for each of at most MOST_LANGUAGES
    made = [T.StructField(out, T.StringType(), False), T.StructField(score, T.DoubleType(), False), T.StructField(rejected, T.BooleanType(), False)]
    kept = [f for f in df.schema.fields if f.name.lower() not in {m.name.lower() for m in made}]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(text).to_pylist()
            for start, stop in slices(texts, 1 << 20):
                found = model.predict(texts[start:stop])
                few = batch.slice(start, stop - start)
                columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[0] == UNKNOWN or f[1] < model.least_score for f in found], pa.bool_())]
                yield pa.RecordBatch.from_arrays([*(few.column(n) for n in names), *columns], [*names, out, score, rejected])

    return df.mapInArrow(run, T.StructType([*kept, *made]))


def held_out(doc_id: str = "doc_id", parts: int = 5) -> Column:
    """Whether an id's CRC-32 is divisible by ``parts``; a null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts == 0, F.lit(True))
