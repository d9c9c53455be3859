"""Rasters: decoding, binarisation, morphology, labelling, noise and gap repair.

An image is a row (file, width, height, pixels BINARY of one byte a pixel). Kernels take
one image at a time in Arrow batches; statistics over components are relational.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floorwise.operators.spatial import nearest
from floorwise.sources.scratch import Written

SCHEMA = "file string, width int, height int, pixels binary"


def decode_png(content: bytes) -> np.ndarray:
    """A PNG without interlacing as (height, width, channels) of 8 bits; palettes become colours."""
    if content[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, data, width, height, colour, depth, palette, clear = 8, [], 0, 0, 0, 8, b"", b""
    while at < len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
            if interlace:
                raise ValueError("interlaced PNGs are not read")
        elif kind == b"PLTE":
            palette = body
        elif kind == b"tRNS":
            clear = body
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    n, line = max(1, channels * depth // 8), -(-width * channels * depth // 8)  # bytes of a pixel and of a row
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, 1 + line)
    out = np.zeros((height, line), np.uint8)
    above = np.zeros(line, np.int64)
    for y in range(height):
        kind, row = int(raw[y, 0]), raw[y, 1:].astype(np.int64)
        if kind == 2:
            row = row + above & 255
        elif kind:
            for x in range(line):
                left = row[x - n] if x >= n else 0
                corner = above[x - n] if x >= n else 0
                if kind == 1:
                    guess = left
                elif kind == 3:
                    guess = (left + above[x]) // 2
                else:
                    p = left + above[x] - corner
                    guess = min((left, above[x], corner), key=lambda v: abs(p - v))
                row[x] = row[x] + guess & 255
        out[y] = above = row
    if depth == 16:
        values = out[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(out, axis=1)[:, : width * depth].reshape(height, width, depth)
        values = bits @ (1 << np.arange(depth)[::-1])
        values = values if colour == 3 else values * 255 // ((1 << depth) - 1)
    else:
        values = out
    image = np.asarray(values, np.uint8).reshape(height, width, channels)
    if colour != 3:
        return image
    colours = np.frombuffer(palette, np.uint8).reshape(-1, 3)[image[..., 0]]
    if not clear:
        return colours
    alpha = np.full(len(palette) // 3, 255, np.uint8)
    alpha[: len(clear)] = np.frombuffer(clear, np.uint8)
    return np.dstack([colours, alpha[image[..., 0]]])


def decode_bmp(content: bytes) -> np.ndarray:
    """An uncompressed bitmap of 8, 24 or 32 bits a pixel as (height, width, 3)."""
    start, head, width, height, _, bits, packed = struct.unpack("<I", content[10:14]) + struct.unpack("<IiiHHI", content[14:34])
    if bits not in (8, 24, 32) or packed not in (0, 3):
        raise ValueError("only uncompressed bitmaps of 8, 24 and 32 bits are read")
    line = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(content, np.uint8, line * abs(height), start).reshape(abs(height), line)[:, : width * bits // 8]
    rows = rows[::-1] if height > 0 else rows
    if bits == 8:
        used = struct.unpack("<I", content[46:50])[0] or 256
        return np.frombuffer(content, np.uint8, 4 * used, 14 + head).reshape(-1, 4)[rows][..., 2::-1]
    return rows.reshape(abs(height), width, bits // 8)[..., 2::-1]


def decode_pnm(content: bytes) -> np.ndarray:
    """A portable bitmap, grey map or pixel map, plain or raw, as (height, width, channels)."""
    fields, at = [], 2
    plain, kind = content[1:2] in b"123", int(content[1:2]) % 3  # 1: bits, 2: grey, 0: colours
    while len(fields) < (2 if kind == 1 else 3):
        found = re.match(rb"(?:\s|#[^\n]*\n)*(\d+)", content[at:])
        fields.append(int(found[1]))
        at += found.end()
    width, height, most, channels = fields[0], fields[1], fields[2] if kind != 1 else 1, 3 if kind == 0 else 1
    if plain:
        body = re.sub(rb"#[^\n]*", b"", content[at:])
        values = np.array(re.findall(rb"[01]" if kind == 1 else rb"\d+", body)[: width * height * channels], int)
    elif kind == 1:
        line = -(-width // 8)
        values = np.unpackbits(np.frombuffer(content, np.uint8, line * height, at + 1).reshape(height, line), axis=1)[:, :width].astype(int)
    else:
        values = np.frombuffer(content, ">u2" if most > 255 else np.uint8, width * height * channels, at + 1).astype(int)
    image = (values * 255 // most).astype(np.uint8).reshape(height, width, channels)
    return 255 - image if kind == 1 else image  # a set bit is black


def decode(content: bytes) -> np.ndarray:
    """An image of any of the formats above."""
    if content[:2] == b"BM":
        return decode_bmp(content)
    return decode_pnm(content) if re.match(rb"P[1-6]\s", content) else decode_png(content)


def resized(image: np.ndarray, width: int, height: int, lobes: int = 3) -> np.ndarray:
    """A grey image in another size, each axis weighted by Lanczos' kernel, which widens when the image shrinks."""

    def weights(old: int, new: int) -> np.ndarray:
        scale = old / new
        wide = max(scale, 1.0)
        away = (np.arange(old)[None, :] + 0.5 - (np.arange(new)[:, None] + 0.5) * scale) / wide
        w = np.where(np.abs(away) < lobes, np.sinc(away) * np.sinc(away / lobes), 0.0)
        return w / w.sum(1, keepdims=True)

    across = image.astype(float) @ weights(image.shape[1], width).T
    return np.clip(np.rint(weights(image.shape[0], height) @ across), 0, 255).astype(np.uint8)


def fitted(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """A grey image as large as fits in a frame, with its own proportions."""
    wide = image.shape[1] / image.shape[0] > width / height
    share = image.shape[1] / image.shape[0]
    return resized(image, width, max(1, int(width / share))) if wide else resized(image, max(1, int(height * share)), height)


def encode_png(grey: np.ndarray, level: int = 0) -> bytes:
    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    height, width = grey.shape
    rows = np.hstack([np.zeros((height, 1), np.uint8), grey.astype(np.uint8)]).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, level)) + chunk(b"IEND", b"")


def dimensions(files: DataFrame) -> DataFrame:
    """Width and height from the head of PNG files (file, content), without decoding."""
    number = lambda at: F.conv(F.hex(F.substring("content", at, 4)), 16, 10).cast("int")
    return files.select("file", number(17).alias("width"), number(21).alias("height"))


def grey(image: np.ndarray) -> np.ndarray:
    if image.ndim == 2:
        return image
    if image.shape[2] in (2, 4):
        alpha = image[..., -1:].astype(float) / 255
        image = image[..., :-1] * alpha + 255 * (1 - alpha)
    return np.rint(image.mean(axis=2) if image.shape[2] == 1 else image @ [0.299, 0.587, 0.114]).astype(np.uint8)


def read(files: DataFrame) -> DataFrame:
    """Grey images of PNG, BMP and portable map files (file, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                image = grey(decode(row.content))
                yield pd.DataFrame([(row.file, image.shape[1], image.shape[0], image.tobytes())], columns=["file", "width", "height", "pixels"])

    return files.select("file", "content").mapInPandas(run, SCHEMA)


def mapped(images: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Every image through a kernel of arrays."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                image = kernel(np.frombuffer(row.pixels, np.uint8).reshape(row.height, row.width)).astype(np.uint8)
                yield pd.DataFrame([(row.file, image.shape[1], image.shape[0], image.tobytes())], columns=["file", "width", "height", "pixels"])

    return images.select("file", "width", "height", "pixels").mapInPandas(run, SCHEMA)


def blurred(image: np.ndarray) -> np.ndarray:
    """A 3 x 3 binomial blur."""
    p = np.pad(image.astype(float), 1, mode="edge")
    rows = p[:-2] + 2 * p[1:-1] + p[2:]
    return np.rint((rows[:, :-2] + 2 * rows[:, 1:-1] + rows[:, 2:]) / 16).astype(np.uint8)


def otsu(image: np.ndarray) -> int:
    """The threshold of the largest variance between the classes."""
    counts = np.bincount(image.ravel(), minlength=256).astype(float)
    below, weighted = np.cumsum(counts), np.cumsum(counts * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (weighted[-1] * below / below[-1] - weighted) ** 2 / (below * above)
    return int(np.argmax(np.nan_to_num(between)))


def binary(image: np.ndarray) -> np.ndarray:
    """Walls as 255: blurred, thresholded, and turned over where walls would be the majority."""
    smooth = blurred(image)
    walls = (smooth <= otsu(smooth)) * np.uint8(255)
    return 255 - walls if walls.mean() > 127 else walls


def shifted(mask: np.ndarray, dy: int, dx: int, fill: bool) -> np.ndarray:
    out = np.full_like(mask, fill)
    h, w = mask.shape
    out[max(dy, 0) : h + min(dy, 0), max(dx, 0) : w + min(dx, 0)] = mask[max(-dy, 0) : h + min(-dy, 0), max(-dx, 0) : w + min(-dx, 0)]
    return out


def line(length: int, direction: str) -> list[tuple[int, int]]:
    half = range(-(length // 2), length - length // 2)
    return [{"h": (0, i), "v": (i, 0), "d": (i, i), "a": (i, -i)}[direction] for i in half]


def square(size: int) -> list[tuple[int, int]]:
    return [(y, x) for y, _ in line(size, "v") for _, x in line(size, "h")]


def dilated(mask: np.ndarray, element: list[tuple[int, int]]) -> np.ndarray:
    return np.logical_or.reduce([shifted(mask, dy, dx, False) for dy, dx in element])


def eroded(mask: np.ndarray, element: list[tuple[int, int]]) -> np.ndarray:
    return np.logical_and.reduce([shifted(mask, -dy, -dx, True) for dy, dx in element])


def closed(mask: np.ndarray, element: list[tuple[int, int]]) -> np.ndarray:
    return eroded(dilated(mask, element), element)


def opened(mask: np.ndarray, element: list[tuple[int, int]]) -> np.ndarray:
    return dilated(eroded(mask, element), element)


GAPS = {"small": (3, 5), "medium": (5, 7, 9), "large": (7, 11, 15)}


def directional(mask: np.ndarray, gap: str = "medium") -> np.ndarray:
    """Gaps along walls closed in four directions at several lengths."""
    out = mask.copy()
    for n in GAPS[gap]:
        for d in "hvda":
            out |= closed(mask, line(n, d))
    return out


def distance(mask: np.ndarray, most: int) -> np.ndarray:
    """Steps to the nearest set pixel, at most ``most`` + 1."""
    out, reached = np.where(mask, 0, most + 1), mask.copy()
    for n in range(1, most + 1):
        reached = dilated(reached, [(0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)])
        out = np.where(reached & (out > n), n, out)
    return out


def distance_filled(mask: np.ndarray, most: int = 10) -> np.ndarray:
    """Pixels that lie between walls nearer than ``most`` on both sides."""
    near = distance(mask, most) <= most // 2
    return mask | eroded(near, square(most // 2 * 2 + 1))


def mean_width(mask: np.ndarray) -> float:
    """Twice the mean distance of wall pixels from the background."""
    inner = distance(~mask, 32)[mask]
    return float(2 * inner.mean()) if inner.size else 1.0


def adaptive(mask: np.ndarray) -> np.ndarray:
    """Closed with a square as large as the mean wall."""
    n = max(3, int(round(mean_width(mask))) | 1)
    return closed(mask, square(n))


def labelled(mask: np.ndarray) -> np.ndarray:
    """Components of set pixels that touch, diagonals included; 0 is the background."""
    labels = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        most = labels.copy()
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                most = np.maximum(most, shifted(labels, dy, dx, 0))
        most = np.where(mask, most, 0)
        flat = np.append(0, most.ravel())  # a pixel takes the label of its label's own pixel
        most = np.where(mask, np.maximum(most, flat[most]), 0)
        if (most == labels).all():
            return np.unique(labels, return_inverse=True)[1].reshape(mask.shape)
        labels = most


def components(images: DataFrame) -> DataFrame:
    """(file, label, area, min_x, min_y, max_x, max_y) of the components of set pixels."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                labels = labelled(np.frombuffer(row.pixels, np.uint8).reshape(row.height, row.width) > 0)
                y, x = np.nonzero(labels)
                found = pd.DataFrame({"label": labels[y, x], "x": x, "y": y}).groupby("label").agg(area=("x", "size"), min_x=("x", "min"), min_y=("y", "min"), max_x=("x", "max"), max_y=("y", "max")).reset_index()
                found.insert(0, "file", row.file)
                yield found

    return images.mapInPandas(run, "file string, label long, area long, min_x long, min_y long, max_x long, max_y long")


def large_components(found: DataFrame, min_area: int = 100) -> DataFrame:
    """Components that are no noise: large next to the median, or long and not too small."""
    median = found.groupBy("file").agg(F.median("area").alias("_m"))
    w, h = F.col("max_x") - F.col("min_x") + 1, F.col("max_y") - F.col("min_y") + 1
    long = F.greatest(w, h) / F.least(w, h) > 3
    return found.join(median, "file").where((F.col("area") >= F.greatest(F.lit(min_area), 0.1 * F.col("_m"))) | ((F.col("area") >= 0.3 * min_area) & long)).drop("_m")


def wall_like(found: DataFrame, images: DataFrame) -> DataFrame:
    """Elongated components of between 20 pixels and a fifth of the image."""
    w, h = F.col("max_x") - F.col("min_x") + 1, F.col("max_y") - F.col("min_y") + 1
    whole = images.select("file", (F.col("width") * F.col("height")).alias("_all"))
    return found.join(whole, "file").where((F.col("area") > 20) & (F.col("area") < 0.2 * F.col("_all")) & (F.greatest(w, h) / F.least(w, h) > 1.5)).drop("_all")


def without_noise(mask: np.ndarray, min_area: int = 100) -> np.ndarray:
    """The mask without the components that ``large_components`` drops."""
    labels = labelled(mask)
    n = labels.max() + 1
    if n < 2:
        return mask
    area = np.bincount(labels.ravel(), minlength=n)
    y, x = np.indices(mask.shape)
    extent = lambda v: np.array([np.ptp(v[labels == i]) + 1 if i else 1 for i in range(n)])
    w, h = extent(x), extent(y)
    long = np.maximum(w, h) / np.minimum(w, h) > 3
    keep = (area >= max(min_area, 0.1 * np.median(area[1:]))) | ((area >= 0.3 * min_area) & long)
    keep[0] = False
    return keep[labels]


def enhanced(image: np.ndarray) -> np.ndarray:
    """The image with its gradient's strength added."""
    p = np.pad(image.astype(float), 1, mode="edge")
    gx, gy = (p[1:-1, 2:] - p[1:-1, :-2]) / 2, (p[2:, 1:-1] - p[:-2, 1:-1]) / 2
    return np.clip(image + np.hypot(gx, gy), 0, 255).astype(np.uint8)


def edges(image: np.ndarray, low: float = 20, high: float = 60) -> np.ndarray:
    """Gradient edges with hysteresis: weak pixels stay where they join strong ones."""
    p = np.pad(blurred(image).astype(float), 1, mode="edge")
    strength = np.hypot(p[1:-1, 2:] - p[1:-1, :-2], p[2:, 1:-1] - p[:-2, 1:-1])
    weak, now = strength >= low, strength >= high
    while True:
        more = weak & dilated(now, square(3))
        if (more == now).all():
            return now
        now = more


def segments(mask: np.ndarray, least: int = 10) -> list[tuple[int, int, int, int]]:
    """Horizontal and vertical runs of at least ``least`` set pixels, as x0, y0, x1, y1."""
    out = []
    for m, turn in ((mask, False), (mask.T, True)):
        for i, row in enumerate(m):
            ends = np.flatnonzero(np.diff(np.r_[0, row.astype(np.int8), 0]))
            for s, e in zip(ends[::2], ends[1::2]):
                if e - s >= least:
                    out.append((i, int(s), i, int(e) - 1) if turn else (int(s), i, int(e) - 1, i))
    return out


def gaps_filled(image: np.ndarray, gap: str = "medium", min_area: int = 100) -> np.ndarray:
    """Walls with gaps filled and noise removed, black on white."""
    mask = binary(image) > 0
    joined = directional(mask, gap) | distance_filled(mask, max(GAPS[gap])) | adaptive(mask)
    return np.where(without_noise(joined, min_area), 0, 255).astype(np.uint8)


def occupancy(image: np.ndarray, threshold: int = 127, thickness: int = 2) -> np.ndarray:
    """1 for obstacles: dark pixels, made thicker."""
    return dilated(image < threshold, square(thickness)).astype(np.uint8)


def black_threshold(image: np.ndarray, most_black: float = 0.3) -> int:
    """From a corner pixel of the ground; the mean instead if too much would be black."""
    ground = int(image[min(9, image.shape[0] - 1), min(9, image.shape[1] - 1)])
    threshold = max(1, ground * 2 // 3)
    return int(image.mean()) if (image < threshold).mean() > most_black else threshold


def sites(images: DataFrame, jitter: float = 0.0, below: int = 1) -> DataFrame:
    """(file, x, y) of obstacle pixels; with ``jitter`` four points around each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                at = np.flatnonzero(np.frombuffer(row.pixels, np.uint8) < below)
                for some in np.array_split(at, len(at) // (1 << 20) + 1):
                    yield pd.DataFrame({"file": row.file, "x": (some % row.width).astype(float), "y": (some // row.width).astype(float)})

    placed = images.select("file", "width", "pixels").mapInPandas(run, "file string, x double, y double")
    if not jitter:
        return placed
    around = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-jitter, jitter) for dy in (-jitter, jitter)))
    return placed.withColumn("d", F.explode(around)).select("file", (F.col("x") + F.col("d.dx")).alias("x"), (F.col("y") + F.col("d.dy")).alias("y"))


def without_outliers(points: DataFrame, neighbours: int = 18, percent: float = 1.5) -> DataFrame:
    """Points (file, x, y) without the ``percent`` whose nearest neighbours lie farthest away on average."""
    scored = Written(nearest(points.distinct().withColumn("id", F.struct("x", "y")), neighbours, ["file"]), "scored").df
    cut = scored.groupBy("file").agg(F.percentile("mean", 1 - percent / 100).alias("cut"))
    return scored.join(cut, "file").where(F.col("mean").isNull() | (F.col("mean") <= F.col("cut"))).select("file", "id.x", "id.y")


def denoised(points: DataFrame, neighbours: int = 18, percent: float = 1.5) -> DataFrame:
    """Outliers removed, and once more one percent of what is left if at least one percent went before."""
    once = without_outliers(points, neighbours, percent)
    return without_outliers(once, neighbours, 1.0) if percent >= 1 else once


#: Points of a file that one task may take.
FEW_POINTS = 200_000
#: Points of a task, and votes that are counted at once.
PART_POINTS, VOTES = 20_000, 4_000_000


def hough_lines(points: DataFrame, threshold: int = 30, apart: tuple[int, int] = (5, 5)) -> DataFrame:
    """(file, theta, rho, votes) of lines x cos(theta) + y sin(theta) = rho that enough points (file, x, y) lie on.

    Every point votes for one distance at each whole degree. Of lines within ``apart`` degrees and pixels of each
    other the one with most votes stays, of equal ones the first; beyond 179 degrees distances change their sign.
    """
    votes = _votes(points).groupBy("file", "theta", "rho").agg(F.count("*").alias("votes"))
    return _best_lines(votes.where(F.col("votes") >= threshold), apart)


def _best_lines(votes: DataFrame, apart: tuple[int, int]) -> DataFrame:
    step = lambda n: F.sequence(F.lit(-n), F.lit(n))
    around = votes.withColumn("_i", F.explode(step(apart[0]))).withColumn("_j", F.explode(step(apart[1])))
    t = F.col("theta") + F.col("_i")
    turned = (t < 0) | (t > 179)
    rivals = around.select("file", F.pmod(t, F.lit(180)).alias("theta"), (F.when(turned, -F.col("rho")).otherwise(F.col("rho")) + F.col("_j")).alias("rho"), F.struct((-F.col("votes")).alias("v"), F.col("theta").alias("t"), F.col("rho").alias("r")).alias("_rival"))
    best = rivals.groupBy("file", "theta", "rho").agg(F.min("_rival").alias("_best"))
    # a line is its own rival, so where it is the best one its votes are there as well
    return best.where((F.col("_best.t") == F.col("theta")) & (F.col("_best.r") == F.col("rho"))).select("file", "theta", "rho", (-F.col("_best.v")).alias("votes"))


def _votes(points: DataFrame, thetas: Column | None = None) -> DataFrame:
    """Points with ``theta`` from 0 to 179, or of an array of degrees, and the whole number ``rho`` nearest to their distance, halves upward."""
    turned = points.select("file", "x", "y", F.explode(F.sequence(F.lit(0), F.lit(179)) if thetas is None else thetas).alias("theta"))
    angle = F.radians(F.col("theta").cast("double"))
    return turned.withColumn("rho", _rho(F.col("x"), F.col("y"), angle))


def _counted(points: DataFrame, threshold: int) -> DataFrame:
    """(file, theta, rho, votes) of at least ``threshold`` votes; all points of a file lie in one partition."""
    angles = np.radians(np.arange(180.0))
    cos, sin = np.cos(angles), np.sin(angles)

    def votes(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        step = max(1, VOTES // len(x))
        for i in range(0, 180, step):
            rho = np.floor(x[:, None] * cos[i : i + step] + y[:, None] * sin[i : i + step] + 0.5 + 1e-9).astype(np.int64)
            low = rho.min()
            span = rho.max() - low + 1
            place = (np.arange(rho.shape[1]) * span + rho - low).ravel()
            if span * rho.shape[1] <= 16 * len(place):
                count = np.bincount(place)
                found = np.flatnonzero(count >= threshold)
                count = count[found]
            else:
                found, count = np.unique(place, return_counts=True)
                found, count = found[count >= threshold], count[count >= threshold]
            yield i + found // span, low + found % span, count

    def of(table: pa.Table) -> Iterator[pa.RecordBatch]:
        files = table.column("file").combine_chunks()
        x, y = (table.column(c).to_numpy() for c in ("x", "y"))
        ends = np.flatnonzero(pc.not_equal(files[1:], files[:-1]).to_numpy(zero_copy_only=False)) + 1
        for i, j in zip([0, *ends.tolist()], [*ends.tolist(), len(files)]):
            theta, rho, count = (np.concatenate(c) for c in zip(*votes(x[i:j], y[i:j])))
            if len(count):
                yield pa.RecordBatch.from_arrays([files.take(pa.array(np.full(len(count), i))), pa.array(theta.astype(np.int32)), pa.array(rho.astype(np.int32)), pa.array(count.astype(np.int64))], ["file", "theta", "rho", "votes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:  # a file goes on as long as its name does
            last = int(pc.index(batch.column("file"), batch.column("file")[-1]).as_py()) if batch.num_rows else 0
            if held and (last or batch.num_rows and batch.column("file")[0] != held[-1].column("file")[-1]):
                yield from of(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = [batch.slice(last)]
            elif batch.num_rows:
                if last:
                    yield from of(pa.Table.from_batches([batch.slice(0, last)]))
                held.append(batch.slice(last))
        if held:
            yield from of(pa.Table.from_batches(held))

    sorted_points = points.where("file is not null and x is not null and y is not null").select("file", "x", "y").sortWithinPartitions("file")
    return sorted_points.mapInArrow(run, "file string, theta int, rho int, votes long")


def _rho(x: Column, y: Column, angle: Column) -> Column:
    return F.floor(x * F.cos(angle) + y * F.sin(angle) + 0.5 + 1e-9).cast("int")


def hough_segments(points: DataFrame, threshold: int = 30, least_length: float = 20.0, most_gap: float = 10.0, apart: tuple[int, int] = (5, 5)) -> DataFrame:
    """(file, theta, rho, x0, y0, x1, y1, points) of stretches of ``hough_lines`` whose points (file, x, y) follow each other closely.

    A line takes the points whose distance differs from its own by one pixel at most. Along the line a gap of
    more than ``most_gap`` divides; stretches under ``least_length`` are left out.

    Points of files that have at most ``FEW_POINTS`` are dealt out by file, so that neither their votes nor what lies on a line has to move;
    those of larger files are not gathered.
    """
    points = Written(points.select("file", "x", "y").distinct(), "points").df
    sizes = Written(points.groupBy("file").agg(F.count("*").alias("_n")), "sizes").df
    large = sizes.where(F.col("_n") > FEW_POINTS).select("file").hint("merge")
    parts = 1 + (sizes.agg(F.sum("_n")).first()[0] or 0) // PART_POINTS
    lesser = (points if large.isEmpty() else points.join(large, "file", "left_anti")).repartition(parts, "file")
    lines = Written(_best_lines(_counted(lesser, threshold), apart), "lines").df.select("file", "theta", F.col("rho").alias("line"))
    listed = lines.groupBy("file").agg(F.collect_list(F.struct("theta", "line")).alias("_l")).hint("merge")  # at most as many as the votes allow
    angle = lambda theta: F.radians(theta.cast("double"))
    near = lambda m: F.abs(_rho(F.col("x"), F.col("y"), angle(m["theta"])) - m["line"]) <= 1
    on = lesser.join(listed, "file").select("file", "x", "y", F.explode(F.filter("_l", near)).alias("_m")).select("file", "x", "y", "_m.*")
    found = _along(on, least_length, most_gap)
    if large.isEmpty():
        return found
    many = points.join(large, "file", "left_semi")
    lines = Written(hough_lines(many, threshold, apart), "lines").df
    used = lines.groupBy("file").agg(F.collect_set("theta").alias("thetas"))  # at most 180 of a file
    turned = _votes(many.join(used.hint("merge"), "file"), F.col("thetas"))
    wide = lines.select("file", "theta", F.col("rho").alias("line"), F.explode(F.array(*(F.col("rho") + i for i in (-1, 0, 1)))).alias("rho"))
    return found.unionByName(_along(turned.join(wide.hint("merge"), ["file", "theta", "rho"]), least_length, most_gap))


def _along(on: DataFrame, least_length: float, most_gap: float) -> DataFrame:
    """Stretches of the points (file, theta, line, x, y) of lines."""
    angle = F.radians(F.col("theta").cast("double"))
    on = on.withColumn("along", F.col("y") * F.cos(angle) - F.col("x") * F.sin(angle))
    order = Window.partitionBy("file", "theta", "line").orderBy("along", "x", "y")  # as many as the line has pixels
    opens = on.withColumn("opens", F.coalesce((F.col("along") - F.lag("along").over(order) > most_gap).cast("int"), F.lit(0)))
    parts = opens.withColumn("part", F.sum("opens").over(order)).groupBy("file", "theta", "line", "part")
    spot = F.struct("along", "x", "y")
    found = parts.agg(F.min(spot).alias("s"), F.max(spot).alias("e"), F.count("*").alias("points")).where(F.col("e.along") - F.col("s.along") >= least_length)
    return found.select("file", "theta", F.col("line").alias("rho"), F.col("s.x").alias("x0"), F.col("s.y").alias("y0"), F.col("e.x").alias("x1"), F.col("e.y").alias("y1"), "points")


def pixel_shares(images: DataFrame) -> DataFrame:
    """Percent of black, white and other pixels, and whether there are no others than 0, 127, 255."""
    values = images.select("file", F.explode(F.split(F.hex("pixels"), "(?<=\\G..)")).alias("v")).where("v <> ''")
    share = lambda c: F.round(100 * F.count_if(c) / F.count("*"), 4)
    v = F.col("v")
    return values.groupBy("file").agg(share(v == "00").alias("black"), share(v == "FF").alias("white"), share(~v.isin("00", "FF")).alias("grey"), F.bool_and(v.isin("00", "7F", "FF")).alias("three_values"))
