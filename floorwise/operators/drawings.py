"""Drawings to floor plans: strokes, the pixels that they cover, and pre-processing by steps.

A stroke is a row (file_id, ax, ay, bx, by). Its pixels are runs (file_id, y, x0, x1), one for each row of pixels that it
meets, so that no image is held while strokes are drawn: runs are joined by row, and only packed rows meet in an image.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floorwise.functions import projection
from floorwise.functions.rings import point
from floorwise.operators import layers, raster
from floorwise.sources import convert, dxf
from floorwise.sources.scratch import Written

#: Degrees of an arc's or a circle's chord.
CHORD = 2.0
#: Steps of pre-processing by number.
STEPS = {1: "convert", 2: "filter", 3: "svg", 4: "png"}
#: Head lines of layer reports and of filter logs, which name the time, the file and numbers of layers.
REPORT_HEAD = ["DXF文件图层信息报告", "生成时间: ", "DXF文件: ", "图层总数: ", "\n图层列表:"]
LOG_HEAD = ["DXF文件图层过滤报告", "处理时间: ", "输入文件: ", "原始图层数: ", "保留图层数: ", "\n保留的图层列表:"]
LOG_END = ["\n总共复制了 ", " 个实体到新文件。", "输出文件: "]


def strokes(drawn: DataFrame, chord: float = CHORD) -> DataFrame:
    """Straight strokes of entities; circles and arcs become chords of ``chord`` degrees or less.

    Closed polylines come back to their first point. Entities of fewer than two points give none.
    """
    on = lambda angle: point(F.col("cx") + F.col("r") * F.cos(F.radians(angle)), F.col("cy") + F.col("r") * F.sin(F.radians(angle)))
    turn = F.pmod(F.col("a1") - F.col("a0"), F.lit(360.0))
    sweep = F.when(F.col("etype") == "CIRCLE", 360.0).when(turn == 0, 360.0).otherwise(turn)
    parts = F.ceil(sweep / chord).cast("int")
    curve = F.transform(F.sequence(F.lit(0), parts), lambda i: on(F.when(F.col("etype") == "ARC", F.col("a0")).otherwise(0.0) + sweep * i / parts))
    path = F.when(F.col("etype").isin("CIRCLE", "ARC"), curve).when(F.coalesce("closed", F.lit(False)) & (F.size("pts") > 2), F.concat("pts", F.slice("pts", 1, 1))).otherwise(F.col("pts"))
    shown = drawn.where("etype in ('LINE', 'CIRCLE', 'ARC', 'LWPOLYLINE', 'POLYLINE')").select("file_id", path.alias("p")).where(F.size("p") > 1)
    legs = F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.struct(F.get("p", i - 1).alias("a"), F.get("p", i).alias("b")))
    return shown.select("file_id", F.explode(legs).alias("l")).select("file_id", F.col("l.a.x").alias("ax"), F.col("l.a.y").alias("ay"), F.col("l.b.x").alias("bx"), F.col("l.b.y").alias("by"))


def in_pixels(found: DataFrame, bounds: DataFrame) -> DataFrame:
    """Strokes in their drawing's image; ``bounds`` are padded bounds by file."""
    frame = F.struct(*(c for c in bounds.columns if c != "file_id"))
    a, b = (projection.drawing_to_pixel(F.col(f"{e}x"), F.col(f"{e}y"), frame) for e in "ab")
    placed = found.join(bounds, "file_id").select("file_id", a.alias("a"), b.alias("b"))
    return placed.select("file_id", F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"))


def runs(found: DataFrame) -> DataFrame:
    """(file_id, y, x0, x1): for each row of pixels the part of a stroke that lies in it."""
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    rows = F.sequence(F.floor(low), F.floor(high))
    inside = found.withColumn("y", F.explode(rows))
    at = lambda y: F.col("ax") + (y - F.col("ay")) * ((F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay")))
    clamped = lambda x: F.greatest(F.least("ax", "bx"), F.least(F.greatest("ax", "bx"), x))
    flat = F.col("ay") == F.col("by")
    first = F.when(flat, F.col("ax")).otherwise(clamped(at(F.greatest(low, F.col("y").cast("double")))))
    last = F.when(flat, F.col("bx")).otherwise(clamped(at(F.least(high, F.col("y") + F.lit(1.0)))))
    return inside.select("file_id", "y", F.floor(F.least(first, last)).alias("x0"), F.floor(F.greatest(first, last)).alias("x1"))


def joined(found: DataFrame, thickness: int = 1) -> DataFrame:
    """Runs without overlaps; each pixel of a stroke becomes a square of ``thickness`` pixels, to the right and down."""
    longest = found.groupBy("file_id", "y", "x0").agg(F.max("x1").alias("x1"))  # as many in a row as it has pixels, at most
    if thickness > 1:
        wide = longest.select("file_id", F.explode(F.sequence(F.col("y"), F.col("y") + thickness - 1)).alias("y"), "x0", (F.col("x1") + thickness - 1).alias("x1"))
        longest = wide.groupBy("file_id", "y", "x0").agg(F.max("x1").alias("x1"))
    row = Window.partitionBy("file_id", "y").orderBy("x0")
    apart = F.col("x0") > F.coalesce(F.max("x1").over(row.rowsBetween(Window.unboundedPreceding, -1)), F.col("x0") - 2) + 1
    numbered = longest.withColumn("_new", apart.cast("int")).withColumn("_run", F.sum("_new").over(row))
    return numbered.groupBy("file_id", "y", "_run").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_run")


def images(found: DataFrame, sizes: DataFrame) -> DataFrame:
    """Black on white images (file, width, height, pixels) of joined runs; ``sizes`` are (file_id, width, height).

    What lies outside an image is not drawn; a file without a run is a white image.
    """
    seen = found.join(sizes, "file_id").where("y >= 0 and y < height and x1 >= 0 and x0 < width")
    of_row = seen.groupBy("file_id", "y", "width").agg(F.collect_list(F.struct(F.greatest("x0", F.lit(0)).cast("int").alias("x0"), F.least("x1", F.col("width") - 1).cast("int").alias("x1"))).alias("runs"))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            packed = []
            for width, spans in zip(batch["width"], batch["runs"]):
                line = np.zeros(width, np.uint8)
                for s in spans:
                    line[s["x0"] : s["x1"] + 1] = 1
                packed.append(np.packbits(line).tobytes())
            yield pd.DataFrame({"file_id": batch["file_id"], "y": batch["y"], "bits": packed})

    lines = of_row.mapInPandas(rows, "file_id string, y long, bits binary").groupBy("file_id").agg(F.collect_list(F.struct("y", "bits")).alias("rows"))
    whole = sizes.select("file_id", F.col("width").cast("int"), F.col("height").cast("int")).join(lines, "file_id", "left")

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, width, height, found_rows in batch.itertuples(index=False):
                image = np.full((height, width), 255, np.uint8)
                for r in found_rows if found_rows is not None else ():
                    image[r["y"]][np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=width) == 1] = 0
                yield pd.DataFrame([(file, width, height, image.tobytes())], columns=["file", "width", "height", "pixels"])

    return whole.mapInPandas(drawn, raster.SCHEMA)


def pngs(found: DataFrame) -> DataFrame:
    """(file, content): images as uncompressed PNG files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                yield pd.DataFrame([(row.file, raster.encode_png(np.frombuffer(row.pixels, np.uint8).reshape(row.height, row.width)))], columns=["file", "content"])

    return found.select("file", "width", "height", "pixels").mapInPandas(run, "file string, content binary")


def bounds_of(drawn: DataFrame, size: int = 4000) -> DataFrame:
    """Padded bounds of each drawing and its image's size, whose longer side is ``size``."""
    points = dxf.bound_points(drawn).groupBy("file_id")
    return points.agg(projection.padded_bounds(F.min("x"), F.min("y"), F.max("x"), F.max("y"), size=size).alias("b")).where("b.svg_width_px is not null").select("file_id", "b.*")


def _name(file_id: str = "file_id") -> Column:
    return F.regexp_extract(file_id, "([^/]*)$", 1)


def _now(at: str | None) -> Column:
    return F.lit(at) if at is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")


def layer_reports(found: DataFrame, at: str | None = None) -> DataFrame:
    """(file_id, text): a report of each drawing's layers (file_id, decoded_name) by name, below head lines."""
    names = found.groupBy("file_id").agg(F.array_sort(F.collect_list("decoded_name")).alias("n"))
    head = [F.lit(REPORT_HEAD[0]), F.concat(F.lit(REPORT_HEAD[1]), _now(at)), F.concat(F.lit(REPORT_HEAD[2]), _name()), F.concat(F.lit(REPORT_HEAD[3]), F.size("n")), F.lit(REPORT_HEAD[4])]
    return names.select("file_id", F.array_join(F.concat(F.array(*head), "n"), "\n").alias("text"))


def filter_logs(all_layers: DataFrame, kept: DataFrame, drawn: DataFrame, at: str | None = None) -> DataFrame:
    """(file_id, text): what a filter kept of each drawing: layers (file_id, raw_name) and entities (file_id, layer)."""
    before = all_layers.groupBy("file_id").agg(F.count("*").alias("before"))
    stayed = kept.groupBy("file_id").agg(F.array_sort(F.collect_list("raw_name")).alias("n"))
    copied = dxf.kept_layers(drawn, kept).groupBy("file_id").agg(F.count("*").alias("copied"))
    whole = before.join(stayed, "file_id", "left").join(copied, "file_id", "left").withColumns({"n": F.coalesce("n", F.array().cast("array<string>")), "copied": F.coalesce("copied", F.lit(0))})
    head = [F.lit(LOG_HEAD[0]), F.concat(F.lit(LOG_HEAD[1]), _now(at)), F.concat(F.lit(LOG_HEAD[2]), _name()), F.concat(F.lit(LOG_HEAD[3]), "before"), F.concat(F.lit(LOG_HEAD[4]), F.size(F.array_distinct("n"))), F.lit(LOG_HEAD[5])]
    end = [F.concat(F.lit(LOG_END[0]), "copied", F.lit(LOG_END[1])), F.concat(F.lit(LOG_END[2]), _name())]
    return whole.select("file_id", F.array_join(F.concat(F.array(*head), F.transform("n", lambda n: F.concat(F.lit("- "), n)), F.array(*end)), "\n").alias("text"))


def flattened(found: DataFrame) -> DataFrame:
    """Items of drawings with every insert replaced by what it shows; blocks go, layers stay."""
    shown = dxf.exploded(found)
    return found.where("kind = 'layer'").unionByName(shown.withColumn("kind", F.lit("entity")).select(*found.columns))


@dataclass
class Prepared:
    """What pre-processing made, each a written table; a step that was skipped leaves None."""

    errors: DataFrame
    log: DataFrame
    drawings: DataFrame
    kept: DataFrame | None = None
    bounds: DataFrame | None = None
    svgs: DataFrame | None = None
    images: DataFrame | None = None
    found: DataFrame | None = field(default=None, repr=False)


def preprocessed(files: DataFrame, converter: list[str] | None = None, skip: tuple[int, ...] = (), names: DataFrame | None = None, size: int = 4000, thickness: int = 1, gap: str | None = "medium", min_area: int = 100, encoding: str = "utf-8") -> Prepared:
    """Files (file_id, content) through the steps convert, filter, svg and png; each step takes all files at once.

    Only DWG files are converted, by ``converter``. Layers stay by the rules of ``layers.keeps`` or, where ``names`` (layer) is
    given, by that list. A file that fails in a step is in ``errors`` (file_id, step, error) and goes no further; the others
    go on. ``log`` has a row (step, files, failed, seconds) for each step that ran.
    """
    spark, log = files.sparkSession, []
    errors = spark.createDataFrame([], "file_id string, step string, error string")

    def timed(number: int, build: Callable[[], DataFrame], failed: Callable[[DataFrame], DataFrame]) -> DataFrame:
        nonlocal errors
        start = time.monotonic()
        made = Written(build(), STEPS[number]).df
        now = Written(failed(made).select("file_id", F.lit(STEPS[number]).alias("step"), "error"), "errors").df
        errors = errors.unionByName(now)
        log.append((STEPS[number], made.select("file_id").distinct().count(), now.count(), time.monotonic() - start))
        return made

    lost = lambda before, made, why: before.select("file_id").distinct().join(made.select("file_id").distinct(), "file_id", "left_anti").withColumn("error", F.lit(why))
    plans = files.select("file_id", F.col("content").cast("binary").alias("content"))
    closed = F.lower("file_id").endswith(".dwg")
    if 1 not in skip and converter:
        done = timed(1, lambda: convert.converted(plans.where(closed), converter, "dwg", "dxf"), lambda made: made.where("error is not null"))
        plans = plans.where(~closed).unionByName(done.where("error is null").select("file_id", "content"))
    else:
        unread = Written(plans.where(closed).select("file_id", F.lit(STEPS[1]).alias("step"), F.lit("there is no converter").alias("error")), "errors").df
        errors, plans = errors.unionByName(unread), plans.where(~closed)
    found = Written(dxf.read(plans, encoding), "drawings").df
    kept = None
    if 2 not in skip:
        of_layer = dxf.layers(found)
        chosen = layers.by_list(of_layer, names) if names is not None else of_layer.where(layers.keeps(F.col("raw_name"), F.col("decoded_name")))
        kept = Written(chosen, "kept").df
        drawings = timed(2, lambda: dxf.filtered(found, kept), lambda made: lost(plans, made, "no layer is kept"))
    else:
        drawings = found
    out = Prepared(errors, None, drawings, kept, found=found)
    if 3 not in skip or 4 not in skip:
        shown = Written(dxf.exploded(drawings), "exploded").df
        out.bounds = Written(bounds_of(shown, size), "bounds").df
        if 3 not in skip:
            out.svgs = timed(3, lambda: dxf.svg(shown, out.bounds), lambda made: lost(drawings, made, "nothing is drawn"))
        if 4 not in skip:
            sizes = out.bounds.select("file_id", F.greatest("svg_width_px", F.lit(1)).cast("int").alias("width"), F.greatest("svg_height_px", F.lit(1)).cast("int").alias("height"))

            def made() -> DataFrame:
                painted = images(joined(runs(in_pixels(strokes(shown), out.bounds)), thickness), sizes)
                filled = raster.mapped(painted, lambda image: raster.gaps_filled(image, gap, min_area)) if gap else painted
                return filled.withColumnRenamed("file", "file_id")

            out.images = timed(4, made, lambda done: lost(drawings, done, "nothing is drawn")).withColumnRenamed("file_id", "file")
    out.errors = errors
    out.log = spark.createDataFrame(log, "step string, files long, failed long, seconds double")
    return out
