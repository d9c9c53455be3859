"""Command lines: validate, repair, merge and label maps, and make them from floor plans.

    python -m floorwise.cli validate PATH... [--dialect semantic|fix_id] [-v] [-s FOLDER]
    python -m floorwise.cli repair PATH... --output FOLDER [--enable-moderate]
    python -m floorwise.cli merge --reference FILE --target FILE... --output FOLDER [--min-matches N]
    python -m floorwise.cli concat PATH... --output FOLDER
    python -m floorwise.cli outline PATH... --output FOLDER [--method boundary|convex_hull|alpha_shape]
    python -m floorwise.cli direction PATH... --output FOLDER
    python -m floorwise.cli match --drawing FILE... --map FILE... --layer NAME --output FOLDER [--renamed FOLDER] [--nearby N]
    python -m floorwise.cli preprocess PATH... --output FOLDER [--converter COMMAND] [--skip-steps N,N] [--layers FILE] [--size N --thickness N --gap SIZE]
    python -m floorwise.cli layers PATH... --output FOLDER
    python -m floorwise.cli flatten PATH... --output FOLDER
    python -m floorwise.cli segment IMAGE... --output FOLDER [--resolution R --alpha A --clear D --dead-ends D... ...]
    python -m floorwise.cli sweep IMAGE... --output FOLDER [--alpha-values LIST --filter WORD... --skip WORD... --dry-run]

``validate`` ends with 1 if a map has errors, ``preprocess`` if a file failed, every command with 2 if there is nothing to read, and ``merge``
with 2 as well if its reference is not one map.
"""

from __future__ import annotations

import argparse
import shlex
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorwise.functions import projection, scalars
from floorwise.operators import drawings, labels, merge, raster, repair, rooms, segment, sweep, validate
from floorwise.session import session
from floorwise.sources import dxf, files, osm_xml
from floorwise.sources.osm_xml import Maps
from floorwise.sources.package import ship
from floorwise.sources.scratch import Written


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="floorwise")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, paths: bool = True) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        if paths:
            p.add_argument("paths", nargs="+")
        p.add_argument("--dialect", choices=list(validate.AREA_TYPES), default="semantic")
        return p

    check = command("validate")
    check.add_argument("-v", "--verbose", action="store_true", help="all findings, not only the first of each kind")
    check.add_argument("-s", "--save", help="folder for the reports as JSON")
    fix = command("repair")
    fix.add_argument("--output", required=True)
    fix.add_argument("--enable-moderate", action="store_true")
    fix.add_argument("--report", help="folder for the fixes as JSON")
    join = command("merge", paths=False)
    join.add_argument("--reference", required=True)
    join.add_argument("--target", nargs="+", required=True)
    join.add_argument("--min-matches", type=int, default=1)
    join.add_argument("--output", required=True)
    command("concat").add_argument("--output", required=True)
    command("direction").add_argument("--output", required=True)
    outline = command("outline")
    outline.add_argument("--method", choices=["boundary", "convex_hull", "alpha_shape"], default="boundary")
    outline.add_argument("--squared-radius", type=float, default=1e-6, help="of the alpha shape, in degrees")
    outline.add_argument("--output", required=True)
    match = command("match", paths=False)
    match.add_argument("--drawing", nargs="+", required=True)
    match.add_argument("--map", nargs="+", required=True, help="maps named as their drawings")
    match.add_argument("--layer", required=True)
    match.add_argument("--nearby", type=float, default=labels.NEARBY)
    match.add_argument("--renamed", help="folder for the maps with their new names")
    match.add_argument("--output", required=True, help="folder for the matches as JSON")
    prepare = command("preprocess")
    prepare.add_argument("--converter", help="of DWG files, with {input} and {output}")
    prepare.add_argument("--skip-steps", default="", help="numbers: " + ", ".join(f"{n} {s}" for n, s in drawings.STEPS.items()))
    prepare.add_argument("--layers", help="a file with a layer to keep in each line, instead of the rules")
    prepare.add_argument("--size", type=int, default=4000)
    prepare.add_argument("--thickness", type=int, default=1)
    prepare.add_argument("--gap", choices=[*raster.GAPS, "none"], default="medium")
    prepare.add_argument("--output", required=True)
    command("layers").add_argument("--output", required=True)
    command("flatten").add_argument("--output", required=True)
    one = command("segment")
    _segmenting(one)
    many = command("sweep")
    many.add_argument("--alpha-values")
    many.add_argument("--filter", nargs="*", default=[])
    many.add_argument("--skip", nargs="*", default=[])
    many.add_argument("--dry-run", action="store_true", help="only show the runs")
    _segmenting(many)
    return top


def _segmenting(p: argparse.ArgumentParser) -> None:
    """Settings of a segmentation; a sweep takes those of its profiles instead where it has them."""
    p.add_argument("--output", required=True)
    for name, default in (("resolution", 0.044), ("alpha", 3600.0), ("clear", 3.0), ("noise-percent", 1.5), ("min-room-area", 10.0), ("simplify", 1.3), ("spike-angle", 15.0), ("spike-distance", 0.3), ("root-lat", 31.0), ("root-lon", 121.0)):
        p.add_argument(f"--{name}", type=float, default=default)
    p.add_argument("--dead-ends", type=float, nargs="+", default=list(segment.DEAD_ENDS))


def _shown(rows: DataFrame) -> None:
    for row in rows.toLocalIterator():
        print(*("" if v is None else v for v in row), sep="\t")


def validated(maps: Maps, args: argparse.Namespace) -> int:
    found = Written(validate.findings(maps, args.dialect), "findings").df
    summaries = Written(validate.summary(found, maps.documents), "summary").df
    lines = found.orderBy("map_id", "ord") if args.verbose else validate.report_lines(found)
    _shown(lines.select("map_id", "level", "category", "element_id", "message", F.to_json("details").alias("details")))
    _shown(validate.batch_summary(summaries))
    if args.save:
        validate.report(found, validate.statistics(maps, args.dialect), summaries).select("json").write.mode("overwrite").text(args.save)
    return int(summaries.where(~F.col("passed")).count() > 0)


def _files(paths: list[str], pattern: str) -> DataFrame:
    found = osm_xml.discover(session(), paths, pattern)
    return found.withColumn("stem", scalars.file_stem(F.col("map_id")))


def matched(args: argparse.Namespace) -> int:
    """Texts of drawings to the rooms of the maps of the same name."""
    plans, maps = _files(args.drawing, "*.{dxf,DXF}"), Maps.read(session(), args.map)
    pairs = plans.select("stem", F.col("map_id").alias("file_id")).join(maps.documents.select("map_id", scalars.file_stem(F.col("map_id")).alias("stem")), "stem").select("file_id", "map_id")
    if pairs.isEmpty():
        print("no drawing has a map of its name", file=sys.stderr)
        return 2
    found = Written(dxf.read(plans.select(F.col("map_id").alias("file_id"), "content")), "drawings").df
    points = dxf.bound_points(dxf.exploded(found))
    bounds = points.groupBy("file_id").agg(projection.padded_bounds(F.min("x"), F.min("y"), F.max("x"), F.max("y")).alias("b")).select("file_id", "b.*")
    texts = labels.pixel_texts(labels.extracted_texts(dxf.entities(found), args.layer), bounds).join(pairs, "file_id")
    texts = Written(texts.select("map_id", "ord", "text", F.col("pixel_point").alias("p")), "texts").df
    best = Written(labels.matches(texts, labels.room_polygons(maps), args.nearby), "matches").df
    labels.mapping_json(best, texts).select("json").write.mode("overwrite").text(args.output)
    _shown(labels.match_statistics(texts, best))
    if args.renamed:
        ways = labels.renamed(maps.ways, labels.new_names(best))
        osm_xml.write(osm_xml.elements_of(maps.nodes, ways, maps.documents, maps.relations), args.renamed)
    return 0


def prepared(plans: DataFrame, args: argparse.Namespace) -> int:
    """Drawings through the steps of pre-processing; a folder for what each of them makes."""
    skip = tuple(int(n) for n in args.skip_steps.split(",") if n.strip().isdigit())
    names = files.text_lines(session(), args.layers).where("trim(layer) <> ''") if args.layers else None
    made = drawings.preprocessed(plans, shlex.split(args.converter) if args.converter else None, skip, names, args.size, args.thickness, None if args.gap == "none" else args.gap)
    if made.kept is not None:
        files.write_texts(dxf.to_dxf(made.drawings), f"{args.output}/dxf", "file_id", "dxf")
        files.write_texts(drawings.filter_logs(dxf.layers(made.found), made.kept, dxf.entities(made.found)), f"{args.output}/logs", "file_id", "text")
    if made.svgs is not None:
        files.write_texts(made.svgs, f"{args.output}/svg", "file_id", "svg")
    if made.bounds is not None:
        files.write_json(made.bounds, f"{args.output}/bounds", ["file_id"])
    if made.images is not None:
        drawings.pngs(made.images).write.mode("overwrite").parquet(f"{args.output}/png")
    _shown(made.log)
    _shown(made.errors.orderBy("file_id"))
    return int(not made.errors.isEmpty())


def _obstacles(images: DataFrame, noise_percent: float) -> DataFrame:
    """(map_id, x, y) of dark pixels without outliers."""
    import numpy as np

    dark = raster.mapped(images, lambda m: np.where(m < raster.black_threshold(m), 0, 255))
    return raster.denoised(raster.sites(dark), percent=noise_percent).withColumnRenamed("file", "map_id")


def segmented(images: DataFrame, settings: dict, output: str) -> None:
    """Maps of the rooms and passages in floor plans."""
    points = Written(_obstacles(images, settings["noise_percent"]), "obstacles").df
    pieces, shapes, bridge = segment.segment(points, settings["clear"], settings["alpha"], tuple(settings["dead_ends"]))
    pieces, shapes, bridge = (Written(df, "segmented").df for df in (pieces, shapes, bridge))
    root = (settings["root_lat"], settings["root_lon"])
    maps = segment.to_maps(pieces, shapes, bridge, settings["resolution"], root, (0.0, 0.0), settings["min_room_area"], settings["simplify"], settings["spike_angle"], settings["spike_distance"])
    osm_xml.write(maps.elements, output)


def swept(images: DataFrame, args: argparse.Namespace) -> int:
    """One run for each image and alpha, or one for each image by its profile; runs of equal settings go together."""
    runs = Written(sweep.runs(images, args.alpha_values, args.filter, args.skip), "runs").df
    _shown(runs.select("file", "building_type", "alpha", *sweep.COLUMNS).orderBy("file", "alpha"))
    if args.dry_run:
        return 0
    sweep.records(runs).write.mode("overwrite").partitionBy("alpha").json(f"{args.output}/parameters")
    renamed = {"simplify_tolerance": "simplify", "door_width": None, "corridor_width": None}
    for n, row in enumerate(runs.select("alpha", *sweep.COLUMNS).distinct().orderBy("alpha", *sweep.COLUMNS).collect()):  # of profiles and alphas
        same = runs.where(" and ".join(f"{c} <=> {row[c]!r}D" if c != "alpha" else f"alpha = {row[c]}" for c in ["alpha", *sweep.COLUMNS]))
        settings = vars(args) | {renamed.get(c, c): row[c] for c in ["alpha", *sweep.COLUMNS] if renamed.get(c, c)}
        segmented(images.join(same.select("file"), "file", "left_semi"), settings, f"{args.output}/alpha={row['alpha']}/setting={n}")
    return 0


def reference_map(maps: Maps, path: str) -> str:
    """The one map that was read from ``path``; an error if it is none or several."""
    resolved = osm_xml.resolved(maps.elements.sparkSession, path)
    found = [r.map_id for r in maps.documents.where((F.col("map_id") == resolved) | F.col("map_id").startswith(resolved.rstrip("/") + "/")).select("map_id").limit(2).collect()]
    if len(found) != 1:
        raise ValueError(f"{path} is {'several maps' if found else 'no map'} of those that were read")
    return found[0]


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = session()
    ship(spark)
    if args.command == "match":
        return matched(args)
    if args.command in ("preprocess", "layers", "flatten"):
        plans = _files(args.paths, "*.{dxf,DXF,dwg,DWG}" if args.command == "preprocess" else "*.{dxf,DXF}").select(F.col("map_id").alias("file_id"), "content")
        if plans.isEmpty():
            print("no drawing was found", file=sys.stderr)
            return 2
        if args.command == "preprocess":
            return prepared(plans, args)
        found = Written(dxf.read(plans), "drawings").df
        made = drawings.layer_reports(dxf.layers(found)) if args.command == "layers" else dxf.to_dxf(drawings.flattened(found)).withColumnRenamed("dxf", "text")
        files.write_texts(made, args.output, "file_id", "text")
        return 0
    if args.command in ("segment", "sweep"):
        found = _files(args.paths, "*.{png,PNG,bmp,BMP,pbm,pgm,ppm,pnm}").select(F.col("map_id").alias("file"), "content")
        if found.isEmpty():
            print("no image was found", file=sys.stderr)
            return 2
        images = Written(raster.read(found), "images").df
        if args.command == "sweep":
            return swept(images, args)
        segmented(images, vars(args), args.output)
        return 0
    paths = [args.reference, *args.target] if args.command == "merge" else args.paths
    maps = Maps.read(spark, paths)
    if maps.documents.isEmpty():
        print("no map was found", file=sys.stderr)
        return 2
    if args.command == "validate":
        return validated(maps, args)
    if args.command == "repair":
        done = repair.repair(maps, args.dialect, args.enable_moderate)
        _shown(repair.fix_counts(done.fixes))
        if args.report:
            repair.fix_report(done.fixes).select("json").write.mode("overwrite").text(args.report)
        osm_xml.write(done.maps.elements, args.output)
        return 0
    if args.command == "merge":
        try:
            reference = reference_map(maps, args.reference)
        except ValueError as error:
            print(error, file=sys.stderr)
            return 2
        merged = merge.merge_floors(maps, reference, min_matches=args.min_matches)
    elif args.command == "outline":
        merged = rooms.with_outlines(maps, rooms.outlines(maps, args.method, args.squared_radius))
    elif args.command == "direction":
        merged = Maps(osm_xml.elements_of(maps.nodes, merge.winding(maps), maps.documents, maps.relations))
    else:
        merged = merge.concat_maps(maps)
    osm_xml.write(merged.elements, args.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
