"""Tiered repair of maps: ordered projections over documents, nodes and ways.

Every step works on the columns that the step before it left. Steps are SAFE or MODERATE;
MODERATE ones run only when asked for. Tags that steps change are columns while they run and
go back into the tag map once; each step leaves a fix (level, category, description,
element_id, old_value, new_value) beside its row, so one pass gives the table and the fixes.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floorwise.functions import scalars
from floorwise.functions.tags import tag, upserted
from floorwise.operators.validate import ACTIONS, AREA_TYPES
from floorwise.sources.osm_xml import Maps, elements_of
from floorwise.sources.scratch import Written

FIX_LEVELS = ["SAFE", "MODERATE", "RISKY"]
#: Tags that steps change, with the columns that stand for them.
CHANGED = {"name": "t_name", "osmAG:areaType": "t_type", "level": "t_level"}


@dataclass
class Steps:
    """A table under repair."""

    df: DataFrame
    element: Column | None = None
    fixes: list[str] = field(default_factory=list)

    def set(self, column: str, new: Column, when: Column, level: str, category: str, description: str) -> None:
        """Set a column where ``when`` holds and ``new`` is not null."""
        new, when = new.cast("string") if dict(self.df.dtypes)[column] == "string" else new, F.coalesce(when & new.isNotNull(), F.lit(False))
        text = lambda c: c.cast("string")
        fix = F.struct(F.lit(level).alias("level"), F.lit(category).alias("category"), F.lit(description).alias("description"), (F.lit(None).cast("string") if self.element is None else self.element).alias("element_id"), text(F.col(column)).alias("old_value"), text(new).alias("new_value"))
        name = f"_fix{len(self.fixes)}"
        self.fixes.append(name)
        self.df = self.df.withColumns({name: F.when(when, fix), column: F.when(when, new).otherwise(F.col(column))})

    def landed(self) -> None:
        self.df = Written(self.df, "repair").df

    def found(self) -> DataFrame:
        rows = self.df.select("map_id", F.explode(F.filter(F.array(*self.fixes), lambda f: f.isNotNull())).alias("f"))
        return rows.select("map_id", "f.*")


@dataclass
class Repair:
    documents: DataFrame
    nodes: DataFrame
    ways: DataFrame
    relations: DataFrame
    fixes: DataFrame

    @property
    def maps(self) -> Maps:
        return Maps(elements_of(self.nodes, self.ways, self.documents, self.relations))


def repair(maps: Maps, dialect: str = "semantic", moderate: bool = False) -> Repair:
    """Repair all maps: root, nodes, ways, areas, passages, cross-level passages, levels."""
    documents, nodes, ways = Steps(maps.documents), Steps(maps.nodes, F.col("id")), Steps(maps.ways, F.col("id"))
    documents.set("version", F.lit("0.6"), F.col("parse_error").isNull() & ~F.col("version").eqNullSafe(F.lit("0.6")), "SAFE", "ROOT", "set the version")
    documents.set("generator", F.lit("floorwise"), F.expr("parse_error is null and generator is null"), "SAFE", "ROOT", "add a generator")
    documents.landed()
    nodes.set("action", F.lit("modify"), F.col("action").isNull() | ~F.col("action").isin(ACTIONS), "SAFE", "NODE", "set the action")
    nodes.set("visible", F.lit("true"), F.col("visible").isNull(), "SAFE", "NODE", "add visible")
    if moderate:
        for column, most in (("lat", 90.0), ("lon", 180.0)):
            value = F.col(column).try_cast("double")
            clamped = F.greatest(F.lit(-most), F.least(F.lit(most), value)).cast("string")
            nodes.set(column, clamped, ~F.isnan(value) & ~value.between(-most, most), "MODERATE", "NODE", f"clamp {column}")
    nodes.landed()
    columns = ways.df.columns
    raw = {c: F.try_element_at("tags", F.lit(k)) for k, c in CHANGED.items()}
    ways.df = ways.df.withColumns(raw | {"kind": tag("osmAG:type"), "start": tag("osmAG:from"), "end": tag("osmAG:to"), "parent": tag("osmAG:parent")})
    _ways(ways, dialect, moderate)
    ways.landed()
    if dialect == "semantic" and moderate:
        _levels(ways)
        ways.landed()
    whole = ways.df.withColumn("tags", upserted(F.col("tags"), {k: F.col(c) for k, c in CHANGED.items()})).select(columns)
    fixes = reduce(DataFrame.unionByName, (s.found() for s in (documents, nodes, ways)))
    return Repair(documents.df.select(maps.documents.columns), nodes.df.select(maps.nodes.columns), whole, maps.relations, fixes)


def _ways(ways: Steps, dialect: str, moderate: bool) -> None:
    """What a way's own columns decide."""
    value = lambda c: F.coalesce(F.col(c), F.lit(""))
    area, passage = F.col("kind") == "area", F.col("kind") == "passage"
    name, kind, level = value("t_name"), value("t_type"), value("t_level")
    ways.set("action", F.lit("modify"), F.col("action").isNull(), "SAFE", "WAY", "add an action")
    ways.set("visible", F.lit("true"), F.col("visible").isNull(), "SAFE", "WAY", "add visible")
    open_ring = area & (F.size("nds") >= 3) & (F.get("nds", F.lit(0)) != F.get("nds", F.size("nds") - 1))
    ways.set("nds", F.concat("nds", F.slice("nds", 1, 1)), open_ring, "SAFE", "AREA", "close the ring")
    if moderate:
        ways.set("t_type", scalars.inferred_type(name, dialect), area & (kind == ""), "MODERATE", "AREA", "infer the type from the name")
        if dialect == "semantic":
            ways.set("t_level", scalars.inferred_level(name), area & (level == ""), "MODERATE", "AREA", "infer the level from the name")
    ways.set("t_type", scalars.standard_type(kind, dialect), area & (kind != "") & ~kind.isin(AREA_TYPES[dialect]), "SAFE", "AREA", "standardise the type")
    if not moderate:
        return
    if dialect == "semantic":
        new = scalars.standard_name(name, kind)
        ways.set("t_name", new, area & (new != name), "MODERATE", "SEMANTIC_NAMING", "standardise the name")
    new = scalars.repaired_level(level)
    ways.set("t_level", new, area & (level != "") & (new != level), "MODERATE", "AREA", "repair the level")
    if dialect == "semantic":
        ends = scalars.passage_name(F.col("start"), F.col("end"))
        ways.set("t_name", ends, passage & (name == "") & (F.col("start") != "") & (F.col("end") != ""), "MODERATE", "PASSAGE", "name the passage by its ends")
        new = scalars.formatted_passage_name(name)
        ways.set("t_name", new, passage & (new != name), "MODERATE", "PASSAGE", "format the name")


def _levels(ways: Steps) -> None:
    """Levels that other areas tell: of the first facility of a cross-level passage's name, and
    of the last area of a parent's name."""
    areas = ways.df.where("kind = 'area' and t_name <> ''").select("map_id", "ord", "t_name", "t_type", F.coalesce("t_level", F.lit("")).alias("found"))
    first = areas.where("t_type in ('elevator', 'stairs') and found <> ''").groupBy("map_id", F.col("t_name").alias("start")).agg(F.min_by("found", "ord").alias("_first"))
    last = areas.groupBy("map_id", F.col("t_name").alias("parent")).agg(F.max_by("found", "ord").alias("_last"))
    ways.df = ways.df.join(first, ["map_id", "start"], "left").join(last, ["map_id", "parent"], "left")
    level = F.coalesce("t_level", F.lit(""))
    cross = (F.col("kind") == "passage") & (F.col("start") != "") & (F.col("start") == F.col("end"))
    ways.set("t_level", F.col("_first"), cross & (level == ""), "MODERATE", "CROSS_LEVEL_PASSAGE", "take the facility's level")
    child = (F.col("kind") == "area") & (F.col("_last") != "") & (level != "") & (level != F.col("_last"))
    ways.set("t_level", F.col("_last"), child, "MODERATE", "LEVEL_CONSISTENCY", "take the parent's level")


def fix_counts(fixes: DataFrame) -> DataFrame:
    """Fixes by tier for each map."""
    return fixes.groupBy("map_id").agg(F.count("*").alias("total"), *(F.count_if(F.col("level") == s).alias(s.lower()) for s in FIX_LEVELS))


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes of the summaries of two validations."""
    b = before.select("map_id", F.col("errors").alias("errors_before"), F.col("warnings").alias("warnings_before"))
    a = after.select("map_id", F.col("errors").alias("errors_after"), F.col("warnings").alias("warnings_after"))
    return b.join(a, "map_id", "full").withColumns({"errors_delta": F.col("errors_after") - F.col("errors_before"), "warnings_delta": F.col("warnings_after") - F.col("warnings_before")})


def fix_report(fixes: DataFrame) -> DataFrame:
    rows = fixes.groupBy("map_id").agg(F.array_sort(F.collect_list(F.struct("category", "element_id", "description", "level", "old_value", "new_value"))).alias("fix_results"))
    return rows.join(fix_counts(fixes), "map_id").select("map_id", F.to_json(F.struct(F.struct("total", "safe", "moderate", "risky").alias("statistics"), "fix_results")).alias("json"))
