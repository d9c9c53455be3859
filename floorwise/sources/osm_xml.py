"""Area-graph maps in OSM XML: discovery, bulk parsing and writing.

A map is one file. Files are read whole and parsed where they lie, in Arrow batches; one
pass gives nodes, ways, relations and the document row with its parse error, and keeps the
document's order, which first-match and last-match rules need. Attributes stay strings;
typed meaning is the validators' business. Attributes that no rule reads (user, timestamp and
the like) are kept in a map and written again. Of repeated tag keys the last wins.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from itertools import islice
from xml.sax.saxutils import quoteattr

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from floorwise.sources.scratch import Written

#: Elements of a part of a map, and rows of a batch.
PART = 1024
#: Attributes with columns of their own.
READ = ("id", "version", "lat", "lon", "action", "visible")
ELEMENTS = """map_id string, kind string, ord int, id string, version string, generator string, root_tag string, parse_error string,
    lat string, lon string, action string, visible string, attributes map<string,string>, tags map<string,string>, nds array<string>, members array<struct<type:string,ref:string,role:string>>"""

_ARROW = pa.schema(
    [(n, pa.string() if n != "ord" else pa.int32()) for n in ("map_id", "kind", "ord", "id", "version", "generator", "root_tag", "parse_error", "lat", "lon", "action", "visible")]
    + [("attributes", pa.map_(pa.string(), pa.string())), ("tags", pa.map_(pa.string(), pa.string())), ("nds", pa.list_(pa.string())), ("members", pa.list_(pa.struct([("type", pa.string()), ("ref", pa.string()), ("role", pa.string())])))]
)


def discover(spark: SparkSession, paths: str | list[str], pattern: str = "*.osm", recursive: bool = True) -> DataFrame:
    """(map_id, content) of each distinct file under the paths.

    Paths that lie under another one are left out before anything is read; only where paths
    are patterns that may overlap are files told apart by their names afterwards.
    """
    several = sorted({p.rstrip("/") for p in ([paths] if isinstance(paths, str) else paths)})
    under = lambda p: any(p.startswith(q + "/") for q in several) if recursive else False
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    files = reader.load([p for p in several if not under(p)]).select(F.col("path").alias("map_id"), "content")
    return files.dropDuplicates(["map_id"]) if len(several) > 1 and any(c in p for p in several for c in "*?[{") else files


def resolved(spark: SparkSession, path: str) -> str:
    """A path as maps are named by it: absolute, with its store's scheme."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


def _rows(map_id: str, content: bytes) -> Iterator[dict]:
    try:
        root = ET.fromstring(content)
    except ET.ParseError as error:
        yield {"map_id": map_id, "kind": "document", "ord": 0, "parse_error": str(error)}
        return
    yield {"map_id": map_id, "kind": "document", "ord": 0, "root_tag": root.tag, "version": root.get("version"), "generator": root.get("generator")}
    for n, element in enumerate(root, 1):
        if element.tag in ("node", "way", "relation"):
            row = {"map_id": map_id, "kind": element.tag, "ord": n, **{a: element.get(a) for a in READ}}
            row["attributes"] = [(k, v) for k, v in element.items() if k not in READ]
            row["tags"] = list({t.get("k", ""): t.get("v", "") for t in element.findall("tag")}.items())
            row["nds"] = [nd.get("ref") for nd in element.findall("nd")]
            row["members"] = [{k: m.get(k) for k in ("type", "ref", "role")} for m in element.findall("member")]
            yield row


def parse(files: DataFrame) -> DataFrame:
    """All elements of maps given as (map_id, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for map_id, content in zip(batch.column("map_id").to_pylist(), batch.column("content").to_pylist()):
                yield from _batches(_rows(map_id, content))

    return files.select("map_id", F.col("content").cast("binary").alias("content")).mapInArrow(run, ELEMENTS)


def parse_parts(parts: DataFrame) -> DataFrame:
    """All elements of maps given as (map_id, part, content) of ``to_parts``: a part's elements follow those of the parts before it.

    Each part is parsed by itself, so a map's size doesn't matter. A part that can't be parsed gives a document row with its error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for map_id, part, content, generator, before in zip(*(batch.column(c).to_pylist() for c in ("map_id", "part", "content", "generator", "before"))):
                head = f"<osm version='0.6' generator={quoteattr(generator)}>" if part == 0 else "<osm>"
                rows = _rows(map_id, f"{head}{content}</osm>".encode())
                yield from _batches(dict(r, ord=r["ord"] + before) if r["kind"] != "document" else r for r in rows if part == 0 or r["kind"] != "document" or r.get("parse_error"))

    return parts.select("map_id", "part", "content", "generator", "before").mapInArrow(run, ELEMENTS)


def _batches(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    """Rows in blocks of ``PART``, so that no file's rows are held at once."""
    rows = iter(rows)
    while some := list(islice(rows, PART)):
        yield pa.RecordBatch.from_pylist(some, schema=_ARROW)


class Maps:
    """Views over parsed elements; ``read`` parses once and lands them as Parquet."""

    def __init__(self, elements: DataFrame):
        self.elements = elements

    @classmethod
    def read(cls, spark: SparkSession, paths: str | list[str], pattern: str = "*.osm") -> Maps:
        return cls(Written(parse(discover(spark, paths, pattern)), "elements", keep=True).df)

    @property
    def documents(self) -> DataFrame:
        return self.elements.where("kind = 'document'").select("map_id", "root_tag", "version", "generator", "parse_error")

    @property
    def nodes(self) -> DataFrame:
        return self.elements.where("kind = 'node'").select("map_id", "ord", "id", "lat", "lon", "action", "visible", "tags", "version", "attributes")

    @property
    def ways(self) -> DataFrame:
        return self.elements.where("kind = 'way'").select("map_id", "ord", "id", "action", "visible", "nds", "tags", "version", "attributes")

    @property
    def relations(self) -> DataFrame:
        return self.elements.where("kind = 'relation'").select("map_id", "ord", "id", "members", "tags", "version", "attributes")

    @property
    def way_nodes(self) -> DataFrame:
        return self.ways.select("map_id", F.col("id").alias("way_id"), F.posexplode("nds").alias("pos", "ref"))


def elements_of(nodes: DataFrame, ways: DataFrame, documents: DataFrame | None = None, relations: DataFrame | None = None) -> DataFrame:
    """Elements again, from tables with the columns of ``Maps``'s views."""
    parts = [nodes.withColumn("kind", F.lit("node")), ways.withColumn("kind", F.lit("way"))]
    if relations is not None:
        parts.append(relations.withColumn("kind", F.lit("relation")))
    if documents is not None:
        parts.append(documents.withColumns({"kind": F.lit("document"), "ord": F.lit(0)}))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    empty = nodes.sparkSession.createDataFrame([], ELEMENTS)
    return empty.unionByName(out, allowMissingColumns=True)


def element_text(row: dict, indent: str = "  ") -> str:
    """One element as XML; attributes in a fixed order, nds before tags."""
    attributes = [(a, row.get(a)) for a in ("id", "action", "visible", "lat", "lon")] + [("version", row.get("version") or "1"), *dict(row.get("attributes") or {}).items()]
    head = " ".join(f"{a}={quoteattr(str(v))}" for a, v in attributes if v is not None)
    inner = [f"<nd ref={quoteattr(r)} />" for r in row.get("nds") or ()]
    inner += ["<member " + " ".join(f"{k}={quoteattr(m[k] or '')}" for k in ("type", "ref", "role")) + " />" for m in row.get("members") or ()]
    inner += [f"<tag k={quoteattr(k)} v={quoteattr(v or '')} />" for k, v in (dict(row.get("tags") or {})).items()]
    if not inner:
        return f"{indent}<{row['kind']} {head} />"
    return "\n".join([f"{indent}<{row['kind']} {head}>", *(indent * 2 + x for x in inner), f"{indent}</{row['kind']}>"])


def _lines(elements: DataFrame) -> DataFrame:
    """(map_id, k, ord, text) of elements: nodes are of kind 0, ways of 1, relations of 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [element_text(dict(r, tags=dict(r["tags"] or ()), attributes=dict(r["attributes"] or ()))) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("map_id"), batch.column("kind"), batch.column("ord"), pa.array(texts, pa.string())], ["map_id", "kind", "ord", "text"])

    columns = ["map_id", "kind", "ord", "id", "version", "lat", "lon", "action", "visible", "attributes", "tags", "nds", "members"]
    lines = elements.where("kind <> 'document'").select(*columns).mapInArrow(run, "map_id string, kind string, ord int, text string")
    rank = F.create_map(*(F.lit(x) for kv in {"node": 0, "way": 1, "relation": 2}.items() for x in kv))[F.col("kind")]
    return lines.select("map_id", rank.alias("k"), "ord", "text")


def to_parts(elements: DataFrame, generator: str = "floorwise") -> DataFrame:
    """(map_id, part, before, generator, content): each map's document in parts, and how many elements are before a part.

    The parts of a map, one after the other, are ``to_xml``'s document without its head and end. A sort over all maps deals
    elements out by range, and a part ends with its range or after ``PART`` elements, so no map lies in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, at, owner, texts = TaskContext.get().partitionId(), 0, None, []

        def part() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"map_id": owner, "task": task, "at": at, "n": len(texts), "content": "\n".join(texts)}], schema=kinds)

        for batch in batches:
            for map_id, text in zip(batch.column("map_id").to_pylist(), batch.column("text").to_pylist()):
                if texts and (map_id != owner or len(texts) == PART):
                    yield part()
                    at, texts = at + 1, []
                owner = map_id
                texts.append(text)
        if texts:
            yield part()

    kinds = pa.schema([("map_id", pa.string()), ("task", pa.int32()), ("at", pa.int32()), ("n", pa.int32()), ("content", pa.string())])
    lines = Written(_lines(elements), "lines")
    dealt = lines.df.orderBy("map_id", "k", "ord", "text").select("map_id", "text").mapInArrow(run, "map_id string, task int, at int, n int, content string")
    parts = Written(dealt, "parts", keep=True)
    lines.discard()
    order = Window.partitionBy("map_id").orderBy("task", "at")  # one row for each part, without its text
    placed = parts.df.select("map_id", "task", "at", (F.row_number().over(order) - 1).alias("part"), (F.sum("n").over(order) - F.col("n")).cast("int").alias("before"))
    return parts.df.drop("n").join(placed, ["map_id", "task", "at"]).select("map_id", "part", "before", F.lit(generator).alias("generator"), "content")


def to_xml(elements: DataFrame, generator: str = "floorwise") -> DataFrame:
    """(map_id, xml): each map's document, nodes before ways before relations, each in order. A document is one row; see ``to_parts``."""
    body = _lines(elements).groupBy("map_id").agg(F.array_sort(F.collect_list(F.struct("k", "ord", "text"))).alias("l"))  # one map's elements
    head = F.lit(f"<?xml version='1.0' encoding='utf-8'?>\n<osm version='0.6' generator='{generator}'>\n")
    return body.select("map_id", F.concat(head, F.array_join(F.transform("l", lambda x: x["text"]), "\n"), F.lit("\n</osm>\n")).alias("xml"))


def write(elements: DataFrame, path: str, generator: str = "floorwise") -> None:
    """One folder of text for each map, partitioned by its whole ``map_id``, so maps of one file name stay apart."""
    documents = to_xml(elements, generator).select(F.col("map_id").alias("map"), F.col("xml").alias("value"))
    documents.write.mode("overwrite").partitionBy("map").option("lineSep", "\n").text(path)
