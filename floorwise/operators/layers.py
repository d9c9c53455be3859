"""Drawing layers: scoring, filtering, token analytics, comparison of layer lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floorwise.functions.scalars import layer_tokens, score, simple_tokens

#: Weights of layer tokens; a token that is not here counts nothing.
WEIGHTS = {
    "WALL": 5, "COLS": 5, "SLAB": 4, "WINDOW": 3, "GLAZ": 3, "CWMG": 3, "HOLE": 2, "EVTR": 3, "柱": 5, "墙体": 5, "结构柱": 5, "板": 4, "窗": 3, "玻璃": 3, "门": 1,
    "EQPM": 1, "STUCCO": 1, "STAIR": 1, "DOOR": 1, "门窗": 1,
    "SYMB": -5, "DIMS": -5, "TEXT": -4, "FIXT": -4, "HATCH": -4, "STRS": -3, "FLOR": -3, "CASE": -3, "FURN": -3, "TEMP": -10,
    "符号": -5, "尺寸": -5, "文字": -4, "标注": -4, "索引": -4, "填充": -4, "家具": -3, "洁具": -4, "楼梯": -3, "地面": -3, "临时": -10,
    "PLAN": -2, "GRID": -2, "轴号": -2, "标高": -2, "NOTE": -4, "0P": -1, "FRAM": -1, "DETL": -1, "DRAN": -1, "TILE": -1, "SCRE": -1,
}
#: Tokens that always exclude a layer, names that are always kept, the least score.
EXCLUDED = ["TEMP", "临时", "DIMS", "尺寸", "标注", "家具", "填充", "文字", "符号", "索引", "标高", "轴号", "NOTE", "PLAN", "GRID", "HATCH", "FIXT", "洁具"]
KEPT = ["0", "Defpoints", "A—墙体", "A—门窗", "A-WALL"]
LEAST_SCORE = 2


def keeps(raw: Column, decoded: Column) -> Column:
    """Whether a layer stays: by name, by the word WALL, unless excluded, by score."""
    tokens = layer_tokens(decoded)
    excluded = F.arrays_overlap(tokens, F.array(*map(F.lit, EXCLUDED)))
    return F.when(raw.isin(KEPT) | F.upper(raw).contains("WALL"), True).when(excluded, False).otherwise(score(tokens, WEIGHTS) >= LEAST_SCORE)


def by_list(layers: DataFrame, names: DataFrame, column: str = "decoded_name") -> DataFrame:
    """Layers whose name is in a list, whatever the case."""
    wanted = names.select(F.upper("layer").alias("_u")).distinct()
    return layers.withColumn("_u", F.upper(column)).join(wanted, "_u", "left_semi").drop("_u")


def header_free(lines: DataFrame, headers: list[str]) -> DataFrame:
    """(file, line, layer) without blank lines and lines that begin like a header."""
    ok = F.trim("layer") != ""
    for h in headers:
        ok = ok & ~F.col("layer").startswith(h)
    return lines.where(ok).withColumn("layer", F.trim("layer"))


def without_first_line(lines: DataFrame, rules: bool = True, has_header: bool = True) -> DataFrame:
    """Layer lists whose first line is a title; ``rules`` drops lines of dashes behind a letter."""
    kept = lines.where((F.col("line") > (1 if has_header else 0)) & (F.trim("layer") != ""))
    return kept.where(~F.col("layer").rlike("^[A-Z]---+$")) if rules else kept


def token_frequency(layers: DataFrame, by: list[str] = ()) -> DataFrame:
    return layers.select(*by, F.explode(simple_tokens(F.col("layer"))).alias("token")).groupBy(*by, "token").agg(F.count("*").alias("n"))


def most_common(counts: DataFrame, k: int, by: list[str] = (), key: str = "token") -> DataFrame:
    """The ``k`` most frequent of each group; of equal ones the first by name."""
    if not by:
        return counts.orderBy(F.desc("n"), key).limit(k)
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), key))).where(F.col("rank") <= k)


def name_analysis(layers: DataFrame) -> DataFrame:
    """(kind, key, n): layers, separators, segment counts, segments by position, prefixes and suffixes."""
    parts = F.filter(F.split(F.col("layer"), r"[-_$ ]+"), lambda p: p != "")
    cut = layers.select("layer", parts.alias("p"))
    count = lambda df, kind: df.groupBy("key").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "key", "n")
    placed = cut.select(F.posexplode("p").alias("pos", "part"))
    out = count(layers.select(F.col("layer").alias("key")), "layer")
    for more in (
        count(layers.select(F.explode(F.regexp_extract_all("layer", F.lit("([-_$ ])"), F.lit(1))).alias("key")), "separator"),
        count(cut.select(F.size("p").cast("string").alias("key")), "segments"),
        count(placed.select(F.concat_ws(":", "pos", F.upper("part")).alias("key")), "position"),
        count(cut.where(F.size("p") > 0).select(F.upper(F.element_at("p", 1)).alias("key")), "prefix"),
        count(cut.where(F.size("p") > 1).select(F.upper(F.element_at("p", -1)).alias("key")), "suffix"),
    ):
        out = out.unionByName(more)
    return out


def compared(first: DataFrame, second: DataFrame, by: list[str] = ()) -> DataFrame:
    """Each distinct layer with the side it is on: both, first or second."""
    a = first.select(*by, "layer").distinct().withColumn("s", F.lit(1))
    b = second.select(*by, "layer").distinct().withColumn("s", F.lit(2))
    sides = a.unionByName(b).groupBy(*by, "layer").agg(F.sum("s").alias("s"))
    return sides.select(*by, "layer", F.when(F.col("s") == 3, "both").when(F.col("s") == 1, "first").otherwise("second").alias("side"))


def paired_files(originals: DataFrame, filtered: DataFrame) -> DataFrame:
    """Original lists with their filtered lists, by file name."""
    name = F.regexp_extract("file", "([^/]*)$", 1)
    o = originals.select(F.col("file").alias("original"), F.replace(name, F.lit("layer-info-"), F.lit("layer-info-filtered-")).alias("_n"))
    return o.join(filtered.select(F.col("file").alias("filtered"), name.alias("_n")), "_n").drop("_n")
