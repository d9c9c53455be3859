"""Cross-site line deduplication by distinct-site spread.

A HyperLogLog sketch of the sites of each line hash is built by a partial aggregate and
merged across tasks. Lines whose estimate lies within the sketch's error of the threshold
get an exact distinct count; the others are decided by the estimate. Lines of at least
``min_sites`` sites are boilerplate and are removed. A document without any other line is a
syndicated copy; it stays whole and is left to near-duplicate removal.

Lines compare by a 128-bit hash of their trimmed text; lines under ``min_words`` words and
under ``min_chars`` characters are no evidence and stay. The second measure holds where a
language writes without spaces.

Defined results: a null text stays null and has no lines; a null site counts as one site of
its own; repeated rows are cleaned alike; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floorwise.llm.shared import Written, fresh, tidy

MIN_SITES, MIN_WORDS, MIN_CHARS, LG_K = 5, 3, 16, 12
SPACE = "\t\n\x0b\x0c\r "


def _hash(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("line"), line).alias("h2"))


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE))


def _counts(line: Column, min_words: int, min_chars: int) -> Column:
    return (F.length(line) >= min_chars) | line.rlike(rf"^[^\t-\r ]+(?:[\t-\r ]+[^\t-\r ]+){{{min_words - 1}}}")


def _hashes(text: Column, min_words: int, min_chars: int) -> Column:
    """Distinct hashes of a text's lines that count."""
    lines = F.filter(F.transform(F.split(text, "\n"), _trimmed), lambda line: _counts(line, min_words, min_chars))
    return F.array_distinct(F.transform(lines, _hash))


def margin(min_sites: int, lg_k: int) -> int:
    """Three standard errors of the sketch at the threshold, and one site."""
    return 1 + int(3 * 1.04 / 2 ** (lg_k / 2) * min_sites + 0.999)


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS, lg_k: int = LG_K, site: str = "source", text: str = "text") -> DataFrame:
    """(h1, h2) of the lines that occur on at least ``min_sites`` sites."""
    lines = docs.select(F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"), F.explode(_hashes(F.col(text), min_words, min_chars)).alias("h")).select("site", "h.h1", "h.h2")
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites"))
    around = margin(min_sites, lg_k)
    likely = Written(spread.where(F.col("sites") >= min_sites - around), "spread").df
    sure = likely.where(F.col("sites") > min_sites + around).select("h1", "h2")
    near = likely.where(F.col("sites") <= min_sites + around).select("h1", "h2")
    exact = lines.join(near, ["h1", "h2"]).distinct().groupBy("h1", "h2").count().where(F.col("count") >= min_sites)
    return sure.unionByName(exact.select("h1", "h2"))


def without_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS, lg_k: int = LG_K, site: str = "source", text: str = "text") -> DataFrame:
    """``docs`` with cleaned texts, and ``removed_lines``: how many lines went from each."""
    t1, t2, lines, removed, left = (fresh(docs, n) for n in ("t1", "t2", "boilerplate_lines", "removed_lines", "left_lines"))
    keys = [F.xxhash64(text).alias(t1), F.xxhash64(F.lit("text"), F.col(text)).alias(t2)]
    of_text = docs.where(F.col(text).isNotNull()).select(*keys, F.explode(_hashes(F.col(text), min_words, min_chars)).alias("h")).select(t1, t2, "h.h1", "h.h2")
    with tidy():
        found = Written(boilerplate(docs, min_sites, min_words, min_chars, lg_k, site, text), "boilerplate").df
        hit = of_text.join(found, ["h1", "h2"]).groupBy(t1, t2).agg(F.collect_set(F.struct("h1", "h2")).alias(lines))
        hits = Written(hit, "lines", keep=True).df  # one row for each distinct text with boilerplate
    joined = docs.withColumns({t1: keys[0], t2: keys[1]}).join(hits.hint("merge"), [t1, t2], "left")
    stays = lambda line: ~(_counts(_trimmed(line), min_words, min_chars) & F.array_contains(F.col(lines), _hash(_trimmed(line))))
    # one expression holds all that is made from the lines, so they are filtered once for a row
    both = lambda of: F.struct(F.array_join(of, "\n").alias("text"), F.size(of).alias("lines"))
    part = F.get(F.transform(F.array(F.filter(F.split(F.col(text), "\n"), stays)), both), F.lit(0))
    kept = joined.withColumn(left, F.when(F.col(lines).isNotNull(), part))
    cleaned = F.coalesce(F.length(_trimmed(F.col(left)["text"])) > 0, F.lit(False))
    n_removed = F.size(F.split(F.col(text), "\n")) - F.col(left)["lines"]
    columns = [F.when(cleaned, F.col(left)["text"]).otherwise(F.col(text)).alias(c) if c == text else F.col(c) for c in docs.columns]
    return kept.select(*columns, F.when(cleaned, n_removed).otherwise(0).cast("long").alias(removed))
