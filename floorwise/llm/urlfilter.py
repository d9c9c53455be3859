"""URL filters: pattern rules behind an index of rare literal tokens.

Every rule has a regular expression and literal tokens that any URL it matches must hold.
A rule is filed under that of its tokens which fewest URLs hold. The tokens of a URL fetch
candidate rules, and only their expressions run. Host rules are such rules too; the longest
that fits decides, and where none fits, pattern rules block and all else is allowed.

A list of at most ``MOST_RULES`` rules is sent to executors with its index. A longer one, or
a table of rules, is filed and fetched by joins over distinct URLs. Both run the same
expressions by the same engine, so verdicts do not depend on the number of rules.

Defined results: a null URL, or one without ``://``, has an empty host and path, matches no
host rule and is allowed; URLs of any length are matched whole; repeated rows get the same
verdict; of equally long host rules the first by text wins, and of equal ones ``allow``;
pages' own columns named host, path, rule or verdict give way to the new ones; an empty table
stays empty. Case is folded for A-Z only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from floorwise.llm.shared import fresh

MOST_RULES = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(_UPPER, _LOWER)


@dataclass(frozen=True)
class Rule:
    """``name`` is shown for host rules; ``tokens`` are whole literal tokens of every match;
    a ``folded`` rule's pattern sees the URL with A-Z lower-cased."""

    action: str
    pattern: str
    tokens: tuple[str, ...]
    name: str | None = None
    folded: bool = False


RULES_SCHEMA = "action string, pattern string, tokens array<string>, name string, folded boolean"


def tokens_of(target: str) -> set[str]:
    return set(re.findall("[0-9a-z]+", target.translate(_FOLD)))


def host_rule(action: str, host: str, path: str) -> Rule:
    """Fits ``host`` and its subdomains where the URL's path starts with ``path``."""
    whole = host + path[: path.rfind("/") + 1]  # the last segment may go on in a URL
    return Rule(action, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tuple(sorted(tokens_of(whole))), host + path)


def phrase_rule(phrase: str) -> Rule:
    """Blocks URLs that hold the words of ``phrase`` in a row, as whole tokens with one mark between."""
    words = phrase.split()
    return Rule("block", rf"(?:^|[^0-9a-z]){'[^0-9a-z]'.join(words)}(?:$|[^0-9a-z])", tuple(dict.fromkeys(words)), folded=True)


#: Words and phrases of URLs that lead to no prose.
PHRASES = [
    "casino", "poker", "porn", "xxx", "viagra", "torrent", "warez", "login", "signin", "signup", "checkout", "cart", "captcha", "adserver", "doubleclick", "tracker",
    "add to cart", "sign in", "log in", "sign up", "my account", "forgot password", "reset password", "wp admin", "wp login php", "cgi bin", "privacy policy",
    "cookie policy", "terms of service", "terms of use", "online casino", "sports betting", "payday loan", "live cams", "free download", "search results",
]
PATTERNS = [phrase_rule(p) for p in PHRASES]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path of a URL; both empty without ``://``."""
    value = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(value, "://") > 0, F.substring(value, F.instr(value, "://") + 3, F.length(value))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def _url_tokens(target: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(F.translate(target, _UPPER, _LOWER), "[^0-9a-z]+")), "")


def token_counts(targets: DataFrame, tokens: DataFrame) -> DataFrame:
    """(token, count): in how many rows of ``target`` each of the wanted tokens occurs."""
    return targets.select(F.explode(_url_tokens(F.col("target"))).alias("token")).join(tokens.distinct(), "token", "left_semi").groupBy("token").count()


def filed(rules: list[Rule], counts: dict[str, int]) -> dict[str, list[int]]:
    """Rule numbers by their rarest token; under ``""`` those that have no token."""
    index: dict[str, list[int]] = {}
    for n, rule in enumerate(rules):
        token = min(rule.tokens, key=lambda t: (counts.get(t, 0), t), default="")
        index.setdefault(token, []).append(n)
    return index


def best(rules: list[Rule], found: list[int]) -> tuple[str | None, str]:
    """The rule's name and the verdict from the numbers of the rules that match."""
    named = [rules[n] for n in found if rules[n].name is not None]
    if named:
        first = min(named, key=lambda r: (-len(r.name), r.name, r.action))
        return first.name, first.action
    return None, "block" if any(rules[n].action == "block" for n in found) else "allow"


def judge(pages: DataFrame, rules: list[Rule] | DataFrame, url: str = "url", most_rules: int = MOST_RULES) -> DataFrame:
    """Add host, path, rule and verdict to pages; ``rules`` is a list, or a table of ``RULES_SCHEMA``."""
    host, path = host_and_path(F.col(url))
    made = {"host": host, "path": path}
    kept = [c for c in pages.columns if c.lower() not in {"host", "path", "rule", "verdict"}]
    parsed = pages.select(*kept, *(c.alias(n) for n, c in made.items()))
    spark = pages.sparkSession
    if isinstance(rules, DataFrame):
        return _joined(parsed, rules)
    if len(rules) > most_rules:
        return _joined(parsed, spark.createDataFrame([tuple(asdict(r).values()) for r in rules], RULES_SCHEMA))
    wanted = spark.createDataFrame([(t,) for t in sorted({t for r in rules for t in r.tokens})], "token string")
    counts = token_counts(parsed.select(F.concat("host", "path").alias("target")), wanted)
    index = filed(rules, {r["token"]: r["count"] for r in counts.collect()})  # a row for each token of the list
    shared = spark.sparkContext.broadcast((rules, index))
    schema = T.StructType([*parsed.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, index = shared.value
        compiled: dict[int, re.Pattern] = {}
        always = index.get("", [])
        for batch in batches:
            names, verdicts = [], []
            for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist()):
                target = h + p
                folded, found = target.translate(_FOLD), []
                for n in {n for t in tokens_of(target) if t in index for n in index[t]}.union(always):
                    if n not in compiled:
                        compiled[n] = re.compile(rules[n].pattern)
                    if compiled[n].search(folded if rules[n].folded else target):
                        found.append(n)
                name, verdict = best(rules, found)
                names.append(name)
                verdicts.append(verdict)
            columns = [*batch.columns, pa.array(names, pa.string()), pa.array(verdicts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "rule", "verdict"])

    return parsed.mapInArrow(run, schema)


def _matching(candidates: DataFrame) -> DataFrame:
    """The rows (t, pattern, action, name, folded) whose pattern is found in t."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("t").to_pylist(), batch.column("pattern").to_pylist(), batch.column("folded").to_pylist())
            yield batch.filter(pa.array([bool(re.search(pattern, t.translate(_FOLD) if folded else t)) for t, pattern, folded in rows], pa.bool_()))

    return candidates.mapInArrow(run, candidates.schema)


def _joined(parsed: DataFrame, rules: DataFrame) -> DataFrame:
    """The same with rules of any number: they are filed, and fetched for distinct URLs, by joins on tokens."""
    rules = rules.distinct()
    urls = parsed.select(F.concat("host", "path").alias("t")).distinct()
    of_rule = rules.withColumn("token", F.explode_outer("tokens"))
    counts = token_counts(parsed.select(F.concat("host", "path").alias("target")), of_rule.where("token is not null").select("token"))
    rarest = F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("token", F.lit("")).alias("token")))["token"]
    filed_rules = of_rule.join(counts, "token", "left").groupBy("action", "pattern", "name", "folded").agg(rarest.alias("token"))
    fetched = urls.select("t", F.explode(F.array_union(_url_tokens(F.col("t")), F.array(F.lit("")))).alias("token")).join(filed_rules, "token")
    order = F.when(F.col("name").isNotNull(), F.struct((-F.length("name")).alias("l"), F.col("name").alias("n"), F.col("action").alias("a")))
    found = _matching(fetched.select("t", "pattern", "action", "name", "folded")).groupBy("t").agg(F.min(order).alias("first"), F.max(F.col("action") == "block").alias("blocks"))
    target = fresh(parsed, "target")
    judged = found.select(F.col("t").alias(target), F.col("first.n").alias("rule"), F.coalesce(F.col("first.a"), F.when(F.col("blocks"), "block").otherwise("allow")).alias("verdict"))
    joined = parsed.withColumn(target, F.concat("host", "path")).join(judged, target, "left")
    return joined.select(*parsed.columns, "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))
