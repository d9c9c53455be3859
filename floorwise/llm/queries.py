"""The operators' queries on the driver's tables, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floorwise.llm import bpe, chat, decontam, langid, licenses, linededup, merkle, oracles, periodic, pii, quality, simhash, tokenfile, urlfilter
from floorwise.llm.shared import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_bpe")
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_and_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), TOKENIZER).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op2_license_scan", oracles.license_scan(licenses))
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join("licenses.license", ",").alias("licenses"))


@query("op3_quality_rules", oracles.quality_rules(quality))
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.scored(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


HOST_RULES = [
    urlfilter.host_rule("block", "com", "/en/"),
    urlfilter.host_rule("allow", "example.com", "/en/7"),
    urlfilter.host_rule("allow", "net", "/de/"),
    urlfilter.host_rule("block", "example.net", "/de/8"),
    urlfilter.host_rule("block", "org", "/es/"),
]


@query("op4_url_filter", oracles.url_filter(HOST_RULES, urlfilter.PHRASES))
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge(pages, [*HOST_RULES, *urlfilter.PATTERNS]).drop("url")


@query("op5_decontamination", oracles.DECONTAMINATION)
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op6_simhash")
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_classes(table(spark, sf_dir, "documents"), words=3, most_bits=3)


@query("op7_token_files")
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    tokenfile.write(table(spark, sf_dir, "documents"), path, TOKENIZER, end_id=0)
    return tokenfile.documents(spark, path, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op8_line_dedup", oracles.LINE_DEDUP)
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    cleaned = linededup.without_boilerplate(docs)
    return cleaned.select("doc_id", "removed_lines", F.size(F.split("text", "\n")).cast("long").alias("n_lines"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


#: A key for the synthetic tables; a real one comes from the caller's secret store.
PII_KEY = "synthetic-tables"


@query("op9_pii_surrogates")
def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replaced(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def _digests(text: str, spans: list) -> tuple:
    """What a formatted conversation gives when it is read back."""
    turns = chat.parsed(text)
    under = "".join(chat.unescape(text[s:e]) for s, e in spans)
    digest = lambda s: sha256(s.encode()).hexdigest()
    return len(turns), digest("".join(f"{role}\n{body}\n" for role, body in turns)), len(under), digest(under), len(text)


@query("op10_chat_formatting", oracles.chat_formatting(chat))
def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    done = chat.conversations(chat.linear(rows), unique=True)

    def run(batches):
        for batch in batches:
            back = [_digests(t, s) for t, s in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist())]
            columns = [pa.array([b[i] for b in back], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("conversation"), *columns], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return done.select("conversation", "formatted", "loss_spans").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


@query("op11_language_id")
def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(~langid.held_out("doc_id")))
    found = langid.identified(docs.select("doc_id", "text", langid.held_out("doc_id").alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def repeating(docs: DataFrame) -> DataFrame:
    """A tenth of the texts, by id, with a tail that repeats a stretch of their own words."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", "[ \\t-\\r]+"), lambda w: w != "")
    n = F.size("_w").cast("long")
    a, p = F.col("_g") % n, F.lit(1) + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8))
    marked = docs.select("doc_id", "text", g.alias("_g"), F.when(h % 10 == 0, words).alias("_w"))
    placed = marked.withColumn("_a", F.when(n > 0, a)).withColumn("_p", p)
    whole = lambda c: c.cast("int")
    repeated = F.flatten(F.array_repeat(F.slice("_w", whole(F.col("_a") + 1), whole(F.col("_p"))), whole(F.ceil((n - F.col("_a")) / F.col("_p")))))
    changed = F.array_join(F.concat(F.slice("_w", F.lit(1), whole(F.col("_a"))), F.slice(repeated, F.lit(1), whole(n - F.col("_a")))), " ")
    return placed.select("doc_id", F.when(F.size("_w") > 0, changed).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs", oracles.PERIODIC_RUNS)
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.with_runs(repeating(table(spark, sf_dir, "documents").select("doc_id", "text")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = found.withColumn("_best", periodic.longest("runs"))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "_best.start",
        "_best.length",
        "_best.period",
        F.expr("_best.length * 1000 div _best.period").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query("op13_merkle_manifest", oracles.MERKLE_MANIFEST)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = table(spark, sf_dir, "documents").select(*columns)
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    claimed = docs.withColumn("tampered", changed).withColumn("claimed", F.unhex(merkle.leaf([*columns[:-1], "tampered"])))
    found = merkle.manifest(claimed.select(*columns, "claimed"), columns, "source", "doc_id", carried=["claimed"])
    lower = lambda c: F.lower(F.hex(c))
    return merkle.verified(found, "claimed").select(
        "doc_id",
        lower("digest").alias("leaf"),
        lower("subroot").alias("subroot"),
        lower("root").alias("root"),
        F.sha2(lower("proof").cast("binary"), 256).alias("proof_sha256"),
        lower("folded_root").alias("folded_root"),
        "verified",
    )
