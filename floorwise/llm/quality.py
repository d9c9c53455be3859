"""Quality rules by weak supervision, with DataFrame functions alone.

Each rule votes for a document, against it, or abstains; rules about words of languages in Latin letters
say nothing of texts in other scripts, which then weigh by their other rules alone. Documents are counted by their
pattern of votes (at most 4 to the power of the number of rules), expectation-maximisation
over these counts estimates how often each rule votes for, votes against and abstains on good
and on bad documents, and a document is kept if its posterior probability of being good is at
least ``threshold``. Where estimation begins weighs as much as ``PRIOR_DOCUMENTS`` documents
whatever the table's size, so a corpus soon outweighs it.
A base check fails documents of too few or mostly repeated words whatever the rules say.

Defined results: a null text has no words and fails the base check, as does an empty one;
an empty table gives an empty table; repeated rows each count and get the same verdict; texts
of any length are counted whole. ``scored`` takes the place of columns that have its own
columns' names; ``good_documents`` keeps all columns whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floorwise.llm.shared import Written, shielded

WINDOW = 8
MIN_WORDS, MOST_REPEATED_PERCENT = 20, 30
ITERATIONS, THRESHOLD = 20, 0.5
#: Where estimation begins: the share of good documents, how often a rule votes against,
#: abstains and votes for on good and on bad ones, and how many documents all this weighs.
PRIOR, PRIOR_DOCUMENTS = 0.8, 100
ON_GOOD, ON_BAD = {-1: 0.02, 0: 0.38, 1: 0.6}, {-1: 0.3, 0: 0.3, 1: 0.4}

#: The white space that separates words, and the symbols that are counted.
SPACE = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = "the of and to in is that der die und das ist nicht le la et les des un une el los que del por para y en con su una al lo".split()

#: What ends a sentence (but for exclamation marks, which are counted by themselves) in Latin, Greek and
#: Cyrillic, Han and kana, Arabic, Devanagari, Armenian, Ethiopic, Burmese, Khmer and Tibetan writing.
STOPS = ".?;。？؟۔।॥։።၊။។།"

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_stops", "n_function_words", "n_wide")

#: Latin letters have one byte, accented ones two; in other scripts all letters have two or more.
LATIN = "2 * n_wide < word_chars"
#: Rules: name, the condition of a vote against, the condition of a vote for; else it abstains. A fourth condition
#: says which documents the rule is about at all.
RULES = (
    ("symbols", "10 * n_symbols > n_words", "false"),
    ("symbol_share", "100 * n_symbols > 4 * word_chars", "false"),
    ("repeated_words", "5 * n_repeat_words > n_words", "false"),
    ("repeated_lines", "n_dup_lines >= 3 and 10 * n_dup_lines > 3 * n_lines", "false"),
    ("upper_case", "10 * n_upper > 3 * word_chars", "false"),
    ("marks", "10 * n_marks > n_words", "false"),
    ("function_words", "100 * n_function_words < 3 * n_words", "100 * n_function_words >= 12 * n_words", LATIN),
    ("word_length", "word_chars > 12 * n_words or word_chars < 2 * n_words", "false", LATIN),
    ("sentences", "200 * n_stops < n_words", "100 * n_stops between 2 * n_words and 25 * n_words"),
    ("length", "n_words < 20", "n_words >= 100"),
)


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def with_features(df: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Add ``FEATURES``; counts are of the whole text."""
    lower = {f.lower() for f in (*FEATURES, "_text", "_words", "_windows")}
    kept = [c for c in df.columns if c.lower() not in lower and (keep_text or c != text)]
    value = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(value, F.lit(SPACE))
    words = df.select(*kept, value.alias("_text"), F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t-\r]+")).alias("_words"))
    last = F.greatest(F.size("_words") - (WINDOW - 1), F.lit(0))
    windows = words.withColumn("_windows", F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice("_words", i, WINDOW)))))
    hashed = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    doubled = windows.withColumn("_windows", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), hashed))
    both = F.zip_with("_windows", F.slice("_windows", 2, 1 << 30), lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"])).otherwise(F.array().cast("array<int>")))
    places = F.array_sort(F.array_distinct(F.flatten(both)))
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n")),
        lambda a, i: F.struct((i + WINDOW).alias("upto"), (a["n"] + F.least(F.lit(WINDOW), i + WINDOW - a["upto"])).alias("n")),
        lambda a: a["n"],
    )
    t = F.col("_text")
    lined = F.filter(F.split(t, "\n"), lambda line: F.btrim(line, F.lit(SPACE)) != "")
    counted = doubled.select(
        *kept,
        t,
        F.size("_words").cast("long").alias("n_words"),
        F.when(F.col("_windows").isNotNull(), covered).otherwise(0).cast("long").alias("n_repeat_words"),
        lined.alias("_lines"),
    )
    count = lambda characters: (F.length(t) - F.length(_without(t, characters))).cast("long")
    return counted.select(
        *kept,
        "n_words",
        F.length(_without(t, SPACE)).cast("long").alias("word_chars"),
        count(SYMBOLS).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.size("_lines").cast("long").alias("n_lines"),
        count("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"),
        count("!").alias("n_marks"),
        count(STOPS).alias("n_stops"),
        F.regexp_count(F.lower(t), F.lit(r"\b(?:" + "|".join(FUNCTION_WORDS) + r")\b")).cast("long").alias("n_function_words"),
        (F.octet_length(t) - F.length(t)).cast("long").alias("n_wide"),
    )


def vote(rule: tuple[str, ...]) -> Column:
    """-1 against, 1 for, 0 abstains; null where the rule is not about the document."""
    said = F.when(F.expr(rule[1]), -1).when(F.expr(rule[2]), 1).otherwise(0)
    return F.when(F.expr(rule[3]), said) if len(rule) > 3 else said


def base_failed() -> Column:
    return F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words")


def estimate(patterns: list[tuple[tuple[int | None, ...], int]], rules: int, iterations: int = ITERATIONS) -> tuple[float, list[dict[int, float]]]:
    """The prior log-odds and each rule's log-odds by vote, from counts by pattern of votes; a null vote counts nowhere."""
    log_prior = math.log(PRIOR / (1 - PRIOR))
    odds = [{v: math.log(ON_GOOD[v] / ON_BAD[v]) for v in ON_GOOD} for _ in range(rules)]
    first_good, first_bad = PRIOR_DOCUMENTS * PRIOR, PRIOR_DOCUMENTS * (1 - PRIOR)
    for _ in range(iterations if patterns else 0):
        good = [{v: first_good * x for v, x in ON_GOOD.items()} for _ in range(rules)]
        bad = [{v: first_bad * x for v, x in ON_BAD.items()} for _ in range(rules)]
        all_good, all_bad = first_good, first_bad
        for votes, n in patterns:
            p = 1 / (1 + math.exp(-(log_prior + sum(o[v] for o, v in zip(odds, votes) if v is not None))))
            all_good += n * p
            all_bad += n * (1 - p)
            for g, b, v in zip(good, bad, votes):
                if v is not None:
                    g[v] += n * p
                    b[v] += n * (1 - p)
        log_prior = math.log(all_good / all_bad)
        odds = [{v: math.log((g[v] / sum(g.values())) / (b[v] / sum(b.values()))) for v in g} for g, b in zip(good, bad)]
    return log_prior, odds


def scored(df: DataFrame, text: str = "text", threshold: float = THRESHOLD, keep_text: bool = False) -> DataFrame:
    """Add the features, ``base_failed``, ``posterior`` and ``kept``."""
    kept = [c for c in df.columns if c.lower() not in {*FEATURES, "base_failed", "posterior", "kept"} and (keep_text or c != text)]
    featured = with_features(df.select(*{c: 0 for c in [*kept, text]}), text, keep_text).select(*kept, *FEATURES)
    table = Written(featured, "quality").df  # read twice, so that texts are gone through once
    names = [f"v{i}" for i in range(len(RULES))]
    counts = table.select(*(vote(r).alias(n) for r, n in zip(RULES, names))).groupBy(*names).count()
    found = [(tuple(r[n] for n in names), r["count"]) for r in counts.collect()]  # at most 4 ** len(RULES) rows
    patterns = sorted(found, key=lambda c: tuple(-2 if v is None else v for v in c[0]))
    log_prior, odds = estimate(patterns, len(RULES))
    total = F.lit(log_prior)
    for rule, o in zip(RULES, odds):
        v = vote(rule)
        total = total + F.when(v.isNull(), 0.0).when(v == -1, o[-1]).when(v == 1, o[1]).otherwise(o[0])
    posterior = 1 / (1 + F.exp(-total))
    return table.select(*kept, *FEATURES, base_failed().alias("base_failed"), posterior.alias("posterior")).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def good_documents(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are kept, with their own columns whatever their names."""
    plain, back = shielded(docs, [text])
    return back(scored(plain, text, threshold, keep_text=True).where("kept"))
