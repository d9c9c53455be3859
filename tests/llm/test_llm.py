"""Operators of the llm subpackage against brute force, round trips and odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("floorwise.llm")
from floorwise.llm import bpe, chat, decontam, licenses, linededup, neardup, pii, quality, queries, simhash, tokenfile, urlfilter  # noqa: E402
from floorwise.llm.shared import fresh, slices  # noqa: E402
from floorwise.sources.scratch import Written, scratch_path  # noqa: E402
from tests.conftest import SMALL  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))


def documents(spark, texts, sources=None, first=0):
    return spark.createDataFrame([(first + i, t, "en", (sources or {}).get(i, f"s{i % 3}"), len(t or "")) for i, t in enumerate(texts)], SCHEMA)


ODD = [None, "", "   \n\t ", "one", "one", "<|endoftext|> a <|endoftext|>", "naïve café 中文 🙂  x", LONG, "a" * 5000, "\x00\x1f odd \x85 bytes"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.TOKENIZER)


@pytest.fixture(scope="module")
def small(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


# op 1


def test_pair_index_equals_the_library(library):
    encoder, decoder = (kind(open(queries.TOKENIZER, encoding="utf-8").read()) for kind in (bpe.PairIndexBPE, bpe.Decoder))
    draw = random.Random(3)
    alphabet = [" ", " ", "\n", "\t", "a", "B", "'s", "'ll", "12", "é", "!", "　", "\u0085", "\x1c", "<|endoftext|>", "中", "🙂", "\r", "the", "ing"]
    texts = ["".join(draw.choices(alphabet, k=draw.randint(0, 14))) for _ in range(3000)] + [t for t in ODD if t]
    for text, expected, ids in zip(texts, library.encode_batch(texts, add_special_tokens=False), encoder.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == expected.ids
        assert decoder.decode(ids) == library.decode(expected.ids, skip_special_tokens=False)
    encoder.most = 50  # generations change at every turn
    assert encoder.encode(texts[:200]) == [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts[:200], add_special_tokens=False)]


def test_op1(spark, library, small):
    for r in queries.QUERIES["op1_bpe"](spark, SMALL).collect():
        ids = library.encode(small[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(small[r.doc_id].encode()).hexdigest()


def test_bpe_on_odd_documents(spark):
    df = documents(spark, ODD).withColumn("IDS", F.lit("clash"))
    rows = bpe.decode(bpe.encode(df, queries.TOKENIZER), queries.TOKENIZER).orderBy("doc_id").collect()
    assert [r.decoded for r in rows] == [t or "" for t in ODD]
    once = bpe.encode_and_decode(df, queries.TOKENIZER).orderBy("doc_id").collect()
    assert [(r.ids, r.decoded) for r in once] == [(r.ids, r.decoded) for r in rows]
    assert bpe.encode(df.limit(0), queries.TOKENIZER).count() == 0


# op 2


def brute_licenses(text):
    words = decontam.words_of(text)
    shingles, n = licenses.shingles_of(words), max(1, len(words) - 4) if words else 0
    found = set()
    for name, template in licenses.TEMPLATES.items():
        t = set(licenses.shingles_of(decontam.words_of(template)))
        c = licenses.size_class(len(t))
        if any(len(t & set(shingles[k : k + 2 * c])) >= 0.8 * len(t) for k in range(0, n, c)):
            found.add(name)
    return found


def test_licenses(spark, small):
    for name, text in licenses.TEMPLATES.items():
        shingles = len(set(licenses.shingles_of(decontam.words_of(text))))
        assert 1 - (1 - licenses.least_jaccard(shingles)) ** licenses.BANDS > 0.999, name
    mixed = [*ODD, "x " * 333 + licenses.TEMPLATES["MIT-grant"] + " y" * 77, licenses.TEMPLATES["GPL-3.0"].upper(), licenses.TEMPLATES["BSD-clause"].replace("binary", "other")]
    for r in licenses.scan(documents(spark, mixed)).collect():
        assert {m.license for m in r.licenses} == brute_licenses(mixed[r.doc_id])
        for m in r.licenses:
            part = (mixed[r.doc_id] or "").encode()[m.start : m.end]
            assert part and m.containment >= 0.8
    rows = queries.QUERIES["op2_license_scan"](spark, SMALL).collect()
    assert {r.doc_id: set(filter(None, r.licenses.split(","))) for r in rows} == {d: brute_licenses(t) for d, t in small.items()}


# op 3


def test_licenses_are_found_under_edits():
    """Recall of templates with changed words, wherever in a text; shares are counted by tuples of words, not by the module's shingles."""
    draw, index = random.Random(4), licenses.Index(licenses.TEMPLATES)
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    fives = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    due = found = 0
    for name, template in licenses.TEMPLATES.items():
        for _ in range(60):
            w = split(template)
            for _ in range(draw.randint(0, max(1, len(w) // 25))):
                at, kind = draw.randrange(len(w)), draw.choice(["changed", "inserted", "left out"])
                w[at : at + (kind != "inserted")] = [] if kind == "left out" else [f"edit{draw.random()}"]
            before, after = ([f"w{draw.random()}" for _ in range(draw.randint(0, 400))] for _ in range(2))
            share = len(fives(w) & fives(split(template))) / len(fives(split(template)))
            hits = index.scan([" ".join([*before, *w, *after])])[0]
            due += share >= 0.8
            found += share >= 0.8 and name in hits
            assert share >= 0.8 or name not in hits
    assert due > 500 and found / due >= 0.99


def test_licenses_at_a_lower_containment(spark):
    """A caller's containment sets the number of bands; what lies beside a document in its batch changes nothing."""
    assert licenses.bands_for(licenses.TEMPLATES) == licenses.BANDS < licenses.bands_for(licenses.TEMPLATES, 0.3)
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.lower())
    draw, template = random.Random(8), split(licenses.TEMPLATES["MIT-text"])
    texts = []
    for _ in range(120):
        n = int(0.42 * len(template))
        at = draw.randrange(len(template) - n)
        texts.append(" ".join([f"w{draw.random()}" for _ in range(draw.randint(0, 200))] + template[at : at + n]))
    rows = licenses.scan(documents(spark, texts), {"MIT-text": licenses.TEMPLATES["MIT-text"]}, containment=0.4).collect()
    assert sum(bool(r.licenses) for r in rows) >= 119
    index = licenses.Index(licenses.TEMPLATES)
    short = [licenses.TEMPLATES["MIT"], licenses.TEMPLATES["GPL-3.0"], *texts[:20], licenses.TEMPLATES["CC-BY-NC-4.0"]]
    assert index.scan(short) == [index.scan([t])[0] for t in short]


def test_licenses_of_odd_tables(spark):
    mit = licenses.TEMPLATES["MIT"]
    df = documents(spark, [f"{mit} x " * 40, mit, mit, None, ""]).selectExpr("*", "'clash' licenses")
    rows = licenses.scan(df, keep_text=True).orderBy("doc_id").collect()
    assert [[m.license for m in r.licenses] for r in rows] == [["MIT"]] * 3 + [[], []] and rows[0].licenses[0].start == 0 and rows[1].text == mit
    assert licenses.scan(df.limit(0)).count() == 0


def brute_features(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_features(spark, small):
    texts = [*ODD, "a b c d e f g h a b c d e f g h", "x\nx\n x\n\n", "1 " * 40, *list(small.values())[:60]]
    for r in quality.scored(documents(spark, texts)).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_features(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept)
    assert quality.scored(documents(spark, []).limit(0)).count() == 0


def test_quality_agrees_with_labels(spark):
    sf = SMALL.replace("0.001", "0.01")
    kept = {r.doc_id: r.kept for r in queries.QUERIES["op3_quality_rules"](spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    right = [kept[r.doc_id] == bool(r.quality) for r in labels]
    assert sum(right) / len(right) > 0.95
    good = [r for r in labels if r.quality]
    assert sum(kept[r.doc_id] for r in good) / len(good) > 0.95


PROSE = {
    "hi": "गाँव के बाहर एक पुराना कुआँ था जिसके पास हर शाम लोग बैठकर बातें करते थे। बच्चे खेलते थे और बूढ़े अपने समय की कहानियाँ सुनाते थे। एक दिन वहाँ एक यात्री आया और उसने पानी माँगा। सबने उसे बैठाया और खाना भी दिया। उसने बदले में दूर देशों की बातें सुनाईं और सब लोग देर रात तक सुनते रहे।",
    "ru": "За деревней стоял старый колодец, возле которого каждый вечер собирались люди. Дети играли, а старики рассказывали о прежних временах. Однажды туда пришёл путник и попросил воды. Его усадили за стол и накормили. В ответ он рассказал о далёких странах, и все слушали его до поздней ночи.",
    "el": "Έξω από το χωριό υπήρχε ένα παλιό πηγάδι όπου κάθε βράδυ μαζεύονταν οι άνθρωποι. Τα παιδιά έπαιζαν και οι γέροι έλεγαν ιστορίες. Μια μέρα ήρθε ένας ταξιδιώτης και ζήτησε νερό. Τον κάθισαν στο τραπέζι και του έδωσαν φαγητό. Εκείνος τους μίλησε για μακρινές χώρες ως αργά τη νύχτα.",
    "ar": "خارج القرية كانت هناك بئر قديمة يجتمع حولها الناس كل مساء. كان الأطفال يلعبون والشيوخ يروون حكايات الزمن القديم. وفي يوم من الأيام جاء مسافر وطلب الماء. أجلسوه وأطعموه، فحدثهم عن بلاد بعيدة. هل سمعتم بها؟ بقي الجميع يستمعون إليه حتى ساعة متأخرة من الليل.",
    "pl": "Za wsią stała stara studnia, przy której co wieczór zbierali się ludzie. Dzieci bawiły się, a starcy opowiadali o dawnych czasach. Pewnego dnia przyszedł tam wędrowiec i poprosił o wodę. Posadzono go przy stole i nakarmiono. W zamian opowiadał o dalekich krajach, a wszyscy słuchali go do późnej nocy.",
}


def test_good_prose_of_any_script_stays(spark, small):
    """Prose stays beside the corpus, whatever its script, and its junk goes."""
    junk = {lang: f"{text.split()[0]} ### $$$ ! " * 30 for lang, text in PROSE.items()}
    texts = [*small.values(), *PROSE.values(), *junk.values()]
    rows = {r.doc_id: r for r in quality.scored(documents(spark, texts)).collect()}
    first = len(small)
    assert {lang: rows[first + i].kept for i, lang in enumerate(PROSE)} == dict.fromkeys(PROSE, True)
    assert not any(rows[first + len(PROSE) + i].kept for i in range(len(junk)))
    mixed = quality.scored(documents(spark, [*small.values(), *(f"{t} {i}" for i in range(40) for t in PROSE.values())])).where(F.col("doc_id") >= first)
    assert mixed.where("kept").count() == 40 * len(PROSE)


def test_estimation_finds_accurate_rules():
    draw = random.Random(5)
    votes = Counter()
    for _ in range(4000):
        good = draw.random() < 0.8
        votes[tuple(-1 if draw.random() < (0.02 if good else p) else (1 if draw.random() < (0.7 if good else 0.2) else 0) for p in (0.6, 0.5, 0.1))] += 1
    prior, odds = quality.estimate(sorted(votes.items()), 3)
    assert prior > 0.8 and odds[0][-1] < odds[2][-1] < 0
    for p, o in zip((0.6, 0.5, 0.1), odds):  # the true odds of each vote, an abstention being one
        true = {-1: 0.02 / p, 0: 0.98 * 0.3 / ((1 - p) * 0.8), 1: 0.98 * 0.7 / ((1 - p) * 0.2)}
        assert all(abs(o[v] - math.log(x)) < 0.5 for v, x in true.items())
    assert quality.estimate([], 3)[1] == quality.estimate([], 3, 0)[1]
    # a rule that is not about some documents learns from the others alone
    apart = [(v, n) for v, n in sorted(votes.items())] + [((v[0], v[1], None), 3 * n) for v, n in sorted(votes.items())]
    assert quality.estimate([(v, n) for v, n in apart if v[2] is not None], 3)[1][2] == pytest.approx(quality.estimate(apart, 3)[1][2], abs=0.3)


# op 4


def test_urls(spark):
    rules = [*queries.HOST_RULES, *urlfilter.PATTERNS]
    urls = [None, "", "no scheme", "http://EXAMPLE.com/en/7", "https://a.b.example.com/en/71?x#y", "ftp://other.com/en/", "http://notcom/en/1", "http://x.net/de/8", "http://example.net/de/8", "http://m.example.net/de/81", "http://q.org/es/", "http://q.org", "http://q.org?/es/", "http://a.fr/Casino/1", "http://a.fr/casinos", "http://x.com/en"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate([*urls, urls[3]])], "page_id long, url string, verdict string")
    expected = [None, None, None, ("example.com/en/7", "allow"), ("example.com/en/7", "allow"), ("com/en/", "block"), None, ("net/de/", "allow"), ("example.net/de/8", "block"), ("example.net/de/8", "block"), ("org/es/", "block"), None, None, None, None, None, ("example.com/en/7", "allow")]
    for most in (1000, 2):  # sent to executors, joined by token
        got = urlfilter.judge(pages, rules, most_rules=most).orderBy("page_id").collect()
        assert [(r.rule, r.verdict) if r.rule else None for r in got] == expected
        assert got[13].verdict == "block" and got[14].verdict == "allow" and (got[3].host, got[3].path) == ("example.com", "/en/7")
    assert urlfilter.judge(pages.limit(0), rules).count() == 0


def test_verdicts_do_not_depend_on_the_number_of_rules(spark):
    rules = [*queries.HOST_RULES, *urlfilter.PATTERNS, urlfilter.Rule("block", "[^0-9]{9}$", ()), urlfilter.host_rule("block", "example.com", "/en/7"), urlfilter.host_rule("block", "xn--k.com", "/é")]
    urls = ["http://a.b/po\u212aer/1", "http://a.b/POKER/1", "http://a.b/tor\u212aent9", "http://a.b/WP-login.php", "http://a.b/wp/x/admin.php5", "http://a.b/add_to.cart?1", "http://a.b/add--to-cart7", "http://XN--K.com/é/" + "x" * 9000, "http://XN--\u212a.com/é1", "http://a.b/ſignin1", "http://example.com/en/7"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    few, many = ([tuple(r) for r in urlfilter.judge(pages, rules, most_rules=n).orderBy("page_id").collect()] for n in (10_000, 0))
    table = spark.createDataFrame([(r.action, r.pattern, list(r.tokens), r.name, r.folded) for r in rules], urlfilter.RULES_SCHEMA)
    assert few == many == [tuple(r) for r in urlfilter.judge(pages, table).orderBy("page_id").collect()]
    assert [r[-1] for r in few] == ["block" if i in (1, 3, 5, 7) else "allow" for i in range(11)]


def test_rules_are_filed_under_their_rarest_token():
    rules = [urlfilter.host_rule("block", "example.com", "/en/7"), urlfilter.Rule("block", "x+", ())]
    assert rules[0].tokens == ("com", "en", "example")
    assert urlfilter.filed(rules, {"com": 9, "en": 3, "example": 5}) == {"en": [0], "": [1]}


# op 5


def test_decontamination(spark):
    words = [f"w{i}" for i in range(30)]
    items = [(1, " ".join(words[:12])), (2, "Short, item!"), (None, " ".join(words[15:25])), (3, None), (3, "..."), (4, "Short item")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    texts = [*ODD, "pre " + ", ".join(words[:12]).upper() + " post", " ".join(words[1:11]), " ".join(words[2:11]), "a SHORT-item b short item", "é " + " ".join(words[15:25]), " ".join(words[:25])]
    found = {r.doc_id: r for r in decontam.scan(documents(spark, texts).withColumn("N_HIT", F.lit(1)), benchmark).collect()}
    at = len(ODD)
    assert [(found[at + i].n_hit, found[at + i].items) for i in range(6)] == [(12, ["1"]), (10, ["1"]), (0, []), (4, ["2", "4"]), (10, ["null"]), (22, ["1", "null"])]
    assert found[0].n_words == 0 and not found[7].contaminated
    (start, end), = found[at].hit_spans
    assert texts[at].encode()[start:end].decode() == ", ".join(words[:12]).upper()
    assert decontam.decontaminated(documents(spark, texts), benchmark).count() == at + 1
    assert decontam.scan(documents(spark, texts), benchmark.limit(0)).where("contaminated").count() == 0


def test_decontamination_in_blocks(spark, monkeypatch):
    texts = [" ".join(f"t{j}x{i}" for i in range(15)) for j in range(8)]
    monkeypatch.setattr(decontam, "MOST_WINDOWS", 20)
    benchmark = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    built = []
    monkeypatch.setattr(decontam, "Written", lambda df, name: built.append(name) or Written(df, name))
    df = documents(spark, [*texts, None, " ".join(texts)]).selectExpr("*", "'x' hits")
    rows = decontam.scan(df, benchmark, keep_text=True).orderBy("doc_id").collect()
    assert [r["items"] for r in rows] == [*([str(i)] for i in range(8)), [], [str(i) for i in range(8)]] and len(built) == 2
    assert [r.n_hit for r in rows] == [15] * 8 + [0, 120] and {r.hits for r in rows} == {"x"} and rows[9].text == " ".join(texts)
    assert decontam.scan(df.limit(0), benchmark).count() == 0


# op 6


def test_golay_keys_meet():
    golay, draw = simhash.Golay(), np.random.default_rng(1)
    codewords = [m << 11 | simhash._remainder(m << 11) for m in range(1 << 12)]
    assert min(c.bit_count() for c in codewords[1:]) == 7
    x = draw.integers(0, 1 << 23, 400)
    _, several = golay.keys(x)
    assert 400 < len(several) <= 2400
    for a in x[:150].tolist():
        keys = set(golay.keys(np.array([a]))[1].tolist())
        assert len(keys) in (1, 6)
        i, j = (1 << int(k) for k in draw.choice(23, 2, replace=False))
        assert int(golay.index(np.array([a ^ i]))[0]) in keys
        assert keys & set(golay.keys(np.array([a ^ i ^ j]))[1].tolist())


def test_links_equal_brute_force(spark):
    draw = random.Random(11)
    values = {0, (1 << 64) - 1}
    for _ in range(120):
        x = draw.getrandbits(64)
        values.add(x)
        for n in range(6):
            y = x
            for bit in draw.sample(range(64), n):
                y ^= 1 << bit
            values.add(y)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    for most in (0, 2, 3):
        got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "f long"), most).collect()}
        expected = {tuple(sorted((a, b))) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= most}
        assert got == expected
    with pytest.raises(ValueError):
        simhash.links(spark.range(1).withColumnRenamed("id", "f"), 4)


def test_joining_links_of_a_dense_group(spark):
    draw = random.Random(3)
    values = {draw.getrandbits(64) for _ in range(40)}
    for x in sorted(values)[:3]:  # hundreds that differ in one to three bits of one another, and chains of these
        values |= {x ^ 1 << i ^ 1 << j for i in range(12) for j in range(i)} | {x ^ 0b1111 << i for i in range(20, 50)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    nodes = spark.createDataFrame([(v,) for v in signed], "f long")
    label = lambda pairs: {(r.node, r.label) for r in simhash.components(pairs).collect()}
    joining = simhash.joining_links(nodes)
    assert label(joining) == label(simhash.links(nodes)) and joining.count() < simhash.links(nodes).count() / 2


def test_sketches_never_overstate():
    draw = np.random.default_rng(2)
    for n, m in ((1, 1), (70, 60), (300, 1000), (5000, 200)):
        pool = draw.integers(-(1 << 63), 1 << 63, n + m, dtype=np.int64)
        x, y = np.unique(pool[:n]), np.unique(np.concatenate([pool[n // 2 : n], pool[n : n + m // 2]]))
        assert neardup.least_difference(neardup.sketch(x), neardup.sketch(y)) <= len(np.setxor1d(x, y))
        assert neardup.least_difference(neardup.sketch(x), neardup.sketch(x)) == 0


def brute_fingerprint(text, k):
    import xxhash

    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_op6_and_odd_documents(spark, small, monkeypatch):
    monkeypatch.setattr(simhash, "STEP", 100)
    for t in [*ODD, *list(small.values())[:15]]:
        assert simhash.fingerprint(t, 3) == brute_fingerprint(t, 3)
    rows = queries.QUERIES["op6_simhash"](spark, SMALL).collect()
    fps = {r.doc_id: int(r.fingerprint, 16) for r in rows}
    label = {d: d for d in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if label[b] < label[a] and (fps[a] ^ fps[b]).bit_count() <= 3:
                    label[a], changed = label[b], True
    assert {r.doc_id: r.component_id for r in rows} == label
    odd = simhash.near_duplicate_classes(documents(spark, ODD)).collect()
    assert {r.doc_id: r.component_id for r in odd if r.doc_id < 5} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3}
    kept = simhash.keep_one_of_each(documents(spark, [*ODD, *ODD]).union(documents(spark, ODD)))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3, 5, 6, 7, 8, 9] and kept.columns == documents(spark, []).columns
    assert simhash.near_duplicate_classes(documents(spark, ODD).limit(0)).count() == 0


# op 7


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_token_files_round_trip(kind):
    draw = np.random.default_rng(2)
    docs = [draw.integers(0, 2**32 if n % 2 else 50_000, n, dtype=np.uint32) for n in (0, 1, 7, 1000, 65, 3)]
    ids = [5, None, 7, 8, 9, 10]
    file = tokenfile.TokenFile(tokenfile.pack(ids, [d.tobytes() for d in docs], kind, block_ids=64))
    whole = np.concatenate(docs)
    assert file.doc_ids == ids and file.lengths.tolist() == [len(d) for d in docs]
    assert (file.ids(0, len(whole)) == whole).all() and (file.ids(60, 200) == whole[60:200]).all() and len(file.ids(9, 9)) == 0
    with pytest.raises(ValueError):
        tokenfile.TokenFile(b"something else")


def test_op7(spark, library, small):
    rows = {r.doc_id: r for r in queries.QUERIES["op7_token_files"](spark, SMALL).collect()}
    start = 0
    for d in sorted(small):
        ids = np.array([*library.encode(small[d], add_special_tokens=False).ids, 0], "<u4")
        assert (rows[d].start, rows[d].n_tokens, rows[d].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_files_without_other_columns(spark, library, tmp_path):
    df = documents(spark, ["b", "a", None]).selectExpr("*", "'x' payload", "'y' ids", "'z' start")
    tokenfile.write(df, f"{tmp_path}/files", queries.TOKENIZER, end_id=0)
    rows = tokenfile.documents(spark, f"{tmp_path}/files").orderBy("doc_id").collect()
    assert [r.n_tokens for r in rows] == [2, 2, 1] and [r.start for r in rows] == [0, 2, 4]


def test_token_files_of_odd_documents(spark, library, monkeypatch):
    df = documents(spark, ODD).union(spark.createDataFrame([(None, "x", "", "", 1), (3, "again", "", "", 1)], SCHEMA))
    path = scratch_path(spark, "odd")
    tokenfile.write(df, path, queries.TOKENIZER)
    rows = sorted(tokenfile.documents(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 0, 1, 2, 3, 3, *range(4, len(ODD))]
    assert library.decode(np.frombuffer(rows[4].ids, "<u4").tolist()[:-1], skip_special_tokens=False) == "again"
    empty = scratch_path(spark, "none")
    tokenfile.write(df.limit(0), empty, queries.TOKENIZER)
    assert tokenfile.documents(spark, empty).count() == 0


# op 8


def test_line_dedup(spark):
    banner, rest = "Subscribe to our newsletter today", [f"Document number {i} has its own words and quite a few more of them here" for i in range(9)]
    texts = [f"{rest[i]}\n  {banner} \n{rest[i]} end" for i in range(9)] + [rest[0], None, "", "As.\nAs."]
    sources = {i: f"s{min(i, 5)}" for i in range(9)}
    rows = linededup.without_boilerplate(documents(spark, texts, sources).withColumn("removed_lines", F.lit("clash")), min_sites=5).orderBy("doc_id").collect()
    assert [r["_removed_lines"] for r in rows] == [1] * 9 + [0] * 4
    assert all(banner not in (r.text or "") for r in rows) and rows[10].text is None and rows[12].text == "As.\nAs."
    unchanged = linededup.without_boilerplate(documents(spark, texts, sources), min_sites=7).collect()
    assert {r.doc_id: r.text for r in unchanged} == dict(enumerate(texts))
    copies = documents(spark, ["One whole text of a page.\nAnd another line of it."] * 8, {i: f"s{i}" for i in range(8)})
    assert {r.text for r in linededup.without_boilerplate(copies).collect()} == {"One whole text of a page.\nAnd another line of it."}
    assert linededup.without_boilerplate(copies.limit(0)).count() == 0


# op 9

PERSONAL = [
    "Mrs. Anna Smith wrote to Mr Smith at été.19@mail5.example.com and ÉTÉ.19@MAIL5.EXAMPLE.COM.",
    'Mr John Smith: 152.143.123.131, 4785380592391139$$$ token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"',
    "+1 (826) 555-4081 190.137.223.204 123-45-6789 4785 3805 9239 1139 Госпожа Ирина Петрова, Herr Müller",
]


def test_surrogates(spark):
    texts = [*PERSONAL, None, "", "nothing personal in 1999", PERSONAL[0], "x@y.zz " * 4000]
    rows = [r.text for r in pii.replaced(documents(spark, texts), "key").orderBy("doc_id").collect()]
    for private in ("Smith", "Anna", "mail5", "152.143", "4785380592391139", "24be6443", "555-4081", "123-45", "4785 3805", "Ирина", "Müller"):
        assert not any(private in (t or "") for t in rows), private
    first = re.fullmatch(r"Mrs\. (\S+) (\S+) wrote to Mr (\S+) at (\S+) and (\S+)\.", rows[0])
    assert first[2] == first[3] and first[5] == first[4].upper() and first[4].split("@")[0][0] not in "abcdefghijklmnopqrstuvwxyz"
    assert first[1].lower().split("-")[0] in {n.lower() for n in pii.GIVEN["f"]["latin"]}
    assert re.fullmatch(r'Mr \S+ (\S+): \d+\.\d+\.\d+\.\d+, \d{16}\$\$\$ token = "[0-9a-f]{40}"', rows[1])[1] == first[2]
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4} \d+\.\d+\.\d+\.\d+ \d{3}-\d{2}-\d{4} \d{4} \d{4} \d{4} \d{4} Госпожа [А-Яа-яё-]+ [А-Яа-яё]+, Herr \w+", rows[2])
    assert rows[3:6] == [None, "", "nothing personal in 1999"] and rows[6] == rows[0]
    assert len(set(rows[7].split())) == 1 and "x@y.zz" not in rows[7]
    assert pii.replaced(documents(spark, texts).limit(0), "key").count() == 0
    other = pii.replaced(documents(spark, texts[:1]), "another key").first().text
    assert other != rows[0]


def test_surrogates_do_not_collide(spark):
    names = [f"name{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(150)]
    entities = spark.createDataFrame([("given_f", n) for n in names] + [("given_f", "anna"), ("ip", "1.2.3.4")], "type string, entity string")
    rows = pii.surrogates(entities, "key").collect()
    assert len({(r.type, r.surrogate) for r in rows}) == len(rows) == 152
    assert not {r.surrogate for r in rows} & {r.entity for r in rows}


def test_names_without_titles_and_cards_that_check(spark):
    texts = ["John Smith met Mr Smith; Smiths, SMITH and John. Mr John Smith paid with 4111 1111 1111 1111 and 4111-1111-1111-1112.", "John Smith is nobody here.", "γιώργος@παράδειγμα.gr Mr Παπαδόπουλος 山田@例え.jp"]
    rows = [r.text for r in pii.replaced(documents(spark, texts), "key").orderBy("doc_id").collect()]
    name = re.search("Mr ([A-Z][a-z-]+) ([A-Z][a-z]+) paid with (.{19}) and (.{19})[.]", rows[0])
    given, family, valid, invalid = name.groups()
    assert rows[0] == f"{given} {family} met Mr {family}; Smiths, {family.upper()} and {given}. Mr {given} {family} paid with {valid} and {invalid}."
    check = lambda card: sum((2 * d - 9 * (d > 4)) if i % 2 == 0 else d for i, d in enumerate(map(int, re.sub("[^0-9]", "", card)))) % 10
    assert check(valid) == 0 and valid != "4111 1111 1111 1111" and re.fullmatch("(....-){3}....", invalid)
    assert rows[1] == texts[1]
    assert re.fullmatch("[ά-ώ]{7}@[ά-ώ]{10}[.]gr Mr [^a-z ]{12,} [一-龥]{2}@[一-龥あ-ん]{2}[.]jp", rows[2]) and "γιώργος" not in rows[2]


def test_a_full_format_grows(spark, monkeypatch):
    monkeypatch.setattr(pii, "KEPT_FORMAT", 1)
    entities = [("ssn", f"{i}-0") for i in range(10)] + [("email", "a@b.c"), ("card", "1"), ("card", "2")]
    rows = pii.surrogates(spark.createDataFrame(entities, "type string, entity string"), "key").collect()
    assert len({(r.type, r.surrogate) for r in rows}) == 13 and not {(r.type, r.surrogate) for r in rows} & set(entities)
    assert all(re.fullmatch("[0-9]+-[0-9]+", r.surrogate) for r in rows if r.type == "ssn")


def test_the_key_is_in_no_plan(spark):
    import hmac

    entities = spark.createDataFrame([("family", "smith")], "type string, entity string").withColumn("attempt", F.lit(0))
    drawn = entities.withColumn("key", pii.keyed(spark, "my secret key")).withColumn("digest", pii._digest(F.col("attempt")))
    expected = "".join(hmac.new(b"my secret key", f"{n}|family|smith|0".encode(), "sha512").hexdigest() for n in "12")
    assert drawn.first().digest == expected
    plan = drawn._jdf.queryExecution().toString()
    assert "my secret" not in plan and bytes(b ^ 0x36 for b in b"my sec").decode() not in plan


def test_op9_leaves_nothing(spark, small):
    patterns = [r"\S+@mail\d+\.example\.com", r"\b\d{1,3}(?:\.\d{1,3}){3}\b", r"\+1 \(\d{3}\) 555-\d{4}", r"\b\d{16}\b", r"\b[0-9a-fA-F]{40}\b"]
    for r in queries.QUERIES["op9_pii_surrogates"](spark, SMALL).collect():
        private = {m for p in patterns for m in re.findall(p, small[r.doc_id])}
        assert not any(m in r.text for m in private)
        if not private:
            assert r.text == small[r.doc_id]


# op 10


def test_escapes_are_reversible():
    draw = random.Random(7)
    parts = [*chat.CONTROLS, "\\", "\n", "x", "<", "|im_end|>", "</", "[", "]", "0"]
    for _ in range(3000):
        turns = [("".join(draw.choices(parts, k=draw.randint(0, 5))), "".join(draw.choices(parts, k=draw.randint(0, 8)))) for _ in range(draw.randint(0, 4))]
        text, spans = chat.formatted(turns, turns[-1][0] if turns else "assistant")
        assert chat.parsed(text) == turns
        assert [chat.unescape(text[s:e]) for s, e in spans] == [b for r, b in turns if r == (turns[-1][0] if turns else "")]
        for _, body in turns:
            assert not any(c in chat.escape(body) for c in chat.CONTROLS)


def test_reply_trees(spark):
    draw = random.Random(9)
    nodes, children = [], defaultdict(list)
    for tree in range(6):
        for n in range(1, 40):
            parent = None if n == 1 else draw.randint(max(1, n - 6), n - 1)
            nodes.append((tree, n, parent, "assistant" if n % 2 else "user", f"t{tree} n{n}", draw.random()))
            children[tree, parent].append(n)
    by = {(t, n): (p, s) for t, n, p, *_, s in nodes}
    df = spark.createDataFrame([*nodes, (7, 1, None, None, None, None), (8, 5, 99, "user", "orphan", 1.0)], "conversation long, node long, parent long, role string, text string, score double")
    got = defaultdict(dict)
    for r in chat.paths(df, 3).collect():
        got[r.conversation, r.rank, r.leaf][r.back] = r.node
    for tree in range(6):
        ranked = []
        for leaf in (n for n in range(1, 40) if not children[tree, n]):
            path, n = [], leaf
            while n:
                path.append(n)
                n = by[tree, n][0]
            ranked.append((-sum(by[tree, n][1] for n in path) / len(path), leaf, path))
        for rank, (_, leaf, path) in enumerate(sorted(ranked)[:3], 1):
            assert [got[tree, rank, leaf][k] for k in sorted(got[tree, rank, leaf])] == path
    assert got[7, 1, 1] == {0: 1} and got[8, 1, 5] == {0: 5}
    one = {r.conversation: r for r in chat.conversations(df).collect()}
    assert len(one) == 8 and chat.parsed(one[7].formatted) == [("", "")]
    assert chat.paths(df.limit(0)).count() == 0 and chat.conversations(df.limit(0)).count() == 0


def test_reply_trees_with_cycles_and_repeated_ids(spark):
    parents = {1: 3, 2: 1, 3: 2, 4: 2, 5: 4, 6: 6, 10: None, 11: 10, 20: 21, 21: 20}
    rows = [(c, n, p, "user", f"n{n}", 0.0) for c in (1, None) for n, p in parents.items()] + [(1, 11, 10, "user", "n11", 0.0), (1, 11, 12, "user", "n11", 0.0)]
    df = spark.createDataFrame(rows, "conversation long, node long, parent long, role string, text string, score double")
    got = defaultdict(list)
    for r in chat.conversations(df, branches=9).collect():
        got[r.conversation].append([t for _, t in chat.parsed(r.formatted)])
    # 1-2-3 is a cycle that becomes a tree under 1; 6 answers itself
    expected = [["n1", "n2", "n3"], ["n1", "n2", "n4", "n5"], ["n10", "n11"], ["n20", "n21"], ["n6"]]
    assert sorted(got[1]) == sorted(got[None]) == expected


def test_op10(spark):
    rows = {r.conv_id: r for r in queries.QUERIES["op10_chat_formatting"](spark, SMALL).collect()}
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{SMALL}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns[r.conv_id].append((r.role, r.text or ""))
    turns[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    assert rows.keys() == turns.keys()
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, several in turns.items():
        learned = "".join(t for r, t in several if r == "assistant")
        assert (rows[c].n_turns, rows[c].turns_sha256) == (len(several), digest("".join(f"{r}\n{t}\n" for r, t in several)))
        assert (rows[c].loss_chars, rows[c].loss_sha256) == (len(learned), digest(learned))


# shared, pipeline


def test_helpers(spark):
    assert list(slices(["a" * 5, None, "b" * 5, "c"], 6)) == [(0, 3), (3, 4)] and list(slices([])) == []
    assert fresh(spark.range(1).withColumnRenamed("id", "X"), "x") == "_x"


def test_stages_keep_columns_of_any_name(spark):
    import corpus_pipeline

    good = " ".join(f"The item{i} and thing{i * 7} of place{i * 3} in year{i}." for i in range(30))
    df = documents(spark, [good, good, None, "", LONG]).selectExpr("*", "'a' kept", "'b' fingerprint", "'c' n_hit", "'d' removed_lines", "'e' component_id", "'f' row_number", "'g' posterior", "'h' T1")
    for stage in (corpus_pipeline.quality_rules, corpus_pipeline.line_dedup, corpus_pipeline.near_dedup, corpus_pipeline.decontamination):
        out = stage(spark, df, SMALL)
        assert out.columns == df.columns and out.count() >= 1
        assert tuple(out.select(df.columns[5:]).first()) == tuple("abcdefgh")
    assert corpus_pipeline.bpe_ids(spark, df.selectExpr("*", "'x' ids", "'y' decoded"), SMALL).columns == ["doc_id", "lang", "source", "n_tokens", "ids", "round_trip"]
    assert linededup.without_boilerplate(df).columns == [*df.columns, "_removed_lines"]
    with_mentions = pii.replaced(df.withColumn("n_mentions", F.lit(1)), "k")
    assert with_mentions.columns[-1] == "_n_mentions"


def brute_firsts(texts):
    """The smallest id of each group that pairs of a Jaccard index of 0.8 on five-word shingles join."""
    sets, label = {}, {d: d for d in texts}
    for d, text in texts.items():
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    for a in texts:
        for b in texts:
            if a < b and label[a] != label[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = {d: low if x == high else x for d, x in label.items()}
    return set(label.values())


def test_pipeline_stages(spark, small, library):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").cache()
    kept = corpus_pipeline.quality_rules(spark, docs, SMALL)
    verdicts = {r.doc_id: r.kept for r in queries.QUERIES["op3_quality_rules"](spark, SMALL).collect()}
    assert {r.doc_id for r in kept.collect()} == {d for d, k in verdicts.items() if k}
    lined = corpus_pipeline.line_dedup(spark, docs, SMALL)
    assert lined.count() == docs.count() and lined.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in lined.where("text is not null").collect() if r.text != small[r.doc_id])
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SMALL).collect()} == brute_firsts(small)
    hit = {r.doc_id for r in queries.QUERIES["op5_decontamination"](spark, SMALL).where("contaminated").collect()}
    assert {r.doc_id for r in corpus_pipeline.decontamination(spark, docs, SMALL).collect()} == small.keys() - hit
    done = corpus_pipeline.run(spark, SMALL).collect()
    assert done and all(r.round_trip and r.n_tokens == len(r.ids) // 4 for r in done)


def test_near_dedup_finds_every_pair_of_four_fifths(spark):
    import corpus_pipeline

    rng, texts = random.Random(5), []
    for group in range(12):
        base = [f"g{group}w{i}" for i in range(120)]
        texts.append(" ".join(base))
        for edits in (1, 2, 3, 4, 6):
            copy = list(base)
            for i in rng.sample(range(120), edits):
                copy[i] = f"new{group}x{edits}x{i}"
            texts.append(" ".join(copy))
    texts += [" ".join([*(f"passage{i}" for i in range(60)), *(f"own{k}w{i}" for i in range(60))]) for k in range(30)] + [None, "", " \n", "One two", "one TWO"]
    sets = [set(neardup.shingles(t).tolist()) for t in texts]
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) * 5 >= len(sets[a] | sets[b]) * 4 and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, documents(spark, texts), SMALL).collect()}
    assert kept == set(group) and {d for d in kept if d >= 72} == {*range(72, 103), 105}


def test_mentions_with_few_digits_are_found(spark):
    secret = "ab1cd2ef" * 5
    rows = [r for r in pii.replaced(documents(spark, ["at 10.0.0.1 now", f"key {secret} end", "no 10 mention 1.5 here"]), "key").orderBy("doc_id").collect()]
    assert [r.n_mentions for r in rows] == [1, 1, 0] and "10.0.0.1" not in rows[0].text and secret not in rows[1].text


def luhn(digits):
    return sum(x if i % 2 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(digits)), 1)) % 10


def personal(draw):
    """(kind, text) of made personal data in every form, each by its own rules and not by the operator's."""
    digits = lambda n: "".join(draw.choices("0123456789", k=n))
    letters = lambda n: "".join(draw.choices("bcdfghklmnprstvwz", k=n))
    name = lambda: letters(1).upper() + letters(draw.randint(3, 8))
    kind = draw.choice(["email", "secret", "ip", "ipv6", "short6", "iban", "abroad", "national", "trunk", "card", "amex", "ssn", "titled", "particle", "double", "initial"])
    card = lambda n: next(body + c for body in ["4" + digits(n - 2)] for c in "0123456789" if luhn(body + c) == 0)
    hexes = lambda n: ":".join(f"{draw.randint(1, 65535):x}" for _ in range(n))
    if kind == "iban":
        body = f"{draw.choice(['', letters(4).upper()])}{digits(18)}"[:18]
        check = 98 - int("".join(str(int(c, 36)) for c in body + "DE00")) % 97
        whole = f"DE{check:02d}{body}"
        return kind, draw.choice([whole, " ".join(whole[i : i + 4] for i in range(0, len(whole), 4))])
    made = {
        "email": lambda: f"{letters(draw.randint(1, 90))}.{digits(2)}@{letters(draw.randint(2, 70))}.{letters(3)}.org",
        "secret": lambda: "".join(draw.choices("0123456789abcdef", k=draw.randint(32, 128))),
        "ip": lambda: ".".join(str(draw.randint(0, 255)) for _ in range(4)),
        "ipv6": lambda: hexes(8),
        "short6": lambda: f"{hexes(draw.randint(1, 4))}::{hexes(draw.randint(1, 3))}",
        "abroad": lambda: f"+{draw.choice(['44 20 ' + digits(4) + ' ' + digits(4), '33 1 ' + ' '.join(digits(2) for _ in range(4)), '49 171 ' + digits(7), '1 (' + digits(3) + ') ' + digits(3) + '-' + digits(4), '4930' + digits(8)])}",
        "national": lambda: draw.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}"]),
        "trunk": lambda: draw.choice([f"020 {digits(4)} {digits(4)}", f"0171/{digits(7)}", "01 " + " ".join(digits(2) for _ in range(4)), f"(030) {digits(8)}"]),
        "card": lambda: card(draw.choice([13, 14, 15, 16, 17, 18, 19])),
        "amex": lambda: (lambda c: f"{c[:4]} {c[4:10]} {c[10:]}")(card(15)),
        "ssn": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
        "titled": lambda: f"{draw.choice(['Mrs.', 'Mr', 'Dr.', 'Prof.', 'Herr', 'Señora'])} {name()} {name()}",
        "particle": lambda: f"Mr. {draw.choice(['de la', 'van der', 'von', 'bin'])} {name()}",
        "double": lambda: f"Mrs. {name()} {name()} {name()}-{name()}",
        "initial": lambda: f"Ms. J. {name()}",
    }
    return kind, made[kind]()


def test_every_form_is_found(spark):
    """2,000 texts with one mention each, and 300 without any."""
    draw = random.Random(9)
    planted = [personal(draw) for _ in range(2000)]
    texts = [f"before, {p} ; after" for _, p in planted]
    clean = [f"On 0{draw.randint(1, 9)}-1{draw.randint(0, 2)}-2003 at 12:30:45 item {draw.randint(1, 99999)} of chapter 3.14 cost 1,250.00 for std::map and 2024-05-06, AB12 CDEF." for _ in range(300)]
    rows = pii.replaced(documents(spark, texts + clean), "key").orderBy("doc_id").collect()
    for (kind, p), r, text in zip(planted, rows, texts):
        assert r.n_mentions == 1, (kind, text, r.text)
        private = [w for w in re.findall(r"[^\W_]+(?:-[^\W_]+)?", p) if w[0].isupper() and w.split("-")[0] not in ("Mrs", "Mr", "Dr", "Prof", "Herr", "Señora", "Ms", "J")] if kind in ("titled", "particle", "double", "initial") else [p]
        assert r.text.startswith("before, ") and r.text.endswith(" ; after") and not any(w in r.text for w in private), (kind, text, r.text)
    assert all(r.n_mentions == 0 and r.text == t for r, t in zip(rows[2000:], clean))
    by_kind = {}
    for (kind, p), r in zip(planted, rows):
        by_kind.setdefault(kind, []).append((p, r.text[8:-8]))
    assert all(len(a) == len(b) and luhn(re.sub("[^0-9]", "", b)) == 0 for kind in ("card", "amex") for a, b in by_kind[kind])
    rest = lambda b: int("".join(str(int(c, 36)) for c in b.replace(" ", "")[4:] + b[:4])) % 97
    assert all(rest(b) == 1 and b[:2] == "DE" and len(a) == len(b) for a, b in by_kind["iban"])
    assert all(re.sub("[0-9a-f]", "x", a) == re.sub("[0-9a-f]", "x", b) for kind in ("ipv6", "short6", "secret") for a, b in by_kind[kind])
    assert all(re.sub("[0-9]", "0", a) == re.sub("[0-9]", "0", b) for kind in ("national", "trunk", "abroad", "ssn") for a, b in by_kind[kind])
    assert all(re.fullmatch(r"Mr\. (de la|van der|von|bin) [A-Z][a-z-]+", b) and a.split()[1] == b.split()[1] for a, b in by_kind["particle"])


def test_names_keep_together(spark):
    rows = pii.replaced(documents(spark, ["Dr. John Smith met Mrs. Mary Jane Watson-Parker. Later Mr. Smith wrote, and Smith and Watson-Parker answered Prof. Anna Lee."]), "key").collect()
    got = re.fullmatch(r"Dr\. (\S+) (\S+) met Mrs\. (\S+) (\S+) (\S+)\. Later Mr\. (\S+) wrote, and (\S+) and (\S+) answered Prof\. (\S+) (\S+)\.", rows[0].text).groups()
    assert got[1] == got[5] == got[6] and got[4] == got[7] and len(set(got)) == 7 and rows[0].n_mentions == 6
    assert not {"John", "Smith", "Mary", "Jane", "Watson-Parker", "Anna", "Lee"} & set(got)


def test_surrogates_outnumber_the_first_alphabet(spark, monkeypatch):
    few = {script: some[:2] for script, some in pii.SYLLABLES.items()}
    monkeypatch.setattr(pii, "SYLLABLES", few)
    letters = "abcdefghijklmnopqrstuvwxyz"
    entities = [("family", f"name{i}") for i in range(60)] + [("email", f"{x}@{y}.zz") for x in letters for y in letters]
    rows = pii.surrogates(spark.createDataFrame(entities, "type string, entity string"), "key").collect()
    assert len({(r.type, r.surrogate) for r in rows}) == len(rows) == len(entities)
    assert not {r.surrogate for r in rows} & {r.entity for r in rows}


def test_lines_without_spaces_are_cleaned(spark):
    banner, short = "本站所有内容均为原创未经许可不得转载使用", "首页"
    rows = linededup.without_boilerplate(documents(spark, [f"{banner}\n{short}\n第{i}篇文章" for i in range(6)], {i: f"s{i}" for i in range(6)})).collect()
    assert {(r.text, r.removed_lines) for r in rows} == {(f"{short}\n第{i}篇文章", 1) for i in range(6)}


def test_line_dedup_of_mostly_boilerplate(spark):
    banner = "Subscribe to our newsletter today " * 20
    rows = linededup.without_boilerplate(documents(spark, [f"{banner}\nown {i}" for i in range(8)], {i: f"s{i}" for i in range(8)})).collect()
    assert {(r.text, r.removed_lines) for r in rows} == {(f"own {i}", 1) for i in range(8)}
