"""Language identification, periodic runs and the Merkle manifest against brute force, round trips and odd inputs."""

import hashlib
import random
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("floorwise.llm")
from floorwise.llm import langid, merkle, periodic, queries  # noqa: E402
from tests.conftest import SMALL  # noqa: E402

LONG = " ".join(f"word{i % 977}" for i in range(30_000))

# op 11


def test_subwords_are_those_of_the_words():
    text = "Ab c, déf!"
    points = np.concatenate([[0], langid.code_points(text), [0]]).astype(np.uint32)
    _, places = langid.subwords(points)
    plain = "".join(chr(c) if c else "_" for c in points)
    grams = []
    for n in range(1, langid.LONGEST + 1):
        grams += [(i, plain[i : i + n]) for i in range(len(plain) - n + 1) if "_" not in plain[i + 1 : i + n - 1] and plain[i : i + n].strip("_")]
    assert [i for i, _ in grams] == places.tolist()
    assert {"_ab_", "_c_", "_dé", "éf_", "déf"} <= {g for _, g in grams}


def test_equal_subwords_share_a_bucket():
    points = np.concatenate([[0], langid.code_points("ana ana"), [0]]).astype(np.uint32)
    buckets, places = langid.subwords(points)
    by = dict(zip(((p, i) for i, p in enumerate(places.tolist())), buckets.tolist()))
    assert len(by) == len(buckets) and len(set(buckets.tolist())) == len({"a", "n", "_a", "an", "na", "a_", "_an", "ana", "na_", "_ana", "ana_"})


def test_held_out_languages_are_found(spark):
    rows = queries.QUERIES["op11_language_id"](spark, SMALL).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert len(rows) == len(docs) and all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.95 * len(held)
    accepted = [r for r in held if not r.rejected]
    assert len(accepted) >= 0.9 * len(held) and sum(r.lang_pred == docs[r.doc_id].lang for r in accepted) >= 0.97 * len(accepted)


def test_predictions_depend_on_the_text_alone(monkeypatch):
    draw = random.Random(2)
    words = {"aa": ["ka", "kato", "mika"], "bb": ["zuz", "zor", "ruzu"]}
    examples = [(" ".join(draw.choices(words[lang], k=20)), lang) for lang in ("aa", "bb") * 60]
    model = langid.fitted(examples)
    assert model.predict(["kato ka", "zor ruzu", None, "", " 12 !", "kato " * 9000])[:5] == [*model.predict(["kato ka"]), *model.predict(["zor ruzu"]), ("und", 0.0), ("und", 0.0), ("und", 0.0)]
    assert [p[0] for p in model.predict(["kato ka", "zor"])] == ["aa", "bb"]
    whole = model.predict(["kato zor " * 3000, "z" * 5000, "ruzu"])
    monkeypatch.setattr(langid, "BLOCK", 1000)
    cut = model.predict(["kato zor " * 3000, "z" * 5000, "ruzu"])
    assert [p[0] for p in whole] == [p[0] for p in cut] and np.allclose([whole[0][1], whole[2][1]], [cut[0][1], cut[2][1]])
    again = langid.fitted(examples)
    assert again.temperature == model.temperature and (again.embedding == model.embedding).all()


def test_languages_of_odd_tables(spark):
    df = spark.createDataFrame([(1, "ka mika kato", "aa", 1.0), (2, "zuz zor", "bb", 2.0), (3, None, "aa", 3.0), (4, "ka mika kato", "aa", 1.0), (5, "12", None, 0.0), (6, "zor", None, 0.0)], "doc_id long, text string, lang string, Score double")
    model = langid.train(df)
    rows = langid.identified(df, model).orderBy("doc_id").collect()
    assert rows[0].lang_pred == rows[3].lang_pred and rows[2].lang_pred == rows[4].lang_pred == "und" and rows[2].rejected
    assert set(rows[0].asDict()) == {"doc_id", "text", "lang", "lang_pred", "score", "rejected"}
    nothing = langid.train(df.limit(0))
    assert {r.lang_pred for r in langid.identified(df, nothing).collect()} == {"und"}
    assert langid.identified(df.limit(0), model).count() == 0


def test_more_languages_than_the_embedding_is_wide():
    examples = [(f"{chr(97 + i)}{chr(98 + i)}x " * 5, f"l{i:02d}") for i in range(20) for _ in range(12)]
    model = langid.fitted([examples[i] for i in np.random.default_rng(1).permutation(len(examples))])
    assert model.table is model.embedding
    assert sum(model.predict([t])[0][0] == lang for t, lang in examples[::12]) >= 15


# op 12


def plain_runs(words, least=12):
    """All runs by definition: maximal stretches of each period, of which the smallest counts."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            piece = words[i : i + length]
            if length >= max(least, 2 * q) and not any(all(piece[k] == piece[k + p] for k in range(length - p)) for p in range(1, q)):
                found[i, length, q] = True
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_collapsed(words, runs):
    return " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + length for s, length, q in runs))


def repetitive(draw):
    words = []
    while len(words) < 40:
        piece = [draw.choice("abcd") for _ in range(draw.randint(1, 7))]
        words += piece * draw.choice([1, 1, 2, 3, 6]) + piece[: draw.randint(0, len(piece))]
    return words


def test_scan_finds_all_runs():
    draw = random.Random(5)
    for _ in range(150):
        words = repetitive(draw)
        raw = [w.encode() for w in words]
        found = periodic.scan(periodic.numbered(raw), 1, len(words) // 2)
        assert sorted((s, e - s, q) for (s, e), q in found.items()) == sorted(plain_runs(words))
    assert periodic.scan(np.zeros(700, np.uint8), 1, 350) == {(0, 700): 1}


def test_ranges_cover_all_lags():
    for n in (0, 11, 12, 13, 500):
        lags = [q for a, b in periodic.ranges(n, 12, 2, 300) for q in range(a, b + 1)]
        assert lags == list(range(1, n // 2 + 1)) if n >= 12 else not lags


@pytest.mark.parametrize("comparisons", [periodic.RANGE_COMPARISONS, 150])
def test_runs_of_documents(spark, comparisons):
    draw = random.Random(6)
    texts = [" ".join(repetitive(draw)) for _ in range(25)]
    texts += [texts[0], None, "", " \n\t ", "one", "x " * 11, "x " * 12, "a\x85b " * 13, "中文 " * 20, "u v w " * 6, "\x0ba\rb\x0c" * 7]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"RUNS": F.lit(1), "_key": F.lit("k"), "Collapsed": F.lit(2)})
    rows = periodic.with_runs(df, range_comparisons=comparisons).orderBy("doc_id").collect()
    assert len(rows) == len(texts)
    for r, text in zip(rows, texts):
        words = [w.decode() for w in (text or "").encode().split()]
        expected = plain_runs(words)
        assert [(x.start, x.length, x.period) for x in r.runs] == expected, text
        assert r.collapsed == plain_collapsed(words, expected) and r.text == text and r["_key"] == "k"
    assert periodic.with_runs(df.limit(0), range_comparisons=comparisons).count() == 0


def test_long_texts_are_dealt_out(spark):
    text = LONG + " " + "tail end " * 40
    df = spark.createDataFrame([(1, text), (2, text), (3, None)], "doc_id long, text string")
    one = periodic.with_runs(df).orderBy("doc_id").collect()
    many = periodic.with_runs(df, range_comparisons=1 << 25).orderBy("doc_id").collect()
    assert one == many and [(r.start, r.length, r.period) for r in one[0].runs] == [(0, 30_000, 977), (30_000, 80, 2)]
    assert one[0].collapsed == " ".join(f"word{i}" for i in range(977)) + " tail end"


def test_op12(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = queries.QUERIES["op12_periodic_runs"](spark, SMALL).collect()
    assert len(rows) == len(docs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in [r for r in rows if len(docs[r.doc_id]) < 2500]:
        words, h = [w.decode() for w in docs[r.doc_id].encode().split()], crc32(str(r.doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = plain_runs(words)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)) and r.collapsed_sha256 == sha(plain_collapsed(words, runs))


# op 13


def plain_tree(leaves):
    """The root and each leaf's siblings, from below."""
    rows = [leaves]
    while len(rows[-1]) > 1:
        rows.append([hashlib.sha256("".join(rows[-1][i : i + 3]).encode()).hexdigest() for i in range(0, len(rows[-1]), 3)])
    beside = []
    for i in range(len(leaves)):
        found = []
        for row in rows[:-1]:
            found += [h for j, h in enumerate(row[i - i % 3 : i - i % 3 + 3]) if j != i % 3]
            i //= 3
        beside.append(found)
    return rows[-1][0], beside


def plain_manifest(rows, columns):
    """{(source, place): (doc_id, leaf, subroot, root, siblings)} of rows as dictionaries."""
    digest = lambda r: hashlib.sha256("".join("-" if r[c] is None else f"{len(str(r[c]).encode())}:{r[c]}" for c in columns).encode()).hexdigest()
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for source in order:
        mine = sorted(groups[source], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, digest(r)))
        trees.append((mine, [digest(r) for r in mine], *plain_tree([digest(r) for r in mine])))
    root, above = plain_tree([t[2] for t in trees])
    return [(r["doc_id"], source, leaf, sub, root, below + up) for source, (mine, leaves, sub, beside), up in zip(order, trees, above) for r, leaf, below in zip(mine, leaves, beside)]


@pytest.mark.parametrize("levels", [1, 2, merkle.LEVELS])
def test_manifest_and_proofs(spark, levels):
    draw = random.Random(levels)
    sources = ["hot"] * 300 + ["Z", "a", "é", None, None, "", "hot "] + [f"s{i % 11}" for i in range(60)]
    rows = [{"doc_id": draw.choice([None, i, i // 2]), "source": s, "text": draw.choice([None, "", f"t{i}", "line\n" * 3]), "n": i % 3 or None} for i, s in enumerate(sources)]
    rows += [rows[0], rows[5]]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, n long").withColumns({"_group": F.lit(1), "Place": F.lit(2), "other": F.lit("x")})
    found = merkle.manifest(df, ["doc_id", "source", "n", "text"], "source", "doc_id", levels=levels)
    done = merkle.verified(found).collect()
    got = [(r.doc_id, r.source, r.digest.hex(), r.subroot.hex(), r.root.hex(), [bytes(r.proof[i : i + 32]).hex() for i in range(0, len(r.proof), 32)]) for r in done]
    key = lambda x: repr(x)
    assert sorted(got, key=key) == sorted(plain_manifest(rows, ["doc_id", "source", "n", "text"]), key=key)
    assert all(r.verified and r.folded_root == r.root for r in done)


def test_manifest_of_odd_tables(spark):
    df = spark.createDataFrame([(1, "a", "x")], "doc_id long, source string, text string")
    one = merkle.verified(merkle.manifest(df, ["text"], "source", "doc_id")).first()
    assert one.digest == one.subroot == one.root == one.folded_root and one.proof == b"" and one.digest.hex() == hashlib.sha256(b"1:x").hexdigest()
    empty = merkle.manifest(df.limit(0), ["text"], "source", "doc_id", carried=["text"])
    assert empty.count() == 0 and empty.columns[:3] == ["doc_id", "source", "text"] and merkle.verified(empty).count() == 0
    long = spark.createDataFrame([(i, "a", "y" * 3_000_000 if i == 1 else str(i)) for i in range(4)], df.schema)
    assert merkle.verified(merkle.manifest(long, ["text"], "source", "doc_id")).where("verified").count() == 4


def test_changes_are_found(spark):
    df = spark.createDataFrame([(i, f"s{i % 4}", f"t{i}") for i in range(50)], "doc_id long, source string, text string")
    claimed = df.withColumn("claimed", F.unhex(F.when(F.col("doc_id") == 7, F.sha2(F.lit("no"), 256)).otherwise(merkle.leaf(["doc_id", "text"]))))
    rows = merkle.verified(merkle.manifest(claimed, ["doc_id", "text"], "source", "doc_id", carried=["claimed"]), "claimed").collect()
    assert [r.doc_id for r in rows if not r.verified] == [7]


def test_op13(spark):
    docs = [r.asDict() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    expected = {x[0]: x for x in plain_manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"])}
    text = {d["doc_id"]: d["text"] for d in docs}
    for r in queries.QUERIES["op13_merkle_manifest"](spark, SMALL).collect():
        _, _, leaf, subroot, root, proof = expected[r.doc_id]
        assert (r.leaf, r.subroot, r.root, r.proof_sha256) == (leaf, subroot, root, hashlib.sha256("".join(proof).encode()).hexdigest())
        changed = crc32(str(r.doc_id).encode()) % 2 == 0 and "\n" in text[r.doc_id]
        assert r.verified == (not changed) == (r.folded_root == root)
