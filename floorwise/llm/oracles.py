"""DuckDB SQL that gives the rows of operators' queries."""

from __future__ import annotations

import re


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def url_filter(rules: list, phrases: list[str]) -> str:
    cases = []
    for rule in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        cases.append((f"regexp_matches(host || path, {_text(rule.pattern)})", rule.name, rule.action))
    rule = " ".join(f"WHEN {c} THEN {_text(n)}" for c, n, _ in cases)
    verdict = " ".join(f"WHEN {c} THEN {_text(a)}" for c, _, a in cases)
    blocked = "(^|[^0-9a-z])(" + "|".join("[^0-9a-z]".join(p.split()) for p in phrases) + ")($|[^0-9a-z])"
    folded = "translate(host || path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    WITH rest AS (
        SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS r FROM pages),
    parts AS (
        SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest)
    SELECT page_id, host, path, CASE {rule} END AS rule,
           CASE {verdict} WHEN regexp_matches({folded}, {_text(blocked)}) THEN 'block' ELSE 'allow' END AS verdict
    FROM parts"""


def license_scan(licenses) -> str:
    """Every window of every template's size class, counted by a join on the shingles themselves."""
    words = lambda text: f"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    size = licenses.SHINGLE
    shingles = lambda of, columns: f"SELECT {columns}, p, array_to_string(w[p + 1:p + {size}], ' ') AS shingle FROM (SELECT *, unnest(range(0, greatest(1, len(w) - {size - 1}))) AS p FROM {of} WHERE len(w) > 0)"
    return f"""
    WITH names AS (SELECT name, {words("text")} AS w FROM (VALUES {", ".join(f"({_text(n)}, {_text(t)})" for n, t in licenses.TEMPLATES.items())}) v(name, text)),
    template AS (SELECT DISTINCT name, shingle FROM ({shingles("names", "name")})),
    class AS (SELECT name, n, greatest({licenses.LEAST_CLASS}, CAST(2 ** ceil(log2(n)) AS BIGINT)) AS s FROM (SELECT name, count(*) AS n FROM template GROUP BY 1)),
    docs AS (SELECT doc_id, {words("text")} AS w FROM documents),
    hits AS (SELECT doc_id, name, shingle, p FROM ({shingles("docs", "doc_id")}) JOIN template USING (shingle)),
    placed AS (SELECT doc_id, name, n, shingle, unnest([p // s, p // s - 1]) AS place FROM hits JOIN class USING (name)),
    found AS (SELECT DISTINCT doc_id, name FROM (SELECT doc_id, name, place FROM placed WHERE place >= 0 GROUP BY doc_id, name, n, place HAVING count(DISTINCT shingle) >= {licenses.CONTAINMENT} * n)),
    listed AS (SELECT doc_id, count(*) AS n_licenses, string_agg(name, ',' ORDER BY name) AS licenses FROM found GROUP BY 1)
    SELECT doc_id, coalesce(n_licenses, 0) AS n_licenses, coalesce(licenses, '') AS licenses FROM documents LEFT JOIN listed USING (doc_id)"""


DECONTAMINATION = r"""
WITH item_words AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
    SELECT DISTINCT item_id, len(w[i:least(i + 9, len(w))]) AS n, w[i:least(i + 9, len(w))] AS words
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM item_words WHERE len(w) > 0)),
doc_words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM doc_words),
hits AS (
    SELECT p.doc_id, p.i, x.n, x.item_id FROM (SELECT DISTINCT n FROM windows) s
    JOIN places p ON p.i + s.n - 1 <= len(p.w)
    JOIN windows x ON x.n = s.n AND x.words = p.w[p.i:p.i + s.n - 1]),
hit_words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hit_words h USING (doc_id) LEFT JOIN hit_items i USING (doc_id)"""


LINE_DEDUP = r"""
WITH lines AS (
    SELECT doc_id, source, pos, line, trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS kept
    FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL)),
boilerplate AS (
    SELECT kept FROM lines WHERE length(kept) >= 16 OR regexp_matches(kept, '^[^\t-\r ]+([\t-\r ]+[^\t-\r ]+){2}')
    GROUP BY kept HAVING count(DISTINCT coalesce(source, '')) >= 5),
cut AS (
    SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE b.kept IS NOT NULL) AS removed, count(*) FILTER (WHERE b.kept IS NULL AND kept <> '') AS own,
           string_agg(line, chr(10) ORDER BY pos) AS whole, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE b.kept IS NULL) AS part
    FROM lines LEFT JOIN boilerplate b USING (kept) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN own > 0 THEN removed ELSE 0 END AS removed_lines, CASE WHEN own > 0 THEN n - removed ELSE n END AS n_lines,
       sha256(CASE WHEN own > 0 THEN part ELSE whole END) AS text_sha256
FROM documents d LEFT JOIN cut USING (doc_id)"""


def chat_formatting(chat) -> str:
    """Lengths of the template and of escapes follow from the template's constants."""
    after_first = "(" + "|".join(re.escape(c[0]) + "(" + re.escape(c[1:]) + ")" for c in chat.CONTROLS) + ")"
    escapes = lambda column: f"len(regexp_extract_all({column}, {_text(after_first)})) + len({column}) - len(replace({column}, chr(92), ''))"
    fixed = len(chat.START) + len(chat.END) + 2
    return f"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
           CAST(sum({fixed} + length(role) + length(text) + {escapes('role')} + {escapes('text')}) AS BIGINT) AS formatted_chars
    FROM turns GROUP BY conv_id"""


def quality_rules(quality) -> str:
    """Features, votes and every step of expectation-maximisation, from the module's constants."""
    space = "'[^\\x20\\x09-\\x0D]"
    count = lambda characters: f"length(t) - length(translate(t, {_text(characters)}, ''))"
    n = len(quality.RULES)
    votes = ", ".join(f"CASE WHEN NOT ({(*about, 'true')[0]}) THEN NULL WHEN {against} THEN -1 WHEN {in_favour} THEN 1 ELSE 0 END AS v{i}" for i, (_, against, in_favour, *about) in enumerate(quality.RULES))
    names = ", ".join(f"v{i}" for i in range(n))
    sign = {"a": -1, "z": 0, "f": 1}
    odds = lambda table: f"{table}.lp + " + " + ".join(f"CASE v{i} WHEN -1 THEN {table}.a{i} WHEN 1 THEN {table}.f{i} WHEN 0 THEN {table}.z{i} ELSE 0 END" for i in range(n))
    first = {"g": quality.PRIOR_DOCUMENTS * quality.PRIOR, "b": quality.PRIOR_DOCUMENTS * (1 - quality.PRIOR)}
    start = {"g": quality.ON_GOOD, "b": quality.ON_BAD}
    steps = []
    for k in range(1, quality.ITERATIONS + 1):
        sums = [f"{first[c]} + sum(n * {p}) AS {c}" for c, p in (("g", "p"), ("b", "(1 - p)"))]
        sums += [f"{first[c] * start[c][v]} + coalesce(sum(n * {p}) FILTER (WHERE v{i} = {v}), 0) AS {c}{w}{i}" for i in range(n) for w, v in sign.items() for c, p in (("g", "p"), ("b", "(1 - p)"))]
        ratios = ", ".join(f"ln((g{w}{i} / (ga{i} + gz{i} + gf{i})) / (b{w}{i} / (ba{i} + bz{i} + bf{i}))) AS {w}{i}" for i in range(n) for w in sign)
        steps.append(f"o{k} AS MATERIALIZED (SELECT ln(g / b) AS lp, {ratios} FROM (SELECT {', '.join(sums)} FROM (SELECT c.*, 1 / (1 + exp(-({odds('o')}))) AS p FROM c, o{k - 1} o)))")
    begin = ", ".join(f"ln({start['g'][v]} / {start['b'][v]}) AS {w}{i}" for i in range(n) for w, v in sign.items())
    words = "|".join(quality.FUNCTION_WORDS)
    return f"""
    WITH t AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    w AS MATERIALIZED (SELECT r, regexp_extract_all(t, {space}+') AS w FROM t),
    windows AS (SELECT r, i, w[i:i + 7] AS x FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
    repeated AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM windows) WHERE n > 1),
    covered AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS j FROM repeated) GROUP BY r),
    lines AS (SELECT r, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, {space}')) AS l FROM t),
    f AS MATERIALIZED (
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, {count(quality.SYMBOLS)} AS n_symbols,
               CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, len(l) AS n_lines,
               {count("ABCDEFGHIJKLMNOPQRSTUVWXYZ")} AS n_upper, {count("!")} AS n_marks, {count(quality.STOPS)} AS n_stops, strlen(t) - length(t) AS n_wide,
               len(list_filter(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{Nd}}_]+'), lambda x: regexp_full_match(x, '{words}'))) AS n_function_words
        FROM t JOIN w USING (r) JOIN lines USING (r) LEFT JOIN covered USING (r)),
    v AS MATERIALIZED (SELECT *, {votes} FROM f),
    c AS MATERIALIZED (SELECT {names}, CAST(count(*) AS DOUBLE) AS n FROM v GROUP BY {names}),
    o0 AS MATERIALIZED (SELECT ln({quality.PRIOR} / (1 - {quality.PRIOR})) AS lp, {begin}),
    {", ".join(steps)},
    b AS (SELECT v.*, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED_PERCENT} * n_words AS base_failed, 1 / (1 + exp(-({odds('o')}))) AS p FROM v, o{quality.ITERATIONS} o)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND p >= {quality.THRESHOLD} AS kept FROM b"""


def crc32(value: str) -> str:
    """CRC-32 of a text of ASCII characters, bit by bit."""
    steps = f"list_concat([4294967295::BIGINT], flatten(list_transform(string_split({value}, ''), lambda c: [ord(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0])))"
    return f"xor(list_reduce({steps}, lambda c, x: xor(xor(c, x) >> 1, 3988292384::BIGINT * (xor(c, x) & 1))), 4294967295::BIGINT)"


#: Pairs of equal words with their distance, islands of neighbouring pairs, the least distance of each stretch.
PERIODIC_RUNS = rf"""
WITH hashed AS (
    SELECT doc_id, coalesce({crc32("doc_id::VARCHAR")}, 1) AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
drawn AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS tail, h // 10 AS g FROM hashed),
placed AS (SELECT *, CASE WHEN tail THEN g % n ELSE n END AS a FROM drawn),
docs AS (
    SELECT doc_id, n, CASE WHEN tail THEN list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE w END AS w FROM placed),
words AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(0, n)) AS i FROM docs),
pairs AS (SELECT x.doc_id, y.i - x.i AS q, x.i AS i FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 2 * (y.i - x.i) <= x.n),
islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs),
stretches AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(12, 2 * q)),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretches GROUP BY 1, 2, 3),
listed AS (
    SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
           min({{'l': -length, 's': start, 'p': period}}) AS best FROM runs GROUP BY 1),
dropped AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words w WHERE NOT EXISTS (SELECT 1 FROM dropped d WHERE d.doc_id = w.doc_id AND d.i = w.i) GROUP BY 1)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, -best.l AS length, best.p AS period, (-best.l) * 1000 // best.p AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM docs LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def _leaf(text: str) -> str:
    parts = [f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(parts)})"


#: Levels by recursion; ``g`` is a source's number, 0 the tree above all sources.
MERKLE_MANIFEST = rf"""
WITH RECURSIVE leaves AS (
    SELECT doc_id, source, {_leaf("text")} AS leaf,
           CASE WHEN {crc32("doc_id::VARCHAR")} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS claimed FROM documents),
placed AS (
    SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM leaves),
nodes AS (
    SELECT g, 0 AS level, i, n, leaf AS h FROM placed
    UNION ALL
    SELECT g, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY g, level, i // 3, n),
subroots AS (SELECT g, h FROM nodes WHERE n = 1),
above AS (
    SELECT 0 AS level, g - 1 AS i, (SELECT count(*) FROM subroots) AS n, h FROM subroots
    UNION ALL
    SELECT level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM above WHERE n > 1 GROUP BY level, i // 3, n),
whole AS (SELECT h AS root FROM above WHERE n = 1),
every AS (SELECT g, level, i, n, h FROM nodes UNION ALL SELECT 0, level, i, n, h FROM above),
sides AS (
    SELECT x.g, x.level, x.i, x.n, string_agg(y.h, '' ORDER BY y.i) FILTER (y.i < x.i) AS before, string_agg(y.h, '' ORDER BY y.i) FILTER (y.i > x.i) AS after
    FROM every x JOIN every y ON x.g = y.g AND x.level = y.level AND x.i // 3 = y.i // 3 WHERE x.n > 1 GROUP BY 1, 2, 3, 4),
paths AS (
    SELECT doc_id, g, i AS leaf_i, g AS tree, i, n, 0 AS level, '' AS proof, claimed AS folded FROM placed
    UNION ALL
    SELECT p.doc_id, p.g, p.leaf_i, CASE WHEN p.n = 1 THEN 0 ELSE p.tree END, CASE WHEN p.n = 1 THEN p.g - 1 ELSE p.i // 3 END,
           CASE WHEN p.n = 1 THEN (SELECT count(*) FROM subroots) ELSE (p.n + 2) // 3 END, CASE WHEN p.n = 1 THEN 0 ELSE p.level + 1 END,
           p.proof || coalesce(s.before, '') || coalesce(s.after, ''),
           CASE WHEN p.n = 1 THEN p.folded ELSE sha256(coalesce(s.before, '') || p.folded || coalesce(s.after, '')) END
    FROM paths p LEFT JOIN sides s ON s.g = p.tree AND s.level = p.level AND s.i = p.i WHERE p.n > 1 OR p.tree > 0)
SELECT p.doc_id, l.leaf, s.h AS subroot, w.root, sha256(p.proof) AS proof_sha256, p.folded AS folded_root, p.folded = w.root AS verified
FROM paths p JOIN placed l ON l.g = p.g AND l.i = p.leaf_i JOIN subroots s ON s.g = p.g CROSS JOIN whole w WHERE p.n = 1 AND p.tree = 0"""
