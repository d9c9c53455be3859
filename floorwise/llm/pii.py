"""Surrogates for personal data, with DataFrame functions alone.

One expression finds mentions: e-mail addresses, IP addresses of both kinds, telephone numbers with and without
a country's code, account numbers that pass their check (IBAN), card numbers (of 16 digits, or of 13 to 19
that pass theirs), social security numbers, hexadecimal secrets, and names behind a title, of up to four words with
particles and initials. In a text with such a name its parts are also found where they stand without a title. A mention's canonical form (lower case;
a name is its given and its family names by themselves) gets a surrogate from a keyed hash
(HMAC with SHA-512): digits become digits, letters letters of the same script, a title keeps its
gender, particles and separators stay, and a card or account number that passes its check does so again. The same
entity has the same surrogate everywhere. The key is no literal of the plan.

Surrogates are checked for collisions over all distinct entities: where two of a type share
one, or one is itself an entity of the corpus, all but the first are drawn again with the
next attempt, until none collide. Every attempt has more to draw from (longer names and
addresses, and after some attempts longer numbers), so no number of entities is too large.
Mentions in upper case get surrogates in upper case.

Defined results: a null text stays null, a text without mentions stays as it is; texts of any
length are searched whole; repeated rows are treated alike; columns of any name stay; an empty
table stays empty.
"""

from __future__ import annotations

from hashlib import sha512
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from floorwise.llm.shared import Written, fresh, tidy

#: After so many attempts numbers, which keep their format until then, grow by a digit each.
KEPT_FORMAT = 8

#: Titles by gender (n: either), particles of names, and given names by gender and script.
TITLES = {
    "f": ["Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Señora", "Sra", "Signora", "Госпожа"],
    "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Signor", "Sir", "Господин"],
    "n": ["Dr", "Prof", "Professor", "Rev", "Capt", "Доктор", "Профессор"],
}
PARTICLES = "de la las los del der den dem van von zu zur di da dos du le ter ten bin ibn al el".split()
GIVEN = {
    "f": {"latin": "Anna Clara Emma Greta Helen Irene Julia Laura Maria Nora Paula Rosa Sofia Teresa Vera Ida".split(), "cyrillic": "Анна Вера Елена Ирина Мария Нина Ольга Софья".split()},
    "m": {"latin": "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leo Martin Oscar Paul Victor".split(), "cyrillic": "Антон Борис Виктор Иван Олег Павел Роман Фёдор".split()},
}
GIVEN["n"] = {script: GIVEN["f"][script] + GIVEN["m"][script] for script in ("latin", "cyrillic")}
#: Syllables of family names by script, two or more to a name.
SYLLABLES = {"latin": "ber dan fel gor hal ker lin mar nor pel ros sten tor val wes zan".split(), "cyrillic": "бор вал гор дан зан кер лин мар нор пел рос сан тор фел хал шен".split()}

#: Alphabets that letters are drawn from, and first and last letters of other scripts
#: (Greek, Armenian, Hebrew, Arabic, Devanagari, Thai, Georgian, kana, Han, Hangul).
ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "àâçèéêëîïôùûüäößñóíáúì", "абвгдежзиклмнопрстуфхцчшэюя"]
CLASSES = ["[0-9]", "[a-z]", "[à-öø-ÿ]", "[а-яё]"]
SCRIPTS = [("ά", "ώ"), ("ա", "ֆ"), ("א", "ת"), ("ب", "غ"), ("क", "ह"), ("ก", "ฮ"), ("ა", "ჰ"), ("あ", "ん"), ("ア", "ン"), ("一", "龥"), ("가", "힣")]

_TITLE = "(?:" + "|".join(t for several in TITLES.values() for t in sorted(several, key=len, reverse=True)) + ")"
_PARTICLE = "(?:" + "|".join(PARTICLES) + ")"
_NAME = rf"(?!{_TITLE}(?![\p{{L}}]))\p{{Lu}}[\p{{L}}'’-]+"
_TITLED = rf"{_TITLE}\.? (?:\p{{Lu}}\. )*(?:{_PARTICLE} )*{_NAME}(?: (?:\p{{Lu}}\. )*(?:{_PARTICLE} )*{_NAME}){{0,3}}"
_HEX = "[0-9a-fA-F]{1,4}"
#: Telephone numbers: with a country's code, and within a country in groups; a date is none.
_PHONES = (
    r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])",
    r"\+[0-9]{1,3}(?: ?\(0\))?(?:[ -][0-9]{1,4}){2,5}(?![0-9])",
    r"\+[0-9]{1,3}[ -]?[0-9]{2,4}[ /-]?[0-9]{5,8}(?![0-9])",
    r"\+[0-9]{8,15}(?![0-9])",
    r"(?<![\p{L}\p{N}+-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![\p{N}-])",
    r"(?<![\p{L}\p{N}.,+/-])(?![0-9]{2}[-/][0-9]{2}[-/][0-9]{4})(?=\(?(?:[0-9][ /()-]{0,2}){8}[0-9])\(?0[1-9][0-9]{0,3}\)?(?:[ /-][0-9]{2,8}){1,5}(?![0-9])",
)
#: Types in the order in which they are told apart, each with its expression.
TYPES = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+",
    "secret": r"(?<![\p{L}\p{N}])[0-9a-fA-F]{32,}+(?![\p{L}\p{N}])",
    "ipv6": rf"(?<![\p{{L}}\p{{N}}:])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}})(?![\p{{L}}\p{{N}}:])",
    "ip": r"(?<![\p{N}.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![\p{N}])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "phone": "(?:" + "|".join(_PHONES) + ")",
    "card": r"(?<![\p{L}\p{N}])(?:[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19})(?![0-9])",
    "ssn": r"(?<![\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{N}-])",
    "name": rf"(?<![\p{{L}}\p{{N}}]){_TITLED}(?![\p{{L}}])",
}
#: A superset of what holds a mention, cheap to search for: every alternative of _ANY needs one of these.
_MAYBE = rf"@|[0-9a-fA-F]{{32}}|[0-9]\.[0-9]|[0-9]{{3}}|\+[0-9]|[0-9a-fA-F]::?[0-9a-fA-F]{{1,4}}|[A-Z]{{2}}[0-9]{{2}}|[0-9]{{2}}[ /-][0-9]{{2}}|\p{{Lu}}\p{{L}}+\.? (?:\p{{Lu}}|{_PARTICLE} )"
_WORD = r"(?<![\p{L}\p{N}])\p{Lu}[\p{L}'’-]*\p{L}(?![\p{L}\p{N}])"
_ANY = "|".join(x.replace("([ -]?)", "(?<separator>[ -]?)").replace(r"\1", r"\k<separator>") for x in TYPES.values())


def _type(mention: Column) -> Column:
    kind = F.when(mention.contains("@"), "email").when(mention.rlike(r"^[0-9a-fA-F]{32,}$"), "secret").when(mention.rlike(r"^[0-9a-fA-F]*:[0-9a-fA-F:]*$"), "ipv6")
    kind = kind.when(mention.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), "ip").when(mention.rlike("^[A-Z]{2}[0-9]{2}"), "iban").when(mention.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
    return kind.when(mention.rlike(f"^(?:{TYPES['card']})$"), "card").when(mention.rlike(r"^[+(0-9]"), "phone").otherwise("name")


def _counts(mention: Column, kind: Column) -> Column:
    """Whether a number that is no mention unless it passes its check does so."""
    digits = F.regexp_replace(mention, "[^0-9]", "")
    return F.when(kind == "iban", _remainder(F.concat(F.substr(_joined(mention), F.lit(5)), F.substr(mention, F.lit(1), F.lit(4)))) == 1).when((kind == "card") & (F.length(digits) != 16), F.pmod(_checksum(digits), F.lit(10)) == 0).otherwise(True)


def _gender(title: Column) -> Column:
    is_one = lambda sex: F.lower(title).isin([t.lower() for t in TITLES[sex]])
    return F.when(is_one("f"), "f").when(is_one("n"), "n").otherwise("m")


def _parts(mention: Column) -> Column:
    """The entities in a mention, each with its word's number: of a name the given and family names, else itself."""
    words = F.split(mention, " ")
    title = F.regexp_replace(F.get(words, F.lit(0)), r"\.$", "")
    numbered = F.transform(words, lambda w, i: F.struct(i.alias("at"), w.alias("w")))
    names = F.filter(numbered, lambda x: (x["at"] > 0) & ~x["w"].isin(PARTICLES) & ~x["w"].rlike(r"^\p{Lu}\.$"))
    last = F.element_at(names, -1)["at"]
    named = F.transform(names, lambda x: F.struct(F.when(x["at"] == last, "family").otherwise(F.concat(F.lit("given_"), _gender(title))).alias("type"), F.lower(x["w"]).alias("entity"), x["at"].alias("at")))
    return F.when(_type(mention) == "name", named).otherwise(F.array(F.struct(_type(mention).alias("type"), F.lower(mention).alias("entity"), F.lit(0).alias("at"))))


def keyed(spark: SparkSession, key: str) -> Column:
    """The two blocks of HMAC-SHA-512, as a value that no plan shows."""
    block = key.encode() if len(key.encode()) <= 128 else sha512(key.encode()).digest()
    inner, outer = (bytes(b ^ pad for b in block.ljust(128, b"\0")) for pad in (0x36, 0x5C))
    return spark.createDataFrame([((inner, outer),)], "key struct<inner: binary, outer: binary>").scalar()


def _digest(attempt: Column) -> Column:
    """256 hexadecimal digits for the row's ``type`` and ``entity``, from its ``key``."""

    def of(n: str) -> Column:
        said = F.concat_ws("|", F.lit(n), "type", "entity", attempt.cast("string")).cast("binary")
        return F.sha2(F.concat(F.col("key.outer"), F.unhex(F.sha2(F.concat(F.col("key.inner"), said), 512))), 512)

    return F.concat(of("1"), of("2"))


def _number(digest: Column, at: int | Column, below: int) -> Column:
    """A number below ``below`` from seven hexadecimal digits of a digest."""
    return F.pmod(F.conv(F.substring(digest, at, 7) if isinstance(at, int) else F.substr(digest, at, F.lit(7)), 16, 10).cast("long"), F.lit(below))


def _like(entity: Column, digest: Column) -> Column:
    """``entity`` with digits and letters drawn anew, each from its own script; letters of other scripts than those listed become Latin."""

    def one(c: Column, i: Column) -> Column:
        n = F.pmod(F.conv(F.substr(digest, F.pmod(i * 3, F.lit(240)) + 1, F.lit(7)), 16, 10).cast("long") + i, F.lit(1 << 30))
        of = lambda alphabet: F.substr(F.lit(alphabet), (F.pmod(n, F.lit(len(alphabet))) + 1).cast("int"), F.lit(1))
        out = F.when(c == "", c)
        for alphabet, letters in zip(ALPHABETS, CLASSES):
            out = out.when(c.rlike(letters), of(alphabet))
        for first, last in SCRIPTS:
            drawn = F.pmod(n, F.lit(ord(last) - ord(first) + 1)) + ord(first)
            out = out.when(F.ascii(c).between(ord(first), ord(last)), F.decode(F.unhex(F.lpad(F.hex(drawn), 4, "0")), "UTF-16BE"))
        return out.when(c.rlike(r"\p{L}"), of(ALPHABETS[1])).otherwise(c)

    return F.array_join(F.transform(F.split(entity, ""), one), "")


def _checksum(digits: Column) -> Column:
    """The sum of a number's digits by Luhn's rule, its last digit being the check."""
    n = F.length(digits)
    each = F.transform(F.split(digits, ""), lambda c, i: c.cast("int") * F.when((n - i) % 2 == 0, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x))


def _card(entity: Column, digest: Column) -> Column:
    drawn, digits = _like(entity, digest), lambda c: F.regexp_replace(c, "[^0-9]", "")
    before = F.substr(drawn, F.lit(1), F.length(drawn) - 1)
    check = F.pmod(-_checksum(F.concat(digits(before), F.lit("0"))), F.lit(10)).cast("string")
    valid = F.pmod(_checksum(digits(entity)), F.lit(10)) == 0
    return F.when(valid, F.concat(before, check)).otherwise(drawn)


def _joined(account: Column) -> Column:
    return F.regexp_replace(account, " ", "")


def _remainder(account: Column) -> Column:
    """Of an account number that is read as a decimal number, letters as 10 to 35, by 97."""
    value = lambda c: F.conv(c, 36, 10).cast("int")
    return F.aggregate(F.split(_joined(account), ""), F.lit(0), lambda a, c: F.pmod(a * F.when(value(c) < 10, 10).otherwise(100) + value(c), F.lit(97)))


def _account(entity: Column, digest: Column) -> Column:
    """An account number of the same country and form, with check digits that fit."""
    country, body = F.substr(entity, F.lit(1), F.lit(2)), _like(F.substr(entity, F.lit(5)), digest)
    check = F.lit(98) - _remainder(F.concat(body, country, F.lit("00")))
    return F.concat(country, F.lpad(check.cast("string"), 2, "0"), body)


def _hex_like(entity: Column, digest: Column) -> Column:
    return F.array_join(F.transform(F.split(entity, ""), lambda c, i: F.when(c.rlike("[0-9a-f]"), F.substr(digest, F.pmod(i, F.lit(250)) + 1, F.lit(1))).otherwise(c)), "")


def _pick(values: list[str], n: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), n.cast("int"))


def _surrogate(attempt: Column) -> Column:
    """A surrogate for the row's ``type`` and ``entity`` by its ``key``, all in lower case."""
    d, entity, kind = F.col("digest"), F.col("entity"), F.col("type")
    extra = F.greatest(attempt - KEPT_FORMAT, F.lit(0))
    cyrillic, latin = entity.rlike("[а-яё]"), entity.rlike("[a-zà-öø-ÿ]")
    octets = F.array_join(F.transform(F.sequence(F.lit(0), extra + 3), lambda i: (_number(d, 1 + 8 * i, 254) + 1).cast("string")), ".")
    local, domain = F.substring_index(entity, "@", 1), F.substring_index(entity, "@", -1)
    top = F.regexp_extract(domain, r"\.[^.]*$", 0)
    longer = F.translate(F.substr(d, F.lit(200), attempt), "0123456789", "ghijklmnop")  # as many letters as attempts
    address = F.concat(_like(local, d), longer, F.lit("@"), _like(F.substr(domain, F.lit(1), F.length(domain) - F.length(top)), F.reverse(d)), top)
    code = F.regexp_extract(entity, r"^\+[0-9]{1,3}?(?=[ .(-]|[0-9]{9,})", 0)
    number = F.concat(entity, F.repeat(F.lit("0"), extra))
    own_script = _like(F.concat(entity, F.repeat(F.regexp_extract(entity, r"\p{L}", 0), attempt)), d)
    syllables = lambda script, at, n: F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: _pick(SYLLABLES[script], _number(d, at + 7 * i, len(SYLLABLES[script])))), "")
    family = lambda script: syllables(script, 1, attempt + 4)
    given = lambda sex, script: F.concat(F.lower(_pick(GIVEN[sex][script], _number(d, 1, len(GIVEN[sex][script])))), F.when(attempt > 0, F.concat(F.lit("-"), F.lower(_pick(GIVEN[sex][script], _number(d, 9, len(GIVEN[sex][script])))), F.when(attempt > 3, F.concat(F.lit("-"), syllables(script, 17, F.greatest(attempt - 2, F.lit(1))))).otherwise(""))).otherwise(""))
    by_script = lambda make: F.when(cyrillic, make("cyrillic")).when(latin, make("latin")).otherwise(own_script)
    out = F.when(kind == "email", address).when(kind == "secret", _hex_like(entity, d)).when(kind == "ip", octets).when(kind == "ipv6", _hex_like(number, d)).when(kind == "iban", _account(number, d))
    out = out.when(kind == "phone", F.concat(code, _like(F.substr(number, F.length(code) + 1, F.length(number)), d)))
    out = out.when(kind == "card", _card(number, d)).when(kind == "family", by_script(family))
    for sex in GIVEN:
        out = out.when(kind == f"given_{sex}", by_script(lambda script, sex=sex: given(sex, script)))
    return out.otherwise(_like(number, d))


def _drawn(entities: DataFrame, key: Column) -> DataFrame:
    """``entities`` (type, entity, attempt) with their surrogates."""
    return entities.withColumn("key", key).withColumn("digest", _digest(F.col("attempt"))).withColumn("surrogate", _surrogate(F.col("attempt"))).drop("key", "digest")


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(type, entity, surrogate) of distinct entities, no two of a type with one surrogate; given names are one type here."""
    secret = keyed(entities.sparkSession, key)
    kind = F.substring_index("type", "_", 1).alias("kind")
    now = Written(_drawn(entities.select("type", "entity", F.lit(0).alias("attempt")), secret), "surrogates")
    for attempt in count(1):
        first = now.df.groupBy(kind, "surrogate").agg(F.min(F.struct("attempt", "type", "entity")).alias("first"), F.count("*").alias("n"))
        real = now.df.select(kind, F.col("entity").alias("surrogate"), F.lit(True).alias("real")).distinct()
        clashes = first.join(real, ["kind", "surrogate"], "left").where("n > 1 or real")
        clashes = Written(clashes.select("kind", "surrogate", F.when(F.col("real").isNull(), F.struct("first.type", "first.entity")).alias("keeps"), F.lit(True).alias("clash")), "clashes")
        if clashes.df.isEmpty():
            return now.df.select("type", "entity", "surrogate")
        joined = now.df.withColumn("kind", kind).join(clashes.df, ["kind", "surrogate"], "left").withColumn("again", F.col("clash").isNotNull() & ~F.struct("type", "entity").eqNullSafe(F.col("keeps")))
        again = _drawn(joined.where("again").select("type", "entity", F.lit(attempt).alias("attempt")), secret)
        columns = ["type", "entity", "attempt", "surrogate"]
        following = Written(joined.where("not again").select(columns).unionByName(again.select(columns)), "surrogates")
        now.discard()
        clashes.discard()
        now = following


def _written_like(mention: Column, surrogate: Column) -> Column:
    return F.when((F.upper(mention) == mention) & (F.lower(mention) != mention), F.upper(surrogate)).otherwise(surrogate)


def replaced(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with surrogates in their texts, and ``n_mentions``: how many were replaced."""
    t1, t2, known, n_mentions = (fresh(docs, n) for n in ("t1", "t2", "replacements", "n_mentions"))
    keys = {t1: F.xxhash64(text), t2: F.xxhash64(F.lit("text"), F.col(text))}
    mentions_of = lambda pattern: F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    with tidy():
        mentions = docs.where(F.col(text).rlike(_MAYBE)).select(*(c.alias(n) for n, c in keys.items()), F.explode(F.array_distinct(mentions_of(_ANY))).alias("mention"))
        mentions = mentions.where(_counts(F.col("mention"), _type(F.col("mention"))))
        found = Written(mentions.withColumn("parts", _parts(F.col("mention"))), "mentions").df
        parts = found.select(t1, t2, "mention", F.explode("parts").alias("part")).select(t1, t2, "mention", "part.at", "part.type", "part.entity")
        drawn = surrogates(parts.select("type", "entity").distinct(), key)
        gathered = parts.join(drawn, ["type", "entity"]).groupBy(t1, t2, "mention").agg(F.array_sort(F.collect_set(F.struct("at", "type", "entity", "surrogate"))).alias("s"))
        named = F.map_from_arrays(F.transform("s", lambda x: x["at"]), F.transform("s", lambda x: F.initcap(x["surrogate"])))
        titled = F.array_join(F.transform(F.split("mention", " "), lambda w, i: F.coalesce(F.try_element_at(named, i), w)), " ")
        is_name = F.get("s", F.lit(0))["type"].isin("family", *(f"given_{sex}" for sex in GIVEN))
        whole = F.struct("mention", F.when(is_name, titled).otherwise(_written_like(F.col("mention"), F.get("s", F.lit(0))["surrogate"])).alias("new"))
        # the parts of a name are also known by themselves, under their lower-case form behind a line break
        bare = F.when(is_name, F.transform("s", lambda x: F.struct(F.concat(F.lit("\n"), x["entity"]).alias("mention"), x["surrogate"].alias("new"))))
        entries = gathered.select(t1, t2, F.explode(F.concat(F.array(whole), F.coalesce(bare, F.array()))).alias("r")).groupBy(t1, t2, "r.mention").agg(F.min("r.new").alias("new"))
        by_text = Written(entries.groupBy(t1, t2).agg(F.map_from_entries(F.collect_list(F.struct("mention", "new"))).alias(known)), "replacements", keep=True).df
    # a merge join at every size: texts are shuffled once, and hot ones are split
    joined = docs.withColumns(keys).join(by_text.hint("merge"), [t1, t2], "left")
    has, names = F.col(known).isNotNull(), F.exists(F.map_keys(known), lambda k: k.startswith("\n"))

    def filled(pattern: str) -> Column:
        """The text with surrogates, and their number."""

        def one(m: Column) -> Column:
            bare = F.element_at(F.col(known), F.concat(F.lit("\n"), F.lower(m)))
            return F.coalesce(F.element_at(F.col(known), m), F.when((F.upper(m) == m) & (F.length(m) > 1), F.upper(bare)).otherwise(F.initcap(bare)))

        new = F.transform(mentions_of(pattern), lambda m: F.struct(m.alias("old"), one(m).alias("new")))
        pieces = F.zip_with(F.split(F.col(text), pattern, -1), new, lambda gap, m: F.concat(gap, F.coalesce(m["new"], m["old"], F.lit(""))))
        return F.struct(F.array_join(pieces, "").alias("text"), F.size(F.filter(new, lambda m: m["new"].isNotNull())).alias("n"))

    done = fresh(docs, "filled")
    joined = joined.withColumn(done, F.when(has & names, filled(f"{_ANY}|{_WORD}")).when(has, filled(_ANY)))
    columns = [F.when(has, F.col(done)["text"]).otherwise(F.col(text)).alias(c) if c == text else F.col(c) for c in docs.columns]
    return joined.select(*columns, F.when(has, F.col(done)["n"]).otherwise(0).cast("long").alias(n_mentions))
