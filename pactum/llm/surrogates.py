"""Personal data and secrets replaced by keyed surrogates, with DataFrame operations alone.

Every entity has a type and a canonical form (digits of a card or phone, lower case of an address), so
all its mentions share one surrogate.  A surrogate is made from a keyed hash in the entity's own format:
digits for digits, letters for letters, a name for a name of the same gender and script, a card number
that passes the check sum.  The table of entities is checked: no two entities may share a surrogate and
none may be an entity of the corpus; those that collide are made anew with the next attempt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pactum.llm.frames import written

# What is looked for.
_TITLES = {"male": ("Mr", "Herr", "Señor", "Monsieur", "Господин"), "female": ("Mrs", "Ms", "Frau", "Señora", "Madame", "Госпожа")}
_ALL_TITLES = "|".join(t for ts in _TITLES.values() for t in sorted(ts, key=len, reverse=True))
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: An address with the signs that stand before its first letter or digit (they are kept, and no part of it).  An
#: attempt starts only at the head of such a run or behind the last match, and nothing taken is given back: a long
#: run is walked through once, and a possessive group is a loop, not a recursion.
_LEAD = "[._%+-]"
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)" + _LEAD + r"*+[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "key": r"\bAKIA[A-Z0-9]{16}\b",
    "secret": r"(?<=\b(?:password|passwd|secret|token|api_key)\s{0,2}[=:]\s{0,2}[\"']?)[A-Za-z0-9_\-]{8,}",
    "iban": r"\b[A-Z]{2}\d{2}(?:(?: ?\d{4}){3,7}\b|(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d.])\d(?:[ -]?\d){12,18}(?![\d.]\d)",
    "ip": r"(?<![\d.])(?:" + _OCTET + r"\.){3}" + _OCTET + r"(?!\.?\d)",
    "phone": r"(?<![\w+])\+?\d{1,3}[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<!\w)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)"
             r"|(?<![\w.+-])(?:\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4})(?![\w-]|\.\d)|(?<![\w+])\+\d{1,3}(?:[ .-]\d{2,4}){2,4}(?![\d-])",
    "name": r"(?<=\b(?:" + _ALL_TITLES + r")\.?\s)\p{Lu}\p{L}+(?: \p{Lu}\p{L}+)?",
}
TYPES = tuple(PATTERNS)
ANY = "|".join(PATTERNS.values())
#: A text without any of these holds no entity.
HINT = r"[@\d]|\b(?:" + _ALL_TITLES + r")\b|secret|token|password|passwd|api_key"
SALTS, ATTEMPTS = 16, 50
#: An account number in any grouping; where it isn't digits in fours, its check digits must be right.
_IBAN_DIGITS = r"^[A-Z]{2}\d{2}(?: ?\d{4}){3,7}$"
_SECRET_BEFORE = r"(?:password|passwd|secret|token|api_key)\s{0,2}[=:]\s{0,2}[\"']?$"


def _kind(entity: Column, before: Column) -> Column:
    """The type of a match; null for a number that is none of the types."""
    kind = None
    secret = before.rlike(_SECRET_BEFORE)
    for name, pattern in PATTERNS.items():
        if name in ("secret", "name"):
            continue  # told by what stands before them; a match of these only is one of the two
        hit = entity.rlike("^(?:" + pattern + ")$")
        if name == "card":
            hit = hit & luhn(F.regexp_replace(entity, r"\D", ""))
        if name == "iban":
            account = F.replace(entity, F.lit(" "), F.lit(""))
            right = mod_97(F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))) == 1
            sound = entity.rlike(_IBAN_DIGITS) | right
            kind = kind.when(hit & sound, name).when(hit & ~secret, F.lit(None))
            continue
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    return kind.when(secret, "secret").when(entity.rlike(r"^\p{Lu}\p{L}+( \p{Lu}\p{L}+)?$") & ~entity.rlike(r"\d"), "name").when(
        entity.rlike(r"^[\d .()+-]+$"), F.lit(None)).otherwise("secret")


def mod_97(text: Column) -> Column:
    """A text of digits and capitals as a number (A is 10, Z is 35), modulo 97."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), lambda a, c: F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def luhn(digits: Column) -> Column:
    """Whether the check sum of a digit string is right."""
    spread = F.transform(F.reverse(F.filter(F.split(digits, ""), lambda d: d != "")), lambda d, i: F.when(
        i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(spread, F.lit(0), lambda a, d: a + d.cast("int")) % 10 == 0


def _canonical() -> Column:
    e = F.col("entity")
    return F.when(F.col("kind").isin("card", "phone", "ssn"), F.regexp_replace(e, r"\D", "")).when(
        F.col("kind") == "iban", F.regexp_replace(e, " ", "")).when(
        F.col("kind") == "email", F.lower(F.regexp_replace(e, "^" + _LEAD + "+", ""))).otherwise(e)


def _byte(stream: Column, i: Column) -> Column:
    """The i-th byte of a stream of hexadecimal digits, which repeats with a shift."""
    at = F.pmod(i * 2 + F.floor(i / 60).cast("int"), F.lit(126)) + 1
    return F.conv(F.substring(stream, at, F.lit(2)), 16, 10).cast("int")


def _formatted(canonical: Column, stream: Column) -> Column:
    """Digits for digits, letters for letters of the same case; the first digit stays non-zero."""
    def one(c: Column, i: Column) -> Column:
        b = _byte(stream, i)
        return (
            F.when(c.rlike("[1-9]"), F.substring(F.lit("123456789"), b % 9 + 1, F.lit(1)))
            .when(c == "0", F.substring(F.lit("0123456789"), b % 10 + 1, F.lit(1)))
            .when(c.rlike("[a-z]"), F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), b % 26 + 1, F.lit(1)))
            .when(c.rlike("[A-Z]"), F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), b % 26 + 1, F.lit(1)))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.filter(F.split(canonical, ""), lambda c: c != ""), one), "")


def _stream(key: str, *parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("\x00", F.lit(key), *parts), 512)


def _name(key: str, stream: Column) -> Column:
    """A first name of the gender and a family name, from syllables of the script.  The family name depends on the
    entity's last word alone, so `Mr. Karl Berg` and `Mr. Berg` stay one family; with every attempt a name that
    collides is a syllable longer (the first name, or the family name where it stands alone), so the space of names
    never ends."""
    c = F.col("canonical")
    cyrillic, alone = c.rlike(r"\p{IsCyrillic}"), ~c.contains(" ")
    kin = _stream(key, F.lit("name"), F.substring_index(c, " ", -1), F.when(alone, F.col("attempt")).otherwise(0).cast("string"))

    def syllable(of: Column, at: Column) -> Column:
        return F.when(cyrillic, F.element_at(F.array(*map(F.lit, cyr)), _byte(of, at) % len(cyr) + 1)).otherwise(
            F.element_at(F.array(*map(F.lit, latin)), _byte(of, at) % len(latin) + 1))

    def syllables(of: Column, base: int, count: int) -> Column:
        return F.concat(*[syllable(of, F.lit(base + k)) for k in range(count)])

    latin = ["ba", "de", "fi", "ga", "ho", "ka", "le", "mi", "no", "pa", "ro", "sa", "te", "vi", "za", "lu"]
    cyr = ["ба", "де", "фи", "га", "хо", "ка", "ле", "ми", "но", "па", "ро", "са", "те", "ви", "за", "лу"]
    male = F.when(cyrillic, "н").otherwise("n")
    female = F.when(cyrillic, "я").otherwise("ia")
    ending = F.when(F.col("gender") == "female", female).otherwise(male)
    # no syllable at attempt 0: a sequence from 1 to 0 would count down
    tries = F.filter(F.sequence(F.lit(0), F.col("attempt")), lambda k: k > 0)
    more = F.array_join(F.transform(tries, lambda k: syllable(stream, k + 10)), "")
    family = F.initcap(F.concat(syllables(kin, 8, 3), F.when(alone, more).otherwise(""), F.when(
        cyrillic & (F.col("gender") == "female"), "ва").when(cyrillic, "в").otherwise("s")))
    first = F.initcap(F.concat(syllables(stream, 0, 2), more, ending))
    return F.when(alone, family).otherwise(F.concat(first, F.lit(" "), family))


def _surrogate(key: str) -> Column:
    stream = _stream(key, "kind", "canonical", F.col("attempt").cast("string"))
    c = F.col("canonical")
    digits = _formatted(c, stream)
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    checks = F.array(*[F.concat(body, F.lit(str(d))) for d in range(10)])
    octet = [(_byte(stream, F.lit(k)) % 254 + 1).cast("string") for k in range(4)]
    local = _formatted(F.substring_index(c, "@", 1), stream)
    domain = F.substring(_stream(key, F.lit("domain"), F.substring_index(c, "@", -1)), 1, 8)
    country, account = F.substring(c, 1, 2), _formatted(F.substring(c, F.lit(5), F.length(c)), stream)
    check = F.lpad((98 - mod_97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")
    return (
        F.when(F.col("kind") == "card", F.element_at(F.filter(checks, luhn), 1))
        .when(F.col("kind") == "ip", F.concat_ws(".", *octet))
        .when(F.col("kind") == "iban", F.concat(country, check, account))
        .when(F.col("kind") == "email", F.concat(local, F.lit("@mail"), domain, F.lit(".example.org")))
        .when(F.col("kind") == "key", F.concat(F.lit("AKIA"), _formatted(F.substring(c, 5, 99), stream)))
        .when(F.col("kind") == "name", _name(key, stream))
        .otherwise(digits)
    )


def surrogate_table(entities: DataFrame, key: str) -> DataFrame:
    """kind, canonical, surrogate for different (kind, canonical, gender) rows: distinct within a kind, and
    never an entity of the corpus.  Each round settles all entities without a collision; the table is
    written between rounds."""
    open_ = written(entities.withColumn("attempt", F.lit(0)), "pii-entities")
    real = open_.select("kind", F.col("canonical").alias("surrogate"))
    settled = None
    for _ in range(ATTEMPTS):
        tried = open_.withColumn("surrogate", _surrogate(key))
        first = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("canonical"))
        taken = real if settled is None else real.unionByName(settled.select("kind", "surrogate"))
        judged = tried.withColumn("first", first).join(taken.distinct().withColumn("taken", F.lit(True)), ["kind", "surrogate"], "left")
        judged = written(judged.withColumn("good", (F.col("first") == 1) & F.col("taken").isNull()), "pii-round")
        good = judged.where("good").select("kind", "canonical", "surrogate")
        settled = good if settled is None else settled.unionByName(good)
        open_ = judged.where(~F.col("good")).select(*entities.columns, (F.col("attempt") + 1).alias("attempt"))
        if open_.isEmpty():
            return settled
    raise ValueError("surrogates collide: there are more entities of a format than surrogates")


def _poured() -> Column:
    """The surrogate's letters and digits in the mention's own separators."""
    e, s = F.col("entity"), F.col("surrogate")
    chars = F.filter(F.split(e, ""), lambda c: c != "")
    at = F.aggregate(
        chars, F.struct(F.lit("").alias("out"), F.lit(1).alias("i")),
        lambda a, c: F.when(c.rlike("[0-9A-Za-z]"), F.struct(F.concat(a["out"], F.substring(s, a["i"], F.lit(1))).alias("out"), (a["i"] + 1).alias("i"))).otherwise(
            F.struct(F.concat(a["out"], c).alias("out"), a["i"].alias("i"))))
    lead = F.regexp_extract(e, "^" + _LEAD + "*", 0)
    return F.when(F.col("kind").isin("card", "phone", "ssn", "iban"), at["out"]).when(F.col("kind") == "email", F.concat(lead, s)).otherwise(s)


def _count(kinds: Column, name: str) -> Column:
    return F.size(F.filter(kinds, lambda kind: kind == name))


def replace_private(docs: DataFrame, key: str = "surrogates") -> DataFrame:
    """doc_id, text with surrogates, n_entities, and n_<type> for each type, for every row of `docs`.

    Null texts stay null and empty ones empty, with no entities; texts without entities are never moved.
    All mentions of an entity in the corpus get the same surrogate; a different key gives other surrogates.
    An entity that a third of all documents name is joined in SALTS parts.  Numbers that look like cards
    but fail the check sum stay, and so do letters and digits that look like an account number but fail its check.
    A person's gender is that of most of their titles.  Repeated rows and null ids stay as they are; other columns are left out.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = texts.withColumn("ents", F.when(F.col("text").rlike(HINT), F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>")))
    female = F.col("before").rlike("(?:" + "|".join(_TITLES["female"]) + r")\.?\s$")
    with_some = written(
        found.where(F.size("ents") > 0).withColumn("parts", F.split("text", ANY, -1)).withColumn("row", F.xxhash64("doc_id", "text")).drop("text"), "pii-found")
    mentions = with_some.select("row", F.posexplode("ents").alias("at", "entity"), "parts").select(
        "row", "entity", F.right(F.element_at("parts", F.col("at") + 1), F.lit(16)).alias("before")).withColumn("kind", _kind(F.col("entity"), F.col("before")))
    mentions = mentions.where("kind IS NOT NULL").withColumn("canonical", _canonical()).withColumn(
        "gender", F.when(F.col("kind") == "name", F.when(female, "female").otherwise("male")))
    entities = mentions.groupBy("kind", "canonical").agg(F.when(
        F.col("kind") == "name", F.when(F.count_if(F.col("gender") == "female") > F.count_if(F.col("gender") == "male"), "female").otherwise("male")).alias("gender"))
    table = surrogate_table(entities, key).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = mentions.select("row", "entity", "kind", "canonical").distinct().withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    changed = salted.join(table, ["kind", "canonical", "salt"]).withColumn("new", _poured())
    by_row = changed.groupBy("row").agg(
        F.map_from_entries(F.collect_list(F.struct("entity", F.struct("new", "kind")))).alias("to"))
    rebuilt = with_some.join(by_row, "row", "left").withColumn(
        "to", F.coalesce("to", F.create_map().cast("map<string,struct<new:string,kind:string>>")))
    # whole names go wherever else they stand in the text, with or without a title
    full = F.filter(F.map_entries("to"), lambda e: (e["value"]["kind"] == "name") & e["key"].contains(" "))
    rebuilt = rebuilt.withColumn("full", full).withColumn("parts", F.when(F.size("full") == 0, F.col("parts")).otherwise(F.transform(
        "parts", lambda p: F.aggregate("full", p, lambda text, e: F.regexp_replace(
            text, F.concat(F.lit(r"(?<!\p{L})"), e["key"], F.lit(r"(?!\p{L})")), e["value"]["new"])))))
    out = F.array_join(F.transform("parts", lambda p, i: F.concat(p, F.when(
        i < F.size("ents"), F.coalesce(F.element_at("to", F.get("ents", i))["new"], F.get("ents", i))).otherwise(""))), "")
    kinds = F.transform("ents", lambda e: F.element_at("to", e)["kind"])
    counts = [_count(kinds, name).alias(f"n_{name}") for name in TYPES]
    total = F.size(F.filter(kinds, lambda k: k.isNotNull())).alias("n_entities")
    rest = found.where(F.size("ents") == 0).select("doc_id", "text", F.lit(0).alias("n_entities"), *[F.lit(0).alias(f"n_{name}") for name in TYPES])
    return rebuilt.select("doc_id", out.alias("text"), total, *counts).unionByName(rest)
