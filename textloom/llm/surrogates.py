"""Surrogates for personal data, in DataFrame operations only.

E-mail addresses, IPv4 addresses, social security, card and phone numbers and titled names are detected by one pattern.
An entity is a kind with a canonical form (digits of a number and its plus, lower-cased address, family name, and given
names with gender within a family); every mention of it, in any format, gets the same surrogate, drawn from a keyed SHA-256 of the entity:
digits take the place of digits and all other signs of a number stay, with its country code; addresses keep the shape of
their local part and get a reserved domain; names keep their title and get a given name of its gender and a family name
in the same script (Latin or Cyrillic).

Collision checks: a surrogate, in the form in which it is written, that equals another one or any original of its kind is drawn again, with the next attempt
number, until all are distinct; so distinct entities stay distinct and nothing maps onto an original.

Scale: texts without an entity pass through where they are read. Entities are aggregated before they are joined, so a
hot entity is one row; mentions travel as kind, canonical form and place, and only texts with entities are shuffled.

Defined results: null texts stay null and have 0 entities; a text without entities stays as it is; rows that repeat are
changed alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import fresh, keep, row_key, table

#: Titles by gender; fixed values.
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Don", "Г-н")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña", "Г-жа")
GIVEN = {
    ("m", "latin"): ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Hugo", "Ivan", "Jonas", "Karl", "Leo", "Martin", "Nils", "Oscar", "Paul", "Theo"),
    ("f", "latin"): ("Alice", "Bella", "Clara", "Diana", "Emma", "Flora", "Greta", "Helen", "Ida", "Julia", "Laura", "Maria", "Nora", "Olga", "Paula", "Rosa"),
    ("m", "cyrillic"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Максим", "Олег", "Павел", "Роман", "Степан", "Тимур", "Юрий"),
    ("f", "cyrillic"): ("Алла", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Ирина", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Раиса", "София", "Юлия"),
}
SYLLABLES = {
    "latin": ("bar", "ber", "cor", "dal", "der", "fan", "gar", "hal", "jor", "kel", "lan", "mer", "nor", "pel", "ros", "tam"),
    "cyrillic": ("бар", "бер", "вол", "гор", "дан", "жар", "зим", "кор", "лан", "мир", "нов", "пет", "рос", "сав", "тар", "юр"),
}
TITLES = "|".join(sorted((*MALE, *FEMALE), key=len, reverse=True))
#: A name has any number of initials, particles and capitalised words, up to the next title; the last word ends it.
PARTICLES = "(?:(?:" + "|".join(("al", "bin", "da", "das", "de", "degli", "dei", "del", "della", "den", "der", "des", "di", "do", "dos", "du", "el", "la", "las", "le", "los", "ten", "ter", "van", "von", "y", "zu", "zum", "zur")) + ") )*"
WORD = r"(?:\p{Lu}\. ?)*\p{Lu}[\p{L}\p{M}]*+(?:['’-]\p{L}[\p{L}\p{M}]*+)*+"
#: Kinds and their patterns, in the order in which they are tried.
NUMBER_START, NUMBER_END = r"(?<![0-9A-Za-z.])", r"(?![0-9A-Za-z])"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": NUMBER_START + r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9A-Za-z])",
    "ssn": NUMBER_START + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + NUMBER_END,
    "card": NUMBER_START + r"(?:[0-9]{4}[ -]?){3}[0-9]{1,7}" + NUMBER_END,
    "phone": r"(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}|" + NUMBER_START + r"(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4})" + NUMBER_END,
    "name": r"(?<!\p{L})(?:" + TITLES + r")\.? " + PARTICLES + WORD + "(?: " + PARTICLES + "(?!(?:" + TITLES + r")(?!\p{L}))" + WORD + ")*",
}
MASTER = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text that matches none of these cannot hold an entity; it is tried first because it is cheap.
HINT = r"@|[0-9]{3}|[0-9]\.[0-9]|\+[0-9]|(?:" + TITLES + r")\.? \p{L}"
ATTEMPTS = 60


def kind_of(value: Column) -> Column:
    """The first kind whose pattern covers the whole value."""
    out = F.lit("name")
    for kind in reversed([k for k in PATTERNS if k != "name"]):
        out = F.when(value.rlike("^(?:" + PATTERNS[kind] + ")$"), F.lit(kind)).otherwise(out)
    return out


def bare(name: Column) -> Column:
    """A titled name without its title."""
    return F.regexp_replace(name, r"^\S+ ", "")


def family_of(name: Column) -> Column:
    """The last word of a titled name, with the particles before it."""
    return F.regexp_extract(bare(name), "((?:(?<![^ ])" + PARTICLES + ")?[^ .]+)$", 1)


def canonical(kind: Column, value: Column) -> Column:
    """What mentions of one entity share."""
    return F.when(kind == "email", F.lower(value)).when(kind == "ip", value).when(kind == "name", F.lower(family_of(value))).otherwise(F.regexp_replace(value, r"(?!^\+)[^0-9]", ""))


def country_length(value: Column) -> Column:
    """Signs of a canonical number that its surrogate keeps: the plus and the country code, where a sign ends it."""
    parted = F.length(F.regexp_extract(value, r"^(\+[0-9]{1,3}(?=[ .(-]))", 1))
    return F.when(parted > 0, parted).otherwise(F.startswith(value, F.lit("+")).cast("int"))


def full_name(value: Column) -> Column:
    """Family name, gender and given names of a titled name, as one entity; null if it has no given name."""
    title = F.regexp_replace(F.substring_index(value, " ", 1), r"\.$", "")
    return F.when(given_of(value) != "", F.concat_ws("\x1f", F.lower(family_of(value)), F.when(title.isin(*FEMALE), "f").otherwise("m"), given_of(value)))


def given_of(name: Column) -> Column:
    """What stands between the title and the family name, lower-cased and without dots; empty if there is nothing."""
    rest = F.substr(bare(name), F.lit(1), F.length(bare(name)) - F.length(family_of(name)))
    return F.lower(F.trim(F.regexp_replace(rest, r"[. ]+", " ")))


def script(value: Column) -> Column:
    return F.when(value.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).otherwise(F.lit("latin"))


def digest(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *parts), 256)


def pick(values: tuple[str, ...], hex_: Column, at: int) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(F.conv(F.substring(hex_, at, 4), 16, 10).cast("int"), F.lit(len(values))))


def digits(hex_: Column) -> Column:
    """Decimal digits from a digest and its own digest; the first is not 0."""
    more = F.concat(hex_, F.sha2(hex_, 256))
    plain = F.translate(more, "abcdef", "135792")
    return F.concat(F.translate(F.substring(plain, 1, 1), "0", "4"), F.substring(plain, 2, 127))


def byte_at(hex_: Column, k: int, low: int, width: int) -> Column:
    return (F.pmod(F.conv(F.substring(hex_, 1 + 4 * k, 4), 16, 10).cast("int"), F.lit(width)) + low).cast("string")


def family(hex_: Column, kind: str, attempt: Column) -> Column:
    base = F.concat(pick(SYLLABLES[kind], hex_, 1), pick(SYLLABLES[kind], hex_, 5), pick(SYLLABLES[kind], hex_, 9), pick(SYLLABLES[kind], hex_, 13))
    return F.when(attempt > 3, F.concat(base, pick(SYLLABLES[kind], hex_, 17), pick(SYLLABLES[kind], hex_, 21))).otherwise(base)


def shaped(value: Column, hex_: Column) -> Column:
    """Letters for letters and digits for digits, in their case; other signs stay."""
    stream = F.concat(hex_, F.sha2(hex_, 256), F.sha2(F.sha2(hex_, 256), 256))

    def one(c, i):
        x = F.substr(stream, F.pmod(i, F.lit(190)) + 1, F.lit(2))
        n = F.conv(x, 16, 10).cast("int")
        letter = F.char(F.pmod(n, F.lit(26)) + 97)
        return F.when(c.rlike("[a-z]"), letter).when(c.rlike("[A-Z]"), F.upper(letter)).when(c.rlike("[0-9]"), F.pmod(n, F.lit(10)).cast("string")).otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def given_name(hex_: Column, canon: Column, attempt: Column) -> Column:
    """A given name of the entity's gender and script; after some attempts a double one, then one with syllables."""
    female, cyrillic = F.substring_index(F.substring_index(canon, "\x1f", 2), "\x1f", -1) == "f", script(canon) == "cyrillic"

    def one(at):
        f = F.when(cyrillic, pick(GIVEN["f", "cyrillic"], hex_, at)).otherwise(pick(GIVEN["f", "latin"], hex_, at))
        return F.when(female, f).when(cyrillic, pick(GIVEN["m", "cyrillic"], hex_, at)).otherwise(pick(GIVEN["m", "latin"], hex_, at))

    more = F.initcap(F.when(cyrillic, family(F.substring(hex_, 9, 32), "cyrillic", attempt)).otherwise(family(F.substring(hex_, 9, 32), "latin", attempt)))
    return F.when(attempt > 6, F.concat(one(1), F.lit("-"), more)).when(attempt > 3, F.concat(one(1), F.lit("-"), one(5))).otherwise(one(1))


def drawn(key: str, kind: Column, canon: Column, head: Column, attempt: Column) -> Column:
    """The canonical form of the surrogate of an entity, for an attempt."""
    hex_ = digest(key, kind, canon, attempt.cast("string"))
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    host = F.substring(digest(key, F.lit("domain"), domain), 1, 8)
    tld = F.substring_index(domain, ".", -1)
    # After some attempts the shape is given up for distinctness: a local part or number of one sign has few forms.
    mail = F.concat(F.when(attempt > 20, F.concat(shaped(local, hex_), F.substring(hex_, 1, 6))).otherwise(shaped(local, hex_)), F.lit("@m"), host, F.lit(".example."), F.when(tld.isin("com", "org", "net"), tld).otherwise(F.lit("com")))
    ip = F.concat_ws(".", byte_at(hex_, 0, 1, 223), byte_at(hex_, 1, 0, 256), byte_at(hex_, 2, 0, 256), byte_at(hex_, 3, 1, 254))
    name = F.when(script(canon) == "cyrillic", family(hex_, "cyrillic", attempt)).otherwise(family(hex_, "latin", attempt))
    # The family name tells apart draws of several families; it is a surrogate's own, so that only the given name is left.
    given = F.concat(F.substring_index(canon, "\x1f", 1), F.lit("\x1f"), given_name(hex_, canon, attempt))
    number = F.concat(F.substr(canon, F.lit(1), head), F.substr(digits(hex_), F.lit(1), F.length(canon) - head))
    return F.when(kind == "email", mail).when(kind == "ip", ip).when(kind == "name", name).when(kind == "given", given).otherwise(number)


def mapping(entities: DataFrame, key: str, attempts: int = ATTEMPTS) -> DataFrame:
    """(kind, canon, surrogate) for distinct entities (kind, canon, head): distinct within a kind, and no original. Draws
    are compared as they are written: numbers with the country code that they keep, given names within a family."""
    todo = keep(entities.withColumn("attempt", F.lit(0)), "entities")
    done = None
    for _ in range(attempts):
        tries = todo.withColumn("surrogate", drawn(key, F.col("kind"), F.col("canon"), F.col("head"), F.col("attempt")))
        # Ties go to the first canonical form; the window is as large as draws collide.
        place = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("canon"))
        taken = entities.select("kind", F.col("canon").alias("surrogate"))
        if done is not None:
            taken = taken.unionByName(done.select("kind", "surrogate"))
        tries = tries.withColumn("first", place == 1).join(taken.distinct().withColumn("taken", F.lit(True)), ["kind", "surrogate"], "left")
        tries = keep(tries.withColumn("ok", F.col("first") & F.col("taken").isNull()), "draws")
        good = tries.filter("ok").select("kind", "canon", "surrogate")
        done = good if done is None else done.unionByName(good)
        todo = tries.filter("NOT ok").select("kind", "canon", "head", (F.col("attempt") + 1).alias("attempt"))
        if todo.isEmpty():
            return done
    raise ValueError("surrogates still collide; a number may have fewer forms than the corpus has originals of its length")


def rendered(kind: Column, value: Column, surrogate: Column, given: Column) -> Column:
    """A mention in its own format with the surrogate's digits or names."""
    # The n-th digit of the mention takes the n-th digit of the surrogate.
    plain = F.regexp_replace(surrogate, r"[^0-9]", "")
    marks = F.transform(F.split(value, ""), lambda c: c.rlike("[0-9]").cast("int"))
    number = F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substr(plain, F.lit(1) + F.aggregate(F.slice(marks, 1, i), F.lit(0), lambda a, b: a + b), F.lit(1))).otherwise(c)), "")
    title = F.regexp_extract(value, r"^(\S+ )", 1)
    first = F.coalesce(F.concat(F.substring_index(given, "\x1f", -1), F.lit(" ")), F.lit(""))
    return F.when(kind.isin("email", "ip"), surrogate).when(kind == "name", F.concat(title, first, F.initcap(surrogate))).otherwise(number)


def replace(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with surrogates in the text, and a column n_entities."""
    i, k, e, m, n = (fresh(docs, f"_pii_{x}") for x in ("id", "key", "found", "made", "count"))
    some = F.coalesce(F.col(text_col).rlike(HINT) & F.col(text_col).rlike(MASTER), F.lit(False))
    found = docs.filter(some).withColumns({i: F.col(id_col), k: row_key(text_col), e: F.regexp_extract_all(F.col(text_col), F.lit(MASTER), F.lit(0))})
    mentions = found.select(F.coalesce(F.col(i), F.lit(0)).alias(i), F.col(i).isNull().alias("z"), k, F.posexplode(e).alias("pos", "value"))
    mentions = mentions.withColumn("kind", kind_of(F.col("value"))).withColumn("canon", canonical(F.col("kind"), F.col("value")))
    mentions = mentions.withColumn("full", F.when(F.col("kind") == "name", full_name(F.col("value"))))
    mentions = keep(mentions.distinct(), "mentions")
    entities = mentions.groupBy("kind", "canon").agg(F.max(F.when(F.col("kind") == "phone", country_length(F.col("value"))).otherwise(0)).alias("head"))
    entities = entities.unionByName(mentions.filter("full IS NOT NULL").select(F.lit("given").alias("kind"), F.col("full").alias("canon"), F.lit(0).alias("head")).distinct())
    table_ = mapping(entities, key)
    givens = table_.filter("kind = 'given'").select(F.col("canon").alias("full"), F.col("surrogate").alias("given"))
    # Mentions without a given name don't take part in that join: their nulls would meet in one task.
    given = mentions.filter("full IS NOT NULL").join(givens, "full").unionByName(mentions.filter("full IS NULL").withColumn("given", F.lit(None).cast("string")))
    made = given.join(table_.filter("kind <> 'given'"), ["kind", "canon"]).withColumn("new", rendered(F.col("kind"), F.col("value"), F.col("surrogate"), F.col("given")))
    # A list for each text: as long as the text has entities.
    made = made.groupBy(i, "z", k).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "new"))), lambda x: x["new"]).alias(m))
    gaps = F.split(F.col(text_col), MASTER, -1)
    text = F.concat(F.array_join(F.transform(F.col(m), lambda x, j: F.concat(F.get(gaps, j), x)), ""), F.get(gaps, F.size(m)))
    z = fresh(docs, "_pii_null")
    own = found.drop(e).withColumns({z: F.col(i).isNull(), i: F.coalesce(F.col(i), F.lit(0))})
    changed = own.join(made.withColumnRenamed("z", z), [i, z, k]).withColumns({text_col: text, n: F.size(m).cast("long")})
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return changed.select(*columns, F.col(n).alias("n_entities")).unionByName(docs.filter(~some).select(*columns, F.lit(0).cast("long").alias("n_entities")))


def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace(docs, key="textloom")
