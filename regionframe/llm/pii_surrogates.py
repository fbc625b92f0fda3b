"""Surrogates for personal data, in DataFrame operations alone.

Entities (e-mail addresses, phone and card numbers, IPv4 addresses, secrets, and names after an honorific) are found by one
pattern.  Each distinct entity, by its canonical form (case and punctuation dropped), gets a surrogate that a secret
key decides: letters become letters of the same case and script, digits become digits, hexadecimal stays hexadecimal, a
valid Luhn number stays valid, an address part keeps its length, and a name takes a given name of the honorific's
gender in its script.  The same entity has the same surrogate in all documents and in all spellings (coreference); given and family name are
replaced apart, so "Mr. John Smith" and "Mr. Smith" keep the family name they share.

Distinctness is checked, not assumed: over all distinct entities, a surrogate that two of them share, or that is itself an
entity of the corpus, is drawn anew with the next attempt number for all but the first, until no such case is left.  A format
holds a finite number of values (9^4 addresses of single digits, 16 given names), so from the second new draw on it widens: numbers, hexadecimal strings,
secrets and names grow, address parts take any length and then become IPv6.  Each attempt multiplies the room, so the rounds end whatever
the number of entities.

Only documents with entities take part in joins; the others are passed through by the scan.  One entity may stand in a third of all documents:
occurrences meet the table of entities in a join whose skewed side Spark can split.

Defined cases: null and empty texts stay as they are; texts of any length are searched whole; repeated rows stay repeated; a given name seen with
both genders takes either; an empty table gives an empty result; all other columns are passed through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

# What the detector recognises.
TITLES_M = ("Mr", "Mister", "Sir", "Herr", "Herrn", "Señor", "Sr", "Monsieur", "M", "господин", "κύριος")
TITLES_F = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Señora", "Sra", "Madame", "Mme", "Mlle", "госпожа", "κυρία")
TITLES_X = ("Dr", "Prof")
_TITLE = "|".join(sorted(TITLES_M + TITLES_F + TITLES_X, key=lambda x: (-len(x), x)))
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+"
SECRET = r"(?<=(?:[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Pp]assword|PASSWORD|[Kk]ey|KEY)\s{0,2}[=:]\s{0,2}[\"'])[^\"'\s]{6,}|(?<![0-9A-Za-z])(?=[a-fA-F]{0,40}[0-9])[0-9a-fA-F]{32,}(?![0-9A-Za-z])"
IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d.]*\d)"
PHONE = r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\w)|(?<![\w+])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w+.-])\d{3}[.-]\d{3}[.-]\d{4}(?!\w)"
CARD = r"(?<![\w.])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?!\w)"
NAME = r"(?<=(?<!\p{L})(?:" + _TITLE + r")\.? )\p{Lu}[\p{L}'’-]+(?: \p{Lu}[\p{L}'’-]+)?"
ENTITY = "|".join((EMAIL, SECRET, IP, PHONE, CARD, NAME))
MAY_HOLD = r"@|\d[\d .()-]{4,}\d|[0-9a-fA-F]{32}|(?:[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Pp]assword|PASSWORD|[Kk]ey|KEY)\s{0,2}[=:]|(?<!\p{L})(?:" + _TITLE + r")\.? \p{Lu}"

# Surrogate names.
GIVEN = {
    ("latin", "m"): ("Adrian", "Boris", "Conrad", "Dorian", "Edgar", "Felix", "Gustav", "Hector", "Ivan", "Jasper", "Leon", "Marcus", "Nestor", "Oscar", "Roland", "Simon"),
    ("latin", "f"): ("Alma", "Bianca", "Clara", "Daria", "Elena", "Flora", "Greta", "Helena", "Irma", "Julia", "Lydia", "Marta", "Nora", "Olivia", "Rosa", "Selma"),
    ("cyrillic", "m"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл"),
    ("cyrillic", "f"): ("Анна", "Белла", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Ксения"),
    ("greek", "m"): ("Άγγελος", "Βασίλης", "Γιώργος", "Δημήτρης", "Ηλίας", "Κώστας", "Λεωνίδας", "Νίκος"),
    ("greek", "f"): ("Άννα", "Βασιλική", "Γεωργία", "Δήμητρα", "Ελένη", "Κατερίνα", "Λυδία", "Νίκη"),
}
SYLLABLES = {
    "latin": ("ba", "cor", "del", "fen", "gar", "hol", "kin", "lan", "mer", "nor", "pol", "quin", "ras", "sel", "tor", "ven"),
    "cyrillic": ("ба", "вер", "гор", "дин", "зал", "кор", "лен", "мир", "нов", "пол", "рад", "сев", "тор", "фед", "чер", "шал"),
    "greek": ("βα", "γερ", "δελ", "ζαν", "κορ", "λεν", "μιρ", "νικ", "παπ", "ροδ", "σελ", "ταν", "φερ", "χαρ", "ψαλ", "ωνα"),
}


def _alternatives(titles: tuple[str, ...]) -> str:
    return r"(?:" + "|".join(titles) + r")\.? $"


def kind(e: Column) -> Column:
    whole = lambda p: e.rlike(r"^(?:" + p + r")$")
    return (
        F.when(e.contains("@"), "email")
        .when(whole(r"\d{1,3}(?:\.\d{1,3}){3}"), "ip")
        .when(whole(r"\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}"), "card")
        .when(whole(r"[+(]\d[\d ().-]+|\d{3}[.-]\d{3}[.-]\d{4}"), "phone")
        .when(whole(r"[0-9a-fA-F]{6,}"), "hex")
        .when(whole(r"\p{Lu}[\p{L}'’-]+(?: \p{Lu}[\p{L}'’-]+)?") & ~e.rlike(r"^\p{Lu}+$"), "name")
        .otherwise("secret")
    )


def canonical(e: Column, k: Column) -> Column:
    return F.when(k.isin("phone", "card"), F.regexp_replace(e, r"\D", "")).when(k.isin("email", "name"), F.lower(e)).when(k == "hex", F.lower(e)).otherwise(e)


def _draw(h: Column, i: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(h, i), F.lit(n)).cast("int")


def _char(c: Column, i: Column, h: Column) -> Column:
    """A character of the same class as ``c``, decided by ``h`` and the place ``i``."""
    pick = lambda first, n: F.substring(F.lit("".join(chr(ord(first) + k) for k in range(n))), _draw(h, i, n) + 1, F.lit(1))
    return (
        F.when(c.between("0", "9"), pick("0", 10)).when(c.between("a", "z"), pick("a", 26)).when(c.between("A", "Z"), pick("A", 26))
        .when(c.between("а", "я"), pick("а", 32)).when(c.between("А", "Я"), pick("А", 32)).when(c.between("α", "ρ"), pick("α", 17)).when(c.between("Α", "Ρ"), pick("Α", 17))
        .when(c.rlike(r"\p{Ll}"), pick("a", 26)).when(c.rlike(r"\p{Lu}"), pick("A", 26)).when(c.rlike(r"\p{L}"), c).otherwise(c)
    )


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _digits(canon: Column, h: Column, kept: Column) -> Column:
    """The digits of a number drawn anew, but for the first ``kept``; the first drawn one is not 0 or 1."""
    return F.array_join(F.transform(_chars(canon), lambda c, i: F.when(i < kept, c).when(i == kept, (_draw(h, i, 8) + 2).cast("string")).otherwise(_draw(h, i, 10).cast("string"))), "")


def _syllables(script: str, h: Column, n: Column) -> Column:
    """``n`` syllables of a script."""
    known = F.array(*map(F.lit, SYLLABLES[script]))
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.element_at(known, _draw(h, i, len(SYLLABLES[script])) + 1)), "")).otherwise("")


def _luhn(d: Column) -> Column:
    """Luhn sum of the digits ``d`` modulo 10."""
    at = lambda c, i: F.when((F.length(d) - i) % 2 == 0, F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1)).otherwise(c.cast("int"))
    return F.aggregate(F.transform(_chars(d), at), F.lit(0), lambda a, x: a + x) % 10


def surrogate(canon: Column, k: Column, gender: Column, attempt: Column, key: str) -> Column:
    """The canonical surrogate of a canonical entity; from the second new draw on its format is wider by ``more`` places."""
    h = F.sha2(F.concat_ws("\x1f", F.lit(key), k, canon, attempt.cast("string")), 256)
    more = (F.greatest(attempt - 1, F.lit(0)) * 2).cast("int")
    wide = F.concat(canon, F.repeat(F.lit("0"), more))
    country = F.greatest(F.length(canon) - 10, F.lit(0))
    card = _digits(wide, h, F.lit(0))
    head = F.substring(card, F.lit(1), F.length(card) - 1)
    valid = F.concat(head, F.pmod(10 - _luhn(F.concat(head, F.lit("0"))), F.lit(10)).cast("string"))
    octet = lambda o, i: (F.when(more > 0, _draw(h, i, 255) + 1).when(F.length(o) == 1, _draw(h, i, 9) + 1).when(F.length(o) == 2, _draw(h, i, 90) + 10).otherwise(_draw(h, i, 155) + 100)).cast("string")
    ip = F.when(more < 12, F.array_join(F.transform(F.split(canon, r"\."), octet), ".")).otherwise(F.concat(F.lit("2001:db8"), *[x for g in range(6) for x in (F.lit(":"), F.substring(h, 4 * g + 1, 4))]))
    hexed = F.array_join(F.transform(_chars(wide), lambda c, i: F.substring(F.lit("0123456789abcdef"), _draw(h, i, 16) + 1, F.lit(1))), "")
    mapped = F.array_join(F.transform(_chars(wide), lambda c, i: _char(c, i, h)), "")
    local = F.array_join(F.transform(_chars(F.substring_index(canon, "@", 1)), lambda c, i: _char(c, i, h)), "")
    top = F.substring_index(canon, ".", -1)
    mail = F.concat(local, F.lit("@mail"), F.substring(h, F.lit(1), more + 6), F.lit(".example."), F.when(top.isin("com", "net", "org"), top).otherwise("com"))
    script = F.when(canon.rlike(r"\p{IsCyrillic}"), "cyrillic").when(canon.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    sex = F.when(gender == "x", F.when(_draw(h, F.lit(99), 2) == 0, "m").otherwise("f")).otherwise(gender)
    family = given = F.lit(None).cast("string")
    for s in SYLLABLES:
        family = F.when(script == s, _syllables(s, h, more + 4)).otherwise(family)
        for g in "mf":
            stem = F.element_at(F.array(*map(F.lit, GIVEN[s, g])), _draw(h, F.lit(50), len(GIVEN[s, g])) + 1)
            # There are few given names: every new draw adds syllables.
            given = F.when((script == s) & (sex == g), F.concat(F.lower(stem), _syllables(s, h, attempt * 2))).otherwise(given)
    return (
        F.when(k == "email", mail).when(k == "ip", ip).when(k == "phone", _digits(wide, h, country)).when(k == "card", F.when(_luhn(canon) == 0, valid).otherwise(card))
        .when(k == "hex", hexed).when(k == "family", family).when(k == "given", given).otherwise(mapped)
    )


def dress(entity: Column, k: Column, sur: Column) -> Column:
    """The surrogate in the entity's own spelling: its punctuation and its case."""
    before = lambda i: F.length(F.regexp_replace(F.substring(entity, F.lit(1), i), r"\D", ""))
    spaced = F.array_join(F.transform(_chars(entity), lambda c, i: F.when(c.between("0", "9"), F.substring(sur, before(i.cast("int")) + 1, F.lit(1))).otherwise(c)), "")
    spaced = F.concat(spaced, F.substring(sur, before(F.length(entity)) + 1, F.length(sur)))
    cased = F.when(entity == F.upper(entity), F.upper(sur)).when(k == "name", F.initcap(sur)).otherwise(sur)
    return F.when(k.isin("phone", "card"), spaced).when(k.isin("hex", "name", "email"), cased).otherwise(sur)


def entity_table(found: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """(kind, canon, sur) of distinct entities (kind, canon, gender), no surrogate twice and none an entity itself."""
    found = found.withColumn("attempt", F.lit(0))
    while True:
        now = scratch.write(found.withColumn("sur", surrogate(F.col("canon"), F.col("kind"), F.col("gender"), F.col("attempt"), key)), "pii-drawn")
        owners = now.groupBy("kind", "sur").agg(F.min("canon").alias("owner"), F.count("*").alias("sharers"))
        real = now.select(F.col("kind").alias("r_kind"), F.col("canon").alias("r_canon"))
        taken = owners.join(real, (F.col("kind") == F.col("r_kind")) & (F.col("sur") == F.col("r_canon")), "left")
        taken = taken.where("sharers > 1 or r_canon is not null").select(F.col("kind").alias("t_kind"), F.col("sur").alias("t_sur"), F.when(F.col("r_canon").isNull(), F.col("owner")).alias("owner"))
        taken = scratch.write(taken, "pii-clashes")
        if taken.isEmpty():
            return now.select("kind", "canon", "sur")
        again = F.col("t_sur").isNotNull() & ~F.col("canon").eqNullSafe(F.col("owner"))
        joined = now.join(taken, (F.col("kind") == F.col("t_kind")) & (F.col("sur") == F.col("t_sur")), "left")
        found = joined.select("kind", "canon", "gender", (F.col("attempt") + again.cast("int")).alias("attempt"))


def _surrogates(each: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """(entity, new): the surrogate of every spelling of ``each`` (entity, gender)."""
    spelled = each.groupBy("entity").agg(F.bool_or(F.col("gender") == "m").alias("m"), F.bool_or(F.col("gender") == "f").alias("f"))
    spelled = spelled.withColumn("kind", kind(F.col("entity"))).withColumn("canon", canonical(F.col("entity"), F.col("kind")))
    two = (F.col("kind") == "name") & F.col("canon").contains(" ")
    whole = F.when(F.col("kind") == "name", F.struct(F.lit("family").alias("kind"), F.substring_index("canon", " ", -1).alias("canon"))).otherwise(F.struct("kind", "canon"))
    spelled = scratch.write(spelled.select("entity", "kind", "m", "f", whole.alias("unit"), F.when(two, F.struct(F.lit("given").alias("kind"), F.substring_index("canon", " ", 1).alias("canon"))).alias("given")), "pii-spelled")
    units = spelled.select("unit", "m", "f").unionByName(spelled.where("given is not null").select(F.col("given").alias("unit"), "m", "f"))
    units = units.groupBy("unit.kind", "unit.canon").agg(F.bool_or("m").alias("m"), F.bool_or("f").alias("f"))
    gender = F.when(F.col("m") == F.col("f"), "x").when(F.col("m"), "m").otherwise("f")
    drawn = entity_table(units.select("kind", "canon", gender.alias("gender")), key, scratch)
    met = spelled.join(drawn.select(F.struct("kind", "canon").alias("u"), F.col("sur").alias("sur")), F.col("unit") == F.col("u"))
    met = met.join(drawn.where("kind = 'given'").select(F.struct("kind", "canon").alias("g"), F.col("sur").alias("first")), F.col("given") == F.col("g"), "left")
    return met.select("entity", dress(F.col("entity"), F.col("kind"), F.concat_ws(" ", "first", "sur")).alias("new"))


def surrogate_key(spark: SparkSession) -> str:
    """The secret of this session, ``spark.regionframe.surrogateKey``; without it a key for invented test data, which anyone can read here."""
    return spark.conf.get("spark.regionframe.surrogateKey", "invented test data")


def replace_entities(docs: DataFrame, *, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with every entity of ``text_col`` replaced, as the secret ``key`` decides; ``count_col`` adds the number of entities."""
    scratch = Scratch(docs.sparkSession)
    may = F.coalesce(F.col(text_col).rlike(MAY_HOLD), F.lit(False))
    base = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("body"), may.alias("may"))
    base = base.withColumn("ents", F.when(F.col("may"), F.regexp_extract_all("body", F.lit(ENTITY), F.lit(0))).otherwise(F.expr("cast(array() as array<string>)")))
    with_count = (lambda f, n: f.select("row.*", n.cast("long").alias(count_col))) if count_col else (lambda f, n: f.select("row.*"))
    clean = with_count(base.where("not may or size(ents) = 0"), F.lit(0))
    held = base.where("may").where("size(ents) > 0").select("row", "ents", F.split("body", ENTITY, -1).alias("gaps"), F.struct(F.xxhash64("row"), F.md5("body")).alias("rid"))
    held = scratch.write(held, "pii-held")
    titles = F.transform("gaps", lambda g: F.when(g.rlike(_alternatives(TITLES_M)), "m").when(g.rlike(_alternatives(TITLES_F)), "f").otherwise("x"))
    each = held.select("rid", F.posexplode(F.arrays_zip("ents", titles.alias("titles"))).alias("at", "z")).select("rid", "at", F.col("z.ents").alias("entity"), F.col("z.titles").alias("gender")).distinct()
    each = scratch.write(each, "pii-each")
    dressed = each.join(_surrogates(each.select("entity", "gender"), key, scratch).withColumnRenamed("entity", "spelled"), F.col("entity") == F.col("spelled"))
    dressed = dressed.select(F.col("rid").alias("d_rid"), F.struct("at", "new").alias("d"))
    dressed = scratch.write(dressed.groupBy("d_rid").agg(F.array_sort(F.collect_list("d")).alias("new")), "pii-dressed")
    scratch.close("pii-held", "pii-dressed")
    done = held.join(dressed, F.col("rid") == F.col("d_rid"))
    text = F.array_join(F.zip_with("gaps", "new", lambda g, d: F.concat(g, F.coalesce(d["new"], F.lit("")))), "")
    done = done.select(F.col("row").withField(text_col, text).alias("row"), F.size("ents").alias("n"))
    return clean.unionByName(with_count(done, F.col("n")))
