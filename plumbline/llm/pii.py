"""Personal data in texts, replaced by keyed surrogates of the same kind and shape. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import stored

# What counts as personal data. Possessive quantifiers keep the search linear; what repeats without bound is a
# class of characters, never a group, because the engine follows groups by recursion.
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
TITLES_M, TITLES_F = r"Mr\.?|Herr|Monsieur|Señor|Sr\.|Sir|Господин", r"Mrs\.?|Ms\.?|Miss|Frau|Madame|Mme\.?|Señora|Sra\.|Госпожа"
#: A word of a name: McDonald, O'Neil, Jean-Luc.
NAME_WORD = r"\p{Lu}[\p{L}\p{M}]*+(?:['’-][\p{L}\p{M}]++){0,4}"
#: What stands before the words of a name and stays: its title and initials.
BEFORE_NAME = rf"^(?:{TITLES_M}|{TITLES_F}) (?:\p{{Lu}}\. ){{0,2}}"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-][A-Za-z0-9.-]+(?<=\.[A-Za-z]{2,24})(?![A-Za-z0-9-])",
    "ip": rf"(?<![0-9A-Za-z.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9A-Za-z]|\.[0-9])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z+.-])[3-6][0-9]{3}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9A-Za-z]|[.-][0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9A-Za-z]|\.[0-9])",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:{TITLES_M}|{TITLES_F}) (?:\p{{Lu}}\. ){{0,2}}(?:{NAME_WORD} ){{0,2}}{NAME_WORD}(?![\p{{L}}\p{{N}}])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without any of this holds no match, so most texts are passed over quickly.
HINT = rf"[0-9]|@|(?:{TITLES_M}|{TITLES_F}) "
#: Letters are replaced within their class, so vowels stay vowels and scripts stay scripts.
CLASSES = ["aeiou", "bcdfghjklmnpqrstvwxyz", "áàâäãåéèêëíìîïóòôöõúùûü", "çñßšžćčđł", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "0123456789"]
#: Rounds after which an entity that still meets another one's surrogate gets a made-up, unique one.
ROUNDS = 12


def kind_of(entity: Column) -> Column:
    return F.when(entity.contains("@"), "email").when(entity.rlike(rf"^(?:{TITLES_M}|{TITLES_F}) "), "name").when(entity.rlike(rf"^(?:{OCTET}\.){{3}}{OCTET}$"), "ip") \
        .when(entity.rlike("^[A-Z]{2}[0-9]{2}"), "iban").when(entity.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn").when(entity.rlike("^[3-6][0-9]{3}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}$"), "card").otherwise("phone")


def entities(text: Column) -> Column:
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def words_of(entity: Column) -> Column:
    """(kind, word) of what an entity is replaced by: itself in canonical form; of a name its words, the last as surname, the
    others as first names (by gender)."""
    kind = kind_of(entity)
    part = lambda k, w: F.struct(k.alias("kind"), w.alias("word"))
    first = F.when(entity.rlike(rf"^(?:{TITLES_F}) "), "first_f").otherwise("first_m")
    bare = F.split(F.lower(F.regexp_replace(entity, BEFORE_NAME, "")), " ")
    name = F.transform(bare, lambda w, i: part(F.when(i == F.size(bare) - 1, "surname").otherwise(first), w))
    plain = F.when(kind.isin("email", "ip"), F.lower(entity)).otherwise(F.upper(F.regexp_replace(entity, "[^A-Za-z0-9]", "")))
    return F.when(kind == "name", name).otherwise(F.array(part(kind, plain)))


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def keyed_bytes(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *parts).cast("binary"), 512)


def characters(word: Column) -> Column:
    return F.regexp_extract_all(word, F.lit("(?s)."), F.lit(0))


def at(digest: Column, i: Column) -> Column:
    """Byte i (over and over) of a hexadecimal digest as a number."""
    return F.conv(F.substr(digest, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def swapped(char: Column, number: Column) -> Column:
    """Another character of the same class; upper case stays; what is in no class stays."""
    low = F.lower(char)
    out = None
    for letters in CLASSES:
        new = F.substr(F.lit(letters), number % len(letters) + 1, F.lit(1))
        out = F.when(F.lit(letters).contains(low), new) if out is None else out.when(F.lit(letters).contains(low), new)
    return F.when(low != char, F.upper(out.otherwise(low))).otherwise(out.otherwise(char))


def luhn_sum(digits: Column) -> Column:
    """Sum over digits from the right, every second one doubled; ``digits`` without the check digit."""
    back = F.reverse(digits)
    each = F.transform(back, lambda d, i: F.when(i % 2 == 0, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d)


def surrogate_word(kind: Column, word: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a canonical word: the same class at every place.

    Kept: country codes of phones and IBANs, issuer digit and check rule of cards, top-level domains; a mail domain is
    replaced by itself alone, so addresses of one domain share one. First names end as their gender suggests.
    """
    own = F.struct(kind.alias("kind"), word.alias("word"), keyed_bytes(key, kind, word, attempt.cast("string")).alias("own"), characters(word).alias("chars"))
    return let(own, lambda w: surrogate_of(w["kind"], w["word"], w["own"], w["chars"], key))


def surrogate_of(kind: Column, word: Column, own: Column, chars: Column, key: str) -> Column:
    n = F.size(chars)
    plain = lambda keep: F.array_join(F.transform(chars, lambda c, i: F.when(i < keep, c).otherwise(swapped(c, at(own, i)))), "")

    def email():
        bounds = F.struct(F.locate("@", word).alias("mark"), (n - F.locate(".", F.reverse(word)) + 1).alias("top"), keyed_bytes(key, F.lit("domain"), F.substring_index(word, "@", -1)).alias("domain"))
        pick = lambda b, i: F.when(i + 1 > b["mark"], at(b["domain"], i - b["mark"])).otherwise(at(own, i))
        return let(bounds, lambda b: F.array_join(F.transform(chars, lambda c, i: F.when(i + 1 > b["top"], c).otherwise(swapped(c, pick(b, i)))), ""))

    def card():
        digits = lambda w: F.transform(F.slice(characters(w), F.lit(1), n - 1), lambda c: c.try_cast("int"))
        valid = (luhn_sum(digits(word)) + F.element_at(chars, -1).try_cast("int")) % 10 == 0
        check = lambda w: F.concat(F.substr(w, F.lit(1), n - 1), F.pmod(F.lit(10) - luhn_sum(digits(w)) % 10, F.lit(10)).cast("string"))
        return let(plain(F.lit(1)), lambda w: F.when(valid, check(w)).otherwise(w))

    def iban():
        valid = rest_of_97(F.concat(F.substr(word, F.lit(5)), F.substr(word, F.lit(1), F.lit(4)))) == 1
        body = lambda w: F.concat(F.substr(w, F.lit(5)), F.substr(w, F.lit(1), F.lit(2)))
        check = lambda w: F.lpad((F.lit(98) - rest_of_97(F.concat(body(w), F.lit("00")))).cast("string"), 2, "0")
        return let(plain(F.lit(4)), lambda w: F.when(valid, F.concat(F.substr(w, F.lit(1), F.lit(2)), check(w), F.substr(w, F.lit(5)))).otherwise(w))

    latin = word.rlike("[a-z]$")
    ending = F.when(kind == "first_f", F.when(latin, "a").otherwise("а")).otherwise(F.when(latin, F.substr(F.lit("nrslk"), at(own, F.lit(63)) % 5 + 1, F.lit(1))).otherwise("н"))
    keep = F.when(kind == "phone", F.greatest(F.lit(0), F.least(n - 10, F.lit(3)))).when(kind == "ssn", 1).otherwise(0)
    return F.when(kind == "ip", address(word, own)).when(kind == "email", email()).when(kind == "card", card()).when(kind == "iban", iban()) \
        .otherwise(let(plain(keep), lambda w: F.when(kind.startswith("first"), F.concat(F.substr(w, F.lit(1), n - 1), ending)).otherwise(w)))


def rest_of_97(code: Column) -> Column:
    """The number that a code spells, letters being 10 to 35, modulo 97."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.try_cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(characters(code), F.lit(0), lambda rest, c: F.when(c.rlike("[0-9]"), rest * 10 + value(c)).otherwise(rest * 100 + value(c)) % 97)


def address(word: Column, own: Column) -> Column:
    """A private or loopback address gives another of the same range, a public one a public one."""
    octet = lambda i: (at(own, F.lit(i)) % 254 + 1).cast("string")
    last = F.concat_ws(".", octet(2), octet(3))
    middle = (at(own, F.lit(1)) % 16 + 16).cast("string")
    return F.when(word.rlike(r"^(10|127)\."), F.concat_ws(".", F.substring_index(word, ".", 1), octet(1), last)) \
        .when(word.startswith("192.168."), F.concat_ws(".", F.lit("192.168"), last)) \
        .when(word.rlike(r"^172\.(1[6-9]|2[0-9]|3[01])\."), F.concat_ws(".", F.lit("172"), middle, last)) \
        .otherwise(F.concat_ws(".", (at(own, F.lit(0)) % 89 + 11).cast("string"), octet(1), last))


def in_case(model: Column, word: Column) -> Column:
    """``word`` with upper case where ``model`` of the same length has it."""
    return F.array_join(F.zip_with(characters(model), characters(word), lambda m, c: F.when(m != F.lower(m), F.upper(c)).otherwise(c)), "")


def styled(entity: Column, word: Column) -> Column:
    """A surrogate code or address in the shape of the entity: its separators and its upper case."""
    kind = kind_of(entity)
    chars = characters(entity)
    alike = F.length(word) == F.length(entity)
    cased = in_case(entity, word)
    before = lambda i: F.length(F.regexp_replace(F.substr(entity, F.lit(1), i + 1), "[^A-Za-z0-9]", ""))
    spaced = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[A-Za-z0-9]"), F.substr(word, before(i), F.lit(1))).otherwise(c)), "")
    same = F.length(F.regexp_replace(entity, "[^A-Za-z0-9]", "")) == F.length(word)
    return F.when(kind == "email", F.when(alike, cased).otherwise(word)).when(kind == "ip", word).otherwise(F.when(same, spaced).otherwise(word))


def replaced(entity: Column, key: str, known: Column | None) -> Column:
    """What stands for an entity; ``known``: map from "kind|word" to surrogates that differ from the first choice."""

    def one(w):
        first = surrogate_word(w["kind"], w["word"], F.lit(0), key)
        return first if known is None else F.coalesce(F.try_element_at(known, F.concat_ws("|", w["kind"], w["word"])), first)

    before = F.regexp_extract(entity, f"({BEFORE_NAME})", 1)
    own = F.split(F.regexp_replace(entity, BEFORE_NAME, ""), " ")
    word = lambda new, old: F.when(F.length(new) == F.length(old), in_case(old, new)).otherwise(F.initcap(new))
    shaped = lambda w: F.when(kind_of(entity) == "name", F.concat(before, F.array_join(F.zip_with(w, own, word), " "))).otherwise(styled(entity, F.element_at(w, 1)))
    return let(F.transform(words_of(entity), one), shaped)


def surrogate_overrides(documents: DataFrame, key: str, rounds: int = ROUNDS) -> DataFrame:
    """kind, word, surrogate of the entities whose first surrogate would be another entity or another one's surrogate.

    Every round gives the entities that are still without one their next surrogate; the least word keeps a contested one.
    """
    every = documents.select(F.explode(F.flatten(F.transform(entities(F.col("text")), words_of))).alias("w")).select("w.kind", "w.word").distinct()
    every = stored(every)
    open_, given = every, None
    for attempt in range(rounds + 1):
        if attempt < rounds:
            tried = open_.withColumn("surrogate", surrogate_word(F.col("kind"), F.col("word"), F.lit(attempt), key))
        else:  # the shape has no room left: unique names instead
            tried = open_.withColumn("surrogate", F.concat(F.upper("kind"), F.substring(keyed_bytes(key, F.col("kind"), F.col("word")), 1, 24)))
        tried = stored(tried)
        taken = every.select("kind", F.col("word").alias("surrogate"))
        if given is not None:
            taken = taken.unionByName(given.select("kind", "surrogate"))
        free = tried.join(taken, ["kind", "surrogate"], "left_anti")
        least = free.groupBy("kind", "surrogate").agg(F.min("word").alias("word"))
        done = least.select("kind", "word", "surrogate", F.lit(attempt).alias("attempt"))
        given = stored(done if given is None else given.unionByName(done))
        open_ = stored(every.join(given, ["kind", "word"], "left_anti"))
        if not open_.limit(1).count():
            break
    return given.filter("attempt > 0").select("kind", "word", "surrogate")


def with_surrogates(documents: DataFrame, key: str = "surrogates") -> DataFrame:
    """Every document with its personal data replaced; adds n_pii and pii_kinds (sorted) to its columns.

    Equal entities get equal surrogates everywhere, whatever their separators or case, and different ones different ones:
    surrogates are checked against each other and against all entities of the table. ``key`` is the secret of the keyed
    hash. A null text stays null with no entities; texts without entities stay as they are. Repeated rows are answered
    alike; a column with one of the added names is replaced.
    """
    documents = documents.drop("n_pii", "pii_kinds")
    text = F.col("text")
    overrides = stored(surrogate_overrides(documents, key))
    known, columns = None, documents.columns
    if overrides.limit(1).count():  # texts that hold such an entity learn its surrogate by a hash of the text
        found = documents.select(F.sha2(text, 256).alias("_text_hash"), F.explode(F.array_distinct(F.flatten(F.transform(entities(text), words_of)))).alias("w")).distinct()
        found = found.join(overrides, (F.col("w.kind") == overrides.kind) & (F.col("w.word") == overrides.word))
        maps = found.groupBy("_text_hash").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "word"), "surrogate"))).alias("_known"))
        documents = documents.withColumn("_own_hash", F.sha2(text, 256)).join(maps, F.col("_own_hash") == F.col("_text_hash"), "left")
        known = F.col("_known")
    found = entities(text)
    pieces = F.split(text, ANY, -1)
    new = F.array_join(F.zip_with(pieces, found, lambda p, e: F.concat(p, F.when(e.isNotNull(), replaced(e, key, known)).otherwise(""))), "")
    named = documents.withColumn("_found", found)
    out = [F.when(F.size("_found") > 0, new).otherwise(text).alias("text") if c == "text" else F.col(f"`{c}`") for c in columns]
    return named.select(
        *out, F.greatest(F.size("_found"), F.lit(0)).cast("long").alias("n_pii"),
        F.coalesce(F.array_sort(F.array_distinct(F.transform("_found", kind_of))), F.array().cast("array<string>")).alias("pii_kinds"),
    )


def surrogates(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, text with surrogates, n_pii, pii_kinds; nulls and repeated rows as in ``with_surrogates``,
    no rows for an empty table."""
    return with_surrogates(documents.select("doc_id", "text"))
