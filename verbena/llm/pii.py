"""Surrogates for personal data (native).

Found are mail addresses, phone numbers, card numbers, account numbers (IBAN), identity numbers of 3, 2 and 4
digits, IPv4 addresses, names after a title and, in the same text, the parts of such a name wherever they
stand. An entity is its kind and its normal form (digits alone for numbers, lower case for addresses), so
different spellings of one number stay one entity, and the parts of a name are entities of their
own: ``Mr Ivo Renn`` and ``Mr Renn`` keep the same family name.

Each distinct entity gets one surrogate from an HMAC-SHA-256: digits for digits, letters for letters of
the same script and case, octets for octets, and a name of the same gender and script. A card number that
passes the Luhn check gets one that passes it too; an account number keeps its country and gets check
digits that are right if its own are. The key comes from the caller or the session setting
``verbena.pii.key``; there is none by default, as whoever knows it can rebuild the surrogates. Surrogates
are checked over the whole table: if two entities share one, or one equals a real entity, all but
the smallest entity draw again until none clash, so distinct entities stay distinct; names and mail
addresses grow with each draw, so there are always places left. A mention
then gets its entity's surrogate in the mention's own format.

The parts that are joined are entities and mentions; texts without a mention are not moved.

Defined cases. A null text stays null and has no entity; an empty one is unchanged. Mentions depend
on the text alone, so null or repeated ids and repeated rows need no care, and equal texts are
worked on once. Of overlapping mentions the leftmost counts, then the first kind in the list. Without a
key there is an error. An empty table gives no rows. Further columns are kept; ``entities`` gets a spare name if it is taken.
"""

from __future__ import annotations

import hashlib
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verbena.llm.support import let, spare, text_of
from verbena.session import written

KEY_SETTING = "verbena.pii.key"
STUCK = 40  # rounds in a row that settle nothing: a format has no free place left

# Titles by gender; the name after one is given name and family name, or family name alone.
TITLES = {
    "male": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος"],
    "female": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία"],
    "any": ["Dr", "Prof"],
}
UPPER, LOWER = "A-ZÀ-ÖØ-ÞА-ЯΑ-Ω", "a-zß-öø-ÿа-яά-ώ"
NAME = f"[{UPPER}][{LOWER}]+(?:-[{UPPER}][{LOWER}]+)?"
ALL_TITLES = "|".join(t for own in TITLES.values() for t in own)
# Phone numbers: 3, 3 and 4 digits; + or 00 and 8 to 15 digits; a leading 0 and 9 to 11 digits, no date.
BETWEEN = r"(?:[ .-]?\(|\)[ .-]?|[ .-])?"
AREA = r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"
ABROAD = rf"(?:\+|00[ .-]?)[1-9](?:{BETWEEN}[0-9]){{7,14}}"
DATE = r"[0-9]{2}[ .-][0-9]{2}[ .-][12][0-9]{3}(?![0-9])"
AT_HOME = rf"(?<![0-9][.,-])(?!{DATE})\(?0[1-9](?:{BETWEEN}[0-9]){{7,9}}"
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
# Country codes of one and two digits; the others have three.
COUNTRY = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}"
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ip": rf"(?<![0-9.])(?<!\b[Vv])(?<!\b[Vv] )(?<!\b[Vv]ersion )(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])",
    "iban": r"(?<![0-9A-Za-z])(?=[A-Z]{2}[0-9]{2}(?:[A-Z ]*[0-9]){6})[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![0-9A-Za-z])",
    "identity": r"(?<![0-9A-Za-z+.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "phone": f"(?<![0-9A-Za-z+])(?:{AREA}|{ABROAD}|{AT_HOME})(?![0-9A-Za-z])",
    "name": f"(?<![{UPPER}{LOWER}])(?:{ALL_TITLES})\\.? {NAME}(?: {NAME})?",
}
KINDS = [*PATTERNS]
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
# What a text must hold for a mention: cheap to look for.
INITIALS = "".join(sorted({t[0] for own in TITLES.values() for t in own}))
HINT = f"@|[0-9](?:[0-9]{{2}}|\\.[0-9])|\\+[1-9]|0[0-9][ .-]?[(0-9]|(?=[{INITIALS}])(?:{ALL_TITLES})\\.? [{UPPER}]"

# Scripts: first letter and number of letters of small and capital alphabets.
SCRIPTS = [
    ("[a-z]", 97, 26),
    ("[A-Z]", 65, 26),
    ("[0-9]", 48, 10),
    ("[а-я]", 0x430, 32),
    ("[А-Я]", 0x410, 32),
    ("[ß-öø-ÿ]", 97, 26),
    ("[À-ÖØ-Þ]", 65, 26),
    ("[ά-ώ]", 0x3B1, 17),
    ("[Α-Ω]", 0x391, 17),
]
# Syllables and endings of names by script.
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe ga ge ka ke ki ko la le li lo ma me mi mo na ne ni no "
    "pa pe ra re ri ro sa se si so ta te ti to va ve vi vo za ze zi zo",
    "cyrillic": "ба бе би бо ва ве ви во га ге да де ди до ка ке ки ко ла ле ли ло ма ме ми мо на "
    "не ни но па пе ра ре ри ро са се си со та те ти то",
    "greek": "βα βε βι βο γα γε δα δε δι δο κα κε κι κο λα λε λι λο μα με μι μο να νε νι νο πα πε "
    "ρα ρε ρι ρο σα σε σι σο τα τε τι το",
}
ENDINGS = {
    "latin": {"male": "n", "female": "ra", "any": "l", "family": "rd"},
    "cyrillic": {"male": "н", "female": "ра", "any": "ль", "family": "рк"},
    "greek": {"male": "νος", "female": "ρα", "any": "λι", "family": "ρης"},
}
ENTITY = "struct<kind:string,form:string>"


def key_of(spark: SparkSession, key: str | None) -> str:
    """The secret key: ``key``, or else the session's setting."""
    key = key or spark.conf.get(KEY_SETTING, None)
    if not key:
        raise ValueError(f"surrogates need a key: pass one or set {KEY_SETTING}")
    return key


def hmac(key: str, message: Column) -> Column:
    """HMAC-SHA-256 of a string as hexadecimal digits."""
    secret = key.encode()
    secret = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(x ^ pad for x in secret)) for pad in (0x36, 0x5C))
    hashed = F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(outer, F.unhex(hashed)), 256)


def draw(key: str, seed: Column, place, size) -> Column:
    """A number below ``size`` from the keyed hash of the seed and a place."""
    message = F.concat_ws("|", seed, F.lit(place) if isinstance(place, int) else place)
    number = F.conv(F.substring(hmac(key, message), 1, 12), 16, 10).cast("long")
    return F.pmod(number, size if isinstance(size, Column) else F.lit(size))


def luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, modulo 10: 0 if its last digit is the right one."""
    chars = F.reverse(F.split(digits, ""))
    ints = F.transform(chars, lambda c: c.cast("int"))
    doubled = F.transform(ints, lambda d, i: F.when(i % 2 == 0, d).otherwise(F.pmod(d * 2, F.lit(10)) + F.when(d > 4, 1).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda n, d: n + d) % 10


def mod97(form: Column) -> Column:
    """An account number modulo 97, its first four characters last: 1 if its check digits are right."""
    turned = F.concat(F.substring(form, 5, 99), F.substring(form, 1, 4))

    def step(n: Column, c: Column) -> Column:
        value = F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return (n * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(F.split(turned, ""), F.lit(0), step)


def card_like(form: Column, drawn: Column) -> Column:
    """``drawn`` with the last digit that passes the Luhn check, if ``form`` passes it."""
    stem = F.substring(drawn, F.lit(1), F.length(drawn) - 1)
    last = F.pmod(F.lit(10) - luhn(F.concat(stem, F.lit("0"))), F.lit(10)).cast("string")
    return F.when(luhn(form) == 0, F.concat(stem, last)).otherwise(drawn)


def account_like(form: Column, drawn: Column) -> Column:
    """``drawn`` (what follows the first four characters) as an account number of the country of ``form``.

    Its check digits are right if those of ``form`` are; wrong ones stay as they are.
    """
    country = F.substring(form, 1, 2)
    right = F.lpad((98 - mod97(F.concat(country, F.lit("00"), drawn))).cast("string"), 2, "0")
    check = F.when(mod97(form) == 1, right).otherwise(F.substring(form, 3, 2))
    return F.concat(country, check, drawn)


def shaped(key: str, form: Column, seed: Column) -> Column:
    """Another string of the same scripts and cases; what is no letter or digit stays."""

    def other(c: Column, i: Column) -> Column:
        out = None
        for pattern, first, size in SCRIPTS:
            code = draw(key, seed, i, size) + first
            # Spark's chr ends at 255; other letters are picked from their alphabet.
            letters = "".join(chr(first + k) for k in range(size))
            letter = F.substring(F.lit(letters), (code - first + 1).cast("int"), F.lit(1))
            out = (F.when if out is None else out.when)(c.rlike(pattern), letter)
        return out.otherwise(c)

    return F.array_join(F.transform(F.split(form, ""), other), "")


def named(key: str, kind: Column, form: Column, seed: Column, draws: Column) -> Column:
    """A name of the kind's gender in the script of the original, a syllable longer at each draw."""

    def made(script: str) -> Column:
        syllables = F.split(F.lit(SYLLABLES[script]), " ")
        parts = F.transform(
            F.sequence(F.lit(0), draws + 2),
            lambda k: F.get(syllables, draw(key, seed, k, F.size(syllables)).cast("int")),
        )
        ending = F.element_at(
            F.create_map(*[F.lit(x) for kv in ENDINGS[script].items() for x in kv]),
            F.substring_index(kind, "_", -1),
        )
        return F.initcap(F.concat(F.array_join(parts, ""), ending))

    return (
        F.when(form.rlike("[А-Яа-я]"), made("cyrillic"))
        .when(form.rlike("[Α-Ωά-ώ]"), made("greek"))
        .otherwise(made("latin"))
    )


def surrogate(key: str, kind: Column, form: Column, draws: Column) -> Column:
    """The surrogate form of an entity at its n-th draw."""
    seed = F.concat_ws("|", kind, form, draws)
    host = F.substring_index(form, "@", -1)
    # A host keeps its last label; equal hosts get equal surrogates.
    host_seed = F.concat_ws("|", F.lit("host"), host)
    label = F.concat(F.lit("."), F.substring_index(host, ".", -1))
    stem = F.substring(host, F.lit(1), F.length(host) - F.length(label))
    # Each further draw makes the part before the host longer, by what it ends with.
    local = F.substring_index(form, "@", 1)
    more = F.when(local.rlike("[0-9]$"), F.lit("0")).otherwise(F.lit("a"))
    local = F.concat(local, F.repeat(more, draws))
    mail = F.concat(shaped(key, local, seed), F.lit("@"), shaped(key, stem, host_seed), label)
    octets = F.transform(F.split(form, r"\."), lambda _, i: (draw(key, seed, i, 254) + 1).cast("string"))
    # The first digit of a card tells its kind, the last ten digits of a phone number the line.
    card = card_like(form, F.concat(F.substring(form, 1, 1), shaped(key, F.substring(form, 2, 99), seed)))
    account = account_like(form, shaped(key, F.substring(form, 5, 99), seed))
    return (
        F.when(kind == "email", mail)
        .when(kind == "ip", F.array_join(octets, "."))
        .when(kind == "card", card)
        .when(kind == "iban", account)
        .when(kind.isin("phone", "identity"), shaped(key, form, seed))
        .otherwise(named(key, kind, form, seed, draws))
    )


def kind_of(mention: Column) -> Column:
    """The kind of a mention; a name without its title is none of the patterns."""
    kinds = None
    for kind in KINDS:
        whole = mention.rlike(f"^(?:{PATTERNS[kind]})$")
        kinds = (F.when if kinds is None else kinds.when)(whole, F.lit(kind))
    return kinds.otherwise(F.lit("name"))


def line_of(mention: Column, digits: Column) -> Column:
    """The digits of a phone number without what depends on where it is called from."""
    home = F.regexp_replace(digits, "^0", "")
    abroad = F.regexp_replace(digits, f"^(?:00)?(?:{COUNTRY})0?", "")
    return (
        F.when(mention.rlike(f"^(?:{AREA})$"), F.substring(digits, -10, 10))
        .when(mention.rlike(r"^(?:\+|00)"), abroad)
        .otherwise(home)
    )


def parts_of(mention: Column) -> Column:
    """The entities of a name after a title: given name and family name, or family name alone."""
    words = F.split(mention, " ")
    title = F.regexp_replace(F.get(words, 0), r"\.", "")
    gender = None
    for g, titles in TITLES.items():
        gender = (F.when if gender is None else gender.when)(title.isin(titles), F.lit(f"given_{g}"))
    family = F.struct(
        F.lit("name_family").alias("kind"), F.element_at(words, -1).alias("form")
    )
    given = F.struct(gender.alias("kind"), F.get(words, 1).alias("form"))
    name = F.when(F.size(words) == 3, F.array(given, family)).otherwise(F.array(family))
    return name.cast(f"array<{ENTITY}>")


def revealed_by(found: Column) -> Column:
    """The entities of the names that stand after a title, each form once."""
    titled = F.filter(found, lambda m: m.rlike(f"^(?:{PATTERNS['name']})$"))
    parts = F.array_sort(F.flatten(F.transform(titled, parts_of)))
    forms = F.array_distinct(F.transform(parts, lambda p: p["form"]))
    return F.transform(forms, lambda form: F.get(F.filter(parts, lambda p: p["form"] == form), F.lit(0)))


def any_of(revealed: Column) -> Column:
    """The pattern of all mentions in a text with the names that its titles reveal."""
    words = F.array_join(F.transform(revealed, lambda p: p["form"]), "|")
    more = F.concat(F.lit(f"{ANY}|(?<![{UPPER}{LOWER}-])(?:"), words, F.lit(f")(?![{UPPER}{LOWER}-])"))
    return F.when(F.size(revealed) > 0, more).otherwise(F.lit(ANY))


def entities_of(mention: Column, revealed: Column) -> Column:
    """The entities of a mention, in its order: one, or the parts of a name."""
    digits = F.regexp_replace(mention, "[^0-9]", "")
    known = F.filter(revealed, lambda p: p["form"] == mention)
    name = F.when(F.instr(mention, " ") > 0, parts_of(mention)).otherwise(known)
    form = (
        F.when(F.col("kind") == "email", F.lower(mention))
        .when(F.col("kind") == "phone", line_of(mention, digits))
        .when(F.col("kind").isin("card", "identity"), digits)
        .when(F.col("kind") == "iban", F.replace(mention, F.lit(" "), F.lit("")))
        .otherwise(mention)
    )
    one = F.array(F.struct(F.col("kind"), form.alias("form")))
    return F.when(F.col("kind") == "name", name).otherwise(one.cast(f"array<{ENTITY}>"))


def laid(mention: Column, kind: Column, forms: Column) -> Column:
    """Surrogate forms in the format of a mention."""
    form = F.get(forms, 0)
    chars = F.split(mention, "")
    n_digits = F.length(F.regexp_replace(mention, "[^0-9]", ""))
    # Numbers: the surrogate's digits fill the last places; a country code before them stays.
    start = F.struct(
        (F.length(form) - n_digits).alias("at"), F.lit("").alias("out")
    )

    def step(a: Column, c: Column) -> Column:
        digit = c.rlike("[0-9]")
        own = F.when(digit & (a["at"] >= 0), F.substring(form, a["at"] + 1, F.lit(1))).otherwise(c)
        at = a["at"] + F.when(digit, 1).otherwise(0)
        return F.struct(at.alias("at"), F.concat(a["out"], own).alias("out"))

    number = F.aggregate(chars, start, step, lambda a: a["out"])
    # Account numbers: the surrogate's characters in order, blanks stay.
    whole = F.aggregate(
        chars,
        F.struct(F.lit(1).alias("at"), F.lit("").alias("out")),
        lambda a, c: F.struct(
            (a["at"] + F.when(c == " ", 0).otherwise(1)).alias("at"),
            F.concat(a["out"], F.when(c == " ", c).otherwise(F.substring(form, a["at"], F.lit(1)))).alias("out"),
        ),
        lambda a: a["out"],
    )
    mail = F.when(mention == F.upper(mention), F.upper(form)).otherwise(form)
    title = F.when(F.instr(mention, " ") > 0, F.substring_index(mention, " ", 1))
    name = F.concat_ws(" ", title, F.array_join(forms, " "))
    return (
        F.when(kind == "email", mail)
        .when(kind == "ip", form)
        .when(kind == "iban", whole)
        .when(kind == "name", name)
        .otherwise(number)
    )


def assign(entities: DataFrame, key: str | None = None) -> DataFrame:
    """``kind, form, surrogate`` of distinct entities; surrogates of a kind are distinct.

    Clashing entities draw again; those that are settled are looked at as taken. Names and mail
    addresses get more places at each draw, so they always settle.
    """
    key = key_of(entities.sparkSession, key)
    originals = written(entities.select("kind", "form").distinct(), "entities")
    done = None
    open_ = originals
    stuck = 0
    for draws in count():
        drawn = open_.withColumn("surrogate", surrogate(key, F.col("kind"), F.col("form"), F.lit(draws)))
        taken = originals.select("kind", F.col("form").alias("surrogate"))
        if done is not None:
            taken = taken.unionByName(done.select("kind", "surrogate"))
        free = drawn.join(taken, ["kind", "surrogate"], "left_anti")
        # The smallest of the entities that drew the same keeps it.
        won = written(
            free.groupBy("kind", "surrogate").agg(F.min("form").alias("form")), "surrogates"
        )
        done = won if done is None else written(done.unionByName(won), "surrogates")
        open_ = written(open_.join(won, ["kind", "form"], "left_anti"), "clashes")
        if open_.isEmpty():
            return done.select("kind", "form", "surrogate")
        stuck = stuck + 1 if won.isEmpty() else 0
        if stuck == STUCK:
            kinds = [r["kind"] for r in open_.select("kind").distinct().collect()]
            raise RuntimeError(f"no free surrogates left: {', '.join(sorted(kinds))}")


def replace_entities(
    docs: DataFrame, text: str = "text", out: str = "entities", key: str | None = None
) -> DataFrame:
    """``docs`` with surrogates in the text, and the replaced mentions as an array of structs
    (kind, start, end): places in the original text, in code points."""
    out = spare(docs, out)
    value = text_of(text)
    likely = F.coalesce(F.col(text).rlike(HINT), F.lit(False))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    plain = docs.filter(~likely).withColumn(out, none)
    marked, found = spare(docs, "text_key"), "found"
    rows = docs.filter(likely).withColumn(marked, F.md5(value))
    texts = rows.select(F.col(marked).alias("text_key"), value.alias("text")).dropDuplicates(
        ["text_key"]
    )
    first = texts.select(
        "*", F.regexp_extract_all("text", F.lit(ANY), F.lit(0)).alias(found)
    ).filter(F.size(found) > 0)
    first = first.withColumn("revealed", revealed_by(F.col(found)))
    # Texts whose titles reveal names are read again, for the names without a title.
    every = any_of(F.col("revealed"))
    again = F.when(
        F.size("revealed") > 0, F.regexp_extract_all("text", every, F.lit(0))
    ).otherwise(F.col(found))
    cut = first.select(
        "text_key",
        "revealed",
        again.alias(found),
        F.split("text", every, -1).alias("between"),
    )
    cut = written(cut, "mentions")
    mentions = (
        cut.select("text_key", "revealed", F.posexplode(found).alias("n", "mention"))
        .withColumn("kind", kind_of(F.col("mention")))
        .withColumn("entities", entities_of(F.col("mention"), F.col("revealed")))
    )
    parts = mentions.select("text_key", "n", F.posexplode("entities").alias("part", "entity"))
    parts = parts.select("text_key", "n", "part", "entity.kind", "entity.form")
    surrogates = assign(parts, key)
    filled = parts.join(surrogates, ["kind", "form"])
    by_text = filled.groupBy("text_key").agg(
        F.array_sort(F.collect_list(F.struct("n", "part", "surrogate"))).alias("forms")
    )
    rebuilt = cut.join(by_text, "text_key").select(
        "text_key", rebuild(F.col(found), F.col("between"), F.col("forms")).alias("new")
    )
    rebuilt = rebuilt.select(F.col("text_key").alias(marked), F.col("new"))
    new = spare(rows, "new")
    joined = rows.join(rebuilt.withColumnRenamed("new", new), marked, "left")
    replaced = joined.withColumn(
        text, F.coalesce(F.col(new)["text"], F.col(text))
    ).withColumn(out, F.coalesce(F.col(new)["entities"], none))
    columns = [F.col(f"`{c}`") for c in [*docs.columns, out]]
    return plain.select(*columns).unionByName(replaced.select(*columns))


def rebuild(found: Column, between: Column, forms: Column) -> Column:
    """The new text and the places of the mentions, from the pieces of the old one.

    ``forms`` is sorted by mention and part; it is walked along with the mentions.
    """
    start = F.struct(
        F.lit(0).alias("at"),
        F.lit(0).alias("used"),
        F.array().cast("array<string>").alias("pieces"),
        F.array().cast("array<struct<kind:string,start:int,end:int>>").alias("entities"),
    )

    def step(a: Column, i: Column) -> Column:
        mention, gap = F.get(found, i), F.get(between, i)
        kind = kind_of(mention)
        parts = F.greatest(F.lit(1), F.size(F.split(mention, " ")) - 1)
        n = F.when(kind == "name", parts).otherwise(1)
        own = F.transform(F.slice(forms, a["used"] + 1, n), lambda x: x["surrogate"])
        begin = a["at"] + F.length(gap)
        end = begin + F.length(mention)
        span = F.struct(kind.alias("kind"), begin.alias("start"), end.alias("end"))
        return F.struct(
            end.alias("at"),
            (a["used"] + n).alias("used"),
            F.concat(a["pieces"], F.array(gap, laid(mention, kind, own))).alias("pieces"),
            F.concat(a["entities"], F.array(span)).alias("entities"),
        )

    walked = F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), start, step)
    return let(
        walked,
        lambda w: F.struct(
            F.concat(F.array_join(w["pieces"], ""), F.element_at(between, -1)).alias("text"),
            w["entities"].alias("entities"),
        ),
    )


def anonymised(docs: DataFrame, text: str = "text", key: str | None = None) -> DataFrame:
    """Documents with surrogates, in the columns they came with."""
    done = replace_entities(docs, text, key=key)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        done = done.withColumn("n_chars", F.coalesce(F.length(text).cast(kind), F.col("n_chars")))
    return done.select(*[F.col(f"`{c}`") for c in docs.columns])
