"""Surrogates for personal data (native DataFrame code).

Detected entities get keyed replacements of the same type: the digits of a
telephone or card number change and its punctuation stays, a card keeps its
issuer digit and a right check digit, an IBAN its country and a right
checksum, a name its script, its letter case and the gender its title shows.
The same entity gets the same surrogate wherever it occurs (also a surname
after "Mr" and after "Mrs"); distinct entities get distinct ones, and none
equals an entity that really occurs: colliding surrogates are drawn again
until no collision is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, ready, sha256_text, text_or_empty

# --- fixed values: titles by the gender they show -------------------------------------
MALE = "Mr|Mister|Herr|Monsieur|Señor|Sr|Господин|Κύριος"
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Señorita|Sra|Госпожа|Κυρία"
NEUTRAL = "Dr|Prof|Doctor|Doktor|Docteur|Professor|Доктор|Профессор"
# Small words inside a name; they are not replaced.
PARTICLE = "de|del|della|der|den|di|du|da|dos|la|le|van|von|zu|zur|zum|ten|ter|el|al|bin|y"
# --- end of fixed values ----------------------------------------------------------------

# Every pattern starts at a boundary and has bounded repeats (or possessive
# ones), so that long texts without white space stay linear.
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]{1,63}\.){1,8}\p{L}{2,24}"
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IP = rf"(?<![\p{{L}}\p{{N}}.])(?:{OCTET}\.){{3}}{OCTET}(?![\p{{L}}\p{{N}}]|\.[0-9])"
SSN = r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}-])"
PHONE = (
    r"(?<![\p{L}\p{N}+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\p{L}\p{N}])"
    r"|(?<![\p{L}\p{N}+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![\p{L}\p{N}])"
)
CARD = r"(?<![\p{L}\p{N}+])[0-9](?:[ -]?[0-9]){12,18}(?![\p{L}\p{N}])"
MALE, FEMALE, NEUTRAL = (f"{x}|{x.upper()}" for x in (MALE, FEMALE, NEUTRAL))
TITLE = f"{MALE}|{FEMALE}|{NEUTRAL}"
# A word of a name; quotation marks and a possessive 's after it are not part of it.
WORD = rf"(?!(?:{TITLE})(?!\p{{L}}))\p{{Lu}}(?:\p{{L}}|-(?=\p{{L}})|['’](?=\p{{L}})(?![sS](?!\p{{L}}))){{1,40}}"
NAME = rf"(?<![\p{{L}}\p{{N}}])(?:{TITLE})\.? {WORD}(?: (?:(?:{PARTICLE}) ){{0,2}}{WORD}){{0,2}}"
# A word that may be a later mention of a name.
PLAIN = rf"(?<![\p{{L}}\p{{N}}]){WORD}(?!\p{{L}})"
ANY = "|".join((EMAIL, IBAN, IP, SSN, PHONE, CARD, NAME))

KEY = "ledgerline"
NAMES = ("given", "given_m", "given_f", "surname")
KINDS = ("email", "iban", "ip", "ssn", "phone", "card", "name")
#: Draws of a surrogate before the job gives up.
DRAWS = 64
#: From this draw on surrogates grow longer, a character or an address part a
#: draw, because most of those in the entity's own format are taken.
LONGER = 8


# --- small string helpers ---------------------------------------------------------------


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _chars(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def _luhn(number: Column) -> Column:
    """Luhn sum modulo 10 of a digit string."""
    each = F.transform(
        F.reverse(_chars(number)),
        lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10


def _fill(raw: Column, pattern: str, new: Column) -> Column:
    """``raw`` with its characters of ``pattern`` replaced, in order, by the
    characters of ``new`` (as many)."""
    return F.array_join(F.zip_with(F.split(raw, pattern, -1), _chars(new), lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")


def _script(c: Column) -> Column:
    return F.when(c.rlike(r"\p{IsCyrillic}"), "cyrillic").when(c.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


# --- detection --------------------------------------------------------------------------


def _kind(m: Column) -> Column:
    """Type of a whole match; a number that fails the card check is none."""
    whole = lambda p: m.rlike(f"^(?:{p})$")
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike(rf"^(?:{TITLE})\.? "), "name")
        .when(m.rlike("^[A-Z]"), "iban")
        .when(whole(IP), "ip")
        .when(whole(SSN), "ssn")
        .when(m.startswith("+") | whole(PHONE), "phone")
        .when((F.length(_digits(m)) >= 13) & (_luhn(_digits(m)) == 0), "card")
        .otherwise("none")
    )


def _units(m: Column, kind: Column) -> Column:
    """The parts of a match that are replaced separately: (kind, raw, norm).
    A name has its title, given names and the surname, and particles, which
    like the title stay; others are one part."""
    words = F.split(m, " ")
    gender = F.when(m.rlike(rf"^(?:{MALE})\.? "), "given_m").when(m.rlike(rf"^(?:{FEMALE})\.? "), "given_f").otherwise("given")
    last = F.size(words) - 1
    of_name = F.transform(
        words,
        lambda w, i: F.struct(
            F.when((i == 0) | w.rlike(f"^(?:{PARTICLE})$"), "title").when(i == last, "surname").otherwise(gender).alias("kind"), w.alias("raw"), F.lower(w).alias("norm")
        ),
    )
    norm = (
        F.when(kind == "email", F.lower(m))
        .when(kind == "iban", F.replace(m, F.lit(" "), F.lit("")))
        .when(kind == "ip", m)
        .when(kind == "phone", F.substring(_digits(m), -10, 10))
        .otherwise(_digits(m))
    )
    return F.when(kind == "name", of_name).otherwise(F.array(F.struct(kind.alias("kind"), m.alias("raw"), norm.alias("norm"))))


# --- surrogates -------------------------------------------------------------------------


def _draw(key: str) -> Column:
    """The surrogate of (kind, norm) at a draw, in normal form.  From draw
    ``LONGER`` on it is longer than the format asks for: a number or account
    by 1, 2, 3, ... digits, a name by as many letters, an e-mail by as many
    digits before the @; an IP becomes one of the IPv6 range for documentation."""
    hexes = F.sha2(F.concat_ws("\x1f", F.lit(key), "kind", "norm", F.col("draw").cast("string")), 256)
    digits = F.translate(hexes, "abcdef", "012345")
    n = F.length("norm")
    letters = F.translate(hexes, "0123456789abcdef", "bdfgklmnprstvzhj")
    vowels = F.translate(F.reverse(hexes), "0123456789abcdef", "aeiouaeioaeiouae")
    syllables = lambda k: F.concat(*[F.concat(F.substring(letters, i + 1, 1), F.substring(vowels, i + 1, 1)) for i in range(k)])
    octet = lambda i: F.conv(F.substring(hexes, 2 * i + 1, 2), 16, 10)
    first = octet(0).cast("int") % 223 + 1
    # 223 networks times 2**24 hosts, and further draws move on.
    ip = F.concat_ws(".", first.cast("string"), octet(1), octet(2), octet(3))
    phone = F.concat(F.translate(F.substring(digits, 1, 1), "01", "23"), F.substring(digits, 2, 63))
    phone = F.when(n < 10, digits.substr(F.lit(1), n)).otherwise(F.substring(phone, 1, 10))
    extra = F.greatest(F.col("draw") - F.lit(LONGER - 1), F.lit(0))
    more = digits.substr(F.lit(25), extra)
    body = F.concat(F.substring("norm", 1, 1), digits.substr(F.lit(1), n - 2), more)
    check = (10 - _luhn(F.concat(body, F.lit("0")))) % 10
    country, account = F.substring("norm", 1, 2), F.substring("norm", 5, 40)
    new_account = F.array_join(
        F.transform(
            _chars(account),
            lambda c, i: F.when(c.rlike("[0-9]"), digits.substr(i + 1, F.lit(1))).otherwise(F.upper(letters.substr(i + 1, F.lit(1)))),
        ),
        "",
    )
    new_account = F.concat(new_account, more)
    as_digits = F.array_join(
        F.transform(_chars(F.concat(new_account, country, F.lit("00"))), lambda c: F.when(c.rlike("[0-9]"), c).otherwise((F.ascii(c) - 55).cast("string"))), ""
    )
    rest = F.aggregate(_chars(as_digits), F.lit(0), lambda a, c: (a * 10 + c.cast("int")) % 97)
    iban = F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), new_account)
    local = F.concat(syllables(5), F.when(F.col("norm").rlike("^[^@]*[0-9]"), F.concat(F.lit("."), F.substring(digits, 40, 2))).otherwise(F.lit("")))
    email = F.concat(local, more, F.lit("@mail"), F.substring(digits, 50, 1), F.lit(".example.org"))
    latin = (
        F.when(F.col("kind") == "surname", F.concat(syllables(4), F.lit("r")))
        .when(F.col("kind") == "given_f", F.concat(syllables(3), F.substring(letters, 9, 1), F.lit("a")))
        .when(F.col("kind") == "given", F.concat(syllables(3), F.substring(letters, 9, 1), F.lit("i")))
        .otherwise(F.concat(syllables(3), F.substring(letters, 9, 1), F.lit("on")))
    )
    latin = F.concat(latin, letters.substr(F.lit(25), extra))
    ip = F.when(extra == 0, ip).otherwise(F.concat(F.lit("2001:db8"), *[F.concat(F.lit(":"), F.substring(hexes, 4 * i + 1, 4)) for i in range(6)]))
    script = _script(F.col("norm"))
    name = (
        F.when(script == "cyrillic", F.translate(latin, "bdfgklmnprstvzhjaeiou", "бдфгклмнпрствзхжаеиоу"))
        .when(script == "greek", F.translate(latin, "bdfgklmnprstvzhjaeiou", "βδφγκλμνπρστθζχξαεηου"))
        .otherwise(latin)
    )
    return (
        F.when(F.col("kind") == "email", email)
        .when(F.col("kind") == "iban", iban)
        .when(F.col("kind") == "ip", ip)
        .when(F.col("kind") == "ssn", F.concat(F.lit("9"), F.substring(digits, 1, 8), more))
        .when(F.col("kind") == "phone", F.concat(phone, more))
        .when(F.col("kind") == "card", F.concat(body, check.cast("string")))
        .otherwise(name)
    )


def assign(entities: DataFrame, key: str = KEY) -> DataFrame:
    """``kind, norm, new`` for distinct entities (kind, norm): no two of a
    kind share ``new`` and none equals a ``norm`` of its kind.

    Each round draws for the entities still without one, lets the first (by
    norm) of those that collide keep it, and draws again for the others.
    Where a format has no free surrogate left (all five-digit telephones
    occur, say) later draws are longer than it.  Rounds are checkpointed;
    nothing is collected.
    """
    entities = cut(entities.select("kind", "norm").distinct())
    real = entities.select(F.col("kind").alias("r_kind"), F.col("norm").alias("r_norm"))
    done, waiting = None, entities
    for draw in range(DRAWS):
        drawn = waiting.withColumn("draw", F.lit(draw)).withColumn("new", _draw(key)).drop("draw")
        drawn = drawn.withColumn("place", F.row_number().over(Window.partitionBy("kind", "new").orderBy("norm")))
        free = drawn.join(real, (F.col("kind") == F.col("r_kind")) & (F.col("new") == F.col("r_norm")), "left_anti")
        if done is not None:
            used = done.select(F.col("kind").alias("u_kind"), F.col("new").alias("u_new"))
            free = free.join(used, (F.col("kind") == F.col("u_kind")) & (F.col("new") == F.col("u_new")), "left_anti")
        free = cut(free.where("place = 1").drop("place"))
        done = free if done is None else done.unionByName(free)
        waiting = cut(waiting.join(free.select("kind", "norm"), ["kind", "norm"], "left_anti"))
        if waiting.isEmpty():
            return done
    raise RuntimeError(f"surrogates still collide after {DRAWS} draws")


def _assign_names(entities: DataFrame, key: str) -> DataFrame:
    """:func:`assign`, where a given name after a neutral title is the one
    that a gendered title shows elsewhere, if any."""
    entities = cut(entities.select("kind", "norm").distinct())
    shown = entities.where("kind in ('given_m', 'given_f')").groupBy("norm").agg(F.min("kind").alias("shown"))
    same = cut(entities.where("kind = 'given'").join(shown, "norm").select("kind", "norm", "shown"))
    table = assign(entities.join(same.select("kind", "norm"), ["kind", "norm"], "left_anti"), key)
    again = same.join(table.select(F.col("kind").alias("shown"), "norm", "new"), ["shown", "norm"]).select("kind", "norm", "new")
    return table.unionByName(again)


def _later_mentions(found: DataFrame, new: DataFrame) -> DataFrame:
    """``p_id, p_digest, plain``: for texts with names, the capitalised words
    of each piece between the entities, those that are a name's word of the
    same text replaced.  A word that is both surname and given name there
    counts as the surname."""
    key = ["doc_id", "digest"]
    names = new.where(F.col("kind").isin(*NAMES)).groupBy(*[F.col(c).alias(f"n_{c}") for c in key], F.col("norm").alias("n_norm")).agg(
        F.max_by(F.struct("kind", "new"), "kind").alias("name")
    )
    named = names.select(F.col("n_doc_id").alias("s_id"), F.col("n_digest").alias("s_digest")).distinct()
    texts = found.join(named, found["doc_id"].eqNullSafe(named["s_id"]) & (found["digest"] == named["s_digest"]), "left_semi")
    words = (
        texts.select(*key, F.posexplode(F.split("text", ANY, -1)).alias("at", "piece"))
        .select(*key, "at", F.posexplode_outer(F.regexp_extract_all("piece", F.lit(PLAIN), F.lit(0))).alias("i", "raw"))
    )
    on = words["doc_id"].eqNullSafe(names["n_doc_id"]) & (words["digest"] == names["n_digest"]) & (F.lower("raw") == names["n_norm"])
    each = words.join(names, on, "left").withColumn("out", _formatted(F.col("name.kind"), F.col("raw"), F.col("name.new")))
    pieces = each.groupBy(*key, "at").agg(F.sort_array(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", "out")))).alias("words"))
    return pieces.groupBy(F.col("doc_id").alias("p_id"), F.col("digest").alias("p_digest")).agg(
        F.sort_array(F.collect_list(F.struct("at", "words"))).alias("plain")
    )


def _formatted(kind: Column, raw: Column, new: Column) -> Column:
    """A surrogate in the format of the text it replaces."""
    keep = F.when((kind == "phone") & (F.length(_digits(raw)) > 10), F.expr("substring(regexp_replace(raw, '[^0-9]', ''), 1, length(regexp_replace(raw, '[^0-9]', '')) - 10)")).otherwise(F.lit(""))
    shouted = (raw == F.upper(raw)) & (raw != F.lower(raw))
    return (
        F.when(new.isNull(), raw)
        .when(kind.isin("phone", "ssn", "card"), _fill(raw, "[0-9]", F.concat(keep, new)))
        .when(kind == "iban", _fill(raw, "[A-Z0-9]", new))
        .when(kind.isin(*NAMES), F.when(shouted, F.upper(new)).otherwise(F.initcap(new)))
        .when(kind == "email", F.when(shouted, F.upper(new)).otherwise(new))
        .otherwise(new)
    )


def surrogates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = KEY) -> DataFrame:
    """One row per input row: ``doc_id, n_entities``, a count for each of
    ``KINDS`` and ``text`` with every entity replaced.

    A null text stays null and counts no entities; empty texts and texts
    without entities are unchanged; rows that repeat (id, text) get the same
    result; ids may be null; other columns are not read.  A number is a card
    only if its check digit is right.  Names are found after a title, up to
    three words with particles like "de la" between them, which stay; their
    words get the same surrogates wherever else they stand capitalised in the
    same text (``n_name`` counts the mentions with a title).
    """
    ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("digest", sha256_text(text_or_empty("text")))
    id_digest = ["doc_id", "digest"]
    found = (
        rows.where(F.col("text").rlike(ANY))
        .select(*id_digest, F.regexp_extract_all("text", F.lit(ANY), F.lit(0)).alias("found"))
        .dropDuplicates(id_digest)
    )
    mentions = found.select(*id_digest, F.posexplode("found").alias("at", "m")).withColumn("of", _kind(F.col("m")))
    units = cut(
        mentions.select(*id_digest, "at", "of", F.posexplode(_units(F.col("m"), F.col("of"))).alias("part", "u")).select(
            *id_digest, "at", "of", "part", "u.kind", "u.raw", "u.norm"
        )
    )
    table = _assign_names(units.where("kind not in ('title', 'none')"), key)
    # An entity may be mentioned by a large share of the texts; it is one row
    # here, and adaptive execution splits its mentions.
    new = units.join(table, ["kind", "norm"], "left").withColumn("out", _formatted(F.col("kind"), F.col("raw"), F.col("new")))
    pieces = new.groupBy(*id_digest, "at", "of").agg(F.sort_array(F.collect_list(F.struct("part", "out"))).alias("parts"))
    by_text = (
        pieces.withColumn("out", F.array_join("parts.out", " "))
        .groupBy(F.col("doc_id").alias("d_id"), F.col("digest").alias("d_digest"))
        .agg(
            F.sort_array(F.collect_list(F.struct("at", "out"))).alias("new"),
            *[F.count(F.when(F.col("of") == k, 1)).alias(f"n_{k}") for k in KINDS],
        )
    )
    on = rows["doc_id"].eqNullSafe(by_text["d_id"]) & (rows["digest"] == by_text["d_digest"])
    plain = _later_mentions(rows.where(F.col("text").rlike(NAME)).dropDuplicates(id_digest), new)
    on_plain = rows["doc_id"].eqNullSafe(plain["p_id"]) & (rows["digest"] == plain["p_digest"])
    inner = lambda a, w: F.array_join(F.zip_with(F.split(a, PLAIN, -1), w["words"]["out"], lambda x, y: F.concat(x, F.coalesce(y, F.lit("")))), "")
    between = F.split("text", ANY, -1)
    between = F.when(F.col("plain").isNull(), between).otherwise(F.zip_with(between, "plain", inner))
    replaced = F.array_join(F.zip_with(between, "new.out", lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    counts = [F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in KINDS]
    total = sum((F.coalesce(f"n_{k}", F.lit(0).cast("long")) for k in KINDS), F.lit(0).cast("long"))
    return rows.join(by_text, on, "left").join(plain, on_plain, "left").select(
        "doc_id", total.alias("n_entities"), *counts, F.when(F.col("new").isNull(), F.col("text")).otherwise(replaced).alias("text")
    )


# --- registered query -------------------------------------------------------------------


def query(spark, sf_dir):
    from ledgerline.llm.common import documents

    return surrogates(documents(spark, sf_dir))
