"""Surrogates for personal data, in DataFrame operations.

Entities are found by patterns.  An entity's canonical form (separators and case
off) and a secret key give its surrogate through SHA-512, so equal entities get
equal surrogates in every document, however they are written.  A surrogate keeps
the type (valid Luhn and IBAN check digits, octets, country codes, top-level
domains), script, case, separators and length, and names keep the gender of
their title.  Over the table of distinct entities, surrogates that equal another
one or any entity found in the corpus are drawn again until none is left.  A format
that runs out of values gets one more character every WIDEN rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riselens.llm.common import hash2
from riselens.session import checkpoint

#: Titles that tell a gender.
MALE = ("Mr", "Mister", "Sir", "Herr", "Señor", "Sr", "Monsieur", "Господин")
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Señora", "Sra", "Madame", "Mme", "Госпожа")
#: Given names by gender and script.
GIVEN = {
    ("m", "latin"): "adam ben carl daniel erik felix hugo ivan jonas karl leon martin nico oscar paul simon".split(),
    ("f", "latin"): "alba bella clara diana elena flora greta helen irene julia laura maria nora olga paula sofia".split(),
    ("m", "cyrillic"): "андрей борис виктор денис егор иван кирилл леонид максим никита олег павел роман степан тимур юрий".split(),
    ("f", "cyrillic"): "алина вера галина дарья елена жанна зоя ирина ксения лариса мария нина ольга полина софья юлия".split(),
}
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_NAME = r"\p{Lu}\p{Ll}++(?:[ -]\p{Lu}\p{Ll}++){0,2}"
#: What stands before a secret or a name, belongs to the match and stays in the text.
SECRET_KEY = r"(?i:password|passwd|secret|token|api[_-]?key)[ ]{0,2}[=:][ ]{0,2}[\"']?"
TITLE_M, TITLE_F = (rf"(?:{'|'.join(t)})\.? " for t in (MALE, FEMALE))
#: In the order they are tried; all begin at the start of a word or number.
PATTERNS = {
    "name_m": TITLE_M + _NAME,
    "name_f": TITLE_F + _NAME,
    "secret": SECRET_KEY + r"[A-Za-z0-9_+/-]{8,}+",
    "iban": r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{10,30}+|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "ip": rf"(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{1,7}+",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])",
    "email": r"[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
}
ANY = r"(?<![\p{L}0-9])(?:" + "|".join(PATTERNS.values()) + ")"
WIDEN = 4


def entity_type(match: Column) -> Column:
    out = F.lit(None)
    for name in reversed(PATTERNS):
        out = F.when(match.rlike(f"^(?:{PATTERNS[name]})$"), name).otherwise(out)
    return out


def lead(match: Column) -> Column:
    """The part of a match that stays: a title, or the name of a secret."""
    return F.regexp_extract(match, f"^(?:{SECRET_KEY}|{TITLE_M}|{TITLE_F})", 0)


def canonical(kind: Column, e: Column) -> Column:
    digits = F.regexp_replace(e, "[^0-9A-Za-z]", "")
    return F.when(kind.isin("ssn", "iban", "phone", "card"), F.upper(digits)).when(kind.isin("email", "name_m", "name_f"), F.lower(e)).otherwise(e)


def _pick(alphabet: str, number: Column) -> Column:
    return F.substring(F.lit(alphabet), number % len(alphabet) + 1, F.lit(1))


def surrogate_of_canonical(rows: DataFrame, key: str) -> DataFrame:
    """rows: kind, canon, attempt; adds surrogate."""
    rows = rows.withColumn("stream", F.sha2(F.concat_ws("\x1f", F.lit(key), "kind", "canon", F.col("attempt").cast("string")), 512))
    kind, canon = F.col("kind"), F.col("canon")
    # every WIDEN rounds one more character: in front of a mail address, else at the end; addresses of hosts have values enough
    more = (F.col("attempt") / WIDEN).cast("int")
    last = F.when(kind.isin("name_m", "name_f"), F.expr("substr(canon, -1)")).when(kind == "secret", "a").otherwise("0")
    wide = F.when(kind == "ip", canon).when(kind == "email", F.concat(F.repeat(F.lit("a"), more), canon)).otherwise(F.concat(canon, F.repeat(last, more)))
    rows = rows.withColumn("wide", wide)
    # the leading part that stays: country codes, and of mail addresses the top-level domain
    keep = F.when(kind == "iban", 2).when(kind == "phone", F.greatest(F.length("canon") - 10, F.lit(0))).otherwise(0)
    stay = F.when(kind == "email", F.length("wide") - F.length(F.regexp_extract(canon, r"[^.]*$", 0))).otherwise(F.length("wide"))
    rows = rows.withColumns({"keep": keep, "stay": stay, "hexa": (kind == "secret") & canon.rlike("^[0-9a-f]+$")})

    def letter(c: Column, i: Column) -> Column:
        number = F.conv(F.substring(F.col("stream"), 1 + 4 * (i % 32), F.lit(4)), 16, 10).cast("int")
        latin = F.when(c.rlike("[aeiou]"), _pick("aeiou", number)).when(c.rlike("[a-z]"), _pick("bcdfghjklmnpqrstvwxyz", number))
        plain = F.when(c.rlike("[0-9]"), F.when((i == F.col("keep")) & kind.isin("phone", "card"), (number % 8 + 2).cast("string")).otherwise((number % 10).cast("string")))
        plain = plain.when(F.col("hexa"), _pick("abcdef", number)).when(c.rlike("[a-z]") & kind.isin("name_m", "name_f"), latin)
        plain = plain.when(c.rlike("[a-z]"), _pick("abcdefghijklmnopqrstuvwxyz", number)).when(c.rlike("[A-Z]"), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", number))
        plain = plain.when(c.rlike("[а-яё]"), _pick("абвгдежзиклмнопрстуфхцчшэюя", number)).when(c.rlike("[α-ω]"), _pick("αβγδεζηθικλμνξοπρστυφχψω", number))
        plain = plain.when(c.rlike(r"\p{IsLatin}"), _pick("áéíóúàèìòùâêîôû", number))
        # letters outside these alphabets: by script, and Latin ones for all others
        plain = plain.when(c.rlike(r"\p{IsCyrillic}"), _pick("абвгдежзиклмнопрстуфхцчшэюя", number)).when(c.rlike(r"\p{IsGreek}"), _pick("αβγδεζηθικλμνξοπρστυφχψω", number))
        plain = plain.when(c.rlike(r"\p{IsArmenian}"), _pick("աբգդեզէըթժիլխծկհձղճմյնշոչպջռսվտրցփք", number)).when(c.rlike(r"\p{L}"), _pick("abcdefghijklmnopqrstuvwxyz", number))
        return F.when((i < F.col("keep")) | (i >= F.col("stay")), c).otherwise(F.coalesce(plain, c))

    mapped = F.array_join(F.transform(F.split("wide", ""), letter), "")
    rows = rows.withColumn("mapped", mapped)
    octets = F.concat_ws(".", *(F.conv(F.substring("stream", 1 + 4 * j, 4), 16, 10).cast("int") % 223 + 1 for j in range(4)))
    # Luhn: doubled digits counted from the second last place
    body = F.expr("reverse(substr(mapped, 1, length(mapped) - 1))")
    luhn = F.aggregate(F.transform(F.split(body, ""), lambda d, i: F.when(i % 2 == 0, (2 * d.cast("int")) % 10 + F.floor(2 * d.cast("int") / 10).cast("int")).otherwise(d.cast("int"))), F.lit(0), lambda a, x: a + x)
    card = F.concat(F.expr("substr(mapped, 1, length(mapped) - 1)"), ((10 - luhn % 10) % 10).cast("string"))
    rest = F.expr("concat(substr(mapped, 5), substr(mapped, 1, 2), '00')")
    mod = F.aggregate(F.transform(F.split(rest, ""), lambda c: F.when(c.rlike("[0-9]"), c).otherwise((F.ascii(c) - 55).cast("string"))), F.lit(0), lambda a, x: F.when(F.length(x) == 1, (a * 10 + x.cast("int")) % 97).otherwise((a * 100 + x.cast("int")) % 97))
    iban = F.concat(F.substring("mapped", 1, 2), F.lpad((98 - mod).cast("string"), 2, "0"), F.expr("substr(mapped, 5)"))
    given = F.lit(None)
    for (sex, script), names in GIVEN.items():
        fits = (kind == "name_" + sex) & canon.rlike("^[a-z]" if script == "latin" else "^[а-яё]")
        given = F.when(fits, F.element_at(F.array(*map(F.lit, names)), F.conv(F.substring("stream", 125, 4), 16, 10).cast("int") % len(names) + 1)).otherwise(given)
    name = F.when(canon.rlike("[ -]") & given.isNotNull(), F.concat(given, F.regexp_extract(F.col("mapped"), r"[ -].*$", 0))).otherwise(F.col("mapped"))
    out = F.when(kind == "ip", octets).when(kind == "card", card).when(kind == "iban", iban).when(kind.isin("name_m", "name_f"), name).otherwise(F.col("mapped"))
    return rows.withColumn("surrogate", out).select("kind", "canon", "attempt", "surrogate")


def settle(entities: DataFrame, key: str) -> DataFrame:
    """entities: distinct (kind, canon); (kind, canon, surrogate) without collisions within a kind.

    A surrogate that equals an entity of the corpus, its own or another's, or one
    already drawn by a smaller canonical form, is drawn again, every WIDEN rounds
    with one more character, so that formats too small for their entities grow.
    """
    found = checkpoint(entities)
    done, todo = None, found.withColumn("attempt", F.lit(0))
    while True:
        drawn = surrogate_of_canonical(todo, key)
        if done is not None:
            taken = done.select("kind", "surrogate").withColumn("taken", F.lit(True))
            drawn = drawn.join(taken, ["kind", "surrogate"], "left")
        else:
            drawn = drawn.withColumn("taken", F.lit(None).cast("boolean"))
        real = found.select("kind", F.col("canon").alias("surrogate"), F.lit(True).alias("real"))
        drawn = drawn.join(real, ["kind", "surrogate"], "left")
        rank = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("canon"))
        drawn = checkpoint(drawn.withColumn("free", F.col("taken").isNull() & F.col("real").isNull() & (rank == 1)))
        good = drawn.where("free").select("kind", "canon", "surrogate")
        done = good if done is None else done.union(good)
        todo = drawn.where("not free").select("kind", "canon", (F.col("attempt") + 1).alias("attempt"))
        if todo.isEmpty():
            return done


def render(kind: Column, e: Column, surrogate: Column) -> Column:
    """The surrogate in the entity's own spelling: separators and case; characters beyond the entity's length as they are."""
    beyond = F.greatest(F.length(surrogate) - F.length(e), F.lit(0))
    mail = F.substring(surrogate, beyond + 1, F.length(surrogate))
    chars = F.split(e, "")
    place = lambda i: F.length(F.regexp_replace(F.substring(e, F.lit(1), i + 1), "[^0-9A-Za-z]", ""))
    spaced = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[0-9A-Za-z]"), F.when(c.rlike("[a-z]"), F.lower(F.substring(surrogate, place(i), F.lit(1)))).otherwise(F.substring(surrogate, place(i), F.lit(1)))).otherwise(c)), "")
    spaced = F.concat(spaced, F.substring(surrogate, F.length(F.regexp_replace(e, "[^0-9A-Za-z]", "")) + 1, F.length(surrogate)))
    cased = F.array_join(F.transform(chars, lambda c, i: F.when(F.upper(c) == c, F.upper(F.substring(mail, i + 1, F.lit(1)))).otherwise(F.substring(mail, i + 1, F.lit(1)))), "")
    cased = F.concat(F.substring(surrogate, F.lit(1), beyond), cased)
    name = F.when(F.upper(e) == e, F.upper(surrogate)).otherwise(F.initcap(surrogate))
    return F.when(kind.isin("ssn", "iban", "phone", "card"), spaced).when(kind == "email", cased).when(kind.isin("name_m", "name_f"), name).otherwise(surrogate)


def surrogate_texts(docs: DataFrame, key: str = "change me") -> DataFrame:
    """(doc_id, text, n_entities): every entity replaced, one row per row of ``docs``.

    Texts without entities, null and empty ones come back as they are.  Repeated
    rows and equal texts get equal surrogates; rows with null ids are treated
    like others; extra columns are ignored; an empty table stays empty.
    """
    h1, h2 = hash2(F.col("text"))
    rows = docs.select("doc_id", "text", F.coalesce(F.regexp_count("text", F.lit(ANY)), F.lit(0)).alias("n_entities"))
    hit = rows.where("n_entities > 0").select("text").withColumns({"h1": h1, "h2": h2})
    texts = checkpoint(hit.groupBy("h1", "h2").agg(F.first("text").alias("text")).select("h1", "h2", F.regexp_extract_all("text", F.lit(ANY), 0).alias("e"), F.split("text", ANY, -1).alias("gaps")))
    spans = texts.select("h1", "h2", F.posexplode("e").alias("i", "m"))
    spans = spans.withColumns({"kind": entity_type(F.col("m")), "lead": lead(F.col("m"))})
    spans = spans.withColumn("e", F.expr("substr(m, length(lead) + 1)"))
    spans = checkpoint(spans.withColumn("canon", canonical(F.col("kind"), F.col("e"))))
    surrogates = settle(spans.select("kind", "canon").distinct(), key)
    written = spans.join(surrogates, ["kind", "canon"]).select("h1", "h2", "i", F.concat("lead", render(F.col("kind"), F.col("e"), F.col("surrogate"))).alias("r"))
    lists = written.groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct("i", "r"))).alias("r"))
    whole = F.array_join(F.zip_with("gaps", F.transform("r", lambda r: r["r"]), lambda g, r: F.concat(g, F.coalesce(r, F.lit("")))), "")
    fresh = checkpoint(texts.join(lists, ["h1", "h2"]).select("h1", "h2", whole.alias("fresh")))
    changed = rows.where("n_entities > 0").select("doc_id", "n_entities", h1.alias("h1"), h2.alias("h2")).join(fresh, ["h1", "h2"])
    same = rows.where("n_entities = 0").select("doc_id", "text", "n_entities")
    return same.unionByName(changed.select("doc_id", F.col("fresh").alias("text"), "n_entities"))
