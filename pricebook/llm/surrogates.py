"""Surrogates for personal data: keyed, type-consistent, distinct and the same for every mention.

E-mail addresses, phone numbers, payment cards, IPv4 addresses, IBANs, social security numbers and titled names are
detected in whole texts. The canonical form of an entity (lower case, without punctuation where that is only layout)
gets one surrogate in the whole corpus, so all mentions stay coreferent; the surrogate is then written in the layout
and case of each mention. Surrogates are drawn from a keyed SHA-512: digits replace digits and letters letters; valid
card numbers stay valid; names keep gender (from the title), script (Latin, Cyrillic, Greek, Armenian; others get
Latin letters) and initial capital. IPv4 addresses stay in range.

A given name with its gender is an entity of its own. Where a document has a titled name, the same words without a
title are replaced too: by the person whose given and last name stand there, else by the first titled name of the
document with that word. Runs of such words count as one name.

Collision checks: no two entities of a type share a surrogate, and no surrogate is an entity of the corpus (for names,
neither a given nor a last name of it). The losers
of a round draw again; each round works on the entities still open, read from the shared folder.

DataFrame functions only. What is shuffled are mentions and the texts that have any; other texts are not moved.

Defined cases: a null text stays null and has no entity; repeated rows are replaced alike; an empty table gives no
rows; other columns, whatever their names, pass through ``pseudonymise`` untouched.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricebook.llm.common import row_key, stored

KEY = "corpus-surrogates"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
# fixed values: titles by gender
MALE = ("Mr.", "Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr.", "Don", "Господин")
FEMALE = ("Mrs.", "Mrs", "Ms.", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra.", "Doña", "Госпожа")
_TITLES = "|".join(t.replace(".", r"\.") for t in sorted(MALE + FEMALE, key=len, reverse=True))
_NAME = r"\p{Lu}\p{L}*(?:['’-]\p{Lu}\p{L}*)?"
# in order: at one place the first kind that fits counts
PATTERNS = {
    # the possessive group is a loop for the engine, so a host may have any number of labels
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]++)++",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}|\([0-9]{3}\) ?[0-9]{3}[-. ][0-9]{4}"
             r"|[0-9]{3}[-.][0-9]{3}[-.][0-9]{4})(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4})(?![0-9A-Za-z])",
    "ip": r"(?<![0-9A-Za-z.])" + _OCTET + r"(?:\." + _OCTET + r"){3}(?![0-9A-Za-z]|\.[0-9])",
    "name": r"(?<!\p{L})(?:" + _TITLES + r") " + _NAME + "(?: " + _NAME + "){0,2}",
}
NAMES = ("name", "given")
# a capitalised word that is no part of a longer one
WORD = r"(?<![\p{L}\p{N}_])" + _NAME + r"(?![\p{L}\p{N}_])"
ANY = "|".join(PATTERNS.values())
TYPES = tuple(PATTERNS)
# fixed values: syllables of made-up names, per script
LATIN = ("ba", "den", "fi", "gor", "hal", "ke", "lin", "mar", "no", "per", "ras", "sol", "tam", "ver", "wil", "zan")
GREEK = ("βα", "δεν", "φι", "γορ", "χαλ", "κε", "λιν", "μαρ", "νο", "περ", "ρας", "σολ", "ταμ", "βερ", "πιλ", "ζαν")
ARMENIAN = ("բա", "դեն", "ֆի", "գոր", "հալ", "կե", "լին", "մար", "նո", "պեր", "րաս", "սոլ", "տամ", "վեր", "վիլ", "զան")
CYRILLIC = ("ба", "ден", "фи", "гор", "хал", "ке", "лин", "мар", "но", "пер", "рас", "сол", "там", "вер", "вил", "зан")


def _regex(p):
    return p.replace("\\", "\\\\").replace("'", "\\'")


def mentions(text):
    """(pieces, mentions) of a text column named ``_t``: what stands between, and the entities in order."""
    pieces = F.split(text, ANY, -1)
    found = F.when(F.size(pieces) > 1, F.expr(f"regexp_extract_all(_t, '{_regex(ANY)}', 0)"))
    return pieces, F.coalesce(found, F.array().cast("array<string>"))


def _type(m):
    title = F.rlike(m, F.lit("^(?:" + _TITLES + ") "))
    kinds = [("email", m.contains("@")), ("name", title), ("iban", m.rlike("^[A-Z]")), ("ssn", m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$")),
             ("card", m.rlike("^" + PATTERNS["card"] + "$")), ("ip", m.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"))]
    return reduce(lambda c, k: c.when(k[1], k[0]), kinds[1:], F.when(kinds[0][1], kinds[0][0])).otherwise("phone")


def _gender(m):
    return F.when(F.split_part(m, F.lit(" "), F.lit(1)).isin(*FEMALE), "f").otherwise("m")


def _canon(kind, m):
    last = F.lower(F.split_part(m, F.lit(" "), F.lit(-1)))
    return (F.when(kind == "email", F.lower(m)).when(kind == "name", F.concat_ws("|", _gender(m), last)).when(kind == "ip", m)
            .otherwise(F.lower(F.regexp_replace(m, "[^0-9A-Za-z]", ""))))


def _stream(key, *parts):
    return F.sha2(F.concat_ws("|", F.lit(key), *parts).cast("binary"), 512)


def _byte(stream, i):
    """Byte i of the stream, which repeats after 64."""
    return F.conv(F.substr(stream, F.lit(1) + (i % 64) * 2, F.lit(2)), 16, 10).cast("int")


def _chars(s):
    return F.split(s, "")


def _shape(s, stream):
    """Digits for digits, letters for letters; the rest stays."""
    digit = lambda i: F.substr(F.lit("0123456789"), _byte(stream, i) % 10 + 1, F.lit(1))
    letter = lambda i: F.substr(F.lit("abcdefghijklmnopqrstuvwxyz"), _byte(stream, i) % 26 + 1, F.lit(1))
    return F.array_join(F.transform(_chars(s), lambda c, i: F.when(c.rlike("[0-9]"), digit(i)).when(c.rlike("[a-z]"), letter(i)).otherwise(c)), "")


def _luhn(s):
    """Luhn sum modulo 10 of a digit string."""
    d = F.transform(F.reverse(_chars(s)), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        F.when(c.cast("int") * 2 > 9, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(d, F.lit(0), lambda a, x: a + x) % 10


def _name(canon, stream, female, extra):
    """Two to three syllables in the script of the name, ending by gender; more syllables after many attempts."""
    def word(table):
        t = F.array(*map(F.lit, table))
        part = lambda i: F.element_at(t, _byte(stream, F.lit(i)) % 16 + 1)
        return F.concat(part(0), part(1), part(2), F.when(extra > 3, F.concat(part(3), part(4), part(5))).otherwise(""))
    return (F.when(canon.rlike(r"\p{IsCyrillic}"), F.concat(word(CYRILLIC), F.when(female, "ова").otherwise("ов")))
            .when(canon.rlike(r"\p{IsGreek}"), F.concat(word(GREEK), F.when(female, "α").otherwise("ος")))
            .when(canon.rlike(r"\p{IsArmenian}"), F.concat(word(ARMENIAN), F.when(female, "ուհի").otherwise("յան")))
            .otherwise(F.concat(word(LATIN), F.when(female, "a").otherwise("o"))))


def _draw(kind, canon, attempt, key):
    stream = _stream(key, kind, canon, attempt.cast("string"))
    digits = _shape(canon, stream)
    head = F.substr(digits, F.lit(1), F.length(digits) - 1)
    check = (10 - _luhn(F.concat(head, F.lit("0")))) % 10
    card = F.when(_luhn(canon) == 0, F.concat(head, check.cast("string"))).otherwise(digits)
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_byte(stream, i) % 254 + 1).cast("string")), ".")
    tail = F.when(attempt > 20, F.concat(F.lit("."), F.substr(stream, F.lit(100), F.lit(12)))).otherwise("")
    at = F.split(canon, "@")
    host = F.element_at(at, -1)
    tld = F.regexp_extract(host, r"(\.[a-z0-9-]+)$", 1)
    new_host = F.concat(_shape(F.regexp_replace(host, r"\.[a-z0-9-]+$", ""), F.reverse(stream)), tld)
    email = F.concat(_shape(F.get(at, F.lit(0)), stream), tail, F.lit("@"), new_host)
    name = _name(canon, stream, canon.startswith("f|"), attempt)
    iban = F.concat(F.substr(canon, F.lit(1), F.lit(2)), F.substr(digits, F.lit(3), F.length(digits)))
    return (F.when(kind == "email", email).when(kind == "card", card).when(kind == "ip", octets).when(kind.isin(*NAMES), name)
            .when(kind == "iban", iban).otherwise(digits))


def surrogates(entities: DataFrame, key=KEY, rounds=200) -> DataFrame:
    """(kind, canon, surrogate) for distinct (kind, canon): all surrogates differ, none is an entity."""
    entities = stored(entities.select("kind", "canon").distinct(), "pii-entities")
    done, left = None, entities.select("kind", "canon", F.lit(0).alias("attempt"))
    named = F.col("kind").isin(*NAMES)
    taken = entities.select(F.explode(F.when(named, F.array(*map(F.lit, NAMES))).otherwise(F.array("kind"))).alias("kind"),
                            F.when(named, F.expr("substring(canon, 3)")).otherwise(F.col("canon")).alias("surrogate")).distinct()
    for _ in range(rounds):
        drawn = left.select("kind", "canon", "attempt", _draw(F.col("kind"), F.col("canon"), F.col("attempt"), key).alias("surrogate"))
        drawn = stored(drawn, "pii-drawn")
        first = drawn.groupBy("kind", "surrogate").agg(F.min("canon").alias("canon"))
        first = first.join(taken, ["kind", "surrogate"], "left_anti")
        if done is not None:
            first = first.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        first = first.select("kind", "canon", "surrogate")
        done = stored(first if done is None else done.union(first), "pii-done")
        left = stored(drawn.join(done.select("kind", "canon"), ["kind", "canon"], "left_anti")
                      .select("kind", "canon", (F.col("attempt") + 1).alias("attempt")), "pii-left")
        if left.isEmpty():
            return done
    raise ValueError(f"no free surrogate after {rounds} draws")


def _write(kind, m, surrogate, given):
    """The surrogate in the layout and case of a mention; given: the surrogates of its given names."""
    s = F.regexp_replace(surrogate, "[^0-9A-Za-z]", "")
    step = lambda a, c: F.when(c.rlike("[0-9A-Za-z]"), F.struct(
        (a["i"] + 1).alias("i"),
        F.concat(a["out"], F.when(c.rlike("[A-Z]"), F.upper(F.substr(s, a["i"], F.lit(1)))).otherwise(F.substr(s, a["i"], F.lit(1)))).alias("out"))
    ).otherwise(F.struct(a["i"].alias("i"), F.concat(a["out"], c).alias("out")))
    layout = F.aggregate(_chars(m), F.struct(F.lit(1).alias("i"), F.lit("").alias("out")), step, lambda a: a["out"])
    words = F.split(m, " ")
    given = F.transform(F.coalesce(given, F.array().cast("array<string>")), F.initcap)
    name = F.array_join(F.concat(F.slice(words, 1, 1), given, F.array(F.initcap(surrogate))), " ")
    return F.when(kind == "name", name).when(kind.isin("email", "ip"), surrogate).otherwise(layout)


def replacements(docs: DataFrame, key=KEY) -> DataFrame:
    """(k, kinds, made): per text with mentions, a map from each mention to its replacement and the count per kind."""
    _, m = mentions(F.col("_t"))
    found = docs.select(row_key("doc_id", "text").alias("k"), F.col("text").alias("_t")).where(F.col("_t").rlike(r"[0-9@]|(?:" + _TITLES + ") "))
    found = found.select("k", F.explode(F.array_distinct(m)).alias("m")).distinct()
    kind = _type(F.col("m"))
    found = stored(found.select("k", "m", kind.alias("kind"), _canon(kind, F.col("m")).alias("canon")), "pii-mentions")
    words = F.split("m", " ")
    given = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    given = (found.where("kind = 'name'").select("m").distinct().select("m", F.posexplode(given).alias("i", "w"))
             .select("m", "i", F.lit("given").alias("kind"), F.concat_ws("|", _gender(F.col("m")), F.lower("w")).alias("canon")))
    known = surrogates(found.select("kind", "canon").union(given.select("kind", "canon")), key)
    given = (given.join(known, ["kind", "canon"]).groupBy("m")
             .agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "surrogate"))), lambda x: x["surrogate"]).alias("given")))
    texts = found.select("m", "kind", "canon").distinct().join(known, ["kind", "canon"]).join(given, "m", "left")
    texts = texts.select("m", "kind", _write(F.col("kind"), F.col("m"), F.col("surrogate"), F.col("given")).alias("r"))
    return (found.select("k", "m").join(texts, "m").groupBy("k")
            .agg(F.map_from_entries(F.collect_list(F.struct("m", F.struct("kind", "r")))).alias("made")))


def _first(pairs):
    """A map of (key, value) pairs in which the first of a key counts."""
    keys = F.array_distinct(F.transform(pairs, lambda x: x["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.get(F.filter(pairs, lambda x: x["key"] == k), F.lit(0))["r"]))


def _let(value, use):
    """use(value), with the value evaluated once per row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _untitled(rows: DataFrame) -> DataFrame:
    """p with the document's titled names replaced where they stand without a title; more: how many."""
    names = F.transform(F.filter(F.arrays_zip("m", "g"), lambda x: x["g"]["kind"] == "name"),
                        lambda x: F.struct(F.split(F.lower(x["m"]), " ").alias("m"), F.split(x["g"]["r"], " ").alias("r")))
    pair = lambda key, r: F.struct(key.alias("key"), r.alias("r"))
    body = lambda x: F.slice(x, 2, F.size(x))
    last = lambda x: F.element_at(x, -1)

    def maps(names):
        # last names first: of a word that is a given name too, the last name counts
        one = F.concat(F.transform(names, lambda x: pair(last(x["m"]), last(x["r"]))),
                       F.flatten(F.transform(names, lambda x: F.zip_with(body(x["m"]), body(x["r"]), pair))))
        two = F.flatten(F.transform(names, lambda x: F.zip_with(
            F.zip_with(F.slice(x["m"], 1, F.size(x["m"]) - 1), body(x["m"]), lambda a, b: F.concat_ws(" ", a, b)), body(x["r"]), pair)))
        return F.struct(_let(one, _first).alias("one"), _let(two, _first).alias("two"))

    def piece(known, t):
        def put(x):
            w, before, joined = F.lower(x["w"]), F.lower(x["b"]), x["gap"] == " "
            r = F.coalesce(F.when(joined, F.try_element_at(known["two"], F.concat_ws(" ", before, w))), F.try_element_at(known["one"], w))
            again = joined & F.try_element_at(known["one"], before).isNotNull()
            return F.struct(F.concat(x["gap"], F.coalesce(r, x["w"], F.lit(""))).alias("t"), (r.isNotNull() & ~again).cast("int").alias("n"))

        return _let(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), lambda found: F.transform(
            F.zip_with(F.zip_with(F.split(t, WORD, -1), found, lambda gap, w: F.struct(gap.alias("gap"), w.alias("w"))),
                       F.concat(F.array(F.lit("")), found), lambda x, b: F.struct(x["gap"].alias("gap"), x["w"].alias("w"), b.alias("b"))), put))

    done = lambda known: _let(F.transform("p", lambda t: piece(known, t)), lambda q: F.struct(
        F.transform(q, lambda x: F.array_join(F.transform(x, lambda y: y["t"]), "")).alias("p"),
        F.aggregate(F.flatten(q), F.lit(0), lambda a, x: a + x["n"]).alias("n")))
    as_is = F.struct(F.col("p"), F.lit(0).alias("n"))
    q = _let(names, lambda x: F.when(F.size(x) > 0, _let(maps(x), done)).otherwise(as_is))
    return rows.select("_doc", "_t", "g", F.explode(F.array(q)).alias("q")).select("_doc", "_t", "g", F.col("q.p").alias("p"), F.col("q.n").alias("more"))


def pseudonymise(docs: DataFrame, key=KEY, counts=False) -> DataFrame:
    """The documents with replaced texts; with ``counts`` also n_entities and one count per type."""
    made = stored(replacements(docs, key), "pii-made")
    rows = docs.select(F.struct("*").alias("_doc"), F.col("text").alias("_t"))
    some = F.coalesce(F.col("_t").rlike(ANY), F.lit(False))
    pieces, m = mentions(F.col("_t"))
    # texts without a mention pass by the join where they lie
    touched = rows.where(some).select("_doc", "_t", row_key("_doc.doc_id", "_t").alias("k")).join(made, "k")
    touched = touched.select("_doc", "_t", "made", pieces.alias("p"), m.alias("m"))
    given = F.transform("m", lambda x: F.element_at("made", x))
    touched = _untitled(touched.select("_doc", "_t", "p", "m", given.alias("g")))
    rows = touched.unionByName(rows.where(~some), allowMissingColumns=True)
    joined = F.array_join(F.zip_with("p", "g", lambda p, g: F.concat(p, F.coalesce(g["r"], F.lit("")))), "")
    text = F.when(F.col("g").isNull(), F.col("_t")).otherwise(joined)
    out = [text.alias(c) if c == "text" else F.col("_doc")[c].alias(c) for c in docs.columns]
    if counts:
        def n(kind=None):
            of_kind = F.filter("g", lambda g: F.lit(True) if kind is None else g["kind"] == kind)
            more = F.coalesce("more", F.lit(0)) if kind in (None, "name") else F.lit(0)
            return (F.greatest(F.size(of_kind), F.lit(0)) + more).cast("long")
        out += [n().alias("n_entities")] + [n(t).alias(f"n_{t}") for t in TYPES]
    return rows.select(*out)
