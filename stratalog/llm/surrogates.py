"""PII surrogates, in DataFrame operations only.

Detected entities (mail addresses, IPv4 addresses, phone numbers, social security numbers, IBANs, card numbers, names
after a form of address) are replaced by values of the same type and format, drawn by a keyed SHA-512 of the entity's
canonical form: letters stay letters of their case, digits digits, separators stay; country codes, top-level domains
and a card's first digit stay; card numbers get a valid check digit; names keep script and gender. The same entity
gets the same surrogate in every document and spelling. Distinct entities get distinct ones: surrogates that clash with
each other or with an entity of the corpus are drawn again, in rounds over the clashing ones, until none is left. Each
attempt from GROW on draws longer values, as a local part of few characters does from the first on, so the supply
grows by a factor of 100 or more a round whatever the format, and rounds end.

The texts are matched once, in the rows that a cheap test lets through. Matches are marked in the text, which is then cut at
the marks and stored; entities, draws and replacements are tables of distinct values, and only the pieces meet them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, fresh, scratch, text_or_empty, written

FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Señorita|Sra|Госпожа|госпожа"
MALE = "Mr|Herr|Monsieur|Señor|Sr|Господин|господин"
# Groups of no bounded number are possessive: Java's others take stack for each repetition, which a long text exhausts.
_MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9][A-Za-z0-9-]*+(?:\.[A-Za-z0-9][A-Za-z0-9-]*+)++"
_IP = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)"
_PHONE = r"(?<![\w+])\+1[ .-]?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\w+])\+\d{1,3}[ .-]?\(\d{1,4}\)(?:[ .-]?\d){5,12}+(?!\d)|(?<![\w+])\+?\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\w+])\(\d{2,4}\)[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\w+])\+\d(?:[ .-]?\d){7,14}+(?!\d)|(?<![\w+.-])\d{3}(?:[.-]\d{3}[.-]| \d{3} )\d{4}(?![\d-]|\.\d)"
_SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
_IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
_CARD = r"(?<![\d.])(?:\d{4}([ -])\d{4}\1\d{4}\1\d{4}|3[47]\d{2}[ -]\d{6}[ -]\d{5}|\d{13,19})(?!\d)"
#: A word of a name, with inner capitals, apostrophes and hyphens, or initials before another word.
_WORD = r"(?:(?:\p{Lu}\.-?)++(?= \p{Lu})|\p{Lu}\p{L}*+(?:['’-]\p{Lu}\p{L}*+)*+)"
_NAME = rf"(?<!\p{{L}})(?:{FEMALE}|{MALE})\.? {_WORD}(?: {_WORD})*+"
_INITIALS = r"^(?:\p{Lu}|(?:\p{Lu}\.-?)++)$"
PATTERN = "|".join([_MAIL, _IP, _PHONE, _SSN, _IBAN, _CARD.replace(r"\1", r"[ -]").replace("([ -])", "[ -]"), _NAME])
#: First letters and the rest of all forms of address.
_TITLE = r"[FHMSГг](?:rau|err|rs?|s|iss|adame|me|lle|onsieur|eñorita|eñora?|ra?|осподин|оспожа)\.? \p{Lu}"
#: Country codes of one and two digits; all others have three.
COUNTRY = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}"
#: Attempts up to which surrogates keep their length, and rounds of drawing that no supply outlasts.
GROW, ROUNDS = 6, 64
#: Marks around a match, and what stands for their first character where a text has it.
_MARK = "\u0001"
_OPEN, _CLOSE, _PLAIN = _MARK + "\u0003", _MARK + "\u0004", _MARK + "\u0002"
_LATIN = "ba be bi bo da de di do fa fe fi ga ge go ha he hi ja jo ka ke ki ko la le li lo lu ma me mi mo na ne ni no pa pe pi ra re ri ro sa se si so ta te ti to va ve vi wa we wi ya yo za ze zo bra dre kri tro plo gle sta sne".split()
_CYRILLIC = "ба бе би бо да де ди до фа фе фи га ге го ха хе хи жа жо ка ке ки ко ла ле ли ло лу ма ме ми мо на не ни но па пе пи ра ре ри ро са се си со та те ти то ва ве ви ша ше ши ча че за зе зо бра дре кри тро пло гле ста сне".split()


def may_have(text: Column) -> Column:
    """Cheap test that every text with an entity passes."""
    return text.contains("@") | text.rlike(r"\d[\d ().-]{5}") | text.rlike(r"[A-Z]{2}\d{2}") | text.rlike(_TITLE)


def _hex(key: str, *parts: Column) -> Column:
    """256 hexadecimal digits: keyed SHA-512 of the parts, twice."""
    joined = F.concat_ws("\u001f", F.lit(key), *parts)
    return F.concat(F.sha2(joined, 512), F.sha2(F.concat(joined, F.lit("\u001f+")), 512))


def _byte(hx: Column, i: Column) -> Column:
    return F.conv(F.substring(hx, (i % 128) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, where ``then`` has functions over arrays that would compute it for every element."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _masked(s: Column, hx: Column, from_: Column | int = 0) -> Column:
    """s with its ASCII lower-case letters, capitals and digits redrawn from position ``from_`` on."""

    def one(c: Column, i: Column, h: Column) -> Column:
        b = _byte(h, i)
        return (
            F.when(i < from_, c)
            .when(c.rlike("^[0-9]$"), (b % 10).cast("string"))
            .when(c.rlike("^[a-z]$"), F.char(F.lit(97) + b % 26))
            .when(c.rlike("^[A-Z]$"), F.char(F.lit(65) + b % 26))
            .otherwise(c)
        )

    return _once(hx, lambda h: F.array_join(F.transform(_chars(s), lambda c, i: one(c, i, h)), ""))


def _luhn(digits: Column) -> Column:
    """The check digit that makes digits + it pass the Luhn test."""
    total = F.aggregate(
        F.transform(F.reverse(_chars(digits)), lambda c, i: F.when(i % 2 == 0, (c.cast("int") * 2 % 10) + F.floor(c.cast("int") * 2 / 10).cast("int")).otherwise(c.cast("int"))),
        F.lit(0), lambda a, x: a + x,
    )
    return ((10 - total % 10) % 10).cast("string")


def entity_type(raw: Column) -> Column:
    whole = lambda p: raw.rlike(f"^(?:{p})$")
    return (
        F.when(raw.contains("@"), "mail")
        .when(whole(r"(?:\d{1,3}\.){3}\d{1,3}"), "ip")
        .when(whole(r"\d{3}-\d{2}-\d{4}"), "ssn")
        .when(whole(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{1,4})+"), "iban")
        .when(whole(r"\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5}"), "card")
        .when(raw.rlike(r"^\p{L}"), "name")
        .otherwise("phone")
    )


def _national(raw: Column) -> Column:
    """The digits of a phone number after its country code and up to two trunk zeros: those that are drawn."""
    digits = F.regexp_replace(raw, r"\D", "")
    code = (
        F.when(raw.startswith("+"), F.regexp_extract(digits, f"^(?:{COUNTRY})", 0))
        .when(raw.rlike(r"^\d"), F.regexp_extract(raw, r"^(\d{1,3})[ .-]?\(", 1))
        .otherwise("")
    )
    return F.regexp_replace(F.substring(digits, F.length(code) + 1, F.length(digits)), r"^0{1,2}(?=\d{5})", "")


def _keys(raw: Column, kind: Column, words: Column) -> Column:
    """Array of (type, canonical form, as spelled): one for each entity; a name has its parts, a given name by gender."""
    entry = lambda t, c, s: F.struct(t.alias("type"), c.alias("canon"), s.alias("shown"))
    gender = F.when(raw.rlike(f"^(?:{FEMALE})\\b"), "f").otherwise("m")
    script = F.when(F.element_at(words, 1).rlike(r"^\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    role = lambda w, i, s: F.when(w.rlike(_INITIALS), "initial").when(i < s["n"] - 1, F.concat(F.lit("given-"), s["gender"])).otherwise("surname")
    plain = lambda w: F.lower(F.replace(w, F.lit("’"), F.lit("'")))
    # Initials are drawn for the name that they are part of (its digest, as a name may be long): there are too few letters for each
    # to get one of its own.
    whole = F.sha2(plain(F.array_join(words, " ")), 256)
    shared = F.struct(script.alias("script"), gender.alias("gender"), F.size(words).alias("n"), whole.alias("whole"))
    one = lambda w, i, s: entry(F.concat_ws("-", role(w, i, s), s["script"]), F.when(w.rlike(_INITIALS), s["whole"]).otherwise(plain(w)), w)
    names = _once(shared, lambda s: F.transform(words, lambda w, i: one(w, i, s)))
    return (
        F.when(kind == "name", names)
        .when(kind == "phone", F.array(entry(kind, _national(raw), raw)))
        .when(kind.isin("card", "ssn"), F.array(entry(kind, F.regexp_replace(raw, r"\D", ""), raw)))
        .when(kind == "iban", F.array(entry(kind, F.replace(raw, F.lit(" "), F.lit("")), raw)))
        .otherwise(F.array(entry(kind, F.lower(raw), raw)))
    )


def surrogate(key: str) -> Column:
    """Canonical surrogate of the columns type, canon and attempt."""
    kind, canon, attempt = F.col("type"), F.col("canon"), F.col("attempt")
    hx = _hex(key, kind, canon, attempt.cast("string"))
    late = F.greatest(attempt - F.lit(GROW - 1), F.lit(0))

    def more(n: Column, char: str) -> Column:
        """So many drawn letters or digits, from a hash of their own."""
        return F.when(n > 0, _masked(F.repeat(F.lit(char), n), _hex(key, F.lit("more"), kind, canon, attempt.cast("string")))).otherwise("")

    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    own = F.length(F.regexp_replace(local, "[^a-z0-9]", ""))
    hd = _hex(key, F.lit("domain"), domain)
    top = F.substring_index(domain, ".", -1)
    mail = F.concat(
        _masked(local, hx), more(F.when(own == 0, attempt + 2).when(own < 4, attempt).otherwise(late) * 2, "a"), F.lit("@"),
        _masked(F.substring(domain, F.lit(1), F.length(domain) - F.length(top) - 1), hd), F.lit("."), top,
    )
    digits = more(late * 2, "0")
    ip = F.concat(F.concat_ws(".", *((_byte(hx, F.lit(i)) % 254 + 1).cast("string") for i in range(4))), F.when(late > 0, ".").otherwise(""), digits)
    card = F.concat(_masked(F.substring(canon, F.lit(1), F.length(canon) - 1), hx, 1), digits)
    phone = F.concat((_byte(hx, F.lit(0)) % 8 + 2).cast("string"), _masked(F.substring(canon, F.lit(2), F.length(canon)), _hex(key, F.lit("rest"), kind, canon, attempt.cast("string"))), digits)
    syllable = lambda table, i: F.element_at(F.array(*map(F.lit, table)), _byte(hx, F.lit(i)) % len(table) + 1)

    def name(table: list[str], female: str, male: str) -> Column:
        further = [F.when(attempt > i, syllable(table, 8 + i)).otherwise("") for i in range(3, ROUNDS, 2)]
        stem = F.concat(*(syllable(table, i) for i in range(3)), *further)
        return F.concat(stem, F.when(kind.startswith("given-f"), female).when(kind.startswith("given-m"), male).otherwise(syllable(["r", "n", "l", "s"] if table is _LATIN else ["в", "н", "р", "к"], 5)))

    return (
        F.when(kind == "mail", mail)
        .when(kind == "ip", ip)
        .when(kind == "card", F.concat(card, _luhn(card)))
        .when(kind == "iban", F.concat(_masked(canon, hx, 2), digits))
        .when(kind == "phone", phone)
        .when(kind == "ssn", F.concat(_masked(canon, hx), digits))
        .when(kind.endswith("cyrillic"), name(_CYRILLIC, "на", "н"))
        .otherwise(name(_LATIN, "na", "n"))
    )


def _spelled(kind: Column, shown: Column, new: Column) -> Column:
    """The canonical surrogate in the format of what it replaces; what it is longer goes to the end."""
    old_digits = F.regexp_replace(shown, r"\D", "")
    # A phone number's country code and trunk zeros stay.
    national = F.when(kind == "phone", _national(shown)).otherwise(old_digits)
    digits = F.concat(F.substring(old_digits, F.lit(1), F.length(old_digits) - F.length(national)), new)
    nth = lambda i: F.length(F.regexp_replace(F.substring(shown, F.lit(1), i + 1), r"\D", ""))
    filled = F.concat(
        F.array_join(F.transform(_chars(shown), lambda c, i: F.when(c.rlike(r"^\d$"), F.substring(digits, nth(i), F.lit(1))).otherwise(c)), ""),
        F.substring(digits, F.length(old_digits) + 1, F.length(digits)),
    )
    cased = F.array_join(F.zip_with(_chars(shown), _chars(new), lambda c, n: F.when(c.rlike("^[A-Z]$"), F.upper(n)).otherwise(n)), "")
    packed = lambda i: F.length(F.replace(F.substring(shown, F.lit(1), i + 1), F.lit(" "), F.lit("")))
    spaced = F.concat(
        F.array_join(F.transform(_chars(shown), lambda c, i: F.when(c == " ", c).otherwise(F.substring(new, packed(i), F.lit(1)))), ""),
        F.substring(new, F.length(F.replace(shown, F.lit(" "), F.lit(""))) + 1, F.length(new)),
    )
    letter = lambda i: F.substring(new, i % 6 + 1, F.lit(1))
    initials = F.array_join(F.transform(_chars(shown), lambda c, i: F.when(c.rlike(r"^\p{L}$"), F.upper(F.when(letter(i) == F.lower(c), letter(i + 1)).otherwise(letter(i)))).otherwise(c)), "")
    return (
        F.when(kind.isin("phone", "card", "ssn"), filled)
        .when(kind == "mail", cased)
        .when(kind == "iban", spaced)
        .when(kind == "ip", new)
        .when(kind.startswith("initial"), initials)
        .when(shown == F.upper(shown), F.upper(new))
        .otherwise(F.initcap(new))
    )


def cut(docs: DataFrame, lead: str, parts: str, row: str) -> DataFrame:
    """The rows of ``docs`` that may have entities, stored, with text replaced by what stands before the first match
    (``lead``) and for each match its raw text and what follows it (``parts``), and with a number of each row (``row``).
    """
    marked = F.regexp_replace(F.replace("text", F.lit(_MARK), F.lit(_PLAIN)), f"(?:{PATTERN})", f"{_OPEN}$0{_CLOSE}")
    cells = docs.filter(may_have(text_or_empty())).withColumn(lead, F.split(marked, _OPEN, -1)).drop("text")
    back = lambda c: F.replace(c, F.lit(_PLAIN), F.lit(_MARK))

    def part(p: Column) -> Column:
        raw = F.substring_index(p, _CLOSE, 1)
        return F.struct(raw.alias("raw"), back(F.substring(p, F.length(raw) + 3, F.length(p))).alias("after"))

    found = F.transform(F.slice(lead, F.lit(2), F.size(lead)), part)
    return written(cells.withColumn(parts, found).withColumn(lead, back(F.element_at(lead, 1))).withColumn(row, F.monotonically_increasing_id()), "pii-rows")


def entities(raws: DataFrame) -> DataFrame:
    """raw -> raw, n (occurrences), kind, k, type, canon, shown: stored, one row per spelling and part."""
    counted = raws.groupBy("raw").agg(F.count(F.lit(1)).alias("n"))
    words = F.slice(F.split("raw", " "), F.lit(2), F.greatest(F.size(F.split("raw", " ")) - 1, F.lit(0)))
    typed = counted.withColumn("kind", entity_type(F.col("raw"))).withColumn("words", words)
    parts = typed.select("raw", "n", "kind", F.posexplode(_keys(F.col("raw"), F.col("kind"), F.col("words"))).alias("k", "e"))
    return written(parts.select("raw", "n", "kind", "k", "e.type", "e.canon", "e.shown"), "pii-entities")


def assign(found: DataFrame, key: str) -> DataFrame:
    """type, canon, new, n (rows of that type and canon): distinct within a type, and no entity of the corpus. Stored.

    Each round draws again for those that clash. ROUNDS is a guard: a supply that grows a hundredfold a round is enough long before.
    """
    spark = found.sparkSession
    drawn = written(found.groupBy("type", "canon").agg(F.count(F.lit(1)).alias("n")).withColumn("attempt", F.lit(0)).withColumn("new", surrogate(key)), "pii-draws")
    for _ in range(ROUNDS):
        with scratch(spark) as kept:
            real = drawn.select("type", F.col("canon").alias("new"))
            first = drawn.groupBy("type", "new").agg(F.min(F.struct("attempt", "canon")).alias("_first"), F.count(F.lit(1)).alias("_n"))
            shared = first.filter("_n > 1").drop("_n")
            lost = (
                drawn.join(shared, ["type", "new"]).filter(F.struct("attempt", "canon") != F.col("_first")).select("type", "canon")
                .unionByName(drawn.join(real, ["type", "new"], "left_semi").select("type", "canon"))
                .distinct()
            )
            lost = written(lost, "pii-clashes")
            if lost.isEmpty():
                return drawn.select("type", "canon", "new", "n")
            again = drawn.join(lost, ["type", "canon"], "left_semi").withColumn("attempt", F.col("attempt") + 1)
            drawn = written(drawn.join(lost, ["type", "canon"], "left_anti").unionByName(again.withColumn("new", surrogate(key))), "pii-draws")
            kept.append(drawn)
    raise RuntimeError("surrogates still clash after the last round")


def replacements(raws: DataFrame, key: str) -> DataFrame:
    """raw -> raw, new, n (occurrences): stored, one row per spelling."""
    spark = raws.sparkSession
    with scratch(spark) as kept:
        found = entities(raws)
        drawn = assign(found, key).withColumn("of", F.concat_ws("\u001f", "type", "canon"))
        named = attach(found.withColumn("of", F.concat_ws("\u001f", "type", "canon")), drawn, "of", ["new"], "raw", "n")
        spelled = named.select("raw", "n", "kind", "k", _spelled(F.col("type"), F.col("shown"), F.col("new")).alias("part"))
        whole = spelled.groupBy("raw", "n", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "part"))), lambda p: p["part"]), " ").alias("new"))
        title = F.when(F.col("kind") == "name", F.concat(F.substring_index("raw", " ", 1), F.lit(" "))).otherwise("")
        out = written(whole.select("raw", F.concat(title, F.col("new")).alias("new"), F.col("n").alias("_n")), "pii-replacements")
        kept.append(out)
    return out


def replace_pii(docs: DataFrame, key: str) -> DataFrame:
    """The columns of ``docs`` with text replaced and n_entities added (an input column of that name is replaced).

    Texts without entities come back as they are, null as null. Rows are told apart by a number of their own, so that null and
    repeated ids do no harm; all rows share their entities' surrogates. Empty in, empty out. What an entity is replaced by depends on
    the key, the entity and, for the few that clash, on the other entities of the corpus.
    """
    base = docs.drop("n_entities")
    names = [f"`{c}`" for c in base.columns]
    lead, parts, row, of, new = fresh(base, "_lead", "_parts", "_row", "_of", "_new")
    plain = base.filter(~may_have(text_or_empty())).withColumn("n_entities", F.lit(0).cast("long"))
    rows = cut(base, lead, parts, row)
    pieces = rows.select(F.col(row).alias("_row"), F.posexplode(f"{parts}.raw").alias("_i", "raw"))
    put = attach(pieces, replacements(pieces.select("raw"), key), "raw", ["new"], "_row")
    by_row = put.groupBy(F.col("_row").alias(of)).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "new"))), lambda p: p["new"]).alias(new))
    woven = F.concat(F.col(lead), F.array_join(F.zip_with(parts, new, lambda p, n: F.concat(n, p["after"])), ""))
    done = rows.join(by_row, F.col(row) == F.col(of), "left").withColumn("text", F.when(F.size(parts) > 0, woven).otherwise(F.col(lead)))
    return plain.unionByName(done.withColumn("n_entities", F.size(parts).cast("long")).select(*names, "n_entities"))
