"""Personal data replaced by surrogates, with SQL functions only.

Detected entities: e-mail addresses, phone numbers, IPv4 addresses, card and account numbers (13 to 19 digits), US social
security numbers, IBANs, secrets (quoted tokens of 32 and more hexadecimal digits, access key ids, values after password=
and the like), and personal names after a title. Words of a name (three letters and more) that a title has told are
replaced wherever they stand in the same document; names that no title tells anywhere in a document stay.

A surrogate is a keyed function of the entity's canonical form, so an entity gets one surrogate in all documents and
spellings (coreference); for names that holds word by word. It keeps type, length, letter case, separators and, for
names, gender and script; card numbers pass the Luhn test and IBANs their check digits. A given name's gender is what
titles say of it in the whole input. Entities of the whole input are checked: where two entities of a type share a
surrogate, or a surrogate is itself an entity that occurs, all but the first entity draw again, from a space that grows
with the draws, until every surrogate is its own (distinctness). Initials are replaced letter by letter, unchecked.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import cells, cut, hidden, restored

#: Titles by the gender they tell.
TITLES = {
    "m": "Mr Sir Sr Herr Hr Monsieur Señor господин κύριος MR SIR HERR SEÑOR".split(),
    "f": "Mrs Ms Miss Madam Frau Madame Mademoiselle Mme Mlle Señora Señorita Sra Srta госпожа κυρία MRS MS MISS FRAU SEÑORA".split(),
    "u": "Dr Prof Professor доктор DR PROF".split(),
}
#: Syllables of surrogate names by script, and the endings of given names by gender.
SYLLABLES = {
    "latin": "bel cor dan fen gar hal jor kel lun mar nor pel ros sal tor vel wen zan bri dor".split(),
    "cyrillic": "бел вар гор дан жел зор кол лун мар нор пет рос сал тор фел хар".split(),
    "greek": "βελ γαρ δαν ζορ θελ καλ λουν μαρ νορ πελ ροσ σαλ τορ φεν χαρ".split(),
}
ENDINGS = {"latin": {"m": "o", "f": "a", "u": "en"}, "cyrillic": {"m": "ий", "f": "ия", "u": "ен"}, "greek": {"m": "ος", "f": "η", "u": "ι"}}
#: Small words inside a name, which stay.
PARTICLES = "van von der den de del della di da dos du la le ter ten bin ibn al el".split()
#: Words that a value after = or : makes secret.
KEYWORDS = "password passwd secret token api_key apikey".split()

_TITLE = "(?:" + "|".join(t for ts in TITLES.values() for t in ts) + r")(?!\p{L})(?:\.\s?|\s)"
_WORD = r"(?:(?:" + "|".join(PARTICLES) + r") )*+(?:[dl]['’])?(?:\p{Lu}\.(?= ?\p{Lu})|\p{Lu}(?:['’]\p{Lu})?\p{L}*+(?:[-'’]\p{L}+)*+)"
_HEX = r"(?<=[\"'])[0-9a-fA-F]{32,}+(?=[\"'])|AKIA[0-9A-Z]{16}(?![0-9A-Za-z])"
#: Order matters: at one position the first that matches is taken. Fixed values of formats but for names.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@(?:[A-Za-z0-9-]++\.(?=[A-Za-z0-9]))++[A-Za-z]{2,24}",
    "secret": _HEX + r"|(?<=(?:" + "|".join(KEYWORDS) + r") ?[=:] ?[\"']?)[A-Za-z0-9][A-Za-z0-9+/_.~-]{4,}[A-Za-z0-9]",
    "ip": r"(?<![\p{L}\d.])(?=\d{1,3}\.\d)(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "iban": r"(?<!\p{L})[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\d])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\p{L}\d])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?![\d])|\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d.-])\d{3}([.-])\d{3}\1\d{4}(?![\d-]|\.\d)",
    "card": r"(?<![\p{L}\d])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?![\p{L}\d])",
    "name": r"(?<!\p{L})(?=[MHSFDPгдκ])" + _TITLE + _WORD + r"(?: " + _WORD + r")*+",
}
MARK, MENTION = "\ufdd0", "\ufdd1"


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed, and written in the plan, once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def any_pattern(email: bool = True, keyword: bool = True) -> str:
    """All patterns, or those that a text without @ or without keywords can match.

    An entity starts after anything but an ASCII letter or digit; that test spares most positions all patterns.
    """
    own = PATTERNS | {"secret": PATTERNS["secret"] if keyword else _HEX}
    if not email:
        del own["email"]
    first = r"(?=[0-9A-Za-z+(гдκ])" if email or keyword else r"(?=[0-9A-Za-f+(гдκ])"
    return first + r"(?<![A-Za-z0-9])(?:" + "|".join(own.values()) + ")"


def by_content(text: Column, use) -> Column:
    """``use(pattern)`` with the shortest pattern that finds all of a text's entities."""
    email, keyword = text.contains("@"), reduce(lambda a, b: a | b, [text.contains(k) for k in ("token", "secret", "passw", "apikey", "api_key")])
    return F.when(email & keyword, use(any_pattern())).when(email, use(any_pattern(keyword=False))).when(keyword, use(any_pattern(email=False))).otherwise(use(any_pattern(False, False)))


def marked(text: Column, pattern: Column | str, kind: str = "") -> Column:
    """Gaps and matches of a text in turn (gap, match, gap, ...), by one pass of the pattern."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    return F.split(F.regexp_replace(text, pattern, F.lit(f"{MARK}{kind}$0{MARK}")), MARK, -1)


def parts_of(text: Column) -> Column:
    """Gaps and entities of a text in turn. Texts that hold the mark themselves are cut by two passes."""

    def slow(pattern: str) -> Column:
        found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda v: v)
        gaps = F.split(text, pattern, -1)
        return F.slice(F.flatten(F.zip_with(gaps, found, lambda g, v: F.array(F.coalesce(g, F.lit("")), F.coalesce(v, F.lit(""))))), F.lit(1), F.size(gaps) * 2 - 1)

    return F.when(text.contains(MARK) | text.contains(MENTION), by_content(text, slow)).otherwise(by_content(text, lambda p: marked(text, p)))


def odd(parts: Column) -> Column:
    """The entities of ``parts_of``."""
    return F.filter(parts, lambda v, i: i % 2 == 1)


def kind_of(value: Column) -> Column:
    """The type of a matched value."""
    has = {
        "mention": value.startswith(MENTION),
        "email": value.contains("@"),
        "name": value.rlike("^" + _TITLE),
        "ip": value.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"),
        "iban": value.rlike(r"^[A-Z]{2}\d{2}[ A-Z0-9]+$") & (F.length(F.regexp_replace(value, " ", "")) <= 35),
        "ssn": value.rlike(r"^\d{3}-\d{2}-\d{4}$"),
        "phone": value.rlike(r"^[+(]|^\d{3}[.-]\d{3}[.-]\d{4}$"),
        "card": value.rlike(r"^(\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})$"),
    }
    return reduce(lambda c, k: c.when(has[k], k), has, F.when(F.lit(False), "")).otherwise("secret")


def script_of(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def gender_of(value: Column) -> Column:
    return F.when(value.rlike("^(?:" + "|".join(TITLES["m"]) + r")(?!\p{L})"), "m").when(value.rlike("^(?:" + "|".join(TITLES["f"]) + r")(?!\p{L})"), "f").otherwise("u")


def name_tokens(name: Column) -> Column:
    """Initials, words and what stands between them."""
    return F.regexp_extract_all(name, F.lit(r"\p{Lu}\.|\p{Lu}['’](?=\p{Lu})|\p{L}+|[^\p{L}]+"), F.lit(0))


def is_word(token: Column) -> Column:
    return token.rlike(r"^\p{Lu}\p{L}*$")


def is_initial(token: Column) -> Column:
    return token.rlike(r"^\p{Lu}\.$")


ATOM = "array<struct<type:string,form:string,role:string>>"


def atoms(value: Column) -> Column:
    """(type, canonical form, role) of each part of a value: a name's words, else the value in lower case without separators.

    The role of a name's word: m, f or u for a given name by the title's gender, s for the surname (what follows the
    last space).
    """

    def named(parts: Column) -> Column:
        def words(part: Column, i: Column) -> Column:
            role = F.when(i < F.size(parts) - 1, gender_of(value)).otherwise("s")
            return F.transform(F.filter(name_tokens(part), is_word), lambda w: F.struct(F.lit("name").alias("type"), F.lower(w).alias("form"), role.alias("role")))

        return F.flatten(F.transform(parts, words))

    def typed(kind: Column) -> Column:
        plain = F.when(kind.isin("email", "ip"), F.lower(value)).when(kind.isin("phone", "card", "ssn"), F.regexp_replace(value, r"\D", "")).when(kind == "secret", value).otherwise(F.lower(F.regexp_replace(value, r"[ -]", "")))
        return F.when(kind == "name", let(F.split(F.regexp_replace(value, "^" + _TITLE, ""), " "), named)).otherwise(F.array(F.struct(kind.alias("type"), plain.alias("form"), F.lit("").alias("role")))).cast(ATOM)

    return let(kind_of(value), typed)


def _pick(digest: Column, i: Column, n: int) -> Column:
    """A number below n from the i-th 12 bits of a digest of 128 hexadecimal digits."""
    return F.pmod(F.conv(digest.substr(F.pmod(i * 3, F.lit(126)) + 1, F.lit(3)), 16, 10).cast("int"), F.lit(n))


def luhn_digit(body: Column) -> Column:
    """The check digit that makes ``body`` pass the Luhn test."""
    weighed = F.transform(F.split(F.reverse(body), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
    return F.pmod(-F.aggregate(weighed, F.lit(0), lambda a, d: a + d), F.lit(10)).cast("string")


def iban_digits(country: Column, rest: Column) -> Column:
    """The two check digits of an IBAN in lower case: 98 less the remainder by 97."""
    number = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 87)
    step = lambda r, c: F.pmod(r * F.when(c.rlike("[0-9]"), 10).otherwise(100) + number(c), F.lit(97)).cast("int")
    return F.lpad((98 - F.aggregate(F.split(F.concat(rest, country, F.lit("00")), ""), F.lit(0), step)).cast("string"), 2, "0")


def surrogate(atom: Column, draw: Column, key: str) -> Column:
    """The surrogate of a canonical form; separators of e-mail and IP addresses stay. Later draws may be longer."""

    def drawn(x: Column) -> Column:
        kind, form, draw, digest = x["type"], x["form"], x["draw"], x["digest"]

        def swap(c: Column, i: Column) -> Column:
            letter = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), _pick(digest, i, 26) + 1, F.lit(1))
            hexa = F.substring(F.lit("0123456789abcdef"), _pick(digest, i, 16) + 1, F.lit(1))
            digit = F.when((i == 0) & (c != "0"), _pick(digest, i, 9) + 1).otherwise(_pick(digest, i, 10)).cast("string")
            fixed = (kind == "secret") & form.startswith("AKIA") & (i < 4)
            return F.when(fixed, c).when(x["hex"], hexa).when(c.rlike("[0-9]"), digit).when(c.rlike("[A-Za-z]"), letter).otherwise(c)

        # what is spelled anew: an address's local part, an IBAN without its first four, else all letters and digits
        part = F.when(kind == "email", F.substring_index(form, "@", 1)).when(kind == "iban", F.substring(form, F.lit(5), F.length(form))).otherwise(F.regexp_replace(form, r"[^\p{L}\p{N}]", ""))
        more = F.when(draw > 12, F.rpad(F.lit(""), F.floor((draw - 9) / 4).cast("int"), F.conv(digest.substr(120, 8), 16, 10))).otherwise("")
        swapped = F.concat(F.array_join(F.transform(F.split(part, ""), swap), ""), more)
        octets = F.transform(F.split(form, r"\."), lambda o, i: F.when(draw > 8, _pick(digest, i, 254) + 1).when(F.length(o) == 1, _pick(digest, i, 9) + 1).when(F.length(o) == 2, _pick(digest, i, 90) + 10).otherwise(_pick(digest, i, 156) + 100).cast("string"))
        domain = F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), F.substring_index(form, "@", -1)), 256), 1, 8)
        tables = F.create_map(*[y for k, v in SYLLABLES.items() for y in (F.lit(k), F.array(*[F.lit(z) for z in v]))])
        ends = F.create_map(*[F.lit(y) for k, v in ENDINGS.items() for g, e in v.items() for y in (k + g, e)])

        def named(own: Column) -> Column:
            syllable = lambda j: F.element_at(own, F.pmod(_pick(digest, j * 2 + 1, 4096), F.size(own)) + 1)
            parts = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(draw / 3).cast("int") + 2), syllable), "")
            return F.concat(parts, F.when(x["role"] == "s", syllable(F.lit(17))).otherwise(F.coalesce(ends[F.concat(script_of(form), x["role"])], F.lit(""))))

        def finished(s: Column) -> Column:
            return F.when(kind == "email", F.concat(s, F.lit("@"), domain, F.lit(".example.net"))).when(kind == "iban", F.concat(F.left(form, F.lit(2)), iban_digits(F.left(form, F.lit(2)), s), s)).when(kind == "card", let(F.substring(s, F.lit(1), F.length(s) - 1), lambda body: F.concat(body, luhn_digit(body)))).otherwise(s)

        return F.when(kind == "ip", F.array_join(octets, ".")).when(kind == "name", let(tables[script_of(form)], named)).otherwise(let(swapped, finished))

    def bound(x: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), x["a"]["type"], x["a"]["form"], x["draw"].cast("string")), 512)
        hexadecimal = (x["a"]["type"] == "secret") & x["a"]["form"].rlike("^[0-9a-fA-F]+$")
        return let(F.struct(x["a"]["type"].alias("type"), x["a"]["form"].alias("form"), x["a"]["role"].alias("role"), x["draw"].alias("draw"), digest.alias("digest"), hexadecimal.alias("hex")), drawn)

    return let(F.struct(atom.alias("a"), draw.alias("draw")), bound)


def dress(value: Column, new, key: str) -> Column:
    """A value with its surrogate in its own spelling: its separators, its case and, for names, its title and particles.

    ``new(atom)`` gives the surrogate of an atom.
    """

    def cased(t: Column, own: Column) -> Column:
        return F.when((F.upper(t) == t) & (F.length(t) > 1), F.upper(own)).otherwise(F.initcap(own))

    def token(t: Column) -> Column:
        own = let(new(F.struct(F.lit("name").alias("type"), F.lower(t).alias("form"), F.lit("").alias("role"))), lambda own: cased(t, own))
        initial = F.concat(F.upper(F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), _pick(F.sha2(F.concat_ws("|", F.lit(key), t), 512), F.lit(1), 26) + 1, F.lit(1))), F.lit("."))
        return F.when(is_initial(t), initial).when(~is_word(t), t).otherwise(own)

    def spelled(sur: Column) -> Column:
        def put(acc: Column, c: Column) -> Column:
            one = F.substring(sur, acc["n"] + 1, F.lit(1))
            live = c.rlike(r"[\p{L}\p{N}]")
            return F.struct(F.concat(acc["s"], F.when(~live, c).when(c.rlike(r"\p{Lu}"), F.upper(one)).otherwise(one)).alias("s"), (acc["n"] + live.cast("int")).alias("n"))

        told = F.aggregate(F.split(value, ""), F.struct(F.lit("").alias("s"), F.lit(0).alias("n")), put)
        return let(told, lambda t: F.concat(t["s"], F.substring(sur, t["n"] + 1, F.length(sur))))

    def by_kind(kind: Column) -> Column:
        bare = F.when(kind == "mention", F.substring(value, F.lit(2), F.length(value))).otherwise(F.regexp_replace(value, "^" + _TITLE, ""))
        named = F.concat(F.when(kind == "name", F.regexp_extract(value, "^" + _TITLE, 0)).otherwise(""), F.array_join(F.transform(name_tokens(bare), token), ""))
        plain = let(new(F.element_at(atoms(value), 1)), lambda sur: let(F.when(kind.isin("ip", "email"), sur).otherwise(spelled(sur)), lambda s: F.when(F.upper(value) == value, F.upper(s)).otherwise(s)))
        return F.when(kind.isin("name", "mention"), named).otherwise(plain)

    return let(kind_of(value), by_kind)


def found_values(text: Column) -> Column:
    """The distinct entities of a text."""
    return F.array_distinct(by_content(text, lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(0))))


def entities(values: DataFrame) -> DataFrame:
    """(type, form, role, roles) of the input's entities: the role of a name in the whole input, and how many it has.

    A name that is both a man's and a woman's has role u; one that is a given name anywhere is one everywhere.
    """
    found = values.select("value").distinct().select(F.explode(atoms(F.col("value"))).alias("atom")).select("atom.*").distinct()
    has = lambda r: F.bool_or(F.col("role") == r)
    m, f, u, s = (has(r) for r in "mfus")
    role = F.when(m & ~f, "m").when(f & ~m, "f").when(m | u, "u").when(s, "s").otherwise("")
    return found.groupBy("type", "form").agg(role.alias("role"), F.count(F.lit(1)).alias("roles"))


def told_apart(found: DataFrame, key: str) -> DataFrame:
    """(type, form, role, roles, draw): draws are raised until surrogates are distinct; the checks are distributed joins."""
    table = cut(found.withColumn("draw", F.lit(0)))
    while True:
        table = table.withColumn("new", surrogate(F.struct("type", "form", "role"), F.col("draw"), key))
        taken = table.select("type", F.col("form").alias("new"), F.lit(True).alias("real")).distinct()
        rank = F.row_number().over(Window.partitionBy("type", "new").orderBy("draw", "form"))
        checked = table.join(taken, ["type", "new"], "left").withColumn("again", F.col("real").isNotNull() | (rank > 1))
        table = cut(checked.select("type", "form", "role", "roles", (F.col("draw") + F.col("again").cast("int")).alias("draw"), "again"))
        if not table.where("again").limit(1).count():
            return table.drop("again")
        table = table.drop("again")


def replace_pii(docs: DataFrame, key: str = "surrogates-1", text_col: str = "text", salts: int = 16) -> DataFrame:
    """``docs`` with the text's entities replaced, plus ``pii_types`` (type of each entity, in order; empty where none).

    Null texts stay null and have no entities; texts without entities come back as they were; texts may have any length.
    All other columns pass, under any names (where ``docs`` has ``pii_types`` the new column gets an underscore more);
    rows may repeat. An empty table gives an empty table. Documents are only joined when some name has several roles or
    a surrogate was drawn again.
    """
    plain, (own,) = hidden(docs, text_col)
    text = F.coalesce(F.col(own).cast("string"), F.lit(""))
    # one row a distinct entity of a text
    held = cut(plain.select(F.sha2(text, 256).alias("digest"), found_values(text).alias("values")).where(F.size("values") > 0).select("digest", F.explode("values").alias("value")).distinct())
    odd_ones = cut(told_apart(entities(held), key).where("draw > 0 or roles > 1").drop("roles"))
    rows = plain.withColumn("_p_parts", parts_of(text))
    local = F.flatten(F.transform(odd(F.col("_p_parts")), lambda v: F.filter(atoms(v), lambda a: a["type"] == "name")))
    rows = rows.withColumn("_p_names", local)
    if odd_ones.limit(1).count():
        needed = held.select("digest", F.explode(atoms(F.col("value"))).alias("a")).select("digest", "a.type", "a.form").distinct().join(odd_ones, ["type", "form"])
        maps = needed.groupBy("digest").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "type", "form"), F.struct("draw", "role")))).alias("_p_told"))
        maps = maps.withColumn("_p_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumnRenamed("digest", "_p_digest")
        some = [c for c, t in plain.dtypes if "map" not in t and "variant" not in t]
        rows = rows.withColumn("_p_digest", F.sha2(text, 256)).withColumn("_p_salt", F.pmod(F.xxhash64(*some), F.lit(salts)).cast("int")).join(maps, ["_p_digest", "_p_salt"], "left")
        told = lambda a: F.col("_p_told")[F.concat_ws("|", a["type"], a["form"])]
        draw, corpus_role = (lambda a: F.coalesce(told(a)["draw"], F.lit(0))), (lambda a: told(a)["role"])
    else:
        draw, corpus_role = (lambda a: F.lit(0)), (lambda a: F.lit(None).cast("string"))

    def new(atom: Column) -> Column:
        def known(a: Column) -> Column:
            # a name that isn't odd has one role in all documents, so this document's is it
            own_role = F.get(F.filter("_p_names", lambda n: n["form"] == a["form"]), F.lit(0))["role"]
            role = F.when(a["type"] == "name", F.coalesce(corpus_role(a), own_role)).otherwise("")
            return surrogate(F.struct(a["type"].alias("type"), a["form"].alias("form"), role.alias("role")), draw(a), key)

        return let(atom, known)

    spelled = F.array_distinct(F.flatten(F.transform(odd(F.col("_p_parts")), lambda v: F.when(kind_of(v) == "name", F.filter(name_tokens(F.regexp_replace(v, "^" + _TITLE, "")), lambda t: is_word(t) & (F.length(t) > 2))).otherwise(F.array().cast("array<string>")))))
    words = F.array_join(F.array_distinct(F.concat(spelled, F.transform(spelled, F.upper))), "|")
    mention = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), words, F.lit(r")(?:[ -](?:"), words, F.lit(r"))*+(?![\p{L}\p{N}])"))
    finer = F.flatten(F.transform("_p_parts", lambda p, i: F.when(i % 2 == 1, F.array(p)).otherwise(marked(p, F.col("_p_mention"), MENTION))))
    rows = rows.withColumn("_p_mention", F.when(F.size("_p_names") > 0, mention)).withColumn("_p_parts", F.when(F.length("_p_mention") > 80, finer).otherwise(F.col("_p_parts")))
    whole = F.array_join(F.transform("_p_parts", lambda p, i: F.when(i % 2 == 1, dress(p, new, key)).otherwise(p)), "")
    kinds = F.transform(odd(F.col("_p_parts")), lambda v: F.regexp_replace(kind_of(v), "mention", "name"))
    out = rows.withColumn("_p_types", kinds).withColumn(own, F.when(F.size("_p_parts") > 1, whole).otherwise(F.col(own)))
    return restored(out, docs, pii_types="_p_types")
