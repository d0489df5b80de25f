"""Surrogates for personal data: keyed, consistent replacements of the same kind; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, shielded

#: Titles that announce a name, by the gender they tell.
_FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Srta", "Doña", "г-жа", "Госпожа")
_MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Don", "г-н", "Господин")
_NEUTRAL = ("Dr", "Prof", "Mx")
_TITLES = "|".join(_FEMALE + _MALE + _NEUTRAL)
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Letters and digits in a lookbehind. The letter beyond 16 bits makes Java look back by whole characters; else each place
#: after such a letter would be tried as a start.
_WORD = "\\p{L}\\p{N}\U00010400"
#: Country codes of phone numbers (fixed values); codes that begin otherwise have three digits.
_COUNTRY = r"^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: Kinds in the order in which they are tried at a place. No group repeats without a bound, as each repetition takes
#: stack: a mail domain has 127 labels at the most, which is the limit of domain names.
PATTERNS = {
    "email": rf"(?<![{_WORD}._%+-])[\p{{L}}\p{{N}}._%+-]++@[\p{{L}}\p{{N}}-]+(?:\.[\p{{L}}\p{{N}}-]+){{0,125}}\.\p{{L}}{{2,}}",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "iban": rf"(?<![{_WORD}])" + r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": rf"(?<![{_WORD}+])(?:\+(?=(?:[ .()-]{{0,3}}\d){{7,15}}(?!\d))\d{{1,3}}(?:[ .-]?\(\d{{1,5}}\))?(?:[ .-]?(?!(?<!\d)\d{{4}}(?:[ -]?\d{{4}}){{3}})(?!(?<!\d)(?:{_OCTET}\.){{3}}{_OCTET}(?!\d))\d){{3,14}}|\(\d{{3,5}}\) ?\d{{3,4}}[ .-]?\d{{3,4}}|\d{{3}}[ .-]\d{{3}}[ .-]\d{{4}})(?!\d|[.]\d)",
    "card": rf"(?<!\d)(?:\d(?:[ -]?(?!(?<!\d)(?:{_OCTET}\.){{3}}{_OCTET}(?!\d))\d){{12,18}}(?![ -]?\d)|\d{{4}}(?:[ -]?\d{{4}}){{3}}|\d{{4}}[ -]?\d{{6}}[ -]?\d{{5}}|\d{{13,19}})(?!\d)",
    "name": rf"(?<![{_WORD}])(?:{_TITLES})\.? \p{{Lu}}[\p{{L}}'-]+(?: \p{{Lu}}[\p{{L}}'-]+)?",
}
KINDS = tuple(PATTERNS)
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What a text must hold to have any entity.
_HINT = rf"[0-9@]|(?:{_TITLES})\.? \p{{Lu}}"
_LATIN = ("ba", "de", "fi", "go", "lu", "ma", "ne", "ri", "so", "tu", "va", "ke", "li", "mo", "pa", "ze")
_CYRILLIC = ("ба", "де", "фи", "го", "лу", "ма", "не", "ри", "со", "ту", "ва", "ке", "ли", "мо", "па", "зе")
_ROUNDS = 4
#: Entities of a task.
PER_TASK = 4096


def kind_of(x: Column) -> Column:
    """Which kind a match is; the first whose whole pattern it fits."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(x.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def _number(key: str, *parts: Column) -> Column:
    """48 keyed bits."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *parts), 256), 1, 12), 16, 10).cast("long")


def permute_digits(digits: Column, key: str) -> Column:
    """A keyed permutation of the strings of so many digits (a Feistel network of additions); up to 36 digits."""
    size = F.length(digits)
    a = F.floor(size / 2).cast("int")
    b = size - a

    def add(to: Column, tag: str, by: Column, n: Column) -> Column:
        total = to + _number(f"{key}|{tag}", size.cast("string"), by.cast("string"))
        return F.when(n > 0, F.pmod(total, F.rpad(F.lit("1"), n + 1, F.lit("0")).cast("long"))).otherwise(F.lit(0).cast("long"))

    left = F.when(a > 0, F.substring(digits, F.lit(1), a)).otherwise("0").cast("long")
    right = F.when(b > 0, F.substring(digits, a + 1, b)).otherwise("0").cast("long")
    state = F.struct(left.alias("l"), right.alias("r"))
    for k in range(_ROUNDS):
        state = _bind(state, lambda s, k=k: F.struct(add(s["l"], f"{k}l", s["r"], a).alias("l"), s["r"].alias("r")))
        state = _bind(state, lambda s, k=k: F.struct(s["l"].alias("l"), add(s["r"], f"{k}r", s["l"], b).alias("r")))
    digit = lambda x, n: F.when(n > 0, F.lpad(x.cast("string"), n, F.lit("0"))).otherwise("")
    return _bind(state, lambda s: F.concat(digit(s["l"], a), digit(s["r"], b)))


def permute_long(digits: Column, key: str) -> Column:
    """A keyed permutation of strings of digits of any length: blocks of 36 are permuted one by one."""
    blocks = F.sequence(F.lit(0), F.floor((F.length(digits) - 1) / 36).cast("int"))
    return F.array_join(F.transform(blocks, lambda i: permute_digits(F.substring(digits, i * 36 + 1, F.lit(36)), key)), "")


def _bind(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), lambda v: use(v)), 1)


def _refill(x: Column, digits: Column) -> Column:
    """x with its digits replaced by those of digits, in turn."""
    chars = F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.when(F.substring(x, i, F.lit(1)).rlike("[0-9]"), F.substring(digits, F.length(F.regexp_replace(F.substring(x, F.lit(1), i), "[^0-9]", "")), F.lit(1))).otherwise(F.substring(x, i, F.lit(1))))
    return F.array_join(chars, "")


def _luhn_check(body: Column) -> Column:
    """The digit that makes body valid."""
    total = F.aggregate(
        F.transform(F.sequence(F.lit(1), F.length(body)), lambda i: _bind(F.substring(body, -i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1), lambda v: F.when(v > 9, v - 9).otherwise(v))),
        F.lit(0), lambda s, v: s + v,
    )
    return F.pmod(F.lit(10) - F.pmod(total, F.lit(10)), F.lit(10))


def _card(digits: Column, key: str) -> Column:
    """Permutes all but the last digit, which stays as far from the check digit as it was."""
    body, last = F.substring(digits, F.lit(1), F.length(digits) - 1), F.substring(digits, F.length(digits), F.lit(1)).cast("int")
    off = last - _luhn_check(body)
    return _bind(permute_digits(body, key), lambda p: F.concat(p, F.pmod(_luhn_check(p) + off, F.lit(10)).cast("string")))


def _pseudo_word(word: Column, ending: Column, key: str, syllables: int) -> Column:
    """A made-up word in the word's script and case, with an ending."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("name"), F.lower(word)), 256)
    cyrillic = word.rlike(r"\p{IsCyrillic}")
    pick = lambda table, i: F.element_at(F.array(*[F.lit(s) for s in table]), F.conv(F.substring(digest, i, F.lit(1)), 16, 10).cast("int") + 1)
    body = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(syllables)), lambda i: F.when(cyrillic, pick(_CYRILLIC, i)).otherwise(pick(_LATIN, i))), "")
    whole = F.concat(body, ending)
    return F.when((F.length(word) > 1) & (word == F.upper(word)), F.upper(whole)).when(word == F.lower(word), whole).otherwise(F.initcap(whole))


def _name(x: Column, key: str, syllables: int) -> Column:
    """Title and made-up words. A given name ends as the title's gender has it; a family name is the same for all who bear
    it, but for a Cyrillic one, which is inflected."""
    title = F.regexp_extract(x, rf"^((?:{_TITLES})\.?) ", 1)
    bare = F.regexp_replace(title, r"\.", "")
    female, male = bare.isin(*_FEMALE), bare.isin(*_MALE)
    words = F.split(F.substring(x, F.length(title) + 2, F.length(x)), " ")

    def word(w: Column, i: Column) -> Column:
        cyrillic, family = w.rlike(r"\p{IsCyrillic}"), i == F.size(words) - 1
        given = F.when(female, F.when(cyrillic, "на").otherwise("na")).when(male, F.when(cyrillic, "н").otherwise("n")).otherwise(F.when(cyrillic, "со").otherwise("so"))
        stem = F.when(cyrillic & family & female, F.regexp_replace(w, "(?<=[оеёи][вн])[аА]$", "")).otherwise(w)  # -ова, -ева, -ина
        ending = F.when(~family, given).when(~cyrillic, F.lit("")).when(female, F.lit("ова")).otherwise(F.lit("ов"))
        return _pseudo_word(stem, ending, key, syllables)

    return F.concat_ws(" ", title, F.array_join(F.transform(words, word), " "))


def _email(x: Column, key: str, syllables: int) -> Column:
    """Made-up words and permuted digits between the separators of the local part; a domain of its own, under .example."""
    local, domain = F.substring_index(F.lower(x), "@", 1), F.substring_index(F.lower(x), "@", -1)
    whole = F.sha2(F.concat_ws("|", F.lit(key), local, domain), 256)
    run = lambda w: F.when(w.rlike("^[0-9]+$"), permute_long(w, f"{key}|mail")).when(w.rlike(r"^[\p{L}\p{M}]+$"), _pseudo_word(F.concat(w, whole), F.lit(""), key, syllables)).otherwise(w)
    parts = F.regexp_extract_all(local, F.lit(r"[0-9]+|[\p{L}\p{M}]+|[^\p{L}\p{M}0-9]+"), F.lit(0))
    return F.concat(F.array_join(F.transform(parts, run), ""), F.lit("@"), _pseudo_word(domain, F.lit(""), key, syllables), F.lit(".example"))


def _iban(x: Column, key: str) -> Column:
    """Permuted digits after the country and its check digits, which stay as far from the valid ones as they were."""
    plain = F.regexp_replace(x, " ", "")

    def valid(account: Column) -> Column:
        letters = F.concat(account, F.substring(plain, 1, 2), F.lit("00"))
        value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
        rest = F.aggregate(F.split(letters, ""), F.lit(0), lambda s, c: F.pmod(s * F.when(c.rlike("[0-9]"), 10).otherwise(100) + F.coalesce(value(c), F.lit(0)), F.lit(97)))
        return F.lit(98) - rest

    account = F.substring(plain, F.lit(5), F.length(plain))
    digits = F.regexp_replace(account, "[^0-9]", "")
    made = _refill(account, permute_digits(digits, f"{key}|iban"))
    off = F.substring(plain, 3, 2).cast("int") - valid(account)
    check = _bind(made, lambda m: F.lpad((F.pmod(valid(m) + off - 2, F.lit(97)) + 2).cast("string"), 2, "0"))
    return _bind(F.concat(check, F.regexp_replace(made, "[^0-9]", "")), lambda d: _refill(x, d))


def surrogate(x: Column, kind: Column, key: str, syllables: int) -> Column:
    """The replacement of entity x."""
    digits = F.regexp_replace(x, "[^0-9]", "")
    country = F.when(x.startswith("+"), F.regexp_extract(digits, _COUNTRY, 1)).otherwise("")
    phone = _refill(x, F.concat(country, permute_digits(F.substring(digits, F.length(country) + 1, F.length(digits)), f"{key}|phone")))
    value = F.aggregate(F.split(x, r"\."), F.lit(0).cast("long"), lambda s, o: s * 256 + o.cast("long"))
    half = _bind(value, lambda v: F.struct(F.shiftright(v, 16).alias("l"), v.bitwiseAND(F.lit(65535).cast("long")).alias("r")))
    for k in range(_ROUNDS):
        half = _ip_round(half, key, k)
    ip = _bind(half, lambda s: F.concat_ws(".", *[F.shiftright(s[p], n).bitwiseAND(F.lit(255).cast("long")).cast("string") for p in ("l", "r") for n in (8, 0)]))
    out = F.when(kind == "email", _email(x, key, syllables)).when(kind == "ip", ip).when(kind == "phone", phone).when(kind == "card", _refill(x, _card(digits, f"{key}|card"))).when(kind == "name", _name(x, key, syllables)).when(kind == "iban", _iban(x, key))
    return out.otherwise(_refill(x, permute_digits(digits, f"{key}|id")))


def _ip_round(half: Column, key: str, k: int) -> Column:
    def left(s: Column) -> Column:
        return F.struct(F.pmod(s["l"] + _number(f"{key}|ip{k}l", s["r"].cast("string")), F.lit(65536)).alias("l"), s["r"].alias("r"))

    def right(s: Column) -> Column:
        return F.struct(s["l"].alias("l"), F.pmod(s["r"] + _number(f"{key}|ip{k}r", s["l"].cast("string")), F.lit(65536)).alias("r"))

    return _bind(_bind(half, left), right)


def _canonical(x: Column, kind: Column) -> Column:
    """What two mentions of one entity share."""
    return F.when(kind.isin("email", "name"), F.lower(x)).when(kind.isin("phone", "card", "iban"), F.regexp_replace(x, "[^0-9A-Z+]", "")).otherwise(x)


@shielded
def replace_entities(docs: DataFrame, key: str, text_col: str = "text", keep: list[str] | None = None, syllables: int = 4, most_draws: int = 6) -> DataFrame:
    """Columns of keep (all by default), __text (with surrogates) and __entities (kind, number) for each row.

    Digits are permuted with the key within their format (so distinct numbers stay distinct), a card's check digit
    stays as valid as it was, and a phone's country code stays, however the number is written; addresses of one mail domain share a domain, and keep
    the local part's separators; a name
    after a title keeps title, gender and script, and bearers of a family name share its surrogate; IBAN check digits
    stay as valid as they were. Mentions of one entity share a surrogate in all documents.

    All surrogates are compared before use: if two entities share one, or an address or name equals a true one, all are
    drawn anew under the next key and with longer names, until none does. (Numbers are permuted among themselves, so in
    a large corpus some equal another entity's true number; that is not held against a draw.)

    Nulls: a null text stays null with no entities. Repeated rows are alike. An empty table gives no rows.
    """
    keep = docs.columns if keep is None else keep
    text = F.col(f"`{text_col}`")
    found = F.when(text.rlike(_HINT), F.regexp_extract_all(text, F.lit(_ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    known = docs.select(F.explode(F.array_distinct(found)).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    known = known.select("x", kind_of(F.col("x")).alias("kind"))
    known = cut(known.select("kind", _canonical(F.col("x"), F.col("kind")).alias("who"), "x"))
    n = known.count()
    known = known.repartition(max(1, -(-n // PER_TASK)), "x")  # small rows, but each takes many steps
    syllables = max(syllables, -(-(2 * n.bit_length() + 6) // 4))  # so that few are alike
    for draw in range(most_draws):
        drawn, long = f"{key}|{draw}", min(60, syllables + 3 * draw)
        made = known.withColumn("s", surrogate(F.col("x"), F.col("kind"), drawn, long))
        shared = made.groupBy(F.lower("s").alias("s")).agg(F.min("who").alias("a"), F.max("who").alias("b")).filter("a <> b").limit(1).count()
        if not shared and not made.filter("kind IN ('email', 'name')").select("s").join(known.select(F.col("x").alias("s")), "s", "left_semi").limit(1).count():
            break
    else:
        raise RuntimeError(f"surrogates collide after {most_draws} draws")
    d = docs.select(*[F.col(f"`{c}`") for c in keep], text.alias("__t"), found.alias("__found"))
    d = d.withColumn("__kinds", F.transform("__found", kind_of))
    pieces = F.split(F.col("__t"), _ANY, -1)
    put = F.zip_with("__found", "__kinds", lambda x, k: surrogate(x, k, drawn, long))
    d = d.withColumn("__pieces", F.when(F.size("__found") > 0, pieces)).withColumn("__put", put)
    whole = F.array_join(F.zip_with("__pieces", F.concat("__put", F.array(F.lit(""))), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    counts = F.create_map(*[c for k in KINDS for c in (F.lit(k), F.expr(f"cast(size(filter(__kinds, x -> x = '{k}')) AS long)"))])
    return d.select(*[F.col(f"`{c}`") for c in keep], F.when(F.size("__found") > 0, whole).otherwise(F.col("__t")).alias("__text"), counts.alias("__entities"))
