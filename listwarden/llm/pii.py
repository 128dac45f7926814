"""Pseudonyms for personal data that keep the format, by keyed Feistel permutations.

Validated numbers and dates are permuted within their own format: a card number becomes another
number that passes the same check digit, a date another date of the calendar, a phone number
another one with the same punctuation. The permutation depends on the key and the kind only, so
equal values get equal pseudonyms in every document, and different values different ones.
DataFrame functions only: every match is found, permuted and put back inside the JVM.

| kind  | accepted if | permuted |
| ----- | ----------- | -------- |
| email | has a dotted domain | letters and digits of the local part, class by class |
| card  | 13 to 19 digits, first 3 to 6 or 2, Luhn; in fours, 4-6-5, 4-6-4, 6-13 or one run | all digits but the first; check digit made anew |
| iban  | length of its country, remainder 1 modulo 97 | letters and digits of the account; check digits made anew |
| ssn   | area, group and serial are issued ones | the three fields, among issued values |
| phone | +, 8 to 15 digits; or (AAA) BBB-CCCC, AAA-BBB-CCCC | digits after the country code |
| ip    | four octets of 0 to 255 | all 32 bits |
| date  | day of the calendar, 1900 to 2099 | the day number |
| secret | value with a digit after password, token, secret, key =; or an access key id | letters and digits, class by class |

Dates are yyyy-mm-dd, yyyy/mm/dd, mm/dd/yyyy and dd.mm.yyyy (with dashes, day first); the same day
in two formats stays the same day. A match that fails its check is left as it is, and does not hide
another one that begins within it or at the same place. A secret before the @ of an address is part of the address.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Characters of an IBAN by country, from the public registry and its usual additions.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
    21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR",
    27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD", 28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_LISTED = "|".join(codes.replace(" ", "|") for codes in IBAN_LENGTHS.values())
_BY_COUNTRY = "|".join(
    rf"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, codes in IBAN_LENGTHS.items())
# No label is empty. What is repeated has one length, as the matcher goes through other groups by recursion.
_DOMAIN = r"@(?:[A-Za-z0-9.-](?<![.@]\.))*(?<![.@])\.[A-Za-z]{2,}"
# An address begins with the first letter or digit of a run: what begins later ends at the same place.
_LOCAL = r"[A-Za-z0-9](?:(?<![._%+-].)|(?<![A-Za-z0-9][._%+-]{1,64}.))[A-Za-z0-9._%+-]*+"
#: Patterns of the candidates by kind; all are tried in this order at each place of a text.
PATTERNS = {
    "email": [_LOCAL + _DOMAIN],
    "secret": [
        r"(?i:password|passwd|token|secret|api_?key)\s{0,3}[=:]\s{0,3}[\"']?(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{8,}+(?!" + _DOMAIN + ")",
        r"\bAKIA[A-Z0-9]{16}\b",
    ],
    # of countries without a known length, the longest run and the run without blanks
    "iban": [rf"(?:{_BY_COUNTRY})\b", rf"(?!{_LISTED})[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{11,30}}\b",
             rf"(?!{_LISTED})[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}\b"],
    "ip": [r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])"],
    "date": [r"(?<![0-9.\/-])(?:[0-9]{4}[-\/][0-9]{2}[-\/][0-9]{2}|[0-9]{2}[-.\/][0-9]{2}[-.\/][0-9]{4})(?![0-9]|[-\/.][0-9])"],
    "ssn": [r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"],
    "phone": [
        r"\+1(?:[ .()-]{0,2}[0-9]){10}(?![0-9])|\+[0-9](?:[ .()-]{0,2}[0-9]){7,14}(?![0-9])",
        r"(?<![0-9])(?:\([0-9]{3}\) ?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9-])",
    ],
    # groups of four up to 19 digits, up to 16 digits or with a long last group, 4-6-5 and 4-6-4, 6-13
    "card": [
        r"(?<![0-9.])[2-6][0-9]{3}(?:[ -]?[0-9]{4}){3}[ -][0-9]{1,3}(?![0-9])",
        r"(?<![0-9.])[2-6][0-9]{3}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9])",
        r"(?<![0-9.])[2-6][0-9]{3}[ -]?[0-9]{6}[ -]?[0-9]{4,5}(?![0-9])",
        r"(?<![0-9.])[2-6][0-9]{5}[ -][0-9]{13}(?![0-9])",
    ],
}
_FORMS = [(kind, form) for kind, forms in PATTERNS.items() for form in forms]
#: What a text with a candidate of a form has, in the order of the forms: others are not searched for it.
_HINTS = [
    "@", "[=:]", "AKIA", *["[A-Z]{2}[0-9]{2}"] * 3, r"[0-9]\.[0-9]{1,3}\.[0-9]", r"[0-9][-.\/][0-9]{2}[-.\/][0-9]", "[0-9]-[0-9]{2}-[0-9]",
    r"\+", "[0-9]{3}[-.][0-9]{4}", *["[2-6][0-9]{3}[ -]?[0-9]{4}"] * 3, "[2-6][0-9]{5}[ -][0-9]{13}",
]
#: Kinds by the first character of their candidates.
_STARTS = {"[A-Za-z]": ("email", "secret", "iban"), "[0-9]": ("email", "ip", "date", "ssn", "phone", "card"), "[+(]": ("phone",)}
#: The places before candidates, which overlap. All start a run of letters and digits, or with a sign before one.
EVERY = "(?=[A-Za-z0-9+(])(?<![A-Za-z0-9])(?=" + "|".join(
    f"(?={start})(?:" + "|".join(f"(?:{form})" for kind, form in _FORMS if kind in kinds) + ")" for start, kinds in _STARTS.items()) + ")"
#: Candidates that the taking of places goes through at once.
_BLOCK = 256


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), where the value is computed once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _mod(x: Column, m: Column) -> Column:
    return F.pmod(x, m)


def _pad(n: Column, width: Column | int) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def _round(key: str, kind: str, r: Column, half: Column) -> Column:
    """Keyed hash of a half as a number of 60 bits."""
    digest = F.sha2(F.concat(F.lit(f"{key}|{kind}|"), r.cast("string"), F.lit("|"), half.cast("string")), 256)
    return F.conv(F.left(digest, F.lit(15)), 16, 10).cast("long")


def permute_pair(a: Column, b: Column, size_a: Column, size_b: Column, key: str, kind: str) -> Column:
    """Feistel permutation of Z_size_a x Z_size_b: a struct of a and b."""
    def step(s: Column, r: Column) -> Column:
        even = r % 2 == 0
        return F.struct(
            F.when(even, _mod(s.a + _round(key, kind, r, s.b) % size_a, size_a)).otherwise(s.a).alias("a"),
            F.when(even, s.b).otherwise(_mod(s.b + _round(key, kind, r, s.a) % size_b, size_b)).alias("b"),
        )
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def permute_digits(digits: Column, key: str, kind: str) -> Column:
    """Permutation of the strings of as many digits, up to 36."""
    n = F.length(digits)
    cut = F.floor(n / 2).cast("int")
    a, b = F.substring(digits, F.lit(1), cut), F.substr(digits, cut + 1)
    power = lambda k: F.pow(F.lit(10.0), k).cast("long")  # noqa: E731  exact up to 10^15
    number = lambda s: F.coalesce(s.cast("long"), F.lit(0))
    return _let(permute_pair(number(a), number(b), power(cut), power(n - cut), key, kind), lambda out: F.concat(
        F.when(cut > 0, _pad(out.a, cut)).otherwise(F.lit("")), F.when(n > 0, _pad(out.b, n - cut)).otherwise(F.lit(""))
    ))


#: The classes of characters that stay within themselves.
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def permute_text(text: Column, key: str, kind: str) -> Column:
    """Permutation of strings in which each letter or digit stays in its class, and the rest as it is.

    Letters of a string of hexadecimal digits stay below g. The halves take turns: to each
    character of one half a keyed hash of the other half is added within the class.
    """
    cut = F.floor(F.length(text) / 2).cast("int")
    hexadecimal = F.when(text.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), F.lit(6)).otherwise(F.lit(26))

    def turned(c: Column, amount: Column, letters: Column) -> Column:
        out = c
        for members, size in ((_LOWER, letters), (_UPPER, letters), (_DIGITS, F.lit(10))):
            place = F.instr(F.lit(members), c) - 1
            moved = F.substr(F.lit(members), (_mod(place + amount, size) + 1).cast("int"), F.lit(1))
            out = F.when(place >= 0, moved).otherwise(out)
        return out

    def shifted(half: Column, other: Column, r: Column, letters: Column) -> Column:
        # what all blocks depend on is computed once, and the other half read once
        seed = F.sha2(F.concat(F.lit(f"{key}|{kind}|"), r.cast("string"), F.lit("|"), other), 256)
        amounts = lambda found: F.flatten(F.transform(found, lambda block: F.transform(
            F.sequence(F.lit(1), F.lit(61), F.lit(4)), lambda at: F.conv(F.substr(block, at, F.lit(4)), 16, 10).cast("long"))))
        blocks = _let(seed, lambda s: F.transform(
            F.sequence(F.lit(0), F.floor(F.length(half) / 16).cast("int")), lambda b: F.sha2(F.concat(s, b.cast("string")), 256)))
        chars = F.filter(F.split(half, ""), lambda c: c != "")
        return _let(blocks, lambda found: _let(amounts(found), lambda a: F.array_join(
            F.transform(chars, lambda c, i: _let(F.get(a, i), lambda amount: turned(c, amount, letters))), "")))

    def rounds(letters: Column) -> Column:
        def step(s: Column, r: Column) -> Column:
            even = r % 2 == 0
            return F.struct(
                F.when(even, shifted(s.a, s.b, r, letters)).otherwise(s.a).alias("a"),
                F.when(even, s.b).otherwise(shifted(s.b, s.a, r, letters)).alias("b"),
            )
        start = F.struct(F.substring(text, F.lit(1), cut).alias("a"), F.substr(text, cut + 1).alias("b"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda out: F.concat(out.a, out.b))

    return _let(hexadecimal, rounds)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _refill(shape: Column, digits: Column) -> Column:
    """Put digits in the places of the digits of shape, whose other characters stay."""
    return _let(digits, lambda d: _filled(shape, d))


def _filled(shape: Column, digits: Column) -> Column:
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(s: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        return F.struct(
            F.concat(s.out, F.when(is_digit, F.substr(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"),
            (s["at"] + F.when(is_digit, 1).otherwise(0)).alias("at"),
        )
    return F.aggregate(F.filter(F.split(shape, ""), lambda c: c != ""), start, step, lambda s: s.out)


def _luhn(digits: Column) -> Column:
    """Luhn sum of the digits, the last of which has weight one, modulo 10."""
    each = F.transform(
        F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(each, F.lit(0), lambda s, d: s + d) % 10


def _mod97(text: Column) -> Column:
    """Remainder modulo 97 of an account: letters count as 10 to 35."""
    def step(s: Column, c: Column) -> Column:
        letter = F.instr(F.lit(_UPPER), c)
        return F.when(letter > 0, s * 100 + letter + 9).otherwise(s * 10 + F.coalesce(c.try_cast("int"), F.lit(0))) % 97
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), step)


def _email(m: Column, key: str) -> Column:
    at = F.instr(m, "@")
    return F.concat(permute_text(F.substr(m, F.lit(1), at - 1), key, "email"), F.substr(m, at))


def _secret(m: Column, key: str) -> Column:
    value = F.regexp_extract(m, r"[A-Za-z0-9+/_-]+$", 0)
    head = F.when(m.startswith("AKIA"), F.lit("AKIA")).otherwise(F.left(m, F.length(m) - F.length(value)))
    fresh = F.concat(head, permute_text(F.substr(m, F.length(head) + 1), key, "secret"))
    return F.when(m.startswith("AKIA") | value.rlike("[0-9]"), fresh)


def _iban(m: Column, key: str) -> Column:
    plain = F.replace(m, F.lit(" "), F.lit(""))
    country, account = F.left(plain, F.lit(2)), F.substr(plain, F.lit(5))
    other = permute_text(account, key, "iban")
    valid = F.length(plain).between(15, 34) & (_mod97(F.concat(account, F.left(plain, F.lit(4)))) == 1)
    whole = _let(other, lambda o: F.concat(country, _pad(98 - _mod97(F.concat(o, country, F.lit("00"))), 2), o))
    return F.when(valid, _let(whole, lambda w: _spread(m, w)))


def _spread(m: Column, whole: Column) -> Column:
    """The characters of whole, with blanks where m has them."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    def step(s: Column, c: Column) -> Column:
        blank = c == " "
        return F.struct(
            F.concat(s.out, F.when(blank, c).otherwise(F.substr(whole, s["at"], F.lit(1)))).alias("out"),
            (s["at"] + F.when(blank, 0).otherwise(1)).alias("at"),
        )
    return F.aggregate(F.filter(F.split(m, ""), lambda c: c != ""), start, step, lambda s: s.out)


def _ip(m: Column, key: str) -> Column:
    o = [F.split_part(m, F.lit("."), F.lit(i)).cast("int") for i in (1, 2, 3, 4)]
    size = F.lit(65536)
    fresh = _let(permute_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], size, size, key, "ip"), lambda out: F.concat_ws(
        ".", *[x.cast("string") for h in (out.a, out.b) for x in (F.shiftright(h, 8), h % 256)]))
    return F.when((o[0] < 256) & (o[1] < 256) & (o[2] < 256) & (o[3] < 256), fresh)


def _date(m: Column, key: str) -> Column:
    d, year_first = _digits(m), m.rlike("^[0-9]{4}")
    month_first = m.rlike("^[0-9]{2}/")
    part = lambda i, n: F.substr(d, F.lit(i), F.lit(n))
    iso = F.when(year_first, F.concat_ws("-", part(1, 4), part(5, 2), part(7, 2))).when(
        month_first, F.concat_ws("-", part(5, 4), part(1, 2), part(3, 2))
    ).otherwise(F.concat_ws("-", part(5, 4), part(3, 2), part(1, 2)))
    first, days = F.lit("1900-01-01").cast("date"), 73049  # to 2099-12-31: 17 * 4297 days
    day = F.datediff(iso.try_cast("date"), first)
    fresh = _let(permute_pair(F.floor(day / 4297), day % 4297, F.lit(17), F.lit(4297), key, "date"),
                 lambda out: F.date_add(first, (out.a * 4297 + out.b).cast("int")))
    shown = F.when(year_first, F.date_format(fresh, "yyyyMMdd")).when(
        month_first, F.date_format(fresh, "MMddyyyy")).otherwise(F.date_format(fresh, "ddMMyyyy"))
    return F.when(day.between(0, days - 1), _refill(m, shown))


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = F.left(m, F.lit(3)).cast("int"), F.substr(m, F.lit(5), F.lit(2)).cast("int"), F.substr(m, F.lit(8)).cast("int")
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    pair = permute_pair(area - 1 - F.when(area > 666, 1).otherwise(0), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, "ssn")
    return F.when(valid, _let(pair, lambda out: F.concat_ws(
        "-", _pad(out.a + 1 + F.when(out.a >= 665, 1).otherwise(0), 3), _pad(F.floor(out.b / 9999) + 1, 2), _pad(out.b % 9999 + 1, 4))))


def _phone(m: Column, key: str) -> Column:
    """North American numbers keep valid first digits of area and exchange; others keep two digits."""
    d = _digits(m)
    home = ~m.startswith("+") | (m.startswith("+1") & (F.length(d) == 11))
    body = F.right(d, F.lit(10))
    n = lambda i, k: F.substr(body, F.lit(i), F.lit(k)).cast("long")
    pair = permute_pair(
        (n(1, 3) - 200) * 100 + n(7, 2), (n(4, 3) - 200) * 100 + n(9, 2), F.lit(80_000), F.lit(80_000), key, "phone"
    )
    fresh = _let(pair, lambda out: F.concat(
        _pad(F.floor(out.a / 100) + 200, 3), _pad(F.floor(out.b / 100) + 200, 3), _pad(out.a % 100, 2), _pad(out.b % 100, 2)
    ))
    american = _refill(m, F.concat(F.left(d, F.length(d) - 10), fresh))
    abroad = _refill(m, F.concat(F.left(d, F.lit(2)), permute_digits(F.substr(d, F.lit(3)), key, "phone")))
    valid = (n(1, 3) >= 200) & (n(4, 3) >= 200)
    return F.when(home & valid, american).when(m.startswith("+") & F.length(d).between(8, 15), abroad)


def _card(m: Column, key: str) -> Column:
    d = _digits(m)
    body = F.concat(F.left(d, F.lit(1)), permute_digits(F.substr(d, F.lit(2), F.length(d) - 2), key, "card"))
    valid = F.length(d).between(13, 19) & (_luhn(d) == 0)
    return F.when(valid, _let(body, lambda b: _refill(
        m, F.concat(b, ((10 - _luhn(F.concat(b, F.lit("0")))) % 10).cast("string")))))


KINDS: dict[str, Callable[[Column, str], Column]] = {
    "email": _email, "secret": _secret, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card,
}


def _judged(forms: Column, key: str) -> Column:
    """The first form at a place that its kind accepts: kind, length and pseudonym, all null if there is none."""
    def accepted(name: str) -> Column:
        mine = F.filter(F.array(*[forms[f"f{i}"] for i, (kind, _) in enumerate(_FORMS) if kind == name]), lambda m: m != "")
        tried = F.transform(mine, lambda m: F.struct(
            F.lit(name).alias("kind"), F.length(m).alias("size"), KINDS[name](m, key).alias("text")))
        return F.get(F.filter(tried, lambda t: t.text.isNotNull()), F.lit(0))

    return F.coalesce(*[accepted(name) for name in KINDS])


def _taken(hits: Column) -> Column:
    """Per place the characters that are replaced from there on, and whether its own candidate is taken.

    First come, first taken: a candidate that begins within one taken before is not. The places are
    gone through in blocks, so that growing arrays stay small.
    """
    kind = "array<struct<skip:int,own:boolean>>"

    def place(s: Column, h: Column) -> Column:
        own = (s["left"] == 0) & h["kind"].isNotNull()
        return _let(F.when(own, h["size"]).otherwise(s["left"]), lambda cover: F.struct(
            F.greatest(cover - h["room"], F.lit(0)).alias("left"),
            F.concat(s.out, F.array(F.struct(F.least(cover, h["room"]).alias("skip"), own.alias("own")))).alias("out")))

    def block(s: Column, at: Column) -> Column:
        start = F.struct(s["left"].alias("left"), F.array().cast(kind).alias("out"))
        return _let(F.aggregate(F.slice(hits, at + 1, F.lit(_BLOCK)), start, place), lambda b: F.struct(
            b["left"].alias("left"), F.concat(s.out, F.array(b.out)).alias("out")))

    start = F.struct(F.lit(0).alias("left"), F.array().cast(f"array<{kind}>").alias("out"))
    return F.flatten(F.aggregate(F.sequence(F.lit(0), F.size(hits) - 1, F.lit(_BLOCK)), start, block, lambda s: s.out))


def _pseudonymised(text: Column, key: str) -> Column:
    """Struct of the text with pseudonyms and the kinds found, null if it has no candidate.

    Every place where a candidate begins is looked at, also within the others: so one that fails
    its check hides none behind it.
    """
    fields = [f"f{i}" for i in range(len(_FORMS))]

    def worked(whole: Column, pieces: Column) -> Column:
        found = [
            F.when(whole.rlike(hint), F.regexp_extract_all(whole, F.lit(f"{EVERY}(?=({form})|)"), F.lit(1))).otherwise(F.array().cast("array<string>"))
            for (_, form), hint in zip(_FORMS, _HINTS, strict=True)]
        rows = F.arrays_zip(F.slice(pieces, F.lit(2), F.size(pieces)).alias("piece"), *[
            f.alias(name) for f, name in zip(found, fields, strict=True)])
        hits = F.transform(rows, lambda r: _let(_judged(r, key), lambda j: F.struct(
            r.piece.alias("piece"), F.length(r.piece).alias("room"), j.kind.alias("kind"), j["size"].alias("size"), j.text.alias("text"))))
        return _let(hits, lambda h: _let(F.zip_with(h, _taken(h), lambda h, t: F.struct(
            F.concat(F.when(t.own, h.text).otherwise(F.lit("")), F.substr(h.piece, t.skip + 1)).alias("text"),
            F.when(t.own, h.kind).alias("kind"),
        )), lambda out: F.struct(
            F.concat(F.substr(F.get(pieces, F.lit(0)), F.lit(2)), F.array_join(out.text, "")).alias("text"),
            F.filter(out.kind, lambda k: k.isNotNull()).alias("found"))))

    # the line break keeps a candidate off the start, where split would make no piece before it
    return _let(F.concat(F.lit("\n"), text), lambda whole: _let(
        F.split(whole, EVERY, -1), lambda pieces: F.when(F.size(pieces) > 1, worked(whole, pieces))))


def with_pseudonyms(docs: DataFrame, key: str) -> DataFrame:
    """docs with its text pseudonymised, and a column `found`: an array of the kinds, in order.

    Whoever has the key can undo the permutation, so it is to be kept like a password.

    Null text stays null with no finds, and so do empty texts; texts without personal data stay as
    they are. Rows are independent: repeated rows stay repeated, other columns (of any name but
    `found`, which is replaced) pass through, an empty table stays empty.
    """
    text = F.col("text")
    busy = text.rlike("[0-9@=:]") | text.contains("AKIA")  # else no pattern can match
    marked = docs.withColumn("found", F.when(busy, _pseudonymised(text, key)))
    some = F.size("found.found") > 0
    marked = marked.withColumn("text", F.when(some, F.col("found.text")).otherwise(text))
    return marked.withColumn("found", F.coalesce(F.col("found.found"), F.array().cast("array<string>")))
