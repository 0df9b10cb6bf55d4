"""Format-preserving pseudonyms for personal data, in DataFrame operations only.

Found and validated: e-mail addresses; card numbers (13 to 19 digits, Luhn); IBANs (modulus 97); social security numbers
(area, group and serial in use); phone numbers in international or area form; IPv4 addresses (octets to 255); ISO and
numeric dates that exist. Each value is permuted by a keyed Feistel network within its own format:

  digits       two halves of the digits, each added the round value of the other, modulo its power of ten
  dates        the day's number in the 400-year cycle 1800 to 2199, as 27 * 5411 = 146,097 places
  social       area and group (898 * 99 places) against serial (9,999 places)
  IPv4         two halves of 16 bits
  cards, IBAN  the payload digits as above, then the check digits anew; an IBAN's payload with letters as in an e-mail
  phone        the national number's digits as above; the country's code stays, with or without separators after it
  e-mail       the local part letter by letter and digit by digit, shifted by a keyed stream over its own format; the domain stays

The networks are bijections of fixed rounds; round values are the leading bits of SHA-256 over key, format, round and half.
Equal values get equal pseudonyms in every document, whatever their separators; separators and formats stay. The key has no
default: who knows it can turn every pseudonym back.

Defined results: a null text stays null and an empty one empty; values that fail validation stay; an address of over 64 characters
before the sign is permuted in parts of 64; where valid values overlap the
leftmost wins, then the order of KINDS (what fails validation hides nothing that begins within it); repeated rows are treated alike. Other columns are passed through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark.llm.shared import free

ROUNDS = 8
#: Characters of an address that are permuted together, and matches of a text that are walked in one run.
TOGETHER, RUN = 64, 256
#: Lengths of IBANs by country, as registered, with letters or digits; others may have any length, of digits.
IBANS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}
_REGISTERED = "|".join(
    f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") + "(?![A-Za-z0-9])" for n, c in IBANS.items()
)
#: A part of a domain's name, in letters of any alphabet.
_LABEL = r"[\p{L}\p{N}](?:[\p{L}\p{M}\p{N}-]*[\p{L}\p{M}\p{N}])?"
#: Patterns by kind, tried in this order at each place.
KINDS = {
    # An address begins with a letter or digit; in a long run of points or the like, at the first place from which it is not too
    # long. Letters and digits on end belong to it however many they are. Each place is so looked at a bounded number of times.
    # Labels are counted, as Java's matcher goes one call deeper with every one; of a longer domain the first ones are the address's
    "email": r"(?<![\p{L}\p{N}])(?=[\p{L}\p{N}])(?:[\p{L}\p{M}\p{N}._%+'-]{1,64}+|[\p{L}\p{M}\p{N}]{65,}+[\p{L}\p{M}\p{N}._%+'-]{0,64}+)@" + rf"{_LABEL}(?:(?:\.{_LABEL}){{0,60}}\.(?:\p{{L}}[\p{{L}}\p{{M}}]++|xn--[A-Za-z0-9-]*[A-Za-z0-9])|(?:\.{_LABEL}){{60}})",
    "iban": rf"(?<![A-Za-z0-9])(?:{_REGISTERED}|[A-Z]{{2}}[0-9]{{2}}(?: ?[0-9]{{4}}){{2,7}}(?: ?[0-9]{{1,3}})?)(?![A-Za-z0-9])",
    "ipv4": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "isodate": r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9]|-[0-9])",
    "date": r"(?<![0-9./])[0-9]{2}(?:\.[0-9]{2}\.|/[0-9]{2}/)[0-9]{4}(?![0-9]|[./][0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "card": r"(?<![0-9A-Za-z.])(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4}(?: [0-9]{6} |-[0-9]{6}-)[0-9]{5})(?![0-9A-Za-z])",
}
_AREA = r"\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}"
#: What a group of a phone number never begins: a card number and, after enough digits for a number, any other kind.
_CARD = r"[0-9]{13}|[0-9]{4}(?:[ -][0-9]{4}){3}(?![0-9]|[ -][0-9]{4}(?![0-9]))"
_MORE = "[ .()-]{0,3}[0-9]"  # written out, as a lookbehind takes no repeated group of varying length
_OTHER = "|".join([*KINDS.values(), f"(?:{_AREA})(?![0-9A-Za-z])"])
_GROUP = rf"[ .-]?(?!{_CARD})(?!(?<=[0-9]{6 * _MORE}[ .-]?)(?:{_OTHER}))[0-9]{{2,4}}"
#: It ends before its sixteenth digit.
KINDS["phone"] = (
    rf"(?<![0-9A-Za-z+])(?:\+[0-9]{{1,3}}[ .-]?(?:\([0-9]{{1,4}}\)[ .-]?)?[0-9]{{1,4}}(?:{_GROUP}){{1,4}}(?<![0-9]{15 * _MORE})|{_AREA})(?![0-9A-Za-z])"
)
#: The first day and the number of days of the cycle, as a product of two near factors.
FIRST_DAY, DAYS = "1800-01-01", (27, 5411)
#: Characters of e-mail addresses by kind: each is moved within its kind. Other characters stay.
ALPHABETS = {
    "a": "abcdefghijklmnopqrstuvwxyz", "A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0": "0123456789", "ß": "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ", "À": "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ",
    "α": "αβγδεζηθικλμνξοπρσςτυφχψω", "Α": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", "а": "абвгдежзийклмнопрстуфхцчшщъыьэюяё", "А": "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯЁ",
}
#: Calling codes of one and two digits; all others have three.
CALLING = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}"

#: What a value of each kind begins with, so that most places of a text are passed over at once.
_FIRST = {"email": "", "iban": "(?=[A-Z]{2}[0-9])"}
_NUMERIC = "|".join(f"(?:{p})" for k, p in KINDS.items() if k not in _FIRST)
PATTERN = "|".join([*(f"(?:{first}{KINDS[k]})" for k, first in _FIRST.items()), f"(?=[0-9+(])(?:{_NUMERIC})"])


def feistel(left: Column, right: Column, left_size: Column, right_size: Column, key: str, name: str) -> Column:
    """(left, right) after ROUNDS additions, in turn to either half; a bijection of left_size * right_size places."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def step(state: Column, number: Column) -> Column:
        def value(half: Column) -> Column:
            text = F.concat_ws("|", F.lit(key), F.lit(name), left_size.cast("string"), right_size.cast("string"), number.cast("string"), half.cast("string"))
            return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("long")

        even = number % 2 == 0
        l = F.when(even, F.pmod(state["l"] + F.pmod(value(state["r"]), left_size), left_size)).otherwise(state["l"])
        r = F.when(even, state["r"]).otherwise(F.pmod(state["r"] + F.pmod(value(state["l"]), right_size), right_size))
        return F.struct(l.cast("long").alias("l"), r.cast("long").alias("r"))

    return F.aggregate(F.array(*map(F.lit, range(ROUNDS))), start, step)


def permuted_digits(digits: Column, key: str, name: str) -> Column:
    """Two or more decimal digits (36 at most), permuted among those of equal length."""
    n = F.length(digits)
    cut = F.floor(n / 2).cast("int")
    a, b = F.substring(digits, F.lit(1), cut), F.substring(digits, cut + 1, n - cut)
    size = lambda d: F.rpad(F.lit("1"), F.length(d) + 1, "0").cast("long")
    out = feistel(a.cast("long"), b.cast("long"), size(a), size(b), key, name)
    return F.concat(F.lpad(out["l"].cast("string"), cut, "0"), F.lpad(out["r"].cast("string"), n - cut, "0"))


def luhn_sum(digits: Column, doubled_last: bool) -> Column:
    """Luhn's sum of the digits; the last one counts doubled or not."""
    each = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    odd = 0 if doubled_last else 1

    def add(state: Column, d: Column) -> Column:
        x = d.cast("int")
        twice = F.when(x * 2 > 9, x * 2 - 9).otherwise(x * 2)
        return F.struct((state["s"] + F.when(state["i"] % 2 == odd, twice).otherwise(x)).alias("s"), (state["i"] + 1).alias("i"))

    return F.aggregate(each, F.struct(F.lit(0).alias("s"), F.lit(0).alias("i")), add, lambda s: s["s"])


def modulus_97(digits: Column) -> Column:
    """The remainder of a long run of digits."""
    return F.aggregate(F.filter(F.split(digits, ""), lambda c: c != ""), F.lit(0), lambda s, d: F.pmod(s * 10 + d.cast("int"), F.lit(97)))


def letters_as_numbers(text: Column) -> Column:
    """A is 10 and Z is 35; digits stay."""
    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.when(c.between("0", "9"), c).otherwise((F.ascii(c) - 55).cast("string"))), "")


def in_format(shape: Column, digits: Column, letters: bool = False) -> Column:
    """The shape with its digits, or its digits and capitals, replaced, one by one, by these."""
    def add(state: Column, c: Column) -> Column:
        own = c.between("0", "9") | c.between("A", "Z") if letters else c.between("0", "9")
        return F.struct(F.concat(state["out"], F.when(own, F.substring(digits, state["i"] + 1, F.lit(1))).otherwise(c)).alias("out"), (state["i"] + own.cast("int")).alias("i"))

    return F.aggregate(F.filter(F.split(shape, ""), lambda c: c != ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("i")), add, lambda s: s["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def card(value: Column, key: str) -> tuple[Column, Column]:
    d = _digits(value)
    payload = permuted_digits(F.substring(d, F.lit(1), F.length(d) - 1), key, "card")
    check = F.pmod(10 - F.pmod(luhn_sum(payload, True), F.lit(10)), F.lit(10)).cast("string")
    valid = (F.pmod(luhn_sum(d, False), F.lit(10)) == 0) & ~d.rlike("^0+$")
    return valid, in_format(value, F.concat(payload, check))


def iban(value: Column, key: str) -> tuple[Column, Column]:
    tight = F.replace(value, F.lit(" "), F.lit(""))
    country, rest = F.substring(tight, 1, 2), F.substring(tight, F.lit(5), F.length(tight) - 4)
    number = letters_as_numbers(country)
    mixed = _permuted_form(rest, country, key, "iban")
    body = F.when(rest.rlike("[A-Z]"), mixed).otherwise(permuted_digits(rest, key, "iban"))
    check = F.lpad((98 - modulus_97(F.concat(letters_as_numbers(body), number, F.lit("00")))).cast("string"), 2, "0")
    valid = (modulus_97(F.concat(letters_as_numbers(rest), number, F.substring(tight, 3, 2))) == 1) & (F.length(rest) <= 30)
    return valid, in_format(value, F.concat(country, check, body), True)


def ssn(value: Column, key: str) -> tuple[Column, Column]:
    area, group, serial = (F.substring(value, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    place = (F.when(area > 666, area - 2).otherwise(area - 1)) * 99 + group - 1
    out = feistel(place, serial - 1, F.lit(898 * 99), F.lit(9999), key, "ssn")
    new = F.floor(out["l"] / 99) + 1
    new = F.when(new >= 666, new + 1).otherwise(new)
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    return valid, F.concat_ws("-", pad(new, 3), pad(F.pmod(out["l"], F.lit(99)) + 1, 2), pad(out["r"] + 1, 4))


def ipv4(value: Column, key: str) -> tuple[Column, Column]:
    o = [F.element_at(F.split(value, r"\."), i + 1).cast("int") for i in range(4)]
    valid = (o[0] < 256) & (o[1] < 256) & (o[2] < 256) & (o[3] < 256)
    out = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, "ipv4")
    return valid, F.concat_ws(".", *(x for h in ("l", "r") for x in (F.floor(out[h] / 256), F.pmod(out[h], F.lit(256)))))


def _day(date: Column, key: str) -> tuple[Column, Column]:
    """Whether an ISO date is in the cycle, and the date it becomes."""
    day = F.datediff(F.try_to_date(date, "yyyy-MM-dd"), F.lit(FIRST_DAY).cast("date"))
    valid = day.isNotNull() & (day >= 0) & (day < DAYS[0] * DAYS[1])
    out = feistel(F.floor(day / DAYS[1]), F.pmod(day, F.lit(DAYS[1])), F.lit(DAYS[0]), F.lit(DAYS[1]), key, "date")
    return valid, F.date_add(F.lit(FIRST_DAY).cast("date"), (out["l"] * DAYS[1] + out["r"]).cast("int"))


def isodate(value: Column, key: str) -> tuple[Column, Column]:
    valid, new = _day(value, key)
    return valid, F.date_format(new, "yyyy-MM-dd")


def date(value: Column, key: str) -> tuple[Column, Column]:
    """Day first with points, month first with strokes; strokes that only make sense day first are read so."""
    a, b, year, sep = (F.substring(value, i, n) for i, n in ((1, 2), (4, 2), (7, 4), (3, 1)))
    day_first = (sep == ".") | (a.cast("int") > 12)
    valid, new = _day(F.concat_ws("-", year, F.when(day_first, b).otherwise(a), F.when(day_first, a).otherwise(b)), key)
    day, month = F.date_format(new, "dd"), F.date_format(new, "MM")
    plain = F.concat(F.when(day_first, day).otherwise(month), sep, F.when(day_first, month).otherwise(day), sep, F.date_format(new, "yyyy"))
    return valid, plain


def phone(value: Column, key: str) -> tuple[Column, Column]:
    """The country's code stays; 7 to 15 digits in all."""
    d = _digits(value)
    code = F.when(value.startswith("+"), F.regexp_extract(d, f"^(?:{CALLING})", 0)).otherwise("")
    own = F.substring(d, F.length(code) + 1, F.length(d))
    return F.length(d).between(7, 15) & (F.length(own) >= 4), in_format(value, F.concat(code, permuted_digits(own, key, "phone")))


def email(value: Column, key: str) -> tuple[Column, Column]:
    """The local part keeps its form. A character moves within its kind by a keyed stream that depends on the form, the
    domain and all characters before it, so the map is a bijection."""
    at = F.instr(value, "@")
    domain = F.substring(value, at, F.length(value))
    # by parts, as the stream goes back to the first character for each one; nearly all addresses are one part
    parts = F.regexp_extract_all(F.substring(value, F.lit(1), at - 1), F.lit(f"(?s).{{1,{TOGETHER}}}"), F.lit(0))

    def permuted(x: Column) -> Column:
        salt = lambda i: F.when(F.size(x["parts"]) == 1, x["salt"]).otherwise(F.concat_ws("|", x["salt"], i))
        return F.array_join(F.transform(x["parts"], lambda part, i: _permuted_form(part, salt(i), key, "email")), "")

    return at > 1, F.concat(_bound(F.struct(parts.alias("parts"), F.lower(domain).alias("salt")), permuted), domain)


def _permuted_form(local: Column, salt: Column, key: str, name: str) -> Column:
    """Letters and digits, permuted among the texts of equal form."""
    form = local
    for kind, letters in ALPHABETS.items():
        form = F.regexp_replace(form, f"[{letters}]", kind)

    def streams(x: Column) -> Column:
        return _stream(_stream(x["local"], x["salt"], key, f"{name}0", 0), x["salt"], key, f"{name}1", 1)

    return _bound(F.struct(local.alias("local"), F.concat_ws("|", form, salt).alias("salt")), streams)


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of the value, which is worked out once, however often f asks for it."""
    return F.transform(F.array(value), f)[0]


def _stream(local: Column, salt: Column, key: str, name: str, number: int) -> Column:
    """One pass from the left; the result is turned round, so that a second pass spreads every character over all."""
    def add(state: Column, c: Column) -> Column:
        shift = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(name), salt, state["seen"]), 256), 1, 8), 16, 10).cast("long")
        new = c
        for letters in reversed(ALPHABETS.values()):
            place = F.instr(F.lit(letters), c)
            new = F.when(place > 0, F.substring(F.lit(letters), (F.pmod(place - 1 + shift, F.lit(len(letters))) + 1).cast("int"), F.lit(1))).otherwise(new)
        return F.struct(F.concat(state["out"], new).alias("out"), F.concat(state["seen"], c).alias("seen"))

    each = F.filter(F.split(local, ""), lambda c: c != "")
    if number:
        each = F.reverse(each)
    out = F.aggregate(each, F.struct(F.lit("").alias("out"), F.lit("").alias("seen")), add, lambda s: s["out"])
    return F.reverse(out) if number else out


WAYS = {"email": email, "iban": iban, "ipv4": ipv4, "isodate": isodate, "date": date, "ssn": ssn, "phone": phone, "card": card}


def pseudonym(value: Column, key: str) -> Column:
    """(value, kind): the pseudonym of one match and its kind; the value itself and null where no kind validates it."""
    out = F.struct(value.alias("value"), F.lit(None).cast("string").alias("kind"))
    for kind, pattern in reversed(KINDS.items()):
        valid, new = WAYS[kind](value, key)
        whole = value.rlike(f"^(?:{pattern})$") & F.coalesce(valid, F.lit(False))
        out = F.when(whole, F.struct(new.alias("value"), F.lit(kind).alias("kind"))).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, text: str = "text", counts: str | None = None) -> DataFrame:
    """docs with pseudonyms in the text. counts: the name of an array column of the kinds replaced, in order."""
    if not key:
        raise ValueError("pseudonyms need a key")
    t, scratch = F.col(text), free("_pseudonyms", docs.columns)
    hit = t.rlike(PATTERN)
    # a match at each place where one begins, within others too, and the text cut at these places
    found = F.regexp_extract_all(t, F.lit(f"(?=({PATTERN}))"), F.lit(1))
    cut = F.split(t, f"(?={PATTERN})", -1)
    before = F.when(F.size(cut) > F.size(found), F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>"))
    pieces = F.zip_with(cut, F.concat(before, found), lambda piece, m: F.struct(piece.alias("piece"), m.alias("m")))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("taken"), F.array().cast("array<string>").alias("kinds"))

    def add(state: Column, x: Column) -> Column:
        """taken: the characters from here on that belong to a value before; a value that fails validation takes none."""
        free = (state["taken"] == 0) & x["m"].isNotNull()
        new = F.when(free, pseudonym(x["m"], key))
        return F.transform(F.array(new), lambda p: _placed(state, x, p))[0]

    def walk(rows: Column) -> Column:
        def steps(state: Column, first: Column) -> Column:
            """A run of matches by itself, so that appending copies the text of the run, not all before it."""
            begin = F.struct(F.lit("").alias("out"), state["taken"].alias("taken"), F.array().cast("array<string>").alias("kinds"))
            some = F.aggregate(F.slice(rows, first, RUN), begin, add)
            return F.transform(F.array(some), lambda r: F.struct(F.concat(state["out"], r["out"]).alias("out"), r["taken"].alias("taken"), F.concat(state["kinds"], r["kinds"]).alias("kinds")))[0]

        return F.aggregate(F.sequence(F.lit(1), F.size(rows), F.lit(RUN)), start, steps)

    result = F.when(hit, F.transform(F.array(pieces), walk)[0])  # pieces are made once, not in each run
    out = docs.withColumn(scratch, result)
    if counts:
        out = out.withColumn(counts, F.coalesce(F.col(f"{scratch}.kinds"), F.array().cast("array<string>")))
    return out.withColumn(text, F.when(F.col(scratch).isNotNull(), F.col(f"{scratch}.out")).otherwise(t)).drop(scratch)


def _placed(state: Column, x: Column, new: Column) -> Column:
    """The state after a piece of text, with the pseudonym of the match that begins it, if any."""
    valid = new["kind"].isNotNull()
    taken = F.when(valid, F.length(x["m"])).otherwise(state["taken"])
    left = F.substring(x["piece"], taken + 1, F.length(x["piece"]))
    return F.struct(
        F.concat(state["out"], F.when(valid, new["value"]).otherwise(""), left).alias("out"),
        F.greatest(taken - F.length(x["piece"]), F.lit(0)).alias("taken"),
        F.when(valid, F.concat(state["kinds"], F.array(new["kind"]))).otherwise(state["kinds"]).alias("kinds"),
    )
