"""Format-preserving Feistel pseudonyms for personal data, in DataFrame functions only.

Found and validated: card numbers (13 to 19 digits, Luhn), IBANs (mod 97), social security numbers (valid ranges),
dates of 1900 to 2099 (yyyy-MM-dd, yyyy/MM/dd, dd/MM/yyyy, MM/dd/yyyy, dd.MM.yyyy), IPv4 addresses, telephone numbers,
e-mail addresses, and values of secrets (password=..., token = "..."). What is not valid stays as it is. A run of
digits that is no card may hold one. Of a run of at most 19 digits the parts from separator to separator are tried. A
longer one, of any length, holds a card where one of its windows in a usual form (groups of 4-4-4-4, 4-4-4-4 and 1 to 3,
4-6-5, or 13 to 19 digits in one group) passes; as windows overlap, all its digits get pseudonyms then, and walk on
until a window passes again, which tells the inverse what was changed.

Each value is split in two halves, and eight Feistel rounds add to one half, modulo its size, a keyed SHA-256 of the
other; so each value goes to exactly one of the same format, equal values stay linked across documents, and with the
key the rounds run backwards (``inverse``). Numbers keep their separators; cards keep the first digit and get their
check digit anew, IBANs keep the country and get their check digits anew, telephone numbers keep what stands before
the last ten digits, dates stay in their century and format, e-mail addresses keep their domain. Letters and digits
of addresses and secrets stay letters of the same case and digits.

Cards come last, in a search of their own, so that a run of numbers hides no other value; the inverse begins with them.
Rows never move: two searches of each text, and only texts with a digit, @, = or : are searched at all.

Defined results: a null text stays null with no finding; an empty one stays empty; equal rows get equal texts; very long
texts and runs of digits are searched whole.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

ROUNDS = 8
#: Steps of a walk at the most. Of a date's days two in five are on either side of the 12th, so that a walk of n steps has a
#: chance of 0.61^n: 10^-85 here. Steps after a walk's end cost nothing to speak of.
WALK = 400
#: The session's secret key.
SETTING = "spark.rasterloom.pseudonym.key"
_MARK = "rasterloom-key-"

_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_SECRET = r"\b(?:[Pp]assword|[Pp]asswd|[Pp]wd|[Ss]ecret|[Tt]oken|[Aa]pi[_-]?[Kk]ey|[Aa]ccess[_-]?[Kk]ey|PASSWORD|SECRET|TOKEN|API_KEY)\b[ ]?[=:][ ]?[\"']?[A-Za-z0-9_+/.-]{8,}"
_IBAN = r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"
_IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])"
_DATE = r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9/-])"
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_PHONE = r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])|(?<![0-9(])\(?[2-9][0-9]{2}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"
# A run of any length; a class of characters, so that no long run takes a stack.
_CARD = r"(?<![0-9])[0-9][0-9 -]{11,}[0-9]"
# Windows of a long run, which may overlap: what looks ahead takes no character.
_WINDOWS = tuple(rf"(?<![0-9])(?=({x})(?![0-9]))" for x in ("[0-9]{4}(?:[ -][0-9]{4}){3}", "[0-9]{4}(?:[ -][0-9]{4}){3}[ -][0-9]{1,3}", "[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}", "[0-9]{13,19}"))


def _number(key: str, tweak: str, i: Column, other: Column) -> Column:
    """A keyed whole number below 2^60."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), i.cast("string"), other.cast("string")), 256), 1, 15), 16, 10).cast("long")


def _rounds(inverse: bool) -> Column:
    return F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)) if inverse else F.sequence(F.lit(1), F.lit(ROUNDS))


def permute_numbers(left: Column, right: Column, a: Column, b: Column, key: str, tweak: str, inverse: bool = False) -> Column:
    """struct(l, r): the pair (left < a, right < b), permuted within its range."""
    sign = -1 if inverse else 1

    def step(x, i):
        odd = i % 2 == 1
        return F.struct(
            F.when(odd, F.pmod(x["l"] + sign * F.pmod(_number(key, tweak, i, x["r"]), a), a)).otherwise(x["l"]).cast("long").alias("l"),
            F.when(odd, x["r"]).otherwise(F.pmod(x["r"] + sign * F.pmod(_number(key, tweak, i, x["l"]), b), b)).cast("long").alias("r"),
        )

    return F.aggregate(_rounds(inverse), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def permute_digits(digits: Column, key: str, tweak: str, inverse: bool = False) -> Column:
    """Digits of up to 36 places to as many digits; one place or none stays."""
    n = F.char_length(digits)
    u = F.floor(n / 2).cast("int")
    left, right = F.substring(digits, F.lit(1), u), F.substring(digits, u + 1, n)
    whole = lambda x: F.coalesce(F.expr("bigint(null)"), F.conv(F.concat(F.lit("0"), x), 10, 10).cast("long"))
    size = lambda k: F.pow(F.lit(10.0), k).cast("long")
    out = permute_numbers(whole(left), whole(right), size(u), size(n - u), key, tweak, inverse)
    padded = lambda x, k: F.lpad(x.cast("string"), k, "0")
    # One expression over the pair, so that the rounds run once.
    return F.when(n < 2, digits).otherwise(F.element_at(F.transform(F.array(out), lambda p: F.concat(padded(p["l"], u), padded(p["r"], n - u))), 1))


def permute_characters(text: Column, key: str, tweak: str, inverse: bool = False) -> Column:
    """Letters stay letters of their case and digits digits, in their places; all else stays."""
    sign = -1 if inverse else 1
    n = F.char_length(text)
    u = F.floor(n / 2).cast("int")

    def shifted(half: Column, i: Column, other: Column) -> Column:
        code = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), i.cast("string"), n.cast("string"), other), 512)

        def one(c, k):
            step = sign * F.conv(F.substring(code, (k % 32) * 4 + 1, F.lit(4)), 16, 10).cast("int")
            moved = lambda first, size: F.char((F.ascii(c) - ord(first) + step) % size + F.when((F.ascii(c) - ord(first) + step) % size < 0, size).otherwise(0) + ord(first))
            return F.when(c.rlike("^[0-9]$"), moved("0", 10)).when(c.rlike("^[a-z]$"), moved("a", 26)).when(c.rlike("^[A-Z]$"), moved("A", 26)).otherwise(c)

        return F.array_join(F.transform(F.split(half, ""), one), "")

    def step(x, i):
        odd = i % 2 == 1
        return F.struct(F.when(odd, shifted(x["l"], i, x["r"])).otherwise(x["l"]).alias("l"), F.when(odd, x["r"]).otherwise(shifted(x["r"], i, x["l"])).alias("r"))

    start = F.struct(F.substring(text, F.lit(1), u).alias("l"), F.substring(text, u + 1, n).alias("r"))
    return F.aggregate(_rounds(inverse), start, step, lambda x: F.concat(x["l"], x["r"]))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _put_back(form: Column, digits: Column) -> Column:
    """``digits`` in the places of the digits of ``form``."""
    return F.array_join(
        F.transform(F.split(form, ""), lambda c, k: F.when(c.rlike("^[0-9]$"), F.substring(digits, F.char_length(_digits(F.substring(form, F.lit(1), k + 1))), F.lit(1))).otherwise(c)),
        "",
    )


def _luhn_sum(digits: Column) -> Column:
    """The Luhn sum with the last digit counted once."""
    each = F.transform(F.reverse(F.split(digits, "")), lambda c, k: F.when(k % 2 == 1, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda s, v: s + F.coalesce(v, F.lit(0)))


def _card_whole(x: Column, key: str, inverse: bool) -> Column:
    d = _digits(x)
    body = F.concat(F.substring(d, 1, 1), permute_digits(F.substring(d, F.lit(2), F.char_length(d) - 2), key, "card", inverse))
    check = F.pmod(10 - _luhn_sum(F.concat(body, F.lit("0"))), F.lit(10))
    return _put_back(x, F.concat(body, check.cast("string")))


def _card_parts(x: Column) -> Column:
    """(less, at, n) of each part of 13 digits or more from separator to separator, the longest first, then the first."""
    places = F.sequence(F.lit(1), F.char_length(x))
    parted = lambda i: (i < 1) | (i > F.char_length(x)) | F.substring(x, i, F.lit(1)).rlike("^[ -]$")
    digit = lambda i: F.substring(x, i, F.lit(1)).rlike("^[0-9]$")
    first, last = F.filter(places, lambda i: digit(i) & parted(i - 1)), F.filter(places, lambda i: digit(i) & parted(i + 1))
    each = F.flatten(F.transform(first, lambda i: F.transform(last, lambda j: F.struct((-F.char_length(_digits(F.substring(x, i, j - i + 1)))).alias("less"), i.alias("at"), (j - i + 1).alias("n")))))
    return F.sort_array(F.filter(each, lambda p: (p["n"] > 0) & (p["less"] <= -13)))


def _card(x: Column, key: str, inverse: bool) -> Column:
    """The run of digits, or where it fails the Luhn test, the first of its parts that passes.

    Such a part walks on through the permutation until the parts tried before it fail as they did before, so that the
    mapping stays one to one.
    """
    passes = lambda t, p: _luhn_sum(_digits(F.substring(t, p["at"], p["n"]))) % 10 == 0
    chosen = lambda t: F.get(F.filter(_card_parts(x), lambda p: passes(t, p)), F.lit(0))

    def walked(part: Column) -> Column:
        def step(s, _):
            now = F.substring(s["t"], part["at"], part["n"])
            new = F.concat(F.substring(x, F.lit(1), part["at"] - 1), _card_whole(now, key, inverse), F.substring(x, part["at"] + part["n"], F.char_length(x)))
            following = F.element_at(F.transform(F.array(new), lambda t: F.struct(t.alias("t"), (chosen(t) == part).alias("done"))), 1)
            return F.when(s["done"], s).otherwise(following)

        return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.struct(x.alias("t"), F.lit(False).alias("done")), step, lambda s: s["t"])

    inner = F.element_at(F.transform(F.array(chosen(x)), lambda p: F.when(p.isNull(), x).otherwise(walked(p))), 1)
    n = F.char_length(_digits(x))
    short = F.when(_luhn_sum(_digits(x)) % 10 == 0, _card_whole(x, key, inverse)).when(x.rlike("[ -]"), inner).otherwise(x)
    return F.when(n < 13, x).when((n > 19) | x.rlike("[ -]{2}"), _long_run(x, key, inverse)).otherwise(short)


def _holds_card(x: Column) -> Column:
    windows = F.concat(*(F.regexp_extract_all(x, F.lit(w), F.lit(1)) for w in _WINDOWS))
    return F.exists(windows, lambda w: _luhn_sum(_digits(w)) % 10 == 0)


def _long_run(x: Column, key: str, inverse: bool) -> Column:
    """A run of digits as it is, or if it holds a card, all its digits permuted until it holds one again."""

    def permuted(t: Column) -> Column:
        d = _digits(t)
        n = F.char_length(d)
        blocks = F.greatest(F.lit(1), F.floor(n / 18)).cast("int")
        # The last block takes the rest, 35 digits at the most.
        part = lambda k: F.substring(d, (k * 18 + 1).cast("int"), F.when(k == blocks - 1, n).otherwise(18).cast("int"))
        new = F.array_join(F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: permute_digits(part(k), key, "run", inverse)), "")
        # Digits into the places of digits, by their count before each place.
        return F.element_at(F.transform(F.array(F.struct(F.split(t, "").alias("form"), F.split(new, "").alias("new"))), _placed), 1)

    def step(s, _):
        following = F.element_at(F.transform(F.array(permuted(s["t"])), lambda t: F.struct(t.alias("t"), _holds_card(t).alias("done"))), 1)
        return F.when(s["done"], s).otherwise(following)

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.struct(x.alias("t"), F.lit(False).alias("done")), step, lambda s: s["t"])
    return F.when(_holds_card(x), walked).otherwise(x)


def _placed(p: Column) -> Column:
    """The digits ``new`` in the places of digits of ``form``, read from left to right."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("i"))
    digit = lambda c: (c >= "0") & (c <= "9")
    places = F.filter(F.transform(p["form"], lambda c, k: F.when(digit(c), k)), lambda k: k.isNotNull())
    return F.element_at(F.transform(F.array(places), lambda at: F.array_join(F.transform(p["form"], lambda c, k: F.when(digit(c), F.get(p["new"], F.array_position(at, k).cast("int") - 1)).otherwise(c)), "")), 1)


def _mod97(x: Column) -> Column:
    """Of letters (10 to 35) and digits, place by place."""
    value = lambda c: F.when(c.rlike("^[0-9]$"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(x, ""), F.lit(0), lambda s, c: (F.when(value(c) > 9, s * 100).otherwise(s * 10) + value(c)) % 97)


def _iban(x: Column, key: str, inverse: bool) -> Column:
    c = F.replace(x, F.lit(" "), F.lit(""))
    land, rest = F.substring(c, 1, 2), F.substring(c, F.lit(5), F.char_length(c))
    new = permute_characters(rest, key, "iban", inverse)
    check = F.lpad((98 - _mod97(F.concat(new, land, F.lit("00")))).cast("string"), 2, "0")
    plain = F.concat(land, check, new)
    back = F.array_join(F.transform(F.split(x, ""), lambda c, k: F.when(c == " ", c).otherwise(F.substring(plain, F.char_length(F.replace(F.substring(x, F.lit(1), k + 1), F.lit(" "), F.lit(""))), F.lit(1)))), "")
    return F.when(_mod97(F.concat(rest, F.substring(c, 1, 4))) == 1, back).otherwise(x)


def _ip(x: Column, key: str, inverse: bool) -> Column:
    o = F.transform(F.split(x, r"\."), lambda v: v.cast("int"))
    at = lambda k: F.element_at(o, k)
    out = permute_numbers(at(1) * 256 + at(2), at(3) * 256 + at(4), F.lit(65536), F.lit(65536), key, "ip", inverse)
    text = F.element_at(F.transform(F.array(out), lambda p: F.concat_ws(".", F.expr("0") + F.floor(p["l"] / 256), p["l"] % 256, F.floor(p["r"] / 256), p["r"] % 256)), 1)
    return F.when(F.array_max(o) <= 255, text).otherwise(x)


def _ssn(x: Column, key: str, inverse: bool) -> Column:
    d = _digits(x)
    area, group, serial = (F.substring(d, i, k).cast("int") for i, k in ((1, 3), (4, 2), (6, 4)))
    valid = (area >= 1) & (area <= 899) & (area != 666) & (group >= 1) & (serial >= 1)
    left = (area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1
    out = permute_numbers(left, serial - 1, F.lit(898 * 99), F.lit(9999), key, "ssn", inverse)
    new_area = lambda p: F.floor(p["l"] / 99) + F.when(F.floor(p["l"] / 99) + 1 >= 666, 2).otherwise(1)
    text = F.element_at(F.transform(F.array(out), lambda p: F.concat_ws("-", F.lpad(new_area(p).cast("string"), 3, "0"), F.lpad((p["l"] % 99 + 1).cast("string"), 2, "0"), F.lpad((p["r"] + 1).cast("string"), 4, "0"))), 1)
    return F.when(valid, text).otherwise(x)


def _date_in(x: Column, form: str, key: str, inverse: bool) -> Column:
    slashes = form.find("/") == 2
    day = F.try_to_timestamp(x, F.lit(form)).cast("date")
    late = F.year(day) >= 2000
    start = F.when(late, F.lit("2000-01-01")).otherwise(F.lit("1900-01-01")).cast("date")
    a, b = F.when(late, F.lit(75)).otherwise(F.lit(92)), F.when(late, F.lit(487)).otherwise(F.lit(397))
    begin = F.date_diff(day, start).cast("long")
    side = lambda d: F.dayofmonth(F.date_add(start, d.cast("int"))) > 12 if slashes else F.lit(True)

    def step(s, _):
        out = permute_numbers(F.floor(s["d"] / b), s["d"] % b, a, b, key, "date", inverse)
        moved = F.transform(F.array(out), lambda p: (p["l"] * b + p["r"]).cast("long"))
        following = F.element_at(F.transform(moved, lambda d: F.struct(d.alias("d"), (side(d) == side(begin)).alias("done"))), 1)
        return F.when(s["done"], s).otherwise(following)

    first = F.struct(begin.alias("d"), F.lit(False).alias("done"))
    text = F.aggregate(F.sequence(F.lit(1), F.lit(WALK if slashes else 1)), first, step, lambda s: F.date_format(F.date_add(start, s["d"].cast("int")), form))
    return F.when(day.isNotNull() & F.year(day).between(1900, 2099), text).otherwise(x)


def _date(x: Column, key: str, inverse: bool) -> Column:
    """Within its century: 36524 = 92 * 397 days from 1900 on, 36525 = 75 * 487 from 2000 on.

    With slashes, days after the 12th say which number is the month; so such a date walks on through the permutation
    until its day is on the same side of the 12th as before, which keeps the mapping one to one.
    """
    forms = (("^[0-9]{4}-", "yyyy-MM-dd"), ("^[0-9]{4}/", "yyyy/MM/dd"), ("^[0-9]{2}[.]", "dd.MM.yyyy"), ("^(?:1[3-9]|[23][0-9])/", "dd/MM/yyyy"), ("^[0-9]{2}/(?:1[3-9]|[23][0-9])/", "MM/dd/yyyy"), ("^[0-9]{2}/", "dd/MM/yyyy"))
    result = x
    for pattern, form in reversed(forms):
        result = F.when(x.rlike(pattern), _date_in(x, form, key, inverse)).otherwise(result)
    return result


def _phone(x: Column, key: str, inverse: bool) -> Column:
    d = _digits(x)
    n = F.char_length(d)
    body = F.concat(F.substring(d, F.lit(1), n - 10), permute_digits(F.substring(d, n - 9, F.lit(10)), key, "phone", inverse))
    return F.when((n >= 10) & (n <= 15), _put_back(x, body)).otherwise(x)


def _email(x: Column, key: str, inverse: bool) -> Column:
    local = F.substring_index(x, "@", 1)
    return F.concat(permute_characters(local, key, "email", inverse), F.substring(x, F.char_length(local) + 1, F.char_length(x)))


def _secret(x: Column, key: str, inverse: bool) -> Column:
    head = F.regexp_extract(x, "^[^=:]*[=:][ ]?[\"']?", 0)
    return F.concat(head, permute_characters(F.substring(x, F.char_length(head) + 1, F.char_length(x)), key, "secret", inverse))


_RULES = (("email", _EMAIL, _email), ("secret", _SECRET, _secret), ("iban", _IBAN, _iban), ("ip", _IP, _ip), ("date", _DATE, _date), ("ssn", _SSN, _ssn), ("phone", _PHONE, _phone))
_LAST = (("card", _CARD, _card),)


def _derived(spark, key: str | None) -> str:
    """What the rounds are keyed with: a digest of the key behind a mark, which Spark redacts in plans, UI and logs."""
    key = key or spark.conf.get(SETTING, None)
    if not key:
        raise ValueError(f"a secret key is needed: {SETTING} or the argument")
    if not spark.conf.get("spark.sql.redaction.string.regex", None):
        spark.conf.set("spark.sql.redaction.string.regex", _MARK + "[0-9a-f]+")
    return _MARK + hashlib.sha256(key.encode()).hexdigest()


def pseudonymise(docs: DataFrame, text: str = "text", out: str = "findings", key: str | None = None, inverse: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in ``text`` and a column ``out``: array<struct<kind, changed>> of what was found, in order (cards last).

    The key is the argument or the session's; without one this is an error, as anyone could undo a known key's work.
    """
    out, key = fresh(docs, out), _derived(docs.sparkSession, key)
    steps = (_LAST, _RULES) if inverse else (_RULES, _LAST)
    found = [fresh(docs, f"_fp_{k}") for k in ("first", "second")]
    df = docs
    for rules, name in zip(steps, found):
        df = _replaced(df, text, name, rules, key, inverse)
    return df.select(*(F.col(f"`{c}`") for c in docs.columns), F.concat(*map(F.col, found)).alias(out))


def _replaced(docs: DataFrame, text: str, out: str, rules: tuple, key: str, inverse: bool) -> DataFrame:
    hits, gaps, new = (fresh(docs, f"_fp_{k}") for k in ("hits", "gaps", "new"))
    every = "|".join(pattern for _, pattern, _ in rules)
    t = F.col(text)
    df = docs.withColumn(hits, F.when(t.rlike("[0-9@=:]"), F.regexp_extract_all(t, F.lit(every), F.lit(0))))
    some = F.size(hits) > 0

    def swap(x):
        kind, value = F.lit(None).cast("string"), x
        for name, pattern, rule in reversed(rules):
            mine = x.rlike(f"^(?:{pattern})$")
            kind, value = F.when(mine, F.lit(name)).otherwise(kind), F.when(mine, rule(x, key, inverse)).otherwise(value)
        return F.struct(kind.alias("kind"), value.alias("value"), x.alias("was"))

    df = df.withColumn(new, F.when(some, F.transform(hits, swap))).withColumn(gaps, F.when(some, F.split(t, every)))
    pieces = F.zip_with(gaps, F.transform(new, lambda x: x["value"]), lambda g, v: F.concat(g, F.coalesce(v, F.lit(""))))
    found = F.coalesce(F.transform(new, lambda x: F.struct(x["kind"].alias("kind"), (x["value"] != x["was"]).alias("changed"))), F.array().cast("array<struct<kind:string,changed:boolean>>"))
    result = {text: F.when(some, F.array_join(pieces, "")).otherwise(t), out: found}
    return df.withColumns(result).select(*(F.col(f"`{c}`") for c in docs.columns), out)
