"""Operator 10: format-preserving pseudonyms of personal numbers and dates, in DataFrame functions only.

Kinds are e-mail addresses, bank account numbers (IBAN), dates, US social security numbers, telephone numbers (US forms,
and international ones with a plus sign), IPv4 addresses and payment cards. Only what passes its validation (check
digits, lengths by country, ranges, the calendar) is replaced. A value is an element of the product of two ranges and is
moved there by a keyed Feistel network whose rounds add to one half a hash of the other, modulo that half's range; so
every kind is permuted within its valid values, equal values get equal pseudonyms in all documents, and whoever has the
key can go back. Separators and check digits are put in anew. In an e-mail address the letters and digits before the @
move within their class, half against half.

The kinds are searched one after the other in the order of ``KINDS``. A value found gives way to a sign that no later
pattern takes; a match that fails its validation stays in the text for the kinds after it. A run of digit groups may hold
cards anywhere: every group or sequence of groups that a card may be written in is tried, lengths in the order of
``CARD_LENGTHS`` and from the left, until none is left that is valid and free.

The key is an argument, or else the setting ``spark.litmill.pii.key`` of the session; a session without it draws one,
so that values are linked within the session only.

A null text stays null with counts of 0; empty and very long texts are treated whole; repeated rows give repeated rows;
an empty table gives an empty result; columns other than the id and text are left out, so no name can clash. Signs of
the text that are the same as the internal ones (Unicode noncharacters) are kept.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "iban", "date", "ssn", "phone", "ip", "card")
KEY_SETTING = "spark.litmill.pii.key"
ROUNDS = 8
#: Digits of a card, the commonest first, and the groups it may be written in.
CARD_LENGTHS = (16, 15, 14, 13, 19, 18, 17)
#: Lengths of bank account numbers by country.
IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 "
    "GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 "
    "MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 "
    "TN24 TR26 UA29 VA22 VG24 XK20"
).split()


def _iban_pattern() -> str:
    by_length: dict[int, list[str]] = {}
    for x in IBAN_LENGTHS:
        by_length.setdefault(int(x[2:]), []).append(x[:2])
    forms = [f"(?:{'|'.join(countries)})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, countries in sorted(by_length.items())]
    return rf"(?<![A-Za-z0-9])(?:{'|'.join(forms)})(?![A-Za-z0-9])"


PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": _iban_pattern(),
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": (
        r"(?<![0-9+])(?:\+1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9])"
        r"|(?<![0-9+])\+[2-9][0-9]{0,2}(?:[ .-]?\(?[0-9]{2,5}\)?){2,5}(?![0-9])"
    ),
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "card": r"[0-9](?:[ -]?[0-9]){12,}",
}
#: What a text must hold for the pattern to be tried.
GUARDS = {"email": "@", "iban": "[A-Z]{2}[0-9]{2}", "date": "[0-9]{2}[-./][0-9]{2}", "ssn": "[0-9]-[0-9]{2}-[0-9]", "phone": r"[0-9][ .)-][ 0-9]|\+[2-9]", "ip": r"[0-9]\.[0-9]{1,3}\.", "card": "[0-9](?:[ -]?[0-9]){12}"}
#: Signs that stand for the values of each kind, and for signs of the text that are the same.
SIGNS = {k: chr(0xFDD0 + n) for n, k in enumerate((*KINDS, "own"))}
#: The days of 1700 to 2099, a whole cycle of the calendar, are 189 times 773.
FIRST_DAY, DAYS = "1700-01-01", (189, 773)


def _hash(half: Column, round_: Column, tweak: Column | str, key: str) -> Column:
    """48 bits that depend on the key, the kind, the round and one half."""
    tweak = F.lit(tweak) if isinstance(tweak, str) else tweak
    digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, round_.cast("string"), half.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


def feistel(left: Column, right: Column, left_range: Column | int, right_range: Column | int, tweak: Column | str, key: str, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of the pairs (left, right) below the ranges, as a struct (l, r)."""
    a, b = (F.lit(x) if isinstance(x, int) else x for x in (left_range, right_range))

    def turn(state: Column, n: Column) -> Column:
        odd = n % 2 == 1
        l = F.when(odd, F.pmod(state.l + F.pmod(_hash(state.r, n, tweak, key), a.cast("long")), a.cast("long"))).otherwise(state.l)  # noqa: E741
        r = F.when(odd, state.r).otherwise(F.pmod(state.r + F.pmod(_hash(state.l, n, tweak, key), b.cast("long")), b.cast("long")))
        return F.struct(l.alias("l"), r.alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), turn)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), (n + 1).cast("int"), "0").cast("long")


def _permuted_digits(digits: Column, tweak: Column | str, key: str) -> Column:
    """A permutation of the digit strings of one length, up to 36 digits."""
    n = F.length(digits)
    a = F.floor(n / 2).cast("int")
    moved = feistel(F.substring(digits, F.lit(1), a).cast("long"), F.substring(digits, a + 1, n - a).cast("long"), _power(a), _power(n - a), F.concat_ws(":", F.lit(tweak) if isinstance(tweak, str) else tweak, n.cast("string")), key)
    return F.transform(F.array(moved), lambda m: F.concat(F.lpad(m.l.cast("string"), a, "0"), F.lpad(m.r.cast("string"), (n - a).cast("int"), "0")))[0]


def _filled(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced in order."""
    place = lambda i: F.length(_digits(F.substring(form, F.lit(1), i + 1)))
    return F.array_join(F.transform(F.split(form, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substring(digits, place(i), F.lit(1))).otherwise(c)), "")


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum; a number is valid if it divides by 10."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda total, x: total + x)


def _card(m: Column, key: str) -> Column:
    """(text, number of cards) of a run of digit groups."""

    def pseudonym(digits: Column) -> Column:
        head = _permuted_digits(F.substring(digits, F.lit(1), F.length(digits) - 1), "card", key)
        return _let(head, lambda h: F.concat(h, F.pmod(F.lit(10) - luhn_sum(F.concat(h, F.lit("0"))) % 10, F.lit(10)).cast("string")))

    def windows(s: Column) -> Column:
        """Rows (start, stop, size) of the groups that are cards. ``s``: groups, ends (digits up to each group, from 0), digits."""
        window = "struct<start:int,stop:int,size:int>"

        def written(i: Column, n: Column) -> Column:
            size = lambda k: F.length(F.get(s.groups, i + k))
            fours = (size(0) == 4) & (size(1) == 4) & (size(2) == 4)
            four = fours & (size(3) <= 4) & ((n == 4) | ((n == 5) & (size(3) == 4) & (size(4) <= 3)))
            return (n == 1) | ((n == 3) & (size(0) == 4) & (size(1) == 6) & size(2).isin(4, 5)) | four

        def of_length(taken: Column, size: Column) -> Column:
            def step(state: Column, i: Column) -> Column:
                before = F.get(s.ends, i)
                n = F.array_position(F.slice(s.ends, i + 2, F.lit(5)), before + size).cast("int")
                digits = F.substring(s.digits, before + 1, size)
                free = (i >= state.next) & ~F.exists(taken, lambda t: (t.start < i + n) & (t.stop > i))
                found = (n > 0) & F.coalesce(written(i, n), F.lit(False)) & free & digits.rlike("[1-9]") & (luhn_sum(digits) % 10 == 0)
                new = F.array(F.struct(i.alias("start"), (i + n).alias("stop"), size.alias("size")))
                return F.struct(F.when(found, i + n).otherwise(state.next).alias("next"), F.when(found, F.concat(state.found, new)).otherwise(state.found).alias("found"))

            start = F.struct(F.lit(0).alias("next"), F.array().cast(f"array<{window}>").alias("found"))
            return F.concat(taken, F.aggregate(F.sequence(F.lit(0), F.size(s.groups) - 1), start, step, lambda x: x.found))

        return F.aggregate(F.array(*map(F.lit, CARD_LENGTHS)), F.array().cast(f"array<{window}>"), of_length)

    def replaced(s: Column, found: Column) -> Column:
        place = lambda w: F.get(s.ends, w)

        def piece(w: Column, n: Column) -> Column:
            from_ = F.when(n > 0, place(F.get(found, n - 1).stop)).otherwise(0)
            return F.concat(F.substring(s.digits, from_ + 1, place(w.start) - from_), pseudonym(F.substring(s.digits, place(w.start) + 1, w.size)))

        last = place(F.element_at(found, -1).stop)
        digits = F.concat(F.array_join(F.transform(found, piece), ""), F.substring(s.digits, last + 1, F.length(s.digits)))
        seps = F.concat(F.array(F.lit("")), F.regexp_extract_all(m, F.lit("[ -]"), F.lit(0)))
        grouped = lambda d: F.zip_with(seps, F.transform(s.groups, lambda g, i: F.substring(d, place(i) + 1, F.length(g))), lambda x, g: F.concat(x, g))
        return _let(digits, lambda d: F.array_join(grouped(d), ""))

    def written(s: Column) -> Column:
        return _let(F.array_sort(windows(s)), lambda w: F.when(F.size(w) > 0, F.struct(replaced(s, w).alias("text"), F.size(w).alias("n"))))

    groups = F.split(m, "[ -]")
    ends = lambda g: F.aggregate(g, F.array(F.lit(0)), lambda e, x: F.concat(e, F.array(F.element_at(e, -1) + F.length(x))))
    return _let(groups, lambda g: _let(F.struct(g.alias("groups"), ends(g).alias("ends"), _digits(m).alias("digits")), written))


def mod97(text: Column) -> Column:
    """The remainder of a bank account number whose letters stand for 10 to 35."""
    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _iban(m: Column, key: str) -> Column:
    def moved(plain: Column) -> Column:
        country, account = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))
        number = F.when(F.length(_digits(account)) > 1, _filled(account, _permuted_digits(_digits(account), F.concat(F.lit("iban"), country), key))).otherwise(account)

        def whole(x: Column) -> Column:
            check = F.lpad((F.lit(98) - mod97(F.concat(x, country, F.lit("00")))).cast("string"), 2, "0")
            return _filled(m, _digits(F.concat(country, check, x)))

        return _let(number, whole)

    valid = lambda p: (mod97(F.concat(F.substring(p, F.lit(5), F.length(p)), F.substring(p, 1, 4))) == 1)
    return _let(F.regexp_replace(m, " ", ""), lambda p: F.when(valid(p), moved(p)))


def _ssn(m: Column, key: str) -> Column:
    """Areas 001 to 899 without 666, groups from 01, serials from 0001."""
    area, group, serial = F.substring(m, 1, 3).cast("int"), F.substring(m, 5, 2).cast("int"), F.substring(m, 8, 4).cast("int")
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    left = (area - 1 - F.when(area > 666, 1).otherwise(0)) * 99 + group - 1

    def written(x: Column) -> Column:
        of_area = F.floor(x.l / 99) + 1
        return F.format_string("%03d-%02d-%04d", of_area + F.when(of_area >= 666, 1).otherwise(0), x.l % 99 + 1, x.r + 1)

    return F.when(valid, _let(feistel(left, serial - 1, 898 * 99, 9999, "ssn", key), written))


def _phone(m: Column, key: str) -> Column:
    """US numbers: ten digits whose area and exchange begin with 2 to 9; a country code stays. International numbers:
    8 to 15 digits, of which the first two stay."""
    def moved(d: Column) -> Column:
        ten = F.substring(d, -10, 10)
        left = (F.substring(ten, 1, 3).cast("int") - 200) * 800 + F.substring(ten, 4, 3).cast("int") - 200
        state = feistel(left, F.substring(ten, 7, 4).cast("int"), 640_000, 10_000, "phone", key)
        code = F.substring(d, F.lit(1), F.length(d) - 10)
        return _let(state, lambda x: _filled(m, F.concat(code, F.format_string("%03d%03d%04d", F.floor(x.l / 800) + 200, x.l % 800 + 200, x.r))))

    def abroad(d: Column) -> Column:
        rest = _permuted_digits(F.substring(d, F.lit(3), F.length(d)), F.concat(F.lit("phone+"), F.substring(d, 1, 2)), key)
        return F.when(F.length(d).between(8, 15), _filled(m, F.concat(F.substring(d, 1, 2), rest)))

    return _let(_digits(m), lambda d: F.when(m.rlike(r"^\+[2-9]"), abroad(d)).otherwise(moved(d)))


def _ip(m: Column, key: str) -> Column:
    def moved(o: Column) -> Column:
        n = lambda i: o[i].cast("int")
        state = feistel(n(0) * 256 + n(1), n(2) * 256 + n(3), 65_536, 65_536, "ip", key)
        return _let(state, lambda x: F.format_string("%d.%d.%d.%d", F.floor(x.l / 256), x.l % 256, F.floor(x.r / 256), x.r % 256))

    return _let(F.split(m, r"\."), lambda o: F.when(F.forall(o, lambda x: x.cast("int") < 256), moved(o)))


def _date(m: Column, key: str) -> Column:
    """Year-month-day with hyphens, day.month.year with stops, month/day/year with slashes."""
    iso, german = m.contains("-"), m.contains(".")
    text = F.when(iso, m).when(german, F.concat(F.substring(m, 7, 4), F.lit("-"), F.substring(m, 4, 2), F.lit("-"), F.substring(m, 1, 2))).otherwise(
        F.concat(F.substring(m, 7, 4), F.lit("-"), F.substring(m, 1, 2), F.lit("-"), F.substring(m, 4, 2))
    )
    same = m.rlike(r"^([0-9]{4}-..-..|..\...\..{4}|../../.{4})$")

    def moved(day: Column) -> Column:
        state = feistel(F.floor(day / DAYS[1]), day % DAYS[1], DAYS[0], DAYS[1], "date", key)
        to = lambda x: F.date_add(F.lit(FIRST_DAY).cast("date"), (x.l * DAYS[1] + x.r).cast("int"))
        return _let(state, lambda x: F.when(iso, F.date_format(to(x), "yyyy-MM-dd")).when(german, F.date_format(to(x), "dd.MM.yyyy")).otherwise(F.date_format(to(x), "MM/dd/yyyy")))

    number = F.datediff(text.try_cast("date"), F.lit(FIRST_DAY).cast("date"))
    return _let(number, lambda d: F.when(same & d.between(0, DAYS[0] * DAYS[1] - 1), moved(d)))


def _email(m: Column, key: str) -> Column:
    """Letters and digits of the local part move within their class; signs and the domain stay."""
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)

    def shifted(half: Column, other: Column, n: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), n.cast("string"), F.length(half).cast("string"), other), 256)

        def each(c: Column, i: Column, d: Column) -> Column:
            by = F.conv(F.substring(d, (i % 16) * 4 + 1, F.lit(4)), 16, 10).cast("int")
            code = F.ascii(c)
            move = lambda first, size: F.char(F.lit(first) + (code - first + by) % size)
            return F.when(c.rlike("[a-z]"), move(97, 26)).when(c.rlike("[A-Z]"), move(65, 26)).when(c.rlike("[0-9]"), move(48, 10)).otherwise(c)

        return _let(digest, lambda d: F.array_join(F.transform(F.split(half, ""), lambda c, i: each(c, i, d)), ""))

    def turn(state: Column, n: Column) -> Column:
        odd = n % 2 == 1
        return F.struct(F.when(odd, shifted(state.l, state.r, n)).otherwise(state.l).alias("l"), F.when(odd, state.r).otherwise(shifted(state.r, state.l, n)).alias("r"))

    half = F.ceil(F.length(local) / 2).cast("int")
    start = F.struct(F.substring(local, F.lit(1), half).alias("l"), F.substring(local, half + 1, F.length(local)).alias("r"))
    return _let(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn), lambda x: F.concat(x.l, x.r, F.lit("@"), domain))


def _one(replace):
    """``replace`` of a match, as (text, 1), or null."""
    return lambda m, key: _let(replace(m, key), lambda x: F.when(x.isNotNull(), F.struct(x.alias("text"), F.lit(1).alias("n"))))


REPLACE = {"email": _one(_email), "iban": _one(_iban), "date": _one(_date), "ssn": _one(_ssn), "phone": _one(_phone), "ip": _one(_ip), "card": _card}


def _cut(text: Column, pattern: str, guard: Column, replace) -> Column:
    """(pieces between the matches, matches, their (text, n)) of a text; null if the guard excludes it."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(guard, _let(found, lambda f: F.struct(F.split(text, pattern, -1).alias("pieces"), f.alias("found"), F.transform(f, replace).alias("done"))))


def _woven(pieces: Column, between: Column) -> Column:
    return F.array_join(F.zip_with(pieces, between, lambda p, b: F.concat(p, F.coalesce(b, F.lit("")))), "")


def session_key(spark: SparkSession) -> str:
    """The key of the session's settings; one is drawn where there is none."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key


def pseudonymise(docs: DataFrame, key: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, a count for each kind (n_email ...), n_pii, and the text with pseudonyms."""
    key = key or session_key(docs.sparkSession)
    text = F.col("text")
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    own = "[" + "".join(SIGNS.values()) + "]"
    as_is = lambda m: F.struct(m.alias("text"), F.lit(0).alias("n"))
    cut = rows.withColumn("own", _cut(text, own, text.rlike(own), as_is)).withColumn("rest", F.coalesce(_woven(F.col("own.pieces"), F.transform("own.found", lambda m: F.lit(SIGNS["own"]))), text))
    some = F.col("rest").rlike("[0-9@]")
    for kind in KINDS:
        guard = (some if kind in ("email", "card") else F.lit(True)) & F.col("rest").rlike(GUARDS[kind])
        replace, sign = REPLACE[kind], SIGNS[kind]
        cut = cut.withColumn(kind, _cut(F.col("rest"), PATTERNS[kind], guard, lambda m: replace(m, key)))  # noqa: B023
        signs = F.zip_with(F.col(kind).found, F.col(kind).done, lambda m, r: F.when(r.isNull(), m).otherwise(F.lit(sign)))  # noqa: B023
        cut = cut.withColumn("rest", F.coalesce(_woven(F.col(kind).pieces, signs), F.col("rest")))
    back = F.col("rest")
    for kind in reversed(("own", *KINDS)):
        sign, values = SIGNS[kind], F.transform(F.filter(F.col(kind).done, lambda r: r.isNotNull()), lambda r: r.text)
        back = F.when(F.col(kind).isNull(), back).otherwise(_let(back, lambda x: _woven(F.split(x, sign, -1), values)))  # noqa: B023
    n = lambda kind: F.coalesce(F.aggregate(F.col(kind).done, F.lit(0), lambda total, r: total + F.coalesce(r.n, F.lit(0))), F.lit(0)).cast("long")
    counted = cut.select("id", *[n(kind).alias(f"n_{kind}") for kind in KINDS], back.alias("text"))
    total = sum((F.col(f"n_{kind}") for kind in KINDS[1:]), F.col(f"n_{KINDS[0]}"))
    return counted.select(F.col("id").alias(id_column), *[f"n_{kind}" for kind in KINDS], total.alias("n_pii"), "text")
