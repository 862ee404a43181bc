"""Format-preserving pseudonyms for personal data, by a keyed Feistel permutation.

One regular expression finds the values of every kind; a value that also passes its
kind's check (Luhn sum, octets, calendar, area codes) is turned into digits, each with its
own radix. A Feistel network over those digits permutes all values of the format: the two
halves take turns in being shifted, digit by digit, by an md5 of key, kind, round and the
other half. Shifting is undone by subtracting, so the map is one to one, and it is the
same for every spelling of a value, so equal values stay linked across documents. The
digits are then written back into the value's own layout.

kind     checked by                     permuted
email    pattern                        letters by case and digits of name and domain, not the top-level domain
ip       four octets up to 255          the octets
phone    area and exchange code 2-9     all ten digits, those two staying 2-9
card     Luhn sum, 13 to 19 digits      all but the last, which is computed anew
ssn      area, group and serial valid   the three numbers, among valid ones
date     calendar day from 1900 to 2099 day, month and year, among days of its class
secret   hexadecimal 32 to 64, AKIA...  the digits, in their alphabet

Dates have four classes, by day: up to 12, to 28, later, and 29 February. A day above 12 shows
whether day or month comes first, and stays above 12, so the same date gets the same
pseudonym in every layout that shows its meaning, and the way back reads it the same. A date
with both up to 12 is read month first.

Everything is built-in functions in one scan without a shuffle: the text is split at the
matches, the matches are transformed as an array, and both are joined again.

Odd rows: a null text stays null and an empty one empty; a null doc_id is kept; repeated
rows get equal results; an empty table gives no rows; other columns are kept as they are,
but for one named ``n_values``, which is replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

#: What may not stand before a value, the value, and what may not follow it; tried in this
#: order at every place of a text.
VALUES = {
    "email": ("", r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9][A-Za-z0-9.-]{0,200}\.[A-Za-z]{2,12}", ""),
    "ip": (r"(?<![\d.])", r"\d{1,3}(?:\.\d{1,3}){3}", r"(?!\d|\.\d)"),
    "date": (r"(?<![\d/.-])", r"(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4})", r"(?!\d|[/-]\d)"),
    "ssn": (r"(?<![\d-])", r"\d{3}-\d{2}-\d{4}", r"(?!\d|-\d)"),
    "phone": (r"(?<!\w)", r"(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}", r"(?!\d)"),
    "card": (r"(?<!\w)", r"\d(?:[ -]?\d){12,18}", r"(?!\d)"),
    "secret": (r"(?<![A-Za-z0-9])", r"(?:[0-9a-f]{32,64}|AKIA[0-9A-Z]{16})", r"(?![A-Za-z0-9])"),
}
ANY = "|".join(before + value + after for before, value, after in VALUES.values())

#: A character's class is an alphabet; its digit is its place there.
_LOWER, _UPPER, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_HEX, _BASE36 = "0123456789abcdef", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def feistel(digits: Column, radix: Column, key: str, kind: str, back: bool = False) -> Column:
    """The permuted digits of an array of digits below the radixes of the array ``radix``.

    An array of fewer than two digits is shifted by the key alone. ``back`` inverts.
    """
    n = F.size(digits)
    half = F.floor(n / 2).cast("int")
    sign = -1 if back else 1

    def shifted(values: Column, radixes: Column, other: Column, turn: int) -> Column:
        seed = F.concat_ws("|", F.lit(f"{key}|{kind}|{turn}"), F.array_join(other, ","))
        return F.zip_with(
            F.zip_with(values, F.sequence(F.lit(1), F.size(values)), lambda v, i: F.struct(v.alias("v"), i.alias("i"))),
            radixes,
            lambda s, r: F.pmod(
                s["v"] + sign * F.conv(F.substring(F.md5(F.concat_ws("|", seed, s["i"])), 1, 12), 16, 10).cast("long"), r
            ),
        )

    left, right = F.slice(digits, 1, half), F.slice(digits, half + 1, n - half)
    left_radix, right_radix = F.slice(radix, 1, half), F.slice(radix, half + 1, n - half)
    state = F.struct(left.alias("l"), right.alias("r"))

    def left_turn(turn: int) -> Callable[[Column], Column]:
        return lambda s: F.struct(_unless_empty(s["l"], shifted(s["l"], left_radix, s["r"], turn)).alias("l"), s["r"].alias("r"))

    def right_turn(turn: int) -> Callable[[Column], Column]:
        return lambda s: F.struct(s["l"].alias("l"), _unless_empty(s["r"], shifted(s["r"], right_radix, s["l"], turn)).alias("r"))

    turns = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)
    for turn in turns:
        # The state is bound by a one-element transform, so that each round computes it once.
        state = _bound(state, right_turn(turn) if turn % 2 == 0 else left_turn(turn))
    return _bound(state, lambda s: F.concat(s["l"], s["r"]))


def _unless_empty(values: Column, moved: Column) -> Column:
    """sequence(1, 0) would count down, so an empty half is left as it is."""
    return F.when(F.size(values) == 0, values).otherwise(moved)


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _letter(alphabet: str, digit: Column) -> Column:
    return F.substring(F.lit(alphabet), (digit + 1).cast("int"), F.lit(1))


def _by_class(text: Column, classes: list[str], key: str, kind: str, back: bool) -> Column:
    """Characters of the classes permuted within their class; others stay where they are."""
    chars = _chars(text)

    def radix(c: Column) -> Column:
        out = F.lit(1)
        for a in classes:
            out = F.when(F.instr(F.lit(a), c) > 0, F.lit(len(a))).otherwise(out)
        return out.cast("long")

    def digit(c: Column) -> Column:
        out = F.lit(0)
        for a in classes:
            out = F.when(F.instr(F.lit(a), c) > 0, F.instr(F.lit(a), c) - 1).otherwise(out)
        return out.cast("long")

    moved = feistel(F.transform(chars, digit), F.transform(chars, radix), key, kind, back)

    def written(c: Column, d: Column) -> Column:
        out = c
        for a in classes:
            out = F.when(F.instr(F.lit(a), c) > 0, _letter(a, d)).otherwise(out)
        return out

    return F.array_join(F.zip_with(chars, moved, written), "")


def _digits(text: Column) -> Column:
    return F.transform(_chars(F.regexp_replace(text, r"\D", "")), lambda c: c.cast("long"))


def _laid_out(layout: Column, digits: Column) -> Column:
    """The layout's digits replaced by ``digits``, one after another."""
    chars = _chars(layout)
    is_digit = lambda c: c.rlike(r"^\d$")
    numbered = F.aggregate(
        chars,
        F.struct(F.lit("").alias("t"), F.lit(0).alias("n")),
        lambda s, c: F.struct(
            F.concat(s["t"], F.when(is_digit(c), F.element_at(digits, s["n"] + 1).cast("string")).otherwise(c)).alias("t"),
            (s["n"] + is_digit(c).cast("int")).alias("n"),
        ),
        lambda s: s["t"],
    )
    return numbered


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of digits whose last one is not doubled."""
    n = F.size(digits)
    doubled = F.zip_with(
        digits,
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda d, i: F.when((n - i) % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d),
    )
    return F.aggregate(doubled, F.lit(0).cast("long"), lambda a, d: a + F.coalesce(d, F.lit(0)))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _email(v: Column, key: str, back: bool) -> Column:
    top = F.regexp_extract(v, r"\.[A-Za-z]+$", 0)
    body = F.substring(v, F.lit(1), F.length(v) - F.length(top))
    return F.concat(_by_class(body, [_LOWER, _UPPER, _DIGIT], key, "email", back), top)


def _ip(v: Column, key: str, back: bool) -> Column:
    octets = F.transform(F.split(v, r"\."), lambda o: o.cast("long"))
    moved = feistel(octets, F.array(*[F.lit(256).cast("long")] * 4), key, "ip", back)
    return F.when(F.forall(octets, lambda o: o < 256), F.array_join(moved, ".")).otherwise(v)


def _offset(digits: Column, least: list[int], sign: int) -> Column:
    return F.zip_with(digits, F.array(*[F.lit(x) for x in least]), lambda d, x: (d + sign * x).cast("long"))


def _phone(v: Column, key: str, back: bool) -> Column:
    least = [2, 0, 0, 2, 0, 0, 0, 0, 0, 0]

    def use(all_digits: Column) -> Column:
        own = F.slice(all_digits, -10, 10)
        radix = F.array(*[F.lit(10 - x).cast("long") for x in least])
        moved = _offset(feistel(_offset(own, least, -1), radix, key, "phone", back), least, 1)
        good = (F.size(all_digits) >= 10) & (own[0] > 1) & (own[3] > 1)
        whole = F.concat(F.slice(all_digits, 1, F.size(all_digits) - 10), moved)
        return F.when(good, _laid_out(v, whole)).otherwise(v)

    return F.when(F.length(F.regexp_replace(v, r"\D", "")) >= 10, _bound(_digits(v), use)).otherwise(v)


def _card(v: Column, key: str, back: bool) -> Column:
    def use(digits: Column) -> Column:
        n = F.size(digits)
        body = F.slice(digits, 1, n - 1)
        moved = feistel(body, F.transform(body, lambda _: F.lit(10).cast("long")), key, "card", back)
        numbered = _bound(
            moved, lambda m: F.concat(m, F.array(F.pmod(-_luhn_sum(F.concat(m, F.array(F.lit(0).cast("long")))), F.lit(10)).cast("long")))
        )
        return F.when(_luhn_sum(digits) % 10 == 0, _laid_out(v, numbered)).otherwise(v)

    return _bound(_digits(v), use)


def _longs(*values: Column | int) -> Column:
    return F.array(*[(F.lit(v) if isinstance(v, int) else v).cast("long") for v in values])


#: Valid areas are 1 to 899 but 666, groups 1 to 99, serials 1 to 9999.
_NO_AREA, _SSN_RADIX = 666, (898, 99, 9999)


def _ssn(v: Column, key: str, back: bool) -> Column:
    area, group, serial = (F.substring(v, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    place = area - 1 - (area > _NO_AREA).cast("int")

    def written(m: Column) -> Column:
        return F.format_string("%03d-%02d-%04d", m[0] + 1 + (m[0] + 1 >= _NO_AREA).cast("int"), m[1] + 1, m[2] + 1)

    moved = _bound(feistel(_longs(place, group - 1, serial - 1), _longs(*_SSN_RADIX), key, "ssn", back), written)
    good = area.between(1, 899) & (area != _NO_AREA) & (group > 0) & (serial > 0)
    return F.when(good, moved).otherwise(v)


_YEARS = (1900, 2099)
#: Days after the 28th, but 29 February: month and day as one number.
_LATE = [100 * m + d for m in range(1, 13) for d in range(29, 32) if m != 2 and (d < 31 or m in (1, 3, 5, 7, 8, 10, 12))]
#: 29 February comes 49 times, first in 1904.
_LEAP = (1904, 7)


def _date(v: Column, key: str, back: bool) -> Column:
    """A calendar day moved within its class and written in its own layout."""
    iso, first = v.contains("-"), F.substring(v, 1, 2).cast("int")
    day_first = ~iso & (first > 12)
    cut = lambda a, n: F.substring(v, a, n).cast("int")
    given = F.struct(
        F.when(iso, cut(1, 4)).otherwise(cut(7, 4)).alias("y"),
        F.when(iso, cut(6, 2)).when(day_first, cut(4, 2)).otherwise(first).alias("m"),
        F.when(iso, cut(9, 2)).when(day_first, first).otherwise(cut(4, 2)).alias("d"),
    )
    late_days = F.array(*[F.lit(x) for x in _LATE])

    def use(t: Column) -> Column:
        y, m, d = t["y"], t["m"], t["d"]
        early, middle, leap = d <= 12, d <= 28, (d == 29) & (m == 2)
        year, nth = y - _YEARS[0], F.floor((y - _LEAP[0]) / 4)
        digits = (
            F.when(early, _longs(d - 1, m - 1, year))
            .when(middle, _longs(d - 13, m - 1, year))
            .when(leap, _longs(F.floor(nth / _LEAP[1]), nth % _LEAP[1]))
            .otherwise(_longs(F.array_position(late_days, 100 * m + d) - 1, year))
        )
        radix = (
            F.when(early, _longs(12, 12, 200))
            .when(middle, _longs(16, 12, 200))
            .when(leap, _longs(_LEAP[1], _LEAP[1]))
            .otherwise(_longs(len(_LATE), 200))
        )

        def written(n: Column) -> Column:
            late = F.element_at(late_days, (n[0] + 1).cast("int"))
            new_d = F.when(early, n[0] + 1).when(middle, n[0] + 13).when(leap, F.lit(29)).otherwise(late % 100)
            new_m = F.when(middle, n[1] + 1).when(leap, F.lit(2)).otherwise(F.floor(late / 100))
            new_y = F.when(middle, n[2] + _YEARS[0]).when(leap, _LEAP[0] + 4 * (_LEAP[1] * n[0] + n[1])).otherwise(n[1] + _YEARS[0])
            new_y, new_m, new_d = (x.cast("int") for x in (new_y, new_m, new_d))
            return (
                F.when(iso, F.format_string("%04d-%02d-%02d", new_y, new_m, new_d))
                .when(day_first, F.format_string("%02d/%02d/%04d", new_d, new_m, new_y))
                .otherwise(F.format_string("%02d/%02d/%04d", new_m, new_d, new_y))
            )

        real = F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd").isNotNull()
        good = real & y.between(*_YEARS)
        return F.when(good, _bound(feistel(digits, radix, key, "date", back), written)).otherwise(v)

    return _bound(given, use)


def _secret(v: Column, key: str, back: bool) -> Column:
    body = F.substring(v, F.lit(5), F.length(v))
    amazon = F.concat(F.lit("AKIA"), _by_class(body, [_BASE36], key, "access key", back))
    return F.when(v.startswith("AKIA"), amazon).otherwise(_by_class(v, [_HEX], key, "secret", back))


MAPS = {"email": _email, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card, "secret": _secret}


def pseudonym(value: Column, key: str, back: bool = False) -> Column:
    """The pseudonym of one value in its format; a value that fails its check stays."""
    out = value
    for kind, (_, pattern, _) in reversed(VALUES.items()):
        out = F.when(value.rlike(f"^(?:{pattern})$"), MAPS[kind](value, key, back)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, column: str = "text", back: bool = False) -> DataFrame:
    """``docs`` with personal values of ``column`` replaced and the number of replaced ones in ``n_values``.

    ``back`` gives the first values again. Who knows the key can do so: keep it secret.
    """
    names = {c.lower() for c in docs.columns}
    found, moved = "_found", "_moved"
    while found in names or moved in names:
        found, moved = f"_{found}", f"_{moved}"
    values = F.regexp_extract_all(F.col(column), F.lit(f"({ANY})"), F.lit(1))
    rows = docs.withColumn(found, F.coalesce(values, F.array().cast("array<string>")))
    rows = rows.withColumn(moved, F.transform(found, lambda v: pseudonym(v, key, back)))
    joined = F.array_join(_woven(F.split(F.col(column), ANY, -1), F.col(moved)), "")
    changed = F.size(F.filter(F.zip_with(found, moved, lambda a, b: a != b), lambda x: x))
    return rows.withColumns(
        {column: F.when(F.size(found) > 0, joined).otherwise(F.col(column)), "n_values": changed.cast("long")}
    ).drop(found, moved)


def _woven(between: Column, values: Column) -> Column:
    """What stands between values, and values, in turn."""
    return F.zip_with(between, values, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))
