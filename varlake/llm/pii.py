"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

Validated numbers and dates are mapped by a keyed Feistel network onto their own format: a value is two digits of a mixed
radix (a, b), and rounds add a keyed hash of the one to the other, which permutes all a * b values. So equal values have
equal pseudonyms in all documents, different values different ones, and the key's owner can map them back.
Addresses of mail get a keyed name of the same format.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

ROUNDS = 8
# Dates are permuted within three ranges, so that usual years stay usual ones. A range has its first month, the days
# of it that belong to the range before, a * b days, and late_a * late_b days that come after the LATE-th of their month.
RANGES = (("0001-01-01", 0, 745, 931, 59, 7121), ("1900-01-01", 0, 250, 292, 28, 1579), ("2099-11-01", 12, 1231, 2344, 4, 436963))
LATE, MONTH = 12, 88497 / 4800  # a month has MONTH late days on average
# Valid social security numbers have areas 001-899 without 666, groups 01-99 and serials 0001-9999.
SSN_AREAS, SSN_GROUPS, SSN_SERIALS = 898, 99, 9999

# The shapes of candidates, in the order in which they are tried.
PATTERNS = {
    "email": r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]++@(?:[A-Za-z0-9-]++\.){1,126}[A-Za-z]{2,}+",
    "phone": r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4})(?![0-9])",
    "date": r"(?<![0-9.])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}|[0-9]{13,19})(?![0-9])",
}
# A domain has 127 labels at most (253 bytes), so no repetition in a pattern is unbounded but those of single characters, which don't recurse.
CANDIDATE = "|".join(f"(?:{p})" for p in PATTERNS.values())


def feistel(a: Column, b: Column, size_a: Column, size_b: Column, kind: str, key: str, inverse: bool = False) -> Column:
    """struct(a, b), permuted; a is in [0, size_a) and b in [0, size_b)."""
    state = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    def keyed(i: Column, x: Column) -> Column:
        word = F.sha2(F.concat_ws(":", F.lit(key), F.lit(kind), size_a, size_b, i, x), 256)
        return F.conv(F.substring(word, 1, 15), 16, 10).cast("long")

    def step(s: Column, i: Column) -> Column:
        sign = -1 if inverse else 1
        even = F.struct(F.pmod(s["a"] + sign * F.pmod(keyed(i, s["b"]), size_a), size_a).alias("a"), s["b"].alias("b"))
        odd = F.struct(s["a"].alias("a"), F.pmod(s["b"] + sign * F.pmod(keyed(i, s["a"]), size_b), size_b).alias("b"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    rounds = range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS)
    return F.aggregate(F.array(*map(F.lit, rounds)), state, step)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def with_digits(m: Column, digits: Column) -> Column:
    """m with its digits, from the left, replaced by those given."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("i"))

    def put(acc: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        return F.struct(F.concat(acc["s"], F.when(is_digit, F.substr(digits, acc["i"], F.lit(1))).otherwise(c)).alias("s"), (acc["i"] + is_digit.cast("int")).alias("i"))

    return F.aggregate(F.split(m, ""), start, put, lambda acc: acc["s"])


def permuted_digits(digits: Column, kind: str, key: str, inverse: bool) -> Column:
    """A string of 2 to 18 digits mapped onto the strings of its length."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    power = lambda k: F.pow(F.lit(10.0), k).cast("long")
    a, b = F.substr(digits, F.lit(1), u).cast("long"), F.substr(digits, u + 1, n).cast("long")
    return let(feistel(a, b, power(u), power(n - u), kind, key, inverse), lambda s: F.concat(F.lpad(s["a"].cast("string"), u, F.lit("0")), F.lpad(s["b"].cast("string"), n - u, F.lit("0"))))


def luhn(digits: Column) -> Column:
    """The check digit that belongs after these digits."""
    n = F.length(digits)
    doubled = lambda i: F.substr(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 0, 2).otherwise(1)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + let(doubled(i), lambda d: d % 10 + F.floor(d / 10).cast("int")))
    return F.pmod(F.lit(10) - total % 10, F.lit(10)).cast("string")


def _card(m: Column, key: str, inverse: bool) -> Column:
    def mapped(d: Column) -> Column:
        body = F.substr(d, F.lit(1), F.length(d) - 1)
        new = let(permuted_digits(body, "card", key, inverse), lambda p: F.concat(p, luhn(p)))
        return F.when(luhn(body) == F.substr(d, F.length(d), F.lit(1)), with_digits(m, new))

    return let(digits_of(m), mapped)


def _phone(m: Column, key: str, inverse: bool) -> Column:
    return let(digits_of(m), lambda d: with_digits(m, F.concat(F.substr(d, F.lit(1), F.length(d) - 10), permuted_digits(F.right(d, F.lit(10)), "phone", key, inverse))))


def _range(date: Column) -> Column:
    """The range of RANGES that a date is in."""
    out = None
    for base, skip, *sizes in RANGES:
        row = F.struct(F.lit(base).cast("date").alias("base"), F.lit(skip).alias("skip"), *(F.lit(x).cast("long").alias(n) for n, x in zip(("a", "b", "late_a", "late_b"), sizes)))
        out = row if out is None else F.when(F.datediff(date, F.lit(base).cast("date")) >= skip, row).otherwise(out)
    return out


def _date(m: Column, key: str, inverse: bool) -> Column:
    """Slashes are read as month first, or as day first where that is no date; days first are mapped among themselves. Years are 0001 to 9999."""
    year_last = lambda month, day: F.concat_ws("-", F.right(m, F.lit(4)), F.substring(m, month, 2), F.substring(m, day, 2)).try_cast("date")
    plain = F.when(m.contains("-"), m.try_cast("date")).when(m.contains("/"), year_last(1, 4)).otherwise(year_last(4, 1))
    day_first = F.when(m.contains("/") & plain.isNull(), year_last(4, 1))

    def mapped(date: Column, r: Column) -> Column:
        n = (F.datediff(date, r["base"]) - r["skip"]).cast("long")
        new = let(n, lambda n: feistel(F.floor(n / r["b"]), n % r["b"], r["a"], r["b"], "date", key, inverse))
        back = let(new, lambda s: F.date_add(r["base"], (s["a"] * r["b"] + s["b"] + r["skip"]).cast("int")))
        written = let(back, lambda d: F.when(m.contains("-"), F.date_format(d, "yyyy-MM-dd")).when(m.contains("/"), F.date_format(d, "MM/dd/yyyy")).otherwise(F.date_format(d, "dd.MM.yyyy")))
        return F.when(n >= 0, written)

    def mapped_late(date: Column, r: Column) -> Column:
        """The same for the days after the LATE-th, which are numbered without the others."""
        start = lambda i: F.datediff(F.add_months(r["base"], i), r["base"]) - LATE * i
        late = (F.datediff(date, r["base"]) - LATE * ((F.year(date) - F.year(r["base"])) * 12 + F.month(date) - F.month(r["base"]) + 1)).cast("long")
        new = let(late, lambda k: feistel(F.floor(k / r["late_b"]), k % r["late_b"], r["late_a"], r["late_b"], "late", key, inverse))
        month = lambda k: let(F.floor(k / MONTH).cast("int"), lambda i: F.array_max(F.filter(F.sequence(i - 2, i + 2), lambda j: start(j) <= k)))
        written = let(let(new, lambda s: s["a"] * r["late_b"] + s["b"]), lambda k: F.date_format(F.date_add(r["base"], (k + LATE * (month(k) + 1)).cast("int")), "dd/MM/yyyy"))
        return F.when(late >= 0, written)

    ranged = lambda date, to: let(date, lambda d: F.when(d.isNotNull(), let(_range(d), lambda r: to(d, r))))
    return F.coalesce(ranged(plain, mapped), ranged(day_first, mapped_late))


def _ssn(m: Column, key: str, inverse: bool) -> Column:
    area, group, serial = (F.substring(m, *p).cast("long") for p in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    a = area - 1 - (area > 666).cast("int")
    new = feistel(a, (group - 1) * SSN_SERIALS + serial - 1, F.lit(SSN_AREAS), F.lit(SSN_GROUPS * SSN_SERIALS), "ssn", key, inverse)
    back = lambda s: s["a"] + 1 + (s["a"] >= 665).cast("int")
    return F.when(valid, let(new, lambda s: F.concat_ws("-", F.lpad(back(s).cast("string"), 3, "0"), F.lpad((F.floor(s["b"] / SSN_SERIALS) + 1).cast("string"), 2, "0"), F.lpad((s["b"] % SSN_SERIALS + 1).cast("string"), 4, "0"))))


def _ip(m: Column, key: str, inverse: bool) -> Column:
    def mapped(o: Column) -> Column:
        new = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), "ip", key, inverse)
        written = let(new, lambda s: F.concat_ws(".", F.floor(s["a"] / 256), s["a"] % 256, F.floor(s["b"] / 256), s["b"] % 256))
        return F.when(F.forall(o, lambda x: x <= 255) & ~m.rlike(r"(?:^|\.)0[0-9]"), written)

    return let(F.split(m, "\\.").cast("array<long>"), mapped)


def _email(m: Column, key: str, inverse: bool) -> Column:
    if inverse:
        return F.lit(None).cast("string")
    return F.concat(F.lit("p"), F.substring(F.sha2(F.concat_ws(":", F.lit(key), F.lit("email"), F.lower(m)), 256), 1, 16), F.lit("@example.com"))


MAPS = {"email": _email, "phone": _phone, "date": _date, "ssn": _ssn, "ip": _ip, "card": _card}


def kind_of(m: Column) -> Column:
    """The kind whose shape the match has."""
    out = F.when(m.contains("@"), "email")
    out = out.when(m.rlike(r"^(?:\+|\()|^[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}$"), "phone")
    out = out.when(m.rlike(r"^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})$"), "date")
    out = out.when(m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn").when(m.contains("."), "ip")
    return out.otherwise("card")


def pseudonym(m: Column, key: str, inverse: bool = False) -> Column:
    """struct(kind, new) of a candidate; new is null where it isn't valid."""

    def mapped(kind: Column) -> Column:
        new = F.lit(None).cast("string")
        for name, to in MAPS.items():
            new = F.when(kind == name, to(m, key, inverse)).otherwise(new)
        return F.struct(kind.alias("kind"), new.alias("new"))

    return let(kind_of(m), mapped)


def pseudonymise(docs: DataFrame, key: str, inverse: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Columns doc_id, text with all valid personal data replaced, found array<struct(kind, value, new)> in order of place; one row for each row of docs.

    inverse maps numbers and dates back under the same key (addresses of mail can't be mapped back). Candidates that aren't
    valid (a failing check digit, no such day or the year 0000, an octet over 255 or with a leading zero) stay as they are. Dates are mapped within
    their range of RANGES: 0001-01-01 to 1899-12-31, to 2099-11-12, to 9999-12-31. Of a domain of more than 127 labels the
    first ones count. Null texts stay null and empty ones empty, with nothing found; repeated rows stay; other columns aren't read.
    """
    text = F.col("text")
    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").alias("text"))
    some = text.rlike("[0-9@]")
    empty = F.array().cast("array<string>")
    rows = rows.withColumn("values", F.when(some, F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))).otherwise(empty))
    rows = rows.withColumn("maps", F.transform("values", lambda m: pseudonym(m, key, inverse)))
    gaps = F.split("text", CANDIDATE, -1)
    put = lambda g, i: F.concat(g, F.coalesce(F.get(F.col("maps"), i)["new"], F.get(F.col("values"), i), F.lit("")))
    new = F.when(F.exists("maps", lambda m: m["new"].isNotNull()), F.array_join(F.transform(gaps, put), "")).otherwise(text)
    found = F.zip_with("values", "maps", lambda v, m: F.struct(m["kind"].alias("kind"), v.alias("value"), m["new"].alias("new")))
    return rows.select("doc_id", new.alias("text"), F.filter(found, lambda x: x["new"].isNotNull()).alias("found"))
