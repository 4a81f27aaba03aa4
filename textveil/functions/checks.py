"""Check digits, digit clean-up and entropy as Column functions. Null strings give false, 0 or null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scan import bound


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, r"\D", "")


def _digit(d: Column, k: int) -> Column:
    return F.substring(d, k + 1, 1).cast("int")


def _weighted(d: Column, weights: list[int]) -> Column:
    """The sum of the first digits by their weights."""
    each = F.zip_with(F.split(F.left(d, F.lit(len(weights))), ""), F.lit(weights), lambda x, w: x.cast("int") * w)
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def _check(d: Column, weights: list[int]) -> Column:
    return _weighted(d, weights) % 11 % 10 == _digit(d, len(weights))


# The official weights of the taxpayer number, 10 and 12 digits.
INN_10 = [2, 4, 10, 3, 5, 9, 4, 6, 8]
INN_11 = [7, 2, 4, 10, 3, 5, 9, 4, 6, 8]
INN_12 = [3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8]


def _of_digits(s: Column, check) -> Column:
    """``check`` of the digits and their number, which are taken out of the string once."""
    return F.coalesce(bound(digits_of(s), lambda d: check(d, F.length(d))), F.lit(False))


def is_valid_inn(s: Column) -> Column:
    return _of_digits(s, lambda d, n: F.when(n == 10, _check(d, INN_10)).when(n == 12, _check(d, INN_11) & _check(d, INN_12)))


def is_valid_snils(s: Column) -> Column:
    def check(d: Column, n: Column) -> Column:
        rest = _weighted(d, list(range(9, 0, -1))) % 101
        return F.when(n == 11, F.when(rest >= 100, 0).otherwise(rest) == F.substring(d, 10, 2).cast("int"))

    return _of_digits(s, check)


def _remainder(s: Column, size: int, by: int) -> Column:
    return _of_digits(s, lambda d, n: F.when(n == size, F.substring(d, 1, size - 1).cast("bigint") % by % 10 == _digit(d, size - 1)))


def is_valid_ogrn(s: Column) -> Column:
    return _remainder(s, 13, 11)


def is_valid_ogrnip(s: Column) -> Column:
    return _remainder(s, 15, 13)


def is_valid_luhn(s: Column) -> Column:
    return _of_digits(s, lambda d, n: (n > 0) & F.call_function("luhn_check", d))


def luhn_fixed(s: Column) -> Column:
    """The string with its last digit replaced so that Luhn holds; strings without digits stay."""
    d = digits_of(s)
    trial = F.sequence(F.lit(0), F.lit(9))
    last = F.element_at(F.filter(trial, lambda x: F.call_function("luhn_check", F.concat(F.substr(d, F.lit(1), F.length(d) - 1), x.cast("string")))), 1)
    return F.when(d == "", s).otherwise(F.concat(F.regexp_extract(s, r"(?s)^(.*)\d\D*$", 1), last.cast("string"), F.regexp_extract(s, r"(?s)^.*\d(\D*)$", 1)))


def entropy(s: Column) -> Column:
    """Shannon entropy over characters, base 2; under two characters 0."""
    n = F.length(s)
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    share = lambda c: (n - F.length(F.replace(s, c, F.lit("")))) / n
    return F.when(n < 2, F.lit(0.0)).otherwise(F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c))))
