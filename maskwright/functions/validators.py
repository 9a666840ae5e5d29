"""Checksums and number plans as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import values as V
from .arrays import let
from .rx import java


def strip_separators(x: Column) -> Column:
    return F.regexp_replace(x, "[ -]", "")


def _digit(s: Column, one_based: Column) -> Column:
    return F.substring(s, one_based, F.lit(1)).cast("int")


def _weighted(s: Column, weights) -> Column:
    total = F.lit(0)
    for i, w in enumerate(weights):
        total = total + F.substring(s, i + 1, 1).cast("int") * F.lit(w)
    return total


def luhn_ok(digits: Column) -> Column:
    return F.coalesce(F.call_function("luhn_check", digits), F.lit(False))


# Verhoeff works in the dihedral group of order ten. Both tables follow from
# the group law and from powers of one permutation.
def _dihedral(a: int, b: int) -> int:
    turn = (a + b) if a < 5 else (a - b)
    return turn % 5 + (5 if (a < 5) != (b < 5) else 0)


def _permutation_powers() -> str:
    row, rows = list(range(10)), []
    for _ in range(8):
        rows.append("".join(map(str, row)))
        row = [V.VERHOEFF_PERMUTATION[d] for d in row]
    return "".join(rows)


_PRODUCT = "".join(str(_dihedral(a, b)) for a in range(10) for b in range(10))
_POWERS = _permutation_powers()


def verhoeff_ok(digits: Column) -> Column:
    n = F.length(digits)
    state = F.aggregate(
        F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
        F.lit(0),
        lambda c, i: _digit(
            F.lit(_PRODUCT),
            c * 10 + 1 + _digit(F.lit(_POWERS), (i % 8) * 10 + 1 + _digit(digits, n - i))),
    )
    return F.when(digits.rlike(r"\A[0-9]+\z"), state == 0).otherwise(False)


def mod97_ok(s: Column) -> Column:
    def add(acc: Column, ch: Column) -> Column:
        return F.when(ch >= "A", acc * 100 + F.ascii(ch) - 55).otherwise(
            acc * 10 + ch.cast("int")) % 97

    rotated = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))
    return F.when(
        s.rlike(r"\A[A-Z0-9]{5,}\z"),
        F.aggregate(F.split(rotated, ""), F.lit(0),
                    lambda acc, ch: F.when(ch == "", acc).otherwise(add(acc, ch))) == 1,
    ).otherwise(False)


def iso7064_11_2_ok(s: Column) -> Column:
    check = (12 - _weighted(s, V.CN_ID_WEIGHTS) % 11) % 11
    last = F.upper(F.substring(s, 18, 1))
    return F.when(
        s.rlike(r"(?s)\A[0-9]{17}.\z"),
        last == F.when(check == 10, F.lit("X")).otherwise(check.cast("string")),
    ).otherwise(False)


def mod11_weighted(digits: Column, weights) -> Column:
    """Weighted sum modulo 11, or -1 when the input does not fit the weights."""
    return F.when(digits.rlike(rf"\A[0-9]{{{len(weights)}}}\z"),
                  _weighted(digits, weights) % 11).otherwise(-1)


def isbn13_ok(digits: Column) -> Column:
    return F.when(digits.rlike(r"\A[0-9]{13}\z"),
                  _weighted(digits, [1, 3] * 6 + [1]) % 10 == 0).otherwise(False)


def isbn10_ok(s: Column) -> Column:
    last = F.upper(F.substring(s, 10, 1))
    total = _weighted(s, range(10, 1, -1)) + F.when(last == "X", 10).otherwise(last.cast("int"))
    return F.when(s.rlike(r"\A[0-9]{9}[0-9Xx]\z"), total % 11 == 0).otherwise(False)


def card_network(digits: Column) -> Column:
    """Issuer by prefix and length, null when no network uses the combination."""
    n = F.length(digits)
    p1, p2, p4 = (F.substring(digits, 1, k).cast("int") for k in (1, 2, 4))
    return F.when(
        digits.rlike(r"\A[0-9]{13,19}\z"),
        F.when((p1 == 4) & n.isin(13, 16, 19), "visa")
        .when((n == 16) & (p2.between(51, 55) | p4.between(2221, 2720)), "mastercard")
        .when((n == 15) & p2.isin(34, 37), "amex")
        .when((n == 16) & ((p4 == 6011) | (p2 == 65) | p4.between(6440, 6499)), "discover")
        .when(n.isin(14, 16, 19) & (p2.between(30, 36) | (p2 == 38)), "diners")
        .when((n >= 16) & p4.between(3528, 3589), "jcb")
        .when((n >= 16) & (p2 == 62), "unionpay"),
    )


def iban_country_len(country: Column) -> Column:
    table = ",".join(f"{code}:{n}" for code, n in V.IBAN_LENGTHS.items())
    return F.try_element_at(F.str_to_map(F.lit(table)), country).cast("int")


def ipv4_public(address: Column) -> Column:
    def check(o: Column) -> Column:
        a, b = o[0], o[1]
        private = (
            a.isin(0, 10, 127) | (a >= 224)
            | ((a == 169) & (b == 254))
            | ((a == 172) & b.between(16, 31))
            | ((a == 192) & (b == 168))
        )
        return (F.size(o) == 4) & F.forall(o, lambda x: F.coalesce(x.between(0, 255), F.lit(False))) \
            & ~private
    octets = F.transform(F.split(address, r"\."), lambda p: p.try_cast("int"))
    return F.coalesce(let(octets, check), F.lit(False))


def _card(x):
    return let(strip_separators(x), lambda d: card_network(d).isNotNull() & luhn_ok(d))


def _iban(x):
    return let(F.upper(strip_separators(x)), lambda s: F.coalesce(
        s.rlike(r"\A[A-Z]{2}[0-9]{2}[A-Z0-9]+\z")
        & (iban_country_len(F.substring(s, 1, 2)) == F.length(s))
        & mod97_ok(s), F.lit(False)))


def _aadhaar(x):
    return let(strip_separators(x), lambda d: d.rlike(r"\A[0-9]{12}\z") & verhoeff_ok(d))


def _nhs(x):
    def check(d):
        digit = (11 - mod11_weighted(F.substring(d, 1, 9), V.NHS_WEIGHTS)) % 11
        return d.rlike(r"\A[0-9]{10}\z") & (digit != 10) & (digit == _digit(d, F.lit(10)))
    return let(strip_separators(x), check)


def _bsn(x):
    rest = mod11_weighted(F.substring(x, 1, 8), V.BSN_WEIGHTS)
    return x.rlike(r"\A[0-9]{9}\z") & ((rest - _digit(x, F.lit(9))) % 11 == 0)


VALIDATORS = {
    "card_pan": _card,
    "iban": _iban,
    "isbn_13": lambda x: isbn13_ok(strip_separators(x)),
    "aadhaar": _aadhaar,
    "cn_id": lambda x: iso7064_11_2_ok(F.upper(x)),
    "ipv4": ipv4_public,
    "imei": luhn_ok,
    "nhs_uk": _nhs,
    "bsn_nl": _bsn,
    "npi_us": lambda x: luhn_ok(F.concat(F.lit("80840"), x)),
}


def secret_value_ok(value: Column) -> Column:
    """Long enough, more than letters, more than one repeated character."""
    return (
        (F.length(value) >= 12)
        & value.rlike("[^A-Za-z]")
        & ~value.rlike(java(r"^(.)\1+$").replace("^", r"\A", 1))
    )
