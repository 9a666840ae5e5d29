"""Rendering of the shared patterns for RE2, and SQL snippets for checksums."""

from __future__ import annotations

from maskwright import values as V
from maskwright.functions import validators
from maskwright.functions.rx import SPACE


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re2(pattern: str, ignore_case: bool = False) -> str:
    """ECMAScript pattern to an RE2 one: spaces spelled out, no look-around."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            nxt = pattern[i + 1]
            if nxt == "u":
                out.append(chr(int(pattern[i + 2:i + 6], 16)))
                i += 6
                continue
            out.append((SPACE if in_class else f"[{SPACE}]") if nxt == "s" else ch + nxt)
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "]" and in_class:
            in_class = False
        elif ch == "$" and not in_class:
            ch = r"\z"
        out.append(ch)
        i += 1
    return ("(?i)" if ignore_case else "") + "".join(out)


def has(text: str, pattern: str, ignore_case: bool = False) -> str:
    return f"regexp_matches({text}, {q(re2(pattern, ignore_case))})"


def re2_has(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {q(pattern)})"


def digits(x: str) -> str:
    return f"regexp_replace({x}, '[ -]', '', 'g')"


def luhn(d: str) -> str:
    v = f"TRY_CAST(substring({d}, length({d}) - i + 1, 1) AS INT)"
    return (f"(regexp_matches({d}, '^[0-9]+$') AND coalesce(list_sum(list_transform("
            f"range(1, length({d}) + 1), lambda i: CASE WHEN i % 2 = 0 THEN "
            f"{v} * 2 - CASE WHEN {v} > 4 THEN 9 ELSE 0 END ELSE {v} END)), 1) % 10 = 0)")


def verhoeff(d: str) -> str:
    step = (f"CAST(substring('{validators._POWERS}', CAST((i % 8) * 10 + 1 + "
            f"TRY_CAST(substring({d}, length({d}) - i, 1) AS INT) AS INT), 1) AS INT)")
    return (f"(regexp_matches({d}, '^[0-9]+$') AND list_reduce([0] || list_transform("
            f"range(0, length({d})), lambda i: {step}), lambda c, p: "
            f"CAST(substring('{validators._PRODUCT}', c * 10 + p + 1, 1) AS INT)) = 0)")


def mod97(s: str) -> str:
    chars = f"string_split(substring({s}, 5) || substring({s}, 1, 4), '')"
    value = "CASE WHEN x >= 'A' THEN ascii(x) - 55 ELSE CAST(x AS INT) END"
    return (f"CASE WHEN regexp_matches({s}, '^[A-Z0-9]{{5,}}$') THEN list_reduce([0] || "
            f"list_transform(list_filter({chars}, lambda x: x <> ''), lambda x: {value}), "
            f"lambda a, x: (CASE WHEN x > 9 THEN a * 100 ELSE a * 10 END + x) % 97) = 1 "
            f"ELSE false END")


def weighted(d: str, weights) -> str:
    ws = list(weights)
    return (f"list_sum(list_transform(range(1, {len(ws) + 1}), lambda i: "
            f"CAST(substring({d}, i, 1) AS INT) * {ws}[i]))")


def iso7064(s: str) -> str:
    check = f"CAST((12 - {weighted(s, V.CN_ID_WEIGHTS)} % 11) % 11 AS INT)"
    return (f"CASE WHEN regexp_matches({s}, '^[0-9]{{17}}[0-9Xx]$') THEN upper(substring({s}, 18, 1)) = "
            f"CASE WHEN {check} = 10 THEN 'X' ELSE CAST({check} AS VARCHAR) END ELSE false END")


def isbn13(d: str) -> str:
    return (f"CASE WHEN regexp_matches({d}, '^[0-9]{{13}}$') THEN "
            f"{weighted(d, [1, 3] * 6 + [1])} % 10 = 0 ELSE false END")


def isbn10(s: str) -> str:
    last = f"upper(substring({s}, 10, 1))"
    return (f"CASE WHEN regexp_matches({s}, '^[0-9]{{9}}[0-9Xx]$') THEN "
            f"({weighted(s, range(10, 1, -1))} + CASE WHEN {last} = 'X' THEN 10 "
            f"ELSE CAST({last} AS INT) END) % 11 = 0 ELSE false END")


def mod11(d: str, weights) -> str:
    n = len(list(weights))
    return (f"CASE WHEN regexp_matches({d}, '^[0-9]{{{n}}}$') THEN CAST({weighted(d, weights)} % 11 AS INT) "
            f"ELSE -1 END")


def nhs(x: str) -> str:
    d = digits(x)
    c = f"((11 - {mod11(f'substring({d}, 1, 9)', V.NHS_WEIGHTS)}) % 11)"
    return f"({c} <> 10 AND {c} = CAST(substring({d}, 10, 1) AS INT))"


def bsn(x: str) -> str:
    return f"(({mod11(f'substring({x}, 1, 8)', V.BSN_WEIGHTS)} - CAST(substring({x}, 9, 1) AS INT)) % 11 = 0)"


def network(d: str) -> str:
    p1, p2, p4 = (f"TRY_CAST(substring({d}, 1, {k}) AS INT)" for k in (1, 2, 4))
    n = f"length({d})"
    return (
        f"CASE WHEN NOT regexp_matches({d}, '^[0-9]{{13,19}}$') THEN NULL "
        f"WHEN {p1} = 4 AND {n} IN (13, 16, 19) THEN 'visa' "
        f"WHEN {n} = 16 AND ({p2} BETWEEN 51 AND 55 OR {p4} BETWEEN 2221 AND 2720) THEN 'mastercard' "
        f"WHEN {n} = 15 AND {p2} IN (34, 37) THEN 'amex' "
        f"WHEN {n} = 16 AND ({p4} = 6011 OR {p2} = 65 OR {p4} BETWEEN 6440 AND 6499) THEN 'discover' "
        f"WHEN {n} IN (14, 16, 19) AND {p2} IN (30, 31, 32, 33, 34, 35, 36, 38) THEN 'diners' "
        f"WHEN {n} >= 16 AND {p4} BETWEEN 3528 AND 3589 THEN 'jcb' "
        f"WHEN {n} >= 16 AND {p2} = 62 THEN 'unionpay' END")


def card(x: str) -> str:
    return f"({network(digits(x))} IS NOT NULL AND {luhn(digits(x))})"


IBAN_VALUES = ", ".join(f"'{c}': {n}" for c, n in V.IBAN_LENGTHS.items())


def iban_len(country: str) -> str:
    return f"MAP {{{IBAN_VALUES}}}[{country}]"


def iban(x: str) -> str:
    s = f"upper({digits(x)})"
    return (f"coalesce(regexp_matches({s}, '^[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]+$') AND "
            f"{iban_len(f'substring({s}, 1, 2)')} = length({s}) AND {mod97(s)}, false)")


def ipv4(x: str) -> str:
    a, b = (f"CAST(split_part({x}, '.', {i}) AS INT)" for i in (1, 2))
    return (f"(NOT ({a} IN (0, 10, 127) OR {a} >= 224 OR ({a} = 169 AND {b} = 254) "
            f"OR ({a} = 172 AND {b} BETWEEN 16 AND 31) OR ({a} = 192 AND {b} = 168)))")


def secret_value(x: str) -> str:
    return (f"(length({x}) >= 12 AND regexp_matches({x}, '[^A-Za-z]') AND "
            f"length(replace({x}, substring({x}, 1, 1), '')) > 0)")


VALIDATORS = {
    "card_pan": card,
    "iban": iban,
    "isbn_13": lambda x: isbn13(digits(x)),
    "aadhaar": lambda x: verhoeff(digits(x)),
    "cn_id": iso7064,
    "ipv4": ipv4,
    "imei": luhn,
    "nhs_uk": nhs,
    "bsn_nl": bsn,
    "npi_us": lambda x: luhn(f"('80840' || {x})"),
}
