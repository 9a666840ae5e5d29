"""Identifier-shaped texts derived from the ``orders`` table.

The document tables hold few identifiers and no country signal. This relation
turns every order into a short text with a number built from its keys, valid
or not as the arithmetic falls, so that every detector, checksum and context
gate has rows to work on and the work grows with the table. The expressions
are plain SQL that both engines understand.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.arrays import with_once
from . import tables

# Digits, hex digits and letters to cut the identifiers from.
_H = "md5(CAST(o_orderkey AS STRING)) || md5(CAST(o_custkey + o_orderkey AS STRING))"
BASE_SQL = (
    f"SELECT o_orderkey, h, translate(h, 'abcdef', '012345') AS d, "
    f"translate(h, '0123456789abcdef', 'ABCDEFGHJKLMSTXZ') AS u "
    f"FROM (SELECT o_orderkey, {_H} AS h FROM orders)"
)


def _piece(source: str, n: int, salt: int) -> str:
    return f"substring({source}, {(salt * 7) % (62 - n) + 1}, {n})"


def _num(n: int, salt: int = 1) -> str:
    return _piece("d", n, salt)


def _letters(n: int, salt: int = 1) -> str:
    return _piece("u", n, salt + 2)


def _hex(n: int, salt: int = 1) -> str:
    return _piece("h", n, salt + 4)


def _octet(salt: int) -> str:
    return f"CAST(CAST({_num(3, salt)} AS INT) % 256 AS STRING)"


def _pick(alphabet: str, salt: int) -> str:
    return f"substring('{alphabet}', CAST(1 + CAST({_num(2, salt)} AS INT) % {len(alphabet)} AS INT), 1)"


# (text expression, country or None)
TEMPLATES: tuple[tuple[str, str | None], ...] = (
    (f"'Charge to 4' || {_num(15)} || ' today.'", None),
    (f"'Try 55' || {_num(2)} || '-' || {_num(4, 2)} || '-' || {_num(4, 3)} || '-' || {_num(4, 4)} || ' now, 1' || {_num(3)}", None),
    (f"'Wire to GB' || {_num(2)} || ' NWBK ' || {_num(4, 2)} || ' ' || {_num(4, 3)} || ' ' || {_num(4, 5)} || ' ' || {_num(2, 6)} || ' today.'", None),
    (f"'DE' || {_num(2)} || '3704004405320' || {_num(5, 2)}", "DE"),
    (f"'Wallet 0x' || {_hex(40)} || ' funded'", None),
    (f"'Book 978' || {_num(10)} || ' and 979' || {_num(10, 4)}", None),
    (f"'Reach +91' || {_num(10)} || ' or +1 ' || {_num(3, 2)} || ' ' || {_num(7, 3)}", "IN"),
    (f"'Aadhaar 2' || {_num(11)} || ' on file.'", "IN"),
    (f"'Resident ' || {_num(17)} || {_pick('0123456789X', 5)}", "CN"),
    (f"{_pick('STFGM', 2)} || {_num(7)} || {_letters(1)} || ' and ' || {_letters(1, 4)} || {_num(7, 2)} || {_letters(1, 3)}", "SG"),
    (f"'CURP ' || {_letters(4)} || {_num(6)} || {_pick('HMX', 3)} || {_letters(5, 5)} || {_num(2, 2)}", "MX"),
    (f"'ID 784-' || {_num(4)} || '-' || {_num(7, 2)} || '-' || {_num(1, 3)}", "AE"),
    (f"'NIE ' || {_pick('XYZW', 3)} || {_num(7)} || {_letters(1, 2)}", "ES"),
    (f"{_letters(6)} || {_num(2)} || {_letters(1, 7)} || {_num(2, 2)} || {_letters(1, 8)} || {_num(3, 3)} || {_letters(1, 9)}", "IT"),
    (f"'Flat ' || {_letters(2)} || {_num(1)} || ' ' || {_num(1, 2)} || {_letters(2, 3)}", "GB"),
    (f"'Ship K' || {_num(1)} || {_letters(1)} || ' ' || {_num(1, 2)} || {_letters(1, 2)} || {_num(1, 3)}", "CA"),
    (f"'host 2001:0db8:' || {_hex(4)} || '::' || {_hex(4, 5)} || ' up'", None),
    (f"{_hex(4)} || ':' || {_hex(4, 2)} || ':' || {_hex(4, 3)} || ':0:0:' || {_hex(4, 4)} || ':' || {_hex(4, 6)} || ':1'", None),
    (f"'At ' || {_num(2)} || '°' || {_num(2, 2)} || '′' || {_num(2, 3)} || '″' || {_pick('NSEWQ', 3)}", None),
    (f"'Plus 8FVC' || {_pick('23456789CFGHJMPQRVWX', 2)} || 'G8F+' || {_pick('23456789CFGHJMPQRVWXAB', 4)} || 'W'", None),
    (f"'NIC ' || {_hex(2)} || ':' || {_hex(2, 2)} || ':' || {_hex(2, 3)} || ':4D:5E:' || {_hex(2, 5)} || ' booted.'", None),
    (f"'server at ' || {_octet(1)} || '.' || {_octet(2)} || '.' || {_octet(3)} || '.' || {_octet(4)}", None),
    (f"'spare ' || {_octet(1)} || '.' || {_octet(2)} || '.' || {_octet(3)} || '.' || {_octet(4)} || ' boxes'", None),
    (f"'device id ' || {_num(15)}", None),
    (f"'SSN ' || {_num(3)} || '-' || {_num(2, 2)} || '-' || {_num(4, 3)} || ' on file.'", None),
    (f"'Badge ' || {_num(3)} || '-' || {_num(2, 2)} || '-' || {_num(4, 3)} || ' printed.'", "US"),
    (f"'Patient ' || {_num(3)} || ' ' || {_num(3, 2)} || ' ' || {_num(4, 3)} || ' record.'", None),
    (f"'BSN ' || {_num(9)} || ' op formulier.'", "NL"),
    (f"'NPI ' || {_num(10)} || ' on claim.'", "US"),
    (f"'DNI ' || {_num(8)} || {_letters(1)}", None),
    (f"'ABN ' || {_num(2)} || ' ' || {_num(3, 2)} || ' ' || {_num(3, 3)} || ' ' || {_num(3, 4)}", "AU"),
    (f"'Patient MRN ' || {_num(5)} || ' seen, bed ' || {_num(4, 2)}", None),
    (f"'〒' || {_num(3)} || '-' || {_num(4, 2)} || ' Tokyo'", "JP"),
    (f"'postcode ' || {_num(4)} || ' or ' || {_num(4, 2)} || ' ' || {_letters(2)}", "NL"),
    (f"'CEP ' || {_num(5)} || '-' || {_num(3, 2)}", "BR"),
    (f"'zip ' || {_num(5)} || '-' || {_num(4, 2)}", None),
    (f"'eircode D0' || {_num(1)} || {_letters(2)} || {_num(2, 2)}", "IE"),
    (f"'Write to user' || {_num(4)} || '@mail' || {_num(2, 2)} || '.example.org, cc a.b@c.de'", None),
    (f"'api_key: ' || {_hex(16)} || ' and password is ' || {_letters(12)} || ' token=\"' || {_hex(12, 3)} || '\"'", None),
    (f"'Bearer ' || {_hex(24)} || '.' || {_num(9)}", None),
    (f"'AKIA' || {_letters(8)} || {_num(8)} || ' glpat-' || {_hex(20)}", None),
    (f"'Budget: $' || {_num(2)} || 'k, paid €1,' || {_num(3)} || '.50 and ' || {_num(4, 2)} || ' USD, ' || {_num(6, 3)} || ' left'", None),
    (f"'Call (' || {_num(3)} || ') ' || {_num(3, 2)} || '-' || {_num(4, 3)} || ' or 44 20 ' || {_num(4, 4)} || ' ' || {_num(4, 5)}", None),
    (f"'Founded 19' || {_num(2)} || ', v1' || {_num(4, 2)} || ', #' || {_num(6, 3)} || ', ' || {_num(5, 4)} || '%, ' || {_num(4, 5)} || 'e10, ' || {_num(4, 6)} || '-' || {_num(4, 7)}", None),
    (f"'Size ' || {_num(4)} || ' MB, ' || {_num(4, 2)} || 'x' || {_num(4, 3)} || ' panel'", None),
    (f"'Section ' || {_num(5)} || ' holds ' || {_num(6, 2)}", None),
    (f"'updated ' || {_num(4)} || ' ' || {_num(2, 2)} || ', 2026' || {_num(4, 3)} || ', 2024-0' || {_num(1, 4)} || '-1' || {_num(1, 5)}", None),
    (f"'Order #' || {_num(5)} || ' shipped'", None),
    (f"'n=' || {_num(5)} || ' cohort, p<0.05'", None),
    (f"'The price ' || {_num(5)}", None),
    (f"{_num(5)} || ' unread messages'", None),
    (f"'Lot ' || {_num(5)} || '-' || {_num(4, 2)} || '; bin ' || {_num(7, 3)}", None),
    (f"'Build ' || {_num(5)} || '.7, sum 1,' || {_num(3, 2)} || ',' || {_num(3, 3)} || ' and (55) ' || {_num(4, 4)} || 'e10'", None),
    (f"'é' || {_num(5)} || ' naïve — ' || {_num(3, 2)} || ' ' || {_num(4, 3)} || ' ' || {_num(3, 4)}", None),
)


def _case(values, default: str) -> str:
    arms = " ".join(f"WHEN {i} THEN {v}" for i, v in values)
    return f"CASE o_orderkey % {len(TEMPLATES)} {arms} ELSE {default} END"


TEXT_SQL = _case(((i, t) for i, (t, _) in enumerate(TEMPLATES)), "''")
COUNTRY_SQL = _case(((i, f"'{c}'") for i, (_, c) in enumerate(TEMPLATES) if c), "CAST(NULL AS STRING)")
SELECT_SQL = f"SELECT o_orderkey AS id, {TEXT_SQL} AS text, {COUNTRY_SQL} AS country FROM ({BASE_SQL})"


def from_orders(orders, **extra):
    """Probe texts of any ``orders`` DataFrame, streaming or not, with extra columns if asked."""
    base = orders.select("o_orderkey", F.expr(_H).alias("h"), *[v.alias(k) for k, v in extra.items()]).selectExpr(
        "*", "translate(h, 'abcdef', '012345') AS d",
        "translate(h, '0123456789abcdef', 'ABCDEFGHJKLMSTXZ') AS u")
    return with_once(base, text=F.expr(TEXT_SQL), country=F.expr(COUNTRY_SQL)).select(
        F.col("o_orderkey").alias("id"), *extra, "text", "country")


def probes(spark, sf_dir: str):
    return from_orders(tables.dealt(tables.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")))
