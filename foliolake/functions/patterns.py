"""Sensitive-data patterns as columns: arrays of matched text, in order. Built-in expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# A capture inside a lookahead gives hits that overlap; the scan restarts one character after a hit's first.
EMAIL = r"(?<![A-Za-z0-9._+-])(?!\.)(?=([A-Za-z0-9._+-]+(?<!\.)@[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?![A-Za-z0-9.-])))"
PHONE = r"(?=(?:[- ().+]*[0-9]){7,15}[- ().+]*+(?![-0-9 ().+]))[+(0-9][-0-9 ().+]*[0-9]"
SSN = r"(?<![0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])"
CARD_BARE = r"(?<![0-9])[0-9]{16}(?![0-9])"
CARD_GROUPED = r"(?=([0-9]{4}([- ])[0-9]{4}\2[0-9]{4}\2[0-9]{4}))"
RFC = r"(?<![A-Za-z0-9])(?=((?:[A-Za-z&Ññ]{4}[0-9]{6}[A-Za-z0-9]{3}|[A-Za-z&Ññ]{3}[0-9]{6}[A-Za-z0-9]{3})(?![A-Za-z0-9])))"
CURP = r"(?<![A-Za-z0-9])[A-Za-z]{4}[0-9]{6}[HMhm][A-Za-z]{5}[A-Za-z0-9][0-9](?![A-Za-z0-9])"


def _all(col: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(group))


def _only_if(col: Column, cheap: Column, found: Column) -> Column:
    """Spares texts that a cheap test rules out the pattern."""
    return F.when(cheap, found).otherwise(F.when(col.isNotNull(), F.array().cast("array<string>")))


def email(col: Column) -> Column:
    return _only_if(col, F.contains(col, F.lit("@")), _all(col, EMAIL, 1))


def phone(col: Column) -> Column:
    """7 to 15 digits in a run of digits, spaces and ``().+-``; a longer run gives its last 15 digits."""
    return _all(col, PHONE, 0)


def ssn(col: Column) -> Column:
    return _only_if(col, F.contains(col, F.lit("-")), _all(col, SSN, 0))


def luhn(col: Column) -> Column:
    return F.call_function("luhn_check", col)


def card(col: Column) -> Column:
    """Grouped numbers first, then bare ones; only with a right check digit."""
    grouped = F.filter(_all(col, CARD_GROUPED, 1), lambda x: luhn(F.regexp_replace(x, "[- ]", "")))
    return F.concat(grouped, F.filter(_all(col, CARD_BARE, 0), luhn))


def rfc(col: Column) -> Column:
    return _all(col, RFC, 1)


def curp(col: Column) -> Column:
    return _all(col, CURP, 0)


def literal(col: Column, query: str, ignore_case: bool = False) -> Column:
    quoted = "\\Q" + query.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return _all(col, ("(?iu)" if ignore_case else "") + quoted, 0)


#: Names by which a pattern can be asked for; Spanish ones too.
NAMES: dict[str, Callable[[Column], Column]] = {
    "email": email, "correo": email, "phone": phone, "telefono": phone, "teléfono": phone, "ssn": ssn, "credit_card": card, "card": card,
    "tarjeta": card, "rfc": rfc, "curp": curp,
}


def matches(col: Column, name: str, query: str | None = None, ignore_case: bool = False) -> Column:
    """The array of matches of a named pattern, or of ``query`` for the name ``text``."""
    key = name.strip().lower().replace("-", "_").replace(" ", "_")
    if key in ("text", "texto", "custom"):
        if not query:
            raise ValueError("the pattern 'text' needs a query")
        return literal(col, query, ignore_case)
    if key not in NAMES:
        raise ValueError(f"no such pattern: {name}")
    return NAMES[key](col)


def mask(col: Column, found: Column, label: str) -> Column:
    """The text with every match replaced by a label."""
    return F.aggregate(found, col, lambda text, m: F.replace(text, m, F.lit(label)))


def repeats(col: Column, needles: list[str], ignore_case: str | None = None, least: int = 4) -> Column:
    """Whether a text holds one of the needles of at least four characters, or, in any case, ``ignore_case``."""
    tests = [F.contains(col, F.lit(n)) for n in needles if len(n) >= least]
    if ignore_case and len(ignore_case) >= least:
        tests.append(F.contains(F.lower(col), F.lit(ignore_case.lower())))
    out = F.lit(False)
    for t in tests:
        out = out | t
    return F.coalesce(out, F.lit(False))
