"""Scalar text functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Typographic ligatures and their letters.
LIGATURES = (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"))
COMPOSED = (("ffi", "ﬃ"), ("ffl", "ﬄ"), ("ff", "ﬀ"), ("fi", "ﬁ"), ("fl", "ﬂ"))
# Letters that stand in for characters a face lacks.
PLAIN = {
    "a": "áàâãåā", "A": "ÁÀÂÃÅĀ", "e": "éèêëē", "E": "ÉÈÊËĒ", "i": "íìîïī", "I": "ÍÌÎÏĪ", "o": "óòôõō", "O": "ÓÒÔÕŌ", "u": "úùûüū", "U": "ÚÙÛÜŪ",
    "n": "ñ", "N": "Ñ", "c": "ç", "C": "Ç", "s": "ß", "?": "¿", "!": "¡", "-": "—–", '"': "“”", "'": "‘’", ".": "…",
}
# Schemes of addresses that run or open something.
DANGEROUS = ("javascript", "jscript", "livescript", "vbscript", "file", "data")


def chained(col: Column, pairs) -> Column:
    for a, b in pairs:
        col = F.replace(col, F.lit(a), F.lit(b))
    return col


def decompose_ligatures(col: Column) -> Column:
    return chained(col, LIGATURES)


def compose_ligatures(col: Column) -> Column:
    return chained(col, COMPOSED)


def transliterate(col: Column) -> Column:
    """Stand-ins for letters beyond ASCII; ``?`` for those without one."""
    source = "".join(PLAIN.values())
    return F.regexp_replace(F.translate(col, source, "".join(k * len(v) for k, v in PLAIN.items())), r"[^\x00-\x7F]", "?")


def win_ansi(code: Column) -> Column:
    """The character of a WinAnsi code; undefined codes are a space."""
    table = [bytes([i]).decode("cp1252", "replace").replace("�", " ") for i in range(256)]
    return F.element_at(F.array(*(F.lit(c) for c in table)), code.cast("int") + 1)


def win_ansi_codes(col: Column) -> Column:
    """The WinAnsi codes of a text's characters; those without one are that of ``?``."""
    known = {bytes([i]).decode("cp1252"): i for i in range(256) if i not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
    codes = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    return F.transform(F.filter(F.split(col, ""), lambda c: c != ""), lambda c: F.coalesce(F.try_element_at(codes, c), F.lit(63)))


def pdf_string(col: Column) -> Column:
    return chained(col, (("\\", "\\\\"), ("(", "\\("), (")", "\\)"), ("\r", "\\r"), ("\n", "\\n")))


def csv_field(col: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(col, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(col.rlike('[",\r\n]'), quoted).otherwise(col)


def csv_row(cells: Column) -> Column:
    return F.array_join(F.transform(cells, lambda c: csv_field(F.coalesce(c, F.lit("")))), ",")


def json_string(col: Column) -> Column:
    """Inside quotes: the short escapes, and four hex digits for other control characters."""
    short = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f"))
    plain = chained(col, short)
    full = chained(plain, ((chr(i), f"\\u{i:04x}") for i in range(32) if chr(i) not in "\n\r\t\b\f"))
    return F.when(col.rlike(r"[\x00-\x07\x0B\x0E-\x1F]"), full).otherwise(plain)


def markdown_cell(col: Column) -> Column:
    return F.trim(chained(col, (("|", "\\|"), ("\r", ""), ("\n", "<br/>"))))


def markdown_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: markdown_cell(F.coalesce(c, F.lit("")))), " | "), F.lit(" |"))


def html_text(col: Column) -> Column:
    return chained(col, (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")))


def xml_text(col: Column) -> Column:
    """The four entities; characters that XML 1.0 forbids go."""
    kept = F.regexp_replace(col, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F￾￿]", "")
    return chained(kept, (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")))


def sheet_name(col: Column, limit: int = 31) -> Column:
    bare = F.regexp_replace(F.trim(F.regexp_replace(col, r"[:\\/?*\[\]]", "")), "^'+|'+$", "")
    return F.when(bare == "", F.lit("Table")).otherwise(F.substring(bare, 1, limit))


def column_name(index: Column) -> Column:
    """A, B, …, Z, AA, … for 0, 1, …; up to three letters."""
    n = index.cast("int")
    letter = lambda x: F.char(x + 65)
    two, three = (n - 26), (n - 702)
    return (
        F.when(n < 26, letter(n))
        .when(n < 702, F.concat(letter(F.floor(two / 26)), letter(two % 26)))
        .otherwise(F.concat(letter(F.floor(three / 676)), letter(F.floor(three / 26) % 26), letter(three % 26)))
    )


def page_label(template: str, page: Column, total: Column) -> Column:
    """``{page}`` and ``{total}`` filled in."""
    return F.replace(F.replace(F.lit(template), F.lit("{page}"), page.cast("string")), F.lit("{total}"), total.cast("string"))


def heading_level(points: Column) -> Column:
    """1 to 3 for faces of 20, 16 and 13.5 points or more; 0 below."""
    return F.when(points >= 20, 1).when(points >= 16, 2).when(points >= 13.5, 3).otherwise(0)


def clean_label(col: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(col, r"^\s+", ""), r"[\s:_.;-]+$", "")


def identifier(col: Column) -> Column:
    """Letters and digits only; each word begins with a capital."""
    words = F.filter(F.split(col, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), "")


# Words in a label that tell what its field is for.
SIGNATURE_WORDS = ("sign", "firma", "rubrica", "signature", "witness")
DATE_WORDS = ("date", "fecha", "dob", "birth", "dated")
TEXT_WORDS = ("name", "nombre", "email", "correo", "phone", "tel", "cell", "address", "direccion", "city", "state", "zip", "postal", "ssn", "title", "notes", "comments")


def _holds(col: Column, words) -> Column:
    return F.lower(col).rlike("|".join(words))


def field_type(is_square: Column, label: Column) -> Column:
    return F.when(is_square, "checkbox").when(_holds(label, SIGNATURE_WORDS), "signature").otherwise("text")


def field_confidence(is_square: Column, label: Column, width: Column, height: Column) -> Column:
    return (
        F.when(is_square & label.isNotNull(), 0.90)
        .when(is_square, 0.80)
        .when(_holds(label, SIGNATURE_WORDS), 0.92)
        .when(_holds(label, DATE_WORDS + TEXT_WORDS), 0.88)
        .when(label.isNotNull(), 0.80)
        .when((height >= 12) & (width >= 40), 0.65)
        .otherwise(0.55)
    )


def css_family(base_font: Column) -> Column:
    name = F.lower(base_font)
    return F.when(name.rlike("courier|mono|consol"), "monospace").when(name.rlike("times|serif|georgia|garamond|roman") & ~name.rlike("sans"), "serif").otherwise("sans-serif")


def url_allowed(col: Column) -> Column:
    """http or https with ``//`` and no control character."""
    return F.coalesce(col.rlike(r"(?i)^https?://") & ~col.rlike(r"[\x00-\x1F\x7F-\x9F]"), F.lit(False))


def url_scheme(col: Column) -> Column:
    """What stands before the first colon, without white space and control characters, in lower case."""
    return F.when(F.contains(col, F.lit(":")), F.lower(F.regexp_replace(F.substring_index(col, ":", 1), r"[\s\x00-\x1F\x7F-\x9F]", "")))


def url_dangerous(col: Column) -> Column:
    return F.coalesce(url_scheme(col).isin(*DANGEROUS), F.lit(False))


def pdf_date_to_iso(col: Column) -> Column:
    raw = F.trim(F.regexp_replace(col, "^D:", ""))
    part = lambda at, otherwise: F.when(F.length(raw) >= at + 1, F.substring(raw, at, 2)).otherwise(otherwise)
    rest = F.substring(raw, F.lit(15), F.length(raw))
    digits = F.regexp_replace(F.substring(rest, F.lit(2), F.length(rest)), "[^0-9]", "")
    zone = F.when(rest.rlike(r"^[+-]") & (F.length(digits) >= 2), F.concat(F.substring(rest, 1, 1), F.substring(digits, 1, 2), F.lit(":"), F.when(F.length(digits) >= 4, F.substring(digits, 3, 2)).otherwise("00"))).otherwise("Z")
    iso = F.concat(F.substring(raw, 1, 4), F.lit("-"), part(5, "01"), F.lit("-"), part(7, "01"), F.lit("T"), part(9, "00"), F.lit(":"), part(11, "00"), F.lit(":"), part(13, "00"), zone)
    return F.when(F.length(raw) < 4, col).otherwise(iso)


def iso_to_pdf_date(col: Column) -> Column:
    text = F.trim(col)
    digits = F.regexp_replace(text, "[^0-9]", "")
    part = lambda at, otherwise: F.when(F.length(digits) >= at + 1, F.substring(digits, at, 2)).otherwise(otherwise)
    built = F.concat(F.lit("D:"), F.substring(digits, 1, 4), part(5, "01"), part(7, "01"), part(9, "00"), part(11, "00"), part(13, "00"), F.lit("Z"))
    return F.when(text.startswith("D:"), text).when(F.length(digits) < 4, F.concat(F.lit("D:"), text)).otherwise(built)
