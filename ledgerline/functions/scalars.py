"""Cleaning of identifiers, amounts, years, dates and names, and guarded ratios, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that mean "no value": fixed values.
YEAR_BLANKS = ("", "nan", "na", "none", "-")
AMOUNT_BLANKS = ("", "-", "--", "–", "—", "na", "n/a", "nil", "nan", "none")
CIN_BLANKS = ("NAN", "NA", "-", "")
CIN_LAYOUT = r"^[A-Z][0-9]{5}[A-Z]{2}[0-9]{4}[A-Z]{3}[0-9]{6}$"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
COMPANY_SUFFIX = r"\b(private|pvt|limited|ltd)\b"


def number(c: Column) -> Column:
    """A text as a double where it is one in plain notation, else null."""
    t = F.trim(c)
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def normalize_text(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def normalize_name(c: Column) -> Column:
    """Trimmed, lower-case, white space one space; null stays null."""
    return F.trim(F.regexp_replace(F.lower(c), r"[ \t\n\r\f\x0b]+", " "))


normalize_label = normalize_name


def normalize_header(c: Column, aliases: dict[str, str]) -> Column:
    """A header's canonical name by an alias map, else the cleaned header."""
    name = normalize_name(c)
    if not aliases:
        return name
    known = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.try_element_at(known, name), name)


def strip_company_suffix(c: Column) -> Column:
    """A normalised name without legal-form words and punctuation."""
    plain = F.regexp_replace(normalize_name(c), r"[^a-z0-9 ]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, COMPANY_SUFFIX, " "), " +", " "))


def normalize_cin(c: Column) -> Column:
    """Upper case without spaces; null unless it is 21 letters and digits."""
    value = F.replace(F.upper(F.trim(c)), F.lit(" "), F.lit(""))
    return F.when(~F.upper(F.trim(c)).isin(*CIN_BLANKS) & value.rlike("^[A-Z0-9]{21}$"), value)


def is_valid_cin(c: Column) -> Column:
    return F.coalesce(F.replace(c, F.lit(" "), F.lit("")).rlike("^[A-Z0-9]{21}$"), F.lit(False))


def cin_incorporation_year(c: Column) -> Column:
    """The year in a company number of the full layout, if it is from 1900 to 2100."""
    value = F.upper(F.trim(c))
    year = F.when(value.rlike(CIN_LAYOUT), F.substring(value, 9, 4).try_cast("int"))
    return F.when(year.between(1900, 2100), year)


def cin_hint(c: Column) -> Column:
    return F.substring(c, 3, 2)


def is_listed(c: Column, prefixes: tuple[str, ...] = ("L",)) -> Column:
    found = F.lit(False)
    for p in prefixes:
        found = found | F.startswith(F.upper(F.trim(c)), F.lit(p))
    return F.coalesce(found, F.lit(False))


def parse_year(c: Column) -> Column:
    """A whole year from 1900 to 2100, one trailing ".0" aside; else null."""
    value = F.regexp_replace(F.trim(c.cast("string")), r"\.0$", "")
    year = F.when(~F.lower(value).isin(*YEAR_BLANKS) & value.rlike("^[+-]?[0-9]+$"), value.try_cast("int"))
    return F.when(year.between(1900, 2100), year)


def parse_amount(c: Column) -> Column:
    """An amount with thousands separators or in accounting brackets; dashes and NA are null."""
    value = F.trim(F.replace(F.replace(c, F.lit(","), F.lit("")), F.lit(" "), F.lit(" ")))
    value = F.when(value.rlike(r"^\(.*\)$"), F.concat(F.lit("-"), F.trim(F.substring(value, F.lit(2), F.length(value) - 2)))).otherwise(value)
    return F.when(~F.lower(value).isin(*AMOUNT_BLANKS), number(value))


def clean_amount(c: Column) -> Column:
    """Everything but digits, dots and minus signs dropped; null unless a number is left."""
    return number(F.regexp_replace(c, "[^0-9.-]", ""))


def parse_date(c: Column, formats: tuple[str, ...] = ("yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy", "dd MMM yyyy")) -> Column:
    """The date by the first format that fits; else null."""
    return F.coalesce(*[F.try_to_date(c, f) for f in formats])


def safe_divide(n: Column, d: Column) -> Column:
    """Null if the denominator is null or 0."""
    return F.try_divide(n, d)


def safe_positive_divide(n: Column, d: Column) -> Column:
    """Null if the denominator is null or not above 0."""
    return F.when(d > 0, n / d)
