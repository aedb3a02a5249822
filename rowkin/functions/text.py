"""Scalar text operators on columns. Nulls count as empty text unless stated."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that a core name leaves out
LEGAL = "llc inc incorporated corp corporation co company ltd limited pvt private llp pc plc lp sa sas sarl sci eurl the and of shri smt sri mr ms dba".split()
# Legal words and the form each stands for
LEGAL_FORM = {
    "pvt": "private", "private": "private", "public": "public", "ltd": "limited", "limited": "limited", "llc": "llc", "inc": "inc",
    "incorporated": "inc", "corp": "corp", "corporation": "corp", "co": "co", "company": "co", "llp": "llp", "lp": "lp", "plc": "plc",
    "pc": "pc", "sa": "sa", "sas": "sas", "sarl": "sarl", "eurl": "eurl", "sci": "sci",
}
# Honorifics and patterns
HONORIFICS = "shri sri shree smt mr mrs ms dr kumari".split()
DBA = r"(?iu)\bd\s*\.?\s*b\s*\.?\s*a\b|\ba\s*\.?\s*k\s*\.?\s*a\b|trading as|\bt/a\b"
WEB = r"(?i)www\.|\.(com|in|net|org|co|fr)\b"
WEB_LABEL = r"([a-z0-9][a-z0-9-]{2,})\.(com|in|net|org|co|fr)\b"
INDIC = "[\\x{0900}-\\x{0DFF}]"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


@F.pandas_udf(T.StringType())
def _decomposed(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKD", x), na_action="ignore")


def clean(c: Column) -> Column:
    """Lower case, compatibility decomposition, Latin accents off, every other run of non-letters to one space, trimmed.

    Only rows beyond ASCII visit Python. Capitals that the decomposition makes (as of the numero sign) stay.
    """
    low = F.lower(_text(c))
    plain = low.rlike("^[\\x00-\\x7F]*$")
    flat = F.coalesce(_decomposed(F.when(~plain, low)), low)
    return F.trim(F.regexp_replace(F.regexp_replace(flat, "[\\x{0300}-\\x{036F}]", ""), "[^\\p{L}\\p{M}\\p{N}]+", " "))


def numbers(c: Column) -> Column:
    """Every run of decimal digits without leading zeros; zeros alone give "0"."""
    runs = F.regexp_extract_all(_text(c), F.lit("\\p{Nd}+"), F.lit(0))
    return F.transform(runs, lambda x: F.coalesce(F.nullif(F.ltrim(x, F.lit("0")), F.lit("")), F.lit("0")))


def words(cleaned: Column) -> Column:
    return F.filter(F.split(cleaned, " "), lambda w: w != "")


def core(cleaned: Column) -> Column:
    """The words of a cleaned name that aren't legal forms or articles, sorted."""
    return F.array_join(F.array_sort(F.filter(words(cleaned), lambda w: ~w.isin(LEGAL))), " ")


def twin_street(address: Column) -> Column:
    """A cleaned address without its first number, words sorted."""
    return F.array_join(F.array_sort(words(F.regexp_replace(address, "^([^0-9]*)[0-9]+", "$1 "))), " ")


def family_street(address: Column) -> Column:
    """A cleaned address without numbers; not trimmed."""
    return F.regexp_replace(F.regexp_replace(address, "[0-9]+", " "), "\\s+", " ")


def unpadded(address: Column) -> Column:
    """A cleaned address whose numbers have no leading zeros."""
    return F.regexp_replace(address, "\\b0+([0-9])", "$1")


def glued(name: Column) -> Column:
    return F.replace(name, F.lit(" "), F.lit(""))


def web_label(raw: Column) -> Column:
    """The label before a web suffix in a raw name, or empty."""
    return F.regexp_extract(F.lower(_text(raw)), WEB_LABEL, 1)


def is_dba(raw: Column) -> Column:
    return _text(raw).rlike(DBA)


def is_web(raw: Column) -> Column:
    return _text(raw).rlike(WEB)


def is_indic(raw: Column) -> Column:
    return _text(raw).rlike(INDIC)


def no_latin(raw: Column, null_counts: bool = True) -> Column:
    """No letter A-Z. Without ``null_counts`` a null stays null, so a filter drops it."""
    return ~(_text(raw) if null_counts else raw).rlike("[A-Za-z]")


def pair_text(name: Column, address: Column) -> Column:
    return F.concat(_text(name), F.lit(" | "), _text(address))


def legal_forms(name: Column) -> Column:
    """Distinct legal forms in a cleaned name, sorted; spelled-out l l c and l l p count, even across words."""
    known = F.create_map(*[F.lit(x) for kv in LEGAL_FORM.items() for x in kv])
    merged = F.replace(F.replace(name, F.lit("l l c"), F.lit("llc")), F.lit("l l p"), F.lit("llp"))
    listed = F.filter(F.split(merged, " "), lambda w: w.isin(list(LEGAL_FORM)))
    return F.array_sort(F.array_distinct(F.transform(listed, lambda w: F.element_at(known, w))))


def has_honorific(name: Column) -> Column:
    return F.arrays_overlap(F.split(name, " "), F.array(*map(F.lit, HONORIFICS)))


def logit(p: Column) -> Column:
    held = F.least(F.greatest(p, F.lit(1e-7)), F.lit(1 - 1e-7))
    return F.ln(held / (1 - held))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def lead(value: Column) -> Column:
    """A house number's first nine characters before a slash, as an integer."""
    return F.substring(F.split_part(value, F.lit("/"), F.lit(1)), 1, 9).cast("int")


def is_abbreviation(short: Column, word: Column) -> Column:
    """``short`` has two letters or more, fewer than ``word``, the same first one, and its letters in order within it."""
    letters = F.array_join(F.transform(F.split(short, ""), lambda x: F.regexp_replace(x, "([\\W])", "\\\\$1")), ".*")
    fits = (F.length(short) >= 2) & (F.length(short) < F.length(word)) & (F.substring(short, 1, 1) == F.substring(word, 1, 1))
    return fits & F.regexp_like(word, F.concat(F.lit("^"), letters))
