"""Typed numbers of postal addresses as column expressions: one pattern finds each number with the words that decide its kind."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The kind of number that follows a word
KINDS = {
    "unit": "apartment apt unit suite ste flat room rm floor fl lot trailer office bldg building tower space spc",
    "area": "sector sec phase block blk gali ward part pocket",
    "box": "box pmb",
    "road": "highway hwy road rd cr us interstate nh sh route rte mile street st county",
}
NUMBER_WORDS = "no number num"
# What counts as a token of an address (# signs, a number with parts and a short ending, a word)
TOKEN = r"#+|\d+(?:\s*/\s*\d+)*(?:[a-z]{1,2}(?![a-z]))?|[a-z]+"
#: A number with what decides its kind: the word before it, and a # or a word for number between the two.
IN_CONTEXT = (
    r"(?:(?<![a-z])([a-z]+)(?![a-z])[^a-z\d#]*)?"
    rf"(?:(#+|(?<![a-z])(?:{'|'.join(NUMBER_WORDS.split())})(?![a-z]))[^a-z\d#]*)?"
    r"(\d+(?:\s*/\s*\d+)*)((?:[a-z]{1,2}(?![a-z]))?)"
)
_kind_of = {word: kind for kind, listed in KINDS.items() for word in listed.split()}


def tokens(address: str | None) -> list[str]:
    return re.findall(TOKEN, (address or "").lower())


def numbers(address: str | None) -> list[tuple[str, str, str]]:
    """(kind, value, suffix) of every number of one address; ``address_numbers`` for a column, in plain Python."""
    out = []
    for word, mark, body, suffix in re.findall(IN_CONTEXT, (address or "").lower()):
        kind = _kind_of.get(word, "hash" if mark[:1] == "#" else "premise")
        if len(suffix) < 2:
            out.append(("hash" if kind == "road" and mark[:1] == "#" else kind, "/".join(re.sub(r"^\s*0*(?=\d)|\s+$", "", x) for x in body.split("/")), suffix))
    return out


def address_numbers(raw: Column) -> Column:
    """kind, value, suffix of every number of a raw address, in order.

    The kind comes from the word before the number: through a #, only unit, area or box (else hash); through a word for
    number, that of the word before it; premise otherwise. Numbers that end in two letters, such as 40th, are none. Parts of a
    value lose leading zeros.
    """
    lowered = F.lower(F.coalesce(raw, F.lit("")))
    groups = [F.regexp_extract_all(lowered, F.lit(f"(?U){IN_CONTEXT}"), F.lit(i)).alias(n) for i, n in enumerate(("word", "mark", "body", "suffix"), 1)]

    def typed(x: Column) -> Column:
        hashed = x["mark"].startswith("#")
        kind = F.when(hashed, F.lit("hash")).otherwise(F.lit("premise"))
        for name, listed in KINDS.items():
            kind = F.when(x["word"].isin(*listed.split()) & ~(hashed if name == "road" else F.lit(False)), F.lit(name)).otherwise(kind)
        parts = F.transform(F.split(x["body"], "/"), lambda part: F.regexp_replace(part, r"(?U)^\s*0*(?=\d)|\s+$", ""))
        return F.struct(kind.alias("kind"), F.array_join(parts, "/").alias("value"), x["suffix"].alias("suffix"))

    return F.transform(F.filter(F.arrays_zip(*groups), lambda x: F.length(x["suffix"]) < 2), typed)


def digest_of(found: Column) -> Column:
    """Struct of typed numbers, the primary one (first premise, else first hash), and the distinct values of each kind, sorted.

    A number after a # counts as a unit where there is a premise.
    """
    premises, hashes = F.filter(found, lambda x: x["kind"] == "premise"), F.filter(found, lambda x: x["kind"] == "hash")
    primary = F.coalesce(F.get(premises, F.lit(0)), F.get(hashes, F.lit(0)))

    def values(rows: Column) -> Column:
        return F.array_sort(F.array_distinct(F.transform(rows, lambda x: x["value"])))

    def of_kind(kind: str) -> Column:
        as_unit = (F.size(premises) > 0) if kind == "unit" else F.lit(False)
        return values(F.filter(found, lambda x: (x["kind"] == kind) | (as_unit & (x["kind"] == "hash"))))

    return F.struct(
        found.alias("numbers"), primary["value"].alias("primary_value"), primary["suffix"].alias("primary_suffix"),
        *(of_kind(k).alias(k) for k in KINDS), values(found).alias("all_values"),
    )


def address_digest(raw: Column) -> Column:
    """Struct of an address's typed numbers (see ``digest_of``). Null has none."""
    return digest_of(address_numbers(raw))


def address_tokens(raw: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(raw, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1))
