"""Learned transliteration: script words to Latin words from aligned true matches, and its application to names."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowkin.functions import text


def script_pairs(s1: DataFrame, others: DataFrame, truth: DataFrame) -> DataFrame:
    """script_name, latin_name of true matches whose record name has no Latin letter (null names are left out)."""
    records = others.filter(text.no_latin(F.col("business_name"), null_counts=False))
    names = s1.select(F.col("entity_id").alias("source1_entity_id"), F.col("business_name").alias("latin_name"))
    owned = records.join(truth, records["entity_id"] == truth["other_id"])
    return owned.join(names, "source1_entity_id").select(F.col("business_name").alias("script_name"), "latin_name")


def aligned_words(pairs: DataFrame) -> DataFrame:
    """s, l: words at equal places of names with as many words."""
    split = pairs.select(F.split(text.clean(F.col("script_name")), " ").alias("s"), F.split(text.clean(F.col("latin_name")), " ").alias("l"))
    same = split.filter(F.size("s") == F.size("l"))
    return same.select(F.explode(F.arrays_zip("s", "l")).alias("w")).select("w.s", "w.l")


def learn(pairs: DataFrame) -> DataFrame:
    """script, latin, n, total: each script word's most frequent reading (ties to the smaller), seen twice and in half or more."""
    counts = aligned_words(pairs).groupBy("s", "l").agg(F.count("*").alias("n"))
    words = Window.partitionBy("s")
    ranked = counts.withColumn("total", F.sum("n").over(words)).withColumn("nth", F.row_number().over(words.orderBy(F.desc("n"), "l")))
    kept = ranked.filter((F.col("nth") == 1) & (F.col("n") >= 2) & (F.col("n") >= 0.5 * F.col("total")))
    return kept.select(F.col("s").alias("script"), F.col("l").alias("latin"), "n", "total")


def ascii_letters(word: str) -> str:
    """Latin letters of a word from the names of its Unicode characters: consonants with their inherent vowel and its signs."""
    out: list[str] = []
    for c in word:
        name = unicodedata.name(c, "")
        if c.isascii():
            out.append(c)
        elif "VOWEL SIGN" in name:
            if out and out[-1].endswith("a"):
                out[-1] = out[-1][:-1]
            out.append(name.rsplit(" ", 1)[-1].lower())
        elif "VIRAMA" in name:
            if out and out[-1].endswith("a"):
                out[-1] = out[-1][:-1]
        elif "ANUSVARA" in name or "CANDRABINDU" in name:
            out.append("n")
        elif (digit := unicodedata.digit(c, None)) is not None:
            out.append(str(digit))
        elif " LETTER " in name:
            out.append(re.sub(r"[^a-z]", "", name.split(" LETTER ", 1)[1].split(" WITH ")[0].split()[-1].lower()))
        else:
            out.append("".join(x for x in unicodedata.normalize("NFKD", c) if x.isascii() and x.isalnum()))
    return "".join(out).lower()


@F.pandas_udf(T.StringType())
def _ascii(s: pd.Series) -> pd.Series:
    return s.map(ascii_letters, na_action="ignore")


def romanise(rows: DataFrame, name: str, table: DataFrame, key: str, out: str) -> DataFrame:
    """Add ``out``: names with an Indic letter word by word through the table (or letter by letter), others unchanged.

    ``key`` identifies rows. Only words of Indic names travel to the table.
    """
    raw = F.coalesce(F.col(name), F.lit(""))
    marked = rows.withColumn("indic_", text.is_indic(F.col(name)))
    words = marked.filter("indic_").select(key, F.posexplode(text.words(text.clean(F.col(name)))).alias("at", "script"))
    known = words.join(table.select("script", "latin"), "script", "left")
    known = known.withColumn("word", F.coalesce(F.nullif("latin", F.lit("")), _ascii(F.when(F.coalesce(F.col("latin"), F.lit("")) == "", F.col("script")))))
    joined = known.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words_"))
    joined = joined.select(key, F.array_join(F.transform("words_", lambda w: w["word"]), " ").alias("latin_"))
    return marked.join(joined, key, "left").withColumn(out, F.when(F.col("indic_"), F.coalesce("latin_", F.lit(""))).otherwise(raw)).drop("indic_", "latin_")


def prepare(rows: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """Source rows with latin, n, a, core and nums; Indic names go through ``table`` first where it is given."""
    rows = romanise(rows, "business_name", table, "entity_id", "latin") if table is not None else rows.withColumn("latin", F.col("business_name"))
    rows = rows.withColumns({"n": text.clean(F.col("latin")), "a": text.clean(F.col("business_address")), "nums": text.numbers(F.col("business_address"))})
    return rows.withColumn("core", text.core(F.col("n")))


def first_number(nums: Column) -> Column:
    return F.get(nums, F.lit(0))
