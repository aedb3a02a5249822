"""Blocking: character-trigram TF-IDF and the exact top-k similarity join."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowkin.operators import search
from rowkin.operators.sampling import first_by_hash, hash_order
from rowkin.session import shared_folder


def trigrams(cleaned: Column) -> Column:
    """3-character windows of each word padded with one space on both sides, repeats kept."""
    words = F.filter(F.split(cleaned, " "), lambda w: w != "")

    def windows(w: Column) -> Column:
        padded = F.concat(F.lit(" "), w, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.substring(padded, i, F.lit(3)))

    return F.flatten(F.transform(words, windows))


def gram_table(rows: DataFrame, parts: list[str], side: str) -> DataFrame:
    """country, part, side, id, gram, tf of rows (country, id, and a cleaned text for each part)."""
    tables = [
        rows.select("country", F.lit(part).alias("part"), F.lit(side).alias("side"), "id", F.explode(trigrams(F.col(part))).alias("gram"))
        for part in parts
    ]
    return reduce(DataFrame.unionByName, tables).groupBy("country", "part", "side", "id", "gram").agg(F.count("*").alias("tf"))


def fit_rows(records: DataFrame, size: int | None = None, seed: int = 0) -> DataFrame:
    """Records whose grams fit the vocabulary: all, or per country the ``size`` smallest hashes."""
    return records if size is None else first_by_hash(records, hash_order("id", seed=seed), F.lit(size))


def inverse_frequency(grams: DataFrame, n: DataFrame) -> DataFrame:
    """country, part, gram, df, idf of grams in two texts or more; n: country, n texts. idf = ln((1 + n) / (1 + df)) + 1."""
    df = grams.groupBy("country", "part", "gram").agg(F.count("*").alias("df")).filter("df >= 2")
    return df.join(n, "country").select("country", "part", "gram", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def weights(grams: DataFrame, idf: DataFrame) -> DataFrame:
    """country, part, side, id, gram, w: tf times idf, scaled so that each text has length 1."""
    own = grams.join(idf.select("country", "part", "gram", "idf"), ["country", "part", "gram"])
    own = own.withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("country", "part", "side", "id")))
    return own.select("country", "part", "side", "id", "gram", (F.col("w") / norm).alias("w"))


def vectors(s1: DataFrame, records: DataFrame, parts: list[str], sample: int | None = None) -> DataFrame:
    """Weights of both sides (side s and r), fitted on Source 1 and all records, or ``sample`` records of each country."""
    ours, theirs = gram_table(s1, parts, "s"), gram_table(records, parts, "r")
    fitted = fit_rows(records.select("country", "id"), sample)
    fit = ours.unionByName(theirs if sample is None else theirs.join(fitted, ["country", "id"], "left_semi").select(*ours.columns))
    n = s1.select("country").unionByName(fitted.select("country")).groupBy("country").agg(F.count("*").alias("n"))
    return weights(ours.unionByName(theirs), inverse_frequency(fit, n))


def top_k(scored: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """The k best candidates of each record, with 0-based rank. Scores are rounded first; ties go to the smaller cand_id."""
    rounded = scored.withColumn("score", F.round("score", digits))
    order = Window.partitionBy("country", "rec_id").orderBy(F.desc("score"), "cand_id")
    return rounded.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < k)


def staged(rows: DataFrame) -> DataFrame:
    """Rows written once to the shared folder and read back."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark.sparkContext)}/rowkin/search-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def shortlist(s1: DataFrame, records: DataFrame, parts: list[str], k: int = 3, sample: int | None = None, digits: int = 9) -> DataFrame:
    """country, rec_id, cand_id, rank, score and cosines of every record's k best Source 1 rows.

    Score is the mean of the parts' cosines. Equal texts of either side share one search (``search.py``): distinct texts go through it
    as packed chunks, each meeting every block of its country's Source 1 texts, and its rows are dealt back. Inverse frequencies reach
    a chunk by its distinct grams. Document frequencies count all records, or ``sample`` of each country.
    """
    if len(parts) > search.MOST_PARTS:
        raise ValueError(f"at most {search.MOST_PARTS} parts")

    def side(rows: DataFrame, ours: bool) -> DataFrame:
        texts = [F.coalesce(F.col(p), F.lit("")).alias(p) for p in parts]
        rows = rows.filter("country is not null").select("country", F.col("id").cast("string").alias("id"), *texts)
        key = F.unhex(F.sha2(F.concat_ws("\u0001", "country", *parts), 256))
        return rows.withColumns({"text_": key, "ours_": F.lit(ours)})

    ours, theirs = side(s1, True), side(records, False)
    fitted = theirs.withColumn("fit_", F.lit(1))
    if sample is not None:
        chosen = fit_rows(theirs.select("country", "id"), sample).select("country", "id", F.lit(1).alias("fit_"))
        fitted = theirs.join(chosen, ["country", "id"], "left").na.fill(0, ["fit_"])
    every = ours.withColumn("fit_", F.lit(1)).unionByName(fitted)
    texts = every.groupBy("country", "text_", *parts).agg(
        F.min(F.when(F.col("ours_"), F.col("id"))).alias("first"), F.count_if("ours_").alias("n_s"), F.count_if(~F.col("ours_")).alias("n_r"), F.sum("fit_").alias("n_fit")
    )
    if len(parts) > 1:  # texts in order: a chunk or block then holds few distinct first parts, most of them too unlike to meet in full
        texts = texts.repartitionByRange("country", *parts).sortWithinPartitions("country", *parts)
    chunks = staged(texts.mapInArrow(search.chunked(parts), search.CHUNK_SCHEMA).withColumn("chunk", F.monotonically_increasing_id()))
    grams = chunks.select("country", "chunk", F.inline("grams"))
    n = chunks.groupBy("country").agg(F.sum("n_fit").alias("n"))
    df = grams.groupBy("country", "gram").agg(F.sum("df").alias("df")).filter("df >= 2")
    idf = df.join(n, "country").select("country", "gram", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    known = grams.join(idf, ["country", "gram"]).groupBy("chunk").agg(F.collect_list(F.struct("gram", "idf")).alias("known"))
    blocks = chunks.groupBy("country").agg(F.ceil(F.sum("n_s") / search.BLOCK_ROWS).alias("blocks_"))  # a row per country
    members = chunks.filter("n_s > 0").select("country", "chunk", "grams", "ours").join(known, "chunk").join(blocks, "country")
    number = F.pmod(F.xxhash64("chunk"), F.col("blocks_"))
    block = members.groupBy("country", number.alias("block_")).agg(F.array_sort(F.collect_list(F.struct("chunk", "ours", "grams", "known"))).alias("block"))
    tasks = -(-(chunks.agg(F.sum("n_s")).first()[0] or 1) // search.TASK_ROWS)
    block = block.select("country", "block").repartition(tasks)
    met = chunks.filter("n_r > 0").select("country", "chunk", "grams", "theirs").join(known, "chunk").join(block.hint("shuffle_replicate_nl"), "country")
    found = met.mapInArrow(search.found(k, len(parts), digits), search.FOUND_SCHEMA)
    # of equal Source 1 texts, the k smallest ids can be among the best
    nth = F.row_number().over(Window.partitionBy("country", "text_").orderBy("id"))
    copies = ours.select("country", "text_", "id").withColumn("nth_", nth).filter(F.col("nth_") <= k)
    scored = found.join(copies.select("country", F.col("text_").alias("cand_text_"), F.col("id").alias("cand_id")), ["country", "cand_text_"])
    best = top_k(scored.withColumnRenamed("text_", "rec_id"), k, digits).withColumnRenamed("rec_id", "text_")
    cosines = [F.col("cosines")[i].alias(f"cos_{p}") for i, p in enumerate(parts)]
    dealt = theirs.select("country", "text_", F.col("id").alias("rec_id")).join(best, ["country", "text_"])
    return dealt.select("country", "rec_id", "cand_id", "rank", "score", *cosines)


def compact(short: DataFrame, deleted: DataFrame, k: int = 3) -> DataFrame:
    """Each record's first k candidates that aren't deleted (cand_id), ranked anew from 0 in their old order."""
    alive = short.join(deleted.select("cand_id"), "cand_id", "left_anti")
    order = Window.partitionBy("country", "rec_id").orderBy("rank")
    return alive.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < k)
