"""Document fingerprints (9): a homomorphic multiset hash, in DataFrame functions alone.

A text is the multiset of its paragraph parts: lines, cut after words that their own letters choose, so that long paragraphs stay
comparable and a cut moves with its words. Each part is hashed to a wide vector: two 64-bit values for equality and, from their
bits, 124 counters. Counters have 31 bits, and a text (2 GB at most) has fewer than 2**30 parts, so none carries into another.
The fingerprint is the sum of the vectors modulo powers of two, so it doesn't depend on order, and adding or removing a
paragraph adds or subtracts its vector. Because a counter's sum is a random projection of the multiset, the inner product of
two fingerprints estimates how many parts the texts share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A part: 32 characters or more up to a word that ends in one of these (about half of all do), 96 characters, or what is left of a line.
PART = "[^\\n]{31,94}?[0-4A-Ma-m.,;!?] |[^\\n]{1,96}"
#: Counters of 31 bits, two in each long, taken from every 31st bit of a hash.
STEP, PER_LONG = 31, 2
LANE = (1 << STEP) - 1
BITS = sum(1 << STEP * i for i in range(PER_LONG))
MODULUS = (1 << 62) - 1
HEAD = 5
#: Ranges of doc_id at most; they only balance the tasks.
MOST_RANGES = 4096


def _sum(values: Column, part) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda total, h: (total + part(h)).bitwiseAND(F.lit(MODULUS)))


def _lanes(hashes: Column) -> Column:
    def shifted(s: Column) -> Column:
        return _sum(hashes, lambda x: F.call_function("shiftrightunsigned", x, s).bitwiseAND(F.lit(BITS)))

    return F.transform(F.sequence(F.lit(0), F.lit(STEP - 1)), shifted)


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add array<long> ``name``: number of parts, four sums for equality, 2 x 31 longs of counters. Null counts as empty.

    The hashes are columns of their own, so that the text is cut once.
    """
    one, two = f"{name}_1", f"{name}_2"
    df = df.withColumn("parts_", F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(PART), F.lit(0)))
    df = df.select("*", F.transform("parts_", lambda p: F.xxhash64(p)).alias(one), F.transform("parts_", lambda p: F.xxhash64(p, F.lit(1))).alias(two))
    low, columns = F.lit(0xFFFFFFFF), (F.col(one), F.col(two))
    sums = [_sum(h, part) for h in columns for part in (lambda x: x.bitwiseAND(low), lambda x: F.shiftrightunsigned(x, 32))]
    print_ = F.concat(F.array(F.size(one).cast("long"), *sums), *map(_lanes, columns))
    return df.withColumn(name, print_).drop("parts_", one, two)


def _combined(a: Column, b: Column, sign: int) -> Column:
    return F.zip_with(a, b, lambda x, y: (x + F.lit(sign) * y).bitwiseAND(F.lit(MODULUS)))


def inserted(whole: Column, part: Column) -> Column:
    """Fingerprint after the paragraphs that ``part`` fingerprints are added."""
    return _combined(whole, part, 1)


def deleted(whole: Column, part: Column) -> Column:
    """Fingerprint after the paragraphs that ``part`` fingerprints are taken away."""
    return _combined(whole, part, -1)


def shown(print_: Column) -> Column:
    """Fixed-width lower-case hexadecimal form."""
    return F.array_join(F.transform(print_, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def counters(print_: Column) -> Column:
    """Centred counters: each is a sum of +1 and -1 over the parts."""
    n = F.element_at(print_, 1)
    longs = F.slice(print_, HEAD + 1, 2 * STEP)
    lanes = F.flatten(F.transform(longs, lambda x: F.array(*(F.shiftright(x, STEP * i).bitwiseAND(F.lit(LANE)) for i in range(PER_LONG)))))
    return F.transform(lanes, lambda c: (2 * c - n).cast("double"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 of two centred counter arrays: the share of parts in common; two empty texts are alike (1)."""
    norms = _dot(a, a) + _dot(b, b)
    return F.when(norms > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * _dot(a, b) / norms))).otherwise(F.lit(1.0))


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Each row with ``next``: a struct of ``columns`` of the following row by descending doc_id (null last); after the last
    comes the first. Rows of one doc_id are ordered by their text.

    The texts are dealt once, into ranges of doc_id. The first row of each range is also sent to the range before it, so the
    order runs on across ranges without a single-task sort. Range limits are approximate quantiles, which only balance.
    """
    spark = docs.sparkSession
    n = min(MOST_RANGES, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    limits = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10_000).alias("q")).first()["q"] or []
    limits = sorted(set(limits))
    place = _range_of(F.col("doc_id"), limits)
    ranges = docs.select(place.alias("range"), "doc_id").groupBy("range").agg(F.max("doc_id").alias("first"))
    kept = {r["range"]: r["first"] for r in ranges.collect()}  # at most MOST_RANGES rows
    order = sorted(kept, reverse=True)
    ahead = [(kept[r], order[i - 1], i == 0) for i, r in enumerate(order)]
    ghosts = spark.createDataFrame(ahead or [(None, None, None)], "first long, to long, wraps boolean")
    # a row goes to its own range and, if it begins one, to the range that ends just before it
    sent = docs.withColumn("range", place.cast("long")).join(F.broadcast(ghosts), docs["doc_id"].eqNullSafe(F.col("first")), "left")
    sent = sent.withColumn(
        "at", F.explode(F.when(F.col("to").isNull(), F.array(F.struct("range", F.lit(0).alias("ghost")))).otherwise(
            F.array(F.struct("range", F.lit(0).alias("ghost")), F.struct(F.col("to").alias("range"), F.lit(1).alias("ghost")))))
    )
    order_by = [F.col("at.ghost"), F.col("doc_id").desc_nulls_last(), F.col("text_order")]
    rows = sent.withColumn("text_order", F.xxhash64("text")).drop("range", "first", "to", "wraps")
    window = Window.partitionBy("at.range").orderBy(*order_by)
    rows = rows.withColumn("next", F.lead(F.struct(*columns)).over(window))
    return rows.filter("at.ghost = 0").drop("at", "text_order")


def _range_of(column: Column, limits: list[int]) -> Column:
    """Number of limits at or below the value, as a balanced tree of comparisons; null goes to the first range."""

    def between(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(column < F.lit(limits[mid]), between(lo, mid)).otherwise(between(mid + 1, hi))

    return F.when(column.isNull(), F.lit(0)).otherwise(between(0, len(limits))) if limits else F.lit(0)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint every document (doc_id, text) and its edited text, whose last third is taken from the next document.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Null text is empty;
    repeated rows give a row each; other columns are ignored; an empty table gives an empty result; the only document is its
    own next one.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = with_fingerprint(own, "text", "print")
    rows = with_next(own, ["text", "print"])
    n = F.char_length("text")
    moved = F.floor(n / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - moved), F.substring(F.col("next.text"), F.lit(1), moved)))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "edited", "print", F.col("next.print").alias("next_print"))
    rows = with_fingerprint(rows, "edited", "edited_print").withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")
    rows = rows.select(
        "*", counters(F.col("print")).alias("own"), counters(F.col("edited_print")).alias("edit"), counters(F.col("next_print")).alias("following")
    )
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", shown(F.col("print")).alias("fingerprint"), shown(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edit")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"),
    )
