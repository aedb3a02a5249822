"""The 78 comparison columns of a shortlisted pair, in three groups: base, extra and sharp.

Entity columns (parsed addresses, word frequencies, flags) are computed once per distinct content of an entity, joined to distinct
pairs of contents by key, and compared in expressions; one Arrow-batched function computes all string similarities of a pair in a
single crossing. Entities of one content share its comparisons; what depends on a pair's rank stays with the pair.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowkin.functions import similarity as sim
from rowkin.functions import text
from rowkin.functions.address import address_numbers, digest_of
from rowkin.operators.blocking import staged

# Names and order of the columns
BASE = (
    "score rank gap_top1 margin12 cos_name cos_addr name_ratio name_tset name_partial name_jw addr_ratio addr_tset core_equal "
    "in_degree best_for_cand is_s3 addr_missing name_no_latin name_len num_shared num_jaccard num_first_equal num_rec_none num_rec_subset"
).split()
EXTRA = (
    "hn_equal hn_rec_missing hn_cand_missing hn_suffix_only hn_one_digit hn_transposed hn_gap hn_log_gap sec_agree sec_one_side "
    "num_conflicts street_sim grp_share_rec_num grp_share_biz_num grp_biz_is_majority grp_distinct_nums grp_rank freq_name_biz "
    "freq_name_rec freq_core_biz freq_rarest_shared left_rec_n left_biz_n fuzzy_pairs abbrev_pairs left_rec_rarest left_biz_rarest "
    "dba web_name honorific_one_side legal_conflict private_public script_rec script_biz"
).split()
SHARP = (
    "hn_gap_20 hn_digit_indel hn_digit_sub hn_biz_in_rec hn_rec_in_biz dw_ratio dw_prefix dw_plus_letters dw_stem_ending dw_edit "
    "dw_rarity_biz dw_rarity_rec code_changed legal_same legal_one_side addr_z_ratio addr_z_tset name_nospace web_vs_name shop_words"
).split()
FEATURES = BASE + EXTRA + SHARP
SHOP_LEAST, SHOP_SHARE = 20, 0.00015
#: What an entity's columns are made of; entities that have it in common are compared once.
CONTENT = "country business_name business_address n a core nums".split()
NOT_APPLICABLE = -1.0


def c(name: str) -> Column:
    return F.col(name)


def number(condition: Column) -> Column:
    return condition.cast("double")


def where(applies: Column, value: Column) -> Column:
    """The value, or the sentinel where it doesn't apply."""
    return F.when(applies, value.cast("double")).otherwise(F.lit(NOT_APPLICABLE))


# ---- columns of the shortlist itself


def rank_block(pairs: DataFrame) -> DataFrame:
    """Add gap_top1, margin12, in_degree and best_for_cand to pairs with rank and score."""
    record, business = Window.partitionBy("country", "rec_id"), Window.partitionBy("country", "cand_id")
    top = F.max(F.when(c("rank") == 0, c("score"))).over(record)
    second = F.coalesce(F.max(F.when(c("rank") == 1, c("score"))).over(record), F.lit(0.0))
    pairs = pairs.withColumns({"top_": top, "second_": second})
    return pairs.withColumns({
        "gap_top1": c("top_") - c("score"), "margin12": c("top_") - c("second_"),
        "in_degree": F.count_if(c("rank") == 0).over(business), "best_for_cand": c("score") >= F.max("score").over(business),
    }).drop("top_", "second_")


def number_block(r: Column, b: Column) -> dict[str, Column]:
    """Comparisons of the two sides' lists of numbers."""
    shared, union = F.size(F.array_intersect(r, b)), F.size(F.array_union(r, b))
    some, both = F.size(r) > 0, (F.size(r) > 0) & (F.size(b) > 0)
    return {
        "num_shared": shared, "num_jaccard": where(union > 0, F.try_divide(shared, union)),
        "num_first_equal": where(both, F.get(r, F.lit(0)) == F.get(b, F.lit(0))), "num_rec_none": number(~some),
        "num_rec_subset": where(some, shared == F.size(F.array_distinct(r))),
    }


def house_number_block() -> dict[str, Column]:
    """Comparisons of primary numbers and of unit, area, box and road numbers (address structs r_ad and c_ad)."""
    a, b, sa, sb = c("r_ad.primary_value"), c("c_ad.primary_value"), c("r_ad.primary_suffix"), c("c_ad.primary_suffix")
    both, moved, edit = a.isNotNull() & b.isNotNull(), a != b, F.levenshtein(a, b)
    gap = F.abs(text.lead(a) - text.lead(b)).cast("double")
    shuffled = F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, ""))

    def kinds(*names: str) -> list[tuple[Column, Column, Column]]:
        return [((F.size(f"r_ad.{k}") > 0), (F.size(f"c_ad.{k}") > 0), F.arrays_overlap(f"r_ad.{k}", f"c_ad.{k}")) for k in names]

    pair = kinds("unit", "area")
    some = (pair[0][0] & pair[0][1]) | (pair[1][0] & pair[1][1])
    agree = (~(pair[0][0] & pair[0][1]) | pair[0][2]) & (~(pair[1][0] & pair[1][1]) | pair[1][2])
    clashes = F.coalesce((both & moved).cast("int"), F.lit(0))
    for x, y, overlap in kinds("unit", "area", "box", "road"):
        clashes = clashes + (x & y & ~overlap).cast("int")
    return {
        "hn_equal": where(both, a == b), "hn_rec_missing": number(a.isNull() & b.isNotNull()), "hn_cand_missing": number(b.isNull() & a.isNotNull()),
        "hn_suffix_only": where(both, (a == b) & (sa != sb)), "hn_one_digit": where(both, moved & (edit == 1)),
        "hn_transposed": where(both, moved & (F.length(a) > 1) & shuffled), "hn_gap": where(both, gap), "hn_log_gap": where(both, F.log1p(gap)),
        "sec_agree": where(some, agree), "sec_one_side": (pair[0][0] != pair[0][1]).cast("int") + (pair[1][0] != pair[1][1]).cast("int"),
        "num_conflicts": clashes,
        "hn_gap_20": where(both, moved & (gap <= 20)),
        "hn_digit_indel": where(both, moved & (F.abs(F.length(a) - F.length(b)) == 1) & (edit == 1)),
        "hn_digit_sub": where(both, moved & (F.length(a) == F.length(b)) & (edit == 1)),
        "hn_biz_in_rec": where(both, moved & F.array_contains(c("r_ad.all_values"), b)),
        "hn_rec_in_biz": where(both, moved & F.array_contains(c("c_ad.all_values"), a)),
    }


def crowd_block(pairs: DataFrame) -> DataFrame:
    """Add the crowd columns. A business's crowd is the records whose first candidate it is.

    ``pairs``: country, rec_id, cand_id, rank, score and the primary numbers r_num and c_num (null: none).
    """
    crowd = pairs.filter("rank = 0")
    key = ["country", "cand_id"]
    by_number = crowd.filter("r_num is not null").groupBy(*key, "r_num").agg(F.count("*").alias("hits"))
    sums = crowd.groupBy(*key).agg(F.count("*").alias("crowd_"))
    modes = by_number.groupBy(*key).agg(F.count("*").alias("distinct_"), F.max("hits").alias("most_"))
    rows = pairs.join(sums, key, "left").join(modes, key, "left").na.fill(0, ["crowd_", "distinct_", "most_"])
    rows = rows.join(by_number.withColumnRenamed("hits", "hits_rec_"), [*key, "r_num"], "left")
    rows = rows.join(by_number.select(*key, F.col("r_num").alias("c_num"), F.col("hits").alias("hits_biz_")), [*key, "c_num"], "left").na.fill(0, ["hits_rec_", "hits_biz_"])
    own = c("rank") == 0
    others = c("crowd_") - own.cast("int")
    # records of the crowd that score strictly higher: a running count over scores, equal scores together
    above = Window.partitionBy(*key).orderBy(F.desc("score")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("upto_", F.count_if(own).over(above))
    ties = Window.partitionBy(*key, "score")
    rows = rows.withColumn("grp_rank", c("upto_") - F.count_if(own).over(ties))
    same = own & (c("r_num") == c("c_num"))
    return rows.withColumns({
        "grp_share_rec_num": where((others > 0) & c("r_num").isNotNull(), F.try_divide(c("hits_rec_") - own.cast("int"), others)),
        "grp_share_biz_num": where((others > 0) & c("c_num").isNotNull(), F.try_divide(c("hits_biz_") - F.coalesce(same, F.lit(False)).cast("int"), others)),
        "grp_biz_is_majority": where((c("distinct_") > 0) & c("c_num").isNotNull(), c("hits_biz_") == c("most_")),
        "grp_distinct_nums": c("distinct_"),
    }).drop("crowd_", "distinct_", "most_", "hits_rec_", "hits_biz_", "upto_")


# ---- columns of entities


def content_key() -> Column:
    return F.unhex(F.sha2(F.to_json(F.struct(*CONTENT)), 256))


def contents(rows: DataFrame) -> DataFrame:
    """Distinct contents of a prepared table: the columns of CONTENT, entity_id (the content's key) and copies (rows that have it)."""
    return rows.groupBy(*CONTENT).agg(F.count("*").alias("copies")).withColumn("entity_id", content_key())


def total(copies: str | None) -> Column:
    """Rows of a group, or the sum of their column ``copies``."""
    return F.sum(copies) if copies else F.count("*")


def name_words(rows: DataFrame, *kept: str | None) -> DataFrame:
    """country, ``kept`` columns and word: a row for each distinct word of a name."""
    return rows.select("country", *filter(None, kept), F.explode(F.array_distinct(text.words(c("n")))).alias("word"))


def word_frequency(s1: DataFrame, copies: str | None = None) -> DataFrame:
    """country, word, df: Source 1 names that hold each word."""
    return name_words(s1, copies).groupBy("country", "word").agg(total(copies).alias("df"))


def with_word_frequency(rows: DataFrame, frequency: DataFrame) -> DataFrame:
    """Add w_df: map from a name's words to their Source 1 document frequency."""
    found = name_words(rows, "entity_id").join(frequency, ["country", "word"], "left").groupBy("country", "entity_id")
    maps = found.agg(F.map_from_entries(F.collect_list(F.struct("word", F.coalesce("df", F.lit(0)).alias("df")))).alias("w_df"))
    empty = F.create_map().cast("map<string,bigint>")
    return rows.join(maps, ["country", "entity_id"], "left").withColumn("w_df", F.coalesce("w_df", empty))


def name_frequency(rows: DataFrame, s1: DataFrame, column: str, out: str, copies: str | None = None) -> DataFrame:
    """Add ``out``: how many Source 1 rows of the country have the row's value of ``column``."""
    counts = s1.groupBy("country", column).agg(total(copies).alias(out))
    return rows.join(counts, ["country", column], "left").na.fill(0, [out])


def shop_words(s1: DataFrame, records: DataFrame, least: int = SHOP_LEAST, share: float = SHOP_SHARE, copies: str | None = None) -> DataFrame:
    """country, entity_id, shop_words: a record's name words that no Source 1 name has but many records have."""
    words = name_words(records, "entity_id", copies)
    n = records.groupBy("country").agg(total(copies).alias("n_"))
    often = words.groupBy("country", "word").agg(total(copies).alias("df")).join(n, "country")
    often = often.filter(c("df") >= F.greatest(F.lit(float(least)), share * c("n_"))).select("country", "word")
    shop = often.join(word_frequency(s1).select("country", "word"), ["country", "word"], "left_anti")
    hits = words.join(shop, ["country", "word"], "left_semi").groupBy("country", "entity_id").agg(F.count("*").alias("shop_words"))
    return records.select("country", "entity_id").join(hits, ["country", "entity_id"], "left").na.fill(0, ["shop_words"])


def entity_columns(rows: DataFrame, s1: DataFrame, frequency: DataFrame, copies: str | None = None) -> DataFrame:
    """A prepared table with everything that a pair compares, for one side."""
    rows = rows.withColumn("found_", address_numbers(c("business_address"))).withColumn("ad", digest_of(c("found_")).dropFields("numbers"))
    rows = with_word_frequency(name_frequency(rows, s1, "n", "freq_n", copies), frequency)
    raw = c("business_name")
    return rows.select(
        "country", "entity_id", "n", "a", "core", "nums", "ad", "w_df", "freq_n", text.family_street(c("a")).alias("street"), text.unpadded(c("a")).alias("z"),
        text.glued(c("n")).alias("glued"), text.web_label(raw).alias("label"), text.is_dba(raw).alias("dba"), text.is_web(raw).alias("web"),
        text.is_indic(raw).alias("script"), text.no_latin(raw).alias("no_latin"), F.char_length(F.coalesce(raw, F.lit(""))).alias("raw_len"),
        c("business_address").isNull().alias("no_address"), text.has_honorific(c("n")).alias("honorific"), text.legal_forms(c("n")).alias("forms"),
    )


# ---- similarities of a pair


#: What the string kernels give, and what follows from the most alike pair of words that differ.
KERNELS = [
    "name_ratio", "name_tset", "name_partial", "name_jw", "addr_ratio", "addr_tset", "street_sim", "addr_z_ratio", "addr_z_tset", "name_nospace", "web_vs_name",
    "fuzzy_pairs", "abbrev_pairs",
]
_list = T.ArrayType(T.StringType())
PAIR_SCORES = T.StructType(
    [T.StructField(n, T.DoubleType()) for n in KERNELS] + [T.StructField(n, _list) for n in ("left_r", "left_c")]
    + [T.StructField("dw_ratio", T.DoubleType())] + [T.StructField(n, T.StringType()) for n in ("dw_r", "dw_c")]
)


#: What the kernels take of each side: a name with its web label and words the other lacks, and an address.
NAME, ADDRESS = ("n", "glued", "label", "own"), ("a", "street", "z")
REMEMBERED, REMEMBERED_CHARS = 1 << 14, 1024


def remembered(kernel: Callable) -> Callable:
    """The kernel, with the latest results for short texts kept: names and addresses recur in pairs that differ in the other."""
    cached = lru_cache(REMEMBERED)(kernel)
    return lambda r, b: (cached if len(r[0]) + len(b[0]) <= REMEMBERED_CHARS else kernel)(r, b)


@remembered
def name_scores(r: tuple, b: tuple) -> tuple:
    """ratio, token set, partial, Jaro-Winkler, glued, label, fuzzy and shortened pairs, left words, best differing words of two names (NAME)."""
    (n, glued, label, own), (n_b, glued_b, label_b, own_b) = r, b
    left_r, left_b, fuzzy, shortened = sim.align(n.split(), n_b.split())
    labels = [sim.partial_ratio(x, y) if x else -1.0 for x, y in ((label, glued_b), (label_b, glued))]
    alike = max(((sim.cached_ratio(x, y), x, y) for x in own for y in own_b), default=(None, None, None))
    kernels = (sim.ratio(n, n_b), sim.token_set_ratio(n, n_b), sim.partial_ratio(n, n_b), sim.jaro_winkler(n, n_b))
    return kernels, (sim.ratio(glued, glued_b), max(labels), float(fuzzy), float(shortened), left_r, left_b, *alike)


@remembered
def address_scores(r: tuple, b: tuple) -> tuple:
    """ratio and token set of two addresses (ADDRESS), token set of their streets, ratio and token set without leading zeros."""
    (a, street, z), (a_b, street_b, z_b) = r, b
    return sim.ratio(a, a_b), sim.token_set_ratio(a, a_b), sim.token_set_ratio(street, street_b), sim.ratio(z, z_b), sim.token_set_ratio(z, z_b)


def pair_scores(name_r: tuple, address_r: tuple, name_b: tuple, address_b: tuple) -> tuple:
    """String kernels of one pair, in the order of PAIR_SCORES."""
    first, last = name_scores(name_r, name_b)
    return *first, *address_scores(address_r, address_b), *last


@F.pandas_udf(PAIR_SCORES)
def _pair_scores(r: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    sides = [zip(*(map(tuple, d[x]) if x == "own" else d[x] for x in part), strict=True) for d in (r, b) for part in (NAME, ADDRESS)]
    return pd.DataFrame([pair_scores(*x) for x in zip(*sides, strict=True)], columns=PAIR_SCORES.names)


def differing_block(x: Column, y: Column, own_r: Column, own_c: Column, ratio: Column) -> dict[str, Column]:
    """Comparisons of the most alike pair (x, y) of words that differ; -1 without one."""
    found, prefix, edit = x.isNotNull(), sim.common_prefix_of(x, y), F.levenshtein(x, y)
    ends = [F.length(w) - prefix for w in (x, y)]

    def short_word(words: Column) -> Column:
        return F.exists(words, lambda w: w.rlike(r"^\p{L}{1,4}$"))

    return {
        "dw_ratio": where(found, ratio), "dw_prefix": where(found, prefix / F.greatest(F.length(x), F.length(y))),
        "dw_plus_letters": where(found, number(edit.between(1, 3) & (edit == F.abs(F.length(x) - F.length(y))))),
        "dw_stem_ending": where(found, number((prefix >= 3) & ends[0].between(1, 3) & ends[1].between(1, 3))), "dw_edit": where(found, edit),
        "code_changed": where(found, number(short_word(own_r) & short_word(own_c))),
    }


def legal_block(r: Column, b: Column) -> dict[str, Column]:
    """Comparisons of the two sides' legal forms."""
    both = (F.size(r) > 0) & (F.size(b) > 0)

    def turned(x: Column, y: Column) -> Column:
        return F.array_contains(x, "private") & F.array_contains(y, "public")

    crossed = (turned(r, b) & ~F.array_contains(b, "private")) | (turned(b, r) & ~F.array_contains(r, "private"))
    return {
        "legal_conflict": where(both, ~F.arrays_overlap(r, b)), "private_public": number(crossed), "legal_same": where(both, r == b),
        "legal_one_side": number((F.size(r) > 0) != (F.size(b) > 0)),
    }


def rarest_shared(r: Column, b: Column) -> Column:
    """log1p of the least document frequency of the words both names hold."""
    shared = F.array_intersect(F.map_keys(r), F.map_keys(b))
    return where(F.size(shared) > 0, F.log1p(F.array_min(F.transform(shared, lambda w: F.element_at(b, w)))))


def comparisons(pairs: DataFrame, s1: DataFrame, records: DataFrame) -> DataFrame:
    """country, rec_id, cand_id and the 78 columns (float) of every pair.

    ``pairs``: country, rec_id, cand_id, rank, score, cos_n, cos_a; ``s1`` and ``records``: prepared tables.
    Contents, ranked pairs and compared pairs of contents are staged: the driver plans small steps, and contents travel to their
    distinct pairs once, by row number.
    """
    s1_rows, record_rows = s1, records
    s1, records = staged(contents(s1)), staged(contents(records))
    frequency = staged(word_frequency(s1, "copies"))
    n_s1 = s1.groupBy("country").agg(F.sum("copies").alias("n_s1"))
    ours = name_frequency(entity_columns(s1, s1, frequency, "copies"), s1, "core", "freq_core", "copies").join(n_s1, "country")
    theirs = entity_columns(records, s1, frequency, "copies").join(shop_words(s1, records, copies="copies"), ["country", "entity_id"])
    ours, theirs = (staged(x.withColumn("row", F.monotonically_increasing_id())) for x in (ours, theirs))

    def numbered(rows: DataFrame, made: DataFrame, key: str, s: str) -> DataFrame:
        own = rows.select("country", c("entity_id").alias(key), content_key().alias("key_"))
        return own.join(made.select(c("entity_id").alias("key_"), c("row").alias(f"{s}_row"), c("ad.primary_value").alias(f"{s}_num")), "key_").drop("key_")

    r_num, c_num = numbered(record_rows, theirs, "rec_id", "r"), numbered(s1_rows, ours, "cand_id", "c")
    ranked = staged(crowd_block(rank_block(pairs).join(r_num, ["country", "rec_id"]).join(c_num, ["country", "cand_id"])))
    compared = staged(content_comparisons(ranked.select("r_row", "c_row").distinct(), theirs, ours))
    made = {
        "score": c("score"), "rank": c("rank"), "gap_top1": c("gap_top1"), "margin12": c("margin12"), "cos_name": c("cos_n"), "cos_addr": c("cos_a"),
        "in_degree": c("in_degree"), "best_for_cand": number(c("best_for_cand")), "is_s3": number(c("rec_id").startswith("S3")),
        **{x: c(x) for x in ("grp_share_rec_num", "grp_share_biz_num", "grp_biz_is_majority", "grp_distinct_nums", "grp_rank")},
    }
    rows = ranked.join(compared, ["r_row", "c_row"])
    return rows.select("country", "rec_id", "cand_id", *[(made[f].cast("float") if f in made else c(f)).alias(f) for f in FEATURES])


def content_comparisons(pairs: DataFrame, theirs: DataFrame, ours: DataFrame) -> DataFrame:
    """r_row, c_row and the columns (float) that follow from the contents of a pair alone; ``theirs`` and ``ours``: entity columns and row."""
    r = theirs.select(*[c(x).alias(f"r_{x}") for x in theirs.columns]).drop("r_country", "r_entity_id")
    b = ours.select(*[c(x).alias(f"c_{x}") for x in ours.columns]).drop("c_country", "c_entity_id")
    rows = pairs.join(r, "r_row").join(b, "c_row")
    own_r, own_c = sim.differing_words(text.words(c("r_n")), text.words(c("c_n")))
    rows = rows.withColumns({"r_own": own_r, "c_own": own_c})
    sides = [F.struct(*[c(f"{s}_{x}").alias(x) for x in (*NAME, *ADDRESS)]) for s in "rc"]
    rows = rows.withColumn("ps", _pair_scores(*sides))

    def rarity(df: Column) -> Column:
        return F.log(c("c_n_s1") / (1 + df))

    def rarest(left: Column, freq: Column) -> Column:
        return where(F.size(left) > 0, rarity(F.array_min(F.transform(left, lambda w: F.element_at(freq, w)))))

    r_df, c_df, found = c("r_w_df"), c("c_w_df"), c("ps.dw_r").isNotNull()
    made = {
        "core_equal": number(c("r_core") == c("c_core")), "addr_missing": number(c("r_no_address")), "name_no_latin": number(c("r_no_latin")), "name_len": c("r_raw_len"),
        **number_block(c("r_nums"), c("c_nums")), **house_number_block(), **legal_block(c("r_forms"), c("c_forms")),
        "freq_name_biz": F.log1p(c("c_freq_n")), "freq_name_rec": F.log1p(c("r_freq_n")), "freq_core_biz": where(c("c_core") != "", F.log1p(c("c_freq_core"))),
        "freq_rarest_shared": rarest_shared(r_df, c_df), "left_rec_n": F.size("ps.left_r"), "left_biz_n": F.size("ps.left_c"),
        "left_rec_rarest": rarest(c("ps.left_r"), r_df), "left_biz_rarest": rarest(c("ps.left_c"), c_df),
        "dba": number(c("r_dba") | c("c_dba")), "web_name": number(c("r_web") | c("c_web")), "honorific_one_side": number(c("r_honorific") != c("c_honorific")),
        "script_rec": number(c("r_script")), "script_biz": number(c("c_script")),
        **{x: c(f"ps.{x}") for x in KERNELS}, **differing_block(c("ps.dw_r"), c("ps.dw_c"), c("r_own"), c("c_own"), c("ps.dw_ratio")),
        "dw_rarity_biz": where(found, rarity(F.element_at(c_df, c("ps.dw_c")))), "dw_rarity_rec": where(found, rarity(F.element_at(r_df, c("ps.dw_r")))),
        "shop_words": c("r_shop_words"),
    }
    return rows.select("r_row", "c_row", *[x.cast("float").alias(f) for f, x in made.items()])
