"""A training set shaped like the test set: near twins, deletion of businesses, splits, owners and the leakage guard."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowkin.functions import text
from rowkin.operators.sampling import SEED, first_by_hash, hash_order, uniform
from rowkin.operators.translit import first_number



def twins(s1: DataFrame, cap: int = 200) -> DataFrame:
    """country, id, id_b, core, street (id < id_b): same core name and street, different first house numbers.

    Core groups of 2 to ``cap`` rows only, counted before rows without street or number fall out.
    """
    sizes = s1.filter("core <> ''").groupBy("country", "core").agg(F.count("*").alias("n_")).filter(F.col("n_").between(2, cap))
    rows = s1.select("country", F.col("entity_id").alias("id"), "core", text.twin_street(F.col("a")).alias("street"), first_number(F.col("nums")).alias("num"))
    rows = rows.filter("street <> '' and num is not null").join(sizes.select("country", "core"), ["country", "core"])
    other = rows.select("country", "core", "street", F.col("id").alias("id_b"), F.col("num").alias("num_b"))
    return rows.join(other, ["country", "core", "street"]).filter("id < id_b and num <> num_b").select("country", "id", "id_b", "core", "street")


def twin_deletions(pairs: DataFrame, seed: int = SEED) -> DataFrame:
    """country, id of twins to delete: pairs in random order, one side by coin flip unless either has gone.

    Pairs never cross (country, core, street), so each group is decided alone; groups are bounded by the twins' cap.
    """
    ordered = pairs.withColumn("order_", hash_order("country", "id", "id_b", seed=seed)).withColumn("coin_", uniform("id_b", "id", seed=seed) < 0.5)
    schema = T.StructType([T.StructField("country", T.StringType()), T.StructField("id", pairs.schema["id"].dataType)])

    def decide(group):
        gone = set()
        for a, b, heads in group.sort_values("order_")[["id", "id_b", "coin_"]].itertuples(index=False):
            if a not in gone and b not in gone:
                gone.add(a if heads else b)
        return group.head(len(gone)).assign(id=sorted(gone))[["country", "id"]] if gone else group.head(0)[["country", "id"]]

    return ordered.select("country", "core", "street", "id", "id_b", "order_", "coin_").groupBy("country", "core", "street").applyInPandas(decide, schema)


def n_to_delete(s1_train: int, others_train: int, s1_test: int, others_test: int) -> int:
    """Businesses to delete so that records per business match the test set; 0 where the test set lacks the country."""
    if not s1_test or not others_test:
        return 0
    return s1_train - round(others_train / (others_test / s1_test))


def random_deletions(s1: DataFrame, pairs: DataFrame, counts: DataFrame, seed: int = SEED) -> DataFrame:
    """country, id of random rows outside every twin pair, ``n_random`` (country, n_random) in each country, by hash order."""
    twin = pairs.select("country", "id").unionByName(pairs.select("country", F.col("id_b").alias("id"))).distinct()
    free = s1.select("country", F.col("entity_id").alias("id")).join(twin, ["country", "id"], "left_anti").join(counts, "country")
    return first_by_hash(free, hash_order("country", "id", seed=seed), F.col("n_random")).select("country", "id")


def deletions(s1: DataFrame, counts: DataFrame, cap: int = 200, seed: int = SEED) -> DataFrame:
    """country, id, reason (1 twin, 2 random); ``counts``: country, n_delete. Fails where n_delete can't be met."""
    pairs = twins(s1, cap)
    gone = twin_deletions(pairs, seed)
    used = gone.groupBy("country").agg(F.count("*").alias("n_twin"))
    rest = counts.join(used, "country", "left").select("country", "n_delete", (F.col("n_delete") - F.coalesce("n_twin", F.lit(0))).alias("n_random"))
    bad = rest.filter("n_random < 0 and n_delete > 0").collect()  # a row per country
    if bad:
        raise ValueError(f"more twins than rows to delete: {[(r['country'], r['n_delete'], r['n_random']) for r in bad]}")
    random = random_deletions(s1, pairs, rest, seed)
    allowed = rest.filter("n_delete > 0").select("country")
    twin = gone.join(allowed, "country", "left_semi").withColumn("reason", F.lit(1))
    return twin.unionByName(random.withColumn("reason", F.lit(2)))


def owners(records: DataFrame, truth: DataFrame, s1: DataFrame) -> DataFrame:
    """rec_id, owner of every record (null: none in ``s1``). Fails where a record has two owners."""
    repeated = truth.groupBy("other_id").count().filter("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"record {repeated[0]['other_id']} has more than one owner")
    known = truth.join(s1.select(F.col("entity_id").alias("source1_entity_id")), "source1_entity_id", "left_semi")
    return records.select(F.col("entity_id").alias("rec_id")).join(known, F.col("rec_id") == F.col("other_id"), "left").select("rec_id", F.col("source1_entity_id").alias("owner"))


def splits(s1: DataFrame, share: float = 0.2, seed: int = SEED) -> DataFrame:
    """Add is_val (held out), tune (half of all), v_tune and v_report."""
    rows = s1.withColumn("is_val", uniform("entity_id", seed=seed) < share).withColumn("tune", uniform("entity_id", seed=seed + 1) < 0.5)
    return rows.withColumn("v_tune", F.col("is_val") & F.col("tune")).withColumn("v_report", F.col("is_val") & ~F.col("tune"))


def training_pairs(pairs: DataFrame, held_out: DataFrame) -> DataFrame:
    """Add train: no candidate of the pair's record is a held-out business (cand_id)."""
    marked = pairs.join(held_out.select("cand_id").distinct().withColumn("val_", F.lit(True)), "cand_id", "left")
    any_val = F.coalesce(F.bool_or("val_").over(Window.partitionBy("rec_id")), F.lit(False))
    return marked.withColumn("train", ~any_val).drop("val_")


def labelled(pairs: DataFrame, owned: DataFrame) -> DataFrame:
    """Add y: the candidate is the record's owner."""
    return pairs.join(owned, "rec_id", "left").withColumn("y", F.coalesce(F.col("owner") == F.col("cand_id"), F.lit(False))).drop("owner")


def true_match_count(s1: DataFrame, owned: DataFrame) -> DataFrame:
    """cand_id, k of every Source 1 row: its true records, shortlisted or not."""
    counts = owned.filter("owner is not null").groupBy("owner").agg(F.count("*").alias("k"))
    return s1.select(F.col("entity_id").alias("cand_id")).join(counts, F.col("cand_id") == F.col("owner"), "left").select("cand_id", F.coalesce("k", F.lit(0)).alias("k"))
