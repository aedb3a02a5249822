"""End to end: train on labelled sources, score new ones, write matches and candidates.

Every stage that a later one reads twice is written to the work folder once, under a key of what made it.
"""

from __future__ import annotations

import argparse
import hashlib
import json
import logging
import time
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowkin import schema
from rowkin.functions import text
from rowkin.operators import blocking, features, testlike, translit
from rowkin.operators.sampling import first_by_hash
from rowkin.plans import decision, models
from rowkin.sources import tsv

log = logging.getLogger("rowkin")


@dataclass(frozen=True)
class Settings:
    """Sizes of the run; the defaults suit millions of records, the tests use smaller ones."""

    search_k: int = 10
    compare_k: int = 3
    held_out: float = 0.2
    evaluation: float = 0.25
    cheap_rounds: int = 100
    cheap_least: int = 100
    tree_rounds: int = 3000
    tree_least: int = 500
    pair_first: int = 1_000_000
    pair_more: int = 3_000_000
    twin_cap: int = 200


class Stages:
    """Parquet stages in a work folder, keyed by settings, inputs and second scorer; a stage that is there is read, not made again."""

    def __init__(self, spark: SparkSession, work_dir: str, settings: Settings, inputs: str = "", scorer: str = ""):
        key = json.dumps([asdict(settings), inputs, scorer], sort_keys=True).encode()
        self.spark, self.folder = spark, f"{work_dir.rstrip('/')}/{hashlib.sha256(key).hexdigest()[:16]}"

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def done(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path(name)}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def __call__(self, name: str, make) -> DataFrame:
        if not self.done(name):
            began = time.time()
            make().write.mode("overwrite").parquet(self.path(name))
            log.info("%s took %.1f s", name, time.time() - began)
        return self.spark.read.parquet(self.path(name))


def searchable(rows: DataFrame) -> DataFrame:
    return rows.select("country", F.col("entity_id").alias("id"), "n", "a")


def shortlist(s1: DataFrame, records: DataFrame, k: int) -> DataFrame:
    """Prepared tables to country, rec_id, cand_id, rank, score, cos_n, cos_a."""
    return blocking.shortlist(searchable(s1), searchable(records), ["n", "a"], k)


def country_sizes(rows: DataFrame) -> DataFrame:
    """country, n: rows of each country."""
    return rows.groupBy("country").agg(F.count("*").alias("n"))


def delete_counts(s1: DataFrame, records: DataFrame, test_s1: DataFrame, test_records: DataFrame) -> DataFrame:
    """country, n_delete of every training country; a row per country passes through the driver."""

    def sizes(rows: DataFrame) -> dict[str, int]:
        return {r["country"]: r["n"] for r in country_sizes(rows).collect()}

    a, b, c, d = map(sizes, (s1, records, test_s1, test_records))
    rows = [(k, max(0, testlike.n_to_delete(n, b.get(k, 0), c.get(k, 0), d.get(k, 0)))) for k, n in a.items()]
    return s1.sparkSession.createDataFrame(rows, "country string, n_delete long")


@dataclass
class Trained:
    """What scoring needs: the script table, the models and the rules."""

    table: DataFrame
    cheap: object
    trees: object
    second: object
    stacker: object
    rules: DataFrame
    report: DataFrame


def pair_texts(pairs: DataFrame, s1: DataFrame, records: DataFrame) -> DataFrame:
    """Add a (record) and b (business): the raw text of both sides."""

    def own(rows: DataFrame, key: str, out: str) -> DataFrame:
        return rows.select("country", F.col("entity_id").alias(key), text.pair_text(F.col("business_name"), F.col("business_address")).alias(out))

    return pairs.join(own(records, "rec_id", "a"), ["country", "rec_id"]).join(own(s1, "cand_id", "b"), ["country", "cand_id"])


def other_texts(pairs: DataFrame, begun: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs whose ``keys`` are not among those of ``begun``."""
    return pairs.join(begun.select(*keys).distinct(), keys, "left_anti").select(*pairs.columns)


def pair_sample(pairs: DataFrame, first: int, more: int) -> DataFrame:
    """Training pairs for the second scorer: ``first`` in a random order, then ``more`` of other texts.

    Countries take part by their share of the pairs, rounded; no country is sorted in one task.
    """

    def some(rows: DataFrame, most: int) -> DataFrame:
        sizes = rows.groupBy("country").agg(F.count("*").alias("size_"))  # a row per country
        wanted = sizes.select("country", F.round(F.lit(most) * F.col("size_") / F.sum("size_").over(Window.partitionBy())).cast("long").alias("most_"))
        keyed = rows.join(wanted, "country").withColumn("id", F.col("cand_id"))
        return first_by_hash(keyed, testlike.hash_order("country", "rec_id", "cand_id"), F.col("most_")).select(*pairs.columns)

    begun = some(pairs, first)
    return begun.unionByName(some(other_texts(pairs, begun, ["country", "a", "b"]), more))


def train(stages: Stages, s1: DataFrame, records: DataFrame, truth: DataFrame, test_s1: DataFrame, test_records: DataFrame, settings: Settings, scorer=None) -> Trained:
    """Fit everything on labelled sources; ``truth``: source1_entity_id, other_id. One held-out split serves every step."""
    split = stages("splits", lambda: testlike.splits(s1, settings.held_out))
    learn_from = split.filter("not is_val")
    tables = {
        name: stages(f"script_{name}", lambda rows=rows: translit.learn(translit.script_pairs(rows, records, truth))) for name, rows in (("train", learn_from), ("all", s1))
    }
    ours = stages("train_s1", lambda: translit.prepare(split, tables["train"]))
    theirs = stages("train_records", lambda: translit.prepare(records, tables["train"]))
    found = stages("train_search", lambda: shortlist(ours, theirs, settings.search_k))
    gone = stages("train_deleted", lambda: testlike.deletions(ours, delete_counts(s1, records, test_s1, test_records), settings.twin_cap))
    kept = ours.join(gone.select(F.col("id").alias("entity_id")), "entity_id", "left_anti")
    short = stages("train_short", lambda: blocking.compact(found, gone.select(F.col("id").alias("cand_id")), settings.compare_k))
    owned = stages("owners", lambda: testlike.owners(theirs, truth, kept))
    compared = stages("train_features", lambda: features.comparisons(short, kept, theirs))
    held_out = kept.filter("is_val").select(F.col("entity_id").alias("cand_id"))
    pairs = testlike.training_pairs(testlike.labelled(compared, owned), held_out)
    pairs = stages("train_pairs", lambda: models.trimmed(pairs, settings.cheap_rounds, settings.cheap_least))
    cheap = models.fitted_or_saved(models.cheap_trees(settings.cheap_rounds, settings.cheap_least), pairs.filter("train"), stages.path("cheap_model"))
    business = kept.select("country", F.col("entity_id").alias("cand_id"), "v_tune", "v_report").join(testlike.true_match_count(kept, owned), "cand_id")
    fit_on = pairs.filter("keep").join(business.select("cand_id", "v_tune"), "cand_id").filter("train or v_tune").withColumn("valid_", ~F.col("train"))
    trees = models.fitted_or_saved(models.final_trees(settings.tree_rounds, settings.tree_least), fit_on, stages.path("tree_model"))
    sample = stages("second_pairs", lambda: pair_sample(pair_texts(pairs.filter("train and keep").select("country", "rec_id", "cand_id", "y"), kept, theirs), settings.pair_first, settings.pair_more))
    second = (scorer or models.text_scorer(path=stages.path("second_model")))(sample)
    chosen = business.filter("v_tune or v_report").filter(testlike.uniform("cand_id", seed=testlike.SEED + 2) < settings.evaluation)
    evaluated = pairs.filter("keep and not train")
    touched = evaluated.join(chosen.select("cand_id"), "cand_id", "left_semi").select("rec_id").distinct()
    selected = models.probability(trees, evaluated.join(touched, "rec_id", "left_semi"), "tree").select("country", "rec_id", "cand_id", "rank", "y", "tree")
    selected = stages("evaluated", lambda: second(pair_texts(selected, kept, theirs), "second").drop("a", "b"))
    tune_on = selected.join(chosen.filter("v_tune").select("cand_id"), "cand_id", "left_semi").filter(models.unsure(F.col("tree")))
    stack = models.stacker(tune_on, path=stages.path("stacker")) if tune_on.groupBy("y").count().count() == 2 else None
    blended = models.stacked(stack, selected) if stack else selected.withColumn("prob", F.col("tree"))
    scored = blended.select("country", F.col("rec_id").alias("rec"), F.col("cand_id").alias("cand"), F.col("rank").alias("rnk"), "prob", "y")
    scored = stages("scored", lambda: scored)
    masks = chosen.select("country", F.col("cand_id").alias("cand"), "k", "v_tune", "v_report")
    rules = stages("rules", lambda: decision.tune_rule(scored, masks.filter("v_tune"), masks.filter("v_report")))
    return Trained(tables["all"], cheap, trees, second, stack, rules, rules.select("country", "report"))


def score(stages: Stages, trained: Trained, s1: DataFrame, records: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(matches, candidates), both source1_entity_id, other_id, for new sources."""
    ours = stages("test_s1", lambda: translit.prepare(s1, trained.table))
    theirs = stages("test_records", lambda: translit.prepare(records, trained.table))
    short = stages("test_short", lambda: shortlist(ours, theirs, settings.compare_k))
    compared = stages("test_features", lambda: features.comparisons(short, ours, theirs))
    pairs = models.probability(trained.cheap, compared, "cheap").filter(F.col("cheap") >= decision.TRIM)
    pairs = stages("test_trees", lambda: models.probability(trained.trees, pairs, "tree").select("country", "rec_id", "cand_id", "rank", "tree"))
    unsure = pair_texts(pairs.filter(models.unsure(F.col("tree"))), ours, theirs)
    seconds = trained.second(unsure, "second").select("country", "rec_id", "cand_id", "second")
    both = pairs.join(seconds, ["country", "rec_id", "cand_id"], "left")
    blended = models.stacked(trained.stacker, both) if trained.stacker else both.withColumn("prob", F.col("tree"))
    scored = stages("test_scored", lambda: blended.select("country", F.col("rec_id").alias("rec"), F.col("cand_id").alias("cand"), F.col("rank").alias("rnk"), "prob"))
    businesses = ours.select("country", F.col("entity_id").alias("cand"))
    accepted = decision.decide_test(scored, decision.rule_for(businesses, trained.rules), businesses)
    named = [F.col("cand").alias("source1_entity_id"), F.col("rec").alias("other_id")]
    return accepted.select(*named), scored.select(*named)


def run(spark: SparkSession, data_dir: str, out_dir: str, work_dir: str, settings: Settings | None = None, scorer=None) -> DataFrame:
    """Read train and test sources, train, score, write both outputs; returns their digests."""
    settings = settings or Settings()
    stages = Stages(spark, work_dir, settings, data_dir, getattr(scorer, "__qualname__", repr(scorer)) if scorer else "")

    def read(split: str, name: str, columns=schema.SOURCE) -> DataFrame:
        return tsv.read_source(spark, tsv.path_of(data_dir, split, name), columns)

    train_s1, test_s1 = read("train", "source1"), read("test", "source1")
    train_records, test_records = (read(s, "source2").unionByName(read(s, "source3")) for s in ("train", "test"))
    truth = tsv.truth_pairs(read("train", "ground_truth", schema.TRUTH))
    trained = train(stages, train_s1, train_records, truth, test_s1, test_records, settings, scorer)
    matches, candidates = score(stages, trained, test_s1, test_records, settings)
    ids = test_s1.select("entity_id").withColumn("position", F.monotonically_increasing_id())  # file order
    return tsv.write_outputs(ids, stages("matches", lambda: matches), stages("candidates", lambda: candidates), out_dir)


def main(args: list[str] | None = None) -> None:
    from rowkin.session import session

    parser = argparse.ArgumentParser(description="Link Source 2 and 3 records to Source 1 businesses.")
    for name in ("data-dir", "out-dir", "work-dir"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--threads", type=int, default=0, help="run locally on so many threads; 0: the cluster that submits")
    parser.add_argument("--pair-first", type=int, default=Settings.pair_first)
    parser.add_argument("--pair-more", type=int, default=Settings.pair_more)
    given = parser.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s")
    spark = session(f"local[{given.threads}]" if given.threads else None)
    run(spark, given.data_dir, given.out_dir, given.work_dir, Settings(pair_first=given.pair_first, pair_more=given.pair_more)).show(truncate=False)


if __name__ == "__main__":
    main()
