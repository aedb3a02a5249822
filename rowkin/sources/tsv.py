"""Tab-separated sources and sinks: header, no quoting, every column a nullable string, an empty field is null."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowkin import schema

OPTIONS = {"sep": "\t", "header": "true", "quote": "", "escape": "", "lineSep": "\n"}
NAMES = ("source1", "source2", "source3", "ground_truth")


class SourceError(ValueError):
    """A source or an output breaks an invariant."""


def path_of(data_dir: str, split: str, name: str) -> str:
    """Where a table of a split lies: <data_dir>/<split>/<split>_<name>.tsv."""
    if name not in NAMES:
        raise SourceError(f"unknown table {name}")
    return f"{data_dir.rstrip('/')}/{split}/{split}_{name}.tsv"


def read_source(spark: SparkSession, path: str, columns=schema.SOURCE, check: bool = True) -> DataFrame:
    """Read a table; ``columns`` are looked up by the header, so files may hold more. Fails if rows were lost or merged."""
    header = (spark.read.option("lineSep", "\n").text(path).first() or [""])[0].rstrip("\r").split("\t")
    missing = [f.name for f in columns if f.name not in header]
    if missing:
        raise SourceError(f"{path} has no column {missing}")
    whole = schema._strings(*header)
    rows = spark.read.schema(whole).options(**OPTIONS).option("mode", "FAILFAST").csv(path).select(*[f.name for f in columns])
    if check:
        check_rows(spark, rows, path)
    return rows


def check_rows(spark: SparkSession, rows: DataFrame, path: str) -> int:
    """Rows read must be the file's lines less the header."""
    lines, read = spark.read.option("lineSep", "\n").text(path).count() - 1, rows.count()
    if lines != read:
        raise SourceError(f"{path}: {read} rows read of {lines} lines")
    return read


def truth_pairs(truth: DataFrame) -> DataFrame:
    """One (source1_entity_id, other_id) row for every true match; empty lists give none."""
    ids = F.split(F.col("matched_entity_ids"), ",")
    return truth.select("source1_entity_id", F.explode(ids).alias("other_id")).dropna().filter("other_id <> ''")


def id_lists(ids: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """Every Source 1 id with its pairs' other ids, distinct, sorted and joined by commas; empty where there are none.

    Ids are gathered per business, of which a record joins at most one, so a list is bounded by the business's own records.
    """
    lists = pairs.groupBy("source1_entity_id").agg(F.array_join(F.array_sort(F.collect_set("other_id")), ",").alias(name))
    joined = ids.join(lists, ids["entity_id"] == lists["source1_entity_id"], "left")
    return joined.select(*[ids[c] for c in ids.columns], F.coalesce(lists[name], F.lit("")).alias(name))


def output_faults(ids: DataFrame, matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """check, faults: broken invariants of the two outputs. All must be 0."""
    keys = ["source1_entity_id", "other_id"]
    both = candidates.select(*keys)

    def counted(name: str, rows: DataFrame) -> DataFrame:
        return rows.agg(F.lit(name).alias("check"), F.count("*").alias("faults"))

    known = ids.select(F.col("entity_id").alias("source1_entity_id"))
    parts = [
        counted("match_outside_candidates", matches.select(*keys).join(both, keys, "left_anti")),
        counted("repeated_match", matches.groupBy(*keys).count().filter("count > 1")),
        counted("repeated_candidate", both.groupBy(*keys).count().filter("count > 1")),
        counted("bad_other_id", both.filter(~F.coalesce(F.col("other_id").rlike("^S[23]-"), F.lit(False)))),
        counted("unknown_source1_id", both.join(known, "source1_entity_id", "left_anti")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def write_outputs(ids: DataFrame, matches: DataFrame, candidates: DataFrame, out_dir: str) -> DataFrame:
    """Check and write matching_results and candidate_pairs, one row per Source 1 id in the order of ``position``.

    Each output is a folder of part files in order. Returns file, rows, filled, ids and sha256 of both.
    """
    bad = [r for r in output_faults(ids, matches, candidates).collect() if r["faults"]]
    if bad:
        raise SourceError(f"outputs are not written: {[(r['check'], r['faults']) for r in bad]}")
    digests = None
    for file, name, pairs in (("matching_results", "matched_entity_ids", matches), ("candidate_pairs", "candidate_entity_ids", candidates)):
        rows = id_lists(ids, pairs, name).orderBy("position").select(F.col("entity_id").alias("source1_entity_id"), name)
        rows.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(f"{out_dir.rstrip('/')}/{file}")
        one = output_digest(rows, name).withColumn("file", F.lit(file))
        digests = one if digests is None else digests.unionByName(one)
    return digests


def output_digest(rows: DataFrame, name: str) -> DataFrame:
    """rows, filled (non-empty lists), ids in lists, and an order-free sha256 of the rows."""
    line = F.sha2(F.concat_ws("\t", "source1_entity_id", name), 256)
    parts = [F.sum(F.conv(F.substring(line, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")) for i in range(5)]
    return rows.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col(name) != "").alias("filled"),
        F.coalesce(F.sum(F.when(F.col(name) != "", F.size(F.split(name, ",")))), F.lit(0)).cast("long").alias("ids"),
        F.sha2(F.concat_ws("-", *[F.coalesce(p, F.lit(0)).cast("string") for p in parts]), 256).alias("sha256"),
    )


def with_position(rows: DataFrame, order: str = "entity_id") -> DataFrame:
    """A dense position by ``order`` for sinks that have no order of their own, from two levels of counts."""
    ranged = rows.repartitionByRange(order).withColumn("part_", F.spark_partition_id())
    sizes = ranged.groupBy("part_").agg(F.count("*").alias("n_"))
    ahead = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part_", F.coalesce(F.sum("n_").over(ahead), F.lit(0)).alias("ahead_"))  # a row per partition
    nth = F.row_number().over(Window.partitionBy("part_").orderBy(order))
    return ranged.withColumn("nth_", nth).join(sizes, "part_").withColumn("position", F.col("ahead_") + F.col("nth_") - 1).drop("part_", "nth_", "ahead_")
