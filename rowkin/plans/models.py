"""Models over pair features: a cheap first model and its trim, boosted trees, a second pair scorer, and their stacker."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowkin.functions import text
from rowkin.operators.features import FEATURES
from rowkin.operators.testlike import SEED
from rowkin.plans.decision import BAND, TRIM

CHEAP = ["score", "rank", "gap_top1", "margin12", "cos_name", "cos_addr"]


def trees(columns: list[str], rounds: int, rate: float, depth: int, least: int, share: float = 1.0, validation: str | None = None) -> Pipeline:
    """Assembled features and gradient-boosted trees on ``y`` (double).

    With ``validation`` (a boolean column) training ends once the error of those rows rises; the library's default tolerance would
    end it at the first gain under 1 %.
    """
    vector = VectorAssembler(inputCols=columns, outputCol="x_", handleInvalid="keep")
    model = GBTClassifier(featuresCol="x_", labelCol="y_", maxIter=rounds, stepSize=rate, maxDepth=depth, minInstancesPerNode=least, validationTol=0.0, seed=SEED)
    model = model.setFeatureSubsetStrategy(str(share) if share < 1 else "all")
    if validation:
        model = model.setValidationIndicatorCol(validation)
    return Pipeline(stages=[vector, model])


def cheap_trees(rounds: int = 100, least: int = 100) -> Pipeline:
    """The first model, on the six columns of the shortlist."""
    return trees(CHEAP, rounds, 0.1, 4, least)


def final_trees(rounds: int = 3000, least: int = 500, validation: str | None = "valid_") -> Pipeline:
    """The final model, on all columns; it stops early on the rows marked by ``validation``."""
    return trees(FEATURES, rounds, 0.05, 8, least, 0.8, validation)


def default_trees(columns: list[str] = FEATURES, rounds: int = 300, least: int = 50, validation: str | None = None) -> Pipeline:
    """Trees of up to 64 leaves, for columns of no particular size."""
    return trees(columns, rounds, 0.05, 6, least, 0.9, validation)


def fit(pipeline: Pipeline, rows: DataFrame) -> PipelineModel:
    return pipeline.fit(rows.withColumn("y_", F.col("y").cast("double")))


def probability(model: PipelineModel, rows: DataFrame, out: str) -> DataFrame:
    """Add ``out``: the model's probability that the pair is a match."""
    return model.transform(rows).withColumn(out, vector_to_array("probability")[1]).select(*rows.columns, out)


def fitted_or_saved(pipeline: Pipeline, rows: DataFrame, path: str | None) -> PipelineModel:
    """A saved model if ``path`` holds one, else a new one, saved there."""
    spark = rows.sparkSession
    if path:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            return PipelineModel.load(path)
    model = fit(pipeline, rows)
    if path:  # under its own name only once it is whole, so that a run that was stopped leaves nothing to be read
        model.write().overwrite().save(f"{path}.part")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).rename(spark._jvm.org.apache.hadoop.fs.Path(f"{path}.part"), folder)
    return model


def fold(record: Column) -> Column:
    return F.pmod(F.xxhash64(record), F.lit(2))


def trimmed(pairs: DataFrame, rounds: int = 100, least: int = 100) -> DataFrame:
    """Add cheap and keep: training pairs scored out of fold (two folds by record), others by a model of all training pairs."""
    rows = pairs.withColumn("fold_", fold(F.col("rec_id")))
    parts = []
    train = rows.filter("train")
    for own in (0, 1):
        model = fit(cheap_trees(rounds, least), train.filter(F.col("fold_") != own))
        parts.append(probability(model, train.filter(F.col("fold_") == own), "cheap"))
    parts.append(probability(fit(cheap_trees(rounds, least), train), rows.filter("not train"), "cheap"))
    out = parts[0].unionByName(parts[1]).unionByName(parts[2]).drop("fold_")
    return out.withColumn("keep", F.col("cheap") >= TRIM)


#: A second scorer: fits on pairs (a, b, y) and returns a function that adds a logit column.
Scorer = Callable[[DataFrame], Callable[[DataFrame, str], DataFrame]]


def text_scorer(buckets: int = 1 << 12, iterations: int = 40, path: str | None = None) -> Scorer:
    """The default second scorer: logistic regression on hashed character trigrams the two texts share or don't.

    With ``path`` a fitted model is saved there, and a later run reads it instead of fitting again.

    It stands in for a cross-encoder, which needs a GPU and libraries that are not assumed; any ``Scorer`` can take its place.
    """

    def grams(c: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3))))

    def prepared(pairs: DataFrame) -> DataFrame:
        rows = pairs.withColumns({"a_": grams(F.lower("a")), "b_": grams(F.lower("b"))})
        tag = lambda name, values: F.transform(values, lambda g: F.concat(F.lit(name), g))
        rows = rows.withColumn("terms_", F.concat(tag("both:", F.array_intersect("a_", "b_")), tag("a:", F.array_except("a_", "b_")), tag("b:", F.array_except("b_", "a_"))))
        return rows.withColumn("share_", F.size(F.array_intersect("a_", "b_")) / F.greatest(F.size(F.array_union("a_", "b_")), F.lit(1))).drop("a_", "b_")

    def train(pairs: DataFrame):
        stages = [
            HashingTF(inputCol="terms_", outputCol="tf_", numFeatures=buckets),
            VectorAssembler(inputCols=["tf_", "share_"], outputCol="x_"),
            LogisticRegression(featuresCol="x_", labelCol="y_", regParam=1e-3, maxIter=iterations),
        ]
        model = fitted_or_saved(Pipeline(stages=stages), prepared(pairs), path)

        def score(rows: DataFrame, out: str) -> DataFrame:
            return model.transform(prepared(rows)).withColumn(out, vector_to_array("rawPrediction")[1]).select(*rows.columns, out)

        return score

    return train


def unsure(p: Column) -> Column:
    return (p > BAND[0]) & (p < BAND[1])


def stacker(rows: DataFrame, c: float = 1e4, path: str | None = None) -> PipelineModel:
    """Logistic regression on the trees' and the second scorer's logits; ``rows``: tree, second, y. ``c`` is inverse strength.

    With ``path`` a fitted model is saved there or read from there.
    """
    n = max(1, rows.count())
    vector = VectorAssembler(inputCols=["tree_logit_", "second"], outputCol="x_")
    model = LogisticRegression(featuresCol="x_", labelCol="y_", regParam=1 / (c * n), standardization=False, maxIter=1000)
    return fitted_or_saved(Pipeline(stages=[vector, model]), rows.withColumn("tree_logit_", text.logit(F.col("tree"))), path)


def stacked(model: PipelineModel, rows: DataFrame, out: str = "prob") -> DataFrame:
    """Add ``out``: the stacker's probability where the trees are unsure and a second score exists, the trees' elsewhere."""
    inside = rows.filter(unsure(F.col("tree")) & F.col("second").isNotNull())
    outside = rows.filter(~(unsure(F.col("tree")) & F.col("second").isNotNull())).withColumn(out, F.col("tree"))
    made = probability(model, inside.withColumn("tree_logit_", text.logit(F.col("tree"))), out).drop("tree_logit_")
    return made.unionByName(outside)
