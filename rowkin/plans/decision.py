"""The decision rule: one business per record, floors and factors per business, bars per record, and their tuning.

Pairs hold country, rec, cand, rnk, prob and, for tuning, y; businesses hold country, cand, k (true records) and masks.
Everything is grouped by country, so nothing is ordered or summed in a single task for all countries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowkin.functions import text

#: Tuning grids: floors and bars of a business's best score and a record's score, factors of the best score.
FLOORS = [round(0.30 + 0.02 * i, 2) for i in range(31)]
FACTORS = [round(0.50 + 0.05 * i, 2) for i in range(11)]
BARS = [round(0.30 + 0.025 * i, 3) for i in range(27)]
TOLERANCE = 0.001
TRIM, BAND = 0.01, (0.05, 0.95)
KEY = ["country", "cand"]


def grid(pairs: DataFrame, **values: list[float]) -> DataFrame:
    """A table of every combination of the grid values; a few hundred rows at most."""
    spark = pairs.sparkSession
    out = None
    for name, listed in values.items():
        one = spark.createDataFrame([(v,) for v in listed], f"{name} double")
        out = one if out is None else out.crossJoin(one)
    return F.broadcast(out)


def best_top(pairs: DataFrame) -> DataFrame:
    """Add best (the pair is its record's most likely, ties to the lower rnk) and top (a business's best such score)."""
    order = Window.partitionBy("country", "rec").orderBy(F.desc("prob"), "rnk")
    marked = pairs.withColumn("best", F.row_number().over(order) == 1)
    return marked.withColumn("top", F.coalesce(F.max(F.when(F.col("best"), F.col("prob"))).over(Window.partitionBy(*KEY)), F.lit(float("-inf"))))


def decide(pairs: DataFrame, least: float) -> DataFrame:
    """Each record's single most likely pair, if its score reaches ``least``."""
    order = Window.partitionBy("country", "rec").orderBy(F.desc("prob"), "rnk")
    return pairs.withColumn("nth_", F.row_number().over(order)).filter((F.col("nth_") == 1) & (F.col("prob") >= least)).drop("nth_")


def drawbridge(pairs: DataFrame, rules: DataFrame) -> DataFrame:
    """Pairs a business keeps: best, its top at the floor or above, and the score at factor times the top or above.

    ``rules``: country, floor, factor.
    """
    rows = best_top(pairs).join(F.broadcast(rules), "country")
    return rows.filter(F.col("best") & (F.col("top") >= F.col("floor")) & (F.col("prob") >= F.col("factor") * F.col("top")))


def f_score(tp, fp, k):
    """F0.5 of a business; 1 where it has no true record and accepts none."""
    return F.when((k == 0) & (fp == 0), F.lit(1.0)).otherwise(1.25 * tp / (1.25 * tp + 0.25 * (k - tp) + fp))


def macro_f05(accepted: DataFrame, businesses: DataFrame) -> DataFrame:
    """country, f05, f05_none (businesses without true records), f05_some: means over ``businesses`` (country, cand, k)."""
    y = F.col("y")
    counts = accepted.groupBy(*KEY).agg(F.count_if(y).alias("tp"), F.count_if(~y).alias("fp"))
    rows = businesses.join(counts, KEY, "left").na.fill(0, ["tp", "fp"]).withColumn("f", f_score(F.col("tp"), F.col("fp"), F.col("k")))
    none = F.col("k") == 0
    return rows.groupBy("country").agg(F.avg("f").alias("f05"), F.avg(F.when(none, F.col("f"))).alias("f05_none"), F.avg(F.when(~none, F.col("f"))).alias("f05_some"))


def accepted_per_business(accepted: DataFrame, businesses: DataFrame) -> DataFrame:
    """country, accepted: accepted pairs per business."""
    n = businesses.groupBy("country").agg(F.count("*").alias("n"))
    got = accepted.groupBy("country").agg(F.count("*").alias("got"))
    return n.join(got, "country", "left").select("country", (F.coalesce("got", F.lit(0)) / F.col("n")).alias("accepted"))


def _gain(tp, fp, k):
    """What a business scores beyond what it would with nothing kept."""
    return f_score(tp, fp, k) - F.when(k == 0, 1.0).otherwise(0.0)


def _base(businesses: DataFrame) -> DataFrame:
    """country, n businesses, none of them without true records: what a curve starts from where nothing is kept."""
    return businesses.groupBy("country").agg(F.count("*").alias("n"), F.count_if(F.col("k") == 0).alias("none"))


def _counted(kept: DataFrame, businesses: DataFrame, names: list[str]) -> DataFrame:
    """country, grid values, cand, tp, fp, k of the businesses that keep a pair there.

    Businesses that keep nothing at a point count 0, or 1 without true records: they come from totals, not from a cross join
    of businesses and points.
    """
    y = F.col("y")
    per = kept.groupBy("country", *names, "cand").agg(F.count_if(y).alias("tp"), F.count_if(~y).alias("fp"))
    return per.join(businesses.select(*KEY, "k"), KEY)


def _points(base: DataFrame, gains: DataFrame, points: DataFrame, names: list[str]) -> DataFrame:
    """country, grid values, f05 at every grid point of every country. Rounded, so that ties are ties in any order of sums."""
    f05 = (F.col("none") + F.coalesce("gain", F.lit(0.0))) / F.col("n")
    return base.crossJoin(points).join(gains, ["country", *names], "left").select("country", *names, F.round(f05, 9).alias("f05"))


def floor_curve(pairs: DataFrame, businesses: DataFrame, factors: list[float] = FACTORS, floors: list[float] = FLOORS) -> DataFrame:
    """country, floor, factor, f05 at every grid point, over ``businesses``.

    A floor keeps or drops a business as a whole. So each business's gain is found once per factor, counted at the number of
    floors its top reaches, and the floors' curve is a sum over those numbers: pairs meet the factors, never the whole grid.
    """
    points = grid(pairs, floor=floors, factor=factors)
    best = best_top(pairs).filter("best").join(businesses.select(*KEY), KEY, "left_semi")
    reach = sum((F.col("top") >= f).cast("int") for f in floors)
    kept = best.withColumn("factor", F.explode(F.array(*map(F.lit, factors)))).filter(F.col("prob") >= F.col("factor") * F.col("top"))
    counts = _counted(kept.withColumn("reach", reach), businesses, ["factor", "reach"])
    gains = counts.groupBy("country", "factor", "reach").agg(F.sum(_gain(F.col("tp"), F.col("fp"), F.col("k"))).alias("gain"))
    steps = grid(pairs, floor=floors).withColumn("least_", sum((F.col("floor") >= f).cast("int") for f in floors))
    per = gains.join(steps, F.col("reach") >= F.col("least_")).groupBy("country", "floor", "factor").agg(F.sum("gain").alias("gain"))
    return _points(_base(businesses), per, points, ["floor", "factor"])


def tune_drawbridge(pairs: DataFrame, businesses: DataFrame) -> DataFrame:
    """country, floor, factor, f05: the best grid point, ties to the lower floor, then the lower factor."""
    order = Window.partitionBy("country").orderBy(F.desc("f05"), "floor", "factor")
    return floor_curve(pairs, businesses).withColumn("nth_", F.row_number().over(order)).filter("nth_ = 1").drop("nth_")


def bar_curve(pairs: DataFrame, businesses: DataFrame, rules: DataFrame, bars: list[float] = BARS) -> DataFrame:
    """country, bar, f05 at every bar on a record's score, on top of ``rules`` (country, floor, factor).

    Pairs never meet the bars: a pair counts at the number of bars it reaches, a business's counts cumulate from the highest of
    its reaches down (at most one row per bar), and the curve sums how much its gain changes at each.
    """
    kept = drawbridge(pairs, rules).join(businesses.select(*KEY), KEY, "left_semi")
    counts = _counted(kept.withColumn("reach", sum((F.col("prob") >= x).cast("int") for x in bars)).filter("reach > 0"), businesses, ["reach"])
    down = Window.partitionBy(*KEY).orderBy(F.desc("reach"))
    upto = counts.withColumns({"tp": F.sum("tp").over(down), "fp": F.sum("fp").over(down)})
    upto = upto.withColumn("gain", _gain(F.col("tp"), F.col("fp"), F.col("k")))
    step = F.col("gain") - F.coalesce(F.lag("gain").over(down), F.lit(0.0))
    changes = upto.withColumn("step_", step).groupBy("country", "reach").agg(F.sum("step_").alias("gain"))
    steps = grid(pairs, bar=bars).withColumn("least_", sum((F.col("bar") >= x).cast("int") for x in bars))
    per = changes.join(steps, F.col("reach") >= F.col("least_")).groupBy("country", "bar").agg(F.sum("gain").alias("gain"))
    return _points(_base(businesses), per, grid(pairs, bar=bars), ["bar"])


def safe_range(points: DataFrame, value: str, tolerance: float = TOLERANCE) -> DataFrame:
    """country, safe_lo, safe_hi: the unbroken run of grid values around the best one that stay within ``tolerance`` of it."""
    country = Window.partitionBy("country")
    rows = points.withColumn("most_", F.max("f05").over(country)).withColumn("good_", F.col("f05") >= F.col("most_") - tolerance)
    rows = rows.withColumn("at_", F.min(F.when(F.col("f05") == F.col("most_"), F.col(value))).over(country))
    # the run number goes up at every value outside the tolerance
    rows = rows.withColumn("run_", F.sum((~F.col("good_")).cast("int")).over(country.orderBy(value)))
    rows = rows.withColumn("best_run_", F.max(F.when(F.col(value) == F.col("at_"), F.col("run_"))).over(country))
    inside = rows.filter(F.col("good_") & (F.col("run_") == F.col("best_run_")))
    return inside.groupBy("country").agg(F.min(value).alias("safe_lo"), F.max(value).alias("safe_hi"))


def bins(score: Column) -> Column:
    """Ranges of a probability that keep its order: some 8,000 steps of its logit, finest where tree scores crowd, near 0 and 1."""
    return F.floor(text.logit(score) * 256)


def count_bar(pairs: DataFrame, rules: DataFrame, businesses: DataFrame) -> DataFrame:
    """country, bar: the score of the n-th best pair kept, n = target times businesses (rounded half to even); 1 if n is 0.

    ``rules``: country, floor, factor, target. A two-level count finds the n-th score without sorting a country in one task.
    """
    kept = drawbridge(pairs, rules.select("country", "floor", "factor")).select("country", "prob")
    n = businesses.groupBy("country").agg(F.count("*").alias("n_"))
    got = kept.groupBy("country").agg(F.count("*").alias("got"))
    want = rules.select("country", "target").join(n, "country").join(got, "country", "left")
    want = want.select("country", F.least(F.bround(F.col("target") * F.col("n_")).cast("long"), F.coalesce("got", F.lit(0))).alias("want"))
    counts = kept.withColumn("bin_", bins(F.col("prob"))).groupBy("country", "bin_").agg(F.count("*").alias("c_"))
    ahead = Window.partitionBy("country").orderBy(F.desc("bin_")).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("ahead_", F.coalesce(F.sum("c_").over(ahead), F.lit(0))).join(want, "country")
    here = counts.filter((F.col("want") > F.col("ahead_")) & (F.col("want") <= F.col("ahead_") + F.col("c_")))
    near = kept.withColumn("bin_", bins(F.col("prob"))).join(F.broadcast(here.select("country", "bin_", "ahead_", "want")), ["country", "bin_"])
    values = near.groupBy("country", "prob", "ahead_", "want").agg(F.count("*").alias("c_"))
    running = F.sum("c_").over(Window.partitionBy("country").orderBy(F.desc("prob")))
    hit = values.withColumn("upto_", F.col("ahead_") + running).filter((F.col("upto_") >= F.col("want")) & (F.col("upto_") - F.col("c_") < F.col("want")))
    return want.select("country").join(hit.select("country", F.col("prob").alias("bar")), "country", "left").na.fill(1.0, ["bar"])


def count_floor(pairs: DataFrame, rules: DataFrame, businesses: DataFrame) -> DataFrame:
    """country, floor: the best score of a business at which as many pairs as possible to target are kept (ties: the greater).

    ``rules``: country, factor, target. Only distinct best scores are candidates. What is kept grows as the floor goes down, so
    they are the ends of score ranges and the scores inside the ranges where the target is passed; no country is sorted as a whole.
    """
    rows = best_top(pairs).join(F.broadcast(rules.select("country", "factor", "target")), "country")
    kept = rows.filter(F.col("best") & (F.col("prob") >= F.col("factor") * F.col("top")))
    tops = kept.groupBy("country", "top", "target").agg(F.count("*").alias("c_")).withColumn("bin_", bins(F.col("top")))
    n = businesses.groupBy("country").agg(F.count("*").alias("n_"))
    ranges = tops.groupBy("country", "bin_", "target").agg(F.sum("c_").alias("c_"), F.min("top").alias("top")).join(n, "country")
    ahead = Window.partitionBy("country").orderBy(F.desc("bin_")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("goal_", F.col("target") * F.col("n_")).withColumn("ahead_", F.coalesce(F.sum("c_").over(ahead), F.lit(0)))
    end = F.col("ahead_") + F.col("c_")
    passed = ranges.filter((F.col("ahead_") <= F.greatest("goal_", F.lit(0.0))) & (F.col("goal_") <= end)).select("country", "bin_", "ahead_", "goal_")
    inside = tops.join(F.broadcast(passed), ["country", "bin_"])
    upto = F.col("ahead_") + F.sum("c_").over(Window.partitionBy("country", "bin_").orderBy(F.desc("top")))
    values = ranges.select("country", "top", "goal_", end.alias("upto_")).unionByName(inside.select("country", "top", "goal_", upto.alias("upto_")))
    order = Window.partitionBy("country").orderBy(F.round(F.abs(F.col("upto_") - F.col("goal_")), 9), F.desc("top"))
    return values.withColumn("nth_", F.row_number().over(order)).filter("nth_ = 1").select("country", F.col("top").alias("floor"))


def tune_rule(pairs: DataFrame, tune: DataFrame, report: DataFrame) -> DataFrame:
    """country, floor, factor, bar, safe_lo, safe_hi, target, report: a rule tuned on some businesses, measured on others."""
    rules = tune_drawbridge(pairs, tune).select("country", "floor", "factor")
    bars = bar_curve(pairs, tune, rules)
    order = Window.partitionBy("country").orderBy(F.desc("f05"), "bar")
    best = bars.withColumn("nth_", F.row_number().over(order)).filter("nth_ = 1").select("country", "bar")
    full = rules.join(best, "country").join(safe_range(bars, "bar"), "country")
    kept = drawbridge(pairs, rules).join(F.broadcast(best), "country").filter("prob >= bar")
    target = accepted_per_business(kept.join(tune.select(*KEY), KEY, "left_semi"), tune).withColumnRenamed("accepted", "target")
    measured = macro_f05(kept.join(report.select(*KEY), KEY, "left_semi"), report).select("country", F.col("f05").alias("report"))
    return full.join(target, "country").join(measured, "country", "left")


def pooled_rule(rules: DataFrame) -> DataFrame:
    """One row for countries without a rule: mean floor, factor and target, and the widest safe range."""
    mean = [F.avg(x).alias(x) for x in ("floor", "factor", "target")]
    return rules.agg(*mean, F.min("safe_lo").alias("safe_lo"), F.max("safe_hi").alias("safe_hi"))


def rule_for(countries: DataFrame, rules: DataFrame) -> DataFrame:
    """A rule for every country: its own, or the pooled one."""
    names = ["floor", "factor", "target", "safe_lo", "safe_hi"]
    pooled = pooled_rule(rules).select(*[F.col(x).alias(f"{x}_") for x in names])
    rows = countries.select("country").distinct().join(rules.select("country", *names), "country", "left").crossJoin(F.broadcast(pooled))
    return rows.select("country", *[F.coalesce(x, f"{x}_").alias(x) for x in names])


def decide_test(pairs: DataFrame, rules: DataFrame, businesses: DataFrame) -> DataFrame:
    """Pairs accepted with the bar that keeps target pairs per business, held within the safe range."""
    bars = count_bar(pairs, rules, businesses).join(rules, "country")
    bars = bars.select("country", F.least(F.greatest("bar", "safe_lo"), "safe_hi").alias("bar"))
    return drawbridge(pairs, rules.select("country", "floor", "factor")).join(F.broadcast(bars), "country").filter("prob >= bar")


def trim_statistics(pairs: DataFrame, businesses: DataFrame, score: str = "prob") -> DataFrame:
    """pairs_per_business and recall (share of true pairs) of the pairs that the trim keeps."""
    keep = F.col(score) >= TRIM
    kept = pairs.agg(F.count_if(keep).alias("kept_"), F.count_if(keep & F.col("y")).alias("true_"), F.count_if("y").alias("all_"))
    n = businesses.agg(F.count("*").alias("n_"))  # both sides are one row
    return kept.crossJoin(n).select((F.col("kept_") / F.col("n_")).alias("pairs_per_business"), (F.col("true_") / F.col("all_")).alias("recall"))


def blend(pairs: DataFrame, tree: str, second: str, out: str = "prob") -> DataFrame:
    """The second model's probability where the trees are unsure, the trees' elsewhere (or where the second is null)."""
    unsure = (F.col(tree) > BAND[0]) & (F.col(tree) < BAND[1]) & F.col(second).isNotNull()
    return pairs.withColumn(out, F.when(unsure, F.col(second)).otherwise(F.col(tree)))
