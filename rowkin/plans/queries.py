"""Registered queries of the record-linkage engine over the driver's tables, one for each operator that can stand alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowkin import fixtures
from rowkin.functions import similarity, text
from rowkin.functions.address import address_digest
from rowkin.operators import blocking, features, testlike, translit
from rowkin.plans import decision, pipeline
from rowkin.session import shared_folder
from rowkin.sources import tsv

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def c(name: str):
    return F.col(name)


def prepared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Source 1 and records of the part fixture, prepared, as one country."""
    names = ["entity_id", "business_name", "business_address"]
    one, other = (d.select(*names, F.lit("XX").alias("country")) for d in (fixtures.p_s1(spark, sf_dir), fixtures.p_ot(spark, sf_dir)))
    return translit.prepare(one), translit.prepare(other)


def written(rows: DataFrame) -> DataFrame:
    """Rows that several parts of a plan read, kept in the shared checkpoint folder."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(context))
    return rows.checkpoint()


def short_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.p_short(spark, sf_dir).select(F.lit("XX").alias("country"), "rec_id", "cand_id", "rank", "score")


# ---- text


@query
def text_clean(spark, sf_dir):
    docs = fixtures.table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.clean(c("text")).alias("clean"))


@query
def text_numbers(spark, sf_dir):
    return fixtures.p_ot(spark, sf_dir).select("entity_id", F.array_join(text.numbers(c("business_address")), ",").alias("nums"))


@query
def text_core(spark, sf_dir):
    return fixtures.p_s1(spark, sf_dir).select("entity_id", text.core(text.clean(c("business_name"))).alias("core"))


@query
def text_pair_text(spark, sf_dir):
    return fixtures.p_ot(spark, sf_dir).select("entity_id", text.pair_text(c("business_name"), c("business_address")).alias("pair_text"))


@query
def text_street_twin(spark, sf_dir):
    return fixtures.p_ot(spark, sf_dir).select("entity_id", text.twin_street(text.clean(c("business_address"))).alias("street"))


@query
def text_street_family(spark, sf_dir):
    return fixtures.p_ot(spark, sf_dir).select("entity_id", text.family_street(text.clean(c("business_address"))).alias("street"))


@query
def text_unpadded(spark, sf_dir):
    return fixtures.p_ot(spark, sf_dir).select("entity_id", text.unpadded(text.clean(c("business_address"))).alias("address"))


@query
def text_glued(spark, sf_dir):
    return fixtures.p_s1(spark, sf_dir).select("entity_id", text.glued(text.clean(c("business_name"))).alias("glued"))


@query
def text_words(spark, sf_dir):
    rows = fixtures.p_ot(spark, sf_dir)
    return rows.select("entity_id", F.explode(text.words(text.clean(c("business_name")))).alias("word")).groupBy("entity_id").agg(F.count("*").alias("n_words"))


@query
def flag_web(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "pages").select("page_id", text.is_web(c("url")).alias("web"))


@query
def flag_dba(spark, sf_dir):
    return fixtures.p_ot(spark, sf_dir).select("entity_id", text.is_dba(F.concat(c("business_name"), F.lit(" d.b.a. x"))).alias("dba"), text.is_dba(c("business_name")).alias("plain"))


@query
def flag_script(spark, sf_dir):
    """Every third document gets a word in another script, so that both answers occur."""
    added = F.concat(F.coalesce("text", F.lit("")), F.when(c("doc_id") % 3 == 0, F.lit(" दुकान")).otherwise(F.lit("")))
    return fixtures.table(spark, sf_dir, "documents").select("doc_id", text.is_indic(added).alias("script"))


@query
def flag_no_latin(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "documents").select("doc_id", text.no_latin(c("text")).alias("no_latin"))


@query
def flag_honorific(spark, sf_dir):
    return fixtures.p_ot(spark, sf_dir).select("entity_id", text.has_honorific(F.concat(F.lit("shri "), text.clean(c("business_name")))).alias("yes"), text.has_honorific(text.clean(c("business_name"))).alias("no"))


@query
def web_label(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "pages").select("page_id", text.web_label(c("url")).alias("label"))


@query
def legal_forms(spark, sf_dir):
    return fixtures.p_s1(spark, sf_dir).select("entity_id", F.array_join(text.legal_forms(text.clean(c("business_name"))), ",").alias("forms"))


@query
def logit_sigmoid(spark, sf_dir):
    rows = fixtures.l_pairs(spark, sf_dir).select("rec", "cand", text.logit(c("prob")).alias("logit"))
    return rows.select("rec", "cand", F.round("logit", 9).alias("logit"), F.round(text.sigmoid(c("logit")), 9).alias("p"))


@query
def lead_numbers(spark, sf_dir):
    return fixtures.p_ot(spark, sf_dir).select("entity_id", text.lead(F.element_at(text.numbers(F.coalesce("business_address", F.lit("0"))), 1)).alias("lead"))


# ---- sources, joins, outputs


@query
def truth_flatten(spark, sf_dir):
    s1, truth = fixtures.p_s1(spark, sf_dir), fixtures.p_truth(spark, sf_dir)
    return tsv.truth_pairs(tsv.id_lists(s1.select("entity_id"), truth, "matched_entity_ids").withColumnRenamed("entity_id", "source1_entity_id"))


@query
def owner_rows(spark, sf_dir):
    s1 = fixtures.p_s1(spark, sf_dir).filter("k % 4 <> 0")
    return testlike.owners(fixtures.p_ot(spark, sf_dir), fixtures.p_truth(spark, sf_dir), s1)


@query
def fold_semi(spark, sf_dir):
    s1 = fixtures.p_s1(spark, sf_dir)
    fold = s1.filter(testlike.uniform("entity_id", seed=0) >= 0.2).select("entity_id")
    return s1.join(fold, "entity_id", "left_semi").select("entity_id", "country")


@query
def pool_anti(spark, sf_dir):
    pool = fixtures.p_ot(spark, sf_dir).select("country", text.pair_text(c("business_name"), c("business_address")).alias("a"))
    return pipeline.other_texts(pool, pool.filter(F.length("a") % 3 == 0), ["country", "a"])


@query
def output_lists(spark, sf_dir):
    return tsv.id_lists(fixtures.p_s1(spark, sf_dir).select("entity_id"), fixtures.p_truth(spark, sf_dir), "matched_entity_ids")


@query
def output_checks(spark, sf_dir):
    s1, truth = fixtures.p_s1(spark, sf_dir), fixtures.p_truth(spark, sf_dir)
    candidates = truth.filter("other_id not like 'S3-%7'")
    return tsv.output_faults(s1.filter("k % 10 <> 0"), truth, candidates.unionByName(candidates.filter("other_id like 'S2-%1'")))


@query
def output_digest(spark, sf_dir):
    lists = tsv.id_lists(fixtures.p_s1(spark, sf_dir).select("entity_id"), fixtures.p_truth(spark, sf_dir), "ids_")
    return tsv.output_digest(lists.withColumnRenamed("entity_id", "source1_entity_id"), "ids_")


@query
def output_positions(spark, sf_dir):
    return tsv.with_position(fixtures.p_s1(spark, sf_dir).select("entity_id")).select("entity_id", c("position").cast("long").alias("position"))


@query
def country_sizes(spark, sf_dir):
    return pipeline.country_sizes(fixtures.p_s1(spark, sf_dir)).orderBy(F.desc("n"), "country")


# ---- transliteration


def script_fixture(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Names written in shifted letters as a stand-in for another script."""
    s1 = fixtures.p_s1(spark, sf_dir).select("entity_id", c("p_name").alias("business_name"))
    greek = F.translate(F.lower("p_name"), "abcdefghijklmnopqrstuvwxyz", "αβγδεζηθικλμνξοπρστυφχψωϊϋ")
    records = fixtures.p_s1(spark, sf_dir).select(F.concat(F.lit("S2-"), c("k").cast("string")).alias("entity_id"), greek.alias("business_name"))
    return s1, records


@query
def translit_learn(spark, sf_dir):
    s1, records = script_fixture(spark, sf_dir)
    truth = records.select(F.replace("entity_id", F.lit("S2"), F.lit("S1")).alias("source1_entity_id"), c("entity_id").alias("other_id"))
    learnt = translit.learn(translit.script_pairs(s1, records, truth))
    return learnt.select("latin", "n", "total")


@query
def translit_aligned(spark, sf_dir):
    s1 = fixtures.p_s1(spark, sf_dir)
    return translit.aligned_words(s1.select(c("p_name").alias("script_name"), F.concat_ws(" ", "p_type", "p_type").alias("latin_name"))).groupBy("s", "l").agg(F.count("*").alias("n"))


# ---- blocking


def document_grams(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    s1, records = fixtures.documents_as_names(spark, sf_dir)
    return tuple(d.select(c("entity_id").alias("id"), "country", plain_clean(c("business_name")).alias("n")) for d in (s1, records))


def plain_clean(name):
    """As ``clean`` without decomposition, which SQL can't express alike."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^\\p{L}\\p{M}\\p{N}]+", " "))


@query
def grams(spark, sf_dir):
    s1, records = document_grams(spark, sf_dir)
    return blocking.gram_table(s1.unionByName(records), ["n"], "s").select("id", "gram", "tf")


@query
def gram_idf(spark, sf_dir):
    s1, records = document_grams(spark, sf_dir)
    every = s1.unionByName(records)
    idf = blocking.inverse_frequency(blocking.gram_table(every, ["n"], "s"), every.groupBy("country").agg(F.count("*").alias("n")))
    return idf.select("country", "gram", "df", F.round("idf", 9).alias("idf"))


@query
def gram_norms(spark, sf_dir):
    weighted = blocking.vectors(*document_grams(spark, sf_dir), ["n"])
    return weighted.groupBy("id").agg(F.count("*").alias("grams"), F.round(F.sum("w"), 6).alias("total"), F.round(F.max("w"), 6).alias("most"))


@query
def topk_shortlist(spark, sf_dir):
    s1, records = document_grams(spark, sf_dir)
    best = blocking.shortlist(s1, records, ["n"], k=3)
    return best.select(c("rec_id").cast("long").alias("rec_id"), c("cand_id").cast("long").alias("cand_id"), "rank", "score")


@query
def shortlist_flat(spark, sf_dir):
    return fixtures.p_short(spark, sf_dir).select("rec_id", "cand_id", "rank", F.round("score", 9).alias("score"))


@query
def shortlist_compact(spark, sf_dir):
    short = short_pairs(spark, sf_dir)
    deleted = fixtures.p_s1(spark, sf_dir).filter("k % 4 = 0").select(c("entity_id").alias("cand_id"))
    return blocking.compact(short, deleted, k=2).select("rec_id", "cand_id", "rank")


# ---- test-like training


@query
def twins(spark, sf_dir):
    s1 = fixtures.p_s1(spark, sf_dir).select("entity_id", "country", F.concat("p_name", F.lit(" "), "p_type").alias("business_name"), "business_address")
    return testlike.twins(translit.prepare(s1), cap=200).select("id", "id_b")


#: Cores of more businesses than this form no twins in the query; some do and some don't at every scale factor.
SMALL_CAP = 5


@query
def twins_small_cap(spark, sf_dir):
    s1 = fixtures.p_s1(spark, sf_dir).select("entity_id", "country", F.concat("p_name", F.lit(" "), "p_type").alias("business_name"), "business_address")
    return testlike.twins(translit.prepare(s1), cap=SMALL_CAP).select("id", "id_b")


@query
def deleted_random(spark, sf_dir):
    s1 = fixtures.p_s1(spark, sf_dir)
    twin = s1.filter("k % 7 = 0").select("country", c("entity_id").alias("id"), c("entity_id").alias("id_b"))
    counts = s1.groupBy("country").agg((F.floor(F.count("*") / 10)).cast("long").alias("n_random"))
    return testlike.random_deletions(s1, twin, counts)


@query
def deleted_twins(spark, sf_dir):
    s1 = fixtures.p_s1(spark, sf_dir).select("entity_id", "country", F.concat("p_name", F.lit(" "), "p_type").alias("business_name"), "business_address")
    return testlike.twin_deletions(testlike.twins(translit.prepare(s1)))


@query
def n_to_delete(spark, sf_dir):
    """The test set: the same businesses, and records of which some are there twice."""
    s1, other = fixtures.p_s1(spark, sf_dir), fixtures.p_ot(spark, sf_dir)
    return pipeline.delete_counts(s1, other, s1, other.unionByName(other.filter("entity_id like '%1'")))


@query
def splits(spark, sf_dir):
    return testlike.splits(fixtures.p_s1(spark, sf_dir)).select("entity_id", "is_val", "v_tune", "v_report")


@query
def leak_guard(spark, sf_dir):
    held_out = fixtures.p_s1(spark, sf_dir).filter("k % 5 = 1").select(c("entity_id").alias("cand_id"))
    return testlike.training_pairs(fixtures.p_short(spark, sf_dir), held_out).select("rec_id", "cand_id", "train")


@query
def labels(spark, sf_dir):
    owned = testlike.owners(fixtures.p_ot(spark, sf_dir), fixtures.p_truth(spark, sf_dir), fixtures.p_s1(spark, sf_dir))
    return testlike.labelled(fixtures.p_short(spark, sf_dir), owned).select("rec_id", "cand_id", "y")


@query
def true_match_count(spark, sf_dir):
    s1 = fixtures.p_s1(spark, sf_dir)
    return testlike.true_match_count(s1, testlike.owners(fixtures.p_ot(spark, sf_dir), fixtures.p_truth(spark, sf_dir), s1))


# ---- features


def rounded(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.select("rec_id", "cand_id", *[F.round(c(n).cast("double"), 5).alias(n) for n in names])


def with_numbers(spark, sf_dir) -> DataFrame:
    s1, records = prepared(spark, sf_dir)
    r = records.select(c("entity_id").alias("rec_id"), c("nums").alias("r_nums"), address_digest(c("business_address")).alias("r_ad"))
    b = s1.select(c("entity_id").alias("cand_id"), c("nums").alias("c_nums"), address_digest(c("business_address")).alias("c_ad"))
    return short_pairs(spark, sf_dir).join(r, "rec_id").join(b, "cand_id")


@query
def feat_rank_block(spark, sf_dir):
    return rounded(features.rank_block(short_pairs(spark, sf_dir)), ["score", "rank", "gap_top1", "margin12"])


@query
def feat_indegree(spark, sf_dir):
    rows = features.rank_block(short_pairs(spark, sf_dir))
    return rows.select("rec_id", "cand_id", "in_degree", "best_for_cand")


@query
def feat_numbers(spark, sf_dir):
    block = features.number_block(c("r_nums"), c("c_nums"))
    return rounded(with_numbers(spark, sf_dir).select("rec_id", "cand_id", *[v.alias(k) for k, v in block.items()]), list(block))


@query
def feat_house_number(spark, sf_dir):
    block = features.house_number_block()
    return rounded(with_numbers(spark, sf_dir).select("rec_id", "cand_id", *[v.alias(k) for k, v in block.items()]), list(block))


@query
def feat_crowd(spark, sf_dir):
    rows = with_numbers(spark, sf_dir).withColumns({"r_num": c("r_ad.primary_value"), "c_num": c("c_ad.primary_value")})
    return rounded(features.crowd_block(rows), ["grp_share_rec_num", "grp_share_biz_num", "grp_biz_is_majority", "grp_distinct_nums"])


@query
def feat_crowd_rank(spark, sf_dir):
    rows = with_numbers(spark, sf_dir).withColumns({"r_num": c("r_ad.primary_value"), "c_num": c("c_ad.primary_value")})
    return features.crowd_block(rows).select("rec_id", "cand_id", c("grp_rank").cast("long").alias("grp_rank"))


@query
def feat_freq(spark, sf_dir):
    s1, records = prepared(spark, sf_dir)
    rows = features.name_frequency(features.name_frequency(s1, s1, "n", "name"), s1, "core", "core_n")
    theirs = features.name_frequency(records, s1, "n", "name").select("entity_id", F.round(F.log1p("name"), 9).alias("freq_name"), F.lit(None).cast("double").alias("freq_core"))
    return rows.select("entity_id", F.round(F.log1p("name"), 9).alias("freq_name"), F.round(F.log1p("core_n"), 9).alias("freq_core")).unionByName(theirs)


@query
def feat_rarest_shared(spark, sf_dir):
    s1, records = prepared(spark, sf_dir)
    frequency = features.word_frequency(s1)
    r = features.with_word_frequency(records, frequency).select(c("entity_id").alias("rec_id"), c("w_df").alias("r_df"))
    b = features.with_word_frequency(s1, frequency).select(c("entity_id").alias("cand_id"), c("w_df").alias("c_df"))
    rows = short_pairs(spark, sf_dir).join(r, "rec_id").join(b, "cand_id")
    return rows.select("rec_id", "cand_id", F.round(features.rarest_shared(c("r_df"), c("c_df")), 9).alias("freq_rarest_shared"))


@query
def feat_shop_words(spark, sf_dir):
    s1, records = prepared(spark, sf_dir)
    return features.shop_words(s1, records).select("entity_id", "shop_words")


@query
def feat_legal(spark, sf_dir):
    s1, records = prepared(spark, sf_dir)
    r = records.select(c("entity_id").alias("rec_id"), text.legal_forms(c("n")).alias("r_forms"))
    b = s1.select(c("entity_id").alias("cand_id"), text.legal_forms(c("n")).alias("c_forms"))
    block = features.legal_block(c("r_forms"), c("c_forms"))
    rows = short_pairs(spark, sf_dir).join(r, "rec_id").join(b, "cand_id")
    return rounded(rows.select("rec_id", "cand_id", *[v.alias(k) for k, v in block.items()]), list(block))


@query
def feat_flags(spark, sf_dir):
    raw = c("business_name")
    return fixtures.p_ot(spark, sf_dir).select(
        "entity_id", c("entity_id").startswith("S3").alias("is_s3"), c("business_address").isNull().alias("addr_missing"),
        text.no_latin(raw).alias("name_no_latin"), F.char_length(raw).alias("name_len"),
    )


@query
def features_all(spark, sf_dir):
    s1, records = map(written, prepared(spark, sf_dir))
    pairs = short_pairs(spark, sf_dir).withColumns({"cos_n": c("score"), "cos_a": c("score")})
    return features.comparisons(pairs, s1, records)


# ---- similarities


def name_pairs(spark, sf_dir) -> DataFrame:
    s1, records = prepared(spark, sf_dir)
    r, b = records.select(c("entity_id").alias("rec_id"), c("n").alias("a")), s1.select(c("entity_id").alias("cand_id"), c("n").alias("b"))
    return short_pairs(spark, sf_dir).join(r, "rec_id").join(b, "cand_id").select("rec_id", "cand_id", "a", "b")


@query
def sim_levenshtein(spark, sf_dir):
    return name_pairs(spark, sf_dir).select("rec_id", "cand_id", F.levenshtein("a", "b").alias("distance"))


@query
def sim_jaro_winkler(spark, sf_dir):
    return name_pairs(spark, sf_dir).select("rec_id", "cand_id", F.round(similarity.jaro_winkler_of("a", "b"), 6).alias("similarity"))


@query
def sim_ratio(spark, sf_dir):
    return name_pairs(spark, sf_dir).select("rec_id", "cand_id", similarity.ratio_of("a", "b").alias("ratio"))


@query
def sim_token_set(spark, sf_dir):
    return name_pairs(spark, sf_dir).select("rec_id", "cand_id", similarity.token_set_ratio_of("a", "b").alias("ratio"))


@query
def sim_partial(spark, sf_dir):
    return name_pairs(spark, sf_dir).select("rec_id", "cand_id", similarity.partial_ratio_of("a", "b").alias("ratio"))


@query
def sim_common_prefix(spark, sf_dir):
    return name_pairs(spark, sf_dir).select("rec_id", "cand_id", similarity.common_prefix_of("a", "b").alias("letters"))


@query
def word_align(spark, sf_dir):
    return name_pairs(spark, sf_dir).select("rec_id", "cand_id", similarity.align_of("a", "b").alias("x")).select("rec_id", "cand_id", "x.*")


@query
def best_word_pair(spark, sf_dir):
    return name_pairs(spark, sf_dir).select("rec_id", "cand_id", similarity.best_differing_of("a", "b").alias("x")).select("rec_id", "cand_id", "x.*")


@query
def address_parse(spark, sf_dir):
    return fixtures.p_ot(spark, sf_dir).select("entity_id", address_digest(c("business_address")).alias("x")).select("entity_id", "x.*")


@query
def address_tokens(spark, sf_dir):
    from rowkin.functions.address import address_tokens as tokens

    return fixtures.p_ot(spark, sf_dir).select("entity_id", F.array_join(tokens(c("business_address")), "|").alias("tokens"))


# ---- decision


def scored(spark, sf_dir) -> DataFrame:
    return fixtures.l_pairs(spark, sf_dir).withColumn("country", F.lit("XX"))


def businesses(spark, sf_dir) -> DataFrame:
    pairs = fixtures.l_pairs(spark, sf_dir)
    k = pairs.filter("y").groupBy("cand").agg(F.count("*").alias("k"))
    rows = fixtures.table(spark, sf_dir, "supplier").select(c("s_suppkey").alias("cand"))
    return rows.join(k, "cand", "left").na.fill(0, ["k"]).withColumn("country", F.lit("XX"))


def rule(spark, **values) -> DataFrame:
    return spark.createDataFrame([("XX", *values.values())], "country string, " + ", ".join(f"{n} double" for n in values))


@query
def decide(spark, sf_dir):
    return decision.decide(scored(spark, sf_dir), 0.5).select("rec", "cand", "prob")


@query
def best_top(spark, sf_dir):
    return decision.best_top(scored(spark, sf_dir)).select("rec", "cand", "best", F.when(c("top") > 0, c("top")).otherwise(-1.0).alias("top"))


@query
def drawbridge(spark, sf_dir):
    return decision.drawbridge(scored(spark, sf_dir), rule(spark, floor=0.9, factor=0.9)).select("rec", "cand")


@query
def macro_f05(spark, sf_dir):
    kept = decision.drawbridge(scored(spark, sf_dir), rule(spark, floor=0.9, factor=0.9))
    return decision.macro_f05(kept, businesses(spark, sf_dir)).select(*[F.round(x, 9).alias(x) for x in ("f05", "f05_none", "f05_some")])


@query
def accepted_per_s1(spark, sf_dir):
    kept = decision.drawbridge(scored(spark, sf_dir), rule(spark, floor=0.9, factor=0.9))
    return decision.accepted_per_business(kept, businesses(spark, sf_dir)).select(F.round("accepted", 9).alias("accepted"))


@query
def floor_curve(spark, sf_dir):
    return decision.floor_curve(scored(spark, sf_dir), businesses(spark, sf_dir)).select("floor", "factor", "f05")


@query
def tune_drawbridge(spark, sf_dir):
    return decision.tune_drawbridge(scored(spark, sf_dir), businesses(spark, sf_dir)).select("floor", "factor", "f05")


@query
def bar_curve(spark, sf_dir):
    return decision.bar_curve(scored(spark, sf_dir), businesses(spark, sf_dir), rule(spark, floor=0.3, factor=0.5)).select("bar", "f05")


@query
def safe_range(spark, sf_dir):
    bars = decision.bar_curve(scored(spark, sf_dir), businesses(spark, sf_dir), rule(spark, floor=0.3, factor=0.5))
    return decision.safe_range(bars, "bar", tolerance=0.01).select("safe_lo", "safe_hi")


@query
def count_bar(spark, sf_dir):
    return decision.count_bar(scored(spark, sf_dir), rule(spark, floor=0.3, factor=0.5, target=20.0), businesses(spark, sf_dir)).select("bar")


@query
def count_floor(spark, sf_dir):
    return decision.count_floor(scored(spark, sf_dir), rule(spark, factor=0.9, target=3.0), businesses(spark, sf_dir)).select("floor")


def nation_rules(spark, sf_dir) -> DataFrame:
    """A made-up rule for each nation."""
    return fixtures.table(spark, sf_dir, "nation").select(
        c("n_name").alias("country"), (c("n_nationkey") / 100.0).alias("floor"), (c("n_nationkey") / 50.0).alias("factor"),
        (c("n_nationkey") * 1.0).alias("target"), (c("n_nationkey") / 40.0).alias("safe_lo"), (c("n_nationkey") / 30.0).alias("safe_hi"),
    )


RULE = ("floor", "factor", "target", "safe_lo", "safe_hi")


@query
def pooled_rule(spark, sf_dir):
    return decision.pooled_rule(nation_rules(spark, sf_dir)).select(*[F.round(x, 9).alias(x) for x in RULE])


@query
def rule_for(spark, sf_dir):
    """Every other nation by name length has a rule of its own; the rest get the pooled one."""
    rules = nation_rules(spark, sf_dir)
    return decision.rule_for(rules, rules.filter(F.length("country") % 2 == 0)).select("country", *[F.round(x, 9).alias(x) for x in RULE])


@query
def tune_rule(spark, sf_dir):
    """Tuned on businesses of even numbers, reported on the others."""
    rows = businesses(spark, sf_dir)
    found = decision.tune_rule(scored(spark, sf_dir), rows.filter("cand % 2 = 0"), rows.filter("cand % 2 = 1"))
    return found.select(*[F.round(x, 9).alias(x) for x in ("floor", "factor", "bar", "safe_lo", "safe_hi", "target", "report")])


@query
def decide_test(spark, sf_dir):
    rules = rule(spark, floor=0.3, factor=0.5, target=20.0, safe_lo=0.4, safe_hi=0.9)
    return decision.decide_test(scored(spark, sf_dir), rules, businesses(spark, sf_dir)).select("rec", "cand")


@query
def band_blend(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("second", F.when(c("rec") % 2 == 0, 1 - c("prob")))
    return decision.blend(rows, "prob", "second", "blended").select("rec", "cand", F.round("blended", 9).alias("blended"))


@query
def trim_statistics(spark, sf_dir):
    found = decision.trim_statistics(scored(spark, sf_dir), businesses(spark, sf_dir))
    return found.select(*[F.round(x, 9).alias(x) for x in ("pairs_per_business", "recall")])


# ---- models


def model_rows(spark, sf_dir) -> DataFrame:
    """Labelled pairs with the columns of the first model, from the made-up shortlist."""
    owned = testlike.owners(fixtures.p_ot(spark, sf_dir), fixtures.p_truth(spark, sf_dir), fixtures.p_s1(spark, sf_dir))
    rows = testlike.labelled(features.rank_block(short_pairs(spark, sf_dir)), owned)
    held_out = fixtures.p_s1(spark, sf_dir).filter("k % 13 = 1").select(c("entity_id").alias("cand_id"))
    rows = rows.withColumns({"cos_name": c("score") * 0.9, "cos_addr": 1 - c("score")})
    return testlike.training_pairs(rows, held_out)


@query
def model_cheap_trim(spark, sf_dir):
    from rowkin.plans import models

    return models.trimmed(model_rows(spark, sf_dir)).select("rec_id", "cand_id", "train", "cheap", "keep")


@query
def model_trees(spark, sf_dir):
    from rowkin.plans import models

    rows = model_rows(spark, sf_dir)
    model = models.fit(models.trees(models.CHEAP, 5, 0.1, 4, 5), rows.filter("train"))
    return models.probability(model, rows.select("rec_id", "cand_id", "train", *models.CHEAP), "prob").select("rec_id", "cand_id", "train", "prob")


@query
def model_text_scorer(spark, sf_dir):
    from rowkin.plans import models, pipeline

    s1, records = (d.withColumn("country", F.lit("XX")) for d in (fixtures.p_s1(spark, sf_dir), fixtures.p_ot(spark, sf_dir)))
    rows = pipeline.pair_texts(model_rows(spark, sf_dir).select("country", "rec_id", "cand_id", "y", "train"), s1, records)
    return models.text_scorer()(rows.filter("train"))(rows, "second").select("rec_id", "cand_id", "second")


@query
def model_stacker(spark, sf_dir):
    from rowkin.plans import models

    rows = scored(spark, sf_dir).select("rec", "cand", "y", c("prob").alias("tree"), (c("prob") * 4 - 2).alias("second"))
    inside = rows.filter(models.unsure(c("tree")))
    return models.stacked(models.stacker(inside), rows).select("rec", "cand", "prob")


@query
def pipeline_search(spark, sf_dir):
    """Shortlist and all comparison columns of the part fixture, as the pipeline makes them."""
    from rowkin.plans import pipeline

    s1, records = map(blocking.staged, prepared(spark, sf_dir))
    return features.comparisons(blocking.staged(pipeline.shortlist(s1, records, 3)), s1, records)
