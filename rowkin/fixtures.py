"""Business-like views over the driver's tables, in SQL that Spark and DuckDB both run.

``part`` gives Source 1 and, in noised copies and decoys, Source 2 and 3 with known owners; ``lineitem`` gives scored pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

P_S1 = """
    select concat('S1-', cast(p_partkey as varchar(20))) as entity_id,
           concat(p_name, ' ', p_type, case p_size % 4 when 0 then ' LLC' when 1 then ' Pvt Ltd' when 2 then ' Inc' else '' end) as business_name,
           concat(cast(p_size as varchar(20)), ' ', p_brand, ' Street') as business_address,
           case when p_partkey % 3 = 0 then 'IN' else 'US' end as country,
           p_partkey as k, p_size, p_brand, p_name, p_type
    from {part}
"""
P_OT = """
    select concat('S2-', cast(k as varchar(20))) as entity_id, upper(business_name) as business_name,
           case when k % 13 = 0 then null else concat('0', business_address) end as business_address, country, k as owner_k
    from {p_s1} where k % 5 <> 0
    union all
    select concat('S3-', cast(k as varchar(20))), concat(p_type, ' ', p_name, ' www.', replace(p_name, ' ', ''), '.com'),
           concat(cast(p_size + (case when k % 7 = 0 then 1 else 0 end) as varchar(20)), ' ', p_brand, ' St'), country, k
    from {p_s1} where k % 3 <> 1
    union all
    select concat('S3-D', cast(k as varchar(20))), concat(p_name, ' shop'),
           concat(cast(p_size + 40 as varchar(20)), ' ', p_brand, ' Road'), country, null
    from {p_s1} where k % 11 = 0
"""
L_PAIRS = """
    select rec, cand, rnk, prob, case when cand = min(case when h % 3 = 0 then cand end) over (partition by rec) then true else false end as y
    from (select l_orderkey as rec, l_suppkey as cand, row_number() over (partition by l_orderkey order by l_suppkey) - 1 as rnk,
                 cast((l_suppkey * 7919 + l_orderkey * 104729) % 1000 as double) / 1000 as prob, (l_suppkey + l_orderkey) as h
          from (select distinct l_orderkey, l_suppkey from {lineitem}) t) u
"""
#: True matches: the owner of every copy that has one.
P_TRUTH = "select concat('S1-', cast(owner_k as varchar(20))) as source1_entity_id, entity_id as other_id from {p_ot} where owner_k is not null"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p_s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(P_S1, part=table(spark, sf_dir, "part"))


def p_ot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(P_OT, p_s1=p_s1(spark, sf_dir))


def p_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(P_TRUTH, p_ot=p_ot(spark, sf_dir))


def l_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(L_PAIRS, lineitem=table(spark, sf_dir, "lineitem"))


def duckdb_views() -> str:
    """The same views as common table expressions for DuckDB."""
    one = P_S1.format(part="part")
    return f"p_s1 as ({one}), p_ot as ({P_OT.format(p_s1='p_s1')}), p_truth as ({P_TRUTH.format(p_ot='p_ot')}), l_pairs as ({L_PAIRS.format(lineitem='lineitem')})"


#: A shortlist with made-up scores: three candidates at most for each record, drawn from the number in its id.
P_SHORT = """
    select rec_id, cand_id, cast(row_number() over (partition by rec_id order by score desc, cand_id) - 1 as int) as rank, score
    from (select rec_id, cand_id, max(score) as score from (
            select o.entity_id as rec_id, s.entity_id as cand_id,
                   cast(900 - 100 * m.j - (s.k * 31 + o.num * 17) % 97 as double) / 1000 as score
            from (select entity_id, cast(regexp_extract(entity_id, '[0-9]+$', 0) as int) as num from {p_ot}) o
            cross join (select 0 as j union all select 1 union all select 2) m
            cross join (select count(*) as n from {p_s1}) c
            join {p_s1} s on s.k = (case m.j when 0 then o.num when 1 then (o.num * 7) % c.n + 1 else (o.num - o.num % 5) % c.n + 1 end)
          ) u group by rec_id, cand_id) v
"""


def p_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(P_SHORT, p_s1=p_s1(spark, sf_dir), p_ot=p_ot(spark, sf_dir))


def documents_as_names(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(Source 1, records): documents named by their whole text, one country per language."""
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id as entity_id", "lang as country", "text as business_name")
    return docs.filter("entity_id % 4 = 0"), docs.filter("entity_id % 4 <> 0")
