"""The queries of this subpackage: thin callers with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowkin.llm import bpe, extraction, fingerprint, language_model, ngram_join, packing, quality, substring_dedup, topk, warc
from rowkin.llm._io import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), k=3, over=90, under=100)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, index = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(folder, index)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(table(spark, sf_dir, "documents"), window=50)


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0", k=10)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = language_model.score(table(spark, sf_dir, "documents"))
    return scores.withColumn("log_score", F.round("log_score", 6))


def op7_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_warc": op2_warc,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_topk": op4_topk,
    "op5_quality": op5_quality,
    "op6_language_model": op6_language_model,
    "op7_extraction": op7_extraction,
    "op8_packing": op8_packing,
    "op9_fingerprint": op9_fingerprint,
    "op10_bpe": op10_bpe,
}

#: Words of documents as lists, A-Z in lower case.
LOWER_WORDS = """
    select doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'
    ) as w from {docs}
"""


def near_duplicates_sql(docs: str, k: int, over: int, under: int) -> str:
    """Common table expressions that end in ``component (doc_id, n_shingles, component_id)``."""
    return f"""
        words as ({LOWER_WORDS.format(docs=docs)}),
        grams as (
            select doc_id, unnest(case
                when len(w) >= {k} then list_distinct(list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k - 1}], ' ')))
                when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g
            from words
        ),
        sizes as (select doc_id, count(*) as n from grams group by doc_id),
        common as (
            select a.doc_id as a, b.doc_id as b, count(*) as c
            from grams a join grams b on a.g = b.g and a.doc_id <> b.doc_id group by all
        ),
        links as (
            select c.a, c.b from common c join sizes x on x.doc_id = c.a join sizes y on y.doc_id = c.b
            where {under} * c.c >= {over} * (x.n + y.n - c.c)
        ),
        reach(doc_id, other) as (
            select doc_id, doc_id from words union select r.doc_id, l.b from reach r join links l on l.a = r.other
        ),
        component as (
            select r.doc_id, coalesce(any_value(s.n), 0) as n_shingles, min(r.other) as component_id
            from reach r left join sizes s on s.doc_id = r.doc_id group by r.doc_id
        )
    """


ORACLE_SQL: dict[str, str] = {
    "op1_ngram_join": f"with recursive {near_duplicates_sql('documents', 3, 90, 100)} select * from component",
    "op2_warc": """
        with p as (
            select page_id, encode(coalesce(html, '')) as payload from pages
        ), d as (
            select page_id, octet_length(payload) as payload_bytes, sha256(payload) as payload_digest from p
        ), f as (
            select *, min(page_id) over (partition by payload_digest) as first_id from d
        )
        select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
               case when payload_bytes >= 100 and first_id <> page_id then 'revisit' else 'response' end as record_type,
               case when payload_bytes >= 100 and first_id <> page_id then first_id end as refers_to
        from f
    """,
    "op3_substring_dedup": """
        with words as (
            select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents
        ), windows as (
            select doc_id, unnest(range(1, len(w) - 48)) as i, w from words where len(w) >= 50
        ), hashed as (
            select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as h from windows
        ), firsts as (
            select *, min(doc_id) over (partition by h) as least from hashed
        ), covered as (
            select distinct doc_id, unnest(range(i, i + 50)) as p from firsts where doc_id > least
        ), places as (
            select doc_id, unnest(range(1, len(w) + 1)) as p, unnest(w) as word from words
        ), kept as (
            select p.doc_id, string_agg(p.word, ' ' order by p.p) as text, count(*) as n
            from places p anti join covered c on c.doc_id = p.doc_id and c.p = p.p group by p.doc_id
        )
        select w.doc_id, len(w.w) as n_words, len(w.w) - coalesce(k.n, 0) as n_removed, sha256(coalesce(k.text, '')) as kept_sha256
        from words w left join kept k on k.doc_id = w.doc_id
    """,
    "op4_topk": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as double)) as e
            from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), s as (
            select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.e, c.e) as bigint) as score
            from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id
        ), r as (
            select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s
        )
        select query_id, rank, vec_id, score from r where rank <= 10
    """,
    "op6_language_model": f"""
        with words as ({LOWER_WORDS.format(docs="documents")}),
        tokens as (select doc_id, unnest(range(1, len(w) + 1)) as i, unnest(w) as w2, unnest(list_prepend(null, w[:-2])) as w1 from words),
        uni as (select w2 as w, count(*) as n from tokens group by w2),
        bi as (select w1, w2, count(*) as n from tokens where w1 is not null group by w1, w2),
        own_uni as (select doc_id, w2 as w, count(*) as n from tokens group by doc_id, w2),
        own_bi as (select doc_id, w1, w2, count(*) as n from tokens where w1 is not null group by doc_id, w1, w2),
        total as (select count(*) as n from tokens),
        sizes as (select doc_id, len(w) as n from words),
        seen as (
            select t.doc_id, t.i, u2.n - o2.n as c2, u1.n - o1.n as c1, coalesce(b.n - ob.n, 0) as c12,
                   greatest(total.n - s.n, 1) as elsewhere
            from tokens t join uni u2 on u2.w = t.w2 join own_uni o2 on o2.doc_id = t.doc_id and o2.w = t.w2
            left join uni u1 on u1.w = t.w1 left join own_uni o1 on o1.doc_id = t.doc_id and o1.w = t.w1
            left join bi b on b.w1 = t.w1 and b.w2 = t.w2
            left join own_bi ob on ob.doc_id = t.doc_id and ob.w1 = t.w1 and ob.w2 = t.w2
            join sizes s on s.doc_id = t.doc_id cross join total
        ),
        scored as (
            select doc_id, sum(case when c12 > 0 then ln(c12 / c1) else ln(greatest(c2, 1) / elsewhere) + (case when i > 1 then ln(0.4) else 0 end) end) as s,
                   count(*) filter (where c12 = 0 and i > 1) as n_backoff, count(*) filter (where c2 < 1) as n_unseen
            from seen group by doc_id
        )
        select z.doc_id, cast(z.n as bigint) as n_words, round(s.s / z.n, 6) as log_score,
               coalesce(n_backoff, 0) as n_backoff, coalesce(n_unseen, 0) as n_unseen
        from sizes z left join scored s on s.doc_id = z.doc_id
    """,
}
