"""SQL for DuckDB that gives the rows of the registered queries, where SQL can express them."""

from __future__ import annotations

from rowkin import fixtures
from rowkin.functions.text import HONORIFICS, LEGAL, LEGAL_FORM
from rowkin.plans.decision import BARS, FACTORS, FLOORS

VIEWS = fixtures.duckdb_views()
SHORT = f"p_short as ({fixtures.P_SHORT.format(p_s1='p_s1', p_ot='p_ot')})"


def listed(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def clean(x: str) -> str:
    return f"trim(regexp_replace(strip_accents(lower(coalesce({x}, ''))), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', ' ', 'g'))"


def plain(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', ' ', 'g'))"


def words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def numbers(x: str) -> str:
    return f"list_transform(regexp_extract_all(coalesce({x}, ''), '[0-9]+'), lambda v: coalesce(nullif(ltrim(v, '0'), ''), '0'))"


def core(x: str) -> str:
    return f"array_to_string(list_sort(list_filter({words(x)}, lambda w: not list_contains({listed(LEGAL)}, w))), ' ')"


def street(x: str) -> str:
    return f"array_to_string(list_sort({words(f"regexp_replace({x}, '^([^0-9]*)[0-9]+', '\\1 ')")}), ' ')"


def forms(x: str) -> str:
    cases = " ".join(f"when '{k}' then '{v}'" for k, v in LEGAL_FORM.items())
    split = f"string_split(replace(replace({x}, 'l l c', 'llc'), 'l l p', 'llp'), ' ')"
    return f"list_sort(list_distinct(list_filter(list_transform({split}, lambda w: case w {cases} end), lambda f: f is not null)))"


def uniform(x: str, seed: int) -> str:
    return f"(cast(('0x' || substr(md5({x} || '|{seed}'), 1, 8)) as bigint) / 4294967296.0)"


def grid(name: str, values) -> str:
    return f"(select unnest([{', '.join(f'cast({v} as double)' for v in values)}]) as {name})"


PREPARED = f"""
    s1 as (select entity_id, business_name, business_address, {clean('business_name')} as n, {clean('business_address')} as a, {numbers('business_address')} as nums from p_s1),
    ot as (select entity_id, business_name, business_address, {clean('business_name')} as n, {clean('business_address')} as a, {numbers('business_address')} as nums from p_ot)
"""
# in the part fixture an address is a house number, a brand and a word; the brand's number follows a #
DIGESTS = """
    rd as (select entity_id, nums[1] as pv, nums[2:] as unit, nums as every from ot),
    cd as (select entity_id, nums[1] as pv, nums[2:] as unit, nums as every from s1)
"""
SHORTED = f"with {VIEWS}, {SHORT}, {PREPARED}, {DIGESTS}"
GRAMS = f"""
    docs as (select doc_id as id, lang as country, {plain('text')} as n from documents),
    windows as (
        select id, country, unnest(flatten(list_transform({words('n')}, lambda w: list_transform(range(1, length(w) + 1), lambda i: substr(' ' || w || ' ', i, 3))))) as gram
        from docs
    ),
    tf as (select id, country, gram, count(*) as tf from windows group by all)
"""
WEIGHTS = f"""
    {GRAMS}, total as (select country, count(*) as n from docs group by country),
    idf as (
        select t.country, gram, count(*) as df, ln((1 + any_value(total.n)) / (1 + count(*))) + 1 as idf
        from tf t join total on total.country = t.country group by t.country, gram having count(*) >= 2
    ),
    w as (select tf.id, tf.country, tf.gram, tf * idf as w from tf join idf on idf.country = tf.country and idf.gram = tf.gram),
    unit as (select id, country, gram, w / sqrt(sum(w * w) over (partition by id)) as w from w)
"""
DECISION = f"""
    with {VIEWS},
    ranked as (select *, row_number() over (partition by rec order by prob desc, rnk) = 1 as best from l_pairs),
    topped as (select *, max(case when best then prob end) over (partition by cand) as top from ranked),
    biz as (select s_suppkey as cand, coalesce(k, 0) as k from supplier left join (select cand, count(*) as k from l_pairs where y group by cand) on cand = s_suppkey)
"""


def kept(floor: str, factor: str) -> str:
    return f"select * from topped where best and top >= {floor} and prob >= {factor} * top"


def f05(rows: str, names: str, grids: str) -> str:
    """Macro F0.5 per grid point of ``rows`` (grid values, cand, y)."""
    on = " and ".join(f"c.{n.strip()} = g.{n.strip()}" for n in names.split(",")) if names else "true"
    selected = ", ".join(f"g.{n.strip()}" for n in names.split(","))
    return f"""
        select {selected}, round(avg(case when b.k = 0 and coalesce(c.fp, 0) = 0 then 1.0
                 else 1.25 * coalesce(c.tp, 0) / (1.25 * coalesce(c.tp, 0) + 0.25 * (b.k - coalesce(c.tp, 0)) + coalesce(c.fp, 0)) end), 9) as f05
        from biz b cross join {grids} g
        left join (select {names}, cand, count(*) filter (where y) as tp, count(*) filter (where not y) as fp from ({rows}) group by all) c
             on c.cand = b.cand and {on}
        group by {selected}
    """


FLOOR_ROWS = f"select f.floor, a.factor, t.cand, t.y from topped t cross join {grid('floor', FLOORS)} f cross join {grid('factor', FACTORS)} a where t.best and t.top >= f.floor and t.prob >= a.factor * t.top"
FLOOR_GRID = f"(select * from {grid('floor', FLOORS)} cross join {grid('factor', FACTORS)})"
FLOOR_CURVE = f05(FLOOR_ROWS, "floor, factor", FLOOR_GRID)
BAR_CURVE = f05(f"select g.bar, t.cand, t.y from topped t cross join {grid('bar', BARS)} g where t.best and t.top >= 0.3 and t.prob >= 0.5 * t.top and t.prob >= g.bar", "bar", grid("bar", BARS))


def flag(condition: str) -> str:
    return f"cast({condition} as double)"


def where(applies: str, value: str) -> str:
    return f"case when {applies} then cast({value} as double) else -1.0 end"


BOTH, MOVED = "(r.pv is not null and c.pv is not null)", "(r.pv <> c.pv)"
GAP = "abs(cast(substr(r.pv, 1, 9) as int) - cast(substr(c.pv, 1, 9) as int))"
UNITS = "(coalesce(len(r.unit), 0) > 0 and coalesce(len(c.unit), 0) > 0)"
HOUSE = {
    "hn_equal": where(BOTH, "r.pv = c.pv"),
    "hn_rec_missing": flag("r.pv is null and c.pv is not null"),
    "hn_cand_missing": flag("c.pv is null and r.pv is not null"),
    "hn_suffix_only": where(BOTH, "false"),
    "hn_one_digit": where(BOTH, f"{MOVED} and levenshtein(r.pv, c.pv) = 1"),
    "hn_transposed": where(BOTH, f"{MOVED} and length(r.pv) > 1 and list_sort(string_split(r.pv, '')) = list_sort(string_split(c.pv, ''))"),
    "hn_gap": where(BOTH, GAP),
    "hn_log_gap": where(BOTH, f"ln(1 + {GAP})"),
    "sec_agree": where(UNITS, "list_has_any(r.unit, c.unit)"),
    "sec_one_side": flag("(coalesce(len(r.unit), 0) > 0) <> (coalesce(len(c.unit), 0) > 0)"),
    "num_conflicts": f"cast(coalesce({BOTH} and {MOVED}, false) as int) + cast({UNITS} and not list_has_any(r.unit, c.unit) as int)",
    "hn_gap_20": where(BOTH, f"{MOVED} and {GAP} <= 20"),
    "hn_digit_indel": where(BOTH, f"{MOVED} and abs(length(r.pv) - length(c.pv)) = 1 and levenshtein(r.pv, c.pv) = 1"),
    "hn_digit_sub": where(BOTH, f"{MOVED} and length(r.pv) = length(c.pv) and levenshtein(r.pv, c.pv) = 1"),
    "hn_biz_in_rec": where(BOTH, f"{MOVED} and list_contains(r.every, c.pv)"),
    "hn_rec_in_biz": where(BOTH, f"{MOVED} and list_contains(c.every, r.pv)"),
}
PAIRED = "p_short p join rd r on r.entity_id = p.rec_id join cd c on c.entity_id = p.cand_id"
NUMS = "p_short p join ot r on r.entity_id = p.rec_id join s1 c on c.entity_id = p.cand_id"


def rounded(values: dict[str, str]) -> str:
    return ", ".join(f"round(cast({v} as double), 5) as {k}" for k, v in values.items())


SHARED, UNION = "len(list_intersect(r.nums, c.nums))", "len(list_distinct(list_concat(r.nums, c.nums)))"
NUMBERS = {
    "num_shared": SHARED,
    "num_jaccard": where(f"{UNION} > 0", f"{SHARED} / {UNION}"),
    "num_first_equal": where("len(r.nums) > 0 and len(c.nums) > 0", "r.nums[1] = c.nums[1]"),
    "num_rec_none": flag("len(r.nums) = 0"),
    "num_rec_subset": where("len(r.nums) > 0", f"{SHARED} = len(list_distinct(r.nums))"),
}
LEGAL_ROWS = {
    "legal_conflict": where("len(rf) > 0 and len(cf) > 0", "not list_has_any(rf, cf)"),
    "private_public": flag(
        "(list_contains(rf, 'private') and list_contains(cf, 'public') and not list_contains(cf, 'private'))"
        " or (list_contains(cf, 'private') and list_contains(rf, 'public') and not list_contains(rf, 'private'))"
    ),
    "legal_same": where("len(rf) > 0 and len(cf) > 0", "rf = cf"),
    "legal_one_side": flag("(len(rf) > 0) <> (len(cf) > 0)"),
}
CROWD = f"""
    {SHORTED},
    pairs as (select p.*, r.pv as rv, c.pv as cv from {PAIRED}),
    crowd as (select * from pairs where rank = 0),
    hits as (select cand_id, rv, count(*) as n from crowd where rv is not null group by all),
    sums as (select cand_id, count(*) as n from crowd group by cand_id),
    modes as (select cand_id, count(*) as d, max(n) as m from hits group by cand_id),
    x as (
        select p.*, coalesce(s.n, 0) - cast(p.rank = 0 as int) as others, coalesce(m.d, 0) as d, coalesce(m.m, 0) as m,
               coalesce(hr.n, 0) - cast(p.rank = 0 as int) as g_rec,
               coalesce(hb.n, 0) as g_biz, cast(coalesce(p.rank = 0 and p.rv = p.cv, false) as int) as own
        from pairs p left join sums s on s.cand_id = p.cand_id left join modes m on m.cand_id = p.cand_id
        left join hits hr on hr.cand_id = p.cand_id and hr.rv = p.rv left join hits hb on hb.cand_id = p.cand_id and hb.rv = p.cv
    )
"""
SCRIPT = "translate(lower(p_name), 'abcdefghijklmnopqrstuvwxyz', 'αβγδεζηθικλμνξοπρστυφχψωϊϋ')"
ALIGNED = """
    aligned as (
        select unnest(s) as s, unnest(l) as l from (select string_split({s}, ' ') as s, string_split({l}, ' ') as l from p_s1) where len(s) = len(l)
    )
"""
TWINS = f"""
    with {VIEWS}, t as (
        select entity_id as id, country, {{name}} as core, {street(clean('business_address'))} as street, ({numbers('business_address')})[1] as num from p_s1
    ), z as (select country, core from t where core <> '' group by all having count(*) between 2 and {{cap}})
    select a.id, b.id as id_b from t a join t b on a.country = b.country and a.core = b.core and a.street = b.street and a.id < b.id and a.num <> b.num
    join z on z.country = a.country and z.core = a.core where a.street <> ''
"""

ORACLES: dict[str, str] = {
    "text_clean": f"select doc_id, {clean('text')} as clean from documents",
    "text_numbers": f"with {VIEWS} select entity_id, array_to_string({numbers('business_address')}, ',') as nums from p_ot",
    "text_core": f"with {VIEWS} select entity_id, {core(clean('business_name'))} as core from p_s1",
    "text_pair_text": f"with {VIEWS} select entity_id, concat(coalesce(business_name, ''), ' | ', coalesce(business_address, '')) as pair_text from p_ot",
    "text_street_twin": f"with {VIEWS} select entity_id, {street(clean('business_address'))} as street from p_ot",
    "text_street_family": f"with {VIEWS} select entity_id, regexp_replace(regexp_replace({clean('business_address')}, '[0-9]+', ' ', 'g'), '\\s+', ' ', 'g') as street from p_ot",
    "text_unpadded": f"with {VIEWS} select entity_id, regexp_replace({clean('business_address')}, '\\b0+([0-9])', '\\1', 'g') as address from p_ot",
    "text_glued": f"with {VIEWS} select entity_id, replace({clean('business_name')}, ' ', '') as glued from p_s1",
    "text_words": f"with {VIEWS} select entity_id, cast(len({words(clean('business_name'))}) as bigint) as n_words from p_ot",
    "flag_web": "select page_id, regexp_matches(lower(coalesce(url, '')), 'www\\.|\\.(com|in|net|org|co|fr)\\b') as web from pages",
    "flag_dba": f"with {VIEWS} select entity_id, true as dba, regexp_matches(lower(business_name), '\\bd\\s*\\.?\\s*b\\s*\\.?\\s*a\\b|\\ba\\s*\\.?\\s*k\\s*\\.?\\s*a\\b|trading as|\\bt/a\\b') as plain from p_ot",
    "flag_script": "select doc_id, regexp_matches(concat(coalesce(text, ''), case when doc_id % 3 = 0 then ' दुकान' else '' end), '[\\x{0900}-\\x{0DFF}]') as script from documents",
    "flag_no_latin": "select doc_id, not regexp_matches(coalesce(text, ''), '[A-Za-z]') as no_latin from documents",
    "flag_honorific": f"with {VIEWS} select entity_id, true as yes, list_has_any(string_split({clean('business_name')}, ' '), {listed(HONORIFICS)}) as no from p_ot",
    "web_label": "select page_id, regexp_extract(lower(coalesce(url, '')), '([a-z0-9][a-z0-9-]{2,})\\.(com|in|net|org|co|fr)\\b', 1) as label from pages",
    "legal_forms": f"with {VIEWS} select entity_id, array_to_string({forms(clean('business_name'))}, ',') as forms from p_s1",
    "logit_sigmoid": f"with {VIEWS}, l as (select rec, cand, ln(least(greatest(prob, 1e-7), 1 - 1e-7) / (1 - least(greatest(prob, 1e-7), 1 - 1e-7))) as x from l_pairs) select rec, cand, round(x, 9) as logit, round(1 / (1 + exp(-x)), 9) as p from l",
    "lead_numbers": f"with {VIEWS} select entity_id, cast(substr(({numbers("coalesce(business_address, '0')")})[1], 1, 9) as int) as lead from p_ot",
    "truth_flatten": f"with {VIEWS} select source1_entity_id, other_id from p_truth",
    "owner_rows": f"with {VIEWS} select o.entity_id as rec_id, s.entity_id as owner from p_ot o left join (select entity_id, k from p_s1 where k % 4 <> 0) s on s.k = o.owner_k",
    "fold_semi": f"with {VIEWS} select entity_id, country from p_s1 where {uniform('entity_id', 0)} >= 0.2",
    "pool_anti": f"with {VIEWS}, q as (select country, concat(coalesce(business_name, ''), ' | ', coalesce(business_address, '')) as a from p_ot) select country, a from q where length(a) % 3 <> 0",
    "output_lists": f"with {VIEWS} select s.entity_id, coalesce(string_agg(t.other_id, ',' order by t.other_id), '') as matched_entity_ids from p_s1 s left join p_truth t on t.source1_entity_id = s.entity_id group by s.entity_id",
    "output_checks": f"""
        with {VIEWS}, once as (select * from p_truth where other_id not like 'S3-%7'),
        c as (select * from once union all select * from once where other_id like 'S2-%1')
        select 'match_outside_candidates' as check, count(*) as faults from p_truth t where not exists (select 1 from c where c.other_id = t.other_id and c.source1_entity_id = t.source1_entity_id)
        union all select 'repeated_match', 0 union all select 'repeated_candidate', count(*) from once where other_id like 'S2-%1'
        union all select 'bad_other_id', count(*) from c where not regexp_matches(other_id, '^S[23]-')
        union all select 'unknown_source1_id', count(*) from c where source1_entity_id not in (select entity_id from p_s1 where k % 10 <> 0)
    """,
    "output_digest": f"""
        with {VIEWS}, l as (select s.entity_id, coalesce(string_agg(t.other_id, ',' order by t.other_id), '') as ids, count(t.other_id) as n
            from p_s1 s left join p_truth t on t.source1_entity_id = s.entity_id group by s.entity_id),
        h as (select n, sha256(concat(entity_id, chr(9), ids)) as x from l)
        select count(*) as rows, count(*) filter (where n > 0) as filled, cast(sum(n) as bigint) as ids,
            sha256(concat_ws('-', {", ".join(f"cast(sum(cast(('0x' || substr(x, {1 + 12 * i}, 12)) as bigint)) as varchar)" for i in range(5))})) as sha256 from h
    """,
    "output_positions": f"with {VIEWS} select entity_id, row_number() over (order by entity_id) - 1 as position from p_s1",
    "country_sizes": f"with {VIEWS} select country, count(*) as n from p_s1 group by country",
    "translit_learn": f"""
        with {VIEWS}, {ALIGNED.replace('{s}', SCRIPT).replace('{l}', 'lower(p_name)')}, n as (select s, l, count(*) as n from aligned group by all),
        r as (select *, sum(n) over (partition by s) as total, row_number() over (partition by s order by n desc, l) as nth from n)
        select l as latin, n, cast(total as bigint) as total from r where nth = 1 and n >= 2 and n >= 0.5 * total
    """,
    "translit_aligned": f"with {VIEWS}, {ALIGNED.replace('{s}', clean('p_name')).replace('{l}', clean("concat_ws(' ', p_type, p_type)"))} select s, l, count(*) as n from aligned group by all",
    "grams": f"with {GRAMS} select id, gram, tf from tf",
    "gram_idf": f"with {WEIGHTS} select country, gram, df, round(idf, 9) as idf from idf",
    "gram_norms": f"with {WEIGHTS} select id, count(*) as grams, round(sum(w), 6) as total, round(max(w), 6) as most from unit group by id",
    "topk_shortlist": f"""
        with {WEIGHTS}, s as (
            select r.id as rec_id, c.id as cand_id, round(sum(r.w * c.w), 9) as score
            from unit r join unit c on c.country = r.country and c.gram = r.gram and r.id % 4 <> 0 and c.id % 4 = 0 group by all
        ), k as (select *, row_number() over (partition by rec_id order by score desc, cast(cand_id as varchar)) - 1 as rank from s)
        select rec_id, cand_id, cast(rank as int) as rank, score from k where rank < 3
    """,
    "shortlist_flat": f"with {VIEWS}, {SHORT} select rec_id, cand_id, rank, round(score, 9) as score from p_short",
    "shortlist_compact": f"""
        with {VIEWS}, {SHORT}, a as (select p.*, row_number() over (partition by rec_id order by rank) - 1 as r from p_short p join p_s1 s on s.entity_id = p.cand_id where s.k % 4 <> 0)
        select rec_id, cand_id, cast(r as int) as rank from a where r < 2
    """,
    "twins": TWINS.replace("{name}", core(clean("concat(p_name, ' ', p_type)"))).replace("{cap}", "200"),
    "twins_small_cap": TWINS.replace("{name}", core(clean("concat(p_name, ' ', p_type)"))).replace("{cap}", "5"),
    "deleted_random": f"""
        with {VIEWS}, f as (
            select country, entity_id as id, row_number() over (partition by country order by md5(country || '|' || entity_id || '|3407'), entity_id) as nth from p_s1 where k % 7 <> 0
        ), n as (select country, count(*) // 10 as m from p_s1 group by country)
        select f.country, f.id from f join n on n.country = f.country where nth <= m
    """,
    "n_to_delete": f"""
        with {VIEWS}, a as (select country, count(*) as n from p_s1 group by country),
        b as (select country, count(*) as m, count(*) + count(*) filter (where entity_id like '%1') as tested from p_ot group by country)
        select country, cast(greatest(0, n - round_even(m / (tested / n), 0)) as bigint) as n_delete from a join b using (country)
    """,
    "splits": f"with {VIEWS}, u as (select entity_id, {uniform('entity_id', 3407)} < 0.2 as is_val, {uniform('entity_id', 3408)} < 0.5 as tune from p_s1) select entity_id, is_val, is_val and tune as v_tune, is_val and not tune as v_report from u",
    "leak_guard": f"with {VIEWS}, {SHORT} select rec_id, cand_id, not bool_or(s.k % 5 = 1) over (partition by rec_id) as train from p_short p join p_s1 s on s.entity_id = p.cand_id",
    "labels": f"with {VIEWS}, {SHORT} select rec_id, cand_id, coalesce(t.source1_entity_id = p.cand_id, false) as y from p_short p left join p_truth t on t.other_id = p.rec_id",
    "true_match_count": f"with {VIEWS} select s.entity_id as cand_id, count(t.other_id) as k from p_s1 s left join p_truth t on t.source1_entity_id = s.entity_id group by s.entity_id",
    "feat_rank_block": f"""
        with {VIEWS}, {SHORT}, x as (
            select *, max(case when rank = 0 then score end) over (partition by rec_id) as top, coalesce(max(case when rank = 1 then score end) over (partition by rec_id), 0) as second from p_short
        ) select rec_id, cand_id, {rounded({'score': 'score', 'rank': 'rank', 'gap_top1': 'top - score', 'margin12': 'top - second'})} from x
    """,
    "feat_indegree": f"with {VIEWS}, {SHORT} select rec_id, cand_id, count(*) filter (where rank = 0) over (partition by cand_id) as in_degree, score >= max(score) over (partition by cand_id) as best_for_cand from p_short",
    "feat_numbers": f"{SHORTED} select p.rec_id, p.cand_id, {rounded(NUMBERS)} from {NUMS}",
    "feat_house_number": f"{SHORTED} select p.rec_id, p.cand_id, {rounded(HOUSE)} from {PAIRED}",
    "feat_crowd": f"{CROWD} select rec_id, cand_id, " + rounded({
        "grp_share_rec_num": where("others > 0 and rv is not null", "g_rec / others"), "grp_share_biz_num": where("others > 0 and cv is not null", "(g_biz - own) / others"),
        "grp_biz_is_majority": where("d > 0 and cv is not null", "g_biz = m"), "grp_distinct_nums": "d",
    }) + " from x",
    "feat_crowd_rank": f"with {VIEWS}, {SHORT} select p.rec_id, p.cand_id, count(o.rec_id) as grp_rank from p_short p left join p_short o on o.cand_id = p.cand_id and o.rank = 0 and o.score > p.score group by all",
    "feat_freq": f"""
        {SHORTED}, t as (select entity_id, n, {core('n')} as core from s1), f as (select n, count(*) as c from t group by n), g as (select core, count(*) as c from t group by core)
        select t.entity_id, round(ln(1 + f.c), 9) as freq_name, round(ln(1 + g.c), 9) as freq_core from t join f on f.n = t.n join g on g.core = t.core
        union all select o.entity_id, round(ln(1 + coalesce(f.c, 0)), 9), null from ot o left join f on f.n = o.n
    """,
    "feat_rarest_shared": f"""
        {SHORTED}, wf as (select w, count(*) as df from (select entity_id, unnest(list_distinct({words('n')})) as w from s1) group by w),
        sw as (select entity_id, unnest(list_distinct({words('n')})) as w from s1), rw as (select entity_id, unnest(list_distinct({words('n')})) as w from ot)
        select p.rec_id, p.cand_id, round(coalesce(ln(1 + min(wf.df)), -1.0), 9) as freq_rarest_shared
        from p_short p left join (rw join sw on sw.w = rw.w join wf on wf.w = rw.w) on rw.entity_id = p.rec_id and sw.entity_id = p.cand_id group by all
    """,
    "feat_shop_words": f"""
        {SHORTED}, rw as (select entity_id, unnest(list_distinct({words('n')})) as w from ot), sw as (select distinct unnest({words('n')}) as w from s1),
        shop as (select w from rw where w not in (select w from sw) group by w having count(*) >= greatest(20, 0.00015 * (select count(*) from ot)))
        select o.entity_id, count(shop.w) as shop_words from ot o left join (rw join shop on shop.w = rw.w) on rw.entity_id = o.entity_id group by o.entity_id
    """,
    "feat_legal": f"{SHORTED}, x as (select p.rec_id, p.cand_id, {forms('r.n')} as rf, {forms('c.n')} as cf from {NUMS}) select rec_id, cand_id, {rounded(LEGAL_ROWS)} from x",
    "feat_flags": f"with {VIEWS} select entity_id, starts_with(entity_id, 'S3') as is_s3, business_address is null as addr_missing, not regexp_matches(business_name, '[A-Za-z]') as name_no_latin, cast(length(business_name) as int) as name_len from p_ot",
    "sim_levenshtein": f"{SHORTED} select p.rec_id, p.cand_id, cast(levenshtein(r.n, c.n) as int) as distance from {NUMS}",
    "sim_common_prefix": f"""
        {SHORTED} select p.rec_id, p.cand_id,
        cast(list_max(list_filter(range(0, least(length(r.n), length(c.n)) + 1), lambda i: substr(r.n, 1, i) = substr(c.n, 1, i))) as int) as letters from {NUMS}
    """,
    "sim_jaro_winkler": f"{SHORTED} select p.rec_id, p.cand_id, round(jaro_winkler_similarity(r.n, c.n), 6) as similarity from {NUMS}",
    "address_tokens": f"with {VIEWS} select entity_id, array_to_string(regexp_extract_all(lower(coalesce(business_address, '')), '#+|[0-9]+|[a-z]+'), '|') as tokens from p_ot",
    "decide": f"{DECISION} select rec, cand, prob from ranked where best and prob >= 0.5",
    "best_top": f"{DECISION} select rec, cand, best, coalesce(case when top > 0 then top end, -1.0) as top from topped",
    "drawbridge": f"{DECISION} select rec, cand from ({kept('0.9', '0.9')})",
    "macro_f05": f"""{DECISION}, c as (select cand, count(*) filter (where y) as tp, count(*) filter (where not y) as fp from ({kept('0.9', '0.9')}) group by cand),
        f as (select b.k, case when b.k = 0 and coalesce(fp, 0) = 0 then 1.0 else 1.25 * coalesce(tp, 0) / (1.25 * coalesce(tp, 0) + 0.25 * (b.k - coalesce(tp, 0)) + coalesce(fp, 0)) end as f from biz b left join c on c.cand = b.cand)
        select round(avg(f), 9) as f05, round(avg(f) filter (where k = 0), 9) as f05_none, round(avg(f) filter (where k > 0), 9) as f05_some from f""",
    "accepted_per_s1": f"{DECISION} select round(count(*) / (select count(*) from biz), 9) as accepted from ({kept('0.9', '0.9')})",
    "floor_curve": f"{DECISION} {FLOOR_CURVE}",
    "tune_drawbridge": f"{DECISION} select * from ({FLOOR_CURVE}) order by f05 desc, floor, factor limit 1",
    "bar_curve": f"{DECISION} {BAR_CURVE}",
    "safe_range": f"""{DECISION}, b as ({BAR_CURVE}), m as (select *, f05 >= max(f05) over () - 0.01 as good, min(case when f05 = (select max(f05) from b) then bar end) over () as peak from b),
        r as (select *, sum(cast(not good as int)) over (order by bar) as run from m)
        select min(bar) as safe_lo, max(bar) as safe_hi from r where good and run = (select run from r where bar = peak)""",
    "count_bar": f"{DECISION}, p as (select prob, row_number() over (order by prob desc) as nth from ({kept('0.3', '0.5')})) select coalesce((select prob from p where nth = least(round_even(20.0 * (select count(*) from biz), 0), (select count(*) from p))), 1.0) as bar",
    "count_floor": f"""{DECISION}, t as (select top, count(*) as n from topped where best and prob >= 0.9 * top group by top), u as (select top, sum(n) over (order by top desc) as upto from t)
        select top as floor from u order by round(abs(upto - 3.0 * (select count(*) from biz)), 9), top desc limit 1""",
    "decide_test": f"""{DECISION}, p as (select rec, cand, prob, row_number() over (order by prob desc) as nth from ({kept('0.3', '0.5')})),
        b as (select least(greatest(coalesce((select prob from p where nth = least(round_even(20.0 * (select count(*) from biz), 0), (select count(*) from p))), 1.0), 0.4), 0.9) as bar)
        select rec, cand from p where prob >= (select bar from b)""",
    "rule_for": f"""
        with r as (select n_name as country, n_nationkey / 100.0 as floor, n_nationkey / 50.0 as factor, n_nationkey * 1.0 as target, n_nationkey / 40.0 as safe_lo, n_nationkey / 30.0 as safe_hi from nation),
        own as (select * from r where length(country) % 2 = 0),
        pooled as (select avg(floor) as floor, avg(factor) as factor, avg(target) as target, min(safe_lo) as safe_lo, max(safe_hi) as safe_hi from own)
        select r.country, {", ".join(f"round(coalesce(o.{x}, p.{x}), 9) as {x}" for x in ("floor", "factor", "target", "safe_lo", "safe_hi"))}
        from r left join own o on o.country = r.country cross join pooled p
    """,
    "tune_rule": f"""{DECISION.replace(" biz as", " every_biz as")}, biz as (select * from every_biz where cand % 2 = 0),
        r as (select floor, factor from ({FLOOR_CURVE}) order by f05 desc, floor, factor limit 1),
        k as (select t.* from topped t, r where t.best and t.top >= r.floor and t.prob >= r.factor * t.top),
        c as ({f05(f"select g.bar, k.cand, k.y from k cross join {grid('bar', BARS)} g where k.prob >= g.bar", "bar", grid("bar", BARS))}),
        b as (select bar from c order by f05 desc, bar limit 1),
        m as (select *, f05 >= max(f05) over () - 0.001 as good from c), runs as (select *, sum(cast(not good as int)) over (order by bar) as run from m),
        safe as (select min(bar) as safe_lo, max(bar) as safe_hi from runs where good and run = (select run from runs where bar = (select bar from b))),
        a as (select k.* from k, b where k.prob >= b.bar),
        odd as (select e.cand, e.k, count(*) filter (where a.y) as tp, count(*) filter (where not a.y) as fp from every_biz e left join a on a.cand = e.cand where e.cand % 2 = 1 group by all)
        select round(r.floor, 9) as floor, round(r.factor, 9) as factor, round(b.bar, 9) as bar, round(safe.safe_lo, 9) as safe_lo, round(safe.safe_hi, 9) as safe_hi,
            round((select count(*) from a where cand in (select cand from biz)) / (select count(*) from biz), 9) as target,
            round((select avg(case when k = 0 and fp = 0 then 1.0 else 1.25 * tp / (1.25 * tp + 0.25 * (k - tp) + fp) end) from odd), 9) as report from r, b, safe""",
    "pooled_rule": "select round(avg(n_nationkey / 100.0), 9) as floor, round(avg(n_nationkey / 50.0), 9) as factor, round(avg(n_nationkey * 1.0), 9) as target, round(min(n_nationkey / 40.0), 9) as safe_lo, round(max(n_nationkey / 30.0), 9) as safe_hi from nation",
    "band_blend": f"with {VIEWS} select rec, cand, round(case when prob > 0.05 and prob < 0.95 and rec % 2 = 0 then 1 - prob else prob end, 9) as blended from l_pairs",
    "trim_statistics": f"{DECISION} select round(count(*) filter (where prob >= 0.01) / (select count(*) from biz), 9) as pairs_per_business, round(count(*) filter (where prob >= 0.01 and y) / count(*) filter (where y), 9) as recall from l_pairs",
}
